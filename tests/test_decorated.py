"""Decorated fields of TypeScript classes and their rules."""
import pytest

from graphmill.operators import shapes
from graphmill.sources.decorated import ClassReader, decorated

FILES = "project string, path string, content string"


@pytest.mark.parametrize("text", ["", "export class", "export class A", "export class A {", "export class A { @", "export class A { @X(", "export class A { @X() a", "export class A { @X() a:", "'open", "`", "export class A { @M(/a", "}}}", "export class A { @X() a: {", "export class A {" + "@X(" * 2000])
def test_texts_that_break_off_are_read_as_far_as_they_go(text):
    assert all(r["class"] == "A" for r in ClassReader(text).read())


def rules(spark, *files):
    x = shapes.decorated_rules(decorated(spark.createDataFrame(list(files), FILES))).orderBy("project", "path", "class", "ord").collect()
    return [(r["class"], r["name"], r["type"], [(q.kind, q.value) for q in r["rules"]]) for r in x]


def test_rules_of_decorators(spark):
    text = '''
@ApiModel() export class Order<T extends X> implements Y {
  @IsNotEmpty() @IsEmail() mail: string;   @IsOptional() note?: string | null
  @Min(1.5) @Max( 7 ) @Min(x) private readonly n!: number = 3
  @Length(2) short: string; @Length(x, 9) long: string;
  @IsIn(["a)", 'b']) @IsEnum( Kind ) @IsEnum() kind: Kind |
    Other;
  @Matches(/^[)"]{2,}$/) @Matches(NAMED) code: Record<string, {a: string}>
  @Type(() => Item) items: Item[];
  @IsString() get x(): string { return 'y: z'; }
  @Inject() constructor(@Inject() a: A, private b: B) { this.c = { d: 1 }; }
  after: string;
  @IsBoolean()
  ok: boolean | null;
}
export class Empty {}
export abstract class Not { @IsString() a: string; }'''
    assert rules(spark, ("p", "a.ts", text), ("p", "b.spec.ts", text), ("p", "c.ts", None), ("p", None, text), ("p", "node_modules/x.ts", text)) == [
        ("Order", "mail", "string", [("required", None), ("email", None)]), ("Order", "note", "string", [("optional", None)]),
        ("Order", "n", "number", [("required", None), ("min", "1.5"), ("max", "7")]), ("Order", "short", "string", [("required", None), ("minLength", "2")]), ("Order", "long", "string", [("required", None), ("maxLength", "9")]),
        ("Order", "kind", "unknown", [("required", None), ("isIn", "a),b"), ("enum", "Kind")]), ("Order", "code", "object", [("required", None), ("regex", '/^[)"]{2,}$/')]),
        ("Order", "items", "array", [("required", None)]), ("Order", "ok", "boolean", [("required", None), ("boolean", None)])]


def test_rules_apart(spark):
    schema = "project string, path string, class string, ord int, name string, type string, rules array<struct<kind:string,value:string>>"
    a = spark.createDataFrame([("p", "a", "OrderRequest", 0, "n", "string", [("required", None), ("min", "1")]), ("p", "a", "OrderRequest", 1, "same", "string", [("email", None)]), ("p", "a", "OrderRequest", 2, "one", "string", [])], schema)
    b = spark.createDataFrame([("p", "b", "OrderDto", 0, "n", "string", [("min", "2"), ("required", None)]), ("p", "b", "OrderDto", 1, "same", "string", [("email", None)]), ("q", "b", "OrderDto", 1, "n", "string", [("email", None)])], schema)
    assert sorted((r.project, r.subject, r.name, r.only_a, r.only_b) for r in shapes.rules_apart(a, b).collect()) == [("p", "Order", "n", ["min:1"], ["min:2"]), ("q", "Order", "n", [], ["email"])]
    assert shapes.rules_apart(a.limit(0), b.limit(0)).count() == 0
