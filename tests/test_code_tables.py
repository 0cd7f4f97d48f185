"""Tables of facts are made when asked for, and a reader's rows become Arrow columns as they would one by one."""
import pyarrow as pa
from pyspark.sql.pandas.types import to_arrow_schema

from graphmill.operators import augment
from graphmill.operators.code import FACT, KINDS, Facts
from graphmill.sources import syntax

TEXT = r"""<?php class AController { public function store(SaveRequest $r, Item $i) { if (!$i) { abort(404); } $this->authorize('see', $i); Ship::dispatch($i); $i->notify(new Told()); return Item::where(['a' => [1, 'b']])->get(); } }"""


def kept():
    names = []

    def keep(df, name):
        names.append(name)
        return df
    return names, keep


def test_only_what_is_asked_for_is_written(spark):
    s = syntax.syntax(spark.createDataFrame([("p", "a.php", TEXT)], "project string, path string, content string"))
    names, keep = kept()
    f = Facts(s, keep)
    assert [(r.method, r.reason) for r in f.guards.collect()] == [("store", "leading_if_throw")]
    assert names == ["methods", "guards"]
    names, keep = kept()
    p = augment.Passes(Facts(s, keep), keep=keep)
    entries = spark.createDataFrame([(1, "p", "a.php", "AController", "store", "handler")], "graph_id long, project string, path string, class string, method string, caller string")
    files = spark.createDataFrame([("p", "a.php")], "project string, path string")
    assert [(r.type, r.node) for r in p.missing_policies(entries, files).collect()] == [("missing_policy", "policy_apolicy_see")]
    assert [n for n in names if n.startswith("facts-")] == ["facts-authorize"] and not {"service-sites", "branches", "held"} & set(names)
    facts = Facts(s, kept()[1])
    one = [tuple(r) for k in KINDS for r in facts.of(k).where(f"kind = '{k}'").select(*FACT).collect()]
    assert sorted(one, key=str) == sorted((tuple(r) for r in facts.all().select(*FACT).collect()), key=str) and len(one) >= 4


def test_columns_are_those_of_rows():
    shape = to_arrow_schema(syntax.SYNTAX)
    rows = syntax.Reader(TEXT).read() + [{"kind": "x", "args": None}, {"kind": "y", "args": []}]
    assert any(r.get("args") for r in rows)
    for f in shape:
        assert syntax._column([r.get(f.name) for r in rows], f.type).to_pylist() == pa.array([r.get(f.name) for r in rows], f.type).to_pylist()
    assert len(syntax._column([], shape.field("args").type)) == 0


def test_calls_find_their_method_without_a_join(spark):
    text = "<?php class B { function a() { $this->c(); x(); $o = new class { function a() { y(); } function d() { $this->e(); } }; } function c() { z(); } function a() { w(); } function e() { v(); } }"
    rows = syntax.Reader(text).read()
    first = {}
    for r in sorted((r for r in rows if r["kind"] == "method"), key=lambda r: r["at"]):
        first.setdefault(r["name"], (r["at"], r["end"]))
    inside = lambda r: r["method"] in first and first[r["method"]][0] <= r["at"] and r["end"] <= first[r["method"]][1]
    assert all(r["placed"] == inside(r) for r in rows)
    assert {r["name"]: r["shared"] for r in rows if r["kind"] == "call" and r["placed"]} == {"c": False, "x": False, "y": False, "e": False, "z": True, "v": True}
    s = syntax.syntax(spark.createDataFrame([("p", "b.php", text)], "project string, path string, content string"))
    f = Facts(s, kept()[1])
    assert sorted(r.name for r in f.calls.collect()) == ["c", "e", "v", "x", "y", "z"]
    assert sorted((r.method, r.source, r.name) for r in f.every.where("rank > 0").collect()) == [("a", "c", "z"), ("d", "e", "v")]
    plan = f.calls._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Window" not in plan
    held = f.in_transactions()._jdf.queryExecution().optimizedPlan().toString()
    assert "args" not in held.split("Union")[0]  # what stands above the union is shuffled
