"""Source text as rows of syntax, facts over them, expansion within a budget, routes over includes."""
import random

import pytest
from pyspark.sql import functions as F

from graphmill.operators import augment, routing
from graphmill.operators.code import Facts, imports, outermost, stabbed
from graphmill.sources.syntax import Reader, syntax

FILES = "project string, path string, content string"


def read(spark, **files):
    return syntax(spark.createDataFrame([("p", k.replace("_", "/") + ".php", v) for k, v in files.items()], FILES)).cache()


@pytest.mark.parametrize("text", ["", "((('{", "<?php class", "$a->", "function f(", "if (", "use A\\{B", "Route::get('x'", "[", "'unterminated", "$x = [1, => 2", "a::", "new", "return", "const A =", "if ($a) throw", "}}}]", "<<<EOT\nx", "#[Attr] class A {}", "fn", "x(" * 3000])
def test_texts_that_break_off_are_read_as_far_as_they_go(text):
    rows = Reader(text).read()
    assert all(0 <= r["at"] <= r["end"] <= len(text) for r in rows)


def test_strings_comments_and_brackets_hide_code():
    text = """<?php class A { function f() { /* $this->no(); */ // $this->no();
      # $this->no();
      $x = 'a->b("c")'; $y = "$this->no()"; $this->yes('it''s', [1, "(", ')']); return <<<T
      $this->no(
      T; } }"""
    calls = [r for r in Reader(text).read() if r["kind"] == "call"]
    assert [r["name"] for r in calls] == ["yes"] and [a["kind"] for a in calls[0]["args"]][-1] == "array"


def test_files_without_text_have_no_rows(spark):
    s = syntax(spark.createDataFrame([("p", "a", None), ("p", "b", ""), ("p", "c", "<?php const X = 'y';")], FILES))
    assert [(r.path, r.name) for r in s.collect()] == [("c", "X")]


def test_spans_against_all_pairs(spark):
    """Nested spans, made by splitting at random: the window finds what comparing all pairs finds."""
    r, spans = random.Random(5), []

    def split(a, b):
        if b - a > 3 and len(spans) < 400:
            spans.append((r.randint(0, 1), a, b))
            m = r.randint(a + 1, b - 1)
            for x, y in ((a + 1, m), (m, b - 1)):
                if r.random() < 0.8:
                    split(x, y)
    for k in range(6):
        split(k * 2000, k * 2000 + 1999)
    df = spark.createDataFrame(sorted(set(spans)), "k int, at int, end int")
    inside = lambda p, q: p[0] == q[0] and q[1] <= p[1] and p[2] <= q[2] and p != q
    tops = {p for p in set(spans) if not any(inside(p, q) for q in spans)}
    assert {tuple(x) for x in outermost(df, ["k"]).collect()} == tops
    points = df.join(spark.createDataFrame(sorted(tops), "k int, at int, end int"), ["k", "at", "end"], "left_anti")
    got = {(x.k, x.at, x.end): x.name for x in stabbed(points, spark.createDataFrame([(*t, str(t)) for t in sorted(tops)], "k int, at int, end int, name string"), ["k"], ["name"]).collect()}
    assert got == {p: str(next(t for t in tops if inside(p, t))) for p in set(spans) - tops if any(inside(p, t) and t[1] < p[1] for t in tops)}


NESTED = r"""<?php
namespace App\Http\Controllers;
use App\Services\Repo;
class AController {
  public function __construct(private Repo $repo) {}
  public function a($x) {
    DB::transaction(function () use ($x) {
      $x->save();
      foreach ($x->all() as $y) { \DB::transaction(fn () => User::create(['a' => 1])); dispatch(new SendIt($y)); }
      $this->helper(); $this->repo->put('k');
    }, 5);
    DB::transaction('not a closure'); Late::dispatch(); $x->delete();
  }
  public function b() { DB::table('x')->update([]); return Task::with(['u' => fn ($q) => $q->where('tenant_id', 1)])->where('x', User::find(1))->get(); }
  public function c($m) { if ($m) { return 1; } if (!$m) abort(404); Task::where('x')->first(); $t = new Task; $t->save(); app('Tenant'); }
  private function ensureC($m) { $a = 1; if (!$m) { log(1); throw new X(); } }
  private function helper() { if (!$this->ok()) { abort(401); } }
}"""


def test_transactions_accesses_and_guards(spark):
    f = Facts(read(spark, a=NESTED))
    held = {(r.method, r.block, r.kind, r.ord): r.name for r in f.in_transactions().collect()}
    assert held == {("a", 0, "write", 0): "unknown::save", ("a", 0, "write", 1): "User::create", ("a", 0, "escape", 0): "SendIt", ("a", 0, "nested", 0): "/helper", ("a", 0, "nested", 1): "repo/put"}
    a = {(r.method, r.kind, r.ord): (r.model, r.operation, r.constrained) for r in f.accesses().collect()}
    assert a == {("a", "write", 0): ("$x", "save", False), ("a", "write", 1): ("User", "create", False), ("b", "read", 0): ("Task", "get", True), ("c", "read", 0): ("Task", "first", False), ("c", "write", 0): ("$t", "save", False)}
    assert {r.method: (r.reason, r.condition) for r in f.guards.collect()} == {"ensureC": ("guard_naming_with_throw", "!$m"), "helper": ("leading_if_throw", "!$this->ok()")}
    assert [r.method for r in f.container_reads().collect()] == ["c"]
    assert {(r.method, r.a, r.c) for r in f.dispatches().collect()} == {("a", "Late", "unknown")}
    assert {(r.method, r.a) for r in f.self_guards().collect()} == {("a", "helper")}


def plain_expansion(start, calls, costs, budget, weights):
    seen, left, out, now = set(), budget, [], start
    for level in (1, 2):
        if left <= 0:
            break
        line = sorted(now, key=lambda m: -weights(m)) if left < budget / 2 else now
        following = []
        for m in line:
            if left <= 0 or m in seen:
                continue
            seen.add(m)
            out.append((level, m, costs.get(m, 0), left))
            left -= costs.get(m, 0)
            following += calls.get(m, [])
        now = following
    return out


def test_an_expansion_keeps_its_budget(spark):
    names = ["CacheThing", "AuthCheck", "Plain", "AuditLog", "TenantScope"]
    body = lambda n, k: f"<?php\nuse App\\S\\{{{', '.join(names)}}};\nclass {n} {{ public function __construct({', '.join(f'private {x} $p{i}' for i, x in enumerate(names))}) {{}}\n public function m() {{ {' '.join(f'Task::find({j});' for j in range(k))} {' '.join(f'$this->p{j}->m();' for j in range(k + 1) if j < 5)} }} }}"
    files = {f"app/S/{n}": body(n, k) for k, n in enumerate(names)}
    files["app/C"] = body("C", 2).replace("$this->p2->m()", "$this->p4->m()")
    s = syntax(spark.createDataFrame([("p", f"{k}.php", v) for k, v in files.items()], FILES)).cache()
    p = augment.Passes(Facts(s))
    entries = spark.createDataFrame([(1, "p", "app/C.php", "C", "m", "h"), (2, "p", "app/None.php", "N", "m", "h")], "graph_id long, project string, path string, class string, method string, caller string")
    start = augment.roots(entries, p, s).cache()
    path = lambda n: f"app/S/{n}.php"
    weights = lambda m: next((w for w, x in ((4, "Auth"), (3, "Tenant"), (2, "Log"), (1, "Cache")) if x in m), 0)
    calls = {path(n): [path(names[j]) for j in range(min(k + 1, 5))] for k, n in enumerate(names)}
    costs = {path(n): k + min(k + 1, 5) for k, n in enumerate(names)}
    for budget in (1, 9, 50):
        got = augment.expanded(start, p, budget=budget)[2]
        have = [(r.level, r.path, r.cost, r.left) for r in got.orderBy("level", "nth").collect()]
        assert have == plain_expansion([path(names[0]), path(names[1]), path(names[4])], calls, costs, budget, weights)


def test_routes_over_includes_with_a_cycle(spark):
    s = read(spark, routes_a=r"""<?php
      Route::prefix('v1')->namespace('Sales')->group(function () { Route::middleware(['auth', X::class])->group(function () { require __DIR__ . '/b.php'; include(__DIR__ . '/../outside/../../gone.php'); }); });
      Route::resource('r', 'RController')->except('create', 'edit', 'update');""", routes_b=r"""<?php
      use App\Y as Z; require 'routes/a.php'; require __DIR__ . '/b.php'; require 'routes/c.php';
      Route::get('/', 'Deep\IController@show'); Route::put('/z/', [Z::class, 'go'])->middleware('can:x', 'y'); Route::get('closure', function () {}); Route::get('one', One::class);""", routes_c="<?php Route::delete('c', '\\Q\\C@x');")
    c = routing.chains(s).cache()
    ways = routing.contexts(s, c, spark.createDataFrame([("p", "routes/a.php")], "project string, path string"))
    assert sorted((w.path, w.prefix, w.depth) for w in ways.collect()) == [("routes/a.php", "", 0), ("routes/b.php", "/v1", 1), ("routes/c.php", "/v1", 2)]
    got = {(r.method, r.path): (r.middleware, r.handler, r.action) for r in routing.routes(s, c, ways, imports(s)).collect()}
    both = ["auth", "X"]
    assert got == {
        ("GET", "/v1/"): (both, "Sales\\Deep\\IController", "show"), ("PUT", "/v1/z/"): ([*both, "can:x", "y"], "App\\Y", "go"), ("GET", "/v1/closure"): (both, "Sales\\Closure", "invoke"), ("GET", "/v1/one"): (both, "Sales\\One", "__invoke"),
        ("DELETE", "/v1/c"): (both, "Q\\C", "x"), **{(m, "/r" + t): ([], "App\\Http\\Controllers\\RController", a) for m, t, a in (("GET", "", "index"), ("POST", "", "store"), ("GET", "/{id}", "show"), ("DELETE", "/{id}", "destroy"))}}
    assert routing.aliases(s).count() == 0 and routing.starts(s).count() == 0


def test_paths(spark):
    x = spark.createDataFrame([("a/b.php", "__DIR__ . '/../c.php'"), ("b.php", "__DIR__.'/../c.php'"), ("a/b.php", "base_path('x/./y.php')"), ("a", "$z . 'x'"), ("a", "'r/q.php'")], "path string, text string")
    assert [r[0] for r in x.select(routing.required(F.col("text"), F.col("path"))).collect()] == ["c.php", None, "x/y.php", None, "r/q.php"]


def test_declared_shapes(spark):
    from graphmill.operators import shapes
    s = read(spark, app_Http_Requests_A=r"""<?php class A extends FormRequest { public function rules(): array { return [
        'a' => 'required|integer|between:1,9|unknown', 'b.*.c' => ['between:1,2', 'numeric', 'max:3', Rule::in(['x'])], "d" => 'in:a, b|nullable|regex:/x/', 'a' => ['email'], 'e' => new Thing, 5 => 'date' ]; } }""", app_Providers_EventServiceProvider=r"""<?php use App\L\One; use App\L\Two as Deux;
        class EventServiceProvider { protected $listen = [E::class => [One::class, Deux::class], 'App\\Events\\F' => ['App\\L\\Three'], G::class => 'App\L\One', H::class => []]; }""", app_L_One="<?php class One implements ShouldHandleEventsAfterCommit {}", app_L_Two="<?php class Two { public bool $afterCommit = true; }", app_L_Three="<?php class Three { public $afterCommit = false; }")
    rules = {r.name: (r.type, [(x.kind, x.value) for x in r.rules]) for r in shapes.field_rules(s).collect()}
    assert rules == {"a": ("number", [("required", None), ("integer", None), ("min", "1"), ("max", "9")]), "b.*.c": ("number", [("minLength", "1"), ("maxLength", "2"), ("max", "3")]), "d": ("string", [("isIn", "a,b"), ("optional", None), ("regex", "/x/")]), "5": ("string", [("date", None)])}
    heard = shapes.listeners(s).cache()
    assert sorted((r.event, r.listener, r.after_commit) for r in heard.collect()) == [("E", "App\\L\\One", True), ("E", "App\\L\\Two", True), ("F", "App\\L\\Three", False)]
    escapes = spark.createDataFrame([(1, "p", "E"), (1, "p", "F"), (2, "q", "E")], "graph_id long, project string, event string")
    assert sorted((r.graph_id, r.event, r.safe) for r in shapes.listened(escapes, heard).distinct().collect() if r.safe is not None) == [(1, "E", True), (1, "E", True), (1, "F", False)]
    assert shapes.listened(escapes, heard).where("graph_id = 2 and listener is null and safe is null").count() == 1


def test_usage_against_a_search_for_each_name(spark):
    from graphmill.operators import inventory
    r, names = random.Random(2), ["Ship", "ShipIt", "ReShip", "Ping", "Pi"]
    pieces = [f"dispatch(new {n}X(1));" for n in names] + [f"A{n}::dispatch();" for n in names] + [f"new {n}(2);" for n in names] + [f"event(new {n});" for n in names] + ["Bus::chain([]);", "X::collection(1);", "é::dispatch("] + [f"{n}::collection($x)" for n in names]
    files = [("p", f"app/{d}/{n}.php", f"<?php\nnamespace N;\nclass {n} {{}}") for d in ("Jobs", "Events", "Http/Resources") for n in names]
    files += [("p", f"app/Services/S{k}.php", "\n".join(r.choices(pieces, k=3))) for k in range(60)] + [("q", "app/Services/S.php", "dispatch(new Ship)"), ("p", "app/Jobs/Null.php", None)]
    df = spark.createDataFrame(files, FILES)
    want = set()
    for p, path, text in files:
        for n in names if p == "p" and text else []:
            job = f"dispatch(new {n}" in text or f"{n}::dispatch(" in text
            if job or f"new {n}" in text and "chain(" in text:
                want.add((path, "queue_job", n, not job))
            if f"event(new {n}" in text or f"{n}::dispatch(" in text:
                want.add((path, "event_dispatch", n, False))
            if f"new {n}(" in text or f"{n}::collection(" in text:
                want.add((path, "api_resource", n, False))
    got = inventory.usage(df)
    assert {(x.path, x.category, x.name, x.chained) for x in got.collect()} == want
    plan = got._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
