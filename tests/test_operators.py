"""What SQL can't hold against: walks, renderers, files, verbs; each against a plain version on small graphs."""
import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphmill import engine, schema
from graphmill.functions import score
from graphmill.operators import analysis, detect, fluent, render
from graphmill.sources import loaders
from graphmill.sources.corpus import from_nested


def graphs(seed, n=12):
    """Random small graphs with cycles, of all kinds of nodes."""
    r = random.Random(seed)
    kinds = [*schema.NODE_TYPES, "service_call", "controller_action", "policy", "middleware"]
    out = []
    for g in range(n):
        size = r.randint(0, 7)
        nodes = [{"id": f"x{i}", "type": r.choice(kinds), "symbol": f"C{r.randint(0, 3)}::m{r.randint(0, 2)}", "args": r.choice([None, [], ["task.update"]]), "role": r.choice([None, "r"]), "mutates": r.random() < 0.5} for i in range(size)]
        edges = [{"from": f"x{r.randrange(size)}", "to": f"x{r.randrange(size)}", "relation": r.choice(["ir:calls", "calls", "ir:authorizes", "next_middleware"])} for _ in range(r.randint(0, 9) if size else 0)]
        out.append({"graph_id": g, "entrypoint": f"GET /{g}", "method": r.choice(["GET", "POST"]), "path": f"/{g}", "framework": "laravel", "nodes": nodes, "edges": edges, "annotations": []})
    return out


def corpus(spark, rows):
    shape = T.StructType([T.StructField("graph_id", T.LongType()), *schema.GRAPH.fields])
    full = lambda kind, x: tuple(x.get(f.name) for f in kind)
    data = [(g["graph_id"], g["entrypoint"], g["method"], g["path"], g["framework"], [full(schema.NODE, x) for x in g["nodes"]], [full(schema.EDGE, x) for x in g["edges"]], []) for g in rows]
    return from_nested(spark.createDataFrame(data, shape))


def breadth_first(g, starts):
    order, queue = [], list(starts)
    while queue:
        v = queue.pop(0)
        if v in order:
            continue
        order.append(v)
        queue += [e["to"] for e in g["edges"] if e["from"] == v and e["to"] not in order]
    return order


def test_paths_are_breadth_first(spark):
    rows = graphs(3, 40)
    c = corpus(spark, rows)
    got = {r.graph_id: [f"x{p - 1}" for p in r.path] for r in analysis.execution_paths(c).collect()}
    roots = {r.graph_id: r.path for r in fluent.paths_from_roots(c).collect()}
    for g in rows:
        kind = {x["id"]: x["type"] for x in g["nodes"]}
        start = [i for i in kind if kind[i] == "ir:entrypoint"][:1] or [i for i in kind if kind[i] == "ir:auth_gate"][:1] or list(kind)[:1]
        assert got[g["graph_id"]] == breadth_first(g, start)
        symbol = {x["id"]: x["symbol"] for x in g["nodes"]}
        entered = {e["to"] for e in g["edges"]}
        assert roots[g["graph_id"]] == [symbol[v] for v in breadth_first(g, [i for i in kind if i not in entered])]


def test_trees_end_at_cycles(spark):
    rows = graphs(4, 30)
    for r in render.tree(corpus(spark, rows)).collect():
        g = rows[r.graph_id]
        symbol = {x["id"]: x["symbol"] for x in g["nodes"]}
        out, seen = [], []

        def walk(v, depth):
            if v not in seen:
                seen.append(v)
                out.append("  " * depth + symbol[v])
                for e in g["edges"]:
                    if e["from"] == v:
                        walk(e["to"], depth + 1)

        for v in symbol:
            if v not in {e["to"] for e in g["edges"]}:
                walk(v, 0)
        assert r.text == "\n".join(out)


def test_cycles_of_classes():
    assert detect._cycles(["A", "B", "C"], [("A", "B"), ("B", "C"), ("C", "A"), ("C", "B")]) == [["A", "B", "C"], ["B", "C"]]
    assert detect._cycles(["A", "B"], [("A", "A"), ("A", "B")]) == [] and detect._cycles([], []) == []


def test_all_detectors_run_on_any_graph(spark):
    c = corpus(spark, [*graphs(5, 30), {"graph_id": 99, "entrypoint": "", "method": None, "path": None, "framework": None, "nodes": [], "edges": []}])
    found = detect.explain(c, "auth").collect()
    assert {r.type for r in found} >= {"resource_unprotected", "dead_middleware"} or found
    assert all(len(r.id.rsplit("-", 1)[1]) == 8 for r in found)
    firsts = [r for r in found if r.rank == 1]
    focus = detect.FOCUS_TYPES["auth"]
    assert all(r.type in focus for r in firsts if any(x.graph_id == r.graph_id and x.type in focus for x in found))
    assert render.markdown(detect.explain(c)).where("text like '# Analysis%'").count() == len({r.graph_id for r in found})


def test_handler_lines(spark):
    source = "class A {\n  public function show() {}\n  async save ( x) {}\n}"
    rows = spark.createDataFrame([(source, "A::show"), (source, "A::save"), (source, "A::none"), (source, "A")], "source string, symbol string")
    assert [r[0] for r in rows.select(analysis.handler_line()).collect()] == [2, 3, 1, 1]


def test_otlp_files(spark, tmp_path):
    a = lambda k, **v: {"key": k, "value": v}
    doc = {"resourceSpans": [{"resource": {"attributes": [a("service.version", stringValue="1.2")]}, "scopeSpans": [{"scope": {"name": "s"}, "spans": [
        {"traceId": "t1", "spanId": "a", "name": "GET /x", "kind": 1, "startTimeUnixNano": "1000000", "endTimeUnixNano": "3000000", "attributes": [a("n", intValue=3), a("n", intValue=4), a("b", boolValue=True)]},
        {"traceId": "t1", "spanId": "b", "parentSpanId": "a", "name": "db.select", "kind": 1, "startTimeUnixNano": "1", "endTimeUnixNano": "2"}]}]}, {"scopeSpans": []}]}
    (tmp_path / "one.json").write_text(json.dumps(doc))
    (tmp_path / "two.json").write_text("{}")
    got = loaders.read_otlp(spark, f"file://{tmp_path}").orderBy("span_ord").collect()
    assert [(r.session_id, r.span_ord, r.span_id, r.parent_id, r.name, r.start_ns, r.service_version) for r in got] == [("t1", 1, "a", None, "GET /x", 1000000, "1.2"), ("t1", 2, "b", "a", "db.select", 1, "1.2")]
    assert got[0].attributes == {"n": "4", "b": "true"} and got[1].attributes == {}


def test_yaml_and_front_matter(spark, tmp_path):
    text = "# golden\nid: g-1\nentrypoint: 'GET /x/{id}'\nnodes:\n  - id: n1\n    type: ir:auth_gate\n    symbol: A::b\n    args: [x, \"y z\"]\n    retrieval:\n      relevance: HIGH   # must be there\n  - id: n2\n    type: policy\n    symbol: P\nedges:\n- from: n1\n  to: n2\n  relation: calls\n  via: |\n    one\n    two\n- from: n2\n  relation: dangling\n"
    assert loaders.yaml(text)["nodes"][0] == {"id": "n1", "type": "ir:auth_gate", "symbol": "A::b", "args": ["x", "y z"], "retrieval": {"relevance": "HIGH"}}
    (tmp_path / "a.yaml").write_text(text)
    (tmp_path / "bad.yaml").write_text("- just\n- a list")
    got = loaders.read_goldens(spark, f"file://{tmp_path}").collect()
    assert len(got) == 1 and got[0].trace == "g-1" and got[0].entrypoint == "GET /x/{id}" and [n.relevance for n in got[0].nodes] == ["HIGH", None]
    assert [(e.src, e.dst, e.mechanism) for e in got[0].edges] == [("n1", "n2", "one\ntwo")]
    (tmp_path / "rules.yml").write_text("version: 1\nrules:\n  - name: no public writes\n    query: mutation AND public\n    severity: HIGH\n  - name: lacks a query\n    severity: LOW\n")
    assert [(r.name, r.query) for r in loaders.read_constraints(spark, f"file://{tmp_path}/rules.yml").collect()] == [("no public writes", "mutation AND public")]
    for name, body in (("b.md", "---\nid: b\nentrypoint: GET /b\nexpected_nodes:\n  - A::x\nexpected_edges:\n  - A -> B\n---\n# text"), ("a.md", "---\nid: a\nentrypoint: GET /a\nexpected_nodes:\n  - B\n---\n"), ("c.md", "no front matter"), ("d.md", "---\nid: d\n---\n")):
        (tmp_path / name).write_text(body)
    assert [(r.trace, r.nodes, r.edges, r.framework) for r in loaders.read_specs(spark, f"file://{tmp_path}").collect()] == [("a", ["B"], [], "laravel"), ("b", ["A::x"], ["A -> B"], "laravel")]
    assert loaders.json_in('Sure: {"a": {"b": 1}} ok') == {"a": {"b": 1}} and loaders.json_in("none") is None


def test_scores_of_lists_that_are_empty_or_missing(spark):
    rows = spark.createDataFrame([("none", "LOW", None, None, ["a b"], "none", "low", [], None, None)], "finding_type string, severity string, key_nodes array<string>, explanation string, recommendations array<string>, want_finding_type string, want_severity string, want_key_nodes array<string>, want_explanation array<string>, want_recommendations array<array<string>>")
    assert score.answer_scores(rows).first().score == 1.0 and score.turn_scores(rows).first().passed
    runtime = score.runtime_scores(spark.createDataFrame([("s", "slow_query", "orders", 2), ("s", "n_plus_one", None, None)], "session_id string, type string, contains string, least int"), spark.createDataFrame([("s", "slow_query", "on orders", 1), ("s", "n_plus_one", "x", None)], "session_id string, type string, evidence string, n int"))
    assert runtime.first().recall == 0.5
    e = score.explainer_scores(spark.createDataFrame([(1, "a", ["x"]), (1, "b", ["y", "z"])], "graph_id long, type string, nodes array<string>"), spark.createDataFrame([(1, "a", ["y"])], "graph_id long, type string, nodes array<string>"))
    assert (e.first().recall, round(e.first().coverage, 6)) == (0.5, 0.333333)
    q = score.question_scores(spark.createDataFrame([("q", ["B", "zz"], ["a::b"], "f", "f", "auth", "all")], "id string, want_evidence array<string>, evidence array<string>, want_finding string, finding string, want_intent string, intent string")).first()
    assert (q.precision, q.score) == (0.5, 0.55)
    pain = score.pain_scores(spark.createDataFrame([("t", ["A::x", "none"], ["a -> B", "no arrow"])], "trace string, nodes array<string>, edges array<string>"), spark.createDataFrame([("t", [(1, "A::x"), (2, "B::y")], [(1, 2)])], "trace string, n array<struct<ord: long, symbol: string>>, e array<struct<src: long, dst: long>>")).first()
    assert (pain.node_recall, pain.edge_recall, pain.passed) == (0.5, 0.5, False)


def test_verbs(spark, tmp_path):
    e = engine.Engine(corpus(spark, graphs(6, 20)))
    assert e.list_entrypoints().count() == 20 and e.execution_graph("GET /{id}").count() in (0, 1)
    for p in ("auth", "event", "transaction", "isolation", "side_effects"):
        assert e.trace(p).columns[:2] == ["graph_id", "entrypoint"]
    steps = e.trace("request", "GET /1").orderBy("step").collect()
    assert [r.step for r in steps] == list(range(len(steps)))
    assert e.context().count() == 20 and e.visualize().count() == 20 and e.query("public").count() >= 0 and e.dependents("C1").count() >= 0
    assert e.evidence_package("who has access?").count() == 20
    path = f"file://{tmp_path}/base"
    e.baseline(path)
    assert e.verify(path).first().ok and e.diff(path).where("status <> 'same'").count() == 0
    assert not e.verify(path, constraints=[("none", "HIGH", "public OR auth")]).first().ok
    half = e.only(F.col("graph_id") < 10)
    assert half.diff(path).where("status = 'gone' and regressed").count() == 10
    for at in ("2024-01-01T00-00-00Z", "2024-02-01T00-00-00Z"):
        e.snapshot(f"file://{tmp_path}/snaps", at)
    assert [r.snapshot for r in loaders.list_snapshots(spark, f"file://{tmp_path}/snaps").collect()] == ["2024-02-01T00-00-00Z", "2024-01-01T00-00-00Z"]
    assert e.history(f"file://{tmp_path}/snaps").where("lost <> '' or gained <> ''").count() == 0
    golden = spark.createDataFrame([("GET /1", "g", "C", "ir:service_call", "HIGH")], "trace string, golden_id string, symbol string, type string, relevance string")
    assert e.benchmark(golden).count() == 1
    e.invalidate_cache()


def test_frameworks(spark):
    rows = [("a", "nest-cli.json", ""), ("b", "go.mod", "require github.com/gin-gonic/gin v1"), ("c", "go.mod", "other"), ("d", "app/pom.xml", "spring-boot-starter")]
    got = engine.detect_framework(spark.createDataFrame(rows, "project string, path string, content string")).collect()
    assert {r.project: r.framework for r in got} == {"a": "nestjs", "b": "go", "c": "laravel", "d": "springboot"}


@pytest.mark.parametrize("question, words", [("What is the Order flow?", ["order", "flow"]), (None, []), ("a of", [])])
def test_words_of_questions(question, words):
    from graphmill.operators.retrieve import keywords
    assert keywords(question) == words
