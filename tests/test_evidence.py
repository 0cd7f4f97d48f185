import pytest
from pyspark.sql import functions as F

from graphmill.operators import evidence
from graphmill.sources.corpus import Corpus
from graphmill.streaming import correlate


@pytest.fixture(scope="module")
def corpus(spark):
    graphs = spark.createDataFrame([(1, "POST", "/a", "POST /a"), (2, "GET", "/b", "GET /b"), (3, "GET", "/c", "GET /c")], "graph_id long, method string, path string, entrypoint string")
    nodes = spark.createDataFrame([
        (1, 1, "ir:auth_gate", "ir:auth_gate", "Auth::handle", None, False, None),
        (1, 2, "ir:validation_gate", "ir:validation_gate", "StoreRequest::Authorize", None, False, None),
        (1, 3, "ir:authz_check", "ir:authz_check", "Gate", "PostPolicy", False, "update"),
        (1, 4, "ir:business_handler", "ir:business_handler", "PostController::store", None, True, None),
        (2, 1, "middleware", "ir:auth_gate", "Throttle::handle", None, False, None),
        (2, 2, "ir:service_call", "ir:service_call", "Mailer::send", None, False, None),
    ], "graph_id long, node_ord long, type string, ir_type string, symbol string, role string, mutates boolean, arg0 string")
    return Corpus(graphs, nodes, spark.createDataFrame([], "graph_id long, src long, dst long, relation string"))


@pytest.mark.parametrize("question, want", [
    ("", "all"), (None, "all"), ("what is this", "all"), ("Does the ROLE matter?", "auth"), ("event is sent before commit, who has access", "transaction"),
    ("tenant access", "isolation"), ("authorization request", "auth"), ("form request", "validation"), ("is it injected", "runtime"), ("preauth", "all"),
])
def test_focus(spark, question, want):
    assert spark.createDataFrame([(question,)], "q string").select(evidence.focus(F.col("q"))).first()[0] == want


def test_intents(spark):
    rows = spark.createDataFrame([(1, "Is the form request validated?"), (2, None), (3, "rollback the transaction: input validation"), (4, "nothing")], "k long, q string")
    got = {}
    for r in evidence.intents(rows, "k", "q").orderBy("k", "rank").collect():
        got.setdefault(r.k, []).append((r.intent, r.score, r.rank))
    assert got[1] == [("validation", 0.5, 1)]
    assert got[2] == got[4] == [("all", 0.0, 1)]
    # equal shares keep the listed order
    assert got[3] == [("validation", 0.5, 1), ("transaction", 0.25, 2)]


def test_merged_relevance():
    m = evidence.merged_relevance(["validation", "auth"])
    assert m["form_request"] == "high" and m["authz_check"] == "high" and m["permission"] == "high" and m["resource_bound"] == "medium"
    assert evidence.merged_relevance(["all"]) == {}


def test_facts(corpus):
    got = {(r.graph_id, r.fact): r for r in evidence.facts(corpus, ["auth"]).collect()}
    assert got[1, "authz_check"].value == "StoreRequest::Authorize, Gate" and got[1, "authz_check"].n == 2
    assert got[1, "ownership_check"].value == "Gate"
    assert got[1, "form_request"].present and got[1, "form_request"].relevance == "low"
    # types count as written: a legacy name is no auth_gate; what is lacking shows only if it matters much
    assert not got[2, "auth_middleware"].present and got[2, "auth_middleware"].value is None
    assert {f for g, f in got if g == 3} == set(evidence.RELEVANCE["auth"]["high"])
    assert (3, "resource_bound") not in got


def test_constraints(corpus, spark):
    out = evidence.check_constraints(corpus, [("no public", "HIGH", "FIND routes WHERE public"), ("bad", "LOW", "auth AND")]).collect()
    assert {(r.constraint, r.graph_id) for r in out if r.error is None} == {("no public", 3)}
    assert [(r.constraint, r.severity, r.graph_id) for r in out if r.error] == [("bad", "LOW", None)]
    assert evidence.check_constraints(corpus, []).count() == 0


def _spans(spark):
    rows = [
        ("s", 1, "r", None, "POST /a", 1_000_000, 9_000_000, {}),
        ("s", 2, "a", "r", "Auth::handle", 0, 1, {}),
        ("s", 3, "b", "r", "x", 0, 1, {"code.namespace": "App\\Http\\Controllers\\PostController", "code.function": "store"}),
        ("s", 4, "c", "r", "y", 0, 1, {"middleware.name": "Auth"}),
        ("s", 5, "d", "r", "StoreReq", 0, 1, {}),
        ("s", 6, "e", "r", "run Gate now", 0, 1, {}),
        ("s", 7, "f", "r", "GET /other", 0, 1, None),
        ("s", 8, "g", "r", "App\\Jobs\\Send", 0, 1, {}),
        ("s", 9, "h", None, "zzz", 0, 1, {}),
        ("s", 10, "i", "a", "db.select", 0, 1, {}),
        ("t", 1, "k", "gone", "loose", 0, 1, {}),
        ("u", 1, "l", "", "GET /b", 0, 2_500_000, {"http.route": "GET /b/{id}"}),
        ("u", 2, "m", "l", "q", 0, 1, {"middleware.name": "Throttle"}),
    ]
    s = spark.createDataFrame(rows, "session_id string, span_ord long, span_id string, parent_id string, name string, start_ns long, end_ns long, attributes map<string,string>")
    return s.withColumn("graph_id", F.when(F.col("session_id") == "s", 1).when(F.col("session_id") == "u", 2).cast("long"))


def test_sessions(spark):
    got = {r.session_id: (r.entrypoint, r.duration_ms) for r in correlate.sessions(correlate.normalise(_spans(spark))).collect()}
    assert got == {"s": ("POST /a", 8.0), "t": ("unknown", 0.0), "u": ("GET /b/{id}", 2.5)}
    routes = {r.span_id: (r.attributes or {}).get("http.route") for r in correlate.normalise(_spans(spark)).collect()}
    assert routes["r"] == "POST /a" and routes["f"] == "GET /other" and routes["l"] == "GET /b/{id}" and routes["a"] is None


def test_correlation(spark, corpus):
    spans = _spans(spark)
    c = correlate.correlate(spans, corpus.nodes)
    got = {r.span_id: (r.node_ord, r.strategy, r.confidence) for r in c.collect()}
    none = (None, "unmatched", "none")
    assert got == {
        "a": (1, "exact_symbol", "exact"), "b": (4, "namespace_function", "exact"), "c": none, "d": (2, "partial_symbol", "partial"),
        "e": (3, "partial_symbol", "partial"), "f": none, "g": none, "h": none, "k": none, "m": (1, "middleware_name", "high"),
    }
    under = correlate.infra_under(spans, c).collect()
    assert [(r.span_id, r.node_ord) for r in under] == [("i", 1)]
    gaps = {(r.session_id, r.category): (r.n, r.percent, r.examples) for r in correlate.gaps(spans, c).collect()}
    assert gaps["s", "queue_job"] == (1, 13, ["App\\Jobs\\Send"]) and gaps["s", "http_infra"] == (1, 13, ["GET /other"])
    assert gaps["s", "unknown"] == (2, 25, ["y", "zzz"]) and gaps["t", "unknown"] == (1, 100, ["loose"])
    rate = {r.session_id: (r.total, r.matched) for r in correlate.coverage(c).collect()}
    assert rate == {"s": (8, 4), "t": (1, 0), "u": (1, 1)}


@pytest.mark.parametrize("name, namespace, want", [
    ("x", "App\\Http\\Controllers\\A", "controller"), ("x", "app\\jobs\\A", "queue_job"), ("event.sent", None, "event_dispatch"), ("redis.get", "", "cache_infra"),
    ("db.insert", "Vendor\\Thing", "db_infra"), ("App\\Services\\Pay", None, "service"), ("Other\\Services\\Pay", None, "unknown"), ("laravel\\Queue\\RunJob", None, "queue_job"),
])
def test_category(spark, name, namespace, want):
    df = spark.createDataFrame([(name, namespace)], "n string, ns string")
    assert df.select(correlate.category(F.col("n"), F.col("ns"))).first()[0] == want
