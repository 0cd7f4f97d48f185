"""Routes as tools show them: facts with their lists, route infos and findings, semantic context, traces, execution paths, evidence.

All are expressions over the nested row of a graph (``sources.corpus.nested``).
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import INDEXED, MUTATIONS, SEVERITY, level
from ..sources.corpus import Corpus, nested
from . import detect

# fixed values: words of throttling middleware and of paths that take credentials
THROTTLE = r"(?i)throttl|ratelimit|rate.?limit"
CREDENTIALS = r"(?i)login|signin|auth|token|password"
# fixed values: roles of node types in requests and in evidence, and the types that evidence of a focus shows
REQUEST_ROLES = {
    "ir:auth_gate": "middleware", "ir:authz_check": "policy", "ir:business_handler": "controller", "ir:validation_gate": "form_request",
    "ir:service_call": "service", "ir:resource": "resource", "ir:txn_boundary": "transaction", "ir:txn_write": "txn_write",
    "ir:txn_escape": "event", "ir:unscoped_query": "unscoped_query", "ir:unscoped_write": "unscoped_write", "ir:tenant_context": "tenant_context",
}
EVIDENCE_ROLES = {
    "ir:auth_gate": "middleware", "ir:authz_check": "policy", "ir:business_handler": "controller", "ir:validation_gate": "form_request",
    "ir:service_call": "service", "ir:permission_constant": "permission", "ir:resource": "resource", "ir:runtime_inject": "runtime_injector",
    "ir:runtime_consume": "runtime_consumer", "ir:tenant_context": "tenant_context", "ir:scoped_query": "scoped_query",
    "ir:unscoped_query": "unscoped_query", "ir:unscoped_write": "unscoped_write", "ir:txn_boundary": "transaction",
    "ir:txn_write": "txn_write", "ir:txn_escape": "txn_escape",
}
FOCUS_NODES = {
    "auth": ("ir:auth_gate", "ir:authz_check", "ir:business_handler", "ir:validation_gate", "ir:permission_constant", "ir:resource"),
    "validation": ("ir:validation_gate", "ir:business_handler"),
    "runtime": ("ir:runtime_inject", "ir:runtime_consume", "ir:tenant_context"),
    "transaction": ("ir:txn_boundary", "ir:txn_write", "ir:txn_escape"),
    "isolation": ("ir:scoped_query", "ir:unscoped_query", "ir:unscoped_write", "ir:tenant_context"),
}


def symbols(*kinds: str, field: str = "ir") -> str:
    """SQL for the symbols of a graph's nodes of these types, in order; ``field`` type takes them as written."""
    return f"transform(filter(n, x -> x.{field} IN ({', '.join(repr(k) for k in kinds)})), x -> x.symbol)"


#: facts with lists: name -> SQL over the nested row
LISTS = {
    "auth_gates": symbols("ir:auth_gate"),
    "authz_checks": symbols("ir:authz_check"),
    "boundaries": symbols("ir:txn_boundary"),
    "writes": symbols("ir:txn_write"),
    "escapes": symbols("ir:txn_escape"),
    "jobs": symbols("ir:queue_job"),
    "events": symbols("ir:event_dispatch"),
    "notifications": symbols("ir:notification"),
    "mails": symbols("ir:mail"),
    "unscoped_queries": symbols("ir:unscoped_query"),
    "unscoped_writes": symbols("ir:unscoped_write"),
    "resources": symbols("ir:resource"),
    "services": symbols("ir:service_call"),
    "validations": symbols("ir:validation_gate"),
}


def fact_lists(corpus: Corpus) -> DataFrame:
    """graph_id, entrypoint and the lists of ``LISTS``."""
    return nested(corpus).select("graph_id", "entrypoint", *(F.expr(v).alias(k) for k, v in LISTS.items()))


def handler_calls(corpus: Corpus, part: str = "") -> DataFrame:
    """graph_id, callees of the first handler over ``ir:calls`` in edge order, and service nodes whose symbol holds ``part``."""
    g = nested(corpus).withColumn("h", F.expr("get(filter(n, x -> x.ir = 'ir:business_handler'), 0)"))
    called = "transform(filter(e, y -> y.src = h.ord AND y.rel = 'ir:calls'), y -> get(n, cast(y.dst - 1 as int)).symbol)"
    of = F.filter(F.expr(LISTS["services"]), lambda s: F.contains(F.lower(s), F.lit(part.lower())))
    return g.select("graph_id", F.coalesce(F.expr(called), F.array().cast("array<string>")).alias("callees"), of.alias("of_class"))


def route_infos(corpus: Corpus) -> DataFrame:
    """A row for each graph with a handler, types as written: gates, checks with arguments, validations, services, has_transaction, throttled, file, line, symbol, is_public.

    In a nestjs project with any gate, routes without one are public on purpose.
    """
    g = nested(corpus).withColumn("h", F.expr("get(filter(n, x -> x.type = 'ir:business_handler'), 0)")).where("h is not null")
    checks = "transform(filter(n, x -> x.type = 'ir:authz_check'), x -> CASE WHEN size(x.args) > 0 THEN concat(x.symbol, ':', array_join(x.args, ',')) ELSE x.symbol END)"
    r = g.select("graph_id", "entrypoint", "method", "path", "framework", F.coalesce("h.file", F.lit("")).alias("file"), F.coalesce(F.when(F.col("h.line") != 0, F.col("h.line")), F.lit(1)).alias("line"), "h.symbol",
                 *(F.expr(symbols(k, field="type")).alias(v) for k, v in (("ir:auth_gate", "auth_gates"), ("ir:validation_gate", "validations"), ("ir:service_call", "services"))),
                 F.expr(checks).alias("authz_checks"), F.expr("exists(n, x -> x.type = 'ir:txn_boundary')").alias("has_transaction"),
                 F.expr(f"exists(n, x -> x.type IN ('ir:auth_gate', 'ir:authz_check') AND x.symbol RLIKE '{THROTTLE}')").alias("throttled"))
    # one row: whether any nestjs route has a gate
    any_gate = r.agg(F.coalesce(F.bool_or((F.col("framework") == "nestjs") & (F.size("auth_gates") > 0)), F.lit(False)).alias("gated"))
    return r.join(F.broadcast(any_gate)).withColumn("is_public", F.coalesce((F.col("framework") == "nestjs") & F.col("gated") & (F.size("auth_gates") == 0), F.lit(False))).drop("gated")


def handler_line(source: str = "source", symbol: str = "symbol"):
    """The line (from 1) of a source text at which the method of a symbol is defined; 1 where it isn't found."""
    method = F.regexp_replace(F.get(F.split(symbol, "::"), F.lit(1)), r"([\\.\[\]{}()*+?^$|])", r"\\$1")
    pattern = F.concat(F.lit(r"(function\s+"), method, F.lit(r"|(async\s+)?"), method, F.lit(r"\s*)\s*\("))
    hits = F.filter(F.transform(F.split(source, "\n", -1), lambda x, i: F.when(F.regexp_like(x, pattern), i + 1)), lambda i: i.isNotNull())
    return F.when(F.coalesce(method, F.lit("")) == "", F.lit(1)).otherwise(F.coalesce(F.get(hits, F.lit(0)), F.lit(1)))


def route_findings(infos: DataFrame, credentials: str = CREDENTIALS) -> DataFrame:
    """graph_id, entrypoint, type, severity of each route's own findings; public routes have none."""
    writes = F.col("method").isin(*MUTATIONS)
    gates, checks = F.size("auth_gates") > 0, F.size("authz_checks") > 0
    classes = F.size(F.array_distinct(F.filter(F.transform("services", lambda s: F.substring_index(s, "::", 1)), lambda c: c != "")))
    rules = (
        ("broken_access_control", "CRITICAL", writes & ~gates & ~checks),
        ("missing_authorization", "HIGH", writes & gates & ~checks),
        ("exposed_read_endpoint", "LOW", (F.col("method") == "GET") & ~gates & (F.size("services") > 0)),
        ("no_rate_limiting", "HIGH", ~F.col("throttled") & ~gates & (F.col("method") == "POST") & F.col("path").rlike(credentials)),
        ("fat_controller", "LOW", classes >= 5),
    )
    hits = F.filter(F.array(*(F.struct(F.lit(t).alias("type"), F.lit(s).alias("severity"), ok.alias("ok")) for t, s, ok in rules)), lambda x: x["ok"])
    return infos.where("not is_public").select("graph_id", "entrypoint", F.explode(hits).alias("f")).select("graph_id", "entrypoint", "f.type", "f.severity")


def route_index(corpus: Corpus, by: str = "file") -> DataFrame:
    """Routes by ``file`` or ``controller`` (the class of the handler): key, routes in graph order; by ``node``: node id -> the last route that has it."""
    r = route_infos(corpus)
    if by == "node":
        n = corpus.nodes.join(r.select("graph_id", "entrypoint"), "graph_id")
        return n.groupBy(F.col("id").alias("key")).agg(F.max_by("entrypoint", "graph_id").alias("route"))
    key = F.col("file") if by == "file" else F.substring_index("symbol", "::", 1)
    return r.where(key != "").groupBy(key.alias("key")).agg(F.transform(F.array_sort(F.collect_list(F.struct("graph_id", "entrypoint"))), lambda x: x["entrypoint"]).alias("routes"))


def context(corpus: Corpus, findings: DataFrame | None = None) -> DataFrame:
    """graph_id, entrypoint, posture, lists, risk and a sentence; ``findings`` (graph_id, severity) decide on the risk."""
    g = nested(corpus)
    lists = {k: F.expr(LISTS[k]) for k in ("auth_gates", "authz_checks", "boundaries", "escapes", "validations", "services")}
    lists["side_effects"] = F.concat(*(F.expr(LISTS[k]) for k in ("jobs", "events", "notifications", "mails")))
    c = g.select("graph_id", "entrypoint", F.upper(F.coalesce("method", F.lit(""))).isin(*MUTATIONS).alias("is_mutation"), F.size("n").cast("bigint").alias("n_nodes"), *(v.alias(k) for k, v in lists.items()))
    c = c.withColumn("is_public", F.size("auth_gates") == 0)
    if findings is None:
        c = c.withColumn("worst", F.lit(None).cast("int"))
    else:
        c = c.join(findings.groupBy("graph_id").agg(F.max(F.coalesce(level(SEVERITY, F.col("severity")), F.lit(0))).alias("worst")), "graph_id", "left")
    risk = F.when(F.col("is_public") & F.col("is_mutation"), "CRITICAL").when(F.col("worst") == 5, "CRITICAL").when(F.col("worst") == 4, "HIGH").when(F.col("worst") == 3, "MEDIUM").when(F.col("worst").isNotNull(), "LOW").otherwise("NONE")
    some = F.size("side_effects")
    sentence = F.concat(F.concat_ws(" ", F.when(F.col("is_mutation"), "Mutating").otherwise("Read-only"), F.when(F.col("is_public"), "public").otherwise("authenticated"), F.lit("route"),
                                    F.when(F.size("boundaries") > 0, "with transaction boundary"), F.when(F.size("authz_checks") > 0, "and authorization checks"),
                                    F.when(some > 0, F.concat(F.lit("with "), some.cast("string"), F.lit(" async side-effect(s)"))),
                                    F.when(F.size("escapes") > 0, "— WARNING: side-effects escape transaction")), F.lit("."))
    return c.withColumn("risk", risk).withColumn("summary", sentence).drop("worst")


TRACES = {
    # pattern: lists, flags, which graphs, summary
    "auth": (
        {"auth_gates": symbols("ir:auth_gate", field="type"), "authz_checks": symbols("ir:authz_check", field="type"), "validation_gates": symbols("ir:validation_gate", field="type"), "resources": symbols("ir:resource", field="type"),
         "unprotected_resources": f"filter({symbols('ir:resource', field='type')}, s -> NOT exists(e, y -> y.rel = 'ir:authorizes' AND get(n, cast(y.dst - 1 as int)).symbol = s))"},
        {"has_auth": "exists(n, x -> x.type IN ('ir:auth_gate', 'ir:authz_check'))"}, "true",
        {"routes_with_auth": "has_auth", "routes_without_auth": "NOT has_auth", "routes_with_unprotected_resources": "size(unprotected_resources) > 0"}),
    "event": (
        {"dispatched_events": symbols("ir:txn_escape", field="type")}, {"inside_transaction": "exists(n, x -> x.type = 'ir:txn_boundary')"}, "size(dispatched_events) > 0",
        {"routes_dispatching_events": "true", "routes_with_unsafe_dispatch": "NOT inside_transaction"}),
    "transaction": (
        {"boundaries": symbols("ir:txn_boundary", field="type"), "writes": symbols("ir:txn_write", field="type"), "escapes": symbols("ir:txn_escape", field="type")}, {}, "size(boundaries) > 0",
        {"routes_with_transactions": "true", "routes_with_escapes": "size(escapes) > 0"}),
    "isolation": (
        {"unscoped_queries": symbols("ir:unscoped_query", field="type"), "unscoped_writes": symbols("ir:unscoped_write", field="type")},
        {"has_tenant_context": "exists(n, x -> x.ir = 'ir:tenant_context' OR (x.ir = 'ir:runtime_inject' AND contains(lower(x.symbol), 'tenant')))"}, "size(unscoped_queries) + size(unscoped_writes) > 0",
        {"routes_with_unscoped_queries": "size(unscoped_queries) > 0", "routes_with_unscoped_writes": "size(unscoped_writes) > 0", "routes_without_tenant_context": "NOT has_tenant_context"}),
    "side_effects": (
        {"queue_jobs": symbols("ir:queue_job", field="type"), "event_dispatches": symbols("ir:event_dispatch", field="type"), "api_resources": symbols("ir:api_resource", field="type"), "notifications": symbols("ir:notification", field="type"), "mails": symbols("ir:mail", field="type"),
         "synchronous_mails": "transform(filter(n, x -> x.type = 'ir:mail' AND NOT coalesce(from_json(x.detail, 'queued boolean').queued, false)), x -> x.symbol)"},
        {"has_side_effects": "exists(n, x -> x.type IN ('ir:queue_job', 'ir:event_dispatch', 'ir:api_resource', 'ir:notification', 'ir:mail'))"}, "true",
        {f"routes_with_{k}": f"size({k}) > 0" for k in ("queue_jobs", "event_dispatches", "api_resources", "notifications", "mails", "synchronous_mails")}),
}


def trace(corpus: Corpus, pattern: str) -> DataFrame:
    """Entries of a pattern: graph_id, entrypoint, lists and flags, types as written."""
    lists, flags, wanted, _ = TRACES[pattern]
    return nested(corpus).select("graph_id", "entrypoint", *(F.expr(v).alias(k) for k, v in (lists | flags).items())).where(wanted)


def trace_summary(corpus: Corpus, pattern: str) -> DataFrame:
    """One row: the pattern's counts, and the routes there are."""
    total = corpus.graphs.agg(F.count("*").alias("total_routes"))
    counts = trace(corpus, pattern).agg(*(F.count_if(F.expr(v)).alias(k) for k, v in TRACES[pattern][3].items()))
    return counts.join(F.broadcast(total))


def execution_paths(corpus: Corpus) -> DataFrame:
    """graph_id, entrypoint, path: places of nodes in breadth-first order from the entrypoint node, else the first gate, else the first node; a node's edges in their order."""
    start = "coalesce(get(filter(n, x -> x.type = 'ir:entrypoint'), 0).ord, get(filter(n, x -> x.type = 'ir:auth_gate'), 0).ord, get(n, 0).ord)"
    rest = "slice(s.q, 2, size(s.q))"
    walk = f"""aggregate(sequence(0, size(e)), named_struct('o', cast(array() as array<bigint>), 'q', array({start})), (s, i) -> CASE WHEN size(s.q) = 0 THEN s
      WHEN array_contains(s.o, s.q[0]) THEN named_struct('o', s.o, 'q', {rest})
      ELSE named_struct('o', concat(s.o, array(s.q[0])), 'q', concat({rest}, transform(filter(e, y -> y.src = s.q[0] AND y.dst <> s.q[0] AND NOT array_contains(s.o, y.dst)), y -> y.dst))) END, s -> s.o)"""
    return nested(corpus).select("graph_id", "entrypoint", F.when(F.size("n") > 0, F.expr(walk)).otherwise(F.array().cast("array<bigint>")).alias("path"))


def request_trace(corpus: Corpus, entrypoint: str) -> DataFrame:
    """The first graph of an entrypoint: step, id, symbol, type, role along its execution path."""
    first = corpus.graphs.where(F.col("entrypoint") == entrypoint).agg(F.min("graph_id").alias("graph_id"))
    only = lambda t: t.join(F.broadcast(first), "graph_id", "left_semi")
    p = execution_paths(Corpus(only(corpus.graphs), only(corpus.nodes), only(corpus.edges))).select("graph_id", F.posexplode("path").alias("step", "node_ord"))
    role = F.coalesce(F.try_element_at(F.create_map(*(F.lit(v) for pair in REQUEST_ROLES.items() for v in pair)), F.col("type")), F.replace("type", F.lit("ir:"), F.lit("")))
    return p.join(only(corpus.nodes), ["graph_id", "node_ord"]).select("graph_id", F.col("step").cast("bigint").alias("step"), "id", "symbol", "type", role.alias("role"))


def evidence(corpus: Corpus, focuses: list[str], top: DataFrame | None = None) -> DataFrame:
    """graph_id, pos, id, symbol, type, role, detail: nodes of the focuses' types, focus by focus in graph order, each once; then those of the top finding (graph_id, nodes)."""
    role = F.coalesce(F.try_element_at(F.create_map(*(F.lit(v) for pair in EVIDENCE_ROLES.items() for v in pair)), F.col("type")), F.replace("type", F.lit("ir:"), F.lit("")))
    detail = F.coalesce(F.nullif("detail", F.lit("")), F.when((F.coalesce("role", F.lit("")) != "") & (F.col("role") != F.col("shown")), F.col("role")), F.when(F.size("args") > 0, F.array_join("args", ", ")))
    n = corpus.nodes.withColumn("shown", role).withColumn("told", detail)
    hit = F.lit(None).cast("int")
    for k in range(len(focuses) - 1, -1, -1):
        wanted = F.lit(True) if focuses[k] == "all" else F.col("type").isin(*FOCUS_NODES[focuses[k]])
        hit = F.when(wanted, F.lit(2 * k)).otherwise(hit)
    if top is not None:
        t = top.select("graph_id", F.explode("nodes").alias("id")).distinct().withColumn("named", F.lit(True))
        n = n.join(t, ["graph_id", "id"], "left")
        hit = F.least(hit, F.when(F.col("named"), F.lit(1)))
    n = n.withColumn("hit", hit).where("hit is not null")
    pos = F.row_number().over(Window.partitionBy("graph_id").orderBy("hit", "node_ord"))
    return n.select("graph_id", pos.cast("bigint").alias("pos"), "id", "symbol", "type", F.col("shown").alias("role"), F.col("told").alias("detail"))


def top_findings(corpus: Corpus, focus: str = "all") -> DataFrame:
    return detect.explain(corpus, focus).where("rank = 1")


def evidence_package(corpus: Corpus, question: str) -> DataFrame:
    """graph_id, intents, execution path, number of evidence items, finding, severity and confidence of the top finding (none, INFO, LOW where there is none)."""
    from . import evidence as asked
    spark = corpus.graphs.sparkSession
    q = spark.range(1).select(F.lit("q").alias("id"), F.lit(question).alias("text"))
    # one question has at most five intents
    found = [r.intent for r in asked.intents(q, "id", "text").orderBy("rank").collect()]
    focus = q.select(asked.focus(F.col("text")).alias("f")).first()[0]
    top = top_findings(corpus, focus)
    items = evidence(corpus, found, top).groupBy("graph_id").agg(F.count("*").alias("n_evidence"))
    p = execution_paths(corpus).select("graph_id", "entrypoint", "path")
    out = p.join(items, "graph_id", "left").join(top.select("graph_id", "type", "severity", "confidence"), "graph_id", "left")
    return out.select("graph_id", "entrypoint", F.lit(",".join(found)).alias("intents"), "path", F.coalesce("n_evidence", F.lit(0)).cast("bigint").alias("n_evidence"), F.coalesce("type", F.lit("none")).alias("finding"), F.coalesce("severity", F.lit("INFO")).alias("severity"), F.coalesce("confidence", F.lit("LOW")).alias("confidence"))


def index_stats(corpus: Corpus) -> DataFrame:
    """One row: distinct symbols, classes and routes of indexed nodes."""
    n = corpus.nodes.where(F.col("type").isin(*INDEXED) & (F.substring_index("symbol", "::", 1) != "")).join(corpus.graphs.select("graph_id", "entrypoint"), "graph_id")
    routes = corpus.graphs.agg(F.count_distinct("entrypoint").alias("n_routes"))
    return n.agg(F.count_distinct("symbol").alias("n_symbols"), F.count_distinct(F.substring_index("symbol", "::", 1)).alias("n_classes")).join(F.broadcast(routes))


def top_symbols(corpus: Corpus, k: int = 10) -> DataFrame:
    """The ``k`` symbols that most routes use, by the first place they stand at where routes are as many."""
    n = corpus.nodes.where(F.col("type").isin(*INDEXED)).join(corpus.graphs.select("graph_id", "entrypoint"), "graph_id")
    return n.groupBy("symbol").agg(F.count_distinct("entrypoint").alias("n_routes"), F.min(F.struct("graph_id", "node_ord")).alias("first")).orderBy(F.desc("n_routes"), "first").limit(k).select("symbol", "n_routes")


def conformance(corpus: Corpus) -> DataFrame:
    """graph_id, conformant, and the number of legacy and unknown node types and relations."""
    from ..schema import LEGACY, LEGACY_RELATIONS, NODE_TYPES, RELATIONS
    kind = lambda c, now, old: F.when(~c.isin(*now), F.when(c.isin(*old), "legacy").otherwise("unknown"))
    n = corpus.nodes.select("graph_id", kind(F.col("type"), NODE_TYPES, LEGACY).alias("node"), F.lit(None).cast("string").alias("edge"))
    e = corpus.edges.select("graph_id", F.lit(None).cast("string").alias("node"), kind(F.col("relation"), RELATIONS, LEGACY_RELATIONS).alias("edge"))
    count = lambda c, v: F.count_if(F.coalesce(F.col(c) == v, F.lit(False))).alias(f"{v}_{c}s")
    v = n.union(e).groupBy("graph_id").agg(*(count(c, v) for c in ("node", "edge") for v in ("legacy", "unknown")))
    names = [f"{v}_{c}s" for c in ("node", "edge") for v in ("legacy", "unknown")]
    out = corpus.graphs.select("graph_id").join(v, "graph_id", "left").select("graph_id", *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in names))
    return out.withColumn("conformant", (F.col("unknown_nodes") == 0) & (F.col("unknown_edges") == 0))
