"""Runtime sessions against graphs: span normalisation, partition, correlation of spans with nodes, categories of the rest.

Spans are rows (session_id, span_ord, span_id, parent_id, name, start_ns, end_ns, attributes map<string,string>).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: name patterns of spans and namespaces
VERB = r"^(GET|POST|PUT|PATCH|DELETE|HEAD) "
INFRA = r"^(db\.|redis\.|http\.client|queue\.|cache\.|aws\.)"
NO_PARTIAL = r"^(db\.|(GET|POST|PUT|PATCH|DELETE) )"
NAMESPACES = (
    ("queue_job", r"(?i)\\Jobs\\"),
    ("event_listener", r"(?i)\\Listeners\\"),
    ("event_dispatch", r"(?i)\\Events\\"),
    ("api_resource", r"(?i)\\Http\\Resources\\"),
    ("notification", r"(?i)\\Notifications\\"),
    ("mail", r"(?i)\\Mail\\"),
    ("policy", r"(?i)\\Policies\\"),
    ("scheduled_command", r"(?i)\\Console\\Commands\\"),
    ("middleware", r"(?i)\\Http\\Middleware\\"),
    ("controller", r"(?i)\\Http\\Controllers\\"),
    ("service", r"(?i)\\Services\\"),
)
NAMES = (
    ("queue_job", r"(?i)^queue\.job\."),
    ("event_dispatch", r"(?i)^event\."),
    ("queue_job", r"(?i)^(Illuminate|laravel)\\.*Job"),
    ("db_infra", r"(?i)^db\.(select|insert|update|delete|statement)"),
    ("http_infra", r"^(GET|POST|PUT|PATCH|DELETE) /"),
    ("cache_infra", r"(?i)^cache\."),
    ("cache_infra", r"(?i)^redis\."),
)


def normalise(spans: DataFrame) -> DataFrame:
    """``http.route`` from names such as ``GET /x``; a route that is there stays."""
    lacks = F.coalesce(F.col("attributes")["http.route"], F.lit("")) == ""
    none = F.create_map().cast("map<string,string>")
    rest = F.map_filter(F.coalesce("attributes", none), lambda k, v: k != "http.route")
    added = F.map_concat(rest, F.create_map(F.lit("http.route"), F.col("name")))
    return spans.withColumn("attributes", F.when(lacks & F.col("name").rlike(VERB), added).otherwise(F.col("attributes")))


def _root() -> Column:
    return F.coalesce("parent_id", F.lit("")) == ""


def sessions(spans: DataFrame) -> DataFrame:
    """(session_id, entrypoint, duration_ms) of the first span without a parent; ``unknown`` and 0 where there is none."""
    route = F.coalesce(F.col("attributes")["http.route"], F.col("name"))
    root = F.min_by(F.when(_root(), F.struct(route.alias("route"), (F.col("end_ns") - F.col("start_ns")).alias("ns"))), F.when(_root(), F.col("span_ord")))
    s = spans.groupBy("session_id").agg(root.alias("root"))
    return s.select("session_id", F.coalesce("root.route", F.lit("unknown")).alias("entrypoint"), F.coalesce(F.col("root.ns") / 1e6, F.lit(0.0)).alias("duration_ms"))


def partition(spans: DataFrame) -> DataFrame:
    """``spans`` with ``part``: the first span without parent is root; others are infra by name, or candidate."""
    first = F.min(F.when(_root(), F.col("span_ord"))).over(Window.partitionBy("session_id"))
    part = F.when(F.col("span_ord") == first, "root").when(F.col("name").rlike(INFRA), "infra").otherwise("candidate")
    return spans.withColumn("part", part)


def correlate(spans: DataFrame, nodes: DataFrame) -> DataFrame:
    """Candidate spans (with graph_id) -> session_id, span_id, graph_id, node_ord, strategy, confidence; unmatched ones included.

    The strategies go by precision: symbol equal to the name, namespace and function, middleware name, part of a
    name.  Of a strategy's nodes the first in graph order is taken.  A session is joined with its own graph's nodes only, as one array a
    graph, and all strategies are tried in one pass over it.  What grows with the corpus or the spans is merged, never broadcast: packed
    shuffles of it look small, and unpacked it would fill the driver.
    """
    held = nodes.groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct("node_ord", "symbol", "type"))).alias("own"))
    s = partition(spans).where("part = 'candidate'").join(held.hint("merge"), "graph_id", "left")
    attr = lambda k: F.col("attributes")[k]
    name = F.col("name")
    ns, fn = F.nullif(attr("code.namespace"), F.lit("")), F.nullif(attr("code.function"), F.lit(""))
    method = F.concat(F.substring_index(ns, "\\", -1), F.lit("::"), fn)
    mw = F.nullif(F.coalesce(attr("middleware.name"), attr("laravel.middleware")), F.lit(""))
    loose = ~name.rlike(NO_PARTIAL)
    klass = lambda n: F.substring_index(n["symbol"], "::", 1)
    tries = (
        ("exact_symbol", "exact", lambda n: n["symbol"] == name),
        ("namespace_function", "exact", lambda n: n["symbol"] == method),
        ("middleware_name", "high", lambda n: n["symbol"] == mw),
        ("middleware_name", "high", lambda n: (n["type"] == "middleware") & n["symbol"].startswith(F.concat(mw, F.lit("::")))),
        ("partial_symbol", "partial", lambda n: loose & n["symbol"].contains(name)),
        ("partial_symbol", "partial", lambda n: loose & (klass(n) != "") & name.contains(klass(n))),
    )
    hits = [F.get(F.filter("own", ok), F.lit(0))["node_ord"] for _, _, ok in tries]
    found = F.coalesce(*(F.when(h.isNotNull(), F.struct(h.alias("node_ord"), F.lit(how).alias("strategy"), F.lit(sure).alias("confidence"))) for h, (how, sure, _) in zip(hits, tries)))
    out = s.select("session_id", "span_id", "graph_id", found.alias("m"))
    return out.select("session_id", "span_id", "graph_id", "m.node_ord", F.coalesce("m.strategy", F.lit("unmatched")).alias("strategy"), F.coalesce("m.confidence", F.lit("none")).alias("confidence"))


def infra_under(spans: DataFrame, correlated: DataFrame) -> DataFrame:
    """(session_id, span_id, graph_id, node_ord): infra spans whose parent is matched to a node."""
    up = correlated.where("node_ord is not null").select("session_id", F.col("span_id").alias("parent_id"), "graph_id", "node_ord")
    return partition(spans).where("part = 'infra'").select("session_id", "span_id", "parent_id").join(up.hint("merge"), ["session_id", "parent_id"]).select("session_id", "span_id", "graph_id", "node_ord")


def category(name: Column, namespace: Column) -> Column:
    """One of 15: by namespace, then by name, then by the name as a namespace of the application."""
    ns = F.coalesce(namespace, F.lit(""))
    by = lambda c, rules: [F.when(c.rlike(p), F.lit(k)) for k, p in rules]
    app = [F.when(name.rlike(r"^App\\") & name.rlike(p), F.lit(k)) for k, p in NAMESPACES]
    return F.coalesce(*by(ns, NAMESPACES), *by(name, NAMES), *app, F.lit("unknown"))


def gaps(spans: DataFrame, correlated: DataFrame) -> DataFrame:
    """(session_id, category, n, percent, examples) of the spans without a node; percent is of the session's candidates."""
    c = correlated.join(spans.select("session_id", "span_id", "span_ord", "name", F.col("attributes")["code.namespace"].alias("ns")).hint("merge"), ["session_id", "span_id"])
    total = correlated.groupBy("session_id").agg(F.count("*").alias("total"))
    firsts = F.slice(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("span_ord", "name"))), lambda x: x["name"])), 1, 3)
    g = c.where("confidence = 'none'").groupBy("session_id", category(F.col("name"), F.col("ns")).alias("category")).agg(F.count("*").alias("n"), firsts.alias("examples"))
    return g.join(total.hint("merge"), "session_id").select("session_id", "category", "n", F.floor(100 * F.col("n") / F.col("total") + 0.5).cast("bigint").alias("percent"), "examples")


def coverage(correlated: DataFrame) -> DataFrame:
    """(session_id, total, matched, rate) of each session's candidates."""
    hit = F.count(F.when(F.col("confidence") != "none", 1))
    return correlated.groupBy("session_id").agg(F.count("*").alias("total"), hit.alias("matched"), (hit / F.count("*")).alias("rate"))
