"""Runtime spans: N+1 queries, slow queries, correlation with nodes, gaps."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import render
from ..sources.corpus import PREFIX, derived
from ..streaming import correlate, runtime
from .base import add
from .base import table as _table

_SPANS = """WITH e AS (SELECT user_id || '-' || CAST(CAST(ts AS DATE) AS VARCHAR) AS session_id, * FROM events),
s AS (SELECT session_id, event_id AS span_id, value AS ms, event_type, row_number() OVER w AS span_ord, CASE WHEN row_number() OVER w > 1 THEN CASE WHEN event_id % 3 = 0 THEN lag(event_id) OVER w ELSE first_value(event_id) OVER w END END AS parent_id
  FROM e WINDOW w AS (PARTITION BY session_id ORDER BY ts, event_id)) """
add("T06_n_plus_one", _SPANS + "SELECT session_id, coalesce(parent_id::VARCHAR, '__root__') AS parent_id, 't' || (span_id % 4) AS \"table\", count(*) AS n, CASE WHEN count(*) >= 10 THEN 'high' ELSE 'medium' END AS severity FROM s WHERE span_ord > 1 GROUP BY 1, 2, 3 HAVING count(*) >= 2")(lambda s, d: runtime.n_plus_one(runtime.spans(_table(s, d, "events")), 2))
add("D27_slow_queries", _SPANS + "SELECT session_id, span_id, round(ms)::BIGINT AS ms, CASE WHEN round(ms) >= 200 THEN 'critical' WHEN round(ms) >= 100 THEN 'high' ELSE 'medium' END AS severity FROM s WHERE span_ord > 1 AND round(ms) >= 50")(lambda s, d: runtime.slow_queries(runtime.spans(_table(s, d, "events")), 50))
add("A10_gap_report", _SPANS + "SELECT category, n, round(100 * n / sum(n) OVER ())::BIGINT AS percent FROM (SELECT CASE WHEN span_ord > 1 THEN 'database' ELSE 'request' END AS category, count(*) AS n FROM s GROUP BY 1)")(lambda s, d: runtime.gap_report(runtime.spans(_table(s, d, "events"))))

# ---- sessions against graphs: a user's day runs through the graph of the user's number
_LINKED = PREFIX + """, ev AS (SELECT user_id || '-' || CAST(CAST(ts AS DATE) AS VARCHAR) AS session_id, user_id AS graph_id, event_id, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS span_ord, value FROM events),
sp0 AS (SELECT ev.session_id, ev.graph_id, event_id::VARCHAR AS span_id, span_ord, CASE WHEN span_ord > 1 THEN first_value(event_id) OVER (PARTITION BY session_id ORDER BY span_ord)::VARCHAR END AS parent_id, event_id % 6 AS m, n.symbol, value FROM ev LEFT JOIN nodes n ON n.graph_id = ev.graph_id AND n.node_ord = event_id % 5 + 1),
sp AS (SELECT *, CASE WHEN span_ord = 1 THEN 'GET /c1/' || graph_id WHEN m = 0 THEN 'db.select' WHEN m = 1 THEN coalesce(symbol, 'none') WHEN m = 2 THEN 'handled' WHEN m = 3 THEN coalesce(split_part(symbol, '::', 1), 'none') WHEN m = 4 THEN 'GET /x' ELSE 'App\\Services\\Thing' END AS name,
  CASE WHEN m = 2 THEN 'App\\Jobs\\' || split_part(symbol, '::', 1) END AS ns, CASE WHEN m = 2 THEN split_part(symbol, '::', 2) END AS fn FROM sp0)
"""


def _linked(spark, sf_dir):
    c = derived(spark, sf_dir)
    e = _table(spark, sf_dir, "events")
    from pyspark.sql import Window
    day = F.concat_ws("-", F.col("user_id").cast("string"), F.to_date("ts").cast("string"))
    e = e.select(day.alias("session_id"), F.col("user_id").alias("graph_id"), "event_id", "ts", "value")
    w = Window.partitionBy("session_id").orderBy("ts", "event_id")
    e = e.withColumn("span_ord", F.row_number().over(w).cast("bigint")).withColumn("top", F.first("event_id").over(w))
    e = e.withColumn("node_ord", F.col("event_id") % 5 + 1).join(c.nodes.select("graph_id", "node_ord", "symbol").hint("merge"), ["graph_id", "node_ord"], "left")
    m, root = F.col("event_id") % 6, F.col("span_ord") == 1
    klass = F.substring_index("symbol", "::", 1)
    name = F.when(root, F.concat(F.lit("GET /c1/"), F.col("graph_id").cast("string"))).when(m == 0, "db.select").when(m == 1, F.coalesce("symbol", F.lit("none"))).when(m == 2, "handled").when(m == 3, F.coalesce(klass, F.lit("none"))).when(m == 4, "GET /x").otherwise("App\\Services\\Thing")
    attributes = F.when((m == 2) & F.col("symbol").isNotNull(), F.create_map(F.lit("code.namespace"), F.concat(F.lit("App\\Jobs\\"), klass), F.lit("code.function"), F.get(F.split("symbol", "::"), F.lit(1)))).otherwise(F.create_map().cast("map<string,string>"))
    start = F.col("event_id") * 1000000
    return c, e.select("session_id", "graph_id", "span_ord", F.col("event_id").cast("string").alias("span_id"), F.when(~root, F.col("top").cast("string")).alias("parent_id"), name.alias("name"), start.alias("start_ns"), (start + F.floor(F.col("value") * 1e6)).cast("bigint").alias("end_ns"), attributes.alias("attributes"))


_MATCH = """, cand AS (SELECT * FROM sp WHERE span_ord > 1 AND NOT regexp_matches(name, '^(db\\.|redis\\.|http\\.client|queue\\.|cache\\.|aws\\.)')),
hits AS (SELECT c.session_id, c.span_id, n.node_ord, CASE WHEN n.symbol = c.name THEN 1 WHEN n.symbol = list_extract(string_split(ns, '\\'), -1) || '::' || fn THEN 2
  WHEN NOT regexp_matches(name, '^(db\\.|(GET|POST|PUT|PATCH|DELETE) )') AND contains(n.symbol, name) THEN 3 WHEN NOT regexp_matches(name, '^(db\\.|(GET|POST|PUT|PATCH|DELETE) )') AND split_part(n.symbol, '::', 1) <> '' AND contains(name, split_part(n.symbol, '::', 1)) THEN 4 END AS p
  FROM cand c JOIN nodes n ON n.graph_id = c.graph_id),
best AS (SELECT session_id, span_id, node_ord, p FROM hits WHERE p IS NOT NULL QUALIFY row_number() OVER (PARTITION BY session_id, span_id ORDER BY p, node_ord) = 1),
cor AS (SELECT c.session_id, c.span_id, c.graph_id, b.node_ord, CASE p WHEN 1 THEN 'exact_symbol' WHEN 2 THEN 'namespace_function' WHEN 3 THEN 'partial_symbol' WHEN 4 THEN 'partial_symbol' ELSE 'unmatched' END AS strategy,
  CASE WHEN p IN (1, 2) THEN 'exact' WHEN p IN (3, 4) THEN 'partial' ELSE 'none' END AS confidence, c.name, c.ns, c.span_ord FROM cand c LEFT JOIN best b ON b.session_id = c.session_id AND b.span_id = c.span_id)
"""


def _correlated(spark, sf_dir):
    c, s = _linked(spark, sf_dir)
    return s, correlate.correlate(s, c.nodes)


add("T01_normalised_routes", _LINKED + "SELECT session_id, span_id, CASE WHEN regexp_matches(name, '^(GET|POST|PUT|PATCH|DELETE|HEAD) ') THEN name END AS route FROM sp")(lambda s, d: correlate.normalise(_linked(s, d)[1]).select("session_id", "span_id", F.col("attributes")["http.route"].alias("route")))
add("T02_sessions", _LINKED + "SELECT session_id, name AS entrypoint, round(floor(value * 1e6) / 1e6, 6) AS duration_ms FROM sp WHERE span_ord = 1")(lambda s, d: correlate.sessions(correlate.normalise(_linked(s, d)[1])).select("session_id", "entrypoint", F.round("duration_ms", 6).alias("duration_ms")))
add("T03_partition", _LINKED + "SELECT session_id, span_id, CASE WHEN span_ord = 1 THEN 'root' WHEN name = 'db.select' THEN 'infra' ELSE 'candidate' END AS part FROM sp")(lambda s, d: correlate.partition(_linked(s, d)[1]).select("session_id", "span_id", "part"))
add("T04_correlate", _LINKED + _MATCH + "SELECT session_id, span_id, graph_id, node_ord, strategy, confidence FROM cor")(lambda s, d: _correlated(s, d)[1])
add("T05_infra_under", _LINKED.replace("CASE WHEN span_ord > 1 THEN first_value(event_id) OVER (PARTITION BY session_id ORDER BY span_ord)::VARCHAR END AS parent_id", "CASE WHEN span_ord > 1 THEN lag(event_id) OVER (PARTITION BY session_id ORDER BY span_ord)::VARCHAR END AS parent_id") + _MATCH + "SELECT s.session_id, s.span_id, c.graph_id, c.node_ord FROM sp s JOIN cor c ON c.session_id = s.session_id AND c.span_id = s.parent_id AND c.node_ord IS NOT NULL WHERE s.span_ord > 1 AND s.name = 'db.select'")(lambda s, d: _under(s, d))


def _under(spark, sf_dir):
    from pyspark.sql import Window
    s, c = _correlated(spark, sf_dir)
    up = F.lag("span_id").over(Window.partitionBy("session_id").orderBy("span_ord"))
    return correlate.infra_under(s.withColumn("parent_id", up), c)


add("A12_coverage", _LINKED + _MATCH + "SELECT session_id, count(*) AS total, count(*) FILTER (confidence <> 'none') AS matched, round(count(*) FILTER (confidence <> 'none') / count(*), 6) AS rate FROM cor GROUP BY 1")(lambda s, d: correlate.coverage(_correlated(s, d)[1]).withColumn("rate", F.round("rate", 6)))
_CATEGORY = "CASE WHEN contains(coalesce(ns, ''), '\\Jobs\\') THEN 'queue_job' WHEN regexp_matches(name, '^(GET|POST|PUT|PATCH|DELETE) /') THEN 'http_infra' WHEN starts_with(name, 'App\\') AND contains(name, '\\Services\\') THEN 'service' ELSE 'unknown' END"
add("T07_categories", _LINKED + f"SELECT span_id, CASE WHEN name = 'db.select' THEN 'db_infra' ELSE {_CATEGORY} END AS category FROM sp")(lambda s, d: _linked(s, d)[1].select("span_id", correlate.category(F.col("name"), F.col("attributes")["code.namespace"]).alias("category")))
add("T08_gaps", _LINKED + _MATCH + f""", k AS (SELECT *, {_CATEGORY} AS category FROM cor WHERE confidence = 'none'), t AS (SELECT session_id, count(*) AS total FROM cor GROUP BY 1),
f AS (SELECT session_id, category, name, min(span_ord) AS o FROM k GROUP BY 1, 2, 3), x AS (SELECT session_id, category, array_to_string(list_slice(list(name ORDER BY o), 1, 3), ',') AS examples FROM f GROUP BY 1, 2)
SELECT k.session_id, k.category, count(*) AS n, floor(100 * count(*) / any_value(t.total) + 0.5)::BIGINT AS percent, any_value(x.examples) AS examples FROM k JOIN t ON t.session_id = k.session_id JOIN x ON x.session_id = k.session_id AND x.category = k.category GROUP BY 1, 2""")(lambda s, d: correlate.gaps(*_correlated(s, d)).withColumn("examples", F.array_join("examples", ",")))
add("A11_gap_roll_up", _LINKED + _MATCH + f"SELECT {_CATEGORY} AS category, count(*) AS n, count(DISTINCT session_id) AS sessions FROM cor WHERE confidence = 'none' GROUP BY 1")(lambda s, d: correlate.gaps(*_correlated(s, d)).groupBy("category").agg(F.sum("n").alias("n"), F.count("*").alias("sessions")))
add("K10_gap_text", _LINKED + _MATCH + f""", k AS (SELECT *, {_CATEGORY} AS category FROM cor WHERE confidence = 'none'), t AS (SELECT session_id, count(*) AS total, count(*) FILTER (confidence <> 'none') AS matched FROM cor GROUP BY 1),
f AS (SELECT session_id, category, name, min(span_ord) AS o FROM k GROUP BY 1, 2, 3), x AS (SELECT session_id, category, array_to_string(list_slice(list(name ORDER BY o), 1, 3), ', ') AS examples FROM f GROUP BY 1, 2),
g AS (SELECT k.session_id, k.category, count(*) AS n, floor(100 * count(*) / any_value(t.total) + 0.5)::BIGINT AS percent, any_value(x.examples) AS examples FROM k JOIN t ON t.session_id = k.session_id JOIN x ON x.session_id = k.session_id AND x.category = k.category GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY n DESC, category) AS nth, '  ' || rpad(category, 20, ' ') || ' ' || lpad(percent || '%', 4, ' ') || '  ' || repeat('█', floor(percent / 5 + 0.5)::INT) || CASE WHEN examples <> '' THEN chr(10) || '    e.g. ' || examples ELSE '' END AS line, '  → ' || category || ': ' || percent || '% of total spans unmatched' AS goal FROM g),
w AS (SELECT session_id, chr(10) || string_agg(line, chr(10) ORDER BY nth) || chr(10) || chr(10) || 'Top Semantic Gaps (parser targets):' || chr(10) || string_agg(goal, chr(10) ORDER BY nth) FILTER (nth <= 5) AS body FROM r GROUP BY 1)
SELECT t.session_id, 'Runtime Coverage Score: ' || floor(100 * matched / total + 0.5)::BIGINT || '% (' || matched || '/' || total || ' spans matched)' || chr(10) || chr(10) || 'Unmatched Span Breakdown:' || coalesce(body, '') AS text FROM t LEFT JOIN w ON w.session_id = t.session_id""")(lambda s, d: (lambda sp, c: render.gap_text(correlate.gaps(sp, c), correlate.coverage(c)))(*_correlated(s, d)))
