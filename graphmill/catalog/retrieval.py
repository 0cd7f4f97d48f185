"""Retrieval: deduplication, ranking, pruning, serialising, impact, baselines, history."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import analysis, baseline, render, retrieve
from ..sources.corpus import PREFIX, Corpus, derived
from .base import add, joined

_REL = """CASE WHEN ir_type IN ('ir:auth_gate', 'ir:authz_check', 'ir:permission_constant', 'ir:runtime_inject', 'ir:tenant_context', 'ir:service_call', 'ir:validation_gate', 'ir:txn_boundary', 'ir:txn_write', 'ir:txn_escape', 'ir:unscoped_query',
  'ir:unscoped_write', 'ir:api_resource', 'ir:queue_job', 'ir:notification') THEN 2 WHEN ir_type IN ('ir:runtime_consume', 'ir:business_handler', 'ir:entrypoint', 'ir:scoped_query', 'ir:event_dispatch', 'ir:mail') THEN 1 ELSE 0 END"""
_DEDUP = """, m AS (SELECT *, CASE WHEN type IN ('ir:txn_boundary', 'ir:txn_write', 'ir:txn_escape', 'ir:unscoped_query', 'ir:unscoped_write', 'ir:scoped_query') THEN type || '|' || symbol || '|' || coalesce(arg0, '') ELSE 'n' || node_ord END AS key FROM nodes),
c AS (SELECT *, min(node_ord) OVER (PARTITION BY graph_id, key) AS first, count(*) OVER (PARTITION BY graph_id, key) AS occurrences FROM m),
dn AS (SELECT * FROM c WHERE node_ord = first),
de AS (SELECT * FROM (SELECT e.graph_id, e.edge_ord, a.first AS src, b.first AS dst, e.relation, e.mechanism FROM edges e JOIN c a ON a.graph_id = e.graph_id AND a.node_ord = e.src JOIN c b ON b.graph_id = e.graph_id AND b.node_ord = e.dst) QUALIFY row_number() OVER (PARTITION BY graph_id, src, dst, relation ORDER BY edge_ord) = 1)
"""
_SCORE = "contains(lower(symbol || coalesce(' ' || arg0, '')), 'widget')::INT + contains(lower(symbol || coalesce(' ' || arg0, '')), 'bolt')::INT + contains(lower(symbol || coalesce(' ' || arg0, '')), 'brand')::INT"
_RANKED = _DEDUP + f""", rn AS (SELECT *, ({_SCORE})::BIGINT AS score, {_REL} AS rel FROM dn),
ro AS (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY occurrences > 1, score DESC, rel DESC, node_ord) AS rank FROM rn)
"""
_SECTION = """CASE WHEN type IN ('ir:auth_gate', 'middleware', 'authentication_gate', 'authorization_check', 'rate_limiter') THEN 1 WHEN type IN ('ir:business_handler', 'controller', 'controller_action') THEN 2 WHEN type IN ('ir:validation_gate', 'form_request') THEN 3
  WHEN type IN ('ir:authz_check', 'ir:permission_constant', 'ir:service_call', 'policy', 'permission', 'service_call') THEN 4 WHEN type IN ('ir:runtime_inject', 'ir:runtime_consume', 'ir:tenant_context', 'runtime_injection') THEN 5 ELSE 6 END"""


def _body(nodes: str, edges: str) -> str:
    """CTEs that end in body (graph_id, body), over nodes (graph_id, id, type, symbol, arg0, role, pos, times) and edges."""
    return f""", ln AS (SELECT graph_id, pos, {_SECTION} AS sec, '  → ' || symbol || coalesce(' [' || arg0 || ']', '') || CASE WHEN coalesce(role, '') <> '' THEN ' (' || role || ')' ELSE '' END || CASE WHEN times > 1 THEN ' ×' || times ELSE '' END AS line, type, times FROM ({nodes})),
sc AS (SELECT graph_id, sec, '[' || CASE sec WHEN 1 THEN 'MIDDLEWARE CHAIN' WHEN 2 THEN 'HANDLER' WHEN 3 THEN 'VALIDATION' WHEN 4 THEN 'AUTHORIZATION' WHEN 5 THEN 'RUNTIME' ELSE 'OTHER' END || ']' || chr(10) || string_agg(line, chr(10) ORDER BY pos) || chr(10) AS t FROM ln GROUP BY 1, 2),
kd AS (SELECT graph_id, type, sum(times)::BIGINT AS n, min(pos) AS o FROM ln WHERE times > 1 GROUP BY 1, 2),
ex AS (SELECT graph_id, 7 AS sec, '[EXECUTION CHARACTERISTICS]' || chr(10) || '  ' || string_agg(n || '× ' || type, ', ' ORDER BY o) || chr(10) AS t FROM kd GROUP BY 1),
cn AS (SELECT graph_id, 8 AS sec, '[CONNECTIONS]' || chr(10) || string_agg('  n' || src || ' → n' || dst || ' (' || relation || CASE WHEN coalesce(mechanism, '') <> '' THEN ' via ' || mechanism ELSE '' END || ')', chr(10) ORDER BY edge_ord) || chr(10) AS t FROM ({edges}) WHERE relation <> 'next_middleware' GROUP BY 1),
body AS (SELECT g.graph_id, coalesce(chr(10) || string_agg(t, chr(10) ORDER BY sec), '') AS body FROM graphs g LEFT JOIN (SELECT * FROM sc UNION ALL SELECT * FROM ex UNION ALL SELECT * FROM cn) p ON p.graph_id = g.graph_id GROUP BY 1)
"""


_PLAIN = _body("SELECT *, node_ord AS pos, 1 AS times FROM nodes", "SELECT * FROM edges")
add("A03_deduplicated_nodes", PREFIX + _DEDUP + "SELECT graph_id, node_ord, type, symbol, occurrences FROM dn")(lambda s, d: retrieve.deduplicate(derived(s, d)).nodes.select("graph_id", "node_ord", "type", "symbol", "occurrences"))
add("A04_deduplicated_edges", PREFIX + _DEDUP + "SELECT graph_id, edge_ord, src, dst, relation FROM de")(lambda s, d: retrieve.deduplicate(derived(s, d)).edges.select("graph_id", "edge_ord", "src", "dst", "relation"))
add("O01_ranked_nodes", PREFIX + _RANKED + "SELECT graph_id, node_ord, score, rank FROM ro")(lambda s, d: retrieve.rank_nodes(retrieve.deduplicate(derived(s, d)), "What widget and bolt, of which brand?").select("graph_id", "node_ord", "score", "rank"))
add("R03_pruned_edges", PREFIX + f", k AS (SELECT graph_id, node_ord FROM nodes WHERE {_REL} >= 2) SELECT e.graph_id, edge_ord, src, dst, relation FROM edges e JOIN k a ON a.graph_id = e.graph_id AND a.node_ord = src JOIN k b ON b.graph_id = e.graph_id AND b.node_ord = dst")(lambda s, d: retrieve.prune(derived(s, d), 2).edges.select("graph_id", "edge_ord", "src", "dst", "relation"))
add("R04_side_effects", PREFIX + ", k AS (SELECT * FROM nodes WHERE type IN ('ir:queue_job', 'ir:event_dispatch', 'ir:api_resource', 'ir:notification', 'ir:mail', 'ir:business_handler')) SELECT graph_id, count(*) AS n_nodes FROM k GROUP BY 1")(lambda s, d: retrieve.prune_by_side_effects(derived(s, d)).nodes.groupBy("graph_id").agg(F.count("*").alias("n_nodes")))
add("K04_bodies", PREFIX + _PLAIN + "SELECT * FROM body")(lambda s, d: retrieve.bodies(derived(s, d)))
add("R08_tokens", PREFIX + _PLAIN + "SELECT graph_id, ceil(length(body) / 4)::BIGINT AS tokens FROM body")(lambda s, d: retrieve.token_estimate(derived(s, d)))
_FIT = _body("SELECT *, rank AS pos, occurrences AS times FROM ro", "SELECT * FROM de")
_OVER = _FIT + ", o AS (SELECT graph_id, ceil(length(body) / 4) > 150 AS pruned FROM body), kn AS (SELECT ro.* FROM ro JOIN o ON o.graph_id = ro.graph_id WHERE NOT pruned OR rel >= 1), ke AS (SELECT de.* FROM de JOIN kn a ON a.graph_id = de.graph_id AND a.node_ord = src JOIN kn b ON b.graph_id = de.graph_id AND b.node_ord = dst)"
_CUT = _body("SELECT *, rank AS pos, occurrences AS times FROM kn", "SELECT * FROM ke")
for _n in ("ln", "sc", "kd", "ex", "cn", "body"):
    _CUT = _CUT.replace(f" {_n} AS (", f" {_n}2 AS (").replace(f"\n{_n} AS (", f"\n{_n}2 AS (").replace(f"FROM {_n} ", f"FROM {_n}2 ").replace(f"FROM {_n})", f"FROM {_n}2)")
_QUESTION = "What widget and bolt, of which brand?"
add("R01_retrieve", PREFIX + _RANKED + _OVER + _CUT + """SELECT g.graph_id, g.entrypoint, (SELECT count(*) FROM kn WHERE kn.graph_id = g.graph_id) AS n_nodes, (SELECT count(*) FROM ke WHERE ke.graph_id = g.graph_id) AS n_edges, ceil(length(b.body) / 4)::BIGINT AS tokens, o.pruned
  FROM graphs g JOIN o ON o.graph_id = g.graph_id JOIN body2 b ON b.graph_id = g.graph_id""")(lambda s, d: retrieve.retrieve(derived(s, d), _QUESTION, budget=150).drop("nodes", "edges"))
add("R05_focus", PREFIX + _RANKED + """, kn AS (SELECT * FROM ro WHERE rel >= 2), ke AS (SELECT de.* FROM de JOIN kn a ON a.graph_id = de.graph_id AND a.node_ord = src JOIN kn b ON b.graph_id = de.graph_id AND b.node_ord = dst)""" + _body("SELECT *, rank AS pos, occurrences AS times FROM kn", "SELECT * FROM ke") + """SELECT g.graph_id, g.entrypoint,
  (SELECT count(*) FROM kn WHERE kn.graph_id = g.graph_id) AS n_nodes, (SELECT count(*) FROM ke WHERE ke.graph_id = g.graph_id) AS n_edges, ceil(length(b.body) / 4)::BIGINT AS tokens, true AS pruned FROM graphs g JOIN body b ON b.graph_id = g.graph_id""")(lambda s, d: retrieve.retrieve(derived(s, d), _QUESTION, "auth").drop("nodes", "edges"))
add("K04_serialised")(lambda s, d: retrieve.serialise(retrieve.retrieve(derived(s, d), _QUESTION, budget=150)))
_INDEXED = "type IN ('ir:service_call', 'ir:queue_job', 'ir:event_dispatch', 'ir:api_resource', 'ir:notification', 'ir:mail') AND split_part(symbol, '::', 1) <> ''"
add("A05_by_symbol", PREFIX + f"SELECT symbol, string_agg(DISTINCT entrypoint, ',' ORDER BY entrypoint) AS routes FROM nodes n JOIN graphs g ON g.graph_id = n.graph_id WHERE {_INDEXED} GROUP BY 1")(lambda s, d: retrieve.dependency_index(derived(s, d)).select("symbol", *joined("routes")))
add("A05_by_class", PREFIX + f"SELECT split_part(symbol, '::', 1) AS class, string_agg(DISTINCT entrypoint, ',' ORDER BY entrypoint) AS routes FROM nodes n JOIN graphs g ON g.graph_id = n.graph_id WHERE {_INDEXED} GROUP BY 1")(lambda s, d: retrieve.dependency_index(derived(s, d), "class").select("class", *joined("routes")))
add("A06_index_stats", PREFIX + f"SELECT count(DISTINCT symbol) AS n_symbols, count(DISTINCT split_part(symbol, '::', 1)) AS n_classes, (SELECT count(DISTINCT entrypoint) FROM graphs) AS n_routes FROM nodes WHERE {_INDEXED}")(lambda s, d: analysis.index_stats(derived(s, d)))
add("O08_top_symbols", PREFIX + f"SELECT symbol, count(DISTINCT entrypoint) AS n_routes FROM nodes n JOIN graphs g ON g.graph_id = n.graph_id WHERE {_INDEXED} GROUP BY 1 ORDER BY n_routes DESC, min(n.graph_id * 100 + node_ord) LIMIT 10")(lambda s, d: analysis.top_symbols(derived(s, d)))
add("R10_dependents", PREFIX + """, p AS (SELECT g.graph_id, g.entrypoint, count(n.node_ord) AS n FROM graphs g LEFT JOIN (SELECT * FROM nodes WHERE type IN ('ir:service_call', 'ir:queue_job', 'ir:event_dispatch', 'ir:api_resource', 'ir:notification', 'ir:mail') AND split_part(symbol, '::', 1) = 'Service3') n ON n.graph_id = g.graph_id GROUP BY 1, 2)
SELECT entrypoint, arg_max(n, graph_id) AS n FROM p GROUP BY 1 HAVING max(n) > 0""")(lambda s, d: retrieve.dependents(derived(s, d), "Service3"))
add("R17_reachable", PREFIX.replace("WITH ", "WITH RECURSIVE ", 1) + ", w AS (SELECT graph_id, node_ord::BIGINT AS node_ord, 0::BIGINT AS depth FROM nodes WHERE ir_type = 'ir:auth_gate' UNION SELECT e.graph_id, e.dst::BIGINT, w.depth + 1 FROM w JOIN edges e ON e.graph_id = w.graph_id AND e.src = w.node_ord WHERE w.depth < 3) SELECT graph_id, node_ord, min(depth) AS depth FROM w GROUP BY 1, 2 HAVING min(depth) > 0")(lambda s, d: (lambda c: retrieve.reachable(s, c, c.nodes.where("ir_type = 'ir:auth_gate'"), 3))(derived(s, d)))
add("R09_naive_tokens", PREFIX + """, f AS (SELECT file, max(symbol) AS content FROM nodes GROUP BY 1), x AS (SELECT DISTINCT n.graph_id, n.file FROM nodes n)
SELECT x.graph_id AS golden_id, count(*) AS n_files, ceil((sum(length(f.content) + length(x.file) + 10) + 2 * (count(*) - 1)) / 4)::BIGINT AS tokens FROM x JOIN f ON f.file = x.file GROUP BY 1""")(lambda s, d: (lambda n: retrieve.naive(n.select(F.col("graph_id").alias("golden_id"), "file"), n.groupBy("file").agg(F.max("symbol").alias("content"))))(derived(s, d).nodes))


def _years(spark, sf_dir):
    c = derived(spark, sf_dir)
    return c, F.year("captured_at")


_CAP = PREFIX + """, c AS (SELECT entrypoint, year(captured_at) AS y, type AS ir_type FROM graphs g LEFT JOIN nodes n ON n.graph_id = g.graph_id),
b AS (SELECT entrypoint, y, coalesce(list_sort(list(DISTINCT ir_type) FILTER (ir_type IN ('ir:auth_gate', 'ir:authz_check', 'ir:validation_gate', 'ir:txn_boundary', 'ir:scoped_query', 'ir:unscoped_query', 'ir:unscoped_write'))), []) AS types FROM c GROUP BY 1, 2)
"""


@add("W01_history", _CAP + """SELECT entrypoint, y::BIGINT AS snapshot, coalesce(array_to_string(list_sort(list_filter(before, lambda x: NOT list_contains(types, x))), ','), '') AS lost,
  coalesce(array_to_string(list_sort(list_filter(types, lambda x: NOT list_contains(before, x))), ','), '') AS gained FROM (SELECT *, lag(types) OVER (PARTITION BY entrypoint ORDER BY y) AS before FROM b)""".replace("list_filter(types, lambda x: NOT list_contains(before, x))", "CASE WHEN before IS NULL THEN [] ELSE list_filter(types, lambda x: NOT list_contains(before, x)) END"))
def w01(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, year = _years(spark, sf_dir)
    # captures have no edges: asking for the corpus' would write them out
    c = Corpus(c.graphs.withColumn("snapshot", year.cast("bigint")), c.nodes, None)
    return baseline.history(baseline.capture(c, ["snapshot"]))


_DIFF = _CAP + """, lo AS (SELECT min(y) AS y FROM b), p AS (SELECT entrypoint, types FROM b WHERE y = (SELECT y + 1 FROM lo)), q AS (SELECT entrypoint, types FROM b WHERE y = (SELECT y FROM lo)),
dd AS (SELECT coalesce(p.entrypoint, q.entrypoint) AS entrypoint, CASE WHEN q.entrypoint IS NULL THEN 'new' WHEN p.entrypoint IS NULL THEN 'gone' WHEN p.types = q.types THEN 'same' ELSE 'changed' END AS status,
  array_to_string(list_filter(coalesce(q.types, []), lambda x: NOT list_contains(coalesce(p.types, []), x)), ',') AS lost, array_to_string(list_filter(coalesce(p.types, []), lambda x: NOT list_contains(coalesce(q.types, []), x)), ',') AS gained
  FROM p FULL JOIN q ON p.entrypoint = q.entrypoint)
"""


@add("R12_verify_baseline", _DIFF + "SELECT *, status = 'gone' OR (status = 'changed' AND (lost <> '' OR contains(gained, 'ir:unscoped_write') OR contains(gained, 'ir:unscoped_query'))) AS regressed FROM dd")
def r12(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, year = _years(spark, sf_dir)
    # the first year there is stays a part of the plan; it is one row
    of = lambda k: baseline.capture(Corpus(c.graphs.join(F.broadcast(c.graphs.agg((F.min(year) + k).alias("y"))), year == F.col("y"), "left_semi"), c.nodes, None))
    return baseline.diff(of(1), of(0))


@add("D28_changes", _DIFF + """, x AS (SELECT entrypoint, 'lost' AS direction, unnest(string_split(lost, ',')) AS type FROM dd WHERE status = 'changed' UNION ALL SELECT entrypoint, 'gained', unnest(string_split(gained, ',')) FROM dd WHERE status = 'changed')
SELECT entrypoint, direction, type, CASE WHEN direction = 'lost' THEN CASE type WHEN 'ir:auth_gate' THEN 'CRITICAL' WHEN 'ir:authz_check' THEN 'HIGH' WHEN 'ir:txn_boundary' THEN 'HIGH' WHEN 'ir:validation_gate' THEN 'MEDIUM' WHEN 'ir:scoped_query' THEN 'MEDIUM' ELSE 'INFO' END
  ELSE CASE WHEN type IN ('ir:unscoped_query', 'ir:unscoped_write') THEN 'CRITICAL' ELSE 'INFO' END END AS severity, (direction = 'lost') <> (type IN ('ir:unscoped_query', 'ir:unscoped_write')) AS regression FROM x WHERE type <> ''""")
def d28(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baseline.changes(r12(spark, sf_dir)).select("entrypoint", "direction", "type", "severity", "regression")
add("K07_diff_verdict", _DIFF + "SELECT count(*) FILTER (status = 'changed' AND (lost <> '' OR contains(gained, 'ir:unscoped_write') OR contains(gained, 'ir:unscoped_query'))) AS regressions, count(*) FILTER (status = 'gone') AS removed, count(*) FILTER (status = 'same') AS stable FROM dd")(lambda s, d: render.verdict(r12(s, d)).select("regressions", "removed", "stable"))
add("K07_diff_lines")(lambda s, d: (lambda x: render.diff_lines(x, baseline.changes(x)))(r12(s, d)))
