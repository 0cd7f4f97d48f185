"""Scores of traces, retrieval, answers and questions, and regression gates."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import regress, score
from ..sources.corpus import PREFIX, derived, nested
from .base import add, joined
from .base import table as _table

add("A15_runs", "SELECT o_orderpriority AS key, round(avg(o_totalprice), 6) AS mean, round(stddev_pop(o_totalprice), 6) AS deviation, min(o_totalprice) AS low, max(o_totalprice) AS high, count(*) AS runs FROM orders GROUP BY 1")(lambda s, d: score.runs(_table(s, d, "orders").withColumnRenamed("o_orderpriority", "key"), "key", "o_totalprice"))
add("W02_last_turns", "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 5")(lambda s, d: score.last_turns(_table(s, d, "conversations")))
add("G04_phrases", "SELECT doc_id, round((contains(lower(coalesce(text, '')), 'the')::INT + contains(lower(coalesce(text, '')), 'tion')::INT + contains(lower(coalesce(text, '')), 'que')::INT) / 3, 6) AS score, round((contains(lower(coalesce(text, '')), 'the')::INT + contains(lower(coalesce(text, '')), 'tion')::INT + contains(lower(coalesce(text, '')), 'que')::INT) / 3, 6) >= 0.7 AS passed FROM documents")(lambda s, d: score.phrases(_table(s, d, "documents"), ["The", "tion", "que"]))

# ---- golden traces made from graphs: the first three nodes, one with its symbol as it is, one with its class, one turned round
_GOLD = PREFIX + """, gold AS (SELECT graph_id::VARCHAR AS trace, 'g' || node_ord AS golden_id, type, CASE node_ord WHEN 1 THEN symbol WHEN 2 THEN split_part(symbol, '::', 1) ELSE reverse(symbol) END AS symbol, arg0, CASE WHEN mutates THEN 'HIGH' ELSE 'MEDIUM' END AS relevance FROM nodes WHERE node_ord <= 3),
kept AS (SELECT graph_id::VARCHAR AS trace, * EXCLUDE (graph_id) FROM nodes WHERE node_ord <> 1)
"""


def _gold(spark, sf_dir):
    c = derived(spark, sf_dir)
    symbol = F.when(F.col("node_ord") == 1, F.col("symbol")).when(F.col("node_ord") == 2, F.substring_index("symbol", "::", 1)).otherwise(F.reverse("symbol"))
    gold = c.nodes.where("node_ord <= 3").select(F.col("graph_id").cast("string").alias("trace"), F.concat(F.lit("g"), "node_ord").alias("golden_id"), "type", symbol.alias("symbol"), "args", F.when(F.col("mutates"), "HIGH").otherwise("MEDIUM").alias("relevance"))
    g = nested(c).select(F.col("graph_id").cast("string").alias("trace"), F.filter("n", lambda x: x["ord"] != 1).alias("n"), F.size("e").alias("n_edges"), "e", F.col("n").alias("all"))
    return gold, g


_WORDS = "list_filter(string_split(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: length(w) > 2)"
_IR = "CASE {0} WHEN 'policy' THEN 'ir:authz_check' WHEN 'authorization_check' THEN 'ir:authz_check' WHEN 'service_call' THEN 'ir:service_call' WHEN 'controller_action' THEN 'ir:business_handler' WHEN 'form_request' THEN 'ir:validation_gate' WHEN 'permission' THEN 'ir:permission_constant' ELSE {0} END"
_SKEL = "type IN ('ir:auth_gate', 'ir:business_handler', 'rate_limiter', 'signature_check', 'email_verification')"
_PAIRS = _GOLD + f""", pairs AS (SELECT g.trace, g.golden_id, g.type, n.node_ord, CASE WHEN lower(g.symbol) = lower(n.symbol) THEN 1.0 WHEN contains(lower(g.symbol), lower(n.symbol)) OR contains(lower(n.symbol), lower(g.symbol)) THEN 0.9 WHEN lower(g.arg0) = lower(n.arg0) THEN 0.7
  WHEN ({_IR.format('g.type')} = n.ir_type OR ({_IR.format('g.type')} IN ('ir:auth_gate', 'ir:authz_check') AND n.ir_type IN ('ir:auth_gate', 'ir:authz_check')))
    AND len(list_filter({_WORDS.format('g.symbol')}, lambda a: len(list_filter({_WORDS.format('n.symbol')}, lambda b: contains(b, a) OR contains(a, b))) > 0)) > 0 THEN 0.6 ELSE 0.0 END AS score
  FROM gold g JOIN kept n ON n.trace = g.trace AND (g.{_SKEL} OR n.ir_type NOT IN ('ir:auth_gate', 'ir:business_handler'))),
best AS (SELECT * FROM pairs WHERE score >= 0.5 QUALIFY row_number() OVER (PARTITION BY trace, golden_id ORDER BY score DESC, node_ord) = 1),
matched AS (SELECT g.trace, g.golden_id, g.type, coalesce(b.score, 0)::DOUBLE AS score, b.node_ord, CASE WHEN b.score IS NULL THEN 'no match' WHEN b.score >= 1 THEN 'exact symbol' WHEN b.score >= 0.9 THEN 'symbol substring' WHEN b.score >= 0.7 THEN 'arg overlap' ELSE 'semantic type + shared token' END AS reason
  FROM gold g LEFT JOIN best b ON b.trace = g.trace AND b.golden_id = g.golden_id)
"""
add("G01_matched_nodes", _PAIRS + "SELECT * FROM matched")(lambda s, d: score.match_nodes(*_gold(s, d)))
add("G02_trace_scores", _PAIRS + f""", ge AS (SELECT e.graph_id::VARCHAR AS trace, count(*) AS wanted FROM edges e JOIN nodes a ON a.graph_id = e.graph_id AND a.node_ord = e.src JOIN nodes b ON b.graph_id = e.graph_id AND b.node_ord = e.dst
  WHERE e.src <= 3 AND e.dst <= 3 AND a.{_SKEL} AND b.{_SKEL} GROUP BY 1), ne AS (SELECT graph_id::VARCHAR AS trace, count(*) AS n FROM edges GROUP BY 1)
SELECT m.trace, round(coalesce(count(*) FILTER ({_SKEL} AND node_ord IS NOT NULL) / nullif(count(*) FILTER ({_SKEL}), 0), 1), 6) AS skeleton, round(coalesce(count(*) FILTER (NOT {_SKEL} AND node_ord IS NOT NULL) / nullif(count(*) FILTER (NOT {_SKEL}), 0), 1), 6) AS deeper,
  round(CASE WHEN any_value(ge.wanted) IS NULL THEN 1.0 ELSE least(1.0, coalesce(any_value(ne.n), 0) / any_value(ge.wanted)) END, 6)::DOUBLE AS edge_recall FROM matched m LEFT JOIN ge ON ge.trace = m.trace LEFT JOIN ne ON ne.trace = m.trace GROUP BY 1""")(lambda s, d: (lambda g, n, c: score.trace_scores(g, c.edges.where("src <= 3 and dst <= 3").select(F.col("graph_id").cast("string").alias("trace"), F.concat(F.lit("g"), "src").alias("src"), F.concat(F.lit("g"), "dst").alias("dst")), n).select("trace", *(F.round(k, 6).alias(k) for k in ("skeleton", "deeper", "edge_recall"))))(*_gold(s, d), derived(s, d)))
add("G03_retrieval_scores", _GOLD + """, cv AS (SELECT g.*, EXISTS (SELECT 1 FROM kept n WHERE n.trace = g.trace AND (contains(lower(n.symbol), lower(g.symbol)) OR contains(lower(g.symbol), lower(n.symbol)))) AS ok FROM gold g),
r AS (SELECT trace, coalesce(count(*) FILTER (relevance = 'HIGH' AND ok) / nullif(count(*) FILTER (relevance = 'HIGH'), 0), 1) AS high, coalesce(count(*) FILTER (relevance = 'MEDIUM' AND ok) / nullif(count(*) FILTER (relevance = 'MEDIUM'), 0), 1) AS medium, count(*) FILTER (ok) / count(*) AS combined,
  coalesce(string_agg(golden_id, ',' ORDER BY golden_id) FILTER (relevance = 'HIGH' AND NOT ok), '') AS missing, coalesce(bool_and(type IN ('ir:service_call', 'service_call', 'ir:permission_constant', 'permission', 'ir:runtime_inject', 'ir:runtime_consume')) FILTER (relevance = 'HIGH' AND NOT ok), true) AS deeper FROM cv GROUP BY 1)
SELECT trace, round(high, 6) AS high, round(medium, 6) AS medium, round(combined, 6) AS combined, missing, CASE WHEN combined >= 0.99 THEN 'ok' WHEN deeper THEN 'extraction_ceiling' ELSE 'retrieval_failure' END AS reason FROM r""")(lambda s, d: score.retrieval_scores(*_gold(s, d)).select("trace", *(F.round(k, 6).alias(k) for k in ("high", "medium", "combined")), *joined("missing"), "reason"))
add("G10_pain_scores", _GOLD + """, sp AS (SELECT trace, symbol FROM gold), nr AS (SELECT trace, count(*) FILTER (EXISTS (SELECT 1 FROM kept n WHERE n.trace = sp.trace AND (contains(lower(n.symbol), lower(sp.symbol)) OR contains(lower(sp.symbol), lower(n.symbol))))) / count(*) AS r FROM sp GROUP BY 1)
SELECT trace, round(r, 6) AS node_recall, r >= 0.7 AS passed FROM nr""")(lambda s, d: (lambda g, n: score.pain_scores(g.groupBy("trace").agg(F.collect_list("symbol").alias("nodes"), F.array().cast("array<string>").alias("edges")), n).select("trace", "node_recall", "passed"))(*_gold(s, d)))

# ---- answers made from documents: every document answers, and a conversation's turns do
_SAID = """WITH a AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Missing_Policy' ELSE 'none' END AS finding_type, CASE doc_id % 2 WHEN 0 THEN 'high' ELSE 'low' END AS severity, coalesce(text, '') AS t FROM documents),
p AS (SELECT *, (lower(finding_type) = 'missing_policy')::INT AS f, (severity = 'high')::INT AS s, CASE doc_id % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE 0.0 END AS k, (contains(lower(t), 'the')::INT + contains(lower(t), 'tion')::INT) / 2 AS e, ((contains(lower(t), 'que') OR contains(lower(t), 'sch'))::INT + contains(lower(t), 'zzz')::INT) / 2 AS r FROM a)
"""


def _answers(spark, sf_dir):
    d = _table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    lit = lambda *v: F.array(*map(F.lit, v))
    nodes = F.when(F.col("doc_id") % 4 == 0, lit("N1", "n2")).when(F.col("doc_id") % 4 == 1, lit("n2", "n9")).otherwise(lit("n7"))
    return d.select("doc_id", F.when(F.col("doc_id") % 3 == 0, "Missing_Policy").otherwise("none").alias("finding_type"), F.when(F.col("doc_id") % 2 == 0, "high").otherwise("low").alias("severity"), nodes.alias("key_nodes"), text.alias("explanation"), F.array(text).alias("recommendations"),
                    F.lit("missing_policy").alias("want_finding_type"), F.lit("HIGH").alias("want_severity"), lit("n1", "N2").alias("want_key_nodes"), lit("The", "tion").alias("want_explanation"), F.array(lit("que", "SCH"), lit("zzz")).alias("want_recommendations"))


add("G04_answer_scores", _SAID + "SELECT doc_id, round(0.3 * f + 0.15 * s + 0.25 * k + 0.2 * e + 0.1 * r, 6)::DOUBLE AS score, round(0.3 * f + 0.15 * s + 0.25 * k + 0.2 * e + 0.1 * r, 9) >= 0.7 AS passed FROM p")(lambda s, d: score.answer_scores(_answers(s, d)).select("doc_id", F.round("score", 6).alias("score"), "passed"))
add("G05_turn_scores", _SAID + "SELECT doc_id, round(0.25 * f + 0.15 + 0.4 * e + 0.2 * r, 6)::DOUBLE AS score, round(0.25 * f + 0.15 + 0.4 * e + 0.2 * r, 9) >= 0.65 AS passed FROM p")(lambda s, d: score.turn_scores(_answers(s, d).withColumn("want_severity", F.lit(None).cast("string"))).select("doc_id", F.round("score", 6).alias("score"), "passed"))
add("G06_judged_answers", _SAID + "SELECT doc_id, round(0.3 * contains(lower(finding_type), 'policy')::INT + 0.15 * s + 0.25 * k + 0.2 * e + 0.1 * r, 9)::DOUBLE AS score, round(0.3 * contains(lower(finding_type), 'policy')::INT + 0.15 * s + 0.25 * k + 0.2 * e + 0.1 * r, 9) >= 0.7 AS passed FROM p")(lambda s, d: score.answer_scores(_answers(s, d), lambda want, said: F.contains(F.lower(said), F.lit("policy"))).select("doc_id", "score", "passed"))
add("A16_answer_averages", _SAID + "SELECT doc_id % 7 AS part, round(avg(round(0.3 * f + 0.15 * s + 0.25 * k + 0.2 * e + 0.1 * r, 9)), 6)::DOUBLE AS score, count(*) FILTER (round(0.3 * f + 0.15 * s + 0.25 * k + 0.2 * e + 0.1 * r, 9) >= 0.7) AS n_passed, count(*) AS n, bool_and(round(0.3 * f + 0.15 * s + 0.25 * k + 0.2 * e + 0.1 * r, 9) >= 0.7) AS all_passed FROM p GROUP BY 1")(lambda s, d: score.averages(score.answer_scores(_answers(s, d).withColumn("part", F.col("doc_id") % 7)), "part"))
add("A22_comparison", "WITH o AS (SELECT o_custkey % 100 / 100.0::DOUBLE AS base, o_orderkey % 100 / 100.0::DOUBLE AS score FROM orders) SELECT round(avg(score - base), 6) AS avg_delta, count(*) FILTER (score - base > 0.05) AS wins, count(*) FILTER (score - base < -0.05) AS losses, count(*) FILTER (abs(score - base) <= 0.05) AS ties FROM o")(lambda s, d: score.comparison(_table(s, d, "orders").select(((F.col("o_custkey") % 100) / 100.0).alias("base"), ((F.col("o_orderkey") % 100) / 100.0).alias("score"))))
add("G08_savings", "SELECT o_orderkey, round((2 * o_orderkey + 1) / 997, 2) AS ratio, round(100 * (1 - 997 / (2 * o_orderkey + 1)), 1) AS percent FROM orders")(lambda s, d: _table(s, d, "orders").select("o_orderkey", regress.savings(2 * F.col("o_orderkey") + 1, F.lit(997)).alias("x")).select("o_orderkey", "x.ratio", "x.percent"))
add("G13_answer_errors", _SAID + "SELECT doc_id, CASE WHEN severity = 'low' THEN 'severity,confidence' ELSE 'severity,confidence' END || CASE WHEN t = '' THEN ',explanation' ELSE '' END AS errors FROM p")(lambda s, d: (lambda a: a.select("doc_id", F.array_join(regress.response_errors(a), ",").alias("errors")))(_answers(s, d)))

# ---- gates: a year of graphs against the next, and halves of orders as repeated answers
_YEARS = PREFIX + """, k AS (SELECT g.entrypoint, year(captured_at) AS y, g.graph_id, ir_type FROM graphs g LEFT JOIN nodes n ON n.graph_id = g.graph_id),
c AS (SELECT entrypoint, y, coalesce(list_sort(list(DISTINCT ir_type) FILTER (ir_type IS NOT NULL)), []) AS ids, count(ir_type) / count(DISTINCT graph_id) AS compression, count(DISTINCT CASE WHEN ir_type = 'ir:txn_write' THEN graph_id END) / count(DISTINCT graph_id) AS recall FROM k GROUP BY 1, 2),
lo AS (SELECT min(y) AS y FROM c), a AS (SELECT * FROM c WHERE y = (SELECT y + 1 FROM lo)), b AS (SELECT * FROM c WHERE y = (SELECT y FROM lo))
"""


def _captures(spark, sf_dir):
    from ..schema import CRITICAL
    c = derived(spark, sf_dir)
    k = c.graphs.select("graph_id", "entrypoint", F.year("captured_at").alias("y")).join(c.nodes.select("graph_id", "ir_type"), "graph_id", "left")
    # graphs are counted where their nodes are, not by distinct ones of each trace, for which every node would be shuffled once for each count
    one = k.groupBy("graph_id", F.col("entrypoint").alias("trace"), "y").agg(F.count_if(F.col("ir_type") == "ir:txn_write").alias("writes"), F.count("ir_type").alias("n"))
    counts = one.groupBy("trace", "y").agg((F.sum("n") / F.count("graph_id")).alias("compression"), (F.count_if(F.col("writes") > 0) / F.count("graph_id")).alias("recall"))
    ids = k.groupBy(F.col("entrypoint").alias("trace"), "y").agg(F.array_sort(F.collect_set("ir_type")).alias("node_ids"))
    same = F.expr("i.trace <=> c.trace and i.y <=> c.y")
    g = ids.alias("i").join(counts.alias("c"), same).select("i.*", "compression", "recall")
    g = g.withColumn("critical", F.array_intersect("node_ids", F.array(*map(F.lit, CRITICAL))))
    first = c.graphs.agg(F.min(F.year("captured_at")).alias("first"))  # one row
    of = lambda n: g.join(F.broadcast(first), F.col("y") == F.col("first") + n, "left_semi").drop("y")
    return of(1), of(0)


add("R13_verify_retrieval", _YEARS + """SELECT coalesce(a.entrypoint, b.entrypoint) AS trace, array_to_string(list_filter([
  CASE WHEN a.y IS NOT NULL AND b.y IS NOT NULL AND len(list_filter(a.ids, lambda v: NOT list_contains(b.ids, v))) > 0 THEN 'nodes added' END, CASE WHEN a.y IS NOT NULL AND b.y IS NOT NULL AND len(list_filter(b.ids, lambda v: NOT list_contains(a.ids, v))) > 0 THEN 'nodes removed' END,
  CASE WHEN a.y IS NOT NULL AND b.y IS NOT NULL AND len(list_filter(b.ids, lambda v: NOT list_contains(a.ids, v) AND v IN ('ir:auth_gate', 'ir:authz_check', 'ir:validation_gate', 'ir:txn_boundary', 'ir:scoped_query', 'ir:unscoped_query', 'ir:unscoped_write'))) > 0 THEN 'critical types' END,
  CASE WHEN b.recall - a.recall > 0.05 THEN 'recall' END, CASE WHEN (b.compression - a.compression) / CASE WHEN b.compression = 0 THEN 1.0 ELSE b.compression END > 0.2 THEN 'compression' END], lambda v: v IS NOT NULL), ',') AS reasons FROM a FULL JOIN b ON b.entrypoint = a.entrypoint""")(lambda s, d: regress.verify_retrieval(*_captures(s, d)).select("trace", *joined("reasons")))
add("G12_verify_answers", """WITH o AS (SELECT o_custkey % 500 AS trace, o_orderkey % 2 AS half, o_totalprice / 1000000 AS v FROM orders), r AS (SELECT trace, half, avg(v) AS mean, stddev_pop(v) AS deviation FROM o GROUP BY 1, 2), a AS (SELECT * FROM r WHERE half = 1), b AS (SELECT * FROM r WHERE half = 0)
SELECT coalesce(a.trace, b.trace) AS trace, CASE WHEN b.trace IS NULL THEN 'new' WHEN a.trace IS NULL THEN 'gone' WHEN b.mean - a.mean > greatest(0.05, b.deviation) OR (a.deviation > 2 * b.deviation AND a.deviation > 0.1) THEN 'changed' ELSE 'same' END AS status FROM a FULL JOIN b ON b.trace = a.trace""")(lambda s, d: (lambda r: regress.verify_answers(r.where("half = 1").drop("half"), r.where("half = 0").drop("half")).select("trace", "status"))(_table(s, d, "orders").select((F.col("o_custkey") % 500).alias("trace"), (F.col("o_orderkey") % 2).alias("half"), (F.col("o_totalprice") / 1000000).alias("v")).groupBy("trace", "half").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("deviation"))))
