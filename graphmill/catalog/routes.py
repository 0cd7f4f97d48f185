"""Query language, selections over nodes, edges and routes, facts, questions, constraints."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.facts import FACTS_SQL, HAS, fact_rows
from ..operators import evidence, fluent
from ..plans import language
from ..sources.corpus import PREFIX, derived
from .base import add
from .base import table as _table

FACTS = PREFIX + ", " + FACTS_SQL

ASKED = {
    "Q03_flagship": ("FIND routes WHERE mutation AND auth AND NOT transaction", "is_mutation AND has_auth AND NOT has_txn"),
    "Q05_public": ("FIND ROUTES WHERE public", "NOT has_auth"),
    "Q06_missing_authorization": ("missing-authorization", "has_auth AND NOT has_authz"),
    "Q07_readonly_or_policy": ("FIND ROUTES WHERE readonly OR policy", "NOT is_mutation OR has_authz"),
    "Q08_transaction_escape": ("transaction AND transaction-escape", "has_txn AND has_escape"),
    "Q09_unscoped_not_tenant": ("FIND ROUTES WHERE unscoped AND NOT tenant", "has_unscoped AND NOT has_tenant"),
    "Q10_async_nested": ("FIND ROUTES WHERE async AND (write OR NOT authenticated)", "has_dispatch AND (is_mutation OR NOT has_auth)"),
}
for _name, (_text, _where) in ASKED.items():
    add(_name, FACTS + f"SELECT graph_id, method, path, entrypoint FROM facts WHERE {_where}")(lambda spark, d, t=_text: language.query(derived(spark, d), t))

_HIT = "contains(lower(concat(type, chr(31), symbol, chr(31), coalesce(role, ''))), '{}')"
add("Q11_match_path", PREFIX + f"SELECT graph_id, method, path, entrypoint FROM graphs WHERE graph_id IN (SELECT graph_id FROM nodes GROUP BY 1 HAVING min(CASE WHEN {_HIT.format('auth_gate')} THEN node_ord END) < max(CASE WHEN {_HIT.format('service_call')} THEN node_ord END))")(lambda s, d: language.query(derived(s, d), "MATCH auth_gate -> service_call"))
add("L01_fact_rows", FACTS + f"SELECT graph_id, entrypoint, {', '.join(HAS)}, has_tenant, n_nodes, n_classes, is_mutation FROM facts")(lambda s, d: fact_rows(derived(s, d)).select("graph_id", "entrypoint", *HAS, "has_tenant", "n_nodes", "n_classes", "is_mutation"))
add("F01_nodes_of_type", PREFIX + "SELECT graph_id, node_ord, symbol FROM nodes WHERE ir_type = 'ir:authz_check' AND contains(lower(symbol), 'widget') AND role = 'N'")(lambda s, d: fluent.nodes(derived(s, d)).of_type("policy").with_symbol("WIDGET").with_role("N").df.select("graph_id", "node_ord", "symbol"))
add("F06_edges_between", PREFIX + "SELECT e.graph_id, e.src, e.dst::BIGINT AS dst, e.relation FROM edges e JOIN nodes a ON a.graph_id = e.graph_id AND a.node_ord = e.src JOIN nodes b ON b.graph_id = e.graph_id AND b.node_ord = e.dst WHERE a.type = 'ir:auth_gate' AND b.type = 'ir:service_call'")(lambda s, d: fluent.edges(derived(s, d)).between("ir:auth_gate", "ir:service_call").df.select("graph_id", "src", "dst", "relation"))
add("F07_edge_targets", PREFIX + "SELECT n.graph_id, node_ord, type FROM nodes n WHERE EXISTS (SELECT 1 FROM edges e WHERE e.graph_id = n.graph_id AND e.dst = n.node_ord AND e.relation = 'ir:calls')")(lambda s, d: fluent.edges(derived(s, d)).of_relation("ir:calls").to_nodes().df.select("graph_id", "node_ord", "type"))
add("F08_first_handler", PREFIX + "SELECT graph_id, min(node_ord) AS node_ord, arg_min(symbol, node_ord) AS symbol FROM nodes WHERE ir_type = 'ir:business_handler' GROUP BY 1")(lambda s, d: fluent.nodes(derived(s, d)).of_type("controller_action").first().select("graph_id", "node_ord", "symbol"))
add("F13_normalised_entrypoints", PREFIX + "SELECT regexp_replace(entrypoint, '\\{[^}]+\\}', '{*}', 'g') AS route, count(*) AS n FROM graphs GROUP BY 1")(lambda s, d: derived(s, d).graphs.groupBy(F.regexp_replace("entrypoint", r"\{[^}]+\}", "{*}").alias("route")).agg(F.count("*").alias("n")))
add("J02_connected_to", PREFIX + "SELECT graph_id, node_ord, symbol FROM nodes n WHERE n.ir_type = 'ir:service_call' AND EXISTS (SELECT 1 FROM edges e JOIN nodes t ON t.graph_id = e.graph_id AND t.node_ord = e.dst WHERE e.graph_id = n.graph_id AND e.src = n.node_ord AND t.ir_type = 'ir:txn_boundary')")(lambda s, d: (lambda c: fluent.nodes(c).of_type("ir:service_call").connected_to(fluent.nodes(c).of_type("ir:txn_boundary")).df.select("graph_id", "node_ord", "symbol"))(derived(s, d)))
add("J04_unwrapped_mutations", PREFIX + "SELECT graph_id, node_ord, symbol FROM nodes n WHERE mutates AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.graph_id = n.graph_id AND e.dst = n.node_ord AND e.relation = 'ir:wraps')")(lambda s, d: fluent.nodes(derived(s, d)).where(F.col("mutates")).without_incoming("ir:wraps").df.select("graph_id", "node_ord", "symbol"))
add("A01_counts", PREFIX + "SELECT g.graph_id, count(n.node_ord) AS n_nodes FROM graphs g LEFT JOIN nodes n ON n.graph_id = g.graph_id GROUP BY 1")(lambda s, d: fact_rows(derived(s, d)).select("graph_id", "n_nodes"))
add("A08_out_degree", PREFIX + "SELECT graph_id, src, count(*) AS degree FROM edges GROUP BY 1, 2")(lambda s, d: derived(s, d).edges.groupBy("graph_id", "src").agg(F.count("*").alias("degree")))
add("F04_by_ids", PREFIX + "SELECT graph_id, id, symbol FROM nodes WHERE id IN ('n2', 'n5')")(lambda s, d: fluent.nodes(derived(s, d)).by_ids("n2", "n5").df.select("graph_id", "id", "symbol"))
add("F05_edges_from_to", PREFIX + "SELECT graph_id, edge_ord, relation FROM edges WHERE relation = 'ir:calls' AND src = 3 AND dst = 2")(lambda s, d: fluent.edges(derived(s, d)).of_relation("ir:calls").leaving("n3").entering("n2").df.select("graph_id", "edge_ord", "relation"))
add("F07_edge_sources", PREFIX + "SELECT n.graph_id, node_ord, type FROM nodes n WHERE EXISTS (SELECT 1 FROM edges e WHERE e.graph_id = n.graph_id AND e.src = n.node_ord AND e.relation = 'ir:accesses')")(lambda s, d: fluent.edges(derived(s, d)).of_relation("ir:accesses").from_nodes().df.select("graph_id", "node_ord", "type"))
add("F08_terminals", PREFIX + "SELECT g.graph_id, count(node_ord) > 0 AS found, count(node_ord) AS n, coalesce(string_agg(symbol, ',' ORDER BY node_ord), '') AS symbols, coalesce(max(CASE WHEN id = 'n2' THEN symbol END), '') AS of_n2 FROM graphs g LEFT JOIN (SELECT * FROM nodes WHERE ir_type = 'ir:service_call') n ON n.graph_id = g.graph_id GROUP BY 1")(lambda s, d: fluent.nodes(derived(s, d)).of_type("service_call").terminals().select("graph_id", "found", "n", F.array_join(F.transform("nodes", lambda x: x["symbol"]), ",").alias("symbols"), F.coalesce(F.try_element_at("by_id", F.lit("n2"))["symbol"], F.lit("")).alias("of_n2")))
add("F09_route_filters", FACTS + "SELECT graph_id, entrypoint FROM facts WHERE is_mutation AND has_auth AND NOT has_authz AND NOT has_txn AND has_dispatch")(lambda s, d: fluent.Routes(derived(s, d)).mutations().authenticated().without_authorization().without_transaction().with_dispatch().df.select("graph_id", "entrypoint"))
add("F10_route_map", FACTS + "SELECT entrypoint || ':' || n_nodes AS label FROM facts WHERE has_escape AND has_unscoped")(lambda s, d: fluent.Routes(derived(s, d)).with_escape().with_unscoped_access().map(F.concat("entrypoint", F.lit(":"), F.col("n_nodes").cast("string")).alias("label")))
add("F12_substring_routes", PREFIX + "SELECT graph_id, entrypoint FROM graphs WHERE contains(lower(entrypoint), 'post /c1')")(lambda s, d: fluent.find_routes(derived(s, d), "POST /c1").select("graph_id", "entrypoint"))
add("F13_matched_entrypoint", PREFIX + "SELECT min(graph_id) AS graph_id FROM graphs WHERE regexp_replace(entrypoint, '\\{[^}]+\\}', '{*}', 'g') = 'GET /c3/{*}'")(lambda s, d: fluent.match_entrypoint(derived(s, d), "GET /c3/{order}").select("graph_id"))
add("F15_legacy_types", PREFIX + "SELECT type, ir_type, count(*) AS n FROM nodes GROUP BY 1, 2")(lambda s, d: derived(s, d).nodes.groupBy("type", "ir_type").agg(F.count("*").alias("n")))
add("J05_missing_ids", PREFIX + "SELECT a.graph_id, 'n99' AS id FROM annotations a")(lambda s, d: (lambda c: fluent.missing_ids(c, c.annotations.select("graph_id", F.explode(F.concat("nodes", F.array(F.lit("n99")))).alias("id"))))(derived(s, d)))
add("W04_chain", PREFIX + "SELECT graph_id, src, dst FROM edges WHERE relation = 'next_middleware'")(lambda s, d: fluent.chain(derived(s, d)))
add("Q12_predicates", "SELECT * FROM (VALUES ('async'), ('async-dispatch'), ('auth'), ('authenticated'), ('authorization'), ('event'), ('missing-authorization'), ('mutation'), ('no-auth'), ('no-authorization'), ('no-policy'), ('no-transaction'), ('policy'), ('public'), ('queue'), ('read'), ('readonly'), ('tenant'), ('tenant-scoped'), ('transaction'), ('transaction-escape'), ('unauthenticated'), ('unscoped'), ('unscoped-access'), ('write')) t(predicate)")(lambda s, d: s.createDataFrame([(p,) for p in language.known_predicates()], "predicate string"))
add("Q13_query_result", FACTS + "SELECT count(*) AS n, count(DISTINCT entrypoint) AS n_entrypoints FROM facts WHERE is_mutation AND NOT has_auth")(lambda s, d: language.query(derived(s, d), "mutation AND public").agg(F.count("*").alias("n"), F.count_distinct("entrypoint").alias("n_entrypoints")))


_ASK = "coalesce(text, '')"
_FOCUS = "CASE " + " ".join(f"WHEN regexp_matches(trim({_ASK}), '{p}') THEN '{f}'" for f, p in evidence.FOCUS) + " ELSE 'all' END"
add("R20_focus", f"SELECT conv_id, turn, {_FOCUS} AS focus FROM conversations")(lambda s, d: _table(s, d, "conversations").select("conv_id", "turn", evidence.focus(F.col("text")).alias("focus")))
_SHARES = " UNION ALL ".join(f"SELECT id, '{i}' AS intent, {k} AS pos, ({' + '.join(f'contains(lower({_ASK}), {w!r})::INT' for w in ws)}) / {len(ws)}.0::DOUBLE AS score FROM asked" for k, (i, ws) in enumerate(evidence.INTENT_WORDS.items()))
add("R21_intents", f"""WITH asked AS (SELECT concat_ws('-', conv_id::VARCHAR, turn::VARCHAR) AS id, text FROM conversations), s AS ({_SHARES}),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, pos) AS rank, max(score) OVER (PARTITION BY id) AS top FROM s)
SELECT id, CASE WHEN top = 0 THEN 'all' ELSE intent END AS intent, round(score, 6) AS score, rank FROM r WHERE rank = 1 OR (top > 0 AND score >= 0.12)""")(lambda s, d: evidence.intents(_table(s, d, "conversations").select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), "text"), "id", "text"))
_TIERS = evidence.merged_relevance(["auth", "transaction"])
_FACT = " UNION ALL ".join(f"SELECT '{f}' AS fact, '{_TIERS.get(f, 'low')}' AS relevance, g.graph_id, count(node_ord) AS n, nullif(string_agg(nullif(symbol, ''), ', ' ORDER BY node_ord), '') AS value FROM graphs g LEFT JOIN (SELECT * FROM nodes WHERE {rule}) n ON n.graph_id = g.graph_id GROUP BY g.graph_id" for f, rule in evidence.FACT_TYPES.items())
add("R23_facts", PREFIX + f"SELECT graph_id, fact, n > 0 AS present, n, value, relevance FROM ({_FACT}) WHERE n > 0 OR relevance = 'high'")(lambda s, d: evidence.facts(derived(s, d), ["auth", "transaction"]))
_RULES = [("writes need authentication", "HIGH", "mutation AND public"), ("reads are scoped", "MEDIUM", "readonly AND unscoped")]
add("R25_constraints", FACTS + "SELECT 'writes need authentication' AS \"constraint\", 'HIGH' AS severity, graph_id, entrypoint, NULL::VARCHAR AS error FROM facts WHERE is_mutation AND NOT has_auth UNION ALL SELECT 'reads are scoped', 'MEDIUM', graph_id, entrypoint, NULL FROM facts WHERE NOT is_mutation AND has_unscoped")(lambda s, d: evidence.check_constraints(derived(s, d), _RULES))
add("A18_constraint_report", FACTS + "SELECT 'writes need authentication' AS \"constraint\", count(*) AS n FROM facts WHERE is_mutation AND NOT has_auth UNION ALL SELECT 'reads are scoped', count(*) FROM facts WHERE NOT is_mutation AND has_unscoped")(lambda s, d: evidence.check_constraints(derived(s, d), _RULES).groupBy("constraint").agg(F.count("*").alias("n")))
