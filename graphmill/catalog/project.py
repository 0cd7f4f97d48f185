"""Joins over the tables of a project: security rules, transactional services, base classes."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import project
from .base import add, table

_RULES = """r AS (SELECT n_nationkey AS rule_ord, 'M' || (n_nationkey % 5) AS module, n_nationkey // 5 AS kind, CASE n_nationkey % 4 WHEN 0 THEN 'permit' WHEN 1 THEN 'authenticated' WHEN 2 THEN 'admin' ELSE 'deny' END AS access FROM nation),
rules AS (SELECT *, CASE kind WHEN 0 THEN '/**' WHEN 1 THEN '/api/**' WHEN 2 THEN '/api/*/edit' WHEN 3 THEN '/open' ELSE '/*/p1?' END AS pattern,
  CASE kind WHEN 0 THEN '^.*$' WHEN 1 THEN '^/api/.*(/.*)?$' WHEN 2 THEN '^/api/[^/]*/edit(/.*)?$' WHEN 3 THEN '^/open(/.*)?$' ELSE '^/[^/]*/p1[^/](/.*)?$' END AS regex,
  CASE kind WHEN 0 THEN 3 - 10 WHEN 1 THEN 7 - 10 WHEN 2 THEN 11 - 5 WHEN 3 THEN 5 ELSE 6 - 5 END AS weight FROM r)"""
_PATH = "CASE p_partkey % 3 WHEN 0 THEN '/open' WHEN 1 THEN '/api' ELSE '/other' END || '/p' || (p_partkey % 13) || CASE WHEN p_partkey % 2 = 0 THEN '/edit' ELSE '' END"


def _rules(spark, d):
    k = F.col("n_nationkey").cast("int")
    pattern = F.get(F.array(*map(F.lit, ("/**", "/api/**", "/api/*/edit", "/open", "/*/p1?"))), F.floor(k / 5).cast("int"))
    return table(spark, d, "nation").select(k.alias("rule_ord"), F.concat(F.lit("M"), (k % 5).cast("string")).alias("module"), pattern.alias("pattern"), F.get(F.array(*map(F.lit, ("permit", "authenticated", "admin", "deny"))), k % 4).alias("access"))


@add("J07_secured", f"""WITH {_RULES}, kept AS (SELECT * REPLACE (CASE WHEN kind = 0 THEN -1000 ELSE weight END AS weight) FROM rules WHERE kind > 0 OR rule_ord = (SELECT arg_min(rule_ord, (CASE access WHEN 'deny' THEN 0 WHEN 'authenticated' THEN 1 WHEN 'permit' THEN 3 ELSE 2 END, rule_ord)) FROM rules WHERE kind = 0)),
p AS (SELECT p_partkey AS route_id, 'M' || (p_partkey % 6) AS module, {_PATH} AS path FROM part),
hit AS (SELECT route_id, rule_ord, access, row_number() OVER (PARTITION BY route_id ORDER BY weight DESC, rule_ord) AS nth FROM p JOIN kept k ON k.module = p.module AND regexp_matches(path, regex))
SELECT p.route_id, rule_ord, access FROM p LEFT JOIN (SELECT * FROM hit WHERE nth = 1) h ON h.route_id = p.route_id""")
def secured(spark, d):
    routes = table(spark, d, "part").select(F.col("p_partkey").alias("route_id"), F.expr("concat('M', p_partkey % 6)").alias("module"), F.expr(_PATH).alias("path"))
    return project.secured(routes, _rules(spark, d))


@add("O06_ordered_rules", f"""WITH {_RULES} SELECT module, rule_ord, pattern, access, weight FROM rules WHERE kind > 0
UNION ALL SELECT module, rule_ord, pattern, access, -2147483648 FROM rules WHERE kind = 0 QUALIFY row_number() OVER (ORDER BY CASE access WHEN 'deny' THEN 0 WHEN 'authenticated' THEN 1 WHEN 'permit' THEN 3 ELSE 2 END, rule_ord) = 1""")
def ordered(spark, d):
    return project.ordered_rules(_rules(spark, d)).select("module", "rule_ord", "pattern", "access", F.col("weight").cast("long").alias("weight"))


# suppliers mark services: some a whole class, some a method, some of the same twice
_MARKS = """SELECT DISTINCT 'M' || (s_nationkey % 3) AS module, 'Service' || (s_suppkey % 9) || CASE WHEN s_suppkey % 2 = 0 THEN 'Impl' ELSE '' END AS class, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE 'm' || (s_suppkey % 4) END AS method FROM supplier WHERE s_suppkey % 7 <> 0"""
_CALLS = "SELECT o_orderkey AS call_id, 'M' || (o_custkey % 4) AS module, 'Service' || (o_custkey % 10) AS class, 'm' || (o_orderkey % 4) AS method FROM orders"
_IMPLS = "SELECT DISTINCT 'M' || (s_nationkey % 3) AS module, 'Service' || (s_suppkey % 9) AS interface, 'Service' || (s_suppkey % 9) || 'Impl' AS class, 1 AS ord FROM supplier UNION ALL SELECT DISTINCT 'M' || (s_nationkey % 3), 'Service' || (s_suppkey % 9), 'Service' || ((s_suppkey + 1) % 9), 2 FROM supplier"
_IN_TXN = f"""WITH marks AS ({_MARKS}), calls AS ({_CALLS}), impls AS ({_IMPLS}), marking AS (SELECT DISTINCT module, class FROM marks),
behind AS (SELECT i.module, i.interface, arg_min(i.class, i.ord) AS impl FROM impls i JOIN marking m ON m.module = i.module AND m.class = i.class GROUP BY 1, 2),
said AS (SELECT c.*, coalesce(m.class, b.impl) AS speaker FROM calls c LEFT JOIN marking m ON m.module = c.module AND m.class = c.class LEFT JOIN behind b ON b.module = c.module AND b.interface = c.class),
hit AS (SELECT call_id, speaker FROM said s WHERE EXISTS (SELECT 1 FROM marks m WHERE m.module = s.module AND m.class = s.speaker AND (m.method IS NULL OR m.method = s.method)))
"""


def _called(spark, d):
    for name in ("supplier", "orders"):
        table(spark, d, name).createOrReplaceTempView(f"graphmill_{name}")
    read = lambda sql: spark.sql(sql.replace("FROM supplier", "FROM graphmill_supplier").replace("FROM orders", "FROM graphmill_orders"))
    return read(_CALLS), read(_MARKS), read(_IMPLS)


@add("J08_transactional", _IN_TXN + 'SELECT call_id, speaker AS "by" FROM hit')
def transactional(spark, d):
    return project.in_service_transactions(*_called(spark, d))


@add("J08_moved_edges", _IN_TXN + """SELECT o_custkey AS graph_id, 'handler' AS src, CASE WHEN call_id IS NULL THEN 'c' || o_orderkey ELSE 'svctxn_c' || o_orderkey END AS dst, 'ir:calls' AS relation FROM orders LEFT JOIN hit ON call_id = o_orderkey
UNION ALL SELECT o_custkey, 'svctxn_c' || o_orderkey, 'c' || o_orderkey, 'ir:calls' FROM orders JOIN hit ON call_id = o_orderkey""")
def moved(spark, d):
    node = F.concat(F.lit("c"), F.col("o_orderkey").cast("string"))
    o = table(spark, d, "orders")
    edges = o.select(F.col("o_custkey").alias("graph_id"), F.lit("handler").alias("src"), node.alias("dst"), F.lit("ir:calls").alias("relation"))
    hit = project.in_service_transactions(*_called(spark, d)).join(o, F.col("call_id") == F.col("o_orderkey")).select(F.col("o_custkey").alias("graph_id"), node.alias("node"))
    return project.through_transactions(edges, hit)


@add("J09_base_paths", """WITH b AS (SELECT 'M' || (s_nationkey % 3) AS module, 'Base' || (s_suppkey % 8) AS class, max('/v' || (s_suppkey % 8) || '/') AS path FROM supplier GROUP BY 1, 2)
SELECT p.module, p.class, rtrim(coalesce(nullif(own, ''), b.path, ''), '/') || '/' || tail AS path
FROM (SELECT 'M' || (p_size % 4) AS module, 'C' || p_partkey AS class, 'Base' || (p_partkey % 10) AS base, CASE WHEN p_partkey % 3 = 0 THEN '/own' || p_size WHEN p_partkey % 3 = 1 THEN '' END AS own, 'p' || p_partkey AS tail FROM part) p LEFT JOIN b ON b.module = p.module AND b.class = p.base""")
def base_paths(spark, d):
    bases = table(spark, d, "supplier").selectExpr("concat('M', s_nationkey % 3) AS module", "concat('Base', s_suppkey % 8) AS class", "concat('/v', s_suppkey % 8, '/') AS path")
    own = "CASE WHEN p_partkey % 3 = 0 THEN concat('/own', p_size) WHEN p_partkey % 3 = 1 THEN '' END"
    controllers = table(spark, d, "part").selectExpr("concat('M', p_size % 4) AS module", "concat('C', p_partkey) AS class", "concat('Base', p_partkey % 10) AS base", f"{own} AS own_path", "concat(CASE WHEN p_partkey % 2 = 0 THEN '/' ELSE '' END, 'p', p_partkey) AS method_path")
    return project.base_paths(controllers, bases)


@add("J10_not_exempt", """WITH r AS (SELECT p_partkey AS route_id, CASE p_partkey % 3 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' ELSE 'PUT' END AS method, '/r' || (p_partkey % 40) AS path FROM part), x AS (SELECT CASE n_nationkey % 2 WHEN 0 THEN '*' ELSE 'POST' END AS method, '/r' || n_nationkey AS path FROM nation)
SELECT * FROM r WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.path = r.path AND x.method IN ('*', r.method))""")
def not_exempt(spark, d):
    routes = table(spark, d, "part").selectExpr("p_partkey AS route_id", "CASE p_partkey % 3 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' ELSE 'PUT' END AS method", "concat('/r', p_partkey % 40) AS path")
    return project.not_exempt(routes, table(spark, d, "nation").selectExpr("CASE n_nationkey % 2 WHEN 0 THEN '*' ELSE 'POST' END AS method", "concat('/r', n_nationkey) AS path"))


@add("J12_hierarchy", """WITH p AS (SELECT p_size AS graph_id, 'EDIT' || (p_partkey % 20) || CASE WHEN p_partkey % 3 = 0 THEN '_ANY' ELSE '' END AS symbol FROM part)
SELECT DISTINCT h.graph_id, h.symbol AS elevated, l.symbol AS base FROM p h JOIN p l ON l.graph_id = h.graph_id AND h.symbol = l.symbol || '_ANY'""")
def hierarchy(spark, d):
    return project.hierarchy(table(spark, d, "part").selectExpr("p_size AS graph_id", "concat('EDIT', p_partkey % 20, CASE WHEN p_partkey % 3 = 0 THEN '_ANY' ELSE '' END) AS symbol"))


@add("J13_reachable_permissions", """WITH p AS (SELECT DISTINCT p_size AS graph_id, 'C' || (p_partkey % 15) AS class, 'v' || (p_partkey % 30) AS value FROM part), s AS (SELECT s_suppkey % 50 AS graph_id, 'use C' || (s_suppkey % 17) || '::X' AS source FROM supplier), a AS (SELECT c_custkey % 50 AS graph_id, 'v' || (c_custkey % 40) AS value FROM customer WHERE c_custkey % 3 = 0)
SELECT * FROM p WHERE EXISTS (SELECT 1 FROM s WHERE s.graph_id = p.graph_id AND contains(source, class)) OR EXISTS (SELECT 1 FROM a WHERE a.graph_id = p.graph_id AND a.value = p.value)""")
def reachable(spark, d):
    permissions = table(spark, d, "part").selectExpr("p_size AS graph_id", "concat('C', p_partkey % 15) AS class", "concat('v', p_partkey % 30) AS value")
    sources = table(spark, d, "supplier").selectExpr("s_suppkey % 50 AS graph_id", "concat('use C', s_suppkey % 17, '::X') AS source")
    return project.reachable_permissions(permissions, sources, table(spark, d, "customer").where("c_custkey % 3 = 0").selectExpr("c_custkey % 50 AS graph_id", "concat('v', c_custkey % 40) AS value"))


@add("W05_guarded", "SELECT a.l_orderkey AS graph_id, a.l_linenumber AS src, b.l_linenumber AS dst FROM lineitem a JOIN lineitem b ON b.l_orderkey = a.l_orderkey AND b.l_linenumber > a.l_linenumber WHERE a.l_partkey % 5 = 0")
def guarded(spark, d):
    return project.guarded(table(spark, d, "lineitem").selectExpr("l_orderkey AS graph_id", "l_linenumber AS node_ord", "CASE WHEN l_partkey % 5 = 0 THEN 'ir:guard_clause' ELSE 'ir:service_call' END AS type"))


@add("A20_sources", "SELECT graph_id, string_agg(n_name, chr(10) ORDER BY 'f' || n_nationkey) AS source FROM (SELECT DISTINCT p_size AS graph_id, p_partkey % 30 AS f FROM part) JOIN nation ON n_nationkey = f GROUP BY 1")
def sources(spark, d):
    return project.sources_of(table(spark, d, "part").selectExpr("p_size AS graph_id", "concat('f', p_partkey % 30) AS file"), table(spark, d, "nation").selectExpr("concat('f', n_nationkey) AS file", "n_name AS content"))
