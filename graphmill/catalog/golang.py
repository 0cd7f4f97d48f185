"""Routes, gates, bindings and transactions of Go projects."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import gin
from ..sources import projects
from ..sources.corpus import once
from ..sources.gosyntax import go_syntax
from .base import add, joined

_S = """WITH s AS (SELECT s_suppkey AS k, s_suppkey // 20 AS n, 'go-' || (s_suppkey // 20) AS project, 'routes/s' || s_suppkey || '.go' AS file FROM supplier),
p AS (SELECT DISTINCT n, project FROM s)"""
#: routes with their gates as they are written
_ROUTES = _S + """, r AS (
  SELECT n, k, project, file, 'GET' AS method, '/api/v1/s' || k || '/:id' AS path, 'h.Get' AS handler, 'S' || k || 'Handler' AS holder, ['middleware.RequireRole(model.RoleAdmin, "x")'] AS more FROM s
  UNION ALL SELECT n, k, project, file, 'POST', '/api/v1/s' || k, 'h.Create', 'S' || k || 'Handler', ['middleware.RequireRole(model.RoleAdmin, "x")', 'Limit(' || k || ')'] FROM s
  UNION ALL SELECT n, k, project, file, 'DELETE', '/api/v1/s' || k || '/:id', 'func(c *gin.Context) { c.Status(204) }', NULL, ['middleware.RequireRole(model.RoleAdmin, "x")'] FROM s WHERE k % 3 = 0
  UNION ALL SELECT n, NULL, project, 'cmd/main.go', 'GET', '/health', 'health', NULL, []::VARCHAR[] FROM p),
routes AS (SELECT * EXCLUDE (more), list_concat(CASE WHEN n % 2 = 1 THEN ['middleware.Logger()'] ELSE []::VARCHAR[] END, ['middleware.AuthMiddleware(cfg)'], more) AS gates FROM r)"""
_TXN = """txn AS (SELECT k, project, file, CASE WHEN k % 7 > 0 THEN 'S' || k || 'Service.Create' END AS service FROM s WHERE k % 7 = 0 OR k % 4 < 2)"""
_BIND = """bind AS (SELECT k, project, file, 'S' || k || 'Request' AS type, 'Name:required' || CASE WHEN k % 2 = 0 THEN ',Age:gte=' || k ELSE '' END AS rules,
  'bound via ctx.' || CASE WHEN k % 2 = 0 THEN 'ShouldBindJSON' ELSE 'ShouldBindUri' END AS detail FROM s)"""


def read(spark, d):
    keep = once(spark, "golang", d, ("supplier",))
    s = keep(go_syntax(projects.go_files(spark, d)), "syntax")
    return s, keep


def found(spark, d):
    s, keep = read(spark, d)
    return s, keep(gin.routes(s, keep), "routes")


@add("S28_group_routes", _ROUTES + " SELECT project, file, method, path, handler, holder, array_to_string(gates, ' ') AS gates FROM routes")
def group_routes(spark, d):
    return found(spark, d)[1].select("project", "file", "method", "path", "handler", "holder", F.array_join(F.transform("gates", lambda g: g["text"]), " ").alias("gates"))


@add("S28_nodes", _ROUTES + f""", {_TXN}, {_BIND},
g AS (SELECT project, method, path, unnest(gates) AS symbol, generate_subscripts(gates, 1) - 1 AS ord, file FROM routes),
kept AS (SELECT project, method, path, 0 AS part, ord, 'mw_' || ord AS id, CASE WHEN contains(symbol, 'Auth') THEN 'ir:auth_gate' WHEN contains(symbol, 'Role') THEN 'ir:authz_check' ELSE 'ir:unknown_middleware' END AS type,
  CASE WHEN contains(symbol, 'Auth') THEN 'authentication' WHEN contains(symbol, 'Role') THEN 'authorization' ELSE 'middleware' END AS role, symbol,
  CASE WHEN contains(symbol, 'Role') THEN 'admin,"x"' WHEN contains(symbol, 'Auth') THEN 'cfg' WHEN contains(symbol, 'Logger') THEN '' ELSE regexp_extract(symbol, '\\d+') END AS args, NULL AS detail,
  CASE WHEN contains(symbol, 'Auth') THEN 'cmd/main.go' WHEN contains(symbol, 'Role') THEN 'shared.go' WHEN contains(symbol, 'Logger') THEN 'server.go' ELSE file END AS file FROM g WHERE NOT (contains(symbol, 'Auth') AND path = '/health')
  UNION ALL SELECT r.project, method, path, 1, 0, 'validation', 'ir:validation_gate', 'validation', type, rules, detail, b.file FROM routes r JOIN bind b ON b.k = r.k WHERE handler = 'h.Create'
  UNION ALL SELECT project, method, path, 2, 0, 'handler', 'ir:business_handler', 'handler', handler, '', NULL, file FROM routes
  UNION ALL SELECT r.project, method, path, 3, 0, 'txn', 'ir:txn_boundary', 'transaction', coalesce(service, handler), '', NULL, t.file FROM routes r JOIN txn t ON t.k = r.k WHERE handler = 'h.Create')
SELECT project, method, path, row_number() OVER (PARTITION BY project, method, path ORDER BY part, ord) - 1 AS nth, id, type, role, symbol, args, detail, file FROM kept""")
def nodes(spark, d):
    s, r = found(spark, d)
    return gin.nodes(r, s).drop("places", "line").withColumn("args", joined("args")[0])


@add("S28_edges", _ROUTES + f""", {_TXN}, c AS (SELECT r.project, method, path, list_concat(['mw_' || i FOR i IN generate_series(0, len(gates) - 1) IF NOT (path = '/health' AND contains(gates[i + 1], 'Auth'))],
  CASE WHEN handler = 'h.Create' THEN ['validation'] ELSE []::VARCHAR[] END, ['handler'], CASE WHEN handler = 'h.Create' AND t.k IS NOT NULL THEN ['txn'] ELSE []::VARCHAR[] END) AS ids FROM routes r LEFT JOIN txn t ON t.k = r.k)
SELECT project, method, path, string_agg(ids[i] || '>' || ids[i + 1], ',' ORDER BY i) AS chain FROM (SELECT *, unnest(generate_series(1, len(ids) - 1)) AS i FROM c) GROUP BY ALL""")
def edges(spark, d):
    s, r = found(spark, d)
    e = gin.edges(gin.nodes(r, s)).groupBy("project", "places").agg(F.collect_list(F.struct("from", "to")).alias("e"))
    # a chain's edges follow each other: gates by number, then validation, handler, transaction
    rank = lambda x: F.when(x.startswith("mw_"), F.substring(x, 4, 9).cast("int")).when(x == "validation", 1_000_000_000).when(x == "handler", 1_000_000_001)
    text = F.array_join(F.transform(F.array_sort(F.transform("e", lambda x: F.struct(rank(x["from"]).alias("k"), x.alias("x")))), lambda y: F.concat_ws(">", y["x"]["from"], y["x"]["to"])), ",")
    return r.join(e, ["project", "places"]).select("project", "method", "path", text.alias("chain"))


@add("S29_go_constants", _S + " SELECT project, 'RoleAdmin' AS name, 'admin' AS value FROM p")
def constants(spark, d):
    return gin.constants(read(spark, d)[0])


@add("S29_exemptions", _S + " SELECT project, 'AuthMiddleware' AS name, method, route FROM p, (VALUES ('GET', '/health'), ('POST', '/api/none')) v(method, route)")
def exemptions(spark, d):
    return gin.exemptions(read(spark, d)[0])


@add("S29_bindings", _S + f", {_BIND} SELECT project, 'S' || k || 'Handler' AS owner, 'Create' AS method, type, file, rules, detail FROM bind")
def bindings(spark, d):
    return gin.bindings(read(spark, d)[0]).withColumn("rules", joined("rules")[0])


@add("S29_transactions", _S + f", {_TXN} SELECT project, 'S' || k || 'Handler' AS owner, 'Create' AS method, service, file FROM txn UNION ALL SELECT project, 'S' || k || 'Service', 'Create', NULL, file FROM s WHERE k % 4 < 2")
def transactions(spark, d):
    return gin.transactions(read(spark, d)[0]).drop("line")
