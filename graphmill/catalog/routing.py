"""Routes over files that include each other, and the tables that name their middleware."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import routing
from ..operators.code import imports
from ..sources import projects
from ..sources.corpus import once
from ..sources.syntax import syntax
from .base import add

_N = "SELECT DISTINCT s_nationkey AS n, 'nation-' || s_nationkey AS project FROM supplier"


def read(spark, d):
    keep = once(spark, "routing", d, ("supplier",))
    s = keep(syntax(projects.route_files(spark, d)), "syntax")
    return s, keep(routing.chains(s), "chains"), keep


def ways(spark, d):
    s, c, keep = read(spark, d)
    entries = s.select("project").distinct().withColumn("path", F.lit("routes/api.php"))
    return s, c, keep(routing.contexts(s, c, entries, keep), "contexts"), keep


@add("S13_kernel", rf"""WITH n AS ({_N}) SELECT project, 'alias' AS kind, 'role' AS name, CASE WHEN n % 2 = 0 THEN 'App\Http\Middleware\HasRole' ELSE 'App\Http\Middleware\EnsureRole' END AS value FROM n
UNION ALL SELECT project, 'alias', 'nothing', 'x' FROM n WHERE n % 2 = 0 UNION ALL SELECT project, 'group', 'api', 'App\Http\Middleware\Authenticate,throttle:api' FROM n WHERE n % 2 = 0""")
def kernel(spark, d):
    s = read(spark, d)[0]
    return routing.aliases(s).select("project", F.lit("alias").alias("kind"), F.col("alias").alias("name"), F.col("fqcn").alias("value")).unionByName(routing.middleware_groups(s).select("project", F.lit("group").alias("kind"), "name", F.array_join("entries", ",").alias("value")))


@add("S14_starts", f"WITH n AS ({_N}) SELECT project, 'routes/api.php' AS path, 'api/v1' AS prefix FROM n WHERE n % 2 = 1")
def starts(spark, d):
    return routing.starts(read(spark, d)[0])


@add("S15_wraps", rf"WITH n AS ({_N}) SELECT project, 'routes/api.php' AS path, 'web,App\Http\Middleware\Authenticate,throttle:api' AS middleware, 'App\Api' AS namespace, 'v2' AS prefix FROM n WHERE n % 2 = 0")
def wraps(spark, d):
    s, c, _ = read(spark, d)
    return routing.wraps(s, c).select("project", "path", F.array_join("middleware", ",").alias("middleware"), "namespace", "prefix")


@add("S17_constants", f"WITH n AS ({_N}) SELECT project, 'Permission' AS class, 'EDIT' AS name, 'edit' AS value FROM n WHERE n % 3 > 0")
def constants(spark, d):
    return routing.constants(read(spark, d)[0])


_OUT = r"CASE WHEN n % 2 = 0 THEN ['web', 'App\Http\Middleware\Authenticate', 'throttle:api'] ELSE []::VARCHAR[] END"
_WAYS = rf"""WITH s AS (SELECT s_suppkey AS k, s_nationkey AS n, 'nation-' || s_nationkey AS project, s_suppkey % 3 AS g FROM supplier),
base AS (SELECT *, CASE WHEN n % 2 = 0 THEN '/v2' ELSE '/api/v1' END AS root, {_OUT} AS out, CASE WHEN n % 2 = 0 THEN 'App\Api' END AS namespace FROM s),
ctx AS (SELECT *, root || CASE g WHEN 0 THEN '/n' WHEN 1 THEN '/n/in' ELSE '' END AS prefix, list_concat(out, CASE WHEN g < 2 THEN ['auth:api'] ELSE []::VARCHAR[] END) AS mw FROM base)
"""


@add("S14_route_prefixes", _WAYS + """SELECT DISTINCT project, 'routes/api.php' AS path, root AS prefix, array_to_string(out, ',') AS middleware, namespace, 0 AS depth FROM ctx
UNION ALL SELECT DISTINCT project, 'routes/g' || g || '.php', prefix, array_to_string(mw, ','), namespace, 1 FROM ctx
UNION ALL SELECT project, 'routes/s/s' || k || '.php', prefix, array_to_string(mw, ','), namespace, 2 FROM ctx""")
def prefixes(spark, d):
    return ways(spark, d)[2].select("project", "path", "prefix", F.array_join("middleware", ",").alias("middleware"), "namespace", "depth")


_MADE = [  # method, tail of the path, middleware behind the file's own, controller, action
    ("GET", "'/s' || k", "[]::VARCHAR[]", "'S' || k || 'Controller'", "index"), ("POST", "'/x/y/{id}'", "['role:admin', 'Perm', 'can:' || CASE WHEN n % 3 > 0 THEN 'edit' ELSE 'Permission::EDIT' END]", "'S' || k || 'Controller'", "save"),
    ("DELETE", "'/x/deep/z'", "['role:admin', 'Perm', 'throttle:60']", r"'Other\ZController'", "__invoke"), ("GET", "'/things'", "['signed']", "'ThingController'", "index"), ("DELETE", "'/things/{id}'", "['signed']", "'ThingController'", "destroy"),
]
_ROUTES = " UNION ALL ".join(f"SELECT k, n, project, 'routes/s/s' || k || '.php' AS file, '{m}' AS method, prefix || {t} AS path, list_concat(mw, {w}) AS middleware, {c} AS controller, '{a}' AS action, namespace FROM ctx" for m, t, w, c, a in _MADE)
_HANDLER = r"CASE WHEN k % 2 = 0 AND controller[1] = 'S' THEN 'App\Web\' WHEN namespace IS NOT NULL THEN namespace || '\' WHEN contains(controller, '\') THEN '' ELSE 'App\Http\Controllers\' END || controller"


def _routes(spark, d):
    s, c, w, _ = ways(spark, d)
    return routing.routes(s, c, w, imports(s))


@add("S01_routes", _WAYS + rf"""SELECT project, file, method, path, array_to_string(middleware, ',') AS middleware, controller, action, {_HANDLER} AS handler, replace(replace({_HANDLER}, 'App\', 'app/'), '\', '/') || '.php' AS handler_file FROM ({_ROUTES})""".replace(r"replace(replace(", r"CASE WHEN starts_with(" + _HANDLER + r", 'App\') THEN replace(replace(").replace("|| '.php' AS handler_file", "|| '.php' END AS handler_file"))
def all_routes(spark, d):
    return _routes(spark, d).select("project", "file", "method", "path", F.array_join("middleware", ",").alias("middleware"), "controller", "action", "handler", "handler_file")


@add("S01_gates", _WAYS + rf""", g AS (SELECT project, n, file, method, path, unnest(middleware) AS raw, generate_subscripts(middleware, 1) - 1 AS nth FROM ({_ROUTES}))
SELECT project, file, method, path, nth, raw, CASE WHEN raw = 'role:admin' THEN CASE WHEN n % 2 = 0 THEN 'HasRole' ELSE 'EnsureRole' END WHEN contains(raw, '\') THEN 'Authenticate' ELSE raw END AS symbol,
CASE WHEN raw = 'role:admin' THEN 'ir:authz_check' WHEN contains(raw, '\') OR raw = 'auth:api' OR raw = 'Perm' THEN 'ir:auth_gate' WHEN starts_with(raw, 'throttle:') THEN 'rate_limiter' WHEN raw = 'signed' THEN 'signature_check' ELSE 'ir:unknown_middleware' END AS type FROM g""")
def gates(spark, d):
    s = read(spark, d)[0]
    return routing.gates(_routes(spark, d), routing.aliases(s)).drop("at", "trail")
