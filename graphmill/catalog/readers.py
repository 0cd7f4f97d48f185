"""The reader of routes as a data source, with predicates taken at the scan."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import memo, projects, routes_format
from ..sources.corpus import once, scratch, stored
from ..sources.decorated import decorated
from .base import add

_S = "WITH s AS (SELECT s_suppkey AS k, 'nation-' || s_nationkey AS project FROM supplier), r AS ("
_ALL = _S + r"""SELECT k, 'laravel' AS framework, project, 'routes/s' || k || '.php' AS file, 0 AS nth, 'GET' AS method, '/s' || k AS path, 'S' || k || 'Controller::index' AS handler, 'ir:auth_gate auth api' AS gates FROM s
  UNION ALL SELECT k, 'laravel', project, 'routes/s' || k || '.php', 1, 'PUT', '/x/y/{id}', 'S' || k || 'Controller::save', '' FROM s WHERE k % 2 = 0
  UNION ALL SELECT k, 'nestjs', project, 'src/s' || k || '.controller.ts', 0, 'GET', '/s' || k, 'S' || k || 'Controller::list', CASE WHEN k % 2 = 0 THEN 'ir:auth_gate JwtAuthGuard ' ELSE '' END FROM s
  UNION ALL SELECT k, 'nestjs', project, 'src/s' || k || '.controller.ts', 1, 'POST', '/s' || k || '/:id', 'S' || k || 'Controller::save',
    array_to_string(list_concat(CASE WHEN k % 2 = 0 AND k % 4 > 0 THEN ['ir:auth_gate JwtAuthGuard '] ELSE [] END, CASE WHEN k % 3 = 0 THEN ['ir:authz_check RolesGuard '] ELSE [] END), ';') FROM s
  UNION ALL SELECT k, 'springboot', project, 'java/S' || k || 'Controller.java', 0, 'GET', '/s' || k || '/{id}', 'S' || k || 'Controller::one', CASE WHEN k % 2 = 0 THEN 'ir:auth_gate PreAuthorize isAuthenticated()' ELSE '' END FROM s
  UNION ALL SELECT k, 'springboot', project, 'java/S' || k || 'Controller.java', 1, 'DELETE', '/s' || k, 'S' || k || 'Controller::drop',
    array_to_string(list_concat(CASE WHEN k % 2 = 0 THEN ['ir:auth_gate PreAuthorize isAuthenticated()'] ELSE [] END, CASE WHEN k % 3 = 0 THEN ['ir:auth_gate isAuthenticated() ', 'ir:authz_check PreAuthorize hasRole(''ADMIN'')'] ELSE [] END), ';') FROM s)
SELECT * EXCLUDE (k) FROM r"""


def read(spark, d) -> DataFrame:
    """The derived files' routes, by the data source; the files are written once a session."""
    routes_format.register(spark)
    path = stored(once(spark, "web", d, ("supplier",)), projects.web_files(spark, d), "files")
    gates = F.array_join(F.transform("gates", lambda g: F.concat_ws(" ", g["type"], g["symbol"], F.array_join(g["args"], ","))), ";")
    return spark.read.format("routes").load(path).withColumn("gates", gates)


add("E03_routes", _ALL)(read)
add("S20_nestjs_routes", _ALL + " WHERE framework = 'nestjs'")(lambda spark, d: read(spark, d).where("framework = 'nestjs'"))
add("S24_spring_routes", _ALL + " WHERE framework = 'springboot'")(lambda spark, d: read(spark, d).where("framework = 'springboot'"))
add("E03_pushed", _ALL + " WHERE framework IN ('laravel', 'springboot') AND starts_with(file, 'routes/') AND method = 'PUT' AND path <> '/none'")(lambda spark, d: read(spark, d).where("framework in ('laravel', 'springboot') and startswith(file, 'routes/') and method = 'PUT' and path <> '/none'"))


@add("V03_remembered", """WITH s AS (SELECT s_suppkey AS k, 'nation-' || s_nationkey AS project, s_suppkey % 2 = 0 AS early FROM supplier),
f AS (SELECT k, project, early, unnest(list_concat(['name', 'age'], CASE WHEN k % 2 = 0 THEN ['count'] ELSE [] END, CASE WHEN k % 3 = 0 THEN ['kind'] ELSE [] END, CASE WHEN k % 5 = 0 THEN ['items'] ELSE [] END)) AS name FROM s)
SELECT project, 'src/r' || k || '.dto.ts' AS path, name, early FROM f UNION ALL SELECT project, 'moved/r' || k || '.dto.ts', name, early FROM f""")
def remembered(spark, d):
    """Files of even suppliers are read first; then all of them, and copies of all under other paths, of which only the others' contents are read."""
    files, folder = projects.dto_files(spark, d), scratch(spark, "memo")
    memo.remembered(files.where("regexp_extract(path, '[0-9]+', 0) % 2 = 0"), decorated, folder)
    every = files.unionByName(files.withColumn("path", F.replace("path", F.lit("src/"), F.lit("moved/"))))
    return memo.remembered(every, decorated, folder).select("project", "path", "name", F.startswith("_run", F.lit("00000000-")).alias("early"))
