"""Events and listeners, rules of form requests, fields of resources, from source text derived from suppliers."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import inventory, shapes
from ..sources import projects
from ..sources.corpus import once
from ..sources.decorated import decorated
from ..sources.syntax import syntax
from .base import add, table

_S = "SELECT s_suppkey AS k, 'nation-' || s_nationkey AS project FROM supplier"
#: an imported listener has a file; one that is named in full too; one that is neither has none
_LISTEN = rf"""WITH s AS ({_S}), l AS (SELECT project, 'E' || k AS event, 0 AS ord, CASE WHEN k % 4 = 2 THEN 'L' || k ELSE 'App\Listeners\L' || k END AS listener, CASE WHEN k % 4 <> 2 THEN 'app/Listeners/L' || k || '.php' END AS file, k % 4 <> 2 AND (k % 2 = 0 OR k % 3 = 0) AS after_commit FROM s
UNION ALL SELECT project, 'E' || k, 1, 'App\Listeners\Gone', 'app/Listeners/Gone.php', false FROM s WHERE k % 2 = 0)"""


def read(spark, d):
    keep = once(spark, "shapes", d, ("supplier",))
    return keep(syntax(projects.shape_files(spark, d)), "syntax")


@add("S12_listeners", _LISTEN + " SELECT * FROM l")
def listening(spark, d):
    return shapes.listeners(read(spark, d))


@add("J11_listened_escapes", _LISTEN + """, e AS (SELECT s_suppkey AS graph_id, 'nation-' || s_nationkey AS project, unnest(['E' || s_suppkey, 'Nobody']) AS event FROM supplier), m AS (SELECT project, event, bool_and(after_commit) AS safe FROM l GROUP BY 1, 2)
SELECT graph_id, e.project, e.event, listener, file, after_commit, safe FROM e LEFT JOIN l ON l.project = e.project AND l.event = e.event LEFT JOIN m ON m.project = e.project AND m.event = e.event""")
def listened(spark, d):
    events = F.explode(F.array(F.concat(F.lit("E"), F.col("s_suppkey").cast("string")), F.lit("Nobody"))).alias("event")
    escapes = table(spark, d, "supplier").select(F.col("s_suppkey").alias("graph_id"), F.concat(F.lit("nation-"), F.col("s_nationkey").cast("string")).alias("project"), events)
    return shapes.listened(escapes, shapes.listeners(read(spark, d)))


_FIELDS = [  # condition, form, place, name, type, rules
    ("true", 0, 1, "'name'", "string", "'required,minLength:2,maxLength:' || k"), ("k % 2 = 0", 1, 2, "'tags.*.id'", "number", "'integer,optional,min:1,max:' || k"), ("true", 0, 3, "'age'", "number", "'min:1.5,isIn:a,b'"), ("k % 3 = 0", 1, 4, "'mail'", "string", "'optional,email,regex:/^a|b$/'"),
    ("true", 0, 6, "'on'", "boolean", "'boolean'"), ("true", 1, 7, "'list'", "array", "'array,maxLength:5'"), ("true", 1, 9, "'none'", "string", "''"),
]
_RULES = " UNION ALL ".join(f"SELECT k, project, {form} AS form, {place} AS place, {name} AS name, '{t}' AS type, {rules} AS rules FROM s WHERE {c}" for c, form, place, name, t, rules in _FIELDS)


@add("S05_rules", f"""WITH s AS ({_S}), f AS ({_RULES}) SELECT project, 'app/Http/Requests/R' || k || 'Request.php' AS path, 'R' || k || 'Request' AS class, row_number() OVER (PARTITION BY k ORDER BY form, place) - 1 AS ord, name, type, rules FROM f""")
def rules(spark, d):
    text = F.transform("rules", lambda r: F.concat_ws(":", r["kind"], r["value"]))
    return shapes.field_rules(read(spark, d)).select("project", "path", "class", "ord", "name", "type", F.array_join(text, ",").alias("rules"))


@add("S11_resource_fields", f"""WITH s AS ({_S}) SELECT project, 'app/Http/Resources/R' || k || 'Resource.php' AS path, unnest(range(len(names))) AS ord, unnest(names) AS name, unnest(list_transform(names, lambda n: n IN ('api_token', 'PASSWORD'))) AS sensitive
FROM (SELECT *, CASE WHEN k % 2 = 0 THEN ['id', 'api_token', 'owner', 'items'] ELSE ['id', 'PASSWORD', 'last'] END AS names FROM s)""")
def fields(spark, d):
    return shapes.resource_fields(read(spark, d))


@add("S11_resource_details", f"""WITH s AS ({_S}) SELECT project, 'app/Http/Resources/R' || k || 'Resource.php' AS path, x.kind, x.name
FROM (SELECT *, unnest(CASE WHEN k % 2 = 0 THEN [{{'kind': 'conditional', 'name': 'secret'}}, {{'kind': 'nested', 'name': 'OwnerResource'}}, {{'kind': 'collection', 'name': 'ItemResource'}}] ELSE [{{'kind': 'conditional', 'name': 'owner'}}, {{'kind': 'nested', 'name': 'OwnerResource'}}] END) AS x FROM s)""")
def details(spark, d):
    return shapes.resource_details(read(spark, d))


@add("S18_jobs", f"""WITH s AS ({_S}) SELECT project, 'app/Jobs/J' || k || '.php' AS path, 'queue:J' || k AS entrypoint, 'QUEUE' AS method, CASE WHEN k % 3 = 0 THEN 'q' || k ELSE 'default' END AS queue, 'J' || k || '::handle' AS symbol FROM s WHERE k % 5 > 0""")
def jobs(spark, d):
    return shapes.queued_jobs(read(spark, d))


_PLAN = [("true", "'mail:send ' || k", "0,30 * * * *"), ("k % 2 = 0", "'J' || k", "5 * * * 1"), ("k % 3 = 0", "'J' || k", "0 0 1 1,4,7,10 *"), ("true", "'fn () => 1'", "0 * * * *"), ("true", "'ls'", "unknown")]


@add("S19_schedules", f"WITH s AS ({_S}) " + " UNION ALL ".join(f"SELECT project, 'app/Console/K' || k || 'Kernel.php' AS path, 'schedule:' || {name} AS entrypoint, 'SCHEDULE' AS method, '{cron}' AS cron, {name} AS symbol FROM s WHERE {c}" for c, name, cron in _PLAN))
def schedules(spark, d):
    return shapes.schedules(read(spark, d)).drop("line")


_CLASSES = f"""WITH s AS ({_S}), c AS (SELECT project, 'app/Jobs/J' || k || '.php' AS path, 'queue_job' AS category, 'J' || k AS class FROM s UNION ALL SELECT project, 'app/Listeners/L' || k || '.php', 'event_listener', 'L' || k FROM s UNION ALL SELECT project, 'app/Http/Resources/R' || k || 'Resource.php', 'api_resource', 'R' || k || 'Resource' FROM s)"""


@add("S37_inventory", _CLASSES + " SELECT project, path, category, class, class AS fqcn FROM c")
def inventory_(spark, d):
    return inventory.classes(projects.shape_files(spark, d))


_USES = _CLASSES + """, u AS (SELECT a.project, a.k, 'queue_job' AS category, 'J' || b.k AS name, a.k % 4 = 1 AS chained FROM s a JOIN s b ON b.project = a.project AND (a.k % 4 IN (0, 1) AND starts_with(a.k::VARCHAR, b.k::VARCHAR) OR a.k % 4 = 2 AND a.k = b.k)
UNION ALL SELECT project, k, 'api_resource', 'R' || k || 'Resource', false FROM s WHERE k % 4 IN (0, 1))
"""


@add("S37_usage", _USES + "SELECT project, 'app/Console/K' || k || 'Kernel.php' AS path, 'Kernel' || k AS caller, 'command' AS source, category, name, chained FROM u")
def usage(spark, d):
    return inventory.usage(projects.shape_files(spark, d))


@add("S37_gates", f"WITH s AS ({_S}) SELECT project, 'app/Console/K' || k || 'Kernel.php' AS path, 'Kernel' || k AS caller, 'command' AS source, x.method, x.ability FROM (SELECT *, unnest([{{'method': 'check', 'ability': 'see'}}, {{'method': 'denies', 'ability': 'edit'}}]) AS x FROM s WHERE k % 4 = 1)")
def gates(spark, d):
    return inventory.gate_calls(projects.shape_files(spark, d))


@add("S37_summary", _USES + """, n AS (SELECT project, category, count(*) AS n_classes FROM c GROUP BY 1, 2), m AS (SELECT project, category, count(DISTINCT name) AS n_used, count(*) AS n_uses FROM u GROUP BY 1, 2)
SELECT project, category, n_classes, coalesce(n_used, 0) AS n_used, coalesce(n_uses, 0) AS n_uses FROM n LEFT JOIN m USING (project, category)""")
def summary(spark, d):
    return inventory.summary(projects.shape_files(spark, d))


_DTO = """SELECT project, 'src/r' || k || '.dto.ts' AS path, 'R' || k || 'Dto' AS class, row_number() OVER (PARTITION BY k ORDER BY place) - 1 AS ord, name, type, rules, k FROM (
  SELECT k, project, 0 AS place, 'name' AS name, 'string' AS type, 'required,minLength:2,maxLength:' || k AS rules FROM s UNION ALL SELECT k, project, 1, 'count', 'number', 'optional,integer,max:' || k FROM s WHERE k % 2 = 0
  UNION ALL SELECT k, project, 2, 'age', 'array', 'required,isIn:a,b,regex:/^[a-z("]+$/i' FROM s UNION ALL SELECT k, project, 3, 'kind', 'unknown', 'required,minLength:1,maxLength:5,enum:Kind' FROM s WHERE k % 3 = 0 UNION ALL SELECT k, project, 4, 'items', 'array', 'required' FROM s WHERE k % 5 = 0)"""


def _dto(spark, d):
    return shapes.decorated_rules(decorated(projects.dto_files(spark, d)))


@add("S22_dto_rules", f"WITH s AS ({_S}) SELECT * EXCLUDE (k) FROM ({_DTO})")
def dto_rules(spark, d):
    text = F.transform("rules", lambda r: F.concat_ws(":", r["kind"], r["value"]))
    return _dto(spark, d).withColumn("rules", F.array_join(text, ","))


@add("S22_rules_apart", f"""WITH s AS ({_S}), a AS (SELECT project, 'R' || k AS subject, name, rules FROM ({_RULES})), b AS (SELECT project, 'R' || k AS subject, name, rules FROM ({_DTO})),
sides AS (SELECT coalesce(a.project, b.project) AS project, coalesce(a.subject, b.subject) AS subject, coalesce(a.name, b.name) AS name, coalesce(a.r, []) AS a, coalesce(b.r, []) AS b FROM
  (SELECT project, subject, name, list_distinct(flatten(list(list_filter(list_transform(string_split(replace(rules, 'isIn:a,b', 'isIn:a;b'), ','), lambda x: replace(x, ';', ',')), lambda x: x <> '')))) AS r FROM a GROUP BY ALL) a FULL JOIN
  (SELECT project, subject, name, list_distinct(flatten(list(list_transform(string_split(replace(rules, 'isIn:a,b', 'isIn:a;b'), ','), lambda x: replace(x, ';', ','))))) AS r FROM b GROUP BY ALL) b ON a.project = b.project AND a.subject = b.subject AND a.name = b.name)
SELECT project, subject, name, array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(b, x))), ';') AS only_a, array_to_string(list_sort(list_filter(b, lambda x: NOT list_contains(a, x))), ';') AS only_b FROM sides
WHERE len(list_filter(a, lambda x: NOT list_contains(b, x))) + len(list_filter(b, lambda x: NOT list_contains(a, x))) > 0""")
def apart(spark, d):
    x = shapes.rules_apart(shapes.field_rules(read(spark, d)), _dto(spark, d))
    return x.withColumns({n: F.array_join(n, ";") for n in ("only_a", "only_b")})
