"""Detectors: semantic facts, structural patterns and ranking.

A graph is small, so a detector is an expression over the nested row of one graph (``sources.corpus.nested``): all of them run in one
pass, and nodes and edges are shuffled once by graph, however many detectors there are.  Every finding has the same columns.
"""
from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import CONFIDENCE, MUTATIONS, SEVERITY, level
from ..sources.corpus import Corpus, nested

# fixed values: node types that count as authorization, or never do, parts of symbols that do, and layers
AUTHORIZATION = ("ir:auth_gate", "ir:authz_check", "ir:service_call", "ir:permission_constant", "middleware", "authentication_gate", "authorization_check", "policy", "service_call", "permission")
NEVER = ("ir:business_handler", "ir:entrypoint", "ir:validation_gate", "ir:resource", "controller_action", "controller", "form_request", "entrypoint")
MARKS = ("permission", "authorize", "gate", "policy")
LAYERS = {
    "middleware": ("ir:auth_gate", "middleware", "authorization_check", "authentication_gate"),
    "policy": ("ir:authz_check", "policy"),
    "service": ("ir:service_call", "service_call"),
    "constant": ("ir:permission_constant", "permission"),
}
FAT = 5
# fixed values: finding types that a focus puts first
FOCUS_TYPES = {
    "auth": ("duplicate_authorization", "missing_authorization", "missing_policy", "privilege_hierarchy_present", "double_permission_check", "resource_mismatch", "resource_unprotected", "exposed_read_endpoint", "over_authorized_route", "dead_middleware"),
    "validation": ("delegated_validation",),
    "runtime": ("hidden_runtime_dependency", "runtime_consumer_trace"),
    "transaction": ("event_before_commit",),
    "isolation": ("missing_tenant_scope", "circular_dependency"),
}


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def ability(permission: str) -> str:
    """SQL for the short word of a permission: what follows the class, the last dotted part, or the second word of an upper-case constant."""
    last = f"trim(element_at(split(trim({permission}), '::'), -1))"
    return f"""CASE WHEN contains({last}, '.') THEN lower(element_at(split({last}, '[.]'), -1))
      WHEN {last} RLIKE '^[A-Z][A-Z0-9_]+$' THEN lower(coalesce(get(split({last}, '_'), 1), {last})) ELSE lower({last}) END"""


def _node(place: str) -> str:
    return f"get(n, cast({place} - 1 as int))"


def facts(graphs: DataFrame) -> DataFrame:
    """``nested`` graphs with the facts that detectors share.

    ``h`` is the first handler.  ``auth``: authorization checks (id, symbol, permission, ability, layer, confidence).  ``gates``: validation
    gates (id, symbol, delegates, confidence).  ``inject``: runtime injections (ord, id, symbol, key, confidence).
    """
    layer = "CASE " + " ".join(f"WHEN lower(x.type) IN {_in(types)} THEN '{name}'" for name, types in LAYERS.items()) + " ELSE 'unknown' END"
    marked = " OR ".join(f"contains(lower(x.symbol), '{m}')" for m in MARKS)
    mechanism = "get(filter(e, y -> y.src = x.ord OR y.dst = x.ord), 0).mech"
    permission = f"""coalesce(get(x.args, 0), nullif(regexp_extract({mechanism}, '[\\'"]([^\\'"]+)[\\'"]', 1), ''))"""
    g = graphs.withColumn("h", F.expr("get(filter(n, x -> x.ir = 'ir:business_handler'), 0)"))
    g = g.withColumn("found", F.expr(f"""transform(filter(n, x -> lower(x.type) NOT IN {_in(NEVER)} AND (lower(x.type) IN {_in(AUTHORIZATION)} OR {marked})),
      x -> named_struct('id', x.id, 'symbol', x.symbol, 'role', x.role, 'layer', {layer}, 'permission', {permission}))"""))
    g = g.withColumn("auth", F.expr(f"""transform(found, f -> named_struct('id', f.id, 'symbol', f.symbol, 'permission', f.permission, 'ability', CASE WHEN f.permission <> '' THEN {ability('f.permission')} END, 'layer', f.layer,
      'confidence', CASE WHEN f.permission IS NOT NULL THEN 'HIGH' WHEN coalesce(f.role, '') <> '' THEN 'MEDIUM' ELSE 'LOW' END))""")).drop("found")
    real = "exists(n, x -> lower(x.type) IN ('ir:auth_gate', 'ir:authz_check', 'policy', 'authorization_check', 'authentication_gate') OR (lower(x.type) = 'middleware' AND size(x.args) > 0))"
    hands_on = "(coalesce(x.role, '') = 'validation_only' OR NOT exists(e, y -> y.src = x.ord AND y.rel IN ('policy_check', 'auth_chain', 'authorization_check')))"
    g = g.withColumn("gates", F.expr(f"""transform(filter(n, x -> lower(x.type) IN ('ir:validation_gate', 'form_request')), x -> named_struct('id', x.id, 'symbol', x.symbol,
      'delegates', {hands_on}, 'confidence', CASE WHEN {hands_on} AND {real} THEN 'HIGH' ELSE 'MEDIUM' END))"""))
    how = "coalesce(get(filter(e, y -> y.dst = x.ord AND y.rel IN ('runtime_inject', 'side_effect')), 0).mech, x.symbol)"
    bound = r"""regexp_extract(x.mech, '(?i)instance\\s*\\(\\s*[\'"]([^\'"]+)[\'"]', 1)"""
    g = g.withColumn("mechs", F.expr(f"transform(filter(n, x -> lower(x.type) IN ('runtime_injection', 'ir:runtime_inject', 'ir:runtime_consume')), x -> named_struct('ord', x.ord, 'id', x.id, 'symbol', x.symbol, 'mech', {how}))"))
    return g.withColumn("inject", F.expr(f"transform(mechs, x -> named_struct('ord', x.ord, 'id', x.id, 'symbol', x.symbol, 'key', coalesce(nullif({bound}, ''), x.mech), 'confidence', CASE WHEN {bound} <> '' AND {bound} <> x.mech THEN 'HIGH' ELSE 'MEDIUM' END))")).drop("mechs")


def _finding(kind: str, severity: str, confidence: str, parts: str, nodes: str, advice: int | str) -> str:
    quote = lambda v: f"'{v}'" if v.isupper() else v
    return f"""named_struct('type', '{kind}', 'severity', {quote(severity)}, 'confidence', {quote(confidence)},
      'id', concat('{kind}-', substr(sha2(array_join(array_sort({parts}), '|'), 256), 1, 8)), 'nodes', {nodes}, 'n_advice', {advice})"""


def _ids(nodes: str) -> str:
    return f"transform({nodes}, x -> x.id)"


_MUTATION = f"upper(coalesce(method, '')) IN {_in(MUTATIONS)}"
_READ = "upper(coalesce(method, '')) IN ('GET', 'HEAD')"
_HAS = lambda kind: f"exists(n, x -> x.ir = '{kind}')"
_OF = lambda kind: f"filter(n, x -> x.ir = '{kind}')"
_CLASSES = "size(array_distinct(filter(transform(filter(n, x -> x.ir = 'ir:service_call'), x -> split(x.symbol, '::')[0]), c -> c <> '')))"
_TENANT = "exists(n, x -> x.ir = 'ir:tenant_context' OR (x.ir = 'ir:runtime_inject' AND contains(lower(x.symbol), 'tenant')))"
_RESOURCES = lambda rel: f"filter(n, x -> x.ir = 'ir:resource' AND exists(e, y -> y.rel = '{rel}' AND y.dst = x.ord))"
_IF = lambda condition, found: f"CASE WHEN {condition} THEN {found} ELSE array() END"
_SENSITIVE = "from_json(x.detail, 'sensitiveFields array<string>').sensitiveFields"
_QUEUED = "from_json(x.detail, 'queued boolean').queued"
_CONSUMED = r"""regexp_extract(y.mech, '(?i)app\\s*\\(\\s*[\'"]([^\'"]+)[\'"]\\s*\\)', 1)"""
_CONSUMERS = f"transform(filter(e, y -> y.rel IN ('runtime_consume', 'runtime_inject', 'next_middleware') AND {_CONSUMED} <> '' AND {_CONSUMED} = f.key), y -> {_node('y.dst')}.id)"
_REACHED = "aggregate(n, transform(filter(n, x -> x.type = 'controller_action'), x -> x.ord), (s, i) -> array_union(s, transform(filter(e, y -> y.rel = 'calls' AND array_contains(s, y.src)), y -> y.dst)))"

#: finding type -> array of findings of one graph, in SQL over the columns of ``facts``
DETECTORS: dict[str, str] = {
    "missing_policy": f"transform(filter(a, x -> x.type = 'missing_policy'), x -> {_finding('missing_policy', 'HIGH', 'HIGH', 'concat(array(entrypoint), x.nodes)', 'x.nodes', 3)})",
    "missing_authorization": _IF(
        f"h IS NOT NULL AND {_MUTATION} AND exists(auth, f -> f.layer = 'middleware') AND NOT exists(auth, f -> f.layer IN ('policy', 'service')) AND NOT {_HAS('ir:authz_check')}",
        f"array({_finding('missing_authorization', 'HIGH', 'HIGH', 'array(h.id, upper(method))', 'array(get(filter(auth, f -> f.layer = ' + chr(39) + 'middleware' + chr(39) + '), 0).id, h.id)', 2)})"),
    "resource_unprotected": f"transform(filter(accessed, x -> NOT array_contains(transform(authorized, z -> z.symbol), x.symbol)), x -> {_finding('resource_unprotected', 'CRITICAL', 'HIGH', 'array(x.id, entrypoint)', 'array_compact(array(x.id, h.id))', 3)})",
    "resource_mismatch": "flatten(transform(filter(authorized, z -> NOT array_contains(transform(accessed, x -> x.symbol), z.symbol)), z -> transform(accessed, x -> " + _finding("resource_mismatch", "CRITICAL", "HIGH", "array(z.id, x.id)", "array_compact(array(z.id, x.id, get(filter(n, w -> exists(e, y -> y.rel = 'ir:authorizes' AND y.src = w.ord AND y.dst = z.ord)), 0).id))", 2) + ")))",
    "fat_controller": _IF(f"h IS NOT NULL AND {_CLASSES} >= {FAT}", f"array({_finding('fat_controller', 'LOW', 'HIGH', 'array(h.id)', 'concat(array(h.id), ' + _ids(_OF('ir:service_call')) + ')', 3)})"),
    "exposed_read_endpoint": _IF(
        f"{_READ} AND h IS NOT NULL AND NOT {_HAS('ir:auth_gate')} AND NOT {_HAS('ir:authz_check')} AND ({_HAS('ir:service_call')} OR {_HAS('ir:resource')})",
        f"array({_finding('exposed_read_endpoint', 'MEDIUM', 'MEDIUM', 'array(h.id, upper(method))', 'concat(array(h.id), ' + _ids(_OF('ir:service_call')) + ', ' + _ids(_OF('ir:resource')) + ')', 3)})"),
    "over_authorized_route": _IF(
        f"h IS NOT NULL AND {_HAS('ir:auth_gate')} AND {_HAS('ir:authz_check')} AND {_HAS('ir:validation_gate')}",
        f"array({_finding('over_authorized_route', 'INFO', 'HIGH', 'array(h.id)', 'concat(array(h.id), ' + ', '.join(_ids(_OF(k)) for k in ('ir:auth_gate', 'ir:authz_check', 'ir:validation_gate')) + ')', 3)})"),
    "dead_middleware": f"transform(filter(n, x -> x.ir = 'ir:auth_gate' AND NOT exists(e, y -> y.src = x.ord)), x -> {_finding('dead_middleware', 'MEDIUM', 'MEDIUM', 'array(x.id)', 'array(x.id)', 3)})",
    "sensitive_field_exposed": _IF("h IS NOT NULL", f"transform(filter(n, x -> x.ir = 'ir:api_resource' AND size({_SENSITIVE}) > 0), x -> {_finding('sensitive_field_exposed', 'HIGH', 'HIGH', 'array(x.id)', 'array(h.id, x.id)', 3)})"),
    "synchronous_mail": _IF("h IS NOT NULL", f"transform(filter(n, x -> x.ir = 'ir:mail' AND {_QUEUED} = false), x -> {_finding('synchronous_mail', 'MEDIUM', 'HIGH', 'array(x.id)', 'array(h.id, x.id)', 4)})"),
    "api_resource_unprotected": _IF(
        f"h IS NOT NULL AND NOT {_HAS('ir:auth_gate')} AND NOT {_HAS('ir:authz_check')} AND NOT ({_CLASSES} > 0 AND {_READ})",
        f"transform({_OF('ir:api_resource')}, x -> {_finding('api_resource_unprotected', 'HIGH', 'HIGH', 'array(h.id, x.id)', 'array(h.id, x.id)', 3)})"),
    "duplicate_authorization": _IF(_HAS("ir:auth_gate"), "transform(filter(transform(array_distinct(transform(sure, f -> f.ability)), b -> filter(sure, f -> f.ability = b)), g -> size(array_distinct(transform(g, f -> f.layer))) >= 2), g -> " + _finding("duplicate_authorization", "LOW", "CASE WHEN forall(g, f -> f.confidence = 'HIGH') THEN 'HIGH' ELSE 'MEDIUM' END", "concat(transform(g, f -> f.id), array(g[0].ability))", "transform(g, f -> f.id)", 1) + ")"),
    "delegated_validation": "transform(filter(gates, x -> x.delegates), x -> " + _finding("delegated_validation", "CASE WHEN size(auth) > 0 THEN 'INFO' ELSE 'MEDIUM' END", "x.confidence", "concat(array(x.id), transform(auth, f -> f.id))", "concat(array(x.id), transform(auth, f -> f.id))", "CASE WHEN size(auth) > 0 THEN 0 ELSE 1 END") + ")",
    "hidden_runtime_dependency": "transform(inject, f -> " + _finding("hidden_runtime_dependency", "HIGH", "f.confidence", f"concat(array(f.id, f.key), {_CONSUMERS})", f"concat(array(f.id), {_CONSUMERS})", 2) + ")",
    "privilege_hierarchy_present": "transform(filter(policies, p -> size(p.perms) >= 2), p -> " + _finding("privilege_hierarchy_present", "MEDIUM", "MEDIUM", "concat(array(p.id), p.perms)", "concat(array(p.id), p.perms)", 2) + ")",
    "event_before_commit": "transform(filter(e, y -> y.rel = 'escapes_transaction' AND " + _node("y.src") + ".ir = 'ir:txn_escape' AND " + _node("y.dst") + ".ir = 'ir:txn_boundary'), y -> " + _finding("event_before_commit", "HIGH", "HIGH", f"array({_node('y.dst')}.id, {_node('y.src')}.id)", f"array({_node('y.dst')}.id, {_node('y.src')}.id)", 3) + ")",
    "missing_tenant_scope": _IF(f"{_TENANT} AND ({_HAS('ir:unscoped_query')} OR {_HAS('ir:unscoped_write')})", "transform(filter(e, y -> y.rel = 'missing_tenant_scope' AND " + _node("y.src") + ".ir = 'ir:unscoped_query' AND " + _node("y.dst") + ".ir = 'ir:runtime_inject'), y -> " + _finding("missing_tenant_scope", "CRITICAL", "HIGH", f"array({_node('y.src')}.id, {_node('y.dst')}.id)", f"array({_node('y.src')}.id, {_node('y.dst')}.id)", 3) + ")"),
    "double_permission_check": "flatten(transform(filter(n, x -> x.ir = 'ir:authz_check' AND size(x.args) > 0), x -> transform(rechecks, p -> " + _finding("double_permission_check", "LOW", "HIGH", "array(x.id, p.policy, p.service)", "array(x.id, p.policy, p.service)", 2) + ")))",
    "runtime_consumer_trace": _IF("size(consumers) > 0", "transform(inject, f -> " + _finding("runtime_consumer_trace", "MEDIUM", "MEDIUM", "concat(array(f.id), consumers)", "concat(array(f.id), consumers)", 2) + ")"),
}

#: what some detectors read, computed once a graph
_HELPERS = {
    "accessed": _RESOURCES("ir:accesses"),
    "authorized": _RESOURCES("ir:authorizes"),
    "sure": "filter(auth, f -> f.ability <> '' AND f.confidence <> 'LOW')",
    "policies": f"""transform(filter(n, x -> x.ir = 'ir:authz_check' AND exists(e, y -> y.rel = 'privilege_hierarchy')), x -> named_struct('id', x.id, 'perms', transform(filter(
      concat(filter(e, y -> y.src = x.ord AND y.rel = 'checks_permission'), filter(e, y -> y.src = x.ord AND y.rel = 'uses_permission')),
      y -> exists(e, z -> z.rel = 'privilege_hierarchy' AND (z.src = y.dst OR z.dst = y.dst))), y -> {_node('y.dst')}.id)))""",
    "rechecks": """flatten(transform(filter(n, x -> x.ir = 'ir:authz_check'), x -> transform(filter(n, s -> s.type = 'service_call' AND (contains(lower(s.symbol), 'permissionservice') OR contains(lower(s.symbol), 'haspermission'))
      AND exists(e, y -> y.src = x.ord AND y.dst = s.ord)), s -> named_struct('policy', x.id, 'service', s.id))))""",
    "consumers": f"concat(transform(filter(n, x -> x.type = 'controller_action'), x -> x.id), transform(filter(n, x -> x.type = 'service_call' AND array_contains({_REACHED}, x.ord)), x -> x.id))",
}


def _cycles(names: list[str], calls: list[tuple[str, str]]) -> list[list[str]]:
    """Cycles that a depth-first walk over classes closes, classes and calls in the order given, one of each set of classes."""
    after: dict[str, dict[str, None]] = {c: {} for c in names}
    for a, b in calls:
        if a != b and a in after:
            after[a][b] = None
    out: list[list[str]] = []
    told: set[frozenset] = set()
    done: set[str] = set()
    for start in after:
        if start in done:
            continue
        path, todo = [start], [iter(after[start])]
        done.add(start)
        while todo:
            c = next(todo[-1], None)
            if c is None:
                todo.pop()
                path.pop()
            elif c not in done:
                done.add(c)
                path.append(c)
                todo.append(iter(after.get(c, ())))
            elif c in path and (key := frozenset(cycle := path[path.index(c):])) not in told:
                told.add(key)
                out.append(cycle)
    return out


def circular(graphs: DataFrame) -> DataFrame:
    """Cycles among service classes over ``ir:calls``: (graph_id, entrypoint, cycles array<array<string>>, services).  Only graphs with two such calls or more reach Python, in Arrow batches."""
    g = graphs.withColumn("services", F.expr("transform(filter(n, x -> x.ir = 'ir:service_call'), x -> named_struct('id', x.id, 'cls', split(x.symbol, '::')[0]))"))
    both = f"{_node('y.src')}.type = 'ir:service_call' AND {_node('y.dst')}.type = 'ir:service_call'"
    g = g.withColumn("calls", F.expr(f"transform(filter(e, y -> y.rel = 'ir:calls' AND {both}), y -> named_struct('a', split({_node('y.src')}.symbol, '::')[0], 'b', split({_node('y.dst')}.symbol, '::')[0]))"))

    @F.pandas_udf("array<array<string>>")
    def cycles(services: pd.Series, calls: pd.Series) -> pd.Series:
        return pd.Series([_cycles(list(dict.fromkeys(x["cls"] for x in s)), [(x["a"], x["b"]) for x in c]) for s, c in zip(services, calls)], dtype=object)

    return g.where("size(calls) > 1").select("graph_id", "entrypoint", cycles("services", "calls").alias("cycles"), "services")


def detect(corpus: Corpus, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """graph_id, entrypoint, type, severity, confidence, id, nodes, n_advice: findings of all detectors, or of ``kinds``."""
    graphs = nested(corpus)
    if "a" not in graphs.columns:
        graphs = graphs.withColumn("a", F.expr("cast(array() as array<struct<type: string, nodes: array<string>>>)"))
    wanted = [k for k in DETECTORS if kinds is None or k in kinds]
    columns = ("type", "severity", "confidence", "id", "nodes", "n_advice")
    shape = "array<struct<type: string, severity: string, confidence: string, id: string, nodes: array<string>, n_advice: int>>"
    out = None
    if wanted:
        g = facts(graphs).withColumns({k: F.expr(v) for k, v in _HELPERS.items()})
        every = F.flatten(F.array(*(F.expr(f"cast({DETECTORS[k]} as {shape})") for k in wanted)))
        out = g.select("graph_id", "entrypoint", F.explode(every).alias("f")).select("graph_id", "entrypoint", *(f"f.{c}" for c in columns))
    if kinds is None or "circular_dependency" in kinds:
        c = circular(graphs).select("graph_id", "entrypoint", "services", F.explode("cycles").alias("cycle"))
        own = F.expr("flatten(transform(cycle, c -> transform(filter(services, x -> x.cls = c), x -> x.id)))")
        c = c.select("graph_id", "entrypoint", F.lit("circular_dependency").alias("type"), F.lit("HIGH").alias("severity"), F.lit("MEDIUM").alias("confidence"), finding_id("circular_dependency", F.col("cycle")).alias("id"), own.alias("nodes"), F.lit(3).alias("n_advice"))
        out = c if out is None else out.union(c)
    return out


def finding_id(kind: str, parts: Column) -> Column:
    """The kind and the first 8 hex digits of a hash of its sorted parts."""
    return F.concat(F.lit(kind + "-"), F.substring(F.sha2(F.array_join(F.array_sort(parts), "|"), 256), 1, 8))


def rank(findings: DataFrame) -> DataFrame:
    """By severity, confidence, number of nodes, number of recommendations, then id as people sort it; a rank within its graph, so no total sort is needed."""
    order = Window.partitionBy("graph_id").orderBy(level(SEVERITY, F.col("severity")).desc(), level(CONFIDENCE, F.col("confidence")).desc(), F.size("nodes").desc(), F.desc("n_advice"), F.collate("id", "UNICODE"))
    return findings.withColumn("rank", F.row_number().over(order).cast("bigint"))


def prioritise(ranked: DataFrame, focus: str) -> DataFrame:
    """Ranked findings with those of a focus first; ``all`` leaves them."""
    first = F.col("type").isin(*FOCUS_TYPES[focus]) if focus in FOCUS_TYPES else F.lit(True)
    return ranked.withColumn("rank", F.row_number().over(Window.partitionBy("graph_id").orderBy(first.desc(), "rank")).cast("bigint"))


def explain(corpus: Corpus, focus: str = "all") -> DataFrame:
    """Facts, detectors, ranking, focus."""
    return prioritise(rank(detect(corpus)), focus)


def contradictions(findings: DataFrame) -> DataFrame:
    """Pairs of ranked findings of one graph, of different types, that share nodes: (graph_id, a, b, shared)."""
    a = findings.select("graph_id", F.col("id").alias("a"), F.col("type").alias("ta"), F.col("nodes").alias("na"), F.col("rank").alias("ra"))
    b = findings.select("graph_id", F.col("id").alias("b"), F.col("type").alias("tb"), F.col("nodes").alias("nb"), F.col("rank").alias("rb"))
    x = a.join(b, "graph_id").where("ra < rb AND ta <> tb AND arrays_overlap(na, nb)")
    return x.select("graph_id", "a", "b", F.array_intersect("na", "nb").alias("shared"))
