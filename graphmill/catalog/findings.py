"""Findings, traces, contexts and evidence."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analysis, detect, render
from ..sources.corpus import PREFIX, derived
from .base import add, joined

_HASH = "substr(sha256(array_to_string(list_sort({}), '|')), 1, 8)"


def _row(kind: str, severity: str, confidence: str, parts: str, nodes: str, advice: str, source: str) -> str:
    return f"SELECT x.graph_id, x.entrypoint, '{kind}' AS type, {severity} AS severity, {confidence} AS confidence, '{kind}-' || {_HASH.format(parts)} AS id, {nodes} AS nodes, {advice} AS n_advice FROM {source}"


FACTS_SQL = PREFIX + r""",
h AS (SELECT graph_id, arg_min(id, node_ord) AS hid FROM nodes WHERE ir_type = 'ir:business_handler' GROUP BY 1),
first_edge AS (SELECT graph_id, node_ord, mechanism FROM (SELECT *, row_number() OVER (PARTITION BY graph_id, node_ord ORDER BY edge_ord) AS r FROM
  (SELECT graph_id, src AS node_ord, edge_ord, mechanism FROM edges UNION ALL SELECT graph_id, dst, edge_ord, mechanism FROM edges)) WHERE r = 1),
auth0 AS (SELECT n.graph_id, n.node_ord, id, symbol, role, CASE WHEN lower(type) IN ('ir:auth_gate', 'middleware', 'authorization_check', 'authentication_gate') THEN 'middleware' WHEN lower(type) IN ('ir:authz_check', 'policy') THEN 'policy'
  WHEN lower(type) IN ('ir:service_call', 'service_call') THEN 'service' WHEN lower(type) IN ('ir:permission_constant', 'permission') THEN 'constant' ELSE 'unknown' END AS layer,
  coalesce(arg0, nullif(regexp_extract(f.mechanism, '[''"]([^''"]+)[''"]', 1), '')) AS permission
  FROM nodes n LEFT JOIN first_edge f ON f.graph_id = n.graph_id AND f.node_ord = n.node_ord
  WHERE lower(type) NOT IN ('ir:business_handler', 'ir:entrypoint', 'ir:validation_gate', 'ir:resource', 'controller_action', 'controller', 'form_request', 'entrypoint')
  AND (lower(type) IN ('ir:auth_gate', 'ir:authz_check', 'ir:service_call', 'ir:permission_constant', 'middleware', 'authentication_gate', 'authorization_check', 'policy', 'service_call', 'permission')
    OR contains(lower(symbol), 'permission') OR contains(lower(symbol), 'authorize') OR contains(lower(symbol), 'gate') OR contains(lower(symbol), 'policy'))),
auth1 AS (SELECT *, trim(list_extract(string_split(trim(permission), '::'), -1)) AS word FROM auth0),
auth AS (SELECT graph_id, node_ord, id, symbol, layer, permission, CASE WHEN permission <> '' THEN CASE WHEN contains(word, '.') THEN lower(list_extract(string_split(word, '.'), -1))
  WHEN regexp_full_match(word, '[A-Z][A-Z0-9_]+') THEN lower(coalesce(list_extract(string_split(word, '_'), 2), word)) ELSE lower(word) END END AS ability,
  CASE WHEN permission IS NOT NULL THEN 'HIGH' WHEN coalesce(role, '') <> '' THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM auth1),
real AS (SELECT DISTINCT graph_id FROM nodes WHERE lower(type) IN ('ir:auth_gate', 'ir:authz_check', 'policy', 'authorization_check', 'authentication_gate') OR (lower(type) = 'middleware' AND arg0 IS NOT NULL)),
gates AS (SELECT n.graph_id, node_ord, id, symbol, coalesce(role, '') = 'validation_only' OR NOT EXISTS (SELECT 1 FROM edges e WHERE e.graph_id = n.graph_id AND e.src = n.node_ord AND relation IN ('policy_check', 'auth_chain', 'authorization_check')) AS delegates
  FROM nodes n WHERE lower(type) IN ('ir:validation_gate', 'form_request')),
bound AS (SELECT graph_id, dst, mechanism FROM (SELECT *, row_number() OVER (PARTITION BY graph_id, dst ORDER BY edge_ord) AS r FROM edges WHERE relation IN ('runtime_inject', 'side_effect')) WHERE r = 1),
inject0 AS (SELECT n.graph_id, node_ord, id, symbol, coalesce(b.mechanism, symbol) AS mech FROM nodes n LEFT JOIN bound b ON b.graph_id = n.graph_id AND b.dst = node_ord
  WHERE lower(type) IN ('runtime_injection', 'ir:runtime_inject', 'ir:runtime_consume')),
inject AS (SELECT graph_id, node_ord, id, symbol, coalesce(nullif(regexp_extract(mech, 'instance\s*\(\s*[''"]([^''"]+)[''"]', 1, 'i'), ''), mech) AS key,
  CASE WHEN regexp_extract(mech, 'instance\s*\(\s*[''"]([^''"]+)[''"]', 1, 'i') NOT IN ('', mech) THEN 'HIGH' ELSE 'MEDIUM' END AS confidence FROM inject0)
"""
_G = "(SELECT g.graph_id, g.entrypoint, upper(g.method) AS method, hid, {} FROM graphs g {} LEFT JOIN h ON h.graph_id = g.graph_id {})"
_HAVE = """have AS (SELECT graph_id, bool_or(ir_type = 'ir:auth_gate') AS gate, bool_or(ir_type = 'ir:authz_check') AS chk, bool_or(ir_type = 'ir:validation_gate') AS val, bool_or(ir_type = 'ir:service_call') AS svc, bool_or(ir_type = 'ir:resource') AS res,
  bool_or(ir_type = 'ir:tenant_context' OR (ir_type = 'ir:runtime_inject' AND contains(lower(symbol), 'tenant'))) AS tenant, bool_or(ir_type IN ('ir:unscoped_query', 'ir:unscoped_write')) AS unscoped,
  count(DISTINCT CASE WHEN ir_type = 'ir:service_call' THEN nullif(split_part(symbol, '::', 1), '') END) AS classes, coalesce(list(id ORDER BY node_ord) FILTER (ir_type = 'ir:service_call'), []) AS svcs,
  coalesce(list(id ORDER BY node_ord) FILTER (ir_type = 'ir:resource'), []) AS ress, coalesce(list(id ORDER BY node_ord) FILTER (ir_type IN ('ir:auth_gate', 'ir:authz_check', 'ir:validation_gate')), []) AS layers FROM nodes GROUP BY 1),
authl AS (SELECT graph_id, list(id ORDER BY node_ord) AS ids, arg_min(id, node_ord) FILTER (layer = 'middleware') AS gate, coalesce(bool_or(layer IN ('policy', 'service')), false) AS other FROM auth GROUP BY 1),
g AS (SELECT g.graph_id, g.entrypoint, upper(g.method) AS method, hid, coalesce(gate, false) AS gate, coalesce(chk, false) AS chk, coalesce(val, false) AS val, coalesce(svc, false) AS svc, coalesce(res, false) AS res, coalesce(tenant, false) AS tenant,
  coalesce(unscoped, false) AS unscoped, coalesce(classes, 0) AS classes, svcs, ress, layers FROM graphs g LEFT JOIN h ON h.graph_id = g.graph_id LEFT JOIN have v ON v.graph_id = g.graph_id),
resources AS (SELECT DISTINCT n.graph_id, n.node_ord, n.id, n.symbol, e.relation FROM nodes n JOIN edges e ON e.graph_id = n.graph_id AND e.dst = n.node_ord WHERE n.ir_type = 'ir:resource' AND e.relation IN ('ir:accesses', 'ir:authorizes')),
accessed AS (SELECT * FROM resources WHERE relation = 'ir:accesses'), authorized AS (SELECT * FROM resources WHERE relation = 'ir:authorizes'),
checker AS (SELECT e.graph_id, e.dst, arg_min(n.id, n.node_ord) AS id FROM edges e JOIN nodes n ON n.graph_id = e.graph_id AND n.node_ord = e.src WHERE relation = 'ir:authorizes' GROUP BY 1, 2),
groups AS (SELECT graph_id, ability, list(id ORDER BY node_ord) AS ids, bool_and(confidence = 'HIGH') AS sure FROM auth WHERE ability <> '' AND confidence <> 'LOW' GROUP BY 1, 2 HAVING count(DISTINCT layer) >= 2),
consumed AS (SELECT i.graph_id, i.id, coalesce(list('n' || e.dst ORDER BY e.edge_ord) FILTER (e.dst IS NOT NULL), []) AS users FROM inject i LEFT JOIN edges e ON e.graph_id = i.graph_id
  AND e.relation IN ('runtime_consume', 'runtime_inject', 'next_middleware') AND regexp_extract(coalesce(e.mechanism, ''), 'app\\s*\\(\\s*[''"]([^''"]+)[''"]\\s*\\)', 1, 'i') = i.key GROUP BY 1, 2),
ranked AS (SELECT DISTINCT graph_id, unnest([src, dst]) AS ord FROM edges WHERE relation = 'privilege_hierarchy'),
perms AS (SELECT n.graph_id, n.id, list('n' || e.dst) AS ids FROM nodes n JOIN edges e ON e.graph_id = n.graph_id AND e.src = n.node_ord AND e.relation IN ('checks_permission', 'uses_permission') JOIN ranked r ON r.graph_id = e.graph_id AND r.ord = e.dst
  WHERE n.ir_type = 'ir:authz_check' GROUP BY 1, 2 HAVING count(*) >= 2),
recheck AS (SELECT DISTINCT p.graph_id, p.id AS policy, s.id AS service FROM nodes p JOIN edges e ON e.graph_id = p.graph_id AND e.src = p.node_ord JOIN nodes s ON s.graph_id = e.graph_id AND s.node_ord = e.dst
  WHERE p.ir_type = 'ir:authz_check' AND s.type = 'service_call' AND (contains(lower(s.symbol), 'permissionservice') OR contains(lower(s.symbol), 'haspermission'))),
walk AS (SELECT graph_id, node_ord::BIGINT AS ord FROM nodes WHERE type = 'controller_action' UNION SELECT e.graph_id, e.dst FROM walk w JOIN edges e ON e.graph_id = w.graph_id AND e.src = w.ord AND e.relation = 'calls'),
users AS (SELECT graph_id, list(id) AS ids FROM (SELECT graph_id, id FROM nodes WHERE type = 'controller_action' UNION ALL SELECT n.graph_id, n.id FROM nodes n JOIN walk w ON w.graph_id = n.graph_id AND w.ord = n.node_ord WHERE n.type = 'service_call') GROUP BY 1)
"""
_SQL = {
    "missing_policy": _row("missing_policy", "'HIGH'", "'HIGH'", "[x.entrypoint, a.node]", "[a.node]", "3", "g x JOIN annotations a ON a.graph_id = x.graph_id WHERE a.type = 'missing_policy'"),
    "missing_authorization": _row("missing_authorization", "'HIGH'", "'HIGH'", "[hid, method]", "[l.gate, hid]", "2", "g x JOIN authl l ON l.graph_id = x.graph_id WHERE hid IS NOT NULL AND method IN ('POST', 'PUT', 'PATCH', 'DELETE') AND l.gate IS NOT NULL AND NOT l.other AND NOT chk"),
    "resource_unprotected": _row("resource_unprotected", "'CRITICAL'", "'HIGH'", "[r.id, x.entrypoint]", "list_filter([r.id, hid], lambda v: v IS NOT NULL)", "3", "g x JOIN accessed r ON r.graph_id = x.graph_id WHERE NOT EXISTS (SELECT 1 FROM authorized z WHERE z.graph_id = r.graph_id AND z.symbol = r.symbol)"),
    "resource_mismatch": _row("resource_mismatch", "'CRITICAL'", "'HIGH'", "[z.id, r.id]", "list_filter([z.id, r.id, c.id], lambda v: v IS NOT NULL)", "2", "g x JOIN authorized z ON z.graph_id = x.graph_id JOIN accessed r ON r.graph_id = x.graph_id LEFT JOIN checker c ON c.graph_id = z.graph_id AND c.dst = z.node_ord WHERE NOT EXISTS (SELECT 1 FROM accessed y WHERE y.graph_id = z.graph_id AND y.symbol = z.symbol)"),
    "fat_controller": _row("fat_controller", "'LOW'", "'HIGH'", "[hid]", "[hid] || svcs", "3", "g x WHERE hid IS NOT NULL AND classes >= 5"),
    "exposed_read_endpoint": _row("exposed_read_endpoint", "'MEDIUM'", "'MEDIUM'", "[hid, method]", "[hid] || svcs || ress", "3", "g x WHERE method IN ('GET', 'HEAD') AND hid IS NOT NULL AND NOT gate AND NOT chk AND (svc OR res)"),
    "over_authorized_route": _row("over_authorized_route", "'INFO'", "'HIGH'", "[hid]", "[hid] || layers", "3", "g x WHERE hid IS NOT NULL AND gate AND chk AND val"),
    "dead_middleware": _row("dead_middleware", "'MEDIUM'", "'MEDIUM'", "[n.id]", "[n.id]", "3", "g x JOIN nodes n ON n.graph_id = x.graph_id WHERE n.ir_type = 'ir:auth_gate' AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.graph_id = n.graph_id AND e.src = n.node_ord)"),
    "sensitive_field_exposed": _row("sensitive_field_exposed", "'HIGH'", "'HIGH'", "[n.id]", "[hid, n.id]", "3", "g x JOIN nodes n ON n.graph_id = x.graph_id WHERE hid IS NOT NULL AND n.ir_type = 'ir:api_resource' AND contains(n.detail, '\"sensitiveFields\":[\"')"),
    "synchronous_mail": _row("synchronous_mail", "'MEDIUM'", "'HIGH'", "[n.id]", "[hid, n.id]", "4", "g x JOIN nodes n ON n.graph_id = x.graph_id WHERE hid IS NOT NULL AND n.ir_type = 'ir:mail' AND contains(n.detail, '\"queued\":false')"),
    "api_resource_unprotected": _row("api_resource_unprotected", "'HIGH'", "'HIGH'", "[hid, n.id]", "[hid, n.id]", "3", "g x JOIN nodes n ON n.graph_id = x.graph_id WHERE hid IS NOT NULL AND n.ir_type = 'ir:api_resource' AND NOT gate AND NOT chk AND NOT (classes > 0 AND method IN ('GET', 'HEAD'))"),
    "duplicate_authorization": _row("duplicate_authorization", "'LOW'", "CASE WHEN d.sure THEN 'HIGH' ELSE 'MEDIUM' END", "d.ids || [d.ability]", "d.ids", "1", "g x JOIN groups d ON d.graph_id = x.graph_id WHERE gate"),
    "delegated_validation": _row("delegated_validation", "CASE WHEN l.ids IS NULL THEN 'MEDIUM' ELSE 'INFO' END", "CASE WHEN r.graph_id IS NULL THEN 'MEDIUM' ELSE 'HIGH' END", "[v.id] || coalesce(l.ids, [])", "[v.id] || coalesce(l.ids, [])", "CASE WHEN l.ids IS NULL THEN 1 ELSE 0 END", "g x JOIN gates v ON v.graph_id = x.graph_id LEFT JOIN authl l ON l.graph_id = x.graph_id LEFT JOIN real r ON r.graph_id = x.graph_id WHERE v.delegates"),
    "hidden_runtime_dependency": _row("hidden_runtime_dependency", "'HIGH'", "i.confidence", "[i.id, i.key] || c.users", "[i.id] || c.users", "2", "g x JOIN inject i ON i.graph_id = x.graph_id JOIN consumed c ON c.graph_id = i.graph_id AND c.id = i.id"),
    "privilege_hierarchy_present": _row("privilege_hierarchy_present", "'MEDIUM'", "'MEDIUM'", "[p.id] || p.ids", "[p.id] || p.ids", "2", "g x JOIN perms p ON p.graph_id = x.graph_id"),
    "event_before_commit": _row("event_before_commit", "'HIGH'", "'HIGH'", "[b.id, a.id]", "[b.id, a.id]", "3", "g x JOIN edges e ON e.graph_id = x.graph_id JOIN nodes a ON a.graph_id = e.graph_id AND a.node_ord = e.src JOIN nodes b ON b.graph_id = e.graph_id AND b.node_ord = e.dst WHERE e.relation = 'escapes_transaction' AND a.ir_type = 'ir:txn_escape' AND b.ir_type = 'ir:txn_boundary'"),
    "missing_tenant_scope": _row("missing_tenant_scope", "'CRITICAL'", "'HIGH'", "[a.id, b.id]", "[a.id, b.id]", "3", "g x JOIN edges e ON e.graph_id = x.graph_id JOIN nodes a ON a.graph_id = e.graph_id AND a.node_ord = e.src JOIN nodes b ON b.graph_id = e.graph_id AND b.node_ord = e.dst WHERE tenant AND unscoped AND e.relation = 'missing_tenant_scope' AND a.ir_type = 'ir:unscoped_query' AND b.ir_type = 'ir:runtime_inject'"),
    "double_permission_check": _row("double_permission_check", "'LOW'", "'HIGH'", "[n.id, r.policy, r.service]", "[n.id, r.policy, r.service]", "2", "g x JOIN nodes n ON n.graph_id = x.graph_id JOIN recheck r ON r.graph_id = x.graph_id WHERE n.ir_type = 'ir:authz_check' AND n.arg0 IS NOT NULL"),
    "runtime_consumer_trace": _row("runtime_consumer_trace", "'MEDIUM'", "'MEDIUM'", "[i.id] || u.ids", "[i.id] || u.ids", "2", "g x JOIN inject i ON i.graph_id = x.graph_id JOIN users u ON u.graph_id = x.graph_id"),
}
_RECURSIVE = (FACTS_SQL + ", " + _HAVE).replace("WITH ", "WITH RECURSIVE ", 1)
_ALL = _RECURSIVE + ", findings AS (" + "\nUNION ALL ".join(_SQL.values()) + ")"
_SHOW = "SELECT graph_id, type, severity, confidence, id, array_to_string(list_sort(nodes), ',') AS nodes, n_advice::INT AS n_advice FROM "
_NUMBERS = {"missing_policy": "D01", "missing_authorization": "D02", "resource_unprotected": "D03", "resource_mismatch": "D04", "fat_controller": "D05", "exposed_read_endpoint": "D06", "over_authorized_route": "D07", "dead_middleware": "D08", "sensitive_field_exposed": "D10", "synchronous_mail": "D11", "api_resource_unprotected": "D12", "duplicate_authorization": "D13", "delegated_validation": "D14", "hidden_runtime_dependency": "D15", "privilege_hierarchy_present": "D16", "event_before_commit": "D17", "missing_tenant_scope": "D18", "double_permission_check": "D19", "runtime_consumer_trace": "D20"}


def _shown(df):
    return df.select("graph_id", "type", "severity", "confidence", "id", *joined("nodes", sort=True), F.col("n_advice").cast("int").alias("n_advice"))


for _kind, _no in _NUMBERS.items():
    add(f"{_no}_{_kind}", _RECURSIVE + _SHOW + f"({_SQL[_kind]})")(lambda s, d, k=_kind: _shown(detect.detect(derived(s, d), (k,))))

add("D09_cyclic_graphs", (PREFIX + """, c AS (SELECT DISTINCT e.graph_id, split_part(a.symbol, '::', 1) AS a, split_part(b.symbol, '::', 1) AS b FROM edges e JOIN nodes a ON a.graph_id = e.graph_id AND a.node_ord = e.src JOIN nodes b ON b.graph_id = e.graph_id AND b.node_ord = e.dst
  WHERE e.relation = 'ir:calls' AND a.type = 'ir:service_call' AND b.type = 'ir:service_call'), r AS (SELECT * FROM c WHERE a <> b UNION SELECT r.graph_id, r.a, c.b FROM r JOIN c ON c.graph_id = r.graph_id AND c.a = r.b WHERE c.a <> c.b)
SELECT DISTINCT graph_id FROM r WHERE a = b""").replace("WITH ", "WITH RECURSIVE ", 1))(lambda s, d: detect.detect(derived(s, d), ("circular_dependency",)).select("graph_id").distinct())
_RANK = "row_number() OVER (PARTITION BY graph_id ORDER BY CASE severity WHEN 'CRITICAL' THEN 5 WHEN 'HIGH' THEN 4 WHEN 'MEDIUM' THEN 3 WHEN 'LOW' THEN 2 ELSE 1 END DESC, CASE confidence WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END DESC, len(nodes) DESC, n_advice DESC, id)"
_KINDS = tuple(detect.DETECTORS)
add("O02_ranked_findings", _ALL + f"SELECT graph_id, id, {_RANK} AS rank FROM (SELECT * FROM findings QUALIFY row_number() OVER (PARTITION BY graph_id, id) = 1)")(lambda s, d: detect.rank(detect.detect(derived(s, d), _KINDS).dropDuplicates(["graph_id", "id"])).select("graph_id", "id", "rank"))
add("O03_focus_first", _ALL + f", r AS (SELECT *, {_RANK} AS r FROM (SELECT * FROM findings QUALIFY row_number() OVER (PARTITION BY graph_id, id) = 1)) SELECT graph_id, id, row_number() OVER (PARTITION BY graph_id ORDER BY type IN ('hidden_runtime_dependency', 'runtime_consumer_trace') DESC, r) AS rank FROM r")(lambda s, d: detect.prioritise(detect.rank(detect.detect(derived(s, d), _KINDS).dropDuplicates(["graph_id", "id"])), "runtime").select("graph_id", "id", "rank"))
add("J23_shared_nodes", _ALL + f", r AS (SELECT *, {_RANK} AS r FROM (SELECT * FROM findings QUALIFY row_number() OVER (PARTITION BY graph_id, id) = 1)) SELECT a.graph_id, a.id AS a, b.id AS b, array_to_string(list_sort(list_intersect(a.nodes, b.nodes)), ',') AS shared FROM r a JOIN r b ON b.graph_id = a.graph_id AND a.r < b.r AND a.type <> b.type AND list_has_any(a.nodes, b.nodes)")(lambda s, d: detect.contradictions(detect.rank(detect.detect(derived(s, d), _KINDS).dropDuplicates(["graph_id", "id"]))).select("graph_id", "a", "b", *joined("shared", sort=True)))
add("D29_explain")(lambda s, d: detect.explain(derived(s, d), "auth").select("graph_id", "rank", "type", "severity", "confidence", "id", *joined("nodes", sort=True)))
add("X01_authorization_facts", FACTS_SQL + "SELECT graph_id, id, permission, ability, layer, confidence FROM auth")(lambda s, d: detect.facts(detect.nested(derived(s, d))).select("graph_id", F.explode("auth").alias("f")).select("graph_id", "f.id", "f.permission", "f.ability", "f.layer", "f.confidence"))
add("X02_validation_gates", FACTS_SQL + "SELECT v.graph_id, v.id, delegates, CASE WHEN delegates AND r.graph_id IS NOT NULL THEN 'HIGH' ELSE 'MEDIUM' END AS confidence FROM gates v LEFT JOIN real r ON r.graph_id = v.graph_id")(lambda s, d: detect.facts(detect.nested(derived(s, d))).select("graph_id", F.explode("gates").alias("f")).select("graph_id", "f.id", "f.delegates", "f.confidence"))
add("X03_runtime_injections", FACTS_SQL + "SELECT graph_id, id, key, confidence FROM inject")(lambda s, d: detect.facts(detect.nested(derived(s, d))).select("graph_id", F.explode("inject").alias("f")).select("graph_id", "f.id", "f.key", "f.confidence"))

# ---- routes, contexts, traces
_INFO = PREFIX + """, hh AS (SELECT graph_id, min(node_ord) AS o FROM nodes WHERE type = 'ir:business_handler' GROUP BY 1),
lists AS (SELECT graph_id, coalesce(list(symbol ORDER BY node_ord) FILTER (type = 'ir:auth_gate'), []) AS auth_gates, coalesce(list(symbol ORDER BY node_ord) FILTER (type = 'ir:validation_gate'), []) AS validations,
  coalesce(list(symbol ORDER BY node_ord) FILTER (type = 'ir:service_call'), []) AS services, coalesce(list(symbol || coalesce(':' || arg0, '') ORDER BY node_ord) FILTER (type = 'ir:authz_check'), []) AS authz_checks,
  bool_or(type = 'ir:txn_boundary') AS has_transaction, coalesce(bool_or(type IN ('ir:auth_gate', 'ir:authz_check') AND regexp_matches(symbol, '(?i)throttl|ratelimit|rate.?limit')), false) AS throttled FROM nodes GROUP BY 1),
infos0 AS (SELECT g.graph_id, g.entrypoint, g.method, g.path, g.framework, n.file, n.line, n.symbol, l.* EXCLUDE (graph_id) FROM graphs g JOIN hh ON hh.graph_id = g.graph_id JOIN nodes n ON n.graph_id = g.graph_id AND n.node_ord = hh.o JOIN lists l ON l.graph_id = g.graph_id),
infos AS (SELECT *, framework = 'nestjs' AND len(auth_gates) = 0 AND (SELECT bool_or(framework = 'nestjs' AND len(auth_gates) > 0) FROM infos0) AS is_public FROM infos0)
"""
add("L10_route_infos", _INFO + "SELECT graph_id, entrypoint, file, CASE WHEN line = 0 THEN 1 ELSE line END AS line, symbol, array_to_string(auth_gates, ',') AS auth_gates, array_to_string(authz_checks, ',') AS authz_checks, array_to_string(validations, ',') AS validations, array_to_string(services, ',') AS services, has_transaction, throttled, is_public FROM infos")(lambda s, d: analysis.route_infos(derived(s, d)).select("graph_id", "entrypoint", "file", "line", "symbol", *joined("auth_gates", "authz_checks", "validations", "services"), "has_transaction", "throttled", "is_public"))
add("D21_route_findings", _INFO + """SELECT graph_id, entrypoint, type, severity FROM (
  SELECT *, 'broken_access_control' AS type, 'CRITICAL' AS severity FROM infos WHERE method IN ('POST', 'PUT', 'PATCH', 'DELETE') AND len(auth_gates) = 0 AND len(authz_checks) = 0
  UNION ALL SELECT *, 'missing_authorization', 'HIGH' FROM infos WHERE method IN ('POST', 'PUT', 'PATCH', 'DELETE') AND len(auth_gates) > 0 AND len(authz_checks) = 0
  UNION ALL SELECT *, 'exposed_read_endpoint', 'LOW' FROM infos WHERE method = 'GET' AND len(auth_gates) = 0 AND len(services) > 0
  UNION ALL SELECT *, 'no_rate_limiting', 'HIGH' FROM infos WHERE NOT throttled AND len(auth_gates) = 0 AND method = 'POST' AND regexp_matches(path, '(?i)login|signin|auth|token|password')
  UNION ALL SELECT *, 'fat_controller', 'LOW' FROM infos WHERE len(list_distinct(list_filter(list_transform(services, lambda v: split_part(v, '::', 1)), lambda v: v <> ''))) >= 5) WHERE NOT is_public""")(lambda s, d: analysis.route_findings(analysis.route_infos(derived(s, d))))
add("L12_routes_by_controller", _INFO + "SELECT split_part(symbol, '::', 1) AS key, string_agg(entrypoint, ',' ORDER BY graph_id) AS routes FROM infos WHERE split_part(symbol, '::', 1) <> '' GROUP BY 1")(lambda s, d: analysis.route_index(derived(s, d), "controller").select("key", *joined("routes")))
add("L12_routes_by_node", _INFO + "SELECT n.id AS key, arg_max(i.entrypoint, n.graph_id) AS route FROM nodes n JOIN infos i ON i.graph_id = n.graph_id GROUP BY 1")(lambda s, d: analysis.route_index(derived(s, d), "node"))
_L = "coalesce(string_agg(symbol, ',' ORDER BY node_ord) FILTER ({}), '') AS {}"
_KIND_OF = {"auth_gates": "ir:auth_gate", "authz_checks": "ir:authz_check", "boundaries": "ir:txn_boundary", "writes": "ir:txn_write", "escapes": "ir:txn_escape", "jobs": "ir:queue_job", "events": "ir:event_dispatch", "notifications": "ir:notification", "mails": "ir:mail", "unscoped_queries": "ir:unscoped_query", "unscoped_writes": "ir:unscoped_write", "resources": "ir:resource", "services": "ir:service_call", "validations": "ir:validation_gate"}
add("L02_fact_lists", PREFIX + "SELECT g.graph_id, g.entrypoint, " + ", ".join(_L.format(f"ir_type = '{k}'", v) for v, k in _KIND_OF.items()) + " FROM graphs g LEFT JOIN nodes n ON n.graph_id = g.graph_id GROUP BY 1, 2")(lambda s, d: analysis.fact_lists(derived(s, d)).select("graph_id", "entrypoint", *joined(*analysis.LISTS)))
add("L07_handler_calls", PREFIX + ", hh AS (SELECT graph_id, min(node_ord) AS o FROM nodes WHERE ir_type = 'ir:business_handler' GROUP BY 1), c AS (SELECT hh.graph_id, string_agg(n.symbol, ',' ORDER BY e.edge_ord) AS callees FROM hh JOIN edges e ON e.graph_id = hh.graph_id AND e.src = hh.o AND e.relation = 'ir:calls' JOIN nodes n ON n.graph_id = e.graph_id AND n.node_ord = e.dst GROUP BY 1), s AS (SELECT graph_id, string_agg(symbol, ',' ORDER BY node_ord) AS of_class FROM nodes WHERE ir_type = 'ir:service_call' AND contains(lower(symbol), 'service3') GROUP BY 1) SELECT g.graph_id, coalesce(callees, '') AS callees, coalesce(of_class, '') AS of_class FROM graphs g LEFT JOIN c ON c.graph_id = g.graph_id LEFT JOIN s ON s.graph_id = g.graph_id")(lambda s, d: analysis.handler_calls(derived(s, d), "Service3").select("graph_id", *joined("callees", "of_class")))
_SUM = """, c AS (SELECT g.graph_id, g.entrypoint, method IN ('POST', 'PUT', 'PATCH', 'DELETE') AS mut, coalesce(bool_or(ir_type = 'ir:auth_gate'), false) AS gate, coalesce(bool_or(ir_type = 'ir:txn_boundary'), false) AS txn, coalesce(bool_or(ir_type = 'ir:authz_check'), false) AS chk,
  count(*) FILTER (ir_type IN ('ir:queue_job', 'ir:event_dispatch', 'ir:notification', 'ir:mail')) AS fx, coalesce(bool_or(ir_type = 'ir:txn_escape'), false) AS esc, count(node_ord) AS n_nodes FROM graphs g LEFT JOIN nodes n ON n.graph_id = g.graph_id GROUP BY g.graph_id, g.entrypoint, g.method)"""
add("L09_context", _ALL + _SUM + """, w AS (SELECT graph_id, max(CASE severity WHEN 'CRITICAL' THEN 5 WHEN 'HIGH' THEN 4 WHEN 'MEDIUM' THEN 3 WHEN 'LOW' THEN 2 ELSE 1 END) AS worst FROM findings GROUP BY 1)
SELECT c.graph_id, c.entrypoint, n_nodes, CASE WHEN (NOT gate AND mut) OR worst = 5 THEN 'CRITICAL' WHEN worst = 4 THEN 'HIGH' WHEN worst = 3 THEN 'MEDIUM' WHEN worst IS NOT NULL THEN 'LOW' ELSE 'NONE' END AS risk,
  concat_ws(' ', CASE WHEN mut THEN 'Mutating' ELSE 'Read-only' END, CASE WHEN gate THEN 'authenticated' ELSE 'public' END, 'route', CASE WHEN txn THEN 'with transaction boundary' END, CASE WHEN chk THEN 'and authorization checks' END,
    CASE WHEN fx > 0 THEN 'with ' || fx || ' async side-effect(s)' END, CASE WHEN esc THEN '— WARNING: side-effects escape transaction' END) || '.' AS summary FROM c LEFT JOIN w ON w.graph_id = c.graph_id""")(lambda s, d: (lambda c: analysis.context(c, detect.detect(c, _KINDS)).select("graph_id", "entrypoint", "n_nodes", "risk", "summary"))(derived(s, d)))
_T = "coalesce(string_agg(symbol, ',' ORDER BY node_ord) FILTER (type = '{}'), '') AS {}"
_PER = "FROM graphs g LEFT JOIN nodes n ON n.graph_id = g.graph_id GROUP BY g.graph_id, g.entrypoint"
_TRACE_SQL = {
    "auth": "SELECT t.*, coalesce(u, '') AS unprotected_resources FROM (SELECT g.graph_id, g.entrypoint, " + ", ".join(_T.format(*x) for x in (("ir:auth_gate", "auth_gates"), ("ir:authz_check", "authz_checks"), ("ir:validation_gate", "validation_gates"), ("ir:resource", "resources"))) + ", coalesce(bool_or(type IN ('ir:auth_gate', 'ir:authz_check')), false) AS has_auth " + _PER + ") t LEFT JOIN (SELECT r.graph_id, string_agg(r.symbol, ',' ORDER BY r.node_ord) AS u FROM nodes r WHERE r.type = 'ir:resource' AND NOT EXISTS (SELECT 1 FROM edges e JOIN nodes z ON z.graph_id = e.graph_id AND z.node_ord = e.dst WHERE e.graph_id = r.graph_id AND e.relation = 'ir:authorizes' AND z.symbol = r.symbol) GROUP BY 1) v ON v.graph_id = t.graph_id",
    "event": "SELECT * FROM (SELECT g.graph_id, g.entrypoint, " + _T.format("ir:txn_escape", "dispatched_events") + ", coalesce(bool_or(type = 'ir:txn_boundary'), false) AS inside_transaction " + _PER + ") WHERE dispatched_events <> ''",
    "transaction": "SELECT * FROM (SELECT g.graph_id, g.entrypoint, " + ", ".join(_T.format(*x) for x in (("ir:txn_boundary", "boundaries"), ("ir:txn_write", "writes"), ("ir:txn_escape", "escapes"))) + " " + _PER + ") WHERE boundaries <> ''",
    "isolation": "SELECT * FROM (SELECT g.graph_id, g.entrypoint, " + ", ".join(_T.format(*x) for x in (("ir:unscoped_query", "unscoped_queries"), ("ir:unscoped_write", "unscoped_writes"))) + ", coalesce(bool_or(ir_type = 'ir:tenant_context' OR (ir_type = 'ir:runtime_inject' AND contains(lower(symbol), 'tenant'))), false) AS has_tenant_context " + _PER + ") WHERE unscoped_queries || unscoped_writes <> ''",
    "side_effects": "SELECT g.graph_id, g.entrypoint, " + ", ".join(_T.format(*x) for x in (("ir:queue_job", "queue_jobs"), ("ir:event_dispatch", "event_dispatches"), ("ir:api_resource", "api_resources"), ("ir:notification", "notifications"), ("ir:mail", "mails"))) + ", coalesce(string_agg(symbol, ',' ORDER BY node_ord) FILTER (type = 'ir:mail' AND NOT coalesce(contains(detail, '\"queued\":true'), false)), '') AS synchronous_mails, coalesce(bool_or(type IN ('ir:queue_job', 'ir:event_dispatch', 'ir:api_resource', 'ir:notification', 'ir:mail')), false) AS has_side_effects " + _PER,
}
_SUMMARY = {
    "auth": "count(*) FILTER (has_auth) AS routes_with_auth, count(*) FILTER (NOT has_auth) AS routes_without_auth, count(*) FILTER (unprotected_resources <> '') AS routes_with_unprotected_resources",
    "event": "count(*) AS routes_dispatching_events, count(*) FILTER (NOT inside_transaction) AS routes_with_unsafe_dispatch",
    "transaction": "count(*) AS routes_with_transactions, count(*) FILTER (escapes <> '') AS routes_with_escapes",
    "isolation": "count(*) FILTER (unscoped_queries <> '') AS routes_with_unscoped_queries, count(*) FILTER (unscoped_writes <> '') AS routes_with_unscoped_writes, count(*) FILTER (NOT has_tenant_context) AS routes_without_tenant_context",
    "side_effects": ", ".join(f"count(*) FILTER ({k} <> '') AS routes_with_{k}" for k in ("queue_jobs", "event_dispatches", "api_resources", "notifications", "mails", "synchronous_mails")),
}
for _p, _sql in _TRACE_SQL.items():
    add(f"R15_trace_{_p}", PREFIX + _sql)(lambda s, d, p=_p: (lambda t: t.select(*(joined(f.name)[0] if f.dataType.typeName() == "array" else f.name for f in t.schema)))(analysis.trace(derived(s, d), p)))
    add(f"A07_{_p}_summary", PREFIX + f"SELECT {_SUMMARY[_p]}, (SELECT count(*) FROM graphs) AS total_routes FROM ({_sql})")(lambda s, d, p=_p: analysis.trace_summary(derived(s, d), p))
add("R16_execution_paths")(lambda s, d: analysis.execution_paths(derived(s, d)).select("graph_id", *joined("path")))
_ROLE = "CASE type WHEN 'ir:auth_gate' THEN 'middleware' WHEN 'ir:authz_check' THEN 'policy' WHEN 'ir:business_handler' THEN 'controller' WHEN 'ir:validation_gate' THEN 'form_request' WHEN 'ir:permission_constant' THEN 'permission' WHEN 'ir:resource' THEN 'resource' WHEN 'ir:txn_boundary' THEN 'transaction' ELSE replace(type, 'ir:', '') END"
add("R22_evidence", PREFIX + f""", x AS (SELECT *, CASE WHEN type IN ('ir:txn_boundary', 'ir:txn_write', 'ir:txn_escape') THEN 0 WHEN type IN ('ir:auth_gate', 'ir:authz_check', 'ir:business_handler', 'ir:validation_gate', 'ir:permission_constant', 'ir:resource') THEN 2 END AS hit, {_ROLE} AS shown FROM nodes)
SELECT graph_id, row_number() OVER (PARTITION BY graph_id ORDER BY hit, node_ord) AS pos, id, symbol, type, shown AS role, coalesce(nullif(detail, ''), CASE WHEN coalesce(role, '') <> '' AND role <> shown THEN role END, arg0) AS detail FROM x WHERE hit IS NOT NULL""")(lambda s, d: analysis.evidence(derived(s, d), ["transaction", "auth"]))
add("R24_evidence_package")(lambda s, d: analysis.evidence_package(derived(s, d), "Is the transaction committed before the event is dispatched, and who has permission?").select("graph_id", "intents", *joined("path"), "n_evidence", "finding", "severity", "confidence"))
_TYPES = "('ir:entrypoint', 'ir:auth_gate', 'ir:authz_check', 'ir:business_handler', 'ir:validation_gate', 'ir:service_call', 'ir:permission_constant', 'ir:runtime_inject', 'ir:runtime_consume', 'ir:tenant_context', 'ir:scoped_query', 'ir:unscoped_query', 'ir:unscoped_write', 'ir:txn_boundary', 'ir:txn_write', 'ir:txn_escape', 'ir:resource', 'ir:api_resource', 'ir:queue_job', 'ir:event_dispatch', 'ir:notification', 'ir:mail')"
add("F14_conformance", PREFIX + f""", v AS (SELECT graph_id, count(*) FILTER (type IN ('authorization_check', 'controller_action', 'form_request', 'service_call', 'permission', 'policy')) AS ln, count(*) FILTER (type NOT IN {_TYPES} AND type NOT IN ('authorization_check', 'controller_action', 'form_request', 'service_call', 'permission', 'policy')) AS un FROM nodes GROUP BY 1),
w AS (SELECT graph_id, count(*) FILTER (relation IN ('calls', 'escapes_transaction', 'next_middleware', 'policy_check', 'missing_tenant_scope')) AS le, count(*) FILTER (relation IN ('checks_permission', 'uses_permission', 'privilege_hierarchy', 'runtime_inject')) AS ue FROM edges GROUP BY 1)
SELECT g.graph_id, coalesce(ln, 0) AS legacy_nodes, coalesce(un, 0) AS unknown_nodes, coalesce(le, 0) AS legacy_edges, coalesce(ue, 0) AS unknown_edges, coalesce(un, 0) = 0 AND coalesce(ue, 0) = 0 AS conformant FROM graphs g LEFT JOIN v ON v.graph_id = g.graph_id LEFT JOIN w ON w.graph_id = g.graph_id""")(lambda s, d: analysis.conformance(derived(s, d)))
_LAYER = "CASE WHEN ir_type = 'ir:auth_gate' THEN 0 WHEN ir_type IN ('ir:authz_check', 'ir:permission_constant') THEN 1 WHEN ir_type = 'ir:validation_gate' THEN 2 WHEN ir_type IN ('ir:runtime_inject', 'ir:runtime_consume', 'ir:tenant_context') THEN 3 WHEN ir_type = 'ir:business_handler' THEN 4 WHEN ir_type = 'ir:txn_boundary' THEN 5 WHEN ir_type = 'ir:service_call' THEN 6 WHEN ir_type IN ('ir:scoped_query', 'ir:unscoped_query', 'ir:unscoped_write', 'ir:txn_write') THEN 7 WHEN ir_type IN ('ir:resource', 'ir:api_resource') THEN 8 WHEN ir_type = 'ir:txn_escape' THEN 9 WHEN ir_type IN ('ir:queue_job', 'ir:event_dispatch') THEN 10 WHEN ir_type IN ('ir:notification', 'ir:mail') THEN 11 END"
add("A19_layers", PREFIX + f", x AS (SELECT *, {_LAYER} AS pos FROM nodes) SELECT graph_id, pos::BIGINT AS pos, count(*) AS n, string_agg(symbol, ',' ORDER BY node_ord) AS symbols, count(*) FILTER (ir_type IN ('ir:unscoped_query', 'ir:unscoped_write', 'ir:txn_escape')) AS n_danger FROM x WHERE pos IS NOT NULL GROUP BY 1, 2")(lambda s, d: render.layers(derived(s, d)).select("graph_id", "pos", "n", *joined("symbols"), "n_danger"))
add("K08_report", _ALL + ", c AS (SELECT graph_id, count(*) FILTER (severity = 'CRITICAL') AS n_critical, count(*) FILTER (severity = 'HIGH') AS n_high FROM findings GROUP BY 1) SELECT g.graph_id, g.entrypoint, coalesce(n_critical, 0) AS n_critical, coalesce(n_high, 0) AS n_high, (SELECT count(*) FROM nodes n WHERE n.graph_id = g.graph_id) AS n_nodes FROM graphs g LEFT JOIN c ON c.graph_id = g.graph_id")(lambda s, d: (lambda c: render.report(c, detect.detect(c, _KINDS)).drop("layers"))(derived(s, d)))
add("K06_markdown", _ALL + f", r AS (SELECT *, {_RANK} AS r FROM (SELECT * FROM findings QUALIFY row_number() OVER (PARTITION BY graph_id, id) = 1)) SELECT graph_id, '# Analysis' || chr(10) || chr(10) || count(*) || ' finding(s) detected.' || chr(10) || string_agg('## Finding ' || r || ': ' || upper(replace(type, '_', ' ')) || chr(10) || chr(10) || '**Severity:** ' || CASE severity WHEN 'CRITICAL' THEN '🔴 CRITICAL' WHEN 'HIGH' THEN '🟠 HIGH' WHEN 'MEDIUM' THEN '🟡 MEDIUM' WHEN 'LOW' THEN '🟢 LOW' ELSE '🔵 INFO' END || '  ' || chr(10) || '**Confidence:** ' || confidence || '  ' || chr(10) || '**Nodes:** ' || array_to_string(list_sort(nodes), ', ') || chr(10), chr(10) || '---' || chr(10) || chr(10) ORDER BY r) AS text FROM r GROUP BY 1")(lambda s, d: render.markdown(detect.rank(detect.detect(derived(s, d), _KINDS).withColumn("nodes", F.array_sort("nodes")).dropDuplicates(["graph_id", "id"]))))
add("K09_prompt_paths", PREFIX + """, ns AS (SELECT graph_id, string_agg('  ' || symbol || coalesce('(' || arg0 || ')', '') || ' [' || type || ']' || CASE WHEN mutates THEN ' [MUTATES]' ELSE '' END || CASE WHEN coalesce(detail, '') <> '' THEN chr(10) || '    detail: ' || detail ELSE '' END, chr(10) ORDER BY node_ord) AS t FROM nodes GROUP BY 1),
es AS (SELECT e.graph_id, string_agg('  ' || a.symbol || ' → ' || b.symbol || '  [' || relation || ']', chr(10) ORDER BY edge_ord) AS t FROM edges e JOIN nodes a ON a.graph_id = e.graph_id AND a.node_ord = e.src JOIN nodes b ON b.graph_id = e.graph_id AND b.node_ord = e.dst GROUP BY 1),
us AS (SELECT graph_id, string_agg('  ' || symbol || ' [' || type || '] — NOT wrapped in a transaction', chr(10) ORDER BY node_ord) AS t FROM nodes n WHERE mutates AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.graph_id = n.graph_id AND e.dst = n.node_ord AND relation = 'ir:wraps') GROUP BY 1)
SELECT g.graph_id, 'Execution path: ' || entrypoint || chr(10) || chr(10) || 'Nodes:' || chr(10) || coalesce(ns.t, '') || chr(10) || chr(10) || 'Edges:' || chr(10) || coalesce(es.t, '') || coalesce(chr(10) || chr(10) || 'Unwrapped mutations (no transaction boundary):' || chr(10) || us.t, '') AS text
FROM graphs g LEFT JOIN ns ON ns.graph_id = g.graph_id LEFT JOIN es ON es.graph_id = g.graph_id LEFT JOIN us ON us.graph_id = g.graph_id""")(lambda s, d: render.prompt_paths(derived(s, d)))
add("K05_trees")(lambda s, d: render.tree(derived(s, d)))
add("K11_hints", _INFO + """SELECT file, CASE WHEN line = 0 THEN 1 ELSE line END AS line, concat_ws(' · ', entrypoint, CASE WHEN len(auth_gates) > 0 THEN 'auth: ' || array_to_string(auth_gates, ', ') WHEN is_public THEN 'public' ELSE 'no auth' END,
  CASE WHEN len(authz_checks) > 0 THEN 'authz: ' || array_to_string(authz_checks, ', ') END, CASE WHEN has_transaction THEN 'transaction' END) AS label FROM infos WHERE file <> ''""")(lambda s, d: render.hints(analysis.route_infos(derived(s, d))))
