"""Vocabularies and the schema of execution graphs."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: names of the data model
NODE_TYPES = (
    "ir:entrypoint", "ir:auth_gate", "ir:authz_check", "ir:business_handler", "ir:validation_gate", "ir:service_call",
    "ir:permission_constant", "ir:runtime_inject", "ir:runtime_consume", "ir:tenant_context", "ir:scoped_query",
    "ir:unscoped_query", "ir:unscoped_write", "ir:txn_boundary", "ir:txn_write", "ir:txn_escape", "ir:resource",
    "ir:api_resource", "ir:queue_job", "ir:event_dispatch", "ir:notification", "ir:mail", "ir:unknown_middleware",
    "ir:guard_clause", "ir:audit_log", "ir:conditional_branch",
)
RELATIONS = (
    "ir:precedes", "ir:calls", "ir:guards", "ir:validates", "ir:injects", "ir:checks_permission", "ir:accesses", "ir:wraps",
    "ir:escapes", "ir:authorizes", "ir:returns", "ir:dispatches", "ir:sends", "ir:controls",
)
LEGACY = {
    "authentication_gate": "ir:auth_gate",
    "authorization_check": "ir:authz_check",
    "controller_action": "ir:business_handler",
    "form_request": "ir:validation_gate",
    "service_call": "ir:service_call",
    "permission": "ir:permission_constant",
    "middleware": "ir:auth_gate",
    "policy": "ir:authz_check",
    "runtime_injection": "ir:runtime_inject",
    "transaction_boundary": "ir:txn_boundary",
    "transactional_write": "ir:txn_write",
    "transaction_escape": "ir:txn_escape",
    "unscoped_query": "ir:unscoped_query",
    "unscoped_write": "ir:unscoped_write",
    "tenant_scoped_query": "ir:scoped_query",
}
LEGACY_RELATIONS = (
    "calls", "validates", "dispatches", "escapes_transaction", "form_request", "next_middleware", "opens_transaction",
    "policy_check", "responds_with", "missing_tenant_scope", "ir:includes", "guards", "authorizes",
)
MUTATIONS = ("POST", "PUT", "PATCH", "DELETE")
CRITICAL = ("ir:auth_gate", "ir:authz_check", "ir:validation_gate", "ir:txn_boundary", "ir:scoped_query", "ir:unscoped_query", "ir:unscoped_write")
DANGER = ("ir:unscoped_write", "ir:unscoped_query")
HIGH = (
    "ir:auth_gate", "ir:authz_check", "ir:permission_constant", "ir:runtime_inject", "ir:tenant_context", "ir:service_call",
    "ir:validation_gate", "ir:txn_boundary", "ir:txn_write", "ir:txn_escape", "ir:unscoped_query", "ir:unscoped_write",
    "ir:api_resource", "ir:queue_job", "ir:notification",
)
MEDIUM = ("ir:runtime_consume", "ir:business_handler", "ir:entrypoint", "ir:scoped_query", "ir:event_dispatch", "ir:mail")
MERGED = ("ir:txn_boundary", "ir:txn_write", "ir:txn_escape", "ir:unscoped_query", "ir:unscoped_write", "ir:scoped_query")
SIDE_EFFECTS = ("ir:queue_job", "ir:event_dispatch", "ir:api_resource", "ir:notification", "ir:mail", "ir:business_handler")
INDEXED = ("ir:service_call", "ir:queue_job", "ir:event_dispatch", "ir:api_resource", "ir:notification", "ir:mail")
SEVERITY = {"CRITICAL": 5, "HIGH": 4, "MEDIUM": 3, "LOW": 2, "INFO": 1}
CONFIDENCE = {"HIGH": 3, "MEDIUM": 2, "LOW": 1}

_TEXT = T.StringType()
NODE = T.StructType([T.StructField(n, _TEXT) for n in ("id", "type", "symbol", "file", "role", "detail")] + [T.StructField("line", T.IntegerType()), T.StructField("args", T.ArrayType(_TEXT)), T.StructField("mutates", T.BooleanType())])
EDGE = T.StructType([T.StructField(n, _TEXT) for n in ("from", "to", "relation", "traceability", "mechanism", "side_effect")])
ANNOTATION = T.StructType([T.StructField("type", _TEXT), T.StructField("description", _TEXT), T.StructField("nodes", T.ArrayType(_TEXT))])
GRAPH = T.StructType([T.StructField(n, _TEXT) for n in ("entrypoint", "method", "path", "framework")] + [T.StructField("nodes", T.ArrayType(NODE)), T.StructField("edges", T.ArrayType(EDGE)), T.StructField("annotations", T.ArrayType(ANNOTATION))])


def to_ir(name: str) -> str:
    return LEGACY.get(name, name)


def ir_type(type_: Column) -> Column:
    """Legacy type names in today's vocabulary; others pass."""
    names = F.create_map(*(F.lit(x) for pair in LEGACY.items() for x in pair))
    return F.coalesce(F.try_element_at(names, type_), type_)


def relevance(kind: Column) -> Column:
    """2, 1 or 0 of a node type in today's vocabulary."""
    return F.when(kind.isin(*HIGH), 2).when(kind.isin(*MEDIUM), 1).otherwise(0)


def level(names: dict[str, int], value: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), value)
