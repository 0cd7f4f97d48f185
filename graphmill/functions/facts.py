"""Per-graph facts in one aggregate: every predicate and most detectors read this row instead of scanning nodes again."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import MUTATIONS
from ..sources.corpus import Corpus

HAS = {"has_auth": ("ir:auth_gate",), "has_authz": ("ir:authz_check",), "has_handler": ("ir:business_handler",), "has_validation": ("ir:validation_gate",), "has_txn": ("ir:txn_boundary",), "has_escape": ("ir:txn_escape",), "has_dispatch": ("ir:queue_job", "ir:event_dispatch"), "has_unscoped": ("ir:unscoped_query", "ir:unscoped_write"), "has_resource": ("ir:resource", "ir:api_resource"), "has_service": ("ir:service_call",)}


def fact_rows(corpus: Corpus) -> DataFrame:
    """One row a graph, graphs without nodes included: flags, counts, number of distinct callee classes."""
    flags = [F.coalesce(F.bool_or(F.col("ir_type").isin(*types)), F.lit(False)).alias(name) for name, types in HAS.items()]
    tenant = (F.col("ir_type") == "ir:tenant_context") | ((F.col("ir_type") == "ir:runtime_inject") & F.lower("symbol").contains("tenant"))
    classes = F.count_distinct(F.when(F.col("ir_type") == "ir:service_call", F.nullif(F.substring_index("symbol", "::", 1), F.lit(""))))
    own = corpus.nodes.groupBy("graph_id").agg(*flags, F.coalesce(F.bool_or(tenant), F.lit(False)).alias("has_tenant"), F.count("*").alias("n_nodes"), classes.alias("n_classes"))
    out = corpus.graphs.join(own, "graph_id", "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(False)) for c in (*HAS, "has_tenant")} | {c: F.coalesce(c, F.lit(0)).cast("bigint") for c in ("n_nodes", "n_classes")})
    return out.withColumn("is_mutation", F.upper(F.coalesce("method", F.lit(""))).isin(*MUTATIONS))


_FLAGS = ", ".join(f"coalesce(bool_or(ir_type IN ({', '.join(repr(t) for t in types)})), false) AS {name}" for name, types in HAS.items())
FACTS_SQL = f"""facts AS (SELECT g.*, {', '.join(f'coalesce({c}, false) AS {c}' for c in (*HAS, 'has_tenant'))}, coalesce(n_nodes, 0) AS n_nodes, coalesce(n_classes, 0) AS n_classes,
  method IN ('POST', 'PUT', 'PATCH', 'DELETE') AS is_mutation
FROM graphs g LEFT JOIN (SELECT graph_id AS gid, {_FLAGS}, coalesce(bool_or(ir_type = 'ir:tenant_context' OR (ir_type = 'ir:runtime_inject' AND contains(lower(symbol), 'tenant'))), false) AS has_tenant,
  count(*) AS n_nodes, count(DISTINCT CASE WHEN ir_type = 'ir:service_call' THEN nullif(split_part(symbol, '::', 1), '') END) AS n_classes FROM nodes GROUP BY 1) n ON n.gid = g.graph_id)
"""
