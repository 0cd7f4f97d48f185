"""Regression gates: stored against current measures of retrieval and of answers, and the shape of answers."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: limits of the gates, and the values that an answer may hold
RECALL_DROP, COMPRESSION_DROP, MEAN_DROP, NOISE = 0.05, 0.20, 0.05, 0.10
SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW")
CONFIDENCES = ("HIGH", "MEDIUM", "LOW")


def _compare(now: DataFrame, stored: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """Full outer join by ``key`` with the rows as structs ``a`` (now) and ``b`` (stored); (key, status, reasons)."""
    a = now.select(F.col(key), F.struct(*[c for c in now.columns if c != key]).alias("a"))
    b = stored.select(F.col(key), F.struct(*[c for c in stored.columns if c != key]).alias("b"))
    x = a.join(b, key, "full_outer")
    hits = F.array_compact(F.array(*(F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items())))
    status = F.when(F.col("b").isNull(), "new").when(F.col("a").isNull(), "gone").when(F.size("reasons") > 0, "changed").otherwise("same")
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    return x.withColumn("reasons", F.when(both, hits).otherwise(F.array().cast("array<string>"))).select(key, status.alias("status"), "reasons")


def verify_retrieval(now: DataFrame, stored: DataFrame, key: str = "trace") -> DataFrame:
    """Rows (key, node_ids, critical, compression, recall) against stored ones: (key, status, reasons).

    The set of nodes, or their order where the sets agree, lost critical types, recall lower by over 0.05, compression lower by over a
    fifth.  A new trace is no failure; one that is gone is.  Null lists count as empty.
    """
    none = F.array().cast("array<string>")
    get = lambda side, c: F.coalesce(F.col(f"{side}.{c}"), none)
    added = F.size(F.array_except(get("a", "node_ids"), get("b", "node_ids"))) > 0
    removed = F.size(F.array_except(get("b", "node_ids"), get("a", "node_ids"))) > 0
    was = F.col("b.compression")
    return _compare(now, stored, key, {
        "nodes added": added,
        "nodes removed": removed,
        "order": ~added & ~removed & (get("a", "node_ids") != F.slice(get("b", "node_ids"), F.lit(1), F.size(get("a", "node_ids")))),
        "critical types": F.size(F.array_except(get("b", "critical"), get("a", "critical"))) > 0,
        "recall": F.col("b.recall") - F.col("a.recall") > RECALL_DROP,
        "compression": (was - F.col("a.compression")) / F.when(was == 0, 1.0).otherwise(was) > COMPRESSION_DROP,
    })


def verify_answers(now: DataFrame, stored: DataFrame, key: str = "trace") -> DataFrame:
    """Rows (key, mean, deviation) of repeated answers: a drop beyond the stored deviation, 0.05 at least, or a deviation doubled and over 0.1."""
    return _compare(now, stored, key, {
        "score": F.col("b.mean") - F.col("a.mean") > F.greatest(F.lit(MEAN_DROP), F.col("b.deviation")),
        "reliability": (F.col("a.deviation") > 2 * F.col("b.deviation")) & (F.col("a.deviation") > NOISE),
    })


def savings(naive: Column, tokens: Column) -> Column:
    """Struct of the compression ratio (2 digits) and the share saved in percent (1 digit); 1 and 0 where there is nothing to save from."""
    some = (naive > 0) & (tokens > 0)
    return F.struct(F.when(some, F.round(naive / tokens, 2)).otherwise(1.0).alias("ratio"), F.when(naive > 0, F.round(100 * (1 - tokens / naive), 1)).otherwise(0.0).alias("percent"))


def response_errors(rows: DataFrame) -> Column:
    """Names of the fields of an answer (columns of ``rows``) that break a rule: names present, values known, lists there. A column that is missing counts as null."""
    have = set(rows.columns)
    col = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
    empty = lambda c: F.coalesce(col(c), F.lit("")) == ""
    rules = {
        "finding_type": empty("finding_type"),
        "severity": ~F.coalesce(col("severity").isin(*SEVERITIES), F.lit(False)),
        "confidence": ~F.coalesce(col("confidence").isin(*CONFIDENCES), F.lit(False)),
        "explanation": empty("explanation"),
        "key_nodes": col("key_nodes").isNull(),
        "recommendations": col("recommendations").isNull(),
    }
    return F.array_compact(F.array(*(F.when(bad, F.lit(name)) for name, bad in rules.items())))
