"""Runtime spans: derivation from events, correlation inputs, N+1 and slow queries, gap report; in batch and as a stream."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# fixed values: how often a table is asked for, and how many milliseconds a query takes, before it is a finding
THRESHOLD, SLOW_MS = 5, 500


def spans(events: DataFrame) -> DataFrame:
    """Events as spans: a session is a user's day, the first event its root; every other is a query under the root, or, of every third, under the one before."""
    day = F.to_date("ts").cast("string")
    e = events.select(F.concat_ws("-", F.col("user_id").cast("string"), day).alias("session_id"), "event_id", "ts", "event_type", "value")
    w = Window.partitionBy("session_id").orderBy("ts", "event_id")
    e = e.withColumn("span_ord", F.row_number().over(w).cast("bigint")).withColumn("top", F.first("event_id").over(w)).withColumn("before", F.lag("event_id").over(w))
    root = F.col("span_ord") == 1
    parent = F.when(~root, F.when(F.col("event_id") % 3 == 0, F.col("before")).otherwise(F.col("top")))
    return e.select("session_id", "span_ord", F.col("event_id").alias("span_id"), parent.alias("parent_id"), F.when(~root, F.concat(F.lit("db."), F.col("event_type"))).otherwise("request").alias("name"), F.when(~root, F.concat(F.lit("SELECT * FROM t"), (F.col("event_id") % 4).cast("string"))).alias("statement"), F.col("value").alias("ms"))


def table_of(statement):
    part = lambda p: F.nullif(F.regexp_extract(statement, p, 1), F.lit(""))
    return F.lower(F.coalesce(part(r"(?i)\bFROM\s+[`\"]?(\w+)"), part(r"(?i)\bUPDATE\s+[`\"]?(\w+)"), part(r"(?i)\bINSERT\s+INTO\s+[`\"]?(\w+)")))


def n_plus_one(spans: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """The same table asked for ``threshold`` times or more under one parent (``__root__`` where there is none): session_id, parent_id, table, n, severity."""
    q = spans.where("name like 'db.%'").withColumn("table", table_of(F.col("statement"))).where("table is not null")
    parent = F.coalesce(F.col("parent_id").cast("string"), F.lit("__root__"))
    out = q.groupBy("session_id", parent.alias("parent_id"), "table").agg(F.count("*").alias("n")).where(F.col("n") >= threshold)
    return out.withColumn("severity", F.when(F.col("n") >= 10, "high").otherwise("medium"))


def slow_queries(spans: DataFrame, least: float = SLOW_MS) -> DataFrame:
    """Queries of ``least`` rounded milliseconds or more; high from twice that, critical from four times."""
    ms = F.round("ms")
    return spans.where("name like 'db.%'").where(ms >= least).select("session_id", "span_id", ms.cast("bigint").alias("ms"), F.when(ms >= 4 * least, "critical").when(ms >= 2 * least, "high").otherwise("medium").alias("severity"))


def with_nodes(findings: DataFrame, correlated: DataFrame, key: str) -> DataFrame:
    """Findings with the node that their span (column ``key``) is matched to, or null."""
    at = correlated.select("session_id", F.col("span_id").cast("string").alias("_span"), "node_ord")
    return findings.join(at.withColumnRenamed("_span", "of_span"), (findings["session_id"] == at["session_id"]) & (findings[key].cast("string") == F.col("of_span")), "left").select(*(findings[c] for c in findings.columns), "node_ord")


def gap_report(spans: DataFrame) -> DataFrame:
    """Spans by category with their share in percent."""
    category = F.when(F.col("name").rlike(r"^db\."), "database").when(F.col("name").rlike(r"^(redis|cache)\."), "cache").otherwise("request")
    c = spans.groupBy(category.alias("category")).agg(F.count("*").alias("n"))
    return c.withColumn("percent", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy())).cast("bigint"))


def stream_n_plus_one(spans: DataFrame, threshold: int = THRESHOLD, late: str = "1 hour") -> DataFrame:
    """``n_plus_one`` over a stream of spans that have a time (ts): the same columns, and the day they are counted in.

    Counts are kept by session, parent and table, and are let go once the watermark has passed their day; spans later than ``late`` behind
    it are dropped.  A session that runs over midnight is counted by day.
    """
    q = spans.withWatermark("ts", late).where("name like 'db.%'").withColumn("table", table_of(F.col("statement"))).where("table is not null")
    parent = F.coalesce(F.col("parent_id").cast("string"), F.lit("__root__"))
    g = q.groupBy(F.window("ts", "1 day").alias("day"), "session_id", parent.alias("parent_id"), "table").agg(F.count("*").alias("n")).where(F.col("n") >= threshold)
    return g.select(F.col("day.start").alias("day"), "session_id", "parent_id", "table", "n", F.when(F.col("n") >= 10, "high").otherwise("medium").alias("severity"))
