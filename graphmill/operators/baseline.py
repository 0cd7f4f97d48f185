"""Topology baselines, history and diff."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import CRITICAL, DANGER
from ..sources.corpus import Corpus


def capture(corpus: Corpus, by=()) -> DataFrame:
    """route -> its critical node types, sorted, and the largest node count; routes of several graphs merge."""
    g = corpus.graphs.select("graph_id", "entrypoint", *by)
    # the types are few and fixed, so a bit each stands for them: sets of a route's graphs aren't collected or shuffled
    names = sorted(CRITICAL)
    bit = F.coalesce(*(F.when(F.col("type") == t, F.lit(1 << k)) for k, t in enumerate(names)), F.lit(0))
    own = corpus.nodes.groupBy("graph_id").agg(F.bit_or(bit).alias("bits"), F.count("*").alias("n"))
    out = g.join(own, "graph_id", "left").groupBy("entrypoint", *by).agg(F.coalesce(F.bit_or("bits"), F.lit(0)).alias("bits"), F.coalesce(F.max("n"), F.lit(0)).alias("n_nodes"))
    types = F.array_compact(F.array(*(F.when(F.col("bits").bitwiseAND(1 << k) != 0, t) for k, t in enumerate(names))))
    return out.select("entrypoint", *by, types.alias("types"), "n_nodes")


def diff(now: DataFrame, stored: DataFrame) -> DataFrame:
    """Full outer join of two captures: lost and gained types, comma-joined; a route of one side only has status new or gone.

    ``regressed``: types are lost, or dangerous ones gained, or the route is gone.
    """
    a, b = now.select("entrypoint", F.col("types").alias("a")), stored.select("entrypoint", F.col("types").alias("b"))
    none = F.array().cast("array<string>")
    x = a.join(b, "entrypoint", "full_outer")
    status = F.when(F.col("b").isNull(), "new").when(F.col("a").isNull(), "gone").when(F.col("a") == F.col("b"), "same").otherwise("changed")
    minus = lambda p, q: F.array_join(F.array_sort(F.array_except(F.coalesce(p, none), F.coalesce(q, none))), ",")
    gained = F.array_except("a", "b")
    worse = F.coalesce((F.size(F.array_except("b", "a")) > 0) | F.arrays_overlap(gained, F.array(*map(F.lit, DANGER))), F.col("a").isNull())
    return x.select("entrypoint", status.alias("status"), minus("b", "a").alias("lost"), minus("a", "b").alias("gained"), worse.alias("regressed"))


# fixed values: what it means that a route lost or gained a type: severity, whether it is a regression, words
LOST = {
    "ir:auth_gate": ("CRITICAL", True, "Authentication gate removed — endpoint is now publicly accessible"),
    "ir:authz_check": ("HIGH", True, "Authorization check removed — any authenticated user can perform this operation"),
    "ir:txn_boundary": ("HIGH", True, "Operation is no longer atomic — partial writes can succeed on failure"),
    "ir:validation_gate": ("MEDIUM", True, "Input validation removed — request data is no longer validated"),
    "ir:scoped_query": ("MEDIUM", True, "Scoped database query removed — queries may now cross tenant boundaries"),
    "ir:unscoped_query": ("INFO", False, "Unscoped query removed — data access is now properly scoped"),
    "ir:unscoped_write": ("INFO", False, "Unscoped write removed — data mutation is now properly scoped"),
}
GAINED = {
    "ir:unscoped_query": ("CRITICAL", True, "Query now runs without tenant scope — risk of cross-tenant data exposure"),
    "ir:unscoped_write": ("CRITICAL", True, "Write now runs without tenant scope — risk of cross-tenant data mutation"),
    "ir:auth_gate": ("INFO", False, "Authentication gate added — endpoint is now protected"),
    "ir:authz_check": ("INFO", False, "Authorization check added — resource-level protection in place"),
    "ir:txn_boundary": ("INFO", False, "Operation is now transactional — writes are atomic"),
    "ir:validation_gate": ("INFO", False, "Input validation added"),
    "ir:scoped_query": ("INFO", False, "Query is now tenant-scoped — isolation improved"),
}


def changes(drift: DataFrame) -> DataFrame:
    """A drift's rows (entrypoint, status, lost, gained) as changes: entrypoint, rank, type, direction, severity, regression, description; regressions first, then by severity, lost before gained."""
    spark = drift.sparkSession
    rows = [(way, k, t, s, r, d) for way, table in (("lost", LOST), ("gained", GAINED)) for k, (t, (s, r, d)) in enumerate(table.items())]
    meaning = spark.createDataFrame(rows, "direction string, k int, type string, severity string, regression boolean, description string")
    c = drift.where("status = 'changed'")
    each = lambda way: c.select("entrypoint", F.lit(way).alias("direction"), F.posexplode(F.split(way, ",")).alias("pos", "type")).where("type <> ''")
    x = each("lost").union(each("gained")).join(F.broadcast(meaning), ["direction", "type"])
    level = F.when(F.col("severity") == "CRITICAL", 0).when(F.col("severity") == "HIGH", 1).when(F.col("severity") == "MEDIUM", 2).otherwise(3)
    order = Window.partitionBy("entrypoint").orderBy(F.desc("regression"), level, F.desc("direction"), "pos")
    return x.withColumn("rank", F.row_number().over(order).cast("bigint")).select("entrypoint", "rank", "type", "direction", "severity", "regression", "description")


def history(snapshots: DataFrame) -> DataFrame:
    """Snapshots (entrypoint, snapshot, types) against the one before on the same route."""
    w = Window.partitionBy("entrypoint").orderBy("snapshot")
    before = F.lag("types").over(w)
    s = snapshots.withColumn("before", before)
    minus = lambda p, q: F.array_join(F.array_sort(F.array_except(p, q)), ",")
    return s.select("entrypoint", "snapshot", F.coalesce(minus("before", "types"), F.lit("")).alias("lost"), F.when(F.col("before").isNull(), "").otherwise(minus("types", "before")).alias("gained"))
