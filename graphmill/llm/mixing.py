"""Mixing sources to target weights along a time-varying curriculum, in DataFrame operations only.

Each source has a weight schedule over the training time 0..1.  Its integral is the source's demand of tokens up to a
time; inverting that gives the time at which a document's first token is due.  Sorting by that time interleaves the sources
so that at any time their tokens follow the schedule.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import boxed, materialize, table

WORDS = r"[^\x20\x09-\x0D]+"
#: weights given to sources in code-point order, repeating
CYCLE = (5, 2, 1)
#: tokens of the mix as a share of all tokens, in halves (3 halves: 150 %)
HALVES = 3
#: a source is taken at most so many times
MOST = 2
#: tilt of the schedules: a source's weight runs from 1 + tilt to 1 - tilt of its mean; the cycle's sources differ
TILTS = (0.5, 0.0, -0.5)
#: hash buckets in which a source's running sums are built, at least, and rows for which there is one; a hot source spreads over all of them
BUCKETS, BUCKET_ROWS = 512, 50_000


def targets(sizes: DataFrame, halves: int = HALVES, most: int = MOST) -> DataFrame:
    """(source, source_size) -> source, source_size, target, rank.  Sources by code point, null last.

    Water filling in closed form: by rising cap per weight, a source is capped if its cap per weight is at most the
    share that is left for it and those after it; the others split what the caps leave.  The table has a row a source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*(F.lit(w) for w in CYCLE))
    s = sizes.withColumn("rank", (F.row_number().over(by_name) - 1).cast("int"))
    s = s.withColumn("weight", F.element_at(cycle, F.col("rank") % len(CYCLE) + 1).cast("long")).withColumn("cap", most * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before, after, whole = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    s = s.withColumn("left2", halves * F.sum("source_size").over(whole) - 2 * F.coalesce(F.sum("cap").over(before), F.lit(0)))
    s = s.withColumn("wleft", F.sum("weight").over(after))
    s = s.withColumn("capped", F.col("cap") * 2 * F.col("wleft") <= F.col("left2") * F.col("weight"))
    free = F.sum(F.when(~F.col("capped"), F.col("weight"))).over(whole)
    rest = halves * F.sum("source_size").over(whole) - 2 * F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(whole), F.lit(0))
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise((F.col("weight") * rest).cast("double") / (2 * free).cast("double"))
    return s.select("source", "source_size", target.alias("target"), "rank")


def due(tilt: Column, demand: Column, at: Column) -> Column:
    """The time t at which the demand integral reaches ``at``: with weight demand * (1 + a * (1 - 2 t)), the integral is demand * (t + a * t * (1 - t))."""
    x = F.when(demand > 0, F.least(at / demand, F.lit(1.0))).otherwise(F.lit(0.0))
    b = F.lit(1.0) + tilt
    root = F.sqrt(F.greatest(b * b - 4 * tilt * x, F.lit(0.0)))
    return F.when(tilt == 0, x).otherwise(2 * x / (b + root))


def _buckets(docs: DataFrame) -> int:
    return max(BUCKETS, docs.count() // BUCKET_ROWS)


def _sized(docs: DataFrame) -> DataFrame:
    d = boxed(docs).select("row", F.col("row.doc_id").cast("long").alias("doc_id"), F.col("row.source").alias("source"), F.coalesce(F.expr(f"regexp_count(row.text, r'{WORDS}')"), F.lit(0)).cast("long").alias("size"), F.xxhash64("row.text").alias("rid"))
    return d.withColumn("h", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def _planned(d: DataFrame, buckets: int) -> DataFrame:
    """Rows (doc_id, source, size, rid, h and whatever else) with source_size, target, taken, position and again."""
    d = d.withColumn("bucket", F.shiftright(F.conv(F.substring("h", 1, 8), 16, 10).cast("long") * buckets, 32).cast("int"))
    sums = d.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    goals = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")))
    by_bucket = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("start", F.coalesce(F.sum("words").over(by_bucket), F.lit(0)))
    starts = starts.alias("a").join(goals.alias("g"), F.expr("a.source <=> g.source")).select("a.source", "bucket", "start", "source_size", "target", "rank")
    # the join and the window go by the same columns, none of them null, so that rows are shuffled once for both
    key = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")).alias("key")
    starts = starts.select(key.alias("key2"), F.col("bucket").alias("bucket2"), "start", "source_size", "target", "rank")
    inside = Window.partitionBy("key", "bucket").orderBy("h", "doc_id", "size", "rid").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("key", key).join(starts, F.expr("key = key2 and bucket = bucket2"))
    d = d.withColumn("at", F.col("start") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    goal = F.round("target").cast("long")
    d = d.withColumn("taken", sum(F.greatest(F.lit(0), F.least("size", goal - k * F.col("source_size") - F.col("at"))) for k in range(MOST)))
    tilt = F.element_at(F.array(*(F.lit(t) for t in TILTS)), F.col("rank") % len(TILTS) + 1)
    d = d.withColumn("position", F.when(F.col("taken") > 0, due(tilt, F.col("target"), F.col("at").cast("double"))))
    return d.withColumn("again", F.when(F.col("taken") > F.col("size"), due(tilt, F.col("target"), (F.col("at") + F.col("source_size")).cast("double"))))


def plan_mix(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, position, again of every document.

    size: words; null text: 0.  A source's documents stand in the order of a hash of doc_id (then doc_id, size and a hash of the
    text).  Its target is laid along that order, over and over: each whole pass takes each document once, and the last pass ends where the
    target does, inside a document if need be.  So taken words add up to the target rounded, and no document passes
    twice its size.  position, again: the times in 0..1 of its first word when it is first and next taken; null where it isn't.
    Repeated rows are documents of their own.  An empty table gives no rows; a null source is a source.  The texts are read once.
    """
    d = materialize(_sized(docs).drop("row"), "sizes")
    return _planned(d, buckets or _buckets(d)).select("doc_id", "source", "size", "source_size", "target", "taken", "position", "again")


def mix(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """The training sequence: the columns of ``docs``, a row for each time a document is taken, range-sorted by position.

    Documents are planned as by ``plan_mix``, each row by itself, so repeated rows and other rows of one doc_id are taken as
    planned.  A document that the target cuts keeps its first words only, with their white space.  What is not taken goes.
    """
    use = F.expr("filter(array(struct(position as position, least(taken, size) as words), struct(again as position, taken - size as words)), x -> x.words > 0)")
    out = _planned(_sized(docs), buckets or _buckets(docs)).where("taken > 0").select("row", "doc_id", "size", F.explode(use).alias("use"))
    cut = F.expr(r"array_join(slice(split(row.text, '(?<=[^\\x20\\x09-\\x0D])(?=[\\x20\\x09-\\x0D])'), 1, cast(use.words as int)), '')")
    out = out.select(F.col("row").withField("text", F.when(F.col("use.words") < F.col("size"), cut).otherwise(F.col("row.text"))).alias("row"), F.col("use.position").alias("position"), "doc_id")
    return out.repartitionByRange(F.col("position"), F.col("doc_id")).sortWithinPartitions("position", "doc_id").select("row.*")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = plan_mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "position")
    return out.repartitionByRange(F.col("position").asc_nulls_last(), F.col("doc_id")).sortWithinPartitions(F.col("position").asc_nulls_last(), "doc_id")


_TILT_SQL = "CASE rank % 3 WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 0.0::DOUBLE ELSE -0.5::DOUBLE END"
OP4_SQL = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(doc_id::VARCHAR) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM s),
c AS (SELECT *, (CASE rank % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END)::BIGINT AS weight, 2 * source_size AS cap FROM w),
o AS (SELECT *, 3 * (SELECT sum(source_size) FROM c) - 2 * coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left2,
      sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS wleft FROM c),
k AS (SELECT *, cap * 2 * wleft <= left2 * weight AS capped FROM o),
t AS (SELECT source, source_size, rank, CASE WHEN capped THEN cap::DOUBLE ELSE
      (weight * (3 * (SELECT sum(source_size) FROM k) - 2 * coalesce((SELECT sum(cap) FROM k WHERE capped), 0)))::DOUBLE / (2 * (SELECT sum(weight) FROM k WHERE NOT capped))::DOUBLE END AS target FROM k),
a AS (SELECT doc_id, size, source_size, target, rank, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
g AS (SELECT *, (greatest(0, least(size, round(target)::BIGINT - pos)) + greatest(0, least(size, round(target)::BIGINT - source_size - pos)))::BIGINT AS taken, {_TILT_SQL} AS tilt, least(pos::DOUBLE / target, 1.0::DOUBLE) AS x FROM a)
SELECT doc_id, size, source_size, target, taken,
  CASE WHEN taken > 0 THEN CASE WHEN tilt = 0 THEN x ELSE 2 * x / (1.0::DOUBLE + tilt + sqrt(greatest((1.0::DOUBLE + tilt) * (1.0::DOUBLE + tilt) - 4 * tilt * x, 0.0::DOUBLE))) END END AS position
FROM g
"""
