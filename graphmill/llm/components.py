"""Connected components by distributed union-find: forests within partitions, then alternating star contraction."""
from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, materialize


def forest(batches):
    """Union-find over the edges of one partition; a star edge (node, root) for each node that isn't a root."""
    parent: dict[int, int] = {}

    def find(x):
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while x != root:
            parent[x], x = root, parent.get(x, x)
        return root

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ra, rb = find(a), find(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
                parent.setdefault(min(ra, rb), min(ra, rb))
    rows = [(x, r) for x in list(parent) if (r := find(x)) != x]
    step = 50_000
    for i in range(0, len(rows), step):
        part = rows[i:i + step]
        yield pa.record_batch([pa.array([x[0] for x in part], pa.int64()), pa.array([x[1] for x in part], pa.int64())], names=["u", "v"])


def _stars(e: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges u > v; the result has u > v again."""
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select("u", F.least("u", "m").alias("m"))
    large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return low.select("u", F.col("m").alias("v")).union(small).where("u <> v").distinct()


def connected_components(edges: DataFrame, label: str = "cc", max_rounds: int = 40) -> DataFrame:
    """``edges`` (a, b: long) -> (id, component) for every id of an edge; component is the least id reachable.

    Null ends and loops are ignored; no edges give no rows.  Each round writes its edges to the
    shared folder.  Only two numbers come to the driver in a round.  Hub vertices are safe: the minimum
    is aggregated before the shuffle and adaptive execution splits the joins.
    """
    a, b = edges.columns[:2]
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"`{a}` is not null and `{b}` is not null and `{a}` <> `{b}`").distinct()
    now = materialize(pairs.mapInArrow(forest, "u long, v long"), label)
    mark = None
    for _ in range(max_rounds):
        sums = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sums[0] == 0 or sums == mark:
            break
        mark = sums
        after = materialize(_stars(now), label)
        drop(now)
        now = after
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)
