"""Prefix tries of conversations.

Turns become digests, so texts are left behind at once; conversations that are equal throughout are counted and their ids
hashed, as a stream in sorted order, and one of them stands for all.  Those are dealt out by the digest of their first
turn to buckets that a task can hold, and each bucket becomes a trie of dictionaries and parent pointers that is folded from the leaves up
without recursion.  A first turn with more turns below it than a task may hold isn't built there: its conversations are dealt out
again by the next turn, as often as it takes, and the nodes above the cut are folded by Spark from what lies below.
"""
from __future__ import annotations

import hashlib
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release, table

#: conversations of a family, and first turns shared at most
FAMILY, SHARED = 5, 9
#: turns that one task builds a trie of
TURNS = 200_000
#: ids that are joined into one piece of text before hashing
PIECE = 4096

NODE = "conv_id long, depth long, parent_conv_id long, above binary, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
NO_ENDS = hashlib.sha256(b"").hexdigest()


def _digest(*parts) -> F.Column:
    return F.substring(F.unhex(F.sha2(F.concat(*parts), 256)), 1, 16)


def rebuilt(turns: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) -> conv_id, steps (a digest a turn), sizes (bytes of its text), after the families' first turns are shared."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    own = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), _digest(F.encode(F.length(role).cast("string"), "utf-8"), F.encode(F.lit(" "), "utf-8"), F.encode(role, "utf-8"), F.encode(text, "utf-8")).alias("step"), F.octet_length(text).cast("long").alias("bytes"))
    order = F.array_sort(F.collect_list(F.struct(F.coalesce("turn", F.lit(-2**63)).alias("turn"), F.col("turn").isNotNull().alias("numbered"), "step", "bytes")))
    whole = materialize(own.groupBy("conv_id").agg(order.alias("turns")).select("conv_id", F.transform("turns", lambda t: F.struct(t["step"].alias("step"), t["bytes"].alias("bytes"))).alias("turns")), "turns")
    heads = whole.select(F.col("conv_id").alias("base"), F.slice("turns", 1, SHARED - 1).alias("head"))
    c = whole.select("conv_id", "turns", (F.crc32(F.col("conv_id").cast("string")) % SHARED).cast("int").alias("h"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"))
    x = c.join(heads, "base", "left")
    all_ = F.concat(F.slice(F.coalesce("head", F.array().cast(whole.schema["turns"].dataType)), F.lit(1), F.col("h")), F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0))))
    return x.select("conv_id", all_.alias("turns")).select("conv_id", F.col("turns.step").alias("steps"), F.col("turns.bytes").alias("sizes"))


def _pieces(batches):
    """Rows sorted by (whole, conv_id): for each run of one sequence, its ids joined, in pieces."""
    key, ids = None, []

    def piece():
        return key, ids[0], len(ids), ",".join(map(str, ids))

    for b in batches:
        out = []
        for k, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if ids and (k != key or len(ids) == PIECE):
                out.append(piece())
                ids = []
            key = k
            ids.append(c)
        yield _table(out)
    if ids:
        yield _table([piece()])


def _table(rows):
    kinds = (("whole", pa.binary()), ("first", pa.int64()), ("n", pa.int64()), ("ids", pa.string()))
    return pa.record_batch([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(kinds)], names=[n for n, _ in kinds])


def _hashed(batches):
    """Pieces sorted by (whole, first): least id, number and hash of each sequence's ids; one hash is open at a time."""
    key, least, n, h = None, None, 0, None

    def row():
        return key, least, n, h.hexdigest()

    for b in batches:
        out = []
        for k, first, m, ids in zip(*(b.column(i).to_pylist() for i in range(4))):
            if h is None or k != key:
                if h is not None:
                    out.append(row())
                key, least, n, h = k, first, m, hashlib.sha256(ids.encode())
            else:
                n += m
                h.update(b"," + ids.encode())
        yield _table(out).rename_columns(["whole", "conv_id", "n", "ends"])
    if h is not None:
        yield _table([row()]).rename_columns(["whole", "conv_id", "n", "ends"])


def distinct_sequences(convs: DataFrame) -> DataFrame:
    """One row a sequence: conv_id (the least), n conversations, ends (the hash of all their ids), steps, sizes. Groups of copies of any size pass as a stream."""
    spark = convs.sparkSession
    c = materialize(convs.withColumn("whole", _digest(F.array_join(F.transform("steps", F.hex), " "))), "conversations")
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ids = c.select("whole", "conv_id").repartitionByRange(n, "whole", "conv_id").sortWithinPartitions("whole", "conv_id").mapInArrow(_pieces, "whole binary, first long, n long, ids string")
    ends = ids.repartition(n, "whole").sortWithinPartitions("whole", "first").mapInArrow(_hashed, "whole binary, conv_id long, n long, ends string")
    out = materialize(ends.join(c, ["whole", "conv_id"]).select("conv_id", "n", "ends", "steps", "sizes"), "sequences")
    release(spark)
    return out


def fold(depth: int, rows) -> list[tuple]:
    """The nodes of one trie or several: rows (conv_id, n, ends, steps, sizes, above), built from turn ``depth`` on.

    Nodes stand in arrays, each after its parent, so that one pass from the last to the first is a postorder.
    """
    tops: dict = {}
    children, parent, least, convs, size, level, end, roof = [], [], [], [], [], [], [], []
    for conv, n, ends, steps, sizes, above in rows:
        at, here = -1, tops
        for d in range(depth - 1, len(steps)):
            k = (above, steps[d]) if at < 0 else steps[d]
            found = here.get(k)
            if found is None:
                found = here[k] = len(parent)
                for column, value in ((children, {}), (parent, at), (least, conv), (convs, 0), (size, sizes[d]), (level, d + 1), (end, NO_ENDS), (roof, above)):
                    column.append(value)
            at, here = found, children[found]
            convs[at] += n
            least[at] = min(least[at], conv)
        end[at] = ends
    leaves, saved = [0] * len(parent), [0] * len(parent)
    out = []
    for at in range(len(parent) - 1, -1, -1):
        leaves[at] = leaves[at] or 1
        saved[at] += (convs[at] - 1) * size[at]
        up = parent[at]
        if up >= 0:
            leaves[up] += leaves[at]
            saved[up] += saved[at]
        out.append((least[at], level[at], least[up] if up >= 0 else None, roof[at] if up < 0 else None, convs[at], len(children[at]), leaves[at], saved[at], end[at]))
    return out


def _built(depth: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        rows = zip(frame["conv_id"], frame["n"], frame["ends"], frame["steps"], frame["sizes"], frame["above"])
        return pd.DataFrame(fold(depth, rows), columns=[c.split()[0] for c in NODE.split(", ")]).astype({"parent_conv_id": "Int64"})
    return run


def prefix_trie(turns: DataFrame, most: int = TURNS) -> DataFrame:
    """Every node of the trie of rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Null role or text is the empty string; turns without conv_id belong to no conversation and go; turns of one number (null ones are first)
    stand by their digests (of the SHA-256 of role and text), and repeated turns are turns of their own.  An empty table has no root and gives no rows.
    Extra columns are not looked at.  ``most`` bounds the turns that are built into a trie at once.  A conversation's own turns, as
    digests of 16 bytes, must fit a task.
    """
    spark = turns.sparkSession
    now = distinct_sequences(rebuilt(turns)).select("*", F.lit(None).cast("binary").alias("above"), F.lit(b"").alias("key"))
    built, upper, depth = [], [], 0
    while True:  # ``now``: conversations below nodes at ``depth`` (by key) that are too large for a task; at depth 0 that is the root
        here = now.groupBy("key").agg(F.first("above").alias("above"), F.min("conv_id").alias("conv_id"), F.sum("n").alias("n_convs"), F.max(F.get("sizes", F.lit(depth - 1)) if depth else F.lit(0)).alias("bytes"), F.max(F.when(F.size("steps") == depth, F.col("ends"))).alias("ends"))
        upper.append(materialize(here, f"upper-{depth}"))
        depth += 1
        step = F.get("steps", F.lit(depth - 1))
        deeper = now.where(F.size("steps") >= depth).withColumns({"above": F.col("key"), "key": _digest(F.col("key"), step)})
        load = deeper.groupBy("key").agg(F.sum(F.size("steps") - (depth - 1)).alias("load"), F.count("*").alias("rows"))
        load = materialize(load, f"load-{depth}")
        large = load.where((F.col("load") > most) & (F.col("rows") > 1)).select("key")
        total, big = load.where((F.col("load") <= most) | (F.col("rows") == 1)).agg(F.coalesce(F.sum("load"), F.lit(0))).first()[0], large.count()
        some = F.broadcast(large) if big <= 100_000 else large  # 16 bytes each
        fits = deeper.join(some, "key", "left_anti") if big else deeper
        if total:
            buckets = -(-2 * total // most)
            dealt = fits.select("conv_id", "n", "ends", "steps", "sizes", "above", F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket"))
            built.append(materialize(dealt.groupBy("bucket").applyInPandas(_built(depth), NODE), f"nodes-{depth}"))
        if not big:
            break
        now = materialize(deeper.join(some, "key", "left_semi"), f"open-{depth}")
        release(spark)
    return _joined(built, upper)


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _joined(built: list[DataFrame], upper: list[DataFrame]) -> DataFrame:
    """Fold the nodes above the cuts, deepest first, and give every top of a built trie, and every such node, its parent's name."""
    keyed = "above", "conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    loose = [b.where("above is not null").select(*keyed) for b in built]
    names = []
    for depth in range(len(upper) - 1, -1, -1):
        u = upper[depth]
        if loose:
            sums = _union(loose).where(F.col("depth") == depth + 1).groupBy(F.col("above").alias("key")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
            u = u.join(sums, "key", "left")
        else:
            u = u.withColumns({c: F.lit(None).cast("long") for c in ("n_children", "leaves", "saved")})
        folded = materialize(u.select(
            "key", "above", "conv_id", F.lit(depth).cast("long").alias("depth"), "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("leaves", F.lit(1)).alias("n_leaves"),
            (F.coalesce("saved", F.lit(0)) + (F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens"), F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256")), f"folded-{depth}")
        loose.append(folded.select(*keyed))
        names.append(folded.select(F.col("key").alias("above"), F.col("conv_id").alias("parent_conv_id")))
    columns = "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    return _union([_union(loose).join(_union(names), "above", "left").select(*columns), *(b.where("above is null").select(*columns) for b in built)])


def op12_prefix_trie(spark, sf_dir):
    return prefix_trie(table(spark, sf_dir, "conversations"))


OP12_SQL = """
WITH RECURSIVE table_ AS MATERIALIZED (
  SELECT list(list_reduce(list_concat([i], range(8)), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) ORDER BY i) AS t FROM (SELECT unnest(range(256)) AS i)),
own AS MATERIALIZED (
  SELECT conv_id, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) ORDER BY turn NULLS FIRST, sha256(concat(length(coalesce(role, '')), ' ', role, text))) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
share AS (
  SELECT conv_id, turns, conv_id - conv_id % 5 AS base,
         xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda a, b: xor(a // 256, t[1 + xor(a, b) % 256])), 4294967295) % 9 AS h
  FROM own, table_),
whole AS MATERIALIZED (
  SELECT s.conv_id, list_concat(coalesce(b.turns, [])[1:h], s.turns[h + 1:]) AS turns FROM share s LEFT JOIN own b ON b.conv_id = s.base),
prefix AS (SELECT conv_id, len(turns) AS n, turns, unnest(range(len(turns) + 1)) AS depth FROM whole),
node AS MATERIALIZED (
  SELECT depth, turns[1:depth] AS p, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256
  FROM prefix GROUP BY 1, 2),
named AS MATERIALIZED (
  SELECT n.*, u.conv_id AS parent_conv_id FROM node n LEFT JOIN node u ON u.depth = n.depth - 1 AND u.p = n.p[1:n.depth - 1]),
children AS (SELECT depth - 1 AS depth, parent_conv_id AS conv_id, count(*) AS n_children FROM named WHERE depth > 0 GROUP BY 1, 2),
fact AS MATERIALIZED (
  SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * strlen(p[depth].t) END AS saved
  FROM named n LEFT JOIN children USING (depth, conv_id)),
up AS (
  SELECT depth, conv_id, parent_conv_id, n_children, saved, depth AS level, conv_id AS c, parent_conv_id AS up FROM fact
  UNION ALL
  SELECT x.depth, x.conv_id, x.parent_conv_id, x.n_children, x.saved, f.depth, f.conv_id, f.parent_conv_id FROM up x JOIN fact f ON f.depth = x.level - 1 AND f.conv_id = x.up),
sums AS (SELECT level AS depth, c AS conv_id, count(*) FILTER (n_children = 0) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM up GROUP BY 1, 2)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 FROM fact JOIN sums USING (depth, conv_id)
"""
