"""Harmonic packing of token sequences.

Lengths fall into reciprocal-capacity classes: class j holds lengths of capacity // j, and a bin of the class takes j of
them.  As documents may be cut, each is cut into lengths that lie exactly on a class: the largest class length that
fits, then the same for what is left.  A bin of class j then wastes fewer than j tokens.  Classes fill their bins independently: a piece's
rank within its class is its place, so no worker waits for another.
"""
from __future__ import annotations

import heapq
import sys
import types
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, release, small_batches, table

CAPACITY = 4096
END = 2
#: hash buckets over which the ranks of a class are counted, at least, and pieces for which there is one
BUCKETS, BUCKET_PIECES = 256, 50_000
#: words whose ids a worker remembers
WORDS = 400_000


def cuts(total: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of the pieces of ``total`` ids, all on classes; 3 or 4 after the whole bins."""
    out = [capacity] * (total // capacity)
    rest = total % capacity
    while rest:
        out.append(capacity // -(-capacity // rest))
        rest -= out[-1]
    return out


class WordIds:
    """Ids of a text, word by word: no token of this tokenizer spans white space, so words are encoded once and remembered."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.own = Tokenizer.from_file(path)
        self.seen: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        return np.asarray(self.own.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # white space to Python, not to the tokenizer
            return self.encode(text)
        seen, out = self.seen, []
        for w in text.split():
            ids = seen.get(w)
            if ids is None:
                ids = self.encode(w)
                if len(seen) < WORDS and len(w) < 64:
                    seen[w] = ids
            out.append(ids)
        return b"".join(out)


def _tokenizer(path: str) -> WordIds:
    """One for each worker process, kept between tasks."""
    held = sys.modules.setdefault("_graphmill_tokenizers", types.ModuleType("_graphmill_tokenizers")).__dict__
    if path not in held:
        held[path] = WordIds(path)
    return held[path]


def _pieces(path: str, capacity: int, end: int):
    def run(batches):
        encode, stop = _tokenizer(path), np.asarray([end], "<u4").tobytes()
        for b in batches:
            cols: list[list] = [[], [], [], [], []]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = encode(text or "") + stop
                at, total = 0, len(ids) // 4
                view = memoryview(ids)
                for n in cuts(total, capacity):
                    for c, v in zip(cols, (doc, at, n, zlib.crc32(view[4 * at:4 * (at + n)]), total)):
                        c.append(v)
                    at += n
            yield pa.record_batch([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
    return run


def _fit(capacity: int):
    """First-fit decreasing by best remaining room for the last, incomplete bin of each class: a bounded number of pieces."""
    def run(batches):
        rows = [r for b in batches for r in b.to_pylist()]
        rows.sort(key=lambda r: (-r["length"], r["doc_id"] is None, r["doc_id"] or 0, r["start"], r["ids_crc32"]))
        room: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by free tokens
        sizes: list[int] = []
        free: list[int] = []  # kinds of room in use
        out = []
        for r in rows:
            n = r["length"]
            spare = []
            while free and (free[0] < n or not room[free[0]]):
                k = heapq.heappop(free)
                if room[k]:
                    spare.append(k)
            if free:
                k = free[0]
                i = room[k].pop()
            else:
                i, k = len(sizes), capacity
                sizes.append(0)
            for s in spare:
                heapq.heappush(free, s)
            out.append((r, i, sizes[i]))
            sizes[i] += n
            if (left := k - n):
                if not room[left] and left not in free:
                    heapq.heappush(free, left)
                room[left].append(i)
        if out:
            yield pa.record_batch([pa.array([r[c] for r, _, _ in out], pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")] + [pa.array([i for _, i, _ in out], pa.int64()), pa.array([o for _, _, o in out], pa.int64())], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
    return run


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end: int = END, buckets: int | None = None) -> DataFrame:
    """A row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text has the end id alone.  Repeated rows are packed as often as they stand there.  The pieces that
    fill whole bins of their class are placed by rank; those of each class's last bin, fewer than ``capacity`` for each of
    at most 2 * sqrt(capacity) classes whatever the input, go to one task that fits them together.  Empty table: no rows.
    """
    if tokenizer is None:
        import public_tokenizers
        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    spark = docs.sparkSession
    small_batches(spark)
    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_pieces(tokenizer, capacity, end), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")
    p = materialize(made, "pieces")
    buckets = buckets or max(BUCKETS, p.count() // BUCKET_PIECES)
    p = p.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)).cast("int"))
    release(spark)
    counts = p.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    run = Window.partitionBy("length").orderBy("bucket")
    counts = counts.select("length", "bucket", (F.sum("n").over(run) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy("length")).alias("all"))
    fill = F.expr(f"{capacity} div length")
    counts = counts.withColumn("bins", F.expr(f"all div ({capacity} div length)"))
    classes = counts.select("length", "bins").distinct()
    classes = classes.select("length", (F.sum("bins").over(Window.orderBy(F.desc("length"))) - F.col("bins")).alias("base"), F.sum("bins").over(Window.partitionBy()).alias("whole"))
    # shuffled as the window below wants it
    q = p.join(counts.join(F.broadcast(classes), "length"), ["length", "bucket"])
    rank = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32")) - 1 + F.col("before")
    q = q.withColumn("rank", rank).withColumn("bin", F.expr("rank div " + f"({capacity} div length)"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    placed = q.where("bin < bins").select(*names, (F.col("base") + F.col("bin")).alias("sequence_id"), (F.col("rank") % fill * F.col("length")).alias("offset"))
    last = q.where("bin >= bins")
    fitted = last.select(*names).repartition(1).mapInArrow(_fit(capacity), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    whole = classes.agg(F.max("whole").alias("whole"))
    fitted = fitted.crossJoin(F.broadcast(whole)).select(*names, (F.col("sequence_id") + F.col("whole")).alias("sequence_id"), "offset")
    return placed.union(fitted)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
