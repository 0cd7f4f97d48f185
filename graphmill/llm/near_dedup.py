"""Near-duplicate documents by a similarity join over trees of minwise hashes.

Every tree draws four hash functions, one a level, and a document goes to the one node that is named by the shingles least under
all four, so two documents of similarity s part with probability 1 - s a level.  All nodes lie at that depth: none stops earlier, and a document has
one path a tree.  Nodes are compared exhaustively; large ones branch further by the rarest shingles of their members.  Independent trees
repeat this until the recall aimed at is reached.  Every link is confirmed on the full shingle sets.
"""
from __future__ import annotations

import hashlib
import math
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import boxed, materialize, release, small_batches, table
from .near import Comparer, alike, distinct, similarity_components

WIDTH, PERCENT = 3, 85
#: levels of a tree
LEVELS = 4
#: share of links of exactly the least similarity that is aimed at
RECALL = 0.9999
SEED = 20240607


def trees_for(percent: int, recall: float = RECALL, levels: int = LEVELS) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - (percent / 100) ** levels))


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()  # bytes: A-Z and the six blanks of ASCII only


def shingles(w: list[bytes], width: int) -> set:
    if not w:
        return set()
    if len(w) < width:
        return {tuple(w)}
    return set(zip(*(w[i:] for i in range(width))))


def _set_of(width: int, text: str) -> set:
    return shingles(words(text.encode("utf-8", "surrogatepass")), width)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class Seen(dict):
    """Hashes of words, of which so many are remembered."""

    def __missing__(self, x: bytes) -> int:
        v = xxhash.xxh3_64_intdigest(x)
        if len(self) < 500_000:
            self[x] = v
        return v


def _hashes(w: list[bytes], width: int, seen: Seen) -> np.ndarray:
    """Distinct 64-bit hashes of the shingles, sorted."""
    if not w:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(seen.__getitem__, w), np.uint64, len(w))
    if len(w) < width:
        return np.array([xxhash.xxh3_64_intdigest(b"\n".join(w), 1)], np.uint64)
    n = len(w) - width + 1
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k:k + n])
    return distinct(out)


def _least(s: np.ndarray, odd: np.ndarray) -> np.ndarray:
    """The least hash under each function; long sets go in blocks, so memory is bounded."""
    out = np.full(len(odd), np.uint64(0xFFFFFFFFFFFFFFFF))
    step = max(1, 2_000_000 // len(odd))
    for i in range(0, len(s), step):
        np.minimum(out, (s[None, i:i + step] * odd[:, None]).min(1), out=out)
    return out


def _sign(width: int, trees: int):
    def run(batches):
        odd = np.random.default_rng(SEED).integers(0, 1 << 63, trees * LEVELS, np.uint64) * np.uint64(2) + np.uint64(1)
        salt = np.arange(1, trees + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)
        seen = Seen()
        for b in batches:
            n, digests, keys = [], [], []
            for t in b.column(1).cast(pa.binary()).to_pylist():
                s = _hashes(words(t), width, seen)
                n.append(len(s))
                if not len(s):
                    digests.append(None)
                    keys.append(None)
                    continue
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                m = _mix(_least(s, odd)).reshape(trees, LEVELS)
                key = salt.copy()
                for k in range(LEVELS):
                    key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + m[:, k])
                keys.append(key.astype("<u8").tobytes())
            yield pa.record_batch([b.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.binary())], names=["doc_id", "n_shingles", "digest", "keys"])
    return run


def _nodes(trees: int):
    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            ids = np.repeat(np.asarray(b.column(0)), trees)
            key = np.concatenate([np.frombuffer(x, "<i8", trees) for x in b.column(1).to_pylist()])
            yield pa.record_batch([pa.array(key), pa.array(ids)], names=["key", "id"])
    return run


def _confirm(width: int, percent: int):
    def run(batches):
        held, own = None, set()
        for b in batches:
            keep = []
            for i, (a, ta, tb) in enumerate(zip(b.column(0).to_pylist(), b.column(2).cast(pa.binary()).to_pylist(), b.column(3).cast(pa.binary()).to_pylist())):
                if a != held:
                    held, own = a, shingles(words(ta), width)
                if alike(own, shingles(words(tb), width), percent):
                    keep.append(i)
            if keep:
                yield b.select(["a", "b"]).take(pa.array(keep))
    return run


def pair_check(contents: DataFrame, confirm) -> "callable":
    """(a, b) -> those that hold, by their contents (id, text)."""
    def check(pairs: DataFrame) -> DataFrame:
        ta = contents.select(F.col("id").alias("a"), F.col("text").alias("ta"))
        tb = contents.select(F.col("id").alias("b"), F.col("text").alias("tb"))
        both = pairs.join(tb, "b").join(ta, "a").select("a", "b", "ta", "tb").sortWithinPartitions("a")
        return both.mapInArrow(confirm, "a long, b long")
    return check


def near_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, recall: float = RECALL) -> DataFrame:
    """doc_id, n_shingles, component_id, kept.

    A document of fewer than ``width`` words has its whole sequence as its one shingle; without words it has none, and is
    linked with nothing.  Null text is the empty text.  Documents of equal sets are one vertex, named by their least doc_id.  Rows
    repeated with one doc_id are one document.  A row without doc_id is linked with nothing and has no component.
    """
    spark = docs.sparkSession
    small_batches(spark)
    trees = trees_for(percent, recall)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = materialize(rows.mapInArrow(_sign(width, trees), "doc_id long, n_shingles long, digest binary, keys binary"), "near-signed")
    reps = materialize(signed.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("keys").alias("keys")), "near-reps")
    release(spark)
    keyed = reps.select("rep", "keys").mapInArrow(_nodes(trees), "key long, id long")

    def verifier(ids):
        wanted = rows.join(ids, F.col("doc_id") == F.col("id")).select("id", "text").dropDuplicates(["id"])
        contents = materialize(wanted, "near-texts")
        release(spark)
        return contents, pair_check(contents, _confirm(width, percent)), Comparer(partial(_set_of, width), percent, joining=True)

    comps = similarity_components(keyed, verifier, "near")
    named = reps.select("digest", "rep").join(comps.withColumnRenamed("id", "rep"), "rep", "left")
    named = named.select(F.col("digest").alias("d"), F.coalesce("component", "rep").alias("component"))
    out = signed.select("doc_id", "n_shingles", "digest").join(named, F.expr("digest = d and doc_id is not null"), "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.expr("doc_id is null or doc_id = component_id").alias("kept"))


def drop_near(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without those whose component has a smaller doc_id."""
    gone = near_components(docs, width, percent).where("not kept").select(F.col("doc_id").alias("gone")).distinct()
    return boxed(docs).join(gone, F.col("row.doc_id").cast("long") == F.col("gone"), "left_anti").select("row.*")


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents"))
