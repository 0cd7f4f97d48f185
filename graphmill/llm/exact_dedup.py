"""Exact deduplication by Grace hashing.

Every input partition collapses its own copies first, so a text that fills a third of the corpus is shuffled
once for each partition.  What is left is dealt out by hash and collapsed again.  Both passes use the
same operator: an open-addressing table that compares complete contents, and beyond its memory limit partition
files on the worker's own disk, partitioned again with other hash bits until each bucket fits.
"""
from __future__ import annotations

import hashlib
import os
import struct
import tempfile

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, partitions, release, small_batches, table

#: bytes of distinct content that a table holds before it spills
MEMORY = 64 << 20
#: spill files of one level
FANOUT = 16


class OpenTable:
    """Open addressing with linear probing; a slot names an entry, and equal hashes count as equal only if the contents are."""

    def __init__(self):
        self.slots = [-1] * 64
        self.entries: list[list] = []  # hash, content, largest id, count
        self.bytes = 0

    def add(self, h: int, content: bytes, top, n: int) -> None:
        slots, mask = self.slots, len(self.slots) - 1
        i = h & mask
        while (k := slots[i]) >= 0:
            e = self.entries[k]
            if e[0] == h and e[1] == content:
                if e[2] is None or (top is not None and top > e[2]):
                    e[2] = top
                e[3] += n
                return
            i = (i + 1) & mask
        slots[i] = len(self.entries)
        self.entries.append([h, content, top, n])
        self.bytes += len(content) + 120
        if len(self.entries) * 3 > len(slots) * 2:
            self._grow()

    def _grow(self) -> None:
        mask = len(self.slots) * 4 - 1
        self.slots = slots = [-1] * (mask + 1)
        for k, e in enumerate(self.entries):
            i = e[0] & mask
            while slots[i] >= 0:
                i = (i + 1) & mask
            slots[i] = k


class _Spill:
    """Partition files of one level; records are framed and compressed."""

    def __init__(self, where: str, level: int):
        self.level = level
        self.paths = [os.path.join(where, f"{level}-{os.urandom(4).hex()}-{i}") for i in range(FANOUT)]
        self.files = [zstandard.ZstdCompressor(1).stream_writer(open(p, "wb")) for p in self.paths]

    def put(self, h: int, content: bytes, top, n: int) -> None:
        f = self.files[(h >> (4 * (self.level + 4))) % FANOUT]  # other bits than those the table starts from
        f.write(struct.pack("<Qq?qq", h, top or 0, top is None, n, len(content)))
        f.write(content)

    def close(self) -> list[str]:
        for f in self.files:
            f.close()
        return self.paths


def _records(path: str):
    size = struct.calcsize("<Qq?qq")
    with open(path, "rb") as raw, zstandard.ZstdDecompressor().stream_reader(raw) as f:
        while head := f.read(size):
            h, top, none, n, length = struct.unpack("<Qq?qq", head)
            yield h, f.read(length) if length else b"", None if none else top, n


def grace(records, memory: int = MEMORY, level: int = 0, where: str | None = None):
    """(hash, content, id, count) -> distinct contents with the largest id and the sum of counts.

    ``level`` beyond 10 uses up the hash: such a bucket holds contents of equal hashes only and stays in memory.
    """
    if where is None:
        with tempfile.TemporaryDirectory() as where:
            yield from grace(records, memory, level, where)
        return
    held, spill = OpenTable(), None
    for h, content, top, n in records:
        if spill is not None:
            spill.put(h, content, top, n)
            continue
        held.add(h, content, top, n)
        if held.bytes > memory and level <= 10 and len(held.entries) > 1:
            spill = _Spill(where, level)
            for e in held.entries:
                spill.put(*e)
            held = OpenTable()
    if spill is None:
        yield from held.entries
        return
    for path in spill.close():
        yield from grace(_records(path), memory, level + 1, where)
        os.remove(path)


def _out(entries):
    size, rows = 0, []
    for e in entries:
        rows.append(e)
        size += len(e[1])
        if size > 4 << 20 or len(rows) >= 2000:
            yield _batch(rows)
            size, rows = 0, []
    if rows:
        yield _batch(rows)


def _batch(rows):
    return pa.record_batch([pa.array([r[1] for r in rows], pa.large_binary()).cast(pa.binary()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int64()), pa.array([hashlib.sha256(r[1]).digest() for r in rows], pa.binary())], names=["content", "top", "n", "digest"])


def _normal(value) -> bytes:
    return b"" if value is None else value.lower()  # bytes.lower() changes A-Z only


def _key(content: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(content, digest_size=8).digest(), "little")


def _collapse_rows(memory):
    def run(batches):
        def records():
            for b in batches:
                for i, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                    c = _normal(t)
                    yield _key(c), c, i, 1
        yield from _out(grace(records(), memory))
    return run


def _collapse_partials(memory):
    def run(batches):
        def records():
            for b in batches:
                for c, top, n in zip(*(b.column(k).to_pylist() for k in range(3))):
                    yield _key(c), c, top, n
        for out in _out(grace(records(), memory)):
            yield out.select(["digest", "top", "n"])
    return run


def _digests(batches):
    for b in batches:
        yield pa.record_batch([b.column(0), pa.array([hashlib.sha256(_normal(t)).digest() for t in b.column(1).cast(pa.binary()).to_pylist()], pa.binary())], names=["doc_id", "digest"])


def exact_dedup(docs: DataFrame, memory: int = MEMORY) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text).

    Texts are equal when identical after lower-casing A-Z; null counts as the empty text.  The largest doc_id of a
    group stays; a group without any doc_id keeps null.  Rows repeated with the same doc_id all count in group_size,
    and each carries kept.  Other columns are not looked at.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    partial = rows.mapInArrow(_collapse_rows(memory), "content binary, top long, n long, digest binary")
    groups = partial.repartition(partitions(spark), "digest").mapInArrow(_collapse_partials(memory), "digest binary, top long, n long")
    groups = materialize(groups.select("digest", F.col("top").alias("keep_id"), F.col("n").alias("group_size")), "exact")
    release(spark)
    own = rows.mapInArrow(_digests, "doc_id long, digest binary")
    return own.join(groups, "digest").select("doc_id", "keep_id", "group_size", F.expr("doc_id <=> keep_id").alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def op9_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents"))


OP9_SQL = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""
