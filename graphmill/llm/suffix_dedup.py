"""Removal of long repeated byte strings with a logarithmic family of sorted fingerprints.

Places are sampled by content: of every 200-byte window the least 64-byte string under a hash is its anchor, so equal
windows have equal anchors at equal places.  Windows of one anchor that stand side by side make a segment.  Pairs of hashes (anchor,
whole segment), dealt out by anchor, go to families of levels inside a task: a batch is sorted by hash, looked up in the levels
there are, and levels of like size merge.  No suffix is sorted by content, and equality rests on 64-bit hashes.  Segments met twice as a whole are
repeats; those that share their anchor with other segments only are compared by the sorted hashes of all windows of the anchor.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, materialize, partitions, release, small_batches, table

LENGTH, ANCHOR = 200, 64
#: entries that are collapsed together before they leave an input partition, and of a family's smallest level
GATHER, BATCH = 400_000, 65_536
#: windows that are compared together, and of one anchor before they are dealt out instead; a task holds no more than the sum
CHUNK, HOT = 300_000, 600_000
_PLACE = np.uint64((1 << 28) - 1)
_ODD = 0x9E3779B97F4A7C15
_U = np.uint64


def _mix(x, a):
    x = (x ^ (x >> _U(32))) * _U(a)
    x ^= x >> _U(29)
    x *= _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


class Powers:
    """Powers of an odd number and of its inverse modulo 2^64, as far as was asked for."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, _U)

    def get(self, n: int):
        if n > len(self.up):
            n = max(n, 2 * len(self.up), 1 << 16)
            self.up = np.cumprod(np.concatenate([[_U(1)], np.full(n - 1, self.base, _U)]), dtype=_U)
            self.down = np.cumprod(np.concatenate([[_U(1)], np.full(n - 1, self.inverse, _U)]), dtype=_U)
        return self.up, self.down


class Text:
    """Rolling hashes over one document's bytes: that of any substring of 8 bytes or more takes two lookups."""

    def __init__(self, data: bytes, powers: Powers, seed: int = 0xA0761D6478BD642F):
        b = np.frombuffer(data, np.uint8).astype(_U)
        w = b[:-1] | b[1:] << _U(8)
        w = w[:-2] | w[2:] << _U(16)
        w = w[:-4] | w[4:] << _U(32)
        self.words = _mix(w, seed)
        self.up, self.down = powers.get(len(w) + 1)
        self.sums = np.zeros(len(w) + 1, _U)
        np.cumsum(self.words * self.up[:len(w)], out=self.sums[1:])

    def hash(self, start, end):
        return _mix((self.sums[end - 7] - self.sums[start]) * self.down[start], _ODD)


def segments(data: bytes, powers: Powers):
    """(anchor hash, content hash, first window, number of windows) of each segment, or None for short texts."""
    n = len(data)
    if n < LENGTH:
        return None
    t = Text(data, powers)
    m = n - ANCHOR + 1
    g = np.zeros(m, _U)
    for k in range(0, ANCHOR, 8):
        g = g * _U(_ODD) + t.words[k:k + m]
    g = _mix(g, 0xE7037ED1A0B428DB)
    order = (g & ~_PLACE) | np.arange(m, dtype=_U)
    span = LENGTH - ANCHOR + 1
    pad = -m % span
    blocks = np.concatenate([order, np.full(pad, ~_U(0), _U)]).reshape(-1, span)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    last = n - LENGTH + 1
    anchor = (np.minimum(behind[:last], ahead[span - 1:span - 1 + last]) & _PLACE).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero(anchor[1:] != anchor[:-1]) + 1])
    count = np.diff(np.append(first, last))
    at = anchor[first]
    content = t.hash(first, first + count - 1 + LENGTH)
    content = _mix(content ^ (count.astype(_U) << _U(20)) ^ (at - first).astype(_U), 0x8EBC6AF09C88C6E3)
    return g[at], content, first, count


COLUMNS = ("h", "c", "n", "doc", "rid", "first", "count", "none")
SUFFIX = "h long, c long, n long, doc long, rid long, first int, count int, none boolean"


def combine(x: dict) -> dict:
    """Sort by suffix and make one entry of equal ones; the least place stands for them."""
    order = np.lexsort((x["first"], x["rid"], x["doc"], x["none"], x["c"], x["h"]))
    x = {k: v[order] for k, v in x.items()}
    head = np.ones(len(order), bool)
    head[1:] = (x["h"][1:] != x["h"][:-1]) | (x["c"][1:] != x["c"][:-1])
    at = np.flatnonzero(head)
    if len(at) == len(order):
        return x
    out = {k: v[at] for k, v in x.items()}
    out["n"] = np.add.reduceat(x["n"], at)
    if "other" in x:
        out["other"] = np.logical_or.reduceat(x["other"], at)
    return out


class Family:
    """Arrays of hashes, sorted, of sizes that grow geometrically.  An entry's ``other`` tells that its anchor stands elsewhere with another content."""

    def __init__(self):
        self.levels: list[dict | None] = []

    @staticmethod
    def _scan(new: dict, old: dict) -> None:
        """Look up each array's hashes in the other: what shares its anchor with the other array, unless with an equal entry alone."""
        for a, b in ((new, old), (old, new)):
            lo, hi = np.searchsorted(b["h"], a["h"], "left"), np.searchsorted(b["h"], a["h"], "right")
            one = hi - lo == 1
            equal = np.zeros(len(lo), bool)
            equal[one] = b["c"][lo[one]] == a["c"][one]
            a["other"] |= (hi > lo) & ~equal

    def add(self, x: dict) -> None:
        x = combine(x)
        h = x["h"]
        other = np.zeros(len(h), bool)
        if len(h) > 1:
            same = h[1:] == h[:-1]
            other[1:] |= same
            other[:-1] |= same
        x["other"] = other
        for level in self.levels:
            if level is not None:
                self._scan(x, level)
        k = 0
        while k < len(self.levels) and self.levels[k] is not None:
            x = self._merge(x, self.levels[k])
            self.levels[k] = None
            k += 1
        if k == len(self.levels):
            self.levels.append(None)
        self.levels[k] = x

    @staticmethod
    def _merge(a: dict, b: dict) -> dict:
        return combine({k: np.concatenate([b[k], a[k]]) for k in a})

    def whole(self) -> dict | None:
        out = None
        for level in self.levels:
            if level is not None:
                out = level if out is None else self._merge(out, level)
        return out


def _arrays(batch) -> dict:
    return {k: np.asarray(batch.column(i)) if k != "none" else batch.column(i).to_numpy(zero_copy_only=False) for i, k in enumerate(COLUMNS)}


def _record(x: dict, names) -> pa.RecordBatch:
    return pa.record_batch([pa.array(x[k]) for k in names], names=list(names))


def _documents(batches):
    powers = Powers(0x5851F42D4C957F2D)
    for b in batches:
        for doc, rid, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist()):
            found = segments(text or b"", powers)
            if found is not None:
                h, c, first, count = found
                k = len(h)
                yield {"h": h.view(np.int64), "c": c.view(np.int64), "n": np.ones(k, np.int64), "doc": np.full(k, doc or 0, np.int64), "rid": np.full(k, rid, np.int64), "first": first.astype(np.int32), "count": count.astype(np.int32), "none": np.full(k, doc is None)}


def _gathered(rows, most: int):
    held, n = [], 0
    for x in rows:
        held.append(x)
        n += len(x["h"])
        if n >= most:
            yield {k: np.concatenate([y[k] for y in held]) for k in COLUMNS}
            held, n = [], 0
    if held:
        yield {k: np.concatenate([y[k] for y in held]) for k in COLUMNS}


def _sample(batches):
    """Suffix entries of an input partition; equal ones are collapsed before they are shuffled."""
    for x in _gathered(_documents(batches), GATHER):
        yield _record(combine(x), COLUMNS)


def _occurrences(batches):
    for x in _gathered(_documents(batches), 50_000):
        yield _record(x, ("h", "c", "doc", "rid", "first", "count", "none"))


def _index(batches):
    """A hash range's family; yields what was met more than once, as a whole or by its anchor."""
    family = Family()
    for x in _gathered((_arrays(b) for b in batches if b.num_rows), BATCH):
        family.add(x)
    x = family.whole()
    if x is not None:
        keep = np.flatnonzero((x["n"] > 1) | x["other"])
        for i in range(0, len(keep), 50_000):
            part = keep[i:i + 50_000]
            yield _record({k: x[k][part] for k in (*COLUMNS, "other")}, (*COLUMNS, "other"))


def _parts(batches):
    """The bytes of segments that must be compared window by window."""
    names = ("h", "hot", "doc", "rid", "none", "first", "count", "data")
    for b in batches:
        rows = []
        for doc, rid, text, parts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist(), b.column(3).to_pylist()):
            rows += [(p["h"], p["hot"], doc or 0, rid, doc is None, p["first"], p["count"], text[p["first"]:p["first"] + p["count"] - 1 + LENGTH]) for p in parts]
        for i in range(0, len(rows), 20_000):
            cols = list(zip(*rows[i:i + 20_000]))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.binary()))], names=list(names))


def _dense(data: list[bytes], count: np.ndarray, powers) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes of every window of the segments, its segment, and its place there."""
    joined = b"".join(data)
    t1, t2 = Text(joined, powers[0]), Text(joined, powers[1], 0xC2B2AE3D27D4EB4F)
    starts = np.cumsum([0] + [len(x) for x in data[:-1]])
    part = np.repeat(np.arange(len(data)), count)
    place = np.arange(len(part)) - np.repeat(np.cumsum(count) - count, count)
    at = starts[part] + place
    return t1.hash(at, at + LENGTH), t2.hash(at, at + LENGTH), part, place


def _resolve(batches):
    """Segments sorted by anchor: equal windows have equal anchors, so each chunk of whole anchors is judged by itself, by sorting its windows."""
    powers = Powers(0x5851F42D4C957F2D), Powers(0x14057B7EF767814F)
    names = ("doc", "rid", "none", "first", "count")

    def judge(rows):
        data, count = [r[7] for r in rows], np.array([r[6] for r in rows])
        h, c, part, place = _dense(data, count, powers)
        order = np.lexsort((c, h))
        same = (h[order][1:] == h[order][:-1]) & (c[order][1:] == c[order][:-1])
        twice = np.zeros(len(h), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        at = np.flatnonzero(twice)
        if not len(at):
            return None
        head = np.ones(len(at), bool)
        head[1:] = (part[at][1:] != part[at][:-1]) | (place[at][1:] != place[at][:-1] + 1)
        first = np.flatnonzero(head)
        n = np.diff(np.append(first, len(at)))
        own = [rows[k] for k in part[at[first]]]
        where = np.array([r[5] for r in own]) + place[at[first]]
        return pa.record_batch([pa.array([r[2] for r in own], pa.int64()), pa.array([r[3] for r in own], pa.int64()), pa.array([r[4] for r in own], pa.bool_()), pa.array(where.astype(np.int32)), pa.array(n.astype(np.int32))], names=list(names))

    held: list = []
    n = 0
    for b in batches:
        for r in zip(*(b.column(k).to_pylist() for k in range(8))):
            if n >= CHUNK and held[-1][0] != r[0]:
                if (out := judge(held)) is not None:
                    yield out
                held, n = [], 0
            held.append(r)
            n += r[6]
    if held and (out := judge(held)) is not None:
        yield out


def _windows(batches):
    """Windows of the segments of hot anchors, a row each, to be dealt out by their own hashes."""
    powers = Powers(0x5851F42D4C957F2D), Powers(0x14057B7EF767814F)
    for batch in batches:
        # parts of about CHUNK windows
        part_of = (np.cumsum(np.asarray(batch.column(6)), dtype=np.int64) - 1) // CHUNK
        edges = np.flatnonzero(np.diff(part_of, prepend=-1, append=-1)) if batch.num_rows else []
        for lo, hi in zip(edges, edges[1:]):
            b = batch.slice(int(lo), int(hi - lo))
            h, c, part, place = _dense(b.column(7).to_pylist(), np.asarray(b.column(6)), powers)
            first = np.asarray(b.column(5))[part] + place
            doc, rid, none = (b.column(k).take(pa.array(part)) for k in (2, 3, 4))
            yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(c.view(np.int64)), doc, rid, none, pa.array(first.astype(np.int32)), pa.array(np.ones(len(part), np.int32))], names=["h", "c", "doc", "rid", "none", "first", "count"])


def _cut(batches):
    for b in batches:
        rows = [[], [], [], [], []]
        for doc, text, marks in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist()):
            data = text or b""
            runs: list[list[int]] = []
            for lo, hi in sorted((m["first"], m["first"] + m["count"] - 1 + LENGTH) for m in marks or ()):
                if runs and lo <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], hi)
                else:
                    runs.append([lo, hi])
            kept, at = hashlib.sha256(), 0
            for lo, hi in runs:
                kept.update(data[at:lo])
                at = hi
            kept.update(data[at:])
            for c, v in zip(rows, (doc, len(data), sum(hi - lo for lo, hi in runs), len(runs), kept.hexdigest())):
                c.append(v)
        yield pa.record_batch([pa.array(c, pa.int64()) for c in rows[:4]] + [pa.array(rows[4], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeats(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows: doc, rid, text), (marks: doc, rid, marks [first window, number of windows]) of all windows that start anywhere else too.

    rid is a hash of the row, so rows that share a doc_id but not a text stay apart.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64(F.col("doc_id").cast("long"), "text").alias("rid"), "text")
    n = partitions(spark)
    met = materialize(rows.mapInArrow(_sample, SUFFIX).repartition(n, "h").mapInArrow(_index, SUFFIX + ", other boolean"), "suffix-met")
    release(spark)
    whole = met.where("n > 1").select(F.col("h").alias("h2"), F.col("c").alias("c2"))
    found = rows.mapInArrow(_occurrences, "h long, c long, doc long, rid long, first int, count int, none boolean")
    found = found.join(whole, F.expr("h = h2 and c = c2"))
    sure = materialize(found.groupBy("doc", "rid", "none").agg(F.collect_set(F.struct("first", "count")).alias("marks")), "suffix-sure")
    release(spark)
    size = met.where("other").groupBy("h").agg(F.sum("count").alias("k")).select(F.col("h").alias("h2"), (F.col("k") > HOT).alias("hot"))
    parts = met.where("other").join(size, F.expr("h = h2")).groupBy("doc", "rid", "none").agg(F.collect_set(F.struct("first", "count", "h", "hot")).alias("parts"))
    parts = parts.select(F.when(~F.col("none"), F.col("doc")).alias("d"), F.col("rid").alias("r"), "parts")
    found = rows.join(parts, F.expr("doc <=> d and rid = r")).dropDuplicates(["doc", "rid"]).select("doc", "rid", "text", "parts")
    open_ = materialize(found.mapInArrow(_parts, "h long, hot boolean, doc long, rid long, none boolean, first int, count int, data binary"), "suffix-open")
    drop(met)
    release(spark)
    spans = "doc long, rid long, none boolean, first int, count int"
    few = open_.where("not hot").repartition(n, "h").sortWithinPartitions("h").mapInArrow(_resolve, spans)
    dense = open_.where("hot").mapInArrow(_windows, "h long, c long, " + spans)
    twice = dense.groupBy("h", "c").agg(F.count("*").alias("k")).where("k > 1").select(F.col("h").alias("h2"), F.col("c").alias("c2"))
    many = dense.join(twice, F.expr("h = h2 and c = c2")).select("doc", "rid", "none", "first", "count")
    more = few.union(many).groupBy("doc", "rid", "none").agg(F.collect_set(F.struct("first", "count")).alias("marks"))
    more = materialize(more, "suffix-more")
    drop(open_)
    release(spark)
    marks = sure.union(more).groupBy("doc", "rid", "none").agg(F.flatten(F.collect_list("marks")).alias("marks"))
    return rows, marks.select(F.when(~F.col("none"), F.col("doc")).alias("d"), F.col("rid").alias("r"), "marks")


def cut_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row.

    Null text has no bytes.  Texts under 200 bytes lose nothing.  Repeated rows are separate documents, and repeat each other.
    """
    rows, marks = repeats(docs)
    return rows.join(marks, F.expr("doc <=> d and rid = r"), "left").select("doc", "text", "marks").mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_repeats(table(spark, sf_dir, "documents"))
