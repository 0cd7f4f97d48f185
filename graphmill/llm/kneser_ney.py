"""Interpolated modified Kneser-Ney language model.

Spark counts: tasks turn words into 64-bit hashes, count the n-grams of some million words at once and send them on by their hash, in blocks;
each bucket of hashes is then counted in full and written as sorted arrays.  The n-grams of a lower order are counted by the
distinct words before them, from the buckets above.  Workers map those arrays into memory and score texts by binary search, a block of words at a time.
The arrays lie in the folder that executors share; where that is no mounted folder a worker maps a copy.
"""
from __future__ import annotations

import mmap
import os
import tempfile
import uuid
from functools import lru_cache
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, materialize, new_path, release, small_batches, table

#: words of an n-gram
ORDER = 2
#: words that a task counts before it sends blocks on, characters of text for which there is a bucket, word hashes that a worker remembers
CHUNK, BUCKET_CHARS, WORDS = 1_500_000, 4_000_000, 200_000
#: files that a worker keeps mapped
MAPPED = 32_768
#: bits of a bucket up to which there is one for each ``BUCKET_CHARS``; beyond, buckets grow in number as the root of the text, and in size with it
FULL_BITS = 9
#: rows with this remainder of crc32(doc_id) are held out
FOLDS, HELD = 7, 2
START, END = (np.uint64(xxhash.xxh3_64_intdigest(x)) for x in (b" start", b" end"))  # no word holds white space
#: discounts for 1, 2, 3 and more where counts of counts allow no estimate
FALLBACK = (0.5, 1.0, 1.5)

_LEFT, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
ROWS = "level int, bucket long, data binary, stat array<long>"


class Hashes(dict):
    """Hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < WORDS:
            self[word] = h
        return h


def words(text: str | None, seen: Hashes) -> np.ndarray:
    """Hashes of a text's words, lower-cased in A-Z, and the end."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z only, and ASCII white space only
    out = np.empty(len(found) + 1, np.uint64)
    out[:-1] = np.fromiter(map(seen.__getitem__, found), np.uint64, len(found))
    out[-1] = END
    return out


def key(columns: list[np.ndarray]) -> np.ndarray:
    """The hash of an n-gram from those of its words; a word is its own."""
    h = columns[0]
    for c in columns[1:]:
        h = (h ^ (h >> np.uint64(29))) * _LEFT + c
    if len(columns) > 1:
        h = (h ^ (h >> np.uint64(32))) * _MIX
        h = h ^ (h >> np.uint64(31))
    return h


def bucket_bits(chars: int, bucket_chars: int) -> int:
    """Bits that tell buckets apart.  Each bucket sends a block to each bucket of the level below, so twice the buckets are four times the blocks: they double as the text becomes four times as long."""
    bits = max(0, -(-chars // bucket_chars) - 1).bit_length()
    return bits if bits <= FULL_BITS else FULL_BITS + (bits - FULL_BITS) // 2


def bucket(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)


def summed(h: np.ndarray, carried: list[np.ndarray], added: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Sorted distinct hashes, of each one row of ``carried``, and sums of ``added``."""
    order = np.argsort(h)
    h = h[order]
    at = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
    return h[at], [c[order[at]] for c in carried], [np.add.reduceat(a[order], at) if len(at) else a[:0] for a in added]


def _planes(c: np.ndarray) -> bytes:
    """A column with the bytes of one place together."""
    return np.ascontiguousarray(c).reshape(-1, 1).view(np.uint8).T.tobytes()


def _column(raw: np.ndarray, at: int, rows: int, kind: str) -> tuple[np.ndarray, int]:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw[at:at + width * rows].reshape(width, rows).T).view(kind).reshape(-1), at + width * rows


def pack(columns: list[np.ndarray], hashes: int) -> bytes:
    """Columns of 64-bit numbers as a block; the first ones are hashes and share a sorted dictionary, as words come again."""
    known, place = np.unique(np.concatenate(columns[:hashes]), return_inverse=True)
    rows = len(columns[0])
    parts = [np.array([rows, len(known)], "<u8").tobytes(), _planes(np.diff(known, prepend=np.uint64(0))), *(_planes(place[rows * k:rows * (k + 1)].astype("<u4")) for k in range(hashes)), *(_planes(c.astype("<u8")) for c in columns[hashes:])]
    return zstandard.compress(b"".join(parts), 1)


def unpack(data: bytes, n: int, hashes: int) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    rows, known = raw[:16].view("<u8").tolist()
    steps, at = _column(raw, 16, known, "<u8")
    known, out = np.cumsum(steps, dtype=np.uint64), []
    for k in range(n):
        c, at = _column(raw, at, rows, "<u4" if k < hashes else "<u8")
        out.append(known[c] if k < hashes else c)
    return out


def joined(blocks, n: int, hashes: int = 1) -> list[np.ndarray]:
    parts = [unpack(b, n, hashes) for b in blocks]
    return [np.concatenate([p[k] for p in parts]) for k in range(n)]


def dealt(level: int, h: np.ndarray, columns: list[np.ndarray], bits: int):
    """Rows (level, bucket, data) of columns by their hashes; within a block rows stand by the first column, which makes blocks small."""
    b = bucket(h, bits)
    order = np.lexsort((columns[0], b))
    b = b[order]
    at = np.flatnonzero(np.r_[True, b[1:] != b[:-1]]) if len(b) else []
    ends = [*at[1:], len(b)] if len(b) else []
    columns = [c[order] for c in columns]
    for i, j in zip(at, ends):
        yield level, int(b[i]), pack([c[i:j] for c in columns], max(1, level))


def _record(rows, level: int = 0, stat: list | None = None) -> pa.RecordBatch:
    """Blocks as rows, and a row with counts of a level if there are any."""
    rows = [(*r, None) for r in rows] + ([(level, None, None, [int(x) for x in stat])] if stat else [])
    kinds = pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int64())
    return pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["level", "bucket", "data", "stat"])


# Levels of rows: n > 0 the n-grams of n words, with their counts; 0 the words with their counts in the text; -n the contexts of n words.

def _counted(order: int, bits: int):
    """Texts to blocks of counts: n-grams of the highest order, lower ones at a text's start (nothing stands before them), and words."""
    def run(batches):
        seen, held, size = Hashes(), [], 0
        for b in batches:
            for text in b.column(0).to_pylist():
                held.append(words(text, seen))
                size += len(held[-1]) + 1
                if size >= CHUNK:
                    yield from _blocks(held, order, bits)
                    held, size = [], 0
        if held:
            yield from _blocks(held, order, bits)
    return run


def _blocks(texts: list[np.ndarray], order: int, bits: int):
    lengths = np.array([len(t) + 1 for t in texts])
    line = np.concatenate([x for t in texts for x in (np.array([START]), t)])
    starts = np.cumsum(lengths) - lengths
    place = np.arange(len(line)) - np.repeat(starts, lengths)  # 0 is the start
    for n in range(1, order + 1):
        at = np.flatnonzero(place >= n - 1) if n == order else starts[lengths >= n] + n - 1
        if n == 1 and order > 1:
            continue
        at = at[place[at] > 0]
        grams = [line[at - (n - 1 - k)] for k in range(n)]
        h, grams, (count,) = summed(key(grams), grams, [np.ones(len(at), np.uint64)])
        if len(h):
            yield _record(dealt(n, h, [*grams, count], bits))
    h, _, (count,) = summed(line[place > 0], [], [np.ones(len(line) - len(texts), np.uint64)])
    yield _record(dealt(0, h, [h, count], bits))


def _merged(path: str, level: int, bits: int):
    """A bucket of one level in full: its arrays are written, its contexts and the n-grams of the order below go on, counts of counts are told."""
    def run(t: pa.Table) -> pa.Table:
        kind, b = t.column("level")[0].as_py(), t.column("bucket")[0].as_py()
        blocks = t.column("data").to_pylist()
        if 0 < kind < level:  # n-grams at the start of texts wait for their level
            return pa.Table.from_batches([_record((kind, b, x) for x in blocks)])
        store = Arrays(path)
        if kind == 0:
            c = joined(blocks, 2)
            h, _, (n,) = summed(c[0], [], [c[1]])
            store.write(f"words-{b}", h, n)
            return pa.Table.from_batches([_record([], 0, [len(h), n.sum()])])
        if kind < 0:
            c = joined(blocks, 5)
            h, _, sums = summed(c[0], [], c[1:])
            store.write(f"contexts{-kind}-{b}", h, *sums)
            return pa.Table.from_batches([_record([])])
        *grams, count = joined(blocks, kind + 1, kind)
        h, grams, (count,) = summed(key(grams), grams, [count])
        store.write(f"grams{kind}-{b}", h, count)
        few = [(count == k).astype(np.uint64) for k in (1, 2)] + [(count >= 3).astype(np.uint64)]
        rows = []
        if kind > 1:
            front = key(grams[:-1])
            c, _, sums = summed(front, [], [count, *few])
            rows += dealt(1 - kind, c, [c, *sums], bits)
            less, rest, (one,) = summed(key(grams[1:]), grams[1:], [np.ones(len(h), np.uint64)])
            rows += dealt(kind - 1, less, [*rest, one], bits)
        return pa.Table.from_batches([_record(rows, kind, [*((count == k).sum() for k in (1, 2, 3, 4)), few[2].sum(), count.sum()])])
    return run


def _mapped(f) -> np.ndarray:
    """A file's bytes, mapped into memory; the mapping holds no file open."""
    return np.frombuffer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, trackfd=False), np.uint8)


class Arrays:
    """Columns of 64-bit numbers, the first sorted, as files under a folder; readers map them into memory."""

    def __init__(self, path: str):
        p = urlparse(path)
        self.fs, self.root, self.open = None, p.path, {}
        if p.scheme not in ("", "file"):
            from pyarrow import fs
            self.fs, self.root = fs.FileSystem.from_uri(path)

    def write(self, name: str, *columns: np.ndarray) -> None:
        """Whole or not at all, so that a task that runs twice does no harm; numbers take the least bytes that hold a column's largest."""
        width = [8] + [next(w for w in (1, 2, 4, 8) if w == 8 or int(c.max(initial=0)) < 1 << 8 * w) for c in columns[1:]]
        data = [np.array([len(columns[0]), *width], "<u8").tobytes(), *(c.astype(f"<u{w}").tobytes() for c, w in zip(columns, width))]
        if self.fs:
            self.fs.create_dir(self.root)
            with self.fs.open_output_stream(f"{self.root}/{name}") as f:
                f.write(b"".join(data))
            return
        os.makedirs(self.root, exist_ok=True)
        new = f"{self.root}/.{name}-{uuid.uuid4().hex}"
        with open(new, "wb") as f:
            f.writelines(data)
        os.replace(new, f"{self.root}/{name}")

    def read(self, name: str, columns: int) -> list[np.ndarray] | None:
        if name not in self.open:
            if len(self.open) >= MAPPED:
                self.open.clear()
            self.open[name] = self._map(name, columns)
        return self.open[name]

    def _map(self, name: str, columns: int) -> list[np.ndarray] | None:
        try:
            if not self.fs:
                with open(f"{self.root}/{name}", "rb") as f:
                    raw = _mapped(f)
            else:
                with self.fs.open_input_stream(f"{self.root}/{name}") as f, tempfile.NamedTemporaryFile() as copy:
                    while part := f.read(8 << 20):
                        copy.write(part)
                    copy.flush()
                    raw = _mapped(copy)  # the mapping outlives the file's name
        except FileNotFoundError:
            return None
        rows, *width = raw[:8 * (columns + 1)].view("<u8").tolist()
        ends = np.cumsum([8 * (columns + 1)] + [rows * w for w in width])
        return [raw[i:j].view(f"<u{w}") for i, j, w in zip(ends, ends[1:], width)]

    def find(self, name: str, asked: np.ndarray, columns: int, bits: int) -> list[np.ndarray]:
        """For each hash asked for what stands beside it, zeros if it isn't there; each is looked up once, in order."""
        q, back = np.unique(asked, return_inverse=True)
        out = [np.zeros(len(q), np.float64) for _ in range(columns)]
        b = bucket(q, bits)
        at = np.flatnonzero(np.r_[True, b[1:] != b[:-1]]) if len(b) else np.zeros(0, np.int64)
        for i, j in zip(at, [*at[1:], len(b)]):
            have = self.read(f"{name}-{b[i]}", columns + 1)
            if have is not None and len(have[0]):
                k = np.minimum(np.searchsorted(have[0], q[i:j]), len(have[0]) - 1)
                hit = np.asarray(have[0][k]) == q[i:j]
                for o, c in zip(out, have[1:]):
                    o[i:j] = np.where(hit, c[k], 0)
        return [o[back] for o in out]


class Model:
    """What scoring needs: where the arrays are, and a few numbers a level."""

    def __init__(self, path: str, order: int, bits: int, stats: dict[int, list[int]]):
        self.path, self.order, self.bits = path, order, bits
        self.kinds, self.tokens = (stats.get(0) or [0, 0])[:2]
        self.stats = {k: stats.get(k) or [0] * 6 for k in range(1, order + 1)}
        self.discounts = {k: discounts(s) for k, s in self.stats.items()}


def discounts(s: list[int]) -> tuple[float, float, float]:
    """Of n-grams counted once, twice, and more often."""
    n1, n2, n3, n4 = s[:4]
    if min(n1, n2, n3, n4) > 0:
        y = n1 / (n1 + 2 * n2)
        d = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3
        if all(0 < x <= k + 1 for k, x in enumerate(d)):
            return d
    return FALLBACK


def _likelihoods(m: Model, store: Arrays, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(known, base, score) of each text, from its words' hashes."""
    lengths = np.array([len(t) + 1 for t in texts])
    starts = np.cumsum(lengths) - lengths
    line = np.concatenate([x for t in texts for x in (np.array([START]), t)])
    place = np.arange(len(line)) - np.repeat(starts, lengths)
    counts, = store.find("words", line, 1, m.bits)
    base = np.log10((counts + 1) / (m.tokens + m.kinds + 1))
    d, s = np.array([0, *m.discounts[1]]), m.stats[1]
    c, = store.find("grams1", line, 1, m.bits)
    p = np.full(len(line), 1 / (m.kinds + 1))
    if s[5]:
        p = (c - d[np.minimum(c, 3).astype(int)] + (d[1] * s[0] + d[2] * s[1] + d[3] * s[4]) * p) / s[5]
    for n in range(2, m.order + 1):
        d = np.array([0, *m.discounts[n]])
        at = np.flatnonzero(place >= n - 1)
        grams = [line[at - (n - 1 - k)] for k in range(n)]
        c, = store.find(f"grams{n}", key(grams), 1, m.bits)
        total, n1, n2, n3 = store.find(f"contexts{n - 1}", key(grams[:-1]), 4, m.bits)
        with np.errstate(divide="ignore", invalid="ignore"):
            q = (c - d[np.minimum(c, 3).astype(int)] + (d[1] * n1 + d[2] * n2 + d[3] * n3) * p[at]) / total
        p[at] = np.where(total > 0, q, p[at])
    real = place > 0
    add = lambda x: np.add.reduceat(np.where(real, x, 0), starts)
    return add(counts > 0), add(base), add(np.log10(p))


@lru_cache(maxsize=1)
def _store(path: str) -> Arrays:
    """A worker's arrays: what one task has mapped, or copied, serves the next."""
    return Arrays(path)


def _scored(m: Model):
    """Scores of texts, looked up for a block of words at a time, however few texts a batch holds."""
    def run(batches):
        seen, store = Hashes(), _store(m.path)
        texts, ids, held, size = [], [], [], 0
        for b in batches:
            for i, h, text in zip(*(b.column(k).to_pylist() for k in range(3))):
                texts.append(words(text, seen))
                ids.append(i)
                held.append(h)
                size += len(texts[-1])
                if size >= CHUNK // 3:
                    yield _scores(m, store, ids, held, texts)
                    texts, ids, held, size = [], [], [], 0
        if texts:
            yield _scores(m, store, ids, held, texts)
    return run


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scores(m, store, ids, held, texts):
    known, base, score = _likelihoods(m, store, texts)
    columns = pa.array(ids, pa.int64()), pa.array(held, pa.bool_()), pa.array([len(t) for t in texts], pa.int64()), pa.array(known.astype(np.int64)), pa.array([m.tokens] * len(ids), pa.int64()), pa.array(base), pa.array(score)
    return pa.record_batch(list(columns), names=[c.split()[0] for c in SCORES.split(", ")])


def held_out() -> F.Column:
    """Whether a row isn't learnt from; a row without doc_id counts as one with an empty id."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % FOLDS == HELD


def fit(texts: DataFrame, order: int = ORDER, bucket_chars: int = BUCKET_CHARS) -> Model:
    """Count the texts (one column, text) and write the model's arrays into the shared folder."""
    spark = texts.sparkSession
    small_batches(spark)
    chars = texts.agg(F.coalesce(F.sum(F.length("text") + 8), F.lit(0))).first()[0]
    bits = bucket_bits(chars, bucket_chars)
    path = new_path(spark, "kneser-ney")
    stats: dict[int, list[int]] = {}
    rows, before = texts.mapInArrow(_counted(order, bits), ROWS), None
    for level in range(order, 0, -1):
        rows = materialize(rows.groupBy("level", "bucket").applyInArrow(_merged(path, level, bits), ROWS), f"grams-{level}")
        for r in rows.where("stat is not null").groupBy("level").agg(*(F.sum(F.get("stat", F.lit(k))).alias(f"s{k}") for k in range(6))).collect():
            stats[r.level] = [x or 0 for x in r[1:]]
        if before is not None:
            drop(before)
        release(spark)
        before, rows = rows, rows.where("stat is null")
    drop(before)
    return Model(path, order, bits, stats)


def score(docs: DataFrame, order: int = ORDER, bucket_chars: int = BUCKET_CHARS) -> DataFrame:
    """Documents (doc_id, text) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; the model learns from those that aren't held out.

    A null text is the empty one, whose only token is the end; rows without doc_id are learnt from; repeated rows are documents of their own.  With
    nothing to learn from every token has probability one, and an empty table gives no rows.  Extra columns are not looked
    at.  A text's words, eight bytes each, must fit a task.  N-grams are told apart by 64 bits.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    model = fit(rows.where("not held_out").select("text"), order, bucket_chars)
    return rows.mapInArrow(_scored(model), SCORES)


def op13_kneser_ney(spark, sf_dir):
    return score(table(spark, sf_dir, "documents"))
