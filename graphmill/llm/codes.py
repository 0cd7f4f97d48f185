"""Product codes of integer vectors by Lloyd's rounds with Hamerly's bounds.

Every part of every vector keeps its entry, one upper bound on the distance to it and one lower bound on the distance to
the second nearest, in a table of the shared folder that each round reads and writes anew.  A round moves the bounds by what the
entries moved.  Where the upper bound stays strictly below the lower one the part keeps its entry unseen; if not, the upper
bound is made exact, and only if that fails too all entries are scanned, in integers, ties to the lower index.  Bounds are
rounded outward, so they never decide a tie.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop, materialize, release, table

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: parts that are scanned at once
BLOCK = 4096


def limit(width: int) -> int:
    """Largest size of a component for which squared distances of a part of this width fit 63 bits, with components in 32."""
    return min(2**31 - 1, int((2**62 // max(1, width)) ** 0.5) // 2)


def scan(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of ``x`` the nearest entry (lower index on ties), its squared distance, and that of the nearest other entry (-1: none)."""
    n, m = len(x), len(book)
    near, best, second = np.empty(n, np.int64), np.empty(n, np.int64), np.full(n, -1, np.int64)
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0)))
    exact = max(1, x.shape[1]) * 4 * top * top < 2**53  # then doubles hold all these integers, and products of matrices are fast
    b = book.astype(np.float64) if exact else book
    bb = (b * b).sum(1)
    for i in range(0, n, BLOCK):
        part = x[i:i + BLOCK].astype(b.dtype)
        d = (part * part).sum(1)[:, None] - 2 * (part @ b.T) + bb
        rows = np.arange(len(d))
        k = d.argmin(1)
        near[i:i + BLOCK], best[i:i + BLOCK] = k, d[rows, k]
        if m > 1:
            d[rows, k] = np.inf if exact else np.iinfo(np.int64).max
            second[i:i + BLOCK] = d.min(1)
    return near, best, second


def _up(d: np.ndarray) -> np.ndarray:
    return np.nextafter(np.sqrt(d.astype(np.float64)), np.inf)


def _down(d: np.ndarray) -> np.ndarray:
    """Of squared distances; -1 (no other entry) is beyond all bounds."""
    return np.where(d < 0, np.inf, np.nextafter(np.sqrt(np.maximum(d, 0).astype(np.float64)), 0))


def assign(x: np.ndarray, book: np.ndarray, near: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
    """Move ``near``, ``upper`` and ``lower`` (in place) on to the nearest entries of ``book``; gives the number of full scans."""
    open_ = np.flatnonzero(~(upper < lower))
    if len(open_):
        known = open_[near[open_] >= 0]
        gap = x[known] - book[near[known]]
        upper[known] = _up((gap * gap).sum(1))
        open_ = open_[~(upper[open_] < lower[open_])]
        near[open_], best, second = scan(x[open_], book)
        upper[open_], lower[open_] = _up(best), _down(second)
    return len(open_)


def shifted(near: np.ndarray, upper: np.ndarray, lower: np.ndarray, moved: np.ndarray) -> None:
    """Widen the bounds (in place) by what the entries moved: the own entry's way up, the longest way of any other down."""
    if not len(moved):
        return
    far = int(moved.argmax())
    others = np.full(len(moved), moved[far])
    others[far] = np.delete(moved, far).max(initial=0)
    upper += moved[near]
    np.nextafter(upper, np.inf, out=upper)
    lower -= others[near]
    np.nextafter(lower, -np.inf, out=lower)


def _floats(column: pa.Array) -> tuple[np.ndarray, int]:
    """A list column without nulls as a matrix; all lists must be of one length."""
    lengths = np.diff(column.offsets.to_numpy())
    width = int(lengths[0]) if len(lengths) else 0
    if (lengths != width).any():
        raise ValueError("vectors have different lengths")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(lengths), width), width


STATE = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("label", T.IntegerType()), T.StructField("x", T.ArrayType(T.IntegerType())),
    T.StructField("near", T.ArrayType(T.ShortType())), T.StructField("upper", T.ArrayType(T.FloatType())), T.StructField("lower", T.ArrayType(T.FloatType())),
    T.StructField("part", T.IntegerType()), T.StructField("entry", T.IntegerType()), T.StructField("used", T.LongType()), T.StructField("total", T.ArrayType(T.LongType())),
])


def _lists(m: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, m.shape[1] or 1)[:len(m) + 1] if m.shape[1] else np.zeros(len(m) + 1), pa.int32()), pa.array(m.reshape(-1), kind))


def _round32(a: np.ndarray, to: float) -> np.ndarray:
    """Bounds as 32-bit numbers, rounded outward."""
    b = a.astype(np.float32)
    wrong = b < a if to > 0 else b > a
    b[wrong] = np.nextafter(b[wrong], np.float32(to))
    return b


def _step(books: np.ndarray, moved: np.ndarray | None):
    """One round over the state: new entries and bounds of every row, then a row for each entry in use with the sum of its parts."""
    parts, _, width = books.shape

    def run(batches):
        used = np.zeros(books.shape[:2], np.int64)
        total = np.zeros(books.shape, np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            x, _ = _floats(b.column(2))
            n, x = len(x), x.astype(np.int64)
            if moved is None:
                near, upper, lower = np.full((n, parts), -1, np.int64), np.full((n, parts), np.inf), np.zeros((n, parts))
            else:
                near, upper, lower = (_floats(b.column(k))[0].astype(t) for k, t in ((3, np.int64), (4, np.float64), (5, np.float64)))
            for p in range(parts):
                own, a, u, w = x[:, p * width:(p + 1) * width], near[:, p].copy(), upper[:, p].copy(), lower[:, p].copy()
                if moved is not None:
                    shifted(a, u, w, moved[p])
                assign(own, books[p], a, u, w)
                near[:, p], upper[:, p], lower[:, p] = a, u, w
                used[p] += np.bincount(a, minlength=books.shape[1])
                np.add.at(total[p], a, own)
            yield _record(n, b, near, _round32(upper, np.inf), _round32(lower, -np.inf))
        at = np.argwhere(used)
        if len(at):
            none = pa.nulls(len(at), pa.int32())
            yield pa.record_batch([
                none.cast(pa.int64()), none, *(pa.nulls(len(at), pa.list_(k)) for k in (pa.int32(), pa.int16(), pa.float32(), pa.float32())),
                pa.array(at[:, 0], pa.int32()), pa.array(at[:, 1], pa.int32()), pa.array(used[at[:, 0], at[:, 1]]), _lists(total[at[:, 0], at[:, 1]], pa.int64()),
            ], names=STATE.names)
    return run


def _record(n, b, near, upper, lower):
    none = pa.nulls(n, pa.int32())
    return pa.record_batch([b.column(0), b.column(1), b.column(2), _lists(near, pa.int16()), _lists(upper, pa.float32()), _lists(lower, pa.float32()), none, none, none.cast(pa.int64()), pa.nulls(n, pa.list_(pa.int64()))], names=STATE.names)


def _coded(books: np.ndarray, moved: np.ndarray):
    """The last assignment: codes and exact errors."""
    parts, _, width = books.shape

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x, near, upper, lower = (_floats(b.column(k))[0].astype(t) for k, t in ((2, np.int64), (3, np.int64), (4, np.float64), (5, np.float64)))
            error = np.zeros(len(x), np.int64)
            for p in range(parts):
                own, a, u, w = x[:, p * width:(p + 1) * width], near[:, p].copy(), upper[:, p].copy(), lower[:, p].copy()
                shifted(a, u, w, moved[p])
                assign(own, books[p], a, u, w)
                near[:, p] = a
                error += ((own - books[p][a]) ** 2).sum(1)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(["".join(f"{k:02x}" for k in row) for row in near.tolist()], pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])
    return run


def _integers(vectors: DataFrame) -> DataFrame:
    """Rows that are kept, with floor(1024 * x) of their components."""
    v = F.col("embedding")
    good = vectors.where(v.isNotNull() & ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    return good.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), F.transform(v, lambda c: F.floor(c.cast("double") * SCALE)).alias("x"))


def encode(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """Vectors (vec_id, embedding, label) -> vec_id, code, error, label_error, codebooks_sha256.

    Rows whose vector is null or holds a null, NaN or infinite component go.  Repeated rows are vectors of their own, each with
    its result; of equal vec_ids the smaller vector starts first, and rows without vec_id start last.  With fewer rows than
    entries the codebooks are as short as that.  Equal distances go to the lower entry.  Vectors must be of one length, a multiple of
    ``parts`` (anything else is an error), with components below ``limit``; empty vectors get code zero.  An empty table gives no rows.
    Extra columns are not looked at.  What comes to the driver is one sum an entry.
    """
    spark = vectors.sparkSession
    source = _integers(vectors)
    first = source.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).collect()
    none = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"
    if not first:
        return source.limit(0).select("vec_id", *(F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in none.split(", ")[1:])))
    width, odd = divmod(len(first[0].x), parts)
    wide = source.agg(F.max(F.size("x")).alias("most"), F.min(F.size("x")).alias("least"), F.max(F.array_max(F.transform("x", F.abs))).alias("top")).first()
    if odd or wide.most != wide.least:
        raise ValueError(f"vectors must be of one length, a multiple of {parts}")
    if (wide.top or 0) > limit(width):
        raise ValueError(f"components must be below {limit(width) / SCALE}")
    books = np.array([r.x for r in first], np.int64).reshape(len(first), parts, width).transpose(1, 0, 2).copy()
    none = (F.lit(None).cast(f.dataType).alias(f.name) for f in STATE.fields[3:])
    state, moved = source.withColumn("x", F.col("x").cast("array<int>")).select("vec_id", "label", "x", *none), None
    for k in range(rounds):
        after = materialize(state.mapInArrow(_step(books, moved), STATE), f"codes-{k}")
        sums = after.where("part is not null").groupBy("part", "entry").agg(F.sum("used").alias("n"), F.array(*(F.sum(F.col("total")[i]) for i in range(width))).cast("array<long>").alias("total")).collect()
        new = books.copy()
        for r in sums:
            if width:
                new[r.part, r.entry] = np.array(r.total, np.int64) // r.n
        gap = new - books
        moved, books = _up((gap * gap).sum(2)) * ((gap != 0).any(2)), new
        if k:
            drop(state)
        state = after
        release(spark)
        state = _rows(state, after)
    coded = materialize(state.mapInArrow(_coded(books, moved), "vec_id long, label int, code string, error long"), "codes")
    drop(state)
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    labels = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    out = coded.alias("c").join(labels.alias("l"), F.expr("c.label <=> l.label"))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _rows(state: DataFrame, written: DataFrame) -> DataFrame:
    """The vectors of a state table, without the sums that stand beside them."""
    out = state.where("part is null")
    out._scratch = written._scratch
    return out


def op11_vector_codes(spark, sf_dir):
    return encode(table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    dist = "list_sum(list_transform(list_zip({0}, {1}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    out = ["""
WITH x AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS i, vec_id, label, list_transform(embedding, lambda c: CAST(floor(1024 * CAST(c AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
parts AS MATERIALIZED (SELECT i, vec_id, label, p, v[p * (len(v) // 4) + 1:(p + 1) * (len(v) // 4)] AS v FROM x, (SELECT unnest(range(4)) AS p)),
book0 AS MATERIALIZED (SELECT p, i - 1 AS e, v AS c FROM parts WHERE i <= 256)"""]
    for k in range(ROUNDS + 1):
        out.append(f"""
near{k} AS MATERIALIZED (
  SELECT i, p, arg_min(e, (d, e)) AS e, min(d) AS d
  FROM (SELECT i, a.p AS p, e, {dist.format('a.v', 'b.c')} AS d FROM parts a JOIN book{k} b ON a.p = b.p) GROUP BY i, p)""")
        if k < ROUNDS:
            out.append(f"""
mean{k} AS MATERIALIZED (
  SELECT p, e, list(m ORDER BY j) AS c
  FROM (SELECT p, e, j, CAST(floor(sum(y) / count(*)) AS BIGINT) AS m
        FROM (SELECT n.p, n.e, unnest(v) AS y, generate_subscripts(v, 1) AS j FROM near{k} n JOIN parts USING (i, p)) GROUP BY p, e, j) GROUP BY p, e),
book{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book{k} b LEFT JOIN mean{k} m USING (p, e))""")
    return ",".join(out) + f""",
codes AS (SELECT i, string_agg(lower(printf('%02x', e)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM near{ROUNDS} GROUP BY i),
digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM codes JOIN x USING (i), digest
"""


OP11_SQL = _sql()
