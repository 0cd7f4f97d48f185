"""Quality classifier: a generalised additive model with pairwise interactions.

Boosting goes round the features in a cycle; each turn fits one shallow tree on one feature's bins and adds it to that
feature's lookup table.  Pairs are then ranked by how well a cross of two cuts explains what is left, and the best
ones get tables of their own in the same way.  A score is the sum of table entries, one addition a feature for a whole batch.
"""
from __future__ import annotations

import itertools
import json
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

#: labelled rows that a fit takes at most, those with the least hash of doc_id
MAX_TRAIN = 20_000
BINS, COARSE = 48, 10
ROUNDS, PAIR_ROUNDS, PAIRS = 250, 80, 6
RATE, RIDGE = 0.1, 2.0
THRESHOLD = 0.7

NAMES = ("words", "word_length", "distinct", "adjacent", "symbols", "pipes", "upper", "bangs", "digits", "line_words", "repeat_lines", "ended_lines", "stops", "commas", "top_word", "pair_distinct", "non_ascii", "long_words", "ends")


def features(text: str | None) -> list[float]:
    """Statistics of a whole text; the empty text has zeros."""
    text = text or ""
    words = text.split()
    n, chars = len(words), max(1, len(text))
    if not n:
        return [0.0] * len(NAMES)
    lines = [x for x in map(str.strip, text.split("\n")) if x]
    k = max(1, len(lines))
    counts = Counter(words)
    return [
        np.log1p(n),
        sum(map(len, words)) / n,
        len(counts) / n ** 0.8,
        sum(map(str.__eq__, words, words[1:])) / n,
        sum(map(text.count, "#*$%&<>=@{}[]\\/_^~")) / chars,
        text.count("|") / n,
        sum(map(str.isupper, words)) / n,
        text.count("!") / n,
        sum(map(text.count, "0123456789")) / chars,
        n / k,
        1 - len(set(lines)) / k,
        sum(x[-1] in ".!?:;\"'" for x in lines) / k,
        text.count(".") / n,
        text.count(",") / n,
        max(counts.values()) / n,
        len(set(zip(words, words[1:]))) / n,
        (len(text.encode("utf-8", "ignore")) - len(text)) / chars,
        sum(len(w) > 14 for w in counts) / n,
        sum(w[-1].isalnum() for w in words) / n,
    ]


class Gam:
    """Lookup tables over feature bins, and over pairs of coarser bins."""

    def __init__(self, edges, coarse, bias, tables, pairs):
        self.edges, self.coarse, self.bias, self.tables, self.pairs = edges, coarse, bias, tables, pairs

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for j, e in enumerate(self.edges):
            z += self.tables[j][np.searchsorted(e, x[:, j], side="right")]
        if self.pairs:
            low = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.coarse)]
            for (a, b), t in self.pairs.items():
                z += t[low[a], low[b]]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def terms(self) -> str:
        """The tables as JSON, to be read by people."""
        return json.dumps({"bias": self.bias, "tables": {NAMES[j]: [self.edges[j].tolist(), t.tolist()] for j, t in enumerate(self.tables)}, "pairs": {f"{NAMES[a]} x {NAMES[b]}": t.tolist() for (a, b), t in self.pairs.items()}})


def _edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    return [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]


def _value(g, h):
    return g / (h + RIDGE)


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Leaf values by bin of the best tree of up to three leaves: the best cut, then the best cut of either side."""
    def cut(lo, hi):
        cg, ch = np.cumsum(g[lo:hi])[:-1], np.cumsum(h[lo:hi])[:-1]
        G, H = g[lo:hi].sum(), h[lo:hi].sum()
        if not len(cg):
            return 0.0, None
        gain = cg ** 2 / (ch + RIDGE) + (G - cg) ** 2 / (H - ch + RIDGE) - G ** 2 / (H + RIDGE)
        k = int(np.argmax(gain))
        return float(gain[k]), lo + k + 1

    n = len(g)
    spans = [(0, n)]
    _, at = cut(0, n)
    if at:
        spans = [(0, at), (at, n)]
        (ga, ka), (gb, kb) = cut(0, at), cut(at, n)
        if ka and ga >= gb:
            spans = [(0, ka), (ka, at), (at, n)]
        elif kb:
            spans = [(0, at), (at, kb), (kb, n)]
    out = np.zeros(n)
    for lo, hi in spans:
        out[lo:hi] = _value(g[lo:hi].sum(), h[lo:hi].sum())
    return out


def _cross(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best cut of a grid in both directions: gain and the value of each cell."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    if min(g.shape) < 2:
        return 0.0, np.zeros_like(g)
    G, H = cg[-1, -1], ch[-1, -1]
    a, ah = cg[:-1, :-1], ch[:-1, :-1]
    b, bh = cg[:-1, -1:] - a, ch[:-1, -1:] - ah
    c, ch2 = cg[-1:, :-1] - a, ch[-1:, :-1] - ah
    d, dh = G - a - b - c, H - ah - bh - ch2
    gain = a ** 2 / (ah + RIDGE) + b ** 2 / (bh + RIDGE) + c ** 2 / (ch2 + RIDGE) + d ** 2 / (dh + RIDGE) - G ** 2 / (H + RIDGE)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    out = np.empty_like(g)
    out[:i + 1, :j + 1], out[:i + 1, j + 1:] = _value(a[i, j], ah[i, j]), _value(b[i, j], bh[i, j])
    out[i + 1:, :j + 1], out[i + 1:, j + 1:] = _value(c[i, j], ch2[i, j]), _value(d[i, j], dh[i, j])
    return float(gain[i, j]), out


def fit(x: np.ndarray, y: np.ndarray) -> Gam:
    """Cyclic boosting of the logistic loss; a tenth of the rows (every tenth, in the order given) tells when to stop."""
    if not len(y):
        return Gam([], [], 0.0, [], {})
    held = np.arange(len(y)) % 10 == 9
    if held.sum() < 30:
        held[:] = False
    xs, ys = x[~held], y[~held].astype(float)
    edges, coarse = _edges(xs, BINS), _edges(xs, COARSE)
    bins = [np.searchsorted(e, xs[:, j], side="right") for j, e in enumerate(edges)]
    low = [np.searchsorted(e, xs[:, j], side="right") for j, e in enumerate(coarse)]
    p = (ys.sum() + 1) / (len(ys) + 2)
    bias = float(np.log(p / (1 - p)))
    tables = [np.zeros(len(e) + 1) for e in edges]
    z = np.full(len(ys), bias)
    model = Gam(edges, coarse, bias, tables, {})

    def loss():
        if not held.any():
            return 0.0
        s = np.clip(model.score(x[held]), 1e-6, 1 - 1e-6)
        return float(-(y[held] * np.log(s) + (1 - y[held]) * np.log(1 - s)).mean())

    best, kept, since = loss(), [t.copy() for t in tables], 0
    for _ in range(ROUNDS):
        for j, t in enumerate(tables):
            q = 1 / (1 + np.exp(-z))
            step = RATE * _tree(np.bincount(bins[j], ys - q, len(t)), np.bincount(bins[j], q * (1 - q), len(t)))
            t += step
            z += step[bins[j]]
        now = loss()
        if now < best - 1e-5 or not held.any():
            best, kept, since = now, [t.copy() for t in tables], 0
        elif (since := since + 1) >= 25:
            break
    for t, k in zip(tables, kept):
        t[:] = k
    z = bias + sum(t[b] for t, b in zip(tables, bins))

    def grid(a, b):
        q = 1 / (1 + np.exp(-z))
        shape = len(coarse[a]) + 1, len(coarse[b]) + 1
        cell = low[a] * shape[1] + low[b]
        return cell, np.bincount(cell, ys - q, shape[0] * shape[1]).reshape(shape), np.bincount(cell, q * (1 - q), shape[0] * shape[1]).reshape(shape)

    ranked = sorted(((-_cross(*grid(a, b)[1:])[0], a, b) for a, b in itertools.combinations(range(x.shape[1]), 2)))[:PAIRS]
    model.pairs = {(a, b): np.zeros((len(coarse[a]) + 1, len(coarse[b]) + 1)) for g, a, b in ranked if g < 0}
    best, kept, since = loss(), {k: t.copy() for k, t in model.pairs.items()}, 0
    for _ in range(PAIR_ROUNDS):
        for (a, b), t in model.pairs.items():
            cell, g, h = grid(a, b)
            step = RATE * _cross(g, h)[1]
            t += step
            z += step.ravel()[cell]
        now = loss()
        if now < best - 1e-5 or not held.any():
            best, kept, since = now, {k: t.copy() for k, t in model.pairs.items()}, 0
        elif (since := since + 1) >= 15:
            break
    model.pairs = kept
    return model


def _feature_rows(batches):
    for b in batches:
        rows = [features(t) for t in b.column(1).to_pylist()]
        yield pa.record_batch([b.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["y", "x"])


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Gam | None:
    """Fit on rows whose crc32(doc_id) mod 4 is not 2; at most ``max_train`` of them, which bounds what is broadcast and what comes to the driver.

    Rows without doc_id or label are passed over.  Without any labelled document there is no model.
    """
    small_batches(docs.sparkSession)
    rows = labels.where("doc_id is not null and quality is not null and crc32(cast(doc_id as string)) % 4 <> 2")
    rows = rows.select(F.col("doc_id").cast("long").alias("_id"), F.col("quality").cast("int").alias("y")).orderBy(F.xxhash64("_id"), "_id", "y").limit(max_train)
    found = docs.select("doc_id", "text").join(F.broadcast(rows), F.col("doc_id") == F.col("_id")).select(F.col("y"), "text")
    got = found.mapInArrow(_feature_rows, "y int, x array<double>").collect()
    if not got:
        return None
    got.sort(key=lambda r: (tuple(r.x), r.y))  # the same rows in any order give the same model
    order = np.random.default_rng(7).permutation(len(got))
    return fit(np.array([got[i].x for i in order]), np.array([got[i].y for i in order]))


def _scores(model: Gam | None):
    def run(batches):
        for b in batches:
            if model is None:
                s = np.full(b.num_rows, 0.5)
            elif b.num_rows:
                s = model.score(np.array([features(t) for t in b.column(1).to_pylist()]))
            else:
                continue
            yield pa.record_batch([b.column(0), pa.array(s, pa.float64())], names=["doc_id", "score"])
    return run


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_train: int = MAX_TRAIN) -> DataFrame:
    """doc_id, held_out, score, predicted for every document, from its text alone.

    Empty and null texts are scored like any (all statistics 0).  Repeated rows are scored alike.  Without labels every score
    is 0.5.  held_out is null where doc_id is.
    """
    model = train(docs, labels, max_train)
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scores(model), "doc_id long, score double")
    return out.select("doc_id", F.expr("crc32(cast(doc_id as string)) % 4 = 2").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_train: int = MAX_TRAIN) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts; without labels, all."""
    model = train(docs, labels, max_train)
    if model is None:
        return docs
    schema = docs.schema
    names = docs.columns
    at = names.index("text")

    def run(batches):
        for b in batches:
            if b.num_rows:
                s = model.score(np.array([features(t) for t in b.column(at).to_pylist()]))
                yield b.filter(pa.array(s >= threshold))

    return docs.mapInArrow(run, schema)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
