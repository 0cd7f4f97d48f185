"""Components of a similarity join over hashed nodes, in work that is linear in the members of a node where its members are alike.

Used by the chosen-path join of documents and by the banded join of lines.
"""
from __future__ import annotations

import itertools
import tempfile
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, materialize, release
from .components import connected_components

#: nodes of up to so many members and bytes of text are compared exhaustively in one task
NODE_LIMIT, VOLUME = 2048, 8 << 20
#: rows (key, id) that a task sorts together
GATHER = 4_000_000
#: members of a node whose pairs are laid out side by side
FEW = 16
#: bits of a set's bitmap
BITS = 2048


def _ordered(rows: np.ndarray) -> np.ndarray:
    """By key, then id, each pair once."""
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    return rows[np.concatenate([[True], (rows[1:] != rows[:-1]).any(1)])] if len(rows) else rows


def _nodes(rows: np.ndarray):
    """(keys, ids, pivots) of the keys with two ids or more."""
    rows = _ordered(rows)
    if not len(rows):
        return
    key, ids = rows[:, 0], rows[:, 1]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sizes = np.diff(np.append(starts, len(key)))
    out = np.repeat(sizes > 1, sizes)
    yield key[out], ids[out], np.repeat(ids[starts], sizes)[out]


def _chunks(f, rows: int):
    f.seek(0)
    while len(x := np.fromfile(f, np.int64, 2 * rows).reshape(-1, 2)):
        yield x


def _dealt(parts, most: int, level: int = 0):
    """The nodes of many rows: these are dealt into files by the next bits of their keys until a file fits; a key of its own streams from its file."""
    files = [tempfile.TemporaryFile() for _ in range(16)]
    for rows in parts:
        part = (rows[:, 0].view(np.uint64) >> np.uint64(60 - 4 * level)) & np.uint64(15)
        for k, f in enumerate(files):
            rows[part == k].tofile(f)
    for f in files:
        n = f.tell() // 16
        if n <= most:
            yield from itertools.chain.from_iterable(map(_nodes, _chunks(f, most)))
        elif level < 15:
            yield from _dealt(_chunks(f, most), most, level + 1)
        else:
            low, high = map(list, zip(*((x[:, 1].min(), x[:, 1].max()) for x in _chunks(f, most))))
            if min(low) < max(high):
                for x in _chunks(f, most):
                    yield x[:, 0], x[:, 1], np.full(len(x), min(low))
        f.close()


def _members(batches, most: int = GATHER):
    """(key, id) rows of whole keys: for every key with two ids or more, its rows with the least id.

    Rows beyond ``most`` go through files in the task's own folder, so memory is bounded, whatever the size of a key.
    """
    def parts():
        held, n = [], 0
        for b in batches:
            held.append(np.stack([np.asarray(b.column(0)), np.asarray(b.column(1))], 1))
            n += b.num_rows
            if n >= most:
                yield np.concatenate(held)
                held, n = [], 0
        if held:
            yield np.concatenate(held)

    got = parts()
    some = list(itertools.islice(got, 2))
    found = _dealt(itertools.chain(some, got), most) if len(some) > 1 else itertools.chain.from_iterable(map(_nodes, some))
    for columns in found:
        for i in range(0, len(columns[0]), 100_000):
            yield pa.record_batch([pa.array(c[i:i + 100_000]) for c in columns], names=["key", "id", "pivot"])


class Texts:
    """The contents (id, text) of the ids of a join, all written out."""

    def __init__(self, contents: DataFrame):
        self.contents = contents

    def sizes(self) -> DataFrame:
        """(id, bytes)"""
        return self.contents.select("id", F.octet_length("text").alias("bytes"))

    def of(self, rows: DataFrame) -> DataFrame:
        """Rows with the text of their id."""
        return rows.join(self.contents, "id")

    def likely(self, members: DataFrame) -> DataFrame:
        """Members (key, id, comp) of nodes; those that nothing in their node can be alike may be left out."""
        return members


def similarity_components(keyed: DataFrame | list[DataFrame], verifier: Callable[[DataFrame], tuple], label: str, limit: int = NODE_LIMIT) -> DataFrame:
    """``keyed`` (key long, id long) -> components (id, component).  Of several such frames, which share no key, one is shuffled at a time.

    1. Members of a node are compared with the node's least id; an id takes the pivot that most of its nodes name.
    2. Verified links give components.  Nodes whose members all lie in one component are done.
    3. Of the other nodes, those that fit a task compare every two members of different components there and emit the links
       that join components only.  Larger ones branch further: by the rarest elements of each member, as many as any set that is
       alike must share one of (``_branches``), so no pair is left out and no pair of a node is written out.

    ``verifier`` is given the ids that share a node with another and returns three things: their contents (id, text), or ``Texts``; a
    function that takes (a, b) with a < b and returns those that hold; and a ``Comparer``.
    """
    keyed, parts = keyed if isinstance(keyed, list) else [keyed], []
    spark = keyed[0].sparkSession
    for rows in keyed:
        parts.append(materialize(rows.repartition(F.col("key")).mapInArrow(_members, "key long, id long, pivot long"), f"{label}-nodes"))
        release(spark)
    nodes = reduce(DataFrame.union, parts)
    contents, verify, compare = verifier(nodes.select("id").distinct())
    contents = contents if isinstance(contents, Texts) else Texts(contents)
    votes = nodes.where("id <> pivot").groupBy("id", "pivot").agg(F.count("*").alias("n"))
    chosen = votes.groupBy("id").agg(F.max_by("pivot", F.struct("n", -F.col("pivot"))).alias("pivot"))
    first = materialize(verify(chosen.select(F.col("pivot").alias("a"), F.col("id").alias("b"))), f"{label}-links")
    comps = materialize(connected_components(first, f"{label}-cc"), f"{label}-comp")
    release(spark)

    at = nodes.join(comps, "id", "left").select("key", "id", F.coalesce("component", "id").alias("comp"))
    at = _open(at)
    at = materialize(at.join(contents.sizes(), "id"), f"{label}-open")
    drop(*parts)
    release(spark)
    sized = at.groupBy("key").agg(F.count("*").alias("n"), F.sum("bytes").alias("volume"))
    large = sized.where((F.col("n") > limit) | (F.col("volume") > VOLUME))
    if large.isEmpty():
        leaves = at.select("key", "id", "comp")
    else:
        inside = contents.of(at.join(large.select("key"), "key", "left_semi").select("key", "id", "comp")).select("key", "id", "comp", "text")
        leaves = at.join(large, "key", "left_anti").select("key", "id", "comp").union(_branches(inside, compare, label))
    met = contents.of(contents.likely(leaves)).select("key", "id", "comp", "text").repartition("key").sortWithinPartitions("key", "id")
    more = materialize(met.mapInArrow(compare.run, "a long, b long").distinct(), f"{label}-links")
    release(spark)
    out = comps if more.isEmpty() else _joined(comps, more, label)
    drop(first, at, more)
    return out


def _open(at: DataFrame) -> DataFrame:
    """Members of nodes that hold two components or more."""
    keys = at.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    return at.join(keys, "key")


def _branches(members: DataFrame, compare: Comparer, label: str) -> DataFrame:
    """Children (key, id, comp) of large nodes.

    A node's elements are ordered by how many members hold them, rarest first.  Of two sets with 100 * common >= percent *
    united, each shares more than all but its ``n - ceil(percent * n / 100)`` elements with the other, so among the first
    ``n - ceil(percent * n / 100) + 1`` of both, by one order, there is a common one.  A child holds the members that have such an
    element in common; the rows are those of the texts' elements, whatever the members share.
    """
    x = materialize(members.mapInArrow(compare.elements, "key long, id long, comp long, e long, n int"), f"{label}-elements")
    often = x.groupBy("key", "e").agg(F.count("*").alias("often")).select(F.col("key").alias("k2"), F.col("e").alias("e2"), "often")
    order = Window.partitionBy("key", "id").orderBy("often", "e")
    y = x.join(often, F.expr("key = k2 and e = e2")).withColumn("at", F.row_number().over(order))
    y = y.where((F.col("often") > 1) & (F.col("at") <= F.expr(f"n - cast(ceil({compare.percent} * n / 100) as int) + 1")))
    return _open(y.select(F.xxhash64("key", "e").alias("key"), "id", "comp"))


class Comparer:
    """Compares the members of nodes, rows (key, id, comp, text) sorted by key.

    ``run`` gives (a, b), a < b: members of one key, of different components, whose ``sets`` are alike.  Every set has a bitmap of its
    elements' hashes: as many bits as two bitmaps differ in, so many elements at least are not common, and only pairs that this
    doesn't rule out have their sets built and compared in full.  Members of the commonest component are not compared
    among themselves.  With ``joining``, a link within a component that the key's earlier links make is left out: the
    components are the same, and a key gives fewer rows than it has members.
    """

    def __init__(self, sets: Callable, percent: int, joining: bool = False, places: Callable | None = None, numbered: Callable | None = None):
        """``places``: texts -> the hashes of their elements as one array, and how many each text has, repeats included, if there is a faster way to them than the sets.
        ``numbered``: texts -> a function that gives the n-th text's set as an array of distinct numbers, equal where elements are; None if it can't."""
        self.sets, self.percent, self.joining, self.places, self.numbered = sets, percent, joining, places, numbered

    def run(self, batches):
        held: list = []
        size = 0
        for b in batches:
            for row in zip(*(b.column(k).to_pylist() for k in range(4))):
                if (len(held) >= 1024 or size > VOLUME) and held[-1][0] != row[0]:
                    yield from self._links(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held:
            yield from self._links(held)

    def elements(self, batches):
        """(key, id, comp, element, size of the set) of each member's set."""
        for b in batches:
            for key, i, comp, text in zip(*(b.column(k).to_pylist() for k in range(4))):
                e = np.array([_digest(x) for x in self.sets(text)], np.int64)
                n = len(e)
                if n:
                    yield pa.record_batch([pa.array(np.full(n, v), pa.int64()) for v in (key, i, comp)] + [pa.array(e), pa.array(np.full(n, n), pa.int32())], names=["key", "id", "comp", "e", "n"])

    def _links(self, rows: list):
        keys = np.array([r[0] for r in rows])
        sets: dict[int, set | np.ndarray] = {}
        number = self.numbered([r[3] for r in rows]) if self.numbered else None
        if self.places is None:
            sets = {i: self.sets(r[3]) for i, r in enumerate(rows)}
            size = np.array([len(x) for x in sets.values()])
            at = np.fromiter((hash(e) for x in sets.values() for e in x), np.int64, size.sum())
        else:
            at, size = self.places([r[3] for r in rows])
        maps, size = bitmaps(at, size)
        comp = np.array([r[2] for r in rows])
        starts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1])
        sizes = np.diff(np.append(starts, len(rows)))
        out: list = []
        few = []  # pairs of places within nodes of up to FEW members, ruled out by bitmap all at once
        for n in range(2, FEW + 1):
            at = starts[sizes == n]
            if len(at):
                few.append(np.stack([(at[:, None] + x).ravel() for x in np.triu_indices(n, 1)]))
        if few:
            i, j = np.concatenate(few, 1)
            some = comp[i] != comp[j]
            i, j = i[some], j[some]
            some = may_be_alike(maps[i], size[i], maps[j], size[j], self.percent)
            node = np.repeat(np.arange(len(starts)), sizes)
            for a, b in zip(i[some].tolist(), j[some].tolist()):
                if comp[a] != comp[b]:
                    lo = starts[node[a]]
                    self._try(rows, a, b, comp[lo:lo + sizes[node[a]]], comp[a], comp[b], sets, number, out)
        for lo, n in zip(starts[sizes > FEW].tolist(), sizes[sizes > FEW].tolist()):
            self._node(rows, lo, lo + n, maps, size, comp[lo:lo + n], sets, number, out)
        if out:
            yield pa.record_batch([pa.array([r[k] for r in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    def _try(self, rows, i, j, comp, one, other, sets, number, out) -> None:
        """Compare two members in full; ``comp`` are the components of their node, ``one`` and ``other`` the two's."""
        for k in (i, j):
            if k not in sets:
                sets[k] = number(k) if number else self.sets(rows[k][3])
        if alike(sets[i], sets[j], self.percent):
            a, b = rows[i][1], rows[j][1]
            out.append((min(a, b), max(a, b)))
            if self.joining:
                comp[comp == other] = one

    def _node(self, rows, lo, hi, maps, size, comp, sets, number, out) -> None:
        names, counts = np.unique(comp, return_counts=True)
        maps, size = maps[lo:hi], size[lo:hi]
        for i in np.flatnonzero(comp != names[counts.argmax()]):
            others = np.flatnonzero(comp != comp[i])
            for j in others[may_be_alike(maps[others], size[others], maps[i], size[i], self.percent)]:
                if comp[i] != comp[j]:
                    self._try(rows, lo + int(i), lo + int(j), comp, comp[i], comp[j], sets, number, out)


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct values of an array, sorted: np.unique hashes since NumPy 2.3, which takes ten times as long here."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def bitmaps(hashes: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A bitmap of each set's hashes, which stand one set after the other, and the sets' sizes."""
    maps = np.zeros((len(size), BITS), bool)
    maps[np.repeat(np.arange(len(size)), size), hashes & (BITS - 1)] = True
    return np.packbits(maps, axis=1).view(np.uint64), size


def may_be_alike(a: np.ndarray, size_a, b: np.ndarray, size_b, percent: int) -> np.ndarray:
    """False where bitmaps and sizes (or more than the sizes) rule out that 100 * common >= percent * united."""
    apart = np.bitwise_count(a ^ b).sum(1, dtype=np.int64)
    return (100 + percent) * apart <= (100 - percent) * (size_a + size_b)


def parities(hashes: np.ndarray, size: np.ndarray, words: int) -> np.ndarray:
    """Of each set ``words`` numbers whose bits say whether an odd number of its distinct hashes fall there.

    As many bits as two sets' differ in, so many elements at least are not common, and what is common cancels, however large the sets.
    """
    sets = np.repeat(np.arange(len(size), dtype=np.int64), size)
    of = distinct(sets << 32 | hashes & 0xFFFFFFFF)
    bits = 64 * words
    odd = np.bincount((of >> 32) * bits + (of & (bits - 1)), minlength=len(size) * bits) & 1
    return np.packbits(odd.astype(bool).reshape(len(size), bits), axis=1).view(np.int64)


def likely_members(percent: int, words: int):
    """Members (key, id, comp, size, words of ``parities``) sorted by key -> (key, id, comp) of those that a member of another component may be alike."""
    def found(rows: np.ndarray):
        keys, comp, size, maps = rows[:, 0], rows[:, 2], rows[:, 3], np.ascontiguousarray(rows[:, 4:]).view(np.uint64)
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sizes = np.diff(np.append(starts, len(rows)))
        hit = np.zeros(len(rows), bool)
        for n in range(2, FEW + 1):
            at = starts[sizes == n]
            for x, y in zip(*np.triu_indices(n, 1)) if len(at) else ():
                i, j = at + x, at + y
                ok = (comp[i] != comp[j]) & may_be_alike(maps[i], size[i], maps[j], size[j], percent)
                hit[i[ok]] = hit[j[ok]] = True
        for lo, n in zip(starts[sizes > FEW].tolist(), sizes[sizes > FEW].tolist()):
            names, counts = np.unique(comp[lo:lo + n], return_counts=True)
            c, m, s = comp[lo:lo + n], maps[lo:lo + n], size[lo:lo + n]
            for i in np.flatnonzero(c != names[counts.argmax()]):
                j = np.flatnonzero((c != c[i]) & may_be_alike(m, s, m[i], s[i], percent))
                if len(j):
                    hit[lo + i] = hit[lo + j] = True
        rows = rows[hit]
        for i in range(0, len(rows), 100_000):
            x = rows[i:i + 100_000]
            yield pa.record_batch([pa.array(x[:, k]) for k in range(3)], names=["key", "id", "comp"])

    def run(batches):
        held, n = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            x = np.stack([np.asarray(c) for c in b.columns], 1)
            if n >= 50_000 and x[0, 0] != held[-1][-1, 0]:
                yield from found(np.concatenate(held))
                held, n = [], 0
            elif n >= 50_000 and x[0, 0] != x[-1, 0]:  # the held rows' last key ends within this batch
                cut = int(np.flatnonzero(x[:, 0] != x[0, 0])[0])
                yield from found(np.concatenate([*held, x[:cut]]))
                held, n, x = [], 0, x[cut:]
            held.append(x)
            n += len(x)
        if held:
            yield from found(np.concatenate(held))
    return run


def _digest(element) -> int:
    """Equal in every process, as Python's own hash is not."""
    import xxhash
    data = element.encode("utf-8", "surrogatepass") if isinstance(element, str) else b"\n".join(element)
    return xxhash.xxh3_64_intdigest(data) - (1 << 63)


def alike(a: set | np.ndarray, b: set | np.ndarray, percent: int) -> bool:
    """100 * common >= percent * united, of two sets or two arrays of distinct values; an empty one is like none."""
    if not len(a) or not len(b) or min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
        return False
    if isinstance(a, set):
        both = len(a & b)
    else:
        c = np.concatenate([a, b])
        c.sort()
        both = int(np.count_nonzero(c[1:] == c[:-1]))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _joined(comps: DataFrame, more: DataFrame, label: str) -> DataFrame:
    """Components after further links: these are first contracted to distinct links between components, so a large group's many links count once."""
    at = comps.select(F.col("id").alias("i"), F.col("component").alias("c"))
    x = more.join(at, F.col("a") == F.col("i"), "left").select(F.coalesce("c", "a").alias("a"), "b")
    x = x.join(at, F.col("b") == F.col("i"), "left").select("a", F.coalesce("c", "b").alias("b")).where("a <> b")
    x = x.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    top = materialize(connected_components(x, f"{label}-cc"), f"{label}-comp")
    new = top.select(F.col("id").alias("i"), F.col("component").alias("c"))
    moved = comps.join(new, F.col("component") == F.col("i"), "left").select("id", F.coalesce("c", "component").alias("component"))
    return materialize(moved.union(top.select("id", "component")).distinct(), f"{label}-comp")
