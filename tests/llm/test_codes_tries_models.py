"""Vector codes, prefix tries and the language model against plain versions, on odd inputs."""
import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from graphmill.llm import codes, kneser_ney, trie


def plain_codes(rows, parts, entries, rounds):
    kept = [(i, [math.floor(1024 * c) for c in v], label) for i, v, label in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width:(p + 1) * width]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v, p: min((dist(cut(v, p), c), e) for e, c in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(parts):
            members = defaultdict(list)
            for _, v, _ in kept:
                members[near(v, p)[1]].append(cut(v, p))
            books[p] = [[sum(x) // len(members[e]) for x in zip(*members[e])] if e in members else c for e, c in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    out = [(i, label, *zip(*(near(v, p) for p in range(parts)))) for i, v, label in kept]
    errors = Counter()
    for i, label, d, e in out:
        errors[label] += sum(d)
    return Counter((i, "".join(f"{k:02x}" for k in e), sum(d), errors[label], digest) for i, label, d, e in out)


@pytest.mark.parametrize("spread,entries", [(3, 256), (3, 7), (200_000, 16)])
def test_codes(spark, spread, entries):
    r = random.Random(spread)
    rows = [(i, [r.randint(-spread, spread) / 1024 + r.random() / 4096 for _ in range(8)], r.choice([1, 2, None])) for i in range(300)]
    rows += [(5, rows[5][1], 1), (5, rows[6][1], 2), (None, rows[7][1], 1), (900, None, 1), (901, [1.0] * 7 + [None], 1), (902, [float("nan")] + [0.0] * 7, 1), (903, [float("inf")] + [0.0] * 7, None)]
    df = spark.createDataFrame([(*x, 1, 2) for x in rows], "vec_id long, embedding array<double>, label int, near int, part int").repartition(5)
    got = Counter((x.vec_id, x.code, x.error, x.label_error, x.codebooks_sha256) for x in codes.encode(df, entries=entries).collect())
    assert got == plain_codes(rows, 4, entries, 4)


def test_codes_of_odd_tables(spark):
    kind = "vec_id long, embedding array<float>, label int"
    assert codes.encode(spark.createDataFrame([], kind)).collect() == [] and codes.encode(spark.createDataFrame([(1, None, 1)], kind)).collect() == []
    assert [x.code for x in codes.encode(spark.createDataFrame([(1, [], 1), (2, [], 1)], kind)).collect()] == ["00000000"] * 2
    for bad in ([(1, [1.0] * 4, 1), (2, [1.0] * 8, 1)], [(1, [1.0] * 6, 1)], [(1, [1e30] * 4, 1)]):
        with pytest.raises(ValueError):
            codes.encode(spark.createDataFrame(bad, kind))


def test_bounds_save_scans_and_keep_ties():
    r = np.random.default_rng(3)
    x = r.integers(-20, 20, (3000, 4)) + 400 * np.r_[np.arange(40), r.integers(0, 40, 2960)][:, None]  # groups far apart
    book = np.concatenate([x[:40], x[:40]])  # every entry twice: ties go to the lower
    near, upper, lower = np.full(3000, -1), np.full(3000, np.inf), np.zeros(3000)
    scans = [codes.assign(x, book, near, upper, lower)]
    assert near.max() < 40
    book = np.concatenate([book[:40], r.integers(3000, 4000, (40, 4))])
    for _ in range(6):
        new = book.copy()
        for e in set(near.tolist()):
            new[e] = x[near == e].sum(0) // (near == e).sum()
        codes.shifted(near, upper, lower, np.sqrt(((new - book) ** 2).sum(1).astype(float)))
        book = new
        scans.append(codes.assign(x, book, near, upper, lower))
        d = ((x[:, None] - book) ** 2).sum(2)
        assert (near == d.argmin(1)).all()
    assert scans[-1] < 1000 < scans[0] == 3000


def plain_trie(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            turns[c].append(((turn is not None, turn or 0, hashlib.sha256(f"{len(role)} {role}{text}".encode()).digest()[:16]), (role, text)))
    own = {c: [x for _, x in sorted(t)] for c, t in turns.items()}
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = own.get(c - int(math.fmod(c, 5)), [])[:h] + own[c][h:]
    members = defaultdict(list)
    for c, t in whole.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = sum(saved[k] for k in kids[p]) + ((len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0)
    ends = lambda p: hashlib.sha256(",".join(str(c) for c in sorted(members[p]) if len(whole[c]) == len(p)).encode()).hexdigest()
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], ends(p)) for p, m in members.items()), key=str)


@pytest.mark.parametrize("most,piece", [(trie.TURNS, 4096), (60, 3), (5, 1)])
def test_trie(spark, most, piece, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", piece)
    r = random.Random(7)
    rows = [(c, k, r.choice(["user", "system", None]), r.choice(["", None, "ä", "bc", "a long turn"])) for c in range(-7, 90) for k in range(r.randint(1, 7))]
    for c in range(1000, 1200):  # a hot first turn, with many equal conversations
        rows += [(c, k, "user", "same") for k in range(3)] + ([(c, 3, "user", "x" * (c % 4))] if c % 3 else [])
    rows += [(2000, None, "a", "first"), (2000, None, "a", "first"), (2000, 1, "b", "2"), (2000, 1, "a", "1"), (2001, -5, "a", "minus"), (None, 1, "user", "nobody's")]
    rows += [(3001, k, "user", f"turn {k} " + "long " * 2000) for k in range(300)] + [(3000, k, "user", str(k)) for k in range(2)]
    df = spark.createDataFrame([(*x, 1, 1) for x in rows], "conv_id long, turn long, role string, text string, n int, depth int").repartition(6)
    names = [c.split()[0] for c in trie.NODE.split(", ") if not c.startswith("above")]
    got = sorted((tuple(x[c] for c in names) for x in trie.prefix_trie(df, most).collect()), key=str)
    assert got == plain_trie(rows)


def test_trie_of_nothing(spark):
    kind = "conv_id long, turn long, role string, text string"
    assert trie.prefix_trie(spark.createDataFrame([], kind)).collect() == [] and trie.prefix_trie(spark.createDataFrame([(None, 1, "a", "b")], kind)).collect() == []


def plain_model(texts, order):
    """Interpolated modified Kneser-Ney over dictionaries of word tuples."""
    lines = [["<s>", *t, "</s>"] for t in texts]
    counts = {order: Counter(tuple(x[i:i + order]) for x in lines for i in range(len(x) - order + 1) if order > 1 or i)}
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
        if n > 1:
            counts[n].update(tuple(x[:n]) for x in lines if len(x) >= n)
    raw = Counter(w for x in lines for w in x[1:])
    def discount(c):
        n = [sum(v == k for v in c.values()) for k in (1, 2, 3, 4)]
        if min(n) > 0:
            y = n[0] / (n[0] + 2 * n[1])
            d = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]]
            if all(0 < x <= k + 1 for k, x in enumerate(d)):
                return d
        return [0.5, 1.0, 1.5]
    ds = {n: discount(c) for n, c in counts.items()}
    after = {n: defaultdict(list) for n in counts}
    for n, c in counts.items():
        for g, v in c.items():
            after[n][g[:-1]].append(v)

    def p(gram):
        n = len(gram)
        lower = p(gram[1:]) if n > 1 else 1 / (len(raw) + 1)
        seen = after[n].get(gram[:-1])
        if not seen:
            return lower
        d = lambda v: ds[n][min(v, 3) - 1] if v else 0
        v = counts[n].get(gram, 0)
        return (v - d(v) + sum(map(d, seen)) * lower) / sum(seen)
    return p, raw


@pytest.mark.parametrize("order,chars", [(1, 10_000), (2, 300), (3, 2_000), (4, 10**9)])
def test_model(spark, order, chars, monkeypatch):
    monkeypatch.setattr(kneser_ney, "CHUNK", 500)
    r = random.Random(order)
    vocabulary = ["".join(r.choices("abcÄéλ", k=r.randint(1, 3))) for _ in range(60)]
    text = lambda: r.choice([" ", "\t", "\n"]).join(r.choices(vocabulary, [1 / (k + 1) for k in range(60)], k=r.randint(0, 40)))
    rows = [(i, text()) for i in range(160)] + [(3, rows_text) for rows_text in ("a A a", "a A a")] + [(None, "b c"), (None, None), (500, None), (501, ""), (502, "\x1c  x\x0by\x85"), (503, "never seen words " * 3000)]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, score int, words int").repartition(4)
    low = lambda t: [w.decode() for w in (t or "").encode().lower().split()]
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    p, raw = plain_model([low(t) for i, t in rows if not held(i)], order)
    total, want = sum(raw.values()), []
    for i, t in rows:
        line = ["<s>", *low(t), "</s>"]
        score = sum(math.log10(p(tuple(line[max(0, k - order + 1) or (0 if order > 1 else k):k + 1]) if order > 1 else (line[k],))) for k in range(1, len(line)))
        want.append((i, held(i), len(line) - 1, sum(w in raw for w in line[1:]), total, sum(math.log10((raw[w] + 1) / (total + len(raw) + 1)) for w in line[1:]), score))
    got = [tuple(x) for x in kneser_ney.score(df, order, chars).collect()]
    put = lambda x: (str(x[0]), *x[1:5], round(x[5], 6), round(x[6], 6))
    got, want = sorted(map(put, got), key=str), sorted(map(put, want), key=str)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], abs=1e-5)


def test_probabilities_sum_to_one(spark, tmp_path):
    words = [f"w{i % 17}" for i in range(400)] + [f"v{i * i % 31}" for i in range(200)]
    texts = [" ".join(words[i:i + 9]) for i in range(0, 600, 9)]
    m = kneser_ney.fit(spark.createDataFrame([(t,) for t in texts], "text string"), 3)
    seen, store = kneser_ney.Hashes(), kneser_ney.Arrays(m.path)
    kinds = sorted(set(words))
    total = 0.0
    for w in [*kinds, "unknown"]:
        _, _, s = kneser_ney._likelihoods(m, store, [kneser_ney.words(f"w1 w2 {w}", seen)[:-1], kneser_ney.words("w1 w2", seen)[:-1]])
        total += 10 ** (s[0] - s[1])
    _, _, s = kneser_ney._likelihoods(m, store, [kneser_ney.words("w1 w2", seen), kneser_ney.words("w1 w2", seen)[:-1]])
    assert total + 10 ** (s[0] - s[1]) == pytest.approx(1, abs=1e-9)


def test_models_of_nothing(spark):
    kind = "doc_id long, text string"
    assert kneser_ney.score(spark.createDataFrame([], kind)).collect() == []
    only = [i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2][:1]
    got = kneser_ney.score(spark.createDataFrame([(only[0], "a b")], kind)).collect()
    assert [(x.held_out, x.n_tokens, x.n_known, x.train_tokens, x.base_score, x.score) for x in got] == [(True, 3, 0, 0, 0.0, 0.0)]
