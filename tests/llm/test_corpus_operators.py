"""The corpus operators against brute force on a small table with nulls, empty, short, long and repeated texts."""
import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from graphmill.llm import exact_dedup, html_extract, line_dedup, mixing, near, near_dedup, packing, quality, rules, suffix_dedup, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, id long"


def texts():
    r = random.Random(5)
    vocabulary = ["".join(r.choices("abcdefgh", k=r.randint(2, 7))) for _ in range(300)]
    line = lambda n: " ".join(r.choices(vocabulary, k=n))
    passage, long = line(60), "\n".join(line(30) for _ in range(200))
    out = [None, "", "   ", "one", "Two words", "two WORDS", passage, passage + " end", "start " + passage, long, long, long.replace("a", "b", 3), "la " * 400]
    base = line(300)
    out += [base] + [" ".join(w if k % 97 != j else "zz" for k, w in enumerate(base.split())) for j in range(6)]
    return out + [line(r.randint(5, 200)) + ".\n" + line(20) for _ in range(30)] + ["### $$$ %%% | x |" * 30]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", [None, "b", "a"][i % 3], 0, "x", 1) for i, t in enumerate(texts())], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_exact(docs, none):
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(docs, memory=2000).collect()}  # spills
    low = [(t or "").encode().lower() for t in texts()]
    for i, t in enumerate(low):
        same = [j for j, x in enumerate(low) if x == t]
        assert (got[i].keep_id, got[i].group_size, got[i].kept, got[i].text_sha256) == (max(same), len(same), i == max(same), hashlib.sha256(t).hexdigest())
    assert exact_dedup.exact_dedup(none).count() == 0


def test_suffix(docs, none):
    data = [(t or "").encode() for t in texts()]
    seen = Counter(b[p:p + 200] for b in data for p in range(len(b) - 199))
    for r in suffix_dedup.cut_repeats(docs).collect():
        b = data[r.doc_id]
        gone = bytearray(len(b))
        for p in range(len(b) - 199):
            if seen[b[p:p + 200]] > 1:
                gone[p:p + 200] = b"\1" * 200
        kept = bytes(x for x, g in zip(b, gone) if not g)
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    assert suffix_dedup.cut_repeats(none).count() == 0


def test_near(docs, none):
    sets = [near_dedup.shingles(near_dedup.words((t or "").encode()), 3) for t in texts()]
    name = list(range(len(sets)))
    for _ in sets:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if a and b and 100 * len(a & b) >= 85 * len(a | b):
                    name[i] = name[j] = min(name[i], name[j])
    got = {r.doc_id: r for r in near_dedup.near_components(docs).collect()}
    assert [got[i].component_id for i in range(len(sets))] == name
    assert all(got[i].n_shingles == len(s) for i, s in enumerate(sets))
    assert near_dedup.near_components(none).count() == 0


def test_a_node_over_the_limit_is_compared_as_a_whole(spark):
    from graphmill.llm import near
    texts = {0: "a b c d", **{i: f"e f g h i j k l m n {'xyz'[i % 3]}{i // 9}" for i in range(1, 40)}}  # the pivot, 0, is like none
    contents = spark.createDataFrame(list(texts.items()), "id long, text string")
    keyed = spark.createDataFrame([(1, i) for i in texts], "key long, id long")
    sets = lambda t: set(t.split())
    got = near.similarity_components(keyed, lambda ids: (contents, lambda pairs: pairs.where("a <> 0"), near.Comparer(sets, 80, joining=True)), "test", limit=4).collect()
    assert {r.id: r.component for r in got} == {i: 1 for i in range(1, 40)}


def test_rules(docs, none):
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    for r in rules.judge(docs, labels).collect():
        t = texts()[r.doc_id] or ""
        w = words(t)
        n = Counter(zip(w, w[1:], w[2:]))
        covered = {k + j for k in range(len(w) - 2) if n[tuple(w[k:k + 3])] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if words(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and r.kept == (not r.base_failed)
    assert rules.judge(none, labels).count() == 0


def test_repeats_are_found_whatever_the_hashes(spark, monkeypatch):
    t = "w232246 mid end q1 w2781254 mid end q2 w232246 mid end q3"
    monkeypatch.setattr(rules, "PLACE", 26)  # fewer bits of hash: these two windows' are equal
    got = rules.statistics(spark.createDataFrame([(1, t), (2, t.replace("mid", "zz")), (3, "la " * 70)], "doc_id long, text string")).collect()
    assert [r.n_repeat_words for r in sorted(got, key=lambda r: r.doc_id)] == [6, 6, 70]
    monkeypatch.setattr(rules, "PLACE", 60)  # four bits of hash
    r = random.Random(8)
    t = " ".join(r.choices("abcdef", k=150))
    w = t.split()
    n = Counter(zip(w, w[1:], w[2:]))
    want = len({k + j for k in range(len(w) - 2) if n[tuple(w[k:k + 3])] > 1 for j in range(3)})
    assert rules.statistics(spark.createDataFrame([(1, t)], "doc_id long, text string")).first().n_repeat_words == want < 150


def test_a_learned_list_decides(spark):
    r = random.Random(2)
    rows = []
    for i in range(400):
        w = ["".join(r.choices("abcdefgh", k=r.randint(2, 7))) for _ in range(80)]
        rows.append((i, " ".join(w) + (" ### $$$" * 12 if i % 4 == 0 else "")))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 4 > 0).cast("int").alias("quality"))
    learned = rules.train(docs, labels)
    assert learned
    for row in rules.judge(docs, labels).collect():
        x = rules.with_features(rules.statistics(docs.where(F.col("doc_id") == row.doc_id))).first() if row.doc_id < 8 else None
        if x is not None:
            hit = [k for k, rule in enumerate(learned, 1) if rules._holds(rule, [x[f] for f in rules.FEATURES])]
            assert row.rule == (hit[0] if hit else 0) and row.kept == (not hit and not row.base_failed)
        assert row.kept == (row.doc_id % 4 > 0)


def test_rules_are_learned():
    rows = [((0.5 if i % 4 == 0 else 0.01, *[0.1] * (len(rules.FEATURES) - 1)), int(i % 4 == 0)) for i in range(200)]
    found = rules.learn(rows)
    assert len(found) == 1 and found[0][0][:2] == (0, True) and rules.learn([]) == []


def test_quality(docs, none, spark):
    out = quality.classify(docs, docs.select("doc_id", (F.col("doc_id") % 2).alias("quality")))
    got = out.collect()
    assert len(got) == len(texts()) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    r = random.Random(3)
    rows = [(i, " ".join("".join(r.choices("abcdefgh", k=r.randint(2, 7))) + ("!!" if i % 2 and k % 5 == 0 else "") for k in range(60))) for i in range(300)]
    planted = spark.createDataFrame(rows, "doc_id long, text string")
    said = quality.classify(planted, planted.select("doc_id", (1 - F.col("doc_id") % 2).cast("int").alias("quality"))).where("held_out").collect()
    assert len(said) > 50 and all(r.predicted == 1 - r.doc_id % 2 for r in said)
    assert quality.classify(none, docs.select("doc_id", F.lit(1).alias("quality"))).count() == 0
    assert quality.keep_good(docs, docs.select("doc_id", F.lit(None).cast("int").alias("quality"))).count() == len(texts())


def test_mixing(docs, none):
    plan = mixing.plan_mix(docs).collect()
    sizes = [len(words(t)) for t in texts()]
    assert all(r.size == sizes[r.doc_id] and 0 <= r.taken <= 2 * r.size for r in plan)
    by = {}
    for r in plan:
        by.setdefault(r.source, [r.target, 0])[1] += r.taken
    assert all(abs(t - n) <= 1 for t, n in by.values()) and abs(sum(t for t, _ in by.values()) - 1.5 * sum(sizes)) < 1e-6
    assert sum(len(words(r.text)) for r in mixing.mix(docs).collect()) == sum(n for _, n in by.values())
    assert mixing.plan_mix(none).count() == 0 and mixing.mix(none).count() == 0


def test_packing(docs, none):
    import public_tokenizers
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = [t.encode(x or "", add_special_tokens=False).ids + [2] for x in texts()]
    got = packing.pack(docs).collect()
    at, bins = {}, {}
    for r in sorted(got, key=lambda r: (r.doc_id, r.start)):
        assert r.start == at.get(r.doc_id, 0) and r.doc_tokens == len(ids[r.doc_id])
        at[r.doc_id] = r.start + r.length
        assert r.ids_crc32 == zlib.crc32(b"".join(v.to_bytes(4, "little") for v in ids[r.doc_id][r.start:r.start + r.length]))
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert [at[i] for i in range(len(ids))] == [len(x) for x in ids]
    for pieces in bins.values():
        end = 0
        for offset, n in sorted(pieces):
            assert offset == end
            end += n
        assert end <= 4096
    assert packing.pack(none).count() == 0


def test_lines(docs, none):
    lines = {}
    for i, t in enumerate(texts()):
        for k, x in enumerate((t or "").split("\n")):
            if n := line_dedup.normal(x):
                lines.setdefault(n, []).append((i, k))
    names = list(lines)
    grams = [line_dedup.grams(n) for n in names]
    group = list(range(len(names)))
    for _ in range(8):
        for i in range(len(names)):
            for j in range(i):
                if group[i] != group[j] and near.alike(grams[i], grams[j], 80):
                    group[i] = group[j] = min(group[i], group[j])
    places = {}
    for i, n in enumerate(names):
        places.setdefault(group[i], []).extend(lines[n])
    gone = Counter(p[0] for ps in places.values() for p in sorted(ps)[1:])
    assert {r.row.doc_id: r.gone for r in line_dedup.dedup_lines(docs).collect()} == {i: gone[i] for i in range(len(texts()))}
    assert line_dedup.drop_lines(none).count() == 0


def test_one_changed_character_in_a_line_of_60_is_a_copy(spark):
    r = random.Random(60)
    rows = []
    for i in range(200):
        x = "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=60))
        at = r.randrange(10, 50)
        rows += [(2 * i, x), (2 * i + 1, x[:at] + "0" + x[at + 1:])]
        assert 0.8 <= len(line_dedup.grams(x) & line_dedup.grams(rows[-1][1])) / len(line_dedup.grams(x) | line_dedup.grams(rows[-1][1])) < 0.85
    gone = {r.row.doc_id: r.gone for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not any(gone[2 * i] for i in range(200)) and sum(gone.values()) >= 199
    assert 1 - (1 - (line_dedup.PERCENT / 100) ** line_dedup.ROWS) ** line_dedup.BANDS >= 0.997


def test_rows_of_one_doc_id_keep_their_own_lines(spark):
    rows = [(0, "A"), (1, "A\nsecond"), (1, "U\nthird"), (1, "U\nthird"), (None, "third"), (None, None)]
    got = sorted(((r.row.doc_id, r.row.text, r.gone) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(0, "A", 0), (1, "second", 1), (1, "U", 1), (1, "U", 1), (None, "third", 0), (None, None, 0)], key=str)


def test_lines_whose_first_hash_is_equal_stay_apart(spark, monkeypatch):
    whole = line_dedup._digests
    monkeypatch.setattr(line_dedup, "_digests", lambda texts: (whole(texts)[0] & 3, whole(texts)[1]))
    r = random.Random(4)
    rows = [(i, "".join(r.choices("abcdefghijklmnop qrstuvwxyz", k=60)) + "\nthe same") for i in range(20)]
    rows += [(20, rows[3][1].split("\n")[0] + "!")]
    got = {r.row.doc_id: r.gone for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: 0, **{i: 1 for i in range(1, 21)}}


def test_a_line_that_stands_often_is_joined_by_broadcast(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SOME", 3)
    rows = [(i, f"hot\nonce {i}") for i in range(10)] + [(10, "twice"), (11, "twice")]
    got = {r.row.doc_id: r.gone for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: 0, **{i: 1 for i in range(1, 10)}, 10: 0, 11: 1}


def test_equal_short_lines_repeat(spark):
    short = ["x" * n for n in range(1, 20)]
    rows = [(1, "\n".join(short) + "\n\n \n"), (2, "\n".join(x.upper() + "  " for x in short)), (3, "y\n\nchapter 1\nchapter 10\nlonger than that: 20"), (4, "y\n  CHAPTER \t 1\n"), (5, None)]
    got = {r.row.doc_id: (r.row.text, r.gone) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (rows[0][1], 0), 2: ("", 19), 3: (rows[2][1], 0), 4: ("", 2), 5: (None, 0)}


def test_warc(spark, tmp_path):
    body = "<p>" + "x y z é " * 200
    pages = spark.createDataFrame([(1, "http://a/1\n", body), (2, "http://a/2", body), (3, None, None), (4, "u", "short"), (5, "u", "short"), (6, "u", body)], "page_id long, url string, html string")
    warc.write_archives(pages, f"file://{tmp_path}/w")
    got = {r.page_id: r for r in warc.read_archives(spark, f"file://{tmp_path}/w").collect()}
    assert [got[i].record_type for i in range(1, 7)] == ["revisit", "revisit", "response", "response", "response", "response"]
    assert got[1].refers_to == 6 and got[6].payload.decode() == body and got[2].payload is None and got[2].payload_length == len(body.encode())
    assert got[3].payload_digest == hashlib.sha1(b"").hexdigest()
    some = warc.read_archives(spark, f"file://{tmp_path}/w", "verify").where("record_type = 'revisit' and page_id = 2").collect()
    assert [r.page_id for r in some] == [2]


@pytest.mark.parametrize("kind", ["plain", "one member", "members of three", "own length"])
@pytest.mark.parametrize("payload", ["yes", "no", "verify"])
def test_archives_of_others(kind, payload, tmp_path):
    import gzip
    bodies = [b"", b"short", b"\r\n\r\n" * 9000, bytes(range(256)) * 900, b"x" * 70_000, b"last"]
    rows = [{"record_type": "response", "payload": x, "payload_length": len(x), "payload_digest": hashlib.sha1(x).hexdigest(), "record_id": None, "date": None, "page_id": i, "target_uri": f"http://a/{i}"} for i, x in enumerate(bodies)]
    data = [warc.record(r) for r in rows]
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    packed = {"plain": b"".join([info, *data]), "one member": gzip.compress(b"".join([info, *data])), "members of three": gzip.compress(info + data[0] + data[1]) + gzip.compress(b"".join(data[2:])), "own length": gzip.compress(info) + b"".join(map(warc.member, data))}[kind]
    (tmp_path / "a.warc").write_bytes(packed)
    from pyarrow import fs
    with fs.LocalFileSystem().open_input_file(str(tmp_path / "a.warc")) as f:
        got = list(warc.records(f, [("record_type", {"response"})], payload))
        assert [r["page_id"] for r in got] == list(range(6)) and [r["payload_length"] for r in got] == list(map(len, bodies))
        assert [r["payload"] for r in got] == (bodies if payload == "yes" else [None] * 6)
        assert [r["page_id"] for r in warc.records(f, [("page_id", {4}), ("payload_length", {70_000})], payload)] == [4]
        assert len(list(warc.records(f, [], "no"))) == 7
    (tmp_path / "b.warc").write_bytes(packed[:-30])
    with fs.LocalFileSystem().open_input_file(str(tmp_path / "b.warc")) as f, pytest.raises(EOFError):
        list(warc.records(f, [], "yes"))


def test_copies_are_found_without_a_broadcast_and_no_pages_give_no_records(spark):
    body = "x" * 2000
    pages = spark.createDataFrame([(i, "u", body, "d", 1) for i in range(5)] + [(9, "u", None, "d", 1), (9, "u", None, "d", 1), (None, "u", body, "d", 1)], "page_id long, url string, html string, d string, top int")
    got = sorted(((r.page_id, r.record_type, r.refers_to) for r in warc.page_records(pages, broadcast_rows=0).collect()), key=str)
    assert got == sorted([(i, "revisit", 4) for i in range(4)] + [(4, "response", None), (9, "response", None), (9, "response", None), (None, "response", None)], key=str)
    assert warc.page_records(pages.limit(0)).count() == 0


def test_html(spark):
    nav = "<html><head><title>t</title></head><body><nav><a>Home</a></nav><div class='ad'>Buy</div>"
    rows = [(1, "http://h/a/1", nav + "<article><h1>A &amp; B</h1><p>one\n two<p>three</article><footer>f</footer>"), (2, "http://h/a/2", nav + "<article><p>four</p><div class='comments'>no</div></article><script>'</p>'</script>"), (3, None, None), (4, "x", "plain"), (5, "http://k/1", "<p>Site</p><p>own one</p>"), (6, "http://k/2", "<p>Site</p><p>own two</p>")]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)).collect()}
    assert got[1] == "A & B\n\none two\n\nthree" and got[2] == "four" and got[3] == "" and got[4] == "plain"
    a = html_extract.lines("<p>Site</p><p>own one</p>")
    assert html_extract.article(a, [html_extract.lines("<p>Site</p><p>own two</p>")]) == ["own one"]
    assert html_extract.common(list("abcbdab"), list("bdcaba")).__len__() == 4


@pytest.mark.parametrize("n", [1, 3, 8])
def test_html_shared_lines_go_inside_an_article_and_others_stay_outside(spark, n):
    page = lambda body, teaser: f"<body><div>Site line</div><div>{body}</div><article><p>{teaser}</p><p>Get our weekly letter</p></article>"
    long = "an article that is a good deal longer than the lines around it, number "
    rows = [(i, f"http://h/{i}", page(f"body {i}", long + str(i))) for i in range(3)]
    rows += [(i, f"http://k/{i}", page(f"body {i}", long + "nil")) for i in range(3, 6)]  # the same article
    rows += [(6, "http://k/9", page("body 6", long + "6")), (7, "http://alone/", "<p>text</p><article>teaser</article>")]
    rows += [(8, "http://h/0", rows[0][2]), (None, None, None), (None, None, None)]  # a copy
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("x")).withColumn("own", F.lit(1))
    got = [(r.page_id, r.text.split("\n\n")) for r in html_extract.extract(df, n).collect()]
    assert len(got) == len(rows) and got.count((None, [""])) == 2
    got = dict(got)
    assert all(got[i] == [f"body {i}", long + str(i)] for i in (0, 1, 2, 6)) and got[8] == got[0]
    assert got[3] == ["body 3", long + "nil", "Get our weekly letter"] and all(got[i] == [f"body {i}", long + "nil"] for i in (4, 5))
    assert got[7] == ["text", "teaser"]
    assert html_extract.extract(df.limit(0)).count() == 0


def test_differencing_decides_on_most_pages(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choices("abcdefghij", k=5))
    rows = []
    for i in range(40):
        site = [f"<p>All of site {i % 4} is here</p>", f"<div>Read more on site {i % 4}</div>"]
        own = [" ".join(word() for _ in range(12)) for _ in range(r.randint(1, 5))]
        rows.append((i, f"http://site{i % 4}/news/{i}", "".join([site[0], "<article>", *(f"<p>{x}</p>" for x in own), site[1], "</article>"]), "\n\n".join(own)))
    got = {x.page_id: x.text for x in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, want string")).collect()}
    assert got == {x[0]: x[3] for x in rows}


def test_common_lines_against_brute_force(monkeypatch):
    def length(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for k, y in enumerate(b):
                new.append(row[k] + 1 if x == y else max(row[k + 1], new[k]))
            row = new
        return row[-1]
    r = random.Random(1)
    for cells in (1 << 26, 4):
        monkeypatch.setattr(html_extract, "CELLS", cells)
        for _ in range(300):
            a, b = (r.choices("abcdefg"[:r.randint(1, 7)], k=r.randint(0, 14)) for _ in "ab")
            found = sorted(html_extract.common(a, b))
            assert len(found) == length(a, b)
            rest = iter(b)
            assert all(a[i] in rest for i in found)


@pytest.mark.parametrize("page, want", [
    ("<article><p class='widget'>body</p></article>", "body"),
    ("<article><section class='related work'><p>body</p></section></article>", "body"),
    ("<article><p>a</p></article><article class='comment'><p>me too</p></article>", "a"),
    ("<article><p>a</p><div class='comments'>me too</div><div class=\"ad\">buy</div></article>", "a"),
    ("<p data-x=don't>hello</p>", "hello"),
    ("<p title='a > b'>hello</p><p title=\"it's\">you</p>", "hello\n\nyou"),
    ("<p>2 < 3 and a<b", "2 < 3 and a<b"),
    ("<p>a<!-- <p>no</p> -->b<script>x</script>c <!-- open", "abc"),
    ("<p>a &amp; &#233;&nbsp;b</p>", "a & é b"),
    ("<nav>menu</nav><p>a<br>b</p><form>f</form>", "a b"),
    ("</div></p><article><header>h</header><p>x</article><p>y", "h\n\nx\n\ny"),
])
def test_markup(page, want):
    assert "\n\n".join(html_extract.article(html_extract.lines(page), [])) == want


def test_long_pages_take_time_in_proportion():
    import time
    began = time.time()
    html_extract.lines("<p a='" * 50_000)
    html_extract.lines("<p a=\"x" * 50_000 + ">")
    html_extract.lines("<i>" * 50_000 + "</b>" * 50_000)
    html_extract.lines("<!-- " * 50_000 + "<![CDATA[" * 50_000)
    html_extract.common(["x", "y"] * 3000, ["y", "x", "x"] * 2000)
    assert time.time() - began < 20


def test_comparer_finds_all_links_of_a_key_whatever_its_size():
    import random

    import pyarrow as pa

    from graphmill.llm import near
    from graphmill.llm.line_dedup import grams
    from graphmill.llm.near import alike
    rnd = random.Random(5)
    base = "the quick brown fox jumps over the lazy dog by the river bank"
    rows = []
    for i in range(60):
        t = list(base)
        for _ in range(rnd.randrange(4)):
            t[rnd.randrange(len(t))] = rnd.choice("xyz")
        rows.append((1 if i < 50 else 2, i, 0 if i % 3 == 0 else i, "".join(t)))
    rows += [(3, 70, 70, ""), (3, 71, 71, ""), (4, 80, 80, "lonely")]
    cols = list(zip(*rows))
    batch = pa.record_batch([pa.array(c, pa.int64()) for c in cols[:3]] + [pa.array(cols[3])], names=["key", "id", "comp", "text"])
    want = {(x[1], y[1]) for x in rows for y in rows if x[0] == y[0] and x[1] < y[1] and x[2] != y[2] and grams(x[3]) and grams(y[3]) and alike(grams(x[3]), grams(y[3]), 80)}
    got = [(a, b) for out in near.Comparer(grams, 80).run(iter([batch.slice(0, 33), batch.slice(33)])) for a, b in zip(out.column(0).to_pylist(), out.column(1).to_pylist())]
    assert want and set(got) == want
    tree = [(a, b) for out in near.Comparer(grams, 80, joining=True, places=line_dedup._places).run(iter([batch.slice(0, 60)])) for a, b in zip(out.column(0).to_pylist(), out.column(1).to_pylist())]
    assert set(tree) <= want and len(tree) < len(rows)

    def parts(links):
        name = {r[1]: r[2] for r in rows}
        for a, b in links:
            old, new = name[b], name[a]
            name = {k: new if v == old else v for k, v in name.items()}
        groups = {}
        for k, v in name.items():
            groups.setdefault(v, set()).add(k)
        return sorted(map(sorted, groups.values()))

    assert parts(tree) == parts(want)


@pytest.mark.parametrize("most", [1, 3, 7, 50, 1000])
def test_members_of_nodes_whatever_fits_at_once(most):
    import pyarrow as pa
    rnd = random.Random(most)
    keys = [rnd.randrange(-1 << 63, 1 << 63) for _ in range(30)]
    rows = [(k, rnd.randrange(12)) for k in keys for _ in range(rnd.choice([1, 1, 2, 5, 20]))]
    rnd.shuffle(rows)
    have = {}
    for k, i in rows:
        have.setdefault(k, set()).add(i)
    want = {(k, i, min(v)) for k, v in have.items() if len(v) > 1 for i in v}
    batch = pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows)], names=["key", "id"])
    got = [r for out in near._members((batch.slice(at, 5) for at in range(0, len(rows), 5)), most) for r in zip(*(c.to_pylist() for c in out.columns))]
    assert set(got) == want and (most < 50 or len(got) == len(want))
    assert list(near._members(iter([]))) == []


def test_windows_dealt_out_give_the_same_cuts(docs, monkeypatch):
    got = lambda: sorted(map(tuple, suffix_dedup.cut_repeats(docs).collect()), key=str)
    want = got()
    monkeypatch.setattr(suffix_dedup, "HOT", 0)
    assert got() == want and any(r[2] for r in want)


def test_windows_go_in_parts(monkeypatch):
    import pyarrow as pa
    rows = [(i, True, i, i, False, 0, n, bytes((7 * i + k) % 251 for k in range(n + 199))) for i, n in enumerate((3, 50, 1, 400, 2))]
    types = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.binary())
    batch = pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["h", "hot", "doc", "rid", "none", "first", "count", "data"])
    flat = lambda: [x for b in suffix_dedup._windows(iter([batch, batch.slice(0, 0)])) for x in zip(*(c.to_pylist() for c in b.columns))]
    whole = flat()
    assert len(whole) == 456
    monkeypatch.setattr(suffix_dedup, "CHUNK", 40)
    assert flat() == whole
