"""Every operator and stage on tables with null ids, repeated rows, ties, empty tables, and columns of any name."""
import random
from functools import partial

import pytest
from pyspark.sql import functions as F

import graphmill.llm.queries as registered
from graphmill.llm import exact_dedup, line_dedup, mixing, near_dedup, packing, quality, rules, suffix_dedup

EXTRA = ("_id", "y", "p", "_gone", "_doc", "_lines_gone", "position", "rank", "row", "rid", "h", "size", "use", "gone", "digest", "rep", "component_id", "bucket", "at", "lines", "keys", "id", "a", "b")


def rows():
    r = random.Random(11)
    vocabulary = ["".join(r.choices("abcdefgh", k=r.randint(2, 7))) for _ in range(200)]
    line = lambda n: " ".join(r.choices(vocabulary, k=n))
    texts = [line(80) + "\n" + line(12) for _ in range(14)]
    out = list(enumerate(texts))
    out += [(3, texts[3]), (3, texts[3]), (3, line(70)), (20, texts[5]), (21, texts[5].upper()), (None, texts[6]), (None, texts[6]), (None, line(60)), (None, None), (22, None), (23, ""), (24, " \n\t")]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.createDataFrame([(i, t, "en", "ab"[k % 2] if k % 5 else None, 0) for k, (i, t) in enumerate(rows())], "doc_id long, text string, lang string, source string, n_chars long")
    return d.select("*", *(F.lit(k).alias(c) for k, c in enumerate(EXTRA))).repartition(3).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, "x", 1.0) for i in range(24)] + [(None, 1, "x", 1.0), (4, None, "x", 1.0)], "doc_id long, quality int, _id string, y double")


def count(df):
    return len(df.collect())


def test_each_row_has_its_result(docs, labels):
    n = len(rows())
    assert count(quality.classify(docs, labels)) == n and count(rules.judge(docs, labels)) == n
    assert count(exact_dedup.exact_dedup(docs)) == n and count(suffix_dedup.cut_repeats(docs)) == n
    assert count(near_dedup.near_components(docs)) == n and count(mixing.plan_mix(docs)) == n
    assert count(line_dedup.dedup_lines(docs)) == n
    pieces = packing.pack(docs).collect()
    assert len({(r.doc_id, r.start) for r in pieces if r.doc_id is not None}) <= len(pieces) and sum(r.start == 0 for r in pieces) == n


def test_stages_keep_all_columns(docs, labels):
    for out in (quality.keep_good(docs, labels), line_dedup.drop_lines(docs), near_dedup.drop_near(docs), mixing.mix(docs)):
        assert out.columns == docs.columns
        got = out.collect()
        assert all(tuple(r[c] for c in EXTRA) == tuple(range(len(EXTRA))) for r in got)


def test_repeated_rows(docs):
    near = near_dedup.drop_near(docs).collect()
    assert sum(r.doc_id is None for r in near) == 4 and not any(r.doc_id in (20, 21) for r in near)
    exact = {(r.doc_id, r.kept, r.group_size) for r in exact_dedup.exact_dedup(docs).collect()}
    assert (3, True, 3) in exact and (5, False, 3) in exact and (21, True, 3) in exact
    plan = mixing.plan_mix(docs).collect()
    by = {}
    for r in plan:
        by.setdefault(r.source, [r.target, 0])[1] += r.taken
    words = {}
    for r in mixing.mix(docs).collect():
        words[r.source] = words.get(r.source, 0) + len((r.text or "").split())
    assert all(abs(t - n) <= 1 and words.get(s, 0) == n for s, (t, n) in by.items())


def test_empty_tables(docs, labels):
    none = docs.limit(0)
    assert [count(f(none)) for f in (exact_dedup.exact_dedup, suffix_dedup.cut_repeats, near_dedup.near_components, mixing.plan_mix, line_dedup.dedup_lines, packing.pack, near_dedup.drop_near, line_dedup.drop_lines, mixing.mix)] == [0] * 9
    assert count(quality.keep_good(none, labels)) == 0 and count(rules.judge(none, labels)) == 0 and count(quality.classify(docs, labels.limit(0))) == len(rows())


def test_the_pipeline(spark, tmp_path):
    pytest.importorskip("corpus_pipeline")
    import corpus_pipeline
    r = random.Random(21)
    vocabulary = ["".join(r.choices("abcdefgh", k=r.randint(2, 7))) for _ in range(400)]
    line = lambda n: " ".join(r.choices(vocabulary, k=n))
    texts = [line(60) + ".\n" + line(20) for _ in range(120)]
    good = [1] * 120
    for i in range(0, 120, 4):
        texts[i], good[i] = texts[i] + " ### $$$ %%%" * 15, 0
    table = [(i, t, "en", "abc"[i % 3], len(t)) for i, t in enumerate(texts)]
    table += [(200, texts[1] + " and", "en", "a", 0), (201, "Only this line, seen before elsewhere: " + line(5), "en", "b", 0), (202, None, "en", "a", 0)]
    table += [(203, table[-2][1], "en", "b", 0)]
    folder = f"file://{tmp_path}"
    spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, g, 0) for i, g in enumerate(good)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = quality.keep_good(docs, spark.read.parquet(f"{folder}/labels.parquet")).collect()
    ids = {x.doc_id for x in kept}
    assert not ids & set(range(0, 120, 4)) and len(ids & {i for i in range(120) if i % 4}) >= 85
    out = registered.pipeline(spark, folder).collect()
    assert out and {x.doc_id for x in out} <= ids and 200 not in {x.doc_id for x in out}
    bins = {}
    for x in out:
        bins.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for pieces in bins.values():
        end = 0
        for offset, n in sorted(pieces):
            assert offset == end
            end += n
        assert end <= 4096
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "MinHash near-dedup", "mixing sources", "packing"]


def test_recall_of_the_join_in_nodes_of_any_size(spark):
    """Families of near copies at the threshold: every link that brute force finds is found, with nodes branched from two members on."""
    from graphmill.llm import near
    r = random.Random(31)
    vocabulary = ["".join(r.choices("abcdefgh", k=6)) for _ in range(3000)]
    texts = []
    for _ in range(12):
        base = r.choices(vocabulary, k=120)
        for _ in range(12):
            t = list(base)
            for _ in range(r.randint(0, 4)):
                t[r.randrange(120)] = r.choice(vocabulary)
            texts.append(" ".join(t))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [near_dedup.shingles(near_dedup.words(t.encode()), 3) for t in texts]
    name = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            if name[i] != name[j] and near.alike(a, sets[j], 85):
                lo, hi = sorted((name[i], name[j]))
                name = [lo if x == hi else x for x in name]
    got = {x.doc_id: x.component_id for x in near_dedup.near_components(docs).collect()}
    assert [got[i] for i in range(len(texts))] == name
    keyed = spark.createDataFrame([(i // 36, i) for i in range(len(texts))], "key long, id long")  # nodes of three families
    contents = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    sets_of = partial(near_dedup._set_of, 3)
    found = near.similarity_components(keyed, lambda ids: (contents, lambda pairs: pairs.limit(0), near.Comparer(sets_of, 85, joining=True)), "recall", limit=4).collect()
    have = {x.id: x.component for x in found}
    assert [have.get(i, i) for i in range(len(texts))] == name
