"""What is shuffled with texts in it."""
import pytest
from pyspark.sql import functions as F

from graphmill.llm import line_dedup, mixing


@pytest.fixture
def unbroadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def _plan(df) -> list[str]:
    return df._jdf.queryExecution().executedPlan().toString().split("\n")


def test_texts_of_lines_are_ruled_out_before_their_shuffle(unbroadcast, monkeypatch):
    shown = unbroadcast.range(1000).select(F.col("id").alias("line"), F.concat(F.lit("line "), F.col("id")).alias("text"))
    ids = unbroadcast.range(0, 1000, 100)
    texts = line_dedup.LineTexts(shown, ids)
    plans, write = {}, line_dedup.materialize
    monkeypatch.setattr(line_dedup, "materialize", lambda df, label: plans.update({label: _plan(df)}) or write(df, label))
    found = texts.texts(ids)
    plan = plans["line-texts"]
    # the first join over the scanned texts is that with the bitmaps, and the joins above it shuffle what it lets through
    assert "BroadcastHashJoin" in next(x for x in reversed(plan) if "Join" in x)
    assert [(r.id, r.text) for r in found.orderBy("id").collect()] == [(i, f"line {i}") for i in range(0, 1000, 100)]


def test_the_mix_shuffles_rows_once_for_its_plan(unbroadcast):
    docs = unbroadcast.range(200).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("s"), F.col("id") % 3)).alias("source"), F.repeat(F.lit("word "), (F.col("id") % 7).cast("int")).alias("text"))
    plan = _plan(mixing._planned(mixing._sized(docs), 8))
    top = next(k for k, x in enumerate(plan) if "Window [" in x)
    below = next(k for k, x in enumerate(plan) if k > top and "SortMergeJoin" in x)
    assert not any("Exchange" in x for x in plan[top:below])
    taken = mixing.plan_mix(docs, 8).groupBy("source").agg(F.sum("taken").alias("n"), F.max("target").alias("target")).collect()
    assert len(taken) == 3 and all(r.n == round(r.target) for r in taken)
