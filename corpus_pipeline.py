"""A training corpus from ``documents``: judge, take out repeated lines, drop near copies, mix sources, pack.

Each stage gets all rows that the one before it kept, as Parquet, and returns the columns of documents; the last returns
pieces of packed sequences.
"""
from pyspark.sql import DataFrame, SparkSession

from graphmill.llm import line_dedup, mixing, near_dedup, packing, quality
from graphmill.llm.common import materialize, release, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; without labels none do."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def fuzzy_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of lines that are alike the first stays; documents left without text go."""
    return line_dedup.drop_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents alike in five-word shingles, that with the least doc_id stays."""
    return near_dedup.drop_near(docs, width=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in training order."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("quality classifier", quality_classifier), ("line dedup", fuzzy_lines), ("MinHash near-dedup", near_duplicates), ("mixing sources", mix_sources), ("packing", pack_sequences)]

#: the classifier is trained, and similarity components are iterative: tests run the stages on a small table, and hold their operators against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{k}")
            release(spark)
    return docs
