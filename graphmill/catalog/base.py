"""The registry of queries, and what their SQL shares."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict = {}
SQL: dict[str, str] = {}


def add(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f
    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def joined(*names: str, sort: bool = False) -> list[Column]:
    """Array columns as text, so that engines compare alike."""
    return [F.array_join(F.array_sort(n) if sort else F.col(n), ",").alias(n) for n in names]
