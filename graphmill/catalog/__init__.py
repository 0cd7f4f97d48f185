"""Every query of the engine by name, with the SQL that an independent engine must agree with; the SQL is written out, values included."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import code, findings, golang, project, readers, retrieval, routes, routing, runtime, scores, shapes  # noqa: F401: they register their queries
from .base import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["Q03_flagship"](spark, sf_dir)
