"""Readers that remember: of a set of files only contents not read before are read, whatever their paths are now.

What a reader gives for a content lies as Parquet in a folder that all executors share, a run a subfolder; an index that is written behind
the rows says which contents a run holds, so a run that breaks off leaves nothing that counts.
"""
from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .corpus import _path

#: names of columns that no reader gives
INDEX = "_content string, _run string"


def _stored(spark: SparkSession, path: str, schema) -> DataFrame:
    fs, p = _path(spark, path)
    if not fs.exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(path)


def _index(spark: SparkSession, folder: str) -> DataFrame:
    """Contents by name, and the run that counts for each: the first of those that read it."""
    return _stored(spark, f"{folder}/index", INDEX).groupBy("_content").agg(F.min("_run").alias("_run"))


def _named(files: DataFrame) -> DataFrame:
    ending = F.regexp_extract("path", r"([.][^/]*)$", 1)
    return files.where("content is not null").select("project", "path", "content", F.concat(F.sha2("content", 256), ending).alias("_content"))


def unread(files: DataFrame, folder: str) -> DataFrame:
    """(project, path, content) of contents that no run holds, each once; the path is the content's name: its hash, and the endings of the file's name."""
    new = _named(files).join(_index(files.sparkSession, folder), "_content", "left_anti")
    return new.groupBy("_content").agg(F.first("content").alias("content")).select(F.lit("").alias("project"), F.col("_content").alias("path"), "content")


def remembered(files: DataFrame, read: Callable[[DataFrame], DataFrame], folder: str) -> DataFrame:
    """``read(files)``, with ``_run``: of which run each row is.  What ``read`` gives must have project and path and follow from the content and the endings of the file's name
    alone; files to be left out for their folder are left out before.  Null contents have no rows; a file that is gone has none either, though its content is kept."""
    spark = files.sparkSession
    new = unread(files, folder)
    run = F.lit(f"{_runs(spark, folder):08d}-{uuid.uuid4().hex}")
    rows = read(new).withColumn("_run", run)
    if not new.isEmpty():
        rows.write.mode("append").parquet(f"{folder}/rows")
        new.select(F.col("path").alias("_content"), run.alias("_run")).write.mode("append").parquet(f"{folder}/index")
    kept = _stored(spark, f"{folder}/rows", rows.schema).withColumnRenamed("path", "_content").drop("project")
    here = _named(files).drop("content").join(_index(spark, folder), "_content")
    return here.join(kept, ["_content", "_run"]).select(*rows.columns)


def _runs(spark: SparkSession, folder: str) -> int:
    return _stored(spark, f"{folder}/index", INDEX).agg(F.count_distinct("_run")).first()[0]


def forget(spark: SparkSession, folder: str) -> None:
    """Deletes what a folder remembers."""
    fs, p = _path(spark, folder)
    fs.delete(p, True)
