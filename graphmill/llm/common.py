"""Reading tables, cutting lineage into shared scratch tables, freeing shuffles."""
from __future__ import annotations

import atexit
import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: rows in one Arrow batch handed to Python; long texts make larger batches dear
ARROW_ROWS = 256

_own: dict[str, SparkSession] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session; in local mode, where it is unset, one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="graphmill-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/graphmill/{label}-{uuid.uuid4().hex}"
    _own[path] = spark
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a frame as Parquet into the shared folder and read it back: lineage ends there, and lost executors cost a reread only."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def drop(*frames: DataFrame) -> None:
    """Delete scratch tables that no later step reads."""
    for df in frames:
        path = getattr(df, "_scratch", None)
        if path and path in _own:
            _remove(_own.pop(path), path)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner see that finished stages' shuffle files are no longer needed, so that disk holds one phase at a time."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def cleanup() -> None:
    """Delete every scratch table of this process; frames that still read one must be consumed before."""
    for path, spark in list(_own.items()):
        try:
            _remove(spark, path)
        except Exception:  # the JVM has ended already
            pass
    _own.clear()


atexit.register(cleanup)


def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Bound what one Arrow batch holds: texts may be very long, so few rows travel at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def boxed(docs: DataFrame) -> DataFrame:
    """One column ``row`` that holds all of ``docs``, so that whatever its columns are called, an operator's own names don't clash with them."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


def partitions(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))
