"""Files made from a small table are read by many tasks."""
from pyspark.sql import functions as F

from graphmill.sources import projects


def test_one_file_of_keys_makes_files_for_many_tasks(spark, tmp_path):
    spark.range(40).select(F.col("id").alias("p_partkey"), F.lit("b").alias("p_brand")).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    files = projects.project_files(spark, str(tmp_path)).select("path", F.spark_partition_id().alias("task")).where("path like '%Controllers/%'")
    assert files.count() == 40
    assert files.select("task").distinct().count() >= 3
