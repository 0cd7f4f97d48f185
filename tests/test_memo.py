"""Readers that remember what they have read."""
from pyspark.sql import functions as F

from graphmill.sources import memo
from graphmill.sources.decorated import decorated

FILES = "project string, path string, content string"


def dto(n):
    return f"export class A{n} {{ @IsString() a{n}: string; }}"


def test_only_new_contents_are_read(spark, tmp_path):
    folder, read = f"file://{tmp_path}/memo", []

    def reader(files):
        read.append(sorted(r.content for r in files.collect()))
        return decorated(files)

    def run(*files):
        x = memo.remembered(spark.createDataFrame(list(files), FILES), reader, folder)
        return sorted((r.project, r.path, r["class"]) for r in x.collect())

    assert run(("p", "a.ts", dto(1)), ("p", "copy.ts", dto(1)), ("q", "n.ts", None), ("q", "e.ts", "")) == [("p", "a.ts", "A1"), ("p", "copy.ts", "A1")]
    assert run(("p", "moved.ts", dto(1)), ("p", "b.ts", dto(2)), ("p", "b.d.ts", dto(2))) == [("p", "b.ts", "A2"), ("p", "moved.ts", "A1")]
    assert run(("p", "b.ts", dto(3)), ("p", "a.ts", dto(1))) == [("p", "a.ts", "A1"), ("p", "b.ts", "A3")]
    assert run(("p", "b.ts", dto(2))) == [("p", "b.ts", "A2")]
    assert read == [["", dto(1)], [dto(2), dto(2)], [dto(3)], []]  # an ending of its own is read for itself


def test_a_run_that_broke_off_does_not_count(spark, tmp_path):
    folder = f"file://{tmp_path}/memo"
    files = spark.createDataFrame([("p", "a.ts", dto(1))], FILES)
    memo.remembered(files, decorated, folder)
    broken = decorated(memo.unread(spark.createDataFrame([("p", "b.ts", dto(2))], FILES), folder)).withColumn("_run", F.lit("00000001-x"))
    broken.write.mode("append").parquet(f"{folder}/rows")  # no index follows
    both = files.unionByName(spark.createDataFrame([("p", "b.ts", dto(2))], FILES))
    assert sorted(r["class"] for r in memo.remembered(both, decorated, folder).collect()) == ["A1", "A2"]
    memo.forget(spark, folder)
    assert memo.remembered(files.limit(0), decorated, folder).count() == 0
