"""Streams against the batch result over the same rows."""
import json

from pyspark.sql import functions as F

from graphmill.functions.score import last_turns
from graphmill.sources import loaders
from graphmill.streaming import runtime
from graphmill.streaming.state import stream_last_turns

SF = "/root/testdata/sf0.001"


def in_files(df, path, n=3):
    for k in range(n):
        df.where(F.pmod(F.hash(*df.columns), F.lit(n)) == k).coalesce(1).write.mode("append").parquet(path)


def drained(stream, tmp_path, mode, keep):
    q = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination()


def test_last_turns(spark, tmp_path):
    turns = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role")
    in_files(turns, f"file://{tmp_path}/in")
    got = {}

    def keep(df, _):
        for conv, rows in df.toPandas().groupby("conv_id"):
            got[conv] = set(zip(rows["turn"], rows["role"]))

    source = spark.readStream.schema(turns.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    drained(stream_last_turns(source), tmp_path, "update", keep)
    want = {}
    for r in last_turns(turns).collect():
        want.setdefault(r.conv_id, set()).add((r.turn, r.role))
    assert want and got == want


def test_queries_repeated_under_a_parent(spark, tmp_path):
    """The stream finds what the batch query finds on the same spans."""
    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    spans = runtime.spans(events).join(events.select(F.col("event_id").alias("span_id"), "ts"), "span_id")
    in_files(spans, f"file://{tmp_path}/in")
    got = {}
    source = spark.readStream.schema(spans.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")

    def keep(df, _):
        got.update({(r.session_id, r.parent_id, r.table): (r.n, r.severity) for r in df.collect()})

    drained(runtime.stream_n_plus_one(source, 2, "400 days"), tmp_path, "update", keep)
    want = {(r.session_id, r.parent_id, r.table): (r.n, r.severity) for r in runtime.n_plus_one(spans, 2).collect()}
    assert want and got == want


def test_batches_of_spans_that_a_collector_drops(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(2):
        span = {"traceId": f"t{k}", "spanId": "a", "name": "GET /x", "startTimeUnixNano": "1", "endTimeUnixNano": "2"}
        (tmp_path / "in" / f"{k}.json").write_text(json.dumps({"resourceSpans": [{"scopeSpans": [{"spans": [span]}]}]}))
    got = []
    drained(loaders.stream_otlp(spark, f"file://{tmp_path}/in"), tmp_path, "append", lambda df, _: got.extend(loaders.otlp(df).collect()))
    assert sorted(r.session_id for r in got) == ["t0", "t1"]
