"""Joins of the correlation step whose sides grow with the input send nothing whole to the driver."""
from graphmill.operators import render
from graphmill.streaming import correlate


def test_nothing_that_grows_is_broadcast(spark):
    spans = spark.createDataFrame([("s", k, 1, str(k), None if k == 1 else "1", "GET /x" if k == 1 else "db.select" if k == 3 else "A::b" if k == 2 else "other", 0, 1, None) for k in range(1, 6)], "session_id string, span_ord long, graph_id long, span_id string, parent_id string, name string, start_ns long, end_ns long, attributes map<string,string>")
    nodes = spark.createDataFrame([(1, 1, "A::b", "x")], "graph_id long, node_ord long, symbol string, type string")
    c = correlate.correlate(spans, nodes)
    gaps = correlate.gaps(spans, c)
    for df, n in ((c, 3), (correlate.infra_under(spans, c), 0), (gaps, 1), (render.gap_text(gaps, correlate.coverage(c)), 1)):
        assert df.count() == n
        df.collect()
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
