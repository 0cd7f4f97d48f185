"""A trace's graphs are counted without making a row of every node for each count."""
from graphmill.catalog import scores


def test_captures_do_not_multiply_nodes(spark):
    new, old = scores._captures(spark, "/root/testdata/sf0.001")
    for g in (new, old):
        assert "Expand" not in g._jdf.queryExecution().optimizedPlan().toString()
    assert all(0 <= r.recall <= 1 and r.compression >= 0 for r in old.collect())


def test_a_capture_collects_no_sets(spark):
    """Types of a route are told by bits: no buffer grows with the route's graphs."""
    from graphmill.operators import baseline
    from graphmill.sources.corpus import Corpus
    graphs = spark.createDataFrame([(1, "GET /a"), (2, "GET /a"), (3, "GET /b")], "graph_id long, entrypoint string")
    nodes = spark.createDataFrame([(1, "ir:txn_boundary"), (1, "ir:auth_gate"), (2, "ir:auth_gate"), (2, "ir:mail"), (2, None)], "graph_id long, type string")
    got = baseline.capture(Corpus(graphs, nodes, None))
    assert "collect_" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.select("entrypoint", "types", "n_nodes").collect())) == [("GET /a", ["ir:auth_gate", "ir:txn_boundary"], 3), ("GET /b", [], 0)]


def test_a_diff_of_captures_writes_no_edges(spark, monkeypatch):
    from graphmill.catalog import retrieval
    from graphmill.sources import corpus

    def edges(self):
        raise AssertionError("edges were asked for")
    monkeypatch.setattr(corpus.Derived, "edges", property(edges))
    assert retrieval.r12(spark, "/root/testdata/sf0.001").count() > 0
    assert retrieval.w01(spark, "/root/testdata/sf0.001").count() > 0
