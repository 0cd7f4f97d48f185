"""Permissions and sources that are named many times are joined once."""
from graphmill.operators import project


def distinct_below_joins(df):
    """How many aggregates stand below the first join of a plan."""
    return df._jdf.queryExecution().optimizedPlan().toString().split("Join", 1)[1].count("Aggregate [")


def test_hierarchy_of_repeated_permissions(spark):
    p = spark.createDataFrame([(g, s) for g in (1, 2) for s in ("A", "A_ANY", "B", "C_ANY") for _ in range(60)], "graph_id long, symbol string")
    out = project.hierarchy(p)
    assert distinct_below_joins(out) == 2
    assert sorted(tuple(r) for r in out.collect()) == [(1, "A_ANY", "A"), (2, "A_ANY", "A")]


def test_reachable_permissions_of_repeated_sources(spark):
    p = spark.createDataFrame([(1, c, v) for c, v in (("C1", "v1"), ("C2", "v2"), ("C3", "v3")) for _ in range(50)], "graph_id long, class string, value string")
    s = spark.createDataFrame([(1, "use C1::X")] * 50 + [(1, "use C4::X")], "graph_id long, source string")
    a = spark.createDataFrame([(1, "v3")] * 50, "graph_id long, value string")
    out = project.reachable_permissions(p, s, a)
    assert distinct_below_joins(out) >= 4  # both sides of both joins
    assert sorted(tuple(r) for r in out.collect()) == [(1, "C1", "v1"), (1, "C3", "v3")]
