"""Facts of code and what an augmentation joins are never broadcast: their files are small, their rows aren't."""
from pyspark.sql import functions as F

from graphmill.operators import augment
from graphmill.operators.code import Facts
from graphmill.sources import syntax


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_augmentation_broadcasts_no_facts(spark):
    plans = []

    def stub(schema):
        """A table that Spark takes for small."""
        return spark.range(1).select(F.from_json(F.col("id").cast("string"), schema).alias("x")).select("x.*")

    def keep(df, name):
        plans.append(_plan(df))
        return stub(df.schema)

    p = augment.Passes(Facts(stub(syntax.SYNTAX), keep), stub("symbol string"), keep=keep)
    entries, files = stub("graph_id long, project string, path string, class string, method string, caller string"), stub("project string, path string, content string")
    a = augment.augment(entries, p, files)
    plans += map(_plan, [a.nodes, a.edges, a.annotations, *augment.expanded(augment.roots(entries, p), p, keep=keep)])
    # the audit sinks alone
    assert sum(x.count("BroadcastHashJoin") for x in plans) <= 1 and sum(x.count("SortMergeJoin") for x in plans) > 50
