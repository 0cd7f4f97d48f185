from pyspark.sql import functions as F

from graphmill.functions import regress

ROW = "trace string, node_ids array<string>, critical array<string>, compression double, recall double"


def test_retrieval(spark):
    now = [("same", ["a", "b"], ["x"], 2.0, 0.96), ("order", ["b", "a"], [], 2.0, 1.0), ("sets", ["a", "c"], [], 1.5, 0.9), ("new", [], [], 1.0, 1.0), ("null", None, None, None, None)]
    was = [("same", ["a", "b"], ["x"], 2.4, 1.0), ("order", ["a", "b"], ["x"], 2.0, 1.0), ("sets", ["a", "b"], [], 2.0, 1.0), ("gone", [], [], 1.0, 1.0), ("null", None, [], 0.0, 1.0)]
    got = {r.trace: (r.status, r.reasons) for r in regress.verify_retrieval(spark.createDataFrame(now, ROW), spark.createDataFrame(was, ROW)).collect()}
    assert got == {
        "same": ("same", []), "order": ("changed", ["order", "critical types"]), "sets": ("changed", ["nodes added", "nodes removed", "recall", "compression"]),
        "new": ("new", []), "gone": ("gone", []), "null": ("same", []),
    }


def test_answers(spark):
    row = "trace string, mean double, deviation double"
    now = [("steady", 0.72, 0.0), ("drop", 0.7, 0.02), ("within", 0.6, 0.2), ("shaky", 0.8, 0.11), ("quiet", 0.8, 0.1)]
    was = [("steady", 0.75, 0.0), ("drop", 0.8, 0.02), ("within", 0.75, 0.2), ("shaky", 0.8, 0.05), ("quiet", 0.8, 0.01)]
    got = {r.trace: r.reasons for r in regress.verify_answers(spark.createDataFrame(now, row), spark.createDataFrame(was, row)).collect()}
    assert got == {"steady": [], "drop": ["score"], "within": [], "shaky": ["reliability"], "quiet": []}


def test_savings_and_errors(spark):
    df = spark.createDataFrame([(1000, 300), (0, 10), (None, 5)], "naive long, tokens long")
    assert [tuple(r[0]) for r in df.select(regress.savings(F.col("naive"), F.col("tokens"))).collect()] == [(3.33, 70.0), (1.0, 0.0), (1.0, 0.0)]
    a = spark.createDataFrame([("x", "HIGH", "LOW", "why", ["n"], []), (None, "INFO", None, "", None, ["r"])], "finding_type string, severity string, confidence string, explanation string, key_nodes array<string>, recommendations array<string>")
    assert [r[0] for r in a.select(regress.response_errors(a)).collect()] == [[], ["finding_type", "severity", "confidence", "explanation", "key_nodes"]]
    bare = a.select("finding_type")
    assert "recommendations" in bare.select(regress.response_errors(bare)).first()[0]
