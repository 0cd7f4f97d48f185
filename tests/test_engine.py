import os

import duckdb
import pytest

from graphmill import catalog
from graphmill.plans import language

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    clean = lambda v: round(v, 5) if isinstance(v, float) else v
    return sorted(tuple(str(clean(r[i])) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_agrees_with_sql(spark, con, name):
    df = catalog.queries()[name](spark, SF)
    if name not in catalog.oracle_sql():
        assert df.count() > 0
        return
    got = con.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in got.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(columns, got.fetchall())


def test_precedence():
    assert language.parse("a OR b AND NOT c") == language.Both("or", language.Pred("a"), language.Both("and", language.Pred("b"), language.Not(language.Pred("c"))))
    assert language.parse("MATCH a -> b").names == ("a", "b")
    assert language.parse("find route where Public") == language.Pred("public")


@pytest.mark.parametrize("text", ["", "auth AND", "a->b", "(auth", "auth auth", "MATCH and"])
def test_bad_queries(text):
    with pytest.raises(SyntaxError):
        language.parse(text)


def test_unknown_predicate():
    with pytest.raises(SyntaxError):
        language.compile_tree(language.parse("nonsense"))


def test_all_arguments_count(spark):
    from pyspark.sql import types as T

    from graphmill import schema
    from graphmill.operators import retrieve
    from graphmill.sources.corpus import from_nested
    args = (["x", "one"], ["x", "two"], ["x", "one"], [], None)
    nodes = [{"id": str(i), "type": kind, "symbol": "A::b", "args": a} for i, (kind, a) in enumerate([*(("ir:txn_write", a) for a in args), ("ir:service_call", ["x"]), ("ir:service_call", ["x"])])]
    edges = [{"from": "2", "to": "4", "relation": "r"}, {"from": "0", "to": "3", "relation": "r"}, {"from": "0", "to": "9", "relation": "r"}]
    data = [("g", "GET /", "GET", "/", "f", [tuple(n.get(f.name) for f in schema.NODE) for n in nodes], [tuple(e.get(f.name) for f in schema.EDGE) for e in edges], [])]
    corpus = from_nested(spark.createDataFrame(data, T.StructType([T.StructField("graph_id", T.StringType()), *schema.GRAPH.fields])))
    merged = retrieve.deduplicate(corpus)
    assert sorted((r.node_ord, r.occurrences) for r in merged.nodes.collect()) == [(1, 2), (2, 1), (4, 2), (6, 1), (7, 1)]
    assert [(r.src, r.dst) for r in merged.edges.collect()] == [(1, 4)]
    assert [r.node_ord for r in retrieve.rank_nodes(merged, "the two").orderBy("rank").collect()] == [2, 6, 7, 1, 4]
    got = retrieve.retrieve(corpus, "the two").first()
    assert [x.ord for x in got.nodes] == [2, 6, 7, 1, 4] and [(e.src, e.dst) for e in got.edges] == [(1, 4)] and not got.pruned
