"""Selections over nodes, edges and routes; each returns a new selection, and ``df`` is its DataFrame."""
from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.facts import fact_rows
from ..schema import to_ir
from ..sources.corpus import Corpus, nested


@dataclass(frozen=True)
class Nodes:
    corpus: Corpus
    df: DataFrame

    def where(self, condition: Column) -> Nodes:
        return replace(self, df=self.df.where(F.coalesce(condition, F.lit(False))))

    def of_type(self, *types: str) -> Nodes:
        return self.where(F.col("ir_type").isin(*map(to_ir, types)))

    def with_symbol(self, part: str) -> Nodes:
        return self.where(F.lower("symbol").contains(part.lower()))

    def with_role(self, role: str) -> Nodes:
        return self.where(F.col("role") == role)

    def connected_to(self, targets: Nodes, relation: str | None = None) -> Nodes:
        """Nodes with an edge into one of the targets."""
        e = self.corpus.edges if relation is None else self.corpus.edges.where(F.col("relation") == relation)
        into = e.join(targets.df.select("graph_id", F.col("node_ord").alias("dst")), ["graph_id", "dst"], "left_semi")
        return replace(self, df=self.df.join(into.select("graph_id", F.col("src").alias("node_ord")), ["graph_id", "node_ord"], "left_semi"))

    def without_incoming(self, relation: str) -> Nodes:
        into = self.corpus.edges.where(F.col("relation") == relation).select("graph_id", F.col("dst").alias("node_ord"))
        return replace(self, df=self.df.join(into, ["graph_id", "node_ord"], "left_anti"))

    def by_ids(self, *ids: str) -> Nodes:
        return self.where(F.col("id").isin(*ids))

    def terminals(self) -> DataFrame:
        """graph_id of every graph, with found, n, nodes (in order) and by_id of the selection."""
        rest = [c for c in ("id", "type", "ir_type", "symbol", "role") if c in self.df.columns]
        own = F.array_sort(F.collect_list(F.struct("node_ord", *rest)))
        got = self.df.groupBy("graph_id").agg(own.alias("nodes"), F.map_from_entries(F.collect_list(F.struct("id", F.struct("node_ord", *rest)))).alias("by_id"))
        out = self.corpus.graphs.select("graph_id").join(got, "graph_id", "left")
        kinds = {f.name: f.dataType for f in out.schema}
        out = out.withColumns({"nodes": F.coalesce("nodes", F.array().cast(kinds["nodes"])), "by_id": F.coalesce("by_id", F.create_map().cast(kinds["by_id"]))})
        return out.select("graph_id", (F.size("nodes") > 0).alias("found"), F.size("nodes").cast("bigint").alias("n"), "nodes", "by_id")

    def first(self) -> DataFrame:
        """Each graph's first node of the selection."""
        rest = [c for c in self.df.columns if c not in ("graph_id", "node_ord")]
        got = self.df.groupBy("graph_id").agg(F.min_by(F.struct("node_ord", *rest), "node_ord").alias("n"))
        return got.select("graph_id", "n.*")


@dataclass(frozen=True)
class Edges:
    corpus: Corpus
    df: DataFrame

    def of_relation(self, *relations: str) -> Edges:
        return replace(self, df=self.df.where(F.col("relation").isin(*relations)))

    def _at(self, end: str, node_id: str) -> Edges:
        n = self.corpus.nodes.where(F.col("id") == node_id).select("graph_id", F.col("node_ord").alias(end))
        return replace(self, df=self.df.join(n, ["graph_id", end], "left_semi"))

    def leaving(self, node_id: str) -> Edges:
        return self._at("src", node_id)

    def entering(self, node_id: str) -> Edges:
        return self._at("dst", node_id)

    def between(self, source: str, target: str) -> Edges:
        """Edges whose ends have these types, as written in the graph."""
        n = self.corpus.nodes
        a = n.where(F.col("type") == source).select("graph_id", F.col("node_ord").alias("src"))
        b = n.where(F.col("type") == target).select("graph_id", F.col("node_ord").alias("dst"))
        return replace(self, df=self.df.join(a, ["graph_id", "src"], "left_semi").join(b, ["graph_id", "dst"], "left_semi"))

    def to_nodes(self) -> Nodes:
        return Nodes(self.corpus, self.corpus.nodes.join(self.df.select("graph_id", F.col("dst").alias("node_ord")), ["graph_id", "node_ord"], "left_semi"))

    def from_nodes(self) -> Nodes:
        return Nodes(self.corpus, self.corpus.nodes.join(self.df.select("graph_id", F.col("src").alias("node_ord")), ["graph_id", "node_ord"], "left_semi"))


def nodes(corpus: Corpus) -> Nodes:
    return Nodes(corpus, corpus.nodes)


def edges(corpus: Corpus) -> Edges:
    return Edges(corpus, corpus.edges)


class Routes:
    """Graphs by their fact rows; every filter returns a new selection, and ``df`` is its DataFrame."""

    def __init__(self, corpus: Corpus, df: DataFrame | None = None):
        self.corpus, self.df = corpus, fact_rows(corpus) if df is None else df

    def matching(self, condition: Column) -> Routes:
        """Any condition over the columns of a fact row; null counts as false."""
        return Routes(self.corpus, self.df.where(F.coalesce(condition, F.lit(False))))

    def with_method(self, *methods: str) -> Routes:
        return self.matching(F.upper("method").isin(*map(str.upper, methods)))

    def mutations(self) -> Routes:
        return self.matching(F.col("is_mutation"))

    def readonly(self) -> Routes:
        return self.matching(~F.col("is_mutation"))

    def authenticated(self) -> Routes:
        return self.matching(F.col("has_auth"))

    def unauthenticated(self) -> Routes:
        return self.matching(~F.col("has_auth"))

    def with_authorization(self) -> Routes:
        return self.matching(F.col("has_authz"))

    def without_authorization(self) -> Routes:
        return self.matching(~F.col("has_authz"))

    def with_transaction(self) -> Routes:
        return self.matching(F.col("has_txn"))

    def without_transaction(self) -> Routes:
        return self.matching(~F.col("has_txn"))

    def with_escape(self) -> Routes:
        return self.matching(F.col("has_escape"))

    def with_unscoped_access(self) -> Routes:
        return self.matching(F.col("has_unscoped"))

    def with_dispatch(self) -> Routes:
        return self.matching(F.col("has_dispatch"))

    def with_tenant_context(self) -> Routes:
        return self.matching(F.col("has_tenant"))

    def count(self) -> int:
        return self.df.count()

    def map(self, *columns: Column) -> DataFrame:
        return self.df.select(*columns)


def routes(corpus: Corpus, *conditions: Column) -> DataFrame:
    """Fact rows that meet all conditions."""
    out = Routes(corpus)
    for c in conditions:
        out = out.matching(c)
    return out.df


def find_routes(corpus: Corpus, part: str) -> DataFrame:
    """Graphs whose entrypoint holds a text, in any case."""
    return corpus.graphs.where(F.contains(F.lower("entrypoint"), F.lit(part.lower())))


def normal_entrypoint(entrypoint):
    """Parameters have any name."""
    return F.regexp_replace(entrypoint, r"\{[^}]+\}", "{*}")


def match_entrypoint(corpus: Corpus, entrypoint: str) -> DataFrame:
    """The first graph of an entrypoint, whatever its parameters are called; no row if there is none."""
    hits = corpus.graphs.where(normal_entrypoint(F.col("entrypoint")) == normal_entrypoint(F.lit(entrypoint)))
    rest = [c for c in hits.columns if c != "graph_id"]
    return hits.agg(F.min_by(F.struct("graph_id", *rest), "graph_id").alias("g")).where("g is not null").select("g.*")


def missing_ids(corpus: Corpus, wanted: DataFrame) -> DataFrame:
    """Of (graph_id, id) those that aren't nodes of their graph."""
    return wanted.join(corpus.nodes.select("graph_id", "id"), ["graph_id", "id"], "left_anti").select("graph_id", "id")


def chain(corpus: Corpus) -> DataFrame:
    """(graph_id, src, dst): every node with the next one of its graph."""
    following = F.lead("node_ord").over(Window.partitionBy("graph_id").orderBy("node_ord"))
    return corpus.nodes.select("graph_id", F.col("node_ord").alias("src"), following.alias("dst")).where("dst is not null")


def paths_from_roots(corpus: Corpus) -> DataFrame:
    """graph_id, path: symbols breadth-first from the nodes that no edge enters, in node order; graphs in which all nodes are entered have none."""
    rest = "slice(s.q, 2, size(s.q))"
    walk = f"""aggregate(sequence(0, size(e) + size(n)), named_struct('o', cast(array() as array<bigint>), 'q', transform(filter(n, x -> NOT exists(e, y -> y.dst = x.ord)), x -> x.ord)), (s, i) -> CASE WHEN size(s.q) = 0 THEN s
      WHEN array_contains(s.o, s.q[0]) THEN named_struct('o', s.o, 'q', {rest})
      ELSE named_struct('o', concat(s.o, array(s.q[0])), 'q', concat({rest}, transform(filter(e, y -> y.src = s.q[0] AND y.dst <> s.q[0] AND NOT array_contains(s.o, y.dst)), y -> y.dst))) END, s -> transform(s.o, v -> get(n, cast(v - 1 as int)).symbol))"""
    return nested(corpus).select("graph_id", F.expr(walk).alias("path"))
