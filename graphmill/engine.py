"""One object with the verbs that tools and commands use, each a DataFrame over one corpus of graphs."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import analysis, baseline, detect, evidence, fluent, render, retrieve
from .plans import language
from .sources import loaders
from .sources.corpus import Corpus, derived, from_nested


def detect_framework(files: DataFrame) -> DataFrame:
    """Files (project, path, content) -> project, framework: nestjs by its own file, go by a module that asks for gin, springboot by a build file that names it, else laravel."""
    has = lambda pattern, words=None: F.bool_or(F.col("path").rlike(pattern) & (F.lit(True) if words is None else F.coalesce(F.contains("content", F.lit(words)), F.lit(False))))
    g = files.groupBy("project").agg(has(r"(^|/)nest-cli\.json$").alias("nest"), has(r"(^|/)go\.mod$", "gin-gonic/gin").alias("go"), has(r"(^|/)(pom\.xml|build\.gradle(\.kts)?)$", "spring-boot").alias("spring"))
    return g.select("project", F.when(F.col("nest"), "nestjs").when(F.col("go"), "go").when(F.col("spring"), "springboot").otherwise("laravel").alias("framework"))


class Engine:
    """Opens a corpus once; every verb plans over its tables, and nothing runs before the result is read."""

    def __init__(self, corpus: Corpus):
        self.corpus = corpus
        self.spark: SparkSession = corpus.graphs.sparkSession

    @classmethod
    def of_json(cls, spark: SparkSession, path: str) -> Engine:
        """Graphs as JSON lines of ``schema.GRAPH`` with a graph_id."""
        from pyspark.sql import types as T

        from . import schema
        shape = T.StructType([T.StructField("graph_id", T.LongType()), *schema.GRAPH.fields])
        return cls(from_nested(spark.read.schema(shape).json(path)))

    @classmethod
    def of_tables(cls, spark: SparkSession, sf_dir: str) -> Engine:
        return cls(derived(spark, sf_dir))

    def only(self, condition: Column) -> Engine:
        """The same over the graphs that meet a condition on their table."""
        kept = self.corpus.graphs.where(condition)
        of = lambda t: t.join(kept.select("graph_id"), "graph_id", "left_semi")
        c = self.corpus
        return Engine(Corpus(kept, of(c.nodes), of(c.edges), None if c.annotations is None else of(c.annotations)))

    def of_entrypoint(self, entrypoint: str) -> Engine:
        """The first graph of an entrypoint, whatever its parameters are called."""
        first = fluent.match_entrypoint(self.corpus, entrypoint).select("graph_id")
        of = lambda t: t.join(F.broadcast(first), "graph_id", "left_semi")
        c = self.corpus
        return Engine(Corpus(of(c.graphs), of(c.nodes), of(c.edges), None if c.annotations is None else of(c.annotations)))

    def list_entrypoints(self) -> DataFrame:
        n = self.corpus.nodes.groupBy("graph_id").agg(F.count("*").alias("n_nodes"))
        e = self.corpus.edges.groupBy("graph_id").agg(F.count("*").alias("n_edges"))
        out = self.corpus.graphs.select("graph_id", "entrypoint", "method", "path").join(n, "graph_id", "left").join(e, "graph_id", "left")
        return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_nodes", "n_edges")})

    def execution_graph(self, entrypoint: str, question: str | None = None, focus: str = "all") -> DataFrame:
        return retrieve.retrieve(self.of_entrypoint(entrypoint).corpus, question, focus)

    def findings(self, question: str | None = None) -> DataFrame:
        focus = "all"
        if question:
            focus = self.spark.range(1).select(evidence.focus(F.lit(question)).alias("f")).first()[0]
        return detect.explain(self.corpus, focus)

    explain = findings

    def evidence_package(self, question: str) -> DataFrame:
        return analysis.evidence_package(self.corpus, question)

    def trace(self, pattern: str, entrypoint: str | None = None) -> DataFrame:
        return analysis.request_trace(self.corpus, entrypoint or "") if pattern == "request" else analysis.trace(self.corpus, pattern)

    def dependents(self, symbol: str) -> DataFrame:
        return retrieve.dependents(self.corpus, symbol)

    deps = dependents

    def context(self) -> DataFrame:
        return analysis.context(self.corpus, detect.detect(self.corpus))

    def query(self, text: str) -> DataFrame:
        return language.query(self.corpus, text)

    def visualize(self) -> DataFrame:
        return render.report(self.corpus, detect.detect(self.corpus))

    def baseline(self, path: str, label: str = "default") -> None:
        loaders.save_baseline(baseline.capture(self.corpus), path, label)

    def diff(self, path: str, label: str = "default") -> DataFrame:
        return baseline.diff(baseline.capture(self.corpus), loaders.load_baseline(self.spark, path, label))

    def verify(self, path: str, label: str = "default", constraints: list[tuple[str, str, str]] = ()) -> DataFrame:
        """One row: ok, regressions, removed, stable, text, violations; it fails on either."""
        drift = render.verdict(self.diff(path, label), label)
        broken = evidence.check_constraints(self.corpus, list(constraints)).agg(F.count("*").alias("violations"))
        return drift.join(F.broadcast(broken)).withColumn("ok", F.col("ok") & (F.col("violations") == 0))

    def snapshot(self, path: str, at: str) -> None:
        loaders.append_snapshot(baseline.capture(self.corpus), path, at)

    def history(self, path: str) -> DataFrame:
        s = self.spark.read.parquet(path)
        return baseline.history(s.select("entrypoint", F.col("snapshot").cast("string").alias("snapshot"), "types"))

    def benchmark(self, golden: DataFrame) -> DataFrame:
        """Golden nodes (trace = entrypoint, golden_id, symbol, type, relevance) against what is retrieved for their entrypoint."""
        from .functions import score
        r = retrieve.retrieve(self.corpus).groupBy("entrypoint").agg(F.min_by("nodes", "graph_id").alias("n"))
        return score.retrieval_scores(golden, r.withColumnRenamed("entrypoint", "trace"))

    def invalidate_cache(self) -> None:
        """Forget what Spark keeps of the corpus's files, so that changed ones are read again."""
        for t in (self.corpus.graphs, self.corpus.nodes, self.corpus.edges):
            for f in t.inputFiles():
                self.spark.catalog.refreshByPath(f.rsplit("/", 1)[0])
