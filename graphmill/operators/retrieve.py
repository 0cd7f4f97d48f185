"""Retrieval within graphs: deduplication, ranking by query words, pruning, serialising, token budgets, dependents, traversal."""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import HIGH, INDEXED, MEDIUM, MERGED, SIDE_EFFECTS, relevance
from ..sources.corpus import Corpus, nested

# fixed values: words that carry no meaning in a question, relevance that a focus asks for, sections of node types, the token budget
STOP = {
    "the", "is", "are", "for", "this", "that", "what", "how", "can", "does", "will", "not", "any", "all", "and", "but", "with", "from",
    "has", "have", "was", "were", "been", "get", "got", "use", "used", "via", "its", "our", "there", "here", "also", "just", "should",
    "would", "could", "when", "where", "which", "who", "why",
}
FOCUS_LEAST = {"auth": 2, "validation": 1, "runtime": 1, "transaction": 2, "isolation": 2}
SECTIONS = {
    "MIDDLEWARE CHAIN": ("ir:auth_gate", "middleware", "authentication_gate", "authorization_check", "rate_limiter"),
    "HANDLER": ("ir:business_handler", "controller", "controller_action"),
    "VALIDATION": ("ir:validation_gate", "form_request"),
    "AUTHORIZATION": ("ir:authz_check", "ir:permission_constant", "ir:service_call", "policy", "permission", "service_call"),
    "RUNTIME": ("ir:runtime_inject", "ir:runtime_consume", "ir:tenant_context", "runtime_injection"),
}
BUDGET = 2500


def keywords(text: str | None) -> list[str]:
    return [w for w in re.split(r"\W+", (text or "").lower()) if len(w) >= 3 and w not in STOP]


def _key() -> list[Column]:
    return [F.col("graph_id"), F.when(F.col("type").isin(*MERGED), F.concat_ws("|", "type", "symbol", F.array_join("args", ","))).otherwise(F.concat(F.lit("#"), "node_ord"))]


def deduplicate(corpus: Corpus) -> Corpus:
    """Nodes whose repetition says nothing more (writes, queries, boundaries of one symbol and arguments) become the first of them, with ``occurrences``; edges follow, each once.

    The nodes are shuffled once; edges get their ends' places from the nodes that went.
    """
    w = Window.partitionBy(*_key())
    n = corpus.nodes.withColumn("first", F.min("node_ord").over(w)).withColumn("occurrences", F.count("*").over(w))
    kept = n.where("node_ord = first").drop("first")
    gone = n.where("node_ord <> first").select("graph_id", F.col("node_ord").alias("old"), "first")
    e = corpus.edges
    for end in ("src", "dst"):
        e = e.join(gone.withColumnsRenamed({"old": end, "first": "new"}), ["graph_id", end], "left").withColumn(end, F.coalesce("new", end)).drop("new")
    first = F.row_number().over(Window.partitionBy("graph_id", "src", "dst", "relation").orderBy("edge_ord"))
    e = e.withColumn("nth", first).where("nth = 1").drop("nth").select(*corpus.edges.columns)
    return Corpus(corpus.graphs, kept, e, corpus.annotations)


def _score(words: list[str]) -> Column:
    hay = F.lower(F.concat_ws(" ", "symbol", "args"))
    return sum((hay.contains(w).cast("int") for w in words), F.lit(0)).cast("bigint")


def rank_nodes(corpus: Corpus, text: str | None) -> DataFrame:
    """The nodes with ``score`` and ``rank`` in their graph: merged ones last, then by words of the question, relevance and place; without words by place."""
    words = keywords(text)
    merged = F.col("occurrences") > 1 if "occurrences" in corpus.nodes.columns else F.lit(False)
    order = [merged, F.desc("score"), F.desc("relevance"), "node_ord"] if words else ["node_ord"]
    n = corpus.nodes.withColumn("score", _score(words)).withColumn("relevance", relevance(F.col("ir_type")))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy("graph_id").orderBy(*order)).cast("bigint")).drop("relevance")


def _among(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """Edges between kept nodes."""
    k = kept.select("graph_id", "node_ord")
    e = edges.join(k.withColumnRenamed("node_ord", "src"), ["graph_id", "src"], "left_semi")
    return e.join(k.withColumnRenamed("node_ord", "dst"), ["graph_id", "dst"], "left_semi")


def prune(corpus: Corpus, least: int) -> Corpus:
    """Nodes of a relevance and the edges between them."""
    kept = corpus.nodes.where(relevance(F.col("ir_type")) >= least)
    return Corpus(corpus.graphs, kept, _among(corpus.edges, kept), corpus.annotations)


def prune_by_side_effects(corpus: Corpus) -> Corpus:
    """Nodes with side effects, the handler, and the edges between them."""
    kept = corpus.nodes.where(F.col("type").isin(*SIDE_EFFECTS))
    return Corpus(corpus.graphs, kept, _among(corpus.edges, kept), corpus.annotations)


def _nodes_of(n: str, times: str = "1L") -> str:
    """SQL for nodes as ``_body`` reads them."""
    return f"transform({n}, x -> named_struct('ord', x.ord, 'id', x.id, 'type', x.type, 'ir', x.ir, 'symbol', x.symbol, 'args', x.args, 'role', x.role, 'times', {times}))"


def _body(n: str, e: str, pruned: str = "false") -> str:
    """SQL for a graph as people read it: nodes by section, what repeats, and connections but the order of middleware."""
    known = [t for kinds in SECTIONS.values() for t in kinds]
    line = """concat('  → ', x.symbol, CASE WHEN size(x.args) > 0 THEN concat(' [', array_join(x.args, ', '), ']') ELSE '' END,
      CASE WHEN coalesce(x.role, '') <> '' THEN concat(' (', x.role, ')') ELSE '' END, CASE WHEN x.times > 1 THEN concat(' ×', x.times) ELSE '' END)"""
    block = lambda heading, lines: f"CASE WHEN size({lines}) > 0 THEN concat(array('{heading}'), {lines}, array('')) ELSE array() END"
    parts = [f"CASE WHEN {pruned} THEN array('(pruned to relevant nodes only)', '') ELSE array('') END"]
    for name, kinds in SECTIONS.items():
        parts.append(block(f"[{name}]", f"transform(filter({n}, x -> x.type IN {kinds}), x -> {line})"))
    parts.append(block("[OTHER]", f"transform(filter({n}, x -> x.type NOT IN {tuple(known)}), x -> {line})"))
    kinds = f"array_distinct(transform(filter({n}, x -> x.times > 1), x -> x.type))"
    summed = f"transform({kinds}, k -> concat(aggregate(filter({n}, x -> x.times > 1 AND x.type = k), 0L, (s, x) -> s + x.times), '× ', k))"
    parts.append(f"CASE WHEN size({kinds}) > 0 THEN array('[EXECUTION CHARACTERISTICS]', concat('  ', array_join({summed}, ', ')), '') ELSE array() END")
    name = lambda end: f"get(filter({n}, x -> x.ord = y.{end}), 0).id"
    how = f"concat('  ', {name('src')}, ' → ', {name('dst')}, ' (', y.rel, CASE WHEN coalesce(y.mech, '') <> '' THEN concat(' via ', y.mech) ELSE '' END, ')')"
    parts.append(block("[CONNECTIONS]", f"transform(filter({e}, y -> y.rel <> 'next_middleware'), y -> {how})"))
    return f"array_join(concat({', '.join(parts)}), '\\n')"


def bodies(corpus: Corpus) -> DataFrame:
    """graph_id, body: every graph for people to read."""
    return nested(corpus).withColumn("m", F.expr(_nodes_of("n"))).select("graph_id", F.expr(_body("m", "e")).alias("body"))


def token_estimate(corpus: Corpus) -> DataFrame:
    """graph_id, tokens: a quarter of the characters of a graph's body, rounded up."""
    return bodies(corpus).select("graph_id", F.ceil(F.length("body") / 4).cast("bigint").alias("tokens"))


def _pruned(graphs: DataFrame, keep: str, when: str = "true") -> DataFrame:
    """``m`` without the nodes that don't meet ``keep``, and ``e`` between the rest, in graphs for which ``when`` holds."""
    g = graphs.withColumn("m", F.expr(f"CASE WHEN {when} THEN filter(m, x -> {keep}) ELSE m END"))
    return g.withColumn("e", F.expr("filter(e, y -> exists(m, x -> x.ord = y.src) AND exists(m, x -> x.ord = y.dst))"))


def retrieve(corpus: Corpus, question: str | None = None, focus: str = "all", budget: int = BUDGET) -> DataFrame:
    """Every graph cut down for a question: graph_id, entrypoint, nodes (ranked), edges, n_nodes, n_edges, tokens, pruned.

    Repetitions merge, nodes are ranked, a focus prunes; without one, graphs over the budget keep nodes of medium relevance and more.
    Tokens are those of the body without the remark that it was pruned.  All of it is an expression over a graph's row.
    """
    words = keywords(question)
    rel = f"CASE WHEN x.ir IN {HIGH} THEN 2 WHEN x.ir IN {MEDIUM} THEN 1 ELSE 0 END"
    key = f"CASE WHEN x.type IN {MERGED} THEN concat_ws('|', x.type, x.symbol, array_join(x.args, ',')) ELSE concat('#', x.ord) END"
    g = nested(corpus).withColumn("keys", F.expr(f"transform(n, x -> {key})"))
    # places are 1, 2, .. so a key's first position is the place of the node that stands for it
    g = g.withColumn("m", F.expr(f"filter({_nodes_of('n', 'cast(size(filter(keys, k -> k = keys[cast(x.ord - 1 as int)])) as bigint)')}, x -> array_position(keys, keys[cast(x.ord - 1 as int)]) = x.ord)"))
    g = g.withColumn("e", F.expr("transform(e, y -> named_struct('k', y.k, 'src', array_position(keys, keys[cast(y.src - 1 as int)]), 'dst', array_position(keys, keys[cast(y.dst - 1 as int)]), 'rel', y.rel, 'mech', y.mech))"))
    g = g.withColumn("ends", F.expr("transform(e, y -> concat_ws('|', y.src, y.dst, y.rel))"))
    g = g.withColumn("e", F.expr("filter(e, (y, i) -> array_position(ends, ends[i]) = i + 1)"))
    if words:
        score = " + ".join(f"cast(contains(lower(concat_ws(' ', x.symbol, x.args)), '{w}') as int)" for w in words)
        g = g.withColumn("m", F.expr(f"transform(array_sort(transform(m, x -> named_struct('a', x.times > 1, 'b', -({score}), 'c', -({rel}), 'd', x.ord, 'x', x))), z -> z.x)"))
    if focus == "side_effects":
        g = _pruned(g, f"x.type IN {SIDE_EFFECTS}").withColumn("pruned", F.lit(True))
    elif focus != "all":
        g = _pruned(g, f"({rel}) >= {FOCUS_LEAST[focus]}").withColumn("pruned", F.lit(True))
    else:
        g = _pruned(g.withColumn("pruned", F.expr(f"ceil(length({_body('m', 'e')}) / 4) > {budget}")), f"({rel}) >= 1", "pruned")
    size = lambda c: F.size(c).cast("bigint")
    return g.select("graph_id", "entrypoint", F.col("m").alias("nodes"), F.col("e").alias("edges"), size("m").alias("n_nodes"), size("e").alias("n_edges"), F.expr(f"ceil(length({_body('m', 'e')}) / 4)").cast("bigint").alias("tokens"), "pruned")


def serialise(results: DataFrame) -> DataFrame:
    """graph_id, text: what ``retrieve`` returned, with its heading and its tokens."""
    text = F.concat(F.lit("Execution flow for "), "entrypoint", F.lit(":\n"), F.expr(_body("nodes", "edges", "pruned")), F.lit("\n~"), F.col("tokens").cast("string"), F.lit(" tokens"))
    return results.select("graph_id", F.rtrim(text).alias("text"))


def naive(goldens: DataFrame, files: DataFrame) -> DataFrame:
    """Goldens (golden_id, file) and sources (file, content) -> golden_id, n_files, tokens of all distinct files put together, each under its name."""
    g = goldens.where("file is not null and file <> ''").select("golden_id", "file").distinct().join(files, "file")
    size = F.length("content") + F.length("file") + len("// File: \n")
    total = F.sum(size) + 2 * (F.count("*") - 1)
    out = g.groupBy("golden_id").agg(F.count("*").alias("n_files"), F.ceil(total / 4).cast("bigint").alias("tokens"))
    return goldens.select("golden_id").distinct().join(out, "golden_id", "left").select("golden_id", *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n_files", "tokens")))


def fuse(results: DataFrame, findings: DataFrame) -> DataFrame:
    """Results with the tokens that runtime findings (graph_id and any columns) add as JSON; a graph without any adds the empty list's."""
    rest = [c for c in findings.columns if c != "graph_id"]
    f = findings.groupBy("graph_id").agg(F.ceil(F.length(F.to_json(F.array_sort(F.collect_list(F.struct(*rest))))) / 4).alias("extra"))
    return results.join(f, "graph_id", "left").withColumn("tokens", F.col("tokens") + F.coalesce("extra", F.lit(1)).cast("bigint")).drop("extra")


def dependency_index(corpus: Corpus, by: str = "symbol") -> DataFrame:
    """symbol or class -> routes that use it (services and side effects alone), sorted."""
    n = corpus.nodes.where(F.col("type").isin(*INDEXED) & (F.substring_index("symbol", "::", 1) != ""))
    key = F.col("symbol") if by == "symbol" else F.substring_index("symbol", "::", 1)
    n = n.select("graph_id", key.alias(by)).distinct().join(corpus.graphs.select("graph_id", "entrypoint"), "graph_id").select(by, "entrypoint").distinct()
    return n.groupBy(by).agg(F.array_sort(F.collect_list("entrypoint")).alias("routes"))


def dependents(corpus: Corpus, symbol: str) -> DataFrame:
    """Routes whose services or side effects use ``Class::method``, or any method of ``Class``: (entrypoint, n), n the nodes of its last graph, in the order of entrypoints as people sort."""
    exact = "::" in symbol
    own = F.col("symbol") == symbol if exact else F.substring_index("symbol", "::", 1) == symbol
    hits = corpus.nodes.where(F.col("type").isin(*INDEXED) & own).groupBy("graph_id").agg(F.count("*").alias("n"))
    g = corpus.graphs.select("graph_id", "entrypoint").join(hits, "graph_id", "left")
    out = g.groupBy("entrypoint").agg(F.max_by(F.coalesce("n", F.lit(0)), "graph_id").alias("n"), F.count("n").alias("found")).where("found > 0").drop("found")
    return out.orderBy(F.collate("entrypoint", "UNICODE"))


def reachable(spark: SparkSession, corpus: Corpus, start: DataFrame, depth: int) -> DataFrame:
    """(graph_id, node_ord, depth): nodes reachable from ``start`` (graph_id, node_ord) and the least number of edges; starts are left out.

    Graphs are small, so the walk stays in a graph's row: edges are shuffled once by graph, whatever the depth, and a level
    adds to an array what it didn't hold.
    """
    e = corpus.edges.groupBy("graph_id").agg(F.collect_set(F.struct("src", "dst")).alias("e"))
    s = start.groupBy("graph_id").agg(F.collect_set(F.struct(F.col("node_ord").cast("bigint").alias("node_ord"), F.lit(0).cast("bigint").alias("depth"))).alias("s"))
    step = """aggregate(sequence(1L, cast({d} as bigint)), s, (m, i) -> concat(m, transform(array_except(
      array_distinct(transform(filter(e, y -> exists(m, x -> x.node_ord = y.src AND x.depth = i - 1)), y -> cast(y.dst as bigint))), transform(m, x -> x.node_ord)),
      v -> named_struct('node_ord', v, 'depth', i))))""".format(d=depth)
    if depth < 1:
        return start.select("graph_id", "node_ord", F.lit(0).cast("bigint").alias("depth")).limit(0)
    return s.join(e, "graph_id").select("graph_id", F.explode(F.expr(step)).alias("x")).select("graph_id", "x.node_ord", "x.depth").where("depth > 0")
