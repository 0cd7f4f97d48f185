"""Texts for people and prompts, as expressions: findings, diffs, layers, prompt sections, gap reports."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import ir_type
from ..sources.corpus import Corpus, nested

# fixed values: layers of a route and their node types, types that mean danger, marks of severities
LAYERS = {
    "auth": ("ir:auth_gate",), "authz": ("ir:authz_check", "ir:permission_constant"), "validation": ("ir:validation_gate",),
    "runtime": ("ir:runtime_inject", "ir:runtime_consume", "ir:tenant_context"), "handler": ("ir:business_handler",),
    "txn": ("ir:txn_boundary",), "services": ("ir:service_call",),
    "data": ("ir:scoped_query", "ir:unscoped_query", "ir:unscoped_write", "ir:txn_write"), "resources": ("ir:resource", "ir:api_resource"),
    "escape": ("ir:txn_escape",), "async": ("ir:queue_job", "ir:event_dispatch"), "effects": ("ir:notification", "ir:mail"),
}
ALARMING = ("ir:unscoped_query", "ir:unscoped_write", "ir:txn_escape")
BADGES = {"CRITICAL": "🔴 CRITICAL", "HIGH": "🟠 HIGH", "MEDIUM": "🟡 MEDIUM", "LOW": "🟢 LOW", "INFO": "🔵 INFO"}
ICONS = {"CRITICAL": "⛔", "HIGH": "⚠ ", "MEDIUM": "~ ", "INFO": "ℹ "}


def _named(names: dict[str, str], value):
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), value)


def layers(corpus: Corpus) -> DataFrame:
    """graph_id, layer, pos (of the layer), n, symbols, n_danger: a route's nodes by layer; types without a layer are left out."""
    kind = ir_type(F.col("type"))
    layer = F.lit(None).cast("int")
    for k, types in enumerate(LAYERS.values()):
        layer = F.when(kind.isin(*types), k).otherwise(layer)
    n = corpus.nodes.withColumn("pos", layer).where("pos is not null").groupBy("graph_id", "pos")
    out = n.agg(F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("node_ord", "symbol"))), lambda x: x["symbol"]).alias("symbols"), F.count_if(kind.isin(*ALARMING)).alias("n_danger"))
    return out.select("graph_id", F.get(F.array(*map(F.lit, LAYERS)), F.col("pos")).alias("layer"), F.col("pos").cast("bigint").alias("pos"), "n", "symbols", "n_danger")


def report(corpus: Corpus, findings: DataFrame) -> DataFrame:
    """graph_id, entrypoint, n_critical, n_high, n_nodes and which layers there are: the routes of a report, most critical first, then high, then by entrypoint."""
    f = findings.groupBy("graph_id").agg(F.count_if(F.col("severity") == "CRITICAL").alias("n_critical"), F.count_if(F.col("severity") == "HIGH").alias("n_high"))
    have = layers(corpus).groupBy("graph_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "layer"))), lambda x: x["layer"]).alias("layers"))
    n = corpus.nodes.groupBy("graph_id").agg(F.count("*").alias("n_nodes"))
    out = corpus.graphs.select("graph_id", "entrypoint").join(f, "graph_id", "left").join(have, "graph_id", "left").join(n, "graph_id", "left")
    zero = {c: F.coalesce(c, F.lit(0)).cast("bigint") for c in ("n_critical", "n_high", "n_nodes")}
    return out.withColumns(zero).withColumn("layers", F.coalesce("layers", F.array().cast("array<string>")))


def markdown(ranked: DataFrame) -> DataFrame:
    """graph_id, text: ranked findings of a graph as Markdown."""
    title = F.concat(F.lit("## Finding "), F.col("rank").cast("string"), F.lit(": "), F.upper(F.replace("type", F.lit("_"), F.lit(" "))))
    text = F.concat_ws("\n", title, F.lit(""), F.concat(F.lit("**Severity:** "), _named(BADGES, F.col("severity")), F.lit("  ")), F.concat(F.lit("**Confidence:** "), "confidence", F.lit("  ")), F.concat(F.lit("**Nodes:** "), F.array_join("nodes", ", ")), F.lit(""))
    all_ = F.transform(F.array_sort(F.collect_list(F.struct("rank", text.alias("text")))), lambda x: x["text"])
    g = ranked.groupBy("graph_id").agg(all_.alias("parts"))
    return g.select("graph_id", F.concat(F.lit("# Analysis\n\n"), F.size("parts").cast("string"), F.lit(" finding(s) detected.\n"), F.array_join("parts", "\n---\n\n")).alias("text"))


def diff_lines(drift: DataFrame, changes: DataFrame) -> DataFrame:
    """entrypoint, part, line: a diff as lines: routes that came and went, and what regressions and improvements mean, worst first."""
    came = drift.where("status in ('new', 'gone')").select("entrypoint", F.when(F.col("status") == "new", "new routes").otherwise("removed routes").alias("part"), F.concat(F.when(F.col("status") == "new", "  + ").otherwise("  - "), "entrypoint").alias("line"))
    means = F.concat(F.lit("    "), F.coalesce(_named(ICONS, F.col("severity")), F.lit("  ")), F.lit(" "), "description")
    lines = changes.groupBy("entrypoint").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", means.alias("line")))), lambda x: x["line"]), "\n").alias("means"))
    rest = drift.where("status = 'changed'").join(lines, "entrypoint", "left")
    part = F.when(F.col("regressed"), "behavior regressions").otherwise("behavior improvements")
    return came.union(rest.select("entrypoint", part.alias("part"), F.concat_ws("\n", F.concat(F.lit("  "), "entrypoint"), "means").alias("line")))


def verdict(drift: DataFrame, label: str = "baseline") -> DataFrame:
    """One row: ok, regressions, removed, stable and the line that sums it up."""
    c = drift.agg(F.count_if((F.col("status") == "changed") & F.col("regressed")).alias("regressions"), F.count_if(F.col("status") == "gone").alias("removed"), F.count_if(F.col("status") == "same").alias("stable"), F.count_if(F.col("status") != "gone").alias("routes"))
    ok = (F.col("regressions") == 0) & (F.col("removed") == 0)
    passed = F.concat(F.lit(f"PASSED ({label}) — "), F.col("stable").cast("string"), F.lit("/"), F.col("routes").cast("string"), F.lit(" routes stable"))
    failed = F.concat(F.lit(f"FAILED ({label}) — "), F.col("regressions").cast("string"), F.lit(" regression(s), "), F.col("removed").cast("string"), F.lit(" removed"))
    return c.select(ok.alias("ok"), "regressions", "removed", "stable", F.when(ok, passed).otherwise(failed).alias("text"))


def prompt_paths(corpus: Corpus) -> DataFrame:
    """graph_id, text: a graph's section of a prompt: nodes, edges, and mutations that no transaction wraps."""
    node = "concat('  ', x.symbol, CASE WHEN size(x.args) > 0 THEN concat('(', array_join(x.args, ', '), ')') ELSE '' END, ' [', x.type, ']', CASE WHEN x.mutates THEN ' [MUTATES]' ELSE '' END, CASE WHEN coalesce(x.detail, '') <> '' THEN concat('\\n    detail: ', x.detail) ELSE '' END)"
    edge = "concat('  ', get(n, cast(y.src - 1 as int)).symbol, ' → ', get(n, cast(y.dst - 1 as int)).symbol, '  [', y.rel, ']')"
    bare = "filter(n, x -> x.mutates AND NOT exists(e, y -> y.rel = 'ir:wraps' AND y.dst = x.ord))"
    g = nested(corpus)
    unwrapped = F.expr(f"array_join(transform({bare}, x -> concat('  ', x.symbol, ' [', x.type, '] — NOT wrapped in a transaction')), '\\n')")
    return g.select("graph_id", F.concat(F.lit("Execution path: "), "entrypoint", F.lit("\n\nNodes:\n"), F.expr(f"array_join(transform(n, x -> {node}), '\\n')"), F.lit("\n\nEdges:\n"), F.expr(f"array_join(transform(e, y -> {edge}), '\\n')"),
                                         F.when(unwrapped != "", F.concat(F.lit("\n\nUnwrapped mutations (no transaction boundary):\n"), unwrapped)).otherwise("")).alias("text"))


def prompt_contradictions(pairs: DataFrame) -> DataFrame:
    """graph_id, text of pairs (graph_id, a, b, shared) of findings that share nodes; the types are what stands before an id's hash."""
    kind = lambda c: F.upper(F.replace(F.regexp_replace(c, "-[0-9a-f]{8}$", ""), F.lit("-"), F.lit("_")))
    line = F.concat(F.lit("  • "), kind("a"), F.lit(" vs "), kind("b"), F.lit(" — shared nodes: "), F.array_join("shared", ", "), F.lit("\n    Both findings apply to the same execution points. Explain which interpretation takes precedence and why."))
    return pairs.groupBy("graph_id").agg(F.concat(F.lit("Competing interpretations (findings sharing nodes):\n"), F.array_join(F.array_sort(F.collect_list(line)), "\n")).alias("text"))


def gap_text(gaps: DataFrame, coverage: DataFrame) -> DataFrame:
    """session_id, text: coverage, and each category of unmatched spans with a bar and examples, the largest first; the first five again as targets."""
    pct = F.col("percent").cast("string")
    line = F.concat(F.lit("  "), F.rpad("category", 20, " "), F.lit(" "), F.lpad(F.concat(pct, F.lit("%")), 4, " "), F.lit("  "), F.repeat(F.lit("█"), F.floor(F.col("percent") / 5 + 0.5).cast("int")), F.when(F.size("examples") > 0, F.concat(F.lit("\n    e.g. "), F.array_join("examples", ", "))).otherwise(""))
    goal = F.concat(F.lit("  → "), "category", F.lit(": "), pct, F.lit("% of total spans unmatched"))
    rows = gaps.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "category", line.alias("line"), goal.alias("goal")))).alias("rows"))
    x = coverage.join(rows.hint("merge"), "session_id", "left")
    head = F.concat(F.lit("Runtime Coverage Score: "), F.floor(100 * F.col("rate") + 0.5).cast("string"), F.lit("% ("), F.col("matched").cast("string"), F.lit("/"), F.col("total").cast("string"), F.lit(" spans matched)\n\nUnmatched Span Breakdown:"))
    each = lambda field, rows: F.transform(rows, lambda r: r[field])
    goals = F.when(F.size("rows") > 0, F.concat(F.lit("\n\nTop Semantic Gaps (parser targets):\n"), F.array_join(each("goal", F.slice("rows", 1, 5)), "\n"))).otherwise("")
    return x.select("session_id", F.concat(head, F.when(F.size("rows") > 0, F.concat(F.lit("\n"), F.array_join(each("line", F.col("rows")), "\n"))).otherwise(""), goals).alias("text"))


def hints(infos: DataFrame) -> DataFrame:
    """file, line, label: a route's hint beside its handler, by file."""
    gate = F.when(F.size("auth_gates") > 0, F.concat(F.lit("auth: "), F.array_join("auth_gates", ", "))).otherwise(F.when(F.col("is_public"), "public").otherwise("no auth"))
    label = F.concat_ws(" · ", F.col("entrypoint"), gate, F.when(F.size("authz_checks") > 0, F.concat(F.lit("authz: "), F.array_join("authz_checks", ", "))), F.when(F.col("has_transaction"), "transaction"))
    return infos.where("file <> ''").select("file", "line", label.alias("label"))


def tree(corpus: Corpus, depth: int = 2**31 - 1) -> DataFrame:
    """graph_id, text: nodes indented below the ones that lead to them, from those that no edge enters; a node stands where it is first met, so cycles end."""
    # a stack of (place, depth) as depth * 2^32 + place; what is on top comes last
    push = "reverse(transform(filter(e, y -> y.src = v.p AND NOT array_contains(s.seen, y.dst) AND y.dst <> v.p), y -> named_struct('p', y.dst, 'd', v.d + 1)))"
    walk = f"""aggregate(sequence(0, size(e) + size(n)), named_struct('seen', cast(array() as array<bigint>), 'out', cast(array() as array<struct<p: bigint, d: bigint>>),
      'stack', reverse(transform(filter(n, x -> NOT exists(e, y -> y.dst = x.ord)), x -> named_struct('p', x.ord, 'd', 0L)))), (s, i) -> CASE WHEN size(s.stack) = 0 THEN s
      WHEN array_contains(s.seen, element_at(s.stack, -1).p) OR element_at(s.stack, -1).d > {depth} THEN named_struct('seen', s.seen, 'out', s.out, 'stack', slice(s.stack, 1, size(s.stack) - 1))
      ELSE named_struct('seen', concat(s.seen, array(element_at(s.stack, -1).p)), 'out', concat(s.out, array(element_at(s.stack, -1))), 'stack', concat(slice(s.stack, 1, size(s.stack) - 1),
        {push.replace('v.p', 'element_at(s.stack, -1).p').replace('v.d', 'element_at(s.stack, -1).d')})) END, s -> s.out)"""
    line = "concat(repeat('  ', cast(v.d as int)), get(n, cast(v.p - 1 as int)).symbol)"
    return nested(corpus).select("graph_id", F.expr(f"array_join(transform({walk}, v -> {line}), '\\n')").alias("text"))
