"""Scores: recall with its defaults, answers by phrases, runs of one question."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import ir_type

# fixed values: weights of an answer's and of a turn's parts, and what passes
ANSWER = {"finding_type": 0.30, "severity": 0.15, "key_nodes": 0.25, "explanation": 0.20, "recommendations": 0.10}
TURN = {"finding_type": 0.25, "severity": 0.15, "explanation": 0.40, "recommendations": 0.20}
PASS, TURN_PASS, PAIN_PASS = 0.7, 0.65, 0.7
# fixed values: node types of a trace's skeleton, and those that only deeper analysis finds
SKELETON = ("ir:auth_gate", "ir:business_handler", "rate_limiter", "signature_check", "email_verification")
DEEPER = ("ir:service_call", "ir:permission_constant", "ir:runtime_inject", "ir:runtime_consume")


def recall(covered, total):
    """1 where nothing is asked for."""
    return F.coalesce(covered / F.nullif(total, F.lit(0)), F.lit(1.0))


def runs(rows: DataFrame, key: str, value: str) -> DataFrame:
    """mean, population deviation, least and largest of each key's runs."""
    v = F.col(value)
    return rows.groupBy(key).agg(F.round(F.avg(v), 6).alias("mean"), F.round(F.stddev_pop(v), 6).alias("deviation"), F.min(v).alias("low"), F.max(v).alias("high"), F.count("*").alias("runs"))


def phrases(docs: DataFrame, wanted: list[str]) -> DataFrame:
    """Share of phrases that a text holds, in any case; passes at 0.7."""
    text = F.lower(F.coalesce("text", F.lit("")))
    hits = sum((text.contains(p.lower()).cast("int") for p in wanted), F.lit(0))
    score = F.round(hits / F.lit(len(wanted)), 6)
    return docs.select("doc_id", score.alias("score"), (score >= 0.7).alias("passed"))


def last_turns(turns: DataFrame, n: int = 5) -> DataFrame:
    from pyspark.sql import Window
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return turns.withColumn("k", F.row_number().over(w)).where(F.col("k") <= n).select("conv_id", "turn", "role")


# ---- nodes of a golden trace against those of a graph

def _words(symbol: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(symbol), "[^a-z0-9]+", " "), " "), lambda w: F.length(w) > 2)


def _fuzzy(a: Column, b: Column) -> Column:
    """Either holds the other, in any case."""
    return F.contains(F.lower(a), F.lower(b)) | F.contains(F.lower(b), F.lower(a))


def match_score(symbol: Column, kind: Column, args: Column, node: Column) -> Column:
    """1 for equal symbols, 0.9 for one within the other, 0.7 for a common argument, 0.6 for like types with a common word, else 0; in any case. ``node`` is a struct (symbol, type, args)."""
    one, two = ir_type(kind), ir_type(node["type"])
    among = lambda t, *names: t.isin(*names)
    gate, hand = ("ir:auth_gate", "ir:authz_check"), ("ir:business_handler", "controller")
    like = (one == two) | (among(one, *gate) & among(two, *gate)) | (among(one, *hand) & among(two, *hand))
    low = lambda a: F.transform(F.coalesce(a, F.array().cast("array<string>")), F.lower)
    shared = F.exists(_words(symbol), lambda w: F.exists(_words(node["symbol"]), lambda v: F.contains(v, w) | F.contains(w, v)))
    return (F.when(F.lower(symbol) == F.lower(node["symbol"]), 1.0).when(_fuzzy(symbol, node["symbol"]), 0.9)
            .when(F.arrays_overlap(low(args), low(node["args"])), 0.7).when(like & shared, 0.6).otherwise(0.0))


def match_nodes(golden: DataFrame, graphs: DataFrame) -> DataFrame:
    """Golden nodes (trace, golden_id, symbol, type, args) with the best of their graph's nodes: trace, golden_id, type, score, node_ord, reason.

    ``graphs`` has a row a trace: (trace, n), n the nodes (ord, symbol, type, args).  The first of the best counts, from 0.5 on.  Skeleton
    nodes are sought among all, others among those outside the skeleton.
    """
    x = golden.join(graphs.select("trace", "n"), "trace")
    skeleton = F.col("type").isin(*SKELETON)
    pool = F.when(skeleton, F.col("n")).otherwise(F.filter("n", lambda v: ~v["type"].isin(*SKELETON) & ~ir_type(v["type"]).isin(*SKELETON)))
    best = F.array_max(F.transform(pool, lambda v: F.struct(match_score(F.col("symbol"), F.col("type"), F.col("args"), v).alias("score"), (-v["ord"]).alias("at"))))
    x = x.withColumn("best", best).withColumn("hit", F.col("best.score") >= 0.5)
    reason = F.when(~F.coalesce("hit", F.lit(False)), "no match").when(F.col("best.score") >= 1, "exact symbol").when(F.col("best.score") >= 0.9, "symbol substring").when(F.col("best.score") >= 0.7, "arg overlap").otherwise("semantic type + shared token")
    return x.select("trace", "golden_id", "type", F.when(F.col("hit"), F.col("best.score")).otherwise(0.0).alias("score"), F.when(F.col("hit"), -F.col("best.at")).alias("node_ord"), reason.alias("reason"))


def trace_scores(golden: DataFrame, golden_edges: DataFrame, graphs: DataFrame) -> DataFrame:
    """trace, recall of skeleton and of deeper nodes, and edge recall: a graph's edges (``n_edges`` of ``graphs``) against the golden edges (trace, src, dst) between skeleton nodes, 1 at most."""
    m = match_nodes(golden, graphs)
    part = lambda c: (F.count_if(c & F.col("node_ord").isNotNull()), F.count_if(c))
    own = F.col("type").isin(*SKELETON)
    r = m.groupBy("trace").agg(recall(*part(own)).alias("skeleton"), recall(*part(~own)).alias("deeper"))
    ends = golden.where(F.col("type").isin(*SKELETON)).select("trace", F.col("golden_id").alias("id"))
    e = golden_edges
    for end in ("src", "dst"):
        e = e.join(ends.withColumnRenamed("id", end), ["trace", end], "left_semi")
    wanted = e.groupBy("trace").agg(F.count("*").alias("wanted"))
    x = r.join(graphs.select("trace", "n_edges"), "trace").join(wanted, "trace", "left")
    return x.select("trace", "skeleton", "deeper", F.when(F.col("wanted").isNull(), 1.0).otherwise(F.least(F.lit(1.0), F.col("n_edges") / F.col("wanted"))).alias("edge_recall"))


def retrieval_scores(golden: DataFrame, graphs: DataFrame) -> DataFrame:
    """Golden nodes (trace, golden_id, symbol, type, relevance) against the nodes retrieved: trace, recall of HIGH, of MEDIUM and of both, missing HIGH nodes, and why."""
    x = golden.join(graphs.select("trace", "n"), "trace", "left")
    x = x.withColumn("covered", F.coalesce(F.exists("n", lambda v: _fuzzy(F.col("symbol"), v["symbol"])), F.lit(False)))
    is_ = lambda level: F.coalesce(F.col("relevance") == level, F.lit(False))
    of = lambda c: recall(F.count_if(c & F.col("covered")), F.count_if(c))
    missing = is_("HIGH") & ~F.col("covered")
    deeper = F.coalesce(F.bool_and(F.when(missing, ir_type(F.col("type")).isin(*DEEPER))), F.lit(True))
    r = x.groupBy("trace").agg(of(is_("HIGH")).alias("high"), of(is_("MEDIUM")).alias("medium"), of(is_("HIGH") | is_("MEDIUM")).alias("combined"), F.array_sort(F.collect_set(F.when(missing, F.col("golden_id")))).alias("missing"), deeper.alias("deeper"))
    return r.select("trace", "high", "medium", "combined", "missing", gap_reason(F.col("trace"), F.col("combined"), F.col("deeper")).alias("reason"))


def gap_reason(entrypoint: Column, combined: Column, deeper: Column) -> Column:
    return F.when(F.contains(entrypoint, F.lit("*")) | entrypoint.startswith("ANY"), "cross_cutting").when(combined >= 0.99, "ok").when(deeper, "extraction_ceiling").otherwise("retrieval_failure")


def benchmark_summary(traces: DataFrame) -> DataFrame:
    """Means over traces (reason, combined, compression, savings) but cross-cutting ones, and the number of all."""
    own = F.col("reason") != "cross_cutting"
    mean = lambda c, digits: F.coalesce(F.round(F.avg(F.when(own, F.col(c))), digits), F.lit(0.0))
    return traces.agg(mean("combined", 2).alias("avg_recall"), mean("compression", 2).alias("avg_compression"), mean("savings", 1).alias("avg_savings"), F.count("*").alias("total_traces"))


# ---- answers against what was expected

def _part(wanted: Column, hit: Callable[[Column], Column]) -> Column:
    """Share of a list's members that hit; 1 for an empty or null list."""
    w = F.coalesce(wanted, F.array().cast("array<string>"))
    return F.when(F.size(w) == 0, 1.0).otherwise(F.size(F.filter(w, hit)) / F.size(w))


def _groups(groups: Column, text: Column) -> Column:
    """Share of groups of phrases of which the text holds one."""
    hits = F.filter(groups, lambda g: F.exists(g, lambda p: F.contains(F.lower(text), F.lower(p))))
    return F.when(F.coalesce(F.size(groups), F.lit(0)) <= 0, 1.0).otherwise(F.size(hits) / F.size(groups))


def answer_scores(rows: DataFrame, judge: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Rows of answers (finding_type, severity, key_nodes, explanation, recommendations) beside what was expected (want_...): the parts, ``score`` and ``passed``.

    want_recommendations is a list of groups of phrases, the others are like the answer's, want_explanation phrases.  ``judge`` may decide on the
    finding type in place of equality: (expected, answered) -> boolean.
    """
    same = lambda c: F.coalesce(F.lower(c) == F.lower("want_" + c), F.lit(False))
    said = F.coalesce("explanation", F.lit(""))
    low = F.transform(F.coalesce("key_nodes", F.array().cast("array<string>")), F.lower)
    parts = {
        "finding_type": (judge(F.col("want_finding_type"), F.col("finding_type")) if judge else same("finding_type")).cast("double"),
        "severity": same("severity").cast("double"),
        "key_nodes": _part(F.col("want_key_nodes"), lambda w: F.array_contains(low, F.lower(w))),
        "explanation": _part(F.col("want_explanation"), lambda w: F.contains(F.lower(said), F.lower(w))),
        "recommendations": _groups(F.col("want_recommendations"), F.array_join("recommendations", " ")),
    }
    total = F.round(sum(parts[k] * F.lit(w) for k, w in ANSWER.items()), 9)
    return rows.select(*(c for c in rows.columns if c not in parts and not c.startswith("want_")), *(v.alias(f"{k}_score") for k, v in parts.items()), total.alias("score"), (total >= PASS).alias("passed"))


def turn_scores(rows: DataFrame) -> DataFrame:
    """Turns of conversations, as ``answer_scores`` without key nodes; what isn't expected (null) passes."""
    same = lambda c: F.when(F.col("want_" + c).isNull(), 1.0).otherwise(F.coalesce(F.lower(c) == F.lower("want_" + c), F.lit(False)).cast("double"))
    said = F.coalesce("explanation", F.lit(""))
    parts = {"finding_type": same("finding_type"), "severity": same("severity"), "explanation": _part(F.col("want_explanation"), lambda w: F.contains(F.lower(said), F.lower(w))), "recommendations": _groups(F.col("want_recommendations"), F.array_join("recommendations", " "))}
    total = F.round(sum(parts[k] * F.lit(w) for k, w in TURN.items()), 9)
    return rows.select(*(c for c in rows.columns if c not in parts and not c.startswith("want_")), total.alias("score"), (total >= TURN_PASS).alias("passed"))


def averages(scores: DataFrame, key: str) -> DataFrame:
    """Of each key: mean score, how many passed, how many there are, whether all passed."""
    return scores.groupBy(key).agg(F.round(F.avg("score"), 6).alias("score"), F.count_if(F.col("passed")).alias("n_passed"), F.count("*").alias("n"), F.bool_and("passed").alias("all_passed"))


def explainer_scores(expected: DataFrame, findings: DataFrame, key: str = "graph_id") -> DataFrame:
    """Expected findings (key, type, nodes) against those found (key, type, nodes): recall by type, and coverage of the nodes asked for."""
    f = findings.groupBy(key).agg(F.collect_set("type").alias("types"), F.array_distinct(F.flatten(F.collect_list("nodes"))).alias("have"))
    x = expected.join(f, key, "left").withColumns({"types": F.coalesce("types", F.array().cast("array<string>")), "have": F.coalesce("have", F.array().cast("array<string>"))})
    covered = F.sum(F.size(F.filter("nodes", lambda v: F.array_contains(F.col("have"), v))))
    return x.groupBy(key).agg((F.count_if(F.array_contains(F.col("types"), F.col("type"))) / F.count("*")).alias("recall"), recall(covered, F.sum(F.size("nodes"))).alias("coverage"))


def pain_scores(specs: DataFrame, graphs: DataFrame) -> DataFrame:
    """Specs (trace, nodes, edges as ``A -> B``) against their graph (trace, n, e): recall of nodes and edges by parts of symbols, and whether nodes pass at 0.7. Edges without an arrow are no hit."""
    x = specs.join(graphs.select("trace", "n", "e"), "trace", "left")
    own = F.filter(F.transform("n", lambda v: F.coalesce(v["symbol"], F.lit(""))), lambda v: v != "")
    node = _part(F.col("nodes"), lambda w: F.coalesce(F.exists(own, lambda v: _fuzzy(v, w)), F.lit(False)))
    name = lambda at: F.coalesce(F.get(F.col("n"), (at - 1).cast("int"))["symbol"], F.lit(""))
    half = lambda spec, k: F.trim(F.get(F.split(spec, "->", 2), F.lit(k)))
    edge = _part(F.col("edges"), lambda w: F.coalesce(F.contains(w, F.lit("->")) & F.exists("e", lambda y: _fuzzy(name(y["src"]), half(w, 0)) & _fuzzy(name(y["dst"]), half(w, 1))), F.lit(False)))
    return x.select("trace", F.round(node, 6).alias("node_recall"), F.round(edge, 6).alias("edge_recall"), (node >= PAIN_PASS).alias("passed"))


def question_scores(rows: DataFrame) -> DataFrame:
    """Questions (id, want_evidence, evidence, want_finding, finding, want_intent, intent): precision of the evidence by parts of symbols, and half of it, 0.3 for the finding, 0.2 for the intent."""
    hit = _part(F.col("want_evidence"), lambda w: F.exists("evidence", lambda v: F.contains(F.lower(v), F.lower(w))))
    yes = lambda a, b: F.coalesce(F.col(a) == F.col(b), F.lit(False)).cast("double")
    return rows.select("id", F.round(hit, 6).alias("precision"), F.round(0.5 * hit + 0.3 * yes("finding", "want_finding") + 0.2 * yes("intent", "want_intent"), 6).alias("score"))


def runtime_scores(expected: DataFrame, found: DataFrame, key: str = "session_id") -> DataFrame:
    """Expected runtime findings (key, type, contains, least) against those found (key, type, evidence, n): the share met by one of the type that holds the words and counts enough."""
    f = found.groupBy(key).agg(F.collect_list(F.struct("type", "evidence", "n")).alias("have"))
    x = expected.join(f, key, "left")
    met = F.exists("have", lambda v: (v["type"] == F.col("type")) & (F.coalesce("contains", F.lit("")).eqNullSafe("") | F.contains(v["evidence"], F.col("contains"))) & (F.col("least").isNull() | (F.coalesce(v["n"], F.lit(0)) >= F.col("least"))))
    return x.groupBy(key).agg(F.round(F.count_if(F.coalesce(met, F.lit(False))) / F.count("*"), 2).alias("recall"))


def comparison(rows: DataFrame) -> DataFrame:
    """Pairs of scores (base, score): mean difference, and how many are better or worse by over 0.05."""
    d = F.col("score") - F.col("base")
    return rows.agg(F.round(F.avg(d), 6).alias("avg_delta"), F.count_if(d > 0.05).alias("wins"), F.count_if(d < -0.05).alias("losses"), F.count_if(F.abs(d) <= 0.05).alias("ties"))
