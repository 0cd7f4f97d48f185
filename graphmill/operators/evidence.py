"""Evidence for a question: its focus and intents, the facts that matter for them, the nodes to show, constraint checks."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import language
from ..sources.corpus import Corpus

# fixed values: focus patterns in order of priority, intent words, relevance of fact types
FOCUS = (
    ("transaction", r"(?i)\b(transaction|commit|rollback|atomic|dispatch.*before|event.*commit|notification.*fail)"),
    ("isolation", r"(?i)\b(tenant|isolation|cross.tenant|multi.tenant|scope|unscoped|data.leak)"),
    ("auth", r"(?i)\b(auth|authoriz|permission|policy|middleware|guard|access|role|privilege)"),
    ("validation", r"(?i)\b(validat|form.?request)"),
    ("runtime", r"(?i)\b(runtime|inject|container)"),
)
INTENT_WORDS = {
    "auth": ("auth", "authoriz", "permission", "policy", "middleware", "guard", "access", "role", "privilege", "guest", "unauthenticated", "anonymous", "who can", "ownership"),
    "transaction": ("transaction", "commit", "rollback", "atomic", "dispatch", "db", "database", "operations"),
    "validation": ("validat", "form request", "input", "sanitiz"),
    "isolation": ("tenant", "isolation", "cross-tenant", "multi-tenant", "scope", "unscoped", "data leak"),
    "runtime": ("runtime", "inject", "container", "binding"),
}
SECONDARY = 0.12
RELEVANCE = {
    "auth": {"high": ("auth_middleware", "authz_check", "ownership_check", "permission", "unknown_security"), "medium": ("resource_bound",), "low": ("form_request", "txn_boundary", "tenant_context")},
    "transaction": {"high": ("txn_boundary", "txn_write", "txn_escape"), "medium": ("auth_middleware",), "low": ("authz_check", "form_request")},
    "validation": {"high": ("form_request",), "medium": ("auth_middleware", "authz_check"), "low": ("permission",)},
    "isolation": {"high": ("tenant_context", "unscoped_query", "scoped_query"), "medium": ("auth_middleware",), "low": ("authz_check",)},
    "runtime": {"high": ("runtime_inject", "runtime_consume"), "medium": ("tenant_context",), "low": ("auth_middleware",)},
}
TIERS = ("low", "medium", "high")

_AUTHZ = "type = 'ir:authz_check' OR (type = 'ir:validation_gate' AND contains(lower(symbol), 'authorize'))"
#: fact type -> its nodes, in SQL that Spark and others read alike; types are compared as written in the graph
FACT_TYPES = {
    "auth_middleware": "type = 'ir:auth_gate'",
    "unknown_security": "type = 'ir:unknown_middleware'",
    "authz_check": _AUTHZ,
    "ownership_check": f"({_AUTHZ}) AND (contains(lower(symbol), 'policy') OR contains(lower(coalesce(role, '')), 'policy'))",
    "permission": "type = 'ir:permission_constant'",
    "resource_bound": "type = 'ir:resource'",
    "form_request": "type = 'ir:validation_gate'",
    "txn_boundary": "type = 'ir:txn_boundary'",
    "txn_write": "type = 'ir:txn_write'",
    "txn_escape": "type = 'ir:txn_escape'",
    "tenant_context": "type = 'ir:tenant_context'",
    "scoped_query": "type = 'ir:scoped_query'",
    "unscoped_query": "type = 'ir:unscoped_query'",
    "runtime_inject": "type = 'ir:runtime_inject'",
    "runtime_consume": "type = 'ir:runtime_consume'",
}


def focus(question: Column) -> Column:
    """The first focus whose pattern is in the question, else ``all``; null counts as empty."""
    q = F.trim(F.coalesce(question, F.lit("")))
    return F.coalesce(*(F.when(q.rlike(p), F.lit(name)) for name, p in FOCUS), F.lit("all"))


def intent_scores(question: Column) -> Column:
    """Array of (intent, score, pos): the share of each intent's words that the question holds, best first, ties in listed order."""
    q = F.lower(F.coalesce(question, F.lit("")))
    shares = [sum((q.contains(w).cast("int") for w in words), F.lit(0)) / F.lit(len(words)) for words in INTENT_WORDS.values()]
    rows = [F.struct((-s).alias("order"), F.lit(k).alias("pos"), F.lit(name).alias("intent"), s.alias("score")) for k, (name, s) in enumerate(zip(INTENT_WORDS, shares))]
    return F.array_sort(F.array(*rows))


def intents(rows: DataFrame, key: str, question: str) -> DataFrame:
    """(key, intent, score, rank): the best intent and every other of 0.12 or more; ``all`` where no word is met."""
    s = rows.select(key, intent_scores(F.col(question)).alias("s"))
    active = F.when(s["s"][0]["score"] > 0, F.expr(f"filter(s, (x, i) -> i = 0 or x.score >= {SECONDARY})"))
    none = F.array(F.struct(F.lit(0.0).alias("order"), F.lit(0).alias("pos"), F.lit("all").alias("intent"), F.lit(0.0).alias("score")))
    out = s.select(key, F.posexplode(F.coalesce(active, none)).alias("rank", "x"))
    return out.select(key, "x.intent", F.round("x.score", 6).alias("score"), (F.col("rank") + 1).cast("bigint").alias("rank"))


def merged_relevance(names: list[str]) -> dict[str, str]:
    """The highest tier that any of the intents gives a fact type; unnamed types are low."""
    out: dict[str, str] = {}
    for name in names:
        for tier, types in RELEVANCE.get(name, {}).items():
            out |= {t: tier for t in types if TIERS.index(tier) >= TIERS.index(out.get(t, "low"))}
    return out


def facts(corpus: Corpus, names: list[str]) -> DataFrame:
    """(graph_id, fact, present, n, value, relevance): what a graph has of each fact type, and what it lacks if that matters much.

    One aggregate over the nodes, whatever the number of types; value joins the symbols in node order and is null where absent.
    """
    tiers = merged_relevance(names)
    held = [F.array_sort(F.collect_list(F.when(F.expr(rule), F.struct("node_ord", "symbol")))).alias(f) for f, rule in FACT_TYPES.items()]
    own = corpus.graphs.select("graph_id").join(corpus.nodes.groupBy("graph_id").agg(*held), "graph_id", "left")
    rows = F.array(*(F.struct(F.lit(f).alias("fact"), F.lit(tiers.get(f, "low")).alias("relevance"), F.col(f).alias("at")) for f in FACT_TYPES))
    x = own.select("graph_id", F.explode(rows).alias("x")).select("graph_id", "x.*")
    n = F.coalesce(F.size("at"), F.lit(0)).cast("bigint")
    n = F.when(F.col("at").isNull(), F.lit(0)).otherwise(n).cast("bigint")
    value = F.array_join(F.filter(F.transform("at", lambda s: s["symbol"]), lambda s: s != ""), ", ")
    x = x.select("graph_id", "fact", (n > 0).alias("present"), n.alias("n"), F.when(n > 0, F.nullif(value, F.lit(""))).alias("value"), "relevance")
    return x.where("present or relevance = 'high'")


def check_constraints(corpus: Corpus, constraints: list[tuple[str, str, str]]) -> DataFrame:
    """(constraint, severity, graph_id, entrypoint, error) of ``constraints`` (name, severity, query): every route a query finds.

    A query that cannot be read gives one row with its error, no graph, and the constraint's own severity.
    """
    out = []
    for name, severity, text in constraints:
        head = [F.lit(name).alias("constraint"), F.lit(severity).alias("severity")]
        try:
            found = language.query(corpus, text)
        except SyntaxError as e:
            one = corpus.graphs.sparkSession.range(1)
            out.append(one.select(*head, F.lit(None).cast(corpus.graphs.schema["graph_id"].dataType).alias("graph_id"), F.lit(None).cast("string").alias("entrypoint"), F.lit(str(e)).alias("error")))
            continue
        out.append(found.select(*head, "graph_id", "entrypoint", F.lit(None).cast("string").alias("error")))
    if not out:
        return corpus.graphs.sparkSession.createDataFrame([], "constraint string, severity string, graph_id bigint, entrypoint string, error string")
    return reduce(DataFrame.unionByName, out)
