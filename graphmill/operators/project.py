"""Joins between the tables of a project: security rules, transactional services, listeners, permissions."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# fixed values: how much a catch-all of each access holds back; others name roles
RESTRICTS = {"deny": 3, "authenticated": 2, "permit": 0}
EVERYTHING = "/**"


def path_pattern(pattern: Column) -> Column:
    """An ant pattern as a regular expression: ** any text, * and {name} within a segment, ? one character; what lies below a match matches too."""
    p = F.regexp_replace(pattern, r"([.+^$()|\[\]\\])", r"\\$1")
    p = F.regexp_replace(p, r"\{[^}]+\}", "[^/]+")
    p = F.replace(F.regexp_replace(F.replace(p, F.lit("**"), F.lit("\x01")), r"\*", "[^/]*"), F.lit("\x01"), F.lit(".*"))
    return F.concat(F.lit("^"), F.regexp_replace(p, r"\?", "[^/]"), F.lit("(/.*)?$"))


def specificity(pattern: Column) -> Column:
    """A pattern's length, less 10 for each double star and 5 for each single one."""
    count = lambda p: F.size(F.regexp_extract_all(pattern, F.lit(p), F.lit(1)))
    return F.length(pattern) - 10 * count(r"(\*\*)") - 5 * count(r"((?<!\*)\*(?!\*))")


def ordered_rules(rules: DataFrame) -> DataFrame:
    """Rules (module, rule_ord, pattern, access) with their ``weight``; of all catch-alls only the most restrictive one stays, behind everything else."""
    hold = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in RESTRICTS.items() for x in pair)), F.col("access")), F.lit(1))
    last = rules.where(F.col("pattern") == EVERYTHING).agg(F.max_by(F.struct(*rules.columns), F.struct(hold, F.negative("rule_ord"))).alias("r")).where("r is not null").select("r.*")
    return rules.where(F.col("pattern") != EVERYTHING).withColumn("weight", specificity(F.col("pattern"))).unionByName(last.withColumn("weight", F.lit(-2**31)))


def _first_segment(path: Column) -> Column:
    return F.split_part(path, F.lit("/"), F.lit(2))


def secured(routes: DataFrame, rules: DataFrame) -> DataFrame:
    """Routes (route_id, module, path) with the rule of their module that governs them, most specific first, then by order: route_id, rule_ord, access; null without one.

    Rules whose first segment is literal meet only the routes that start with it, so a module with many rules isn't paired with all its routes.
    """
    first = _first_segment(F.col("pattern"))
    # the segment must end in the pattern, or be all of it; what lies below matches too
    r = ordered_rules(rules).withColumns({"regex": path_pattern(F.col("pattern")), "bucket": F.when(first.rlike(r"[*?{]") | ~F.col("pattern").startswith("/"), "*").otherwise(first)})
    p = routes.withColumn("path", F.when(F.col("path").startswith("/"), F.col("path")).otherwise(F.concat(F.lit("/"), "path")))
    p = p.withColumn("bucket", F.explode(F.array_distinct(F.array(F.lit("*"), _first_segment(F.col("path"))))))
    best = p.join(r, ["module", "bucket"]).where("regexp_like(path, regex)").groupBy("route_id").agg(F.max_by(F.struct("rule_ord", "access"), F.struct("weight", F.negative("rule_ord"))).alias("b"))
    return routes.select("route_id").join(best.select("route_id", "b.rule_ord", "b.access"), "route_id", "left")


def transactional(calls: DataFrame, index: DataFrame, implementations: DataFrame) -> DataFrame:
    """Service calls (call_id, class, method) with what the index (class, method, propagation) says of the class, or else of what implements it (interface, class): call_id, propagation."""
    index = index.groupBy("class", "method").agg(F.min("propagation").alias("propagation"))
    direct = index.withColumnRenamed("propagation", "own")
    via = implementations.join(index, "class").groupBy(F.col("interface").alias("class"), "method").agg(F.min("propagation").alias("behind"))
    x = calls.join(direct, ["class", "method"], "left").join(via, ["class", "method"], "left")
    return x.select("call_id", F.coalesce("own", "behind").alias("propagation"))


def in_service_transactions(calls: DataFrame, index: DataFrame, implementations: DataFrame) -> DataFrame:
    """Calls (call_id, module, class, method) that their service runs in a transaction: call_id, by (the class that says so).

    ``index`` (module, class, method; null: the class as a whole) has what is marked.  A class that marks anything speaks for itself; otherwise the first of its
    implementations (module, interface, class, ord) that marks anything does.
    """
    marking = index.select("module", "class").distinct()
    key = ["module", "class"]
    own = calls.join(marking.withColumn("_own", F.lit(True)), key, "left")
    behind = implementations.join(marking, key).groupBy("module", F.col("interface").alias("class")).agg(F.min_by("class", "ord").alias("_impl"))
    x = own.join(behind, key, "left").withColumn("by", F.when(F.col("_own"), F.col("class")).otherwise(F.col("_impl"))).where("by is not null")
    whole = index.where("method is null").select("module", F.col("class").alias("by")).distinct().withColumn("_whole", F.lit(True))
    some = index.where("method is not null").select("module", F.col("class").alias("by"), "method").distinct().withColumn("_some", F.lit(True))
    return x.join(whole, ["module", "by"], "left").join(some, ["module", "by", "method"], "left").where("_whole or _some").select("call_id", "by")


def through_transactions(edges: DataFrame, calls: DataFrame) -> DataFrame:
    """Edges (graph_id, src, dst, relation) with a boundary before each transactional call (graph_id, node, that something leads to): what led to the call leads to ``svctxn_`` and its node, and that calls it."""
    led = edges.join(calls.select("graph_id", F.col("node").alias("dst")).distinct().withColumn("_txn", F.lit(True)), ["graph_id", "dst"], "left")
    gate = F.concat(F.lit("svctxn_"), "dst")
    moved = led.select("graph_id", "src", F.when(F.col("_txn"), gate).otherwise(F.col("dst")).alias("dst"), "relation")
    added = led.where("_txn").select("graph_id", gate.alias("src"), "dst", F.lit("ir:calls").alias("relation")).distinct()
    return moved.unionByName(added)


def base_paths(controllers: DataFrame, bases: DataFrame) -> DataFrame:
    """Controllers (module, class, base, own_path, method_path) with full paths; without a path of their own that of their base class (module, class, path) in the same module holds."""
    b = bases.groupBy("module", F.col("class").alias("base")).agg(F.max("path").alias("_path"))
    x = controllers.join(b, ["module", "base"], "left").withColumn("_at", F.coalesce(F.nullif("own_path", F.lit("")), "_path", F.lit("")))
    sub = F.when(F.startswith("method_path", F.lit("/")), F.col("method_path")).otherwise(F.concat(F.lit("/"), "method_path"))
    return x.select("module", "class", F.concat(F.regexp_replace("_at", "/$", ""), sub).alias("path"))


def not_exempt(routes: DataFrame, exempt: DataFrame) -> DataFrame:
    """Routes (method, path, ..) that no row (method, path) exempts from a middleware; method * is any."""
    one = routes.join(exempt.where("method <> '*'"), ["method", "path"], "left_anti")
    return one.join(exempt.where("method = '*'").select("path"), "path", "left_anti").select(*routes.columns)


def listened(escapes: DataFrame, listeners: DataFrame) -> DataFrame:
    """Escaping events (graph_id, event) with each listener (event, listener, after_commit); null where nobody listens."""
    return escapes.join(listeners, "event", "left").select("graph_id", "event", "listener", "after_commit")


def hierarchy(permissions: DataFrame) -> DataFrame:
    """Pairs of permissions (graph_id, symbol): X_ANY over X: graph_id, elevated, base.  Each is joined once, however often it is named."""
    permissions = permissions.select("graph_id", "symbol").distinct()
    low = permissions.select("graph_id", F.col("symbol").alias("base"))
    high = permissions.where("endswith(symbol, '_ANY')").select("graph_id", F.col("symbol").alias("elevated"), F.regexp_replace("symbol", "_ANY$", "").alias("base"))
    return high.join(low, ["graph_id", "base"]).select("graph_id", "elevated", "base")


def reachable_permissions(permissions: DataFrame, sources: DataFrame, asked: DataFrame) -> DataFrame:
    """Permissions (graph_id, class, value) that a graph reaches: its sources (graph_id, source) name the class, or its checks (graph_id, value) ask for the value.  Each is joined once, however often it is named."""
    permissions, sources = permissions.distinct(), sources.select("graph_id", "source").distinct()
    named = permissions.join(sources, "graph_id").where("contains(source, class)").select(*(permissions[c] for c in permissions.columns))
    wanted = permissions.join(asked.select("graph_id", "value").distinct(), ["graph_id", "value"], "left_semi").select(*permissions.columns)
    return named.union(wanted).distinct()


def guarded(nodes: DataFrame) -> DataFrame:
    """(graph_id, src, dst): a guard clause protects every later node of its graph."""
    g = nodes.where("type = 'ir:guard_clause'").select("graph_id", F.col("node_ord").alias("src"))
    return g.join(nodes.select("graph_id", F.col("node_ord").alias("dst")), "graph_id").where("dst > src")


def sources_of(reached: DataFrame, files: DataFrame) -> DataFrame:
    """graph_id, source: the contents of a graph's files (graph_id, file) put together, by name."""
    return reached.distinct().join(files, "file").groupBy("graph_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("file", "content"))), lambda x: x["content"]), "\n").alias("source"))
