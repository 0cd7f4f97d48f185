"""Graphs of a handler with what its code adds to them: gates, checks, resources, calls, transactions, accesses to models, side effects.

An entry names a graph's handler and the method that it is (graph_id, project, path, class, method, caller).  Passes join entries with
the facts of their method (``operators.code``) and with facts of other files by path, and give nodes and edges; nothing is parsed
here.  ``expanded`` follows services further, within a budget a graph.
"""
from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.corpus import written
from .code import FILE, MERGE, TENANT_KEYS, TENANT_SIGNALS, Facts, class_path, short

NODE = "graph_id", "id", "type", "symbol", "role", "file", "detail", "args", "mutates"
EDGE = "graph_id", "src", "dst", "relation", "traceability", "mechanism"
HERE = [*FILE, "method"]

# fixed values: levels and nodes of an expansion, and what goes first when room is short
LEVELS, BUDGET = 2, 50
WEIGHTS = ((4, "auth|permission|policy|guard|gate|idempotenc|authoriz"), (3, "tenant|scope|isolat"), (2, "transaction|txn|audit|log"), (1, "cache|notify|notification|event|dispatch"))
FOCUS = {"auth": "auth|permission|policy|guard|gate|authoriz|role", "transaction": "transaction|txn|order|payment|checkout|cart|store|create|update|delete", "tenant": "tenant|scope|isolat|organization|context"}


@dataclass(frozen=True)
class Augmented:
    nodes: DataFrame
    edges: DataFrame
    annotations: DataFrame  # graph_id, type, node, description


def slug(text: Column, fold: bool = True) -> Column:
    return F.regexp_replace(F.lower(text) if fold else text, "[^a-z0-9]", "_")


def _all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _nodes(rows: DataFrame, id, type_, symbol, role, file=None, detail=None, args=None, mutates=None) -> DataFrame:
    """Nodes as expressions over rows; what is left out is null."""
    c = lambda x, kind="string": F.expr(x).cast(kind) if isinstance(x, str) else x if x is not None else F.lit(None).cast(kind)
    return rows.select("graph_id", c(id).alias("id"), c(type_).alias("type"), c(symbol).alias("symbol"), c(role).alias("role"), c(file).alias("file"), c(detail).alias("detail"), c(args, "array<string>").alias("args"), c(mutates, "boolean").alias("mutates"))


def _edges(rows: DataFrame, src, dst, relation: str, traceability: str, mechanism=None) -> DataFrame:
    c = lambda x: F.expr(x).cast("string") if isinstance(x, str) else x if x is not None else F.lit(None).cast("string")
    return rows.select("graph_id", c(src).alias("src"), c(dst).alias("dst"), F.lit(relation).alias("relation"), F.lit(traceability).alias("traceability"), c(mechanism).alias("mechanism"))


class Passes:
    """The passes over callers: entries, or services met on the way (graph_id, project, path, class, method, caller)."""

    def __init__(self, facts: Facts, sinks: DataFrame | None = None, signals=TENANT_SIGNALS, keys=TENANT_KEYS, keep=written):
        self.f, self.keep = facts, keep
        self.sinks, self.signals, self.keys = sinks, signals, keys
        self._facts: dict[str, DataFrame] = {}

    @cached_property
    def every(self) -> DataFrame:
        """Facts of all kinds, in one job."""
        return self.keep(self.f.all(), "facts")

    def facts(self, kind: str) -> DataFrame:
        """The facts of one kind; like all tables here they are written when first asked for, unless those of all kinds are there."""
        if "every" in self.__dict__:
            return self.every.where(F.col("kind") == kind)
        if kind not in self._facts:
            self._facts[kind] = self.keep(self.f.of(kind).where(F.col("kind") == kind), f"facts-{kind}")
        return self._facts[kind]

    @cached_property
    def held(self) -> DataFrame:
        return self.keep(self.f.in_transactions(), "held")

    @cached_property
    def accesses(self) -> DataFrame:
        return self.keep(self.f.accesses(self.signals, self.keys), "accesses")

    @cached_property
    def tenants(self) -> DataFrame:
        return self.keep(self.f.container_reads(self.keys), "tenants")

    @property
    def guards(self) -> DataFrame:
        return self.f.guards

    @cached_property
    def blocks(self) -> DataFrame:
        return self.keep(self.f.transactions(), "blocks")

    @cached_property
    def audits(self) -> DataFrame | None:
        return self.keep(self.f.audits(self.sinks), "audits") if self.sinks is not None else None

    def of(self, callers: DataFrame, kind: str) -> DataFrame:
        return callers.join(self.facts(kind).drop("kind").hint(MERGE), HERE)

    # ---- calls on services ----

    def services(self, callers: DataFrame, calls: DataFrame | None = None) -> DataFrame:
        """Nodes of service calls, one an id and caller, with the file and method they lead to: graph_id, caller, ord, id, guard, project, file, called, and what a node needs."""
        x = self.of(callers, "service_call") if calls is None else calls
        file = F.when(F.contains("b", F.lit("\\")), class_path(F.col("b")))
        base = slug(F.concat(F.lit("svc_"), short(F.col("b")), F.lit("_"), F.col("c")))
        x = x.withColumns({"id": F.concat(base, F.lit("_"), slug(F.col("caller"), False)), "file": file, "called": F.col("c"), "symbol": F.concat(short(F.col("b")), F.lit("::"), F.col("c"))})
        first = F.row_number().over(Window.partitionBy("graph_id", "caller", "id").orderBy("ord"))
        g = self.guards.select("project", F.col("path").alias("file"), F.col("method").alias("called"), "reason", "condition")
        return x.withColumn("_n", first).where("_n = 1").drop("_n").join(g.hint(MERGE), ["project", "file", "called"], "left").withColumn("guard", F.col("reason").isNotNull())

    def service_nodes(self, s: DataFrame) -> DataFrame:
        return _nodes(s, "id", "if(guard, 'ir:guard_clause', 'ir:service_call')", "symbol", "if(guard, 'guard', 'service')", "file", "if(guard, nullif(condition, ''), null)", "if(size(args) > 0, args, null)", "if(contains(called, ')->'), true, null)")

    def guarded(self, s: DataFrame) -> DataFrame:
        """A guard protects the calls that its caller makes after it."""
        g = s.where("guard").select("graph_id", "caller", F.col("ord").alias("_ord"), F.col("id").alias("src"))
        return _edges(g.join(s.select("graph_id", "caller", "ord", F.col("id").alias("dst")).hint(MERGE), ["graph_id", "caller"]).where("ord > _ord"), "src", "dst", "ir:guards", "semantic")

    def called(self, callers: DataFrame, s: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
        """A caller's services, its own guards, and its branches on parameters of the request with the calls on either side."""
        nodes, edges = [self.service_nodes(s)], [_edges(s, "caller", "id", "calls", "semantic"), self.guarded(s)]
        b = self.of(callers, "branch").withColumn("id", F.regexp_replace(F.concat(F.lit("branch_"), "caller", F.lit("_"), "ord"), "(?i)[^a-z0-9_]", "_"))
        nodes.append(_nodes(b, "id", "'ir:conditional_branch'", "a", "'control_flow'", detail="b"))
        edges.append(_edges(b, "caller", "id", "calls", "static"))
        sites = self.f.branch_calls.select(*HERE, F.col("branch"), "side", F.col("at").alias("ord"), F.col("prop").alias("a"), F.col("fqcn").alias("b"), F.col("called").alias("c"), F.col("literals").alias("args"))
        inner = callers.join(sites.hint(MERGE), HERE).withColumn("caller", F.regexp_replace(F.concat(F.lit("branch_"), "caller", F.lit("_"), "branch"), "(?i)[^a-z0-9_]", "_"))
        t = self.services(callers, inner)
        nodes.append(self.service_nodes(t))
        edges += [_edges(t, "caller", "id", "calls", "semantic"), _edges(t, "caller", "id", "ir:controls", "semantic"), self.guarded(t)]
        g = self.of(callers, "self_guard").withColumn("id", F.regexp_replace(F.concat(F.lit("guard_"), "caller", F.lit("_"), "ord"), "(?i)[^a-z0-9_]", "_"))
        nodes.append(_nodes(g, "id", "'ir:guard_clause'", "concat(class, '::', a)", "'guard'", "path", "nullif(b, '')"))
        edges.append(_edges(g, "caller", "id", "calls", "semantic"))
        edges.append(_edges(g.select("graph_id", "caller", F.col("id").alias("g")).join(s.select("graph_id", "caller", "id").hint(MERGE), ["graph_id", "caller"]), "g", "id", "ir:guards", "semantic"))
        return nodes, edges

    # ---- transactions ----

    def transactions(self, callers: DataFrame, s: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
        """Boundaries, writes and dispatches inside, and the services that the closure calls."""
        t = callers.join(self.blocks.select(*HERE, "block").hint(MERGE), HERE).withColumn("txn", F.concat_ws("_", F.lit("txn"), "caller", "block"))
        h = callers.join(self.held.hint(MERGE), HERE).withColumns({"txn": F.concat_ws("_", F.lit("txn"), "caller", "block"), "id": F.concat_ws("_", F.concat(F.lit("txn_"), "kind"), "caller", "block", "ord")})
        w, e, n = (h.where(F.col("kind") == k) for k in ("write", "escape", "nested"))
        nodes = [_nodes(t, "txn", "'ir:txn_boundary'", "'DB::transaction'", "'atomicity'"), _nodes(w, "id", "'ir:txn_write'", "name", "'persistence'", mutates="true"), _nodes(e, "id", "'ir:txn_escape'", "concat(name, '::dispatch')", "'side_effect'")]
        n = n.select("graph_id", "caller", "txn", F.col("ord").alias("_nth"), F.substring_index("name", "/", 1).alias("prop"), F.substring_index("name", "/", -1).alias("c"))
        targets = s.select("graph_id", "caller", "ord", F.col("a").alias("_prop"), "c", "id")
        first = F.row_number().over(Window.partitionBy("graph_id", "txn", "_nth").orderBy("ord"))
        n = n.join(targets.hint(MERGE), ["graph_id", "caller", "c"]).where("prop = '' or prop = _prop").withColumn("_n", first).where("_n = 1")
        edges = [_edges(t, "caller", "txn", "opens_transaction", "static"), _edges(w, "txn", "id", "ir:wraps", "static"), _edges(e, "txn", "id", "ir:wraps", "static"), _edges(e, "id", "txn", "escapes_transaction", "static"), _edges(n, "txn", "id", "ir:wraps", "semantic")]
        return nodes, edges

    # ---- accesses and audits ----

    def isolation(self, callers: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
        a = callers.join(self.accesses.hint(MERGE), HERE).where("kind = 'read' or not constrained")
        a = a.join(self.tenants.withColumn("tenant", F.lit(True)).hint(MERGE), HERE, "left").withColumns({"id": F.concat_ws("_", F.lit("iso"), F.when(F.col("kind") == "read", "query").otherwise("write"), "caller", "ord"), "symbol": F.concat("model", F.lit("::"), "operation")})
        i = callers.join(self.tenants.hint(MERGE), HERE)
        kind = "case when kind = 'write' then 'ir:unscoped_write' when constrained then 'ir:scoped_query' else 'ir:unscoped_query' end"
        nodes = [_nodes(i, "concat('tenant_injection_', caller)", "'ir:runtime_inject'", "\"app()->instance('tenant', $tenant)\"", "'runtime'"), _nodes(a, "id", kind, "symbol", "'data_access'")]
        return nodes, [_edges(a, "caller", "id", "calls", "static"), _edges(a.where("tenant and not constrained"), "id", "concat('tenant_injection_', caller)", "missing_tenant_scope", "semantic")]

    def audited(self, callers: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
        if self.audits is None:
            return [], []
        a = callers.join(self.audits.hint(MERGE), HERE).withColumn("id", F.regexp_replace(F.concat_ws("_", F.lit("audit"), "caller", "ord"), "(?i)[^a-z0-9_]", "_"))
        return [_nodes(a, "id", "'ir:audit_log'", "symbol", "'side_effect'", args="if(size(args) > 0, args, null)")], [_edges(a, "caller", "id", "calls", "static")]

    # ---- what only handlers have ----

    def policies(self, entries: DataFrame) -> DataFrame:
        """Checks of handlers, with the policy that answers and its file."""
        p = self.of(entries, "authorize").withColumn("policy", F.concat(F.regexp_replace("class", "^(.+)Controller$", "$1"), F.lit("Policy")))
        return p.withColumns({"id": F.concat(F.lit("policy_"), slug(F.col("policy")), F.lit("_"), "a"), "file": F.concat(F.lit("app/Policies/"), "policy", F.lit(".php"))})

    def policy_callers(self, entries: DataFrame) -> DataFrame:
        return self.policies(entries).select("graph_id", "project", F.col("file").alias("path"), F.col("policy").alias("class"), F.col("a").alias("method"), F.col("id").alias("caller")).distinct()

    def missing_policies(self, entries: DataFrame, files: DataFrame) -> DataFrame:
        """Annotations of policies whose file isn't there."""
        lost = self.policies(entries).join(files.select("project", F.col("path").alias("file")).distinct().hint(MERGE), ["project", "file"], "left_anti")
        said = F.concat("policy", F.lit(" referenced in "), "class", F.lit("::"), "method", F.lit(" but class file not found at "), "file")
        return lost.select("graph_id", F.lit("missing_policy").alias("type"), F.col("id").alias("node"), said.alias("description")).distinct()

    def handlers(self, entries: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
        """Requests, policies, resources, dispatches, messages and middleware of constructors, of facts of all kinds."""
        self.every  # noqa: B018: all kinds are needed, so they are written in one job
        r = self.of(entries, "form_request").withColumns({"id": F.concat(F.lit("fr_"), slug(F.col("a"))), "file": class_path(F.col("b"))})
        body = self.f.s.where("kind = 'return' and method = 'authorize'").groupBy("project", F.col("path").alias("file")).agg(F.min(F.struct("at", "text"))["text"].alias("body"))
        r = r.join(body.hint(MERGE), ["project", "file"], "left")
        nodes = [_nodes(r, "id", "'ir:validation_gate'", "concat(a, '::authorize')", "'validation'", "file", "body")]
        edges = [_edges(r, "caller", "id", "form_request", "static")]

        p = self.policies(entries)
        nodes.append(_nodes(p, "id", "'ir:authz_check'", "concat(policy, '::', a)", "'authorization'", "file"))
        edges.append(_edges(p, "caller", "id", "policy_check", "semantic", "b"))

        m = self.of(entries, "model_param").withColumn("id", F.concat(F.lit("resource_"), F.lower("a"), F.lit("_"), "caller"))
        nodes.append(_nodes(m, "id", "'ir:resource'", "a", "'accessed_resource'"))
        edges.append(_edges(m, "caller", "id", "ir:accesses", "static"))
        on = p.where("c is not null").select("graph_id", F.col("c").alias("var"), F.col("id").alias("policy_id"), F.col("b").alias("said"))
        edges.append(_edges(m.select("graph_id", F.col("c").alias("var"), "id").join(on.hint(MERGE), ["graph_id", "var"]), "policy_id", "id", "ir:authorizes", "semantic", "said"))

        d = self.of(entries, "dispatch").where("c <> 'unknown'").withColumns({"id": F.concat(F.when(F.col("c") == "job", "job_").otherwise("evt_"), slug(F.col("a")), F.lit("_"), "caller"), "file": F.when((F.col("c") == "job") & F.contains("b", F.lit("\\")), class_path(F.col("b")))}).dropDuplicates(["graph_id", "id"])
        nodes.append(_nodes(d, "id", "if(c = 'job', 'ir:queue_job', 'ir:event_dispatch')", "concat(a, '::dispatch')", "if(c = 'job', 'async_execution', 'event_emission')", "file"))
        edges.append(_edges(d, "caller", "id", "ir:dispatches", "static"))

        n = self.of(entries, "notification").withColumn("mail", F.col("c") != "notification")
        once = F.row_number().over(Window.partitionBy("graph_id", "b").orderBy("ord"))
        n = n.withColumn("_n", once).where("_n = 1").withColumn("id", F.concat(F.when(F.col("mail"), "mail_").otherwise("notif_"), slug(F.col("a")), F.lit("_"), "caller"))
        nodes.append(_nodes(n, "id", "if(mail, 'ir:mail', 'ir:notification')", "concat(a, if(mail, '::build', '::via'))", "'side_effect'", detail=F.to_json(F.struct(F.col("a").alias("className"), (F.col("c") == "queued").alias("queued")))))
        edges.append(_edges(n, "caller", "id", "ir:sends", "static"))

        w = entries.join(self.facts("constructor_middleware").select(*FILE, "ord", "a", "b", "c").hint(MERGE), FILE)
        w = w.where("(c = '' or array_contains(split(c, ','), method)) and (b = '' or not array_contains(split(b, ','), method))").withColumn("id", F.concat(F.lit("ctor_mw_"), "ord", F.lit("_"), slug(F.col("a"))))
        kind, role, args = middleware(F.col("a"))
        nodes.append(_nodes(w, "id", kind, short(F.col("a")), role, args=args))
        edges.append(_edges(w, "id", "caller", "next_middleware", "static"))
        return nodes, edges


def middleware(raw: Column) -> tuple[Column, Column, Column]:
    """Type, role and arguments of a middleware by what it is written as."""
    name = F.trim(raw)
    kind = (F.when(name.startswith("auth:"), "ir:auth_gate").when(name.rlike("^permission:.+"), "ir:authz_check").when(name.startswith("throttle:"), "rate_limiter").when(name == "signed", "signature_check")
            .when(name == "verified", "email_verification").when(F.contains(name, F.lit("\\")) | name.rlike("^[A-Z]"), "ir:auth_gate").otherwise("ir:unknown_middleware"))
    role = (F.when(name.startswith("auth:"), "authentication").when(kind == "ir:authz_check", "authorization").when(kind == "rate_limiter", "rate_limiting").when(kind.isin("signature_check", "email_verification"), "authentication")
            .when(kind == "ir:auth_gate", "middleware").otherwise("unknown"))
    args = F.when(kind == "ir:authz_check", F.split(F.regexp_replace(name, "^permission:", ""), r"\|")).when((kind == "ir:auth_gate") & (role == "middleware") | F.contains(raw, F.lit("\\")), F.array(raw))
    return kind, role, args


def _together(parts: list[tuple[list[DataFrame], list[DataFrame]]]) -> tuple[DataFrame, DataFrame]:
    return _all([n for ns, _ in parts for n in ns]), _all([e for _, es in parts for e in es])


def augment(entries: DataFrame, passes: Passes, files: DataFrame) -> Augmented:
    """Nodes and edges that the handlers' own code adds; of a policy its calls on services too.  Entries without a method or file add nothing."""
    nodes, edges = passes.handlers(entries)
    s, of_policies = passes.services(entries), passes.services(passes.policy_callers(entries))
    parts = [(nodes, edges), passes.called(entries, s), ([passes.service_nodes(of_policies)], [_edges(of_policies, "caller", "id", "calls", "semantic"), passes.guarded(of_policies)]), passes.transactions(entries, s), passes.isolation(entries), passes.audited(entries)]
    n, e = _together(parts)
    return Augmented(n.dropDuplicates(["graph_id", "id"]), e, passes.missing_policies(entries, files))


def roots(entries: DataFrame, passes: Passes, files: DataFrame | None = None) -> DataFrame:
    """Services from which an expansion starts: those of the handler, then those of its policies, with their place in line; no file is looked up."""
    policies = passes.policy_callers(entries)
    a, b = passes.services(entries).withColumn("line", F.struct(F.lit(0).alias("k"), F.lit("").alias("c"), "ord")), passes.services(policies).withColumn("line", F.struct(F.lit(1).alias("k"), F.col("caller").alias("c"), "ord"))
    return _frontier(a.unionByName(b, allowMissingColumns=True))


def _frontier(s: DataFrame) -> DataFrame:
    return s.where("file is not null").select("graph_id", "project", F.col("file").alias("path"), F.substring_index("symbol", "::", 1).alias("class"), F.substring_index("symbol", "::", -1).alias("method"), F.col("id").alias("caller"), "symbol", "line")


def expanded(start: DataFrame, passes: Passes, levels: int = LEVELS, budget: int = BUDGET, focus: str = "all", keep=written) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Services followed into their methods, level by level: nodes, edges, and the methods in the order of their visits.

    A graph visits each method of a file once, and spends on it what the method adds: three for a transaction, one for each
    read, audit, service, branch and guard.  A method is visited while anything is left, so the last may overdraw; where less than half
    is left at a level's start, what matters most goes first.  A level is one window a graph: costs before a method add up in order.
    """
    if focus not in FOCUS and focus != "all":
        raise ValueError(f"no focus {focus!r}")
    wanted = (lambda df: df) if focus == "all" else (lambda df: df.where(F.lower("symbol").rlike(FOCUS[focus])))
    one = lambda df, n, by=HERE: df.groupBy(*by).agg(F.count("*").alias(n))
    count = lambda kind, n: one(passes.facts(kind), n)
    services = passes.facts("service_call").groupBy(*HERE).agg(F.count_distinct(slug(F.concat_ws("_", short(F.col("b")), "c"))).alias("services"))
    costs = passes.f.m.select(*HERE)
    for c in (one(passes.blocks, "blocks"), one(passes.accesses.where("kind = 'read'"), "reads"), count("branch", "branches"), count("self_guard", "guards"), services, *([one(passes.audits, "audited")] if passes.audits is not None else [])):
        costs = costs.join(c.hint(MERGE), HERE, "left")
    zero = lambda c: F.coalesce(c, F.lit(0)) if c in costs.columns else F.lit(0)
    costs = keep(costs.select(*HERE, (3 * zero("blocks") + sum((zero(c) for c in ("reads", "branches", "guards", "services", "audited")), F.lit(0))).alias("cost")), "costs")
    weight = F.lit(0)
    for w, words in reversed(WEIGHTS):
        weight = F.when(F.lower("symbol").rlike(words), w).otherwise(weight)

    now = keep(wanted(start), "frontier-0")
    left = now.select("graph_id").distinct().withColumn("left", F.lit(budget).cast("long"))
    seen, nodes, edges, visits = None, [], [], []
    for level in range(1, levels + 1):
        x = now.join(left.hint(MERGE), "graph_id").where("left > 0")
        if seen is not None:
            x = x.join(seen.hint(MERGE), ["graph_id", "path", "method"], "left_anti")
        order = [F.when(F.col("left") < budget / 2, -weight).otherwise(0), F.col("line")]
        first = F.row_number().over(Window.partitionBy("graph_id", "path", "method").orderBy(*order))
        x = x.withColumn("_n", first).where("_n = 1").join(costs.hint(MERGE), HERE, "left").withColumn("cost", F.coalesce("cost", F.lit(0)))
        w = Window.partitionBy("graph_id").orderBy(*order)
        spent = F.coalesce(F.sum("cost").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        x = keep(x.withColumn("spent", spent).where("spent < left").withColumn("nth", F.row_number().over(w)).drop("_n"), f"visited-{level}")
        visits.append(x.select("graph_id", F.lit(level).alias("level"), "nth", "path", "method", "cost", (F.col("left") - F.col("spent")).alias("left")))
        callers = x.select("graph_id", "project", "path", "class", "method", "caller")
        s = keep(passes.services(callers), f"services-{level}")
        n, e = _together([passes.called(callers, s), passes.transactions(callers, s), passes.isolation(callers), passes.audited(callers)])
        nodes.append(n)
        edges.append(e)
        if level == levels:
            break
        left = left.join(x.groupBy("graph_id").agg(F.sum("cost").alias("_spent")).hint(MERGE), "graph_id", "left").select("graph_id", (F.col("left") - F.coalesce("_spent", F.lit(0))).alias("left"))
        here = x.select("graph_id", "path", "method")
        seen = here if seen is None else seen.unionByName(here)
        place = s.join(x.select("graph_id", "caller", "nth").hint(MERGE), ["graph_id", "caller"]).withColumn("line", F.struct(F.col("nth").alias("k"), F.lit("").alias("c"), "ord"))
        now = keep(wanted(_frontier(place)), f"frontier-{level}")
    return _all(nodes).dropDuplicates(["graph_id", "id"]), _all(edges), _all(visits)
