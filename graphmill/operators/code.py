"""What a project's source text says, from rows of syntax (``sources.syntax``): facts of methods, transactions, accesses to models, guards.

Everything here is joins, filters and windows within a file, keyed by (project, path); what stands in another file is joined by
its path.  Containment of calls in closures and of chains in chains is found by one pass in order of place, not by
comparing pairs.
"""
from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.corpus import written

FILE = ["project", "path"]
#: how joins are made: Spark goes by the size of files, and source text and what is read from it take ten times that and more in memory, so what it would broadcast fills the driver
MERGE = "merge"
FACT = "project", "path", "method", "kind", "ord", "a", "b", "c", "args"

# fixed values
NAMESPACES = (("App\\", "app/"),)
BASE_REQUESTS = ("Request", "Illuminate\\Http\\Request", "Illuminate\\Foundation\\Http\\FormRequest")
SERVICE_SUFFIXES = ("Service", "Repository", "Manager", "Provider", "Factory", "Contract", "Interface", "Middleware", "Policy", "Gate", "Guard", "Controller", "Handler", "Listener", "Job", "Event", "Mailer", "Notification", "Resource", "Transformer")
NOT_INJECTED = ("Request", "Closure", "Response")
MUTATING = ("delete", "update", "save", "create", "attach", "detach", "sync", "forceDelete")
REQUEST_READS = ("input", "has", "boolean")
DISPATCHES = ("dispatch", "dispatchSync", "dispatchNow", "dispatchAfterResponse")
STATIC_WRITES = {"create": "create", "upsert": "upsert", "updateOrCreate": "upsert", "insert": "create", "firstOrCreate": "create"}
OBJECT_WRITES = {"save": "save", "update": "update", "delete": "delete", "forceDelete": "delete"}
READS = ("find", "findOrFail", "first", "firstOrFail", "get", "all", "paginate", "where", "latest", "oldest", "pluck")
MODEL_WRITES = ("create", "insert", "update")
FACADES = ("DB", "Auth", "Cache", "Session", "Queue", "Event", "Log", "Mail", "Bus", "Gate", "Hash", "Storage", "Validator")
TENANT_SIGNALS = ("tenant_id", "tenantId", "tenant", "organization_id", "organizationId", "whereTenant", "whereTenantId", "forTenant", "whereOrganization", "whereOrganizationId")
TENANT_KEYS = ("tenant", "organization")
GUARD_NAME = "(?i)^(ensure|assert|guard|verify)"


def dispatch_kind(name: Column) -> Column:
    """job, event or unknown of a dispatched class: by its namespace, then by its last name, events before jobs."""
    spaces, last = F.split(name, r"\\"), F.substring_index(name, "\\", -1)
    return (F.when(F.arrays_overlap(spaces, F.array(F.lit("Jobs"), F.lit("Actions"))), "job").when(F.array_contains(spaces, "Events"), "event")
            .when(last.rlike("Event|Was[A-Z]|Created|Updated|Deleted|Fired|Dispatched"), "event").when(last.rlike("Job|Process|Send|Queue|Handle"), "job").otherwise("unknown"))


def class_path(fqcn: Column, namespaces=NAMESPACES) -> Column:
    """The file of a class by its namespace; null where none fits."""
    out = F.lit(None).cast("string")
    for space, folder in reversed(namespaces):
        out = F.when(F.startswith(fqcn, F.lit(space)), F.concat(F.lit(folder), F.replace(F.substr(fqcn, F.lit(len(space) + 1)), F.lit("\\"), F.lit("/")), F.lit(".php"))).otherwise(out)
    return out


def short(fqcn: Column) -> Column:
    return F.substring_index(fqcn, "\\", -1)


def _among(column: Column, values) -> Column:
    return column.isin(*values)


def _mapped(column: Column, values: dict) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in values.items() for x in pair)), column)


# ---- spans ----

def outermost(spans: DataFrame, by: list[str]) -> DataFrame:
    """Spans (at, end) that lie in no other of the same key; as spans of syntax nest, one running maximum in order of place tells."""
    w = Window.partitionBy(*by).orderBy("at", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    return spans.withColumn("_reach", F.max("end").over(w)).where("_reach is null or at >= _reach").drop("_reach")


def stabbed(points: DataFrame, spans: DataFrame, by: list[str], carried: list[str]) -> DataFrame:
    """Points (at, end, ..) that lie in one of the disjoint spans (at, end) of their key, with ``carried`` of it: a merge by place, no pair is formed."""
    kept = points.columns
    p = points.select(*by, "at", F.lit(1).alias("_later"), F.struct(*kept).alias("_point"), F.lit(None).cast(spans.select(F.struct("at", "end", *carried).alias("s")).schema["s"].dataType).alias("_span"))
    s = spans.select(*by, "at", F.lit(0).alias("_later"), F.lit(None).cast(p.schema["_point"].dataType).alias("_point"), F.struct("at", "end", *carried).alias("_span"))
    w = Window.partitionBy(*by).orderBy("at", "_later").rowsBetween(Window.unboundedPreceding, 0)
    x = p.unionByName(s).withColumn("_span", F.last("_span", True).over(w)).where("_point is not null and _point.at > _span.at and _point.end <= _span.end")
    return x.select("_point.*", *(F.col(f"_span.{c}").alias(c) for c in carried))


# ---- what stands in a file ----

def imports(s: DataFrame) -> DataFrame:
    """(project, path, alias, fqcn); of a name that is imported twice the later one."""
    w = Window.partitionBy(*FILE, "name").orderBy(F.desc("at"))
    return s.where("kind = 'use'").withColumn("_n", F.row_number().over(w)).where("_n = 1").select(*FILE, F.col("name").alias("alias"), F.col("text").alias("fqcn"))


def resolved(rows: DataFrame, uses: DataFrame, name: str, out: str) -> DataFrame:
    """``out``: the full name of the class in column ``name`` by the file's imports, the name itself if none tells."""
    u = uses.select(*FILE, F.col("alias").alias(name), F.col("fqcn").alias("_full"))
    return rows.join(u.hint(MERGE), [*FILE, name], "left").withColumn(out, F.coalesce("_full", name)).drop("_full")


def methods(s: DataFrame) -> DataFrame:
    """Methods of a file, the first of each name: project, path, method, class, visibility, at, end, line, params (ord, type, var, promoted)."""
    w = Window.partitionBy(*FILE, "name").orderBy("at")
    m = s.where("kind = 'method'").withColumn("_n", F.row_number().over(w)).where("_n = 1")
    params = F.transform("args", lambda a, i: F.struct(i.alias("ord"), a["text"].alias("type"), a["value"].alias("var"), (a["kind"] == "promoted").alias("promoted")))
    return m.select(*FILE, F.col("name").alias("method"), "class", F.col("form").alias("visibility"), "at", "end", "line", params.alias("params"))


def _within(s: DataFrame, kind: str) -> DataFrame:
    """Rows of one kind that stand in the first method of their name, as the reader tells: no row is joined with its method."""
    return s.where((F.col("kind") == kind) & F.col("placed"))


def calls(s: DataFrame) -> DataFrame:
    """Calls in methods, in the order of a walk from the outside: by place, the longer first."""
    return _within(s, "call")


def guards(s: DataFrame) -> DataFrame:
    """Methods that may throw or abort on a condition at their top: project, path, method, reason, condition."""
    top = _within(s, "if").where("ord >= 0 and args[1].kind = 'exit'").groupBy(*FILE, "method").agg(F.min("ord").alias("first"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "; ").alias("condition"))
    reason = F.when(F.col("first") == 0, "leading_if_throw").when(F.col("method").rlike(GUARD_NAME), "guard_naming_with_throw")
    return top.select(*FILE, "method", reason.alias("reason"), "condition").where("reason is not null")


def scopes(s: DataFrame, m: DataFrame, g: DataFrame) -> DataFrame:
    """Where a method's facts come from beside itself (rank 0): the methods of its class that it calls on itself, if they aren't guards: project, path, method, source, rank (from 1)."""
    c = calls(s).where("form = 'member' and base = '$this'")
    first = c.groupBy(*FILE, "method", F.col("name").alias("source")).agg((F.min(F.struct("at", F.negative("end").alias("e")))).alias("o"))
    called = first.join(m.select(*FILE, F.col("method").alias("source")).hint(MERGE), [*FILE, "source"], "left_semi").join(g.select(*FILE, F.col("method").alias("source")).hint(MERGE), [*FILE, "source"], "left_anti")
    rank = F.row_number().over(Window.partitionBy(*FILE, "method").orderBy("o")).cast("long")
    return called.select(*FILE, "method", "source", rank.alias("rank"))


def injections(m: DataFrame, uses: DataFrame) -> DataFrame:
    """Variables that hold a service or a model: project, path, method (null: from the constructor), var, fqcn."""
    p = m.select(*FILE, "method", F.explode("params").alias("p")).select(*FILE, "method", F.col("p.type").alias("type"), F.ltrim(F.col("p.var"), F.lit("$")).alias("var"), F.col("p.ord").alias("ord"))
    p = p.where(F.col("type").rlike(r"^[^a-z]") & (F.col("type") != "") & ~_among(F.col("type"), NOT_INJECTED))
    made = p.where("method = '__construct'").withColumn("method", F.lit(None).cast("string"))
    x = made.unionByName(p.where("method <> '__construct' and not endswith(type, 'Request')"))
    last = F.row_number().over(Window.partitionBy(*FILE, "method", "var").orderBy(F.desc("ord")))
    return resolved(x.withColumn("_n", last).where("_n = 1"), uses, "type", "fqcn").select(*FILE, "method", "var", "fqcn")


def _ranked(rows: DataFrame, kind: str, a, b, c, args=None) -> DataFrame:
    """Facts of one kind, numbered in order of (rank, place)."""
    n = F.row_number().over(Window.partitionBy(*FILE, "method").orderBy("rank", "at", F.desc("end"))) - 1
    return rows.select(*FILE, "method", F.lit(kind).alias("kind"), n.alias("ord"), *(F.expr(x).cast("string").alias(k) for k, x in zip("abc", (a, b, c))), (args if args is not None else F.array().cast("array<string>")).alias("args"))


def _literals(args) -> Column:
    return F.transform(F.filter(args, lambda x: x["kind"] == "string"), lambda x: x["value"])


class Facts:
    """Facts of all methods of a project's files; each property is a DataFrame, made when first asked for, and shares the tables before it."""

    def __init__(self, s: DataFrame, keep=written):
        """``keep`` writes a table that much is asked of and reads it back."""
        self.s, self.keep = s, keep

    @cached_property
    def uses(self) -> DataFrame:
        return self.keep(imports(self.s), "imports")

    @cached_property
    def m(self) -> DataFrame:
        return self.keep(methods(self.s), "methods")

    @cached_property
    def guards(self) -> DataFrame:
        self.m  # noqa: B018: what asks for guards asks for methods, too
        return self.keep(guards(self.s), "guards")

    @cached_property
    def calls(self) -> DataFrame:
        return self.keep(calls(self.s), "calls")

    @cached_property
    def injections(self) -> DataFrame:
        return self.keep(injections(self.m, self.uses), "injections")

    @cached_property
    def every(self) -> DataFrame:
        """Calls with the methods they count for; only those of methods that are called on $this are joined, and written."""
        others = self.calls.where("shared").withColumnRenamed("method", "source").join(scopes(self.s, self.m, self.guards).hint(MERGE), [*FILE, "source"])
        own = self.calls.withColumns({"source": F.col("method"), "rank": F.lit(0).cast("long")})
        return own.unionByName(self.keep(others, "every-call"))

    @cached_property
    def sites(self) -> DataFrame:
        return self.keep(self._service_sites(), "service-sites")

    @cached_property
    def branches(self) -> DataFrame:
        return self.keep(self._branches(), "branches")

    @cached_property
    def branch_calls(self) -> DataFrame:
        return self.keep(self._branch_calls(), "branch-calls")

    def params(self) -> DataFrame:
        return resolved(self.m.select(*FILE, "method", F.explode("params").alias("p")).select(*FILE, "method", "p.ord", "p.type", "p.var", "p.promoted"), self.uses, "type", "fqcn").where("not promoted")

    def form_requests(self) -> DataFrame:
        x = self.params().where(F.endswith("type", F.lit("Request")) & ~_among(F.col("type"), BASE_REQUESTS) & ~_among(F.col("fqcn"), BASE_REQUESTS))
        return _ranked(x.selectExpr("*", "0 as rank", "ord as at", "0 as end"), "form_request", "type", "fqcn", "var")

    def model_params(self) -> DataFrame:
        suffix = F.regexp_replace("type", ".*([A-Z][a-z]+)$", "$1")
        x = self.params().where(F.col("type").rlike("^[A-Z]") & ~F.endswith("type", F.lit("Request")) & ~_among(suffix, SERVICE_SUFFIXES) & ~_among(F.col("fqcn"), BASE_REQUESTS))
        return _ranked(x.selectExpr("*", "0 as rank", "ord as at", "0 as end"), "model_param", "type", "fqcn", "var")

    def authorize_calls(self) -> DataFrame:
        x = self.every.where("form = 'member' and base = '$this' and name = 'authorize' or form = 'static' and base = 'Gate' and name in ('authorize', 'allows', 'check')")
        known = self.model_params().select(*FILE, "method", F.col("c").alias("var")).distinct()
        x = x.withColumn("var", F.when(F.get("args", F.lit(1))["kind"] == "variable", F.get("args", F.lit(1))["value"]))
        x = x.join(known.withColumn("_known", F.lit(True)).hint(MERGE), [*FILE, "method", "var"], "left")
        first = F.get("args", F.lit(0))
        return _ranked(x.withColumn("ability", F.coalesce(F.when(first["kind"] == "string", first["value"]), first["text"], F.lit("unknown"))), "authorize", "ability", "text", "if(_known, var, null)")

    def _service_sites(self) -> DataFrame:
        """Calls on what is injected, with repeats: rank, at, end, prop, fqcn, called, mutates, literals, source."""
        var = F.coalesce(F.nullif(F.regexp_extract("base", r"^\$this->(\w+)$", 1), F.lit("")), F.nullif(F.regexp_extract("base", r"^\$(\w+)$", 1), F.lit("")))
        x = self.every.where("form = 'member'").withColumn("var", var)
        # what a variable holds in each method, with what the constructor puts into it, in one row
        held = F.map_from_entries(F.collect_list(F.when(F.col("method").isNotNull(), F.struct("method", "fqcn"))))
        i = self.injections.groupBy(*FILE, "var").agg(held.alias("_own"), F.max(F.when(F.col("method").isNull(), F.col("fqcn"))).alias("_made"))
        base = x.where("base like '$%' and var is not null").select(*FILE, "method", "source", "rank", "at", "end", "name", "var", _literals("args").alias("literals")).join(i.hint(MERGE), [*FILE, "var"])
        base = base.withColumn("fqcn", F.coalesce(F.try_element_at("_own", F.col("method")), "_made")).where("fqcn is not null").drop("_own", "_made")
        # a mutating call right behind such a call is one with it
        behind = [*FILE, "method", "source", "rank", "at", "end"]
        tail = x.where(_among(F.col("name"), MUTATING)).select(*behind[:-1], (F.col("at") + F.length("base")).alias("end"), F.struct(F.col("name").alias("_tail"), F.col("end").alias("_end")).alias("t")).groupBy(*behind).agg(F.max("t").alias("t"))
        both = base.dropDuplicates([*behind, "name", "var", "fqcn"]).join(tail.hint(MERGE), behind, "left")
        return both.select(
            *FILE, "method", "source", "rank", "at", F.coalesce("t._end", "end").alias("end"), F.col("var").alias("prop"), "fqcn",
            F.when(F.col("t").isNotNull(), F.concat("name", F.lit("()->"), "t._tail")).otherwise(F.col("name")).alias("called"), F.col("t").isNotNull().alias("mutates"), "literals")

    def request_vars(self) -> DataFrame:
        """Variables that hold a request's parameter: project, path, method, var, parameter."""
        a = _within(self.s, "assign")
        c = self.calls.where(_among(F.col("name"), REQUEST_READS) & (F.col("form") == "member") & F.col("base").rlike(r"^\$\w+$")).select(*FILE, "method", "at", "end", F.get(_literals("args"), F.lit(0)).alias("parameter"))
        x = a.select(*FILE, "method", "at", "end", F.ltrim("name", F.lit("$")).alias("var")).join(c.hint(MERGE), [*FILE, "method", "at", "end"]).where("parameter is not null")
        return x.groupBy(*FILE, "method", "var").agg(F.max(F.struct("at", "parameter"))["parameter"].alias("parameter"))

    def _branches(self) -> DataFrame:
        """Branches on a request's parameter: project, path, method, ord, at, end, condition, parameter, spans of then and else."""
        i = _within(self.s, "if")
        v = self.request_vars().join(_within(self.s, "assign").groupBy(*FILE, "method", F.ltrim("name", F.lit("$")).alias("var")).agg(F.min("at").alias("first")).hint(MERGE), [*FILE, "method", "var"])
        x = i.join(v.hint(MERGE), [*FILE, "method"]).where(F.contains("text", F.concat(F.lit("$"), "var")))
        first = F.row_number().over(Window.partitionBy(*FILE, "method", "at").orderBy("first"))
        x = x.withColumn("_n", first).where("_n = 1")
        n = F.row_number().over(Window.partitionBy(*FILE, "method").orderBy("at")) - 1
        return x.select(*FILE, "method", n.alias("ord"), "at", "end", F.col("text").alias("condition"), "parameter", F.get("args", F.lit(1)).alias("then"), F.get("args", F.lit(2)).alias("other"))

    def _branch_calls(self) -> DataFrame:
        """Service calls in such a branch: project, path, method, branch, side, at, end, prop, fqcn, called, mutates, literals."""
        sides = self.branches.select(*FILE, "method", F.col("ord").alias("branch"), F.explode(F.array(F.struct(F.lit("then").alias("side"), F.col("then.at").alias("a"), F.col("then.end").alias("e")), F.struct(F.lit("else").alias("side"), F.col("other.at").alias("a"), F.col("other.end").alias("e")))).alias("x")).select(*FILE, "method", "branch", "x.*").where("a is not null")
        return self.sites.where("rank = 0").join(sides.hint(MERGE), [*FILE, "method"]).where("at >= a and end <= e").drop("a", "e", "rank", "source")

    def service_calls(self) -> DataFrame:
        """Service calls of each method, one a property and called method, without those that stand in a branch on a parameter."""
        key = [*FILE, "method", "prop", "called"]
        first = F.row_number().over(Window.partitionBy(*key).orderBy("rank", "at", F.desc("end")))
        x = self.sites.withColumn("_n", first).where("_n = 1").join(self.branch_calls.select(*key).distinct().hint(MERGE), key, "left_anti")
        out = _ranked(x, "service_call", "prop", "fqcn", "called", F.col("literals"))
        return out

    def constructor_middleware(self) -> DataFrame:
        """Middleware that a constructor adds: a its name, b the methods left out, c the only ones, by commas."""
        c = self.calls.where("method = '__construct' and form = 'member' and base = '$this' and name = 'middleware' and size(args) > 0")
        items = self.s.where("kind = 'item'")
        keyed = items.select(*FILE, F.col("owner").alias("_array"), F.col("base").alias("_key"), F.col("at").alias("owner"))
        lists = keyed.where("_key in ('except', 'only')").join(items.where("form = 'string' and base is null").hint(MERGE), [*FILE, "owner"]).groupBy(*FILE, "_array", "_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "name"))), lambda x: x["name"]), ",").alias("names"))
        x = c.withColumn("_array", F.get("args", F.lit(1))["at"])
        for k in ("except", "only"):
            x = x.join(lists.where(F.col("_key") == k).select(*FILE, "_array", F.col("names").alias(f"_{k}")).hint(MERGE), [*FILE, "_array"], "left")
        first = F.get("args", F.lit(0))
        return _ranked(x.withColumns({"rank": F.lit(0), "raw": F.when(first["kind"] == "string", first["value"]).otherwise(first["text"])}), "constructor_middleware", "raw", "coalesce(_except, '')", "coalesce(_only, '')")

    def transactions(self) -> DataFrame:
        """Outermost transactions with a closure: project, path, method, block, at, end (of the closure)."""
        t = self.calls.where("form = 'static' and base = 'DB' and name = 'transaction'")
        t = t.withColumn("_c", F.get(F.filter("args", lambda a: a["kind"] == "closure"), F.lit(0))).where("_c is not null")
        t = outermost(t, [*FILE, "method"])
        n = F.row_number().over(Window.partitionBy(*FILE, "method").orderBy("at")) - 1
        return t.select(*FILE, "method", n.alias("block"), F.col("_c.at").alias("at"), F.col("_c.end").alias("end"))

    def _outside(self, rows: DataFrame) -> DataFrame:
        """Rows that stand in no transaction's call, closure or not."""
        t = outermost(self.calls.where("form = 'static' and base = 'DB' and name = 'transaction'").select(*FILE, F.col("method").alias("source"), "at", "end"), [*FILE, "source"])
        inside = stabbed(rows.select(*FILE, "source", "method", "at", "end"), t, [*FILE, "source"], []).distinct()
        return rows.join(inside.hint(MERGE), [*FILE, "source", "method", "at", "end"], "left_anti")

    def dispatches(self) -> DataFrame:
        """Jobs and events that are dispatched outside transactions: a class, b full name, c kind."""
        first = F.get(F.filter("args", lambda a: _among(a["kind"], ("new", "static")) & ~((a["kind"] == "static") & _among(a["value"], ("DB", "Bus")))), F.lit(0))["value"]
        said = _among(F.col("name"), DISPATCHES)
        by_arg = (F.col("form") == "static") & (F.col("base") == "Bus") & said | (F.col("form") == "member") & (F.col("base") == "$this") & said | (F.col("form") == "function") & _among(F.col("name"), ("dispatch", "event"))
        by_class = (F.col("form") == "static") & ~_among(F.col("base"), ("DB", "Bus")) & (said | (F.col("name") == "run"))
        x = self.every.withColumn("class_", F.when(by_arg, first).when(by_class, F.col("base"))).where("class_ is not null and class_ <> ''")
        x = outermost(self._outside(x), [*FILE, "method", "source"])
        x = resolved(x, self.uses, "class_", "fqcn").withColumn("kind_", dispatch_kind(F.col("fqcn")))
        return _ranked(x, "dispatch", "class_", "fqcn", "kind_")

    def notifications(self) -> DataFrame:
        """Notifications and mail: a class, b full name, c notification, mail or queued."""
        new = F.get(F.filter("args", lambda a: a["kind"] == "new"), F.lit(0))["value"]
        second = F.when(F.get("args", F.lit(1))["kind"] == "new", F.get("args", F.lit(1))["value"])
        told = (F.col("form") == "static") & (F.col("base") == "Notification") & (F.col("name") == "send")
        noted = (F.col("form") == "member") & _among(F.col("name"), ("notify", "notifyNow"))
        mailed = _among(F.col("name"), ("send", "queue")) & ((F.col("form") == "static") & (F.col("base") == "Mail") | (F.col("form") == "member") & F.col("base").rlike(r"^\\?Mail::(to|cc|bcc)\(") & (F.col("root") == "Mail"))
        x = self.every.withColumns({"class_": F.when(told, second).when(noted | mailed, new), "kind_": F.when(told | noted, "notification").when(mailed & (F.col("name") == "queue"), "queued").otherwise("mail")}).where("class_ is not null")
        return _ranked(resolved(outermost(x, [*FILE, "method", "source"]), self.uses, "class_", "fqcn"), "notification", "class_", "fqcn", "kind_")

    def self_guards(self) -> DataFrame:
        """Calls of a method on its own class's guard methods: a its name, b what it checks."""
        c = self.calls.where("form = 'member' and base = '$this'").groupBy(*FILE, "method", F.col("name").alias("guard")).agg(F.min("at").alias("at"), F.lit(0).alias("end"))
        x = c.join(self.guards.select(*FILE, F.col("method").alias("guard"), "condition").hint(MERGE), [*FILE, "guard"])
        return _ranked(x.withColumn("rank", F.lit(0)), "self_guard", "guard", "condition", "null")

    def accesses(self, signals=TENANT_SIGNALS, keys=TENANT_KEYS) -> DataFrame:
        """Reads and writes of models: project, path, method, kind (read, write), ord, model, operation, constrained.

        A chain counts once, by its outermost reading call, and is constrained if any of its text names a tenant; a write is if a
        quoted tenant key stands among its arguments; what is saved by itself never is.
        """
        model = ~_among(F.col("_model"), FACADES) & F.col("_model").rlike("^[A-Z]")
        reads = self.calls.withColumn("_model", F.when(F.col("form") == "static", F.col("base")).when(F.col("form") == "member", F.ltrim("root", F.lit("\\")))).where(_among(F.col("name"), READS) & model)
        hit = F.exists(F.array(*map(F.lit, signals)), lambda s: F.contains(F.col("text"), s))
        # asked of the text before the window, so that texts aren't shuffled
        reads = outermost(reads.withColumn("constrained", hit), [*FILE, "method"]).select(*FILE, "method", "at", F.lit("read").alias("kind"), F.col("_model").alias("model"), F.col("name").alias("operation"), "constrained")
        inside = F.array_join(F.transform("args", lambda a: a["text"]), ",")
        quoted = F.exists(F.array(*map(F.lit, signals)), lambda s: F.contains(inside, F.concat(F.lit("'"), s, F.lit("'"))) | F.contains(inside, F.concat(F.lit('"'), s, F.lit('"'))))
        static = self.calls.withColumn("_model", F.when(F.col("form") == "static", F.col("base"))).where(_among(F.col("name"), MODEL_WRITES) & model).withColumn("constrained", quoted)
        saved = self.calls.where(r"form = 'member' and name = 'save' and base rlike '^\\$[a-zA-Z_]'").withColumns({"_model": F.col("base"), "constrained": F.lit(False)})
        writes = outermost(static.unionByName(saved), [*FILE, "method"]).select(*FILE, "method", "at", F.lit("write").alias("kind"), F.col("_model").alias("model"), F.col("name").alias("operation"), "constrained")
        n = F.row_number().over(Window.partitionBy(*FILE, "method", "kind").orderBy("at")) - 1
        return reads.unionByName(writes).select(*FILE, "method", "kind", n.alias("ord"), "model", "operation", "constrained")

    def container_reads(self, keys=TENANT_KEYS) -> DataFrame:
        """Methods that take the tenant from the container: project, path, method."""
        said = F.lower(F.array_join(F.transform("args", lambda a: a["text"]), ","))
        return self.calls.where((F.col("form") == "function") & _among(F.col("name"), ("app", "resolve")) & F.exists(F.array(*(F.lit(k.lower()) for k in keys)), lambda k: F.contains(said, k))).select(*FILE, "method").distinct()

    def audits(self, sinks: DataFrame) -> DataFrame:
        """Calls of audit sinks (symbol: ``X::add`` or ``activity()->log``): project, path, method, ord, symbol, args."""
        f = F.regexp_extract("base", r"^(\w+)\((?:[^()]|\([^()]*\))*\)$", 1)
        x = self.calls.withColumn("symbol", F.when(F.col("form") == "static", F.concat("base", F.lit("::"), "name")).when((F.col("form") == "member") & (f != ""), F.concat(f, F.lit("()->"), "name")))
        x = x.join(sinks.select("symbol").distinct(), "symbol", "left_semi")
        n = F.row_number().over(Window.partitionBy(*FILE, "method").orderBy("at", F.desc("end"))) - 1
        return x.select(*FILE, "method", n.alias("ord"), "symbol", _literals("args").alias("args"))

    def in_transactions(self) -> DataFrame:
        """What a transaction holds: project, path, method, block, kind (write, escape, nested), ord, name, at: writes of models, dispatches, calls on services and on the class itself (property/method)."""
        new = F.get(F.filter("args", lambda a: a["kind"] == "new"), F.lit(0))["value"]
        write = F.when(F.col("form") == "static", F.concat("base", F.lit("::"), _mapped(F.col("name"), STATIC_WRITES))).when(F.col("form") == "member", F.concat(F.lit("unknown::"), _mapped(F.col("name"), OBJECT_WRITES)))
        escape = F.when((F.col("form") == "static") & (F.col("name") == "dispatch") & (F.col("base") != "DB"), F.col("base")).when((F.col("form") == "function") & (F.col("name") == "dispatch"), new)
        prop = F.when(F.col("base") == "$this", "").otherwise(F.nullif(F.regexp_extract("base", r"^\$this->(\w+)$", 1), F.lit("")))
        nested = F.when(F.col("form") == "member", F.concat(prop, F.lit("/"), "name"))
        # what a call is, is told before its place is looked for, so that its texts and arguments aren't shuffled
        x = self.calls.where("form in ('static', 'member', 'function')").select(*FILE, "method", "at", "end", write.alias("write"), escape.alias("escape"), nested.alias("nested")).where("coalesce(write, escape, nested) is not null")
        x = stabbed(x, self.transactions(), [*FILE, "method"], ["block"])
        x = x.select(*FILE, "method", "block", "at", "end", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("name")) for k in ("write", "escape", "nested")))).alias("x")).where("x.name is not null")
        n = F.row_number().over(Window.partitionBy(*FILE, "method", "block", "x.kind").orderBy("at", F.desc("end"))) - 1
        return x.select(*FILE, "method", "block", "x.kind", n.alias("ord"), "x.name", "at")

    def of(self, kind: str) -> DataFrame:
        """The facts of one kind, of ``KINDS``."""
        return KINDS[kind](self)

    def all(self) -> DataFrame:
        """Every fact as one table of ``FACT``."""
        return reduce(DataFrame.unionByName, (f(self) for f in dict.fromkeys(KINDS.values())))

    def branch_facts(self) -> DataFrame:
        b = self.branches.select(*FILE, "method", F.lit("branch").alias("kind"), "ord", F.col("condition").alias("a"), F.col("parameter").alias("b"), F.lit(None).cast("string").alias("c"), F.array().cast("array<string>").alias("args"))
        n = F.row_number().over(Window.partitionBy(*FILE, "method", "side").orderBy("branch", "at", F.desc("end"))) - 1
        c = self.branch_calls.select(*FILE, "method", F.concat(F.lit("branch_"), "side").alias("kind"), n.alias("ord"), F.col("prop").alias("a"), "fqcn", F.col("called").alias("c"), F.col("literals").alias("args"))
        return b.unionByName(c.withColumnRenamed("fqcn", "b"))


#: what gives the facts of a kind; of branches all three kinds at once
KINDS = {
    "form_request": Facts.form_requests, "model_param": Facts.model_params, "authorize": Facts.authorize_calls, "service_call": Facts.service_calls, "constructor_middleware": Facts.constructor_middleware, "dispatch": Facts.dispatches,
    "notification": Facts.notifications, "self_guard": Facts.self_guards, "branch": Facts.branch_facts, "branch_then": Facts.branch_facts, "branch_else": Facts.branch_facts,
}
