"""Routes of a project from its route files: groups within a file, files that include others, and what wraps a file from outside.

Everything comes from rows of syntax (``sources.syntax``).  A route file is read under contexts (prefix, middleware, namespace): those of
the project's entry files, carried along the includes by iterated joins; a file that includes itself, over others or at once, isn't entered again.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.corpus import written
from .code import FILE, class_path, short

# fixed values
VERBS = ("get", "post", "put", "patch", "delete", "options")
RESOURCE = (("GET", "", "index", False), ("POST", "", "store", False), ("GET", "/{id}", "show", False), ("PUT", "/{id}", "update", False), ("PATCH", "/{id}", "update", False), ("DELETE", "/{id}", "destroy", False), ("GET", "/create", "create", True), ("GET", "/{id}/edit", "edit", True))
ALIASES, GROUPS = ("$middlewareAliases", "$routeMiddleware"), "$middlewareGroups"
ROUTING, NO_ROUTES = ("api", "web", "commands"), ("routes/console.php", "routes/channels.php")
API_PREFIX, CONTROLLERS = "api", "App\\Http\\Controllers\\"


def _none() -> Column:
    return F.array().cast("array<string>")


def joined(base: Column, part: Column) -> Column:
    """A path and a segment, with one slash between them."""
    return F.concat(F.regexp_replace(base, "/$", ""), F.when(part.startswith("/"), part).otherwise(F.concat(F.lit("/"), part)))


def normal(path: Column) -> Column:
    """A path without ``.`` and ``..``; null if it leaves the project."""
    steps = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    start = F.struct(_none().alias("kept"), F.lit(False).alias("out"))
    up = lambda a: F.struct(F.slice(a["kept"], F.lit(1), F.greatest(F.size(a["kept"]) - 1, F.lit(0))).alias("kept"), (a["out"] | (F.size(a["kept"]) == 0)).alias("out"))
    end = F.aggregate(steps, start, lambda a, x: F.when(x == "..", up(a)).otherwise(F.struct(F.concat(a["kept"], F.array(x)).alias("kept"), a["out"].alias("out"))))
    return F.when(~end["out"], F.array_join(end["kept"], "/"))


def folder(path: Column) -> Column:
    return F.regexp_replace(path, "(^|/)[^/]*$", "")


def required(text: Column, path: Column) -> Column:
    """The file that an expression names: ``base_path('x')``, ``__DIR__ . '/x'`` or a plain string; null for others."""
    pick = lambda p: F.nullif(F.regexp_extract(text, p, 1), F.lit(""))
    here = pick(r"""^__DIR__\s*\.\s*['"]([^'"]+)['"]$""")
    return F.coalesce(normal(pick(r"""^base_path\(\s*['"]([^'"]+)['"]\s*\)$""")), normal(F.concat(folder(path), F.lit("/"), here)), normal(pick(r"""^['"]([^'"]+)['"]$""")))


# ---- tables beside the routes ----

def constants(s: DataFrame) -> DataFrame:
    """Constants of classes: project, class, name, value; only strings have one."""
    return s.where("kind = 'const' and form = 'string' and class is not null").select("project", "class", "name", F.col("text").alias("value")).distinct()


def items(s: DataFrame) -> DataFrame:
    """Items of arrays with plain values: project, path, owner (the array's place), ord, key, form, value, at.  Constants are looked up, alone or behind a string."""
    i = s.where("kind = 'item'").select(*FILE, "owner", "ord", F.col("base").alias("key"), "form", F.col("name").alias("value"), "text", "at")
    return _with_constants(i, constants(s))


def _with_constants(rows: DataFrame, known: DataFrame) -> DataFrame:
    said = r"^(?:'([^']*)'\s*\.\s*)?\\?(?:\w+\\)*(\w+)::(\w+)$"
    x = rows.withColumns({"class": F.regexp_extract("text", said, 2), "_name": F.regexp_extract("text", said, 3)})
    x = x.join(known.select("project", "class", F.col("name").alias("_name"), F.col("value").alias("_value")), ["project", "class", "_name"], "left")
    full = F.concat(F.regexp_extract("text", said, 1), F.coalesce("_value", F.concat_ws("::", "class", "_name")))
    return x.withColumn("value", F.when((F.col("form") == "other") & (F.col("class") != ""), full).otherwise(F.col("value"))).drop("class", "_name", "_value")


def aliases(s: DataFrame) -> DataFrame:
    """Short names of middleware, from the kernel's property or the application's start: project, alias, fqcn."""
    i = items(s)
    kernel = s.where(F.col("kind") == "property").where(F.col("name").isin(*ALIASES) & F.col("method").isNull()).select(*FILE, F.col("at").alias("owner"))
    start = s.where("kind = 'call' and name = 'alias' and form = 'member'").select(*FILE, F.get("args", F.lit(0))["at"].alias("owner"))
    return kernel.unionByName(start).join(i.where("key is not null and form in ('class', 'string')"), [*FILE, "owner"]).groupBy("project", F.col("key").alias("alias")).agg(F.max(F.struct("path", "at", "value"))["value"].alias("fqcn"))


def middleware_groups(s: DataFrame) -> DataFrame:
    """Groups of middleware: project, name, entries."""
    i = items(s)
    g = s.where((F.col("kind") == "property") & (F.col("name") == GROUPS)).select(*FILE, F.col("at").alias("owner")).join(i.where("key is not null and form = 'array'"), [*FILE, "owner"]).select(*FILE, F.col("key").alias("name"), F.col("at").alias("owner"))
    v = i.where("form in ('class', 'string')").groupBy(*FILE, "owner").agg(_ordered("ord", "value").alias("entries"))
    return g.join(v, [*FILE, "owner"], "left").select("project", "name", F.coalesce("entries", _none()).alias("entries"))


def _ordered(by: str, value: str) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(by, value))), lambda x: x[value])


def starts(s: DataFrame) -> DataFrame:
    """Route files that an application's start names: project, path, prefix (of the ``api`` file: api, or what ``apiPrefix`` says; empty for none)."""
    c = s.where("kind = 'call' and name = 'withRouting' and form = 'member'").select(*FILE, "args")
    own = F.get(F.filter("args", lambda a: a["key"] == "apiPrefix"), F.lit(0))["value"]
    x = c.withColumn("own", F.coalesce(own, F.lit(API_PREFIX))).select("project", F.col("path").alias("from"), "own", F.explode("args").alias("a")).where(F.col("a.key").isin(*ROUTING))
    x = x.select("project", required(F.regexp_replace("a.text", r"^\w+\s*:\s*", ""), F.col("from")).alias("path"), F.when(F.col("a.key") == "api", F.col("own")).otherwise("").alias("prefix"))
    return x.where(F.col("path").isNotNull() & ~F.col("path").isin(*NO_ROUTES)).groupBy("project", "path").agg(F.max("prefix").alias("prefix"))


# ---- chains ----

def chains(s: DataFrame) -> DataFrame:
    """Chains of calls on Route, one row each: project, path, at, end, prefixes, middleware, namespace, what it is (group, resource, verb), its arguments, only and but."""
    i = items(s)
    plain = i.where("form in ('class', 'string', 'other') and key is null").groupBy(*FILE, "owner").agg(_ordered("ord", "value").alias("listed"))
    c = s.where("kind = 'call' and root = 'Route'").select(*FILE, "at", "end", "name", "args")
    a = c.select(*FILE, "at", "end", "name", F.posexplode_outer("args").alias("n", "a"))
    a = a.select(*FILE, "at", "end", "name", "n", F.col("a.kind").alias("form"), F.col("a.text").alias("text"), F.col("a.value").alias("value"), F.col("a.at").alias("owner"), F.col("a.end").alias("shut"))
    a = _with_constants(a, constants(s)).join(plain, [*FILE, "owner"], "left")
    a = a.withColumn("values", F.when(F.col("form") == "array", F.coalesce("listed", _none())).when(F.col("form").isNull(), _none()).otherwise(F.array("value")))
    calls = a.groupBy(*FILE, "at", "end", "name").agg(F.flatten(_ordered("n", "values")).alias("values"), F.array_sort(F.collect_list(F.struct("n", "form", "text", "value", "owner", "shut", "values"))).alias("args"))
    # options of a group, as an array before the closure
    nested = i.where("key in ('middleware', 'prefix', 'namespace')").join(plain.withColumnRenamed("owner", "at"), [*FILE, "at"], "left")
    options = nested.groupBy(*FILE, "owner").agg(*(F.flatten(F.collect_list(F.when(F.col("key") == k, F.when(F.col("form") == "array", F.coalesce("listed", _none())).otherwise(F.array("value"))))).alias(f"_{k}") for k in ("middleware", "prefix", "namespace")))
    one = calls.groupBy(*FILE, "at").agg(F.max("end").alias("end"), F.array_sort(F.collect_list(F.struct("end", "name", "values", "args"))).alias("calls"))
    of = lambda *names: F.filter("calls", lambda x: x["name"].isin(*names))
    group, verb = F.get(F.reverse(of("group")), F.lit(0)), F.get(F.filter("calls", lambda x: F.lower(x["name"]).isin(*VERBS)), F.lit(0))
    resource = F.get(of("resource", "apiResource"), F.lit(0))
    what = F.when(F.size(of("group")) > 0, "group").when(F.size(of("resource", "apiResource")) > 0, "resource").when(verb.isNotNull(), "verb")
    one = one.withColumns({"what": what, "main": F.when(what == "group", group).when(what == "resource", resource).otherwise(verb)}).where("what is not null")
    before = lambda name: F.filter(of(name), lambda x: (F.col("what") != "group") | (x["end"] < F.col("main.end")))
    one = one.withColumn("owner", F.when(F.col("what") == "group", F.get("main.args", F.lit(0))["owner"])).join(options, [*FILE, "owner"], "left")
    lists = lambda name: F.flatten(F.transform(of(name), lambda x: x["values"]))
    return one.select(
        *FILE, "at", "end", "what", F.col("main.name").alias("name"), F.col("main.args").alias("args"),
        F.concat(F.transform(before("prefix"), lambda x: F.get(x["values"], F.lit(0))), F.coalesce("_prefix", _none())).alias("prefixes"),
        F.concat(F.flatten(F.transform(before("middleware"), lambda x: x["values"])), F.coalesce("_middleware", _none())).alias("middleware"),
        F.regexp_replace(F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.transform(before("namespace"), lambda x: F.get(x["values"], F.lit(0))), F.coalesce("_namespace", _none())), -1), r"^\\|\\$", "").alias("namespace"),
        lists("only").alias("only"), lists("except").alias("but"))


def _groups(c: DataFrame) -> DataFrame:
    """Groups with a closure: project, path, at, end of the closure's argument, and what they add."""
    last = F.filter("args", lambda a: a["form"] == "closure")
    g = c.where("what = 'group'").withColumn("_c", F.get(last, F.lit(0))).where("_c is not null")
    return g.select(*FILE, F.col("_c.owner").alias("at"), F.col("_c.shut").alias("end"), "prefixes", "middleware", "namespace")


def enclosed(points: DataFrame, c: DataFrame) -> DataFrame:
    """Points (project, path, at, end) with what the groups around them add, from the outermost in: _prefixes, _middleware, _namespace.  A file's groups are one window."""
    kept = points.columns
    shape = F.struct("at", "end", "prefixes", "middleware", "namespace")
    g = _groups(c)
    p = points.select(*FILE, "at", F.lit(1).alias("_later"), F.struct(*kept).alias("_point"), F.lit(None).cast(g.select(shape.alias("s")).schema["s"].dataType).alias("_group"))
    q = g.select(*FILE, "at", F.lit(0).alias("_later"), F.lit(None).cast(p.schema["_point"].dataType).alias("_point"), shape.alias("_group"))
    w = Window.partitionBy(*FILE).orderBy("at", "_later").rowsBetween(Window.unboundedPreceding, 0)
    x = p.unionByName(q).withColumn("_open", F.collect_list("_group").over(w)).where("_point is not null").withColumn("_open", F.filter("_open", lambda s: s["end"] >= F.col("_point.end")))
    add = lambda f: F.flatten(F.transform("_open", lambda s: s[f]))
    return x.select("_point.*", add("prefixes").alias("_prefixes"), add("middleware").alias("_middleware"), F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.filter(F.transform("_open", lambda s: s["namespace"]), lambda n: n.isNotNull())), -1).alias("_namespace"))


def _prefixed(base: Column, parts: Column) -> Column:
    return F.aggregate(parts, base, lambda a, x: joined(a, x))


def includes(s: DataFrame, c: DataFrame) -> DataFrame:
    """Files that a file includes: project, path, target, with what the groups around the statement add."""
    i = s.where("kind = 'include'").select(*FILE, "at", "end", required(F.trim("text"), F.col("path")).alias("target")).where("target is not null")
    return enclosed(i, c)


def wraps(s: DataFrame, c: DataFrame) -> DataFrame:
    """Route files that providers wrap in groups: project, path, middleware (united, in order), namespace and prefix (of the last group that has one)."""
    p = s.where("kind = 'class' and (base = 'ServiceProvider' or endswith(base, 'RouteServiceProvider') or endswith(path, 'RouteServiceProvider.php'))").select(*FILE).distinct()
    own = s.where("kind = 'property' and name = '$namespace' and form = 'string'").groupBy(*FILE).agg(F.min(F.struct("at", "text"))["text"].alias("_own"))
    g = c.where("what = 'group'").join(p, FILE, "left_semi").join(own, FILE, "left").withColumn("namespace", F.when(F.col("namespace") == "$this->namespace", F.col("_own")).otherwise(F.col("namespace")))
    last = F.element_at("args", -1)
    direct = g.withColumn("target", required(last["text"], F.col("path"))).where("target is not null")
    closed = g.withColumn("_c", last).where("_c.form = 'closure'").select(*FILE, "at", F.col("_c.owner").alias("a"), F.col("_c.shut").alias("e"), "middleware", "namespace", "prefixes")
    inner = s.where("kind = 'include'").select(*FILE, F.col("at").alias("i"), required(F.trim("text"), F.col("path")).alias("target")).where("target is not null")
    inside = closed.join(inner, FILE).where("i > a and i < e")
    pick = ["project", "target", F.col("at").alias("nth"), "middleware", "namespace", F.element_at(F.concat(F.array(F.lit(None).cast("string")), "prefixes"), -1).alias("prefix")]
    w = direct.select(*pick).unionByName(inside.select(*pick)).where("size(middleware) > 0 or namespace is not null or prefix is not null")
    of = lambda x: F.max(F.when(F.col(x).isNotNull(), F.struct("nth", x)))[x].alias(x)
    m = w.groupBy("project", F.col("target").alias("path")).agg(F.array_distinct(F.flatten(_ordered("nth", "middleware"))).alias("middleware"), of("namespace"), of("prefix"))
    groups = middleware_groups(s).select("project", F.col("name").alias("m"), "entries")
    x = m.select("project", "path", F.posexplode_outer("middleware").alias("n", "m")).join(groups, ["project", "m"], "left")
    flat = x.withColumn("e", F.when(F.col("m").isNull(), _none()).otherwise(F.coalesce("entries", F.array("m")))).groupBy("project", "path").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "e"))), lambda y: y["e"])).alias("middleware"))
    return m.drop("middleware").join(flat, ["project", "path"])


def contexts(s: DataFrame, c: DataFrame, entries: DataFrame, keep=written, most: int = 100) -> DataFrame:
    """Every way a route file is read: project, path, prefix, middleware, namespace, depth, trail.  ``entries`` (project, path) are read first; includes follow level by level until none is new."""
    w = wraps(s, c).unionByName(starts(s).select("project", "path", _none().alias("middleware"), F.lit(None).cast("string").alias("namespace"), F.nullif("prefix", F.lit("")).alias("prefix")))
    one = F.row_number().over(Window.partitionBy("project", "path").orderBy(F.desc(F.size("middleware"))))
    w = w.withColumn("_n", one).where("_n = 1").drop("_n")
    now = entries.select("project", "path").distinct().join(w, ["project", "path"], "left").select("project", "path", F.coalesce(joined(F.lit(""), F.col("prefix")), F.lit("")).alias("prefix"), F.coalesce("middleware", _none()).alias("middleware"), "namespace", F.lit(0).alias("depth"), F.array("path").alias("trail"))
    now = keep(now, "contexts-0")
    there = s.select("project", F.col("path").alias("target")).distinct()
    inner = keep(includes(s, c).join(there, ["project", "target"], "left_semi"), "includes").select("project", "path", "target", "_prefixes", "_middleware", "_namespace")
    every = now
    for depth in range(1, most):
        x = now.join(inner, ["project", "path"]).where(~F.array_contains("trail", F.col("target")))
        now = keep(x.select("project", F.col("target").alias("path"), _prefixed(F.col("prefix"), F.col("_prefixes")).alias("prefix"), F.concat("middleware", "_middleware").alias("middleware"), F.coalesce("_namespace", "namespace").alias("namespace"), F.lit(depth).alias("depth"), F.concat("trail", F.array("target")).alias("trail")), f"contexts-{depth}")
        if now.isEmpty():
            break
        every = every.unionByName(now)
    return every


def routes(s: DataFrame, c: DataFrame, ways: DataFrame, uses: DataFrame) -> DataFrame:
    """Routes under each context of their file: project, file, at, method, path, middleware, controller, action, handler (its full name), handler_file."""
    leaf = enclosed(c.where("what <> 'group'"), c).withColumnRenamed("namespace", "_inline")
    x = leaf.join(ways.select("project", "path", F.col("prefix").alias("_base"), F.col("middleware").alias("_outer"), F.col("namespace").alias("_space"), "trail"), FILE)
    first, second = F.get("args", F.lit(0)), F.get("args", F.lit(1))
    raw = F.coalesce(F.get(first["values"], F.lit(0)), F.lit("/"))
    base = joined(_prefixed(F.col("_base"), F.col("_prefixes")), raw)
    kinds = F.array(*(F.struct(F.lit(m).alias("method"), F.lit(t).alias("tail"), F.lit(a).alias("action"), F.lit(web).alias("web")) for m, t, a, web in RESOURCE))
    listed = F.filter(kinds, lambda k: (~k["web"] | (F.col("name") == "resource")) & ((F.size("only") == 0) | F.array_contains("only", k["action"])) & ~F.array_contains("but", k["action"]))
    at = F.instr(second["value"], "@")
    named = F.when(second["form"] == "array", F.struct(F.coalesce(F.get(second["values"], F.lit(0)), F.lit("UnknownController")).alias("controller"), F.coalesce(F.get(second["values"], F.lit(1)), F.lit("unknown")).alias("action")))
    named = named.when(second["form"] == "class", F.struct(second["value"].alias("controller"), F.lit("__invoke").alias("action")))
    named = named.when((second["form"] == "string") & (at > 1), F.struct(F.substring_index(second["value"], "@", 1).alias("controller"), F.coalesce(F.nullif(F.substring_index(second["value"], "@", -1), F.lit("")), F.lit("unknown")).alias("action")))
    named = named.when(second.isNull(), F.struct(F.lit("UnknownController").alias("controller"), F.lit("unknown").alias("action"))).otherwise(F.struct(F.lit("Closure").alias("controller"), F.lit("invoke").alias("action")))
    klass = F.coalesce(F.nullif(F.regexp_extract(F.regexp_replace(second["text"], r"""::class\s*$|['"]""", ""), r"([^\\/]+)$", 1), F.lit("")), F.lit("UnknownController"))
    made = F.when(F.col("what") == "verb", F.array(F.struct(F.upper("name").alias("method"), F.lit("").alias("tail"), named["action"].alias("action"), named["controller"].alias("controller")))).otherwise(F.transform(listed, lambda k: F.struct(k["method"].alias("method"), k["tail"].alias("tail"), k["action"].alias("action"), klass.alias("controller"))))
    x = x.withColumns({"r": F.explode(made), "_full": base}).select("project", F.col("path").alias("file"), "at", "trail", "r.method", F.concat("_full", "r.tail").alias("route"), F.concat("_outer", "_middleware", "middleware").alias("middleware"), "r.controller", "r.action", F.coalesce("_namespace", "_space").alias("namespace"))
    u = uses.select("project", F.col("path").alias("file"), F.col("alias").alias("controller"), F.col("fqcn").alias("_known"))
    slash = F.lit("\\")
    full = F.coalesce("_known", F.when(F.col("controller").startswith("\\"), F.ltrim("controller", slash)).when(F.col("namespace").isNotNull(), F.concat("namespace", slash, "controller")).when(F.contains("controller", slash), F.col("controller")).otherwise(F.concat(F.lit(CONTROLLERS), "controller")))
    return x.join(u, ["project", "file", "controller"], "left").select("project", "file", "at", F.array_join("trail", " > ").alias("trail"), "method", F.col("route").alias("path"), "middleware", "controller", "action", full.alias("handler"), class_path(full).alias("handler_file"))


def gates(routes_: DataFrame, known: DataFrame) -> DataFrame:
    """Middleware of routes in order, with the class an alias stands for: project, file, at, trail, method, path, nth, raw, symbol, type."""
    m = routes_.select("project", "file", "at", "trail", "method", "path", F.posexplode("middleware").alias("nth", "raw"))
    m = m.withColumn("alias", F.substring_index("raw", ":", 1)).join(known, ["project", "alias"], "left")
    k = short(F.coalesce("fqcn", F.when(F.contains("raw", F.lit("\\")), F.col("raw"))))
    by_class = F.when(k.rlike("Authenticate|Guard"), "ir:auth_gate").when(k.rlike("Permission|Role|Authorize|CheckAccess|HasRole|EnsureRole|EnsureUser"), "ir:authz_check").when(k.rlike("Throttle|RateLimit"), "rate_limiter").otherwise("ir:unknown_middleware")
    from .augment import middleware
    return m.select("project", "file", "at", "trail", "method", "path", "nth", "raw", F.coalesce(k, short(F.col("raw"))).alias("symbol"), F.when(k.isNotNull(), by_class).otherwise(middleware(F.col("raw"))[0]).alias("type"))
