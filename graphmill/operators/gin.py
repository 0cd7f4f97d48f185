"""Routes of Go projects whose routers are passed from function to function, from rows of ``sources.gosyntax``.

What a function gives back is settled first, callees before callers, by iterated joins that put a callee's ways in place of a call.
Contexts (a function, and the state of its parameters) then follow the calls from ``main``; a function isn't entered again on its own
trail.  Of functions that give back what calls of each other give, each has what is left without those calls.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.corpus import written
from ..sources.gosyntax import GATE, WAYS

ITEM = ["project", "path", "of", "at", "slot"]
STATE = f"struct<suffix:string,gates:array<{GATE.simpleString()}>>"
GIVEN = f"array<struct<key:int,state:{STATE}>>"

# fixed values
AUTH, AUTHZ = r"^(Auth|RequireAuth|JWTAuth|Authenticate)", r"^(RequireRole|RequireSystemRole|RequirePermission|RequireScope|Authorize)"
BOUND = {"json": "ctx.ShouldBindJSON", "query": "ctx.ShouldBindQuery"}  # all others are said to be ctx.ShouldBindUri
GATE_TYPES = (("ir:auth_gate", "authentication"), ("ir:authz_check", "authorization"), ("ir:unknown_middleware", "middleware"))


def located(s: DataFrame) -> DataFrame:
    """The rows with the file's path in each gate."""
    gates = lambda g: F.transform(g, lambda x: x.withField("file", F.col("path")))
    ways = lambda w: F.transform(w, lambda x: x.withField("gates", gates(x["gates"])))
    return s.withColumns({"gates": gates(F.col("gates")), "ways": ways(F.col("ways")), "args": F.transform("args", ways)})


def registry(s: DataFrame, entry: str = "main") -> DataFrame:
    """One function a name: project, name, path, of, params.  The last by path and place stands, and of those named ``entry`` the last that makes a router, or else the first."""
    f = s.where("kind = 'func'")
    last = F.max_by(F.struct("path", "of", "params"), F.struct("path", "of"))
    first = F.min_by(F.struct("path", "of", "params"), F.struct("path", "of"))
    made = F.max_by(F.struct("path", "of", "params"), F.when(F.col("form") == "engine", F.struct("path", "of")))
    g = f.groupBy("project", "name").agg(last.alias("l"), first.alias("f"), made.alias("m"), F.max(F.col("form") == "engine").alias("any"))
    x = g.withColumn("x", F.when(F.col("name") != entry, F.col("l")).when(F.col("any"), F.col("m")).otherwise(F.col("f")))
    return x.select("project", "name", "x.path", "x.of", "x.params")


def constants(s: DataFrame) -> DataFrame:
    """String constants of a project by name, the last by path and place: project, name, value."""
    return s.where("kind = 'const'").groupBy("project", "name").agg(F.max_by("text", F.struct("path", "at")).alias("value"))


def exemptions(s: DataFrame) -> DataFrame:
    """What a middleware's function lets through: project, name, method, route; of functions of one name the last one's map counts."""
    w = s.where("kind = 'func'").groupBy("project", "name").agg(F.max(F.struct("path", "of")).alias("x")).select("project", "name", "x.*")
    k = s.where("kind = 'skip'").select("project", "path", "of", F.col("name").alias("method"), F.col("text").alias("route"))
    return k.join(w, ["project", "path", "of"]).select("project", "name", "method", "route").distinct()


def _firsts(ways: Column) -> Column:
    """Ways without those that are never reached: a root that stands before, and all behind a constructor."""
    fresh = F.filter(ways, lambda x, i: ~F.exists(F.slice(ways, F.lit(1), i), lambda y: ((y["kind"] == x["kind"]) & (y["key"] == x["key"])) | (y["kind"] == "engine")))
    return fresh.cast(WAYS)


def _onto(below: Column, above: Column) -> Column:
    """A way put behind another: the root of the first, suffix and gates of both."""
    return F.struct(below["kind"].alias("kind"), below["key"].alias("key"), F.concat(below["suffix"], above["suffix"]).alias("suffix"), F.concat(below["gates"], above["gates"]).alias("gates"))


def settled(s: DataFrame, r: DataFrame, keep=written) -> DataFrame:
    """Receivers of verbs, arguments of calls and what functions give back, with ways that start at a constructor or a parameter alone: project, path, of, at, slot, ways.

    Slot is -2 for verbs, -1 for what is given back, else the argument's number."""
    own = s.join(r.select("project", "path", "of"), ["project", "path", "of"], "left_semi")
    calls = own.where("kind = 'call'").select("project", "path", "of", F.col("at").alias("key"), F.col("name").alias("callee"), "args")
    items = own.where("kind in ('verb', 'func')").select("project", "path", "of", "at", F.when(F.col("kind") == "func", -1).otherwise(-2).cast("int").alias("slot"), "ways")
    items = items.unionByName(own.where("kind = 'call'").select("project", "path", "of", "at", F.posexplode("args").alias("slot", "ways")))
    open_ = F.exists("ways", lambda w: w["kind"] == "call")
    now, n = keep(items, "ways-0"), 0
    while now.where(open_).limit(1).count():
        n += 1
        back = now.where("slot = -1").where(~open_).join(r.select("project", "path", "of", F.col("name").alias("callee")), ["project", "path", "of"]).select("project", "callee", F.col("ways").alias("back"))
        known = r.select("project", F.col("name").alias("callee"), F.lit(True).alias("there"))
        c = calls.join(known, ["project", "callee"], "left").join(back, ["project", "callee"], "left")
        x = now.where(open_).select(*ITEM, F.posexplode("ways").alias("n", "w")).withColumn("key", F.when(F.col("w.kind") == "call", F.col("w.key")))
        x = x.join(c, ["project", "path", "of", "key"], "left")
        given = lambda b: F.coalesce(F.get("args", b["key"]), F.array().cast(WAYS))
        put = F.flatten(F.transform("back", lambda b: F.when(b["kind"] == "engine", F.array(_onto(b, F.col("w")))).otherwise(F.transform(given(b), lambda g: _onto(_onto(g, b), F.col("w"))))))
        waits = F.col("key").isNotNull() & F.col("there").isNotNull() & F.col("back").isNull()
        to = F.when(F.col("key").isNull() | waits, F.array("w")).when(F.col("there").isNull(), F.array().cast(WAYS)).otherwise(put)
        x = x.select(*ITEM, "n", to.cast(WAYS).alias("to"), (F.col("key").isNotNull() & ~waits).alias("moved"))
        x = x.groupBy(*ITEM).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("n", "to"))), lambda y: y["to"])).alias("ways"), F.max("moved").alias("moved"))
        x = keep(x.withColumn("ways", _firsts(F.col("ways"))), f"moved-{n}")
        moved = x.where("moved").limit(1).count() > 0
        x = x.drop("moved")
        if not moved:  # all that is left waits for functions that wait for each other
            asked = x.where("slot = -1").select("project", "path", "of", F.explode("ways").alias("w")).where("w.kind = 'call'").withColumn("key", F.col("w.key"))
            ring = asked.join(calls, ["project", "path", "of", "key"]).join(r.withColumnRenamed("name", "callee").select("project", "callee", F.col("path").alias("p"), F.col("of").alias("o")), ["project", "callee"])
            ring = ring.select("project", F.col("p").alias("path"), F.col("o").alias("of"), F.lit(-1).alias("slot"), F.lit(True).alias("ring")).distinct()
            x = x.join(ring, ["project", "path", "of", "slot"], "left").withColumn("ways", F.when(F.col("ring"), F.filter("ways", lambda w: w["kind"] != "call")).otherwise(F.col("ways"))).select(*now.columns)
        now = keep(now.where(~open_).unionByName(x), f"ways-{n}")
    return now


def _state(ways: Column, given: Column) -> Column:
    """The first way that holds where a function's parameters have the states ``given`` (by name of place); null for none."""
    def one(w):
        p = F.get(F.filter(given, lambda g: g["key"] == w["key"]), F.lit(0))["state"]
        made = F.struct(w["suffix"].alias("suffix"), w["gates"].alias("gates")).cast(STATE)
        return F.when(w["kind"] == "engine", made).when(p.isNotNull(), F.struct(F.concat(p["suffix"], w["suffix"]).alias("suffix"), F.concat(p["gates"], w["gates"]).alias("gates")).cast(STATE))
    return F.get(F.filter(F.transform(ways, one), lambda x: x.isNotNull()), F.lit(0))


def contexts(s: DataFrame, r: DataFrame, ways: DataFrame, keep=written, entry: str = "main") -> DataFrame:
    """Every way a function is run from ``entry``: project, path, of, given (the states of its parameters), trail of names, places of the calls."""
    none = F.array().cast(GIVEN)
    calls = s.where("kind = 'call'").select("project", "path", "of", "at", F.col("name").alias("callee"), F.col("form").alias("how"))
    given = ways.where("slot >= 0").groupBy("project", "path", "of", "at").agg(F.array_sort(F.collect_list(F.struct("slot", "ways"))).alias("slots"))
    target = r.select("project", F.col("name").alias("callee"), F.col("path").alias("_path"), F.col("of").alias("_of"), F.size("params").alias("_size"))
    steps = keep(calls.join(target, ["project", "callee"]).join(given, ["project", "path", "of", "at"], "left"), "calls")
    now = keep(r.where(F.col("name") == entry).select("project", "path", "of", none.alias("given"), F.array("name").alias("trail"), F.array().cast("array<int>").alias("places")), "contexts-0")
    every, n = now, 0
    while now.limit(1).count():
        n += 1
        x = now.join(steps, ["project", "path", "of"]).where(~F.array_contains("trail", F.col("callee")))
        args = F.filter(F.transform(F.coalesce("slots", F.array().cast(f"array<struct<slot:int,ways:{WAYS.simpleString()}>>")), lambda a: F.struct(a["slot"].alias("key"), _state(a["ways"], F.col("given")).alias("state"))), lambda a: a["state"].isNotNull() & (a["key"] < F.col("_size")))
        x = x.withColumn("_given", args.cast(GIVEN)).where("how = 'assigned' or size(_given) > 0")
        now = keep(x.select("project", F.col("_path").alias("path"), F.col("_of").alias("of"), F.col("_given").alias("given"), F.concat("trail", F.array("callee")).alias("trail"), F.concat("places", F.array("at")).alias("places")), f"contexts-{n}")
        every = every.unionByName(now)
    return every


def routes(s: DataFrame, keep=written, entry: str = "main") -> DataFrame:
    """Routes in order of ``places``: project, places, file, line, method, path, handler, holder (its receiver's type), gates."""
    s = located(s)
    r = keep(registry(s, entry), "registry")
    ways = settled(s, r, keep)
    verbs = s.where("kind = 'verb'").select("project", "path", "of", "at", "line", F.col("name").alias("method"), "text", F.col("form").alias("handler"), F.get("params", F.lit(0)).alias("holder"), F.col("gates").alias("own"))
    verbs = verbs.join(ways.where("slot = -2").select("project", "path", "of", "at", "ways"), ["project", "path", "of", "at"])
    x = contexts(s, r, ways, keep, entry).join(verbs, ["project", "path", "of"]).withColumn("state", _state(F.col("ways"), F.col("given"))).where("state is not null")
    return x.select("project", F.concat("places", F.array("at")).alias("places"), F.col("path").alias("file"), "line", "method", F.concat("state.suffix", "text").alias("path"), "handler", "holder", F.concat("state.gates", "own").alias("gates"))


def gates(found: DataFrame, s: DataFrame) -> DataFrame:
    """Gates of routes: project, places, method, path, nth, type, role, symbol, args, file, line; constants have their values, and a gate of authentication goes where its function exempts the route."""
    x = found.select("project", "places", "method", "path", F.posexplode("gates").alias("nth", "g")).select("project", "places", "method", "path", "nth", "g.*")
    kind = F.when(F.col("name").rlike(AUTH), 0).when(F.col("name").rlike(AUTHZ), 1).otherwise(2)
    of = lambda k: F.get(F.array(*(F.lit(t[k]) for t in GATE_TYPES)), kind)
    x = x.withColumns({"type": of(0), "role": of(1)})
    e = exemptions(s).select("project", "name", "method", F.col("route").alias("path"), F.lit("ir:auth_gate").alias("type"))
    x = x.join(e, ["project", "name", "method", "path", "type"], "left_anti")
    a = x.select("project", "places", "nth", F.posexplode("args").alias("n", "arg")).withColumn("name", F.substring_index("arg", ".", -1)).join(constants(s), ["project", "name"], "left")
    a = a.groupBy("project", "places", "nth").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", F.coalesce("value", "arg").alias("v")))), lambda y: y["v"]).alias("args"))
    return x.drop("args", "name").withColumnRenamed("text", "symbol").join(a, ["project", "places", "nth"], "left").select("project", "places", "method", "path", "nth", "type", "role", "symbol", F.coalesce("args", F.array().cast("array<string>")).alias("args"), "file", "line")


def methods(s: DataFrame) -> DataFrame:
    """Methods by type and name, the last by path and place: project, owner, method, path, of."""
    m = s.where("kind = 'func' and owner is not null").groupBy("project", "owner", F.col("name").alias("method")).agg(F.max(F.struct("path", "of")).alias("x"))
    return m.select("project", "owner", "method", "x.*")


def structs(s: DataFrame) -> DataFrame:
    """Where a type's struct is written first: project, owner, path."""
    return s.where("kind = 'struct'").groupBy("project", "owner").agg(F.min("path").alias("path"))


def bindings(s: DataFrame) -> DataFrame:
    """What methods check of their input: project, owner, method, type (the struct), file, rules, detail.  A method's first binding counts, and the first declaration of its variable; structs without fields give none."""
    body = ["project", "path", "of"]
    b = s.where("kind = 'bind'").groupBy(*body).agg(F.min(F.struct("at", "name", "form")).alias("b")).select(*body, "b.name", "b.form")
    v = s.where("kind = 'var'").groupBy(*body, "name").agg(F.min(F.struct("at", "text"))["text"].alias("type"))
    f = s.where("kind = 'field'").join(structs(s), ["project", "owner", "path"]).groupBy("project", F.col("owner").alias("type"), F.col("path").alias("file")).agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("form") != "", F.struct("at", F.concat_ws(":", "name", "form").alias("r"))))), lambda y: y["r"]).alias("rules"))
    detail = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for p in BOUND.items() for x in p)), F.col("form")), F.lit("ctx.ShouldBindUri"))
    return methods(s).join(b, body).join(v, [*body, "name"]).join(f, ["project", "type"]).select("project", "owner", "method", "type", "file", "rules", F.concat(F.lit("bound via "), detail).alias("detail"))


def transactions(s: DataFrame) -> DataFrame:
    """Methods with a transaction, their own or else that of the first method of a field's service they call: project, owner, method, service (null for their own), file, line."""
    body = ["project", "path", "of"]
    m = methods(s)
    own = m.join(s.where("kind = 'txn'").groupBy(*body).agg(F.min("line").alias("line")), body).select("project", "owner", "method", F.col("path").alias("file"), "line")
    field = s.where("kind = 'field' and text is not null and name <> ''").join(structs(s), ["project", "owner", "path"]).groupBy("project", "owner", F.col("name").alias("field")).agg(F.max_by("text", "at").alias("service"))
    used = m.join(s.where("kind = 'used'").select(*body, "at", F.col("name").alias("called"), F.col("text").alias("field")), body)
    hop = used.join(field, ["project", "owner", "field"]).join(own.select("project", F.col("owner").alias("service"), F.col("method").alias("called"), "file", "line"), ["project", "service", "called"])
    hop = hop.groupBy("project", "owner", "method").agg(F.min(F.struct("at", F.concat_ws(".", "service", "called").alias("service"), "file", "line")).alias("h")).select("project", "owner", "method", "h.service", "h.file", "h.line")
    first = hop.join(own, ["project", "owner", "method"], "left_anti")
    return own.withColumn("service", F.lit(None).cast("string")).unionByName(first)


def nodes(found: DataFrame, s: DataFrame) -> DataFrame:
    """Nodes of routes' graphs in the order of their chain: project, places, method, path, nth, id, type, role, symbol, args, detail, file, line."""
    none, keys = F.array().cast("array<string>"), ["project", "places", "method", "path"]
    g = gates(found, s).select(*keys, F.lit(0).alias("part"), F.col("nth").alias("ord"), F.concat(F.lit("mw_"), "nth").alias("id"), "type", "role", "symbol", "args", F.lit(None).cast("string").alias("detail"), "file", "line")
    h = found.select(*keys, F.lit(2).alias("part"), F.lit(0).alias("ord"), F.lit("handler").alias("id"), F.lit("ir:business_handler").alias("type"), F.lit("handler").alias("role"), F.col("handler").alias("symbol"), none.alias("args"), F.lit(None).cast("string").alias("detail"), "file", "line")
    held = found.where("holder is not null").select(*keys, "handler", F.col("holder").alias("owner"), F.substring_index("handler", ".", -1).alias("_method"))
    on = lambda t: t.withColumnRenamed("method", "_method")
    v = held.join(on(bindings(s)), ["project", "owner", "_method"]).select(*keys, F.lit(1).alias("part"), F.lit(0).alias("ord"), F.lit("validation").alias("id"), F.lit("ir:validation_gate").alias("type"), F.lit("validation").alias("role"), F.col("type").alias("symbol"), F.col("rules").alias("args"), "detail", "file", F.lit(None).cast("int").alias("line"))
    t = held.join(on(transactions(s)), ["project", "owner", "_method"]).select(*keys, F.lit(3).alias("part"), F.lit(0).alias("ord"), F.lit("txn").alias("id"), F.lit("ir:txn_boundary").alias("type"), F.lit("transaction").alias("role"), F.coalesce("service", "handler").alias("symbol"), none.alias("args"), F.lit(None).cast("string").alias("detail"), "file", "line")
    every = g.unionByName(v).unionByName(h).unionByName(t)
    return every.withColumn("nth", F.row_number().over(Window.partitionBy("project", "places").orderBy("part", "ord")) - 1).select(*keys, "nth", "id", "type", "role", "symbol", "args", "detail", "file", "line")


def edges(chain: DataFrame) -> DataFrame:
    """Each node of a chain before the next: project, places, from, to, relation."""
    to = F.lead("id").over(Window.partitionBy("project", "places").orderBy("nth"))
    return chain.select("project", "places", F.col("id").alias("from"), to.alias("to"), F.lit("ir:precedes").alias("relation")).where("to is not null")
