"""What classes declare, from rows of syntax: events and their listeners, rules of form requests, fields of API resources."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .code import FILE, class_path, imports, short

# fixed values
AFTER_COMMIT = "ShouldHandleEventsAfterCommit"
SENSITIVE = "(?i)secret|token|password|passwd|internal|admin_|_admin|private|api_key|_hash|hash_"
CONDITIONS = ("when", "whenLoaded", "whenNotNull")
NUMBERS = ("integer", "numeric")
QUEUED, QUEUE = "ShouldQueue", "default"
SCHEDULED = ("command", "job", "call", "exec")
SKIPPED = "(^|/)(node_modules|vendor|storage|bootstrap|[.]git|dist|build|coverage)/|Test[.]php$"
SAME = {"required": "required", "email": "email", "url": "url", "uuid": "uuid", "alpha": "alphanumeric", "alpha_num": "alphanumeric", "date": "date", "boolean": "boolean", "array": "array", "integer": "integer", "nullable": "optional", "sometimes": "optional"}


def listeners(s: DataFrame) -> DataFrame:
    """Listeners of events by the ``$listen`` of a project's event provider: project, event (short), ord, listener (full name), file, after_commit."""
    i = s.where("kind = 'item'")
    p = s.where("kind = 'property' and form = 'array' and contains(name, 'listen') and endswith(path, 'Providers/EventServiceProvider.php')").select(*FILE, F.col("at").alias("owner"))
    events = i.join(p, [*FILE, "owner"]).where("form = 'array' and base is not null").select(*FILE, short(F.col("base")).alias("event"), F.col("ord").alias("_nth"), F.col("at").alias("owner"))
    last = F.row_number().over(Window.partitionBy("project", "event").orderBy(F.desc("_nth")))  # of an event that is listed twice the later list holds
    events = events.withColumn("_n", last).where("_n = 1").drop("_n", "_nth")
    x = i.where("base is null and form in ('class', 'string')").join(events, [*FILE, "owner"])
    u = imports(s).select(*FILE, F.col("alias").alias("name"), F.col("fqcn").alias("_full"))
    x = x.join(u, [*FILE, "name"], "left").select("project", "event", "ord", F.when(F.col("form") == "class", F.coalesce("_full", "name")).otherwise(F.replace("name", F.lit("\\\\"), F.lit("\\"))).alias("listener"))
    named = F.exists("args", lambda a: F.contains(a["value"], F.lit(AFTER_COMMIT)))
    safe = s.where((F.col("kind") == "use") & F.contains("text", F.lit(AFTER_COMMIT)) | (F.col("kind") == "class") & named | F.col("kind").isin("property", "assign") & (F.col("name") == "$afterCommit") & (F.col("text") == "true"))
    safe = safe.select("project", F.col("path").alias("file"), F.lit(True).alias("_safe")).distinct()
    return x.withColumn("file", class_path(F.col("listener"))).join(safe, ["project", "file"], "left").select("project", "event", "ord", "listener", "file", F.coalesce("_safe", F.lit(False)).alias("after_commit"))


def event_safety(listening: DataFrame) -> DataFrame:
    """An event is as safe as its least safe listener: project, event, n_listeners, safe."""
    return listening.groupBy("project", "event").agg(F.count("*").alias("n_listeners"), F.bool_and("after_commit").alias("safe"))


def listened(escapes: DataFrame, listening: DataFrame) -> DataFrame:
    """Escaping events (graph_id, project, event) with their listeners and whether all of them wait for the commit; an event nobody listens to keeps its row."""
    x = escapes.join(listening, ["project", "event"], "left").join(event_safety(listening).select("project", "event", "safe"), ["project", "event"], "left")
    return x.select("graph_id", "project", "event", "listener", "file", "after_commit", "safe")


def field_rules(s: DataFrame) -> DataFrame:
    """Fields of form requests: project, path, class, ord, name, type, rules (kind, value); fields in pipe form stand before those in array form, which they outdo."""
    i = s.where("kind = 'item'")
    r = s.where("kind = 'return' and method = 'rules' and form = 'array'").select(*FILE, F.col("at").alias("owner"))
    fields = i.where("base is not null and method = 'rules'").join(r, [*FILE, "owner"]).withColumn("_n", F.dense_rank().over(Window.partitionBy(*FILE, "class").orderBy("owner"))).where("_n = 1")
    parts = i.where("form = 'string' and base is null").groupBy(*FILE, F.col("owner").alias("at")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "name"))), lambda x: x["name"]).alias("_listed"))
    x = fields.join(parts, [*FILE, "at"], "left").where("form in ('string', 'array')")
    piped = F.filter(F.transform(F.split("name", r"\|"), lambda p: F.trim(p)), lambda p: p != "")
    x = x.select(*FILE, "class", "ord", F.col("base").alias("name"), (F.col("form") == "array").alias("listed"), F.when(F.col("form") == "string", piped).otherwise(F.coalesce("_listed", F.array().cast("array<string>"))).alias("parts"))
    once = F.row_number().over(Window.partitionBy(*FILE, "class", "name").orderBy("listed", "ord"))
    x = x.withColumn("_n", once).where("_n = 1 or not listed").withColumn("ord", F.row_number().over(Window.partitionBy(*FILE, "class").orderBy("listed", "ord")) - 1)
    read = F.aggregate("parts", F.struct(F.lit("string").alias("type"), F.array().cast("array<struct<kind:string,value:string>>").alias("rules")), _step)
    return x.withColumn("f", read).select(*FILE, "class", "ord", "name", F.col("f.type").alias("type"), F.col("f.rules").alias("rules"))


def _rule(kind, value=None):
    return F.struct((F.lit(kind) if isinstance(kind, str) else kind).cast("string").alias("kind"), (F.lit(None) if value is None else value).cast("string").alias("value"))


def _step(state, part):
    """One rule after another: numbers before a bound make it one of the value, otherwise it is one of the length."""
    kind = F.when(part.isin(*NUMBERS), "number").when(part == "boolean", "boolean").when(part == "array", "array").otherwise(state["type"])
    number = kind == "number"
    pick = lambda p, n=1: F.regexp_extract(part, p, n)
    plain = F.try_element_at(F.create_map(*(F.lit(x) for pair in SAME.items() for x in pair)), part)
    bound, between = r"^(min|max):(\d+(?:\.\d+)?)$", r"^between:(\d+),(\d+)$"
    side = lambda name: F.when(number, name).otherwise(F.concat(F.lit(name), F.lit("Length")))
    none = F.array().cast("array<struct<kind:string,value:string>>")
    inside = F.array_join(F.transform(F.split(pick("^in:(.+)$"), ","), lambda x: F.trim(x)), ",")
    added = (F.when(plain.isNotNull(), F.array(_rule(plain))).when(part.rlike(bound), F.array(_rule(F.when(number, pick(bound)).otherwise(F.concat(pick(bound), F.lit("Length"))), pick(bound, 2))))
             .when(part.rlike("^in:.+$"), F.array(_rule("isIn", inside))).when(part.rlike("^regex:.+$"), F.array(_rule("regex", pick("^regex:(.+)$"))))
             .when(part.rlike(between), F.array(_rule(side("min"), pick(between)), _rule(side("max"), pick(between, 2)))).otherwise(none))
    return F.struct(kind.alias("type"), F.concat(state["rules"], added).alias("rules"))


def resource_fields(s: DataFrame) -> DataFrame:
    """Fields that API resources give out, by their ``toArray``, also through ``array_merge``: project, path, ord, name, sensitive."""
    inner = s.where("method = 'toArray'")
    direct = inner.where("kind = 'return' and form = 'array'").select(*FILE, F.col("at").alias("owner"))
    returns = inner.where("kind = 'return'").select(*FILE, "at")
    merged = inner.where("kind = 'call' and form = 'function' and name = 'array_merge'").join(returns, [*FILE, "at"]).select(*FILE, F.explode("args").alias("a")).where("a.kind = 'array'").select(*FILE, F.col("a.at").alias("owner"))
    x = inner.where("kind = 'item' and base is not null").join(direct.unionByName(merged), [*FILE, "owner"])
    n = F.row_number().over(Window.partitionBy(*FILE).orderBy("at")) - 1
    return x.select(*FILE, n.alias("ord"), F.col("base").alias("name"), F.col("base").rlike(SENSITIVE).alias("sensitive"))


def resource_details(s: DataFrame) -> DataFrame:
    """Conditional fields and resources inside resources: project, path, kind (conditional, nested, collection), name."""
    c = s.where("kind = 'call' and method = 'toArray'")
    first = F.get("args", F.lit(0))
    given = c.where((F.col("base") == "$this") & F.col("name").isin(*CONDITIONS) & (first["kind"] == "string")).select(*FILE, F.lit("conditional").alias("kind"), first["value"].alias("name"))
    inside = c.where(r"form = 'new' and name rlike '(Resource|Collection)$' or form = 'static' and base rlike '(Resource|Collection)$' and name in ('collection', 'make')")
    named = inside.select(*FILE, "at", F.when((F.col("form") == "static") & (F.col("name") == "collection"), "collection").otherwise("nested").alias("kind"), F.when(F.col("form") == "new", F.col("name")).otherwise(F.col("base")).alias("name"))
    return given.unionByName(named.groupBy(*FILE, "name").agg(F.min(F.struct("at", "kind"))["kind"].alias("kind")).select(*FILE, "kind", "name"))


def queued_jobs(s: DataFrame) -> DataFrame:
    """Entrypoints of queued jobs: project, path, entrypoint, method, queue, symbol; of each file the first class that is queued, tests and foreign code left out."""
    jobs = s.where((F.col("kind") == "class") & (F.col("form") == "class") & F.exists("args", lambda a: a["value"] == QUEUED) & ~F.col("path").rlike(SKIPPED))
    one = jobs.groupBy(*FILE).agg(F.min_by("name", "at").alias("class"))
    named = s.where("kind = 'property' and name = '$queue' and form = 'string' and method is null").groupBy(*FILE, "class").agg(F.min_by("text", "at").alias("queue"))
    x = one.join(named, [*FILE, "class"], "left")
    return x.select(*FILE, F.concat(F.lit("queue:"), "class").alias("entrypoint"), F.lit("QUEUE").alias("method"), F.coalesce("queue", F.lit(QUEUE)).alias("queue"), F.concat("class", F.lit("::handle")).alias("symbol"))


def schedules(s: DataFrame) -> DataFrame:
    """Entrypoints of a schedule's statements: project, path, line, entrypoint, method, cron (unknown where no frequency is named), symbol."""
    from ..sources.scan import CRON
    c = s.where("kind = 'call' and form = 'member' and method = 'schedule'")
    first = F.get("args", F.lit(0))
    head = c.where(F.col("base").rlike(r"^\$\w*schedule\w*$") & F.col("name").isin(*SCHEDULED) & (F.col("ord") >= 0))
    raw = F.regexp_replace(first["text"], r"""^['"]|['"]$""", "")
    named = F.when(first.isNull(), "unknown").when((F.col("name") == "job") & first["kind"].isin("new", "class"), first["value"]).when((F.col("name") != "job") & (first["kind"] == "string"), first["value"]).otherwise(F.when(F.col("name") == "job", first["text"]).otherwise(raw))
    known = F.try_element_at(F.create_map(*(F.lit(x) for pair in CRON.items() for x in pair)), F.col("name"))
    often = c.where(F.col("name").isin(*CRON, "cron")).withColumn("cron", F.when(F.col("name") == "cron", F.coalesce(F.when(first["kind"] == "string", first["value"]), raw, F.lit("unknown"))).otherwise(known)).select(*FILE, "at", "end", "cron")
    x = head.select(*FILE, "at", "line", F.col("end").alias("_end"), named.alias("symbol")).join(often, [*FILE, "at"], "left").where("cron is null or end > _end")
    one = x.groupBy(*FILE, "at", "line", "symbol").agg(F.coalesce(F.min_by("cron", "end"), F.lit("unknown")).alias("cron"))
    return one.select(*FILE, "line", F.concat(F.lit("schedule:"), "symbol").alias("entrypoint"), F.lit("SCHEDULE").alias("method"), "cron", "symbol")


# fixed values: decorators without arguments, those with a number, and the plain types
DECORATED = {
    "IsNotEmpty": "required", "IsOptional": "optional", "IsString": "required", "IsInt": "integer", "IsNumber": "required", "IsBoolean": "boolean", "IsEmail": "email", "IsUrl": "url", "IsUUID": "uuid", "IsArray": "array", "IsPositive": "positive", "IsNegative": "negative",
    "IsDefined": "required", "IsNotEmptyObject": "required", "IsDate": "date", "IsDateString": "date", "IsPhoneNumber": "phone", "IsEthereumAddress": "ethereumAddress", "IsAlphanumeric": "alphanumeric", "IsNumberString": "numberString", "ArrayNotEmpty": "array",
}
BOUNDED = {"Min": "min", "Max": "max", "MinLength": "minLength", "MaxLength": "maxLength", "ArrayMinSize": "arrayMinSize", "ArrayMaxSize": "arrayMaxSize"}
PLAIN_TYPES = ("string", "number", "boolean")


def _map(values: dict):
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def _number(text):
    """The number a text begins with; null for none."""
    return F.nullif(F.regexp_extract(text, r"^\s*([-+]?(?:\d+(?:\.\d+)?|\.\d+))", 1), F.lit(""))


def _decorator(d):
    """Rules of one decorator."""
    none = F.array().cast("array<struct<kind:string,value:string>>")
    plain, bound = F.try_element_at(_map(DECORATED), d["name"]), F.try_element_at(_map(BOUNDED), d["name"])
    n, a, b = _number(d["args"]), _number(d["args"]), _number(F.get(F.split(d["args"], ","), F.lit(1)))
    sides = F.filter(F.array(_rule("minLength", a), _rule("maxLength", b)), lambda r: r["value"].isNotNull())
    return (F.when(plain.isNotNull(), F.array(_rule(plain))).when(bound.isNotNull() & n.isNotNull(), F.array(_rule(bound, n))).when(d["name"] == "Length", sides)
            .when((d["name"] == "IsEnum") & (F.trim(d["args"]) != ""), F.array(_rule("enum", F.trim(d["args"]))))
            .when(d["name"] == "IsIn", F.array(_rule("isIn", F.array_join(d["listed"], ","))))
            .when((d["name"] == "Matches") & d["args"].rlike("^/.+/[gimsuy]*$"), F.array(_rule("regex", d["args"]))).otherwise(none))


def decorated_rules(fields: DataFrame) -> DataFrame:
    """Rows of ``sources.decorated`` as ``field_rules`` gives them: project, path, class, ord, name, type, rules.  A field that says neither is required."""
    rules = F.flatten(F.transform("decorators", _decorator))
    said = F.exists("_rules", lambda r: r["kind"].isin("required", "optional"))
    t = F.regexp_replace(F.lower("written"), r"\s", "")
    bare = F.regexp_replace(t, r"^null\||\|null$", "")
    kind = F.when(bare.isin(*PLAIN_TYPES), bare).when(t.endswith("[]") | t.startswith("array<"), "array").when((t == "object") | t.startswith("record<"), "object").otherwise("unknown")
    x = fields.withColumn("_rules", rules).withColumn("rules", F.when(said, F.col("_rules")).otherwise(F.concat(F.array(_rule("required")), "_rules")))
    return x.select(*FILE, "class", "ord", "name", kind.alias("type"), "rules")


def rules_apart(a: DataFrame, b: DataFrame) -> DataFrame:
    """Fields whose rules differ between two tables of rules, matched by project, subject (the class without its suffix) and name: project, subject, name, only_a, only_b (texts of rules, sorted); a field on one side alone is told apart by all its rules."""
    subject = F.regexp_replace("class", "(Request|Dto|DTO)$", "")
    text = F.array_sort(F.array_distinct(F.transform("rules", lambda r: F.concat_ws(":", r["kind"], r["value"]))))
    side = lambda t, n: t.groupBy("project", subject.alias("subject"), "name").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(text)))).alias(n))
    none = F.array().cast("array<string>")
    x = side(a, "a").join(side(b, "b"), ["project", "subject", "name"], "full")
    less = lambda p, q: F.array_except(F.coalesce(p, none), F.coalesce(q, none))
    x = x.select("project", "subject", "name", less(F.col("a"), F.col("b")).alias("only_a"), less(F.col("b"), F.col("a")).alias("only_b"))
    return x.where("size(only_a) + size(only_b) > 0")
