"""Statistics of a corpus of source files: classes by category, and which files dispatch, return or ask for what.

Names are found through an index of the words that stand at such places, joined by equality; a word counts for every name it begins with or
ends in, as a search for the text would, so its prefixes or suffixes are joined.  No file is searched for each name.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values
CATEGORIES = (
    ("queue_job", "Jobs"), ("event_listener", "Listeners"), ("event_dispatch", "Events"), ("api_resource", "Http/Resources"), ("notification", "Notifications"), ("mail", "Mail"), ("policy", "Policies"),
    ("scheduled_command", "Console/Commands"), ("middleware", "Http/Middleware"), ("controller", "Http/Controllers"), ("service", "Services"), ("service", "Actions"), ("observer", "Observers"), ("action", "Actions"),
)
CALLERS = (("Http/Controllers", "controller"), ("Listeners", "listener"), ("Services", "service"), ("Actions", "action"), ("Console", "command"), ("Jobs", "job"), ("Observers", "observer"))
FOLDER = "app/"


def _class_name() -> Column:
    declared = F.regexp_extract("content", r"(?m)^class\s+(\w+)", 1)
    return F.when(declared != "", declared).otherwise(F.replace(F.regexp_extract("path", r"([^/]*)$", 1), F.lit(".php")))


def classes(files: DataFrame) -> DataFrame:
    """Classes by category of their folder: project, path, category, class, fqcn; a folder may count for two categories. Files (project, path, content)."""
    f = files.where("content is not null and endswith(path, '.php')").withColumns({"class": _class_name(), "_space": F.regexp_extract("content", r"(?m)^namespace\s+([\w\\]+)", 1)})
    rows = F.array(*(F.when(F.startswith("path", F.lit(f"{FOLDER}{d}/")), c) for c, d in CATEGORIES))
    return f.select("project", "path", F.explode(F.array_distinct(F.array_compact(rows))).alias("category"), "class", F.when(F.col("_space") != "", F.concat("_space", F.lit("\\"), "class")).otherwise(F.col("class")).alias("fqcn"))


def caller_kind(path: Column) -> Column:
    out = F.lit("other")
    for part, kind in reversed(CALLERS):
        out = F.when(F.contains(path, F.lit(part)), kind).otherwise(out)
    return out


def usage(files: DataFrame) -> DataFrame:
    """Who uses which job, event or resource: project, path, caller, source, category, name, chained (a job in a chain only)."""
    f = files.where(f"content is not null and startswith(path, '{FOLDER}') and endswith(path, '.php')").withColumns({"caller": _class_name(), "source": caller_kind(F.col("path")), "_chain": F.contains("content", F.lit("chain("))})
    said = lambda p: F.array_distinct(F.regexp_extract_all("content", F.lit(p), F.lit(1)))
    begins, ends, whole = (lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda n: F.substr(w, F.lit(1), n))), (lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda n: F.substr(w, n))), (lambda w: F.array(w))
    places = (  # category, pattern, names that a word counts for, only with chain(
        ("queue_job", r"dispatch\(new (\w+)", begins, False), ("queue_job", r"(\w+)::dispatch\(", ends, False), ("queue_job", r"new (\w+)", begins, True),
        ("event_dispatch", r"event\(new (\w+)", begins, False), ("event_dispatch", r"(\w+)::dispatch\(", ends, False), ("api_resource", r"new (\w+)\(", whole, False), ("api_resource", r"(\w+)::collection\(", ends, False),
    )
    entry = lambda c, p, names, chain: F.transform(F.array_distinct(F.flatten(F.transform(said(p), names))), lambda n: F.struct(F.lit(c).alias("category"), n.alias("name"), F.lit(chain).alias("chained")))
    marks = F.concat(*(F.when(~F.lit(x[3]) | F.col("_chain"), entry(*x)).otherwise(F.array().cast("array<struct<category:string,name:string,chained:boolean>>")) for x in places))
    m = f.select("project", "path", "caller", "source", F.explode(marks).alias("m")).select("project", "path", "caller", "source", "m.*")
    known = classes(files).where("category in ('queue_job', 'event_dispatch', 'api_resource')").select("project", "category", F.col("class").alias("name")).distinct()
    return m.join(known, ["project", "category", "name"], "left_semi").groupBy("project", "path", "caller", "source", "category", "name").agg(F.bool_and("chained").alias("chained"))


def gate_calls(files: DataFrame) -> DataFrame:
    """Calls of the gate: project, path, caller, source, method, ability, in order, repeats included."""
    p = r"""Gate::(allows|denies|authorize|check)\s*\(\s*['"]([^'"]+)['"]"""
    pick = lambda k: F.regexp_extract_all("content", F.lit(p), F.lit(k))
    f = files.where(f"startswith(path, '{FOLDER}') and endswith(path, '.php')")
    return f.select("project", "path", _class_name().alias("caller"), caller_kind(F.col("path")).alias("source"), F.explode(F.arrays_zip(pick(1).alias("method"), pick(2).alias("ability"))).alias("x")).select("project", "path", "caller", "source", "x.method", "x.ability")


def summary(files: DataFrame) -> DataFrame:
    """A project's classes and uses by category: project, category, n_classes, n_used, n_uses."""
    c, u = classes(files), usage(files)
    used = u.groupBy("project", "category").agg(F.count_distinct("name").alias("n_used"), F.count("*").alias("n_uses"))
    n = c.groupBy("project", "category").agg(F.count("*").alias("n_classes")).join(used, ["project", "category"], "left")
    return n.select("project", "category", "n_classes", F.coalesce("n_used", F.lit(0)).alias("n_used"), F.coalesce("n_uses", F.lit(0)).alias("n_uses"))
