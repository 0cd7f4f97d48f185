"""Routes of web projects from their source text: one nested graph a route (``schema.GRAPH``), by framework.

Files are rows (project, path, content); each is read by itself, in Arrow batches, so a project of any size spreads over the
cluster.  The readers follow calls, groups, decorators and annotations as they are written in one file; what needs another file (traits, base
classes, route files that include others, values of constants) isn't resolved.
"""
from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema
from ..operators.code import dispatch_kind  # noqa: F401: it belongs to what files say, too

#: framework -> reader of one file's text, giving (method, path, [(type, symbol, args)], handler)
ADAPTERS: dict[str, Callable[[str], Iterator[tuple]]] = {}

# fixed values: actions of a resource's routes, and how often named schedules run
RESOURCE = (("index", "GET", ""), ("create", "GET", "/create"), ("store", "POST", ""), ("show", "GET", "/{id}"), ("edit", "GET", "/{id}/edit"), ("update", "PUT", "/{id}"), ("update", "PATCH", "/{id}"), ("destroy", "DELETE", "/{id}"))
CHECKS = ("PreAuthorize", "Secured", "RolesAllowed")
UNKNOWN_CHECKS = ("PreAuth", "RequiresRoles", "RequiresPermissions", "RequiresUser", "RequiresAuthentication", "RequireLogin", "CheckPermission")
CRON = {
    "everyMinute": "* * * * *", "everyTwoMinutes": "*/2 * * * *", "everyThreeMinutes": "*/3 * * * *", "everyFourMinutes": "*/4 * * * *", "everyFiveMinutes": "*/5 * * * *", "everyTenMinutes": "*/10 * * * *", "everyFifteenMinutes": "*/15 * * * *",
    "everyThirtyMinutes": "0,30 * * * *", "hourly": "0 * * * *", "daily": "0 0 * * *", "weekly": "0 0 * * 0", "monthly": "0 0 1 * *", "quarterly": "0 0 1 1,4,7,10 *", "yearly": "0 0 1 1 *", "weekdays": "* * * * 1-5", "weekends": "* * * * 0,6",
    "sundays": "* * * * 0", "mondays": "* * * * 1", "tuesdays": "* * * * 2", "wednesdays": "* * * * 3", "thursdays": "* * * * 4", "fridays": "* * * * 5", "saturdays": "* * * * 6",
}


def adapter(name: str):
    def put(f):
        ADAPTERS[name] = f
        return f
    return put


def closing(text: str, at: int) -> int:
    """The place of the bracket that closes the one at ``at``; strings are passed over; the text's end if there is none."""
    pairs, depth, quote = {"(": ")", "[": "]", "{": "}"}, 0, ""
    for i in range(at, len(text)):
        c = text[i]
        if quote:
            quote = "" if c == quote and text[i - 1] != "\\" else quote
        elif c in "'\"`":
            quote = c
        elif c in pairs:
            depth += 1
        elif c in pairs.values():
            depth -= 1
            if not depth:
                return i
    return len(text)


def strings(text: str) -> list[str]:
    return [a or b for a, b in re.findall(r"'([^']*)'|\"([^\"]*)\"", text)]


def comments_out(text: str, marks: str = "//") -> str:
    text = re.sub(r"/\*.*?\*/", "", text, flags=re.S)
    return re.sub(rf"(^|[\s;{{}}(,]){marks}[^\n]*", r"\1", text)


def calls(text: str, at: int) -> tuple[list[tuple[str, str]], int]:
    """The chain of calls that starts at ``at``: [(name, arguments)], and where it ends."""
    out = []
    while m := re.compile(r"\s*(?:->|::|\.)?\s*(\w+)\s*\(").match(text, at):
        end = closing(text, m.end() - 1)
        out.append((m[1], text[m.end():end]))
        at = end + 1
        if not re.compile(r"\s*(->|\.)").match(text, at):
            break
    return out, at


def joined(*parts: str) -> str:
    return "/" + "/".join(p.strip("/") for p in parts if p and p.strip("/"))


def gate(name: str) -> tuple[str, str, list[str]]:
    """A middleware's or guard's node: by its name, what follows a colon as arguments."""
    symbol, _, args = name.partition(":")
    low = symbol.lower().rsplit("\\", 1)[-1]
    if "throttle" in low or "ratelimit" in low:
        kind = "rate_limiter"
    elif re.search(r"^(can|permission|role|ability|scope)s?$|permission|policy|roles?guard|authoriz", low):
        kind = "ir:authz_check"
    elif re.search(r"auth|jwt|sanctum|passport|token|session|login", low):
        kind = "ir:auth_gate"
    else:
        kind = "ir:unknown_middleware"
    return kind, symbol, [a.strip() for a in args.split(",") if a.strip()]


@adapter("laravel")
def laravel(text: str, prefix: str = "", around: tuple = ()) -> Iterator[tuple]:
    """``Route::`` chains: verbs, match, any, resource and apiResource with only and except, groups with prefix, middleware and controller."""
    text = comments_out(text) if not prefix and not around else text
    at = 0
    while m := re.compile(r"\bRoute::").search(text, at):
        chain, at = calls(text, m.end())
        named = {}
        for name, args in chain:
            named.setdefault(name, args)
        own = [*around, *(s for name, args in chain if name == "middleware" for s in strings(args))]
        here = joined(prefix, *strings(named.get("prefix", "''"))[:1])
        if "group" in named:
            body = named["group"]
            brace = body.find("{")
            klass = re.search(r"(\w+)::class", named.get("controller", ""))
            inner = body[brace + 1:closing(body, brace)] if brace >= 0 else ""
            for method, path, gates, handler in laravel(inner, here, tuple(own)):
                yield method, path, gates, f"{klass[1]}::{handler}" if klass and handler and "::" not in handler else handler
            continue
        for name, args in chain:
            verb = name.lower()
            said = strings(args)
            if verb in ("get", "post", "put", "patch", "delete", "options", "any", "match"):
                methods = [verb.upper()]
                if verb == "match":
                    methods, said = [x.upper() for x in strings(args[:closing(args, args.find("[")) + 1])], strings(args[closing(args, args.find("[")) + 1:])
                klass = re.search(r"(\w+)::class", args)
                action = said[1] if len(said) > 1 else ("__invoke" if klass else "")
                handler = f"{klass[1]}::{action}" if klass else action.replace("@", "::")
                for method in ("GET", "POST", "PUT", "PATCH", "DELETE") if verb == "any" else methods:
                    yield method, joined(here, said[0] if said else ""), [gate(x) for x in own], handler
                break
            if verb in ("resource", "apiresource"):
                klass = re.search(r"(\w+)::class", args)
                only, but = strings(named.get("only", "")), strings(named.get("except", ""))
                for action, method, tail in RESOURCE:
                    if not (verb == "apiresource" and action in ("create", "edit")) and (not only or action in only) and action not in but:
                        yield method, joined(here, said[0] if said else "", tail), [gate(x) for x in own], f"{klass[1]}::{action}" if klass else action
                break


def _guards(text: str) -> list[str]:
    return [g for args in re.findall(r"@(?:UseGuards|Roles|Permissions)\(([^)]*)\)", text) for g in re.findall(r"\w+", args)]


@adapter("nestjs")
def nestjs(text: str) -> Iterator[tuple]:
    """Classes with ``@Controller`` and methods with a verb; guards of class and method; ``@Public`` takes the class's away."""
    text = comments_out(text)
    for m in re.finditer(r"((?:@\w+\([^)]*\)\s*)*)@Controller\(([^)]*)\)((?:\s*@\w+\([^)]*\))*)\s*(?:export\s+)?(?:default\s+)?class\s+(\w+)[^{]*\{", text):
        body = text[m.end():closing(text, m.end() - 1)]
        base, outer = (strings(m[2]) or [""])[0], _guards(m[1] + m[3])
        for r in re.finditer(r"((?:@\w+\([^)]*\)\s*)*?)@(Get|Post|Put|Patch|Delete)\(([^)]*)\)((?:\s*@\w+\([^)]*\))*)\s*(?:public\s+|private\s+)?(?:async\s+)?(\w+)\s*\(", body):
            said = r[1] + r[4]
            guards = _guards(said) if re.search(r"@Public\(", said) else [*outer, *_guards(said)]
            yield r[2].upper(), joined(base, *(strings(r[3])[:1])), [gate(g) for g in guards], f"{m[4]}::{r[5]}"


def _security(text: str) -> list[tuple[str, str, list[str]]]:
    """Security annotations with their words: those that ask for a login alone are gates, those of other frameworks aren't known."""
    out = []
    for name, args in re.findall(r"@(\w+)(?:\s*\(((?:[^()\"]|\"[^\"]*\"|\([^)]*\))*)\))?", text):
        said = re.findall(r'"([^"]*)"', args)
        if name in CHECKS:
            login = name == "PreAuthorize" and said and re.fullmatch(r"\s*(isAuthenticated\(\)|!isAnonymous\(\))\s*", said[0])
            out.append(("ir:auth_gate" if login else "ir:authz_check", name, said))
        elif name in UNKNOWN_CHECKS:
            out.append(("ir:unknown_middleware", name, said))
    return out


def implied(gates: list[tuple[str, str, list[str]]], framework: str) -> list[tuple[str, str, list[str]]]:
    """Gates with those that they imply: a check of Spring's asks for a login first."""
    login = ("ir:auth_gate", "isAuthenticated()", [])
    return [x for g in gates for x in ([login, g] if framework == "springboot" and g[0] == "ir:authz_check" else [g])]


@adapter("springboot")
def springboot(text: str) -> Iterator[tuple]:
    """Controllers' mapping annotations; security annotations of class and method as checks with their words."""
    text = comments_out(text)
    note = r"@\w+(?:\s*\((?:[^()\"]|\"[^\"]*\"|\([^)]*\))*\))?"
    m = re.search(rf"((?:{note}\s*)*)(?:public\s+)?class\s+(\w+)", text)
    if not m or not re.search(r"@(Rest)?Controller\b", m[1]):
        return
    base = re.search(r"@RequestMapping\s*\(([^)]*)\)", m[1])
    prefix = (strings(base[1]) or [""])[0] if base else ""
    for r in re.finditer(rf"((?:{note}\s*)+)(?:public|protected|private)?\s*[\w<>\[\], ?]+\s+(\w+)\s*\(", text[m.end():]):
        v = re.search(r"@(Get|Post|Put|Patch|Delete)Mapping\s*(?:\(([^)]*)\))?", r[1])
        if v:
            yield v[1].upper(), joined(prefix, *(strings(v[2] or "")[:1])), [*_security(m[1]), *_security(r[1])], f"{m[2]}::{r[2]}"


@adapter("go")
def gin(text: str) -> Iterator[tuple]:
    """Gin routers: verbs on a router or a group; middleware of ``Use``, of groups and of a route, in the order it is written."""
    text = comments_out(text)
    groups: dict[str, tuple[str, list[str]]] = {}
    for m in re.finditer(r"(?:(\w+)\s*:?=\s*)?(\w+)\.(Group|Use|GET|POST|PUT|PATCH|DELETE)\(", text):
        args = text[m.end():closing(text, m.end() - 1)]
        rest = [re.sub(r"\(.*$", "", a.strip(), flags=re.S) for a in re.split(r",(?![^(]*\))", args) if a.strip()]
        base, around = groups.get(m[2], ("", []))
        if m[3] == "Use":
            groups[m[2]] = base, [*around, *rest]
        elif m[3] == "Group" and m[1]:
            groups[m[1]] = joined(base, *(strings(args)[:1])), [*around, *rest[1:]]
        elif m[3] not in ("Group", "Use") and len(rest) > 1:
            yield m[3], re.sub(r":(\w+)", r"{\1}", joined(base, *(strings(args)[:1]))), [gate(g) for g in [*around, *rest[1:-1]]], rest[-1].replace(".", "::")


def graph(found: tuple, framework: str, path: str) -> dict:
    """A route as a nested graph: gates in order, the handler, and the chain through them."""
    method, route, gates, handler = found
    every = [*implied(gates, framework), ("ir:business_handler", handler or "closure", [])]
    nodes = [{"id": f"n{k}", "type": kind, "symbol": symbol, "file": path, "role": None, "detail": None, "line": None, "args": args, "mutates": False} for k, (kind, symbol, args) in enumerate(every)]
    edges = [{"from": f"n{k}", "to": f"n{k + 1}", "relation": "next_middleware", "traceability": None, "mechanism": None, "side_effect": None} for k in range(len(every) - 1)]
    return {"entrypoint": f"{method} {route}", "method": method, "path": route, "framework": framework, "nodes": nodes, "edges": edges, "annotations": []}


def routes(files: DataFrame, framework: str) -> DataFrame:
    """Files (path, content) -> graph_id and the columns of ``schema.GRAPH``; ids follow from path and place, so reruns agree. Files without routes, or null, give none."""
    read = ADAPTERS[framework]
    shape = T.StructType([T.StructField("graph_id", T.LongType()), *schema.GRAPH.fields])
    names = [f.name for f in shape]

    def run(frames):
        import xxhash
        for frame in frames:
            out = []
            for path, text in zip(frame["path"], frame["content"]):
                for k, found in enumerate(read(text or "")):
                    out.append({"graph_id": xxhash.xxh3_64_intdigest(f"{path}#{k}") >> 1, **graph(found, framework, path)})
            yield pd.DataFrame(out, columns=names)

    return files.select("path", "content").mapInPandas(run, shape)


def read_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, content, key) of the files under a root; key is a hash of the content."""
    f = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", True).format("binaryFile").load(root)
    return f.select("path", F.col("content").cast("string").alias("content"), F.sha2("content", 256).alias("key"))


def changed(files: DataFrame, seen: DataFrame) -> DataFrame:
    """Files whose path and content (key) weren't seen: what must be read again."""
    return files.join(seen.select("path", "key"), ["path", "key"], "left_anti")


def schedules(files: DataFrame) -> DataFrame:
    """path, symbol, cron of scheduled commands and jobs: ``command('x')`` or ``job(new X)`` with a named frequency or its own cron expression."""
    text = r"->(?:command|job)\(\s*(?:'([^']+)'|new\s+(\w+))[^;]*?->(\w+)\((?:'([^']*)')?"
    pick = lambda k: F.regexp_extract_all("content", F.lit(text), F.lit(k))
    x = files.select("path", F.explode(F.arrays_zip(pick(1).alias("a"), pick(2).alias("b"), pick(3).alias("f"), pick(4).alias("c"))).alias("x"))
    named = F.try_element_at(F.create_map(*(F.lit(v) for pair in CRON.items() for v in pair)), F.col("x.f"))
    return x.select("path", F.coalesce(F.nullif("x.a", F.lit("")), F.col("x.b")).alias("symbol"), F.when(F.col("x.f") == "cron", F.col("x.c")).otherwise(named).alias("cron")).where("cron is not null")
