"""The query language: text -> tokens -> tree -> a Column over fact rows.

    query := FIND ROUTES WHERE expr | MATCH name (-> name)* | expr
    expr  := or;  or := and (OR and)*;  and := not (AND not)*;  not := NOT not | (expr) | predicate

Keywords in any case.  A name may hold hyphens, so an arrow needs a blank before it.  Characters that start no token are
passed over.  Unknown predicates are errors at once, before any row is read.
"""
from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.facts import fact_rows
from ..sources.corpus import Corpus

KEYWORDS = {"find", "routes", "route", "where", "and", "or", "not", "match"}
_TOKEN = re.compile(r"(?P<arrow>->)|(?P<name>[A-Za-z_][\w-]*)|(?P<paren>[()])|.", re.S)


class QueryError(SyntaxError):
    pass


@dataclass(frozen=True)
class Pred:
    name: str


@dataclass(frozen=True)
class Not:
    of: object


@dataclass(frozen=True)
class Both:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Path:
    names: tuple[str, ...]


def tokens(text: str) -> list[tuple[str, str]]:
    out = []
    for m in _TOKEN.finditer(text):
        if m.lastgroup == "name" and m[0].lower() in KEYWORDS:
            word = m[0].lower()
            out.append(("routes" if word == "route" else word, m[0]))
        elif m.lastgroup:
            out.append((m[0] if m.lastgroup == "paren" else m.lastgroup, m[0]))
    return out


def parse(text: str):
    todo = tokens(text)[::-1]
    peek = lambda: todo[-1][0] if todo else "end"

    def take(kind):
        if peek() != kind:
            raise QueryError(f"expected {kind}, found {todo[-1][1] if todo else 'the end'}")
        return todo.pop()[1]

    def chain(op, below):
        left = below()
        while peek() == op:
            take(op)
            left = Both(op, left, below())
        return left

    def one():
        if peek() == "not":
            take("not")
            return Not(one())
        if peek() == "(":
            take("(")
            inside = any_of()
            take(")")
            return inside
        return Pred(take("name").lower())

    def any_of():
        return chain("or", lambda: chain("and", one))

    if peek() == "match":
        take("match")
        names = [take("name")]
        while peek() == "arrow":
            take("arrow")
            names.append(take("name"))
        tree = Path(tuple(names))
    else:
        if peek() == "find":
            for kind in ("find", "routes", "where"):
                take(kind)
        tree = any_of()
    if todo:
        raise QueryError(f"{todo[-1][1]} is left over")
    return tree


_flag: Callable[[str], Column] = F.col
#: predicates by name; a plan may add its own
PREDICATES: dict[str, Callable[[], Column]] = {}


def define(names: str, column: Callable[[], Column]) -> None:
    for name in names.split():
        PREDICATES[name] = column


define("auth authenticated", lambda: _flag("has_auth"))
define("no-auth public unauthenticated", lambda: ~_flag("has_auth"))
define("authorization policy", lambda: _flag("has_authz"))
define("no-authorization no-policy", lambda: ~_flag("has_authz"))
define("missing-authorization", lambda: _flag("has_auth") & ~_flag("has_authz"))
define("mutation write", lambda: _flag("is_mutation"))
define("readonly read", lambda: ~_flag("is_mutation"))
define("transaction", lambda: _flag("has_txn"))
define("no-transaction", lambda: ~_flag("has_txn"))
define("transaction-escape", lambda: _flag("has_escape"))
define("tenant-scoped tenant", lambda: _flag("has_tenant"))
define("unscoped unscoped-access", lambda: _flag("has_unscoped"))
define("async async-dispatch queue event", lambda: _flag("has_dispatch"))


def known_predicates() -> list[str]:
    return sorted(PREDICATES)


def compile_tree(tree) -> Column:
    match tree:
        case Pred(name):
            if name not in PREDICATES:
                raise QueryError(f"unknown predicate {name}; known: {', '.join(known_predicates())}")
            return PREDICATES[name]()
        case Not(of):
            return ~compile_tree(of)
        case Both(op, left, right):
            a, b = compile_tree(left), compile_tree(right)
            return a & b if op == "and" else a | b
    raise QueryError("a path stands alone")


def match_path(corpus: Corpus, names: tuple[str, ...]) -> DataFrame:
    """Graphs whose nodes hold the names as an ordered subsequence: a fold over each graph's nodes in order; a name matches inside type, symbol or role."""
    text = F.lower(F.concat_ws("\x1f", "type", "symbol", F.coalesce("role", F.lit(""))))
    ordered = corpus.nodes.groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct("node_ord", text.alias("text")))).alias("ns"))
    wanted = F.array(*(F.lit(n.lower()) for n in names))
    seen = F.aggregate("ns", F.lit(0), lambda k, n: F.when((k < len(names)) & n["text"].contains(F.get(wanted, k)), k + 1).otherwise(k))
    return corpus.graphs.join(ordered.where(seen == len(names)).select("graph_id"), "graph_id", "left_semi")


def query(corpus: Corpus, text: str) -> DataFrame:
    """Routes (graph_id, method, path, entrypoint) that a query names."""
    tree = parse(text)
    found = match_path(corpus, tree.names) if isinstance(tree, Path) else fact_rows(corpus).where(compile_tree(tree))
    return found.select("graph_id", "method", "path", "entrypoint")
