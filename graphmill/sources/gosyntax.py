"""Go source text as rows of syntax: functions, their steps in order, constants, fields of structs, keys of maps, and what methods' bodies call.

A step's receiver is followed within its own function: where its state may come from (a parameter, a constructor, what a call returns) and
what is added on the way, first choice first.  What another function gives or takes is left to joins (``operators.gin``).
"""
from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .syntax import Reader, rows

TOKEN = re.compile(r"""
 (?P<skip>\s+|//[^\n]*|/\*.*?\*/)
|(?P<s>"(?:[^"\\\n]|\\.)*"|`[^`]*`)
|(?P<r>'(?:[^'\\\n]|\\.)+')
|(?P<n>[^\W\d]\w*)
|(?P<d>\d[\w.]*)
|(?P<o>:=|==|!=|<=|>=|&&|\|\||<-|\+\+|--|\.\.\.|.)""", re.S | re.X)
CONTROL = {"if", "for", "switch", "select", "go", "defer", "var", "const", "type", "func", "break", "continue", "goto", "fallthrough"}

# fixed values
VERBS = ("GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS")
ENGINES = ("gin.Default", "gin.New")
METHODS = {"http.MethodGet": "GET", "http.MethodPost": "POST", "http.MethodPut": "PUT", "http.MethodPatch": "PATCH", "http.MethodDelete": "DELETE", "http.MethodHead": "HEAD", "http.MethodOptions": "OPTIONS"}
BINDS = {"ShouldBindJSON": "json", "ShouldBindQuery": "query", "ShouldBindUri": "uri", "ShouldBind": "body", "BindJSON": "json"}

GATE = T.StructType([T.StructField("text", T.StringType()), T.StructField("name", T.StringType()), T.StructField("args", T.ArrayType(T.StringType())), T.StructField("file", T.StringType()), T.StructField("line", T.IntegerType())])
WAYS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("key", T.IntegerType()), T.StructField("suffix", T.StringType()), T.StructField("gates", T.ArrayType(GATE))]))
GO = T.StructType([
    *(T.StructField(n, T.StringType()) for n in ("project", "path", "kind", "fn", "owner")),  # fn, owner: the function that holds the row, and its receiver's type
    *(T.StructField(n, T.IntegerType()) for n in ("of", "at", "line")),  # of: where that function starts
    *(T.StructField(n, T.StringType()) for n in ("name", "text", "form")),
    T.StructField("params", T.ArrayType(T.StringType())), T.StructField("ways", WAYS), T.StructField("args", T.ArrayType(WAYS)), T.StructField("gates", T.ArrayType(GATE)),
])


class GoReader(Reader):
    """A Go file's rows; ``path`` is filled in by joins, so gates carry no file of their own here."""

    pattern = TOKEN

    def __init__(self, text: str):
        super().__init__(text)
        self.opens = {shut: o for o, shut in self.close.items()}

    def read(self) -> list[dict]:
        at = 0
        while at < len(self.words):
            w = self.words[at]
            if w == "func" and self.line(at) != self.line(at - 1) if at else w == "func":
                at = self.function(at)
                continue
            at += 1
        for i, w in enumerate(self.words):
            if w in ("const", "type") and self.kind(i) == "n":
                group = self.word(i + 1) == "("
                for a, b in self.statements(i + 2, self.close[i + 1]) if group else [next(self.statements(i + 1, len(self.words)), (i, i))]:
                    self.constant(a, b) if w == "const" else self.struct(a, b)
        return self.rows

    def put(self, kind: str, i: int, **more) -> None:
        self.rows.append({"kind": kind, "at": self.start(i), "line": self.line(i), **more})

    # ---- pieces ----

    def statements(self, i: int, j: int) -> Iterator[tuple[int, int]]:
        """Token ranges of statements: they end at a semicolon, or with a line whose last token can end one."""
        at = k = i
        while k < j:
            last = self.close[k] if k in self.close else k
            if self.word(k) == ";":
                if k > at:
                    yield at, k
                at = k = k + 1
                continue
            k = last + 1
            ends = self.kind(last) in ("n", "d", "s", "r") or self.word(last) in (")", "]", "}", "++", "--")
            if ends and k < j and self.line(k) > self.line(last) + self.text.count("\n", self.start(last), self.until(last + 1)):
                yield at, k
                at = k
        if at < j:
            yield at, j

    def call(self, i: int, j: int) -> tuple[str | None, str, list[tuple[int, int]]] | None:
        """Receiver, name and arguments of the call that stands from i to j; null for anything else."""
        o = self.opens.get(j - 1)
        if o is None or o <= i or self.word(o) != "(" or self.kind(o - 1) != "n":
            return None
        k = i
        while k < o:
            if self.kind(k) != "n" and self.word(k) != "." and not (k > i and k in self.close):
                return None
            k = self.close.get(k, k) + 1
        if o - 1 > i and self.word(o - 2) != "." or self.word(i) == "func":
            return None
        return (self.slice(i, o - 2) if o - 1 > i else None), self.word(o - 1), list(self.parts(o + 1, j - 1))

    def literal(self, i: int, j: int) -> str | None:
        return self.word(i)[1:-1] if j == i + 1 and self.kind(i) == "s" else None

    def bare(self, i: int, j: int) -> str | None:
        """A type's own name: pointers and package left out; null for slices, maps and the like."""
        while i < j and self.word(i) == "*":
            i += 1
        if j - i == 1 and self.kind(i) == "n":
            return self.word(i)
        return self.word(i + 2) if j - i == 3 and self.word(i + 1) == "." else None

    def params(self, i: int, j: int) -> list[tuple[str, str | None]]:
        """(name, bare type) of parameters; those that share a type have the one that follows; without names there are none."""
        said = list(self.parts(i, j))
        if not any(b - a > 1 and self.kind(a) == "n" and self.word(a + 1) != "." for a, b in said):
            return []
        out, kind = [], None
        for a, b in reversed(said):
            kind = self.bare(a + 1, b) if b - a > 1 else kind
            out.append((self.word(a), kind))
        return out[::-1]

    def gate(self, i: int, j: int) -> list[dict]:
        found = self.call(i, j)
        return [{"text": self.slice(i, j), "name": found[1], "args": [self.slice(a, b) for a, b in found[2]], "file": None, "line": self.line(i)}] if found else []

    # ---- what is read ----

    def constant(self, i: int, j: int) -> None:
        eq = next((k for k in range(i, j) if self.word(k) == "="), None)
        if eq is not None:
            a, b = next(self.parts(eq + 1, j), (eq, eq))
            value = self.literal(a, b)
            if value is not None:
                self.put("const", i, name=self.word(i), text=value)

    def struct(self, i: int, j: int) -> None:
        if self.word(i + 1) != "struct" or self.word(i + 2) != "{":
            return
        self.put("struct", i, owner=self.word(i))
        for a, b in self.statements(i + 3, self.close[i + 2]):
            tag = self.word(b - 1) if self.kind(b - 1) == "s" else ""
            end, k = b - 1 if tag else b, a + 1
            while self.word(k) == ",":  # names that share a type
                k += 2
            named = self.kind(a) == "n" and end > k and self.word(k) != "."
            binding = re.search(r'binding:"([^"]*)"', tag.strip("`"))
            self.put("field", a, owner=self.word(i), name=self.word(a) if named else "", text=self.bare(k if named else a, end), form=binding and binding[1])

    def function(self, i: int) -> int:
        """A function's rows; returns the token behind it."""
        name, owner = i + 1, None
        if self.word(name) == "(":
            taken = self.params(name + 1, self.close[name])
            owner = taken[0][1] if taken else self.bare(name + 1, self.close[name])
            name = self.close[name] + 1
        p = name + 1
        if self.word(p) == "[":
            p = self.close[p] + 1
        if self.kind(name) != "n" or self.word(p) != "(":
            return i + 1
        params = self.params(p + 1, self.close[p])
        body, line = self.close[p] + 1, self.line(self.close[p])
        if self.word(body) == "(":
            body = self.close[body] + 1
        while body < len(self.words) and self.word(body) != "{" and self.line(body) == line:
            body = body + 2 if self.word(body) in ("interface", "struct") else body + 1
        if self.word(body) != "{":
            return body
        end, mark = self.close[body], len(self.rows)
        state = {n: [{"kind": "param", "key": k, "suffix": "", "gates": []}] for k, (n, _) in enumerate(params) if n != "_"}
        self.steps(body + 1, end, state, dict(params))
        tops = list(self.statements(body + 1, end))
        back = [w for a, b in tops if self.word(a) == "return" and b == a + 2 for w in state.get(self.word(a + 1), [])]
        engine = any(self.made(a, b) for a, b in tops)
        self.put("func", i, name=self.word(name), form="engine" if engine else None, params=[n for n, _ in params], ways=back)
        self.inside(body + 1, end, owner)
        for r in self.rows[mark:]:
            r.update(fn=self.word(name), owner=owner, of=self.start(i))
        return end + 1

    def assigned(self, i: int, j: int) -> tuple[str, int, int] | None:
        """Target and value of an assignment: the first of each side."""
        k = i
        while k < j and self.word(k) not in (":=", "="):
            k = self.close.get(k, k) + 1
        if k >= j or k == i:
            return None
        left, right = next(self.parts(i, k), (i, i)), next(self.parts(k + 1, j), (k, k))
        return self.slice(*left), *right

    def made(self, i: int, j: int) -> bool:
        found = self.assigned(i, j) if self.word(i) not in CONTROL else None
        call = found and self.call(found[1], found[2])
        return bool(call) and f"{call[0]}.{call[1]}" in ENGINES

    def steps(self, i: int, j: int, state: dict[str, list], types: dict[str, str | None]) -> None:
        """Statements in order, those of plain blocks among them; branches, loops and what runs later aren't followed."""
        for a, b in self.statements(i, j):
            if self.word(a) == "{":
                self.steps(a + 1, self.close[a], state, types)
            if self.word(a) in CONTROL or self.word(a) in ("return", "{"):
                continue
            found = self.assigned(a, b)
            call = self.call(found[1], found[2]) if found else self.call(a, b)
            if not call:
                continue
            receiver, name, args = call
            known = state.get(receiver, []) if receiver else []
            if found and f"{receiver}.{name}" in ENGINES:
                state[found[0]] = [{"kind": "engine", "key": 0, "suffix": "", "gates": []}]
            elif found and name == "Group" and known:
                suffix = (self.literal(*args[0]) or "") if args else ""
                more = [g for x in args[1:] for g in self.gate(*x)]
                state[found[0]] = [*({**w, "suffix": w["suffix"] + suffix, "gates": w["gates"] + more} for w in known), *state.get(found[0], [])]
            elif not found and name == "Use" and known:
                more = [g for x in args for g in self.gate(*x)]
                state[receiver] = [{**w, "gates": w["gates"] + more} for w in known]
            elif not found and name in VERBS and known:
                if len(args) > 1:
                    x, y = args[-1]
                    holder = types.get(self.word(x)) if y - x == 3 and self.word(x + 1) == "." else None
                    self.put("verb", a, name=name, text=self.literal(*args[0]) or "", form=self.slice(x, y), params=[holder] if holder else [], ways=known, gates=[g for z in args[1:-1] for g in self.gate(*z)])
            else:
                given = [state.get(self.word(x), []) if y == x + 1 else [] for x, y in args]
                self.put("call", a, name=name, form="assigned" if found else "plain", args=given)
                if found:
                    state[found[0]] = [{"kind": "call", "key": self.start(a), "suffix": "", "gates": []}, *state.get(found[0], [])]

    def head(self, i: int) -> int:
        """Where the chain starts whose name stands at i."""
        while self.word(i - 1) == ".":
            i -= 2
            while i in self.opens:
                i = self.opens[i] - 1
        return i

    def inside(self, i: int, j: int, owner: str | None) -> None:
        """What is asked of bodies: keys of maps everywhere; of methods also bindings, variables' types, transactions and calls."""
        for k in range(i, j):
            w = self.word(k)
            if w == "map" and self.word(k + 1) == "[":
                brace = self.close[k + 1] + 1
                while brace < j and self.kind(brace) == "n" or self.word(brace) in (".", "*"):
                    brace += 1
                for a, b in self.parts(brace + 1, self.close[brace]) if self.word(brace) == "{" else ():
                    said = list(self.parts(a + 1, self.close[a])) if self.word(a) == "{" and self.word(self.close[a] + 1) == ":" else []
                    if len(said) == 2:
                        method = METHODS.get(self.slice(*said[0])) or (self.literal(*said[0]) or "").upper()
                        path = self.literal(*said[1])
                        if method and path:
                            self.put("skip", a, name=method, text=path)
            if owner is None:
                continue
            if w == "var" and self.kind(k + 1) == "n" and self.line(k + 1) == self.line(k):
                end = next(self.statements(k, j), (k, k))[1]
                eq = next((x for x in range(k, end) if self.word(x) == "="), end)
                kind = self.bare(k + 2, eq) if self.word(k + 2) != "*" else None
                if kind:
                    self.put("var", k, name=self.word(k + 1), text=kind)
            elif w == ":=" and self.kind(k + 1) == "n":
                brace = k + 4 if self.word(k + 2) == "." else k + 2
                if self.word(brace) == "{":
                    first = k - 1
                    while self.word(first - 1) == ",":
                        first -= 2
                    self.put("var", first, name=self.word(first), text=self.word(brace - 1))
            elif w == "(" and self.kind(k - 1) == "n" and self.word(k - 1) != "func":
                first, args = self.head(k - 1), list(self.parts(k + 1, self.close[k]))
                name = self.word(k - 1)
                if name in BINDS and args:
                    x, y = args[0]
                    self.put("bind", first, name=self.slice(x + 1 if self.word(x) == "&" else x, y), form=BINDS[name])
                if name == "Transaction" and args and self.word(args[-1][0]) == "func":
                    x = args[-1][0] + 1
                    if "DB" in [t for _, t in self.params(x + 1, self.close.get(x, x))]:
                        self.put("txn", first)
                if self.word(k - 2) == "." and self.kind(k - 3) == "n":
                    self.put("used", first, name=name, text=self.word(k - 3))


def go_syntax(files: DataFrame) -> DataFrame:
    """Files (project, path, content) -> rows of ``GO``; tests (``_test.go``) and null or empty files have none."""
    return rows(files.where("not endswith(path, '_test.go')"), GoReader, GO)
