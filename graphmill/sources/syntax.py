"""PHP source text as rows of syntax: imports, classes, methods, properties, calls, branches, assignments, items of arrays.

One reader goes over a file's tokens once, with brackets matched beforehand, and says nothing of what a call means: that is asked of the
rows, by joins and filters (``operators.code``).  Files are read by themselves, in batches, so a project of any size spreads.
"""
from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

TOKEN = re.compile(r"""
 (?P<skip>\s+|//[^\n]*|\#(?!\[)[^\n]*|/\*.*?\*/|<\?php|<\?=|\?>)
|(?P<s>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|<<<[ \t]*['"]?(?P<mark>\w+)['"]?\n.*?\n[ \t]*(?P=mark)\b)
|(?P<v>\$\w+)
|(?P<n>\\?[A-Za-z_\u0080-￿][\w\u0080-￿]*(?:\\[A-Za-z_]\w*)*)
|(?P<d>\d[\w.]*)
|(?P<o>\?->|->|::|=>|\.\.\.|===|!==|==|!=|<=|>=|&&|\|\||\?\?|.)""", re.S | re.X)
OPEN = {"(": ")", "[": "]", "{": "}"}
LINKS = {"->", "?->", "::"}
#: words that stand before a parenthesis and aren't functions
WORDS = {"if", "elseif", "while", "for", "foreach", "switch", "catch", "match", "function", "fn", "array", "list", "isset", "empty", "unset", "echo", "print", "return", "use", "declare", "and", "or", "xor", "exit", "die", "new", "require", "require_once", "include", "include_once", "throw", "static", "self_", "case", "clone", "yield"}
INCLUDES = {"require", "require_once", "include", "include_once"}
MODIFIERS = {"public", "protected", "private", "static", "final", "abstract", "readonly", "var"}

ARG = T.StructType([T.StructField(n, T.StringType()) for n in ("key", "kind", "text", "value")] + [T.StructField(n, T.IntegerType()) for n in ("at", "end")])
SYNTAX = T.StructType([
    T.StructField("project", T.StringType()), T.StructField("path", T.StringType()),
    *(T.StructField(n, T.StringType()) for n in ("kind", "class", "method")),  # method: the one whose body holds the row, null outside
    *(T.StructField(n, T.IntegerType()) for n in ("at", "end", "ord", "owner", "line")),
    *(T.StructField(n, T.StringType()) for n in ("form", "name", "base", "root", "text")),
    T.StructField("args", T.ArrayType(ARG)),
    # whether the row stands in the first method of its name in the file, and whether that method's name is one that such methods call on $this
    *(T.StructField(n, T.BooleanType()) for n in ("placed", "shared")),
])


class Reader:
    """The tokens of a text, and what stands between any two of them."""

    pattern = TOKEN

    def __init__(self, text: str):
        self.text = text
        self.tokens, self.words = [], []
        self.close: dict[int, int] = {}
        stack: list[int] = []
        for m in self.pattern.finditer(text):
            kind = m.lastgroup
            if kind == "skip":
                continue
            w, i = m.group(), len(self.words)
            self.tokens.append((kind if kind != "mark" else "s", m.start(), m.end()))
            self.words.append(w)
            if kind != "o":
                continue
            if w in OPEN:
                stack.append(i)
            elif w in ")]}":
                while stack and OPEN[self.words[stack[-1]]] != w:  # one that is never closed
                    self.close[stack.pop()] = i
                if stack:
                    self.close[stack.pop()] = i
        for i in stack:
            self.close[i] = len(self.words)
        self.lines = [m.start() for m in re.finditer("\n", text)]
        self.rows: list[dict] = []

    def word(self, i: int) -> str:
        return self.words[i] if 0 <= i < len(self.words) else ""

    def kind(self, i: int) -> str:
        return self.tokens[i][0] if 0 <= i < len(self.tokens) else ""

    def start(self, i: int) -> int:
        return self.tokens[i][1] if i < len(self.tokens) else len(self.text)

    def until(self, i: int) -> int:
        """Where the token before ``i`` ends."""
        return self.tokens[min(i, len(self.tokens)) - 1][2] if i and self.tokens else 0

    def slice(self, i: int, j: int) -> str:
        return self.text[self.start(i):self.until(j)] if j > i else ""

    def line(self, i: int) -> int:
        return bisect_right(self.lines, self.start(i)) + 1

    def parts(self, i: int, j: int, mark: str = ",") -> Iterator[tuple[int, int]]:
        """Token ranges between ``mark`` from i to j, brackets passed over."""
        at, k = i, i
        while k < j:
            if self.word(k) == mark and self.kind(k) == "o":
                if k > at:
                    yield at, k
                at = k + 1
            k = min(self.close[k], j) if k in self.close else k
            k += 1
        if j > at:
            yield at, j

    def value(self, i: int, j: int) -> tuple[str, str]:
        """What kind of expression stands from i to j, and its plain value."""
        w, n = self.word(i), j - i
        if n == 1 and self.kind(i) == "s":
            return "string", w[1:-1] if w[0] in "'\"" else w
        if n == 1 and self.kind(i) == "v":
            return "variable", w
        if w == "[" and self.close.get(i) == j - 1 or w == "array" and self.close.get(i + 1) == j - 1:
            return "array", ""
        if n == 3 and self.word(i + 1) == "::" and self.word(i + 2) == "class":
            return "class", w.lstrip("\\")
        if w == "new" and (n == 2 or self.close.get(i + 2) == j - 1):
            return "new", self.word(i + 1).lstrip("\\")
        if w in ("function", "fn") or w == "static" and self.word(i + 1) in ("function", "fn"):
            return "closure", ""
        if self.kind(i) == "n" and self.word(i + 1) == "::" and self.word(i + 3) == "(" and self.close.get(i + 3) == j - 1:
            return "static", w.lstrip("\\")
        return "other", self.slice(i, j)

    def argument(self, i: int, j: int) -> dict:
        key = None
        if self.kind(i) == "n" and self.word(i + 1) == ":" and self.word(i + 2) != ":":
            key, i = self.word(i), i + 2
        kind, value = self.value(i, j)
        return {"key": key, "kind": kind, "text": self.slice(i, j), "value": value, "at": self.start(i), "end": self.until(j)}

    def add(self, kind: str, i: int, j: int, **more) -> None:
        self.rows.append({"kind": kind, "at": self.start(i), "end": self.until(j), "line": self.line(i), "from": i, **more})

    # ---- what is read ----

    def read(self) -> list[dict]:
        # nothing stands before the first and behind the last
        words, kinds = [*self.words, *[""] * 4], [*(k for k, _, _ in self.tokens), *[""] * 4]
        for i, w in enumerate(self.words):
            k = kinds[i]
            if k == "n" and words[i - 1] not in LINKS:
                if w == "use" and words[i - 1] in ("", ";", "{", "}"):
                    self.imports(i)
                elif w in ("class", "interface", "trait", "enum") and kinds[i + 1] == "n" and words[i - 1] != "::":
                    self.klass(i)
                elif w == "function" and kinds[i + 1] == "n" and words[i + 2] == "(":
                    self.function(i)
                elif w == "if" and words[i + 1] == "(":
                    self.branch(i)
                elif w == "return":
                    j = self.sentence(i)
                    self.add("return", i + 1, j, text=self.slice(i + 1, j), form=self.value(i + 1, j)[0], name="return")
                elif w == "const" and words[i + 2] == "=" or w == "const" and words[i + 3] == "=":
                    at = i + 1 if words[i + 2] == "=" else i + 2
                    j = self.sentence(i)
                    self.add("const", at + 2, j, name=self.word(at), text=self.value(at + 2, j)[1], form=self.value(at + 2, j)[0])
                elif w in INCLUDES:
                    j = self.sentence(i)
                    wrapped = words[i + 1] == "(" and self.close.get(i + 1) == j - 1
                    self.add("include", i, j, text=self.slice(i + 2, j - 1) if wrapped else self.slice(i + 1, j), name=w)
                elif w == "new" and kinds[i + 1] == "n":
                    self.chain(i)
                elif words[i + 1] in ("(", "::") and w not in WORDS and words[i - 1] not in ("function", "new", "fn"):
                    self.chain(i)
            elif k == "v" and words[i - 1] != "::":
                if words[i + 1] == "=" and words[i - 1] in MODIFIERS or words[i + 1] == "=" and kinds[i - 1] == "n" and words[i - 2] in MODIFIERS:
                    j = self.sentence(i)
                    kind, value = self.value(i + 2, j)
                    self.add("property", i + 2, j, name=w, text=value, form=kind)
                elif words[i + 1] == "=":
                    j = self.sentence(i)
                    self.add("assign", i + 2, j, name=w, text=self.slice(i + 2, j), form=self.value(i + 2, j)[0])
                if words[i + 1] in LINKS:
                    self.chain(i)
            elif w == "(" and k == "o" and self.word(self.close[i] + 1) in LINKS and kinds[i - 1] not in ("n", "v"):
                self.chain(i)
            if w == "[" and k == "o" and not (kinds[i - 1] == "v" or kinds[i - 1] == "n" and words[i - 1] not in WORDS or words[i - 1] in ("]", ")", "#")) or w == "(" and words[i - 1] == "array":
                self.items(i)
        return self.placed()

    def sentence(self, i: int) -> int:
        """The token that ends the expression from i: a semicolon, a closing bracket, or a comma."""
        while i < len(self.words):
            w = self.words[i]
            if self.kind(i) == "o" and w in ";)]},":
                return i
            i = self.close[i] + 1 if i in self.close else i + 1
        return len(self.words)

    def imports(self, i: int) -> None:
        j = i + 1
        while j < len(self.words) and self.words[j] != ";":
            j += 1
        if self.word(i + 1) == "(":
            return
        brace = next((k for k in range(i, j) if self.words[k] == "{"), None)
        prefix = self.slice(i + 1, brace).replace(" ", "").strip("\\") + "\\" if brace else ""
        for a, b in self.parts(brace + 1 if brace else i + 1, min(self.close[brace], j) if brace else j):
            if self.word(a) in ("function", "const"):
                continue
            full = prefix + self.word(a).lstrip("\\")
            self.add("use", a, b, name=self.word(a + 2) if self.word(a + 1) == "as" else full.rsplit("\\", 1)[-1], text=full)

    def klass(self, i: int) -> None:
        j = i + 2
        while j < len(self.words) and self.words[j] not in ("{", ";"):
            j += 1
        head = self.words[i + 2:j]
        base = head[head.index("extends") + 1] if "extends" in head else None
        faces = [x.lstrip("\\") for x in head[head.index("implements") + 1:] if x != ","] if "implements" in head else []
        self.add("class", i, self.close.get(j, j) + 1, name=self.word(i + 1), base=base and base.lstrip("\\"), form=self.word(i), args=[{"kind": "implements", "text": x, "value": x} for x in faces])

    def function(self, i: int) -> None:
        shut = self.close[i + 2]
        params = []
        for a, b in self.parts(i + 3, shut):
            var = next((k for k in range(a, b) if self.kind(k) == "v"), None)
            if var is None:
                continue
            said = [self.word(k) for k in range(a, var)]
            kept = [x for x in said if x not in MODIFIERS and x not in ("&", "...", "?")]
            params.append({"key": None, "kind": "promoted" if set(said) & MODIFIERS else "param", "text": "".join(kept), "value": self.word(var), "at": self.start(a), "end": self.until(b)})
        body = shut + 1
        while body < len(self.words) and self.words[body] not in ("{", ";"):
            body += 1
        first = i
        while self.word(first - 1) in MODIFIERS:
            first -= 1
        seen = set(self.words[first:i])
        end = self.close.get(body, body) + 1 if self.word(body) == "{" else body + 1
        self.add("method", first, end, name=self.word(i + 1), form=next((x for x in ("private", "protected") if x in seen), "public"), args=params, body=body)

    def statements(self, i: int, j: int) -> Iterator[tuple[int, int]]:
        """Token ranges of the statements from i to j."""
        at = i
        while at < j:
            k, block = at, self.word(at) in ("if", "for", "foreach", "while", "switch", "try", "do", "{")
            while k < j:
                if self.word(k) == ";" and self.kind(k) == "o":
                    k += 1
                    if not (block and self.word(k) in ("else", "elseif")):
                        break
                    continue
                if k in self.close:
                    shut = self.words[k] == "{"
                    k = self.close[k] + 1
                    if block and shut and self.word(k) not in ("else", "elseif", "catch", "finally", "while"):
                        break
                    continue
                k += 1
            yield at, min(k, j)
            at = max(k, at + 1)

    def block(self, i: int) -> tuple[int, int]:
        """The statement or block that starts at i."""
        if self.word(i) == "{":
            return i, self.close[i] + 1
        return next(self.statements(i, len(self.words)), (i, i))

    def branch(self, i: int) -> None:
        shut = self.close[i + 1]
        a, b = self.block(shut + 1)
        inner = (a + 1, b - 1) if self.word(a) == "{" else (a, b)
        exits = any(self.word(x) == "throw" or self.word(x) == "abort" and self.word(x + 1) == "(" for x, _ in self.statements(*inner))
        spans = [{"key": None, "kind": "condition", "text": self.slice(i + 2, shut), "value": "", "at": self.start(i + 2), "end": self.until(shut)}, {"key": None, "kind": "exit" if exits else "then", "text": "", "value": "", "at": self.start(a), "end": self.until(b)}]
        if self.word(b) in ("else", "elseif"):
            c, d = self.block(b + 1) if self.word(b) == "else" else (b, self.block(self.close.get(b + 1, b) + 1)[1])
            spans.append({"key": None, "kind": "else", "text": "", "value": "", "at": self.start(c), "end": self.until(d)})
            b = d
        self.add("if", i, b, text=self.slice(i + 2, shut), args=spans)

    def chain(self, i: int) -> None:
        """The calls of one chain: a call reaches from the chain's start to its own closing bracket."""
        at, name, form, base, root, whole, called = i, self.word(i), "function", "", None, True, True
        if name == "new":
            name, form, at = self.word(i + 1), "new", i + 1
        elif self.kind(i) == "v":
            name, form = "", "variable"
        elif name == "(":
            at, name, form = self.close[i], "", "group"
        k = at + 1
        while True:
            w = self.word(k)
            if w == "(" and self.kind(k) == "o" and (name or k == at + 1):
                shut = self.close[k]
                if name:
                    if form == "static" and root is None and k == i + 3:
                        root = base
                    args = [self.argument(a, b) for a, b in self.parts(k + 1, shut)]
                    self.add("call", i, shut + 1, form=form, name=name.lstrip("\\"), base=base, root=root if whole else None, text=self.slice(i, shut + 1), args=args)
                name, k = "", shut + 1
                called = True
            elif w in LINKS and self.kind(k + 1) in ("n", "v"):
                if k > i + 1 and not called:
                    whole = False
                base, name, form = self.slice(i, k), self.word(k + 1), "static" if w == "::" else "member"
                base = base.lstrip("\\") if form == "static" else base
                k, called = k + 2, False
            elif w == "[" and k in self.close:
                k, whole = self.close[k] + 1, False
            else:
                return

    def items(self, i: int) -> None:
        for n, (a, b) in enumerate(self.parts(i + 1, self.close[i])):
            arrow = next((k for k, w in enumerate(self.words[a:b], a) if w == "=>" and not any(o < k < self.close[o] for o in range(a, k) if o in self.close)), None) if self.word(a) not in ("fn", "static", "function") else None
            key = self.value(a, arrow)[1] if arrow else None
            v = arrow + 1 if arrow else a
            kind, value = self.value(v, b)
            self.add("item", v, b, ord=n, owner=self.start(i - 1 if self.word(i) == "(" else i), base=key, form=kind, name=value, text=self.slice(v, b))

    def placed(self) -> list[dict]:
        """Rows with the class and the method that hold them, and the place among the statements for those at a method's top."""
        methods = sorted((r["at"], r["end"], r) for r in self.rows if r["kind"] == "method")
        classes = sorted((r["at"], r["end"], r["name"]) for r in self.rows if r["kind"] == "class")
        tops = {}
        for _, _, m in methods:
            if self.word(m["body"]) == "{":
                for n, (a, _) in enumerate(self.statements(m["body"] + 1, self.close[m["body"]])):
                    tops[a] = n

        def holder(spans, at):
            best = None
            for a, e, x in spans:
                if a > at:
                    break
                if at < e:
                    best = x
            return best

        firsts: dict[str, tuple[int, int]] = {}
        for a, e, m in methods:
            firsts.setdefault(m["name"], (a, e))
        called = set()
        for r in self.rows:
            m = holder(methods, r["at"])
            r["method"] = m["name"] if m is not None and m is not r else None
            r["class"] = holder(classes, r["at"]) if r["kind"] != "class" else r["name"]
            if r["kind"] != "item":
                r["ord"] = tops.get(r["from"], -1)
            a, e = firsts.get(r["method"], (0, -1))
            r["placed"] = a <= r["at"] and r["end"] <= e
            if r["placed"] and r["kind"] == "call" and r["form"] == "member" and r["base"] == "$this":
                called.add(r["name"])
        for r in self.rows:
            r["shared"] = r["method"] in called
        return self.rows


def syntax(files: DataFrame) -> DataFrame:
    """Files (project, path, content) -> rows of ``SYNTAX``; a null or empty file has none, and one that breaks off is read as far as it goes."""
    return rows(files, Reader, SYNTAX)


def _column(values: list, kind: pa.DataType) -> pa.Array:
    """Values as a column; lists of structures field by field, which is much faster than one by one."""
    if not (pa.types.is_list(kind) and pa.types.is_struct(kind.value_type)):
        return pa.array(values, kind)
    flat = [x for v in values if v for x in v]
    fields = list(kind.value_type)
    inner = pa.StructArray.from_arrays([pa.array([x.get(f.name) for x in flat], f.type) for f in fields], fields=fields)
    ends = list(accumulate((len(v) if v else 0 for v in values), initial=0))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), inner, type=kind, mask=pa.array([v is None for v in values], pa.bool_()))


def rows(files: DataFrame, reader: type[Reader], schema: T.StructType) -> DataFrame:
    """Files (project, path, content) -> a reader's rows, in Arrow batches of a few thousand."""
    shape = to_arrow_schema(schema)

    def batch(out: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([_column([r.get(f.name) for r in out], f.type) for f in shape], schema=shape)

    def run(batches):
        for b in batches:
            out = []
            for project, path, text in zip(*(b.column(k).to_pylist() for k in range(3))):
                for r in reader(text).read() if text else []:
                    r["project"], r["path"] = project, path
                    out.append(r)
                if len(out) >= 5_000:
                    yield batch(out)
                    out = []
            yield batch(out)

    return files.select("project", "path", "content").mapInArrow(run, schema)
