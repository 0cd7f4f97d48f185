"""TypeScript classes whose fields carry decorators, as rows: one a field, with its type as it is written and its decorators in order."""
from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .syntax import Reader, rows

TOKEN = re.compile(r"""
 (?P<skip>\s+|//[^\n]*|/\*.*?\*/)
|(?P<s>'(?:[^'\\\n]|\\.)*'|"(?:[^"\\\n]|\\.)*"|`(?:[^`\\]|\\.)*`)
|(?P<r>(?:(?<=[(,:=\[])|(?<=[(,:=\[]\s))/(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*)
|(?P<n>[^\W\d][\w$]*)
|(?P<d>-?\d[\w.]*)
|(?P<o>=>|\.\.\.|.)""", re.S | re.X)
MODIFIERS = {"public", "private", "protected", "readonly", "declare", "override"}

FIELDS = T.StructType([
    *(T.StructField(n, T.StringType()) for n in ("project", "path", "class")), T.StructField("ord", T.IntegerType()), T.StructField("name", T.StringType()), T.StructField("written", T.StringType()),
    T.StructField("decorators", T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("args", T.StringType()), T.StructField("listed", T.ArrayType(T.StringType()))]))),
])


class ClassReader(Reader):
    """Exported classes of a file; ``listed`` of a decorator are the strings among its arguments."""

    pattern = TOKEN

    def read(self) -> list[dict]:
        for i, w in enumerate(self.words):
            if w == "class" and self.kind(i) == "n" and self.word(i - 1) == "export" and self.kind(i + 1) == "n":
                brace = i + 2
                while brace < len(self.words) and self.word(brace) != "{":
                    brace += 1
                if brace < len(self.words):
                    self.members(self.word(i + 1), brace + 1, self.close[brace])
        return self.rows

    def members(self, name: str, i: int, j: int) -> None:
        """Fields with decorators from i to j; what else stands in a class takes the decorators before it."""
        notes, n = [], 0
        while i < j:
            if self.word(i) == "@" and self.kind(i + 1) == "n":
                shut = self.close[i + 2] if self.word(i + 2) == "(" else i + 1
                notes.append({"name": self.word(i + 1), "args": self.slice(i + 3, min(shut, j)) if shut > i + 1 else "", "listed": [self.word(k)[1:-1] for k in range(i + 3, min(shut, j)) if self.kind(k) == "s"]})
                i = shut + 1
                continue
            k = i
            while self.word(k) in MODIFIERS and self.kind(k + 1) == "n":
                k += 1
            mark = k + 2 if self.word(k + 1) in ("?", "!") else k + 1
            end = self.ends(mark, j)
            if notes and self.kind(k) == "n" and self.word(mark) == ":":
                stop = next((x for x in range(mark, end) if self.word(x) == "="), end)
                self.rows.append({"class": name, "ord": n, "name": self.word(k), "written": self.slice(mark + 1, stop), "decorators": notes})
                n += 1
            notes, i = [], max(end + (self.word(end) == ";"), i + 1)

    def ends(self, i: int, j: int) -> int:
        """Where a member ends: at a semicolon, behind a body, before a decorator, or where a line begins that carries nothing on."""
        k = i
        while k < j:
            w = self.word(k)
            if w == ";" or w == "@":
                return k
            last = min(self.close[k], j) if k in self.close else k
            after = last + 1
            on = {"|", "&", "=", ":", ",", "=>", "?", ".", "<"}
            if k > i and after < j and self.line(after) > self.line(min(last, j - 1)) and self.word(last) not in on and self.word(after) not in on | {"{", "[", ">"}:
                return after
            if w == "{" and self.word(k - 1) not in (":", "=", "|", "&", "<", ",", "("):
                return after
            k = after
        return j


def decorated(files: DataFrame) -> DataFrame:
    """Files (project, path, content) -> rows of ``FIELDS``; declarations (``.d.ts``), tests and null or empty files have none."""
    own = F.col("path").endswith(".ts") & ~F.col("path").rlike(r"[.](d|spec|test)[.]ts$|(^|/)(node_modules|dist|build|[.]git|coverage|[.]next)/")
    return rows(files.where(own), ClassReader, FIELDS)
