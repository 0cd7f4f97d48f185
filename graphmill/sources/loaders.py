"""Files that people and collectors write: spans as OTLP JSON, golden traces, constraints, specs with front matter, baselines and snapshots.

JSON goes through Spark's reader with a fixed schema.  YAML of the few shapes that occur is read file by file, in Arrow batches, as
lines; Spark lists and reads the files, so any store that it reads will do.
"""
from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_VALUE = "stringValue string, intValue string, boolValue string, doubleValue string"
_ATTRIBUTES = f"array<struct<key: string, value: struct<{', '.join(x.replace(' ', ': ') for x in _VALUE.split(', '))}>>>"
OTLP = f"""resourceSpans array<struct<resource: struct<attributes: {_ATTRIBUTES}>, scopeSpans: array<struct<scope: struct<name: string, version: string>,
  spans: array<struct<traceId: string, spanId: string, parentSpanId: string, name: string, kind: int, startTimeUnixNano: string, endTimeUnixNano: string, attributes: {_ATTRIBUTES}>>>>>>"""


def _flat(attributes):
    """A map of attributes; of a value's kinds the first that is there counts, of equal keys the last."""
    v = lambda a: F.coalesce(*(a["value"][k] for k in ("stringValue", "intValue", "boolValue", "doubleValue")))
    known = F.filter(F.coalesce(attributes, F.array().cast(_ATTRIBUTES)), lambda a: a["key"].isNotNull() & v(a).isNotNull())
    return F.map_from_entries(F.filter(F.transform(known, lambda a, i: F.when(~F.exists(F.slice(known, i + 2, F.size(known)), lambda b: b["key"] == a["key"]), F.struct(a["key"].alias("k"), v(a).alias("v")))), lambda x: x.isNotNull()))


def otlp(raw: DataFrame) -> DataFrame:
    """Rows (file, resourceSpans) as spans: session_id (the first span's trace), span_ord, span_id, parent_id, name, start_ns, end_ns, attributes, service_version. Whatever is missing is null; a file without spans gives none."""
    r = raw.select("file", F.posexplode("resourceSpans").alias("r", "rs"))
    r = r.withColumn("version", F.try_element_at(_flat(F.col("rs.resource.attributes")), F.lit("service.version")))
    s = r.select("file", "r", "version", F.posexplode("rs.scopeSpans").alias("s", "ss")).select("file", "r", "s", "version", F.posexplode("ss.spans").alias("k", "x"))
    w = Window.partitionBy("file")
    order = w.orderBy("r", "s", "k")
    none = lambda c: F.nullif(c, F.lit(""))
    return s.select("file", F.first("x.traceId").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("session_id"), F.row_number().over(order).cast("bigint").alias("span_ord"),
                    F.col("x.spanId").alias("span_id"), none(F.col("x.parentSpanId")).alias("parent_id"), "x.name", F.col("x.startTimeUnixNano").cast("bigint").alias("start_ns"), F.col("x.endTimeUnixNano").cast("bigint").alias("end_ns"), _flat(F.col("x.attributes")).alias("attributes"),
                    F.first("version", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("service_version"))


def read_otlp(spark: SparkSession, path: str) -> DataFrame:
    """Spans of the OTLP JSON files under a path, a document a file."""
    return otlp(spark.read.schema(OTLP).option("multiLine", True).option("mode", "PERMISSIVE").json(path).withColumn("file", F.input_file_name()))


def stream_otlp(spark: SparkSession, path: str) -> DataFrame:
    """The same files as a stream of raw documents (file, resourceSpans), for ``foreachBatch`` with ``otlp``: a file is a batch that a collector dropped."""
    return spark.readStream.schema(OTLP).option("multiLine", True).json(path).withColumn("file", F.input_file_name())


# ---- YAML and front matter

def _scalar(text: str):
    text = text.strip()
    if len(text) > 1 and text[0] == text[-1] and text[0] in "\"'":
        return text[1:-1]
    if text.startswith("[") and text.endswith("]"):
        return [_scalar(x) for x in text[1:-1].split(",") if x.strip()]
    return None if text in ("", "null", "~") else text


def yaml(text: str):
    """Mappings, lists, scalars as text, block text (| and >) and comments: what traces and specs are written in. Numbers and booleans stay text."""
    rows = [(len(x) - len(x.lstrip()), x.strip(), x) for x in text.split("\n")]
    at = 0

    def blank() -> None:
        nonlocal at
        while at < len(rows) and (not rows[at][1] or rows[at][1].startswith("#")):
            at += 1

    def block(depth: int, folded: bool) -> str:
        nonlocal at
        out = []
        while at < len(rows) and (not rows[at][1] or rows[at][0] > depth):
            out.append(rows[at][2].strip() if folded else rows[at][2][depth + 2:])
            at += 1
        return (" " if folded else "\n").join(out).strip()

    def value(rest: str, depth: int):
        nonlocal at
        rest = re.sub(r"\s+#.*$", "", rest) if not rest[:1] in ("'", '"') else rest
        if rest[:1] in ("|", ">"):
            return block(depth, rest[0] == ">")
        if rest:
            return _scalar(rest)
        blank()
        if at < len(rows) and (rows[at][0] > depth or (rows[at][0] == depth and rows[at][1].startswith("- "))):
            return node(rows[at][0])
        return None

    def node(depth: int):
        nonlocal at
        blank()
        if at >= len(rows):
            return None
        if rows[at][1] == "-" or rows[at][1].startswith("- "):
            out = []
            while blank() or (at < len(rows) and rows[at][0] == depth and (rows[at][1] == "-" or rows[at][1].startswith("- "))):
                rest = rows[at][1][1:].strip()
                if re.match(r"[\w.-]+:(\s|$)", rest):
                    rows[at] = (depth + 2, rest, " " * (depth + 2) + rest)
                    out.append(node(depth + 2))
                else:
                    at += 1
                    out.append(value(rest, depth))
            return out
        out = {}
        while blank() or (at < len(rows) and rows[at][0] == depth):
            m = re.match(r"([^:]+):(?:\s+(.*)|)$", rows[at][1])
            at += 1
            if m:
                out[_scalar(m[1])] = value(m[2] or "", depth)
        return out

    blank()
    return node(rows[at][0]) if at < len(rows) else None


def front_matter(text: str) -> dict | None:
    """The mapping between the first two ``---`` of a document."""
    end = text.find("\n---", 3)
    return (yaml(text[4:end]) or {}) if text.startswith("---") and end >= 0 else None


def _files(spark: SparkSession, path: str, pattern: str, read: Callable[[str], Iterator[dict]], schema: str) -> DataFrame:
    """One pass over whole files; what can't be read gives no rows."""
    columns = list(spark.createDataFrame([], schema).columns)

    def run(frames):
        for frame in frames:
            out = []
            for name, text in zip(frame["path"], frame["text"]):
                try:
                    out += [{"file": name, **row} for row in read(text)]
                except (ValueError, KeyError, AttributeError, TypeError):
                    continue
            yield pd.DataFrame(out, columns=columns)

    found = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", True).format("binaryFile").load(path)
    t = found.select("path", F.col("content").cast("string").alias("text"))
    return t.mapInPandas(run, schema)


def _text(v):
    return None if v is None else str(v)


def read_goldens(spark: SparkSession, path: str) -> DataFrame:
    """Golden traces: file, trace, entrypoint, nodes, edges (those without a target are left out; via is the mechanism)."""
    def read(text):
        g = yaml(text)
        nodes = [{"id": _text(n.get("id")), "type": _text(n.get("type")), "symbol": _text(n.get("symbol")), "file": _text(n.get("file")), "args": n.get("args") or [], "relevance": _text((n.get("retrieval") or {}).get("relevance"))} for n in g.get("nodes") or []]
        edges = [{"src": _text(e.get("from")), "dst": _text(e.get("to")), "relation": _text(e.get("relation")), "mechanism": _text(e.get("via") or e.get("mechanism"))} for e in g.get("edges") or [] if e.get("to")]
        yield {"trace": _text(g["id"]), "entrypoint": _text(g.get("entrypoint")), "nodes": nodes, "edges": edges}
    return _files(spark, path, "*.yaml", read, "file string, trace string, entrypoint string, nodes array<struct<id: string, type: string, symbol: string, file: string, args: array<string>, relevance: string>>, edges array<struct<src: string, dst: string, relation: string, mechanism: string>>")


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    """Golden answers: file, id, entrypoint, question, and what is expected (want_...), as ``functions.score.answer_scores`` takes it."""
    def read(text):
        g = yaml(text)
        e = g.get("expected_response") or {}
        groups = [x if isinstance(x, list) else [x] for x in e.get("recommendations_must_contain") or []]
        yield {"id": _text(g["id"]), "entrypoint": _text(g.get("entrypoint")), "question": _text(g.get("query") or g.get("question")), "want_finding_type": _text(e.get("finding_type")), "want_severity": _text(e.get("severity")), "want_key_nodes": e.get("key_nodes") or [], "want_explanation": e.get("explanation_must_contain") or [], "want_recommendations": groups}
    return _files(spark, path, "*.yaml", read, "file string, id string, entrypoint string, question string, want_finding_type string, want_severity string, want_key_nodes array<string>, want_explanation array<string>, want_recommendations array<array<string>>")


def read_constraints(spark: SparkSession, path: str) -> DataFrame:
    """Rules: file, name, query, severity, message; those without name, query or severity are left out."""
    def read(text):
        for rule in (yaml(text) or {}).get("rules") or []:
            if rule.get("name") and rule.get("query") and rule.get("severity"):
                yield {k: _text(rule.get(k)) for k in ("name", "query", "severity", "message")}
    return _files(spark, path, "*.y*ml", read, "file string, name string, query string, severity string, message string")


def read_specs(spark: SparkSession, path: str) -> DataFrame:
    """Specs in front matter: file, trace, framework, category, entrypoint, nodes, edges, by trace; those without id, entrypoint or nodes are left out."""
    def read(text):
        m = front_matter(text)
        if m and m.get("id") and m.get("entrypoint") and isinstance(m.get("expected_nodes"), list) and m["expected_nodes"]:
            edges = m.get("expected_edges")
            yield {"trace": _text(m["id"]), "framework": _text(m.get("framework") or "laravel"), "category": _text(m.get("category") or ""), "entrypoint": _text(m["entrypoint"]), "nodes": list(map(str, m["expected_nodes"])), "edges": list(map(str, edges)) if isinstance(edges, list) else []}
    return _files(spark, path, "*.md", read, "file string, trace string, framework string, category string, entrypoint string, nodes array<string>, edges array<string>").orderBy(F.collate("trace", "UNICODE"))


# ---- baselines and snapshots

def save_baseline(rows: DataFrame, path: str, label: str) -> None:
    """Keep a capture under a label; the label's earlier rows are replaced, others stay."""
    rows.write.mode("overwrite").parquet(f"{path}/label={label}")


def load_baseline(spark: SparkSession, path: str, label: str) -> DataFrame:
    return spark.read.parquet(f"{path}/label={label}")


def snapshot_id(at):
    """A time as an id: ISO, with - for : and without fractions of a second."""
    return F.date_format(at, "yyyy-MM-dd'T'HH-mm-ss'Z'")


def append_snapshot(rows: DataFrame, path: str, snapshot: str) -> None:
    rows.withColumn("snapshot", F.lit(snapshot)).write.mode("append").partitionBy("snapshot").parquet(path)


def list_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Snapshots with their number of routes, the latest first."""
    return spark.read.parquet(path).groupBy(F.col("snapshot").cast("string").alias("snapshot")).agg(F.count("*").alias("n_routes")).orderBy(F.desc("snapshot"))


def load_snapshot(spark: SparkSession, path: str, snapshot: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("snapshot").cast("string") == snapshot).drop("snapshot")


def json_in(text: str) -> dict | None:
    """The first JSON object in prose, or None."""
    m = re.search(r"\{.*\}", text or "", re.S)
    try:
        return json.loads(m[0]) if m else None
    except ValueError:
        return None
