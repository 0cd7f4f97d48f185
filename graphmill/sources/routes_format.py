"""``spark.read.format("routes").load(root)``: the routes that a tree of source files holds, or Parquet tables of them (project, path, content).

A partition is a bounded share of the bytes, planned from sizes alone.  Predicates on framework, project, file and method are taken at the scan:
files that can't answer are never read, nor are contents of row groups without such a file.
"""
from __future__ import annotations

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, StringContains, StringEndsWith, StringStartsWith

from .scan import ADAPTERS, implied

GATE = T.StructType([T.StructField("type", T.StringType()), T.StructField("symbol", T.StringType()), T.StructField("args", T.ArrayType(T.StringType()))])
SCHEMA = T.StructType([*(T.StructField(n, T.StringType()) for n in ("framework", "project", "file")), T.StructField("nth", T.IntegerType()), *(T.StructField(n, T.StringType()) for n in ("method", "path", "handler")), T.StructField("gates", T.ArrayType(GATE))])
ENDINGS = {"laravel": ".php", "nestjs": ".ts", "springboot": ".java", "go": ".go"}
BEFORE = ("framework", "project", "file")  # known before a file is read
BYTES = 32 << 20
ROWS = 2_000


def _fs(path: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class Share(InputPartition):
    """Source files by name, or one Parquet file's row groups of which every ``of``-th from ``at`` is read."""

    def __init__(self, files: list[str], at: int = 0, of: int = 0):
        super().__init__(None)
        self.files, self.at, self.of = files, at, of


class RoutesReader(DataSourceReader):
    def __init__(self, root: str, project: str, most: int):
        self.root, self.project, self.most = root, project, most
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters):
        kinds = {EqualTo: "is", In: "in", StringStartsWith: "starts", StringEndsWith: "ends", StringContains: "has", IsNotNull: "set"}
        for f in filters:
            name = ".".join(getattr(f, "attribute", ()))
            if type(f) in kinds and name in (*BEFORE, "method"):
                self.tests.append((name, kinds[type(f)], getattr(f, "value", None)))
            else:
                yield f

    def holds(self, **known) -> bool:
        """Whether what is known of a row agrees with the predicates on it; null agrees with none."""
        def one(kind, value, x):
            if x is None:
                return False
            return {"is": lambda: x == value, "in": lambda: x in value, "starts": lambda: x.startswith(value), "ends": lambda: x.endswith(value), "has": lambda: value in x, "set": lambda: True}[kind]()
        return all(one(kind, value, known[name]) for name, kind, value in self.tests if name in known)

    def framework(self, file: str | None) -> str | None:
        return next((k for k, end in ENDINGS.items() if file and file.endswith(end) and not file.endswith((".d.ts", "_test.go"))), None)

    def wanted(self, project: str | None, file: str | None) -> bool:
        framework = self.framework(file)
        return framework is not None and self.holds(framework=framework, project=project, file=file)

    def partitions(self):
        from pyarrow import fs as pafs
        fs, top = _fs(self.root)
        found = sorted((f.path, f.size or 0) for f in fs.get_file_info(pafs.FileSelector(top, recursive=True, allow_not_found=True)) if f.is_file and f.base_name[0] not in "._")
        out, files, size = [], [], 0
        for path, n in found:
            if path.endswith(".parquet"):
                of = max(1, -(-n // self.most))
                out += [Share([path], k, of) for k in range(of)]
            elif self.wanted(self.project, path[len(top):].lstrip("/")):
                if files and size + n > self.most:
                    out.append(Share(files))
                    files, size = [], 0
                files, size = [*files, path], size + n
        return [*out, Share(files)] if files or not out else out

    def texts(self, share: Share):
        """(project, file, content) of a share."""
        fs, top = _fs(self.root)
        if not share.of:
            for path in share.files:
                with fs.open_input_file(path) as f:
                    yield self.project, path[len(top):].lstrip("/"), f.read().decode("utf-8", "replace")
            return
        import pyarrow.parquet as pq
        with fs.open_input_file(share.files[0]) as f:
            table = pq.ParquetFile(f)
            for g in range(share.at, table.num_row_groups, share.of):
                keys = table.read_row_group(g, columns=["project", "path"])
                mine = [self.wanted(p, q) for p, q in zip(keys["project"].to_pylist(), keys["path"].to_pylist())]
                if not any(mine):
                    continue
                at = 0
                for b in table.iter_batches(ROWS, [g], columns=["project", "path", "content"]):
                    b, at = b.filter(pa.array(mine[at:at + len(b)])), at + len(b)
                    yield from zip(*(b.column(n).to_pylist() for n in ("project", "path", "content")))

    def read(self, partition):
        out = []
        for project, file, text in self.texts(partition):
            framework = self.framework(file)
            for nth, (method, path, gates, handler) in enumerate(ADAPTERS[framework](text or "")):
                if self.holds(method=method):
                    out.append({"framework": framework, "project": project, "file": file, "nth": nth, "method": method, "path": path, "handler": handler, "gates": [{"type": k, "symbol": s, "args": a} for k, s, a in implied(gates, framework)]})
            if len(out) >= ROWS:
                yield pa.RecordBatch.from_pylist(out, _ARROW)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, _ARROW)


_ARROW = pa.schema([*((n, pa.string()) for n in ("framework", "project", "file")), ("nth", pa.int32()), *((n, pa.string()) for n in ("method", "path", "handler")), ("gates", pa.list_(pa.struct([("type", pa.string()), ("symbol", pa.string()), ("args", pa.list_(pa.string()))])))])


class RoutesSource(DataSource):
    """``format("routes")``; options: path; project (the name of a tree of files, which has none of its own); partition_bytes."""

    @classmethod
    def name(cls):
        return "routes"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return RoutesReader(self.options["path"], self.options.get("project", ""), int(self.options.get("partition_bytes", BYTES)))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RoutesSource)
