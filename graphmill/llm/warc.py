"""A Python data source for WARC archives, and the page archive round trip built on it.

Archives are files of gzip members, a record each.  A member carries its own compressed length in a gzip extra field, so a
reader that turns a record down after its headers seeks to the next one without inflating the payload.  Archives
written by others are read too: plain ones, where a reader seeks past the payload, and members without that field or
with many records, which are inflated in small pieces and thrown away.
"""
from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from .common import materialize, new_path, release, small_batches, table

SCHEMA = "record_id string, record_type string, target_uri string, date string, page_id long, refers_to long, payload_digest string, payload_length long, payload binary"
#: an archive is closed beyond so many bytes, which bounds the work of a read partition
ARCHIVE = 64 << 20
#: copies of payloads from this length on are written as revisits
REVISIT = 1000
#: digests met twice that are broadcast at most, some 100 bytes each
BROADCAST = 500_000
DATE = "2020-01-01T00:00:00Z"
#: columns whose predicates are decided on headers alone
HEADER_COLUMNS = {"record_id", "record_type", "target_uri", "date", "page_id", "refers_to", "payload_digest", "payload_length"}


def _fs(path: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def _b32(sha1_hex: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def _hex(label: str | None) -> str | None:
    if not label:
        return None
    algorithm, _, value = label.partition(":")
    return base64.b32decode(value).hex() if algorithm.lower() == "sha1" and len(value) == 32 else value.lower()


def member(data: bytes) -> bytes:
    """A gzip member with its whole length in an extra field of the subfield id SL."""
    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = c.compress(data) + c.flush()
    head = b"\x1f\x8b\x08\x04" + b"\0" * 4 + b"\0\xff" + struct.pack("<H", 12) + b"SL" + struct.pack("<H", 8)
    whole = len(head) + 8 + len(body) + 8
    return head + struct.pack("<Q", whole) + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def _clean(value) -> str:
    """Header values hold no line ends."""
    return " ".join(str(value).split("\r")).replace("\n", " ").strip()


def record(row: dict) -> bytes:
    """A response holds an HTTP head and the payload; a revisit holds the head alone and names the response it stands for."""
    payload = row["payload"] or b""
    revisit = row["record_type"] == "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_length']}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: {row['record_id'] or record_id(row['page_id'])}", f"WARC-Date: {row['date'] or DATE}"]
    if row["target_uri"] is not None:
        head.append(f"WARC-Target-URI: {_clean(row['target_uri'])}")
    if row["page_id"] is not None:
        head.append(f"X-Page-Id: {row['page_id']}")
    head.append(f"WARC-Payload-Digest: {_b32(row['payload_digest'])}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(row['refers_to'])}", f"X-Refers-To-Page-Id: {row['refers_to']}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


class _Message(WriterCommitMessage):
    def __init__(self, names):
        self.names = names


class WarcWriter(DataSourceWriter):
    def __init__(self, path: str, archive: int):
        self.path, self.archive = path, archive

    def write(self, rows):
        from pyspark import TaskContext
        fs, top = _fs(self.path)
        fs.create_dir(top, recursive=True)
        stem = f"part-{TaskContext.get().partitionId():05d}-{TaskContext.get().taskAttemptId()}"
        out, names, size = None, [], 0
        try:
            for r in rows:
                if out is None:
                    names.append(f"{top}/_{stem}-{len(names):03d}.warc.gz")
                    out, size = fs.open_output_stream(names[-1], compression=None), 0
                data = member(record(r.asDict()))
                out.write(data)
                size += len(data)
                if size >= self.archive:
                    out.close()
                    out = None
        finally:
            if out is not None:
                out.close()
        return _Message(names)

    def commit(self, messages):
        """Archives take their names only now: those of lost or repeated tasks never become visible."""
        fs, _ = _fs(self.path)
        for m in messages:
            for name in m.names if m else ():
                folder, _, leaf = name.rpartition("/")
                fs.move(name, f"{folder}/{leaf[1:]}")

    def abort(self, messages):
        fs, _ = _fs(self.path)
        for m in messages:
            for name in m.names if m else ():
                fs.delete_file(name)


class _File(InputPartition):
    def __init__(self, path, start, stop):
        super().__init__(path)
        self.path, self.start, self.stop = path, start, stop


class WarcReader(DataSourceReader):
    """Plans a partition a file; ``payload`` is yes, no, or verify: inflate and hash it, compare with the header, don't return it."""

    def __init__(self, path: str, payload: str, pattern: str = ".warc"):
        self.path, self.payload, self.pattern = path, payload, pattern
        self.tests: list[tuple[str, set]] = []

    def pushFilters(self, filters):
        for f in filters:
            name = ".".join(getattr(f, "attribute", ()))
            if isinstance(f, EqualTo) and name in HEADER_COLUMNS:
                self.tests.append((name, {f.value}))
            elif isinstance(f, In) and name in HEADER_COLUMNS:
                self.tests.append((name, set(f.value)))
            else:
                yield f

    def partitions(self):
        from pyarrow import fs as pafs
        fs, top = _fs(self.path)
        found = fs.get_file_info(pafs.FileSelector(top, recursive=True, allow_not_found=True))
        files = sorted(f.path for f in found if f.is_file and self.pattern in f.base_name and f.base_name[0] not in "._")
        return [_File(p, 0, None) for p in files] or [_File("", 0, 0)]

    def read(self, partition):
        rows = []
        size = 0
        if partition.path:
            fs, _ = _fs(self.path)
            with fs.open_input_file(partition.path) as f:
                for row in records(f, self.tests, self.payload):
                    rows.append(row)
                    size += len(row["payload"] or b"")
                    if len(rows) >= 2000 or size > 8 << 20:
                        yield _to_batch(rows)
                        rows, size = [], 0
        if rows:
            yield _to_batch(rows)


_ARROW = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("date", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_length", pa.int64()), ("payload", pa.binary())])


def _to_batch(rows):
    return pa.RecordBatch.from_pylist(rows, _ARROW)


class _Bytes:
    """The records of one file as one run of bytes: of a plain file, or of gzip members that hold one record each or many."""

    def __init__(self, f):
        self.f, self.size, self.at = f, f.size(), 0
        f.seek(0)
        self.zipped = f.read(2) == b"\x1f\x8b"
        self.buf, self.z, self.start, self.first = b"", None, 0, False

    def more(self) -> bool:
        """Lengthen the buffer; False at the end of the file."""
        while True:
            if self.at >= self.size:
                if self.z is not None:
                    raise EOFError(f"the gzip member at byte {self.start} is cut off")
                return False
            if self.zipped and self.z is None:
                self.z, self.start, self.first, self.tail = zlib.decompressobj(31), self.at, not self.buf, b""
            self.f.seek(self.at)
            raw = self.f.read(16384)
            self.at += len(raw)
            if not self.zipped:
                self.buf += raw
                return True
            out = self.z.decompress(raw)
            if self.z.eof:
                self.at -= len(self.z.unused_data)
                self.z = None
            if out:
                self.buf += out
                return True

    def until(self, mark: bytes, most: int | None = None) -> bytes | None:
        """Bytes up to ``mark``, which is passed over; None if it doesn't come within ``most`` bytes or before the file's end."""
        seen = 0
        while True:
            k = self.buf.find(mark, max(0, seen - len(mark)))
            if k >= 0 and (most is None or k + len(mark) <= most):
                out, self.buf = self.buf[:k], self.buf[k + len(mark):]
                return out
            seen = len(self.buf)
            if (most is not None and seen >= most) or not self.more():
                return None

    def pieces(self, n: int):
        """The next ``n`` bytes."""
        while n:
            if not self.buf and not self.more():
                raise EOFError(f"a record of {self.f} is cut off")
            out, self.buf = self.buf[:n], self.buf[n:]
            n -= len(out)
            yield out

    def skip(self, n: int) -> None:
        k = min(n, len(self.buf))
        self.buf, n = self.buf[k:], n - k
        if not self.zipped:
            self.at += n
            if self.at > self.size:
                raise EOFError(f"a record of {self.f} is cut off")
            return
        for _ in self.pieces(n):
            pass

    def leave(self, start: int, length: int) -> None:
        """Go on behind the member at ``start``, without inflating what is left of it."""
        self.at, self.buf, self.z = start + length, b"", None


def _own_length(f, at: int) -> int | None:
    """The member's length from its extra field."""
    f.seek(at)
    head = f.read(512)
    if len(head) >= 12 and head[:3] == b"\x1f\x8b\x08" and head[3] & 4:
        n, = struct.unpack_from("<H", head, 10)
        extra, i = head[12:12 + n], 0
        while i + 4 <= len(extra):
            k, = struct.unpack_from("<H", extra, i + 2)
            if extra[i:i + 2] == b"SL" and k == 8:
                return struct.unpack_from("<Q", extra, i + 4)[0]
            i += 4 + k
    return None


def _number(text):
    return int(text) if text is not None and text.strip().lstrip("-").isdigit() else None


def records(f, tests, payload: str):
    """Rows of one archive. Headers come first; a payload that isn't wanted is passed over, unread in a plain file, and in a member of known length not inflated."""
    b = _Bytes(f)
    while True:
        while not b.buf.lstrip(b"\r\n"):  # what ends the record before
            b.buf = b""
            if not b.more():
                return
        b.buf = b.buf.lstrip(b"\r\n")
        start, known = b.start, _own_length(f, b.start) if b.zipped and b.first else None
        b.first = False
        head = b.until(b"\r\n\r\n")
        if head is None:
            raise EOFError(f"a record of {f} is cut off")
        lines = head.decode("utf-8", "replace").split("\r\n")
        h = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        kind, length = h.get("warc-type"), int(h.get("content-length", 0))
        row = {"record_id": h.get("warc-record-id"), "record_type": kind, "target_uri": h.get("warc-target-uri"), "date": h.get("warc-date"), "page_id": _number(h.get("x-page-id")), "refers_to": _number(h.get("x-refers-to-page-id")), "payload_digest": _hex(h.get("warc-payload-digest")), "payload_length": None, "payload": None}
        wanted = all(row[k] in v for k, v in tests if k != "payload_length")
        if wanted:
            http = "application/http" in h.get("content-type", "")
            inner = b.until(b"\r\n\r\n", length) if http else None
            if inner is not None:
                length -= len(inner) + 4
                for line in inner.split(b"\r\n")[1:] if kind == "revisit" else ():
                    if line[:15].lower() == b"content-length:":
                        row["payload_length"] = _number(line[15:].decode("ascii", "replace"))
            if row["payload_length"] is None:
                row["payload_length"] = length
            wanted = all(row[k] in v for k, v in tests)
            if wanted and payload != "no" and kind != "revisit":
                body, length = b"".join(b.pieces(length)), 0
                if payload == "yes":
                    row["payload"] = body
                elif len(body) != row["payload_length"] or hashlib.sha1(body).hexdigest() != row["payload_digest"]:
                    raise ValueError(f"record {row['record_id']}: the payload doesn't match its digest")
            if wanted:
                yield row
        if known is None:
            b.skip(length)
        else:
            b.leave(start, known)


class WarcDataSource(DataSource):
    """``format("warc")``; options: path, payload (yes, no, verify), archive_bytes."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema: StructType):
        return WarcReader(self.options["path"], self.options.get("payload", "yes"))

    def writer(self, schema: StructType, overwrite: bool):
        return WarcWriter(self.options["path"], int(self.options.get("archive_bytes", ARCHIVE)))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def page_records(pages: DataFrame, least: int = REVISIT, broadcast_rows: int = BROADCAST) -> DataFrame:
    """Pages as WARC records. Of equal payloads of ``least`` bytes or more, that with the largest page_id is the response.

    A null html is an empty payload.  Pages without page_id are always responses.  Equal rows with the same page_id are all responses.
    Digests and ids are shuffled to count copies.  Up to ``broadcast_rows`` digests that were met twice are broadcast then; beyond
    that they are joined by shuffle, payloads and all, where smaller payloads, never revisits, are dealt out by themselves.
    """
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("target_uri"), body.alias("payload"))
    p = p.withColumn("payload_digest", F.sha1("payload")).withColumn("payload_length", F.octet_length("payload").cast("long"))
    key = p.where(F.col("payload_length") >= least).groupBy("payload_digest").agg(F.max("page_id").alias("top"), F.count("*").alias("n")).where("n > 1 and top is not null").select(F.col("payload_digest").alias("d"), "top")
    key = materialize(key, "warc-copies")
    by = F.when(F.col("payload_length") >= least, F.col("payload_digest")).otherwise(F.concat(F.lit("#"), F.xxhash64("page_id", "target_uri")))
    p = p.withColumn("by", by).join(F.broadcast(key) if key.count() <= broadcast_rows else key.hint("merge"), F.col("by") == F.col("d"), "left")
    back = F.when(F.col("top") > F.col("page_id"), F.col("top"))
    p = p.withColumn("refers_to", back).withColumn("record_type", F.when(back.isNotNull(), "revisit").otherwise("response"))
    return p.select(F.lit(None).cast("string").alias("record_id"), "record_type", "target_uri", F.lit(None).cast("string").alias("date"), "page_id", "refers_to", "payload_digest", "payload_length", F.when(F.col("record_type") == "response", F.col("payload")).alias("payload"))


def write_archives(pages: DataFrame, path: str, least: int = REVISIT) -> None:
    register(pages.sparkSession)
    small_batches(pages.sparkSession)
    page_records(pages, least).write.format("warc").mode("append").save(path)


def read_archives(spark: SparkSession, path: str, payload: str = "yes") -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", payload).load(path)


def op2_warc(spark, sf_dir):
    path = new_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    release(spark)
    return read_archives(spark, path, "verify").select("page_id", F.col("payload_length").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


OP2_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
t AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND top > page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND top > page_id THEN top END AS refers_to
FROM t
"""
