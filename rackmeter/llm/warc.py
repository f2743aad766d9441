"""WARC archives as a Spark data source (format ``warc``).

Reading: every partition is one file, or several small ones. Filters on the record type and on header
columns reach the reader, which parses the headers of a record first and goes on to the next record without
unpacking the rest where they fail, or where the schema that was asked for needs no payload. Records in
gzip members carry their packed length in the ``sl`` field of the gzip header; members without it
are unpacked to find their end. Records that are not packed are passed over by their length.

Writing: each task writes files of its own and names them to the driver, which makes them visible when all
tasks have succeeded; what failed tasks left behind is removed. Responses hold HTTP headers and payload. Revisits hold
the HTTP headers alone, whose Content-Length is that of the full payload, and name the response.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import sys
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone
from urllib.parse import quote

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In,
    InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringStartsWith, WriterCommitMessage,
)
from pyspark.sql.types import StructType

from rackmeter.llm import common
from rackmeter.llm.common import file_system, on_workers
from rackmeter.session import scratch_path

# Names and order of the header fields, and their columns.
VERSION = b"WARC/1.1"
HEADERS = {
    "record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "date": "WARC-Date",
    "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To", "content_type": "Content-Type",
    "content_length": "Content-Length",
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = (
    "record_type string, record_id string, target_uri string, date string, payload_digest string, refers_to string, "
    "content_type string, content_length long, payload_bytes long, actual_digest string, payload binary, "
    "file string, position long"
)
#: Columns that need more than the headers of the record and of its block.
FROM_PAYLOAD = {"payload", "actual_digest"}
FILE_BYTES = 64 << 20
PACK_BYTES = 32 << 20
HEAD = 4096


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# --- records ----------------------------------------------------------------------------------------


def record(kind: str, key: str, uri: str | None, payload: bytes, refers_to: str | None, date: str) -> bytes:
    """One record as it stands in an archive that is not packed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:record:{quote(key)}>"), ("WARC-Date", date)]
    if uri is not None:
        fields.append(("WARC-Target-URI", quote(uri, safe="%/:=&?~#+!$,;'@()*[]|")))
    fields.append(("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"))
    if refers_to is not None:
        fields += [("WARC-Refers-To", f"<urn:record:{quote(refers_to)}>"), ("WARC-Profile", PROFILE)]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = VERSION + b"\r\n" + "".join([f"{n}: {v}\r\n" for n, v in fields]).encode() + b"\r\n"
    return head + block + b"\r\n\r\n"


def packed(raw: bytes) -> bytes:
    """A gzip member whose header states its own length and that of the data."""
    squeeze = zlib.compressobj(1, zlib.DEFLATED, -zlib.MAX_WBITS)
    body = squeeze.compress(raw) + squeeze.flush()
    size = 10 + 2 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, size, len(raw) & 0xFFFFFFFF)
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra
    return head + body + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines[1:])}


class _Plain:
    """Records of a file that is not packed."""

    def __init__(self, source: io.BufferedReader):
        self.source, self.at = source, 0

    def head(self) -> bytes | None:
        self.source.seek(self.at)
        self.start, self.seen = self.at, b""
        while b"\r\n\r\n" not in self.seen:
            more = self.source.read(HEAD)
            if not more:
                return None
            self.seen += more
        return self.seen[: self.seen.index(b"\r\n\r\n") + 4]

    def more(self, size: int) -> bytes:
        """The first ``size`` bytes of the record."""
        if len(self.seen) < size:
            self.seen += self.source.read(size - len(self.seen))
        return self.seen[:size]

    def skip(self, size: int) -> None:
        self.at = self.start + size


class _Packed:
    """Records in gzip members."""

    def __init__(self, source: io.BufferedReader):
        self.source, self.at = source, 0

    def head(self) -> bytes | None:
        self.source.seek(self.at)
        self.start = self.at
        first = self.source.read(24)
        if not first:
            return None
        self.length = None
        if first[3] & 4 and first[12:14] == b"sl":
            self.length = struct.unpack("<I", first[16:20])[0]
        self.unpack, self.seen = zlib.decompressobj(zlib.MAX_WBITS | 16), b""
        self.rest = first
        while b"\r\n\r\n" not in self.seen:
            before = len(self.seen)
            self._grow(before + HEAD)
            if len(self.seen) == before:
                raise ValueError(f"record without end of headers at {self.start}")
        return self.seen[: self.seen.index(b"\r\n\r\n") + 4]

    def _grow(self, size: int) -> None:
        parts, have = [self.seen], len(self.seen)
        while have < size and not self.unpack.eof:
            if not self.rest:
                self.rest = self.source.read(max(HEAD, min(1 << 20, size - have)))
                if not self.rest:
                    break
            out = self.unpack.decompress(self.rest, size - have)
            self.rest = self.unpack.unconsumed_tail
            parts.append(out)
            have += len(out)
        self.seen = b"".join(parts)

    def more(self, size: int) -> bytes:
        self._grow(size)
        return self.seen[:size]

    def skip(self, size: int) -> None:
        if self.length is None:
            self._grow(size)
            while not self.unpack.eof:
                self.rest = self.rest or self.source.read(1 << 16)
                self.unpack.decompress(self.rest)
                self.rest = self.unpack.unconsumed_tail
            self.length = self.source.tell() - len(self.unpack.unused_data) - self.start
        self.at = self.start + self.length


def records(source: io.BufferedReader, wanted: set[str], keep) -> Iterator[dict]:
    """Columns of the records whose headers ``keep`` accepts."""
    magic = source.read(2)
    walk = (_Packed if magic == b"\x1f\x8b" else _Plain)(source)
    while (head := walk.head()) is not None:
        fields = _fields(head)
        row = {column: fields.get(name.lower()) for column, name in HEADERS.items()}
        length = int(row["content_length"] or 0)
        row["content_length"] = length
        row["payload_digest"] = row["payload_digest"] and row["payload_digest"].removeprefix("sha1:")
        row["position"] = walk.start
        if keep(row):
            http, size = b"", 0
            if (row["content_type"] or "").startswith("application/http") and wanted & (FROM_PAYLOAD | {"payload_bytes"}):
                step = HEAD
                while b"\r\n\r\n" not in http and size < length:
                    size = min(length, size + step)
                    http = walk.more(len(head) + size)[len(head) :]
                    step *= 2
                at = http.find(b"\r\n\r\n")
                http = http[: at + 4] if at >= 0 else b""
            row["payload_bytes"] = length - len(http)
            if row["record_type"] == "revisit":
                stated = _fields(http).get("content-length") if http else None
                row["payload_bytes"] = int(stated) if stated else None
            elif wanted & FROM_PAYLOAD:
                payload = walk.more(len(head) + length)[len(head) + len(http) :]
                row["payload"] = payload
                if "actual_digest" in wanted:
                    row["actual_digest"] = base32_sha1(payload)
            yield row
        walk.skip(len(head) + length + 4)


# --- the data source --------------------------------------------------------------------------------


def _test(filter_: Filter):
    """The check of one pushed filter on a row of header columns, or None where it must stay with Spark."""
    name = filter_.attribute[0] if len(filter_.attribute) == 1 else None
    if name not in HEADERS:
        return None
    known = {
        EqualTo: lambda v, x: v == x, GreaterThan: lambda v, x: v > x, GreaterThanOrEqual: lambda v, x: v >= x,
        LessThan: lambda v, x: v < x, LessThanOrEqual: lambda v, x: v <= x,
        StringStartsWith: lambda v, x: v.startswith(x), In: lambda v, x: v in x,
    }
    if isinstance(filter_, IsNotNull):
        return lambda row: row[name] is not None
    check = known.get(type(filter_))
    return check and (lambda row: row[name] is not None and check(row[name], filter_.value))


@dataclass
class Files(InputPartition):
    paths: list[str]


class WarcReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.names, self.filters = path, schema.fieldNames(), []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for one in filters:
            if _test(one):
                self.filters.append(one)
            else:
                yield one

    def partitions(self) -> list[Files]:
        fs, path = file_system(self.path)
        import pyarrow.fs as pafs

        infos = fs.get_file_info(pafs.FileSelector(path, recursive=True))
        plan, held = [], 0
        for info in sorted(infos, key=lambda i: i.path):
            if info.is_file and info.base_name.endswith((".warc", ".warc.gz")) and not info.base_name.startswith("."):
                if not plan or held + info.size > PACK_BYTES:
                    plan.append(Files([]))
                    held = 0
                plan[-1].paths.append(info.path)
                held += info.size
        return plan or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(self.path)
        tests = [_test(f) for f in self.filters]
        kinds = {f.name: f.type for f in _ARROW}
        wanted = set(self.names)
        rows, held = [], 0
        for path in partition.paths:
            with io.BufferedReader(fs.open_input_file(path), 1 << 18) as source:
                for row in records(source, wanted, lambda r: all(t(r) for t in tests)):
                    row["file"] = path
                    rows.append(row)
                    held += len(row.get("payload") or b"") if "payload" in wanted else 1000
                    if held > 4 << 20:
                        yield self._batch(rows, kinds)
                        rows, held = [], 0
        yield self._batch(rows, kinds)

    def _batch(self, rows: list[dict], kinds: dict) -> pa.RecordBatch:
        columns = [pa.array([r.get(n) for r in rows], kinds[n]) for n in self.names]
        return pa.RecordBatch.from_arrays(columns, names=self.names)


_ARROW = [
    pa.field(part.split()[0], {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[part.split()[1]])
    for part in SCHEMA.split(", ")
]


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class WarcWriter(DataSourceArrowWriter):
    """Takes columns key, uri, payload, refers_to (all but payload as text)."""

    def __init__(self, path: str, pack: bool):
        self.path, self.pack = path, pack

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, path = file_system(self.path)
        fs.create_dir(path, recursive=True)
        date = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
        names, out, size = [], None, 0
        for batch in iterator:
            columns = [batch.column(n) for n in ("key", "uri", "payload", "refers_to")]
            for key, uri, payload, refers_to in zip(*columns):
                if out is None:
                    names.append(f".{uuid.uuid4().hex}.warc" + ".gz" * self.pack)
                    out, size = fs.open_output_stream(f"{path}/{names[-1]}", compression=None), 0
                first = refers_to.as_py()
                kind = "response" if first is None else "revisit"
                raw = record(kind, key.as_py() or "", uri.as_py(), payload.as_py() or b"", first, date)
                raw = packed(raw) if self.pack else raw
                out.write(raw)
                size += len(raw)
                if size >= FILE_BYTES:
                    out.close()
                    out = None
        if out:
            out.close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        fs, path = file_system(self.path)
        for message in messages:
            for name in message.names if message else []:
                fs.move(f"{path}/{name}", f"{path}/{name[1:]}")

    def abort(self, messages: list[Written | None]) -> None:
        fs, path = file_system(self.path)
        for message in messages:
            for name in message.names if message else []:
                fs.delete_file(f"{path}/{name}")


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], self.options.get("pack", "true") == "true")


def register(spark: SparkSession) -> None:
    """Make the format known; its classes go to all Python processes by value, also to those that plan."""
    for module in (sys.modules[__name__], common):
        cloudpickle.register_pickle_by_value(module)
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_warc(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Records below ``path``; without payload columns among ``columns`` no payload is unpacked."""
    register(spark)
    kinds = {part.split()[0]: part for part in SCHEMA.split(", ")}
    return spark.read.format("warc").schema(", ".join(kinds[c] for c in columns or kinds)).load(path)


def write_warc(
    pages: DataFrame, path: str, key: str = "page_id", uri: str = "url", html: str = "html", least_bytes: int = 0,
    pack: bool = True,
) -> None:
    """Write one record per row; of equal payloads the one with the smallest key is the response.

    Payloads are the html in UTF-8 (null: empty). Rows whose payload is shorter than ``least_bytes``, rows
    that repeat the smallest key, and rows without a key are all responses. Equal payloads are found by their SHA-1, and a
    payload that very many rows share is spread over tasks, as only its smallest key is looked up.
    """
    register(pages.sparkSession)
    rows = on_workers(pages).select(
        F.col(key).alias("key"), F.col(uri).cast("string").alias("uri"),
        F.coalesce(F.encode(F.col(html), "UTF-8"), F.lit(b"")).alias("payload"),
    ).withColumn("sha1", F.sha1("payload"))
    firsts = rows.groupBy("sha1").agg(F.min("key").alias("first"))
    again = (F.col("first") < F.col("key")) & (F.octet_length("payload") >= least_bytes)
    rows.join(firsts, "sha1", "left").select(
        F.col("key").cast("string").alias("key"), "uri", "payload",
        F.when(again, F.col("first").cast("string")).alias("refers_to"),
    ).write.format("warc").mode("append").option("pack", str(pack).lower()).save(path)


def archived(pages: DataFrame, path: str | None = None, **how) -> DataFrame:
    """Write the pages and read the archives back: key (text), payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write_warc(pages, path, **how)
    names = ["record_type", "record_id", "payload_digest", "refers_to", "payload_bytes"]
    full = read_warc(spark, path, [*names, "actual_digest"]).where("record_type = 'response'")
    again = read_warc(spark, path, names).where("record_type = 'revisit'")
    key = lambda c: F.url_decode(F.regexp_extract(c, "^<urn:record:(.*)>$", 1))
    return full.withColumn("payload_digest", F.col("actual_digest")).select(names).unionAll(again).select(
        key("record_id").alias("key"), "payload_bytes", "payload_digest", "record_type", key("refers_to").alias("refers_to")
    )
