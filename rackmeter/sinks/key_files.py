"""Partition folders of many small files on a file system that all tasks mount (format ``key_files``).

Without native Hadoop libraries Spark's own writer starts three processes per file there, to set the rights of the folder, of
the file and of its checksum. With a folder per server that is most of the time of writing. Here a task writes the files of its
rows by Arrow, or as text. They are hidden until all tasks have succeeded; the driver, which gets only their names (packed, as
there may be very many), then makes them visible.
"""

from __future__ import annotations

import json
import os
import re
import sys
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from rackmeter.session import mounted_path

KEY = "_key_"
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"
# Characters that the names of partition folders hold as %XX.
ESCAPED = re.compile(r"""[\x01-\x1f"#%'*/:=?\\\x7f{\[\]^]""")
CODECS = {"snappy": "snappy", "gzip": "gzip", "zstd": "zstd", "none": "none", "uncompressed": "none"}
# Column types that Spark reads back from Arrow's files as it does from its own.
PLAIN = re.compile(r"string|boolean|tinyint|smallint|int|bigint|float|double|decimal\(.*\)|date|timestamp(_ntz)?")


def folder(keys: Sequence[str], values: Sequence[str | None]) -> str:
    """``run=0711/host=h1``, with the names that Spark gives to partition folders."""
    escaped = lambda name: ESCAPED.sub(lambda c: f"%{ord(c[0]):02X}", name)
    return "/".join(f"{escaped(k)}={escaped(v) if v else NO_VALUE}" for k, v in zip(keys, values))


def stretches(batch: pa.RecordBatch, width: int) -> Iterator[tuple[tuple[str | None, ...], pa.RecordBatch]]:
    """The keys and other columns of each stretch of rows whose first ``width`` columns are the same."""
    if not batch.num_rows:
        return
    ends = sorted({end for i in range(width) for end in pc.run_end_encode(batch.column(i), run_end_type=pa.int64()).run_ends.to_pylist()})
    rest = batch.select(batch.schema.names[width:])
    for low, high in zip([0, *ends], ends):
        yield tuple(batch.column(i)[low].as_py() for i in range(width)), rest.slice(low, high - low)


def joined(lines: pa.Array) -> memoryview:
    """The bytes of all strings of an array, one behind the other, as they lie there."""
    kind = np.int64 if pa.types.is_large_string(lines.type) else np.int32
    _, places, data = lines.buffers()
    ends = np.frombuffer(places, dtype=kind)[[lines.offset, lines.offset + len(lines)]]
    return memoryview(data or b"")[ends[0] : ends[1]]


class _File:
    """A file that is being written: Parquet, or the lines of its only column below the header, if there is one."""

    def __init__(self, path: str, schema: pa.Schema, form: str, codec: str, header: str):
        os.makedirs(os.path.dirname(path), exist_ok=True)
        self.packer = None
        if form == "parquet":
            self.out = pq.ParquetWriter(path, schema, compression=codec)
            self.add = self.out.write_batch
        else:
            self.out, self.add = open(path, "wb"), self.lines
            self.packer = zlib.compressobj(wbits=zlib.MAX_WBITS | 16) if codec == "gzip" else None
            self.put(header.encode())

    def put(self, text: bytes | memoryview) -> None:
        self.out.write(self.packer.compress(text) if self.packer else text)

    def lines(self, rows: pa.RecordBatch) -> None:
        self.put(joined(rows.column(0)))

    def close(self) -> None:
        if self.packer:
            self.out.write(self.packer.flush())
        self.out.close()


@dataclass
class Written(WriterCommitMessage):
    packed: bytes

    @classmethod
    def of(cls, names: Sequence[str]) -> Written:
        return cls(zlib.compress("\0".join(names).encode()))

    def names(self) -> list[str]:
        text = zlib.decompress(self.packed).decode()
        return text.split("\0") if text else []


class KeyFileWriter(DataSourceArrowWriter):
    """Takes the keys as text, then the columns of the files, in order of the keys."""

    def __init__(self, options: dict[str, str]):
        self.path, self.keys = options["path"], json.loads(options["keys"])
        self.form, self.codec, self.header, self.end = (options[name] for name in ("form", "codec", "header", "end"))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        name, names, out, last = f".part-{uuid.uuid4().hex}{self.end}", [], None, None
        try:
            for batch in iterator:
                for key, rows in stretches(batch, len(self.keys)):
                    if out is None or key != last:
                        if out:
                            out.close()
                        names.append(f"{folder(self.keys, key)}/{name}")
                        out, last = _File(f"{self.path}/{names[-1]}", rows.schema, self.form, self.codec, self.header), key
                    out.add(rows)
            if out:
                out.close()
        except BaseException:
            for some in names:
                if os.path.exists(f"{self.path}/{some}"):
                    os.remove(f"{self.path}/{some}")
            raise
        return Written.of(names)

    def _each(self, messages: list[Written | None]) -> Iterator[tuple[str, str]]:
        for message in messages:
            for name in message.names() if message else []:
                above, file = os.path.split(f"{self.path}/{name}")
                yield f"{above}/{file}", f"{above}/{file[1:]}"

    def commit(self, messages: list[Written | None]) -> None:
        os.makedirs(self.path, exist_ok=True)
        for hidden, shown in self._each(messages):
            os.rename(hidden, shown)
        open(f"{self.path}/_SUCCESS", "w").close()

    def abort(self, messages: list[Written | None]) -> None:
        for hidden, _ in self._each(messages):
            if os.path.exists(hidden):
                os.remove(hidden)


class KeyFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "key_files"

    def writer(self, schema: StructType, overwrite: bool) -> KeyFileWriter:
        return KeyFileWriter(dict(self.options))


def local_path(df: DataFrame, path: str) -> str | None:
    """The path on the mounted file system, None if it is on another one."""
    return mounted_path(df.sparkSession, path)


def can_write(df: DataFrame, path: str, keys: Sequence[str], fmt: str) -> bool:
    """Whether files of this kind with these columns can be written here, and Spark reads them like its own."""
    columns = [f for f in df.schema if f.name not in keys]
    codec = df.sparkSession.conf.get("spark.sql.parquet.compression.codec").lower()
    plain = set(keys) <= set(df.columns) and all(PLAIN.fullmatch(f.dataType.simpleString()) for f in columns)
    return bool(columns) and plain and (fmt == "csv" or fmt == "parquet" and codec in CODECS) and local_path(df, path) is not None


def write(df: DataFrame, path: str, keys: Sequence[str], fmt: str) -> None:
    """Add the rows as files below folders of the keys. A hot key may come from several tasks, each with its file."""
    spark = df.sparkSession
    names = [c for c in df.columns if c not in keys]
    columns, options = [F.col(f"`{c}`") for c in names], {}
    if fmt == "csv":
        columns = [_ended(F.to_csv(F.struct(*columns)))]
        titles = F.to_csv(F.struct(*[F.lit(c).alias(f"c{i}") for i, c in enumerate(names)]))
        options = {"form": "text", "header": spark.range(1).select(_ended(titles)).first()[0], "end": ".csv"}
    else:
        options["codec"] = CODECS[spark.conf.get("spark.sql.parquet.compression.codec").lower()]
    dealt = df.hint("rebalance", *keys).select(*_folders(keys), *columns)
    _save(dealt.sortWithinPartitions(*[f"`{KEY}{k}`" for k in keys]), path, keys, **options)


def write_lines(df: DataFrame, path: str, keys: Sequence[str], packed: bool = False) -> None:
    """Add the column ``line`` as text files below folders of the keys, gzipped if ``packed``.

    Rows are written as they are dealt and in their order; those of a key must lie together in a partition.
    """
    rows = df.select(*_folders(keys), _ended(F.col("line")))
    end = {"codec": "gzip", "end": ".txt.gz"} if packed else {"end": ".txt"}
    _save(rows, path, keys, form="text", **end)


def _ended(line: Column) -> Column:
    return F.concat(line, F.lit("\n")).alias("line")


def _folders(keys: Sequence[str]) -> list[Column]:
    """The keys as text; Spark has one folder for empty and missing values."""
    return [F.nullif(F.col(f"`{k}`").cast("string"), F.lit("")).alias(f"{KEY}{k}") for k in keys]


def _save(rows: DataFrame, path: str, keys: Sequence[str], form: str = "parquet", codec: str = "none", header: str = "", end: str = ".parquet") -> None:
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    rows.sparkSession.dataSource.register(KeyFiles)
    options = {"keys": json.dumps(list(keys)), "form": form, "codec": codec, "header": header, "end": end}
    rows.write.format("key_files").mode("append").options(**options).save(local_path(rows, path))
