"""A batch source of text lines with their true places: the byte at which a line starts and the one at which the next does.

Files are planned as byte ranges. A line belongs to the range that holds its first byte, and the task of that range reads
on to the line's end, so places and lines are the same for every way to cut a file. Lines end with a line feed, a carriage
return, or both.

A gzip file can only be unpacked from the start of a member. Files of many members (as written by log rotation or block
compressors) are indexed first: tasks look for members in ranges of the packed bytes and keep those that unpack
without an error up to their checksum; of members within others only the outer ones are real. Each range
of members is then read by itself, at its true place in the unpacked text. A file of one member is one range.
"""

from __future__ import annotations

import json
import os
import sys
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from rackmeter.schemas import LINE_SCHEMA
from rackmeter.session import wide

CHUNK = 1 << 20
FEED, RETURN = 10, 13
MAGIC = b"\x1f\x8b\x08"
HEADER = 10
# Of many small files so many make a task, though Spark's setting for the cost of opening one may ask for fewer.
FILES = 512
# How the bytes before a range end.
INSIDE, FRESH, AFTER_RETURN = 0, 1, 2


def open_file(path: str) -> pa.NativeFile:
    """A file by the path that Spark lists it under."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem().open_input_file("/" + path[5:].lstrip("/"))
    if "://" in path:
        system, inner = pafs.FileSystem.from_uri(path)
        return system.open_input_file(inner)
    return pafs.LocalFileSystem().open_input_file(path)


class _Unpacked:
    """Unpacked bytes of a gzip file from a member on; bytes behind the last member are left out."""

    def __init__(self, source: pa.NativeFile, start: int):
        self.source, self.held, self.place = source, b"", start
        self.member: zlib._Decompress | None = None
        source.seek(start)

    def _more(self) -> bool:
        part = self.source.read(CHUNK)
        self.held += part
        return bool(part)

    def read(self, size: int) -> bytes:
        """Up to ``size`` bytes, none only at the end; ``member`` is None where a member has just ended."""
        while True:
            if self.member is None:
                if len(self.held) < HEADER and self._more():
                    continue
                if not self.held.startswith(MAGIC):
                    return b""
                self.member = zlib.decompressobj(zlib.MAX_WBITS | 16)
            if not self.held and not self._more():
                raise EOFError("a gzip member is cut off")
            before = len(self.held)
            out = self.member.decompress(self.held, size)
            self.held = self.member.unused_data if self.member.eof else self.member.unconsumed_tail
            self.place += before - len(self.held)
            if self.member.eof:
                self.member = None
            if out:
                return out


def cut_lines(
    read: Callable[[int], bytes], base: int, state: int, limit: int
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Whole lines that start from ``base`` to before ``limit``: their bytes joined, their lengths, and their places.

    ``read`` gives the bytes from ``base`` on; places hold one entry more than there are lines, where the last line ends.
    """
    held, at, ended = b"", base, False
    while not ended and (at < limit or state != FRESH):
        wanted = min(CHUNK, max(limit - at - len(held), 0) + 1024)
        part = read(max(wanted, len(held)))
        ended = not part
        held += part
        data = np.frombuffer(held, dtype=np.uint8)
        if state == AFTER_RETURN and len(data):
            skip = int(data[0] == FEED)
            held, at, state = held[skip:], at + skip, FRESH
            data = data[skip:]
        back, feed = data == RETURN, data == FEED
        if len(data) and not ended:
            back[-1] &= False  # a line feed may follow
        pair = np.zeros(len(data), dtype=bool)
        pair[:-1] = back[:-1] & feed[1:]
        alone = feed.copy()
        alone[1:] &= ~(data[:-1] == RETURN)
        ends = np.flatnonzero(back | alone)
        nexts = ends + 1 + pair[ends]
        if ended and len(data) and (not len(nexts) or nexts[-1] < len(data)):
            ends, nexts = np.r_[ends, len(data)], np.r_[nexts, len(data)]
        if not len(nexts):
            continue
        starts = np.r_[0, nexts[:-1]]
        first = 0
        if state == INSIDE:
            first, state = 1, FRESH
        last = int(np.searchsorted(starts, limit - at))
        if last > first:
            keep = np.ones(int(nexts[last - 1]), dtype=bool)
            keep[: starts[first]] = False
            keep[ends[first:last][ends[first:last] < len(keep)]] = False
            keep[nexts[first:last][pair[np.minimum(ends[first:last], len(pair) - 1)]] - 1] = False
            places = np.r_[starts[first:last], nexts[last - 1]] + at
            yield data[: len(keep)][keep], ends[first:last] - starts[first:last], places
        if last < len(starts):
            return
        held, at = held[int(nexts[-1]) :], at + int(nexts[-1])


Range = tuple[str, bool, int, int, int, int]


@dataclass
class Ranges(InputPartition):
    """Ranges of one task: (file, packed, first byte to read, first and last place, state before).

    They may also stand in a list file: its path, their first byte there and their length.
    """

    ranges: list[Range]
    listed: tuple[str, int, int] | None = None

    def all(self) -> Iterator[Range]:
        yield from self.ranges
        if self.listed:
            path, start, length = self.listed
            with open_file(path) as source:
                yield from json.loads(source.read_at(length, start))


def ranges_of(path: str, size: int, members: Sequence[Sequence[int]], most: int) -> Iterator[tuple[int, Range]]:
    """The ranges of a file, each with the bytes it holds."""
    if members:
        for start, end, low, high, state in members:
            yield end - start, (path, True, start, low, high, state)
    elif path.endswith(".gz"):
        yield size, (path, True, 0, 0, 1 << 62, FRESH)
    else:
        for low in range(0, max(size, 1), most):
            high = min(low + most, size)
            yield high - low, (path, False, max(low - 1, 0), low, high, INSIDE if low else FRESH)


def together(ranges: Iterable[tuple[int, Range]], most: int, cost: int) -> Iterator[list[Range]]:
    """Large ranges by themselves, small ones together; opening one counts as ``cost`` bytes."""
    part, held = [], 0
    for weight, one in ranges:
        if part and held + weight > most:
            yield part
            part, held = [], 0
        part.append(one)
        held += weight + cost
    if part:
        yield part


class LineReader(DataSourceReader):
    def __init__(self, options: dict):
        self.files, self.lists = json.loads(options["files"]), json.loads(options.get("lists", "[]"))
        self.size, self.cost = int(options["rangebytes"]), int(options["opencost"])

    def __getstate__(self) -> dict:
        """What tasks need; the list of all files stays where partitions are planned."""
        return {name: value for name, value in self.__dict__.items() if name not in ("files", "lists")}

    def partitions(self) -> list[Ranges]:
        """Large files in ranges, small ones together."""
        ranges = (one for path, size, members in self.files for one in ranges_of(path, size, members, self.size))
        parts = [Ranges(part) for part in together(ranges, self.size, self.cost)]
        return parts + [Ranges([], tuple(one)) for one in self.lists] or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        for path, packed, first, low, high, state in partition.all():
            with open_file(path) as source:
                if packed:
                    read = _Unpacked(source, first).read
                else:
                    source.seek(first)
                    read = source.read
                for data, lengths, places in cut_lines(read, low if packed else first, state, high):
                    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
                    np.cumsum(lengths, out=offsets[1:])
                    n = len(lengths)
                    lines = pa.StringArray.from_buffers(n, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data)))
                    columns = [pa.repeat(pa.scalar(path, pa.string()), n), pa.array(np.full(n, low)), pa.array(places[:-1]), pa.array(places[1:]), lines]
                    yield pa.RecordBatch.from_arrays(columns, names=["file", "split", "pos", "next", "line"])


class LineSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "byte_lines"

    def schema(self) -> str:
        return LINE_SCHEMA

    def reader(self, schema: StructType) -> LineReader:
        return LineReader(dict(self.options))


def _by_value() -> None:
    """The code of this module goes to all Python processes with the task, also to those that plan."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])


def members(ranges: DataFrame) -> DataFrame:
    """Real gzip members that start in the ranges (file, low, high): file, start, end, size unpacked, last byte."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, low, high in zip(*(batch.column(i).to_pylist() for i in range(3))):
                with open_file(path) as source:
                    at = low
                    while (at := _candidate(source, at, high)) >= 0:
                        found = _member(source, at)
                        rows += [(path, at, *found)] if found else []
                        at = found[0] if found else at + 1
            columns = list(zip(*rows)) or [()] * 5
            kinds = [pa.string(), *[pa.int64()] * 3, pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    _by_value()
    names = ["file", "start", "end", "size", "last"]
    found = ranges.mapInArrow(find, "file string, start long, end long, size long, last int")
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    outer = F.col("start") >= F.coalesce(F.max("end").over(before), F.lit(0))
    return found.withColumn("outer", outer).where("outer").drop("outer")


def _candidate(source: pa.NativeFile, low: int, high: int) -> int:
    """First place from ``low`` to before ``high`` where a member's header may stand, or -1."""
    while low < high:
        data = source.read_at(CHUNK + HEADER, low)
        at = data.find(MAGIC)
        while 0 <= at < CHUNK and low + at < high:
            if len(data) >= at + HEADER and data[at + 3] < 0x20:
                return low + at
            at = data.find(MAGIC, at + 1)
        low += CHUNK
    return -1


def _member(source: pa.NativeFile, start: int) -> tuple[int, int, int] | None:
    """End, unpacked size and last unpacked byte of the member that starts here; None if there is none."""
    unpacked, size, last = _Unpacked(source, start), 0, -1
    try:
        while part := unpacked.read(CHUNK):
            size, last = size + len(part), part[-1]
            if unpacked.member is None:
                break
    except (zlib.error, EOFError):
        return None
    return (unpacked.place, size, last) if unpacked.member is None and unpacked.place > start else None


def member_ranges(spark: SparkSession, files: Sequence[tuple[str, int]], range_bytes: int) -> dict[str, list[list[int]]]:
    """Of large gzip files: packed start and end, unpacked start and end, and state before, of runs of members.

    Runs hold about ``range_bytes`` of packed bytes, so the driver gets as many rows as it plans tasks.
    """
    listed = spark.createDataFrame([(f, n) for f, n in files], "file string, bytes long")
    low = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(range_bytes)))
    ranges = listed.select("file", "bytes", low.alias("low")).select("file", "low", F.least(F.col("low") + range_bytes, "bytes").alias("high"))
    count = sum(-(-n // range_bytes) for _, n in files)
    found = members(ranges.repartition(max(1, count), "file", "low"))
    in_order = Window.partitionBy("file").orderBy("start")
    upto = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    state = F.lag("last").over(in_order)
    placed = found.select(
        "file", "start", "end", F.sum("size").over(upto).alias("high"), "size",
        F.when(state.isNull() | (state == FEED), FRESH).when(state == RETURN, AFTER_RETURN).otherwise(INSIDE).alias("state"),
        F.floor(F.col("start") / range_bytes).alias("run"),
    )
    runs = placed.groupBy("file", "run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.min(F.col("high") - F.col("size")).alias("low"),
        F.max("high").alias("high"), F.min_by("state", "start").alias("state"),
    )
    out: dict[str, list[list[int]]] = {}
    for r in runs.orderBy("file", "start").collect():
        out.setdefault(r.file, []).append([r.start, r.end, r.low, r.high, r.state])
    return out


def first_lines(files: DataFrame) -> DataFrame:
    """First line (``head``) of each file (file, bytes) with its size; files without a line are left out. Reads no further."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with open_file(path) as source:
                    more = _Unpacked(source, 0).read if path.endswith(".gz") else source.read
                    for data, lengths, _ in cut_lines(more, 0, FRESH, 1):
                        rows.append((path, size, data[: lengths[0]].tobytes().decode("utf-8", "replace")))
            columns = list(zip(*rows)) or [(), (), ()]
            kinds = [pa.string(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["file", "bytes", "head"])

    _by_value()
    return files.select("file", "bytes").mapInArrow(read, "file string, bytes long, head string")


def lines_of(spark: SparkSession, files: Sequence[tuple[str, int]], range_bytes: int, open_cost: int) -> DataFrame:
    """Lines of files (path, bytes) with their places."""
    return _load(spark, _plan(spark, files, range_bytes), [], range_bytes, open_cost)


def lines_of_many(files: DataFrame, path: str, range_bytes: int, open_cost: int) -> DataFrame:
    """Lines of many files (file, bytes) with their places.

    Tasks put the ranges together and write them to list files below ``path``; the driver gets where those of a task stand.
    Only large gzip files, which are tasks of their own, are planned there.
    """
    spark = files.sparkSession
    large = F.col("file").endswith(".gz") & (F.col("bytes") > range_bytes)
    packed = [(r.file, r.bytes) for r in files.where(large).orderBy("file").collect()]
    cost = min(open_cost, range_bytes // FILES)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = (one for b in batches for one in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        ranges = (one for file, size in some for one in ranges_of(file, size, (), range_bytes))
        name, rows, at = f"{path}/{uuid.uuid4().hex}", [], 0
        os.makedirs(path, exist_ok=True)
        with open(name, "wb") as out:
            for part in together(ranges, range_bytes, cost):
                text = json.dumps(part).encode()
                out.write(text)
                rows.append((name, at, len(text)))
                at += len(text)
        columns = list(zip(*rows)) or [(), (), ()]
        kinds = [pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["list", "start", "length"])

    _by_value()
    dealt = files.where(~large).select("file", "bytes").repartition(wide(spark), "file").sortWithinPartitions("file")
    lists = dealt.mapInArrow(put, "list string, start long, length long").collect()
    return _load(spark, _plan(spark, packed, range_bytes), [tuple(r) for r in lists], range_bytes, open_cost)


def _plan(spark: SparkSession, files: Sequence[tuple[str, int]], range_bytes: int) -> list[list]:
    """Path, size and members of files."""
    packed = [f for f in files if f[0].endswith(".gz") and f[1] > range_bytes]
    index = member_ranges(spark, packed, range_bytes) if packed else {}
    return [[path, size, index.get(path, [])] for path, size in files]


def _load(spark: SparkSession, plan: list[list], lists: list[tuple], range_bytes: int, open_cost: int) -> DataFrame:
    _by_value()
    spark.dataSource.register(LineSource)
    options = {"files": json.dumps(plan), "lists": json.dumps(lists), "rangebytes": str(range_bytes), "opencost": str(open_cost)}
    return spark.read.format("byte_lines").options(**options).load()
