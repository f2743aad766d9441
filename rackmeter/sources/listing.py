"""Listing of many files by tasks, on a file system that all tasks mount.

Spark lists a pattern of folders on the driver, which keeps several records per folder and file, and starts a task per
folder. Here the driver opens a pattern level by level only until there are more than a few folders. Tasks go on from there,
and what they find is a table that the driver need not hold.
"""

from __future__ import annotations

import os
import re
import sys
from collections.abc import Iterator, Sequence
from itertools import islice

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rackmeter.session import mounted_path, mounted_scratch, wide

SCHEMA = "file string, bytes long"
BATCH = 10_000
# In place of its size: a folder below a folder that was asked for.
NESTED = -1


def _hidden(name: str) -> bool:
    """Whether Spark leaves out files of this name."""
    left = name.startswith("_") and "=" not in name or name.startswith(".") or name.endswith("._COPYING_")
    return left and not name.startswith(("_common_metadata", "_metadata"))


def _there(entry: os.DirEntry) -> bool:
    return not entry.is_symlink() or os.path.exists(entry.path)


def _entries(folder: str, part: str, deeper: bool) -> Iterator[str]:
    """What one part of a pattern leads to from a folder; only folders if more parts follow."""
    if not re.search(r"[*?]", part):
        path = f"{folder}/{part}"
        if os.path.isdir(path) if deeper else os.path.exists(path):
            yield path
        return
    fits = re.compile("".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in part), re.DOTALL).fullmatch
    with os.scandir(folder or "/") as found:
        for entry in found:
            if fits(entry.name) and (entry.is_dir() if deeper else _there(entry)):
                yield f"{folder}/{entry.name}"


def _paths(folder: str, parts: Sequence[str], deeper: bool = False) -> Iterator[str]:
    """What some parts of a pattern lead to from a folder."""
    if not parts:
        yield folder
        return
    for path in _entries(folder, parts[0], deeper or len(parts) > 1):
        yield from _paths(path, parts[1:], deeper)


def _files(path: str) -> Iterator[tuple[str, int]]:
    """Name and size of a file, or of the files in a folder."""
    if not os.path.isdir(path):
        if not _hidden(os.path.basename(path)):
            yield path, os.path.getsize(path)
        return
    with os.scandir(path) as found:
        for entry in found:
            if not _hidden(entry.name):
                if entry.is_dir():
                    yield f"{path}/{entry.name}", NESTED
                elif _there(entry):
                    yield f"{path}/{entry.name}", entry.stat().st_size


def _begin(path: str, few: int) -> tuple[list[str], list[str]] | None:
    """The folders from which tasks go on, and the parts of the pattern that are left; None if the files are few."""
    parts = path.strip("/").split("/")
    found = [""]
    for k, part in enumerate(parts):
        more = list(islice((p for f in found for p in _entries(f, part, k + 1 < len(parts))), few + 1))
        if len(more) > few:
            return found, parts[k:]
        found = more
    files = islice((file for path in found for file in _files(path)), few + 1)
    return (found, []) if sum(1 for _ in files) > few else None


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    while some := list(islice(rows, BATCH)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some), schema)], schema=schema)


def many_files(spark: SparkSession, path: str, few: int) -> DataFrame | None:
    """Path and size of the files that a path or pattern leads to, as Spark lists them, written as a table by tasks.

    None if there are at most ``few``, or if the listing is better left to Spark: for other file systems, for patterns
    with other signs than ``*`` and ``?``, where files lie in deeper folders than those asked for, and where there are none.
    """
    local = mounted_path(spark, path)
    if local is None or re.search(r"[][{}\\]", local) or (begun := _begin(local, few)) is None:
        return None
    if (table := mounted_scratch(spark, "files")) is None:
        return None
    folders, parts = begun
    cloudpickle.register_pickle_by_value(sys.modules[__name__])

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((p,) for b in batches for f in b.column(0).to_pylist() for p in _paths(f, parts[:1], len(parts) > 1))
        yield from _batches(rows, pa.schema([("path", pa.string())]))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths = (p for b in batches for f in b.column(0).to_pylist() for p in _paths(f, parts[1:]))
        rows = ((f"file:{file}", size) for p in paths for file, size in _files(p))
        yield from _batches(rows, pa.schema([("file", pa.string()), ("bytes", pa.int64())]))

    tasks = wide(spark)
    paths = spark.createDataFrame([(f,) for f in folders], "path string").repartition(min(len(folders), tasks))
    if parts:
        paths = paths.mapInArrow(opened, "path string").repartition(tasks)
    # Not packed, so that the optimizer knows the size of the paths.
    paths.mapInArrow(listed, SCHEMA).write.option("compression", "none").parquet(f"file:{table}")
    files = spark.read.schema(SCHEMA).parquet(f"file:{table}")
    n, least = files.agg(F.count("*"), F.min("bytes")).first()
    return files if n and least != NESTED else None
