"""Helpers that several corpus operators share: batches of bytes, words and hashes as arrays."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import zipfile
import zlib
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rackmeter.session import scratch_path

SLICE_BYTES = 2 << 20
WINDOW_BYTES = 4 << 20
MERGED_ROWS = 250_000
MASK64 = (1 << 64) - 1
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"

# White space that separates words (space, tab to carriage return).
WHITE = [0x20, *range(0x09, 0x0E)]
IS_WHITE = np.zeros(256, dtype=bool)
IS_WHITE[WHITE] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of unsigned 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


# Span hashes: two polynomials with symbols, bases and sums of their own, modulo the prime 2^31 - 1.
_PRIME = (1 << 31) - 1
_P, _SHIFT = np.uint64(_PRIME), np.uint64(31)
_BLOCK = 1 << 16


def _fold(x: np.ndarray) -> np.ndarray:
    """An equal value modulo the prime; below 2^33 for any x, below 2^31 + 4 for x below 2^33."""
    return (x & _P) + (x >> _SHIFT)


def _mod(x: np.ndarray) -> np.ndarray:
    x = _fold(_fold(x))
    return np.where(x >= _P, x - _P, x)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(1, dtype=np.uint64)
    while len(out) < n:
        out = np.concatenate([out, _mod(out * np.uint64(pow(base, len(out), _PRIME)))])
    return out[:n]


class _Lane:
    def __init__(self, seed: int) -> None:
        values = mix64(np.arange(1, 258, dtype=np.uint64) * np.uint64(seed | 1))
        self.base = int(values[256] % np.uint64(_PRIME - 2)) + 2
        self.symbols = values[:256] % np.uint64(_PRIME - 1) + np.uint64(1)
        self.symbols_lower = self.symbols[LOWER]
        self.up = _powers(self.base, _BLOCK)
        self.down = _powers(pow(self.base, -1, _PRIME), _BLOCK + 1)

    def power(self, exponents: np.ndarray) -> np.ndarray:
        out, square = np.ones(len(exponents), dtype=np.uint64), self.base
        left = exponents.copy()
        while left.any():
            out = np.where(left & 1, _mod(out * np.uint64(square)), out)
            left >>= 1
            square = square * square % _PRIME
        return out


_LANES = [_Lane(0xD1342543DE82EF95), _Lane(0xA24BAED4963EE407)]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False) -> np.ndarray:
    """64-bit hashes of ``data[start:end]``, equal for equal bytes (A-Z as a-z with ``fold``).

    The bytes are gone through in blocks, so that memory beyond the result does not grow with them.
    """
    sums = [np.zeros(len(starts), dtype=np.uint64) for _ in _LANES]
    if len(starts):
        in_order = bool((starts[1:] >= starts[:-1]).all() and (ends[1:] >= ends[:-1]).all())
        for low in range(int(starts.min()) // _BLOCK * _BLOCK, int(ends.max()), _BLOCK):
            high = min(low + _BLOCK, len(data))
            if in_order:
                some = slice(int(np.searchsorted(ends, low, "right")), int(np.searchsorted(starts, high, "left")))
            else:
                some = np.flatnonzero((starts < high) & (ends > low))
            first, last = np.maximum(starts[some], low) - low, np.minimum(ends[some], high) - low
            if not len(first):
                continue
            later = np.flatnonzero(starts[some] < low)  # spans that began in an earlier block
            for lane, out in zip(_LANES, sums):
                total = np.zeros(high - low + 1, dtype=np.uint64)
                symbols = lane.symbols_lower if fold else lane.symbols
                np.cumsum(_fold(symbols[data[low:high]] * lane.up[: high - low]), out=total[1:])
                part = _mod(_fold(_fold(total[last] - total[first])) * lane.down[first])
                if len(later):
                    part[later] = _mod(part[later] * lane.power(low - starts[some][later]))
                out[some] = _mod(out[some] + part)
    with np.errstate(over="ignore"):
        lengths = (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return mix64((sums[0] << np.uint64(32) | sums[1]) ^ mix64(lengths))


_GRAM_BASE = 0x9E3779B97F4A7C15
_GRAM_SYMBOL = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of all runs of ``size`` bytes, for runs of a few hundred bytes at most.

    Sums modulo 2^64: strings made for the purpose collide from some thousand bytes on, so longer ones use ``span_hashes``.
    """
    n = len(data) - size + 1
    out = np.zeros(max(0, n), dtype=np.uint64)
    if n <= 0:
        return out
    width = min(n, 1 << 18) + size
    with np.errstate(over="ignore"):
        up = np.cumprod(np.r_[np.uint64(1), np.full(width, _GRAM_BASE, dtype=np.uint64)], dtype=np.uint64)
        inverse = np.full(width, pow(_GRAM_BASE, -1, 1 << 64), dtype=np.uint64)
        down = np.cumprod(np.r_[np.uint64(1), inverse], dtype=np.uint64)
        for low in range(0, n, 1 << 18):
            m = min(n - low, 1 << 18)
            sums = np.zeros(m + size, dtype=np.uint64)
            np.cumsum(_GRAM_SYMBOL[data[low : low + m + size - 1]] * up[: m + size - 1], out=sums[1:])
            out[low : low + m] = mix64((sums[size:] - sums[:m]) * down[:m])
    return out


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document number of every word; a word never crosses documents."""
    n = len(data)
    if not n:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, empty
    black = ~IS_WHITE[data]
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = black[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = False
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = black[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts = np.flatnonzero(black & ~before)
    ends = np.flatnonzero(black & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def text_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A string column with nulls as empty texts."""
    column = batch.column(batch.schema.get_field_index(name))
    return pc.fill_null(column, "") if column.null_count else column


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of about ``limit`` bytes: first and last row, the bytes, offsets of the texts in them.

    Texts are whole: one longer than the limit makes a run of its own.
    """
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if not len(column):
        return
    ends = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    low = 0
    while low < len(column):
        high = max(low + 1, int(np.searchsorted(ends, ends[low] + limit, "right")) - 1)
        yield low, high, raw[ends[low] : ends[high]], ends[low : high + 1] - ends[low]
        low = high


def text_windows(
    column: pa.Array, breaks: np.ndarray, limit: int = WINDOW_BYTES
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Like ``text_slices``, but a text over the limit comes in windows that end behind a byte of ``breaks``.

    Nothing is cut that has no such byte inside. A window of a long text holds that row alone.
    """
    for low, high, data, offsets in text_slices(column, limit):
        if len(data) <= 2 * limit:
            yield low, high, data, offsets
            continue
        for start, end in break_windows(data, breaks, limit):
            yield low, high, data[start:end], np.array([0, end - start], dtype=np.int64)


def break_windows(data: np.ndarray, breaks: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Windows of at least ``limit`` bytes over all of ``data``, each but the last ending behind a byte of ``breaks``."""
    start = 0
    while start < len(data):
        end = start + limit
        while end < len(data):
            found = np.flatnonzero(breaks[data[end - 1 : end - 1 + limit]])
            if len(found):
                end += int(found[0])
                break
            end += limit
        end = min(end, len(data))
        yield start, end
        start = end


def string_array(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Strings of the given byte lengths that stand one after the other in ``data``."""
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.StringArray.from_buffers(len(lengths), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data)))


def merged_counts(
    parts: Iterator[tuple[pa.Array, pa.Array]], name: str, most: int = MERGED_ROWS, chunk: int = 50_000
) -> Iterator[pa.RecordBatch]:
    """Counts (``name``, n) of the values of a task; what is held at once is bounded, so a value may come again."""
    held: list[pa.Table] = []
    size = 0

    def merge() -> pa.Table:
        merged = pa.concat_tables(held).group_by(name).aggregate([("n", "sum")])
        return merged.rename_columns([name, "n"]).combine_chunks()

    for values, counts in parts:
        held.append(pa.table({name: values, "n": counts}))
        size += len(values)
        if size > most:
            held = [merge()]
            size = held[0].num_rows
            if size > most // 2:
                yield from held[0].to_batches(max_chunksize=chunk)
                held, size = [], 0
    if held:
        yield from merge().to_batches(max_chunksize=chunk)


def string_hashes(strings: pa.Array) -> np.ndarray:
    """64-bit hash of each string."""
    data, lengths = string_bytes(strings)
    ends = np.cumsum(lengths, dtype=np.int64)
    return span_hashes(data, ends - lengths, ends)


def string_bytes(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all strings one after the other, and the length of each."""
    offsets = np.frombuffer(strings.buffers()[1], dtype=np.int32)[strings.offset : strings.offset + len(strings) + 1]
    raw = strings.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], np.diff(offsets)


PACKED = "bucket int, lengths binary, strings binary, counts binary"


def packed(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Strings and counts as one row of ``PACKED`` for each bucket of a batch; equal strings share a bucket."""
    for batch in batches:
        strings, counts = batch.column(0), batch.column(1).to_numpy()
        bucket = (string_hashes(strings) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        strings, counts = strings.take(pa.array(order)), counts[order].astype(np.int64)
        data, lengths = string_bytes(strings)
        first = np.r_[group_starts(bucket[order]), len(order)]
        place = np.r_[0, np.cumsum(lengths, dtype=np.int64)]
        parts = list(zip(first[:-1].tolist(), first[1:].tolist()))
        yield pa.RecordBatch.from_arrays([
            pa.array(bucket[order][first[:-1]], pa.int32()),
            pa.array([lengths[a:b].astype(np.int32).tobytes() for a, b in parts], pa.binary()),
            pa.array([data[place[a] : place[b]].tobytes() for a, b in parts], pa.binary()),
            pa.array([counts[a:b].tobytes() for a, b in parts], pa.binary()),
        ], names=["bucket", "lengths", "strings", "counts"])


def unpacked_sums(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[pa.Table]:
    """Sums (``name``, n) of each bucket, for rows of ``PACKED`` sorted by bucket."""
    held: list[pa.Table] = []
    size, largest, now = 0, MERGED_ROWS, None

    def merge() -> pa.Table:
        return pa.concat_tables(held).group_by(name).aggregate([("n", "sum")]).rename_columns([name, "n"])

    for batch in batches:
        for bucket, lengths, strings, counts in zip(*(batch.column(i) for i in range(4))):
            if bucket.as_py() != now and held:
                yield merge()
                held, size, largest = [], 0, MERGED_ROWS
            now = bucket.as_py()
            values = string_array(np.frombuffer(strings.as_buffer(), dtype=np.uint8), np.frombuffer(lengths.as_buffer(), dtype=np.int32))
            held.append(pa.table({name: values, "n": np.frombuffer(counts.as_buffer(), dtype=np.int64)}))
            size += len(values)
            if size > largest:
                held = [merge()]
                size = held[0].num_rows
                largest = max(MERGED_ROWS, 2 * size)
    if held:
        yield merge()


def group_starts(keys: np.ndarray) -> np.ndarray:
    """First positions of the runs of equal values in a sorted array."""
    if not len(keys):
        return np.zeros(0, dtype=np.int64)
    return np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])


def crc_of_id(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode())


def id_crc(column: Column | str) -> Column:
    """crc32 of the id as text; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary") if isinstance(column, str) else column)


def held_out(column: str, modulus: int, remainder: int) -> Column:
    """Whether a document is kept out of training; a document without id is."""
    return F.coalesce(id_crc(column) % F.lit(modulus) == F.lit(remainder), F.lit(True))


def on_workers(df: DataFrame) -> DataFrame:
    """``df``, once the Python workers can import this package: Spark hands its files to every executor.

    Unless the session sets it, a batch for a worker is limited to 8 MB.
    """
    context = df.sparkSession.sparkContext
    if not getattr(context, "_package_shipped", False):
        package = Path(__file__).resolve().parent.parent
        target = Path(tempfile.mkdtemp()) / f"{package.name}.zip"
        with zipfile.ZipFile(target, "w") as out:
            for source in sorted(package.rglob("*.py")):
                out.write(source, source.relative_to(package.parent))
        context.addPyFile(str(target))
        context._package_shipped = True
    conf = df.sparkSession.conf
    if conf.get(_BATCH_BYTES) == "67108864b":  # the default: whole splits at once in each worker
        conf.set(_BATCH_BYTES, "8m")
    return df


def lean(function: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over batches that leaves nothing behind: a worker serves many tasks, of other operators too.

    At the end of the task the caches named by ``per_task`` are emptied and freed memory goes back to the system.
    """

    def run(batches: Iterator) -> Iterator:
        try:
            yield from function(batches)
        finally:
            for cache in _CACHES:
                cache.clear()
            give_back()

    return run


_CACHES: list[dict] = []


class Remembered(dict):
    """Results by word. Those of the generation before are kept too, so frequent ones are not worked out again."""

    def __init__(self, most: int) -> None:
        super().__init__()
        self.most, self.before = most, {}

    def age(self) -> None:
        if len(self) > self.most:
            self.before = dict(self)
            super().clear()

    def clear(self) -> None:
        super().clear()
        self.before = {}


def per_task(cache: dict) -> dict:
    """Names a cache of a module to be emptied at the end of each task."""
    _CACHES.append(cache)
    return cache


def give_back() -> None:
    """Returns freed memory to the system, where the platform can do so."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """The rows written to the shared scratch folder and read back, which cuts the lineage."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_row_keys(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with a column that tells rows apart, the same whenever it is worked out: file and place in the file.

    Rows that do not come straight from files are written and read back first.
    """
    place = lambda file, row: F.struct(file.alias("file"), row.alias("row"))
    try:
        return docs.withColumn(name, place(F.xxhash64("_metadata.file_path"), F.col("_metadata.row_index")))
    except AnalysisException:
        return stored(docs.withColumn(name, place(F.lit(0), F.monotonically_increasing_id())), "rows")


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and inner path of a folder that all executors share."""
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path if "://" in path else "file://" + path[5:])
    return pafs.LocalFileSystem(), path
