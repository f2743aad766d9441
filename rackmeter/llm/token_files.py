"""Token-id files with a minimal perfect hash index for access by document key.

A *store* is a folder with three parts:

``shards/NAME.ids``   raw ids of consecutive documents (little-endian, 2 bytes each where the vocabulary
                      allows, else 4), after them the length of each document, at the end a footer
``entries``           a table with a row per document: key, shard, place in the shard, length
``index/NAME.mph``    minimal perfect hash functions over the keys, one file per key bucket, with a
                      fingerprint and a place (shard, ordinal, offset, copies) per slot

Documents stand in ascending order of their keys, rows of equal keys in the order of their texts, and
shard names ascend likewise. A key that several rows share has one slot that leads to the first of
them; a shard never ends between them. Null texts are empty documents (the end id alone); a null key
sorts first and is found like any other. Tasks write under names of their own, and only files named
in ``entries`` count, so a task that is run again leaves no second copy behind.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rackmeter.llm.common import Remembered, file_system, lean, mix64, on_workers, text_column

MAGIC = b"IDSHARD1"
FOOTER = "<8sBxxxxxxxQQ"
SHARD_TOKENS = 4 << 20
BUCKET_KEYS = 16_384
CACHED_WORDS = 250_000
ROWS = 256


class _Pieces(Remembered):
    """Ids of pre-tokens in lower case, from the library's model as they are first needed."""

    def __init__(self, model, code: str):
        super().__init__(CACHED_WORDS)
        self.model, self.code = model, code

    def __missing__(self, piece: str) -> bytes:
        if (found := self.before.get(piece)) is not None:
            self[piece] = found
            return found
        mapped = piece if piece.isascii() else "".join([BYTE_CHARACTERS[b] for b in piece.encode()])
        found = self[piece] = array(self.code, [t.id for t in self.model.tokenize(mapped)]).tobytes()
        return found


class _Words(Remembered):
    """Ids of words. Latin words are cut into pre-tokens here; all others go through the whole tokenizer."""

    def __init__(self, tokenizer, pieces: _Pieces):
        super().__init__(CACHED_WORDS)
        self.tokenizer, self.pieces = tokenizer, pieces

    def __missing__(self, word: str) -> bytes:
        if (found := self.before.get(word)) is not None:
            pass
        elif LATIN_WORD.fullmatch(word) and "<|" not in word:
            found = b"".join(map(self.pieces.__getitem__, PRE_TOKEN.findall(word.lower())))
        else:
            found = array(self.pieces.code, self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        self[word] = found
        return found


# How the tokenizer file cuts words, for printable characters up to U+012F, of which neither
# composition nor lower case depends on context; and its characters for the 256 bytes.
LATIN_WORD = re.compile("[!-~\u00c0-\u012f]+")
_LETTER = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f"
PRE_TOKEN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[0-9]|[^{_LETTER}0-9]+")
_OWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_OTHER = [b for b in range(256) if b not in _OWN]
BYTE_CHARACTERS = {b: chr(b) for b in _OWN} | {b: chr(256 + n) for n, b in enumerate(_OTHER)}


class WordEncoder:
    """Encodes whole texts by way of their words.

    The tokenizer never joins characters across white space, so the ids of a text are those of its words
    one after another. Each word is encoded by the library once and remembered.
    """

    def __init__(self, path: str, width: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.pieces = _Pieces(tokenizer.model, "H" if width == 2 else "I")
        self.words = _Words(tokenizer, self.pieces)

    def encode(self, text: str) -> bytes:
        self.words.age()
        self.pieces.age()
        return b"".join(map(self.words.__getitem__, text.replace("\n", " ").split(" ")))


_ENCODERS: dict[tuple[str, int], WordEncoder] = {}


def encoder(path: str, width: int) -> WordEncoder:
    if (path, width) not in _ENCODERS:
        _ENCODERS[path, width] = WordEncoder(path, width)
    return _ENCODERS[path, width]


def id_width(path: str) -> int:
    """Bytes per stored id."""
    from tokenizers import Tokenizer

    return 2 if Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4


class _Shard:
    """A shard file being written."""

    def __init__(self, base: str, name: str, width: int):
        self.name, self.width, self.tokens, self.lengths = name, width, 0, []
        fs, path = file_system(base)
        fs.create_dir(f"{path}/shards", recursive=True)
        self.out = fs.open_output_stream(f"{path}/shards/{name}.ids")

    def add(self, ids: bytes) -> tuple[int, int, int]:
        place = len(self.lengths), self.tokens, len(ids) // self.width
        self.out.write(ids)
        self.lengths.append(place[2])
        self.tokens += place[2]
        return place

    def close(self) -> None:
        self.out.write(np.array(self.lengths, dtype="<u4").tobytes())
        self.out.write(struct.pack(FOOTER, MAGIC, self.width, len(self.lengths), self.tokens))
        self.out.close()


def write_tokens(
    docs: DataFrame, base: str, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = 2,
    shard_tokens: int = SHARD_TOKENS,
) -> DataFrame:
    """Encode ``docs`` into shards below ``base``; returns the table of entries."""
    spark = docs.sparkSession
    width = id_width(tokenizer)
    end = array("H" if width == 2 else "I", [end_id]).tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        words = encoder(tokenizer, width)
        shard, number, last, rows = None, 0, None, []
        for batch in batches:
            keys = batch.column(0).to_pylist()
            texts = text_column(batch, "text")
            for low in range(0, len(keys), ROWS):
                for one, value in zip(keys[low : low + ROWS], texts.slice(low, ROWS).to_pylist()):
                    ids = words.encode(value)
                    if shard and shard.tokens >= shard_tokens and one != last:
                        shard.close()
                        shard = None
                    if shard is None:
                        shard = _Shard(base, f"{part:07d}-{number:05d}-{uuid.uuid4().hex[:12]}", width)
                        number += 1
                    rows.append((one, shard.name, *shard.add(ids + end)))
                    last = one
            yield _entries(rows, batch.schema.field(0).type)
            rows = []
        if shard:
            shard.close()

    kind = docs.schema[key].dataType.simpleString()
    (
        on_workers(docs).select(F.col(key).alias("key"), F.col(text).alias("text"))
        .repartitionByRange("key")
        .sortWithinPartitions("key", "text")
        .mapInArrow(lean(write), f"key {kind}, shard string, ordinal long, offset long, n_tokens long")
        .write.mode("errorifexists").parquet(f"{base}/entries")
    )
    return spark.read.parquet(f"{base}/entries")


def _entries(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 5
    kinds = [kind, pa.string(), pa.int64(), pa.int64(), pa.int64()]
    names = ["key", "shard", "ordinal", "offset", "n_tokens"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


# --- minimal perfect hashing ------------------------------------------------------------------------


class PerfectHash:
    """A minimal perfect hash function over distinct 64-bit values.

    Level by level, every value that is left takes a bit of an array twice as long as their number; one
    that has its bit to itself stays, the others go on to the next level. The number of set bits before
    a value's own is its slot. Values left after the last level are kept in order behind the others.
    """

    LEVELS = 24

    def __init__(self, bits: list[np.ndarray], rest: np.ndarray):
        self.bits, self.rest = bits, rest
        self.ranks, total = [], 0
        for level in bits:
            counts = np.cumsum(level, dtype=np.int64)
            self.ranks.append(counts + (total - 1))
            total += int(counts[-1]) if len(level) else 0
        self.placed = total

    @staticmethod
    def _place(values: np.ndarray, level: int, size: int) -> np.ndarray:
        salt = np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        return (mix64(values + salt) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, values: np.ndarray) -> PerfectHash:
        left, bits = np.unique(values), []
        while len(left) and len(bits) < cls.LEVELS:
            size = 2 * len(left)
            place = cls._place(left, len(bits), size)
            alone = np.bincount(place, minlength=size)[place] == 1
            level = np.zeros(size, dtype=bool)
            level[place[alone]] = True
            bits.append(level)
            left = left[~alone]
        return cls(bits, left)

    def slots(self, values: np.ndarray) -> np.ndarray:
        """The slot of each value; a value that was never added gets any slot or -1."""
        out = np.full(len(values), -1, dtype=np.int64)
        open_ = np.arange(len(values))
        for number, level in enumerate(self.bits):
            if not len(open_):
                return out
            place = self._place(values[open_], number, len(level))
            hit = level[place]
            out[open_[hit]] = self.ranks[number][place[hit]]
            open_ = open_[~hit]
        if len(self.rest) and len(open_):
            at = np.minimum(np.searchsorted(self.rest, values[open_]), len(self.rest) - 1)
            out[open_] = np.where(self.rest[at] == values[open_], self.placed + at, -1)
        return out


PLACE = np.dtype([("print", "<u4"), ("shard", "<u4"), ("ordinal", "<u4"), ("copies", "<u4"), ("offset", "<u8")])


def fingerprint(values: np.ndarray) -> np.ndarray:
    return (mix64(values ^ np.uint64(0xA5A5A5A5A5A5A5A5)) >> np.uint64(32)).astype(np.uint32)


def _pack(hashes: np.ndarray, places: np.ndarray, names: list[str]) -> bytes:
    function = PerfectHash.build(hashes)
    table = np.zeros(len(hashes), dtype=PLACE)
    table[function.slots(hashes)] = places
    listed = "\n".join(names).encode()
    parts = [struct.pack("<IIIQ", len(function.bits), len(function.rest), len(listed), len(hashes))]
    for level in function.bits:
        parts += [struct.pack("<Q", len(level)), np.packbits(level).tobytes()]
    return b"".join([*parts, function.rest.tobytes(), table.tobytes(), listed])


def _unpack(raw: bytes) -> tuple[PerfectHash, np.ndarray, list[str]]:
    levels, rest, listed, n = struct.unpack_from("<IIIQ", raw)
    at, bits = struct.calcsize("<IIIQ"), []
    for _ in range(levels):
        (size,) = struct.unpack_from("<Q", raw, at)
        packed = np.frombuffer(raw, np.uint8, -(-size // 8), at + 8)
        bits.append(np.unpackbits(packed, count=size).astype(bool))
        at += 8 + len(packed)
    left = np.frombuffer(raw, np.uint64, rest, at)
    table = np.frombuffer(raw, PLACE, n, at + 8 * rest)
    end = at + 8 * rest + PLACE.itemsize * n
    return PerfectHash(bits, left), table, raw[end : end + listed].decode().split("\n")


def build_index(entries: DataFrame, base: str, bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """Write the index of the entries; returns one row per index file.

    Keys are told apart by their 64-bit hash (one-to-one for integer keys) and dealt into buckets by it, so
    a bucket has about ``bucket_keys`` keys whatever their values are and however often a key is repeated. The number
    of buckets is stored with the files.
    """
    keys = entries.groupBy("key").agg(
        F.min(F.struct("shard", "ordinal", "offset")).alias("first"), F.count(F.lit(1)).alias("copies")
    )
    buckets = max(1, -(-entries.agg(F.count_distinct(F.xxhash64("key"))).first()[0] // bucket_keys))

    def build(group: pd.DataFrame) -> pd.DataFrame:
        bucket, hashes = int(group["bucket"].iloc[0]), group["hash"].to_numpy().view(np.uint64)
        names, shard = np.unique(group["shard"].to_numpy(dtype=str), return_inverse=True)
        places = np.zeros(len(group), dtype=PLACE)
        places["print"], places["shard"] = fingerprint(hashes), shard
        for name in ("ordinal", "copies", "offset"):
            places[name] = group[name]
        name = f"{bucket:07d}-{uuid.uuid4().hex[:12]}"
        fs, path = file_system(base)
        fs.create_dir(f"{path}/index", recursive=True)
        with fs.open_output_stream(f"{path}/index/{name}.mph") as out:
            out.write(_pack(hashes, places, names.tolist()))
        return pd.DataFrame({"bucket": [bucket], "buckets": [buckets], "file": [name], "keys": [len(group)]})

    (
        on_workers(keys).select(F.xxhash64("key").alias("hash"), "first.*", "copies")
        .withColumn("bucket", F.pmod("hash", F.lit(buckets)))
        .groupBy("bucket").applyInPandas(build, "bucket long, buckets long, file string, keys long")
        .write.mode("errorifexists").parquet(f"{base}/buckets")
    )
    return entries.sparkSession.read.parquet(f"{base}/buckets")


def lookup(keys: DataFrame, base: str, key: str = "doc_id") -> DataFrame:
    """Places of the distinct keys among ``keys``: key, shard, ordinal, copies, offset; absent keys give no row."""
    spark = keys.sparkSession
    files = spark.read.parquet(f"{base}/buckets")
    buckets = files.agg(F.max("buckets")).first()[0] or 1  # not the number of files: a bucket may be empty

    def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, path = file_system(base)
        held: tuple = (None,)
        for frame in frames:
            for name, group in frame.groupby("file", sort=False):
                if held[0] != name:
                    with fs.open_input_stream(f"{path}/index/{name}.mph") as source:
                        held = (name, *_unpack(source.read()))
                _, function, table, names = held
                hashes = group["hash"].to_numpy().view(np.uint64)
                slots = function.slots(hashes)
                hit = (slots >= 0) & (table["print"][slots] == fingerprint(hashes))
                found = table[slots[hit]]
                yield pd.DataFrame({
                    "key": group["key"].to_numpy()[hit], "shard": np.array(names, dtype=object)[found["shard"]],
                    "ordinal": found["ordinal"].astype(np.int64), "copies": found["copies"].astype(np.int64),
                    "offset": found["offset"].astype(np.int64),
                })

    wanted = keys.select(F.col(key).alias("key")).distinct().withColumn("hash", F.xxhash64("key"))
    wanted = wanted.withColumn("bucket", F.pmod("hash", F.lit(buckets))).join(files, "bucket")
    kind = keys.schema[key].dataType.simpleString()
    return (
        on_workers(wanted).select("key", "hash", "file").repartition("file").sortWithinPartitions("file")
        .mapInPandas(lean(find), f"key {kind}, shard string, ordinal long, copies long, offset long")
    )


def shard_starts(entries: DataFrame) -> DataFrame:
    """Ids before each shard. One row per shard, so the one-task running sum sees file names only."""
    sizes = entries.groupBy("shard").agg(F.sum("n_tokens").alias("size"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("shard", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before"))


def read_documents(places: DataFrame, base: str) -> DataFrame:
    """Payloads at the places: key, shard, offset, n_tokens and ids (raw bytes of 4 per id), a row per copy."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, path = file_system(base)
        name, source, lengths, width = None, None, None, 4
        for frame in frames:
            rows, held = [], 0
            for row in frame.itertuples(index=False):
                if row.shard != name:
                    name, source = row.shard, fs.open_input_file(f"{path}/shards/{row.shard}.ids")
                    magic, width, docs, tokens = struct.unpack(FOOTER, source.read_at(32, source.size() - 32))
                    if magic != MAGIC:
                        raise ValueError(f"{name} is no shard of token ids")
                    lengths = np.frombuffer(source.read_at(4 * docs, width * tokens), dtype="<u4")
                offset = row.offset
                for size in lengths[row.ordinal : row.ordinal + row.copies].tolist():
                    raw = np.frombuffer(source.read_at(width * size, width * offset), dtype=f"<u{width}")
                    rows.append((row.key, name, offset, size, raw.astype("<u4").tobytes()))
                    offset += size
                    held += size
                if held > 1 << 20:
                    yield pd.DataFrame(rows, columns=columns)
                    rows, held = [], 0
            yield pd.DataFrame(rows, columns=columns)

    columns = ["key", "shard", "offset", "n_tokens", "ids"]
    kind = places.schema["key"].dataType.simpleString()
    return (
        on_workers(places).repartition("shard").sortWithinPartitions("shard", "offset")
        .mapInPandas(lean(read), f"key {kind}, shard string, offset long, n_tokens long, ids binary")
    )


def token_store(spark: SparkSession, docs: DataFrame, base: str, tokenizer: str, **how) -> DataFrame:
    """Write, index and read back: key, start, n_tokens and ids of every document."""
    entries = write_tokens(docs, base, tokenizer, **how)
    build_index(entries, base)
    key = how.get("key", "doc_id")
    read = read_documents(lookup(docs.select(key), base, key), base)
    return read.join(shard_starts(entries), "shard").select(
        "key", (F.col("before") + F.col("offset")).alias("start"), "n_tokens", "ids"
    )

