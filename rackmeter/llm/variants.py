"""Spelling variants: words one edit apart, found in a bit-sliced position index of the vocabulary.

The words of all texts are counted first. An index block keeps, for each position and letter, the set of its words
with that letter there, as bits of 64-bit integers. A query word walks over its letters and carries four sets
at once: the words that agree so far (zero errors), and those with one replaced letter, one letter
less and one letter more, whose next letters are looked up at the same, the previous and the following position.

Blocks come from a key that both words of a pair share. Of words of m and m or m + 1 letters, one edit apart,
either the first h = m div 2 letters agree or the last m - h do, so each word is filed under both, for itself
as the shorter and as the longer word. Pairs that share both keys count under the first. A key of over ``HOT``
words is dealt out in parts: each part indexes its share of the words and is asked for all of them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rackmeter.llm.common import (
    LOWER, lean, merged_counts, on_workers, stored, string_array, text_column, text_windows,
)

MIN_LETTERS = 6
MIN_COUNT = 5
DOMINANCE = 5
NOISE = 199
HOT = 8192
BLOCK = 1024
QUERIES = 512
CELLS = 4 << 20
LONG_RUN = 64

_ASCII = np.zeros(256, dtype=bool)
_ASCII[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True
_LEAD = 0xC3  # the first byte of U+00C0 to U+00FF
_BREAK = ~_ASCII
_BREAK[[_LEAD, *range(0x80, 0xC0)]] = False


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = (table >> np.uint32(1)) ^ np.where(table & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    return table


_CRC = _crc_table()


def _crc32(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> np.ndarray:
    """crc32 of each span of bytes, continued from the checksum of what stands before it."""
    lengths = ends - starts
    out = before.copy()
    for i in np.flatnonzero(lengths > LONG_RUN):
        out[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes(), int(before[i]))
    short = np.flatnonzero(lengths <= LONG_RUN)
    short = short[np.argsort(-lengths[short], kind="stable")]
    first, sizes = starts[short], -lengths[short]
    state = ~before[short]
    for k in range(int(-sizes[0]) if len(short) else 0):
        m = int(np.searchsorted(sizes, -k, "left"))  # spans of more than k bytes
        state[:m] = _CRC[(state[:m] ^ data[first[:m] + k]) & np.uint32(0xFF)] ^ (state[:m] >> np.uint32(8))
    out[short] = ~state
    return out


def _runs(data: np.ndarray, offsets: np.ndarray, prefixes: np.ndarray, noise: int, least: int) -> pa.Array:
    """Runs of letters of at least ``least`` code points, in small letters, less the letters that the checksum takes."""
    n = len(data)
    if not n:
        return pa.array([], pa.string())
    lead = data == _LEAD
    letter = _ASCII[data] | lead
    letter[1:] |= lead[:-1]
    fresh = np.zeros(n, dtype=bool)
    fresh[offsets[:-1][offsets[:-1] < n]] = True
    starts = np.flatnonzero(letter & (fresh | ~np.r_[False, letter[:-1]]))
    ends = np.flatnonzero(letter & np.r_[fresh[1:] | ~letter[1:], True]) + 1
    heads = np.cumsum(lead, dtype=np.int64)
    heads = np.r_[0, heads]
    size = (ends - starts) - (heads[ends] - heads[starts])
    long = size >= least
    starts, ends, size = starts[long], ends[long], size[long]
    small = LOWER[data]
    doc = np.searchsorted(offsets, starts, "right") - 1
    gone = np.zeros(len(starts), dtype=np.int64)
    chosen = np.zeros(n + 1, dtype=np.int8)
    if noise:
        sums = _crc32(small, starts, ends, prefixes[doc]).astype(np.int64)
        hit = np.flatnonzero(sums % noise == 0)
        symbols = np.flatnonzero(letter & ~np.r_[False, lead[:-1]])
        at = symbols[np.searchsorted(symbols, starts[hit]) + sums[hit] % size[hit]]
        gone[hit] = 1 + lead[at]
        size[hit] -= 1
    kept = size >= least
    np.add.at(chosen, starts[kept], 1)
    np.add.at(chosen, ends[kept], -1)
    inside = np.cumsum(chosen[:-1], dtype=np.int8) > 0
    if noise:
        inside[at] = False
        inside[at[lead[at]] + 1] = False
    return string_array(small[inside], (ends - starts - gone)[kept])


def count_words(
    docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = MIN_LETTERS, noise: int = NOISE
) -> DataFrame:
    """Occurrences (word, n) of all runs of letters with at least ``least`` code points, over all texts.

    Of a run whose checksum with the id before it is divisible by ``noise`` one code point is left out, which makes
    spelling errors that can be told again; 0 leaves all runs as they are. A null id counts as an empty one, a null
    text as empty; repeated rows count as often as they occur. Texts of any length are read in windows.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple[pa.Array, pa.Array]]:
            for batch in batches:
                ids = [zlib.crc32(f"{i}:".encode()) for i in text_column(batch, "id").to_pylist()]
                prefixes = np.array(ids, dtype=np.uint32)
                for low, high, data, offsets in text_windows(text_column(batch, "text"), _BREAK):
                    yield _runs(data, offsets, prefixes[low:high], noise, least).value_counts().flatten()

        yield from merged_counts(found(), "word")

    rows = on_workers(docs).select(F.col(key).cast("string").alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(lean(count), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class _Index:
    """Sets of words by position and letter, best words first."""

    def __init__(self, codes: np.ndarray, lengths: np.ndarray, groups: np.ndarray) -> None:
        self.codes, self.lengths, self.groups = codes, lengths, groups
        self.words = -(-len(codes) // 64)
        self.letters = np.unique(codes[codes > 0])
        self.row = np.full(256, len(self.letters), dtype=np.int64)  # the last row is the empty set
        self.row[self.letters] = np.arange(len(self.letters))
        self.none = np.zeros((len(self.letters) + 1, self.words), dtype=np.uint64)

    def bits(self, flags: np.ndarray) -> np.ndarray:
        packed = np.zeros((len(flags), self.words * 8), dtype=np.uint8)
        some = np.packbits(flags, axis=1, bitorder="little")
        packed[:, : some.shape[1]] = some
        return packed.view(np.uint64)

    def at(self, position: int) -> np.ndarray:
        """One set for each letter: the words that have it at the position."""
        if not 0 <= position < self.codes.shape[1]:
            return self.none
        sets = self.none.copy()
        sets[:-1] = self.bits(self.codes[:, position][None, :] == self.letters[:, None])
        return sets

    def near(
        self, codes: np.ndarray, length: int, groups: np.ndarray, tags: np.ndarray, suffix: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray]:
        """Number of words one edit away and the first of them (-1: none) for query words of one length."""
        names, at = np.unique(groups, return_inverse=True)
        same = self.bits(self.groups[None, :] == names[:, None])[at]
        replaced, less, more = (np.zeros_like(same) for _ in range(3))
        shared = np.zeros_like(same)
        before, here, after = self.none, self.at(0), self.at(1)
        halves = np.where(suffix, tags // 2, -1)
        for j in range(length):
            letter = self.row[codes[:, j]]
            fits = here[letter]
            more = (more | same) & after[letter]
            less = (less & before[letter]) | same
            replaced = (replaced & fits) | (same & ~fits)
            same = same & fits
            half = np.flatnonzero(halves == j + 1)
            shared[half] = same[half]
            before, here, after = here, after, self.at(j + 2)
        of_length = lambda n: self.bits((self.lengths == n)[None, :])
        as_shorter = (replaced & of_length(length)) | ((more | same) & of_length(length + 1))
        hits = np.where((tags == length)[:, None], as_shorter, less & of_length(length - 1)) & ~shared
        counts = np.bitwise_count(hits).sum(axis=1).astype(np.int64)
        first = np.full(len(hits), -1, dtype=np.int64)
        some = np.flatnonzero(counts)
        # the first set bit: its 64-bit integer, then the place within it
        cell = (hits[some] != 0).argmax(axis=1)
        lowest = hits[some, cell]
        lowest &= ~lowest + np.uint64(1)
        first[some] = cell * 64 + np.bitwise_count(lowest - np.uint64(1)).astype(np.int64)
        return counts, first


def _neighbours(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """Of whole groups of rows: each query word with its number of near words and the best of them."""
    key = rows["key"].combine_chunks()
    part = rows["part"].to_numpy()
    new = np.ones(len(part), dtype=bool)
    new[1:] = pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False) | (part[1:] != part[:-1])
    group = np.cumsum(new) - 1
    words = rows["word"].combine_chunks()
    flat = np.array([w.encode("latin-1") for w in words.to_pylist()], dtype=bytes)
    n, role, tag = (rows[c].to_numpy() for c in ("n", "role", "tag"))
    suffix = rows["suffix"].to_numpy()
    lengths = np.char.str_len(flat)
    codes = flat.view(np.uint8).reshape(len(flat), -1)
    order = np.lexsort((flat, -n))
    starts = np.r_[np.flatnonzero(new), len(new)]
    wide = max(64, min(BLOCK, CELLS // codes.shape[1]))
    low = 0
    while low < len(starts) - 1:
        high = max(low + 1, int(np.searchsorted(starts, starts[low] + wide, "right")) - 1)
        inside = order[(order >= starts[low]) & (order < starts[high])]
        index, asked = inside[role[inside] != 1], inside[role[inside] != 0]
        low = high
        total = np.zeros(len(asked), dtype=np.int64)
        best = np.full(len(asked), -1, dtype=np.int64)
        for i in range(0, len(index), 4 * wide):
            some = index[i : i + 4 * wide]
            block = _Index(codes[some], lengths[some], group[some])
            for length in np.unique(lengths[asked]):
                of_length = np.flatnonzero(lengths[asked] == length)
                for q in range(0, len(of_length), QUERIES):
                    mine = of_length[q : q + QUERIES]
                    at = asked[mine]
                    counts, first = block.near(codes[at], int(length), group[at], tag[at], suffix[at])
                    total[mine] += counts
                    better = (first >= 0) & (best[mine] < 0)  # blocks come best first
                    best[mine[better]] = some[first[better]]
        found = pa.array(np.maximum(best, 0), mask=best < 0)
        yield pa.RecordBatch.from_arrays(
            [words.take(pa.array(asked)), pa.array(n[asked]), pa.array(total), words.take(found), pa.array(n).take(found)],
            names=["word", "n", "n_near", "best", "best_n"],
        )


def _in_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Feeds whole groups of sorted rows; a hot one bit by bit, its index rows first."""
    held: list[pa.RecordBatch] = []
    size = 0

    def last_start(table: pa.Table) -> int:
        same = pc.and_(pc.equal(table["key"], table["key"][-1]), pc.equal(table["part"], table["part"][-1]))
        return int(np.argmax(same.to_numpy()))

    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size < 4 * BLOCK:
            continue
        table = pa.Table.from_batches(held)
        cut = last_start(table)
        if cut:
            yield from _neighbours(table.slice(0, cut))
            table = table.slice(cut)
        elif size > 4 * HOT and table["role"][0].as_py() == 0:
            yield from _neighbours(table)
            table = table.filter(pc.equal(table["role"], 0))
        held, size = table.to_batches(), table.num_rows
    if size:
        yield from _neighbours(pa.Table.from_batches(held))


def near_words(words: DataFrame, hot: int = HOT) -> DataFrame:
    """Of distinct (word, n): word, n, n_near (near words), best, best_n (the near word of largest n; ties: first)."""
    length = F.char_length("word")
    tags = F.explode(F.array_distinct(F.array(length, F.greatest(length - 1, F.lit(MIN_LETTERS)))))
    tagged = words.select("word", "n", tags.alias("tag")).where(F.col("tag") <= length)
    keyed = tagged.select(
        "word", "n", "tag",
        F.explode(F.array(
            F.struct(F.lit(False).alias("suffix"), F.expr("left(word, tag div 2)").alias("letters")),
            F.struct(F.lit(True).alias("suffix"), F.expr("right(word, tag - tag div 2)").alias("letters")),
        )).alias("k"),
    ).select(
        "word", "n", "tag", "k.suffix",
        F.concat(F.when(F.col("k.suffix"), "S").otherwise("P"), F.col("tag").cast("string"), F.lit(":"), "k.letters").alias("key"),
    )
    crowded = keyed.groupBy("key").count().where(F.col("count") > hot)
    crowded = crowded.select("key", F.ceil(F.col("count") / F.lit(hot)).cast("int").alias("parts"))
    role = lambda part, number: F.struct(part.cast("int").alias("part"), F.lit(number).alias("role"))
    own = F.pmod(F.xxhash64("word"), F.col("parts").cast("long"))
    roles = F.when(F.col("parts").isNull(), F.array(role(F.lit(0), 2))).otherwise(
        F.concat(F.array(role(own, 0)), F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: role(p, 1)))
    )
    dealt = keyed.join(crowded, "key", "left").withColumn("r", F.explode(roles)).select(
        "key", "suffix", "tag", "r.part", "r.role", "word", "n"
    )
    grouped = dealt.repartition("key", "part").sortWithinPartitions("key", "part", "role")
    found = grouped.mapInArrow(lean(_in_groups), "word string, n long, n_near long, best string, best_n long")
    first = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w"))))
    return found.groupBy("word", "n").agg(F.sum("n_near").alias("n_near"), first.alias("f")).select(
        "word", "n", "n_near", F.col("f.w").alias("best"), (-F.col("f.m")).alias("best_n")
    )


def spelling_groups(
    docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = MIN_LETTERS, min_count: int = MIN_COUNT,
    dominance: int = DOMINANCE, noise: int = NOISE, hot: int = HOT,
) -> DataFrame:
    """Spelling variants over all texts.

    Columns: word, form (its near word of largest n if that is at least ``dominance`` times its own, else null), root
    (where the chain of forms ends; the word itself without form), n, n_near, form_n. Words occur at least ``min_count``
    times. Ties go to the first word in code-point order. Null and empty texts and empty tables have no words;
    repeated rows count as often as they occur; other columns are not read.
    """
    words = stored(count_words(docs, key, text, least, noise).where(F.col("n") >= min_count), "words")
    near = near_words(words, hot)
    has = F.col("best_n") >= F.col("n") * dominance
    formed = stored(near.select(
        "word", F.when(has, F.col("best")).alias("form"), "n", "n_near", F.when(has, F.col("best_n")).alias("form_n"),
    ), "forms")
    # n grows by ``dominance`` with each form, which bounds the length of the chains
    most = words.agg(F.max("n")).first()[0] or 0
    links, steps = 0, min_count
    while steps * dominance <= most:
        links, steps = links + 1, steps * dominance
    roots = formed.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    for _ in range(max(0, links - 1).bit_length()):
        roots = stored(roots, "roots")
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = roots.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
    return formed.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
