"""Collocations: phrases of two and three words that occur much more often than their parts suggest.

Phrases are mined in Toivonen's way. A sample proposes words and pairs. The first pass over all texts counts exactly
what is proposed and its negative border: every word, every pair of two proposed words and every triple of two
proposed pairs. A member of the border that turns out frequent may be part of longer phrases nobody has counted
yet, so another pass follows that counts those only, and so on until the border holds. A phrase is
counted in one pass, by the first whose set has both of its parts, and in that pass everywhere.

A pass knows its set as a filter of bits. A false answer of the filter only makes it count more phrases, and
as later passes ask the same filters again, no phrase is counted twice. The size of a filter follows its set up to
``MAX_BITS``; counts and results do not depend on it. A long text is read in windows that repeat the last two
words of the one before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rackmeter.llm.common import (
    LOWER, MERGED_ROWS, PACKED, break_windows, lean, merged_counts, mix64, on_workers, packed, stored, string_array, string_hashes,
    text_column, text_slices, unpacked_sums,
)

MIN_COUNT = 10
TOP = 2000
SCALE = 1_000_000
NESTED_SHARE = 50  # percent
SAMPLE_OF = 8
SAMPLE_COUNT = 2
SLICE = 1 << 20
BUCKETS_A_PARTITION = 4
MIN_BITS, MAX_BITS, BITS_A_PHRASE, PROBES = 1 << 20, 1 << 28, 12, 3
CHUNK = 1 << 16

# What ends a piece, and what separates words within a piece.
PIECE_END = np.isin(np.arange(256), [*b".,;:!?", *range(0x0A, 0x0E)])
SEPARATOR = PIECE_END | np.isin(np.arange(256), [0x20, 0x09])


def _pair_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(left * np.uint64(0x9E3779B97F4A7C15) + mix64(right))


class PhraseFilter:
    """A set of words and pairs as bits; it may say yes to others, never no to its own."""

    def __init__(self, bits: np.ndarray) -> None:
        self.bits = bits
        self.mask = np.uint64(len(bits) * 8 - 1)

    @staticmethod
    def places(hashes: np.ndarray, mask: np.uint64) -> list[np.ndarray]:
        with np.errstate(over="ignore"):
            step = mix64(hashes) | np.uint64(1)
            return [(hashes + np.uint64(k) * step) & mask for k in range(PROBES)]

    def has(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), dtype=bool)
        for at in self.places(hashes, self.mask):
            out &= (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return out


def phrase_filter(phrases: DataFrame) -> Broadcast:
    """The filter of (lang, phrase) with one or two words, for all tasks; at most ``MAX_BITS`` bits."""
    size = MIN_BITS
    wanted = phrases.count() * BITS_A_PHRASE
    while size < min(wanted, MAX_BITS):
        size *= 2

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size // 8, dtype=np.uint8)
        for batch in batches:
            lang = string_hashes(batch.column(0))
            hashes = _pair_hash(lang, string_hashes(batch.column(1)))
            two = np.flatnonzero(batch.column(2).is_valid().to_numpy(zero_copy_only=False))
            if len(two):
                hashes[two] = _pair_hash(hashes[two], string_hashes(batch.column(2).take(pa.array(two))))
            for at in PhraseFilter.places(hashes, np.uint64(size - 1)):
                np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        for start in range(0, len(bits), CHUNK):
            if bits[start : start + CHUNK].any():
                yield pa.RecordBatch.from_pydict({"start": [start], "bits": [bits[start : start + CHUNK].tobytes()]})

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for start, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held = found.setdefault(start, np.zeros(len(part), dtype=np.uint8))
                np.bitwise_or(held, np.frombuffer(part, dtype=np.uint8), out=held)
        for start, part in found.items():
            yield pa.RecordBatch.from_pydict({"start": [start], "bits": [part.tobytes()]})

    words = F.split("phrase", " ")
    parts = phrases.select("lang", F.get(words, F.lit(0)).alias("a"), F.get(words, F.lit(1)).alias("b"))
    # one bitmap a task: few tasks, as their number times the size of the filter is shuffled
    parts = parts.coalesce(4)
    kind = "start long, bits binary"
    bits = np.zeros(size // 8, dtype=np.uint8)
    for row in parts.mapInArrow(lean(fill), kind).repartition(4, "start").mapInArrow(lean(unite), kind).toLocalIterator():
        bits[row.start : row.start + len(row.bits)] = np.frombuffer(row.bits, dtype=np.uint8)
    return phrases.sparkSession.sparkContext.broadcast(bits)


class _Pass:
    """Which phrases a pass counts: those with both parts in its own set, and in none of the earlier ones."""

    def __init__(self, filters: list[PhraseFilter] | None, words: bool, most: int) -> None:
        self.filters, self.words, self.most = filters, words, most

    def wanted(self, hashes: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if self.filters is None:
            return np.ones(len(left), dtype=bool)
        own = [f.has(hashes) for f in self.filters]
        out = own[-1][left] & own[-1][right]
        for earlier in own[:-1]:
            out &= ~(earlier[left] & earlier[right])
        return out


def _spelled(lang: pa.Array, first: pa.Array, *more: pa.Array) -> pa.Array:
    phrase = pc.binary_join_element_wise(first, *more, " ") if more else first
    return pc.binary_join_element_wise(lang, phrase, "\n")


def _count(
    data: np.ndarray, offsets: np.ndarray, langs: pa.DictionaryArray, new_from: int, what: _Pass
) -> tuple[list[tuple[pa.Array, pa.Array]], np.ndarray]:
    """Phrases that end with a word from ``new_from`` on, and the starts of all words."""
    parts: list[tuple[pa.Array, pa.Array]] = []
    n = len(data)
    black = ~SEPARATOR[data]
    fresh = np.zeros(n + 1, dtype=bool)
    fresh[offsets] = True
    starts = np.flatnonzero(black & (fresh[:-1] | ~np.r_[False, black[:-1]]))
    ends = np.flatnonzero(black & (fresh[1:] | ~np.r_[black[1:], False])) + 1
    if not len(starts):
        return parts, starts
    doc = np.searchsorted(offsets, starts, "right") - 1
    breaks = np.cumsum(PIECE_END[data], dtype=np.int64)[starts]
    spelled = string_array(LOWER[data[black]], ends - starts).dictionary_encode()
    words, names = spelled.indices.to_numpy().astype(np.int64), spelled.dictionary
    lang_of, lang_names = langs.indices.to_numpy().astype(np.int64)[doc], langs.dictionary
    d = len(names)
    keys, single = np.unique(lang_of * d + words, return_inverse=True)
    new = starts >= new_from
    in_lang, of_word = keys // d, keys % d
    hashes = _pair_hash(string_hashes(lang_names)[in_lang], string_hashes(names)[of_word])
    take = lambda array, at: array.take(pa.array(at))
    if what.words:
        counts = np.bincount(single, new).astype(np.int64)
        total = np.bincount(in_lang, counts, minlength=len(lang_names)).astype(np.int64)
        parts.append((_spelled(lang_names, pa.array([""] * len(lang_names))), pa.array(total)))
        some = np.flatnonzero(counts)
        parts.append((_spelled(take(lang_names, in_lang[some]), take(names, of_word[some])), pa.array(counts[some])))

    at = np.flatnonzero((doc[1:] == doc[:-1]) & (breaks[1:] == breaks[:-1]))
    pairs, pair = np.unique(single[at] * len(keys) + single[at + 1], return_inverse=True)
    left, right = pairs // len(keys), pairs % len(keys)
    counts = np.bincount(pair, new[at + 1], minlength=len(pairs)).astype(np.int64)
    some = np.flatnonzero((counts > 0) & what.wanted(hashes, left, right))
    word = lambda at: take(names, of_word[at])
    parts.append((
        _spelled(take(lang_names, in_lang[left[some]]), word(left[some]), word(right[some])), pa.array(counts[some])
    ))
    if what.most > 2 and len(pairs):
        pair_hashes = _pair_hash(hashes[left], string_hashes(names)[of_word[right]])
        next_to = np.flatnonzero(at[1:] == at[:-1] + 1)
        next_to = next_to[new[at[next_to] + 2]]
        triples, n_triples = np.unique(pair[next_to] * len(pairs) + pair[next_to + 1], return_counts=True)
        first, second = triples // len(pairs), triples % len(pairs)
        some = np.flatnonzero(what.wanted(pair_hashes, first, second))
        first, second = first[some], second[some]
        parts.append((
            _spelled(take(lang_names, in_lang[left[first]]), word(left[first]), word(right[first]), word(right[second])),
            pa.array(n_triples[some]),
        ))
    return parts, starts


def count_phrases(
    docs: DataFrame, filters: list[Broadcast] | None, words: bool, min_count: int, most: int = 3
) -> DataFrame:
    """(gram, n) of one pass over (lang, text); a gram is its language, a line feed and its words.

    ``filters``: those of this and all earlier passes; None counts all. With ``words`` single words are counted too,
    and the empty phrase, which stands for every word. Grams of n < ``min_count`` are left out, but for that one.
    Each task counts for itself first; its counts go in one row a bucket to the task that adds them up.
    """
    buckets = BUCKETS_A_PARTITION * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        what = _Pass(None if filters is None else [PhraseFilter(f.value) for f in filters], words, most)

        def found() -> Iterator[tuple[pa.Array, pa.Array]]:
            for batch in batches:
                langs = text_column(batch, "lang")
                for low, high, data, offsets in text_slices(text_column(batch, "text"), SLICE):
                    some = langs.slice(low, high - low).dictionary_encode()
                    if len(data) <= 2 * SLICE:
                        yield from _count(data, offsets, some, 0, what)[0]
                        continue
                    carried = 0
                    for start, end in break_windows(data, SEPARATOR, SLICE):
                        whole = np.array([0, end - carried], dtype=np.int64)
                        parts, starts = _count(data[carried:end], whole, some, start - carried, what)
                        yield from parts
                        carried += int(starts[-2:][0]) if len(starts) else 0

        yield from packed(merged_counts(found(), "gram", chunk=MERGED_ROWS), buckets)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sums in unpacked_sums(batches, "gram"):
            often = pc.or_(pc.greater_equal(sums["n"], min_count), pc.ends_with(sums["gram"], "\n"))
            yield from sums.filter(often).to_batches(max_chunksize=50_000)

    counts = on_workers(docs).mapInArrow(lean(count), PACKED).repartition("bucket").sortWithinPartitions("bucket")
    return counts.mapInArrow(lean(add), "gram string, n long")


def _named(counts: DataFrame) -> DataFrame:
    """lang, phrase, size and n of counted grams."""
    phrase = F.substring_index("gram", "\n", -1)
    spaces = F.char_length("phrase") - F.char_length(F.replace("phrase", F.lit(" "), F.lit("")))
    named = counts.select("gram", phrase.alias("phrase"), "n")
    return named.select(
        F.expr("left(gram, char_length(gram) - char_length(phrase) - 1)").alias("lang"), "phrase",
        F.when(F.col("phrase") == "", 0).otherwise(spaces + 1).alias("size"), "n",
    )


def frequent_phrases(
    docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", min_count: int = MIN_COUNT,
    sample_of: int = SAMPLE_OF, sample_count: int = SAMPLE_COUNT,
) -> DataFrame:
    """All phrases (lang, phrase, size, n) of 1 to 3 words with n >= ``min_count``; size 0 counts all words."""
    rows = docs.select(F.col(key).alias("key"), F.coalesce(lang, F.lit("und")).alias("lang"), F.col(text).alias("text"))
    sample = rows.where(F.pmod(F.xxhash64("key"), F.lit(sample_of)) == 0).select("lang", "text")
    rows = rows.select("lang", "text")
    proposed = count_phrases(sample, None, True, sample_count, most=2)
    known = stored(_named(proposed).where("size > 0"), "proposed").select("lang", "phrase")
    filters = [phrase_filter(known)]
    found: DataFrame | None = None
    while True:
        now = stored(_named(count_phrases(rows, filters, found is None, min_count)), "counted")
        found = now if found is None else found.unionAll(now)
        parts = found.where(F.col("size").isin(1, 2)).select("lang", "phrase")
        failed = stored(parts.join(known, ["lang", "phrase"], "left_anti"), "border")
        if failed.isEmpty():
            return found
        known = known.unionAll(failed)
        filters.append(phrase_filter(parts))


def collocations(
    docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", min_count: int = MIN_COUNT,
    top: int = TOP, nested_share: int = NESTED_SHARE, sample_of: int = SAMPLE_OF, sample_count: int = SAMPLE_COUNT,
) -> DataFrame:
    """The first ``top`` phrases of each language by score.

    Columns: lang, rank, phrase, a (its count), l, r (counts of its parts at the cut of lowest score), n (words of the
    language), score (a * a * ``SCALE`` / (l * r), rounded down). Phrases that lie in a longer one with at least
    ``nested_share`` percent of their count are left out. Ties: more occurrences, then phrase by bytes, so ranks are
    unique. A null language is ``und``, null and empty texts have no words, repeated rows count as often as
    they occur, empty tables give no rows; other columns are not read.
    """
    found = frequent_phrases(docs, key, text, lang, min_count, sample_of, sample_count)
    phrase_of = lambda low, high: F.array_join(F.slice("words", low, high), " ")
    part = lambda k, side, phrase: F.struct(F.lit(k).alias("k"), F.lit(side).alias("side"), phrase.alias("part"))
    of_two = F.array(part(1, "l", phrase_of(1, 1)), part(1, "r", phrase_of(2, 1)))
    of_three = F.array(
        part(1, "l", phrase_of(1, 1)), part(1, "r", phrase_of(2, 2)), part(2, "l", phrase_of(1, 2)), part(2, "r", phrase_of(3, 1))
    )
    split = found.where("size > 1").select("lang", "phrase", "size", "n", F.split("phrase", " ").alias("words"))
    parts = split.select("lang", "phrase", "size", F.col("n").alias("a"), F.explode(F.when(F.col("size") == 2, of_two).otherwise(of_three)).alias("c"))
    counts = found.where("size in (1, 2)").select("lang", F.col("phrase").alias("part"), F.col("n").alias("f"))
    joined = parts.select("lang", "phrase", "size", "a", "c.k", "c.side", "c.part").join(counts, ["lang", "part"])
    at = lambda k, side: F.max(F.when((F.col("k") == k) & (F.col("side") == side), F.col("f")))
    cut = joined.groupBy("lang", "phrase", "size", "a").agg(
        at(1, "l").alias("l1"), at(1, "r").alias("r1"), at(2, "l").alias("l2"), at(2, "r").alias("r2")
    )

    def score(left: str, right: str) -> Column:
        return F.expr(
            f"(cast({SCALE} as decimal(7, 0)) * cast(a as decimal(14, 0)) * cast(a as decimal(14, 0)))"
            f" div (cast({left} as decimal(14, 0)) * cast({right} as decimal(14, 0)))"
        )

    option = lambda k: F.struct(score(f"l{k}", f"r{k}").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))
    scored = cut.withColumn("c", F.when(F.col("size") == 2, option(1)).otherwise(F.least(option(1), option(2))))
    inner = split.where("size = 3").select("lang", "n", F.explode(F.array(phrase_of(1, 2), phrase_of(2, 2))).alias("phrase"))
    longer = inner.groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    alone = scored.join(longer, ["lang", "phrase"], "left").where(
        (F.col("size") == 3) | F.col("longer").isNull() | (100 * F.col("longer") < nested_share * F.col("a"))
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    flat = alone.select("lang", "phrase", "a", "c.l", "c.r", "c.score")
    best = flat.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    total = found.where("size = 0").select("lang", "n")
    return best.join(total, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )
