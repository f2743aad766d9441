"""Documents that hold benchmark passages, found by the q-gram lemma.

Every window of a benchmark text is looked for, whatever place it starts at. A window of m characters that occurs
in a text with at most k edits shares at least m + 1 - q (k + 1) of its q-grams with it, and all those matches
lie on at most k + 1 neighbouring diagonals (place in the text minus place in the item). Shared q-grams are counted
in bands of 2 (k + 1) diagonals that overlap by half, so one band holds them all: first per item and band, then,
in the bands that reach the bound, per window. Windows that reach it are verified by a banded alignment, all
others cannot occur. Capitals of ASCII and Latin-1 count as small letters.

The items are the stated query set: they are dealt into blocks of bounded size, each block is sent to
the executors as one index of an entry per character, and all texts are scanned against it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from rackmeter.llm.common import lean, on_workers, text_column, text_slices

Q = 8
WINDOW = 96
EDIT_SHARE = 0.08
BLOCK_CHARACTERS = 2_000_000
TABLE_BITS = 22
HITS = 500_000
ALIGNED = 4_000
SLICE = 1 << 20
OUTSIDE = 0xFFFFFFFF


def budget(length: int, share: float) -> int:
    """Edits allowed in a window."""
    return int(share * length)


def q_for(length: int, share: float, q: int) -> int:
    """The largest q-gram length up to ``q`` for which a match must share at least one q-gram."""
    k = budget(length, share)
    while q > 1 and length + 1 - q * (k + 1) < 1:
        q -= 1
    return q


def gram_hashes(text: np.ndarray, q: int) -> np.ndarray:
    """32-bit hashes of all runs of q characters."""
    h = np.zeros(max(0, len(text) - q + 1), dtype=np.uint32)
    for k in range(q):
        h = h * np.uint32(0x01000193) + text[k : k + len(h)]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return h ^ (h >> np.uint32(13))


def code_points(raw: bytes) -> np.ndarray:
    """Characters of UTF-8 text as numbers, capitals of the first 256 as small letters."""
    points = np.frombuffer(raw.decode().encode("utf-32-le"), dtype="<u4")
    return np.take(FOLD, points, mode="clip") + np.where(points > 0xFF, points - np.uint32(0xFF), np.uint32(0))


FOLD = np.arange(256, dtype=np.uint32)
FOLD[[*range(0x41, 0x5B), *range(0xC0, 0xD7), *range(0xD8, 0xDF)]] += 32


@dataclass
class Items:
    """Items of one q-gram length with their index: hashes in order, and the item and place of each.

    Every run of ``window`` characters of an item is looked for (the whole item if it is shorter).
    """

    q: int
    share: float
    window: int
    owners: list
    texts: list[np.ndarray]
    hashes: np.ndarray = field(init=False)
    item: np.ndarray = field(init=False)
    place: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        grams = [gram_hashes(t, self.q) for t in self.texts]
        sizes = [len(g) for g in grams]
        item = np.repeat(np.arange(len(grams)), sizes)
        place = np.concatenate([np.arange(s) for s in sizes])
        hashes = np.concatenate(grams)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.item, self.place = hashes[order], item[order], place[order]
        self.size = np.array([len(t) for t in self.texts])
        self.first = np.cumsum(self.size) - self.size
        self.flat = np.concatenate(self.texts)
        self.length = np.minimum(self.size, self.window)
        self.edits = np.array([budget(n, self.share) for n in self.length])
        self.least = np.maximum(1, self.length + 1 - self.q * (self.edits + 1))
        self.table = np.zeros(1 << TABLE_BITS, dtype=bool)
        self.table[self.hashes >> np.uint32(32 - TABLE_BITS)] = True

    def hits(self, text: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Item, place in the item and place in the text of shared q-grams, in portions of bounded size."""
        hashes = gram_hashes(text, self.q)
        hit = self.table[hashes >> np.uint32(32 - TABLE_BITS)]
        # A band that reaches the bound needs that many hits within the longest window and its edits.
        span = int(self.length.max() + self.edits.max())
        total = np.r_[0, np.cumsum(hit, dtype=np.int64)]
        at = np.flatnonzero(hit)
        around = total[np.minimum(at + span, len(hit))] - total[np.maximum(at - span, 0)]
        at = at[around >= self.least.min()]
        low = np.searchsorted(self.hashes, hashes[at], "left")
        count = np.searchsorted(self.hashes, hashes[at], "right") - low
        at, low, count = at[count > 0], low[count > 0], count[count > 0]
        doc = np.searchsorted(offsets, at, "right") - 1
        inside = at + self.q <= offsets[doc + 1]
        at, low, count = at[inside], low[inside], count[inside]
        first, sums = 0, np.cumsum(count)
        while first < len(at):
            last = max(first + 1, int(np.searchsorted(sums, (sums[first - 1] if first else 0) + HITS, "right")))
            some = slice(first, last)
            row = np.repeat(np.arange(last - first), count[some])
            entry = low[some][row] + np.arange(len(row)) - np.repeat(np.cumsum(count[some]) - count[some], count[some])
            yield self.item[entry], self.place[entry], at[some][row]
            first = last

    def regions(self, text: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Item, start in the item and first diagonal of the windows whose band reaches the bound."""
        none = np.zeros(0, dtype=np.int64)
        longest = int(self.size.max())
        base = 4 * (len(text) + longest) + 64

        def keys_of(item: np.ndarray, place: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            band = (at - place + longest) // (self.edits[item] + 1)
            return np.r_[item * base + band, item * base + band - 1], np.r_[place, place]

        # bands of whole items first: a band without enough hits has no window with enough
        counted = [np.unique(keys_of(*h)[0], return_counts=True) for h in self.hits(text, offsets)]
        if not counted:
            return none, none, none
        key, inverse = np.unique(np.concatenate([k for k, _ in counted]), return_inverse=True)
        total = np.bincount(inverse, np.concatenate([n for _, n in counted]))
        key = key[total >= self.least[key // base]]
        if not len(key):
            return none, none, none
        codes = []
        for h in self.hits(text, offsets):
            own, place = keys_of(*h)
            at = np.minimum(np.searchsorted(key, own), len(key) - 1)
            good = key[at] == own
            codes.append(at[good] * (longest + 1) + place[good])
        code = np.sort(np.concatenate(codes))
        # then each window of the bands that are left
        item = key // base
        starts = self.size[item] - self.length[item] + 1
        row = np.repeat(np.arange(len(key)), starts)
        start = np.arange(len(row)) - np.repeat(np.cumsum(starts) - starts, starts)
        of = item[row]
        from_ = row * (longest + 1) + start
        shared = np.searchsorted(code, from_ + self.length[of] - self.q + 1) - np.searchsorted(code, from_)
        good = shared >= self.least[of]
        row, start, of = row[good], start[good], of[good]
        return of, start, (key[row] % base) * (self.edits[of] + 1) - longest

    def verify(
        self, text: np.ndarray, offsets: np.ndarray, items: np.ndarray, starts: np.ndarray, diagonals: np.ndarray
    ) -> np.ndarray:
        """Rows (document, item, edits, start, end) of windows that occur; a band in two documents is aligned in each."""
        begins = diagonals + starts
        reach = self.length[items] + 2 * self.edits[items] + 1
        low, high = np.maximum(0, begins), np.minimum(len(text), begins + reach)
        first = np.searchsorted(offsets, low, "right") - 1
        docs = np.maximum(1, np.searchsorted(offsets, high, "left") - first)
        row = np.repeat(np.arange(len(items)), docs)
        doc = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(docs) - docs, docs)
        found = [np.zeros((0, 5), dtype=np.int64)]
        length, edits = self.length[items[row]], self.edits[items[row]]
        for m in np.unique(length):
            of_length = np.flatnonzero(length == m)
            for part in np.array_split(of_length, -(-len(of_length) // ALIGNED)):
                k, some = int(edits[part[0]]), items[row[part]]
                begin = begins[row[part]]
                at = begin[:, None] + np.arange(m + 2 * k + 1)
                inside = (at >= offsets[doc[part]][:, None]) & (at < offsets[doc[part] + 1][:, None])
                around = np.where(inside, text[np.clip(at, 0, len(text) - 1)], OUTSIDE)
                patterns = self.flat[(self.first[some] + starts[row[part]])[:, None] + np.arange(m)]
                cost, start, end = align(patterns, around, k)
                good = cost <= k
                base = offsets[doc[part]]
                size = offsets[doc[part] + 1] - base
                start, end = np.clip(begin + start - base, 0, size), np.clip(begin + end - base, 0, size)
                found.append(np.stack([doc[part], some, cost, start, end], axis=1)[good])
        return np.concatenate(found)


def passages(rows: np.ndarray) -> np.ndarray:
    """Overlapping rows (document, item, edits, start, end) of one document and item as one, with the fewest edits."""
    if not len(rows):
        return rows
    rows = rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]
    other = np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)]
    far = np.cumsum(other) * (int(rows[:, 4].max()) + 1)  # keeps the places of groups apart
    reach = np.maximum.accumulate(rows[:, 4] + far)
    new = np.r_[True, rows[1:, 3] + far[1:] > reach[:-1]] | other
    first = np.flatnonzero(new)
    out = rows[first].copy()
    out[:, 2] = np.minimum.reduceat(rows[:, 2], first)
    out[:, 4] = np.maximum.reduceat(rows[:, 4], first)
    return out


def align(patterns: np.ndarray, regions: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Banded alignment of pattern rows with region rows: fewest edits, start and end of the matched part.

    A row has one cell for each of the 2 (k + 1) diagonals of the band. The start of the best path is carried
    along in the low digits of the costs, so that among equal costs the latest start wins. Places outside of
    the document differ from every character and thus cost as much as leaving the character out.
    """
    width = regions.shape[1] - patterns.shape[1] + 1
    scale = np.int64(1 << 20)
    diagonal = np.arange(width, dtype=np.int64)
    row = np.broadcast_to(-diagonal, (len(patterns), width)).copy()
    for i in range(patterns.shape[1]):
        same = row + scale * (regions[:, i : i + width] != patterns[:, i : i + 1])
        same[:, :-1] = np.minimum(same[:, :-1], row[:, 1:] + scale)
        row = np.minimum.accumulate(same - scale * diagonal, axis=1) + scale * diagonal
    end = np.argmin(row, axis=1)
    best = row[np.arange(len(row)), end]
    cost = -(-best // scale)
    return cost, cost * scale - best, patterns.shape[1] + end


def scan(text: np.ndarray, offsets: np.ndarray, groups: list[Items]) -> list[tuple]:
    """(document, owner, edits, start, end) of all passages over all groups of items."""
    out = []
    for group in groups:
        if len(text):
            found = passages(group.verify(text, offsets, *group.regions(text, offsets)))
            out += [(d, group.owners[i], e, s, t) for d, i, e, s, t in found.tolist()]
    return out


def build(rows: list[tuple], share: float = EDIT_SHARE, q: int = Q, window: int = WINDOW) -> list[Items]:
    """Items from (owner, text), grouped by the q-gram length that their edits allow."""
    groups: dict[int, tuple[list, list]] = {}
    for owner, text in rows:
        if text:
            owners, texts = groups.setdefault(q_for(min(len(text), window), share, q), ([], []))
            owners.append(owner)
            texts.append(code_points(text.encode()))
    return [Items(length, share, window, *groups[length]) for length in sorted(groups)]


def leaks(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
    item_text: str = "text", window: int = WINDOW, share: float = EDIT_SHARE, q: int = Q,
    block_characters: int = BLOCK_CHARACTERS,
) -> DataFrame:
    """Benchmark passages in texts: key, item, edits, start and end (code points, end exclusive), a row each.

    Each run of ``window`` characters of an item counts that occurs with at most ``share`` edits; overlapping ones
    make one passage, with the fewest edits of its runs. Null and empty texts hold nothing, and null or empty items
    are held by nothing. Items shorter than a window count as a whole; repeated rows on either side give repeated
    results, and an empty table none. Keys and items may be of any type. Further columns of both tables are not read.
    """
    names = [key, "item_id", "edits", "start", "end"]
    kinds = [docs.schema[key].dataType.simpleString(), benchmark.schema[item].dataType.simpleString(), *["long"] * 3]
    schema = ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds))
    item_kind = to_arrow_type(benchmark.schema[item].dataType)
    texts = docs.select(F.col(key), F.col(text).alias("text"))

    def of_block(held: Broadcast) -> DataFrame:
        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            groups = build(held.value, share, q, window)
            for batch in batches:
                kinds = [batch.schema.field(0).type, item_kind, *[pa.int64()] * 3]
                for low, high, data, offsets in text_slices(text_column(batch, "text"), SLICE):
                    heads = np.r_[0, np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)]
                    points = code_points(data.tobytes())
                    found = scan(points, heads[offsets], groups)
                    keys = batch.column(0).slice(low, high - low).take(pa.array([f[0] for f in found], pa.int64()))
                    rest = [pa.array([f[k] for f in found], kinds[k]) for k in range(1, 5)]
                    yield pa.RecordBatch.from_arrays([keys, *rest], names=names)

        return on_workers(texts).mapInArrow(lean(find), schema)

    return reduce(DataFrame.unionAll, map(of_block, _blocks(benchmark, item, item_text, block_characters)))


def _blocks(benchmark: DataFrame, item: str, text: str, block_characters: int) -> list[Broadcast]:
    """The items in blocks that are small enough to be held by every executor."""
    items = benchmark.select(F.col(item).alias("item"), F.col(text).alias("whole")).where("char_length(whole) > 0")
    size = items.agg(F.sum(F.char_length("whole"))).first()[0] or 0
    blocks = max(1, -(-size // block_characters))
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item", "whole"), F.lit(blocks)))
    rows = lambda block: [(r.item, r.whole) for r in dealt.where(F.col("block") == block).select("item", "whole").collect()]
    return [benchmark.sparkSession.sparkContext.broadcast(rows(block)) for block in range(blocks)]


def without_leaks(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
    window: int = WINDOW, share: float = EDIT_SHARE, q: int = Q, block_characters: int = BLOCK_CHARACTERS,
) -> DataFrame:
    """The rows of ``docs`` whose text holds no benchmark passage, with all their columns.

    Each row is judged by its own text, so null and repeated keys play no part, and no row is moved.
    """
    for held in _blocks(benchmark, item, item_text, block_characters):

        def keep(batches: Iterator[pa.RecordBatch], held: Broadcast = held) -> Iterator[pa.RecordBatch]:
            groups = build(held.value, share, q, window)
            for batch in batches:
                clean = np.ones(len(batch), dtype=bool)
                for low, _, data, offsets in text_slices(text_column(batch, text), SLICE):
                    heads = np.r_[0, np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)]
                    clean[[low + f[0] for f in scan(code_points(data.tobytes()), heads[offsets], groups)]] = False
                yield batch.filter(pa.array(clean))

        docs = on_workers(docs).mapInArrow(lean(keep), docs.schema)
    return docs


def leaked(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per document and item: fewest edits of a passage, first start and last end of the passages found."""
    return found.groupBy(key, "item_id").agg(
        F.min("edits").alias("edits"), F.min("start").alias("start"), F.max("end").alias("end")
    )
