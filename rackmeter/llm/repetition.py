"""Quality rules on whole texts, with repetition measured on a suffix array of the words.

The suffixes of many documents are sorted together by prefix doubling; the document is part of the key, so
repeats are always within one document. From neighbours in this order come the longest common prefixes,
whose intervals of ``min_repeat`` words and more are the maximal repeated substrings. Their spans are
united per document. A document is kept if it passes the base rules, if no more than a share of its
words lies in repeats, and if its longest repeat stays below a limit that grows with its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rackmeter.llm.common import (
    IS_WHITE, lean, mix64, on_workers, span_hashes, text_column, text_slices, word_spans,
)

# Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
IS_SYMBOL = np.isin(np.arange(256), np.frombuffer(SYMBOLS.encode(), dtype=np.uint8))

MIN_REPEAT = 5
MAX_COVERED = 0.4
LONGEST_WORDS = 100
LONGEST_SHARE = 0.25


def suffix_array(words: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of all suffixes and the words that each shares with the one before it (0 across documents)."""
    n = len(words)
    if not n:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty
    keys = mix64(words ^ mix64(docs.astype(np.uint64) + np.uint64(1)))
    _, rank, counts = np.unique(keys, return_inverse=True, return_counts=True)
    first = np.cumsum(counts) - counts
    open_ = np.flatnonzero(counts[rank] > 1)
    rank = first[rank]
    ends = np.searchsorted(docs, docs, "right")
    levels, step = [], 1
    while len(open_):
        levels.append(rank)
        after = open_ + step
        follow = np.where(after < ends[open_], rank[np.minimum(after, n - 1)] + 1, 0)
        order = np.argsort(rank[open_] * (n + 1) + follow, kind="stable")
        sorted_, follow = open_[order], follow[order]
        old = rank[sorted_]
        outer = np.r_[True, old[1:] != old[:-1]]
        inner = outer | np.r_[True, follow[1:] != follow[:-1]]
        at = np.arange(len(sorted_))
        new = old + np.maximum.accumulate(np.where(inner, at, 0)) - np.maximum.accumulate(np.where(outer, at, 0))
        rank = rank.copy()
        rank[sorted_] = new
        alone = inner & np.r_[inner[1:], True]
        open_ = sorted_[~alone]
        step *= 2
    order = np.empty(n, dtype=np.int64)
    order[rank] = np.arange(n)
    common = np.zeros(n, dtype=np.int64)
    near = np.flatnonzero(levels[0][order[1:]] == levels[0][order[:-1]]) + 1 if levels else np.zeros(0, dtype=np.int64)
    left, right = order[near - 1], order[near]
    shared = np.zeros(len(near), dtype=np.int64)
    for level in range(len(levels) - 1, -1, -1):
        a, b = left + shared, right + shared
        fits = (a < ends[left]) & (b < ends[right])
        fits &= levels[level][np.minimum(a, n - 1)] == levels[level][np.minimum(b, n - 1)]
        shared += fits << level
    common[near] = shared
    return order, common


def repeats(words: np.ndarray, docs: np.ndarray, min_repeat: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether each word lies in a repeat of its document, and the longest repeat that starts there."""
    order, common = suffix_array(words, docs)
    longest = np.zeros(len(words), dtype=np.int64)
    longest[order] = np.maximum(common, np.r_[common[1:], 0] if len(common) else common)
    longest[longest < min_repeat] = 0
    at = np.arange(len(words))
    reach = np.maximum.accumulate(np.where(longest > 0, at + longest, 0)) if len(words) else at
    return reach > at, longest


def _counts(data: np.ndarray, offsets: np.ndarray, docs: int, min_repeat: int) -> dict[str, np.ndarray]:
    starts, ends, doc = word_spans(data, offsets)
    words = span_hashes(data, starts, ends)
    per_doc = lambda at, weights=None: np.bincount(at, weights, minlength=docs).astype(np.int64)
    within = lambda flags: np.diff(np.r_[0, np.cumsum(flags, dtype=np.int64)][offsets])

    # lines
    breaks = np.flatnonzero(data == 0x0A)
    first = np.union1d(offsets[:-1][np.diff(offsets) > 0], breaks + 1)
    first = first[first < len(data)]
    line_doc = np.searchsorted(offsets, first, "right") - 1
    last = np.minimum(np.r_[breaks, len(data)][np.searchsorted(breaks, first)], offsets[line_doc + 1])
    black = np.r_[0, np.cumsum(~IS_WHITE[data], dtype=np.int64)]
    full = black[last] > black[first]
    first, last, line_doc = first[full], last[full], line_doc[full]
    lines = mix64(span_hashes(data, first, last) ^ mix64(line_doc.astype(np.uint64) + np.uint64(1)))
    distinct = per_doc(line_doc[np.unique(lines, return_index=True)[1]])

    # windows of three words
    marked = np.zeros(len(words), dtype=bool)
    if len(words) > 2:
        with np.errstate(over="ignore"):
            three = words[:-2] * np.uint64(3) + mix64(words[1:-1]) * np.uint64(5) + mix64(mix64(words[2:])) * np.uint64(7)
        at = np.flatnonzero(doc[:-2] == doc[2:])
        keys = mix64(three[at] ^ mix64(doc[at].astype(np.uint64) + np.uint64(1)))
        _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
        at = at[counts[inverse] > 1]
        for k in range(3):
            marked[at + k] = True

    covered, longest = repeats(words, doc, min_repeat)
    most = np.zeros(docs, dtype=np.int64)
    np.maximum.at(most, doc, longest)
    return {
        "n_words": per_doc(doc), "word_chars": within(~IS_WHITE[data] & ((data & 0xC0) != 0x80)),
        "n_symbols": within(IS_SYMBOL[data]), "n_dup_lines": per_doc(line_doc) - distinct,
        "n_repeat_words": per_doc(doc[marked]), "covered_words": per_doc(doc[covered]), "longest_repeat": most,
    }


def quality_rules(
    docs: DataFrame, key: str = "doc_id", text: str = "text", min_repeat: int = MIN_REPEAT,
    max_covered: float = MAX_COVERED, longest_words: int = LONGEST_WORDS, longest_share: float = LONGEST_SHARE,
) -> DataFrame:
    """Counts and verdict per document.

    Columns: key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, covered_words,
    longest_repeat (long), base_failed, kept (boolean). Null and empty texts have no words and fail the
    base rules. Repeated rows are judged one by one, other columns are not read.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in text_slices(text_column(batch, "text")):
                found = _counts(data, offsets, high - low, min_repeat)
                words = found["n_words"]
                failed = (words < 50) | (100 * found["n_repeat_words"] > 50 * words)
                limit = np.maximum(longest_words, longest_share * words)
                kept = ~failed & (found["covered_words"] <= max_covered * words) & (found["longest_repeat"] <= limit)
                columns = [batch.column(0).slice(low, high - low), *(pa.array(c, pa.int64()) for c in found.values())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(failed), pa.array(kept)], names=names)

    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat"]
    names = [key, *counts, "base_failed", "kept"]
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, " + ", ".join(f"{c} long" for c in counts) + ", base_failed boolean, kept boolean"
    return on_workers(docs).select(F.col(key), F.col(text).alias("text")).mapInArrow(lean(count), schema)
