"""Quality scores from pairwise preferences.

Each text is described by shares and lengths (no labels, languages, sources or ids). Every document of
label 1 is preferred to every one of label 0; the Bradley-Terry model gives document i the odds exp(s_i - s_j)
of being preferred to j, with s linear in the features, so the weights are those of a logistic loss on feature
differences. Documents are then told apart at a quantile of the scores: the share of label 0 in the training
rows. The score that is returned is a logistic function that takes the value ``THRESHOLD`` at that quantile.

The weights are fitted on a bounded sample: at most ``max_rows`` labelled rows, chosen by a hash of their id,
and ``max_pairs`` pairs of them. Everything else runs on all rows, the share and the quantile too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rackmeter.llm.common import (
    held_out, lean, mix64, on_workers, span_hashes, stored, text_column, text_slices, word_spans,
)
from rackmeter.llm.repetition import IS_SYMBOL
from rackmeter.operators.describe import exact_quantiles

THRESHOLD = 0.3
MAX_ROWS = 20_000
MAX_PAIRS = 200_000
MODULUS, REMAINDER = 5, 0

_BYTES = np.arange(256)
_UPPER = (_BYTES >= 0x41) & (_BYTES <= 0x5A)
_LETTER = _UPPER | (_BYTES >= 0x61) & (_BYTES <= 0x7A)
_DIGIT = (_BYTES >= 0x30) & (_BYTES <= 0x39)
_STOP = np.isin(_BYTES, np.frombuffer(b".,;:", dtype=np.uint8))
FEATURES = [
    "log_words", "short", "word_length", "long_words", "symbols", "shouts", "upper", "digits", "stops", "lines",
    "bars", "distinct", "echo", "repeated_windows", "repeated_lines", "inner_marks", "upper_words", "non_ascii",
]


def features(data: np.ndarray, offsets: np.ndarray, docs: int) -> np.ndarray:
    """One row of features per text; those of an empty text are 0 but for ``short``."""
    starts, ends, doc = word_spans(data, offsets)
    size = np.maximum(1, np.diff(offsets)).astype(float)
    bytes_of = lambda flags: np.diff(np.r_[0, np.cumsum(flags, dtype=np.int64)][offsets]) / size
    n = np.bincount(doc, minlength=docs)
    count = np.maximum(1, n).astype(float)
    words_of = lambda flags: np.bincount(doc[flags], minlength=docs) / count
    salt = mix64(doc.astype(np.uint64) + np.uint64(1))
    keys = mix64(span_hashes(data, starts, ends, fold=True) ^ salt)
    upper = np.r_[0, np.cumsum(_UPPER[data], dtype=np.int64)]
    letter = np.r_[0, np.cumsum(_LETTER[data], dtype=np.int64)]
    symbol = np.r_[0, np.cumsum(IS_SYMBOL[data] | (data == 0x21), dtype=np.int64)]
    distinct = np.bincount(doc[np.unique(keys, return_index=True)[1]], minlength=docs)
    echo = np.zeros(len(keys), dtype=bool)
    echo[1:] = keys[1:] == keys[:-1]
    repeated = np.zeros(len(keys), dtype=bool)
    if len(keys) > 2:
        three = mix64(mix64(mix64(keys[:-2]) ^ keys[1:-1]) ^ keys[2:])
        _, inverse, counts = np.unique(three, return_inverse=True, return_counts=True)
        repeated[:-2] = (counts[inverse] > 1) & (doc[:-2] == doc[2:])
    breaks = np.flatnonzero(data == 0x0A)
    line_starts = np.union1d(offsets[:-1][np.diff(offsets) > 0], breaks + 1)
    line_starts = line_starts[line_starts < len(data)]
    line_doc = np.searchsorted(offsets, line_starts, "right") - 1
    line_ends = np.minimum(np.r_[breaks, len(data)][np.searchsorted(breaks, line_starts)], offsets[line_doc + 1])
    lines = mix64(span_hashes(data, line_starts, line_ends) ^ mix64(line_doc.astype(np.uint64) + np.uint64(1)))
    n_lines = np.bincount(line_doc, minlength=docs)
    kinds = np.bincount(line_doc[np.unique(lines, return_index=True)[1]], minlength=docs)
    length = ends - starts
    two = (letter[ends] - letter[starts]) > 1
    columns = [
        np.log1p(n) / 10, n < 20, np.bincount(doc, length, docs) / count / 10, words_of(length > 20),
        bytes_of(IS_SYMBOL[data]), bytes_of(data == 0x21), bytes_of(_UPPER[data]), bytes_of(_DIGIT[data]),
        bytes_of(_STOP[data]), np.log1p(n_lines) / 10, bytes_of(data == 0x7C), np.where(n > 0, distinct / count, 0),
        words_of(echo), words_of(repeated), 1 - np.where(n_lines > 0, kinds / np.maximum(1, n_lines), 1),
        words_of((symbol[ends] - symbol[starts]) > 0),
        words_of(two & (upper[ends] - upper[starts] == letter[ends] - letter[starts])), bytes_of(data >= 0x80),
    ]
    base = np.stack([np.asarray(c, dtype=float) for c in columns], axis=1)
    return np.hstack([base, np.sqrt(np.abs(base[:, 4:])), np.minimum(1, 20 * base[:, 4:])])


def feature_rows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and features of each row."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in text_slices(text_column(batch, "text")):
                rows = features(data, offsets, high - low)
                flat = pa.array(rows.ravel())
                lists = pa.ListArray.from_arrays(np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32), flat)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), lists], names=[key, "features"])

    kind = docs.schema[key].dataType.simpleString()
    return on_workers(docs).select(F.col(key), F.col(text).alias("text")).mapInArrow(lean(describe), f"`{key}` {kind}, features array<double>"
    )


@dataclass
class Ranking:
    """Weights of the standardised features, and the place and steepness of the threshold."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float = 0.0

    def strength(self, rows: np.ndarray) -> np.ndarray:
        return np.clip((rows - self.mean) / self.scale, -10, 10) @ self.weights

    def score(self, rows: np.ndarray) -> np.ndarray:
        x = self.strength(rows) - self.cut + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(rows: np.ndarray, labels: np.ndarray, max_pairs: int = MAX_PAIRS, ridge: float = 1e-3) -> Ranking:
    """Bradley-Terry weights by Newton steps on the mean logistic loss over pairs of unlike labels."""
    width = rows.shape[1]
    good, bad = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    if not len(good) or not len(bad):
        # Nothing to compare: every document gets the same score, on the side of the label that is there.
        shift = 1.0 if len(bad) else -1.0
        return Ranking(np.zeros(width), np.ones(width), np.zeros(width), shift if len(rows) else -1.0)
    mean, scale = rows.mean(axis=0), rows.std(axis=0)
    scale[scale == 0] = 1
    z = np.clip((rows - mean) / scale, -10, 10)
    picks = np.random.default_rng(7)
    each = max(1, min(len(good), max_pairs // len(bad)))
    left = z[good[picks.integers(0, len(good), each * len(bad))]]
    difference = left - z[np.repeat(bad, each)]
    weights = np.zeros(width)
    for _ in range(30):
        chance = 1 / (1 + np.exp(-np.clip(difference @ weights, -30, 30)))
        slope = difference.T @ (chance - 1) / len(difference) + ridge * weights
        curve = (difference * (chance * (1 - chance))[:, None]).T @ difference / len(difference)
        step = np.linalg.solve(curve + ridge * np.eye(width), slope)
        weights -= step
        if np.abs(step).max() < 1e-6:
            break
    return Ranking(mean, scale, weights)


def labelled(labels: DataFrame) -> DataFrame:
    """doc_id and label of the rows outside of the held-out fold."""
    rows = labels.where(F.col("quality").isin(0, 1) & ~held_out("doc_id", MODULUS, REMAINDER))
    return rows.groupBy("doc_id").agg(F.max("quality").alias("label"))


def fit_sample(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_pairs: int = MAX_PAIRS) -> Ranking:
    """Weights from at most ``max_rows`` labelled documents outside of the held-out fold; the cut is still open."""
    chosen = labelled(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = feature_rows(docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi"))
    found = rows.join(F.broadcast(chosen), "doc_id").orderBy("doc_id").limit(max_rows).toPandas()
    width = features(np.zeros(0, np.uint8), np.zeros(2, np.int64), 1).shape[1]
    matrix = np.stack(found["features"].to_numpy()) if len(found) else np.zeros((0, width))
    return fit(matrix, found["label"].to_numpy(), max_pairs)


def with_cut(ranking: Ranking, strengths: DataFrame, labels: DataFrame) -> Ranking:
    """The ranking with its cut: the exact quantile, over all labelled rows, at the share of label 0 among them."""
    rows = strengths.join(labelled(labels), "doc_id").select("strength", "label")
    share = rows.agg(F.avg((F.col("label") == 0).cast("int"))).first()[0]
    if not share or share == 1:  # nothing to compare
        return ranking
    cut = exact_quantiles(rows, "strength", [share]).first()[0]
    return replace(ranking, cut=cut)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_pairs: int = MAX_PAIRS) -> Ranking:
    """Weights from a bounded sample, cut from all labelled documents outside of the held-out fold."""
    ranking = fit_sample(docs, labels, max_rows, max_pairs)
    return with_cut(ranking, stored(strength_of(docs, ranking), "strengths"), labels)


def score_of(strength: Column, ranking: Ranking) -> Column:
    """Score of a strength."""
    x = strength - ranking.cut + float(np.log(THRESHOLD / (1 - THRESHOLD)))
    return 1 / (1 + F.exp(-F.least(F.greatest(x, F.lit(-30.0)), F.lit(30.0))))


def strength_of(docs: DataFrame, ranking: Ranking, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and strength of every row; null and empty texts have that of a text without words."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in text_slices(text_column(batch, "text")):
                found = ranking.strength(features(data, offsets, high - low))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(found)], names=[key, "strength"])

    kind = docs.schema[key].dataType.simpleString()
    rows = on_workers(docs).select(F.col(key), F.col(text).alias("text"))
    return rows.mapInArrow(lean(score), f"`{key}` {kind}, strength double")


def score_documents(docs: DataFrame, ranking: Ranking, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and score (0 to 1) of every row; null and empty texts have the score of a text without words."""
    return strength_of(docs, ranking, key, text).select(key, score_of(F.col("strength"), ranking).alias("score"))


def accepted(docs: DataFrame, ranking: Ranking, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, with all their columns."""

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        filled = column.fill_null("")
        found = [ranking.score(features(d, o, high - low)) for low, high, d, o in text_slices(filled)]
        return pa.array(np.concatenate(found) if found else [], pa.float64())

    return on_workers(docs).where(score(text) >= threshold)
