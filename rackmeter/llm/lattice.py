"""Probability of texts under a piece vocabulary, over all ways to cut their words into pieces.

The pieces of an existing vocabulary file and their scores are the start of the model: scores of merge files are
ranks, so a piece of rank r weighs 1 / (r + 1). Rounds of expectation and maximisation over the words of
the training documents turn these into probabilities. The probability of a word is the sum over all paths
through the lattice of its pieces, by forward recursion in log space; that of a text is the product over
its words and the end.

Texts are coded by *batches* of neighbouring documents: a batch row holds word codes and the batch's
dictionary, so what is shuffled are the words of each batch once and not every token. Dictionary entries
are summed up to corpus counts by word, words are scored once each, and the results go back to the
batches, where the sums per document are taken. Batches have a bounded size, so all groups are bounded
whatever the frequency of a word is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rackmeter.llm.common import (
    LOWER, crc_of_id, lean, on_workers, span_hashes, stored, text_column, text_slices, word_spans,
)

MODULUS, REMAINDER = 7, 2
BATCH_BYTES = 16 << 20
SLICE_BYTES = 4 << 20
ROUNDS = 1
SPACE = "▁"
LOG10 = np.log(10)


class Lattice:
    """Pieces of a vocabulary file and an automaton over them."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as model_pb2

        model = model_pb2.ModelProto()
        with open(path, "rb") as source:
            model.ParseFromString(source.read())
        self.size = len(model.pieces)
        self.end = next(i for i, p in enumerate(model.pieces) if p.piece == "</s>")
        self.byte = np.zeros(256, dtype=np.int64)
        rank = np.full(self.size, float(self.size))
        self.known = np.zeros(self.size, dtype=bool)
        self.known[self.end] = True
        self.automaton = ahocorasick.Automaton()
        for i, p in enumerate(model.pieces):
            if p.type == 1:
                self.automaton.add_word(p.piece, (len(p.piece), i))
                rank[i] = min(-p.score, float(self.size))
                self.known[i] = True
            elif p.type == 6:
                self.byte[int(p.piece[3:5], 16)] = i
                self.known[i] = True
        self.automaton.make_automaton()
        weight = np.where(self.known, 1 / (rank + 1), 0)
        with np.errstate(divide="ignore"):
            self.start = np.log(weight / weight.sum())

    def edges(self, words: list[str]) -> tuple[np.ndarray, ...]:
        """All arcs of the lattices of the words: word, first and last place, piece (or -1 - character for bytes)."""
        word, first, last, piece = [], [], [], []
        for number, text in enumerate(words):
            marked = SPACE + text
            single = [True] * len(marked)
            for end, (length, token) in self.automaton.iter(marked):
                word.append(number)
                first.append(end + 1 - length)
                last.append(end + 1)
                piece.append(token)
                if length == 1:
                    single[end] = False
            if True in single:
                for at, alone in enumerate(single):
                    if alone:
                        word.append(number)
                        first.append(at)
                        last.append(at + 1)
                        piece.append(-1 - ord(marked[at]))
        return tuple(np.array(c, dtype=np.int64) for c in (word, first, last, piece))

    def weights(self, piece: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """Log probability of each arc."""
        out = np.where(piece >= 0, scores[np.maximum(piece, 0)], 0.0)
        for at in np.flatnonzero(piece < 0).tolist():
            out[at] = scores[self.byte[list(chr(-1 - piece[at]).encode())]].sum()
        return out

    def forward(self, words: list[str], scores: np.ndarray) -> np.ndarray:
        """Log probability of each word over all of its paths."""
        return self._run(words, scores, False)[0]

    def expected(self, words: list[str], counts: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """Expected number of times each piece is used, in words that stand ``counts`` times in the corpus."""
        return self._run(words, scores, True, counts)[1]

    def _run(self, words: list[str], scores: np.ndarray, back: bool, counts=None) -> tuple[np.ndarray, np.ndarray | None]:
        total = np.zeros(len(words))
        uses = np.zeros(self.size) if back else None
        order = np.argsort([len(w) for w in words], kind="stable")
        low = 0
        while low < len(order):
            # words of like length together; the table of places stays small
            high = low + 1
            while high < len(order) and high - low < 8192 and (high - low + 1) * (len(words[order[high]]) + 2) < 1 << 20:
                high += 1
            some = order[low:high]
            low = high
            text = [words[k] for k in some.tolist()]
            length = np.array([len(t) + 1 for t in text])
            word, first, last, piece = self.edges(text)
            weight = self.weights(piece, scores)
            alpha = np.full((len(text), int(length.max()) + 1), -np.inf)
            alpha[:, 0] = 0
            self._sweep(alpha, word, first, last, weight)
            total[some] = alpha[np.arange(len(text)), length]
            if back:
                beta = np.full_like(alpha, -np.inf)
                # the same recursion from the other end: places counted from the end of each word
                beta[:, 0] = 0
                self._sweep(beta, word, length[word] - last, length[word] - first, weight)
                share = alpha[word, first] + weight + beta[word, length[word] - last] - total[some][word]
                share = np.exp(share) * counts[some][word]
                whole = piece >= 0
                uses += np.bincount(piece[whole], share[whole], self.size)
                for at in np.flatnonzero(~whole).tolist():
                    np.add.at(uses, self.byte[list(chr(-1 - piece[at]).encode())], share[at])
        return total, uses

    @staticmethod
    def _sweep(table: np.ndarray, word: np.ndarray, first: np.ndarray, last: np.ndarray, weight: np.ndarray) -> None:
        order = np.lexsort((word, last))
        word, first, last, weight = word[order], first[order], last[order], weight[order]
        bounds = np.searchsorted(last, np.arange(1, table.shape[1] + 1))
        for place in range(1, table.shape[1]):
            a, b = bounds[place - 1], bounds[place]
            if a == b:
                continue
            owner = word[a:b]
            heads = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            table[owner[heads], place] = np.logaddexp.reduceat(table[owner, first[a:b]] + weight[a:b], heads)


_LATTICES: dict[str, Lattice] = {}


def lattice(path: str) -> Lattice:
    if path not in _LATTICES:
        _LATTICES[path] = Lattice(path)
    return _LATTICES[path]


def _is_held_out(doc_id: int | None) -> bool:
    return doc_id is None or crc_of_id(doc_id) % MODULUS == REMAINDER


def coded(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Batches: ids and fold of their documents, word codes, and the dictionary with training counts."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        keys, hashes, sizes, kept, held = [], [], [], {}, 0

        def flush() -> pa.RecordBatch:
            every = np.concatenate(hashes)
            size = np.concatenate(sizes)
            out = np.array([_is_held_out(k) for k in keys])
            distinct, codes = np.unique(every, return_inverse=True)
            counts = np.bincount(codes, np.repeat(~out, size), len(distinct)).astype(np.int64)
            words = [kept[h] for h in distinct.tolist()]
            return pa.RecordBatch.from_arrays([
                pa.array([part << 24 | number], pa.int64()), pa.array([keys], pa.list_(kind)),
                pa.array([out.tolist()], pa.list_(pa.bool_())), pa.array([size.tolist()], pa.list_(pa.int64())),
                pa.array([codes.astype("<u4").tobytes()], pa.binary()), _one(pa.array(distinct.view(np.int64))),
                _one(pa.array(words, pa.string())), _one(pa.array(counts)),
            ], names=names)

        for batch in batches:
            kind = batch.schema.field(0).type
            for low, high, data, offsets in text_slices(text_column(batch, "text"), SLICE_BYTES):
                starts, ends, doc = word_spans(data, offsets)
                found = span_hashes(data, starts, ends, fold=True)
                distinct, at = np.unique(found, return_index=True)
                raw = LOWER[data].tobytes()
                for h, s, e in zip(distinct.tolist(), starts[at].tolist(), ends[at].tolist()):
                    if h not in kept:
                        kept[h] = raw[s:e].decode()
                keys += batch.column(0).slice(low, high - low).to_pylist()
                hashes.append(found)
                sizes.append(np.bincount(doc, minlength=high - low))
                held += len(data)
                if held >= BATCH_BYTES:
                    yield flush()
                    number += 1
                    keys, hashes, sizes, kept, held = [], [], [], {}, 0
        if keys:
            yield flush()

    kind_name = docs.schema[key].dataType.simpleString()
    names = ["batch", "ids", "held_out", "sizes", "codes", "hashes", "words", "counts"]
    return on_workers(docs).select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(lean(encode), f"batch long, ids array<{kind_name}>, held_out array<boolean>, sizes array<long>, codes binary, "
        "hashes array<long>, words array<string>, counts array<long>"
    )


def _one(values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.array([0, len(values)], dtype=np.int32), values)


@dataclass
class Corpus:
    """What the training documents say: tokens and distinct tokens (ends included), documents, piece scores."""

    tokens: int
    distinct: int
    documents: int
    scores: np.ndarray


def learn(batches: DataFrame, words: DataFrame, path: str, rounds: int = ROUNDS) -> Corpus:
    """Counts over all training documents, and piece scores from expected uses. The driver gets sums per piece."""
    documents = batches.select(F.explode("held_out").alias("h")).where("not h").count()
    sums = words.where("c > 0").agg(F.sum("c"), F.count("c")).first()
    model = lattice(path)
    scores = model.start

    def expect(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, uses = lattice(path), 0
        for frame in frames:
            for low in range(0, len(frame), 20_000):
                part = frame.slice(low, 20_000)
                counts = part.column(1).to_numpy().astype(float)
                uses = uses + own.expected(part.column(0).to_pylist(), counts, scores)
        if isinstance(uses, np.ndarray):
            used = np.flatnonzero(uses)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(uses[used])], names=["piece", "uses"])

    for _ in range(rounds):
        found = (
            on_workers(words).where("c > 0").select("word", "c").mapInArrow(lean(expect), "piece long, uses double")
            .groupBy("piece").agg(F.sum("uses").alias("uses")).toPandas()
        )
        uses = np.zeros(model.size)
        uses[found["piece"].to_numpy(dtype=np.int64)] = found["uses"]
        uses[model.end] = documents
        with np.errstate(divide="ignore"):
            scores = np.log(np.where(model.known, uses + 1, 0) / (uses.sum() + model.known.sum()))
    return Corpus((sums[0] or 0) + documents, (sums[1] or 0) + (documents > 0), documents, scores)


def score_texts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score and score (both log10) of every row.

    Words are separated by white space, A-Z counts as a-z, and every text has an end token, so null and empty
    texts have one token. Rows without key are held out; repeated rows count as often as they stand there.
    Other columns are not read.
    """
    batches = stored(coded(docs, key, text), "coded")
    entries = batches.select(F.inline(F.arrays_zip("hashes", "words", "counts"))).toDF("hash", "word", "count")
    words = stored(entries.groupBy("hash", "word").agg(F.sum("count").alias("c")), "words")
    corpus = learn(batches, words, path, rounds)
    kind = docs.schema[key].dataType.simpleString()
    scale = np.log10(corpus.tokens + corpus.distinct + 1)
    ends = corpus.documents

    def score(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lattice(path)
        for frame in frames:
            for low in range(0, len(frame), 20_000):
                part = frame.slice(low, 20_000)
                found = own.forward(part.column(1).to_pylist(), corpus.scores)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(found)], names=["hash", "c", "lp"])

    def total(batch: pd.DataFrame, dictionary: pd.DataFrame) -> pd.DataFrame:
        row = batch.iloc[0]
        n = len(dictionary)
        c, lp = np.zeros(n), np.zeros(n)
        c[dictionary["code"]], lp[dictionary["code"]] = dictionary["c"], dictionary["lp"]
        codes = np.frombuffer(row["codes"], dtype="<u4")
        sizes = np.asarray(row["sizes"], dtype=np.int64)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        of = lambda values: np.bincount(doc, values[codes], len(sizes)) if len(codes) else np.zeros(len(sizes))
        base = of(np.log10(c + 1)) + np.log10(ends + 1) - (sizes + 1) * scale
        return pd.DataFrame({
            key: pd.Series(list(row["ids"]), dtype=object), "held_out": np.asarray(row["held_out"], dtype=bool), "n_tokens": sizes + 1,
            "n_known": of((c > 0).astype(float)).astype(np.int64) + (ends > 0), "train_tokens": corpus.tokens,
            "base_score": base, "score": (of(lp) + corpus.scores[own_end]) / LOG10,
        })

    own_end = lattice(path).end
    scored = words.select("hash", "word", "c").mapInArrow(lean(score), "hash long, c long, lp double")
    places = batches.select(F.col("batch").alias("of"), F.posexplode("hashes").alias("code", "hash"))
    replies = places.join(scored, "hash").select("of", "code", "c", "lp")
    return (
        batches.select("batch", "ids", "held_out", "sizes", "codes").groupBy("batch").cogroup(replies.groupBy("of"))
        .applyInPandas(total, f"`{key}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, "
                       "base_score double, score double")
    )
