"""Encoding with a vocabulary of merge-type pieces by a table of last tokens per prefix.

For each prefix of a word there is one token that can end its encoding. It is found among the pieces that an
automaton reports as ending there: the one that may follow the last token of what stands before it. Two
tokens may follow each other if merging the text of both would never have joined characters across their
border. Going back from the end of the word, the table yields the ids. The ids are those of merging
pairs step by step, but no step is ever undone or queued.

No piece holds a space mark after another character, so a text is encoded word by word (a word keeps the
space marks before it), and words are remembered. Runs of space marks have pieces of equal rank, for which
the order of merges depends on the place; words that begin with several marks are therefore merged
step by step, from a heap of pairs. Characters outside of the vocabulary become byte pieces.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rackmeter.llm.common import Remembered, lean, on_workers, per_task, text_column

SPACE = "▁"
CACHED_WORDS = 100_000
CACHED_PAIRS = 300_000
CACHED_LENGTH = 64
NORMAL, BYTE = 1, 6
ROWS = 256


class PieceEncoder:
    """Encoder over the pieces of a sentencepiece model file of the merge type."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as model_pb2

        model = model_pb2.ModelProto()
        with open(path, "rb") as source:
            model.ParseFromString(source.read())
        spec = model.normalizer_spec
        if (
            model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback or spec.precompiled_charsmap
            or spec.remove_extra_whitespaces or not spec.add_dummy_prefix
        ):
            raise ValueError("only merge-type models with byte pieces and without normalisation are known here")
        self.library = SentencePieceProcessor(model_file=path)
        self.piece = [p.piece for p in model.pieces]
        self.rank = [-p.score for p in model.pieces]
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("pieces must not hold a space mark after another character")
        self.parts: dict[int, tuple[int, int]] = {}
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            if len(piece) == 1 or not piece.startswith(SPACE * 2) and self.merge(piece) == [i]:
                self.automaton.add_word(piece, (len(piece), i))
        self.automaton.make_automaton()
        joined = {b for p in self.ids for a, b in zip(p, p[1:]) if a.isalpha()}
        self.marks = "".join(c for c in ".,;:!?" if c not in joined)
        self.stems = _Stems(self)
        self.words = _Words(self, self.stems)
        per_task(self.stems)
        per_task(self.words)
        self.pairs = _Pairs(self)

    def merge(self, word: str) -> list[int]:
        """Ids by merging pairs step by step, the best rank first and the leftmost among equals.

        Pairs wait in a heap, so the time is near-linear. A pair is out of date if one of its places was merged since.
        """
        ids, rank = self.ids, self.rank
        tokens = [ids.get(c, -1) for c in word]
        texts: list[str | None] = list(word)
        following = [*range(1, len(word)), -1]
        before = list(range(-1, len(word) - 1))
        queue: list[tuple[float, int, int, int, int]] = []

        def offer(left: int, right: int) -> None:
            joined = ids.get(texts[left] + texts[right])
            if joined is not None:
                heapq.heappush(queue, (rank[joined], left, right, len(texts[left]), joined))

        for k in range(len(word) - 1):
            offer(k, k + 1)
        alive = len(word)
        while queue:
            _, left, right, length, joined = heapq.heappop(queue)
            if texts[left] is None or texts[right] is None or len(texts[left]) != length or following[left] != right:
                continue
            if len(texts[left]) + len(texts[right]) != len(self.piece[joined]):
                continue
            if alive == 2:
                self.parts[joined] = tokens[left], tokens[right]
            alive -= 1
            texts[left], texts[right], tokens[left] = self.piece[joined], None, joined
            after = following[left] = following[right]
            if after >= 0:
                before[after] = left
                offer(left, after)
            if before[left] >= 0:
                offer(before[left], left)
        out: list[int] = []
        for token, text in zip(tokens, texts):
            if text is not None:
                out += [token] if token >= 0 else [self.byte[b] for b in text.encode()]
        return out

    def split_of(self, token: int) -> tuple[int, int] | None:
        """The two tokens that the last merge of a token joined; None for a single character."""
        text = self.piece[token]
        if len(text) == 1:
            return None
        if token not in self.parts:
            self.merge(text)
        return self.parts[token]

    def compatible(self, left: int, right: int) -> bool:
        """Whether two tokens stay apart when the text of both is merged.

        Goes back in time: the younger of the two tokens at the border is taken apart, and each
        pair that stood at the border is asked whether it would have been merged before that.
        """
        ids, piece, rank = self.ids, self.piece, self.rank
        until = float("inf")
        strict = False
        while True:
            joined = ids.get(piece[left] + piece[right])
            if joined is not None and (rank[joined] < until or strict and rank[joined] == until):
                return False
            a, b = self.split_of(left), self.split_of(right)
            if a is None and b is None:
                return True
            # Of equal ranks the merge further left comes first, so then the right token is the younger one.
            if b is None or a is not None and rank[left] > rank[right]:
                until, strict, left = rank[left], False, a[1]
            else:
                until, strict, right = rank[right], True, b[0]

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word, with the space marks before it."""
        if word.startswith(SPACE * 2):
            return self.merge(word)
        n = len(word)
        last = [-1] * (n + 1)
        size = [0] * (n + 1)
        size[0] = 1
        pairs = self.pairs
        reached = 0
        for end, (length, token) in self.automaton.iter(word):
            end += 1
            if size[end]:
                continue
            start = end - length
            if not size[start]:
                if start < reached:
                    continue
                for k in range(reached + 1, start + 1):  # characters outside of the vocabulary
                    size[k] = 1
            before = last[start]
            if before >= 0 and not pairs[before << 20 | token]:
                continue
            last[end], size[end], reached = token, length, end
        out: list[int] = []
        while n:
            if last[n] >= 0:
                out.append(last[n])
                n -= size[n]
            else:
                out += [self.byte[b] for b in reversed(word[n - 1].encode())]
                n -= 1
        out.reverse()
        return out

    def encode(self, text: str) -> str:
        """The ids of a text, in decimal and joined by commas."""
        self.words.age()
        self.stems.age()
        if len(self.pairs) > CACHED_PAIRS:
            self.pairs.clear()
        return ",".join(map(self.words.__getitem__, split_words(text))) if text else ""


class _Pairs(dict):
    """Whether two tokens may stand side by side."""

    def __init__(self, encoder: PieceEncoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, pair: int) -> bool:
        found = self[pair] = self.encoder.compatible(pair >> 20, pair & (1 << 20) - 1)
        return found


class _Stems(Remembered):
    """Ids of words, or of parts of them, as text."""

    def __init__(self, encoder: PieceEncoder):
        super().__init__(CACHED_WORDS)
        self.encoder = encoder

    def __missing__(self, word: str) -> str:
        found = self.before.get(word)
        if found is None:
            found = ",".join(map(str, self.encoder.encode_word(word)))
        if len(word) <= CACHED_LENGTH:
            self[word] = found
        return found


class _Words(Remembered):
    """Ids of words as text; marks at the end of a word, which no piece joins with letters, are encoded apart."""

    def __init__(self, encoder: PieceEncoder, stems: _Stems):
        super().__init__(CACHED_WORDS)
        self.marks, self.stems = encoder.marks, stems

    def __missing__(self, word: str) -> str:
        found = self.before.get(word)
        if found is not None:
            self[word] = found
            return found
        stem = word.rstrip(self.marks)
        if stem == word or not stem[-1:].isalpha():
            found = self.stems[word]
        else:
            found = f"{self.stems[stem]},{self.stems[word[len(stem):]]}"
        if len(word) <= CACHED_LENGTH:
            self[word] = found
        return found


_RUN = re.compile(f"{SPACE}{{2,}}[^{SPACE}]*|{SPACE}?[^{SPACE}]+|{SPACE}")


def split_words(text: str) -> list[str]:
    """The words of a text with the space marks before them, the first one with the mark that is put before a text."""
    marked = SPACE + text.replace(" ", SPACE)
    if SPACE * 2 in marked or marked.endswith(SPACE):
        return _RUN.findall(marked)
    return [SPACE + word for word in marked[1:].split(SPACE)]


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def encode_pieces(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", ids: bool = False) -> DataFrame:
    """Ids of whole texts and the text decoded from them, a row per document.

    Columns: key, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256 and, if asked
    for, ids. Null and empty texts have no ids; repeated rows give repeated rows; ``docs`` may have any
    other columns, which are not read.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(model)
        for batch in batches:
            texts = text_column(batch, "text")
            for low in range(0, len(texts), ROWS):
                joined = list(map(own.encode, texts.slice(low, ROWS).to_pylist()))
                lists = [list(map(int, row.split(","))) if row else [] for row in joined]
                decoded = own.library.decode(lists, num_threads=1)
                columns = [
                    batch.column(0).slice(low, ROWS), pa.array(map(len, lists), pa.int64()),
                    pa.array([hashlib.sha256(row.encode()).hexdigest() for row in joined]),
                    pa.array([hashlib.sha256(row.encode()).hexdigest() for row in decoded]),
                ]
                if ids:
                    columns.append(pa.array(lists, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    names = [key, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * ids]
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids
    return on_workers(docs).select(F.col(key), F.col(text).alias("text")).mapInArrow(lean(encode), schema)
