"""Spelling variants against all pairs of a small vocabulary."""

import random
import re
import zlib
from collections import Counter

import pytest

from rackmeter.llm import variants


def runs(rows, noise, least):
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{low}".encode())
            if noise and h % noise == 0:
                low = low[: h % len(low)] + low[h % len(low) + 1 :]
            counts[low] += len(low) >= least
    return counts


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows, min_count=5, least=6, noise=199, dominance=5):
    n = {w: k for w, k in runs(rows, noise, least).items() if k >= min_count}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        if best is not None and n[best] >= dominance * n[w]:
            form[w] = best
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(near[w]), n.get(form.get(w))))
    return out


def vocabulary(rng, size):
    words = ["".join(rng.choice("abéÿ÷") for _ in range(rng.randint(6, 9))) for _ in range(size)]
    for w in words[: size // 2]:
        i = rng.randrange(len(w))
        words.append(rng.choice([w[:i] + w[i + 1 :], w[:i] + "c" + w[i:], w[:i] + "c" + w[i + 1 :]]))
    return words


@pytest.mark.parametrize(("noise", "hot"), [(199, 8192), (3, 8192), (0, 20)])
def test_spelling_groups(spark, noise, hot):
    rng = random.Random(5)
    words = vocabulary(rng, 250)
    rows = [(i, " ".join(rng.choices(words, [2.0 ** -(k % 9) for k in range(len(words))], k=60))) for i in range(400)]
    rows += [(1, "HAUSER Hauser,hauser " * 30), (2, "häuser " * 6 + "Häusérn " * 5), (None, "nokeyhere " * 5), (3, None), (4, "")]
    rows += [(5, "Aß ×÷×÷×÷ ĀbcdefĀ " * 6), rows[0], rows[0], (6, "q" * 70 + " "), (7, ("r" * 100 + " ") * 5 + ("r" * 101 + " ") * 25)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS word", "2 AS n", "3 AS key", "4 AS part")
    got = variants.spelling_groups(docs.repartition(4), noise=noise, hot=hot).collect()
    assert len(got) == len({r.word for r in got})
    assert {tuple(r) for r in got} == plain(rows, noise=noise)


def test_windows_of_a_long_text(spark, monkeypatch):
    rng = random.Random(6)
    text = "".join(rng.choice(["straße ", "Strasse-", "größer9", "a", "é", "\n", "x" * 90]) for _ in range(20_000))
    rows = [(1, text), (2, "short strasse")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = {tuple(r) for r in variants.count_words(docs).collect()}
    assert whole == set(runs(rows, 199, 6).items()) - {(w, 0) for w in runs(rows, 199, 6)}
    import numpy as np
    import pyarrow as pa

    from rackmeter.llm.common import text_windows

    parts = list(text_windows(pa.array([text]), variants._BREAK, 1000))
    assert len(parts) > 50
    assert b"".join(np.asarray(d).tobytes() for _, _, d, _ in parts) == text.encode()
    cut = Counter()
    for _, _, data, offsets in parts:
        cut.update(variants._runs(data, offsets, np.array([zlib.crc32(b"1:")], dtype=np.uint32), 199, 6).to_pylist())
    assert cut == {w: k for w, k in runs(rows[:1], 199, 6).items() if k}


def test_no_rows(spark):
    empty = spark.createDataFrame([], "doc_id string, text string")
    assert variants.spelling_groups(empty).collect() == []
