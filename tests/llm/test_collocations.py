"""Collocations against plain counting of all phrases."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from rackmeter.llm import collocations


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall("[^ \t]+", piece) for piece in re.split("[.,;:!?\n-\r]", low)]


def counts_of(rows):
    f = Counter()
    for _, lang, text in rows:
        for words in words_of(text):
            for size in (1, 2, 3):
                for i in range(len(words) - size + 1):
                    f["und" if lang is None else lang, tuple(words[i : i + size])] += 1
    return f


def plain(rows, min_count=10, top=2000):
    f = counts_of(rows)
    total = Counter()
    for (lang, phrase), n in f.items():
        total[lang] += n * (len(phrase) == 1)
    out = defaultdict(list)
    for (lang, phrase), a in f.items():
        if len(phrase) == 1 or a < min_count:
            continue
        around = [n for (other, p), n in f.items() if other == lang and len(p) == 3 and n >= min_count and phrase in (p[:2], p[1:])]
        if len(phrase) == 2 and any(100 * n >= 50 * a for n in around):
            continue
        cuts = [(10**6 * a * a // (f[lang, phrase[:k]] * f[lang, phrase[k:]]), k) for k in range(1, len(phrase))]
        score, k = min(cuts)
        out[lang].append((-score, -a, " ".join(phrase).encode(), f[lang, phrase[:k]], f[lang, phrase[k:]]))
    return {
        (lang, i + 1, p.decode(), -a, l, r, total[lang], -s)
        for lang, found in out.items() for i, (s, a, p, l, r) in enumerate(sorted(found)[:top])
    }


def make(rng, rows):
    common = "the of La größe été x|y ÉtÉ $ \x0b".split(" ")
    rare = [f"w{i}" for i in range(300)]
    text = lambda n: "".join(rng.choice(common if rng.random() < 0.6 else rare) + rng.choice([" ", " ", "  ", "\t", ". ", ", ", "\n"]) for _ in range(n))
    return [(i, rng.choice(["en", "de", None, "a\nb"]), text(rng.randint(0, 120))) for i in range(rows)]


@pytest.mark.parametrize(("sample_of", "sample_count", "top"), [(8, 2, 2000), (1, 10, 2000), (1000, 1, 5), (2, 1, 7)])
def test_collocations(spark, sample_of, sample_count, top):
    rng = random.Random(3)
    rows = make(rng, 150)
    rows += [(200, "en", None), (201, "en", ""), (None, "en", "no key no key no key"), (202, None, " \n "), rows[0], rows[0], rows[1]]
    rows += [(300 + i, "en", "Late bloomers only here, late bloomers only") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").selectExpr("*", "1 AS gram", "2 AS n", "3 AS phrase")
    got = collocations.collocations(docs.repartition(3), sample_of=sample_of, sample_count=sample_count, top=top).collect()
    assert len(got) == len(set(got))
    assert {tuple(r) for r in got} == plain(rows, top=top)


def test_windows_repeat_two_words(spark, monkeypatch):
    rng = random.Random(4)
    rows = make(rng, 1)
    text = " ".join(r[2] for r in make(rng, 40)) + "one two three" * 3000
    what = collocations._Pass(None, True, 3)
    got = Counter()
    from rackmeter.llm.common import break_windows

    data = np.frombuffer(text.encode(), dtype=np.uint8)
    lang = pa.array(["en"]).dictionary_encode()
    carried = 0
    for start, end in break_windows(data, collocations.SEPARATOR, 50):
        parts, starts = collocations._count(data[carried:end], np.array([0, end - carried]), lang, start - carried, what)
        for grams, counts in parts:
            for gram, n in zip(grams.to_pylist(), counts.to_pylist()):
                got[tuple(gram.split("\n")[1].split(" "))] += n
        carried += int(starts[-2:][0]) if len(starts) else 0
    total = got.pop(("",))
    expected = {phrase: n for (_, phrase), n in counts_of([(1, "en", text)]).items()}
    assert got == expected and total == sum(n for p, n in expected.items() if len(p) == 1)
    assert rows


def test_no_rows(spark):
    empty = spark.createDataFrame([], "doc_id string, lang string, text string")
    assert collocations.collocations(empty).collect() == []


def test_scores_beyond_64_bits(spark):
    rows = [(i, "en", "a b " * 30_000) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    assert {tuple(r) for r in collocations.collocations(docs).collect()} == plain(rows)
