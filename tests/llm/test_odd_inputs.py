"""Inputs made to break things: colliding strings, repeated and null keys, long runs, thresholds over all rows."""

import math
import random
import time

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rackmeter.llm import lattice, minhash, pieces, queries, ranking, repetition, token_files
from rackmeter.llm.common import gram_hashes, held_out, span_hashes
from rackmeter.session import scratch_path
from tests.conftest import DATA

PIECES = public_tokenizers.path("piece_bpe_32k.model")
SWAP = str.maketrans("ab", "ba")


def doubled(steps):
    """A string and its twin whose polynomial hashes modulo 2^64 are equal for every odd base."""
    text = "a"
    for _ in range(steps):
        text += text.translate(SWAP)
    return text, text.translate(SWAP)


def spans(*texts):
    data = np.frombuffer("".join(texts).encode(), dtype=np.uint8)
    ends = np.cumsum([len(t.encode()) for t in texts])
    return data, ends - [len(t.encode()) for t in texts], ends


@pytest.mark.parametrize("steps", [10, 11, 14])
def test_doubled_strings_have_different_hashes(steps):
    one, other = doubled(steps)
    hashes = span_hashes(*spans(one, other, one))
    assert hashes[0] != hashes[1] and hashes[0] == hashes[2]


def test_hashes_across_blocks():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 256, 300_000).astype(np.uint8)
    data[150_000:220_000] = data[1_000:71_000]
    starts, ends = np.array([1_000, 150_000, 9, 9, 149_999]), np.array([71_000, 220_000, 9, 299_999, 219_999])
    got = span_hashes(data, starts, ends)
    assert got[0] == got[1] and len(set(got.tolist())) == 4
    alone = [span_hashes(data[a:b].copy(), np.array([0]), np.array([b - a]))[0] for a, b in zip(starts, ends)]
    assert got.tolist() == alone
    grams = gram_hashes(data, 64)
    assert len(grams) == len(data) - 63 and (grams[1_000:70_900] == grams[150_000:219_900]).all()
    assert (span_hashes(*spans("AbÉ", "aBÉ"), fold=True)[:1] == span_hashes(*spans("abÉ", "aBÉ"), fold=True)[1:]).all()


def test_doubled_strings_stay_apart_in_operators(spark):
    one, other = doubled(10)
    docs = spark.createDataFrame([(1, one), (2, other), (3, f"{one}\n{other}"), (4, f"x {one} {other}")], "doc_id long, text string")
    groups = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, words=2).collect()}
    assert groups == {1: 1, 2: 2, 3: 3, 4: 4}
    rules = {r.doc_id: r for r in repetition.quality_rules(docs).collect()}
    assert rules[3].n_dup_lines == 0 and rules[4].n_repeat_words == 0
    scored = {r.doc_id: r for r in lattice.score_texts(docs, PIECES).collect()}
    assert scored[4].n_known == 4 and scored[3].n_known == 3


def test_long_runs_of_spaces():
    own = pieces.encoder(PIECES)
    rng = random.Random(4)
    for n in (2, 3, 5, 16, 17, 31, 1000, 20_000):
        for tail in ("", "a", "über"):
            text = f"b{' ' * n}{tail}{' ' * (n // 2)}"
            assert own.encode(text) == ",".join(map(str, own.library.encode(text)))
    for _ in range(300):
        text = "".join(rng.choices(["  ", " ", "   ", "the", "a", "日", "\n"], k=30))
        assert own.encode(text) == ",".join(map(str, own.library.encode(text)))
    began = time.perf_counter()
    own.encode("a" + " " * 100_000 + "b")
    assert time.perf_counter() - began < 2


def test_token_index_of_few_often_repeated_keys(spark):
    docs = spark.range(40_000).select((F.col("id") % 2).alias("doc_id"), F.lit("one two").alias("text"))
    words = public_tokenizers.path("word_bpe_49k.json")
    got = token_files.token_store(spark, docs, scratch_path(spark, "few"), words)
    assert {r.key: r["count"] for r in got.groupBy("key").count().collect()} == {0: 20_000, 1: 20_000}


def test_archive_query_with_null_ids(spark, tmp_path):
    rows = [(None, "u", "<p>a"), (None, None, "<p>a"), (1, "u", "<p>a"), (2, "u", "<p>a"), (3, "u", None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = queries.op4_warc(spark, str(tmp_path)).collect()
    kinds = sorted(((r.page_id, r.record_type, r.refers_to) for r in got), key=str)
    assert kinds == sorted([
        (None, "response", None), (None, "response", None), (1, "response", None), (2, "revisit", 1), (3, "response", None),
    ], key=str)


WORDS = " ".join(f"w{i}" for i in range(40))
OTHER = " ".join(f"v{i}" for i in range(40))


def test_null_and_repeated_keys_among_near_duplicates(spark):
    rows = [(None, WORDS), (5, WORDS), (6, WORDS + " x"), (6, OTHER), (3, OTHER), (9, "alone at last"), (None, WORDS), (6, "")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.component_id, r.kept) for r in got), key=str) == sorted([
        (None, None, True), (None, None, True), (5, 3, False), (6, 3, False), (6, 3, False), (6, 6, True), (3, 3, True), (9, 9, True),
    ], key=str)


def test_pipeline_stages_decide_per_row(spark, tmp_path):
    leak = spark.read.parquet(f"{DATA}/benchmark.parquet").where("length(text) > 150").first().text
    rows = [(None, WORDS), (None, WORDS), (4, WORDS), (4, WORDS), (7, OTHER), (7, "quite another text " * 9), (None, "so " + leak), (8, leak), (8, "clean " * 9)]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "docs"))
    stages = dict(corpus_pipeline.STAGES)
    for some in (docs, spark.read.parquet(str(tmp_path / "docs"))):
        left = [(r.doc_id, r.text) for r in stages["deduplicate"](spark, some, DATA).collect()]
        expected = [(4, WORDS), (7, OTHER), (7, rows[5][1]), *rows[8:]]
        assert sorted(t for t in left if t[1][-20:] != leak[-20:]) == sorted(expected)
        clean = [(r.doc_id, r.text) for r in stages["decontaminate"](spark, some, DATA).collect()]
        assert sorted(clean, key=str) == sorted(rows[:6] + rows[8:], key=str)


def test_ranking_against_plain_fit(spark):
    rng = random.Random(6)
    texts, labels = [], []
    for i in range(600):
        good = i % 3 > 0
        words = ["the", "of", "house,", "river.", "walks", "slowly"] if good else ["$$$", "BUY", "now!!!", "###", "the", "1234"]
        texts.append((i, " ".join(rng.choices(words + ["and", "it"], k=rng.randint(5, 60)))))
        labels.append((i, int(good != (rng.random() < 0.1)), 0))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = ranking.train(docs, marks, max_pairs=5_000)
    data, starts, ends = spans(*[t for _, t in texts])
    rows = ranking.features(data, np.r_[starts, ends[-1]], len(texts))
    train = [not x for x in (r.h for r in docs.select(held_out("doc_id", 5, 0).alias("h")).collect())]
    rows, quality = rows[train], np.array([q for _, q, _ in labels])[train]
    # plain gradient descent on the same pairs
    z = np.clip((rows - rows.mean(axis=0)) / np.where(rows.std(axis=0) > 0, rows.std(axis=0), 1), -10, 10)
    good, bad = np.flatnonzero(quality == 1), np.flatnonzero(quality == 0)
    each = min(len(good), 5_000 // len(bad))
    picks = np.random.default_rng(7).integers(0, len(good), each * len(bad))
    difference = z[good[picks]] - z[np.repeat(bad, each)]
    weights = np.zeros(z.shape[1])
    loss = lambda w: np.logaddexp(0, -difference @ w).mean() + 5e-4 * w @ w
    for _ in range(20_000):
        weights -= 0.05 * (-difference.T @ (1 / (1 + np.exp(difference @ weights))) / len(difference) + 1e-3 * weights)
    assert loss(model.weights) <= loss(weights) + 1e-6
    assert np.abs(z @ model.weights - z @ weights).max() < 0.05 * np.abs(z @ weights).max() + 0.05
    assert math.isclose(model.cut, np.quantile(z @ model.weights, len(bad) / len(quality)), rel_tol=1e-9, abs_tol=1e-9)
    # the cut covers all labelled rows even if the sample is small
    small = ranking.train(docs, marks, max_rows=50)
    strength = small.strength(rows)
    assert math.isclose(small.cut, np.quantile(strength, len(bad) / len(quality)), rel_tol=1e-9, abs_tol=1e-9)
