"""Corpus preparation in stages; each is written as Parquet and read again as the documents of the next.

Every stage decides per row: null and repeated ids make no difference. Null and empty texts are scored like a
text without words, are nobody's duplicate and hold no passage or secret. Of rows that are alike but for their id the
one of the smallest id stays. Empty tables pass through; further columns are kept up to the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rackmeter.llm import decontam, minhash, pieces, ranking, secrets
from rackmeter.llm.common import on_workers, stored, table

PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of good quality; those that the classifier rejects go."""
    ranks = ranking.train(docs, table(spark, sf_dir, "labels"))
    return ranking.accepted(docs, ranks)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (shingles of five words), whatever its id is."""
    return minhash.without_duplicates(docs, words=5)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of benchmark items; each is judged by its own text."""
    return decontam.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret."""
    cleaned = on_workers(docs).withColumn("text", secrets.redacted("text"))
    return cleaned.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of the documents that are left."""
    return pieces.encode_pieces(docs, PIECE_MODEL, ids=True)


STAGES = [
    ("classify", classify), ("deduplicate", deduplicate), ("decontaminate", decontaminate), ("redact", redact),
    ("encode", encode),
]

#: SQL cannot express the classifier and the encoder; the tests compare with plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = stored(docs, f"stage-{name}")
    return docs


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir)


QUERIES = {"pipeline": pipeline}
SQL = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
