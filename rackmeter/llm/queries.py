"""One query per corpus operator on the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rackmeter.llm import (
    collocations, decontam, lattice, minhash, personal, pieces, ranking, repeats, repetition, secrets, token_files,
    variants, warc,
)
from rackmeter.llm.common import held_out, stored, table
from rackmeter.session import scratch_path

WORD_MODEL = public_tokenizers.path("word_bpe_49k.json")
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token-id files of all documents, read back through their index."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    store = token_files.token_store(spark, docs, scratch_path(spark, "tokens"), WORD_MODEL)
    return store.select(F.col("key").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of all documents and the texts decoded from them."""
    return pieces.encode_pieces(table(spark, sf_dir, "documents"), PIECE_MODEL)


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near-duplicates among all documents, on shingles of two words."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=2)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of all pages, read back."""
    read = warc.archived(table(spark, sf_dir, "pages"))
    return read.select(
        F.expr("try_cast(key AS long)").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.expr("try_cast(refers_to AS long)").alias("refers_to"),
    )


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the byte strings that occur more than once."""
    return repeats.remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


def op6_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality rules on all documents."""
    return repetition.quality_rules(table(spark, sf_dir, "documents"))


def op7_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    ranks = ranking.fit_sample(docs, labels)
    strengths = stored(ranking.strength_of(docs, ranks), "strengths")
    scored = strengths.withColumn("score", ranking.score_of(F.col("strength"), ranking.with_cut(ranks, strengths, labels)))
    return scored.select(
        "doc_id", held_out("doc_id", ranking.MODULUS, ranking.REMAINDER).alias("held_out"), "score",
        (F.col("score") >= ranking.THRESHOLD).cast("int").alias("predicted"),
    )


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents."""
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with passages of benchmark items."""
    return decontam.leaked(decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op10_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities of all documents under a piece lattice, beside smoothed word counts."""
    return lattice.score_texts(table(spark, sf_dir, "documents"), PIECE_MODEL)


def op11_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among the words of all documents."""
    return variants.spelling_groups(table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest phrases of each language in all documents."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    return personal.find_personal(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_token_files": op1_token_files, "op2_pieces": op2_pieces, "op3_minhash": op3_minhash, "op4_warc": op4_warc,
    "op5_repeats": op5_repeats, "op6_repetition": op6_repetition, "op7_ranking": op7_ranking,
    "op8_secrets": op8_secrets, "op9_decontamination": op9_decontamination, "op10_lattice": op10_lattice, "op11_variants": op11_variants,
    "op12_collocations": op12_collocations, "op13_personal": op13_personal,
}

SQL = {
    "op12_collocations": r"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[.,;:!?\x0A-\x0D]')) AS piece
            FROM documents
        ), texts AS (
            SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') AS w FROM pieces
        ), grams AS (
            SELECT lang, 1 AS size, unnest(w) AS phrase FROM texts
            UNION ALL
            SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM texts
            UNION ALL
            SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
            FROM texts
        ), f AS (SELECT lang, size, phrase, count(*) AS n FROM grams GROUP BY ALL
        ), candidates AS (
            SELECT lang, size, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND n >= 10
        ), cuts AS (
            SELECT c.*, k, array_to_string(w[:k], ' ') AS lp, array_to_string(w[k + 1:], ' ') AS rp
            FROM candidates c, (VALUES (1), (2)) AS v(k) WHERE k < size
        ), scored AS (
            SELECT c.lang, c.size, c.phrase, c.a, k, x.n AS l, y.n AS r,
                1000000::HUGEINT * c.a * c.a // (x.n::HUGEINT * y.n) AS score
            FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = lp JOIN f y ON y.lang = c.lang AND y.phrase = rp
        ), lowest AS (
            SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
        ), inner_pairs AS (
            SELECT lang, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS phrase, a FROM candidates WHERE size = 3
        ), longer AS (SELECT lang, phrase, max(a) AS m FROM inner_pairs GROUP BY ALL
        ), ranked AS (
            SELECT lowest.lang, row_number() OVER (
                    PARTITION BY lowest.lang ORDER BY score DESC, a DESC, lowest.phrase) AS rank, lowest.phrase, a, l, r, score
            FROM lowest LEFT JOIN longer ON longer.lang = lowest.lang AND longer.phrase = lowest.phrase
            WHERE size = 3 OR m IS NULL OR 100 * m < 50 * a
        ), totals AS (SELECT lang, sum(n) AS n FROM f WHERE size = 1 GROUP BY lang)
        SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
        FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
    """,
    "op4_warc": """
        WITH raw AS (
            SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(coalesce(html, '')) AS digest FROM pages
        ), firsts AS (SELECT digest, min(page_id) AS first_id FROM raw GROUP BY digest)
        SELECT page_id, octet_length(payload) AS payload_bytes,
            list_aggregate(list_transform(range(32), lambda i: substr(
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                1 + CAST((CAST('0x' || substr(raw.digest, CAST(1 + 10 * (i // 8) AS INTEGER), 10) AS BIGINT)
                    >> CAST(35 - 5 * (i % 8) AS BIGINT)) & 31 AS INTEGER), 1)), 'string_agg', '') AS payload_digest,
            CASE WHEN first_id < page_id THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN first_id < page_id THEN first_id END AS refers_to
        FROM raw JOIN firsts USING (digest)
    """,
}
