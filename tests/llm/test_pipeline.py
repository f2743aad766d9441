"""The pipeline stage by stage on the smallest tables, against plain versions of the stages."""

import hashlib

import duckdb
import pytest

import __spark_entry__ as entry
import brute
import corpus_pipeline
from rackmeter.llm import pieces, ranking, secrets
from rackmeter.llm.common import table
from tests.conftest import DATA


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, DATA, "documents")


def test_stages(spark, docs):
    left = {r.doc_id: r for r in docs.collect()}
    scores = {r.doc_id: r.score for r in ranking.score_documents(docs, ranking.train(docs, table(spark, DATA, "labels"))).collect()}
    left = {k: r.asDict() for k, r in left.items() if scores[k] >= 0.3}
    groups = brute.groups([(k, r["text"]) for k, r in left.items()], 5)
    left = {k: r for k, r in left.items() if groups[k] == k}
    items = [r.text for r in table(spark, DATA, "benchmark").collect()]
    exact = {k for k, r in left.items() if any(t in r["text"] for t in items)}
    stages = dict(corpus_pipeline.STAGES)
    after = spark.createDataFrame([tuple(r[c] for c in docs.columns) for r in left.values()], docs.schema)
    clean = {r.doc_id for r in stages["decontaminate"](spark, after, DATA).collect()}
    assert exact.isdisjoint(clean) and len(left) - len(clean) <= len(exact) + 2
    library = pieces.encoder(corpus_pipeline.PIECE_MODEL).library
    expected = set()
    for key in clean:
        text = left[key]["text"]
        text = secrets.redact(text, secrets.scan(text)[1])
        ids = library.encode(text)
        expected.add((key, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()))
    got = entry.queries()["pipeline"](spark, DATA).collect()
    assert {(r.doc_id, r.n_tokens, r.ids_sha256) for r in got} == expected and len(got) == len(expected)
    assert all(library.decode(r.ids) and len(r.ids) == r.n_tokens for r in got if r.n_tokens)


def test_stages_keep_columns_and_survive_odd_rows(spark, docs):
    odd = spark.createDataFrame(
        [(None, None, None, None, None), (1, "", "en", "a", 0), (1, "", "en", "a", 0), (2, "x " * 5000, None, "b", 1)], docs.schema
    )
    for rows in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, rows, DATA)
            assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
            out.collect()
        assert corpus_pipeline.STAGES[-1][1](spark, rows, DATA).count() == rows.count()


def test_warc_query_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{DATA}/pages.parquet'")
    cursor = con.execute(entry.oracle_sql()["op4_warc"])
    names = [c[0] for c in cursor.description]
    got = entry.queries()["op4_warc"](spark, DATA)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(tuple, got.select(names).collect()), key=str) == sorted(map(tuple, cursor.fetchall()), key=str)
