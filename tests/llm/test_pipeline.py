"""Queries and pipeline at the smallest scale."""

import pytest

import corpus_pipeline
from tamiz.llm.queries import QUERIES, SQL
from tests.check import as_rows, database

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    done = database(FOLDER).execute(SQL[name])
    want = as_rows([c[0] for c in done.description], done.fetchall())
    df = QUERIES[name](spark, FOLDER)
    assert as_rows(df.columns, df.collect()) == want


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    docs = docs.selectExpr("*", "1 AS score", "2 AS copies", "'x' AS passages", "3 AS code")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if name != "token files":
            assert out.columns == [*columns, "score", "copies", "passages", "code"]
            assert out.subtract(docs).isEmpty()
        counts.append(out.count())
        docs = out
    assert counts[0] > counts[2] > counts[3] > counts[4] == counts[5] > 0.6 * counts[0]
    passages = [r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    kept = spark.read.parquet(str(tmp_path / "mixture")).collect()
    assert not any(p in r.text for r in kept for p in passages)


def test_pipeline_over_no_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, FOLDER).collect() == []
