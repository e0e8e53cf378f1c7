"""The pipeline's stages over odd and ordinary documents."""

import pytest
from helpers import SF, against_duckdb

import corpus_pipeline
from partloom.llm.common import materialize
from partloom.llm.queries import ORACLE_SQL, QUERIES

SQL = sorted(ORACLE_SQL)


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "MinHash near-dedup", "mixing sources", "packing"]
    assert sorted(QUERIES, key=lambda n: int(n[2:].split("_")[0])) == list(QUERIES) and len(QUERIES) == 13


def test_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, SF), "test")
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts[0] > counts[1] == counts[2] >= counts[3]
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert pieces.agg({"length": "sum"}).first()[0] > 0
    assert sorted(map(str, corpus_pipeline.run(spark, SF).select("doc_id", "ids_crc32").distinct().collect()))


def test_empty(spark, no_docs):
    docs = no_docs.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), "test-empty")
        assert docs.count() == 0


@pytest.mark.parametrize("name", SQL)
def test_sql(spark, name):
    against_duckdb(QUERIES[name](spark, SF), ORACLE_SQL[name])
