"""Registered queries against SQL, and the pipeline against its parts, on the driver's smallest tables."""

import os

import duckdb
import pytest

import corpus_pipeline
from keyfold.llm import queries

DATA = os.environ.get("KEYFOLD_TEST_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.execute(queries.ORACLE_SQL[name]).df()
    got = queries.QUERIES[name](spark, DATA).toPandas()[list(want.columns)]
    assert sorted(map(tuple, got.to_numpy().tolist())) == sorted(map(tuple, want.to_numpy().tolist()))


def test_pipeline(spark):
    docs = queries.table(spark, DATA, "documents")
    frames = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, frames[-1], DATA).cache()
        assert out.columns == docs.columns and out.subtract(frames[-1]).isEmpty()
        frames.append(out)
    assert 0 < frames[-1].count() < docs.count()
    run = corpus_pipeline.run(spark, DATA)
    assert {r.doc_id for r in run.collect()} == {r.doc_id for r in frames[-1].collect()}


def test_pipeline_on_an_empty_table(spark):
    docs = queries.table(spark, DATA, "documents").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
        assert docs.isEmpty()


def test_stages_with_odd_rows(spark):
    from pyspark.sql import functions as F

    docs = queries.table(spark, DATA, "documents")
    odd = spark.createDataFrame([(10**6, None, None, None, None), (10**6 + 1, "", "en", "s", 0), (None, "no id here at all", "en", "s", 5)], docs.schema)
    for c in ("score", "row", "toxic", "leaks", "sum", "log_weight"):
        docs, odd = docs.withColumn(c, F.lit("mine")), odd.withColumn(c, F.lit("mine"))
    both = docs.unionByName(odd)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, both, DATA)
        assert out.columns == both.columns and out.where("doc_id = 1000001").count() == 1
    assert corpus_pipeline.STAGES[-1][1](spark, both, DATA).count() == both.count()
