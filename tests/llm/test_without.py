"""The pipeline's removal of rows by their ids."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strataflow.llm.common import lookup_join


@pytest.fixture
def met(monkeypatch):
    """How many rows each lookup is given."""
    seen = []
    monkeypatch.setattr(corpus_pipeline, "lookup_join", lambda rows, small, *a, **b: seen.append(small.count()) or lookup_join(rows, small, *a, **b))
    return seen


def test_dense_ids_take_a_row_for_64(spark, met):
    docs = spark.range(6400).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    got = corpus_pipeline.without(docs, docs.filter("doc_id % 2 = 0").select("doc_id"))
    assert {r.doc_id for r in got.collect()} == set(range(1, 6400, 2))
    assert met == [100]


@pytest.mark.parametrize("most", [250_000, 0])
def test_only_the_ids_go(spark, monkeypatch, awkward, most):
    monkeypatch.setattr(corpus_pipeline, "DROPPED_ROWS", most)
    ids = [None, None, 0, 1, 1, 63, 64, -1, -64, -65, 2**63 - 1, -(2**63), 2**63 - 2, -(2**63) + 1, 10**12]
    docs = spark.createDataFrame([(i, str(n), n) for n, i in enumerate(ids)], "doc_id long, `_word` string, `_bits` int")
    for gone in ([], [None], [0, 63, -64, None, None], [1, 1, -1, 2**63 - 1, 7], [-(2**63), 10**12], ids):
        got = corpus_pipeline.without(docs, spark.createDataFrame([(i,) for i in gone], "doc_id long"))
        assert got.columns == docs.columns
        assert sorted(map(str, got.collect())) == sorted(str(r) for r in docs.collect() if r.doc_id is None or r.doc_id not in gone)
    got = corpus_pipeline.without(awkward, awkward.filter("doc_id in (1, 10)").select("doc_id"))
    assert sorted(map(str, got.collect())) == sorted(str(r) for r in awkward.collect() if r.doc_id not in (1, 10))
