"""Sums over the postings of documents: a task passes on a sum for each document, not one for each posting."""

import random

import pytest
from pyspark.sql import functions as F

from quern.operators import tfidf
from tests.test_batch_scores import exchanged


def postings(n_terms=300, n_docs=50):
    rng = random.Random(2)
    return [(doc or None, f"t{at:03}", rng.randint(1, 9)) for at in range(n_terms) for doc in range(n_docs) if rng.random() < 0.6]


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_sums_equal_a_plain_sum(spark, kind):
    rows = postings()
    made = spark.createDataFrame(rows, "doc_id bigint, term string, tf int").withColumn("doc_id", F.col("doc_id").cast(kind))
    want = {}
    for doc, _, tf in rows:
        key = doc if doc is None or kind == "bigint" else str(doc)
        n, total = want.get(key, (0, 0.0))
        want[key] = n + 1, total + tf * tf
    found = tfidf.document_sums(made, (F.col("tf") * F.col("tf")).cast("double")).collect()
    assert {r.doc_id: (r.n, r.total) for r in found} == want


def test_more_parts_do_not_shuffle_more(spark, tmp_path, monkeypatch):
    """Each of a few tasks passes on a sum for every document; before, each part of the postings did."""
    monkeypatch.setattr(tfidf, "SUM_TASKS", 1)
    rows = spark.createDataFrame(postings(), "doc_id bigint, term string, tf int")
    cores = spark.sparkContext.defaultParallelism
    for parts in (16, 64):
        dealt = rows.repartitionByRange(parts, "term").sortWithinPartitions("term")
        dealt = spark.createDataFrame(dealt.rdd, dealt.schema)
        assert 0 < exchanged(tfidf.document_sums(dealt, F.lit(1.0))) <= cores * 50
        assert exchanged(dealt.groupBy("doc_id").count()) > cores * 50


def test_a_missing_id_has_a_norm(spark):
    docs = spark.createDataFrame([(1, "a1 b1 a1"), (None, "b1 c1")], "doc_id bigint, text string")
    index = tfidf.build_index(docs, "doc_id", "text")
    assert sorted(index.scanned.select("term", "weight").collect()) == sorted(index.postings.select("term", "weight").collect())
    squares = tfidf.document_sums(index.scanned, F.col("weight") * F.col("weight")).collect()
    assert {r.doc_id: (r.n, round(r.total, 9)) for r in squares} == {1: (4, 1.0), None: (3, 1.0)}
    numbers = spark.createDataFrame([("b1", 0)], "term string, number long")
    assert {r.doc_id for r in index.matched(numbers).where("weight > 0").collect()} == {1, None}
