"""Blocks and frequencies of a segment come from one pass over ordered postings, whatever its batches are."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quern.operators import retrieve, segments, tfidf


@pytest.fixture
def docs(spark):
    rng = random.Random(4)
    rows = [(k, " ".join(rng.choices(["w1", "w2", "w3", "w4", "w5"], k=rng.randint(1, 9)))) for k in range(120)]
    return spark.createDataFrame(rows, "doc_id bigint, text string")


@pytest.fixture
def small_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "3")
    yield
    spark.conf.set(name, before)


def found(rows):
    return sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 9)) for r in rows.collect())


def test_blocks_are_made_without_a_shuffle(spark, docs, small_batches, monkeypatch):
    plans, store = {}, tfidf.store

    def kept(df, name, *rest):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return store(df, name, *rest)

    monkeypatch.setattr(tfidf, "store", kept)
    index = tfidf.build_index(docs, "doc_id", "text", run_docs=16, long_term=5)
    rows = index.blocks
    assert "BroadcastExchange" in plans["index-blocks"] and "Exchange hashpartitioning" not in plans["index-blocks"]
    assert "Exchange rangepartitioning" not in plans["index-blocks"]
    most = index.postings.groupBy("term", "run").agg(F.max("weight").alias("most")).join(index.terms.where("df >= 5"), "term", "left_semi")
    assert sorted(map(tuple, rows.groupBy("term", "run").agg(F.max("most")).collect())) == sorted(map(tuple, most.collect()))
    # Blocks in several rows bound as one.
    plain = tfidf.build_index(docs, "doc_id", "text")
    asked = spark.createDataFrame([(1, "w1 w2"), (2, "w3 w4 w5")], "query_id bigint, query string")
    assert found(retrieve.search(index, asked, 4)) == found(retrieve.search(plain, asked, 4))
    assert found(retrieve.search(index, "w1 w2 w3", 4)) == found(retrieve.search(plain, "w1 w2 w3", 4))
    bounds = retrieve.run_bounds(index, retrieve.query_vectors(index, retrieve.one_query(index, "w1"), few=True)).collect()
    weights = {r.run: r.most for r in index.postings.where("term = 'w1'").groupBy("run").agg(F.max("weight").alias("most")).collect()}
    assert {r.run: round(r.bound, 9) for r in bounds} == {run: round(most, 9) for run, most in weights.items()}


def test_terms_of_a_generation_are_added_up_once(spark, docs, small_batches, tmp_path):
    index = segments.add(segments.create(spark, str(tmp_path)), docs, "doc_id", "text")
    plan = segments.terms(index)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    want = Counter(r.term for r in index.segments[0].postings.collect())
    assert {r.term: r.df for r in segments.terms(index).collect()} == dict(want)
    whole = tfidf.build_index(docs, "doc_id", "text")
    assert found(segments.search(index, "w1 w2", 5)) == found(retrieve.search(whole, "w1 w2", 5))
