"""A batch of queries: a posting moves once, however many queries ask for its term, and results equal sums of pairs."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.functions import scoring
from quern.operators import retrieve, segments, tfidf

VOCABULARY = [f"w{at}" for at in range(40)]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    weights = [1 / (at + 1) for at in range(len(VOCABULARY))]
    made = [(at, " ".join(rng.choices(VOCABULARY, weights, k=rng.randint(0, 15)))) for at in range(400)]
    return spark.createDataFrame(made + [(1000 + at, "w1 w2 w3") for at in range(30)], "doc_id bigint, text string")


@pytest.fixture(scope="module")
def queries(spark):
    rng = random.Random(5)
    return spark.createDataFrame([(at, " ".join(rng.choices(VOCABULARY, k=4))) for at in range(25)] + [(90, ""), (91, "zzz")], "query_id bigint, query string")


def rows(found):
    return sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 9)) for r in found.collect())


def brute(index, queries, limit):
    """Every query by itself, by a join."""
    vectors = retrieve.query_vectors(index, queries)
    pairs = index.postings.join(vectors, "term").groupBy("query_id", "doc_id").agg(F.sum(F.col("query_weight") * F.col("weight")).alias("score"))
    return rows(retrieve.top_k(pairs, limit))


@pytest.mark.parametrize("limit", [1, 7, 1500])
def test_batches_equal_sums_of_pairs(docs, queries, limit):
    index = tfidf.build_index(docs, "doc_id", "text")
    bounded = tfidf.build_index(docs, "doc_id", "text", run_docs=8, long_term=10)
    want = brute(index, queries, limit)
    assert rows(retrieve.search(index, queries, limit)) == want and rows(retrieve.search(bounded, queries, limit)) == want


def exchanged(df):
    """The largest number of rows that an exchange of the finished plan moved."""
    df.collect()
    plan, most = df._jdf.queryExecution().executedPlan(), 0
    left = [plan.finalPhysicalPlan() if "Adaptive" in plan.nodeName() else plan]
    while left:
        node = left.pop()
        if "QueryStage" in node.nodeName():
            node = node.plan()
        metric = node.metrics().get("shuffleRecordsWritten")
        if metric.isDefined():
            most = max(most, metric.get().value())
        children = node.children()
        left += [children.apply(at) for at in range(children.size())]
    return most


def test_a_posting_moves_once_for_all_queries(spark, docs):
    """A hundred queries of one term: the postings of that term move, not a hundred times as many rows."""
    index = tfidf.build_index(docs, "doc_id", "text", run_docs=8, long_term=10)
    asked = spark.range(100).select(F.col("id").alias("query_id"), F.lit("w0 w1").alias("query"))
    vectors, wanted = retrieve.settle(retrieve.query_vectors(index, asked), "vectors")
    terms = ["w0", "w1", "w0 w1"]
    n_postings = index.postings.where(F.col("term").isin(terms)).count()
    n_blocks = index.blocks.where(F.col("term").isin(terms)).count()
    assert 0 < exchanged(retrieve.scores(index, vectors)) <= n_postings
    _, numbers = retrieve.numbered(wanted, "query_weight", spark)
    matched = index.matched(numbers).select("doc_id", "number", "weight", "run", "df")
    bounds = retrieve.run_bounds(index, vectors, wanted, matched)
    assert 0 < exchanged(bounds) <= n_blocks + n_postings
    assert sorted(map(tuple, bounds.select("query_id", "run", F.round("bound", 9)).collect())) == sorted(
        map(tuple, retrieve.run_bounds(index, vectors, wanted).select("query_id", "run", F.round("bound", 9)).collect())
    )


def table(docs, numbers, weights):
    return pa.record_batch({"doc_id": pa.array(docs, pa.int64()), "number": pa.array(numbers, pa.int64()), "weight": pa.array(weights, pa.float64())})


def test_chunks_never_cut_a_document(monkeypatch):
    monkeypatch.setattr(scoring, "CHUNK_ROWS", 3)
    vectors = pa.table({"query_id": ["a", "a", "b"], "term": ["x", "y", "y"], "query_weight": [1.0, 2.0, 4.0]})
    queries, terms = scoring.asked(vectors, "query_weight")
    assert terms.to_pylist() == ["x", "y"] and queries.query_ids.to_pylist() == ["a", "b"]
    docs = [None, None, 1, 1, 1, 2, 2, 2, 2, 2, 3, 9]
    numbers = [0, 1, 0, 1, 1, 0, 0, 0, 0, 1, 1, 0]
    batches = [table(docs[at:at + 2], numbers[at:at + 2], [1.0] * 2) for at in range(0, 12, 2)]
    found = {(r["query_id"], r["doc_id"]): r["score"] for out in scoring.document_scores(iter(batches), queries, None) for r in out.to_pylist()}
    assert found == {
        ("a", None): 3.0, ("b", None): 4.0, ("a", 1): 5.0, ("b", 1): 8.0, ("a", 2): 6.0, ("b", 2): 4.0, ("a", 3): 2.0, ("b", 3): 4.0, ("a", 9): 1.0,
    }
    best = [r for out in scoring.document_scores(iter(batches), queries, 2) for r in out.to_pylist()]
    assert {("a", 2, 6.0), ("a", 1, 5.0), ("b", 1, 8.0)} <= {(r["query_id"], r["doc_id"], r["score"]) for r in best}
