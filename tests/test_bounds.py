"""Searches by bounds of runs find what plain searches find, and read little of frequent terms."""

import random

import pytest
from pyspark.sql import functions as F

from quern.operators import retrieve, skew, tfidf

WORDS = [f"w{at}" for at in range(80)]


def prose(n, seed=4):
    rng = random.Random(seed)
    weights = [1 / (at + 1) for at in range(len(WORDS))]
    return [(at, " ".join(rng.choices(WORDS, weights, k=rng.randint(1, 12)))) for at in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([*prose(600), *((1000 + at, "w1 w2") for at in range(40))], "doc_id bigint, text string")


@pytest.fixture(scope="module")
def plain(docs):
    return tfidf.build_index(docs, "doc_id", "text")


@pytest.fixture(scope="module", params=[(4, 1), (16, 60)])
def bounded(request, docs):
    run_docs, long_term = request.param
    return tfidf.build_index(docs, "doc_id", "text", run_docs=run_docs, long_term=long_term)


def rows(found):
    return sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 9)) for r in found.collect())


@pytest.fixture(scope="module")
def queries(spark):
    rng = random.Random(8)
    texts = ["w0", "w1 w2", "w79 w0", "w0 w1 w2 w3 w4 w5", "zzz", "", " ".join(WORDS)] + [" ".join(rng.choices(WORDS, k=3)) for _ in range(12)]
    return spark.createDataFrame(list(enumerate(texts)), "query_id bigint, query string")


def test_blocks_only_where_a_term_is_frequent(plain, bounded):
    assert plain.blocks is None and bounded.blocks is not None
    most = bounded.postings.groupBy("term", "run").agg(F.max("weight").alias("most"))
    long = bounded.terms.where(F.col("df") >= bounded.long_term)
    want = most.join(long, "term", "left_semi")
    assert sorted(map(tuple, bounded.blocks.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("limit", [1, 5, 45])
def test_bounded_batch_equals_plain_batch(plain, bounded, queries, limit):
    assert rows(retrieve.search(bounded, queries, limit)) == rows(retrieve.search(plain, queries, limit))


def test_one_query_and_pushing_change_nothing(plain, bounded, monkeypatch):
    want = rows(retrieve.search(plain, "w79 w0 w3", 7))
    assert rows(retrieve.search(bounded, "w79 w0 w3", 7)) == want
    assert retrieve.search(bounded, "w79", 0).isEmpty() and retrieve.search(bounded, "zzz", 3).isEmpty()
    monkeypatch.setattr(retrieve, "PUSHED_TERMS", 0)
    assert rows(retrieve.search(bounded, "w79 w0 w3", 7)) == want
    assert rows(retrieve.search(plain, "w79 w0 w3", 7)) == want


def test_batches_beyond_the_broadcast_bounds(plain, bounded, queries, monkeypatch):
    want = rows(retrieve.search(plain, queries, 5))
    monkeypatch.setattr(skew, "LOCAL_ROWS", 2)
    monkeypatch.setattr(skew, "BROADCAST_ROWS", 2)
    monkeypatch.setattr(skew.broadcast_if_small, "__defaults__", (2, 10))
    assert rows(retrieve.search(plain, queries, 5)) == want
    assert rows(retrieve.search(bounded, queries, 5)) == want


def test_filters_count_before_the_last_wanted_score(spark, plain, bounded, queries):
    catalog = plain.docs.select(
        F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 7 == 0, F.array(F.lit("A"))).when(F.col("doc_id") % 7 == 1, F.array(F.lit("B"), F.lit("C"))).alias("categories")
    )
    for index in (plain, bounded):
        found = retrieve.filtered_search(index, "w0 w5", catalog, ["A"], 6)
        assert rows(found) == rows(retrieve.filtered_search(plain, "w0 w5", catalog, ["A"], 6)) and found.where("doc_id % 7 != 0").isEmpty()
    kinds = F.when(F.col("query_id") % 3 == 0, F.array(F.lit("A"))).when(F.col("query_id") % 3 == 1, F.array(F.lit("C"), F.lit("A")))
    asked = queries.withColumn("filters", kinds)
    answers = [
        sorted((r.query_id, r["rank"], r.doc_id, r.score and round(r.score, 9)) for r in retrieve.answer_requests(index, catalog, asked, 4, 2).collect())
        for index in (plain, bounded)
    ]
    assert answers[0] == answers[1] and len(answers[0]) > 40


def test_similar_documents_by_bounds(plain, bounded):
    assert rows(retrieve.similar(bounded, 3, 6)) == rows(retrieve.similar(plain, 3, 6))
    assert rows(retrieve.similar_padded(bounded, 3, 6)) == rows(retrieve.similar_padded(plain, 3, 6))


def test_a_frequent_term_beside_a_rare_one_is_hardly_read(spark):
    """A word of all documents and one of eight: under a tenth of the postings is read."""
    n = 6000
    text = F.concat(F.lit("common f"), F.col("id") % 97, F.lit(" g"), F.col("id") % 89, F.when(F.col("id") % 750 == 3, F.lit(" rare")).otherwise(F.lit("")))
    docs = spark.range(n).select(F.col("id").alias("doc_id"), text.alias("text"))
    analyzer = tfidf.Analyzer(largest=1)
    plain = tfidf.build_index(docs, "doc_id", "text", analyzer)
    index = tfidf.build_index(docs, "doc_id", "text", analyzer, run_docs=32, long_term=1000)
    vectors = retrieve.query_vectors(index, retrieve.one_query(index, "rare common"), few=True)
    best, taken = retrieve.bounded_top_k(index, vectors, 5, few=True)
    assert rows(best) == rows(retrieve.search(plain, "rare common", 5))
    asked = index.postings.where(F.col("term").isin("rare", "common"))
    assert asked.count() == n + n // 750
    assert asked.join(taken, "run", "left_semi").count() < asked.count() / 10


def test_browsing_by_category_lists_no_pairs(spark):
    """Every request shows the first documents of its categories; only the first of each category meet requests."""
    n, limit = 2000, 3
    catalog = spark.range(n).select("id", F.array(F.when(F.col("id") % 2 == 0, F.lit("A")).otherwise(F.lit("B")), F.lit("All")).alias("categories"))
    index = tfidf.build_index(spark.createDataFrame([(1, "x1")], "doc_id bigint, text string"), "doc_id", "text")
    filters = [["A"], ["B"], ["A", "B"], ["All", "nothing"], ["nothing"]]
    asked = spark.createDataFrame([(at, " ", filters[at % 5]) for at in range(50)], "query_id bigint, query string, filters array<string>")
    found = retrieve.answer_requests(index, catalog, asked, limit, 5)
    order = [r.id for r in catalog.orderBy(F.md5(F.concat_ws(":", F.col("id").cast("string"), F.lit("5"))), "id").collect()]
    want = set()
    for at in range(50):
        wanted = filters[at % 5]
        shown = [i for i in order if "All" in wanted or ("A" in wanted and i % 2 == 0) or ("B" in wanted and i % 2)]
        want |= {(at, i, rank) for rank, i in enumerate(shown[:limit], 1)}
    assert {(r.query_id, r.doc_id, r["rank"]) for r in found.collect()} == want
