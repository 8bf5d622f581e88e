import math

import pytest
from pyspark.sql import functions as F

from quern.operators import retrieve, tfidf


def corpus(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def index_of(spark, rows, **options):
    return tfidf.build_index(corpus(spark, rows), "doc_id", "text", **options)


def test_index_keeps_ids_and_vocabulary(spark):
    index = index_of(spark, [(10, "tomato basil pasta"), (20, "tomato soup")])
    assert [r.doc_id for r in index.docs.orderBy("doc_id").collect()] == [10, 20]
    assert tfidf.index_facts(index).first().n_documents == 2
    words = [r.term for r in tfidf.vocabulary(index).collect()]
    assert words == sorted(words)
    assert {"tomato", "tomato soup", "basil pasta"} <= set(words)


def test_weights_follow_the_published_formula(spark):
    index = index_of(spark, [(1, "a1 a1 b1"), (2, "b1")], analyzer=tfidf.Analyzer(largest=1))
    rows = {(r.doc_id, r.term): r.weight for r in index.postings.collect()}
    idf_a, idf_b = math.log(3 / 2) + 1, math.log(3 / 3) + 1
    norm = math.hypot(2 * idf_a, idf_b)
    assert rows[(1, "a1")] == pytest.approx(2 * idf_a / norm)
    assert rows[(1, "b1")] == pytest.approx(idf_b / norm)
    assert rows[(2, "b1")] == pytest.approx(1.0)


def test_vectors_have_unit_length(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    index = tfidf.build_index(docs, "doc_id", "text")
    lengths = index.postings.groupBy("doc_id").agg(F.sum(F.col("weight") * F.col("weight")).alias("s"))
    assert lengths.where(F.abs(F.col("s") - 1) > 1e-9).isEmpty()


def test_top_terms(spark):
    index = index_of(spark, [(10, "tomato basil tomato pasta"), (20, "chicken soup broth")])
    top = retrieve.top_terms(index, limit=2, doc_id=10).orderBy("rank").collect()
    assert len(top) == 2 and top[0].term == "tomato" and top[0].weight > 0
    with pytest.raises(ValueError):
        retrieve.top_terms(index, doc_id=999)


def test_search_ranks_the_best_match_first(spark):
    index = index_of(spark, [(1, "tomato basil pasta"), (2, "chicken noodle soup"), (3, "basil pesto pasta")])
    found = retrieve.search(index, "tomato pasta", limit=2).orderBy("rank").collect()
    assert found[0].doc_id == 1 and found[0].score >= found[1].score
    assert retrieve.search(index, "tomato pasta", limit=0).isEmpty()


@pytest.mark.parametrize("query", ["", "   ", "zzz unknown"])
def test_blank_or_unknown_query_finds_nothing(spark, query):
    index = index_of(spark, [(1, "tomato basil pasta")])
    assert retrieve.search(index, query).isEmpty()


def test_similar_excludes_the_source(spark):
    index = index_of(spark, [(1, "tomato basil pasta"), (2, "tomato garlic pasta"), (3, "chicken soup broth")])
    found = retrieve.similar(index, 1, limit=2).orderBy("rank").collect()
    assert [r.doc_id for r in found] == [2]
    assert retrieve.similar(index, 999).isEmpty()
    padded = retrieve.similar_padded(index, 1).orderBy("rank").collect()
    assert [(r.doc_id, r.score > 0) for r in padded] == [(2, True), (3, False)]
    assert retrieve.similar_padded(index, 999).isEmpty()


def test_stopwords_are_bridged_by_bigrams(spark):
    analyzer = tfidf.Analyzer(stopwords=("and",))
    index = index_of(spark, [(1, "salt and pepper")], analyzer=analyzer)
    assert {r.term for r in index.terms.collect()} == {"salt", "pepper", "salt pepper"}


def test_title_boost_makes_the_wrapping_bigram(spark):
    df = spark.createDataFrame([(1, "red soup", "tomato")], "doc_id bigint, title string, body string")
    boosted = tfidf.boosted_text(df, "title", "body")
    assert boosted.first().text == "red soup red soup red soup tomato"


def test_vocabulary_limits(spark):
    rows = [(1, "aa aa bb"), (2, "aa cc"), (3, "bb dd")]
    words = tfidf.Analyzer(largest=1)
    assert {r.term for r in index_of(spark, rows, analyzer=words, max_features=2).terms.collect()} == {"aa", "bb"}
    assert {r.term for r in index_of(spark, rows, analyzer=words, min_df=2).terms.collect()} == {"aa", "bb"}
    assert {r.term for r in index_of(spark, rows, analyzer=words, max_df=1).terms.collect()} == {"cc", "dd"}


def test_stemmed_search_and_category_filter(spark):
    index = index_of(spark, [(1, "grilled tomatoes"), (2, "tomato soup"), (3, "soup")], analyzer=tfidf.STEMS)
    assert {r.doc_id for r in retrieve.search(index, "tomatoes").collect()} == {1, 2}
    catalog = spark.createDataFrame([(1, ["Main"]), (2, ["Soup", "Main"]), (3, ["Soup"])], "id bigint, categories array<string>")
    found = retrieve.filtered_search(index, "tomato", catalog, ["Soup"])
    assert [r.doc_id for r in found.collect()] == [2]
    named = retrieve.with_titles(found, spark.createDataFrame([(7, "x")], "id bigint, title string"))
    assert named.first().title == "Unknown"


def test_deep_limits_equal_shallow_ones(spark, monkeypatch):
    index = index_of(spark, [(at, f"common word{at % 7} extra{at % 3}") for at in range(200)])
    whole = retrieve.search(index, "common word3 extra1", 150)
    shallow = [tuple(r) for r in whole.orderBy("rank").collect()]
    monkeypatch.setattr(retrieve, "TASK_LIMIT", 10)
    deep = retrieve.search(index, "common word3 extra1", 150)
    assert [tuple(r) for r in deep.orderBy("rank").collect()] == shallow and len(shallow) == 150


def test_a_deep_limit_never_sorts_a_whole_query(spark):
    index = index_of(spark, [(1, "tomato basil"), (2, "tomato")])
    plan = retrieve.search(index, "tomato", 5000)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window [") == 2 and "_part" in plan


def test_one_document_reads_few_row_groups(spark, sf_dir):
    """Vectors are sorted by document, so the ranges that the files hold do not overlap."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        index = tfidf.build_index(docs, "doc_id", "text")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    ranges = index.vectors.groupBy(F.input_file_name().alias("f")).agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).orderBy("lo").collect()
    assert len(ranges) > 1 and all(a.hi < b.lo for a, b in zip(ranges, ranges[1:]))
    assert sum(r.lo <= 5 <= r.hi for r in ranges) == 1
    assert not retrieve.similar(index, 5).isEmpty()
    terms = index.postings.groupBy(F.input_file_name().alias("f")).agg(F.min("term").alias("lo"), F.max("term").alias("hi")).orderBy("lo", "hi").collect()
    assert all(a.hi <= b.lo for a, b in zip(terms, terms[1:]))


def test_requests(spark):
    index = index_of(spark, [(1, "tomato basil"), (2, "tomato soup"), (3, "bread"), (4, "basil")])
    catalog = spark.createDataFrame([(1, ["A"]), (2, ["B"]), (3, ["A", "B"]), (4, None)], "id bigint, categories array<string>")
    with pytest.raises(ValueError):
        retrieve.filtered_search(index, "tomato", catalog, [], limit=21, maximum=20)
    assert [r.doc_id for r in retrieve.filtered_search(index, "tomato", catalog, ["B"]).collect()] == [2]
    for seed in (None, 3):
        blank = retrieve.filtered_search(index, "  ", catalog, ["A"], seed=seed).collect()
        assert {r.doc_id for r in blank} == {1, 3} and sorted(r["rank"] for r in blank) == [1, 2] and blank[0].score is None
    asked = spark.createDataFrame(
        [(1, "tomato", []), (2, "tomato", ["A"]), (3, " ", ["B"]), (4, None, None), (5, "nothing known", None), (6, "basil", ["C"])],
        "query_id bigint, query string, filters array<string>",
    )
    rows = retrieve.answer_requests(index, catalog, asked, limit=3, seed=1).collect()
    found = {}
    for row in sorted(rows, key=lambda r: r["rank"]):
        found.setdefault(row.query_id, []).append(row.doc_id)
    assert found[1] in ([1, 2], [2, 1]) and found[2] == [1] and set(found[3]) == {2, 3} and len(found[4]) == 3 and set(found) == {1, 2, 3, 4}
    assert [r.doc_id for r in retrieve.filtered_search(index, "", catalog, [], limit=3, seed=1).orderBy("rank").collect()] == found[4]
