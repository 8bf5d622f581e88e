"""An index writes what is read, and its postings cross the network once."""

import pytest
from pyspark.sql import functions as F

from quern.operators import retrieve, tfidf

ROWS = [(at, " ".join(f"w{at * k % 7}" for k in range(1, 6))) for at in range(1, 40)] + [(40, None), (41, "")]


@pytest.fixture
def written(monkeypatch):
    names, store = [], tfidf.store
    monkeypatch.setattr(tfidf, "store", lambda df, name, *sort: names.append(name) or store(df, name, *sort))
    return names


def index_of(spark, **options):
    return tfidf.build_index(spark.createDataFrame(ROWS, "doc_id bigint, text string"), "doc_id", "text", **options)


def table(df):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in row) for row in df.collect())


def test_only_what_is_read_is_written(spark, written):
    index = index_of(spark)
    assert not written and index.terms.count() and written == ["index-terms"]
    index = index_of(spark)
    del written[:]
    assert retrieve.search(index, "w1 w2", 3).count() == 3
    assert written == ["index-counts", "index-placed", "index-norms", "index-terms"]
    del written[:]
    assert retrieve.top_terms(index, 2).count() and written == ["index-vectors"]


def test_terms_are_the_same_from_texts_and_from_postings(spark):
    alone, with_postings = index_of(spark), index_of(spark)
    retrieve.prepare(with_postings)
    assert table(alone.terms) == table(with_postings.terms)


@pytest.mark.parametrize("options", [{}, {"max_features": 5, "min_df": 2}])
def test_sent_and_joined_norms_give_the_same_weights(spark, monkeypatch, options):
    sent = index_of(spark, long_term=5, run_docs=4, **options)
    want = [table(sent.postings), table(sent.blocks), table(sent.docs)]
    monkeypatch.setattr(tfidf, "NORM_DOCS", 0)
    joined = index_of(spark, long_term=5, run_docs=4, **options)
    assert [table(joined.postings), table(joined.blocks), table(joined.docs)] == want
    vectors = {(r.doc_id, r.term): round(r.weight, 9) for r in sent.vectors.collect()}
    assert {(doc, term): weight for doc, term, _, weight, _ in want[0]} == vectors and vectors


def test_an_empty_index(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    index = tfidf.build_index(docs, "doc_id", "text")
    assert retrieve.search(index, "a b", 3).isEmpty() and index.docs.isEmpty() and index.blocks is None
    assert index.vectors.agg(F.count("*")).first()[0] == 0


def test_one_vector_is_read_off_the_postings(spark, written):
    index = index_of(spark)
    alone = retrieve.similar(index, 3, 4)
    want = table(alone)
    assert want and "index-vectors" not in written
    assert index.vectors.count() and "index-vectors" in written and table(retrieve.similar(index, 3, 4)) == want


def test_rows_of_one_term_come_together(spark):
    lists = [(1, "a b a b".split()), (2, None), (3, []), (4, "b a b".split()), (None, ["a"])]
    rows = spark.createDataFrame(lists, "doc_id bigint, tokens array<string>").coalesce(1)
    found = [tuple(row) for row in tfidf.term_counts(rows).collect()]
    assert sorted(found, key=str) == sorted([
        (1, "a", 2), (1, "b", 2), (1, "a b", 2), (1, "b a", 1), (4, "a", 1), (4, "b", 2), (4, "b a", 1), (4, "a b", 1), (None, "a", 1),
    ], key=str)
    terms = [term for _, term, _ in found]
    assert sum(a != b for a, b in zip(terms, terms[1:])) == len(set(terms)) - 1
