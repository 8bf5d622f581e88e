"""Nearest documents of all documents against comparing every pair."""

import random

import pytest
from pyspark.sql import functions as F

from quern.operators import neighbours, retrieve, skew, tfidf

ONE_WORD = tfidf.Analyzer(largest=1)


def every_pair(index, limit, padded=False):
    vectors = {}
    for row in index.vectors.collect():
        vectors.setdefault(row.doc_id, {})[row.term] = row.weight
    known = sorted(row.doc_id for row in index.docs.collect())
    out = []
    for one in known:
        scored = []
        for other in known:
            score = sum(w * vectors.get(other, {}).get(t, 0.0) for t, w in vectors.get(one, {}).items())
            if other != one and (score > 0 or padded):
                scored.append((-round(score, 10), other))
        out += [(one, other, round(-score, 6) + 0.0, rank) for rank, (score, other) in enumerate(sorted(scored)[:limit], 1)]
    return out


def rows(found):
    return sorted((r.query_id, r.doc_id, round(round(r.score, 10), 6), r["rank"]) for r in found.collect())


@pytest.fixture(scope="module")
def index(spark):
    rng = random.Random(11)
    words = [f"w{at}" for at in range(150)]
    weights = [1 / (at + 1) for at in range(150)]
    texts = [" ".join(rng.choices(words, weights, k=rng.randint(1, 15))) for _ in range(220)]
    texts += ["w0 w1"] * 9 + ["w0"] * 4 + ["w1 w0 w0"] * 3 + ["", None, "only here"] + texts[:20]
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return tfidf.build_index(docs, "doc_id", "text")


@pytest.mark.parametrize("limit", [1, 4])
def test_neighbours_equal_comparing_every_pair(index, limit):
    assert rows(neighbours.similar_all(index, limit).found) == sorted(every_pair(index, limit))


def test_padded_and_asked(spark, index):
    assert rows(neighbours.similar_all(index, 12, padded=True).found) == sorted(every_pair(index, 12, padded=True))
    asked = spark.createDataFrame([(3,), (50,), (50,), (99_999,)], "doc_id bigint")
    want = [row for row in every_pair(index, 3) if row[0] in (3, 50)]
    assert rows(neighbours.similar_all(index, 3, asked).found) == sorted(want)
    assert rows(neighbours.similar_all(index, 3, asked.limit(0)).found) == []
    one = retrieve.similar(index, 3, 3).select("query_id", "doc_id", "score", "rank")
    assert rows(one) == sorted(row for row in want if row[0] == 3)
    with pytest.raises(ValueError):
        neighbours.similar_all(index, 0)


def test_seeds_and_hot_keys_change_nothing(index, monkeypatch):
    want = sorted(every_pair(index, 4))
    monkeypatch.setattr(neighbours, "SEED_DOCS", 1)
    monkeypatch.setattr(neighbours, "SEED_TERMS", 1)
    monkeypatch.setattr(neighbours, "SHARE", 1.0)
    monkeypatch.setattr(neighbours, "MIN_HOT_ROWS", 10)
    monkeypatch.setattr(skew.lookup_join, "__defaults__", ("inner", 10, None))
    assert rows(neighbours.similar_all(index, 4).found) == want


def test_a_term_of_all_documents_makes_no_pairs(spark):
    """1,200 documents share one word; each has six near relations by other words, and thousands are equal."""
    n = 1200
    group = (F.col("id") / 6).cast("bigint")
    text = F.concat(F.lit("common "), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.concat(F.lit("g"), group, F.lit("x"), k)), " "), F.lit(" own"), F.col("id"))
    docs = spark.range(n).select(F.col("id").alias("doc_id"), text.alias("text"))
    copies = spark.range(3000).select((F.col("id") + 10_000).alias("doc_id"), F.lit("common copy of a text").alias("text"))
    index = tfidf.build_index(docs.unionByName(copies), "doc_id", "text", ONE_WORD)
    result = neighbours.similar_all(index, 5)
    found = result.found.where(F.col("query_id") < n)
    assert found.count() == 5 * n and found.where((F.col("query_id") / 6).cast("bigint") != (F.col("doc_id") / 6).cast("bigint")).isEmpty()
    copied = result.found.where(F.col("query_id") >= n).groupBy("query_id").agg(F.max("doc_id").alias("last"), F.min("score").alias("score"), F.count("rank").alias("n"))
    assert copied.where((F.col("n") == 5) & (F.col("last") <= 10_005) & (F.col("score") > 1 - 1e-9)).count() == 3000
    pairs = {row.step: row.n for row in result.pairs.collect()}
    assert pairs["sharing a term"] > (n + 3000) ** 2 and pairs["met"] < 100 * n and pairs["compared"] <= 6 * n, pairs
