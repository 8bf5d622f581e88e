"""An index grown in steps equals one build, and leaves what was written alone."""

import os
import random

import pytest
from pyspark.sql import functions as F

from quern.operators import neighbours, retrieve, segments, tfidf


def texts(n, seed=3):
    rng = random.Random(seed)
    return [(at, " ".join(rng.choices([f"w{k}" for k in range(50)], k=rng.randint(0, 12)))) for at in range(n)] + [(n, None), (n + 1, "")]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def state(folder):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, files in os.walk(folder) for f in files}


def tables(index):
    """All rows of an index; weights to nine digits."""
    return [
        sorted((r.doc_id, r.term, r.tf, round(r.weight, 9)) for r in index.postings.collect()),
        sorted((r.term, r.df, r.total_tf, round(r.idf, 9)) for r in index.terms.collect()),
        sorted((r.doc_id, r.n_terms, round(r.norm, 9)) for r in index.docs.collect()),
    ]


def found(rows):
    return sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 9)) for r in rows.collect())


def test_a_build_and_two_additions_equal_one_build(spark, tmp_path):
    rows, folder = texts(120), str(tmp_path / "index")
    index = segments.add(segments.create(spark, folder), frame(spark, rows[:100]), "doc_id", "text")
    [first] = index.segments
    before = state(f"{folder}/{first.name}")
    for part in (rows[100:108], rows[108:]):
        index = segments.add(index, frame(spark, part), "doc_id", "text")
    assert len(index.segments) == 3 and index.generation == 3 and state(f"{folder}/{first.name}") == before
    whole = tfidf.build_index(frame(spark, rows), "doc_id", "text")
    assert tables(segments.as_text_index(index)) == tables(whole)
    asked = spark.createDataFrame([(1, "w1 w2 w3"), (2, "w4"), (3, ""), (4, "zzz"), (5, "w1 w1 w7 w8")], "query_id bigint, query string")
    assert found(segments.search(index, asked, 7)) == found(retrieve.search(whole, asked, 7))
    assert found(segments.search(index, "w9 w10", 3)) == found(retrieve.search(whole, "w9 w10", 3))
    again = segments.open_index(spark, folder)
    assert again.generation == 3 and found(segments.search(again, asked, 7)) == found(retrieve.search(whole, asked, 7))
    view = segments.as_text_index(again)
    assert found(retrieve.similar(view, 5, 4)) == found(retrieve.similar(whole, 5, 4))
    assert found(neighbours.similar_all(view, 2).found) == found(neighbours.similar_all(whole, 2).found)


def test_equal_segments_are_merged(spark, tmp_path):
    rows, folder = texts(60), str(tmp_path / "index")
    index = segments.create(spark, folder)
    sizes = []
    for at in range(0, 60, 6):
        index = segments.add(index, frame(spark, rows[at:at + 6]), "doc_id", "text", fanout=3, norms=False)
        sizes.append(sorted(segment.n_docs for segment in index.segments))
    assert sizes[:4] == [[6], [6, 6], [18], [6, 18]] and sizes[8] == [54] and sizes[9] == [6, 54]
    with pytest.raises(ValueError):
        segments.search(index, "w1")
    whole = tfidf.build_index(frame(spark, rows[:60]), "doc_id", "text")
    assert tables(segments.as_text_index(segments.refresh(index))) == tables(whole)


def test_refused_documents_change_nothing(spark, tmp_path):
    folder = str(tmp_path / "index")
    empty = segments.create(spark, folder)
    assert segments.search(empty, "w1").isEmpty() and segments.open_index(spark, folder).segments == ()
    index = segments.add(empty, frame(spark, [(1, "aa bb"), (2, "bb")]), "doc_id", "text")
    for bad in ([(2, "cc")], [(7, "cc"), (7, "dd")]):
        with pytest.raises(ValueError):
            segments.add(index, frame(spark, bad), "doc_id", "text")
    assert segments.open_index(spark, folder).generation == 1
    same = segments.add(index, frame(spark, []), "doc_id", "text")
    assert same.n_docs == 2 and found(segments.search(same, "bb")) == found(segments.search(index, "bb"))


def test_a_query_reads_its_terms_only(spark, tmp_path):
    index = segments.add(segments.create(spark, str(tmp_path / "index")), frame(spark, texts(30)), "doc_id", "text")
    plan = segments.search(index, "w1 w2")._jdf.queryExecution().executedPlan().toString()
    assert "In(term" in plan
    assert index.norms.where(F.col("norm") <= 0).isEmpty()
