"""Whole jobs: pages to catalog and indexes, and results that do not depend on partitioning."""

from pyspark.sql import functions as F

from quern.operators import phrases, retrieve
from quern.plans import build
from quern.plans.checks import pages as page_checks
from quern.plans.checks import normal, search


def test_pages_to_catalog(spark, sf_dir):
    pages = page_checks.built(spark, sf_dir)
    n_recipes = pages.where(F.col("form").isin(0, 1, 5)).count()
    corpus = build.build_corpus(pages, "http://x/{id}")
    counts = corpus.counts.first()
    assert counts.total_records == n_recipes
    assert corpus.clean.count() + corpus.quarantine.count() == n_recipes
    # Every look-up reads what was written, and only the files that can hold its id.
    assert corpus.catalog.inputFiles() and "Exchange" not in corpus.catalog._jdf.queryExecution().executedPlan().toString()
    ranges = corpus.catalog.groupBy(F.input_file_name().alias("f")).agg(F.min("id").alias("lo"), F.max("id").alias("hi")).orderBy("lo").collect()
    assert all(a.hi < b.lo for a, b in zip(ranges, ranges[1:]))
    rows = corpus.catalog.where(F.size("categories") > 0).collect()
    assert rows and all(r.categories == ["Main"] for r in rows)
    one = rows[0]
    assert one.cook_time_minutes == one.id and one.servings == one.id
    assert [(i.name, i.amount) for i in one.ingredients] == [("water", f"{one.id} cup"), ("salt & pepper", "")]
    assert [s.step for s in one.instructions] == [1, 2]

    index = build.text_index(corpus.clean, normal.lexicon(spark, sf_dir))
    found = retrieve.search(index, "boil serve", limit=3).collect()
    assert found and all(r.score > 0 for r in found)
    stemmed = build.search_index(corpus.catalog)
    assert not retrieve.search(stemmed, "waters", limit=3).isEmpty()
    suggestions = build.suggestion_index(corpus.catalog)
    assert [r.text for r in phrases.suggest(suggestions, "salt p").collect()] == ["salt pepper"]


def test_scores_do_not_depend_on_partitioning(spark, sf_dir):
    def ranked(partitions):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(partitions)
        index = search.tfidf.build_index(docs, "doc_id", "text")
        rows = retrieve.search(index, search.QUERY, 10).orderBy("rank").collect()
        return [(r.doc_id, round(r.score, 9)) for r in rows]

    try:
        assert ranked(3) == ranked(8)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
