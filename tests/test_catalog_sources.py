import os
import tempfile

import pytest
from pyspark.sql import functions as F

from quern.functions import cells
from quern.operators import catalog
from quern.operators import skew
from quern.operators.skew import lookup_join
from quern.sources import csv_tables, incremental, json_docs, profile
from quern.streaming.ingest import process_new_files


@pytest.fixture()
def folder():
    return tempfile.mkdtemp(prefix="quern-test-")


RECORDS = "recipe_id bigint, ord int, title string, ingredients string, instructions string, category string, cook_time string, prep_time string, total_time string, servings string"


def records(spark):
    return spark.createDataFrame([
        (1, 0, "Old", "[]", "[]", "Main", None, None, None, None),
        (1, 1, "New", '[{"name":"salt","quantity":2.0,"unit":"cup","preparation":""},3,{"name":"","quantity":"1/2"}]',
         '["Mix",{"step":7,"description":"Bake"},{"description":"Eat"}]', " main DISH, ,soup", "PT0M", "PT1H5M", "PT9H", "4.7"),
        (2, 2, None, "{bad", None, "soup", None, None, None, "x"),
    ], RECORDS)


def test_catalog(spark):
    built = catalog.build_catalog(records(spark), "http://x/{id}.png")
    rows = {r.id: r for r in built.collect()}
    one = rows[1]
    assert one.title == "New" and one.categories == ["Main dish", "Soup"]
    assert (one.cook_time_minutes, one.servings, one.ingredients_text) == (65, 4, "salt")
    assert [(i.name, i.amount) for i in one.ingredients] == [("salt", "2 cup"), ("", "1/2")]
    assert [(s.step, s.description) for s in one.instructions] == [(1, "Mix"), (7, "Bake"), (3, "Eat")]
    assert one.image == "http://x/1.png"
    assert rows[2].title == "nan" and rows[2].ingredients == [] and rows[2].servings == 0
    assert [(r.category, r.n) for r in catalog.facets(built).collect()] == [("Soup", 2), ("Main dish", 1)]
    assert catalog.lookup(built, 2).count() == 1 and catalog.lookup(built, 9).isEmpty()
    assert {r.id for r in catalog.browse(built, ["Soup"]).collect()} == {1, 2}
    assert catalog.browse(built, ["soup"]).isEmpty()
    assert catalog.browse(built, seed=1).collect() == catalog.browse(built.repartition(3), seed=1).collect()
    assert catalog.responses(built).columns[5] == "cookTimeMinutes"


def test_csv_round_trip(spark, folder):
    path = os.path.join(folder, "t")
    df = spark.createDataFrame([(1, 'a "b",\nc '), (2, "NA"), (3, None), (4, "null")], "recipe_id bigint, tfidf_text string")
    csv_tables.write_csv(df, path)
    back = csv_tables.read_csv(spark, path, "recipe_id bigint, tfidf_text string")
    assert {r.recipe_id: r.tfidf_text for r in back.collect()} == {1: 'a "b",\nc ', 2: None, 3: None, 4: None}
    assert [(r.doc_id, r.text) for r in csv_tables.text_documents(back).collect()] == [(1, 'a "b",\nc')]


def test_a_large_file_is_split_where_lines_are_records(spark, folder):
    path = os.path.join(folder, "big")
    csv_tables.write_csv(spark.range(200_000).selectExpr("id", "repeat('x', 20) AS s").coalesce(1), path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512k")
    try:
        whole, split = (csv_tables.read_csv(spark, path, "id bigint, s string", multi_line=flag) for flag in (True, False))
        assert whole.rdd.getNumPartitions() == 1 < 4 < split.rdd.getNumPartitions()
        assert split.count() == whole.count() == 200_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_json_as_common_readers_take_it(spark):
    cells_ = ['{"a":1,"a":2}', '[NaN,-Infinity,"NaN"]', '{"k":"x, NaN, \\" -Infinity"}', '{"a":"b\nc"}', "{a}", "nan", None]
    df = spark.createDataFrame([(at, cell) for at, cell in enumerate(cells_)], "i int, c string")
    got = {r.i: r.j for r in df.select("i", F.to_json(cells.parse_json(F.col("c"))).alias("j")).collect()}
    assert got == {0: '{"a":2}', 1: '[null,null,"NaN"]', 2: '{"k":"x, NaN, \\" -Infinity"}', 3: None, 4: None, 5: None, 6: None}


def test_missing_columns(spark):
    with pytest.raises(ValueError, match="Missing required columns: recipe_id, tfidf_text"):
        csv_tables.text_documents(spark.range(1))


def test_json_documents(spark, folder):
    for name, raw in (("5.json", '{"a": 1}'), ("bad.json", "{"), ("x y.json", "[]")):
        with open(os.path.join(folder, name), "w") as out:
            out.write(raw)
    docs = json_docs.read_documents(spark, folder)
    assert tuple(json_docs.load_summary(docs).first()) == (3, 2, 1)
    assert [r.file_name for r in json_docs.failed_files(docs).collect()] == ["bad.json"]
    keyed = json_docs.with_key(docs.select("file_name", F.lit(None).cast("string").alias("recipe_id")))
    assert {r.recipe_id for r in keyed.collect()} == {"5", "bad", "x y"}


def test_keyed_lists(spark):
    df = spark.createDataFrame([(1, 0, '["a"]'), (1, 1, '["b","c"]'), (2, 2, "{")], "k int, ord int, v string")
    assert {r.k: r.items for r in json_docs.keyed_lists(df, "k", "v", "ord").collect()} == {1: ["b", "c"], 2: []}


def test_incremental(spark):
    incoming = spark.createDataFrame([(1, "a", "i", ""), (2, "b", "i", "http://x"), (2, "b", "i", None), (3, "c", "i", "u")],
                                     "id bigint, title string, image string, sourceUrl string")
    stored = spark.createDataFrame([(1,), (1,)], "recipe_id bigint")
    listing = incremental.listing_rows(incoming)
    fresh = incremental.new_rows(listing, stored, "recipe_id")
    assert sorted((r.recipe_id, r.instructions) for r in fresh.collect()) == [(2, "No instructions provided"), (2, "http://x"), (3, "u")]
    assert incremental.new_rows(listing, stored, "recipe_id", dedupe_batch=True).count() == 2
    assert tuple(incremental.plan_counts(listing, stored, "recipe_id").first()) == (4, 1, 3)
    log = spark.createDataFrame([(200,), (299,), (404,), (None,), (301,)], "status int")
    assert {r.outcome: r.n for r in incremental.outcome_counts(log).collect()} == {"saved": 2, "not_found": 2, "failed": 1}


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_lookup_join_with_a_hot_key(spark, how):
    facts = spark.range(3001).selectExpr("CASE WHEN id % 3 = 0 THEN -1 WHEN id = 3000 THEN NULL ELSE id END AS k", "id AS v")
    facts = facts.selectExpr("CASE WHEN v = 1 THEN NULL ELSE k END AS k", "v")
    lookup = spark.range(4000).selectExpr("id AS k", "id * 2 AS w").where("k <> -1")
    plain = facts.join(lookup, "k", how)
    for bar in (100, 1_000_000):
        split = lookup_join(facts, lookup, ["k"], how, min_hot_rows=bar)
        assert sorted(map(str, split.collect())) == sorted(map(str, plain.collect()))
    given = spark.createDataFrame([(-1,), (7,)], "k long")
    split = lookup_join(facts, lookup, ["k"], how, hot=given)
    assert sorted(map(str, split.collect())) == sorted(map(str, plain.collect()))


def test_number_of_hot_keys_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_KEYS", 2)
    facts = spark.range(1000).selectExpr("id % 10 AS k").unionByName(spark.range(50).selectExpr("3L AS k"))
    assert sorted(r.k for r in skew.hot_keys(facts, ["k"], 10).collect()) == [0, 3]


def test_broadcasts_are_bounded_in_rows_and_bytes(spark):
    df = spark.range(100).selectExpr("id", "repeat('x', 100) AS s")
    hinted = lambda *bounds: "broadcast" in skew.broadcast_if_small(df, *bounds)._jdf.queryExecution().logical().toString().lower()
    assert hinted() and not hinted(99) and not hinted(100, 5000)


def test_settled_batches_are_the_same_either_way(spark, monkeypatch):
    df = spark.range(100).selectExpr("id", "id % 7 AS k")
    for rows in (1000, 10):
        monkeypatch.setattr(skew, "LOCAL_ROWS", rows)
        for few in (True, False):
            kept, local = skew.settle(df, "batch", few)
            assert (local is None) == (rows == 10) and kept.exceptAll(df).isEmpty() and kept.count() == 100


def test_profile(spark):
    df = spark.createDataFrame([(1, None), (1, "x")], "id int, s string")
    rows = {r.column_name: (r.dtype, r.n_nulls, r.n_rows, r.n_keys) for r in profile.profile(df, "id").collect()}
    assert rows == {"id": ("int", 0, 2, 1), "s": ("string", 1, 2, 1)}
    assert tuple(profile.table_counts(df, "id").first()) == (2, 1)
    assert tuple(profile.table_counts(df, "zz").first()) == (2, 0)
    assert profile.table_counts(profile.read_if_present(spark, "/tmp/quern-absent"), "id") == (0, 0)


def test_new_files_are_handled_once(spark, folder):
    source, target, marks = (os.path.join(folder, part) for part in ("in", "out", "marks"))
    work = lambda df: df.withColumn("twice", F.col("id") * 2)
    for expected in (3, 3, 6):
        if expected == 6 or not os.path.exists(source):
            spark.range(3).coalesce(1).write.mode("append").parquet(source)
        process_new_files(spark, source, spark.range(1).schema, work, target, marks)
        assert spark.read.parquet(target).count() == expected
