import json

import pytest
from pyspark.sql import functions as F

from quern.operators import audit, records, skew


def docs(spark, values):
    rows = [(name, json.dumps(value) if not isinstance(value, str) else value) for name, value in values]
    return spark.createDataFrame(rows, "file_name string, raw string").select("file_name", F.try_parse_json("raw").alias("doc"))


GOOD = {
    "recipe_id": "7", "title": "Soup", "servings": 4, "category": "Main",
    "parsed_ingredients": [{"original": "x", "name": "salt", "quantity": None, "unit": "", "preparation": "", "is_valid": True},
                           {"name": "é", "quantity": 1.5, "unit": "cup", "preparation": "hot"}, "junk"],
    "processed_instructions": {"steps": [{"text": "Mix"}, {"text": ""}], "step_count": 2,
                               "metadata": {"temperatures": [], "times": ["5 min"], "equipment": []}},
}


def test_structure(spark):
    out = records.structure_records(docs(spark, [
        ("a.json", GOOD),
        ("8.json", {"title": "", "parsed_ingredients": "x", "processed_instructions": []}),
        ("dir/9.json", {"title": 5, "processed_instructions": {"steps": "no", "step_count": 1}}),
        ("bad.json", {"title": "T"}),
        ("b.json", {"recipe_id": 7, "title": "Later"}),
    ]))
    rows = {r.file_name: r for r in out.collect()}
    good = rows["a.json"]
    assert good.recipe_id == 7 and good.extraction_status == "success" and not good.has_validation_errors
    assert good.ingredients == (
        '[{"name":"salt","quantity":null,"unit":"","preparation":""},'
        '{"name":"é","quantity":1.5,"unit":"cup","preparation":"hot"}]'
    )
    assert good.instructions == '["Mix"]' and good.instruction_times == '["5 min"]' and good.servings == "4"
    assert good.ingredient_count == 2 and good.step_count == 2
    assert rows["8.json"].recipe_id == 8 and rows["8.json"].extraction_status == "partial"
    assert rows["dir/9.json"].recipe_id == 9 and rows["dir/9.json"].has_empty_title
    assert rows["bad.json"].recipe_id is None and rows["bad.json"].extraction_status == "failed"
    assert [r.file_name for r in records.rejected_records(out).collect()] == ["bad.json"]
    kept = records.keep_first(out)
    assert {r.file_name for r in kept.collect()} == {"a.json", "8.json", "dir/9.json"}
    row = records.record_metrics(out, kept).first()
    assert (row.total_files, row.failed, row.processed, row.duplicate_ids) == (5, 1, 3, 1)
    assert {r.file_name for r in records.status_samples(kept).collect()} == {"a.json", "8.json", "dir/9.json"}


def test_structure_messages(spark):
    out = docs(spark, [("1", {"title": None, "parsed_ingredients": "x", "processed_instructions": 3}),
                       ("2", {"title": "", "processed_instructions": {"steps": {}}}),
                       ("3", {"title": "ok", "processed_instructions": [], "parsed_ingredients": None})])
    errors = {r.file_name: r.e for r in out.select("file_name", records.structure_errors(F.col("doc")).alias("e")).collect()}
    assert errors["1"] == ["parsed_ingredients is not a list: <class 'str'>",
                           "processed_instructions is not a dict: <class 'int'>", "title is empty or invalid: None"]
    assert errors["2"] == ["processed_instructions['steps'] is not a list: <class 'dict'>", "title is empty or invalid: ''"]
    assert errors["3"] == []


@pytest.mark.parametrize("flags, status", [
    ((False, False, False), "success"), ((False, False, True), "partial"),
    ((False, True, True), "failed"), ((True, False, False), "partial"),
])
def test_status(spark, flags, status):
    df = spark.range(1).select(records.extraction_status(*[F.lit(f) for f in flags]).alias("s"))
    assert df.first().s == status


@pytest.mark.parametrize("cell, messages", [
    ("{bad", ["Invalid JSON in 'ingredients' column"]),
    ('{"a":1}', ["'ingredients' JSON is not an array: dict"]),
    ("null", ["'ingredients' JSON is not an array: NoneType"]),
    ("[1]", ["Ingredient [0] is not a dict: int"]),
    ('[{"name":"x","quantity":"2"}]', ["Ingredient [0] 'x' has non-numeric quantity: '2'"]),
    ('[{"name":"x","quantity":2.5},{"name":" "}]', ["Ingredient [1] has empty name"]),
    ('[{"quantity":[]}]', ["Ingredient [0] '?' has non-numeric quantity: []", "Ingredient [0] has empty name"]),
    ('[{"name":"x","quantity":null},{"name":"y","quantity":true}]', []),
    ("", []), (None, []),
])
def test_ingredient_messages(spark, cell, messages):
    df = spark.createDataFrame([(cell,)], "c string").select(audit.ingredient_errors(F.col("c")).alias("e"))
    assert df.first().e == messages


@pytest.mark.parametrize("cell, messages", [
    ("[", ["Invalid JSON in 'instructions' column"]), ("3", ["'instructions' JSON is not an array: int"]),
    ('["a", 1, " "]', ["Instruction step [1] is not a string: int", "Instruction step [2] is empty or whitespace only"]),
])
def test_instruction_messages(spark, cell, messages):
    df = spark.createDataFrame([(cell,)], "c string").select(audit.instruction_errors(F.col("c")).alias("e"))
    assert df.first().e == messages


def test_audit_split(spark):
    good = '[{"name":"x","quantity":1}]'
    rows = [
        (1, 0, "a", "[1]", "[]", 1, 0), (1, 1, "b", good, '["s"]', 1, 1), (2, 2, " ", good, "[]", 1, 0),
        (3, 3, "c" * 50, good, "[", 0, 0), (4, 4, "d", good, '["s"]', 0, 2),
    ]
    schema = "recipe_id bigint, ord int, title string, ingredients string, instructions string, ingredient_count int, step_count int"
    checked = audit.with_errors(spark.createDataFrame(rows, schema))
    assert {r.ord for r in checked.where("is_duplicate").collect()} == {1}
    clean, found = audit.clean_rows(checked), audit.anomalies(checked)
    assert [r.recipe_id for r in clean.collect()] == [4]
    assert clean.count() + found.count() == len(rows)
    counts = audit.anomaly_counts(checked).first()
    assert (counts.duplicate_ids, counts.empty_titles, counts.invalid_instructions_json, counts.zero_ingredients) == (1, 1, 1, 1)
    detail = {r.ord: r for r in audit.anomaly_detail(found).collect()}
    assert detail[3].title == "c" * 40 + "..." and detail[1].errors == "Duplicate recipe_id: 1"
    assert audit.clean_totals(clean).first().total_steps == 2


def test_one_hot_key_keeps_every_later_row(spark):
    df = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN -1 ELSE id END AS recipe_id", "id AS ord")
    assert audit.later_occurrences(df, "recipe_id", "ord").count() == 999


def test_many_later_rows_are_found_in_place(spark, monkeypatch, tmp_path):
    """Past the broadcast bound only rows that a filter lets through are shuffled; the marks are the same."""
    rows = spark.range(4000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN -1 WHEN id % 50 = 1 THEN NULL ELSE id % 2500 END AS recipe_id", "id AS ord", "concat('t', id) AS title",
        "'[]' AS ingredients", "'[\"s\"]' AS instructions", "0 AS ingredient_count", "1 AS step_count",
    )
    rows.write.parquet(str(tmp_path / "rows"))
    stored = spark.read.parquet(str(tmp_path / "rows"))
    few = audit.with_errors(stored)
    want = sorted((r.ord, r.is_duplicate, tuple(r.errors)) for r in few.collect())
    monkeypatch.setattr(audit, "BROADCAST_ROWS", 10)
    many = audit.with_errors(stored)
    assert many.columns == few.columns or set(many.columns) == set(few.columns)
    assert sorted((r.ord, r.is_duplicate, tuple(r.errors)) for r in many.collect()) == want
    assert sum(flag for _, flag, _ in want) > 1300
    # With one bit for all keys everything passes the filter, and the result stays the same.
    monkeypatch.setattr(skew, "BITS_FOR_EACH", 0)
    assert sorted((r.ord, r.is_duplicate, tuple(r.errors)) for r in audit.with_errors(stored).collect()) == want


def test_a_key_filter_lets_all_keys_through(spark):
    rows, keys = spark.range(50_000), spark.range(0, 50_000, 100)
    passed = rows.where(skew.may_hold(rows, keys, ["id"]))
    assert passed.join(keys, "id").count() == 500 and passed.count() < 6_000
    assert rows.where(skew.may_hold(rows, keys.limit(0), ["id"])).isEmpty()
