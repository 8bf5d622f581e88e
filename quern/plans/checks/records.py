"""Record structuring and validation over ``events``: documents and cells are spoiled by rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import audit, records
from quern.plans.checks.registry import Check
from quern.plans.tables import derive, plain, shared
from quern.sources.tables import store

# --- Documents: one JSON text per event, some parts with the wrong shape ------------------------------------
DOCUMENTS = """
SELECT event_id, event_id % 11 AS form, event_id % 4 AS n_items, event_id % 3 AS n_steps, version,
  concat(lpad(CAST(event_id AS STRING), 9, '0'), '-', CAST(version AS STRING), '.json') AS file_name,
  event_type, k,
  concat('{{"recipe_id":',
    CASE WHEN event_id % 13 = 0 THEN '"no number"' WHEN event_id % 2 = 0 THEN concat('"', CAST(event_id AS STRING), '"') ELSE CAST(event_id AS STRING) END,
    ',"title":', CASE event_id % 11 WHEN 0 THEN '""' WHEN 1 THEN '5' WHEN 2 THEN 'null' ELSE concat('"', event_type, ' ', CAST(version AS STRING), '"') END,
    ',"parsed_ingredients":',
      CASE WHEN event_id % 11 = 3 THEN '"none"'
           ELSE concat('["junk"', repeat(concat(',{{"name":"', event_type, '","quantity":', k, ',"unit":"cup","is_valid":true}}'), CAST(event_id % 4 AS INT)), ']') END,
    ',"processed_instructions":',
      CASE WHEN event_id % 11 = 4 THEN '["x"]' WHEN event_id % 11 = 5 THEN '{{"steps":7,"step_count":2}}'
           ELSE concat('{{"steps":[{{"text":""}}', repeat(concat(',{{"text":"', event_type, ' on"}}'), CAST(event_id % 3 AS INT)),
                       '],"step_count":', CAST(event_id % 3 AS STRING), ',"metadata":{{"times":["', k, ' min"]}}}}') END,
    ',"servings":', k, ',"category":"', event_type, '"}}') AS raw
FROM (
  SELECT event_id, event_type, replace(replace(props, '{{"k": ', ''), '}}', '') AS k, 0 AS version FROM {events}
  UNION ALL
  SELECT event_id, event_type, replace(replace(props, '{{"k": ', ''), '}}', '') AS k, 1 AS version FROM {events} WHERE value > 50
)
"""

STRUCTURED = f"""
WITH docs AS ({plain(DOCUMENTS).replace('AS STRING', 'AS VARCHAR')}), parts AS (
  SELECT *, CASE WHEN event_id % 13 <> 0 THEN event_id END AS recipe_id,
    CASE WHEN form IN (0, 1, 2) THEN '' ELSE concat(event_type, ' ', version) END AS title,
    CASE WHEN form = 3 THEN 0 ELSE n_items END AS ingredient_count,
    CASE WHEN form = 4 THEN 0 WHEN form = 5 THEN 2 ELSE n_steps END AS step_count,
    CASE WHEN form IN (4, 5) THEN 0 ELSE n_steps END AS n_texts,
    concat_ws('; ', CASE form WHEN 3 THEN 'parsed_ingredients is not a list: <class ''str''>' END,
      CASE form WHEN 4 THEN 'processed_instructions is not a dict: <class ''list''>'
                WHEN 5 THEN 'processed_instructions[''steps''] is not a list: <class ''int''>' END,
      CASE form WHEN 0 THEN 'title is empty or invalid: ''''' WHEN 1 THEN 'title is empty or invalid: 5'
                WHEN 2 THEN 'title is empty or invalid: None' END) AS errors
  FROM docs
), records AS (
  SELECT *, CASE WHEN title = '' THEN 'partial' WHEN ingredient_count > 0 AND step_count > 0 THEN 'success'
                 WHEN ingredient_count > 0 OR step_count > 0 THEN 'partial' ELSE 'failed' END AS status
  FROM parts
), kept AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY recipe_id ORDER BY file_name) AS nth FROM records
                 WHERE recipe_id IS NOT NULL) WHERE nth = 1
)
"""


# Structuring a document takes about a tenth of a millisecond, so a task has a few seconds.
EVENTS_PER_TASK = 20_000


def documents(spark, sf_dir):
    return derive(spark, sf_dir, DOCUMENTS, EVENTS_PER_TASK).select("file_name", F.try_parse_json("raw").alias("doc"))


def structured(spark, sf_dir):
    def build():
        return store(records.structure_records(documents(spark, sf_dir)), "structured")

    return shared(spark, sf_dir, "structured", build)


def kept(spark, sf_dir):
    return records.keep_first(structured(spark, sf_dir))


def long(name):
    return F.col(name).cast("bigint").alias(name)


def q01_structure_errors(spark, sf_dir):
    return documents(spark, sf_dir).select(
        "file_name", F.array_join(records.structure_errors(F.col("doc")), "; ").alias("errors")
    )


def q02_sanitize(spark, sf_dir):
    safe = records.sanitize(documents(spark, sf_dir))
    return safe.select(
        "file_name", "title", F.size("ingredient_items").cast("bigint").alias("n_ingredients"),
        F.size("step_items").cast("bigint").alias("n_steps"), long("step_count"), F.to_json("times").alias("times"),
    )


def q03_record_ids(spark, sf_dir):
    return structured(spark, sf_dir).select("file_name", "recipe_id")


def q04_flags(spark, sf_dir):
    return structured(spark, sf_dir).select(
        "file_name", "has_empty_title", "has_zero_ingredients", "has_zero_steps", "has_validation_errors"
    )


def q05_status(spark, sf_dir):
    return structured(spark, sf_dir).select("file_name", F.col("extraction_status").alias("status"))


def q06_json_cells(spark, sf_dir):
    return structured(spark, sf_dir).select(
        "file_name", "ingredients", "instructions", "instruction_temperatures", "instruction_times", "instruction_equipment"
    )


def q07_first_wins(spark, sf_dir):
    return kept(spark, sf_dir).select("recipe_id", "file_name", "title")


def q08_metrics(spark, sf_dir):
    found = records.record_metrics(structured(spark, sf_dir), kept(spark, sf_dir))
    decimals = [name for name, dtype in found.dtypes if dtype == "double"]
    return found.withColumns({name: F.round(name, 6) for name in decimals})


def q09_samples(spark, sf_dir):
    shown = records.status_samples(kept(spark, sf_dir))
    return shown.select(F.col("extraction_status").alias("status"), long("nth"), "file_name")


# --- Flat rows: one per event, cells spoiled by rule, and a second copy of some ----------------------------------
ROWS = """
SELECT event_id AS recipe_id, version * 1000000000 + event_id AS ord, event_id % 29 AS title_form,
  event_id % 17 AS form, event_id % 23 AS step_form, version, k, event_type,
  CASE event_id % 29 WHEN 0 THEN NULL WHEN 1 THEN '  ' WHEN 2 THEN repeat(concat(event_type, ' '), 12) ELSE event_type END AS title,
  CASE event_id % 17
    WHEN 0 THEN concat('[{{"name":"', event_type)
    WHEN 1 THEN props
    WHEN 2 THEN concat('[', k, ',{{"name":"a","quantity":1}}]')
    WHEN 3 THEN concat('[{{"name":"', event_type, '","quantity":"', k, '"}},{{"name":" ","quantity":2.5}}]')
    WHEN 4 THEN NULL
    WHEN 5 THEN ''
    WHEN 6 THEN concat('[{{"name":" ","name":"', event_type, '","quantity":NaN}},{{"name":"NaN, -Infinity","quantity":-Infinity}}]')
    ELSE concat('[{{"name":"', event_type, '","quantity":', k, '}},{{"name":"b","quantity":null}}]') END AS ingredients,
  CASE event_id % 23
    WHEN 0 THEN '["a",'
    WHEN 1 THEN k
    WHEN 2 THEN concat('["ok",', k, ',""]')
    WHEN 3 THEN NULL
    ELSE concat('["', event_type, '"]') END AS instructions,
  CAST(CASE WHEN event_id % 17 IN (4, 5) THEN 0 ELSE 2 END AS INT) AS ingredient_count,
  CAST(CASE WHEN event_id % 23 = 3 THEN 0 ELSE 1 END AS INT) AS step_count,
  CASE WHEN event_id % 2 = 0 THEN '["350°F"]' ELSE '[]' END AS instruction_temperatures,
  CASE WHEN event_id % 3 = 0 THEN concat('["', k, ' min"]') WHEN event_id % 3 = 1 THEN '{{bad' END AS instruction_times,
  '["oven","pan"]' AS instruction_equipment,
  CASE WHEN event_id % 5 = 0 THEN ' ' WHEN event_id % 5 < 3 THEN event_type END AS cuisine,
  event_type AS category, CASE WHEN event_id % 7 = 0 THEN 'PT5M' END AS prep_time,
  CASE WHEN event_id % 7 = 1 THEN '' ELSE 'PT5M' END AS cook_time, k AS servings
FROM (
  SELECT event_id, event_type, props, replace(replace(props, '{{"k": ', ''), '}}', '') AS k, 0 AS version FROM {events}
  UNION ALL
  SELECT event_id, event_type, props, replace(replace(props, '{{"k": ', ''), '}}', '') AS k, 1 AS version FROM {events} WHERE value > 50
)
"""

CHECKED = f"""
WITH rows AS ({plain(ROWS).replace('AS STRING', 'AS VARCHAR')}), messages AS (
  SELECT *,
    CASE WHEN title_form IN (0, 1) THEN 'Empty or missing title' END AS title_error,
    CASE form WHEN 0 THEN 'Invalid JSON in ''ingredients'' column'
              WHEN 1 THEN '''ingredients'' JSON is not an array: dict'
              WHEN 2 THEN 'Ingredient [0] is not a dict: int'
              WHEN 3 THEN concat('Ingredient [0] ''', event_type, ''' has non-numeric quantity: ''', k, '''; Ingredient [1] has empty name')
    END AS ingredient_error,
    CASE step_form WHEN 0 THEN 'Invalid JSON in ''instructions'' column'
                   WHEN 1 THEN '''instructions'' JSON is not an array: int'
                   WHEN 2 THEN 'Instruction step [1] is not a string: int; Instruction step [2] is empty or whitespace only'
    END AS step_error,
    CASE WHEN version = 1 THEN concat('Duplicate recipe_id: ', recipe_id) END AS duplicate_error
  FROM rows
), checked AS (
  SELECT *, concat_ws('; ', title_error, ingredient_error, step_error, duplicate_error) AS errors FROM messages
), clean AS (SELECT * FROM checked WHERE errors = '')
"""


def rows(spark, sf_dir):
    return derive(spark, sf_dir, ROWS)


def checked(spark, sf_dir):
    return shared(spark, sf_dir, "checked", lambda: store(audit.with_errors(rows(spark, sf_dir)), "checked"))


def clean(spark, sf_dir):
    return audit.clean_rows(checked(spark, sf_dir))


def found(spark, sf_dir):
    return audit.anomalies(checked(spark, sf_dir))


def q10_ingredient_errors(spark, sf_dir):
    errors = audit.ingredient_errors(F.col("ingredients"))
    return rows(spark, sf_dir).select("ord", F.array_join(errors, "; ").alias("errors"))


def q11_instruction_errors(spark, sf_dir):
    errors = audit.instruction_errors(F.col("instructions"))
    return rows(spark, sf_dir).select("ord", F.array_join(errors, "; ").alias("errors"))


def q12_row_errors(spark, sf_dir):
    errors = audit.row_errors(F.col("title"), F.col("ingredients"), F.col("instructions"))
    return rows(spark, sf_dir).select("ord", F.array_join(errors, "; ").alias("errors"))


def q13_duplicate_flag(spark, sf_dir):
    return checked(spark, sf_dir).select("recipe_id", "ord", "is_duplicate")


def q14_clean_rows(spark, sf_dir):
    return clean(spark, sf_dir).select("recipe_id", "ord", "title", "ingredients", "instructions")


def q14_anomalies(spark, sf_dir):
    return found(spark, sf_dir).select("recipe_id", "ord", "title", F.array_join("errors", "; ").alias("errors"))


def q15_anomaly_counts(spark, sf_dir):
    return audit.anomaly_counts(checked(spark, sf_dir))


def q16_totals(spark, sf_dir):
    totals = audit.clean_totals(clean(spark, sf_dir))
    return totals.withColumns({name: F.round(name, 6) for name in ("average_ingredients", "average_steps")})


def q16_coverage(spark, sf_dir):
    return audit.coverage(clean(spark, sf_dir)).withColumn("percent", F.round("percent", 6))


def q17_log(spark, sf_dir):
    return audit.anomaly_log(found(spark, sf_dir))


def q17_detail(spark, sf_dir):
    return audit.anomaly_detail(found(spark, sf_dir))


def q18_review_sample(spark, sf_dir):
    return audit.review_sample(clean(spark, sf_dir)).select("recipe_id", "title")


def percent(part: str, whole: str, name: str) -> str:
    return f"round(100.0::DOUBLE * {part} / {whole}, 6) AS {name}"


FIELDS = {
    "instruction_temperatures": "recipe_id % 2 = 0", "instruction_times": "recipe_id % 3 = 0", "instruction_equipment": "true",
    "cuisine": "recipe_id % 5 IN (1, 2)", "category": "true", "prep_time": "recipe_id % 7 = 0",
    "cook_time": "recipe_id % 7 <> 1", "servings": "true",
}

CHECKS = {
    "q01_structure_errors": Check(q01_structure_errors, STRUCTURED + "SELECT file_name, errors FROM records"),
    "q02_sanitize": Check(q02_sanitize, STRUCTURED + """
        SELECT file_name, title, CAST(ingredient_count AS BIGINT) AS n_ingredients,
          CAST(CASE WHEN form IN (4, 5) THEN 0 ELSE n_steps + 1 END AS BIGINT) AS n_steps, CAST(step_count AS BIGINT) AS step_count,
          CASE WHEN form IN (4, 5) THEN '[]' ELSE concat('["', k, ' min"]') END AS times FROM records"""),
    "q03_record_ids": Check(q03_record_ids, STRUCTURED + "SELECT file_name, recipe_id FROM records"),
    "q04_flags": Check(q04_flags, STRUCTURED + """
        SELECT file_name, title = '' AS has_empty_title, ingredient_count = 0 AS has_zero_ingredients,
          step_count = 0 AS has_zero_steps, errors <> '' AS has_validation_errors FROM records"""),
    "q05_status": Check(q05_status, STRUCTURED + "SELECT file_name, status FROM records"),
    "q06_json_cells": Check(q06_json_cells, STRUCTURED + """
        SELECT file_name, '[]' AS instruction_temperatures, '[]' AS instruction_equipment,
          CASE WHEN form IN (4, 5) THEN '[]' ELSE concat('["', k, ' min"]') END AS instruction_times,
          concat('[', array_to_string(list_transform(range(ingredient_count),
            lambda i: concat('{"name":"', event_type, '","quantity":', k, ',"unit":"cup","preparation":""}')), ','), ']') AS ingredients,
          concat('[', array_to_string(list_transform(range(n_texts), lambda i: concat('"', event_type, ' on"')), ','), ']') AS instructions
        FROM records"""),
    "q07_first_wins": Check(q07_first_wins, STRUCTURED + "SELECT recipe_id, file_name, title FROM kept"),
    "q08_metrics": Check(q08_metrics, STRUCTURED + f"""
        , seen AS (SELECT count(*) AS total_files, count(*) FILTER (recipe_id IS NULL) AS failed FROM records
        ), totals AS (
          SELECT count(*) AS processed, count(*) FILTER (status = 'success') AS status_success,
            count(*) FILTER (status = 'partial') AS status_partial, count(*) FILTER (status = 'failed') AS status_failed,
            CAST(sum(ingredient_count) AS BIGINT) AS total_ingredients, CAST(sum(step_count) AS BIGINT) AS total_steps,
            count(*) FILTER (title = '') AS empty_titles, count(*) FILTER (ingredient_count = 0) AS zero_ingredients,
            count(*) FILTER (step_count = 0) AS zero_steps, count(*) FILTER (errors <> '') AS validation_errors FROM kept)
        SELECT *, total_files - failed - processed AS duplicate_ids,
          round(total_ingredients::DOUBLE / processed, 6) AS average_ingredients, round(total_steps::DOUBLE / processed, 6) AS average_steps,
          {percent('status_success', 'processed', 'success_percent')}, {percent('status_partial', 'processed', 'partial_percent')},
          {percent('status_failed', 'processed', 'failed_percent')} FROM seen, totals"""),
    "q09_samples": Check(q09_samples, STRUCTURED + """
        SELECT status, nth_ AS nth, file_name FROM (
          SELECT *, row_number() OVER (PARTITION BY status ORDER BY file_name) AS nth_ FROM kept WHERE status <> 'failed')
        WHERE nth_ <= 3"""),
    "q10_ingredient_errors": Check(q10_ingredient_errors, CHECKED + "SELECT ord, coalesce(ingredient_error, '') AS errors FROM checked"),
    "q11_instruction_errors": Check(q11_instruction_errors, CHECKED + "SELECT ord, coalesce(step_error, '') AS errors FROM checked"),
    "q12_row_errors": Check(q12_row_errors, CHECKED + """
        SELECT ord, concat_ws('; ', title_error, ingredient_error, step_error) AS errors FROM checked"""),
    "q13_duplicate_flag": Check(q13_duplicate_flag, CHECKED + """
        SELECT recipe_id, ord, ord > min(ord) OVER (PARTITION BY recipe_id) AS is_duplicate FROM checked"""),
    "q14_clean_rows": Check(q14_clean_rows, CHECKED + "SELECT recipe_id, ord, title, ingredients, instructions FROM clean"),
    "q14_anomalies": Check(q14_anomalies, CHECKED + "SELECT recipe_id, ord, title, errors FROM checked WHERE errors <> ''"),
    "q15_anomaly_counts": Check(q15_anomaly_counts, CHECKED + """
        SELECT count(*) AS total_records, count(*) FILTER (errors = '') AS valid_records, count(*) FILTER (errors <> '') AS anomaly_records,
          count(*) FILTER (version = 1) AS duplicate_ids, count(*) FILTER (title_form IN (0, 1)) AS empty_titles,
          count(*) FILTER (form = 0) AS invalid_ingredients_json, count(*) FILTER (step_form = 0) AS invalid_instructions_json,
          count(*) FILTER (form = 3) AS non_numeric_quantities, count(*) FILTER (step_form = 2) AS empty_instruction_steps,
          count(*) FILTER (errors = '' AND ingredient_count = 0) AS zero_ingredients,
          count(*) FILTER (errors = '' AND step_count = 0) AS zero_steps FROM checked"""),
    "q16_totals": Check(q16_totals, CHECKED + """
        SELECT count(*) AS valid_records, CAST(sum(ingredient_count) AS BIGINT) AS total_ingredients,
          CAST(sum(step_count) AS BIGINT) AS total_steps, round(avg(ingredient_count), 6) AS average_ingredients,
          round(avg(step_count), 6) AS average_steps FROM clean"""),
    "q16_coverage": Check(q16_coverage, CHECKED + " UNION ALL ".join(
        f"SELECT '{name}' AS field, count(*) FILTER ({rule}) AS present, {percent(f'count(*) FILTER ({rule})', 'count(*)', 'percent')} FROM clean"
        for name, rule in FIELDS.items())),
    "q17_log": Check(q17_log, CHECKED + "SELECT recipe_id, errors, ord FROM checked WHERE errors <> ''"),
    "q17_detail": Check(q17_detail, CHECKED + """
        SELECT recipe_id, ord,
          CASE WHEN length(shown) > 40 THEN left(shown, 40) || '...' ELSE shown END AS title,
          CASE WHEN length(errors) > 80 THEN left(errors, 77) || '...' ELSE errors END AS errors
        FROM (SELECT *, coalesce(title, 'nan') AS shown FROM checked WHERE errors <> '' ORDER BY ord LIMIT 20)"""),
    "q18_review_sample": Check(q18_review_sample, CHECKED + """
        SELECT recipe_id, title FROM clean ORDER BY md5(concat(recipe_id, ':42')), recipe_id LIMIT 15"""),
}
