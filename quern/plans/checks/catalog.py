"""Catalog built from ``part``; cells are written by rule, so the SQL knows what they must become."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import cells
from quern.operators import catalog
from quern.plans.checks.registry import Check
from quern.plans.tables import derive, plain, shared

# Every part once, and those of even size a second time with another title: the later row wins.
RECORDS = """
SELECT p_partkey AS recipe_id, version * 1000000000 + p_partkey AS ord, p_size, p_name, p_type, p_brand, version,
  CASE WHEN p_size % 10 = 9 THEN NULL WHEN version = 1 THEN concat('New ', p_name) ELSE p_name END AS title,
  CASE p_size % 7 WHEN 6 THEN 'nan' WHEN 5 THEN NULL ELSE concat(' ', p_type, ', ,', lower(p_brand), ',') END AS category,
  CASE p_size % 5 WHEN 0 THEN concat('PT', CAST(p_size % 4 AS STRING), 'H', CAST(p_size AS STRING), 'M')
                  WHEN 1 THEN concat('PT', CAST(p_size AS STRING), 'M') WHEN 2 THEN 'PT45S' WHEN 3 THEN 'P1D' END AS cook_time,
  CASE p_size % 2 WHEN 0 THEN 'PT0M' ELSE concat('PT', CAST(p_size % 3 AS STRING), 'H') END AS prep_time,
  'PT1H30M' AS total_time,
  CASE p_size % 4 WHEN 0 THEN CAST(p_size AS STRING) WHEN 1 THEN concat(CAST(p_size AS STRING), '.7') WHEN 2 THEN 'four' END AS servings,
  CASE p_size % 6 WHEN 5 THEN '[{{"name": broken'
       ELSE concat('[{{"name":"', p_name, '","quantity":', CAST(p_size AS STRING), '.0,"unit":"cup","preparation":"chopped"}},',
                   '{{"name":"', lower(p_type), '","quantity":0.5,"unit":"","preparation":""}},"loose",',
                   '{{"name":"half","quantity":"1/2","unit":"","unit":"cup","preparation":""}},',
                   '{{"name":"","quantity":null,"unit":"","preparation":"diced"}}]') END AS ingredients,
  CASE p_size % 6 WHEN 4 THEN NULL
       ELSE concat('["Take the ', p_name, '",{{"step":7,"description":"Turn"}},{{"description":"Wait"}}]') END AS instructions
FROM (SELECT *, 0 AS version FROM {part} UNION ALL SELECT *, 1 AS version FROM {part} WHERE p_size % 2 = 0)
"""

IMAGES = "https://images.example.com/{id}.jpg"

EXPECTED = f"""
WITH rows AS ({plain(RECORDS).replace('AS STRING', 'AS VARCHAR')}), last AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY recipe_id ORDER BY ord DESC) AS nth FROM rows) WHERE nth = 1
), shaped AS (
  SELECT *, recipe_id AS id, coalesce(title, 'nan') AS shown_title,
    p_size % 7 < 5 AS has_category,
    upper(left(p_type, 1)) || lower(substr(p_type, 2)) AS first_category, p_brand AS second_category,
    CASE p_size % 5 WHEN 0 THEN (p_size % 4) * 60 + p_size WHEN 1 THEN p_size ELSE 0 END AS cook_minutes,
    CASE p_size % 2 WHEN 0 THEN 0 ELSE (p_size % 3) * 60 END AS prep_minutes,
    CASE p_size % 4 WHEN 0 THEN p_size WHEN 1 THEN p_size ELSE 0 END AS servings_found,
    p_size % 6 <> 5 AS has_ingredients, p_size % 6 <> 4 AS has_instructions
  FROM last
)
"""
MINUTES = "CAST(CASE WHEN cook_minutes > 0 THEN cook_minutes WHEN prep_minutes > 0 THEN prep_minutes ELSE 90 END AS BIGINT)"


def rows(spark, sf_dir):
    return derive(spark, sf_dir, RECORDS)


def built(spark, sf_dir):
    return shared(spark, sf_dir, "catalog", lambda: catalog.store_by_id(catalog.build_catalog(rows(spark, sf_dir), IMAGES)))


def long(name):
    return F.col(name).cast("bigint").alias(name)


def c01_categories(spark, sf_dir):
    listed = catalog.keep_last(rows(spark, sf_dir), "recipe_id", "ord")
    return listed.select(F.col("recipe_id").alias("id"), F.array_join(cells.category_list(F.col("category")), "|").alias("categories"))


def c02_json_lists(spark, sf_dir):
    listed = catalog.keep_last(rows(spark, sf_dir), "recipe_id", "ord")
    return listed.select(
        F.col("recipe_id").alias("id"), F.size(cells.json_items(F.col("ingredients"))).cast("bigint").alias("n_ingredients"),
        F.size(cells.json_items(F.col("instructions"))).cast("bigint").alias("n_instructions"),
    )


def c03_amounts(spark, sf_dir):
    return built(spark, sf_dir).select("id", F.array_join(F.col("ingredients")["amount"], "|").alias("amounts"))


def c04_cook_time(spark, sf_dir):
    return built(spark, sf_dir).select("id", long("cook_time_minutes"))


def c05_durations(spark, sf_dir):
    found = rows(spark, sf_dir).select(
        "recipe_id", "ord", *[cells.iso_minutes(F.col(name)).cast("bigint").alias(name) for name in ("cook_time", "prep_time", "total_time")]
    )
    return catalog.keep_last(found, "recipe_id", "ord").drop("ord")


def c06_servings(spark, sf_dir):
    return built(spark, sf_dir).select("id", long("servings"))


def c07_ingredients(spark, sf_dir):
    return built(spark, sf_dir).select("id", F.array_join(F.col("ingredients")["name"], "|").alias("names"))


def c08_numbered_steps(spark, sf_dir):
    steps = built(spark, sf_dir).select("id", F.explode("instructions").alias("s"))
    return steps.select("id", F.col("s.step").cast("bigint").alias("step"), "s.description")


def c09_ingredient_text(spark, sf_dir):
    return built(spark, sf_dir).select("id", "ingredients_text")


def c10_images(spark, sf_dir):
    return built(spark, sf_dir).select("id", "image")


def c11_catalog(spark, sf_dir):
    return built(spark, sf_dir).select("id", "title", "description", long("cook_time_minutes"), long("servings"), "ingredients_text")


def c12_facet_counts(spark, sf_dir):
    return catalog.facet_counts(built(spark, sf_dir))


def c13_facets(spark, sf_dir):
    """The rank column keeps the order for comparison."""
    ordered = catalog.facets(built(spark, sf_dir))
    place = F.row_number().over(catalog.Window.orderBy(F.desc("n"), "category"))
    return ordered.select("category", "n", place.cast("bigint").alias("place"))


def c14_lookup(spark, sf_dir):
    return catalog.lookup(built(spark, sf_dir), 17).select("id", "title")


def c15_browse(spark, sf_dir):
    return catalog.browse(built(spark, sf_dir), ["Promo"], seed=42).select("id", "title")


def c16_responses(spark, sf_dir):
    shaped = catalog.responses(built(spark, sf_dir))
    return shaped.select(
        "id", "title", "description", "image", F.array_join("categories", "|").alias("categories"),
        long("cookTimeMinutes"), long("servings"), F.to_json("ingredients").alias("ingredients"),
    )


CATEGORIES = "CASE WHEN has_category THEN first_category || '|' || second_category ELSE '' END"
NAMES = "CASE WHEN has_ingredients THEN p_name || ' ' || lower(p_type) || ' half' ELSE '' END"
FACETS = """, facet AS (
  SELECT category, count(*) AS n FROM (
    SELECT first_category AS category FROM shaped WHERE has_category
    UNION ALL SELECT second_category FROM shaped WHERE has_category) GROUP BY category)"""

CHECKS = {
    "c01_categories": Check(c01_categories, EXPECTED + f"SELECT id, {CATEGORIES} AS categories FROM shaped"),
    "c02_json_lists": Check(c02_json_lists, EXPECTED + """
        SELECT id, CAST(CASE WHEN has_ingredients THEN 5 ELSE 0 END AS BIGINT) AS n_ingredients,
          CAST(CASE WHEN has_instructions THEN 3 ELSE 0 END AS BIGINT) AS n_instructions FROM shaped"""),
    "c03_amounts": Check(c03_amounts, EXPECTED + """
        SELECT id, CASE WHEN has_ingredients THEN concat(p_size, ' cup chopped|0.5|1/2 cup|diced') ELSE '' END AS amounts FROM shaped"""),
    "c04_cook_time": Check(c04_cook_time, EXPECTED + f"SELECT id, {MINUTES} AS cook_time_minutes FROM shaped"),
    "c05_durations": Check(c05_durations, EXPECTED + """
        SELECT recipe_id, CAST(cook_minutes AS BIGINT) AS cook_time, CAST(prep_minutes AS BIGINT) AS prep_time,
          CAST(90 AS BIGINT) AS total_time FROM shaped"""),
    "c06_servings": Check(c06_servings, EXPECTED + "SELECT id, CAST(servings_found AS BIGINT) AS servings FROM shaped"),
    "c07_ingredients": Check(c07_ingredients, EXPECTED + """
        SELECT id, CASE WHEN has_ingredients THEN p_name || '|' || lower(p_type) || '|half|' ELSE '' END AS names FROM shaped"""),
    "c08_numbered_steps": Check(c08_numbered_steps, EXPECTED + """
        SELECT id, CAST(1 AS BIGINT) AS step, 'Take the ' || p_name AS description FROM shaped WHERE has_instructions
        UNION ALL SELECT id, 7, 'Turn' FROM shaped WHERE has_instructions
        UNION ALL SELECT id, 3, 'Wait' FROM shaped WHERE has_instructions"""),
    "c09_ingredient_text": Check(c09_ingredient_text, EXPECTED + f"SELECT id, {NAMES} AS ingredients_text FROM shaped"),
    "c10_images": Check(c10_images, EXPECTED + """
        SELECT id, concat('https://images.example.com/', id, '.jpg') AS image FROM shaped"""),
    "c11_catalog": Check(c11_catalog, EXPECTED + f"""
        SELECT id, shown_title AS title, '' AS description, {MINUTES} AS cook_time_minutes,
          CAST(servings_found AS BIGINT) AS servings, {NAMES} AS ingredients_text FROM shaped"""),
    "c12_facet_counts": Check(c12_facet_counts, EXPECTED + FACETS + "SELECT category, n FROM facet"),
    "c13_facets": Check(c13_facets, EXPECTED + FACETS + """
        SELECT category, n, row_number() OVER (ORDER BY n DESC, category) AS place FROM facet"""),
    "c14_lookup": Check(c14_lookup, EXPECTED + "SELECT id, shown_title AS title FROM shaped WHERE id = 17"),
    "c15_browse": Check(c15_browse, EXPECTED + """
        SELECT id, shown_title AS title FROM shaped WHERE has_category AND first_category = 'Promo'
        ORDER BY md5(concat(id, ':42')), id LIMIT 20"""),
    "c16_responses": Check(c16_responses, EXPECTED + f"""
        SELECT id, shown_title AS title, shown_title AS description,
          concat('https://images.example.com/', id, '.jpg') AS image, {CATEGORIES} AS categories,
          {MINUTES} AS "cookTimeMinutes", CAST(servings_found AS BIGINT) AS servings,
          CASE WHEN has_ingredients THEN concat('[{{"name":"', p_name, '","amount":"', p_size, ' cup chopped"}},{{"name":"',
            lower(p_type), '","amount":"0.5"}},{{"name":"half","amount":"1/2 cup"}},{{"name":"","amount":"diced"}}]') ELSE '[]' END AS ingredients FROM shaped"""),
}
