"""Quantity lines built from ``lineitem`` and ``part``.

The SQL returns the values a line was built from; it never parses the line again.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import lines
from quern.operators import records
from quern.plans.checks.registry import Check
from quern.plans.tables import derive, plain

# Each row's line, and next to it what went into the line.  A name that starts with hot or cold loses
# that word to the preparation; a size word directly after the quantity is taken for a unit.
BUILT = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, quantity, spelling, unit_built,
       p_name, first_word, second_word, is_header, comma_part, bracket_part,
       CASE WHEN is_header THEN concat('For the ', p_name, ':')
            ELSE concat(quantity_text, spelling, CASE WHEN spelling = '' THEN '' ELSE ' ' END, article, p_name,
                        CASE WHEN bracket_part = '' THEN '' ELSE concat(' (', bracket_part, ')') END,
                        CASE WHEN comma_part = '' THEN '' ELSE concat(', ', comma_part) END)
       END AS line
FROM (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, p_name, l_quantity = 50 AS is_header,
    split_part(p_name, ' ', 1) AS first_word, split_part(p_name, ' ', 2) AS second_word,
    CASE l_linenumber
      WHEN 1 THEN concat(CAST(CAST(l_quantity AS INT) AS STRING), ' ')
      WHEN 2 THEN concat(CAST(CAST(l_quantity AS INT) AS STRING), ' 1/2 ')
      WHEN 3 THEN concat(CAST(CAST(l_quantity AS INT) AS STRING), '/4 ')
      WHEN 4 THEN concat(CAST(CAST(l_quantity AS INT) AS STRING), '-', CAST(CAST(l_quantity AS INT) + 2 AS STRING), ' ')
      WHEN 5 THEN concat(CAST(CAST(l_quantity AS INT) AS STRING), ' to ', CAST(CAST(l_quantity AS INT) + 1 AS STRING), ' ')
      WHEN 6 THEN '¾ '
      ELSE '' END AS quantity_text,
    CASE l_linenumber
      WHEN 1 THEN l_quantity WHEN 2 THEN l_quantity + 0.5 WHEN 3 THEN l_quantity / 4 WHEN 4 THEN l_quantity + 1
      WHEN 5 THEN l_quantity + 0.5 WHEN 6 THEN CAST(0.75 AS DOUBLE) END AS quantity,
    CASE l_suppkey % 6 WHEN 0 THEN 'cups' WHEN 1 THEN 'Tbsp.' WHEN 2 THEN 'OZ' WHEN 3 THEN 'fl oz' WHEN 4 THEN 'pinches' ELSE '' END AS spelling,
    CASE l_suppkey % 6 WHEN 0 THEN 'cup' WHEN 1 THEN 'tablespoon' WHEN 2 THEN 'ounce' WHEN 3 THEN 'fluid_ounce' WHEN 4 THEN 'pinch' ELSE '' END AS unit_built,
    CASE WHEN l_suppkey % 6 = 0 AND l_linenumber < 7 THEN 'of the ' ELSE '' END AS article,
    CASE WHEN l_partkey % 2 = 0 THEN 'chopped' WHEN l_partkey % 5 = 0 THEN 'to taste' ELSE '' END AS comma_part,
    CASE WHEN l_partkey % 3 = 0 THEN '80% lean' ELSE '' END AS bracket_part
  FROM {lineitem} JOIN {part} ON l_partkey = p_partkey
)
"""

# What the parser has to find, from the parts of the line alone.
EXPECTED = plain(BUILT).replace("AS STRING", "AS VARCHAR")
EXPECTED = f"""
WITH built AS ({EXPECTED}), named AS (
  SELECT *, first_word IN ('hot', 'cold') AS has_state,
    NOT is_header AND quantity IS NOT NULL AND spelling = '' AND first_word IN ('large', 'small') AS size_taken
  FROM built
), expected AS (
  SELECT *,
    CASE WHEN is_header THEN NULL ELSE quantity END AS quantity_found,
    CASE WHEN is_header OR quantity IS NULL THEN '' ELSE unit_built END AS unit_found,
    CASE WHEN is_header THEN line
         WHEN quantity IS NULL THEN lower(concat(spelling, CASE WHEN spelling = '' THEN '' ELSE ' ' END,
                                                 CASE WHEN has_state THEN second_word ELSE p_name END))
         WHEN has_state OR size_taken THEN second_word ELSE p_name END AS name_found,
    CASE WHEN is_header THEN ''
         ELSE concat_ws(', ', nullif(comma_part, ''), nullif(bracket_part, ''), CASE WHEN has_state THEN first_word END)
    END AS preparation_found,
    NOT is_header AS valid_found
  FROM named
)
"""


def built(spark, sf_dir):
    return derive(spark, sf_dir, BUILT).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "line")


def parsed(spark, sf_dir):
    return lines.parse_column(built(spark, sf_dir), "line")


def tally(df, *columns):
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def p1_quantity(spark, sf_dir):
    return tally(parsed(spark, sf_dir), "original", "quantity")


def p2_unit(spark, sf_dir):
    return tally(parsed(spark, sf_dir), "original", "unit")


def p3_preparation(spark, sf_dir):
    return tally(parsed(spark, sf_dir), "original", "preparation")


def p4_name(spark, sf_dir):
    return tally(parsed(spark, sf_dir), "original", "name")


def p5_line(spark, sf_dir):
    return tally(parsed(spark, sf_dir), *lines.OUTPUT)


def recipes(spark, sf_dir):
    """One recipe per row: its line, a header, a second line that names the part, and a blank one."""
    rows = derive(spark, sf_dir, BUILT)
    listed = F.array(
        F.col("line"), F.lit("For serving:"), F.concat(F.lit("2 cans "), F.col("second_word")), F.lit(" "),
    )
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", listed.alias("ingredients"))


def p6_rollup(spark, sf_dir):
    found = records.parse_ingredients(recipes(spark, sf_dir))
    return found.select(
        "l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), "l_partkey", "l_suppkey",
        F.array_join(F.col("parsed_ingredients")["name"], "|").alias("names"),
        F.size("parsed_ingredients").cast("bigint").alias("n_valid"), F.col("ingredient_parse_status").alias("status"),
    )


def p7_metrics(spark, sf_dir):
    found = records.ingredient_metrics(records.parse_ingredients(recipes(spark, sf_dir)))
    return found.withColumns({name: F.round(name, 6) for name in ("parse_rate", "quantity_rate")})


def tally_sql(**columns: str) -> str:
    shown = ", ".join(f"{source} AS {name}" for name, source in columns.items())
    return EXPECTED + f"SELECT {shown}, count(*) AS n FROM expected GROUP BY {', '.join(columns.values())}"


CHECKS = {
    "p1_quantity": Check(p1_quantity, tally_sql(original="line", quantity="quantity_found")),
    "p2_unit": Check(p2_unit, tally_sql(original="line", unit="unit_found")),
    "p3_preparation": Check(p3_preparation, tally_sql(original="line", preparation="preparation_found")),
    "p4_name": Check(p4_name, tally_sql(original="line", name="name_found")),
    "p5_line": Check(p5_line, tally_sql(
        original="line", quantity="quantity_found", unit="unit_found", name="name_found",
        preparation="preparation_found", is_valid="valid_found")),
    "p6_rollup": Check(p6_rollup, EXPECTED + """
        SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey,
          CAST(CASE WHEN valid_found THEN 2 ELSE 1 END AS BIGINT) AS n_valid, 'success' AS status,
          CASE WHEN valid_found THEN concat(name_found, '|', second_word) ELSE second_word END AS names FROM expected"""),
    "p7_metrics": Check(p7_metrics, EXPECTED + """
        , n AS (SELECT count(*) AS recipes, 4 * count(*) AS total_lines,
          count(*) + count(*) FILTER (valid_found AND quantity_found IS NOT NULL) AS with_quantity,
          count(*) FILTER (valid_found AND quantity_found IS NULL) AS without_quantity FROM expected)
        SELECT *, round(100.0::DOUBLE * (with_quantity + without_quantity) / total_lines, 6) AS parse_rate,
          round(100.0::DOUBLE * with_quantity / total_lines, 6) AS quantity_rate FROM n"""),
}
