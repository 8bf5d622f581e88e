"""Instruction steps built from ``lineitem``; the SQL returns what a step was built from."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import steps
from quern.operators import records
from quern.plans.checks.registry import Check
from quern.plans.tables import derive, plain

KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
SENTENCE = "Whisk the batch number X in a mixing bowl until smooth"

def step_text(form: str) -> str:
    """0 an oven step, 1 a pan step, 2 a bracketed step, 3 a long block of five sentences, 4 a blank one."""
    return f"""CASE {form}
    WHEN 0 THEN concat('Step ', CAST(l_linenumber AS STRING), ': Bake  at ', number, '°F for ', minutes, ' minutes in the Oven;')
    WHEN 1 THEN concat(CAST(l_linenumber AS STRING), '. Heat the pan on medium-high heat for about ', number)
    WHEN 2 THEN concat('(', CAST(l_linenumber AS STRING), ') Slowly stir with a wooden spoon overnight - ')
    WHEN 3 THEN concat('STEP ', CAST(l_linenumber AS STRING), ') ', repeat(concat(replace('{SENTENCE}', 'X', number), '. '), 5), 'Ok.')
    ELSE concat(CAST(l_linenumber AS STRING), ')  ') END"""


BUILT = f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, form, number, minutes,
  {step_text('form')} AS step, {step_text('(form + 1) % 5')} AS next_step
FROM (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_partkey % 5 AS form,
    CAST(CAST(l_quantity AS INT) + 300 AS STRING) AS number, CAST(CAST(l_quantity AS INT) AS STRING) AS minutes
  FROM {{lineitem}}
)
"""

EXPECTED = f"""
WITH built AS ({plain(BUILT).replace('AS STRING', 'AS VARCHAR')}), expected AS (
  SELECT *,
    CASE form
      WHEN 0 THEN concat('Bake at ', number, '°F for ', minutes, ' minutes in the Oven')
      WHEN 1 THEN concat('Heat the pan on medium-high heat for about ', number)
      WHEN 2 THEN 'Slowly stir with a wooden spoon overnight'
      WHEN 3 THEN concat(repeat(concat(replace('{SENTENCE}', 'X', number), '. '), 5), 'Ok.')
      ELSE '' END AS clean,
    CASE form WHEN 0 THEN concat(number, '°F') WHEN 1 THEN 'medium|high heat' WHEN 2 THEN 'low' ELSE '' END AS temperatures,
    CASE form WHEN 0 THEN concat(minutes, ' minutes') WHEN 1 THEN concat('for about ', number) WHEN 2 THEN 'overnight'
              WHEN 3 THEN 'until smooth' ELSE '' END AS times,
    CASE form WHEN 0 THEN 'oven' WHEN 1 THEN 'pan' WHEN 2 THEN 'wooden spoon' WHEN 3 THEN 'whisk|mixing bowl' ELSE '' END AS equipment,
    CASE form WHEN 3 THEN 5 WHEN 4 THEN 0 ELSE 1 END AS pieces
  FROM built
)
"""


def built(spark, sf_dir):
    return derive(spark, sf_dir, BUILT)


def i1_clean_step(spark, sf_dir):
    cleaned = built(spark, sf_dir).select("step", steps.clean_step(F.col("step")).alias("clean"))
    return cleaned.groupBy("step", "clean").agg(F.count(F.lit(1)).alias("n"))


def i2_split_block(spark, sf_dir):
    split = built(spark, sf_dir).select("step", steps.step_texts(F.array("step")).alias("texts"))
    return split.groupBy("step").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.size("texts")).cast("bigint").alias("pieces"),
        F.max(F.get("texts", F.size("texts") - 1)).alias("last_piece"),
    )


def i3_step_facts(spark, sf_dir):
    text = F.col("step")
    found = built(spark, sf_dir).select(
        "step",
        F.array_join(steps.temperatures(text), "|").alias("temperatures"),
        F.array_join(steps.times(text), "|").alias("times"),
        F.array_join(steps.equipment(text), "|").alias("equipment"),
    )
    return found.groupBy("step", "temperatures", "times", "equipment").agg(F.count(F.lit(1)).alias("n"))


def recipes(spark, sf_dir):
    """One recipe per row: its step, the next form, and the first again; returned rows have none."""
    listed = F.when(F.col("l_returnflag") == "R", F.array().cast("array<string>")).otherwise(
        F.array("step", "next_step", "step")
    )
    return built(spark, sf_dir).select(*KEY, listed.alias("instructions"))


def keyed(df, *columns):
    return df.select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), "l_partkey", "l_suppkey", *columns)


def i4_rollup(spark, sf_dir):
    done = records.process_instructions(recipes(spark, sf_dir)).select(*KEY, "processed_instructions.*")
    return keyed(
        done, F.col("step_count").cast("bigint").alias("step_count"),
        *[F.array_join(F.col("metadata")[name], "|").alias(name) for name in records.METADATA],
    )


def i5_status(spark, sf_dir):
    done = records.process_instructions(recipes(spark, sf_dir))
    return keyed(done, F.col("instruction_status").alias("status"))


def i6_metrics(spark, sf_dir):
    done = records.instruction_metrics(records.process_instructions(recipes(spark, sf_dir)))
    return done.withColumn("average_steps", F.round("average_steps", 6))


# The facts of two neighbouring forms never overlap, so a recipe has those of its step, then of the next.
FACTS = {
    "temperatures": "CASE {form} WHEN 0 THEN concat(number, '°F') WHEN 1 THEN 'medium|high heat' WHEN 2 THEN 'low' END",
    "times": "CASE {form} WHEN 0 THEN concat(minutes, ' minutes') WHEN 1 THEN concat('for about ', number) WHEN 2 THEN 'overnight' WHEN 3 THEN 'until smooth' END",
    "equipment": "CASE {form} WHEN 0 THEN 'oven' WHEN 1 THEN 'pan' WHEN 2 THEN 'wooden spoon' WHEN 3 THEN 'whisk|mixing bowl' END",
}
PIECES = "CASE {form} WHEN 3 THEN 5 WHEN 4 THEN 0 ELSE 1 END"


def both(expression: str, how: str) -> str:
    here, after = expression.format(form="form"), expression.format(form="(form + 1) % 5")
    return how.format(here, after)


ROLLUP = EXPECTED + ", rolled AS (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey, l_returnflag = 'R' AS bare, " + (
    f"CAST(CASE WHEN l_returnflag = 'R' THEN 0 ELSE {both(PIECES, '2 * {} + {}')} END AS BIGINT) AS step_count, "
) + ", ".join(
    f"CASE WHEN l_returnflag = 'R' THEN '' ELSE {both(expression, 'concat_ws(chr(124), {}, {})')} END AS {name}"
    for name, expression in FACTS.items()
) + " FROM expected)"

CHECKS = {
    "i1_clean_step": Check(i1_clean_step, EXPECTED + "SELECT step, clean, count(*) AS n FROM expected GROUP BY ALL"),
    "i2_split_block": Check(i2_split_block, EXPECTED + f"""
        SELECT step, count(*) AS n, CAST(max(pieces) AS BIGINT) AS pieces,
          max(CASE form WHEN 3 THEN concat(replace('{SENTENCE}', 'X', number), '.') WHEN 4 THEN NULL ELSE clean END) AS last_piece
        FROM expected GROUP BY step"""),
    "i3_step_facts": Check(i3_step_facts, EXPECTED + """
        SELECT step, temperatures, times, equipment, count(*) AS n FROM expected GROUP BY ALL"""),
    "i4_rollup": Check(i4_rollup, ROLLUP + "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, step_count, temperatures, times, equipment FROM rolled"),
    "i5_status": Check(i5_status, ROLLUP + """
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN bare THEN 'no_instructions' WHEN step_count > 0 THEN 'success' ELSE 'failed' END AS status
        FROM rolled"""),
    "i6_metrics": Check(i6_metrics, ROLLUP + """
        SELECT count(*) AS processed, count(*) FILTER (bare) AS no_instructions,
          CAST(sum(step_count) AS BIGINT) AS total_steps,
          count(*) FILTER (temperatures <> '') AS with_temperatures, count(*) FILTER (times <> '') AS with_times,
          count(*) FILTER (equipment <> '') AS with_equipment,
          round(CAST(sum(step_count) AS DOUBLE) / count(*), 6) AS average_steps
        FROM rolled"""),
}
