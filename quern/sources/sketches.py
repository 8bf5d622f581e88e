"""Counts that can be stored and merged: rows and missing values exactly, distinct values by sketches.

A sketch table has a row for each part of a table: ``(part, column, n_rows, n_missing, sketch)``.  Parts are written as
they come and merged at any time, without reading their rows again; merging is the same in any order and grouping.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# 2 ** 12 registers, some four kilobytes a sketch.  An estimate is off by one standard error about every third time.
REGISTERS_LOG = 12
STANDARD_ERROR = 1.04 / 2 ** (REGISTERS_LOG / 2)


def sketch_columns(rows: DataFrame, columns: Mapping[str, Column] | Sequence[str], part: Column) -> DataFrame:
    """``(part, column, n_rows, n_missing, sketch)`` of some columns or expressions.

    Values count by their text, so every type goes.  Sketches are built in each task and united after the shuffle, so
    one part may hold most rows.  A part without rows has none here.
    """
    named = dict(columns) if isinstance(columns, Mapping) else {name: F.col(name) for name in columns}
    # Each input row is aggregated where it is; columns become rows only when they are sketches.
    facts = [
        piece for at, value in enumerate(named.values())
        for piece in (F.hll_sketch_agg(value.cast("string"), F.lit(REGISTERS_LOG)).alias(f"s{at}"), F.count(value).alias(f"n{at}"))
    ]
    found = rows.withColumn("_part", part).groupBy(F.col("_part").alias("part")).agg(F.count(F.lit(1)).alias("n_rows"), *facts)
    listed = F.array(*[
        F.struct(F.lit(name).alias("column"), (F.col("n_rows") - F.col(f"n{at}")).alias("n_missing"), F.col(f"s{at}").alias("sketch"))
        for at, name in enumerate(named)
    ])
    return found.select("part", "n_rows", F.inline(listed)).select("part", "column", "n_rows", "n_missing", "sketch")


def sketch_tokens(rows: DataFrame, columns: Mapping[str, Column], part: Column) -> DataFrame:
    """The same for the distinct tokens of array columns; ``n_rows`` counts tokens."""
    tables = []
    for name, tokens in columns.items():
        each = rows.select(part.alias("_of"), F.explode(tokens).alias(name))
        tables.append(sketch_columns(each, [name], F.col("_of")))
    return reduce(DataFrame.unionByName, tables)


def merge(sketches: DataFrame, part: Column | None = None) -> DataFrame:
    """Parts as one, or as one for each value of ``part``."""
    whole = F.lit("all") if part is None else part
    return sketches.withColumn("_part", whole).groupBy(F.col("_part").alias("part"), "column").agg(
        F.sum("n_rows").cast("bigint").alias("n_rows"), F.sum("n_missing").cast("bigint").alias("n_missing"), F.hll_union_agg("sketch").alias("sketch")
    )


def estimates(sketches: DataFrame) -> DataFrame:
    """``(part, column, n_rows, n_missing, n_distinct)``."""
    return sketches.select("part", "column", "n_rows", "n_missing", F.hll_sketch_estimate("sketch").alias("n_distinct"))


def reduction(sketches: DataFrame, before: str, after: str) -> DataFrame:
    """``(vocab_before, vocab_after, reduction_percent)`` of two sketched vocabularies, as far as sketches tell."""
    counted = estimates(merge(sketches))
    both = counted.agg(
        F.coalesce(F.max(F.when(F.col("column") == before, F.col("n_distinct"))), F.lit(0)).alias("vocab_before"),
        F.coalesce(F.max(F.when(F.col("column") == after, F.col("n_distinct"))), F.lit(0)).alias("vocab_after"),
    )
    percent = F.try_divide(100.0 * (F.col("vocab_before") - F.col("vocab_after")), F.col("vocab_before"))
    return both.withColumn("reduction_percent", F.coalesce(percent, F.lit(0.0)))
