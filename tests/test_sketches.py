"""Stored sketches: parts merge to the whole, in any order, and estimates stay near the truth."""

import pytest
from pyspark.sql import functions as F

from quern.sources import sketches

WITHIN = 5 * sketches.STANDARD_ERROR


@pytest.fixture(scope="module")
def rows(spark):
    key = F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 20_011)
    return spark.range(60_000).select(
        "id", key.alias("key"), F.when(F.col("id") % 10 > 0, F.col("id") % 7).alias("few"), F.lit(None).cast("string").alias("none"), (F.col("id") % 9).alias("day")
    )


def shown(table):
    return sorted(map(tuple, sketches.estimates(table).collect()))


def test_parts_merge_to_the_whole(rows):
    parts = sketches.sketch_columns(rows, ["id", "key", "few", "none"], F.col("day"))
    assert parts.count() == 9 * 4
    # A sketch of one part is united with nothing, so that both sides are unions.
    whole = sketches.merge(sketches.sketch_columns(rows, ["id", "key", "few", "none"], F.lit(0)))
    assert shown(sketches.merge(parts)) == shown(whole)
    halves = sketches.merge(parts, F.col("part") % 2)
    assert halves.count() == 2 * 4 and shown(sketches.merge(halves)) == shown(whole)
    late = parts.where("part < 4").unionByName(sketches.merge(parts.where("part >= 4")).withColumn("part", F.lit(99).cast("bigint")))
    assert shown(sketches.merge(late)) == shown(whole)


def test_estimates_stay_within_the_bound(rows):
    found = {r.column: r for r in sketches.estimates(sketches.merge(sketches.sketch_columns(rows, ["id", "key", "few", "none", "day"], F.col("day")))).collect()}
    exact = {"id": 60_000, "key": rows.select("key").distinct().count(), "few": 7, "none": 0, "day": 9}
    assert all(abs(found[name].n_distinct - n) <= WITHIN * n for name, n in exact.items())
    assert (found["few"].n_rows, found["few"].n_missing, found["none"].n_missing) == (60_000, 6_000, 60_000)
    assert sketches.sketch_columns(rows.limit(0), ["id"], F.col("day")).isEmpty()


def test_vocabularies(spark):
    docs = spark.range(3000).select(F.array(F.concat(F.lit("A"), F.col("id")), F.lit("the"), F.lit(None)).alias("raw"), F.array(F.concat(F.lit("a"), F.col("id") % 600)).alias("normal"), (F.col("id") % 4).alias("p"))
    parts = sketches.sketch_tokens(docs, {"raw": F.col("raw"), "normal": F.col("normal")}, F.col("p"))
    row = sketches.reduction(parts, "raw", "normal").first()
    assert abs(row.vocab_before - 3001) <= WITHIN * 3001 and abs(row.vocab_after - 600) <= WITHIN * 600 and abs(row.reduction_percent - 80) < 5
    assert sketches.reduction(parts.limit(0), "raw", "normal").first().reduction_percent == 0
