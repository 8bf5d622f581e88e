"""Incremental ingest: what is new, what is left to do, what came of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import fixed
from quern.operators.skew import lookup_join
from quern.sources.tables import store


def listing_rows(
    incoming: DataFrame, id_col: str = "id", title_col: str = "title", image_col: str = "image", url_col: str = "sourceUrl"
) -> DataFrame:
    """Incoming rows in the twelve listing columns; columns not known yet are empty."""
    url = F.when(F.coalesce(F.col(url_col), F.lit("")) != "", F.col(url_col)).otherwise(F.lit(fixed.NO_SOURCE_URL))
    known = {
        "recipe_id": F.col(id_col).cast("bigint"), "title": F.col(title_col), "image": F.col(image_col), "instructions": url,
    }
    return incoming.select(*[known.get(name, F.lit("")).alias(name) for name in fixed.LISTING_COLUMNS])


def new_rows(incoming: DataFrame, stored: DataFrame, key: str, dedupe_batch: bool = False) -> DataFrame:
    """Rows whose id is not stored yet; repeats inside the batch stay unless asked otherwise."""
    known = stored.select(F.col(key)).distinct()
    fresh = lookup_join(store(incoming, "incoming"), known, [key], "left_anti")
    return fresh.dropDuplicates([key]) if dedupe_batch else fresh


def append_new(incoming: DataFrame, stored: DataFrame, path: str, id_col: str = "id") -> None:
    """Append the unseen incoming rows to the stored listing."""
    listing = listing_rows(incoming, id_col)
    new_rows(listing, stored, "recipe_id").write.mode("append").parquet(path)


def to_do(items: DataFrame, finished: DataFrame, key: str) -> DataFrame:
    """Items without an output."""
    return lookup_join(store(items, "items"), finished.select(key).distinct(), [key], "left_anti")


def plan_counts(items: DataFrame, finished: DataFrame, key: str) -> DataFrame:
    """``(total, skipped, to_do)``."""
    done = finished.select(key).distinct().withColumn("_done", F.lit(True))
    marked = lookup_join(store(items.select(key), "items"), done, [key], "left")
    return marked.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("_done").isNotNull()).alias("skipped"),
        F.count_if(F.col("_done").isNull()).alias("to_do"),
    )


def fetch_outcome(status: Column) -> Column:
    return (
        F.when(status.between(200, 299), F.lit("saved"))
        .when(status.isNull(), F.lit("failed"))
        .otherwise(F.lit("not_found"))
    )


def outcome_counts(log: DataFrame, status_col: str = "status") -> DataFrame:
    counted = log.select(fetch_outcome(F.col(status_col)).alias("outcome")).groupBy("outcome")
    return counted.agg(F.count(F.lit(1)).alias("n"))
