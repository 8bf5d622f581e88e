"""JSON documents, one per file, and JSON record sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.cells import json_strings, parse_json
from quern.operators.catalog import keep_last
from quern.operators.records import file_stem


def read_documents(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """``(file_path, file_name, doc, loaded)``; a corrupt file has a NULL document and does not stop the scan."""
    files = (
        spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
        .schema("value string").text(path)
    )
    parsed = files.select(
        F.col("_metadata.file_path").alias("file_path"),
        F.url_decode(F.col("_metadata.file_name")).alias("file_name"),
        parse_json(F.col("value")).alias("doc"),
    )
    return parsed.withColumn("loaded", F.col("doc").isNotNull())


def load_summary(documents: DataFrame) -> DataFrame:
    return documents.agg(
        F.count(F.lit(1)).alias("total"), F.count_if("loaded").alias("loaded"), F.count_if(~F.col("loaded")).alias("failed")
    )


def failed_files(documents: DataFrame) -> DataFrame:
    return documents.where(~F.col("loaded")).select("file_path", "file_name")


def with_key(records: DataFrame, key: str = "recipe_id", file_col: str = "file_name") -> DataFrame:
    """Fill a missing record key from the stem of the file name."""
    return records.withColumn(key, F.coalesce(F.col(key).cast("string"), file_stem(F.col(file_col))))


def write_records(df: DataFrame, path: str) -> None:
    """Nested record sink: one data set of JSON lines."""
    df.write.option("ignoreNullFields", False).json(path)


def keyed_lists(rows: DataFrame, key: str, list_col: str, order: str) -> DataFrame:
    """``(key, items)`` with one row per key, the last in table order; a broken cell is an empty list."""
    return keep_last(rows, key, order).select(
        F.col(key).cast("bigint").alias(key), json_strings(F.col(list_col)).alias("items")
    )


def write_keyed_lists(rows: DataFrame, key: str, list_col: str, order: str, path: str) -> None:
    keyed_lists(rows, key, list_col, order).write.json(path)
