"""From raw documents to packed training bins, in five stages.

Each stage reads all that its predecessor kept, written as Parquet in the shared folder.  All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import langid, neardup, packing, pii, quality
from quern.sources.tables import store

# A text with at least this many n-grams of which the likeliest language claims fewer than this share is in none of them.
LANGUAGE_N_GRAMS = 20
LANGUAGE_COVERAGE = 0.2
QUALITY_SCORE = 0.3


def _held_out(parts: int, rest: int):
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(parts)) == rest, F.lit(False))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language.  Rejected: texts without a letter, and texts that look like no known language."""
    model = langid.train(docs.where(~_held_out(3, 1)), "doc_id", "text", "lang")
    return langid.keep(docs, "text", model, LANGUAGE_N_GRAMS, LANGUAGE_COVERAGE)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    train = ~_held_out(5, 0)
    network = quality.train(docs.where(train), labels.where(train), "doc_id", "text", "quality")
    return quality.keep(docs, "text", network, QUALITY_SCORE)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every near-duplicate group; rows without an id, and empty texts, stay."""
    found = neardup.groups(docs, "doc_id", "text", neardup.Sketch(words=5, percent=80))
    return neardup.keep_first(docs, "doc_id", "text", found)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without personal data."""
    return pii.sanitise(docs, "text").withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bin of every document or piece of one."""
    return packing.pack_texts(docs, "doc_id", "text", "source").withColumnRenamed("id", "doc_id")


STAGES = [("language", language), ("quality", good), ("near_duplicates", distinct), ("personal_data", private), ("packing", packed)]

# Training, similarity groups and greedy packing are not SQL; tests hold each stage against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
