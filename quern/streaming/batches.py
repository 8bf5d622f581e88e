"""Appends and tallies of a stream whose batches may come twice: each takes effect once.

What a batch writes lies in a folder of its own, named by the stream and the batch; a batch counts once it stands in the
``commits`` table, which is written last.  A batch that comes again after its commit does nothing.  One that stopped
before it is computed and written anew, over what was left.  Keys of committed batches are the state of the key filter;
it outlives the checkpoint, and a stream that starts with a new checkpoint is another stream with batches of its own.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.sources.incremental import new_rows, outcome_counts

COMMITS = "stream string, batch long"
Work = Callable[[DataFrame, DataFrame | None], DataFrame]


def prepare(spark: SparkSession, target: str) -> None:
    """Make an empty target; one that exists is left alone."""
    spark.createDataFrame([], COMMITS).write.mode("ignore").parquet(f"{target}/commits")


def commits(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.schema(COMMITS).parquet(f"{target}/commits").distinct()


def committed(spark: SparkSession, target: str) -> DataFrame | None:
    """The rows of all committed batches, with ``stream`` and ``batch``; None before the first."""
    done = commits(spark, target)
    if done.isEmpty():
        return None
    rows = spark.read.option("mergeSchema", "false").parquet(f"{target}/rows")
    typed = rows.withColumns({"stream": F.col("stream").cast("string"), "batch": F.col("batch").cast("long")})
    return typed.join(F.broadcast(done) if done.limit(100_001).count() <= 100_000 else done, ["stream", "batch"], "left_semi")


def commit(spark: SparkSession, target: str, stream: str, batch: int) -> None:
    spark.createDataFrame([(stream, batch)], COMMITS).coalesce(1).write.mode("append").parquet(f"{target}/commits")


def handle(batch: DataFrame, number: int, stream: str, target: str, work: Work) -> bool:
    """Take in one batch; whether it was new.  ``work`` makes its rows of it and of all rows committed so far."""
    spark = batch.sparkSession
    if not commits(spark, target).where((F.col("stream") == stream) & (F.col("batch") == number)).isEmpty():
        return False
    rows = work(batch, committed(spark, target))
    rows.write.mode("overwrite").parquet(f"{target}/rows/stream={stream}/batch={number}")
    commit(spark, target, stream, number)
    return True


def _stream_name(spark: SparkSession, checkpoint: str) -> str:
    """The id that a checkpoint gives its stream for life."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first().value)["id"]


def run(
    spark: SparkSession, source: str, schema: T.StructType, target: str, checkpoint: str, work: Work, files_per_batch: int | None = None
) -> None:
    """Hand the files that ``source`` has and earlier runs have not seen to ``work``, batch by batch."""
    prepare(spark, target)
    reader = spark.readStream.schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)

    def take(batch: DataFrame, number: int) -> None:
        handle(batch, number, _stream_name(spark, checkpoint), target, work)

    query = reader.parquet(source).writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def unseen(key: str, stored: DataFrame | None = None) -> Work:
    """Rows whose key is in no earlier batch and not in ``stored``; repeats inside a batch stay."""

    def work(batch: DataFrame, earlier: DataFrame | None) -> DataFrame:
        known = [rows.select(key) for rows in (stored, earlier) if rows is not None]
        for rows in known:
            batch = new_rows(batch, rows, key)
        return batch

    return work


def tallies(status_col: str = "status") -> Work:
    """``(outcome, n)`` of a batch of a fetch log; :func:`tallied` adds them up."""
    return lambda batch, earlier: outcome_counts(batch, status_col)


def tallied(spark: SparkSession, target: str) -> DataFrame:
    rows = committed(spark, target)
    if rows is None:
        return spark.createDataFrame([], "outcome string, n long")
    return rows.groupBy("outcome").agg(F.sum("n").cast("bigint").alias("n"))
