"""Incremental runs over a folder that only grows: each input file is handled once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def process_new_files(
    spark: SparkSession,
    source: str,
    schema: T.StructType,
    work: Callable[[DataFrame], DataFrame],
    target: str,
    checkpoint: str,
) -> None:
    """Run ``work`` on the files that earlier runs have not seen and append its rows to ``target``.

    ``work`` must be row-local.  The checkpoint folder remembers what is done, so a repeated run with
    no new files writes nothing.
    """
    incoming = spark.readStream.schema(schema).parquet(source)
    query = (
        work(incoming).writeStream.format("parquet").option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start(target)
    )
    query.awaitTermination()
