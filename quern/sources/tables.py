"""Materialisation points: written parquet tables in the folder the cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder for written tables: ``spark.checkpoint.dir``; a scratch folder only in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    local = spark.sparkContext.master.startswith("local")
    if configured:
        if configured.startswith("file:") and not local:
            raise ValueError(f"{configured} is on the machine of each executor; set spark.checkpoint.dir to a shared folder")
        return configured.rstrip("/")
    if not local:
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    fresh = tempfile.mkdtemp(prefix="quern-")
    spark.sparkContext.setCheckpointDir(fresh)
    return fresh


def spread(df: DataFrame) -> DataFrame:
    """Spread a table with fewer splits than cores over all cores.  Others are left alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def divided(df: DataFrame, rows: int) -> DataFrame:
    """Divide a table into parts of about ``rows`` rows at most.  One with as many splits already is left alone.

    Splits follow bytes, and a narrow table packs millions of rows into each.
    """
    parts = -(-df.count() // rows)
    return df.repartition(parts) if parts > df.rdd.getNumPartitions() else df


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/quern/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def store(df: DataFrame, name: str, sort_by: Sequence[str | Column] = ()) -> DataFrame:
    """Write ``df`` once and read it back, so later plans start from files and not from its lineage.

    Unlike ``persist`` this survives the loss of executors, and unlike ``checkpoint`` the result
    still takes column pruning and row-group pruning.
    """
    if sort_by:
        df = df.sortWithinPartitions(*sort_by)
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
