"""Table profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException


def table_counts(df: DataFrame | None, key: str) -> DataFrame | tuple[int, int]:
    """Row count and number of distinct keys; zero keys where there is no such column."""
    if df is None:
        return 0, 0
    keys = F.count_distinct(F.col(key)) if key in df.columns else F.lit(0).cast("bigint")
    return df.agg(F.count(F.lit(1)).alias("n_rows"), keys.alias("n_keys"))


def read_if_present(spark: SparkSession, path: str) -> DataFrame | None:
    """A stored table, or None where nothing is stored."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def profile(df: DataFrame, key: str | None = None) -> DataFrame:
    """``(column_name, dtype, n_rows, n_nulls, n_keys)``, one row per column, from one pass."""
    names = df.columns
    keys = F.count_distinct(F.col(key)) if key else F.lit(None).cast("bigint")
    totals = df.agg(
        F.count(F.lit(1)).alias("_rows"), keys.alias("_keys"),
        *[F.count_if(F.col(name).isNull()).alias(f"_{at}") for at, name in enumerate(names)],
    )
    types = dict(df.dtypes)
    entries = F.array(
        *[
            F.struct(F.lit(name).alias("column_name"), F.lit(types[name]).alias("dtype"), F.col(f"_{at}").alias("n_nulls"))
            for at, name in enumerate(names)
        ]
    )
    return totals.select(F.col("_rows").alias("n_rows"), F.col("_keys").alias("n_keys"), F.inline(entries))
