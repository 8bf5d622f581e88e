"""The given tables, inputs derived from them, and index tables that several queries share."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.sources.tables import divided, spread

_shared: dict[tuple[str, str, str], object] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def derive(spark: SparkSession, sf_dir: str, sql: str, rows_per_task: int | None = None) -> DataFrame:
    """Run SQL in which ``{name}`` stands for a given table.  The same text serves both engines.

    ``rows_per_task`` is for steps that cost much for a row: no task then gets more rows of a table.
    """
    names = set(re.findall(r"(?<!\{)\{(\w+)\}", sql))
    tables = {name: table(spark, sf_dir, name) for name in names}
    if rows_per_task is not None:
        tables = {name: divided(df, rows_per_task) for name, df in tables.items()}
    return spark.sql(sql, **tables)


def plain(sql: str) -> str:
    """The same SQL with the table names filled in."""
    return re.sub(r"(?<!\{)\{(\w+)\}", r"\1", sql).replace("{{", "{").replace("}}", "}")


def shared(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], object]) -> object:
    """Build tables once per session and data folder; later queries read what was written."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _shared:
        _shared[key] = build()
    return _shared[key]
