"""CSV tables and indexable documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions import fixed
from quern.functions.text import strip


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType | str, na_tokens: Sequence[str] = tuple(fixed.NA_TOKENS),
    multi_line: bool = True,
) -> DataFrame:
    """Headed CSV with quoted cells; the given tokens read as NULL in any column.

    A cell that does not fit its type reads as NULL.  With ``multi_line`` cells may span lines, but a file
    cannot be split, so large tables belong in many files (see :func:`write_csv`).  Without it a large
    file is read by many tasks, and every line must be a whole record.
    """
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    raw = T.StructType([T.StructField(field.name, T.StringType()) for field in schema])
    texts = (
        spark.read.schema(raw).option("header", True).option("multiLine", multi_line)
        .option("quote", '"').option("escape", '"').option("enforceSchema", False).csv(path)
    )
    cell = lambda name: F.when(~F.col(name).isin(*na_tokens), F.col(name))
    return texts.select(*[cell(field.name).try_cast(field.dataType).alias(field.name) for field in schema])


def write_csv(df: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """Flat table sink: a folder of headed CSV files."""
    (
        df.write.option("header", True).option("quote", '"').option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
        .option("maxRecordsPerFile", rows_per_file).csv(path)
    )


def require_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """Fail before any job starts when columns are missing."""
    missing = set(required).difference(df.columns)
    if missing:
        raise ValueError(f"Missing required columns: {', '.join(sorted(missing))}")
    return df


def text_documents(df: DataFrame, id_col: str = "recipe_id", text_col: str = "tfidf_text") -> DataFrame:
    """``(doc_id, text)`` to index: trimmed, without blank, NULL or literal ``nan`` texts."""
    require_columns(df, [id_col, text_col])
    trimmed = df.select(F.col(id_col).cast("bigint").alias("doc_id"), strip(F.col(text_col)).alias("text"))
    return trimmed.where((F.col("text") != "") & (F.col("text") != "nan"))
