"""Bounded, repeatable samples of labelled rows for fitting small models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def share_of(key: Column) -> Column:
    """A number in [0, 1) that depends on the key alone."""
    return F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))


def per_class(rows: DataFrame, key: str, label: str, about: int) -> tuple[DataFrame, dict]:
    """About ``about`` rows of every value of ``label`` (all, if there are fewer), and the number of rows of each.

    One narrow count, then a filter on a hash of the key; no row is moved.
    """
    counts = {row[0]: row[1] for row in rows.groupBy(label).count().collect()}
    kept = [
        F.col(label).eqNullSafe(F.lit(value)) & (share_of(F.col(key)) < F.lit(about / n)) if n > about else F.col(label).eqNullSafe(F.lit(value))
        for value, n in counts.items()
    ]
    wanted = F.lit(False)
    for condition in kept:
        wanted = wanted | condition
    return rows.where(wanted), counts
