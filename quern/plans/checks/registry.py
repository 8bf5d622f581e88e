"""One entry per operator: a Spark query and, where SQL can say the same, its statement."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Check:
    query: Query
    sql: str | None = None


def collect() -> dict[str, Check]:
    from quern.plans.checks import catalog, lines, normal, pages, records, search, sources, steps, suggest

    merged: dict[str, Check] = {}
    for module in (sources, pages, lines, steps, records, normal, search, suggest, catalog):
        merged.update(module.CHECKS)
    return merged
