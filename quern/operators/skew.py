"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.sources.tables import store

# A key with this many rows is hot, however large the table is; only so many keys are treated as hot.
MIN_HOT_ROWS = 1_000_000
HOT_KEYS = 10_000
# Largest side that may be broadcast after it has been measured, in rows and in bytes of JSON.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 * 1024 * 1024
# Largest table, in rows, that may pass through the driver as a query batch.
LOCAL_ROWS = 20_000
# A filter of keys has so many bits for each, and at most 2 ** FILTER_BITS (32 MB); beyond that more keys pass it.
BITS_FOR_EACH = 16
FILTER_BITS = 28


def at_most(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has no more than ``rows`` rows; reads no further than it must."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint only after rows and bytes proved the bound; otherwise the planner shuffles."""
    width = F.length(F.to_json(F.struct(*df.columns))).alias("width")
    found = df.limit(rows + 1).select(width).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("width"), F.lit(0)).alias("bytes")).first()
    return F.broadcast(df) if found.n <= rows and found.bytes <= size else df


def settle(df: DataFrame, name: str, few: bool = False) -> tuple[DataFrame, pa.Table | None]:
    """Compute a query-sided table once, for the several steps that read it.

    A small one becomes literal rows of the plan and its rows are returned, too; a larger one is written.
    ``few`` says that the batch is small for sure, which saves writing it first.
    """
    if not few:
        df = store(df, name)
    found = df.limit(LOCAL_ROWS + 1).toArrow()
    if found.num_rows <= LOCAL_ROWS and found.nbytes <= BROADCAST_BYTES:
        return F.broadcast(df.sparkSession.createDataFrame(found, df.schema)), found
    return broadcast_if_small(store(df, name) if few else df), None


def hot_keys(facts: DataFrame, keys: Sequence[str], min_hot_rows: int = MIN_HOT_ROWS) -> DataFrame:
    """The most frequent keys with at least ``min_hot_rows`` rows, no more than ``HOT_KEYS`` of them."""
    counted = facts.dropna(subset=list(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= min_hot_rows).orderBy(F.desc("n"), *keys).limit(HOT_KEYS).select(*keys)


def lookup_join(
    facts: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    min_hot_rows: int = MIN_HOT_ROWS,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Join ``facts``, possibly skewed on ``keys``, with ``lookup``, which is unique on ``keys``.

    Hot keys are few by construction, so their lookup rows are broadcast and the hot fact rows never move;
    the other keys go through an ordinary shuffle join.  ``how`` is ``inner``, ``left``, ``left_semi`` or
    ``left_anti``.  ``facts`` is read twice or three times, so it should be a stored table; ``hot`` saves the
    first time.
    """
    keys = list(keys)
    hot = store(hot_keys(facts, keys, min_hot_rows) if hot is None else hot.select(*keys), "hot-keys")
    if hot.isEmpty():
        return facts.join(lookup, keys, how)
    hot = F.broadcast(hot)
    keyed = facts.dropna(subset=keys)
    hot_lookup = F.broadcast(lookup.join(hot, keys, "left_semi"))
    result = (
        keyed.join(hot, keys, "left_semi").join(hot_lookup, keys, how)
        .unionByName(keyed.join(hot, keys, "left_anti").join(lookup, keys, how))
    )
    if how in ("left", "left_anti"):
        # NULL keys match nothing; keeping them out of the shuffle spares one overfull task.
        missing = facts.where(" OR ".join(f"`{key}` IS NULL" for key in keys))
        result = result.unionByName(missing, allowMissingColumns=True)
    return result


def may_hold(rows: DataFrame, keys: DataFrame, columns: Sequence[str]) -> Column:
    """Whether the key of a row may be among ``keys``; false for sure where it is false.

    The filter is put together in pieces of four kilobytes on the executors and sent to all tasks; ``keys`` is read
    twice, so it should be a stored table.
    """
    bits = 1 << min(FILTER_BITS, max(15, (keys.count() * BITS_FOR_EACH - 1).bit_length()))
    place = F.pmod(F.xxhash64(*columns), F.lit(bits)) + 1
    filled = keys.select(F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("position"))
    filled = filled.groupBy("bucket").agg(F.bitmap_construct_agg("position").alias("bits")).toArrow()
    table = np.zeros(bits >> 3, np.uint8)
    for bucket, part in zip(filled["bucket"].to_pylist(), filled["bits"].to_pylist(), strict=True):
        table[(bucket - 1) * 4096:bucket * 4096] = np.frombuffer(part, np.uint8)
    shared = rows.sparkSession.sparkContext.broadcast(table)

    def held(places: pa.Array) -> pa.Array:
        at = places.to_numpy(zero_copy_only=False)
        return pa.array((shared.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool))

    return F.arrow_udf(held, T.BooleanType())(F.pmod(F.xxhash64(*columns), F.lit(bits)))
