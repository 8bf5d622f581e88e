"""Best-fit packing of documents into bins of a fixed number of tokens, with conflicts.

No bin holds two pieces of one duplicate cluster, nor two of one source.  Clusters of texts are the near-duplicate
groups of ``neardup`` at 5 words and similarity 0.8, exact copies included.  Documents longer than a bin are cut into
consecutive pieces, so that every token of every document is in exactly one place.

The table is dealt into shards of about ``shard_rows`` pieces by a hash, which spreads hot sources and clusters
evenly; each shard is packed by one task.  Pieces go by size, largest first.  Bins stand in order of what is left in
them and carry the bits of the sources and clusters they hold; the search starts at the smallest rest that is large
enough and goes to its successors until a bin has neither bit.  If none has, a new bin is opened.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm import neardup
from quern.sources.tables import store


@dataclass(frozen=True)
class Plan:
    capacity: int = 2048
    shard_rows: int = 4096


def n_words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; 0 for NULL."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]++"), 0)), F.lit(0)).cast("long")


def normal_key(text: Column) -> Column:
    """Equal for texts that differ in case and white space only."""
    return F.xxhash64(F.regexp_replace(F.lower(text), r"[\x20\x09-\x0D]+", " "))


def best_fit(sizes: np.ndarray, groups: list[np.ndarray], capacity: int) -> np.ndarray:
    """The bin of every piece.  ``groups`` holds one array of codes for each kind of conflict; -1 conflicts with nothing."""
    bins = np.zeros(len(sizes), np.int64)
    order = np.lexsort((np.arange(len(sizes)), -sizes))
    rests: list[tuple[int, int]] = []  # (tokens left, bin), ascending
    held: list[tuple[int, ...]] = []  # bitmaps by bin
    columns = [codes.tolist() for codes in groups]
    for at in order.tolist():
        size = int(sizes[at])
        bits = tuple(1 << codes[at] if codes[at] >= 0 else 0 for codes in columns)
        spot = bisect_left(rests, (size, -1))
        while spot < len(rests) and any(mine & theirs for mine, theirs in zip(bits, held[rests[spot][1]], strict=True)):
            spot += 1
        if spot < len(rests):
            rest, chosen = rests.pop(spot)
            held[chosen] = tuple(mine | theirs for mine, theirs in zip(bits, held[chosen], strict=True))
        else:
            rest, chosen = capacity, len(held)
            held.append(bits)
        bins[at] = chosen
        if rest > size:
            left = (rest - size, chosen)
            rests.insert(bisect_left(rests, left), left)
    return bins


def pieces(docs: DataFrame, id_col: str, size: Column, source: Column, cluster: Column, capacity: int) -> DataFrame:
    """``(id, piece, start, n_tokens, source, cluster)``, one row for each piece of at most ``capacity`` tokens."""
    rows = docs.select(F.col(id_col).alias("id"), size.cast("long").alias("size"), source.cast("string").alias("source"), cluster.alias("cluster"))
    last = F.greatest(F.ceil(F.col("size") / capacity) - 1, F.lit(0)).cast("long")
    return rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece")).select(
        "id", "piece", (F.col("piece") * capacity).alias("start"),
        F.least(F.lit(capacity).cast("long"), F.col("size") - F.col("piece") * capacity).alias("n_tokens"), "source", "cluster",
    )


def pack(docs: DataFrame, id_col: str, size: Column, source: Column, cluster: Column, plan: Plan = Plan()) -> DataFrame:
    """``(bin_id, id, piece, start, n_tokens, free)`` for every piece; ``free`` is what its bin has left in the end.

    Rows without tokens (NULL size included) need no place and keep a NULL bin.  A NULL source or cluster conflicts
    with nothing.  Repeated rows are pieces of their own; an empty table gives an empty table.  Ties in size go to the
    smaller id, then to the order of the other columns, so the result is the same whatever the partitioning is.
    """
    rows = pieces(docs, id_col, size, source, cluster, plan.capacity)
    n_shards = max(1, -(-rows.count() // plan.shard_rows))
    shard = F.pmod(F.xxhash64("id", "piece"), F.lit(n_shards))
    capacity = plan.capacity

    def packed(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([(name, "ascending") for name in ("id", "piece", "n_tokens", "source", "cluster")])
        groups = []
        for name in ("source", "cluster"):
            column = table[name].combine_chunks()
            codes = column.dictionary_encode().indices
            groups.append(np.asarray(codes.fill_null(-1)).astype(np.int64))
        sizes = table["n_tokens"].to_numpy()
        bins = best_fit(sizes, groups, capacity)
        free = capacity - np.bincount(bins, weights=sizes, minlength=1).astype(np.int64)
        return pa.table({
            "bin_id": pa.array((key[0].as_py() << 32) + bins, pa.int64()), "id": table["id"], "piece": table["piece"],
            "start": table["start"], "n_tokens": table["n_tokens"], "free": pa.array(free[bins]),
        })

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"bin_id long, id {kind}, piece long, start long, n_tokens long, free long"
    full = rows.where("n_tokens > 0").withColumn("shard", shard)
    placed = full.groupBy("shard").applyInArrow(packed, schema)
    empty = rows.where("coalesce(n_tokens, 0) <= 0").select(
        F.lit(None).cast("long").alias("bin_id"), "id", "piece", "start", F.lit(0).cast("long").alias("n_tokens"), F.lit(None).cast("long").alias("free")
    )
    return placed.unionByName(empty)


def pack_texts(docs: DataFrame, id_col: str, text_col: str, source_col: str, plan: Plan = Plan()) -> DataFrame:
    """``pack`` of texts by words; a cluster is a near-duplicate group, with case levelled.

    Rows without an id belong to the group of their text; rows that repeat an id are in one cluster.
    """
    text = F.col(text_col)
    kind = "long" if docs.schema[id_col].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint") else "string"
    key = F.coalesce(F.col(id_col).cast(kind), F.xxhash64(text).cast(kind))
    rows = docs.select(
        F.col(id_col).alias("id"), key.alias("key"), n_words(text).alias("size"), F.col(source_col).alias("source")
    )
    texts = docs.select(F.col(id_col).alias("id"), key.alias("key"), F.lower(text).alias("text"))
    # Copies without an id have one key, and are looked at once.
    unnamed = texts.where("id IS NULL AND text IS NOT NULL").dropDuplicates(["key"])
    found = neardup.groups(
        texts.where("id IS NOT NULL").unionByName(unnamed).select("key", "text"), "key", "text", neardup.Sketch(words=5, percent=80)
    )
    clusters = found.groupBy("id").agg(F.min("component_id").alias("cluster")).withColumnRenamed("id", "key")
    rows = store(rows.join(clusters, "key", "left"), "to-pack")
    return pack(rows, "id", F.col("size"), F.col("source"), F.col("cluster"), plan)
