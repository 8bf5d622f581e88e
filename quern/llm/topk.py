"""Exact top-k inner products by columnar branch and bound.

Vectors become whole numbers and are dealt into blocks in vertical layout, one row of a matrix for each dimension.
Blocks of queries meet blocks of candidates pair by pair.  For one query the scores of all candidates of a block are
accumulated over a few dimensions at a time; what the remaining dimensions can still add is at most the product of
the remaining masses (Euclidean norms), so candidates that cannot reach the k-th best known score are compacted away.
The k-th best score starts from the full scores of the leaders after the first dimensions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.sources.tables import spread, store


@dataclass(frozen=True)
class Plan:
    k: int = 5
    scale: int = 256
    query_rows: int = 1024
    candidate_rows: int = 4096
    step: int = 16


BLOCK = "block int, kind string, n_dims int, ids binary, cells binary"
_LIMIT = float(1 << 53)


def usable(vector: Column) -> Column:
    """Neither NULL nor holding NULL, NaN or an infinity."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))


def _pack(key: tuple, table: pa.Table) -> pa.Table:
    """One block: distinct (id, vector) rows, shorter vectors padded with zeros."""
    rows = sorted({(i, tuple(v)) for i, v in zip(table["id"].to_pylist(), table["cells"].to_pylist(), strict=True)})
    n_dims = max(len(v) for _, v in rows)
    matrix = np.zeros((n_dims, len(rows)))
    for at, (_, vector) in enumerate(rows):
        matrix[:len(vector), at] = vector
    matrix = np.floor(matrix)
    top = np.abs(matrix).max(initial=0)
    kind = "<i2" if top < 1 << 15 else "<i4" if top < 1 << 31 else "<f8"
    return pa.table({
        "block": pa.array([key[0].as_py()], pa.int32()), "kind": [kind], "n_dims": pa.array([n_dims], pa.int32()),
        "ids": pa.array([np.array([i for i, _ in rows], np.int64).tobytes()], pa.binary()),
        "cells": pa.array([matrix.astype(kind).tobytes()], pa.binary()),
    })


def blocks(rows: DataFrame, size: int, name: str) -> DataFrame:
    """Deal ``(id, cells)`` by a hash of the id into blocks of about ``size`` rows."""
    n = max(1, -(-rows.count() // size))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id", F.lit("block")), F.lit(n)).cast("int"))
    return store(dealt.groupBy("block").applyInArrow(_pack, BLOCK), name)


def _open(kind: str, n_dims: int, ids: bytes, cells: bytes) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids, np.int64)
    return ids, np.frombuffer(cells, kind).reshape(n_dims, len(ids)).astype(np.float64)


def _fit(matrix: np.ndarray, n_dims: int) -> np.ndarray:
    return np.concatenate((matrix, np.zeros((n_dims - len(matrix), matrix.shape[1])))) if len(matrix) < n_dims else matrix


def _first(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, ties to the smaller id, every id once."""
    order = np.lexsort((ids, -scores))
    if len(np.unique(ids)) < len(ids):
        order = order[np.sort(np.unique(ids[order], return_index=True)[1])]
    return order[:k]


def search(query: np.ndarray, own: int, ids: np.ndarray, cells: np.ndarray, rest: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the best candidates of a block for one query.

    ``rest[s]`` holds each candidate's norm over the dimensions from ``s * step`` on.
    """
    alive = np.flatnonzero(ids != own)
    if not len(alive):
        return ids[:0], np.zeros(0)
    mass = np.sqrt(np.append(np.cumsum(query[::-1] ** 2)[::-1], 0.0))
    scores, floor = np.zeros(len(alive)), -np.inf
    for turn, lo in enumerate(range(0, len(query), plan.step)):
        hi = min(lo + plan.step, len(query))
        part = cells[lo:hi] if len(alive) == cells.shape[1] else cells[lo:hi, alive]
        scores = scores + query[lo:hi] @ part
        if hi == len(query):
            break
        if turn == 0:
            # The k-th best full score of the leaders, every id once, is a score that the answer reaches.
            leaders = _first(scores, ids[alive], plan.k)
            if len(leaders) == plan.k:
                floor = np.sort(scores[leaders] + query[hi:] @ cells[hi:, alive[leaders]])[0]
        most = scores + mass[hi] * rest[turn + 1][alive]
        stay = most * (1 + 1e-9) + 1 >= floor if floor >= 0 else most + 1 + 1e-9 * np.abs(most) >= floor
        if not stay.all():
            alive, scores = alive[stay], scores[stay]
    best = _first(scores, ids[alive], plan.k)
    return ids[alive][best], scores[best]


def _exact(query: np.ndarray, own: int, ids: np.ndarray, cells: np.ndarray, plan: Plan) -> tuple[np.ndarray, list[int]]:
    """The same without bounds, in whole numbers of any size, for values beyond what doubles hold exactly."""
    whole = [int(x) for x in query]
    found = {}
    for at in np.flatnonzero(ids != own).tolist():
        score = sum(a * int(b) for a, b in zip(whole, cells[:, at].tolist(), strict=True))
        score = min(max(score, -(1 << 63)), (1 << 63) - 1)
        found[int(ids[at])] = max(score, found.get(int(ids[at]), score))
    best = sorted(found.items(), key=lambda item: (-item[1], item[0]))[:plan.k]
    return np.array([i for i, _ in best], np.int64), [s for _, s in best]


def _pairs(batches: Iterator[pa.RecordBatch], plan: Plan) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            query_ids, queries = _open(row["q_kind"], row["q_n_dims"], row["q_ids"], row["q_cells"])
            ids, cells = _open(row["kind"], row["n_dims"], row["ids"], row["cells"])
            n_dims = max(len(queries), len(cells))
            queries, cells = _fit(queries, n_dims), _fit(cells, n_dims)
            starts = range(0, n_dims, plan.step)
            tail = np.cumsum((cells ** 2)[::-1], axis=0)[::-1]
            rest = [np.sqrt(tail[lo]) for lo in starts]
            safe = n_dims * np.abs(queries).max(initial=0) * np.abs(cells).max(initial=0) < _LIMIT
            out: tuple[list, list, list] = ([], [], [])
            for at, own in enumerate(query_ids.tolist()):
                query = np.ascontiguousarray(queries[:, at])
                found, scores = search(query, own, ids, cells, rest, plan) if safe else _exact(query, own, ids, cells, plan)
                out[0].extend([own] * len(found))
                out[1].extend(found.tolist())
                out[2].extend(int(s) for s in scores)
            yield pa.record_batch({n: pa.array(v, pa.int64()) for n, v in zip(("query_id", "vec_id", "score"), out, strict=True)})


def top_k(vectors: DataFrame, id_col: str, vector_col: str, is_query: Column, plan: Plan = Plan()) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for every row that ``is_query`` marks its k best other rows.

    Components count as ``floor(scale * x)``; shorter vectors are padded with zeros.  Rows whose id is NULL, and
    vectors that are NULL or hold NULL or a non-finite number, take no part.  Ties go to the smaller id.  Rows that
    repeat an id are never candidates for it; if its vectors differ, a pair scores its highest.  Scores beyond 64
    bits count as the largest or smallest number of 64 bits.  A query without candidates has no rows.
    """
    # Rounded down in the packing, where the result may be any double.
    scaled = F.transform(F.col(vector_col), lambda x: x.cast("double") * float(plan.scale))
    rows = vectors.where(F.col(id_col).isNotNull() & usable(F.col(vector_col)))
    rows = rows.select(F.col(id_col).cast("long").alias("id"), scaled.alias("cells"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    candidates = blocks(rows.select("id", "cells"), plan.candidate_rows, "candidates")
    queries = blocks(rows.where("asks").select("id", "cells"), plan.query_rows, "queries")
    # Every block of candidates meets every block of queries where it is; tasks read the queries, and no copy is made of either.
    asked = queries.select(*(F.col(c).alias(f"q_{c}") for c in queries.columns if c != "block"))
    both = spread(candidates.drop("block")).hint("shuffle_replicate_nl").crossJoin(asked)
    best = both.mapInArrow(lambda batches: _pairs(batches, plan), "query_id long, vec_id long, score long")
    best = best.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= plan.k).select("query_id", "rank", "vec_id", "score")
