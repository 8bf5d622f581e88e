"""Worker-side sums of query weights over postings, a bounded chunk of documents or runs at a time."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

# Postings that are laid out at once; a document or run is never cut.
CHUNK_ROWS = 1 << 20
# Rows of a batch that leaves a task, and scores that a task keeps to tell what is among the best.
OUT_ROWS, KEPT_SCORES = 1 << 17, 1 << 22
# What sums of doubles and the rounding of scores may differ by.
MARGIN = 1e-9


@dataclass(frozen=True)
class Asked:
    """The vectors of some queries: numbers of their terms and weights, query by query."""

    query_ids: pa.Array
    starts: np.ndarray
    terms: np.ndarray
    weights: np.ndarray
    n_terms: int


def asked(vectors: pa.Table, weight: str) -> tuple[Asked, pa.Array]:
    """Queries of a table ``(query_id, term, weight)``, and the terms in the order of their numbers."""
    queries = vectors["query_id"].combine_chunks().dictionary_encode(null_encoding="encode")
    terms = vectors["term"].combine_chunks().dictionary_encode()
    of = np.asarray(queries.indices, np.int64)
    order = np.argsort(of, kind="stable")
    starts = np.searchsorted(of[order], np.arange(len(queries.dictionary) + 1))
    numbers, weights = np.asarray(terms.indices, np.int64), np.asarray(vectors[weight].combine_chunks(), np.float64)
    return Asked(queries.dictionary, starts, numbers[order], weights[order], len(terms.dictionary)), terms.dictionary


def _codes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    found = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    found = found.dictionary_encode(null_encoding="encode")
    return np.asarray(found.indices, np.int64), found.dictionary


def _chunks(batches: Iterator[pa.RecordBatch], by: str) -> Iterator[pa.Table]:
    """Rows that are in order of a column, cut between its values."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += len(batch)
        if size < CHUNK_ROWS:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        codes, _ = _codes(table[by])
        other = np.flatnonzero(codes != codes[-1])
        cut = int(other[-1]) + 1 if len(other) else 0
        if cut:
            yield table.slice(0, cut)
        held = table.slice(cut).combine_chunks().to_batches()
        size = len(table) - cut
    if size:
        yield pa.Table.from_batches(held).combine_chunks()


def _totals(queries: Asked, keys: np.ndarray, n_keys: int, terms: np.ndarray, weights: np.ndarray, some: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For some queries the sum of each key."""
    order = np.argsort(terms, kind="stable")
    bounds = np.searchsorted(terms[order], np.arange(queries.n_terms + 1))
    keys, weights = keys[order], weights[order]
    for query in some.tolist():
        mine = slice(queries.starts[query], queries.starts[query + 1])
        parts = [(lo, hi, weight) for lo, hi, weight in zip(bounds[queries.terms[mine]], bounds[queries.terms[mine] + 1], queries.weights[mine]) if lo < hi]
        if parts:
            yield query, np.bincount(
                np.concatenate([keys[lo:hi] for lo, hi, _ in parts]), np.concatenate([weights[lo:hi] * weight for lo, hi, weight in parts]), n_keys
            )


class _Out:
    """Rows ``(query_id, key, value)``, gathered into batches."""

    def __init__(self, query_ids: pa.Array, names: tuple[str, str, str]) -> None:
        self.query_ids, self.names, self.held, self.size = query_ids, names, [], 0

    def add(self, query: int, keys: np.ndarray, values: np.ndarray) -> None:
        self.held.append((np.full(len(keys), query), keys, values))
        self.size += len(keys)

    def batch(self, known: pa.Array) -> pa.RecordBatch:
        queries, keys, values = (np.concatenate(part) for part in zip(*self.held))
        self.held, self.size = [], 0
        return pa.record_batch([self.query_ids.take(pa.array(queries)), known.take(pa.array(keys)), pa.array(values)], names=list(self.names))


def document_scores(batches: Iterator[pa.RecordBatch], queries: Asked, limit: int | None) -> Iterator[pa.RecordBatch]:
    """``(query_id, doc_id, score)`` of rows ``(doc_id, number, weight)`` in order of documents.

    With a limit, documents that so many others of the task surpass for sure are left out.
    """
    n = len(queries.query_ids)
    floors, track = np.zeros(n), limit is not None and n * limit <= KEPT_SCORES
    best = [np.zeros(0)] * n if track else []
    out = _Out(queries.query_ids, ("query_id", "doc_id", "score"))
    for table in _chunks(batches, "doc_id"):
        docs, known = _codes(table["doc_id"])
        for query, total in _totals(queries, docs, len(known), table["number"].to_numpy(), table["weight"].to_numpy(), np.arange(n)):
            found = np.flatnonzero((total > 0) & (total >= floors[query] - MARGIN))
            if limit is not None and len(found):
                scores = np.concatenate((best[query], total[found])) if track else total[found]
                if len(scores) > limit:
                    scores = np.partition(scores, len(scores) - limit)[len(scores) - limit:]
                if len(scores) == limit:
                    floors[query] = max(floors[query], scores.min())
                    found = found[total[found] >= floors[query] - MARGIN]
                if track:
                    best[query] = scores
            out.add(query, found, total[found])
            if out.size >= OUT_ROWS:
                yield out.batch(known)
        if out.held:
            yield out.batch(known)


def run_bounds(batches: Iterator[pa.RecordBatch], queries: Asked) -> Iterator[pa.RecordBatch]:
    """``(query_id, run, bound)`` of rows ``(run, number, weight)`` in order of runs; of a term in a run its largest weight counts."""
    out = _Out(queries.query_ids, ("query_id", "run", "bound"))
    for table in _chunks(batches, "run"):
        runs, known = _codes(table["run"])
        place = runs * queries.n_terms + table["number"].to_numpy()
        order = np.argsort(place, kind="stable")
        first = np.flatnonzero(np.concatenate(([True], np.diff(place[order]) > 0)))
        place, most = place[order][first], np.maximum.reduceat(table["weight"].to_numpy()[order], first)
        runs, terms = place // queries.n_terms, place % queries.n_terms
        for query, total in _totals(queries, runs, len(known), terms, most, np.arange(len(queries.query_ids))):
            found = np.flatnonzero(total > 0)
            out.add(query, found, total[found])
            if out.size >= OUT_ROWS:
                yield out.batch(known)
        if out.held:
            yield out.batch(known)


def scores_in_runs(batches: Iterator[pa.RecordBatch], queries: Asked, floors: np.ndarray) -> Iterator[pa.RecordBatch]:
    """``(query_id, doc_id, score)`` of rows ``(run, doc_id, number, weight)`` in order of runs.

    A row with a number ``-1 - query`` asks for the run; scores below the floor of their query are left out.
    """
    out = _Out(queries.query_ids, ("query_id", "doc_id", "score"))
    for table in _chunks(batches, "run"):
        runs, known_runs = _codes(table["run"])
        numbers = table["number"].to_numpy()
        asks = numbers < 0
        wanted = np.zeros((len(queries.query_ids), len(known_runs)), bool)
        wanted[-1 - numbers[asks], runs[asks]] = True
        rows = np.flatnonzero(~asks)
        if not len(rows):
            continue
        docs, known = _codes(table["doc_id"].take(pa.array(rows)))
        run_of = np.zeros(len(known), np.int64)
        run_of[docs] = runs[rows]
        some = np.flatnonzero(wanted.any(axis=1))
        for query, total in _totals(queries, docs, len(known), numbers[rows], table["weight"].to_numpy()[rows], some):
            found = np.flatnonzero((total > 0) & (total >= floors[query] - MARGIN) & wanted[query][run_of])
            out.add(query, found, total[found])
            if out.size >= OUT_ROWS:
                yield out.batch(known)
        if out.held:
            yield out.batch(known)
