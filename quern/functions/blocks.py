"""Worker-side comparison of blocks of sparse vectors, each block a few megabytes and a row of its own."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Vectors of a block and entries of all of them, at most; a longer vector makes a block of its own.
BLOCK_DOCS, BLOCK_ENTRIES = 1024, 1 << 20
# Meetings that are laid out at once.
MEETINGS = 1 << 21
# Added to squares of norms, so that rounding never makes a bound too small.
SLACK = 1e-12
# Lists of a block: ``sizes`` are the entries of whole vectors, ``lengths`` those that are listed in the last four.
COLUMNS = {
    "reps": "array<{kind}>", "lows": "array<double>", "sizes": "array<long>", "lengths": "array<long>", "keys": "array<long>",
    "weights": "array<double>", "starts": "array<double>", "afters": "array<double>",
}


def _lists(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The values of an array of lists, and how many each list has."""
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), kind), np.diff(np.asarray(column.offsets, np.int64))


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``(rep, keys, dfs, places, weights, low)`` as blocks of ``COLUMNS``, rarest keys of a vector first."""
    held: list[pa.RecordBatch] = []
    docs = entries = 0
    for batch in batches:
        lo = 0
        for at, size in enumerate(_lists(batch.column("keys"), np.int64)[1].tolist()):
            if docs and (docs == BLOCK_DOCS or entries + size > BLOCK_ENTRIES):
                yield _block([*held, batch.slice(lo, at - lo)])
                held, docs, entries, lo = [], 0, 0, at
            docs, entries = docs + 1, entries + size
        held.append(batch.slice(lo))
    if docs:
        yield _block(held)


def _block(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    table = pa.Table.from_batches([part for part in parts if len(part)]).combine_chunks().to_batches()[0]
    (keys, sizes), (dfs, _), (weights, _) = (_lists(table.column(name), kind) for name, kind in (("keys", np.int64), ("dfs", np.int64), ("weights", np.float64)))
    doc = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((_lists(table.column("places"), np.int64)[0], doc))
    keys, weights = keys[order], weights[order]
    squares = weights * weights
    upto = np.cumsum(squares)
    behind = np.maximum(upto[np.cumsum(sizes) - 1][doc] - upto, 0.0) if len(keys) else squares
    # A key of one document counts in the norms, and meets nobody.
    met = np.flatnonzero(dfs[order] > 1)
    made = {
        "reps": table.column("rep"), "lows": table.column("low"), "sizes": sizes, "lengths": np.bincount(doc[met], minlength=len(sizes)),
        "keys": keys[met], "weights": weights[met], "starts": np.sqrt(behind + squares + SLACK)[met], "afters": np.sqrt(behind + SLACK)[met],
    }
    return pa.record_batch({name: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values)) for name, values in made.items()})


class _Vectors:
    """Entries of a block whose keys another block has, too, in order of vectors; sizes are those of the whole vectors."""

    def __init__(self, block: dict[str, np.ndarray], common: np.ndarray) -> None:
        self.sizes, doc = block["sizes"], np.repeat(np.arange(len(block["sizes"])), block["lengths"])
        local = np.searchsorted(common, block["keys"])
        chosen = np.flatnonzero(common[np.minimum(local, len(common) - 1)] == block["keys"]) if len(common) else np.zeros(0, np.int64)
        self.keys, self.doc = local[chosen], doc[chosen]
        self.weights, self.start, self.after = (block[name][chosen] for name in ("weights", "starts", "afters"))
        self.ends = np.cumsum(np.bincount(self.doc, minlength=len(self.sizes)))
        # A key that a vector has twice counts by its first entry where it is looked up.
        self.again = np.zeros(len(self.keys), bool)
        self.again[1:] = (self.keys[1:] == self.keys[:-1]) & (self.doc[1:] == self.doc[:-1])


def compare(batches: Iterator[pa.RecordBatch], share: float) -> Iterator[pa.RecordBatch]:
    """Pairs ``(rep, other, score)`` of two blocks that may reach the ``low`` of ``rep``, and a row that counts meetings and comparisons.

    Two vectors meet in a common key where the product of their norms from there on reaches ``share`` of ``low``. Those that
    meet are bounded by the sum so far and the norms that are left, and what passes is compared in full.
    """
    for batch in batches:
        for at in range(len(batch)):
            yield from _compare_two(batch.slice(at, 1), share)


def _compare_two(row: pa.RecordBatch, share: float) -> Iterator[pa.RecordBatch]:
    column = {name: row.column(name).flatten() for name in row.schema.names}
    array = {name: column[name].to_numpy(zero_copy_only=False) for name in column if name not in ("reps", "other_reps")}
    other = {name: array[f"other_{name}"] for name in COLUMNS if name not in ("reps", "lows")}
    common, others = np.unique(array["keys"]), np.unique(other["keys"])
    if len(common) and len(others):
        common = common[others[np.minimum(np.searchsorted(others, common), len(others) - 1)] == common]
    else:
        common = common[:0]
    a, b, low = _Vectors(array, common), _Vectors(other, common), array["lows"].astype(np.float64)
    itself = column["reps"].equals(column["other_reps"])
    # Entries of the other side by key, largest norm first: what an entry meets is the beginning of its key's part.
    place = b.keys * 4.0 + (1.0 - b.start)
    order = np.argsort(place, kind="stable")
    place = place[order]
    asked = low[a.doc]
    least = np.clip(np.where(np.isnan(asked), 2.0, asked * share / a.start), -1.0, 2.0)
    begin = np.searchsorted(place, a.keys * 4.0 - 0.5)
    counts = np.maximum(np.searchsorted(place, a.keys * 4.0 + (1.0 - least) + 1e-8, "right") - begin, 0)
    counts[np.isnan(asked)] = 0
    total = np.concatenate(([0], np.cumsum(counts)))
    first, n_b, lo, met, compared = np.concatenate(([0], a.ends)), len(b.sizes), 0, 0, 0
    while lo < len(a.sizes):
        # As many vectors as meet few enough others.
        hi = max(lo + 1, int(np.searchsorted(total[first], total[first[lo]] + MEETINGS, "right")) - 1)
        p, q = first[lo], first[hi]
        n = counts[p:q]
        mine = np.repeat(np.arange(p, q), n)
        theirs = order[np.repeat(begin[p:q] - (total[p:q] - total[p]), n) + np.arange(len(mine))]
        cell = (a.doc[mine] - lo) * n_b + b.doc[theirs]
        if itself:
            apart = a.doc[mine] != b.doc[theirs]
            mine, theirs, cell = mine[apart], theirs[apart], cell[apart]
        met += len(cell)
        part = np.bincount(cell, a.weights[mine] * b.weights[theirs], (hi - lo) * n_b)
        # Entries are in order, so a pair's first meeting has the largest reach, and behind the last the norms are left.
        reach, rest = np.full(len(part), -1.0), np.zeros(len(part))
        reach[cell[::-1]] = (a.start[mine] * b.start[theirs])[::-1]
        rest[cell] = a.after[mine] * b.after[theirs]
        bound = np.repeat(low[lo:hi], n_b)
        close = np.flatnonzero((reach >= 0) & (reach >= bound) & (part + rest >= bound))
        compared += len(close)
        if len(close):
            left, right = close // n_b + lo, close % n_b
            score = _dots(a, b, len(common), left, right)
            kept = np.flatnonzero(score > 0)
            yield pa.record_batch({
                "rep": column["reps"].take(pa.array(left[kept])), "other": column["other_reps"].take(pa.array(right[kept])),
                "score": pa.array(score[kept]), "met": pa.nulls(len(kept), pa.int64()), "compared": pa.nulls(len(kept), pa.int64()),
            })
        lo = hi
    kind = column["reps"].type
    yield pa.record_batch({
        "rep": pa.nulls(1, kind), "other": pa.nulls(1, kind), "score": pa.nulls(1, pa.float64()),
        "met": pa.array([met], pa.int64()), "compared": pa.array([compared], pa.int64()),
    })


def _dots(a: _Vectors, b: _Vectors, n_keys: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products of pairs in order of ``left``; each key of the shorter vector is looked up in the longer one."""
    out = np.zeros(len(left))
    starts, sizes = np.concatenate(([0], b.ends[:-1])), np.diff(np.concatenate(([0], b.ends)))
    firsts = np.concatenate(([0], a.ends))
    repeated = bool(a.again.any() or b.again.any())
    once = np.where(b.again, 0.0, b.weights)
    sums, looked = np.zeros(n_keys), np.zeros(n_keys)
    cuts = np.concatenate(([0], np.flatnonzero(left[1:] != left[:-1]) + 1, [len(left)]))
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        entries = slice(firsts[left[lo]], firsts[left[lo] + 1])
        keys, weights = a.keys[entries], a.weights[entries]
        sums[keys] = 0.0
        np.add.at(sums, keys, weights)
        others = right[lo:hi]
        n = sizes[others]
        edges = np.concatenate(([0], np.cumsum(n)))
        at = np.repeat(starts[others] - edges[:-1], n) + np.arange(edges[-1])
        of = np.repeat(np.arange(len(others)), n)
        found = np.bincount(of, once[at] * sums[b.keys[at]], len(others))
        if repeated:
            fresh = ~a.again[entries]
            looked[keys[fresh]] = weights[fresh]
            longer = a.sizes[left[lo]] > b.sizes[others]
            found = np.where(longer, np.bincount(of, b.weights[at] * looked[b.keys[at]], len(others)), found)
            looked[keys] = 0.0
        out[lo:hi] = found
        sums[keys] = 0.0
    return out
