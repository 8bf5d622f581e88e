"""Vectorised work on the UTF-8 bytes of whole Arrow columns: words, word hashes, shingles, sets.

White space and A-Z are single bytes in UTF-8, so words can be cut and lower-cased on the bytes themselves.
Texts are handled in runs of whole documents (``runs``), so that working arrays stay near a fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Bytes of text handled at once; a longer document makes a run of its own.
RUN_BYTES = 1 << 20
# Documents handled at once, however short they are.
RUN_ROWS = 2048

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
# Bytes that are in no term: everything in ASCII but letters and digits.
NO_TERM = np.ones(256, dtype=bool)
NO_TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each row begins and ends in them; NULL counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    if not offsets[-1]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def runs(offsets: np.ndarray, limit: int = RUN_BYTES) -> Iterator[tuple[int, int]]:
    """At most ``RUN_ROWS`` consecutive documents whose bytes stay under ``limit`` together."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, min(lo + RUN_ROWS, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1))
        yield lo, hi
        lo = hi


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values in place (the finaliser of MurmurHash3)."""
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def words(data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every run of bytes outside ``gaps`` (white space), and the document it stands in."""
    inside = ~gaps[data]
    bounds = offsets[:-1][np.diff(offsets) > 0]
    before = np.empty_like(inside)
    before[1:] = inside[:-1]
    before[bounds] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[:-1] = inside[1:]
    after[offsets[1:][np.diff(offsets) > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(
    data: np.ndarray, offsets: np.ndarray, lower: bool = True, gaps: np.ndarray = _SPACE
) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word (A-Z lowered) and the document it stands in.

    A word's hash is the sum of a scrambled value for every (place in the word, byte).
    """
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    starts, ends, doc = words(data, offsets, gaps)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    place = np.arange(len(data), dtype=np.int64)
    place[starts[0]:] -= np.repeat(starts, np.diff(np.append(starts, len(data))))
    code = place.astype(np.uint64)
    code <<= np.uint64(8)
    code |= (_LOWER[data] if lower else data).astype(np.uint64)
    code += np.uint64(1)
    code *= _SPREAD
    mix(code)
    code[gaps[data]] = 0
    return mix(np.add.reduceat(code, starts)), doc


def shingles(hashes: np.ndarray, doc: np.ndarray, n_docs: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words in a document; a shorter document is one run of all its words."""
    counts = np.bincount(doc, minlength=n_docs)
    first = np.concatenate(([0], np.cumsum(counts)))[:-1]
    out, owner = [], []
    for width in range(1, size + 1):
        if width < size:
            at = first[counts == width]
        else:
            last = len(hashes) - size + 1
            at = np.flatnonzero(doc[: max(last, 0)] == doc[size - 1:]) if last > 0 else np.zeros(0, np.int64)
        if not len(at):
            continue
        h = mix(hashes[at] + np.uint64(width))
        for k in range(1, width):
            h += hashes[at + k] * _SPREAD
            mix(h)
        out.append(h)
        owner.append(doc[at])
    if not out:
        return np.zeros(0, np.uint64), np.zeros(n_docs + 1, np.int64)
    h, owner = np.concatenate(out), np.concatenate(owner)
    if len(out) > 1:
        order = np.argsort(owner, kind="stable")
        h, owner = h[order], owner[order]
    return h, np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=n_docs))))


def distinct(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct values of every document."""
    if not len(values):
        return values, bounds
    values = values.copy()
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if hi - lo > 1:
            values[lo:hi].sort()
    keep = np.ones(len(values), dtype=bool)
    keep[1:] = values[1:] != values[:-1]
    keep[bounds[:-1][np.diff(bounds) > 0]] = True
    kept = np.concatenate(([0], np.cumsum(keep)))
    return values[keep], kept[bounds]


def owners(bounds: np.ndarray) -> np.ndarray:
    """The document of every value that ``bounds`` deals out."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
