"""I-Match fingerprints: terms within a band of inverse document frequency, hashed in several randomised lexicons.

The lexicon holds the terms whose ``ln(N / df)`` over all documents lies in the band.  The fingerprint of a text has
one slot for each random subset of the lexicon; a slot is the hash of the text's sorted distinct terms in that subset.
Subsets come at several densities: of a text with many terms the dense ones agree only if it is almost equal, the
thin ones still agree by the share of terms in common; short texts fill the dense ones only.  A last field hashes all lexicon terms of the text (of a text without any, its bytes).

The band bounds the lexicon: a text's distinct terms add one to as many document frequencies, so at most
``mean distinct terms * exp(max_idf)`` terms can have a frequency of ``N / exp(max_idf)``, however large the corpus is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import flat

# Distinct terms a task gathers before it hands its counts on.
HELD_TERMS = 1 << 19


@dataclass(frozen=True)
class Plan:
    min_idf: float = 1.5
    max_idf: float = 7.5
    # One subset in so many terms, and how many disjoint subsets of each kind.
    thinness: tuple[int, ...] = (16, 64, 256, 1024, 4096)
    subsets: int = 16

    @property
    def slots(self) -> int:
        return self.subsets * len(self.thinness)


def terms_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct term hashes of every text; a term is a run of letters and digits (all of them beyond ASCII), A-Z lowered."""
    hashes, doc = flat.word_hashes(data, offsets, gaps=flat.NO_TERM)
    return flat.distinct(hashes, np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=len(offsets) - 1)))))


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        terms, at = np.unique(np.concatenate([t for t, _ in held]), return_inverse=True)
        return terms, np.bincount(at, weights=np.concatenate([n for _, n in held])).astype(np.int64)

    def out(terms: np.ndarray, docs: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch({"term": pa.array(terms.view(np.int64)), "docs": pa.array(docs)})

    for batch in batches:
        data, offsets = flat.utf8(batch.column(0))
        for lo, hi in flat.runs(offsets):
            terms, docs = np.unique(terms_of(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])[0], return_counts=True)
            held.append((terms, docs))
            size += len(terms)
            if size > HELD_TERMS:
                held[:] = [merged()]
                size = len(held[0][0])
                if size > HELD_TERMS // 2:
                    yield out(*held.pop())
                    size = 0
    if held:
        yield out(*merged())


def lexicon(docs: DataFrame, text_col: str, plan: Plan = Plan()) -> np.ndarray:
    """Sorted hashes of the terms in the band, counted over all documents (NULL texts count as empty documents)."""
    n = docs.count()
    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(_count_batches, "term long, docs long")
    counted = counted.groupBy("term").agg(F.sum("docs").alias("docs"))
    low, high = n * float(np.exp(-plan.max_idf)), n * float(np.exp(-plan.min_idf))
    found = counted.where(F.col("docs").between(F.lit(low), F.lit(high))).select("term").toArrow()
    return np.sort(found["term"].to_numpy().view(np.uint64))


def fingerprints(data: np.ndarray, offsets: np.ndarray, terms: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """Slots (0: no term in the subset) and the last field of every text."""
    values, bounds = terms_of(data, offsets)
    if len(terms):
        at = np.minimum(np.searchsorted(terms, values), len(terms) - 1)
        known = terms[at] == values
    else:
        known = np.zeros(len(values), dtype=bool)
    kept = np.concatenate(([0], np.cumsum(known)))
    values, bounds = values[known], kept[bounds]
    n = len(offsets) - 1
    sums, owner = np.zeros(n * plan.slots, np.uint64), flat.owners(bounds)
    for level, thin in enumerate(plan.thinness):
        h = flat.mix(values ^ np.uint64((level + 1) * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF))
        subset = (h >> np.uint64(32)) * np.uint64(thin) >> np.uint64(32)
        inside = np.flatnonzero(subset < np.uint64(plan.subsets))
        place = owner[inside] * plan.slots + level * plan.subsets + subset[inside].astype(np.int64)
        np.add.at(sums, place, flat.mix(h[inside] + np.uint64(1)))
    slots = np.where(sums != 0, np.maximum(flat.mix(sums.copy()) >> np.uint64(48), np.uint64(1)), np.uint64(0))
    slots = slots.astype(np.uint16).reshape(n, plan.slots)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(flat.mix(values + np.uint64(1)), dtype=np.uint64)))
    last = flat.mix(total[bounds[1:]] - total[bounds[:-1]] + np.uint64(1))
    for at in np.flatnonzero(bounds[1:] == bounds[:-1]).tolist():
        last[at] = int.from_bytes(hashlib.blake2b(data[offsets[at]:offsets[at + 1]].tobytes(), digest_size=8).digest(), "big")
    return slots, last


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Share of equal slots among those that are filled on either side; 1 for equal last fields."""
    filled = (a[0] != 0) | (b[0] != 0)
    equal = ((a[0] == b[0]) & filled).sum(axis=1)
    return np.where(a[1] == b[1], 1.0, equal / np.maximum(filled.sum(axis=1), 1))


def _text(slots: np.ndarray, last: np.ndarray) -> list[str]:
    return [row.tobytes().hex() + f"{tail:016x}" for row, tail in zip(slots.astype(">u2"), last.tolist(), strict=True)]


def _fingerprint_column(texts: list[str], terms: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = flat.utf8(pa.array(texts, pa.large_string()))
    found = [fingerprints(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], terms, plan) for lo, hi in flat.runs(offsets)]
    return np.concatenate([slots for slots, _ in found]), np.concatenate([last for _, last in found])


def fingerprint(docs: DataFrame, id_col: str, text_col: str, terms: np.ndarray, plan: Plan = Plan()) -> DataFrame:
    """``(id, fingerprint)`` of every whole text; NULL counts as empty."""
    shipped = docs.sparkSession.sparkContext.broadcast(terms)
    kind = docs.schema[id_col].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                found = _fingerprint_column(batch.column(1).fill_null("").to_pylist(), shipped.value, plan)
                yield pa.record_batch({"id": batch.column(0), "fingerprint": pa.array(_text(*found))})

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(rows, f"id {kind}, fingerprint string")


def _edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def _compare(batches: Iterator[pa.RecordBatch], shipped, plan: Plan) -> Iterator[pa.RecordBatch]:
    """Rows come bucket by bucket in order; the row after a bucket's last own row is a copy of the next bucket's first."""
    waiting: tuple | None = None
    for batch in batches:
        for lo in range(0, len(batch), 256):
            part = batch.slice(lo, 256).to_pydict()
            rows = list(zip(part["bucket"], part["copy"], part["id"], part["text"], strict=True))
            if waiting is not None:
                rows.insert(0, waiting)
            waiting = rows[-1]
            pairs = [(a, b) for a, b in zip(rows, rows[1:]) if not a[1] and a[0] == b[0]]
            if not pairs:
                continue
            texts = [a[3] for a, _ in pairs]
            changed = [_edited(a[3], b[3]) for a, b in pairs]
            every = _fingerprint_column([row[3] for row in rows], shipped.value, plan)
            edited = _fingerprint_column(changed, shipped.value, plan)
            first = np.array([at for at, (a, b) in enumerate(zip(rows, rows[1:])) if not a[1] and a[0] == b[0]])
            own, other = ([part[at] for part in every] for at in (first, first + 1))
            yield pa.record_batch({
                "id": pa.array([a[2] for a, _ in pairs], batch.schema.field("id").type),
                "n_chars": pa.array([len(x) for x in texts], pa.int64()),
                "edited_sha256": pa.array([hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in changed]),
                "fingerprint": pa.array(_text(*own)), "edited_fingerprint": pa.array(_text(*edited)),
                "near_edited": pa.array(likeness(own, edited)), "near_next": pa.array(likeness(own, other)),
            })


def compare_with_next(docs: DataFrame, id_col: str, text_col: str, terms: np.ndarray, plan: Plan = Plan()) -> DataFrame:
    """Fingerprints of every text, of the text with its second half taken from the next one, and their likeness.

    The order is descending id, repeats of an id by text, NULL ids last; after the last row comes the first.  ``id``
    is a number.  Rows are dealt into ranges whose upper ends are ids of the table; each range also gets a copy of
    the rows with the upper end of the one below, so that all neighbours meet while every text moves once.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Several ranges for each partition even out what the hash of their numbers deals unevenly.
    shares = [k / (4 * parts) for k in range(1, 4 * parts)]
    ends = rows.agg(F.percentile_approx("id", shares, 100 * parts).alias("ends"), F.max("id").alias("top")).first()
    upper = np.array(sorted({*(ends["ends"] or []), *([ends["top"]] if ends["top"] is not None else [])}))

    def ranges(ids: pa.Array) -> pa.Array:
        """The range of each id and, for an upper end, the range above that holds a copy (the top one's is the lowest)."""
        out = []
        for value in ids.to_pylist():
            if value is None:
                out.append([0] if len(upper) else [0, 0])
                continue
            at = int(np.searchsorted(upper, value, "left"))
            out.append([at] if value != upper[at] else [at, (at + 1) % len(upper)])
        return pa.array(out, pa.list_(pa.int32()))

    dealt = rows.select("id", "text", F.posexplode(F.arrow_udf(ranges, "array<int>")("id")).alias("copy", "bucket"))
    ordered = dealt.repartition(parts, "bucket").sortWithinPartitions("bucket", "copy", F.desc_nulls_last("id"), "text")
    shipped = spark.sparkContext.broadcast(terms)
    schema = (
        f"id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    )
    return ordered.select("bucket", "copy", "id", "text").mapInArrow(lambda batches: _compare(batches, shipped, plan), schema)
