"""Language identification with language-bitmask n-gram filters.

A Bloom filter whose cells are bitmasks, one bit per language: the languages that hold an n-gram are the bits set in
all of its cells, so one look-up answers for every language at once.  A text's hits are counted per language, the
hits expected by chance alone (from each language's share of set cells) are taken out, and the largest rest wins.

An n-gram is a run of bytes of the lower-cased UTF-8 text in which everything but letters became blanks.  A language
holds an n-gram if a share of its training documents contains it, and no other language has it much more often.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import flat, sample

UNDETERMINED = "und"
_LETTER = np.full(256, 0x20, np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)
# Odd multipliers, one for each cell of an n-gram.
_PROBES = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)


@dataclass(frozen=True)
class Plan:
    """``docs_per_language`` bounds the training sample; the filter has ``2 ** cells_log2`` cells."""

    docs_per_language: int = 1500
    sizes: tuple[int, ...] = (3, 4)
    min_share: float = 0.01
    min_of_best: float = 0.25
    cells_log2: int = 19
    probes: int = 2


@dataclass(frozen=True)
class Model:
    languages: list[str]
    cells: np.ndarray  # (planes, cells) uint8; bit l % 8 of plane l // 8 is language l
    by_chance: np.ndarray
    plan: Plan


def _normal(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = flat.utf8(pc.utf8_lower(column.cast(pa.large_string())))
    return _LETTER[data], offsets


def _grams(data: np.ndarray, offsets: np.ndarray, sizes: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size, a 32-bit code at every byte, and whether an n-gram begins there: within one text, no two blanks."""
    blank = data == 0x20
    double = np.zeros(len(data), dtype=bool)
    double[:-1] = blank[:-1] & blank[1:]
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(data))
    wide = np.concatenate((data, np.full(4, 0x20, np.uint8))).astype(np.uint32)
    for size in sizes:
        code = np.zeros(len(data), np.uint32)
        for k in range(size):
            code |= wide[k:k + len(data)] << np.uint32(8 * k)
        if size < 4:
            code |= np.uint32(0xFFFFFFFF) << np.uint32(8 * size)
        held = left >= size
        for k in range(size - 1):
            held[:len(data) - k] &= ~double[k:]
        yield code, held


def _cell(code: np.ndarray, probe: int, cells_log2: int) -> np.ndarray:
    spread = (code ^ (code >> np.uint32(15))) * np.uint32(_PROBES[probe])
    spread ^= spread >> np.uint32(13)
    spread *= np.uint32(0x27D4EB2F)
    return spread >> np.uint32(32 - cells_log2)


def _document_grams(batches: Iterator[pa.RecordBatch], sizes: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    """How many documents of each language hold each n-gram, summed over a batch."""
    for batch in batches:
        tags = batch.column(1).to_pylist()
        data, offsets = _normal(batch.column(0))
        found: dict[str, list[np.ndarray]] = {}
        for lo, hi in flat.runs(offsets):
            part = offsets[lo:hi + 1] - offsets[lo]
            pieces = list(_grams(data[offsets[lo]:offsets[hi]], part, sizes))
            for at in range(lo, hi):
                a, b = part[at - lo], part[at - lo + 1]
                found.setdefault(tags[at], []).append(np.unique(np.concatenate([code[a:b][held[a:b]] for code, held in pieces])))
        for tag, grams in found.items():
            gram, docs = np.unique(np.concatenate(grams), return_counts=True)
            yield pa.record_batch({"lang": pa.array([tag] * len(gram)), "gram": pa.array(gram.astype(np.int64)), "docs": pa.array(docs)})


def train(docs: DataFrame, id_col: str, text_col: str, lang_col: str, plan: Plan = Plan()) -> Model:
    """Fit the filter on a bounded sample of the rows of ``docs``.

    Only n-grams in at least ``min_share`` of a language's documents reach the driver; there are at most (mean number
    of distinct n-grams of a document) / ``min_share`` of them for each language, whatever the size of the corpus.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    chosen, counts = sample.per_class(rows, id_col, lang_col, plan.docs_per_language)
    texts = chosen.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    languages = sorted(counts, key=lambda name: (-counts[name], name))
    if not languages:
        return Model([], np.zeros((1, 1 << plan.cells_log2), np.uint8), np.zeros(0), plan)
    seen = texts.groupBy("lang").count()
    sizes = plan.sizes
    grams = (
        texts.mapInArrow(lambda batches: _document_grams(batches, sizes), "lang string, gram long, docs long")
        .groupBy("lang", "gram").agg(F.sum("docs").alias("docs"))
        .join(F.broadcast(seen), "lang")
        .where(F.col("docs") >= F.col("count") * F.lit(plan.min_share))
        .select("lang", "gram", (F.col("docs") / F.col("count")).alias("share"))
        .toArrow()
    )
    return _build(languages, grams, plan)


def _build(languages: list[str], grams: pa.Table, plan: Plan) -> Model:
    index = {name: at for at, name in enumerate(languages)}
    code, group = np.unique(grams["gram"].to_numpy(), return_inverse=True)
    share, lang = grams["share"].to_numpy(), np.array([index[x] for x in grams["lang"].to_pylist()], np.int64)
    best = np.zeros(len(code))
    np.maximum.at(best, group, share)
    held = share >= plan.min_of_best * best[group]
    cells = np.zeros((-(-len(languages) // 8), 1 << plan.cells_log2), np.uint8)
    for probe in range(plan.probes):
        at = _cell(code[group[held]].astype(np.uint32), probe, plan.cells_log2)
        np.bitwise_or.at(cells, (lang[held] // 8, at), (1 << (lang[held] % 8)).astype(np.uint8))
    filled = np.array([((cells[at // 8] >> (at % 8)) & 1).mean() for at in range(len(languages))])
    return Model(languages, cells, filled ** plan.probes, plan)


def hits(data: np.ndarray, offsets: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Per document: looked-up n-grams, and for each language how many of them its bits claim."""
    n, plan = len(offsets) - 1, model.plan
    total, claimed = np.zeros(n), np.zeros((n, len(model.languages)))
    full = np.flatnonzero(np.diff(offsets))
    if not len(full):
        return total, claimed
    begin = offsets[:-1][full]
    for code, held in _grams(data, offsets, plan.sizes):
        at = [_cell(code, probe, plan.cells_log2) for probe in range(plan.probes)]
        total[full] += np.add.reduceat(held, begin, dtype=np.int64)
        for plane in range(len(model.cells)):
            mask = model.cells[plane][at[0]]
            for where in at[1:]:
                mask &= model.cells[plane][where]
            mask[~held] = 0
            for lang in range(8 * plane, min(8 * plane + 8, len(model.languages))):
                claimed[full, lang] += np.add.reduceat((mask >> np.uint8(lang % 8)) & np.uint8(1), begin, dtype=np.int64)
    return total, claimed


def _has_letter(data: np.ndarray, offsets: np.ndarray, column: pa.Array) -> np.ndarray:
    """ASCII letters are seen on the bytes; only texts without any are looked at character by character."""
    plain = np.concatenate(([0], np.cumsum((data >= 97) & (data < 123))))[offsets]
    found = np.diff(plain) > 0
    for at in np.flatnonzero(~found & (np.diff(offsets) > 0)).tolist():
        found[at] = any(map(str.isalpha, column[at].as_py()))
    return found


def _judge(column: pa.Array, model: Model) -> dict[str, np.ndarray]:
    """The answer for every text of a column."""
    names = np.array([*model.languages, UNDETERMINED], dtype=object)
    column = column.fill_null("")
    data, offsets = _normal(column)
    n = len(column)
    out = {"lang_pred": np.full(n, UNDETERMINED, dtype=object), "score": np.zeros(n), "coverage": np.zeros(n), "n_grams": np.zeros(n, np.int64)}
    for lo, hi in flat.runs(offsets) if model.languages else ():
        part, text = offsets[lo:hi + 1] - offsets[lo], data[offsets[lo]:offsets[hi]]
        total, claimed = hits(text, part, model)
        letters = _has_letter(text, part, column.slice(lo, hi - lo))
        rate = claimed / np.maximum(total, 1)[:, None]
        rest = np.maximum(rate - model.by_chance, 0) / (1 - model.by_chance)
        top, sums = rest.max(axis=1), rest.sum(axis=1)
        out["lang_pred"][lo:hi] = names[np.where(letters, rest.argmax(axis=1), len(model.languages))]
        out["score"][lo:hi] = np.where(letters & (sums > 0), top / np.maximum(sums, 1e-300), 0.0)
        out["coverage"][lo:hi] = np.where(letters, top, 0.0)
        out["n_grams"][lo:hi] = total
    return out


def _predict_batches(batches: Iterator[pa.RecordBatch], shipped) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = _judge(batch.column(1), shipped.value)
        yield pa.record_batch({
            "id": batch.column(0), "lang_pred": pa.array(found["lang_pred"], pa.string()),
            **{name: pa.array(found[name]) for name in ("score", "coverage", "n_grams")},
        })


def predict(docs: DataFrame, id_col: str, text_col: str, model: Model) -> DataFrame:
    """``(id, lang_pred, score, coverage, n_grams)`` of every whole text.

    ``score`` is the winner's share of all languages' corrected hits, ``coverage`` the share of n-grams it claims.
    NULL texts and texts without a letter are ``und`` with a score of 0, as is everything if nothing was learned.
    Ties go to the language with more training rows, then to the one that sorts first; so does a text with letters
    but too short for any n-gram, with a score of 0.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        lambda batches: _predict_batches(batches, shipped), f"id {kind}, lang_pred string, score double, coverage double, n_grams long"
    )


def keep(docs: DataFrame, text_col: str, model: Model, min_grams: int, min_coverage: float) -> DataFrame:
    """Rows of ``docs`` whose text is in a known language; nothing is shuffled, and only the text visits Python.

    Rejected are undetermined texts, and texts of at least ``min_grams`` n-grams of which the likeliest language
    claims less than ``min_coverage``.  If nothing was learned, texts with a letter cannot be judged and all stay.
    """
    if not model.languages:
        return docs
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def known(texts: pa.Array) -> pa.Array:
        found = _judge(texts, shipped.value)
        return pa.array((found["lang_pred"] != UNDETERMINED) & ~((found["n_grams"] >= min_grams) & (found["coverage"] < min_coverage)))

    return docs.where(F.arrow_udf(known, "boolean")(F.col(text_col)))
