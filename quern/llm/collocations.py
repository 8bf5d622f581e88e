"""Phrase collocations from sorted count streams, after the layout of external n-gram estimation.

Counting.  Tasks number the words of their texts, sort runs of word windows and emit each distinct window with its
count, so a phrase in a third of all rows crosses the network once per run.  A first pass counts word pairs by a 64-bit
hash; a second counts words and the phrases of up to ``longest`` words all of whose pairs may be frequent, exactly, as
text.  A phrase cannot be more frequent than a pair in it, so none is lost: equal hashes only let more through.

Layout.  The counts of each length are one stream, kept once in prefix order (language, phrase) and once in suffix order
(language, last words, phrase).  Sort-merge joins of a stream with the next shorter one give the counts of what a phrase
begins with (prefix order) and ends with (suffix order); the same two, read the other way, give the most frequent
extension of every phrase.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm import flat
from quern.operators.retrieve import best_rows
from quern.sources.tables import spread, store

# Pairs, and words, that are sorted together in a task, and phrases that become one batch.
RUN_PAIRS = 1 << 21
RUN_WORDS = 1 << 20
BATCH_PHRASES = 1 << 16
# Bytes of a text that are split at once, cut at white space.
PART_BYTES = 1 << 20
# The filter of frequent pairs has so many bits for each, at most 2 ** FILTER_BITS in all.  Beyond that it lets more
# through, and the second pass counts more; the result is the same.
BITS_FOR_EACH = 16
FILTER_BITS = 28
_BREAK = b"."
_WORDS = bytes(
    0x2E if bytes([b]) in b".,;:!?\n\x0b\x0c\r" else 0x20 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256)
)
UNKNOWN = "und"


@dataclass(frozen=True)
class Plan:
    longest: int = 4  # words of a phrase
    least: int = 30  # occurrences of a candidate
    absorbed: int = 80  # percent of its occurrences within one longer candidate that drop a candidate
    first: int = 2000  # phrases of a language


def _word_numbers(text: bytes, number: dict[bytes, int]) -> Iterator[np.ndarray]:
    """Numbers of the words of a text, with 0 at every break between pieces."""
    lo = 0
    while lo < len(text):
        hi = lo + PART_BYTES
        if hi < len(text):
            # White space never stands within a word; the numbers are joined again.
            ends = [at for at in (text.find(gap, hi) for gap in (b" ", b"\t", b"\n")) if at >= 0]
            hi = min(ends) if ends else len(text)
        part = text[lo:hi].translate(_WORDS).replace(_BREAK, b" . ").split()
        yield np.fromiter(map(number.__getitem__, part), np.int64, len(part))
        lo = hi


@dataclass
class Run:
    """Windows of one language in word numbers, ready to be sorted."""

    words: list[bytes]
    ids: np.ndarray

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Where two words follow each other, and the pair as one number."""
        at = np.flatnonzero((self.ids[:-1] > 0) & (self.ids[1:] > 0))
        return at, self.ids[at] * len(self.words) + self.ids[at + 1]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Run]]:
    """Texts of a task in runs of one language each; a run ends between documents, so no window is cut."""
    numbers: dict[str, dict[bytes, int]] = {}
    parts: dict[str, list[np.ndarray]] = defaultdict(list)
    size = 0

    def close() -> Iterator[tuple[str, Run]]:
        for lang, ids in parts.items():
            yield lang, Run(list(numbers[lang]), np.concatenate([*ids, np.zeros(1, np.int64)]))

    for batch in batches:
        data, offsets = flat.utf8(batch.column(1))
        ends = offsets.tolist()
        for lang, lo, hi in zip(batch.column(0).to_pylist(), ends, ends[1:], strict=False):
            if lang not in numbers:
                number = numbers[lang] = defaultdict()
                number.default_factory = number.__len__
                number[_BREAK]
            for ids in _word_numbers(data[lo:hi].tobytes(), numbers[lang]):
                parts[lang].append(ids)
                size += len(ids)
            parts[lang].append(np.zeros(1, np.int64))
            if size >= RUN_WORDS:
                yield from close()
                numbers, parts, size = {}, defaultdict(list), 0
    yield from close()


_BREAKS = np.zeros(256, bool)
_BREAKS[list(b".,;:!?\n\x0b\x0c\r")] = True
_GAPS = _BREAKS.copy()
_GAPS[[0x20, 0x09]] = True


def _seed(lang: str) -> int:
    return xxhash.xxh64_intdigest(lang.encode())


def _joined(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """A 64-bit hash of two hashes in order."""
    return flat.mix(flat.mix(first) + second)


def _pair_hashes(lang: str, run: Run, pairs: np.ndarray) -> np.ndarray:
    """A 64-bit hash of language and both words, the same in every task; the breaks are words here, too."""
    text = np.frombuffer(b" ".join(run.words), np.uint8)
    spaces = np.zeros(256, bool)
    spaces[0x20] = True
    of_word = flat.word_hashes(text, np.array([0, len(text)]), gaps=spaces)[0]
    n = len(run.words)
    return _joined(of_word[pairs // n] ^ np.uint64(_seed(lang)), of_word[pairs % n])


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []
    size = 0

    def close() -> pa.RecordBatch:
        pairs, counts = np.unique(np.concatenate(held), return_counts=True)
        return pa.record_batch({"pair": pa.array(pairs.view(np.int64)), "a": pa.array(counts)})

    for batch in batches:
        langs = batch.column(0).dictionary_encode()
        seeds = np.array([_seed(lang) for lang in langs.dictionary.to_pylist()], np.uint64)[langs.indices.to_numpy()]
        data, offsets = flat.utf8(batch.column(1))
        for lo, hi in flat.runs(offsets):
            part, ends = data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
            hashes, doc = flat.word_hashes(part, ends, gaps=_GAPS)
            if len(hashes) < 2:
                continue
            piece = np.cumsum(_BREAKS[part])[flat.words(part, ends, _GAPS)[0]]
            at = np.flatnonzero((doc[1:] == doc[:-1]) & (piece[1:] == piece[:-1]))
            held.append(_joined(hashes[at] ^ seeds[lo + doc[at]], hashes[at + 1]))
            size += len(at)
            if size >= RUN_PAIRS:
                yield close()
                held, size = [], 0
    if size:
        yield close()


def _maybe_frequent(counted: DataFrame, least: int) -> tuple[np.ndarray, int]:
    """A bit for every hash that may be of a frequent pair, and the number of bits; built in buckets of a few kilobytes."""
    frequent = store(counted.groupBy("pair").agg(F.sum("a").alias("a")).where(F.col("a") >= least).select("pair"), "pairs")
    bits = 1 << min(FILTER_BITS, max(16, (frequent.count() * BITS_FOR_EACH - 1).bit_length()))
    # Positions count from 1 and buckets of 32,768 bits, too.
    place = F.col("pair").bitwiseAND(F.lit(bits - 1))
    filled = frequent.select(F.bitmap_bucket_number(place + 1).alias("bucket"), F.bitmap_bit_position(place + 1).alias("position"))
    filled = filled.groupBy("bucket").agg(F.bitmap_construct_agg("position").alias("bits")).toArrow()
    out = np.zeros(bits >> 3, np.uint8)
    for bucket, found in zip(filled["bucket"].to_pylist(), filled["bits"].to_pylist(), strict=True):
        out[(bucket - 1) * 4096:bucket * 4096] = np.frombuffer(found, np.uint8)
    return out, bits


def _count_phrases(batches: Iterator[pa.RecordBatch], table: np.ndarray, bits: int, longest: int) -> Iterator[pa.RecordBatch]:
    def rows(lang: str, run: Run, windows: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(windows), BATCH_PHRASES):
            part = windows[lo:lo + BATCH_PHRASES]
            phrases = [b" ".join([run.words[i] for i in window]) for window in part.tolist()]
            yield pa.record_batch({
                "lang": pa.array([lang] * len(part)), "size": pa.array(np.full(len(part), part.shape[1], np.int32)),
                "phrase": pa.array(phrases, pa.binary()).cast(pa.string()), "a": pa.array(counts[lo:lo + BATCH_PHRASES]),
            })

    for lang, run in _runs(batches):
        ids, counts = np.unique(run.ids[run.ids > 0], return_counts=True)
        if not len(ids):
            continue
        yield from rows(lang, run, ids[:, None], counts)
        at, pairs = run.pairs()
        if not len(at):
            continue
        known, number = np.unique(pairs, return_inverse=True)
        place = (_pair_hashes(lang, run, known) & np.uint64(bits - 1)).astype(np.int64)
        open_ = (table[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)
        # The number of the window of the size at hand that begins at a word, -1 where none may be frequent.
        window = np.full(len(run.ids), -1, np.int64)
        window[at] = np.where(open_[number], number, -1)
        pair_at, begin = window.copy(), np.flatnonzero(window >= 0)
        for size in range(2, longest + 1):
            if size > 2:
                # A window and the pair at its end make the next longer one.
                begin = begin[begin + size - 2 < len(pair_at)]
                begin = begin[pair_at[begin + size - 2] >= 0]
                key = window[begin] * len(known) + pair_at[begin + size - 2]
                _, number = np.unique(key, return_inverse=True)
                window[:] = -1
                window[begin] = number
            if not len(begin):
                break
            _, where, counts = np.unique(window[begin], return_index=True, return_counts=True)
            yield from rows(lang, run, run.ids[begin[where][:, None] + np.arange(size)], counts)


def phrase_counts(docs: DataFrame, text_col: str, lang_col: str, plan: Plan = Plan()) -> tuple[DataFrame, DataFrame]:
    """``(lang, size, phrase, a)`` of all words and phrases with ``plan.least`` occurrences, and ``(lang, n)``: all words.

    A-Z is lowered; texts fall into pieces at ``.,;:!?`` and line ends, pieces into words at blanks and tabs.  A NULL
    language reads ``und``; NULL and empty texts hold nothing.
    """
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text_col).cast("string").alias("text"))
    texts = spread(texts.where(F.col("text").isNotNull()))
    table, bits = _maybe_frequent(texts.mapInArrow(_count_pairs, "pair long, a long"), plan.least)
    shipped, longest = docs.sparkSession.sparkContext.broadcast(table), plan.longest

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _count_phrases(batches, shipped.value, bits, longest)

    counted = texts.mapInArrow(rows, "lang string, size int, phrase string, a long")
    counted = counted.groupBy("lang", "size", "phrase").agg(F.sum("a").alias("a"))
    # Of rare phrases nothing is needed; rare words count in the totals.
    counted = store(counted.where((F.col("a") >= plan.least) | (F.col("size") == 1)), "phrase-counts")
    totals = counted.where(F.col("size") == 1).groupBy("lang").agg(F.sum("a").alias("n"))
    return counted.where(F.col("a") >= plan.least), totals


def beginning(phrase: str = "phrase") -> Column:
    """A phrase without its last word."""
    return F.expr(f"left({phrase}, length({phrase}) - instr(reverse({phrase}), ' '))")


def ending(phrase: str = "phrase") -> Column:
    """A phrase without its first word."""
    return F.expr(f"substring({phrase}, instr({phrase}, ' ') + 1)")


def streams(counted: DataFrame, plan: Plan = Plan()) -> list[tuple[DataFrame, DataFrame]]:
    """For every length the stream of counts, in prefix order and in suffix order."""
    out = []
    for size in range(1, plan.longest + 1):
        stream = counted.where(F.col("size") == size).drop("size")
        pair = (stream, stream) if size == 1 else (stream.withColumn("part", beginning()), stream.withColumn("part", ending()))
        keys = ["lang", "phrase"] if size == 1 else ["lang", "part", "phrase"]
        out.append(tuple(store(half, f"stream-{size}", keys) for half in (pair[:1] if size == 1 else pair)))
    return [(pair[0], pair[-1]) for pair in out]


def _with_parts(longer: DataFrame, shorter: DataFrame, name: str) -> DataFrame:
    """The counts of all beginnings (or endings) of a phrase, shortest first, by merging two sorted streams."""
    below = shorter.select(F.col("lang"), F.col("phrase").alias("part"), F.concat(F.col(name), F.array("a")).alias(name))
    return longer.join(below.hint("merge"), ["lang", "part"]).select("lang", "phrase", "a", name)


def _extended(longer: tuple[DataFrame, DataFrame]) -> DataFrame:
    """``(lang, phrase, most)``: the most occurrences of any phrase that has one more word before or behind."""
    both = [half.groupBy("lang", F.col("part").alias("phrase")).agg(F.max("a").alias("most")) for half in longer]
    left, right = both[0], both[1].withColumnRenamed("most", "other")
    return left.join(right.hint("merge"), ["lang", "phrase"], "full").select("lang", "phrase", F.greatest("most", "other").alias("most"))


def score(counted: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """``(lang, phrase, a, l, r, score)`` of all candidates that no longer one takes in.

    ``counted`` holds ``(lang, size, phrase, a)`` of words and phrases, with every part of a phrase it holds.
    """
    ordered = streams(counted, plan)
    empty = F.array().cast("array<bigint>")
    left, right = ordered[0][0].withColumn("begins", empty), ordered[0][0].withColumn("ends", empty)
    found = None
    for size in range(2, plan.longest + 1):
        prefix, suffix = ordered[size - 1]
        left = store(_with_parts(prefix, left, "begins"), f"begins-{size}", ["lang", "phrase"])
        right = store(_with_parts(suffix, right, "ends"), f"ends-{size}", ["lang", "phrase"])
        rows = left.join(right.drop("a").hint("merge"), ["lang", "phrase"])
        if size < plan.longest:
            rows = rows.join(_extended(ordered[size]).hint("merge"), ["lang", "phrase"], "left")
            taken = F.col("most").cast("decimal(20,0)") * 100 >= F.col("a").cast("decimal(20,0)") * plan.absorbed
            rows = rows.where(~F.coalesce(taken, F.lit(False))).drop("most")
        # Cut after k words: the k-th beginning, and the ending of all others.
        cuts = F.transform(
            F.sequence(F.lit(1), F.lit(size - 1)),
            lambda k: F.struct(k.alias("k"), F.get("begins", k - 1).alias("l"), F.get("ends", F.lit(size - 1) - k).alias("r")),
        )
        exact = "cast(2000000 as decimal(7,0)) * cast(a as decimal(19,0)) div (cast(c.l as decimal(19,0)) + cast(c.r as decimal(19,0)))"
        rows = rows.withColumn("cuts", cuts).withColumn("cuts", F.expr(f"transform(cuts, c -> struct({exact} AS score, c.k, c.l, c.r))"))
        rows = rows.select("lang", "phrase", "a", F.array_min("cuts").alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
        found = rows if found is None else found.unionByName(rows)
    return found


def mine(docs: DataFrame, text_col: str, lang_col: str, plan: Plan = Plan()) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: each language's first phrases of two words or more.

    ``a`` counts the phrase, ``l`` and ``r`` the two parts of its lowest-scoring cut, ``n`` all words of the language;
    ``score`` is ``floor(2000000 * a / (l + r))``.  A candidate that lies in a longer one with ``plan.absorbed`` percent
    of its occurrences is dropped; looking one word further is enough, for what lies between the two is as frequent as
    the longer one.  Order: score, then ``a``, both descending, then the phrase by its bytes.  Rows that repeat count
    each time; an empty table has no rows.
    """
    if plan.longest < 2:
        raise ValueError("a phrase has two words at least")
    counted, totals = phrase_counts(docs, text_col, lang_col, plan)
    found = store(score(counted, plan), "candidates")
    ranked = best_rows(found, "lang", [F.desc("score"), F.desc("a"), F.col("phrase")], plan.first, "phrase")
    ranked = ranked.join(totals.hint("merge"), "lang")
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
