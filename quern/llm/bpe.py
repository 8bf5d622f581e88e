"""Token counts by rank-synchronous merging of ragged arrays.

The vocabulary is a public tokenizer file of byte-pair merges.  Its own normaliser and splitting rules cut texts into
pre-tokens; each distinct pre-token of a batch then becomes a row of one ragged array of symbol numbers.  In every round
each row applies its pair of lowest rank, at all its places at once, all rows together; rows without a pair leave, and
the symbols that survive are their tokens.

That is the same as merging one place at a time, as long as no pair that a merge creates ranks before that merge.
``load`` checks this, and refuses a file for which it does not hold.

Where the splitting rules never join what white space parts, tasks count words and keep the counts of those they met.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import flat

# Words whose counts a task keeps before it starts afresh, and their longest in bytes.
KEPT_WORDS = 400_000
KEPT_BYTES = 64
# Bytes of text handled at once; a longer document is handled alone.
GROUP_BYTES = 1 << 22
# A longer row is merged by itself, rank after rank, so that its rounds do not read it all each time.
LONG_ROW = 512
NO_RANK = np.int64(1) << np.int64(62)
_WHITE = " \t\n\x0b\x0c\r"


@dataclass
class Model:
    """Merges as sorted pair keys, and what turns texts into rows of symbols."""

    rules: str  # the tokenizer file without its vocabulary
    specials: list[str]
    by_words: bool
    n_symbols: int
    keys: np.ndarray  # left * n_symbols + right, sorted
    rank_of: np.ndarray  # by key
    merged: np.ndarray  # by rank
    inner: np.ndarray  # symbol of a character, by code point; -1 without one
    final: np.ndarray  # the same for the last character of a pre-token
    _cut: object = field(default=None, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "_cut": None}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of every pair; ``NO_RANK`` for pairs that are never merged."""
        if not len(self.keys):
            return np.full(len(left), NO_RANK)
        key = left * self.n_symbols + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank_of[at], NO_RANK)

    def pre_tokens(self, text: str) -> tuple[list[str], int]:
        """The pre-tokens of a text, and how many special strings stand in it."""
        if self._cut is None:
            self._cut = _cutter(self.rules)
        if not any(special in text for special in self.specials):
            return self._cut(text), 0
        parts = re.split("|".join(re.escape(s) for s in sorted(self.specials, key=len, reverse=True)), text)
        return [piece for part in parts for piece in self._cut(part)], len(parts) - 1


def _cutter(rules: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(rules)
    normal = tokenizer.normalizer.normalize_str if tokenizer.normalizer else lambda text: text
    split = tokenizer.pre_tokenizer.pre_tokenize_str if tokenizer.pre_tokenizer else lambda text: [(text, None)] if text else []
    return lambda text: [piece for piece, _ in split(normal(text))] if text else []


def _parts_at_white_space(cut) -> bool:
    """Whether a text is cut as its words are, tried on every kind of neighbours."""
    kinds = ["a", "é", "7", "-", "'", "'s", "_", "中", "́", "x1"]
    return all(cut(a + gap + b) == cut(a) + cut(b) for a in kinds for b in kinds for gap in [*_WHITE, "  ", "\r\n"]) and not cut(_WHITE)


def _symbols(vocabulary: dict[str, int], prefix: int, suffix: str) -> np.ndarray:
    ends = {word[: len(word) - len(suffix)]: number for word, number in vocabulary.items() if word.endswith(suffix)}
    single = {ord(word): number for word, number in ends.items() if len(word) == 1}
    table = np.full(prefix, -1, np.int64)
    table[list(single)] = list(single.values())
    return table


def load(path: str) -> Model:
    """Read a tokenizer file (JSON) whose model is plain byte-pair merging.

    Files that drop merges at random, fall back to bytes, mark continued words, name an unknown token or look for
    special strings only after normalising are refused, as are merges out of order.
    """
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model = spec["model"]
    odd = [name for name in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges") if model.get(name)]
    added = spec.get("added_tokens") or []
    odd += [token["content"] for token in added if token.get("normalized") or token.get("lstrip") or token.get("rstrip") or token.get("single_word")]
    if model.get("type") != "BPE" or odd:
        raise ValueError(f"not plain byte-pair merging: {odd or model.get('type')}")
    vocabulary = model["vocab"]
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    left = np.array([vocabulary[a] for a, _ in merges], np.int64)
    right = np.array([vocabulary[b] for _, b in merges], np.int64)
    merged = np.array([vocabulary[a + b] for a, b in merges], np.int64)
    n = max([*vocabulary.values(), 0]) + 1
    # The last merge that makes a symbol must come before every pair that the symbol is in.
    made = np.full(n, -1, np.int64)
    np.maximum.at(made, merged, np.arange(len(merges)))
    if len(merges) and (np.maximum(made[left], made[right]) >= np.arange(len(merges))).any():
        raise ValueError("a merge comes before the merges that make its parts")
    keys = left * n + right
    first = np.unique(keys, return_index=True)
    top = max((ord(word[0]) for word in vocabulary if word), default=0) + 1
    rules = json.dumps({**spec, "added_tokens": [], "model": {"type": "BPE", "vocab": {}, "merges": []}, "post_processor": None})
    return Model(
        rules, [token["content"] for token in added], _parts_at_white_space(_cutter(rules)), n, first[0], first[1], merged,
        _symbols(vocabulary, top, ""), _symbols(vocabulary, top, model.get("end_of_word_suffix") or ""),
    )


def _alternate(places: np.ndarray, touches: np.ndarray) -> np.ndarray:
    """Of places that overlap the one before them, every other from the left."""
    if not touches.any():
        return places
    start = np.flatnonzero(~touches)
    nth = np.arange(len(places)) - np.repeat(start, np.diff(np.append(start, len(places))))
    return places[nth % 2 == 0]


def _long_row(symbols: np.ndarray, model: Model) -> int:
    """Tokens of one long row: ranks in order, each at all its places, over neighbours held as links."""
    n = len(symbols)
    symbols, after, before = symbols.copy(), np.append(np.arange(1, n), -1), np.arange(-1, n - 1)
    alive, waiting, heap = np.ones(n, bool), {}, []

    def push(places: np.ndarray) -> None:
        ranks = model.ranks(symbols[places], symbols[after[places]])
        order = np.argsort(ranks, kind="stable")
        ranks, places = ranks[order], places[order]
        found = int(np.searchsorted(ranks, NO_RANK))
        cuts = np.flatnonzero(np.diff(ranks[:found])) + 1
        for group, rank in zip(np.split(places[:found], cuts), ranks[:found][np.append(0, cuts)] if found else (), strict=False):
            if int(rank) not in waiting:
                heapq.heappush(heap, int(rank))
            waiting.setdefault(int(rank), []).append(group)

    push(np.arange(n - 1))
    while heap:
        rank = heapq.heappop(heap)
        places = np.unique(np.concatenate(waiting.pop(rank)))
        places = places[alive[places] & (after[places] >= 0)]
        places = places[model.ranks(symbols[places], symbols[after[places]]) == rank]
        if not len(places):
            continue
        places = _alternate(places, np.append(False, after[places[:-1]] == places[1:]))
        gone = after[places]
        beyond = after[gone]
        symbols[places], after[places], alive[gone] = model.merged[rank], beyond, False
        before[beyond[beyond >= 0]] = places[beyond >= 0]
        near = np.unique(np.concatenate((places, before[places][before[places] >= 0])))
        push(near[after[near] >= 0])
    return int(alive.sum())


def survivors(symbols: np.ndarray, bounds: np.ndarray, model: Model) -> np.ndarray:
    """How many symbols of every row are left when no pair of it can be merged."""
    lengths = np.diff(bounds)
    out = lengths.copy()
    for row in np.flatnonzero(lengths > LONG_ROW).tolist():
        out[row] = _long_row(symbols[bounds[row]:bounds[row + 1]], model)
    lengths = np.where(lengths > LONG_ROW, 0, lengths)
    row = np.repeat(np.arange(len(out)), np.diff(bounds))
    inside = lengths[row] > 1
    row, symbols = row[inside], symbols[inside]
    ranks = np.full(len(row), NO_RANK)
    pairs = np.flatnonzero(row[:-1] == row[1:])
    ranks[pairs] = model.ranks(symbols[pairs], symbols[pairs + 1])
    while len(row):
        starts = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        size = np.diff(np.append(starts, len(row)))
        lowest = np.minimum.reduceat(ranks, starts)
        done = lowest == NO_RANK
        out[row[starts[done]]] = size[done]
        live = np.repeat(~done, size)
        lowest = np.repeat(lowest, size)[live]
        row, symbols, ranks = row[live], symbols[live], ranks[live]
        places = np.flatnonzero(ranks == lowest)
        if not len(places):
            break
        places = _alternate(places, np.append(False, np.diff(places) == 1))
        symbols[places] = model.merged[ranks[places]]
        keep = np.ones(len(row), bool)
        keep[places + 1] = False
        row, symbols, ranks = row[keep], symbols[keep], ranks[keep]
        places = places - np.arange(len(places))
        near = np.unique(np.concatenate((places, np.maximum(places - 1, 0))))
        joined = (near + 1 < len(row)) & (row[near] == row[np.minimum(near + 1, len(row) - 1)])
        ranks[near] = NO_RANK
        near = near[joined]
        ranks[near] = model.ranks(symbols[near], symbols[near + 1])
    return out


def _rows(pieces: list[str], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of every pre-token; characters that the vocabulary lacks have none, as in the library."""
    bounds = np.concatenate(([0], np.cumsum([len(piece) for piece in pieces], dtype=np.int64)))
    points = np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    known = points < len(model.inner)
    at = np.where(known, points, 0)
    symbols = np.where(known, model.inner[at], -1)
    last = bounds[1:][np.diff(bounds) > 0] - 1
    symbols[last] = np.where(known[last], model.final[at[last]], -1)
    kept = np.concatenate(([0], np.cumsum(symbols >= 0)))
    return symbols[symbols >= 0], kept[bounds]


def _count_units(units: list[bytes], model: Model) -> list[int]:
    """Tokens of each of some words or texts; each distinct pre-token is merged once."""
    number: dict[str, int] = {}
    owner, pick, special = [], [], np.zeros(len(units), np.int64)
    for at, unit in enumerate(units):
        pieces, special[at] = model.pre_tokens(unit.decode("utf-8", "replace"))
        for piece in pieces:
            owner.append(at)
            pick.append(number.setdefault(piece, len(number)))
    if not number:
        return special.tolist()
    left = survivors(*_rows(list(number), model), model)
    return (special + np.bincount(owner, left[pick], len(units)).astype(np.int64)).tolist()


def count_texts(texts: list[bytes], model: Model, kept: dict[bytes, int] | None = None) -> list[int]:
    """The number of tokens of every whole text, given as UTF-8."""
    if not model.by_words:
        return _count_units(texts, model)
    kept = {} if kept is None else kept
    # Exactly the white space of ASCII.
    words = [text.split() for text in texts]
    fresh = list(set().union(*words) - kept.keys())
    kept.update(zip(fresh, _count_units(fresh, model), strict=True))
    counts = [sum(map(kept.__getitem__, found)) for found in words]
    if len(kept) > KEPT_WORDS:
        kept.clear()
    else:
        for word in fresh:
            if len(word) > KEPT_BYTES:
                del kept[word]
    return counts


def count(docs: DataFrame, id_col: str, text_col: str, model: Model, limit: int | None = None) -> DataFrame:
    """``(id, n_bytes, n_tokens, over_limit)``: UTF-8 bytes and tokens of every whole text.

    ``over_limit`` says whether there are more tokens than ``limit``; without a limit it is NULL.  NULL and empty texts
    have no tokens.  Rows that repeat are counted each; no other column is read.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[bytes, int] = {}
        for batch in batches:
            data, offsets = flat.utf8(batch.column(1))
            raw, counts = data.tobytes(), []
            for lo, hi in flat.runs(offsets, GROUP_BYTES):
                ends = offsets[lo:hi + 1].tolist()
                counts += count_texts([raw[a:b] for a, b in zip(ends, ends[1:], strict=False)], shipped.value, kept)
            yield pa.record_batch({"id": batch.column(0), "n_bytes": pa.array(np.diff(offsets)), "n_tokens": pa.array(counts, pa.int64())})

    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        rows, f"id {kind}, n_bytes long, n_tokens long"
    )
    return found.withColumn("over_limit", F.col("n_tokens") > F.lit(limit).cast("long"))
