"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi search.

The automaton reads the text once.  At each position its output links name every piece that ends there, and each of
them may improve the best score of the position.  A character that no piece covers costs ten less than the worst
piece and is written as its UTF-8 bytes where the vocabulary has byte pieces.  Ties go to the longer last piece.

Where no piece holds a blank behind another character, no piece spans two words, so the best path of a text is the
best paths of its words put together; each task then keeps the paths of the words it has met.

The vocabulary is a public model file that the driver reads; nothing is trained.  For models whose scores come from
merge ranks the result is the best-scoring segmentation, which may differ from replaying the merges.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLANK = "▁"
# Words whose paths a worker keeps before it starts afresh.
KEPT_WORDS = 200_000
KEPT_LETTERS = 48


@dataclass
class Vocabulary:
    pieces: list[str]
    scores: list[float]
    usable: list[bool]
    byte_ids: list[int]  # by byte; empty without byte pieces
    unknown: int
    dummy_prefix: bool
    whole_words: bool
    kept: dict[str, bytes] = field(default_factory=dict, repr=False)
    _automaton: object = field(default=None, repr=False)
    _spelt: tuple | None = field(default=None, repr=False)

    def spellings(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Length of every piece's bytes, where they begin, and the bytes of all pieces."""
        if self._spelt is None:
            byte_of = {number: byte for byte, number in enumerate(self.byte_ids)}
            spelt = [_spelling(self, at, byte_of) for at in range(len(self.pieces))]
            length = np.array([len(s) for s in spelt], np.int64)
            self._spelt = length, np.concatenate(([0], np.cumsum(length)))[:-1], np.frombuffer(b"".join(spelt), np.uint8)
        return self._spelt

    def automaton(self):
        """Built once in each worker."""
        if self._automaton is None:
            import ahocorasick

            found = ahocorasick.Automaton()
            for at, (piece, score, usable) in enumerate(zip(self.pieces, self.scores, self.usable, strict=True)):
                if usable and piece:
                    found.add_word(piece, (at, len(piece), score))
            found.make_automaton()
            self._automaton = found
        return self._automaton

    @property
    def unknown_score(self) -> float:
        return min((s for s, u in zip(self.scores, self.usable, strict=True) if u), default=0.0) - 10.0


def load(path: str) -> Vocabulary:
    """Read a public SentencePiece model file on the driver.  Models with a character map are refused."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    norm = model.normalizer_spec
    if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
        raise ValueError(f"{path} changes texts before it cuts them, which cannot be undone")
    kinds = model.SentencePiece
    byte_ids = {int(p.piece[1:-1], 16): at for at, p in enumerate(model.pieces) if p.type == kinds.BYTE}
    pieces = [p.piece for p in model.pieces]
    usable = [p.type in (kinds.NORMAL, kinds.USER_DEFINED) for p in model.pieces]
    return Vocabulary(
        pieces, [float(p.score) for p in model.pieces], usable, [byte_ids[b] for b in range(256)] if len(byte_ids) == 256 else [],
        next((at for at, p in enumerate(model.pieces) if p.type == kinds.UNKNOWN), 0), norm.add_dummy_prefix,
        not any((BLANK in p.lstrip(BLANK)) or "\n" in p for p, u in zip(pieces, usable, strict=True) if u),
    )


_WORD = re.compile(f"{BLANK}*[^{BLANK}\n]+|{BLANK}+|\n")


def best_path(text: str, vocabulary: Vocabulary, unknown_score: float) -> list[int]:
    """Piece ids of the best-scoring segmentation."""
    n = len(text)
    best, back, piece = [0.0] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
    at = 0
    for end, (number, length, score) in vocabulary.automaton().iter(text):
        end += 1
        while at < end:
            best[at + 1], back[at + 1] = best[at] + unknown_score, at
            at += 1
        total = best[end - length] + score
        if total > best[end] or (total == best[end] and end - length < back[end]):
            best[end], back[end], piece[end] = total, end - length, number
    while at < n:
        best[at + 1], back[at + 1] = best[at] + unknown_score, at
        at += 1
    out: list[int] = []
    end = n
    while end:
        start = back[end]
        if piece[end] >= 0:
            out.append(piece[end])
        elif vocabulary.byte_ids:
            out.extend(vocabulary.byte_ids[b] for b in reversed(text[start:end].encode("utf-8", "surrogatepass")))
        elif not out or out[-1] != vocabulary.unknown or piece[min(end + 1, n)] >= 0:
            out.append(vocabulary.unknown)
        end = start
    return out[::-1]


def encode_texts(texts: list[str | None], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """All ids in a row, and where each text's begin and end.  NULL and empty texts have none."""
    kept, worst = vocabulary.kept, vocabulary.unknown_score
    lengths, parts = np.zeros(len(texts) + 1, np.int64), []
    for at, text in enumerate(texts):
        if not text:
            continue
        text = text.replace(" ", BLANK)
        if vocabulary.dummy_prefix:
            text = BLANK + text
        size = 0
        for word in _WORD.findall(text) if vocabulary.whole_words else (text,):
            found = kept.get(word)
            if found is None:
                found = np.array(best_path(word, vocabulary, worst), np.int32).tobytes()
                if len(word) <= KEPT_LETTERS:
                    if len(kept) >= KEPT_WORDS:
                        kept.clear()
                    kept[word] = found
            parts.append(found)
            size += len(found)
        lengths[at + 1] = size // 4
    return np.frombuffer(b"".join(parts), np.int32), np.cumsum(lengths)


def decode_ids(ids: np.ndarray, bounds: np.ndarray, vocabulary: Vocabulary) -> list[str]:
    """The text of every list of ids; the blank put before a text is taken off, bytes that are no UTF-8 become U+FFFD."""
    byte_of = {number: byte for byte, number in enumerate(vocabulary.byte_ids)}
    spelt = [
        bytes([byte_of[at]]) if at in byte_of else piece.replace(BLANK, " ").encode() if usable else "⁇".encode() if at == vocabulary.unknown else b""
        for at, (piece, usable) in enumerate(zip(vocabulary.pieces, vocabulary.usable, strict=True))
    ]
    length = np.array([len(s) for s in spelt], np.int64)
    begin = np.concatenate(([0], np.cumsum(length)))[:-1]
    letters = np.frombuffer(b"".join(spelt), np.uint8)
    out = []
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        sizes = length[ids[lo:hi]]
        ends = np.cumsum(sizes)
        take = np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin[ids[lo:hi]] - (ends - sizes), sizes)
        text = letters[take].tobytes().decode("utf-8", "replace")
        out.append(text[1:] if vocabulary.dummy_prefix and text.startswith(" ") else text)
    return out


# Texts handled at once, so that lists of ids stay small.
TEXTS = 256


def encode(docs: DataFrame, id_col: str, text_col: str, vocabulary: Vocabulary) -> DataFrame:
    """``(id, ids, n_tokens, round_trip)`` of every whole text.

    ``round_trip`` says whether decoding the ids gives the text back; it does but for texts that hold the blank's own
    sign U+2581, which reads as a blank.  NULL and empty texts have no ids.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(vocabulary)
    kind = docs.schema[id_col].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), TEXTS):
                part = batch.slice(lo, TEXTS)
                texts = part.column(1).to_pylist()
                ids, bounds = encode_texts(texts, shipped.value)
                again = decode_ids(ids, bounds, shipped.value)
                yield pa.record_batch({
                    "id": part.column(0), "ids": pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids)),
                    "n_tokens": pa.array(np.diff(bounds)), "round_trip": pa.array([a == (b or "") for a, b in zip(again, texts, strict=True)]),
                })

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        rows, f"id {kind}, ids array<int>, n_tokens long, round_trip boolean"
    )


def decode(rows: DataFrame, id_col: str, ids_col: str, vocabulary: Vocabulary) -> DataFrame:
    """``(id, text)``: the texts that lists of ids spell; a NULL list, or an empty one, spells an empty text.

    Ids outside the vocabulary, and NULL ones, read as the unknown piece.
    """
    shipped = rows.sparkSession.sparkContext.broadcast(vocabulary)
    kind = rows.schema[id_col].dataType.simpleString()

    def spelt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shipped.value
        for batch in batches:
            for lo in range(0, len(batch), TEXTS):
                part = batch.slice(lo, TEXTS)
                lists = [
                    [words.unknown if i is None or not 0 <= i < len(words.pieces) else i for i in x or ()] for x in part.column(1).to_pylist()
                ]
                bounds = np.concatenate(([0], np.cumsum([len(x) for x in lists], dtype=np.int64)))
                ids = np.array([i for x in lists for i in x], np.int64)
                yield pa.record_batch({"id": part.column(0), "text": pa.array(decode_ids(ids, bounds, words), pa.string())})

    return rows.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(spelt, f"id {kind}, text string")
