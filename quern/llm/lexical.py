"""Ranked lexical search by the Best Position Algorithm over impact lists.

A first pass counts, per document, the terms that the queries ask for; document frequencies, the number of documents
and of their terms come from what it writes.  Those fix the impact of every posting.  Then each task cuts its documents
into shards of bounded size and holds one impact list per term and shard: its documents by falling impact.

A query reads the lists of its terms side by side, a few positions at a time.  Every document met is looked up in all
lists, and marks its position in each.  The best position of a list is the last one up to which all are marked; the
impacts at the best positions add up to the most that an unseen document can reach, which is tighter than the last
positions read.  Once that is strictly below the k-th best score the shard is done; ties can change nothing then.
The k-th score carries over from shard to shard of a task.  The best of all tasks are ranked at the end.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.llm import flat
from quern.sources.tables import spread, store

# Query terms handled in one pass over the documents; more queries take further passes.
BLOCK_TERMS = 100_000
# Postings of a shard; a document is never cut.
SHARD_POSTINGS = 1 << 19
# Positions read from each list at first; doubled from read to read.
FIRST_READ = 16

_SPELL = bytes(0x20 if flat.NO_TERM[b] else b + 32 if 65 <= b <= 90 else b for b in range(256))
_NO_ID = -(1 << 63)


def terms_of(text: bytes) -> list[bytes]:
    """All terms of a text: runs of ASCII letters and digits and of anything beyond ASCII; only A-Z is lowered."""
    return text.translate(_SPELL).split()


def _raw(column: pa.Array) -> Iterator[bytes]:
    data, offsets = flat.utf8(column)
    ends = offsets.tolist()
    for a, b in zip(ends, ends[1:], strict=False):
        yield data[a:b].tobytes()


def _item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(item_id, term)``, each once; rows that repeat an id make one query of all their terms."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for item, text in zip(ids, _raw(batch.column(1)), strict=True):
                found = sorted(set(terms_of(text)))
                yield pa.record_batch({"item_id": pa.array([item] * len(found), batch.column(0).type), "term": pa.array(found, pa.binary())})

    kind = items.schema[id_col].dataType.simpleString()
    picked = items.select(F.col(id_col).alias("item_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(rows, f"item_id {kind}, term binary").distinct()


def _count(docs: DataFrame, id_col: str, text_col: str, terms: list[bytes]) -> DataFrame:
    """``(id, n, terms, tfs)`` of every document with a term: its length and what it holds of the terms asked for."""
    shipped = docs.sparkSession.sparkContext.broadcast({term: at for at, term in enumerate(terms)})

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shipped.value
        for batch in batches:
            keep, sizes, counts, ends, held = [], [], [], [0], []
            for at, text in enumerate(_raw(batch.column(1))):
                words = terms_of(text)
                if not words:
                    continue
                found = Counter(filter(number.__contains__, words))
                keep.append(at)
                sizes.append(len(words))
                held += map(number.__getitem__, found)
                counts += found.values()
                ends.append(len(held))
            bounds = pa.array(ends, pa.int32())
            yield pa.record_batch({
                "id": batch.column(0).take(pa.array(keep, pa.int64())), "n": pa.array(sizes, pa.int64()),
                "terms": pa.ListArray.from_arrays(bounds, pa.array(held, pa.int32())),
                "tfs": pa.ListArray.from_arrays(bounds, pa.array(counts, pa.int64())),
            })

    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return spread(picked).mapInArrow(rows, "id long, n long, terms array<int>, tfs array<bigint>")


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Shard:
    """The impact lists of some documents, and each document's entries in them."""

    def __init__(self, ids: np.ndarray, bounds: np.ndarray, terms: np.ndarray, impacts: np.ndarray, n_terms: int):
        self.ids, self.bounds, self.terms, self.impacts = ids, bounds, terms, impacts
        order = np.lexsort((-impacts, terms))
        self.starts = np.searchsorted(terms[order], np.arange(n_terms + 1))
        self.listed_doc, self.listed_impact = flat.owners(bounds)[order], impacts[order]
        # Where each entry of a document stands in its list: direct access.
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.arange(len(order))
        self.marked, self.seen, self.slot = np.zeros(len(order), bool), np.zeros(len(ids), bool), np.zeros(n_terms, bool)

    def look_up(self, docs: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of documents over the terms marked in ``own``, and the places of their entries in the lists."""
        lengths = self.bounds[docs + 1] - self.bounds[docs]
        at = np.repeat(self.bounds[docs] - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(lengths.sum())
        of = np.repeat(np.arange(len(docs)), lengths)
        mine = own[self.terms[at]]
        at, of = at[mine], of[mine]
        scores = np.zeros(len(docs), np.int64)
        np.add.at(scores, of, self.impacts[at])
        return scores, self.place[at]

    def best(self, terms: np.ndarray, k: int, floor: int = 0) -> tuple[np.ndarray, np.ndarray, int]:
        """Ids and scores of the k best documents, ties to the smaller id, and how many were looked up.

        ``floor`` is a score that k documents elsewhere reach; documents below it need not be found.
        """
        lists = [(int(self.starts[t]), int(self.starts[t + 1])) for t in terms.tolist() if self.starts[t] < self.starts[t + 1]]
        self.slot[terms] = True
        best_at = [lo for lo, _ in lists]
        ids, scores, kth, depth, step, met = self.ids[:0], np.zeros(0, np.int64), floor, 0, FIRST_READ, []
        while lists:
            read = np.concatenate([self.listed_doc[min(lo + depth, hi):min(lo + depth + step, hi)] for lo, hi in lists])
            new = np.unique(read)
            new = new[~self.seen[new]]
            depth, step = depth + step, step * 2
            if len(new):
                self.seen[new] = True
                met.append(new)
                found, places = self.look_up(new, self.slot)
                self.marked[places] = True
                ids, scores = np.concatenate((ids, self.ids[new])), np.concatenate((scores, found))
                first = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[first], scores[first]
                if len(scores) == k:
                    kth = max(floor, int(scores[-1]))
            most = 0
            for n, (lo, hi) in enumerate(lists):
                rest = self.marked[best_at[n]:hi]
                gap = int(rest.argmin()) if len(rest) else 0
                best_at[n] = hi if not len(rest) or rest[gap] else best_at[n] + gap
                # Impact at the best position; a list that is marked throughout holds no unseen document.
                if best_at[n] < hi:
                    most += int(self.listed_impact[max(best_at[n] - 1, lo)])
            if most < kth or most == 0:
                break
        self.slot[terms] = False
        for lo, hi in lists:
            self.marked[lo:hi] = False
        looked = np.concatenate(met) if met else np.zeros(0, np.int64)
        self.seen[looked] = False
        good = scores > 0
        return ids[good], scores[good], len(looked)


def impacts(sizes: np.ndarray, bounds: np.ndarray, terms: np.ndarray, tfs: np.ndarray, weights: np.ndarray, n_docs: int, length: int) -> np.ndarray:
    """What each entry adds to a score; whole numbers of 64 bits throughout."""
    m = 50 + (50 * sizes * n_docs) // length
    return weights[terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 20 * np.repeat(m, np.diff(bounds))))


def _shards(batches: Iterator[pa.RecordBatch], weights: np.ndarray, n_docs: int, length: int) -> Iterator[Shard]:
    held, size = [], 0

    def close() -> Shard:
        table = pa.Table.from_batches(held).combine_chunks()
        lists, counts = table["terms"].combine_chunks(), table["tfs"].combine_chunks()
        bounds = lists.offsets.to_numpy().astype(np.int64)
        bounds, terms = bounds - bounds[0], lists.flatten().to_numpy().astype(np.int64)
        sizes, tfs = table["n"].to_numpy(), counts.flatten().to_numpy()
        ids = table["id"].fill_null(_NO_ID).to_numpy()
        # A document without an id comes after all others.
        ids = np.where(ids == _NO_ID, -(_NO_ID + 1), ids) if table["id"].null_count else ids
        return Shard(ids, bounds, terms, impacts(sizes, bounds, terms, tfs, weights, n_docs, length), len(weights))

    for batch in batches:
        rows = np.concatenate(([0], np.cumsum(np.diff(batch.column("terms").offsets.to_numpy()), dtype=np.int64)))
        lo = 0
        while lo < len(batch):
            hi = max(lo + 1, int(np.searchsorted(rows, rows[lo] + SHARD_POSTINGS - size, "right")) - 1)
            held.append(batch.slice(lo, hi - lo))
            size += int(rows[hi] - rows[lo])
            lo = hi
            if size >= SHARD_POSTINGS or lo < len(batch):
                yield close()
                held, size = [], 0
    if held:
        yield close()


def _ranked(counted: DataFrame, queries: list[np.ndarray], weights: np.ndarray, n_docs: int, length: int, k: int) -> DataFrame:
    """``(query, id, score)``: the best of every task."""
    shipped = counted.sparkSession.sparkContext.broadcast((queries, weights))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, value = shipped.value
        none = np.zeros(0, np.int64)
        kept = [(none, none)] * len(asked)
        for shard in _shards(batches, value, n_docs, length):
            for at, terms in enumerate(asked):
                ids, scores = kept[at]
                floor = int(scores[-1]) if len(scores) == k else 0
                more, found, _ = shard.best(terms, k, floor)
                if len(more):
                    ids, scores = np.concatenate((ids, more)), np.concatenate((scores, found))
                    first = np.lexsort((ids, -scores))[:k]
                    kept[at] = ids[first], scores[first]
        for at, (ids, scores) in enumerate(kept):
            missing = ids == -(_NO_ID + 1)
            yield pa.record_batch({
                "query": pa.array(np.full(len(ids), at, np.int32)), "id": pa.array(ids, mask=missing), "score": pa.array(scores),
            })

    # No rows without a term asked for.
    return counted.where(F.size("terms") > 0).mapInArrow(rows, "query int, id long, score long")


def search(
    docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_id_col: str, item_text_col: str, limit: int = 50,
) -> DataFrame:
    """``(item_id, rank, id, score)``: for every item its ``limit`` best documents with a score above zero.

    Ids of documents are whole numbers.  Ties go to the smaller id, documents without an id come last.  Rows that repeat
    a document are documents of their own, in counts and in ranks.  Items whose text is NULL, empty or without terms
    find nothing; items that repeat an id, NULL among them, are one item with the terms of all their rows.  Empty tables
    give no rows.  Items are taken in blocks by a hash of their id, so that a block holds about ``BLOCK_TERMS`` terms;
    every block reads all documents.
    """
    kind = items.schema[item_id_col].dataType.simpleString()
    wanted = store(_item_terms(items, item_id_col, item_text_col), "item-terms")
    n_blocks = -(-wanted.count() // BLOCK_TERMS) if limit > 0 else 0
    result = None
    for block in range(n_blocks):
        asked = wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == block).groupBy("item_id").agg(F.array_sort(F.collect_list("term")).alias("terms"))
        asked = asked.toArrow()
        if not asked.num_rows:
            continue
        terms = sorted({term for row in asked["terms"].to_pylist() for term in row})
        number = {bytes(term): at for at, term in enumerate(terms)}
        queries = [np.array([number[bytes(term)] for term in row], np.int64) for row in asked["terms"].to_pylist()]
        counted = store(_count(docs, id_col, text_col, list(number)), "term-counts")
        facts = counted.agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("length")).first()
        held = counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).toArrow()
        weights = np.zeros(len(terms), np.int64)
        for term, df in zip(held["term"].to_pylist(), held["df"].to_pylist(), strict=True):
            weights[term] = term_weight(facts.n_docs, df)
        found = _ranked(counted, queries, weights, facts.n_docs, facts.length or 1, limit)
        names = docs.sparkSession.createDataFrame(
            pa.table({"query": pa.array(range(len(queries)), pa.int32()), "item_id": asked["item_id"]}), f"query int, item_id {kind}"
        )
        part = _top(found, limit).join(F.broadcast(names), "query").select("item_id", "rank", "id", "score")
        result = part if result is None else result.unionByName(part)
    if result is None:
        return docs.sparkSession.createDataFrame([], f"item_id {kind}, rank int, id long, score long")
    return result


def _top(found: DataFrame, limit: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
