"""Near-duplicate groups: fast similarity sketches, banding, and exact verification on full shingle sets.

The sketch places every shingle in one of ``bins`` bins with a fresh hash in each round, for at most twice as many
rounds as bins; in the second half, round ``i`` sends all shingles to bin ``i - bins``, so that every coordinate is
sure to fill, also for tiny sets.  A bin keeps the smallest value of the earliest round that reached it.  The share
of equal coordinates concentrates around the Jaccard similarity (Dahlgaard, Knudsen, Thorup 2017).

Steps, each written to the shared folder:

1. one row per document: set size, digest of the set, one byte of each coordinate, and the band hashes;
2. documents with equal digests form a class; from here on only the smallest member stands for it;
3. bands shared by several classes are buckets.  Star rounds compare each member with one centre per bucket, which
   takes as many pairs as members; components of the confirmed links are contracted;
4. the last round takes the buckets that hold members of several components.  Small ones give their pairs; large ones
   are looked through chunk by chunk, comparing wide sketches of members of different components and then their full
   sets, and only links that connect something new leave the task.  So no link between components is lost, groups that
   are already connected cost nothing more, and lookalikes that are not linked leave no rows;
5. a pair is confirmed on the full sets.  Before that it must pass two tests on its sketches: the sizes allow the
   similarity, and the share of equal coordinates is not more than six standard deviations below it.

Sets are never written: compressed texts travel to the pairs, a fraction of the size of their hashes, and the tasks
that compare them make the sets again.

With 40 bands of 5 coordinates a pair at similarity 0.8 shares no band with a probability of 1.2e-7.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import flat
from quern.llm.components import components
from quern.sources.tables import store

# Members of one centre that are joined in one task; larger stars are split over several.
SALT_ROWS = 256
# Members of a bucket that are compared in one go in the last round.
OPEN_ROWS = 1024
# Shingles that a task keeps of texts it has unpacked, to compare them again.
KEPT_VALUES = 1 << 22
# In the last round buckets up to this size give their pairs; larger ones are looked through in place.
FEW_ROWS = 8


@dataclass(frozen=True)
class Sketch:
    """Shingle width in words, similarity in per cent, and the banding."""

    words: int = 5
    percent: int = 80
    bands: int = 40
    rows: int = 5
    wide: int = 800

    @property
    def bins(self) -> int:
        return self.bands * self.rows

    def least(self, bins: int) -> int:
        """Equal coordinates below which a pair is not looked at: six standard deviations under the threshold.

        A pair at the threshold falls below that far more rarely than it shares no band.
        """
        share = self.percent / 100
        return int(bins * share - 6 * (bins * share * (1 - share)) ** 0.5)

    @property
    def least_equal(self) -> int:
        return self.least(self.bins)


def sets_of(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every document."""
    hashes, doc = flat.word_hashes(data, offsets)
    return flat.distinct(*flat.shingles(hashes, doc, len(offsets) - 1, words))


def sketch(values: np.ndarray, bounds: np.ndarray, bins: int) -> np.ndarray:
    """A row of ``bins`` (fewer than 1024) coordinates for every set; the rows of empty sets stay at the largest value."""
    n = len(bounds) - 1
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    state = np.full((n, bins), empty, np.uint64)
    left = np.flatnonzero(np.diff(bounds))
    owner, flat_state = flat.owners(bounds), state.ravel()
    for turn in range(2 * bins):
        if not len(left):
            break
        h = flat.mix(values ^ np.uint64((turn + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        value = (h >> np.uint64(11)) | np.uint64(turn << 53)
        if turn < bins:
            place = ((h & np.uint64(0xFFFFFFFF)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
            np.minimum.at(flat_state, owner * bins + place, value)
        else:
            sizes = np.diff(bounds)[left]
            begin = np.concatenate(([0], np.cumsum(sizes)))[:-1]
            column = state[left, turn - bins]
            state[left, turn - bins] = np.minimum(column, np.minimum.reduceat(value, begin))
        still = (state[left] == empty).any(axis=1)
        if not still.all():
            keep = np.zeros(n, dtype=bool)
            keep[left[still]] = True
            mask = keep[owner]
            values, owner, left = values[mask], owner[mask], left[still]
            bounds = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=n))))
    return state


def band_hashes(coordinates: np.ndarray, plan: Sketch) -> np.ndarray:
    """One hash for each band of every row of coordinates."""
    band = np.zeros((len(coordinates), plan.bands), np.uint64) + np.arange(1, plan.bands + 1, dtype=np.uint64)
    for row in range(plan.rows):
        band = flat.mix(band ^ coordinates[:, row::plan.rows])
    return band


def _sketch_batches(batches: Iterator[pa.RecordBatch], plan: Sketch) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = flat.utf8(batch.column(1))
        for lo, hi in flat.runs(offsets):
            part = offsets[lo:hi + 1] - offsets[lo]
            values, bounds = sets_of(data[offsets[lo]:offsets[hi]], part, plan.words)
            n, sizes = hi - lo, np.diff(bounds)
            coordinates = sketch(values, bounds, plan.bins)
            # Two sums over differently scrambled values tell whole sets apart.
            digest = []
            for seed in (1, 2):
                total = np.concatenate(([0], np.cumsum(flat.mix(values * np.uint64(2 * seed + 1) + np.uint64(seed)), dtype=np.uint64)))
                digest.append((total[bounds[1:]] - total[bounds[:-1]]).view(np.int64))
            band = band_hashes(coordinates, plan)
            low = flat.mix(coordinates).astype(np.uint8)
            full = np.flatnonzero(sizes)
            band_offsets = np.concatenate(([0], np.cumsum(np.where(sizes > 0, plan.bands, 0)))).astype(np.int32)
            yield pa.record_batch({
                "id": batch.column(0).slice(lo, hi - lo),
                "n_shingles": pa.array(sizes, pa.int64()),
                "digest_a": pa.array(digest[0]), "digest_b": pa.array(digest[1]),
                "low": pa.array([row.tobytes() for row in low], pa.binary()),
                "bands": pa.ListArray.from_arrays(pa.array(band_offsets), pa.array(band[full].ravel().view(np.int64))),
            })


def sketches(docs: DataFrame, id_col: str, text_col: str, plan: Sketch) -> DataFrame:
    """``(id, n_shingles, digest_a, digest_b, low, bands)`` of every document; empty ones have no bands."""
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        lambda batches: _sketch_batches(batches, plan),
        f"id {kind}, n_shingles long, digest_a long, digest_b long, low binary, bands array<long>",
    )


# Bits of the filter that tells which documents' texts are needed; its size is fixed, extra hits do no harm.
WANTED_BITS = 1 << 26


def _wanted(ids: DataFrame) -> np.ndarray:
    """A fixed-size bitmap of hashed ids, put together on the executors."""
    place = F.pmod(F.xxhash64("id"), F.lit(WANTED_BITS))
    words = ids.select(F.shiftright(place, 6).cast("int").alias("word"), F.expr("shiftleft(1L, cast(pmod(xxhash64(id), 64) as int))").alias("bit"))
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(WANTED_BITS // 64, np.int64)
    bits[found["word"].to_numpy()] = found["bits"].to_numpy()
    return bits


def _marked(keys: pa.Array, bits: np.ndarray) -> pa.Array:
    key = keys.to_numpy(zero_copy_only=False)
    return pa.array(((bits[(key % WANTED_BITS) >> 6] >> (key % 64)) & 1).astype(bool))


def _only(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of the ids that are wanted, and a few others; spares the shuffle of the rest."""
    bits = rows.sparkSession.sparkContext.broadcast(_wanted(ids))
    return rows.where(F.arrow_udf(lambda keys: _marked(keys, bits.value), "boolean")(F.xxhash64("id")))


def _packed_batches(batches: Iterator[pa.RecordBatch], bits) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        batch = batch.filter(_marked(batch.column(2), bits.value))
        data, offsets = flat.utf8(batch.column(1))
        for lo, hi in flat.runs(offsets):
            packed = [pack.compress(data[a:b].tobytes()) for a, b in zip(offsets[lo:hi].tolist(), offsets[lo + 1:hi + 1].tolist())]
            yield pa.record_batch({"id": batch.column(0).slice(lo, hi - lo), "packed": pa.array(packed, pa.binary())})


def packed_texts(docs: DataFrame, id_col: str, text_col: str, ids: DataFrame) -> DataFrame:
    """``(id, packed)``: compressed texts of the documents in ``ids`` and of a few others."""
    bits = docs.sparkSession.sparkContext.broadcast(_wanted(ids))
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(id_col).alias("key")
    ).mapInArrow(lambda batches: _packed_batches(batches, bits), f"id {kind}, packed binary")


def _unpacked(packed: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of packed texts, and where each begins and ends in them."""
    unpack = zstandard.ZstdDecompressor()
    # The content size is in every frame; an empty text has an empty frame.
    texts = [unpack.decompress(frame) for frame in packed]
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(text) for text in texts], dtype=np.int64)))


class _Sets:
    """Sets of packed texts, made when asked for and kept up to a fixed number of shingles."""

    def __init__(self, words: int) -> None:
        self.words, self.kept, self.values = words, {}, 0

    def __getitem__(self, packed: bytes) -> np.ndarray:
        found = self.kept.get(packed)
        if found is None:
            found = sets_of(*_unpacked([packed]), self.words)[0]
            if self.values + len(found) > KEPT_VALUES:
                self.kept, self.values = {}, 0
            self.kept[packed] = found
            self.values += len(found)
        return found

    def linked(self, a: bytes, b: bytes, percent: int) -> bool:
        """Whether the full sets of two texts reach the similarity."""
        left, right = self[a], self[b]
        both = np.concatenate((left, right))
        both.sort(kind="stable")
        common = int((both[1:] == both[:-1]).sum())
        return 100 * common >= percent * (len(both) - common)


def _with_both(pairs: DataFrame, rows: DataFrame, columns: list[str]) -> DataFrame:
    """Join ``columns`` of ``rows`` (unique by id) to both ends of ``pairs``; an end with very many pairs is split up."""
    load = pairs.groupBy("b").count().where(F.col("count") > SALT_ROWS).select(
        "b", F.ceil(F.col("count") / SALT_ROWS).cast("int").alias("parts")
    )
    load = store(load, "load")
    left = rows.select(F.col("id").alias("a"), *(F.col(c).alias(f"a_{c}") for c in columns))
    right = rows.select(F.col("id").alias("b"), *(F.col(c).alias(f"b_{c}") for c in columns))
    if load.isEmpty():
        return pairs.join(left, "a").join(right, "b")
    dealt = pairs.join(load, "b", "left").withColumn("part", F.pmod(F.xxhash64("a"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    copies = right.join(load, "b", "left").withColumn("part", F.explode(F.expr("sequence(0, coalesce(parts, 1) - 1)"))).drop("parts")
    return dealt.join(left, "a").join(copies, ["b", "part"]).drop("part")


def _equal(a: pa.Array, b: pa.Array) -> pa.Array:
    """Equal bytes of two sketches."""
    if not len(a):
        return pa.array([], pa.int32())
    left, right = (np.frombuffer(b"".join(side.to_pylist()), np.uint8).reshape(len(a), -1) for side in (a, b))
    return pa.array((left == right).sum(axis=1), pa.int32())


def _likely(pairs: DataFrame, rows: DataFrame, plan: Sketch) -> DataFrame:
    """Pairs whose sketches and sizes leave room for a link."""
    both = _with_both(pairs, rows, ["n_shingles", "low"]).where(
        f"100 * least(a_n_shingles, b_n_shingles) >= {plan.percent} * greatest(a_n_shingles, b_n_shingles)"
    )
    equal = F.arrow_udf(_equal, "int")
    return store(both.where(equal("a_low", "b_low") >= plan.least_equal).select("a", "b"), "likely")


def _confirmed(pairs: DataFrame, texts: DataFrame, plan: Sketch, few: bool = True) -> DataFrame:
    """Pairs that are links.  ``few`` says that many texts are in no pair, and had better not be shuffled."""
    if few:
        texts = store(_only(texts, pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id")))), "texts-in-pairs")

    def linked(a: pa.Array, b: pa.Array) -> pa.Array:
        sets = _Sets(plan.words)
        return pa.array([sets.linked(x.as_py(), y.as_py(), plan.percent) for x, y in zip(a, b)], pa.bool_())

    both = _with_both(pairs, texts, ["packed"])
    return store(both.where(F.arrow_udf(linked, "boolean")("a_packed", "b_packed")).select("a", "b"), "confirmed")


def groups(docs: DataFrame, id_col: str, text_col: str, plan: Sketch = Sketch()) -> DataFrame:
    """``(id, n_shingles, class_id, component_id)`` for every document.

    ``class_id`` is the smallest id with the same shingle set, ``component_id`` the smallest id reachable over links.
    Documents without words, and NULL texts, have size 0 and are linked with nothing.  Rows that
    repeat an id give a row each, and count as one document that has the links of all of them; a row with a NULL id is
    linked with nothing and keeps a NULL component.
    """
    table = store(sketches(docs, id_col, text_col, plan), "sketches")
    full = table.where("n_shingles > 0 AND id IS NOT NULL")
    classes = full.groupBy("digest_a", "digest_b", "n_shingles").agg(F.min("id").alias("class_id"), F.count("*").alias("n"))
    several = store(classes.where("n > 1").drop("n"), "classes")
    members = store(
        table.select("id", "n_shingles", "digest_a", "digest_b")
        .join(several, ["digest_a", "digest_b", "n_shingles"], "left")
        .select("id", "n_shingles", F.when(F.col("id").isNull() | (F.col("n_shingles") == 0), F.col("id")).otherwise(F.coalesce("class_id", "id")).alias("class_id")),
        "members",
    )
    first = full.join(several, ["digest_a", "digest_b", "n_shingles"], "left").where("class_id IS NULL OR class_id = id")
    first = first.select("id", "n_shingles", "low", "bands", "digest_a", "digest_b").dropDuplicates(["id", "digest_a", "digest_b"])
    first = store(first.drop("digest_a", "digest_b"), "first")
    # The classes that one repeated id stands in belong together.
    torn = members.groupBy("id").agg(F.min("class_id").alias("b"), F.max("class_id").alias("high")).where("b <> high").drop("high")
    same_id = members.join(torn, "id").select(F.col("class_id").alias("a"), "b")
    roots = components(links_between(docs, id_col, text_col, first, plan).unionByName(same_id))
    return (
        members.join(roots.withColumnRenamed("node", "class_id"), "class_id", "left")
        .select("id", "n_shingles", "class_id", F.coalesce("root", "class_id").alias("component_id"))
    )


def keep_first(docs: DataFrame, id_col: str, text_col: str, found: DataFrame) -> DataFrame:
    """Rows of ``docs`` that stand for their group in ``found``, with all their columns.

    Of rows that repeat an id the one with the smallest text stays.  Rows with a NULL id, and every id whose texts
    are empty, stand for themselves.
    """
    found = store(found.where("id IS NOT NULL").groupBy("id").agg(F.min("component_id").alias("root"), F.count("*").alias("n")), "found")
    later = found.where("id <> root").select(F.col("id").alias(id_col))
    repeated = found.where("id = root AND n > 1").select(F.col("id").alias(id_col))
    once = docs.join(later.unionByName(repeated), id_col, "left_anti").select(*docs.columns)
    first = (
        docs.join(repeated, id_col, "left_semi").groupBy(id_col)
        .agg(F.min_by(F.struct(*docs.columns), F.coalesce(F.col(text_col), F.lit(""))).alias("first")).select("first.*")
    )
    return once.unionByName(first)


def links_between(docs: DataFrame, id_col: str, text_col: str, first: DataFrame, plan: Sketch) -> DataFrame:
    """Links ``(a, b)`` that connect all classes that are linked, directly or over others, and no more."""
    entries = first.select("id", F.posexplode("bands").alias("place", "band"))
    stars = (
        entries.groupBy("band").agg(F.min("id").alias("centre"), F.max("id").alias("far"), F.min_by("id", F.xxhash64("id", "band")).alias("any"))
        .where("centre <> far").drop("far")
    )
    # One row for every class in every bucket of two or more.  The first centre is the same in most buckets of a
    # group, the second is another one in each.
    bucket = store(entries.join(store(stars, "stars"), "band"), "buckets")
    if bucket.isEmpty():
        return bucket.select(F.col("id").alias("a"), F.col("id").alias("b"))
    texts = store(packed_texts(docs, id_col, text_col, bucket.select("id")), "texts")
    marks = first.select("id", "n_shingles", "low")
    pairs = bucket.where("id <> centre").select(F.col("id").alias("a"), F.col("centre").alias("b")).distinct()
    done = components(_confirmed(_likely(store(pairs, "pairs"), marks, plan), texts, plan))
    pairs = bucket.where("id <> any").select(F.least("id", "any").alias("a"), F.greatest("id", "any").alias("b"))
    pairs = store(_apart(pairs, done).distinct(), "pairs")
    links = _star(done).unionByName(_confirmed(_likely(pairs, marks, plan), texts, plan))
    done = components(links)
    labelled = bucket.join(done.withColumnRenamed("node", "id"), "id", "left").select(
        "band", "place", "id", F.coalesce("root", "id").alias("root")
    )
    labelled = store(labelled, "labelled")
    mixed = labelled.groupBy("band").agg(
        F.min("root").alias("low"), F.max("root").alias("high"), F.ceil(F.count("*") / OPEN_ROWS).cast("int").alias("chunks"),
        F.count("*").alias("n"),
    ).where("low <> high").select("band", "chunks", "n")
    rows = store(labelled.join(store(mixed, "mixed"), "band"), "open")
    small = store(_small_pairs(rows.where(F.col("n") <= FEW_ROWS)), "pairs")
    rows = rows.where(F.col("n") > FEW_ROWS)
    wide = _only(texts, rows.select("id")).mapInArrow(
        lambda batches: _wide_batches(batches, plan), f"id {rows.schema['id'].dataType.simpleString()}, n int, bands binary, wide binary, packed binary"
    )
    found = _confirmed(_likely(small, marks, plan), texts, plan).unionByName(_open_links(rows, store(wide, "wide"), plan))
    return _star(done).unionByName(found)


def _small_pairs(rows: DataFrame) -> DataFrame:
    """Pairs of different components in buckets of a few rows, each once."""
    members = rows.groupBy("band").agg(F.sort_array(F.collect_list(F.struct("id", "root"))).alias("m"))
    pairs = members.select(F.explode(F.expr(
        "flatten(transform(m, (x, i) -> transform(filter(slice(m, i + 2, size(m)), y -> y.root <> x.root), y -> struct(x.id AS a, y.id AS b))))"
    )).alias("pair"))
    return pairs.select("pair.*").where("a <> b").distinct()


def _star(done: DataFrame) -> DataFrame:
    """Links that connect each component over its root."""
    return done.select(F.col("node").alias("a"), F.col("root").alias("b"))


def _wide_batches(batches: Iterator[pa.RecordBatch], plan: Sketch) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lo = 0
        while lo < len(batch):
            # Texts are unpacked up to a fixed number of rows and packed bytes.
            sizes = np.cumsum([len(batch.column(1)[at].as_buffer()) for at in range(lo, min(lo + 256, len(batch)))])
            rows = max(1, int(np.searchsorted(sizes, flat.RUN_BYTES // 4, "right")))
            part = batch.slice(lo, rows)
            lo += rows
            values, bounds = sets_of(*_unpacked(part.column(1).to_pylist()), plan.words)
            bands = band_hashes(sketch(values, bounds, plan.bins), plan)
            wide = flat.mix(sketch(values, bounds, plan.wide)).astype(np.uint8)
            yield pa.record_batch({
                "id": part.column(0), "n": pa.array(np.diff(bounds).astype(np.int32)),
                "bands": pa.array([row.tobytes() for row in bands], pa.binary()), "wide": pa.array([row.tobytes() for row in wide], pa.binary()),
                "packed": part.column(1),
            })


def _open_links(rows: DataFrame, wide: DataFrame, plan: Sketch) -> DataFrame:
    """Links of a bucket between different components, as many as it takes to connect them.

    A bucket is cut into chunks, and each pair of chunks is looked through by itself, so no task holds a whole one.
    """
    chunk = F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")
    dealt = rows.select("band", "place", "id", "root", chunk.alias("chunk"), F.explode(F.expr("sequence(0, chunks - 1)")).alias("other"))
    dealt = dealt.select("band", "place", "id", "root", "chunk", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"))
    dealt = dealt.join(wide, "id").repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")
    kind = rows.schema["id"].dataType.simpleString()
    names = ("band", "i", "j", "place", "chunk", "id", "root", "n", "bands", "wide", "packed")
    return store(dealt.select(*names).mapInArrow(lambda batches: _open_batches(batches, plan), f"a {kind}, b {kind}").distinct(), "open-links")


def _open_batches(batches: Iterator[pa.RecordBatch], plan: Sketch) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    kind = None
    for batch in batches:
        kind = batch.schema.field("id").type
        keys = np.stack([np.asarray(batch.column(k)).astype(np.int64) for k in range(3)])
        cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        edges = [0, *cuts.tolist(), len(batch)]
        for lo, hi in zip(edges, edges[1:]):
            part = batch.slice(lo, hi - lo)
            if held and any(held[-1].column(k)[0] != part.column(k)[0] for k in range(3)):
                yield from _compare_group(held, plan, kind)
                held = []
            held.append(part)
    if held:
        yield from _compare_group(held, plan, kind)


def _compare_group(parts: list[pa.RecordBatch], plan: Sketch, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(parts).combine_chunks()
    if len(table) < 2:
        return
    chunk, n = table["chunk"].to_numpy(), table["n"].to_numpy().astype(np.int64)
    roots = np.unique(np.array(table["root"].to_pylist()), return_inverse=True)[1]
    place, i, j = (table[name][0].as_py() for name in ("place", "i", "j"))
    bands, wide = (
        np.frombuffer(b"".join(table[name].to_pylist()), form).reshape(len(table), -1) for name, form in (("bands", np.uint64), ("wide", np.uint8))
    )
    left = np.flatnonzero(chunk == i)
    right = np.flatnonzero(chunk == j)
    packed, sets = table["packed"].combine_chunks(), _Sets(plan.words)
    found: list[tuple[int, int]] = []
    for a in left.tolist():
        b = right[right > a] if i == j else right
        b = b[(roots[b] != roots[a]) & (100 * np.minimum(n[b], n[a]) >= plan.percent * np.maximum(n[b], n[a]))]
        if not len(b):
            continue
        # A pair is taken in the first band that it shares, and left alone in the others.  The hashes are those that the
        # buckets are made of, so both ends do stand in that band's bucket.
        shared = bands[b] == bands[a]
        b = b[(shared.argmax(axis=1) == place) & shared[:, place]]
        if len(b):
            b = b[(wide[b] == wide[a]).sum(axis=1) >= plan.least(plan.wide)]
        for other in b.tolist():
            # What a link has just connected needs no second one.
            if roots[other] != roots[a] and sets.linked(packed[a].as_py(), packed[other].as_py(), plan.percent):
                roots[roots == roots[other]] = roots[a]
                found.append((a, other))
    if found:
        ids = table["id"].combine_chunks()
        a, b = (ids.take(pa.array([pair[side] for pair in found])).cast(kind) for side in (0, 1))
        yield pa.record_batch({"a": a, "b": b})


def _apart(pairs: DataFrame, done: DataFrame) -> DataFrame:
    """Pairs whose ends are not yet in one component."""
    for end in ("a", "b"):
        pairs = pairs.join(done.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root")), end, "left")
    return pairs.where("coalesce(a_root, a) <> coalesce(b_root, b)").select("a", "b")
