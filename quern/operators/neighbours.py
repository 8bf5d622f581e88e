"""The most similar documents of every document: an exact cosine join without a cap on frequent terms.

Documents with equal vectors are one class, and only classes are compared.  The terms of a class are put in one
order, rarest first.  Two documents whose first common term stands at places i and j of their vectors can score no
more than the norm of the one from i on times the norm of the other from j on.  So once a class knows a score that
enough others reach (its floor), it need only meet classes through terms where that product reaches the floor:
frequent terms, which come last, drop out.  What has met is bounded once more by the sum so far and the norms that
are left, and only pairs that pass are compared in full.  All of this happens between two blocks of vectors at a time,
inside a task, so neither meetings nor vectors of pairs are shuffled; only scores of pairs that passed the bounds leave it.

Floors come from pairs that share a rare term and from the documents in which a frequent term weighs most, a few for
each term, so that they cost a fixed multiple of the index.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf
from pyspark.sql.window import Window

from quern.functions import blocks, words
from quern.operators.retrieve import MARGIN, best_rows, ranking_key
from quern.operators.skew import HOT_KEYS, MIN_HOT_ROWS, lookup_join
from quern.operators.tfidf import TextIndex
from quern.sources.tables import store

# Terms in no more documents than this show candidates for the floors with all their postings; of more frequent ones
# the heaviest postings do, for as many terms of each document.
SEED_DOCS = 16
SEED_TERMS = 8
# Pairs meet through terms down to this share of the floor; what is left after them can add no more than that.
SHARE = 0.5


@arrow_udf(T.DoubleType())
def _dots(left_keys: pa.Array, left: pa.Array, right_keys: pa.Array, right: pa.Array) -> pa.Array:
    return words.sparse_dots(left_keys, left, right_keys, right)


@dataclass(frozen=True)
class Neighbours:
    """``found(query_id, doc_id, score, rank)``, and ``pairs(step, n)``: how many pairs each step made."""

    found: DataFrame
    pairs: DataFrame


def _classes(index: TextIndex, limit: int) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, rep)`` of every document with terms, and ``(rep, members)`` with the first ``limit + 1`` of each class.

    Vectors are equal if their terms and counts are, told by two 64-bit hashes and two counts.
    """
    facts = index.vectors.groupBy("doc_id").agg(
        F.bit_xor(F.xxhash64("term", "tf")).alias("one"), F.bit_xor(F.xxhash64("tf", F.lit(7), "term")).alias("two"),
        F.count(F.lit(1)).alias("n"), F.sum("tf").alias("length"),
    )
    key = F.struct("one", "two", "n", "length")
    keyed = store(facts.select("doc_id", F.sha2(F.to_json(key), 256).alias("class")), "classes")
    first = best_rows(keyed, "class", [F.col("doc_id")], limit + 1, "doc_id")
    named = first.groupBy("class").agg(F.min("doc_id").alias("rep"), F.array_sort(F.collect_list("doc_id")).alias("members"))
    named = store(named, "class-members")
    return store(lookup_join(keyed, named.select("class", "rep"), ["class"]).select("doc_id", "rep"), "members"), named.select("rep", "members")


def _placed(index: TextIndex, reps: DataFrame) -> DataFrame:
    """``(rep, term, df, weight)`` of the vectors that stand for a class."""
    rows = store(index.vectors.join(reps.withColumnRenamed("rep", "doc_id"), "doc_id").select(F.col("doc_id").alias("rep"), "term", "weight"), "reps")
    hot = index.terms.where(F.col("df") >= MIN_HOT_ROWS).orderBy(F.desc("df"), "term").limit(HOT_KEYS)
    rows = lookup_join(rows, index.terms.select("term", "df"), ["term"], hot=hot.select("term"))
    return store(rows.select("rep", "term", "df", "weight"), "placed")


def _vectors(rows: DataFrame) -> DataFrame:
    """``(rep, keys, weights, dfs, places)`` with hashed terms in order, and the place of each among the terms from the rarest on."""
    entries = F.array_sort(F.collect_list(F.struct("df", "term", "weight")))
    named = F.transform(entries, lambda x, at: F.struct(F.xxhash64(x["term"]).alias("k"), x["weight"].alias("w"), x["df"].alias("d"), at.alias("p")))
    listed = rows.groupBy("rep").agg(F.array_sort(named).alias("v"))
    columns = {"keys": "k", "weights": "w", "dfs": "d", "places": "p"}
    return store(listed.select("rep", *(F.col(f"v.{field}").alias(name) for name, field in columns.items())), "sparse")


def _compared(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """``(rep, other, score)`` of pairs, by their whole vectors."""
    other = vectors.select(F.col("rep").alias("other"), F.col("keys").alias("other_keys"), F.col("weights").alias("other_weights"))
    both = pairs.select("rep", "other").join(vectors.select("rep", "keys", "weights"), "rep").join(other, "other")
    return both.select("rep", "other", _dots("keys", "weights", "other_keys", "other_weights").alias("score"))


def _floors(rows: DataFrame, asking: DataFrame, vectors: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """``(rep, floor)`` of classes that ``limit`` others reach so much of, and the pairs compared for it."""
    # A term of one document shows nobody else.
    seen = F.col("df").between(2, SEED_DOCS)
    rare, common = rows.where(seen), rows.where(F.col("df") > SEED_DOCS)
    mine = rows.join(asking, "rep", "left_semi")
    champions = best_rows(common, "term", [F.desc("weight"), F.col("rep")], limit + 1, "rep").drop("rank")
    heavy = best_rows(mine.where(F.col("df") > SEED_DOCS), "rep", [F.desc("weight"), F.col("term")], SEED_TERMS, "term").drop("rank")
    found = None
    for asked, shown in ((mine.where(seen), rare), (heavy, champions)):
        shown = shown.select("term", F.col("rep").alias("other"), F.col("weight").alias("other_weight"))
        met = asked.select("rep", "term", "weight").join(shown, "term").where(F.col("rep") != F.col("other"))
        part = met.select("rep", "other", (F.col("weight") * F.col("other_weight")).alias("part"))
        found = part if found is None else found.unionByName(part)
    likely = found.groupBy("rep", "other").agg(F.sum("part").alias("part"))
    likely = store(best_rows(likely, "rep", [F.desc("part"), F.col("other")], limit, "other").select("rep", "other"), "likely")
    scored = _compared(likely, vectors).groupBy("rep").agg(F.min("score").alias("floor"), F.count(F.lit(1)).alias("n"))
    return store(scored.where(F.col("n") == limit).select("rep", "floor"), "floors"), likely


def _met(vectors: DataFrame, lows: DataFrame) -> DataFrame:
    """``(rep, other, score)`` of pairs that may reach the ``low`` of ``rep``, and rows that count what ``met`` and was ``compared``.

    Vectors are packed into blocks, and every block that asks is held against every other by a product of the two tables,
    which reads them again and again but moves and writes neither.
    """
    kind, spark = vectors.schema["rep"].dataType.simpleString(), vectors.sparkSession
    named = vectors.join(lows, "rep", "left").select("rep", "keys", "dfs", "places", "weights", F.coalesce("low", F.lit(float("nan"))).alias("low"))
    packed = named.mapInArrow(blocks.pack, ", ".join(f"{name} {form.format(kind=kind)}" for name, form in blocks.COLUMNS.items()))
    packed = store(packed, "blocks")
    asking = packed.where(F.exists("lows", lambda low: ~F.isnan(low)))
    others = packed.select(*(F.col(name).alias(f"other_{name}") for name in blocks.COLUMNS if name != "lows"))
    share, compare, at_once = SHARE, blocks.compare, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(at_once)
    # A row is two blocks, some 32 MB.
    spark.conf.set(at_once, "1")
    try:
        both = asking.hint("shuffle_replicate_nl").crossJoin(others)
        found = both.mapInArrow(lambda batches: compare(batches, share), f"rep {kind}, other {kind}, score double, met long, compared long")
        return store(found, "met")
    finally:
        spark.conf.set(at_once, before)


def _count(pairs: DataFrame, step: str, n=None) -> DataFrame:
    return pairs.agg(F.lit(step).alias("step"), F.coalesce(F.count(F.lit(1)) if n is None else F.sum(n), F.lit(0)).cast("long").alias("n"))


def similar_all(index: TextIndex, limit: int = 5, queries: DataFrame | None = None, padded: bool = False) -> Neighbours:
    """The ``limit`` most similar documents of every document, or of those in ``queries(doc_id)``.

    Scores are cosines above zero; order is by score, then id, and no document is its own neighbour.  ``padded`` fills
    the rows of every known document up with the first unrelated documents at score zero.  Documents without terms, and
    unknown ids, have no neighbours.
    """
    if limit <= 0:
        raise ValueError("at least one neighbour must be wanted")
    members, classes = _classes(index, limit)
    rows = _placed(index, classes.select("rep"))
    vectors = _vectors(rows)
    asking = classes.select("rep", (F.size("members") > limit).alias("full"))
    if queries is not None:
        wanted = members.join(queries.select("doc_id").distinct(), "doc_id", "left_semi").select("rep").distinct()
        asking = asking.join(wanted, "rep", "left_semi")
    asking = store(asking, "asking")
    floors, likely = _floors(rows, asking.where(~F.col("full")).select("rep"), vectors, limit)
    # A class with more than ``limit`` members has a full list of its own; only vectors in its very direction matter.
    floors = floors.unionByName(asking.where("full").select("rep", F.lit(1.0).alias("floor")))

    low = F.coalesce("floor", F.lit(0.0)) - MARGIN
    met = _met(vectors, asking.select("rep").join(floors, "rep", "left").select("rep", low.alias("low")))
    scored = met.where(F.col("met").isNull()).select("rep", "other", "score")
    best = best_rows(scored, "rep", [ranking_key().desc(), F.col("other")], limit, "other").select("rep", "other", "score")

    # Each class shows its own members and those of its neighbours; a document leaves itself out.
    own = classes.select("rep", F.col("rep").alias("other"), F.lit(1.0).alias("score"))
    shown = best.unionByName(own).join(classes.withColumnRenamed("rep", "other"), "other")
    shown = shown.select("rep", F.explode("members").alias("doc_id"), "score")
    shown = best_rows(shown, "rep", [ranking_key().desc(), F.col("doc_id")], limit + 1, "doc_id")
    lists = shown.groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "score"))).alias("shown"))
    lists = store(lists, "lists")
    asked = members if queries is None else members.join(queries.select("doc_id").distinct(), "doc_id", "left_semi")
    found = lookup_join(store(asked, "asked"), lists, ["rep"]).select(F.col("doc_id").alias("query_id"), "shown")
    if padded:
        known = index.docs if queries is None else index.docs.join(queries.select("doc_id").distinct(), "doc_id", "left_semi")
        found = known.select(F.col("doc_id").alias("query_id")).join(found, "query_id", "left")
        found = found.withColumn("shown", F.coalesce("shown", F.array().cast(found.schema["shown"].dataType)))
        # At most ``limit + 1`` of the first documents are shown already.
        first = [row.doc_id for row in index.docs.select("doc_id").orderBy("doc_id").limit(2 * limit + 2).collect()]
        filler = F.array_except(F.array(*[F.lit(key) for key in first]), F.transform("shown", lambda x: x["doc_id"]))
        zero = F.transform(filler, lambda key: F.struct(F.lit(0).alias("rank"), key.alias("doc_id"), F.lit(0.0).alias("score")))
        found = found.withColumn("shown", F.concat("shown", zero.cast(found.schema["shown"].dataType)))
    others = F.slice(F.filter("shown", lambda x: x["doc_id"] != F.col("query_id")), 1, limit)
    found = found.select("query_id", F.posexplode(others).alias("at", "x"))
    found = found.select("query_id", F.col("x.doc_id").alias("doc_id"), F.col("x.score").alias("score"), (F.col("at") + 1).alias("rank"))
    possible = index.terms.agg(F.lit("sharing a term").alias("step"), F.sum(F.col("df") * F.col("df")).cast("long").alias("n"))
    pairs = possible.unionByName(_count(likely, "for floors")).unionByName(_count(met, "met", F.col("met"))).unionByName(_count(met, "compared", F.col("compared")))
    return Neighbours(found, pairs)
