"""A term index that grows: immutable segments, merged when equal in size; weights come about when a query is asked.

A segment holds what never changes with later documents: ``postings(doc_id, term, tf)`` in ranges of (term, document),
``terms(term, df, total_tf)``, a term in one row or several, and ``docs(doc_id, n_terms)``.  Document frequencies of the
whole are sums over segments, and idf is applied to the terms of a query.  Only the norms of documents depend on everything; each generation writes
them anew, two numbers a document, from postings that it reads and does not touch.

A generation is a row for each of its segments in the ``generations`` table, written last: what stops before that
leaves the previous generation in force.  One writer at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions import words
from quern.operators.retrieve import numbered, only_terms, summed, top_k
from quern.operators.skew import HOT_KEYS, MIN_HOT_ROWS, broadcast_if_small, lookup_join, settle
from quern.operators.tfidf import WORDS, Analyzer, TextIndex, document_sums, smooth_idf, term_counts, tokens
from quern.sources.tables import store

# So many segments of one size class become one; a class spans as large a factor in documents.
FANOUT = 4
GENERATIONS = "generation long, segment string, n_docs long"


@dataclass(frozen=True)
class Segment:
    name: str
    n_docs: int
    postings: DataFrame
    terms: DataFrame
    docs: DataFrame


@dataclass(frozen=True)
class GrowingIndex:
    """``norms(doc_id, norm)`` and ``vocabulary``, the terms of all documents, are missing until the generation is refreshed."""

    spark: SparkSession
    folder: str
    generation: int
    segments: tuple[Segment, ...]
    analyzer: Analyzer
    norms: DataFrame | None = None
    vocabulary: DataFrame | None = None

    @property
    def n_docs(self) -> int:
        return sum(segment.n_docs for segment in self.segments)


def _write(df: DataFrame, path: str, sort_by: Sequence[str] = ()) -> DataFrame:
    if sort_by:
        df = df.repartitionByRange(*sort_by).sortWithinPartitions(*sort_by)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def create(spark: SparkSession, folder: str, analyzer: Analyzer = WORDS) -> GrowingIndex:
    """An index without documents; ``folder`` is one that every executor reaches."""
    spark.createDataFrame([], GENERATIONS).write.parquet(f"{folder}/generations")
    return GrowingIndex(spark, folder, 0, (), analyzer)


def open_index(spark: SparkSession, folder: str, analyzer: Analyzer = WORDS) -> GrowingIndex:
    """The last generation that was committed."""
    rows = spark.read.schema(GENERATIONS).parquet(f"{folder}/generations")
    latest = rows.agg(F.max("generation").alias("g")).first().g
    if latest is None:
        return GrowingIndex(spark, folder, 0, (), analyzer)
    segments = []
    for row in rows.where(F.col("generation") == latest).orderBy(F.desc("n_docs"), "segment").collect():
        tables = [spark.read.parquet(f"{folder}/{row.segment}/{kind}") for kind in ("postings", "terms", "docs")]
        segments.append(Segment(row.segment, row.n_docs, *tables))
    return refresh(GrowingIndex(spark, folder, latest, tuple(segments), analyzer))


def _segment(folder: str, counts: DataFrame, docs: DataFrame) -> Segment:
    """Write a segment; its frequencies come from what was written."""
    name = f"segment-{uuid.uuid4().hex[:12]}"
    path = f"{folder}/{name}"
    # Ranges are cut by a sample, which would count all terms twice.
    counts = store(counts.select("doc_id", "term", "tf"), "segment-counts")
    postings = _write(counts, f"{path}/postings", ["term", "doc_id"])
    # Postings are in order of terms; where a term goes on in another batch or file, it has another row.
    postings.select("term", "tf").mapInArrow(words.term_runs, "term string, df long, total_tf long").write.parquet(f"{path}/terms")
    terms = counts.sparkSession.read.parquet(f"{path}/terms")
    sizes = document_sums(postings, F.lit(0.0)).select("doc_id", F.col("n").alias("n_terms"))
    known = docs.select("doc_id").join(sizes, "doc_id", "left").select("doc_id", F.coalesce("n_terms", F.lit(0)).alias("n_terms"))
    written = _write(known, f"{path}/docs", ["doc_id"])
    return Segment(name, written.count(), postings, terms, written)


def _merged(index: GrowingIndex, parts: Sequence[Segment]) -> Segment:
    """One segment of several: postings are put in order once more, frequencies added."""
    name = f"segment-{uuid.uuid4().hex[:12]}"
    path = f"{index.folder}/{name}"
    postings = _write(reduce(DataFrame.unionByName, [part.postings for part in parts]), f"{path}/postings", ["term", "doc_id"])
    terms = _write(_added([part.terms for part in parts]), f"{path}/terms", ["term"])
    docs = _write(reduce(DataFrame.unionByName, [part.docs for part in parts]), f"{path}/docs", ["doc_id"])
    return Segment(name, sum(part.n_docs for part in parts), postings, terms, docs)


def _added(tables: Sequence[DataFrame]) -> DataFrame:
    """Document frequencies of some segments as one, a row for each term."""
    rows = reduce(DataFrame.unionByName, tables)
    return rows.groupBy("term").agg(F.sum("df").cast("bigint").alias("df"), F.sum("total_tf").cast("bigint").alias("total_tf"))


def size_class(n_docs: int, fanout: int = FANOUT) -> int:
    """How often ``fanout`` goes into a size."""
    at = 0
    while n_docs >= fanout:
        n_docs //= fanout
        at += 1
    return at


def _compacted(index: GrowingIndex, segments: list[Segment], fanout: int) -> list[Segment]:
    while True:
        classes: dict[int, list[Segment]] = {}
        for segment in segments:
            classes.setdefault(size_class(segment.n_docs, fanout), []).append(segment)
        full = next((parts for _, parts in sorted(classes.items()) if len(parts) >= fanout), None)
        if full is None:
            return segments
        segments = [segment for segment in segments if segment not in full] + [_merged(index, full)]


def add(index: GrowingIndex, docs: DataFrame, id_col: str, text_col: str, fanout: int = FANOUT, norms: bool = True) -> GrowingIndex:
    """The next generation: the documents as a new segment, and merges where sizes call for them.

    Ids must be new and unique; others are an error, and nothing is committed.  ``norms=False`` leaves them to a later
    :func:`refresh`, for several additions in a row.
    """
    known = docs.select(F.col(id_col).alias("doc_id"))
    for segment in index.segments:
        if not known.join(segment.docs, "doc_id", "left_semi").isEmpty():
            raise ValueError("some documents are in the index already")
    counts = term_counts(tokens(docs, id_col, text_col, index.analyzer), index.analyzer)
    fresh = _segment(index.folder, counts, known)
    if fresh.docs.select("doc_id").distinct().count() < fresh.n_docs:
        raise ValueError("some documents come twice")
    segments = _compacted(index, [*index.segments, fresh] if fresh.n_docs else list(index.segments), fanout)
    grown = replace(index, generation=index.generation + 1, segments=tuple(segments), norms=None, vocabulary=None)
    rows = [(grown.generation, segment.name, segment.n_docs) for segment in segments]
    index.spark.createDataFrame(rows, GENERATIONS).coalesce(1).write.mode("append").parquet(f"{index.folder}/generations")
    return refresh(grown) if norms else grown


def terms(index: GrowingIndex) -> DataFrame:
    """``(term, df, total_tf, idf)`` of all documents."""
    if index.vocabulary is not None:
        return index.vocabulary
    counted = _added([segment.terms for segment in index.segments])
    return counted.withColumn("idf", smooth_idf(F.col("df"), index.n_docs))


def _weighted(index: GrowingIndex, vocabulary: DataFrame | None = None) -> DataFrame:
    """``(doc_id, term, tf, raw)`` of all postings, by a join that hot terms do not unbalance."""
    vocabulary = terms(index) if vocabulary is None else vocabulary
    rows = reduce(DataFrame.unionByName, [segment.postings for segment in index.segments])
    hot = vocabulary.where(F.col("df") >= MIN_HOT_ROWS).orderBy(F.desc("df"), "term").limit(HOT_KEYS)
    joined = lookup_join(rows, vocabulary.select("term", "idf"), ["term"], hot=hot.select("term"))
    return joined.select("doc_id", "term", "tf", (F.col("tf") * F.col("idf")).alias("raw"))


def refresh(index: GrowingIndex) -> GrowingIndex:
    """The same generation with the norms of its documents."""
    if index.norms is not None or not index.segments:
        return index
    # Frequencies are added up once, not for every part of the join and not for every pass over all postings.
    vocabulary = store(terms(index), "idf")
    weighted = _weighted(index, vocabulary)
    squares = document_sums(weighted, F.col("raw") * F.col("raw")).select("doc_id", F.sqrt("total").alias("norm"))
    path = f"{index.folder}/norms/{index.generation}-{uuid.uuid4().hex[:12]}"
    return replace(index, norms=_write(squares, path, ["doc_id"]), vocabulary=vocabulary)


def search(
    index: GrowingIndex, queries: DataFrame | str, limit: int = 5, id_col: str = "query_id", text_col: str = "query"
) -> DataFrame:
    """Ranked documents ``(query_id, doc_id, score, rank)``, as a search of one index over all documents has them."""
    if not index.segments:
        return index.spark.createDataFrame([], "query_id long, doc_id long, score double, rank int")
    if index.norms is None:
        raise ValueError("this generation has no norms yet; refresh it")
    few = isinstance(queries, str)
    if few:
        queries = index.spark.range(1).select(F.col("id").alias("query_id"), F.lit(queries).alias("query"))
        id_col, text_col = "query_id", "query"
    counted = term_counts(
        tokens(queries.select(F.col(id_col).alias("query_id"), F.col(text_col).alias("query")), "query_id", "query", index.analyzer).withColumnRenamed("doc_id", "query_id"),
        index.analyzer, key="query_id",
    )
    counts, wanted = settle(counted, "query-terms", few)
    # Every segment is asked for the query's terms alone, before frequencies are added up.
    asked = counts.select("term").distinct()
    asked = F.broadcast(asked) if wanted is not None else broadcast_if_small(asked)
    vocabulary = _added([only_terms(segment.terms, wanted).join(asked, "term", "left_semi") for segment in index.segments])
    vectors = vocabulary.withColumn("idf", smooth_idf(F.col("df"), index.n_docs)).join(counts, "term").withColumn("raw", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("query_id")))
    # The idf of a posting goes with the query's weight.
    vectors = vectors.select("query_id", "term", (F.col("raw") / norm * F.col("idf")).alias("factor"))
    vectors, wanted = settle(vectors, "query-vectors", few)
    if wanted is not None and wanted.num_rows and not few:
        queries, numbers = numbered(wanted, "factor", index.spark)
        matched = [segment.postings.join(numbers, "term").select("doc_id", "number", "tf") for segment in index.segments]
        weighed = reduce(DataFrame.unionByName, matched).join(index.norms, "doc_id")
        return top_k(summed(weighed.select("doc_id", "number", (F.col("tf") / F.col("norm")).alias("weight")), queries, vectors, limit), limit)
    matched = [only_terms(segment.postings, wanted).join(vectors, "term").select("query_id", "doc_id", (F.col("factor") * F.col("tf")).alias("part")) for segment in index.segments]
    # A document is in one segment, so each sums up its own.
    added = [part.groupBy("query_id", "doc_id").agg(F.sum("part").alias("raw")) for part in matched]
    scored = reduce(DataFrame.unionByName, added).join(index.norms, "doc_id")
    return top_k(scored.select("query_id", "doc_id", (F.col("raw") / F.col("norm")).alias("score")).where(F.col("score") > 0), limit)


def as_text_index(index: GrowingIndex) -> TextIndex:
    """The tables that one build over all documents would have, computed when read."""
    if index.norms is None:
        raise ValueError("this generation has no norms yet; refresh it")
    weighted = _weighted(index).join(index.norms, "doc_id").select("doc_id", "term", "tf", (F.col("raw") / F.col("norm")).alias("weight"))
    docs = reduce(DataFrame.unionByName, [segment.docs for segment in index.segments])
    known = docs.join(index.norms, "doc_id", "left").select("doc_id", "n_terms", F.coalesce("norm", F.lit(0.0)).alias("norm"))
    return TextIndex(weighted, terms(index), known, index.analyzer, weighted)
