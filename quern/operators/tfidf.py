"""Weighted term index over a document table.

The index is four tables: ``postings(doc_id, term, tf, weight, run)``, ``terms(term, df, total_tf, idf)``,
``docs(doc_id, n_terms, norm)`` and ``vectors``, the postings once more.  Documents are dealt into runs by a hash
of their id, and postings lie in ranges of terms, ordered by term, run and document: a term is in one file (beyond
``NORM_DOCS`` documents a frequent one may be in several), and a query reads only the row groups and
pages that can hold its terms and runs.  Vectors lie in ranges of (document, term), so one document's terms are read without touching the others.

A fifth table, ``blocks(term, run, most)``, has the largest weight that a term with many postings takes in each
run, the largest ``most`` if a run has several rows.  A search bounds the scores of whole runs with it, and then reads only runs that can hold a result.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quern.functions import fixed, text, words
from quern.operators.skew import at_most, broadcast_if_small
from quern.sources.tables import store


@dataclass(frozen=True)
class Analyzer:
    """How text becomes terms.  Stopwords go after tokenising (and stemming), so n-grams bridge them."""

    tokenizer: text.Tokenizer = text.word_tokens
    stopwords: Sequence[str] = ()
    smallest: int = 1
    largest: int = 2


WORDS = Analyzer()
STEMS = Analyzer(tokenizer=text.stem_tokens, stopwords=tuple(fixed.ENGLISH_STOPWORDS))


# Documents of a run, and the documents a term stands in from which on its blocks are kept.
RUN_DOCS = 512
LONG_TERM = 100_000
# Postings of a task, at most; small tables are divided among the cores.
PART_ROWS, SMALL_PART_ROWS = 1_500_000, 50_000
# Documents whose norms are sent to every executor: some 100 bytes each.
NORM_DOCS = 4_000_000
# Tasks for each core that add up the postings of documents; each of them passes on a sum for every document.
SUM_TASKS = 3


@dataclass(frozen=True)
class TextIndex:
    """``blocks`` is missing where no term has as many documents as ``long_term``."""

    postings: DataFrame
    terms: DataFrame
    docs: DataFrame
    analyzer: Analyzer
    vectors: DataFrame
    blocks: DataFrame | None = None
    long_term: int = LONG_TERM

    def vector(self, doc_id) -> DataFrame:
        return self.vectors.where(F.col("doc_id") == doc_id)

    def matched(self, numbers: DataFrame) -> DataFrame:
        """The postings of some terms, with the columns of ``numbers(term, …)``."""
        return self.postings.join(numbers, "term")


def tokens(docs: DataFrame, id_col: str, text_col: str, analyzer: Analyzer = WORDS) -> DataFrame:
    """One row per document with its token array."""
    found = docs.select(F.col(id_col).alias("doc_id"), analyzer.tokenizer(F.col(text_col)).alias("tokens"))
    if analyzer.stopwords:
        found = found.withColumn("tokens", text.without_words(F.col("tokens"), analyzer.stopwords))
    return found


def term_counts(tokenised: DataFrame, analyzer: Analyzer = WORDS, key: str = "doc_id") -> DataFrame:
    """``(key, term, tf)``.

    A document is one row, so its terms are counted where that row is.  Nothing is shuffled.
    """
    rows = tokenised.select(key, "tokens")
    kind = T.StructType([rows.schema[key], T.StructField("term", T.StringType()), T.StructField("tf", T.IntegerType())])
    count, sizes = words.counted_grams, (analyzer.smallest, analyzer.largest)
    names = (key, "term", "tf")
    return rows.mapInArrow(lambda batches: count(batches, *sizes, names), kind)


def boosted_text(df: DataFrame, title_col: str, body_col: str, times: int = 3, out: str = "text") -> DataFrame:
    """Repeat the title in front of the body so that its terms weigh more."""
    title = F.repeat(F.concat(F.coalesce(F.col(title_col), F.lit("")), F.lit(" ")), times)
    return df.withColumn(out, F.concat(title, F.coalesce(F.col(body_col), F.lit(""))))


def document_frequency(counts: DataFrame) -> DataFrame:
    """``(term, df, total_tf)``; partial sums are combined before the shuffle."""
    return counts.groupBy("term").agg(
        F.count(F.lit(1)).alias("df"), F.sum("tf").cast("bigint").alias("total_tf")
    )


def smooth_idf(df_col: Column, n_docs: int) -> Column:
    return F.log((F.lit(1.0) + F.lit(n_docs)) / (F.lit(1.0) + df_col)) + F.lit(1.0)


def _as_count(bound: int | float, n_docs: int) -> float:
    """A whole number is a document count, a float a share of the corpus."""
    return bound if isinstance(bound, int) else bound * n_docs


def prune_terms(
    terms: DataFrame,
    n_docs: int,
    min_df: int | float = 1,
    max_df: int | float = 1.0,
    max_features: int | None = None,
) -> DataFrame:
    """Vocabulary limits: document-frequency bounds first, then the most frequent terms of the corpus."""
    low, high = _as_count(min_df, n_docs), _as_count(max_df, n_docs)
    if low > 1:
        terms = terms.where(F.col("df") >= low)
    if high < n_docs:
        terms = terms.where(F.col("df") <= high)
    if max_features is not None:
        terms = terms.orderBy(F.desc("total_tf"), "term").limit(max_features)
    return terms


def document_sums(rows: DataFrame, value: Column) -> DataFrame:
    """``(doc_id, n, total)``: a document's rows and the sum of their values.

    Rows lie in order of terms, so every part of them meets most documents.  A few tasks for each core add up all they
    read before anything is shuffled: one sum for a document from each of them, however many postings there are.
    """
    few = rows.select("doc_id", value.alias("value")).coalesce(SUM_TASKS * rows.sparkSession.sparkContext.defaultParallelism)
    return few.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


class BuiltIndex:
    """The tables of a :class:`TextIndex`, each written when it is first read.

    Postings cross the network once, to ranges of terms, where a term's rows are counted and put in order by run and
    document.  A term's rows are sorted by one task; they are no more than the documents.  Norms are summed up from what
    is written there, and weights are made when postings are read, from the norms of all documents, sent around.  Beyond
    ``NORM_DOCS`` documents the norms are joined, and weighted postings written.
    """

    def __init__(
        self, docs: DataFrame, id_col: str, text_col: str, analyzer: Analyzer, limits: tuple, name: str, run_docs: int, long_term: int,
    ) -> None:
        self.analyzer, self.long_term, self.name, self._limits, self._run_docs = analyzer, long_term, name, limits, run_docs
        self._ids = docs.select(F.col(id_col).alias("doc_id"))
        self._found = term_counts(tokens(docs, id_col, text_col, analyzer), analyzer)
        self.n_docs = docs.count()

    @property
    def _limited(self) -> bool:
        low, high, most = self._limits
        return _as_count(low, self.n_docs) > 1 or _as_count(high, self.n_docs) < self.n_docs or most is not None

    @cached_property
    def _counts(self) -> DataFrame:
        return store(self._found, f"{self.name}-counts")

    @cached_property
    def terms(self) -> DataFrame:
        if "_placed" in self.__dict__ and not self._limited:
            found = self._placed.where("first").select("term", "df", "total_tf")
        else:
            found = document_frequency(self.__dict__.get("_counts", self._found))
        found = prune_terms(found, self.n_docs, *self._limits)
        return store(found.withColumn("idf", smooth_idf(F.col("df"), self.n_docs)), f"{self.name}-terms", ["term"])

    @cached_property
    def _parts(self) -> int:
        n, cores = self._counts.count(), self._ids.sparkSession.sparkContext.defaultParallelism
        return max(-(-n // PART_ROWS), min(cores, -(-n // SMALL_PART_ROWS)), 2)

    @cached_property
    def _placed(self) -> DataFrame:
        """``(doc_id, term, tf, run, df, total_tf, first)`` in ranges of terms; ``first`` marks one row of each."""
        counts = self._counts
        if self._limited:
            counts = counts.join(broadcast_if_small(self.terms.select("term")), "term", "left_semi")
        run = F.pmod(F.xxhash64("doc_id"), F.lit(-(-self.n_docs // self._run_docs) or 1)).alias("run")
        ranges = counts.select("doc_id", "term", "tf").repartitionByRange(self._parts, "term").select("*", run)
        order = Window.partitionBy("term").orderBy("run", "doc_id")
        whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        placed = ranges.withColumns(
            {
                "df": F.count(F.lit(1)).over(whole), "total_tf": F.sum("tf").over(whole).cast("bigint"),
                "first": F.row_number().over(order) == 1,
            }
        )
        return store(placed, f"{self.name}-placed", ["term", "run", "doc_id"])

    @property
    def _raw(self) -> DataFrame:
        return self._placed.withColumn("raw", F.col("tf") * smooth_idf(F.col("df"), self.n_docs))

    @cached_property
    def _norms(self) -> DataFrame:
        found = document_sums(self._raw, F.col("raw") * F.col("raw"))
        return store(found.select("doc_id", F.col("n").alias("n_terms"), F.sqrt("total").alias("norm")), f"{self.name}-norms")

    @cached_property
    def docs(self) -> DataFrame:
        known = self._ids.join(self._norms, "doc_id", "left").select(
            "doc_id", F.coalesce("n_terms", F.lit(0)).alias("n_terms"), F.coalesce("norm", F.lit(0.0)).alias("norm")
        )
        return store(known, f"{self.name}-docs", ["doc_id"])

    @cached_property
    def _few(self) -> bool:
        """Whether the norms of all documents can be sent around."""
        return isinstance(self._placed.schema["doc_id"].dataType, T.IntegralType) and at_most(self._norms, NORM_DOCS)

    @cached_property
    def _missing(self) -> float | None:
        """The norm of the document without an id."""
        found = self._norms.where(F.col("doc_id").isNull()).first()
        return found and found.norm

    def _joined(self, raw: DataFrame) -> DataFrame:
        """Weights of postings by a join with norms that are sent around: many rows at a time."""
        norms = self._norms.where(F.col("doc_id").isNotNull()).select("doc_id", "norm")
        norm = F.coalesce("norm", F.lit(self._missing).cast("double"))
        return raw.join(F.broadcast(norms), "doc_id", "left").withColumn("weight", F.col("raw") / norm).drop("norm")

    @property
    def scanned(self) -> DataFrame:
        """The postings, for a pass over all of them."""
        rows = self._joined(self._raw) if self._few else self._weighted
        return rows.select("doc_id", "term", "tf", "weight", "run", "df")

    @cached_property
    def _weighted(self) -> DataFrame:
        if self._few:
            norm = _norm_of(self._norms.select("doc_id", "norm"))
            return self._raw.withColumn("weight", F.col("raw") / norm(F.col("doc_id").cast("bigint")))
        norms = self._norms.select("doc_id", "norm").withColumnRenamed("doc_id", "of")
        joined = self._raw.join(norms, F.col("doc_id").eqNullSafe(F.col("of"))).withColumn("weight", F.col("raw") / F.col("norm"))
        rows = joined.select("doc_id", "term", "tf", "weight", "run", "df").repartitionByRange(self._parts, "term", "run", "doc_id")
        return store(rows, f"{self.name}-postings", ["term", "run", "doc_id"])

    @property
    def postings(self) -> DataFrame:
        return self._weighted.select("doc_id", "term", "tf", "weight", "run")

    def matched(self, numbers: DataFrame) -> DataFrame:
        """The postings of some terms, with the columns of ``numbers(term, …)``; weights are made for these alone."""
        return self._joined(self._raw.join(numbers, "term")) if self._few else self._weighted.join(numbers, "term")

    @cached_property
    def vectors(self) -> DataFrame:
        # A group is one document's terms.  Weights are made when read: counts and frequencies take less room.
        rows = self._placed.select("doc_id", "term", "tf", "df").repartitionByRange(self._parts, "doc_id")
        raw = F.col("tf") * smooth_idf(F.col("df"), self.n_docs)
        whole = Window.partitionBy("doc_id").orderBy("term").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        found = store(rows.withColumn("norm", F.sqrt(F.sum(raw * raw).over(whole))), f"{self.name}-vectors", ["doc_id", "term"])
        return found.select("doc_id", "term", "tf", (raw / F.col("norm")).alias("weight"))

    def vector(self, doc_id) -> DataFrame:
        """The vector of one document; read off the postings as long as nobody has had the vectors written."""
        rows = self.vectors if "vectors" in self.__dict__ else self.postings
        return rows.select("doc_id", "term", "tf", "weight").where(F.col("doc_id") == doc_id)

    @cached_property
    def blocks(self) -> DataFrame | None:
        long = F.col("df") >= self.long_term
        if self._placed.where(long).isEmpty():
            return None
        rows = self.scanned.where(long).select("term", "run", "weight")
        kind = T.StructType([rows.schema["term"], rows.schema["run"], T.StructField("most", T.DoubleType())])
        # Rows are read in order of term and run, so nothing is shuffled; a block that two batches share has two rows.
        found = rows.mapInArrow(words.run_peaks, kind)
        if self._few:
            return store(found, f"{self.name}-blocks")
        # Ranges of joined postings may end within a run.
        found = found.groupBy("term", "run").agg(F.max("most").alias("most"))
        return store(found.repartitionByRange("term", "run"), f"{self.name}-blocks", ["term", "run"])


def _norm_of(norms: DataFrame):
    """The norm of a document, by a search in the sorted ids, which are sent to every executor."""
    found = norms.toArrow().sort_by("doc_id")
    ids = found["doc_id"].cast(pa.int64()).drop_null().to_numpy()
    values = found["norm"].to_numpy()
    # A missing id sorts last.
    shared = norms.sparkSession.sparkContext.broadcast((ids, values))

    def norm(doc_ids: pa.Array) -> pa.Array:
        known, of = shared.value
        if not len(of):
            return pa.nulls(len(doc_ids), pa.float64())
        at = np.searchsorted(known, doc_ids.fill_null(0).to_numpy(zero_copy_only=False))
        at[doc_ids.is_null().to_numpy(zero_copy_only=False)] = len(of) - 1
        return pa.array(of[np.minimum(at, len(of) - 1)])

    return F.arrow_udf(norm, T.DoubleType())


def build_index(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    analyzer: Analyzer = WORDS,
    min_df: int | float = 1,
    max_df: int | float = 1.0,
    max_features: int | None = None,
    name: str = "index",
    run_docs: int = RUN_DOCS,
    long_term: int = LONG_TERM,
) -> BuiltIndex:
    """An index whose tables are written when they are first read.

    ``id_col`` is unique; ``catalog.keep_last`` or ``records.keep_first`` make it so.  ``run_docs`` and ``long_term``
    change what a search reads, never what it finds.
    """
    return BuiltIndex(docs, id_col, text_col, analyzer, (min_df, max_df, max_features), name, run_docs, long_term)


def index_facts(index: TextIndex | BuiltIndex) -> DataFrame:
    """Document, vocabulary and posting counts in one row."""
    return (
        index.docs.agg(F.count(F.lit(1)).alias("n_documents"), F.sum("n_terms").cast("bigint").alias("n_postings"))
        .withColumn("one", F.lit(1))
        .join(F.broadcast(index.terms.agg(F.count(F.lit(1)).alias("n_terms")).withColumn("one", F.lit(1))), "one")
        .drop("one")
    )


def vocabulary(index: TextIndex) -> DataFrame:
    return index.terms.select("term").orderBy("term")
