"""Ranked retrieval over the term index.

Scores are cosines of L2-normalised vectors.  Ranking is by score rounded to ten digits, then by
document id, so the order does not depend on how sums were partitioned.

Where the index has blocks, a search first bounds what the documents of each run can score: the largest weight of
each query term in the run, from the blocks of frequent terms and the postings of rare ones.  It scores the most
promising runs, and after that only runs whose bound reaches the last score that is then wanted.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quern.functions import scoring
from quern.functions.text import shuffled
from quern.operators.skew import broadcast_if_small, settle
from quern.operators.tfidf import TextIndex, term_counts
from quern.sources.tables import store

# Up to this many distinct query terms travel as literals, so that row groups can be skipped.  Beyond it the
# same rows are found by the join alone.
PUSHED_TERMS = 500
SCORE_DIGITS = 10
DEFAULT_LIMIT = 20
# Spark keeps only the best rows of a window per task up to this limit; beyond it a query's rows are first
# ranked in so many parts.
TASK_LIMIT = 1000
PARTS = 64
MARGIN = scoring.MARGIN
# Runs scored per wanted row, round by round; then all that can still matter.
FIRST_RUNS = (1, 8)

Admit = Callable[[DataFrame], DataFrame]


def one_query(index: TextIndex, query: str) -> DataFrame:
    spark = index.terms.sparkSession
    return spark.range(1).select(F.col("id").alias("query_id"), F.lit(query).alias("query"))


def only_terms(table: DataFrame, wanted: pa.Table | None) -> DataFrame:
    """Restrict an index table to the terms of a settled table, if few, by a filter the parquet reader knows."""
    if wanted is None:
        return table
    terms = wanted["term"].unique().to_pylist()
    return table.where(F.col("term").isin(terms)) if len(terms) <= PUSHED_TERMS else table


def prepare(index: TextIndex) -> None:
    """Have the postings written first; a built index then reads its terms off them instead of counting once more."""
    _ = index.postings


def query_vectors(
    index: TextIndex, queries: DataFrame, id_col: str = "query_id", text_col: str = "query", few: bool = False
) -> DataFrame:
    """``(query_id, term, query_weight, df)`` of the known terms, normalised; blank queries yield nothing."""
    tokenised = queries.select(
        F.col(id_col).alias("query_id"), index.analyzer.tokenizer(F.col(text_col)).alias("tokens")
    )
    if index.analyzer.stopwords:
        stop = list(index.analyzer.stopwords)
        tokenised = tokenised.withColumn("tokens", F.filter("tokens", lambda token: ~token.isin(*stop)))
    counts, wanted = settle(term_counts(tokenised, index.analyzer, key="query_id"), "query-terms", few)
    weighted = only_terms(index.terms.select("term", "idf", "df"), wanted).join(counts, "term")
    weighted = weighted.withColumn("raw", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("query_id")))
    return weighted.select("query_id", "term", (F.col("raw") / norm).alias("query_weight"), "df")


def numbered(vectors: pa.Table, weight: str, spark) -> tuple[scoring.Asked, DataFrame]:
    """The vectors of a batch, to be sent to the tasks, and their terms ``(term, number)``."""
    queries, terms = scoring.asked(vectors, weight)
    rows = pa.table({"term": terms, "number": pa.array(np.arange(len(terms)), pa.int64())})
    return queries, F.broadcast(spark.createDataFrame(rows, "term string, number long"))


def _rows(vectors: DataFrame, key: T.StructField, value: str) -> T.StructType:
    return T.StructType([vectors.schema["query_id"], T.StructField(key.name, key.dataType), T.StructField(value, T.DoubleType())])


def summed(matched: DataFrame, queries: scoring.Asked, vectors: DataFrame, limit: int | None = None) -> DataFrame:
    """``(query_id, doc_id, score)`` of postings ``(doc_id, number, weight)``.

    A posting moves once, to the task of its document, however many queries ask for its term.  With a limit, documents
    that so many others surpass for sure are left out.
    """
    shipped = matched.sparkSession.sparkContext.broadcast(queries)
    limit = limit if limit is not None and limit > 0 else None
    dealt = matched.select("doc_id", "number", "weight").repartition("doc_id").sortWithinPartitions("doc_id")
    return dealt.mapInArrow(lambda batches: scoring.document_scores(batches, shipped.value, limit), _rows(vectors, matched.schema["doc_id"], "score"))


def scores(
    index: TextIndex, vectors: DataFrame, allowed: DataFrame | None = None, few: bool = False, limit: int | None = None
) -> DataFrame:
    """``(query_id, doc_id, score)`` for every document that shares a term with the query.

    ``allowed`` holds the ``doc_id`` that may be found, and their ``query_id`` if it differs by query; it is
    applied to the postings, before anything is summed.  ``limit`` says that no more of the best rows of a query are
    wanted; some of the others may then be missing.
    """
    vectors, wanted = settle(vectors, "query-vectors", few)
    by_query = allowed is not None and "query_id" in allowed.columns
    if wanted is not None and wanted.num_rows and not few and not by_query:
        queries, numbers = numbered(wanted, "query_weight", vectors.sparkSession)
        matched = index.matched(numbers)
        if allowed is not None:
            matched = matched.join(allowed, "doc_id", "left_semi")
        return summed(matched, queries, vectors, limit)
    matched = only_terms(index.postings.select("doc_id", "term", "weight"), wanted).join(vectors, "term")
    if allowed is not None:
        matched = matched.join(allowed, [name for name in ("query_id", "doc_id") if name in allowed.columns], "left_semi")
    summed_up = matched.groupBy("query_id", "doc_id").agg(F.sum(F.col("query_weight") * F.col("weight")).alias("score"))
    return summed_up.where(F.col("score") > 0)


def ranking_key(score: str = "score") -> Column:
    return F.round(F.col(score), SCORE_DIGITS)


def best_rows(df: DataFrame, per: str, order: list[Column], limit: int, salt: str) -> DataFrame:
    """The first ``limit`` rows of each group, with their ``rank``.

    A small limit is applied in each task before the shuffle.  A large one is applied to hashed parts of the
    group first, so that no task ever sorts a whole group; the result is the same.
    """
    limit = max(limit, 0)
    if limit > TASK_LIMIT:
        part = F.pmod(F.xxhash64(salt), F.lit(PARTS))
        within = Window.partitionBy(per, "_part").orderBy(*order)
        df = df.withColumn("_part", part).withColumn("_nth", F.row_number().over(within))
        df = df.where(F.col("_nth") <= limit).drop("_part", "_nth")
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(per).orderBy(*order))).where(F.col("rank") <= limit)


def top_k(scored: DataFrame, limit: int, per: str = "query_id", by: str = "doc_id") -> DataFrame:
    """The best ``limit`` rows of each query."""
    return best_rows(scored, per, [ranking_key().desc(), F.col(by)], limit, by)


def run_bounds(index: TextIndex, vectors: DataFrame, wanted: pa.Table | None = None, matched: DataFrame | None = None) -> DataFrame:
    """``(query_id, run, bound)``: the most that a document of the run can score; runs without a query term have no row.

    ``vectors`` holds ``(query_id, term, query_weight, df)``.  Of frequent terms only blocks are read.  ``matched`` are the
    postings ``(number, run, weight, df)`` of a batch; a block or posting then moves once, to the task of its run.
    """
    long = F.col("df") >= index.long_term
    if matched is not None:
        queries, numbers = numbered(wanted, "query_weight", vectors.sparkSession)
        blocks = index.blocks.join(numbers, "term").select("run", "number", F.col("most").alias("weight"))
        rows = blocks.unionByName(matched.where(~long).select("run", "number", "weight"))
        shipped = rows.sparkSession.sparkContext.broadcast(queries)
        dealt = rows.repartition("run").sortWithinPartitions("run")
        return dealt.mapInArrow(lambda batches: scoring.run_bounds(batches, shipped.value), _rows(vectors, rows.schema["run"], "bound"))
    blocks = only_terms(index.blocks, wanted).join(vectors.where(long), "term")
    rare = only_terms(index.postings.select("term", "run", F.col("weight").alias("most")), wanted).join(vectors.where(~long), "term")
    names = ["query_id", "term", "run", "query_weight"]
    most = blocks.select(*names, "most").unionByName(rare.select(*names, "most")).groupBy(*names).agg(F.max("most").alias("most"))
    return most.groupBy("query_id", "run").agg(F.sum(F.col("query_weight") * F.col("most")).alias("bound"))


def _scores_in(index: TextIndex, vectors: DataFrame, runs: DataFrame, wanted: pa.Table | None, listed: pa.Table | None) -> DataFrame:
    """``(query_id, doc_id, score)`` of the documents in some runs ``(query_id, run)``."""
    postings = only_terms(index.postings.select("doc_id", "term", "weight", "run"), wanted)
    if listed is not None:
        numbers = listed["run"].unique().to_pylist()
        postings = postings.where(F.col("run").isin(numbers)) if len(numbers) <= PUSHED_TERMS else postings
    asked = vectors.select("query_id", "term", "query_weight").join(runs.select("query_id", "run"), "query_id")
    matched = postings.join(asked, ["term", "run"])
    return matched.groupBy("query_id", "doc_id").agg(F.sum(F.col("query_weight") * F.col("weight")).alias("score"))


def _batch_scores_in(matched: DataFrame, vectors: DataFrame, wanted: pa.Table, runs: DataFrame, best: DataFrame | None, limit: int) -> DataFrame:
    """As :func:`_scores_in` from the postings ``(doc_id, number, weight, run)`` of a batch, each moved once.

    Documents below the last wanted score of ``best`` are left out.
    """
    spark = vectors.sparkSession
    queries, _ = scoring.asked(wanted, "query_weight")
    ids = queries.query_ids
    floors = np.zeros(len(ids))
    if best is not None:
        last = best.where(F.col("rank") == limit).select("query_id", "score").toArrow()
        floors[np.asarray(pc.index_in(last["query_id"], value_set=ids), np.int64)] = last["score"].to_numpy()
    # A row of a run that is asked for; it comes to the postings of the run.
    table = pa.table({"query_id": ids, "number": pa.array(-1 - np.arange(len(ids)), pa.int64())})
    kind = T.StructType([vectors.schema["query_id"], T.StructField("number", T.LongType())])
    asked = runs.join(F.broadcast(spark.createDataFrame(table, kind)), "query_id").select("run", "number").withColumns(
        {"doc_id": F.lit(None).cast(matched.schema["doc_id"].dataType), "weight": F.lit(0.0)}
    )
    mine = matched.join(broadcast_if_small(runs.select("run").distinct()), "run", "left_semi")
    shipped = spark.sparkContext.broadcast((queries, floors))
    rows = mine.select("run", "number", "doc_id", "weight").unionByName(asked).repartition("run").sortWithinPartitions("run")
    return rows.mapInArrow(lambda batches: scoring.scores_in_runs(batches, *shipped.value), _rows(vectors, matched.schema["doc_id"], "score"))


def bounded_top_k(
    index: TextIndex, vectors: DataFrame, limit: int, allowed: DataFrame | None = None, admit: Admit | None = None, few: bool = False
) -> tuple[DataFrame, DataFrame]:
    """The best ``limit`` rows of each query, as ``top_k(scores(...))`` has them, and the runs ``(query_id, run)`` that were read.

    Every run has a matching document, so the first round, of as many runs as rows are wanted, mostly fills them.
    ``allowed`` and ``admit`` are applied before the last wanted score is taken, so a filter only makes more runs count.
    """
    if "df" not in vectors.columns:
        vectors = vectors.join(index.terms.select("term", "df"), "term")
    vectors, wanted = settle(vectors, "query-vectors", few)
    # The postings of a batch's terms are picked out once; one query reads its own terms and runs.
    batch = wanted is not None and wanted.num_rows > 0 and not few
    matched = None
    if batch:
        _, numbers = numbered(wanted, "query_weight", vectors.sparkSession)
        matched = store(index.matched(numbers).select("doc_id", "number", "weight", "run", "df"), "matched", ["run"])
    bounds = store(run_bounds(index, vectors, wanted, matched), "run-bounds")
    best = taken = None
    for times in (*FIRST_RUNS, None):
        left = bounds
        if taken is not None:
            last = best.where(F.col("rank") == limit).select("query_id", F.col("score").alias("last"))
            left = left.join(taken, ["query_id", "run"], "left_anti").join(last, "query_id", "left")
            left = left.where(F.col("bound") >= F.coalesce("last", F.lit(0.0)) - MARGIN).drop("last")
        if times is not None:
            left = best_rows(left, "query_id", [F.desc("bound"), F.col("run")], times * limit, "run").drop("rank")
        runs, listed = settle(left.select("query_id", "run"), "runs")
        if listed is not None and not listed.num_rows:
            break
        if batch:
            found = _batch_scores_in(matched, vectors, wanted, runs, best, limit)
        else:
            found = _scores_in(index, vectors, runs, wanted, listed).where(F.col("score") > 0)
        if allowed is not None:
            found = found.join(allowed, [name for name in ("query_id", "doc_id") if name in allowed.columns], "left_semi")
        if admit is not None:
            found = admit(found)
        columns = ["query_id", "doc_id", "score"]
        best = store(top_k(found.select(*columns) if best is None else best.select(*columns).unionByName(found.select(*columns)), limit), "best")
        taken = store(runs if taken is None else taken.unionByName(runs), "taken")
    if best is None:
        none = _scores_in(index, vectors, bounds.limit(0), None, None)
        return top_k(none, 0), bounds.select("query_id", "run").limit(0)
    return best, taken


def ranked(
    index: TextIndex, vectors: DataFrame, limit: int, allowed: DataFrame | None = None, admit: Admit | None = None, few: bool = False
) -> DataFrame:
    """The best ``limit`` rows of each query; by bounds where the index has them and the limit is not deep.

    ``admit`` keeps some of the rows ``(query_id, doc_id, score)``.
    """
    if index.blocks is not None and 0 < limit <= TASK_LIMIT:
        return bounded_top_k(index, vectors, limit, allowed, admit, few)[0]
    if admit is not None:
        return top_k(admit(scores(index, vectors, allowed, few)), limit)
    return top_k(scores(index, vectors, allowed, few, limit), limit)


def search(
    index: TextIndex, queries: DataFrame | str, limit: int = 5, id_col: str = "query_id", text_col: str = "query"
) -> DataFrame:
    """Ranked documents ``(query_id, doc_id, score, rank)`` of one query text or a table of queries."""
    few = isinstance(queries, str)
    prepare(index)
    if few:
        queries = one_query(index, queries)
    return ranked(index, query_vectors(index, queries, id_col, text_col, few), limit, few=few)


def top_terms(index: TextIndex, limit: int = 5, doc_id: int | None = None) -> DataFrame:
    """Heaviest terms ``(doc_id, term, weight, rank)`` of one document, or of every document.

    An unknown document id is an error.
    """
    postings = index.vectors.where(F.col("weight") > 0)
    if doc_id is not None:
        if index.docs.where(F.col("doc_id") == doc_id).isEmpty():
            raise ValueError(f"unknown document: {doc_id}")
        postings = postings.where(F.col("doc_id") == doc_id)
    order = Window.partitionBy("doc_id").orderBy(ranking_key("weight").desc(), F.col("term"))
    ranked = postings.select("doc_id", "term", "weight", F.row_number().over(order).alias("rank"))
    return ranked.where(F.col("rank") <= limit)


def similar(index: TextIndex, doc_id: int, limit: int = 5) -> DataFrame:
    """Documents nearest to one document; nothing for an unknown id."""
    vector = index.vector(doc_id).select(
        F.lit(doc_id).cast("bigint").alias("query_id"), "term", F.col("weight").alias("query_weight")
    )
    return ranked(index, vector, limit, admit=lambda found: found.where(F.col("doc_id") != doc_id), few=True)


def similar_padded(index: TextIndex, doc_id: int, limit: int = 3) -> DataFrame:
    """As :func:`similar`, but filled up to ``limit`` with unrelated documents at score zero.

    At most ``limit`` documents can be displaced by better ones, so the first ``2 * limit + 1`` ids
    are enough to fill up from.
    """
    if index.docs.where(F.col("doc_id") == doc_id).isEmpty():
        return similar(index, doc_id, 0)
    best = similar(index, doc_id, limit).drop("rank")
    first = index.docs.select("doc_id").orderBy("doc_id").limit(2 * limit + 1)
    filler = first.where(F.col("doc_id") != doc_id).join(best, "doc_id", "left_anti")
    filler = filler.select(
        F.lit(doc_id).cast("bigint").alias("query_id"), "doc_id", F.lit(0.0).alias("score")
    )
    return top_k(best.unionByName(filler), limit)


def matching_categories(catalog: DataFrame, filters: list[str], column: str = "categories") -> DataFrame:
    """Rows that carry at least one of the categories, compared exactly; no filter keeps all."""
    if not filters:
        return catalog
    return catalog.where(F.arrays_overlap(F.col(column), F.array(*[F.lit(value) for value in filters])))


def checked_limit(limit: int | None, maximum: int | None) -> int:
    """The limit that a request gets; one above the caller's maximum is refused, never shortened."""
    limit = limit or DEFAULT_LIMIT
    if maximum is not None and limit > maximum:
        raise ValueError(f"limit {limit} is above the maximum of {maximum}")
    return limit


def filtered_search(
    index: TextIndex,
    query: str,
    catalog: DataFrame,
    filters: list[str],
    limit: int | None = None,
    id_col: str = "id",
    category_col: str = "categories",
    maximum: int | None = None,
    seed: int | None = None,
) -> DataFrame:
    """``(query_id, doc_id, score, rank)`` among the documents of the given categories.

    The filter is applied to the postings, before scores are summed; weights still come from the whole
    corpus.  A blank query browses: documents of the categories in random order, which a seed makes
    repeatable, without a score.
    """
    limit = checked_limit(limit, maximum)
    allowed = matching_categories(catalog, filters, category_col).select(F.col(id_col).alias("doc_id"))
    if not query.strip():
        chance = F.rand() if seed is None else shuffled("doc_id", seed)
        shown = allowed.select(F.lit(0).cast("bigint").alias("query_id"), "doc_id", chance.alias("_chance"))
        first = best_rows(shown.orderBy("_chance", "doc_id").limit(limit), "query_id", [F.col("_chance"), F.col("doc_id")], limit, "doc_id")
        return first.select("query_id", "doc_id", F.lit(None).cast("double").alias("score"), "rank")
    prepare(index)
    vectors = query_vectors(index, one_query(index, query), few=True)
    return ranked(index, vectors, limit, allowed if filters else None, few=True)


def _browsed(listed: DataFrame, filtered: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """``(query_id, doc_id, rank)``: the first documents with one of a request's categories.

    What is first among several categories is among the first of one of them, so only the first of each category
    meet the requests.  ``listed`` holds ``(doc_id, category)``, ``filtered`` ``(query_id, category)``.
    """
    wanted = listed.join(filtered.select("category").distinct(), "category", "left_semi")
    first = best_rows(wanted, "category", order, limit, "doc_id").drop("rank")
    return best_rows(first.join(filtered, "category").select("query_id", "doc_id").distinct(), "query_id", order, limit, "doc_id")


def answer_requests(
    index: TextIndex, catalog: DataFrame, requests: DataFrame, limit: int = DEFAULT_LIMIT, seed: int = 0,
    id_col: str = "id", category_col: str = "categories",
) -> DataFrame:
    """Answer a table of requests ``(query_id, query, filters)``: ``(query_id, doc_id, score, rank)``.

    Each is a ranked search or, if its query is blank, a browse in seeded order; no filter admits every document.
    """
    asked = store(requests.select("query_id", F.coalesce("query", F.lit("")).alias("query"), "filters"), "requests")
    no_filter = F.array().cast("array<string>")
    open_ = F.size(F.coalesce("filters", no_filter)) <= 0
    blank = F.trim("query") == ""
    order = [shuffled("doc_id", seed), F.col("doc_id")]
    categories = catalog.select(F.col(id_col).alias("doc_id"), F.col(category_col).alias("_categories"))

    def admit(found: DataFrame) -> DataFrame:
        """Scored documents with one of the request's categories; requests without a filter take all."""
        bound = asked.where(~open_).select("query_id", "filters")
        free = found.join(bound, "query_id", "left_anti")
        kept = found.join(bound, "query_id").join(categories, "doc_id").where(F.arrays_overlap("_categories", "filters"))
        return free.unionByName(kept.select(*found.columns))

    prepare(index)
    found = ranked(index, query_vectors(index, asked.where(~blank)), limit, admit=admit).select("query_id", "doc_id", "score", "rank")
    # All requests without text and filter show the same documents.
    first = catalog.select(F.col(id_col).alias("doc_id")).orderBy(*order).limit(limit).withColumn("_all", F.lit(True))
    shown = asked.where(blank & open_).select("query_id", F.lit(True).alias("_all")).join(first, "_all").select("query_id", "doc_id")
    listed = categories.select("doc_id", F.explode(F.array_distinct("_categories")).alias("category"))
    filtered = asked.where(blank & ~open_).select("query_id", F.explode(F.array_distinct("filters")).alias("category"))
    browsed = best_rows(shown, "query_id", order, limit, "doc_id").unionByName(_browsed(listed, filtered, order, limit))
    return found.unionByName(browsed.select("query_id", "doc_id", F.lit(None).cast("double").alias("score"), "rank"))


def with_titles(results: DataFrame, catalog: DataFrame, id_col: str = "id", title_col: str = "title") -> DataFrame:
    """Attach titles to ranked results; an id without a title reads ``Unknown``."""
    titles = catalog.select(F.col(id_col).alias("doc_id"), F.col(title_col).alias("title"))
    named = titles.join(broadcast_if_small(results), "doc_id", "right")
    return named.select(*results.columns, F.coalesce("title", F.lit("Unknown")).alias("title"))
