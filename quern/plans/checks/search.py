"""Term index and ranked retrieval over ``documents``; ``benchmark`` texts are the query batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.cells import category_list
from quern.functions.text import strip
from quern.operators import neighbours, retrieve, segments, tfidf
from quern.plans.checks.registry import Check
from quern.plans.tables import derive, shared, table
from quern.sources.tables import fresh_path

QUERY = "the nation and their eauxment über"
SOURCE_DOC = 1
FILTERS = ["Fr", "Src3"]
PRUNED = {"max_features": 5000, "min_df": 2, "max_df": 0.8}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def index(spark: SparkSession, sf_dir: str) -> tfidf.TextIndex:
    docs = documents(spark, sf_dir)
    return shared(spark, sf_dir, "documents-index", lambda: tfidf.build_index(docs, "doc_id", "text"))


def bounded_index(spark: SparkSession, sf_dir: str) -> tfidf.TextIndex:
    """The same index with small runs and blocks for all terms of 20 documents and more, so that bounds decide."""
    docs = documents(spark, sf_dir)
    return shared(
        spark, sf_dir, "bounded-index", lambda: tfidf.build_index(docs, "doc_id", "text", name="bounded", run_docs=16, long_term=20)
    )


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark")


def rounded(name: str, digits: int = 6):
    return F.round(name, digits).alias(name)


def v01_tokens(spark, sf_dir):
    found = tfidf.tokens(documents(spark, sf_dir), "doc_id", "text")
    return found.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def v02_ngrams(spark, sf_dir):
    from quern.functions.text import ngrams

    found = tfidf.tokens(documents(spark, sf_dir), "doc_id", "text")
    grams = found.select("doc_id", "tokens", ngrams(F.col("tokens"), 2, 2).alias("pairs"))
    return grams.select(
        "doc_id", F.size("tokens").cast("bigint").alias("n_words"), F.size("pairs").cast("bigint").alias("n_pairs"),
        F.size(F.array_distinct("pairs")).cast("bigint").alias("n_distinct_pairs"),
        F.get("pairs", F.lit(0)).alias("first_pair"),
    )


def v03_term_frequency(spark, sf_dir):
    counts = tfidf.term_counts(tfidf.tokens(documents(spark, sf_dir), "doc_id", "text"))
    return counts.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_terms"), F.sum("tf").cast("bigint").alias("sum_tf"),
        F.sum(F.col("tf") * F.col("tf")).cast("bigint").alias("sum_squares"), F.max(F.struct("tf", "term"))["term"].alias("top_term"),
    )


def v04_document_frequency(spark, sf_dir):
    terms = index(spark, sf_dir).terms
    return terms.groupBy("df").agg(
        F.count(F.lit(1)).alias("n_terms"), F.sum("total_tf").cast("bigint").alias("sum_tf"),
        F.round(F.max("idf"), 6).alias("idf"), F.min("term").alias("first_term"),
    )


def v05_norms(spark, sf_dir):
    built = index(spark, sf_dir)
    found = tfidf.document_sums(built.scanned, F.col("weight") * F.col("weight"))
    squares = found.select("doc_id", F.round("total", 6).alias("squares"))
    return built.docs.join(squares, "doc_id", "left").select("doc_id", rounded("norm"), "squares")


def v06_vocabulary_limits(spark, sf_dir):
    built = index(spark, sf_dir)
    pruned = tfidf.prune_terms(built.terms, built.n_docs, **PRUNED)
    return pruned.select("term", "df", "total_tf")


def v06_pruned_index(spark, sf_dir):
    """The whole index over the limited vocabulary: norms then come from the kept terms only."""
    docs = documents(spark, sf_dir)
    built = shared(
        spark, sf_dir, "pruned-index", lambda: tfidf.build_index(docs, "doc_id", "text", name="pruned", **PRUNED)
    )
    return built.docs.select("doc_id", F.col("n_terms").cast("bigint").alias("n_terms"), rounded("norm"))


def v07_index_facts(spark, sf_dir):
    return tfidf.index_facts(index(spark, sf_dir))


def with_titles(spark, sf_dir):
    """The first line of a document is its title, the rest its body."""
    text = F.col("text")
    rest = F.substr(text, F.length(F.substring_index(text, "\n", 1)) + 1)
    return documents(spark, sf_dir).select("doc_id", F.substring_index(text, "\n", 1).alias("title"), rest.alias("body"))


def v08_title_boost(spark, sf_dir):
    boosted = tfidf.boosted_text(with_titles(spark, sf_dir), "title", "body")
    counts = tfidf.term_counts(tfidf.tokens(boosted, "doc_id", "text"))
    return counts.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_terms"), F.sum("tf").cast("bigint").alias("sum_tf"),
        F.sum(F.col("tf") * F.col("tf")).cast("bigint").alias("sum_squares"),
    )


def v09_query_vectors(spark, sf_dir):
    vectors = retrieve.query_vectors(index(spark, sf_dir), benchmark(spark, sf_dir), "item_id", "text")
    return vectors.select("query_id", "term", rounded("query_weight"))


def v10_search_topk(spark, sf_dir):
    """One query over every document."""
    return retrieve.search(index(spark, sf_dir), QUERY, limit=10).select("doc_id", "rank", rounded("score"))


def v10_search_batch(spark, sf_dir):
    found = retrieve.search(index(spark, sf_dir), benchmark(spark, sf_dir), 5, "item_id", "text")
    return found.select("query_id", "doc_id", "rank", rounded("score"))


def v10_search_bounded(spark, sf_dir):
    """The batch by bounds of runs."""
    found = retrieve.search(bounded_index(spark, sf_dir), benchmark(spark, sf_dir), 5, "item_id", "text")
    return found.select("query_id", "doc_id", "rank", rounded("score"))


def grown_index(spark: SparkSession, sf_dir: str) -> segments.GrowingIndex:
    """The same documents in three additions."""
    def build():
        docs = documents(spark, sf_dir)
        grown = segments.create(spark, fresh_path(spark, "grown"))
        for part in range(3):
            grown = segments.add(grown, docs.where(F.pmod(F.col("doc_id"), F.lit(3)) == part), "doc_id", "text", norms=part == 2)
        return grown

    return shared(spark, sf_dir, "grown-index", build)


def v05_grown_norms(spark, sf_dir):
    view = segments.as_text_index(grown_index(spark, sf_dir))
    squares = view.postings.groupBy("doc_id").agg(F.round(F.sum(F.col("weight") * F.col("weight")), 6).alias("squares"))
    return view.docs.join(squares, "doc_id", "left").select("doc_id", rounded("norm"), "squares")


def v10_search_grown(spark, sf_dir):
    found = segments.search(grown_index(spark, sf_dir), benchmark(spark, sf_dir), 5, "item_id", "text")
    return found.select("query_id", "doc_id", "rank", rounded("score"))


def v11_top_terms(spark, sf_dir):
    return retrieve.top_terms(index(spark, sf_dir), 5).select("doc_id", "rank", "term", rounded("weight"))


def v12_similar(spark, sf_dir):
    return retrieve.similar(index(spark, sf_dir), SOURCE_DOC, 5).select("doc_id", "rank", rounded("score"))


def v13_similar_padded(spark, sf_dir):
    return retrieve.similar_padded(index(spark, sf_dir), SOURCE_DOC, 3).select("doc_id", "rank", rounded("score"))


def v12_similar_all(spark, sf_dir):
    """The nearest documents of every document."""
    found = neighbours.similar_all(index(spark, sf_dir), 5).found
    return found.select("query_id", "doc_id", "rank", rounded("score"))


def v13_similar_padded_all(spark, sf_dir):
    found = neighbours.similar_all(index(spark, sf_dir), 3, padded=True).found
    return found.select("query_id", "doc_id", "rank", rounded("score"))


def document_catalog(spark, sf_dir):
    """Language and source are the categories of a document."""
    return documents(spark, sf_dir).select(
        F.col("doc_id").alias("id"), category_list(F.concat_ws(", ", "lang", "source")).alias("categories")
    )


def v14_filtered_search(spark, sf_dir):
    found = retrieve.filtered_search(index(spark, sf_dir), QUERY, document_catalog(spark, sf_dir), FILTERS)
    return found.select("doc_id", "rank", rounded("score"))


def v14_filtered_deep(spark, sf_dir):
    """A limit above the default is honoured."""
    found = retrieve.filtered_search(index(spark, sf_dir), QUERY, document_catalog(spark, sf_dir), FILTERS, limit=50)
    return found.select("doc_id", "rank", rounded("score"))


# Every fourth request is blank; a third of them has no filter.
REQUESTS = """
SELECT item_id AS query_id, CASE WHEN item_id % 4 = 0 THEN ' ' ELSE text END AS query, item_id % 3 AS kind FROM {benchmark}
"""
SEED = 7


def requests(spark, sf_dir):
    filters = F.when(F.col("kind") == 1, F.array(F.lit("Fr"))).when(F.col("kind") == 2, F.array(F.lit("En"), F.lit("Src3")))
    return derive(spark, sf_dir, REQUESTS).withColumn("filters", filters)


def v14_requests(spark, sf_dir):
    found = retrieve.answer_requests(index(spark, sf_dir), document_catalog(spark, sf_dir), requests(spark, sf_dir), 10, SEED)
    return found.select("query_id", "doc_id", "rank", rounded("score"))


def v14_requests_bounded(spark, sf_dir):
    found = retrieve.answer_requests(bounded_index(spark, sf_dir), document_catalog(spark, sf_dir), requests(spark, sf_dir), 10, SEED)
    return found.select("query_id", "doc_id", "rank", rounded("score"))


def v14_filtered_bounded(spark, sf_dir):
    found = retrieve.filtered_search(bounded_index(spark, sf_dir), QUERY, document_catalog(spark, sf_dir), FILTERS)
    return found.select("doc_id", "rank", rounded("score"))


def v10_search_deep(spark, sf_dir):
    """More rows per query than a task keeps by itself."""
    found = retrieve.search(index(spark, sf_dir), benchmark(spark, sf_dir), 5000, "item_id", "text")
    return found.select("query_id", "doc_id", "rank", rounded("score"))


def v15_titles(spark, sf_dir):
    """Only labelled documents have a title here, so the others read as unknown."""
    labelled = with_titles(spark, sf_dir).join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    found = retrieve.search(index(spark, sf_dir), QUERY, limit=20)
    named = retrieve.with_titles(found, labelled.select("doc_id", strip(F.col("title")).alias("title")), "doc_id", "title")
    return named.select("doc_id", "rank", "title")


INDEX_SQL = r"""
WITH tok AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS t FROM documents
), grams AS (
  SELECT doc_id, unnest(t) AS term FROM tok
  UNION ALL
  SELECT doc_id, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) FROM tok
), tf AS (
  SELECT doc_id, term, count(*) AS tf FROM grams GROUP BY ALL
), size AS (
  SELECT count(*) AS n FROM documents
), terms AS (
  SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total_tf,
         ln((1.0 + (SELECT n FROM size)) / (1.0 + count(*))) + 1.0 AS idf
  FROM tf GROUP BY term
), weighted AS (
  SELECT doc_id, term, tf, tf * idf AS raw FROM tf JOIN terms USING (term)
), norms AS (
  SELECT doc_id, sqrt(sum(raw * raw)) AS norm, count(*) AS n_terms FROM weighted GROUP BY doc_id
), postings AS (
  SELECT doc_id, term, raw / norm AS weight FROM weighted JOIN norms USING (doc_id)
)"""


def ranked_sql(queries: str, where: str = "true") -> str:
    """CTEs up to ``ranked`` for a query relation ``(query_id, query)``."""
    return INDEX_SQL + rf""", queries AS ({queries}), qtok AS (
  SELECT query_id, regexp_extract_all(lower(query), '[\p{{L}}\p{{N}}_]{{2,}}') AS t FROM queries
), qgrams AS (
  SELECT query_id, unnest(t) AS term FROM qtok
  UNION ALL
  SELECT query_id, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) FROM qtok
), qraw AS (
  SELECT query_id, term, count(*) * any_value(idf) AS raw FROM qgrams JOIN terms USING (term) GROUP BY ALL
), qvec AS (
  SELECT query_id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY query_id)) AS query_weight FROM qraw
), scored AS (
  SELECT query_id, doc_id, sum(query_weight * weight) AS score
  FROM qvec JOIN postings USING (term) WHERE {where} GROUP BY ALL
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 10) DESC, doc_id) AS rank FROM scored
)"""


ONE_QUERY = f"SELECT 0 AS query_id, '{QUERY}' AS query"
BATCH = "SELECT item_id AS query_id, text AS query FROM benchmark"
SIMILAR_SQL = INDEX_SQL + f""", scored AS (
  SELECT p.doc_id, sum(s.weight * p.weight) AS score
  FROM postings s JOIN postings p USING (term)
  WHERE s.doc_id = {SOURCE_DOC} AND p.doc_id <> {SOURCE_DOC} GROUP BY p.doc_id
)"""
TITLES_SQL = """SELECT doc_id, split_part(text, chr(10), 1) AS title,
  substr(text, length(split_part(text, chr(10), 1)) + 1) AS body FROM documents"""
ADMITTED = """(query_id % 3 = 0 OR (query_id % 3 = 1 AND doc_id IN (SELECT doc_id FROM documents WHERE lang = 'fr'))
  OR (query_id % 3 = 2 AND doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en' OR source = 'src3')))"""
COUNT_COLUMNS = """count(*) AS n_terms, CAST(sum(tf) AS BIGINT) AS sum_tf, CAST(sum(tf * tf) AS BIGINT) AS sum_squares"""

CHECKS = {
    "v01_tokens": Check(v01_tokens, INDEX_SQL + "SELECT token, count(*) AS n FROM (SELECT unnest(t) AS token FROM tok) GROUP BY token"),
    "v02_ngrams": Check(v02_ngrams, INDEX_SQL + """, pairs AS (
        SELECT doc_id, t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]) AS p FROM tok)
        SELECT doc_id, CAST(len(t) AS BIGINT) AS n_words, CAST(len(p) AS BIGINT) AS n_pairs,
               CAST(len(list_distinct(p)) AS BIGINT) AS n_distinct_pairs, p[1] AS first_pair FROM pairs"""),
    "v03_term_frequency": Check(v03_term_frequency, INDEX_SQL + f"""
        SELECT doc_id, {COUNT_COLUMNS}, max((tf, term))[2] AS top_term FROM tf GROUP BY doc_id"""),
    "v04_document_frequency": Check(v04_document_frequency, INDEX_SQL + """
        SELECT df, count(*) AS n_terms, CAST(sum(total_tf) AS BIGINT) AS sum_tf, round(max(idf), 6) AS idf,
               min(term) AS first_term FROM terms GROUP BY df"""),
    "v05_norms": Check(v05_norms, INDEX_SQL + """
        SELECT d.doc_id, round(coalesce(norm, 0.0), 6) AS norm, CASE WHEN norm IS NOT NULL THEN 1.0::DOUBLE END AS squares
        FROM documents d LEFT JOIN norms USING (doc_id)"""),
    "v06_vocabulary_limits": Check(v06_vocabulary_limits, INDEX_SQL + """
        SELECT term, df, total_tf FROM terms WHERE df >= 2 AND df <= 0.8 * (SELECT n FROM size)
        ORDER BY total_tf DESC, term LIMIT 5000"""),
    "v06_pruned_index": Check(v06_pruned_index, INDEX_SQL + """, kept AS (
        SELECT term FROM terms WHERE df >= 2 AND df <= 0.8 * (SELECT n FROM size) ORDER BY total_tf DESC, term LIMIT 5000
        ), small AS (SELECT doc_id, count(*) AS n_terms, sqrt(sum(raw * raw)) AS norm
                     FROM weighted JOIN kept USING (term) GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n_terms, 0) AS n_terms, round(coalesce(norm, 0.0), 6) AS norm
        FROM documents d LEFT JOIN small USING (doc_id)"""),
    "v07_index_facts": Check(v07_index_facts, INDEX_SQL + """
        SELECT (SELECT n FROM size) AS n_documents, (SELECT count(*) FROM tf) AS n_postings,
               (SELECT count(*) FROM terms) AS n_terms"""),
    "v08_title_boost": Check(v08_title_boost, INDEX_SQL.replace(
        "FROM documents\n), grams", f"FROM (SELECT doc_id, repeat(title || ' ', 3) || body AS text FROM ({TITLES_SQL}))\n), grams", 1,
    ) + f"SELECT doc_id, {COUNT_COLUMNS} FROM tf GROUP BY doc_id"),
    "v09_query_vectors": Check(v09_query_vectors, ranked_sql(BATCH) + """
        SELECT query_id, term, round(query_weight, 6) AS query_weight FROM qvec"""),
    "v10_search_topk": Check(v10_search_topk, ranked_sql(ONE_QUERY) + """
        SELECT doc_id, rank, round(score, 6) AS score FROM ranked WHERE rank <= 10"""),
    "v10_search_batch": Check(v10_search_batch, ranked_sql(BATCH) + """
        SELECT query_id, doc_id, rank, round(score, 6) AS score FROM ranked WHERE rank <= 5"""),
    "v10_search_deep": Check(v10_search_deep, ranked_sql(BATCH) + """
        SELECT query_id, doc_id, rank, round(score, 6) AS score FROM ranked WHERE rank <= 5000"""),
    "v11_top_terms": Check(v11_top_terms, INDEX_SQL + """
        SELECT doc_id, rank, term, round(weight, 6) AS weight FROM (
          SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(weight, 10) DESC, term) AS rank FROM postings)
        WHERE rank <= 5"""),
    "v12_similar": Check(v12_similar, SIMILAR_SQL + """
        SELECT doc_id, row_number() OVER (ORDER BY round(score, 10) DESC, doc_id) AS rank, round(score, 6) AS score
        FROM scored ORDER BY rank LIMIT 5"""),
    "v13_similar_padded": Check(v13_similar_padded, SIMILAR_SQL + f"""
        SELECT doc_id, row_number() OVER (ORDER BY round(coalesce(score, 0), 10) DESC, doc_id) AS rank,
               round(coalesce(score, 0.0), 6) AS score
        FROM documents LEFT JOIN scored USING (doc_id) WHERE doc_id <> {SOURCE_DOC} ORDER BY rank LIMIT 3"""),
    "v14_filtered_search": Check(v14_filtered_search, ranked_sql(
        ONE_QUERY, "doc_id IN (SELECT doc_id FROM documents WHERE lang = 'fr' OR source = 'src3')") + """
        SELECT doc_id, rank, round(score, 6) AS score FROM ranked WHERE rank <= 20"""),
    "v14_filtered_deep": Check(v14_filtered_deep, ranked_sql(
        ONE_QUERY, "doc_id IN (SELECT doc_id FROM documents WHERE lang = 'fr' OR source = 'src3')") + """
        SELECT doc_id, rank, round(score, 6) AS score FROM ranked WHERE rank <= 50"""),
    "v14_requests": Check(v14_requests, ranked_sql(
        "SELECT item_id AS query_id, text AS query FROM benchmark WHERE item_id % 4 <> 0", ADMITTED) + f""", browsed AS (
          SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY md5(concat(doc_id, ':{SEED}')), doc_id) AS rank
          FROM (SELECT item_id AS query_id FROM benchmark WHERE item_id % 4 = 0), documents WHERE {ADMITTED})
        SELECT query_id, doc_id, rank, round(score, 6) AS score FROM ranked WHERE rank <= 10
        UNION ALL SELECT query_id, doc_id, rank, NULL FROM browsed WHERE rank <= 10"""),
    "v15_titles": Check(v15_titles, ranked_sql(ONE_QUERY) + f""", titles AS ({TITLES_SQL})
        SELECT r.doc_id, rank, coalesce(trim(title, chr(9) || chr(10) || chr(13) || ' '), 'Unknown') AS title
        FROM ranked r LEFT JOIN (SELECT * FROM titles WHERE doc_id IN (SELECT doc_id FROM labels)) t USING (doc_id)
        WHERE rank <= 20"""),
}

ALL_PAIRS_SQL = INDEX_SQL + """, scored AS (
  SELECT s.doc_id AS query_id, p.doc_id, sum(s.weight * p.weight) AS score
  FROM postings s JOIN postings p USING (term) WHERE p.doc_id <> s.doc_id GROUP BY ALL
)"""

CHECKS |= {
    "v05_grown_norms": Check(v05_grown_norms, CHECKS["v05_norms"].sql),
    "v10_search_grown": Check(v10_search_grown, CHECKS["v10_search_batch"].sql),
    "v12_similar_all": Check(v12_similar_all, ALL_PAIRS_SQL + """
        SELECT query_id, doc_id, rank::INTEGER AS rank, round(score, 6) AS score FROM (
          SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 10) DESC, doc_id) AS rank FROM scored)
        WHERE rank <= 5"""),
    "v13_similar_padded_all": Check(v13_similar_padded_all, ALL_PAIRS_SQL + """, filled AS (
          SELECT q.doc_id AS query_id, d.doc_id, coalesce(score, 0.0) AS score
          FROM documents q JOIN documents d ON q.doc_id <> d.doc_id LEFT JOIN scored s ON s.query_id = q.doc_id AND s.doc_id = d.doc_id)
        SELECT query_id, doc_id, rank::INTEGER AS rank, round(score, 6) AS score FROM (
          SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 10) DESC, doc_id) AS rank FROM filled)
        WHERE rank <= 3"""),
    "v10_search_bounded": Check(v10_search_bounded, CHECKS["v10_search_batch"].sql),
    "v14_requests_bounded": Check(v14_requests_bounded, CHECKS["v14_requests"].sql),
    "v14_filtered_bounded": Check(v14_filtered_bounded, CHECKS["v14_filtered_search"].sql),
}
