"""Registered queries of this package: each operator over its whole table, with SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import blocklabel, bpe, collocations, imatch, langid, lexical, neardup, packing, pieces, pii, quality, topk, warc
from quern.plans.checks.registry import Check


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(parts: int, rest: int) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(parts)) == rest


def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    held = F.coalesce(held_out(3, 1), F.lit(False))
    model = langid.train(docs.where(~held), "doc_id", "text", "lang")
    return langid.predict(docs, "doc_id", "text", model).withColumnRenamed("id", "doc_id").select(
        "doc_id", held.alias("held_out"), "lang_pred", "score", "coverage", "n_grams"
    )


def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    held = F.coalesce(held_out(5, 0), F.lit(False))
    network = quality.train(docs.where(~held), labels.where(~held), "doc_id", "text", "quality")
    return quality.score(docs, "doc_id", "text", network).withColumnRenamed("id", "doc_id").select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.groups(_read(spark, sf_dir, "documents"), "doc_id", "text", neardup.Sketch(words=4, percent=80))
    return found.select(
        F.col("id").alias("doc_id"), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"), "class_id"
    )


PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def piece_ids(spark: SparkSession, sf_dir: str, model: str = PIECE_MODEL) -> DataFrame:
    return pieces.encode(_read(spark, sf_dir, "documents"), "doc_id", "text", pieces.load(model)).withColumnRenamed("id", "doc_id")


def document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    terms = imatch.lexicon(docs, "text")
    return imatch.compare_with_next(docs, "doc_id", "text", terms).withColumnRenamed("id", "doc_id")


def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(_read(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def packed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_texts(_read(spark, sf_dir, "documents"), "doc_id", "text", "source").withColumnRenamed("id", "doc_id")


def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_read(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 50 == 0)


NEAREST_SQL = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS cells FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.cells, c.cells)::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
) WHERE rank <= 5
"""


def web_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = warc.write(_read(spark, sf_dir, "pages"), "page_id", "url", "html")
    return warc.read(archive).select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


ARCHIVE_SQL = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS payload FROM pages),
last AS (SELECT *, strlen(payload) AS n, max(page_id) OVER (PARTITION BY payload) AS owner FROM p)
SELECT page_id, n AS payload_bytes, sha1(payload) AS payload_digest,
    CASE WHEN n < 1000 OR page_id IS NOT DISTINCT FROM owner THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN n < 1000 OR page_id IS NOT DISTINCT FROM owner THEN NULL ELSE owner END AS refers_to, url
FROM last
"""


def main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages")
    model = blocklabel.train(pages, "page_id", "html")
    return blocklabel.extract(pages, "page_id", "url", "html", model).withColumnRenamed("id", "page_id")


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    model = bpe.load(public_tokenizers.path("word_bpe_49k.json"))
    return bpe.count(_read(spark, sf_dir, "documents"), "doc_id", "text", model, 2048).withColumnRenamed("id", "doc_id")


def ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")
    return lexical.search(docs, items, "doc_id", "text", "item_id", "text").withColumnRenamed("id", "doc_id")


SEARCH_TERMS = (
    r"unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),"
    r" '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term"
)
SEARCH_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, text FROM documents),
words AS (SELECT row, doc_id, {SEARCH_TERMS} FROM d),
tf AS (SELECT row, doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
sizes AS (SELECT row, sum(tf)::BIGINT AS n FROM tf GROUP BY row),
total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS length FROM sizes),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total GROUP BY term, docs),
asked AS (SELECT DISTINCT item_id, {SEARCH_TERMS} FROM benchmark),
scored AS (
    SELECT item_id, row, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // length))))::BIGINT AS score
    FROM asked JOIN tf USING (term) JOIN weights USING (term) JOIN sizes USING (row), total GROUP BY ALL
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0
) WHERE rank <= 50
"""


def phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(_read(spark, sf_dir, "documents"), "text", "lang")


COLLOCATION_SQL = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-]')) AS piece
    FROM documents
), words AS (
    SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS w FROM pieces
), f AS (
    SELECT lang, size, phrase, count(*) AS a FROM (
        SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS phrase
        FROM words, range(1, 5) AS t(size)
    ) GROUP BY ALL
), totals AS (
    SELECT lang, sum(a)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang
), candidates AS (
    SELECT *, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND a >= 30
), inner_parts AS (
    SELECT c.lang, c.a, unnest(list_transform(range(1, c.size - t.short + 2), lambda i: array_to_string(c.w[i:i + t.short - 1], ' '))) AS phrase
    FROM candidates c JOIN range(2, 4) AS t(short) ON t.short < c.size
), kept AS (
    SELECT c.* FROM candidates c LEFT JOIN (SELECT lang, phrase, max(a) AS most FROM inner_parts GROUP BY ALL) x USING (lang, phrase)
    WHERE x.most IS NULL OR 100::HUGEINT * x.most < 80::HUGEINT * c.a
), cuts AS (
    SELECT k.lang, k.phrase, k.a, t.cut, lf.a AS l, rf.a AS r, ((2000000::HUGEINT * k.a) // (lf.a + rf.a))::BIGINT AS score
    FROM kept k JOIN range(1, 4) AS t(cut) ON t.cut < k.size
    JOIN f lf ON lf.lang = k.lang AND lf.phrase = array_to_string(k.w[1:t.cut], ' ')
    JOIN f rf ON rf.lang = k.lang AND rf.phrase = array_to_string(k.w[t.cut + 1:], ' ')
), lowest AS (
    SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
)
SELECT lang, rank::INTEGER AS rank, phrase, a, l, r, n, score FROM (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest
) JOIN totals USING (lang) WHERE rank <= 2000
"""


CHECKS = {
    "op1_language_id": Check(language_id),
    "op2_quality": Check(quality_scores),
    "op3_nearest_vectors": Check(nearest_vectors, NEAREST_SQL),
    "op4_packing": Check(packed_documents),
    "op5_near_duplicates": Check(near_duplicates),
    "op6_piece_ids": Check(piece_ids),
    "op7_document_fingerprints": Check(document_fingerprints),
    "op8_personal_data": Check(personal_data),
    "op9_web_archive": Check(web_archive, ARCHIVE_SQL),
    "op10_main_text": Check(main_text),
    "op11_token_counts": Check(token_counts),
    "op12_ranked_search": Check(ranked_search, SEARCH_SQL),
    "op13_phrase_collocations": Check(phrase_collocations, COLLOCATION_SQL),
}
