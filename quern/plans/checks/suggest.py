"""Autocomplete over part names and types; queries are cut from the same table.

The stems of the few words that occur in ``part`` are spelled out for the SQL side.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import text
from quern.operators import phrases
from quern.plans.checks.registry import Check
from quern.plans.tables import derive, plain, shared

# Titles are singular or plural by size, so that stems collide; types and brands are the ingredients.
RECORDS = """
SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN concat(p_name, 's') ELSE p_name END AS title,
       p_type, concat(p_type, '-(', p_brand, ')') AS branded
FROM {part}
"""

# Partial words, several words, words in another order, an unknown lead, and a blank query.
QUERIES = """
SELECT DISTINCT query FROM (
  SELECT substr(p_name, 1, length(p_name) - 2) AS query FROM {part}
  UNION ALL SELECT concat('  ', upper(substr(p_name, 1, 3)), ' ') FROM {part}
  UNION ALL SELECT concat(split_part(p_name, ' ', 2), 's') FROM {part}
  UNION ALL SELECT concat(split_part(p_name, ' ', 2), 's ', substr(p_name, 1, 2)) FROM {part}
  UNION ALL SELECT concat('zz ', substr(p_name, 1, length(p_name) - 1)) FROM {part}
  UNION ALL SELECT concat(p_type, ' b') FROM {part}
  UNION ALL SELECT p_brand FROM {part}
  UNION ALL SELECT concat(split_part(p_name, ' ', 1), 's ', substr(split_part(p_name, ' ', 2), 1, 2)) FROM {part}
  UNION ALL SELECT substr(p_name, 1, 0) FROM {part}
)
"""


def records(spark, sf_dir):
    return derive(spark, sf_dir, RECORDS).withColumn("names", F.array("p_type", "branded"))


def documents(spark, sf_dir):
    return phrases.training_phrases(records(spark, sf_dir), "p_partkey", "title", "names")


def index(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return shared(spark, sf_dir, "phrase-index", lambda: phrases.build_phrase_index(docs))


def queries(spark, sf_dir):
    return derive(spark, sf_dir, QUERIES)


def prepared(spark, sf_dir):
    return phrases.prepare_queries(queries(spark, sf_dir), "query", "query")


def count_as_long(df):
    return df.select(*[F.col(c).cast("bigint").alias(c) if t == "int" else F.col(c) for c, t in df.dtypes])


def a01_normalise(spark, sf_dir):
    normal = records(spark, sf_dir).select(F.col("branded").alias("raw"), text.normal_phrase(F.col("branded")).alias("phrase"))
    return normal.groupBy("raw", "phrase").agg(F.count(F.lit(1)).alias("n"))


def a02_training_phrases(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.col("pos").cast("bigint").alias("pos"), "text", "source")


def a03_phrase_counts(spark, sf_dir):
    return phrases.phrase_counts(documents(spark, sf_dir)).select("phrase", "cnt")


def a04_source_labels(spark, sf_dir):
    counted = phrases.phrase_counts(documents(spark, sf_dir))
    return counted.select("phrase", F.array_join("sources", ", ").alias("source"))


def a05_one_per_stem(spark, sf_dir):
    return index(spark, sf_dir).phrases.select("phrase", "cnt", "stemmed", F.array_join("sources", ", ").alias("source"))


def a06_prefixes(spark, sf_dir):
    return index(spark, sf_dir).prefixes


def a07_words(spark, sf_dir):
    return index(spark, sf_dir).words


def a08_most_frequent(spark, sf_dir):
    return phrases.most_frequent(index(spark, sf_dir)).select("phrase", "cnt")


def a09_prefix_tier(spark, sf_dir):
    found = phrases.prefix_matches(index(spark, sf_dir), prepared(spark, sf_dir))
    return found.where(F.col("tier") == 1).select("query_id", "phrase", "cnt")


def a10_stemmed_tier(spark, sf_dir):
    found = phrases.prefix_matches(index(spark, sf_dir), prepared(spark, sf_dir))
    return found.where(F.col("tier") == 2).select("query_id", "phrase", "cnt")


def a11_several_words(spark, sf_dir):
    found = phrases.phrase_word_matches(index(spark, sf_dir), prepared(spark, sf_dir))
    return found.select("query_id", "phrase", "cnt")


def a12_one_word(spark, sf_dir):
    found = phrases.word_prefix_matches(index(spark, sf_dir), prepared(spark, sf_dir)).distinct()
    return found.select("query_id", "phrase", "cnt")


def a13_trailing_words(spark, sf_dir):
    found = phrases.trailing_matches(index(spark, sf_dir), prepared(spark, sf_dir))
    return found.select("query_id", "phrase", "cnt")


def a14_suggest(spark, sf_dir):
    found = phrases.suggest(index(spark, sf_dir), queries(spark, sf_dir), 15, "query", "query")
    return count_as_long(found)


def a15_facts(spark, sf_dir):
    return phrases.phrase_facts(index(spark, sf_dir))


STEMS = """
WITH records AS (""" + plain(RECORDS) + """), documents_ AS (
  SELECT p_partkey AS doc_id, 0 AS pos, lower(title) AS text, 'title' AS source FROM records
  UNION ALL SELECT p_partkey, 1, lower(p_type), 'ingredient' FROM records
  UNION ALL SELECT p_partkey, 2, replace(replace(replace(lower(branded), '-(', ' '), '#', ' '), ')', ''), 'ingredient' FROM records
), stems AS (
  SELECT word, CASE word WHEN 'economy' THEN 'economi' WHEN 'large' THEN 'larg' WHEN 'larges' THEN 'larg' ELSE
    CASE WHEN word IN ('anvils', 'bolts', 'gears', 'gizmos', 'plates', 'rings', 'rods', 'widgets',
                       'blues', 'colds', 'hots', 'olds', 'reds', 'smalls')
         THEN left(word, length(word) - 1) ELSE word END END AS stem
  FROM (SELECT DISTINCT unnest(string_split(text, ' ')) AS word FROM documents_
        UNION SELECT DISTINCT unnest(string_split(lower(trim(query)), ' ')) FROM (""" + plain(QUERIES) + """))
), counted AS (
  SELECT text AS phrase, count(*) AS cnt, string_agg(DISTINCT source, ', ' ORDER BY source) AS source,
         min((doc_id, pos)) AS first
  FROM documents_ GROUP BY text
), stemmed AS (
  SELECT phrase, string_agg(stem, ' ' ORDER BY nth) AS stemmed FROM (
    SELECT phrase, unnest(string_split(phrase, ' ')) AS word, generate_subscripts(string_split(phrase, ' '), 1) AS nth
    FROM counted) JOIN stems USING (word) GROUP BY phrase
), phrases AS (
  SELECT phrase, cnt, source, stemmed FROM (
    SELECT *, row_number() OVER (PARTITION BY stemmed ORDER BY cnt DESC, first) AS nth FROM counted JOIN stemmed USING (phrase))
  WHERE nth = 1
), prefixes AS (
  SELECT left(phrase, CAST(n AS BIGINT)) AS prefix, phrase, cnt
  FROM (SELECT phrase, cnt, unnest(range(1, length(phrase) + 1)) AS n FROM phrases)
), words AS (
  SELECT DISTINCT stem, phrase, cnt FROM (SELECT phrase, cnt, unnest(string_split(stemmed, ' ')) AS stem FROM phrases)
)"""

TIERS = STEMS + """, asked AS (
  SELECT query AS query_id, lower(trim(query)) AS q, string_split(lower(trim(query)), ' ') AS tokens
  FROM (""" + plain(QUERIES) + """)
), stem_q AS (
  SELECT query_id, string_agg(CASE WHEN nth < n OR n = 1 THEN stem ELSE word END, ' ' ORDER BY nth) AS stemmed_q FROM (
    SELECT query_id, len(tokens) AS n, unnest(tokens) AS word, generate_subscripts(tokens, 1) AS nth FROM asked
  ) JOIN stems USING (word) GROUP BY query_id
), tier1 AS (
  SELECT query_id, phrase, cnt FROM asked JOIN phrases ON starts_with(phrase, q) WHERE q <> ''
), tier2 AS (
  SELECT query_id, phrase, cnt FROM asked JOIN stem_q USING (query_id) JOIN phrases ON starts_with(phrase, stemmed_q)
  WHERE q <> '' AND stemmed_q <> q
), needed AS (
  SELECT DISTINCT query_id, stem FROM (
    SELECT query_id, len(tokens) AS n, unnest(tokens) AS word, generate_subscripts(tokens, 1) AS nth FROM asked
  ) JOIN stems USING (word) WHERE nth < n
), tier3 AS (
  SELECT a.query_id, w.phrase, w.cnt FROM asked a JOIN needed n USING (query_id) JOIN words w ON w.stem = n.stem
  WHERE len(list_filter(string_split(w.phrase, ' '), lambda x: starts_with(x, a.tokens[-1]))) > 0
  GROUP BY a.query_id, w.phrase, w.cnt
  HAVING count(*) = (SELECT count(*) FROM needed m WHERE m.query_id = a.query_id)
), tier3_one AS (
  SELECT query_id, phrase, cnt FROM asked JOIN phrases
    ON len(list_filter(string_split(phrase, ' '), lambda x: starts_with(x, q))) > 0
  WHERE len(tokens) = 1 AND q <> ''
), tails AS (
  SELECT query_id, n, array_to_string(tokens[len(tokens) - n + 1 : ], ' ') AS tail
  FROM (SELECT query_id, tokens, unnest(range(1, len(tokens))) AS n FROM asked)
), tier4 AS (
  SELECT query_id, phrase, cnt FROM (
    SELECT query_id, n, max(n) OVER (PARTITION BY query_id) AS longest, phrase, cnt
    FROM tails JOIN phrases ON starts_with(phrase, tail)) WHERE n = longest
), found AS (
  SELECT *, 1 AS tier FROM tier1 UNION ALL SELECT *, 2 FROM tier2
  UNION ALL SELECT *, 3 FROM tier3 UNION ALL SELECT *, 3 FROM tier3_one
), matched AS (
  SELECT query_id, phrase, cnt, min(tier) AS tier FROM (
    SELECT * FROM found UNION ALL SELECT *, 4 FROM tier4 WHERE query_id NOT IN (SELECT query_id FROM found)
    UNION ALL SELECT query_id, phrase, cnt, 0 FROM asked, phrases WHERE q = '') GROUP BY ALL
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tier, cnt DESC, phrase) AS rank FROM matched
)"""

CHECKS = {
    "a01_normalise": Check(a01_normalise, STEMS + """
        SELECT branded AS raw, replace(replace(replace(lower(branded), '-(', ' '), '#', ' '), ')', '') AS phrase, count(*) AS n
        FROM records GROUP BY ALL"""),
    "a02_training_phrases": Check(a02_training_phrases, STEMS + "SELECT doc_id, CAST(pos AS BIGINT) AS pos, text, source FROM documents_"),
    "a03_phrase_counts": Check(a03_phrase_counts, STEMS + "SELECT phrase, cnt FROM counted"),
    "a04_source_labels": Check(a04_source_labels, STEMS + "SELECT phrase, source FROM counted"),
    "a05_one_per_stem": Check(a05_one_per_stem, STEMS + "SELECT phrase, cnt, stemmed, source FROM phrases"),
    "a06_prefixes": Check(a06_prefixes, STEMS + "SELECT prefix, phrase, cnt FROM prefixes"),
    "a07_words": Check(a07_words, STEMS + "SELECT stem, phrase, cnt FROM words"),
    "a08_most_frequent": Check(a08_most_frequent, STEMS + "SELECT phrase, cnt FROM phrases ORDER BY cnt DESC, phrase LIMIT 15"),
    "a09_prefix_tier": Check(a09_prefix_tier, TIERS + "SELECT query_id, phrase, cnt FROM tier1"),
    "a10_stemmed_tier": Check(a10_stemmed_tier, TIERS + "SELECT query_id, phrase, cnt FROM tier2"),
    "a11_several_words": Check(a11_several_words, TIERS + "SELECT query_id, phrase, cnt FROM tier3"),
    "a12_one_word": Check(a12_one_word, TIERS + "SELECT query_id, phrase, cnt FROM tier3_one"),
    "a13_trailing_words": Check(a13_trailing_words, TIERS + "SELECT query_id, phrase, cnt FROM tier4"),
    "a14_suggest": Check(a14_suggest, TIERS + """
        SELECT query_id, rank, phrase AS text, source, CAST(tier AS BIGINT) AS tier
        FROM ranked JOIN phrases USING (phrase) WHERE rank <= 15"""),
    "a15_facts": Check(a15_facts, STEMS + """
        SELECT 'documents' AS fact, count(*) AS n FROM documents_ UNION ALL SELECT 'phrases', count(*) FROM phrases
        UNION ALL SELECT 'prefix_entries', count(*) FROM prefixes UNION ALL SELECT 'word_entries', count(*) FROM words"""),
}
