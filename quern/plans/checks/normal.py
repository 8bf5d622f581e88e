"""Normalisation of document lines, stems, and the stemmed search index.

The lexicon is the vocabulary of ``benchmark`` and ``conversations``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import fixed, text, words
from quern.operators import normalize, retrieve, tfidf
from quern.plans.checks.registry import Check
from quern.plans.checks.search import QUERY, TITLES_SQL, with_titles
from quern.plans.checks.stem_sql import stem_sql
from quern.plans.tables import shared, table
from quern.sources.tables import store

MAX_FEATURES = 10_000


def lexicon(spark, sf_dir):
    """Each token is a noun; tokens of even length are verbs, too."""
    def build():
        texts = table(spark, sf_dir, "benchmark").select("text").unionByName(table(spark, sf_dir, "conversations").select("text"))
        tokens = texts.select(F.explode(text.extract_all(F.lower("text"), "[a-z]{3,}")).alias("lemma")).distinct()
        pos = F.when(F.length("lemma") % 2 == 0, F.array(F.lit("n"), F.lit("v"))).otherwise(F.array(F.lit("n")))
        return store(tokens.select("lemma", F.explode(pos).alias("pos")), "lexicon")

    return shared(spark, sf_dir, "lexicon", build)


def documents(spark, sf_dir):
    """The lines of a document serve as names and as sentences."""
    return table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("lines"))


def normalised(spark, sf_dir):
    def build():
        done = normalize.normalise_records(documents(spark, sf_dir), "lines", "lines", lexicon(spark, sf_dir), "doc_id")
        return store(done, "normalised")

    return shared(spark, sf_dir, "normalised", build)


def long(name):
    return F.col(name).cast("bigint").alias(name)


def digest(name):
    joined = F.array_join(name, "|")
    return [F.size(name).cast("bigint").alias("n_phrases"), F.length(joined).cast("bigint").alias("n_chars"), F.md5(joined).alias("digest")]


def n01_names(spark, sf_dir):
    return normalize.normal_names(documents(spark, sf_dir), "lines", "out", lexicon(spark, sf_dir), "doc_id").select("doc_id", *digest("out"))


def n02_prose(spark, sf_dir):
    return normalize.normal_prose(documents(spark, sf_dir), "lines", "out", lexicon(spark, sf_dir), "doc_id").select("doc_id", *digest("out"))


def n03_stopwords(spark, sf_dir):
    """How often each listed word was left out."""
    def tokens(stopwords):
        return F.flatten(F.transform("lines", lambda line: text.prose_tokens(line, stopwords)))

    found = documents(spark, sf_dir).select(F.explode(tokens(())).alias("token"))
    return found.where(F.col("token").isin(*normalize.STOPWORDS)).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def vocabulary(spark, sf_dir):
    tokens = F.flatten(F.transform("lines", lambda line: text.prose_tokens(line, normalize.STOPWORDS)))
    return documents(spark, sf_dir).select(F.explode(F.array_distinct(tokens)).alias("token"))


def n04_noun_lemmas(spark, sf_dir):
    return normalize.noun_forms(vocabulary(spark, sf_dir), lexicon(spark, sf_dir))


def n04_verb_lemmas(spark, sf_dir):
    return normalize.verb_noun_forms(vocabulary(spark, sf_dir), lexicon(spark, sf_dir))


def n04_lemmas_by_join(spark, sf_dir):
    """The route for a lexicon that is too large to send around; same result as ``n02_prose``."""
    kept = F.transform("lines", lambda line: F.array_join(text.prose_tokens(line, normalize.STOPWORDS), " "))
    prepared = documents(spark, sf_dir).select("doc_id", F.filter(kept, lambda phrase: phrase != "").alias("out"))
    done = normalize.lemmatise(prepared, "out", lexicon(spark, sf_dir), "doc_id", "vn", lexicon_rows=0)
    return done.select("doc_id", *digest("out"))


def n05_vocabulary_sizes(spark, sf_dir):
    return normalised(spark, sf_dir).select("doc_id", long("ingredient_vocab_size"), long("instruction_vocab_size"))


def n06_index_text(spark, sf_dir):
    return normalised(spark, sf_dir).select(
        "doc_id", F.length("tfidf_text").cast("bigint").alias("n_chars"), F.md5("tfidf_text").alias("digest")
    )


def n07_total_size(spark, sf_dir):
    return normalised(spark, sf_dir).select("doc_id", long("total_vocab_size"))


def n08_vocabulary_reduction(spark, sf_dir):
    done = normalised(spark, sf_dir)
    parts = [
        normalize.vocabulary_reduction(done, "lines", after).withColumn("field", F.lit(after))
        for after in ("ingredients_tfidf", "instructions_tfidf")
    ]
    return parts[0].unionByName(parts[1]).withColumn("reduction_percent", F.round("reduction_percent", 6))


def n09_mean_sizes(spark, sf_dir):
    means = normalize.vocabulary_means(normalised(spark, sf_dir))
    return means.withColumns({name: F.round(name, 6) for name in means.columns})


def n10_changed_names(spark, sf_dir):
    paired = normalize.paired_names(documents(spark, sf_dir), "lines", lexicon(spark, sf_dir), "doc_id")
    samples = normalize.changed_samples(paired, "doc_id", "lines", "paired", 6)
    return samples.withColumn("pos", F.col("pos").cast("bigint"))


def n10_changed_prose(spark, sf_dir):
    paired = normalize.paired_names(documents(spark, sf_dir), "lines", lexicon(spark, sf_dir), "doc_id", prose=True)
    samples = normalize.changed_samples(paired, "doc_id", "lines", "paired", 3, longer_than=20)
    return samples.withColumn("pos", F.col("pos").cast("bigint"))


def n11_stems(spark, sf_dir):
    """Stem table over the distinct words of all documents."""
    found = table(spark, sf_dir, "documents").select(F.explode(text.letter_tokens(F.col("text"))).alias("word")).distinct()
    return found.select("word", text.stem_word(F.col("word")).alias("stem"))


def stemmed_index(spark, sf_dir):
    def build():
        boosted = tfidf.boosted_text(with_titles(spark, sf_dir), "title", "body")
        return tfidf.build_index(boosted, "doc_id", "text", tfidf.STEMS, max_features=MAX_FEATURES, name="stemmed")

    return shared(spark, sf_dir, "stemmed-index", build)


def full_stemmed_index(spark, sf_dir):
    """The same without a limit on the vocabulary."""
    def build():
        boosted = tfidf.boosted_text(with_titles(spark, sf_dir), "title", "body")
        return tfidf.build_index(boosted, "doc_id", "text", tfidf.STEMS, name="stemmed-full")

    return shared(spark, sf_dir, "stemmed-full-index", build)


def v01_stemmed_terms(spark, sf_dir):
    """Stems without stopwords, title counted three times, the most frequent terms kept."""
    return stemmed_index(spark, sf_dir).terms.select("term", "df", "total_tf")


def v10_stemmed_search(spark, sf_dir):
    found = retrieve.search(stemmed_index(spark, sf_dir), QUERY, limit=20)
    return found.select("doc_id", "rank", F.round("score", 6).alias("score"))


def v10_full_stemmed_search(spark, sf_dir):
    found = retrieve.search(full_stemmed_index(spark, sf_dir), QUERY, limit=20)
    return found.select("doc_id", "rank", F.round("score", 6).alias("score"))


def listed(names) -> str:
    return ", ".join("'" + name.replace("'", "''") + "'" for name in names)


STOP = listed(normalize.STOPWORDS)


def candidates_sql(pos: str) -> str:
    rules = {"n": words.DETACH_NOUN, "v": words.DETACH_VERB}[pos]
    parts = ["SELECT word, 0 AS nth, word AS form FROM vocab"]
    for nth, (ending, new) in enumerate(rules, 1):
        parts.append(
            f"SELECT word, {nth}, left(word, length(word) - {len(ending)}) || '{new}' FROM vocab WHERE ends_with(word, '{ending}')"
        )
    return f"""SELECT word, min((length(form), nth, form))[3] AS lemma FROM ({' UNION ALL '.join(parts)})
        JOIN (SELECT lemma AS form FROM lexicon WHERE pos = '{pos}') USING (form) GROUP BY word"""


def treebank_sql(text: str) -> str:
    """Treebank splitting without looking around.  Sentences end at white space, where letters end anyway."""
    quoted = [part.replace("'", "''") for part in fixed.TREEBANK_ENDINGS]
    steps = [
        (r"[\s\x0B\x85\xA0]+", " "), (r"''([a-ce-lo-ru-z0-9_])\b", r"'' \1"), (fixed.TREEBANK_MARKS.replace("'", "''"), r" \0 "),
        (r"([:,])([^0-9])", r" \1 \2"), (rf"([^'' ])({'|'.join(quoted)})( |$)", r"\1 \2 "),
    ]
    for left, right in fixed.TREEBANK_PAIRS:
        if "'" not in left + right:
            steps.append((rf"\b({left})({right}){' ' if left == 'wan' else chr(92) + 'b'}", r"\1 \2 "))
    for pattern, new in steps:
        text = f"regexp_replace({text}, '{pattern}', '{new}', 'g')"
    return text


TREEBANK_SQL = treebank_sql("lower(line)")
NORMAL = rf"""
WITH lexicon AS (
  SELECT lemma, unnest(CASE WHEN length(lemma) % 2 = 0 THEN ['n', 'v'] ELSE ['n'] END) AS pos FROM (
    SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{{3,}}')) AS lemma
    FROM (SELECT text FROM benchmark UNION ALL SELECT text FROM conversations))
), lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS li FROM documents
), name_lists AS (
  SELECT doc_id, li, list_transform(string_split_regex({TREEBANK_SQL}, ' +'), lambda x: regexp_replace(x, '[^a-z]', '', 'g')) AS t FROM lines
), prose_lists AS (
  SELECT doc_id, li, string_split_regex(trim(regexp_replace(regexp_replace(regexp_replace(lower(line),
      '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\p{{Nd}}+', ' ', 'g'), '\bcannot\b', 'can not', 'g'), ' ' || chr(9) || chr(13)), '\s+') AS t FROM lines
), name_words AS (
  SELECT doc_id, li, unnest(t) AS word, generate_subscripts(t, 1) AS wi FROM name_lists
), prose_words AS (
  SELECT doc_id, li, unnest(t) AS word, generate_subscripts(t, 1) AS wi FROM prose_lists
), names_kept AS (
  SELECT * FROM name_words WHERE length(word) >= 3 AND word NOT IN ({STOP})
), prose_kept AS (
  SELECT * FROM prose_words WHERE length(word) >= 3 AND word NOT IN ({STOP})
), vocab AS (
  SELECT DISTINCT word FROM (SELECT word FROM names_kept UNION ALL SELECT word FROM prose_kept)
), nouns AS ({candidates_sql('n')}), verbs AS ({candidates_sql('v')}),
forms AS (
  SELECT v.word, n.lemma AS noun, coalesce(CASE WHEN b.lemma <> v.word THEN b.lemma END, n.lemma) AS verb_noun
  FROM vocab v LEFT JOIN nouns n USING (word) LEFT JOIN verbs b USING (word)
), name_phrases AS (
  SELECT doc_id, li, string_agg(coalesce(noun, word), ' ' ORDER BY wi) AS phrase FROM names_kept JOIN forms USING (word) GROUP BY ALL
), prose_phrases AS (
  SELECT doc_id, li, string_agg(coalesce(verb_noun, word), ' ' ORDER BY wi) AS phrase FROM prose_kept JOIN forms USING (word) GROUP BY ALL
), name_docs AS (
  SELECT doc_id, count(*) AS n_phrases, string_agg(phrase, '|' ORDER BY li) AS joined, string_agg(phrase, ' ' ORDER BY li) AS spaced FROM name_phrases GROUP BY doc_id
), prose_docs AS (
  SELECT doc_id, count(*) AS n_phrases, string_agg(phrase, '|' ORDER BY li) AS joined, string_agg(phrase, ' ' ORDER BY li) AS spaced FROM prose_phrases GROUP BY doc_id
), name_sizes AS (
  SELECT doc_id, count(DISTINCT coalesce(noun, word)) AS n FROM names_kept JOIN forms USING (word) GROUP BY doc_id
), prose_sizes AS (
  SELECT doc_id, count(DISTINCT coalesce(verb_noun, word)) AS n FROM prose_kept JOIN forms USING (word) GROUP BY doc_id
), sizes AS (
  SELECT doc_id, coalesce(a.n, 0) AS names, coalesce(b.n, 0) AS prose
  FROM documents LEFT JOIN name_sizes a USING (doc_id) LEFT JOIN prose_sizes b USING (doc_id)
)
"""


def digest_sql(source: str) -> str:
    return NORMAL + f"""SELECT doc_id, coalesce(n_phrases, 0) AS n_phrases, coalesce(length(joined), 0) AS n_chars,
        md5(coalesce(joined, '')) AS digest FROM documents LEFT JOIN {source} USING (doc_id)"""


def reduction_sql(field: str, kept: str, form: str) -> str:
    return f"""SELECT '{field}' AS field, b AS vocab_before, a AS vocab_after, round(100.0::DOUBLE * (b - a) / b, 6) AS reduction_percent
      FROM (SELECT (SELECT count(DISTINCT w) FROM (SELECT unnest(string_split_regex(lower(line), '\\s+')) AS w FROM lines) WHERE w <> '') AS b,
        (SELECT count(DISTINCT coalesce({form}, word)) FROM {kept} JOIN forms USING (word)) AS a)"""


def samples_sql(source: str, limit: int, longer: int) -> str:
    return NORMAL + f"""SELECT doc_id, li - 1 AS pos, line AS before, phrase AS after FROM lines JOIN {source} USING (doc_id, li)
        WHERE line <> phrase AND length(line) > {longer} ORDER BY doc_id, li LIMIT {limit}"""


WORDS_SQL = "SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents"
STEMMED = f"""
WITH {stem_sql(WORDS_SQL + f" UNION ALL SELECT unnest(regexp_extract_all('{QUERY}', '[a-z]+'))")}, texts AS (
  SELECT doc_id, repeat(title || ' ', 3) || body AS text FROM ({TITLES_SQL})
  UNION ALL SELECT -1, '{QUERY}'
), placed AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS at_ FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM texts)
), uni AS (
  SELECT doc_id, stem AS term, at_ FROM placed JOIN stemmed USING (word) WHERE stem NOT IN ({listed(fixed.ENGLISH_STOPWORDS)})
), grams AS (
  SELECT doc_id, term FROM uni UNION ALL
  SELECT doc_id, term || ' ' || next FROM (SELECT doc_id, term, lead(term) OVER (PARTITION BY doc_id ORDER BY at_) AS next FROM uni) WHERE next IS NOT NULL
), tf AS (SELECT doc_id, term, count(*) AS tf FROM grams GROUP BY ALL
), terms AS (
  SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total_tf,
    ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + count(*))) + 1.0 AS idf FROM tf WHERE doc_id >= 0 GROUP BY term
  ORDER BY total_tf DESC, term LIMIT {MAX_FEATURES}
), vectors AS (
  SELECT doc_id, term, tf * idf AS raw, sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY doc_id)) AS norm FROM tf JOIN terms USING (term)
), scored AS (
  SELECT d.doc_id, sum(q.raw / q.norm * d.raw / d.norm) AS score FROM vectors q JOIN vectors d USING (term)
  WHERE q.doc_id = -1 AND d.doc_id >= 0 GROUP BY d.doc_id
)
"""

CHECKS = {
    "n01_names": Check(n01_names, digest_sql("name_docs")),
    "n02_prose": Check(n02_prose, digest_sql("prose_docs")),
    "n03_stopwords": Check(n03_stopwords, NORMAL + f"""
        SELECT word AS token, count(*) AS n FROM prose_words WHERE length(word) >= 3 AND word IN ({STOP}) GROUP BY word"""),
    "n04_noun_lemmas": Check(n04_noun_lemmas, NORMAL + """
        SELECT word AS token, lemma FROM nouns WHERE word IN (SELECT word FROM prose_kept)"""),
    "n04_verb_lemmas": Check(n04_verb_lemmas, NORMAL + """
        SELECT word AS token, verb_noun AS lemma FROM forms WHERE verb_noun IS NOT NULL AND word IN (SELECT word FROM prose_kept)"""),
    "n04_lemmas_by_join": Check(n04_lemmas_by_join, digest_sql("prose_docs")),
    "n05_vocabulary_sizes": Check(n05_vocabulary_sizes, NORMAL + """
        SELECT doc_id, names AS ingredient_vocab_size, prose AS instruction_vocab_size FROM sizes"""),
    "n06_index_text": Check(n06_index_text, NORMAL + """
        SELECT doc_id, length(t) AS n_chars, md5(t) AS digest FROM (
          SELECT doc_id, concat_ws(' ', a.spaced, b.spaced) AS t
          FROM documents LEFT JOIN name_docs a USING (doc_id) LEFT JOIN prose_docs b USING (doc_id))"""),
    "n07_total_size": Check(n07_total_size, NORMAL + "SELECT doc_id, names + prose AS total_vocab_size FROM sizes"),
    "n08_vocabulary_reduction": Check(n08_vocabulary_reduction, NORMAL + reduction_sql("ingredients_tfidf", "names_kept", "noun")
        + " UNION ALL " + reduction_sql("instructions_tfidf", "prose_kept", "verb_noun")),
    "n09_mean_sizes": Check(n09_mean_sizes, NORMAL + """
        SELECT round(avg(names), 6) AS mean_ingredient_vocab, round(avg(prose), 6) AS mean_instruction_vocab,
          round(avg(names + prose), 6) AS mean_total_vocab FROM sizes"""),
    "n10_changed_names": Check(n10_changed_names, samples_sql("name_phrases", 6, 0)),
    "n10_changed_prose": Check(n10_changed_prose, samples_sql("prose_phrases", 3, 20)),
    "n11_stems": Check(n11_stems, "WITH " + stem_sql(WORDS_SQL) + " SELECT word, stem FROM stemmed"),
    "v01_stemmed_terms": Check(v01_stemmed_terms, STEMMED + "SELECT term, df, total_tf FROM terms"),
    "v10_full_stemmed_search": Check(v10_full_stemmed_search, STEMMED.replace(f" LIMIT {MAX_FEATURES}", "") + """
        SELECT doc_id, row_number() OVER (ORDER BY round(score, 10) DESC, doc_id) AS rank, round(score, 6) AS score
        FROM scored ORDER BY rank LIMIT 20"""),
    "v10_stemmed_search": Check(v10_stemmed_search, STEMMED + """
        SELECT doc_id, row_number() OVER (ORDER BY round(score, 10) DESC, doc_id) AS rank, round(score, 6) AS score
        FROM scored ORDER BY rank LIMIT 20"""),
}
