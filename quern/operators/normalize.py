"""Text normalisation for indexing: tokens without stopwords, in dictionary form.

The lexicon is a table ``(lemma, pos)`` with ``pos`` ``n`` or ``v``; irregular forms are a table
``(word, pos, lemma)``.  A word's form is the shortest lexicon entry among the word itself and what the
public suffix rules make of it.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from quern.functions import fixed, text, words
from quern.operators.skew import at_most, lookup_join
from quern.sources.tables import store

# A lexicon up to this many entries (40 MB) is sent to every executor; a larger one is joined.
LEXICON_ROWS = 2_000_000
STOPWORDS = tuple(fixed.ENGLISH_STOPWORDS) + tuple(fixed.UNIT_STOPWORDS)
RULES = {"n": words.DETACH_NOUN, "v": words.DETACH_VERB}


# --- Lemma table over a vocabulary -----------------------------------------------------------------------
def candidates(word: Column, pos: str) -> Column:
    """``[{form, nth}]``: the word and each form its suffixes allow."""
    made = [F.struct(word.alias("form"), F.lit(0).alias("nth"))]
    for nth, (ending, replacement) in enumerate(RULES[pos], 1):
        stem = F.substr(word, F.lit(1), F.length(word) - len(ending))
        made.append(
            F.when(
                F.endswith(word, F.lit(ending)),
                F.struct(F.concat(stem, F.lit(replacement)).alias("form"), F.lit(nth).alias("nth")),
            )
        )
    return F.array_compact(F.array(*made))


def lemma_table(
    vocabulary: DataFrame, lexicon: DataFrame, pos: str, irregular: DataFrame | None = None, word_col: str = "token"
) -> DataFrame:
    """``(token, lemma)`` for the distinct words that the lexicon knows in some form."""
    vocabulary = vocabulary.select(F.col(word_col).alias("token")).distinct()
    forms = vocabulary.select("token", F.inline(candidates(F.col("token"), pos)))
    if irregular is not None:
        listed = irregular.where(F.col("pos") == pos).select(F.col("word").alias("token"), F.col("lemma").alias("form"))
        extra = vocabulary.join(listed, "token").select("token", "form", F.lit(0).alias("nth"))
        ruled = forms.where(F.col("nth") == 0).unionByName(forms.where(F.col("nth") > 0).join(extra, "token", "left_anti"))
        forms = ruled.unionByName(extra)
    known = lexicon.where(F.col("pos") == pos).select(F.col("lemma").alias("form")).distinct()
    best = forms.join(known, "form").groupBy("token")
    return best.agg(F.min(F.struct(F.length("form"), "nth", "form"))["form"].alias("lemma"))


def noun_forms(vocabulary: DataFrame, lexicon: DataFrame, irregular: DataFrame | None = None) -> DataFrame:
    return lemma_table(vocabulary, lexicon, "n", irregular)


def verb_noun_forms(vocabulary: DataFrame, lexicon: DataFrame, irregular: DataFrame | None = None) -> DataFrame:
    """Verb form if it differs from the word, else noun form."""
    as_verb = lemma_table(vocabulary, lexicon, "v", irregular).where(F.col("lemma") != F.col("token"))
    as_noun = lemma_table(vocabulary, lexicon, "n", irregular).withColumnRenamed("lemma", "noun")
    both = as_noun.join(as_verb, "token", "full")
    return both.select("token", F.coalesce("lemma", "noun").alias("lemma"))


# --- Lemmatising token lists -----------------------------------------------------------------------------------
def _sorted_words(column: pa.ChunkedArray) -> words.SortedWords:
    return words.SortedWords(column.combine_chunks())


def _in_place(df: DataFrame, column: str, change, *values) -> DataFrame:
    """Change the distinct words of a column of phrases in each batch; ``values`` are sent to every executor."""
    shared = df.sparkSession.sparkContext.broadcast(values)
    per_list = words.map_phrase_words

    @arrow_udf(text.STRINGS)
    def changed(lists: pa.Array) -> pa.Array:
        return per_list(lists, lambda tokens: change(tokens, *shared.value))

    return df.withColumn(column, changed(F.col(column)))


def _lemmatise_in_place(df: DataFrame, column: str, lexicon: DataFrame, order: str, irregular: DataFrame | None) -> DataFrame:
    """Workers search sorted buffers of the lexicon: some 20 bytes an entry, 40 MB for the most that is sent."""
    listed = lexicon.select("lemma", "pos").where(F.col("pos").isin("n", "v")).distinct().toArrow().sort_by([("pos", "ascending"), ("lemma", "ascending")])
    lists = {pos: _sorted_words(listed.filter(pc.field("pos") == pos)["lemma"]) for pos in ("n", "v")}
    if irregular is None:
        return _in_place(df, column, words.listed_forms, lists, order)
    keyed = irregular.select(F.concat("word", F.lit("\0"), "pos").alias("key"), "lemma").dropna().toArrow()
    keyed = keyed.sort_by([("key", "ascending"), ("lemma", "ascending")])
    exceptions = _sorted_words(keyed["key"]), _sorted_words(keyed["lemma"])
    shared = df.sparkSession.sparkContext.broadcast((lists, exceptions))
    make, per_list = words.form_finder, words.map_word_lists

    @arrow_udf(text.STRINGS)
    def lemmatise(lists: pa.Array) -> pa.Array:
        lemma = make(*shared.value, order)
        return per_list(lists, lambda phrase: " ".join(lemma(token) for token in phrase.split(" ")))

    return df.withColumn(column, lemmatise(F.col(column)))


def _changed_forms(df: DataFrame, column: str, lexicon: DataFrame, order: str, irregular: DataFrame | None) -> DataFrame:
    """``(token, lemma)`` of the words of a column that have another form; only distinct words are shuffled."""
    phrases = F.filter(column, lambda phrase: phrase.isNotNull())
    tokens = F.array_distinct(F.flatten(F.transform(phrases, lambda phrase: F.split(phrase, " "))))
    vocabulary = store(df.select(F.explode(tokens).alias("token")).distinct(), "vocabulary")
    table = (verb_noun_forms if order == "vn" else noun_forms)(vocabulary, lexicon, irregular)
    return store(table.where(F.col("token") != F.col("lemma")), "changed-forms")


def _lemmatise_by_join(
    df: DataFrame, column: str, lexicon: DataFrame, order: str, irregular: DataFrame | None, key: str
) -> DataFrame:
    placed = df.select(key, F.posexplode(column).alias("item", "phrase"))
    placed = placed.select(key, "item", F.posexplode(F.split("phrase", " ")).alias("at", "token"))
    placed = store(placed, "lemma-tokens")
    table = (verb_noun_forms if order == "vn" else noun_forms)(placed.select("token"), lexicon, irregular)
    named = lookup_join(placed, table, ["token"], "left").withColumn("lemma", F.coalesce("lemma", "token"))
    # Regrouping gives back one row per input row; a group is as large as that row was.
    phrases = named.groupBy(key, "item").agg(F.array_sort(F.collect_list(F.struct("at", "lemma")))["lemma"].alias("lemmas"))
    phrases = phrases.select(key, "item", F.array_join("lemmas", " ").alias("phrase"))
    lists = phrases.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("item", "phrase")))["phrase"].alias("_lists"))
    empty = F.when(F.col(column).isNotNull(), text.no_strings())
    return df.join(lists, key, "left").withColumn(column, F.coalesce("_lists", empty)).drop("_lists")


def lemmatise(
    df: DataFrame, column: str, lexicon: DataFrame, key: str, order: str = "n",
    irregular: DataFrame | None = None, lexicon_rows: int = LEXICON_ROWS,
) -> DataFrame:
    """Replace each word of an array of phrases by its dictionary form.

    ``order`` is ``n`` or ``vn``; ``key`` is unique per row.  With a counted, small lexicon every row is
    finished where it is.  A larger one is joined with the distinct words of the rows; if so few of them have another
    form, those are sent around instead, else all words go through joins.  All ways give the same rows.
    """
    small = at_most(lexicon, lexicon_rows) and (irregular is None or at_most(irregular, lexicon_rows))
    if small:
        return _lemmatise_in_place(df, column, lexicon, order, irregular)
    if lexicon_rows > 0:
        df = store(df, "prepared")
        changed = _changed_forms(df, column, lexicon, order, irregular)
        if at_most(changed, lexicon_rows):
            listed = changed.toArrow().sort_by("token")
            return _in_place(df, column, words.known_forms, _sorted_words(listed["token"]), _sorted_words(listed["lemma"]))
    return _lemmatise_by_join(df, column, lexicon, order, irregular, key)


# --- Records --------------------------------------------------------------------------------------------------
def _phrases(parts: Column, tokenise) -> Column:
    """One normalised phrase per part, before lemmatising; blanks go."""
    joined = F.transform(parts, lambda part: F.array_join(tokenise(F.coalesce(part, F.lit(""))), " "))
    return F.filter(joined, lambda phrase: phrase != "")


def normal_names(
    df: DataFrame, column: str, out: str, lexicon: DataFrame, key: str, stopwords: Sequence[str] = STOPWORDS, **options
) -> DataFrame:
    """Normalise an array of short names."""
    prepared = df.withColumn(out, _phrases(F.col(column), lambda part: text.name_tokens(part, stopwords)))
    return lemmatise(prepared, out, lexicon, key, "n", **options)


def normal_prose(
    df: DataFrame, column: str, out: str, lexicon: DataFrame, key: str, stopwords: Sequence[str] = STOPWORDS, **options
) -> DataFrame:
    """Normalise an array of sentences."""
    prepared = df.withColumn(out, _phrases(F.col(column), lambda part: text.prose_tokens(part, stopwords)))
    return lemmatise(prepared, out, lexicon, key, "vn", **options)


def vocabulary_size(phrases: Column) -> Column:
    return F.size(F.array_distinct(F.flatten(F.transform(phrases, lambda phrase: F.split(phrase, " ")))))


def index_text(names: Column, prose: Column) -> Column:
    """Names, then sentences; an empty side leaves no blank."""
    sides = F.array(F.array_join(names, " "), F.array_join(prose, " "))
    return F.array_join(F.filter(sides, lambda side: side != ""), " ")


def normalise_records(df: DataFrame, names: str, prose: str, lexicon: DataFrame, key: str, **options) -> DataFrame:
    """Adds both normalised lists, their vocabulary sizes and sum, and the text to index; ``key`` is unique per row."""
    out = normal_names(df, names, "ingredients_tfidf", lexicon, key, **options)
    out = normal_prose(out, prose, "instructions_tfidf", lexicon, key, **options)
    return out.withColumns(
        {
            "ingredient_vocab_size": vocabulary_size(F.col("ingredients_tfidf")),
            "instruction_vocab_size": vocabulary_size(F.col("instructions_tfidf")),
            "tfidf_text": index_text(F.col("ingredients_tfidf"), F.col("instructions_tfidf")),
        }
    ).withColumn("total_vocab_size", F.col("ingredient_vocab_size") + F.col("instruction_vocab_size"))


def vocabulary_reduction(df: DataFrame, before: str, after: str, approximate: bool = False) -> DataFrame:
    """Distinct words of an array column before and after normalisation, and the reduction in percent."""
    raw = F.filter(text.split_on(F.lower(F.array_join(before, " ")), r"(?U)\s+"), lambda word: word != "")
    done = F.filter(text.split_on(F.array_join(after, " "), " "), lambda word: word != "")
    tagged = df.select(
        F.explode(
            F.concat(
                F.transform(F.array_distinct(raw), lambda word: F.struct(F.lit(True).alias("raw"), word.alias("word"))),
                F.transform(F.array_distinct(done), lambda word: F.struct(F.lit(False).alias("raw"), word.alias("word"))),
            )
        ).alias("e")
    ).select("e.*")
    if approximate:
        counts = tagged.agg(
            F.approx_count_distinct(F.when(F.col("raw"), F.col("word"))).alias("vocab_before"),
            F.approx_count_distinct(F.when(~F.col("raw"), F.col("word"))).alias("vocab_after"),
        )
    else:
        counts = tagged.distinct().agg(
            F.count_if("raw").alias("vocab_before"), F.count_if(~F.col("raw")).alias("vocab_after")
        )
    fewer = F.col("vocab_before") - F.col("vocab_after")
    return counts.withColumn("reduction_percent", F.try_divide(F.lit(100.0) * fewer, F.col("vocab_before")))


def vocabulary_means(normalised: DataFrame) -> DataFrame:
    return normalised.agg(
        *[F.avg(f"{name}_vocab_size").alias(f"mean_{name}_vocab") for name in ("ingredient", "instruction", "total")]
    )


def changed_samples(df: DataFrame, key: str, before: str, after: str, limit: int, longer_than: int = 0) -> DataFrame:
    """The first pairs that normalisation changed.  Both lists are aligned element by element."""
    pairs = df.select(key, F.posexplode(F.arrays_zip(F.col(before).alias("before"), F.col(after).alias("after"))).alias("pos", "pair"))
    shown = pairs.select(key, "pos", "pair.before", "pair.after").where(
        (F.length("before") > longer_than) & (F.col("after") != "") & (F.col("before") != F.col("after"))
    )
    return shown.orderBy(key, "pos").limit(limit)


def paired_names(
    df: DataFrame, column: str, lexicon: DataFrame, key: str, stopwords: Sequence[str] = STOPWORDS, prose: bool = False, **options
) -> DataFrame:
    """Adds ``paired``: one normalised phrase per element of ``column``, blanks kept, for comparisons."""
    tokenise = text.prose_tokens if prose else text.name_tokens
    kept = F.transform(
        F.col(column), lambda part: F.array_join(tokenise(F.coalesce(part, F.lit("")), stopwords), " ")
    )
    return lemmatise(df.withColumn("paired", kept), "paired", lexicon, key, "vn" if prose else "n", **options)
