"""Tokenising, cleaning and splitting text as Column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from quern.functions import fixed, words

STRINGS = T.ArrayType(T.StringType())
Tokenizer = Callable[[Column], Column]


def no_strings() -> Column:
    return F.array().cast(STRINGS)


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``use``, which may mention it many times."""
    return F.get(F.transform(F.array(value), use), 0)


def replace_all(text: Column, pattern: str, replacement: str = "") -> Column:
    return F.regexp_replace(text, F.lit(pattern), F.lit(replacement))


def extract_all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def split_on(text: Column, pattern: str) -> Column:
    return F.split(text, pattern, -1)


def strip(text: Column) -> Column:
    """Trim every Unicode blank, not only the space character."""
    return F.btrim(text, F.lit(fixed.BLANKS))


def squeeze(text: Column) -> Column:
    return strip(replace_all(text, f"[{fixed.BLANKS}]+", " "))


def is_blank(text: Column) -> Column:
    return F.coalesce(strip(text) == "", F.lit(True))


def non_blank(parts: Column) -> Column:
    """Trim the parts and keep those with content."""
    return F.filter(F.transform(parts, strip), lambda part: part != "")


def shuffled(key: str, seed: int) -> Column:
    """A repeatable random sort key that does not depend on partitioning."""
    return F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))


# --- Tokenisers -----------------------------------------------------------------------------------
def word_tokens(text: Column) -> Column:
    """Lower-cased runs of two or more word characters of any script."""
    return extract_all(F.lower(text), r"[\p{L}\p{N}_]{2,}")


def letter_tokens(text: Column) -> Column:
    return extract_all(F.lower(text), r"[a-z]+")


@arrow_udf(STRINGS)
def _stem_lists(lists: pa.Array) -> pa.Array:
    return words.map_word_lists(lists, words.stem)


@arrow_udf(T.StringType())
def stem_word(tokens: pa.Array) -> pa.Array:
    return words.map_words(tokens, words.stem)


@arrow_udf(T.StringType())
def stem_phrase(phrases: pa.Array) -> pa.Array:
    return words.map_words(phrases, words.stem_phrase)


def stem_tokens(text: Column) -> Column:
    """Letter runs, each stemmed.  Only the distinct words of a batch reach the stemmer."""
    return _stem_lists(letter_tokens(text))


def without_words(tokens: Column, stopwords: Sequence[str]) -> Column:
    if not stopwords:
        return tokens
    return F.filter(tokens, lambda token: ~token.isin(*stopwords))


def ngrams(tokens: Column, smallest: int = 1, largest: int = 2) -> Column:
    """All word n-grams of the sizes asked for; a pure array expression, so no window or shuffle."""
    grams = []
    for n in range(smallest, largest + 1):
        if n == 1:
            grams.append(tokens)
            continue
        count = F.greatest(F.size(tokens) - (n - 1), F.lit(0))
        joined = F.slice(tokens, F.lit(1), count)
        for shift in range(1, n):
            joined = F.zip_with(
                joined, F.slice(tokens, F.lit(shift + 1), count), lambda a, b: F.concat_ws(" ", a, b)
            )
        grams.append(joined)
    return F.concat(*grams) if len(grams) > 1 else grams[0]


# --- Extracted page text -----------------------------------------------------------------------------
@arrow_udf(STRINGS)
def _unescape_lists(lists: pa.Array) -> pa.Array:
    return words.map_word_lists(lists, words.unescape)


def unescape_entities(texts: Column) -> Column:
    """Decode character references in an array of strings."""
    return _unescape_lists(texts)


def strip_markup(text: Column) -> Column:
    """Everything of the text cleaning that follows entity decoding."""
    text = replace_all(text, r"<[^>]+>")
    for pattern in fixed.NAVIGATION_PATTERNS:
        text = replace_all(text, f"(?iU){pattern}")
    return squeeze(text)


def clean_texts(texts: Column) -> Column:
    return F.transform(unescape_entities(texts), strip_markup)


def clean_text(text: Column) -> Column:
    return F.get(clean_texts(F.array(text)), 0)


def split_steps(text: Column) -> Column:
    """Steps of one instruction string: the first numbering style that yields several parts wins."""
    parted = [non_blank(split_on(text, f"(?iU){pattern}")) for pattern in fixed.STEP_SPLIT_PATTERNS]
    several = [bind(parts, lambda found: F.when(F.size(found) > 1, found)) for parts in parted]
    return F.coalesce(*several, F.array(text))


# --- Phrases ---------------------------------------------------------------------------------------------
def normal_phrase(text: Column) -> Column:
    cleaned = replace_all(F.lower(text), r"[^a-z0-9 ]", " ")
    return F.trim(replace_all(cleaned, " +", " "))


def normal_query(text: Column) -> Column:
    return squeeze(F.lower(text))


# --- Normalisation before lemmatising ------------------------------------------------------------------------
def _kept(tokens: Column, stopwords: Sequence[str]) -> Column:
    long_enough = F.filter(tokens, lambda token: F.length(token) >= fixed.MIN_TOKEN_LENGTH)
    return without_words(long_enough, stopwords)


def sentences(text: Column) -> Column:
    """Sentences: a period, question or exclamation mark ends one before white space, unless it ends an abbreviation.

    Initials (one letter) and enumerations count as abbreviations.  Case does not matter, since names come lowered.
    """
    short = "|".join(re.escape(word) for word in fixed.ABBREVIATIONS)
    # Cheap looks come first, here and below: most places fail the first one.
    pattern = rf"(?U)(?=\s)(?<=[.?!\"')\]»”’])(?<=[.?!][\"')\]»”’]{{0,2}})(?<!(?:^|[\s(\[\"'])(?:{short}|\w)\.)\s+"
    return split_on(strip(text), pattern)


def treebank_words(sentence: Column) -> Column:
    """Words and marks of one sentence, in lower case, after the treebank conventions.

    Marks stand alone; commas and colons do unless a digit follows; the last period is split off, others stay in their
    word; endings like ``n't`` and ``'s`` are words, and so are the halves of ``cannot`` or ``gonna``.  Quotation marks
    are left as they are.
    """
    ending = "|".join(fixed.TREEBANK_ENDINGS)
    whole = "|".join(rf"{left}(?={right}{' ' if left == 'wan' else ''}\b)" for left, right in fixed.TREEBANK_PAIRS if not left.startswith("'"))
    cut = "|".join(rf"{left}(?={right}\b)" for left, right in fixed.TREEBANK_PAIRS if left.startswith("'"))
    out = replace_all(sentence, r"(?U)\s+", " ")
    out = replace_all(out, r"(?U)'(?=(?![mtsdn])\w\b)", "' ")
    out = replace_all(out, fixed.TREEBANK_MARKS, " $0 ")
    out = replace_all(out, r"[:,](?=\D|$)", " $0 ")
    out = replace_all(out, r"\.(?=[\])}>\"'»”’ ]*$)(?<=[^.]\.)", " . ")
    out = replace_all(F.concat(out, F.lit(" ")), rf"(?=['n])(?<=[^' ])(?:{ending})(?= )", " $0")
    out = replace_all(out, rf"(?U)\b(?:{whole})|(?:{cut})(?<=(?:^|[^\w'])'t)", "$0 ")
    return F.filter(split_on(out, " +"), lambda token: token != "")


def name_tokens(name: Column, stopwords: Sequence[str]) -> Column:
    """Tokens of a short name, split sentence by sentence; characters other than letters vanish inside a token."""
    found = F.flatten(F.transform(sentences(F.lower(name)), treebank_words))
    letters = F.transform(found, lambda token: replace_all(token, "[^a-z]"))
    return _kept(letters, stopwords)


def prose_tokens(text: Column, stopwords: Sequence[str], remove_numbers: bool = True) -> Column:
    """Tokens of running text; punctuation and digits separate."""
    cleaned = replace_all(F.lower(text), r"[^\p{L}\p{N}_\s]", " ")
    if remove_numbers:
        cleaned = replace_all(cleaned, r"\p{Nd}+", " ")
    cleaned = replace_all(cleaned, r"(?U)\bcannot\b", "can not")
    tokens = F.filter(split_on(strip(cleaned), r"(?U)\s+"), lambda token: ~token.rlike(r"^\p{Nd}*$"))
    return _kept(tokens, stopwords)
