"""The published English stemming rules as SQL over a vocabulary, for comparison only."""

from quern.functions import words

SHORT = r"(^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$"


def _cases(table: dict[str, str], column: str) -> str:
    return " ".join(f"WHEN {column} = '{ending}' THEN '{new}'" for ending, new in table.items())


def _any(endings) -> str:
    return "|".join(sorted(endings, key=len, reverse=True))


def stem_sql(vocabulary: str) -> str:
    """CTEs up to ``stemmed(word, stem)`` for a relation with a column ``word``."""
    irregular = _cases(words.IRREGULAR_STEMS, "word")
    kept = ", ".join(f"'{word}'" for word in sorted(words.KEPT_AFTER_PLURAL))
    cut = "left(w, length(w) - length(e))"
    return rf"""
vocab AS (SELECT DISTINCT word FROM ({vocabulary})),
fixed AS (SELECT word, CASE WHEN length(word) < 3 THEN word {irregular} END AS done,
                 regexp_replace(word, '(^|[aeiouy])y', '\1Y', 'g') AS w FROM vocab),
region1 AS (SELECT *, CASE WHEN regexp_matches(w, '^(gener|commun|arsen)') THEN length(regexp_extract(w, '^(gener|commun|arsen)'))
  WHEN regexp_matches(w, '[aeiouy][^aeiouy]') THEN length(regexp_extract(w, '^.*?[aeiouy][^aeiouy]')) ELSE length(w) END AS r1 FROM fixed),
region2 AS (SELECT *, CASE WHEN regexp_matches(substr(w, r1 + 1), '[aeiouy][^aeiouy]')
  THEN r1 + length(regexp_extract(substr(w, r1 + 1), '^.*?[aeiouy][^aeiouy]')) ELSE length(w) END AS r2 FROM region1),
plural AS (SELECT word, done, r1, r2, CASE WHEN ends_with(w, 'sses') THEN left(w, -2)
  WHEN ends_with(w, 'ied') OR ends_with(w, 'ies') THEN left(w, CASE WHEN length(w) > 4 THEN -2 ELSE -1 END)
  WHEN regexp_matches(w, '[aeiouy].*[^us]s$') THEN left(w, -1) ELSE w END AS w FROM region2),
kept AS (SELECT word, CASE WHEN done IS NULL AND w IN ({kept}) THEN w ELSE done END AS done, r1, r2, w,
  regexp_extract(w, '(eedly|ingly|edly|eed|ing|ed)$') AS e FROM plural),
past AS (SELECT *, e NOT IN ('', 'eed', 'eedly') AND regexp_matches({cut}, '[aeiouy]') AS dropped, {cut} AS base FROM kept),
past_done AS (SELECT word, done, r1, r2, CASE
  WHEN e IN ('eed', 'eedly') AND length(base) >= r1 THEN base || 'ee'
  WHEN NOT dropped THEN w
  WHEN regexp_matches(base, '(at|bl|iz)$') THEN base || 'e'
  WHEN regexp_matches(base, '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$') THEN left(base, -1)
  WHEN length(base) <= r1 AND regexp_matches(base, '{SHORT}') THEN base || 'e' ELSE base END AS w FROM past),
final_y AS (SELECT word, done, r1, r2, regexp_replace(w, '^(.+[^aeiouy])[yY]$', '\1i') AS w FROM past_done),
second AS (SELECT *, regexp_extract(w, '({_any(words.STEP2)}|ogi|li)$') AS e FROM final_y),
second_done AS (SELECT word, done, r1, r2, CASE WHEN e = '' OR length(w) - length(e) < r1 THEN w
  WHEN e = 'ogi' THEN CASE WHEN ends_with(w, 'logi') THEN left(w, -1) ELSE w END
  WHEN e = 'li' THEN CASE WHEN regexp_matches(w, '[cdeghkmnrt]li$') THEN left(w, -2) ELSE w END
  ELSE {cut} || CASE {_cases(words.STEP2, "e")} END END AS w FROM second),
third AS (SELECT *, regexp_extract(w, '({_any([*words.STEP3, "ative"])})$') AS e FROM second_done),
third_done AS (SELECT word, done, r1, r2, CASE WHEN e = '' OR length(w) - length(e) < r1 THEN w
  WHEN e = 'ative' THEN CASE WHEN length(w) - 5 >= r2 THEN left(w, -5) ELSE w END
  ELSE {cut} || CASE {_cases(words.STEP3, "e")} END END AS w FROM third),
fourth AS (SELECT *, regexp_extract(w, '({_any(words.STEP4)}|[st]ion)$') AS e FROM third_done),
fourth_done AS (SELECT word, done, r1, r2, CASE WHEN e = '' THEN w
  WHEN e IN ('sion', 'tion') THEN CASE WHEN length(w) - 3 >= r2 THEN left(w, -3) ELSE w END
  WHEN length(w) - length(e) >= r2 THEN {cut} ELSE w END AS w FROM fourth),
fifth AS (SELECT word, done, CASE
  WHEN ends_with(w, 'e') AND (length(w) - 1 >= r2 OR (length(w) - 1 >= r1 AND NOT regexp_matches(left(w, -1), '{SHORT}'))) THEN left(w, -1)
  WHEN ends_with(w, 'll') AND length(w) - 1 >= r2 THEN left(w, -1) ELSE w END AS w FROM fourth_done),
stemmed AS (SELECT word, coalesce(done, replace(w, 'Y', 'y')) AS stem FROM fifth)"""
