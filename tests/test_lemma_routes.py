"""Forms of many words at once, and the route of a large lexicon of which few words are needed."""

import random

import pyarrow as pa

from quern.functions import words
from quern.operators import normalize


def test_arrays_and_single_words_have_the_same_forms():
    rng = random.Random(4)
    endings = ["", "s", "ses", "ves", "xes", "zes", "ches", "shes", "men", "ies", "es", "ed", "ing", "y", "f", "x", "e", "man"]
    made = sorted({"".join(rng.choices("absé", k=rng.randint(0, 2))) + rng.choice(endings) for _ in range(3000)})
    lists = {pos: sorted(rng.sample(made, len(made) // 3), key=str.encode) for pos in ("n", "v")}
    lexicon = {pos: words.SortedWords(pa.array(listed)) for pos, listed in lists.items()}
    for order in ("n", "vn"):
        find = words.form_finder(lexicon, None, order)
        found = words.listed_forms(pa.array(made, pa.string()), lexicon, order).to_pylist()
        assert found == [find(word) for word in made] and found != made
    empty = {pos: words.SortedWords(pa.array([], pa.string())) for pos in ("n", "v")}
    assert words.listed_forms(pa.array(["axes"]), empty, "vn").to_pylist() == ["axes"]


def test_phrases_keep_their_shape():
    lists = pa.array([["a b", "", None], None, [], ["b  a"]])[1:]
    assert words.map_phrase_words(lists, lambda tokens: pa.array([t.upper() for t in tokens.to_pylist()], pa.string())).to_pylist() == [None, [], ["B  A"]]


def test_a_large_lexicon_does_not_move_every_word(spark, monkeypatch):
    lexicon = spark.createDataFrame([(f"word{at}", "n") for at in range(20)] + [("bake", "v"), ("leaf", "n")], "lemma string, pos string")
    rows = [(1, ["leaves baked", "", "word1 xyz"]), (1, ["bakes", None]), (None, ["leaves"]), (2, []), (3, None)]
    df = spark.createDataFrame(rows, "id int, p array<string>")
    want = sorted(map(str, normalize.lemmatise(df, "p", lexicon, "id", "vn").collect()))
    monkeypatch.setattr(normalize, "_lemmatise_by_join", None)
    assert sorted(map(str, normalize.lemmatise(df, "p", lexicon, "id", "vn", lexicon_rows=5).collect())) == want
    assert "bake" in str(want) and "leaf" in str(want)


def test_lexicons_of_a_gigabyte_move_no_tokens(spark, monkeypatch):
    """The table of 1 GB has some 1.4 million entries; beyond the bound all tokenised lines are written."""
    assert normalize.LEXICON_ROWS >= 1_500_000
    lexicon = spark.range(600_000).selectExpr("concat('word', id) AS lemma", "'n' AS pos")
    monkeypatch.setattr(normalize, "store", None)
    df = spark.createDataFrame([(1, ["word1s other"])], "id int, p array<string>")
    assert normalize.lemmatise(df, "p", lexicon, "id").first().p == ["word1 other"]
