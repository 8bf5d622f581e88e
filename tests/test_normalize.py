import pickle
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.functions import text, words
from quern.operators import normalize

LEXICON = [("tomato", "n"), ("chop", "v"), ("knife", "n"), ("berry", "n"), ("bake", "v"), ("dish", "n"), ("bus", "n"), ("leaf", "n")]


@pytest.fixture(scope="module")
def lexicon(spark):
    return spark.createDataFrame(LEXICON, "lemma string, pos string")


def tokens(spark, value, prose=False):
    make = text.prose_tokens if prose else text.name_tokens
    return spark.createDataFrame([(value,)], "x string").select(make(F.col("x"), normalize.STOPWORDS).alias("t")).first().t


def test_tokens(spark):
    assert tokens(spark, "All-Purpose flour (2 cups), don't") == ["allpurpose", "flour"]
    assert tokens(spark, "Mix the all-purpose flour; 20g", prose=True) == ["mix", "purpose", "flour"]
    assert tokens(spark, "chef's crème", prose=False) == ["chef", "crme"]
    assert tokens(spark, "crème 1½ x", prose=True) == ["crème"]


def test_lemma_rules(spark, lexicon):
    asked = spark.createDataFrame([(w,) for w in ("tomatoes", "berries", "leaves", "buses", "dishes", "xyz", "bus", "knives")], "token string")
    irregular = spark.createDataFrame([("knives", "n", "knife")], "word string, pos string, lemma string")
    found = {r.token: r.lemma for r in normalize.noun_forms(asked, lexicon, irregular).collect()}
    assert found == {"berries": "berry", "leaves": "leaf", "buses": "bus", "dishes": "dish", "bus": "bus", "knives": "knife"}
    verbs = spark.createDataFrame([("chopping",), ("baked",), ("dishes",)], "token string")
    assert {r.token: r.lemma for r in normalize.verb_noun_forms(verbs, lexicon).collect()} == {"baked": "bake", "dishes": "dish"}


def test_both_lemma_routes_agree(spark, lexicon):
    rows = [(1, ["dishes leaves", "", "baked buses"]), (2, []), (3, None), (4, ["xyz"])]
    df = spark.createDataFrame(rows, "id int, p array<string>")
    want = {1: ["dish leaf", "", "bake bus"], 2: [], 3: None, 4: ["xyz"]}
    for limit in (100, 2):
        out = normalize.lemmatise(df, "p", lexicon, "id", "vn", lexicon_rows=limit)
        assert {r.id: r.p for r in out.collect()} == want


def test_no_size_of_the_lexicon_changes_a_result(spark, lexicon):
    df = spark.createDataFrame(
        [(1, ["Fresh berries", "knives, 2 oz", ""], ["Baked in dishes!", "the", "chopping knives"]), (2, [], None), (3, None, ["Leaves"])],
        "id int, names array<string>, prose array<string>",
    )
    irregular = spark.createDataFrame([("knives", "n", "knife")], "word string, pos string, lemma string")
    records, pairs = [], []
    for limit in (100, 0):
        options = {"irregular": irregular, "lexicon_rows": limit}
        out = normalize.normalise_records(df, "names", "prose", lexicon, "id", **options)
        records.append(sorted(map(str, out.select("id", "ingredients_tfidf", "instructions_tfidf", "tfidf_text").collect())))
        for column, prose in (("names", False), ("prose", True)):
            paired = normalize.paired_names(df, column, lexicon, "id", prose=prose, **options)
            pairs.append(sorted(map(str, paired.select("id", "paired").collect())))
    assert records[0] == records[1] and pairs[:2] == pairs[2:]
    assert "knife" in records[0][0]


def test_records(spark, lexicon):
    df = spark.createDataFrame(
        [(1, ["Fresh berries", "2 oz", "berries"], ["Baked in dishes!", "the"]), (2, [], ["Leaves and leaves"])],
        "id int, names array<string>, prose array<string>",
    )
    out = normalize.normalise_records(df, "names", "prose", lexicon, "id").orderBy("id").collect()
    assert out[0].ingredients_tfidf == ["fresh berry", "berry"] and out[0].instructions_tfidf == ["bake dish"]
    assert out[0].tfidf_text == "fresh berry berry bake dish" and out[1].tfidf_text == "leaf leaf"
    assert [(r.ingredient_vocab_size, r.instruction_vocab_size, r.total_vocab_size) for r in out] == [(2, 2, 4), (0, 1, 1)]
    normal = normalize.normalise_records(df, "names", "prose", lexicon, "id")
    reduced = normalize.vocabulary_reduction(normal, "names", "ingredients_tfidf").first()
    assert (reduced.vocab_before, reduced.vocab_after, reduced.reduction_percent) == (4, 2, 50.0)
    assert normalize.vocabulary_means(normal).first().mean_total_vocab == 2.5
    paired = normalize.paired_names(df, "names", lexicon, "id")
    samples = normalize.changed_samples(paired, "id", "names", "paired", 6).collect()
    assert [(r.before, r.after) for r in samples] == [("Fresh berries", "fresh berry"), ("berries", "berry")]


def test_sorted_words_find_what_a_set_holds():
    rng = random.Random(1)
    known = sorted({"".join(rng.choices("abcé\u4e2d", k=rng.randint(0, 4))) for _ in range(300)}, key=str.encode)
    found = pickle.loads(pickle.dumps(words.SortedWords(pa.array(known))))
    probes = ["".join(rng.choices("abcdé\u4e2d", k=rng.randint(0, 5))) for _ in range(2000)] + known
    assert [word in found for word in probes] == [word in set(known) for word in probes]
    assert "a" not in words.SortedWords(pa.array([], pa.string())) and "b" in words.SortedWords(pa.array(["x", "a", "b", "c"])[1:])


def test_a_full_lexicon_stays_small():
    entries = pa.array([f"word{at:07d}" for at in range(normalize.LEXICON_ROWS)])
    assert len(pickle.dumps(words.SortedWords(entries))) < 25 * normalize.LEXICON_ROWS


def test_ties_and_exceptions_on_both_routes(spark):
    """Several irregular forms, forms of one length, and a word that only another part of speech knows."""
    lexicon = spark.createDataFrame([("axe", "n"), ("axi", "n"), ("ax", "v"), ("lie", "v"), ("lay", "v"), ("bus", "n"), ("bus", "n"), ("li", "v")], "lemma string, pos string")
    irregular = spark.createDataFrame([("axes", "n", "axi"), ("axes", "n", "axe"), ("lain", "v", "lie"), ("lain", "v", "lay"), ("lain", None, "x")], "word string, pos string, lemma string")
    df = spark.createDataFrame([(1, ["axes lain lies buses", "axes"])], "id int, p array<string>")
    out = [normalize.lemmatise(df, "p", lexicon, "id", "vn", irregular, lexicon_rows=n).first().p for n in (100, 0)]
    assert out[0] == out[1] and out[0][0].split()[1] == "lay"


# What the treebank conventions make of contractions, quotes, ellipses and abbreviations.
SPLITS = {
    "don't": "do n't", "can't": "ca n't", "cannot": "can not", "won't stop": "wo n't stop", "i'll": "i 'll", "you're": "you 're",
    "they've": "they 've", "i'm": "i 'm", "he'd": "he 'd", "it's": "it 's", "chef's": "chef 's", "chefs' hats": "chefs ' hats",
    "isn't it": "is n't it", "couldn't've": "couldn't 've", "gonna": "gon na", "gotta go": "got ta go", "lemme": "lem me", "gimme": "gim me",
    "wanna go": "wan na go", "wannabe": "wannabe", "more'n two": "more 'n two", "d'ye": "d 'ye", "'tis": "'t is", "'twas": "'t was",
    "rock 'n roll": "rock 'n roll", "o'brien": "o'brien", "salt & pepper": "salt & pepper", "salt&pepper": "salt & pepper", "50%": "50 %",
    "$5": "$ 5", "#1 cut": "# 1 cut", "a@b": "a @ b", "salt, pepper": "salt , pepper", "salt,pepper": "salt , pepper", "1,000": "1,000",
    "1, 2": "1 , 2", "note: hot": "note : hot", "10:30": "10:30", "end:": "end :", "wait...": "wait ...", "wait... more": "wait ... more",
    "a..b": "a .. b", "done.": "done .", "done. next": "done . next", "is it? yes!": "is it ? yes !", "mr. smith": "mr. smith",
    "2 tbsp. oil": "2 tbsp. oil", "e.g. salt": "e.g. salt", "approx. 3 oz. cream": "approx. 3 oz. cream", "p.m.": "p.m .", "u.s. beef": "u.s . beef",
    "j. doe": "j. doe", '"quoted" word': '" quoted " word', "“quoted”": "“ quoted ”", "«a»": "« a »", "chef’s": "chef ’ s", "``a''": "`` a ''",
    "(chopped)": "( chopped )", "[a] {b} <c>": "[ a ] { b } < c >", "a--b": "a -- b", "all-purpose": "all-purpose", "half*": "half *", "a;b": "a ; b",
    "crème brûlée's": "crème brûlée 's", "done.)": "done . )", "  tabs\tand\u00a0blanks ": "tabs and blanks", "": "", "'": "'", "say 'x": "say ' x",
}


def test_treebank_splitting(spark):
    rows = spark.createDataFrame([(given,) for given in SPLITS], "x string")
    found = F.flatten(F.transform(text.sentences(F.col("x")), text.treebank_words))
    got = {r.x: " ".join(r.t) for r in rows.select("x", found.alias("t")).collect()}
    assert {given: got[given] for given, want in SPLITS.items() if got[given] != want} == {}
    assert len(SPLITS) >= 60
