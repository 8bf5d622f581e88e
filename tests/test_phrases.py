import random

import pytest
from pyspark.sql import functions as F

from quern.operators import phrases


def documents(spark, titles, names=()):
    rows = [(at, title, list(names) if at == 0 else []) for at, title in enumerate(titles)]
    df = spark.createDataFrame(rows, "id bigint, title string, names array<string>")
    return phrases.training_phrases(df, "id", "title", "names")


def suggestions(index, query, limit=15):
    return [(r.text, r.tier) for r in phrases.suggest(index, query, limit).orderBy("rank").collect()]


@pytest.fixture(scope="module")
def index(spark):
    titles = ["Mango Salsa", "mango sauce", "mango sauce", "Thai green mango salad", "Tomato paste", "tomatoes", "Tomatoes!", "tomatoes",
              "tomato", "fried chicken", ""]
    return phrases.build_phrase_index(documents(spark, titles, ["Tomato", "mango-salsa", " "]))


def test_counts_and_sources(index):
    rows = {r.phrase: (r.cnt, r.sources) for r in index.phrases.collect()}
    assert rows["mango salsa"] == (2, ["ingredient", "title"])
    # The most frequent form of a stem survives alone, with its own count and sources.
    assert rows["tomatoes"] == (3, ["title"]) and "tomato" not in rows


def test_ties_go_to_the_first_appearance(spark):
    counted = phrases.phrase_counts(documents(spark, ["pies", "pie"]))
    assert [r.phrase for r in phrases.one_per_stem(counted).collect()] == ["pies"]


def test_tiers(index):
    assert suggestions(index, "mango sa") == [("mango salsa", 1), ("mango sauce", 1), ("thai green mango salad", 3)]
    assert suggestions(index, "  Tomatoes ") == [("tomatoes", 1), ("tomato paste", 2)]
    assert suggestions(index, "tomatoes pa") == [("tomato paste", 2)]
    assert suggestions(index, "garlic tomato p") == [("tomato paste", 4)]
    assert suggestions(index, "chick") == [("fried chicken", 3)]
    assert suggestions(index, "frie") == [("fried chicken", 1)]
    assert suggestions(index, "mango sa", limit=1) == [("mango salsa", 1)]
    assert suggestions(index, "zzz") == []
    assert suggestions(index, "paste, tomato") == [("tomatoes", 4), ("tomato paste", 4)]


def test_blank_query_gets_the_most_frequent(index):
    assert [t for t, _ in suggestions(index, " ", limit=3)] == ["tomatoes", "mango salsa", "mango sauce"]


def test_query_batch(spark, index):
    queries = spark.createDataFrame([(1, "mango sa"), (2, ""), (3, "chick")], "qid int, q string")
    out = phrases.suggest(index, queries, 2, "qid", "q").collect()
    assert sorted((r.query_id, r.rank, r.text) for r in out) == [
        (1, 1, "mango salsa"), (1, 2, "mango sauce"), (2, 1, "tomatoes"), (2, 2, "mango salsa"), (3, 1, "fried chicken"),
    ]


def test_facts(index):
    facts = {r.fact: r.n for r in phrases.phrase_facts(index).collect()}
    assert facts["phrases"] == index.phrases.count()
    assert facts["prefix_entries"] == sum(len(r.phrase) for r in index.phrases.collect())


def test_keys_reach_the_tables_as_filters(spark, index):
    rows = phrases.prepare_queries(spark.createDataFrame([(1, "garlic tomato p"), (2, "chick")], "query_id int, query string"))
    keys = phrases.asked_keys([row.asDict() for row in rows.collect()])
    assert keys.words == {"chick"} and {"tomato p", "p"} <= keys.tails and "chick" in keys.prefixes
    for find in (phrases.prefix_matches, phrases.phrase_word_matches, phrases.word_prefix_matches, phrases.trailing_matches):
        plan = find(index, rows, True, keys)._jdf.queryExecution().executedPlan().toString()
        assert "StringStartsWith(" in plan or "In(stem" in plan or "EqualTo(stem" in plan, plan
        assert "sequence(1, length(" not in plan
    few, many = (sorted(map(str, phrases.suggest(index, rows.select("query_id", F.col("q").alias("query"))).collect())) for _ in range(2))
    assert few == many


def test_many_keys_find_the_same(spark, index, monkeypatch):
    queries = spark.createDataFrame([(1, "mango sa"), (2, "garlic tomato p"), (3, "chick"), (4, "")], "query_id int, query string")
    few = sorted(map(str, phrases.suggest(index, queries).collect()))
    monkeypatch.setattr(phrases, "PUSHED_KEYS", 0)
    assert sorted(map(str, phrases.suggest(index, queries).collect())) == few


@pytest.fixture(scope="module")
def large(spark):
    """4,000 phrases over few words, so that short prefixes and words have many."""
    rng = random.Random(6)
    words = ["apple", "apples", "apricot", "bean", "beans", "beet", "corn", "a", "ab", "é", "zest", "\u00e9clair", "corned"]
    rows = [" ".join(rng.choices(words, k=rng.randint(1, 4))) + (f" no{at % 700}" if at % 3 else "") for at in range(4000)]
    return documents(spark, rows)


QUERIES = [
    "a", "ap", "apple", "apples b", "zest", "no", "no1", "no12", "b", "beans corn a", "corn beans n", "beet zest corn apricot a", "x apples", "e", "zz a",
    "apple apples beans", "a a a", "no5 a", "ab no7 b", "nothing at", "", "corned beans no69", "apple apple",
]


@pytest.mark.parametrize("listed, bitmap_rows, stride", [(3, 2, 2), (20, 300, 8)])
def test_lists_and_bitmaps_change_nothing(spark, large, monkeypatch, listed, bitmap_rows, stride):
    monkeypatch.setattr(phrases, "STRIDE", stride)
    plain = phrases.build_phrase_index(large, listed=10 ** 6, bitmap_rows=10 ** 9)
    index = phrases.build_phrase_index(large, listed=listed, bitmap_rows=bitmap_rows)
    assert plain.lists is None and plain.bitmaps is None and index.lists is not None
    asked = spark.createDataFrame(list(enumerate(QUERIES)), "query_id bigint, query string")
    for limit in (listed, 5 * listed):
        want = sorted(map(str, phrases.suggest(plain, asked, limit).collect()))
        assert sorted(map(str, phrases.suggest(index, asked, limit).collect())) == want
    prepared = phrases.prepare_queries(asked)
    for find in (phrases.prefix_matches, phrases.phrase_word_matches, phrases.word_prefix_matches, phrases.trailing_matches):
        assert sorted(map(str, find(index, prepared).collect())) == sorted(map(str, find(plain, prepared).collect()))
    monkeypatch.setattr(phrases, "PUSHED_KEYS", 0)
    monkeypatch.setattr(phrases, "PUSHED_PREFIXES", 0)
    assert sorted(map(str, phrases.suggest(index, asked, limit).collect())) == want


def test_lists_hold_the_best_of_every_heavy_prefix(spark, large):
    index = phrases.build_phrase_index(large, listed=7, bitmap_rows=50)
    for lists, table in ((index.lists, index.prefixes), (index.word_lists, index.spoken.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word")), lambda n: F.substr("word", F.lit(1), n))).alias("prefix"), "phrase", "cnt"))):
        nodes = {}
        for row in table.collect():
            nodes.setdefault(row.prefix, []).append((-row.cnt, row.phrase))
        want = {
            (prefix, phrase, -cnt, rank) for prefix, rows in nodes.items() if len(rows) > 7
            for rank, (cnt, phrase) in enumerate(sorted(set(rows))[:7], 1)
        }
        assert {(r.prefix, r.phrase, r.cnt, r["rank"]) for r in lists.collect()} == want
    order = [(-r.cnt, r.phrase) for r in index.numbered.orderBy("number").collect()]
    assert order == sorted(order)
    held = index.bitmaps.groupBy("stem").agg(F.sum(F.bitmap_count("bits")).alias("n"))
    frequent = index.words.groupBy("stem").agg(F.count(F.lit(1)).alias("n")).where("n >= 50")
    assert sorted(map(tuple, held.collect())) == sorted(map(tuple, frequent.collect()))
    assert index.stems.join(index.bitmaps, "stem", "left_semi").isEmpty()


def test_a_one_letter_query_reads_one_list(spark, large):
    index = phrases.build_phrase_index(large, listed=7)
    rows = phrases.prepare_queries(spark.createDataFrame([(1, "a")], "query_id int, query string"))
    keys = phrases.asked_keys([row.asDict() for row in rows.collect()])
    found = phrases.prefix_matches(index, rows, True, keys, 5)
    assert found.count() == 7 and index.prefixes.where("prefix = 'a'").count() > 700
    # Nothing is read of the phrases themselves: the prefix has a list.
    assert phrases.heavy_among(index.lists, keys.prefixes) == {"a"}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") == 1 and "rank" in plan, plan
