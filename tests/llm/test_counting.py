"""Token counts, ranked search and collocations against the public library and plain versions."""

import json
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from quern.llm import bpe, collocations, lexical
from tests.llm import brute

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]


# Token counts


def odd_texts():
    rng = random.Random(3)
    parts = [
        "a", "b", "the", "ing", " ", "  ", "\n", "'s", "'", "é", "é", "中", "文", "1", "23", "-", "...", "\xa0", " ", "Σ", "ΑΣ", "İ",
        "ß", "\U0001f600", "<|endoftext|>", "<|startoftext|>", "<|", "\x1c", "\x85", "\x00", "_", "aaaa", "!!!!", "ᄀ", "ᅡ", "ꟓ",
    ]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(800)]
    texts += [chr(c) + "a " + chr(c) for c in range(1, 0x110000, 211) if not 0xD800 <= c < 0xE000]
    letters = "".join(rng.choice("etaoinshrdlu") for _ in range(20_000))
    return texts + ["", "x" * 5000, "ab" * 4000, "中文字符集" * 1000, letters, "a" * 513, "a" * 512, "!" * 3001]


@pytest.fixture(scope="module", params=FILES)
def tokenizer(request):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(request.param)
    return Tokenizer.from_file(path), bpe.load(path)


def test_counts_equal_the_library(tokenizer):
    library, model = tokenizer
    texts = odd_texts()
    want = [len(found.ids) for found in library.encode_batch(texts, add_special_tokens=False)]
    assert bpe.count_texts([text.encode() for text in texts], model) == want


def test_rows_merged_alone_and_together_agree(tokenizer, monkeypatch):
    model, texts = tokenizer[1], [text.encode() for text in odd_texts()]
    together = bpe.count_texts(texts, model)
    monkeypatch.setattr(bpe, "LONG_ROW", 3)
    assert bpe.count_texts(texts, model) == together


def test_kept_words_change_nothing(tokenizer, monkeypatch):
    model, texts = tokenizer[1], [text.encode() for text in odd_texts()]
    want = bpe.count_texts(texts, model)
    monkeypatch.setattr(bpe, "KEPT_WORDS", 5)
    kept = {}
    assert [n for at in range(0, len(texts), 50) for n in bpe.count_texts(texts[at:at + 50], model, kept)] == want


def test_every_round_applies_the_lowest_rank_of_each_row():
    # 0 1 2: a b c; merges ab, aa, (ab)c
    model = bpe.Model("", [], True, 6, np.array([0 * 6 + 0, 0 * 6 + 1, 3 * 6 + 2]), np.array([1, 0, 2]), np.array([3, 4, 5]), np.zeros(0), np.zeros(0))
    rows = [[0, 1, 2], [0, 0, 0], [0, 0, 1], [2], [], [1, 1]]
    bounds = np.cumsum([0, *map(len, rows)])
    assert bpe.survivors(np.array(sum(rows, [])), bounds, model).tolist() == [1, 2, 2, 1, 0, 2]


def test_files_that_merge_otherwise_are_refused(tmp_path):
    def spec(**model):
        vocab = {"a": 0, "b": 1, "c": 2, "ab": 3, "abc": 4}
        return {"added_tokens": [], "normalizer": None, "pre_tokenizer": None, "model": {"type": "BPE", "vocab": vocab, "merges": [["a", "b"]], **model}}

    for bad in ({"merges": [["ab", "c"], ["a", "b"]]}, {"dropout": 0.1}, {"byte_fallback": True}, {"type": "Unigram"}):
        (tmp_path / "t.json").write_text(json.dumps(spec(**bad)))
        with pytest.raises(ValueError):
            bpe.load(str(tmp_path / "t.json"))
    (tmp_path / "t.json").write_text(json.dumps(spec()))
    assert bpe.count_texts([b"abcab", b"zab"], bpe.load(str(tmp_path / "t.json"))) == [3, 1]


def test_token_counts_of_odd_rows(tokenizer, odd, none):
    library, model = tokenizer
    rows = bpe.count(odd, "doc_id", "text", model, 2).orderBy("id").collect()
    texts = sorted(((row["doc_id"], row["text"] or "") for row in odd.collect()), key=lambda row: (row[0] is not None, row))
    want = [(key, len(text.encode()), len(library.encode(text, add_special_tokens=False).ids)) for key, text in texts]
    assert [(row["id"], row["n_bytes"], row["n_tokens"]) for row in rows] == want
    assert all(row["over_limit"] == (row["n_tokens"] > 2) for row in rows)
    assert bpe.count(none, "doc_id", "text", model).count() == 0


# Ranked search


def plain(docs, items, k=50):
    return brute.lexical_ranks(docs, items, k)


def some_documents(n=400, seed=5):
    rng = random.Random(seed)
    words = [f"w{at}" for at in range(60)] + ["É", "é", "42", "中文"]
    weights = [1 / (at + 1) for at in range(len(words))]
    return [(at, rng.choice([" ", ", ", "\n"]).join(rng.choices(words, weights, k=rng.randint(0, 60)))) for at in range(n)]


@pytest.mark.parametrize("shard, read", [(1 << 19, 16), (50, 1), (997, 3)])
def test_search_equals_scoring_everything(spark, monkeypatch, shard, read):
    docs = some_documents() + [(1000, None), (1001, ""), (7, "w1 w2 w59 W59"), (None, "w59 w59"), (1002, "...")]
    docs += [(2000 + at, "w3 w5") for at in range(40)]
    items = [(1, "w59 w3 W5!"), (2, "w0 w1 w2 w3 w4"), (3, "zzz"), (4, None), (5, ""), (None, "é 42"), (6, "中文 w7 w7 w8"), (7, "w9"), (7, "w10")]
    monkeypatch.setattr(lexical, "SHARD_POSTINGS", shard)
    monkeypatch.setattr(lexical, "FIRST_READ", read)
    for k in (1, 5, 50):
        got = lexical.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), "doc_id", "text", "item_id", "text", k)
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(plain(docs, items, k), key=repr)


def test_blocks_of_items_change_nothing(spark, monkeypatch):
    docs, items = some_documents(120), [(at, f"w{at} w{2 * at} w3") for at in range(20)]
    monkeypatch.setattr(lexical, "BLOCK_TERMS", 10)
    got = lexical.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), "doc_id", "text", "item_id", "text", 5)
    assert sorted(map(tuple, got.collect())) == sorted(plain(docs, items, 5))


def test_best_positions_stop_before_the_lists_end():
    n = 20_000
    rng = np.random.default_rng(2)
    impacts = np.sort(rng.integers(1, 1_000_000, (n, 2)), axis=0)[::-1].copy()
    impacts[:100] += 5_000_000
    shard = lexical.Shard(np.arange(n), np.arange(0, 2 * n + 1, 2), np.tile([0, 1], n), impacts.reshape(-1), 2)
    want = sorted(range(n), key=lambda d: (-int(impacts[d].sum()), d))[:10]
    for _ in range(2):
        ids, scores, looked = shard.best(np.array([0, 1]), 10)
        assert ids.tolist() == want and scores.tolist() == [int(impacts[d].sum()) for d in want] and looked < n / 50
    # Ties at the k-th score must be read to their end, a higher floor from elsewhere ends at once.
    even = lexical.Shard(np.arange(n)[::-1].copy(), np.arange(n + 1), np.zeros(n, np.int64), np.full(n, 7), 1)
    assert even.best(np.array([0]), 3)[0].tolist() == [0, 1, 2]
    assert even.best(np.array([0]), 3, floor=8)[2] <= lexical.FIRST_READ


def test_search_of_odd_rows(spark, odd, none):
    got = lexical.search(odd, odd, "doc_id", "text", "doc_id", "text", 3)
    assert got.columns == ["item_id", "rank", "id", "score"]
    rows = [(row["doc_id"], row["text"]) for row in odd.collect()]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(plain(rows, rows, 3), key=repr)
    assert lexical.search(none, odd, "doc_id", "text", "doc_id", "text").count() == 0
    assert lexical.search(odd, none, "doc_id", "text", "doc_id", "text").count() == 0
    assert lexical.search(odd, odd, "doc_id", "text", "doc_id", "text", 0).count() == 0


# Collocations


def some_prose(n=300, seed=9):
    rng = random.Random(seed)
    words = ["New", "york", "city", "of", "the", "red", "tomato", "soup", "x\xa0y", "é", "w"] + [f"v{at}" for at in range(30)]
    fixed = ["new York city hall", "the the the", "red tomato soup", "in  the\tend", "of the of the"]
    rows = []
    for _ in range(n):
        text = "".join(
            (rng.choice(fixed) if rng.random() < 0.4 else rng.choice(words)) + rng.choice([" ", " ", "  ", "\t", ", ", ".", "\n", "? "])
            for _ in range(rng.randint(0, 30))
        )
        rows.append((text, rng.choice(["en", "en", "de", None, "und"])))
    return rows


@pytest.mark.parametrize("plan", [
    collocations.Plan(), collocations.Plan(least=5), collocations.Plan(longest=3, least=3, absorbed=50, first=7), collocations.Plan(longest=2, least=4),
])
def test_collocations_equal_plain_counting(spark, plan):
    rows = some_prose() + [(None, "en"), ("", "de")]
    got = collocations.mine(spark.createDataFrame(rows, "text string, lang string"), "text", "lang", plan)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = brute.collocations(rows, plan.longest, plan.least, plan.absorbed, plan.first)
    assert want and sorted(map(tuple, got.collect())) == sorted(want)


def test_run_sizes_and_a_full_filter_change_nothing(spark, monkeypatch):
    rows = some_prose(150)
    monkeypatch.setattr(collocations, "RUN_WORDS", 100)
    monkeypatch.setattr(collocations, "BATCH_PHRASES", 3)
    monkeypatch.setattr(collocations, "PART_BYTES", 7)
    monkeypatch.setattr(collocations, "_maybe_frequent", lambda counted, least: (np.full(4096, 255, np.uint8), 1 << 15))
    plan = collocations.Plan(least=4)
    got = collocations.mine(spark.createDataFrame(rows, "text string, lang string"), "text", "lang", plan)
    assert sorted(map(tuple, got.collect())) == sorted(brute.collocations(rows, plan.longest, plan.least, plan.absorbed, plan.first))


def test_both_passes_hash_pairs_alike():
    rows = [row for row in some_prose(80) if row[0]] + [("One, two two. \tThree\u00a0x three", "en")]
    table = pa.record_batch({"lang": pa.array([lang or "und" for _, lang in rows]), "text": pa.array([text for text, _ in rows])})
    first = {}
    for batch in collocations._count_pairs(iter([table])):
        for row in batch.to_pylist():
            first[row["pair"]] = first.get(row["pair"], 0) + row["a"]
    second = {}
    for lang, run in collocations._runs(iter([table])):
        pairs, counts = np.unique(run.pairs()[1], return_counts=True)
        second.update(zip(collocations._pair_hashes(lang, run, pairs).view(np.int64).tolist(), counts.tolist()))
    assert first == second and len(first) > 100


def test_scores_past_64_bits_are_exact(spark):
    big = 9_000_000_000_000_000
    counted = spark.createDataFrame([("en", 1, "a", big), ("en", 1, "b", big - 1), ("en", 2, "a b", big - 7)], "lang string, size int, phrase string, a long")
    found = collocations.score(counted, collocations.Plan()).collect()
    assert [(row["phrase"], row["score"]) for row in found] == [("a b", 2_000_000 * (big - 7) // (2 * big - 1))]


def test_collocations_of_odd_rows(spark, odd, none):
    plan = collocations.Plan(least=2)
    rows = [(row["text"], row["lang"]) for row in odd.collect()]
    got = collocations.mine(odd, "text", "lang", plan).collect()
    assert sorted(map(tuple, got)) == sorted(brute.collocations(rows, 4, 2, 80, 2000))
    assert collocations.mine(none, "text", "lang", plan).count() == 0
    with pytest.raises(ValueError):
        collocations.mine(odd, "text", "lang", collocations.Plan(longest=1))
