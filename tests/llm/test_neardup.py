import math
import random

import numpy as np
import pyarrow as pa
import pytest

from quern.llm import components, flat, neardup
from tests.llm import brute


def test_components_of_paths_stars_and_loops(spark):
    rng = random.Random(4)
    chain = [(k, k + 1) for k in range(0, 60)]
    star = [(200, 200 + k) for k in range(1, 80)]
    pairs = chain + star + [(500, 500), (600, 601), (601, 600), (None, 3)] + [(rng.randint(700, 760), rng.randint(700, 760)) for _ in range(40)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = components.components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert {row["node"]: row["root"] for row in got} == {x: find(x) for x in parent}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sets_are_the_shingles_of_whole_texts():
    texts = ["", "one", "a b c", "a b c d", "A b\tc\nd  e a b c d", "x " * 300, "é ü É", " lead and trail \r"]
    data, offsets = flat.utf8(pa.array(texts))
    for size in (1, 2, 4, 5):
        _, bounds = neardup.sets_of(data, offsets, size)
        assert np.diff(bounds).tolist() == [len(brute.shingle_set(text, size)) for text in texts]
    values, bounds = neardup.sets_of(*flat.utf8(pa.array(["a b c d e", "b c d e a", "A  b c\nd e"])), 4)
    sets = [values[a:b].tolist() for a, b in zip(bounds, bounds[1:])]
    assert sets[0] == sets[2] and len(set(sets[0]) & set(sets[1])) == 1


def test_sketch_fills_every_bin_and_estimates():
    rng = np.random.default_rng(0)
    base = np.sort(rng.integers(0, 1 << 63, 400, dtype=np.int64).view(np.uint64))
    other = np.sort(np.concatenate((base[:350], rng.integers(0, 1 << 63, 50, dtype=np.int64).view(np.uint64))))
    values = np.concatenate((base, other, base[:1], base[:2]))
    rows = neardup.sketch(values, np.array([0, 400, 800, 801, 803, 803]), 200)
    assert (rows[:4] != np.uint64(0xFFFFFFFFFFFFFFFF)).all() and (rows[4] == np.uint64(0xFFFFFFFFFFFFFFFF)).all()
    wide = neardup.sketch(values[:800], np.array([0, 400, 800]), 1000)
    assert abs((wide[0] == wide[1]).mean() - 350 / 450) < 0.08


def near_copies(seed):
    """Groups of copies with edits of all degrees, a hot group, unrelated texts, and texts that share a passage."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    rows = []
    for size in [1] * 60 + [2] * 20 + [5] * 10 + [150]:
        base = [word() for _ in range(rng.randint(3, 90))]
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
                copy[rng.randrange(len(copy))] = word()
            rows.append(" ".join(copy))
    passage = " ".join(word() for _ in range(40))
    rows += [f"{passage} " + " ".join(word() for _ in range(rng.randint(2, 30))) for _ in range(60)] + ["", None, "  "]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("size, chunk", [(4, 1024), (5, 32)])
def test_groups_equal_brute_force(spark, monkeypatch, size, chunk):
    monkeypatch.setattr(neardup, "OPEN_ROWS", chunk)
    monkeypatch.setattr(neardup, "SALT_ROWS", 16 if chunk < 100 else 256)
    monkeypatch.setattr(neardup, "FEW_ROWS", 0 if chunk < 100 else 8)
    rows = near_copies(size)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = neardup.groups(docs, "doc_id", "text", neardup.Sketch(words=size)).collect()
    assert {row["id"]: (row["n_shingles"], row["component_id"]) for row in got} == brute.near_groups(rows, size)
    assert len(got) == len(rows)


def test_odd_rows(spark, odd, odd_rows, none):
    found = neardup.groups(odd, "doc_id", "text")
    got = found.collect()
    assert len(got) == len(odd_rows)
    want = brute.near_groups([(key, text) for key, text, *_ in odd_rows if key is not None], 5)
    assert {(row["id"], row["component_id"]) for row in got if row["id"] is not None} == {(key, root) for key, (_, root) in want.items()}
    kept = neardup.keep_first(odd, "doc_id", "text", found)
    assert kept.columns == odd.columns
    ids = [row["doc_id"] for row in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({root for _, root in want.values()}) and ids.count(None) == 1
    assert neardup.groups(none, "doc_id", "text").count() == 0


def test_repeated_id_has_the_links_of_all_its_texts(spark):
    a, b = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))
    docs = spark.createDataFrame([(5, a), (5, b), (1, a + " x"), (9, b), (7, "other text here")], "doc_id long, text string")
    got = neardup.groups(docs, "doc_id", "text").collect()
    assert sorted((row["id"], row["component_id"]) for row in got) == [(1, 1), (5, 1), (5, 1), (7, 7), (9, 1)]


def test_last_round_takes_every_pair_of_large_buckets(spark, monkeypatch):
    # Nothing is linked before the last round, and every bucket is looked through in place.
    monkeypatch.setattr(neardup, "components", lambda links: spark.createDataFrame([], "node long, root long"))
    monkeypatch.setattr(neardup, "FEW_ROWS", 0)
    rows = []
    for k in range(1500):
        common = [f"c{k}x{i}" for i in range(40)]
        rows += [(2 * k + side, " ".join(common + [f"{'ab'[side]}{k}x{i}" for i in range(5)])) for side in range(2)]
    docs, plan = spark.createDataFrame(rows, "doc_id long, text string").repartition(4), neardup.Sketch(words=1)
    first = neardup.sketches(docs, "doc_id", "text", plan)
    got = neardup.links_between(docs, "doc_id", "text", first, plan).collect()
    assert sorted(tuple(sorted((row["a"], row["b"]))) for row in got) == [(2 * k, 2 * k + 1) for k in range(1500)]


def test_lookalikes_leave_no_pairs(spark, monkeypatch):
    """One group of edited copies, most of them below the threshold to each other: links leave the tasks, not pairs."""
    rng = random.Random(3)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(600):
        copy = list(base)
        for at in rng.sample(range(120), rng.randint(3, 9)):
            copy[at] = f"x{k}y{at}"
        rows.append((k, " ".join(copy)))
    left = {}
    store = neardup.store
    monkeypatch.setattr(neardup, "store", lambda df, name, *rest: left.setdefault(name, store(df, name, *rest)) if name == "open-links" else store(df, name, *rest))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = neardup.groups(docs, "doc_id", "text", neardup.Sketch(words=4)).collect()
    assert {row["id"]: (row["n_shingles"], row["component_id"]) for row in got} == brute.near_groups(rows, 4)
    assert left["open-links"].count() < len(rows)


def test_packed_texts_compare_as_their_sets(monkeypatch):
    rows = near_copies(2)[:120]
    pack = neardup.zstandard.ZstdCompressor().compress
    for kept in (neardup.KEPT_VALUES, 10):
        monkeypatch.setattr(neardup, "KEPT_VALUES", kept)
        sets = neardup._Sets(3)
        for (_, a), (_, b) in zip(rows, rows[1:] + rows[:1]):
            x, y = brute.shingle_set(a, 3), brute.shingle_set(b, 3)
            for percent in (1, 50, 80):
                assert sets.linked(pack((a or "").encode()), pack((b or "").encode()), percent) == (100 * len(x & y) >= percent * len(x | y))


def test_sketch_tests_lose_fewer_pairs_than_the_banding():
    plan = neardup.Sketch()
    lost = [sum(math.comb(n, k) * 0.8**k * 0.2**(n - k) for k in range(plan.least(n))) for n in (plan.bins, plan.wide)]
    assert sum(lost) < (1 - 0.8**plan.rows) ** plan.bands
