"""Operators with an exact answer, against brute force, SQL and round trips."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from oracle_check import TABLES, rows_of
from quern.llm import flat, imatch, packing, pieces, pii, queries, topk, warc
from tests.llm import brute

SF = "/root/testdata/sf0.001"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@pytest.mark.parametrize("name", [name for name, check in queries.CHECKS.items() if check.sql])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in TABLES:
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df, result = queries.CHECKS[name].query(spark, SF), con.sql(queries.CHECKS[name].sql)
    assert rows_of(df.columns, df.collect()) == rows_of(result.columns, result.fetchall())


# Top-k


def brute_top(rows, k=5):
    vectors = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(
        x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in vectors if i % 3 == 0}):
        best = {}
        for i, query in vectors:
            for c, vector in vectors:
                if i == q and c != q:
                    score = min(max(sum(a * b for a, b in zip(query, vector)), -(1 << 63)), (1 << 63) - 1)
                    best[c] = max(score, best.get(c, score))
        top = sorted(best.items(), key=lambda item: (-item[1], item[0]))[:k]
        out += [(q, rank, c, s) for rank, (c, s) in enumerate(top, 1)]
    return out


@pytest.mark.parametrize("big", [1.0, 3e4, 1e9, 1e200])
def test_top_k(spark, big):
    rng = random.Random(big)
    rows = [(i, [rng.choice([0.0, -0.5, 0.25, rng.uniform(-1, 1)]) * big for _ in range(20)]) for i in range(60)]
    rows += [(60, None), (61, [1.0, None] * 10), (63, [float("nan")] * 20), (64, [float("inf")] * 20), (None, [1.0] * 20), (66, []), (69, [2.0] * 3)]
    rows += [rows[6], rows[7], (9, rows[12][1]), (72, rows[6][1]), (75, rows[6][1])]
    table = spark.createDataFrame([(*row, "x") for row in rows], "vec_id long, embedding array<double>, score string").repartition(3)
    got = topk.top_k(table, "vec_id", "embedding", F.col("vec_id") % 3 == 0, topk.Plan(query_rows=8, candidate_rows=16, step=6))
    assert sorted(map(tuple, got.collect())) == brute_top(rows)
    assert topk.top_k(table.limit(0), "vec_id", "embedding", F.col("vec_id") % 3 == 0).count() == 0
    assert topk.top_k(table, "vec_id", "embedding", F.col("vec_id") < 0).count() == 0
    alone = table.where("vec_id = 3")
    assert topk.top_k(alone, "vec_id", "embedding", F.col("vec_id") % 3 == 0).count() == 0


def test_blocks_meet_without_copies(spark):
    rng = random.Random(8)
    table = spark.createDataFrame([(k, [rng.uniform(-1, 1) for _ in range(8)]) for k in range(200)], "vec_id long, embedding array<double>")
    got = topk.top_k(table, "vec_id", "embedding", F.col("vec_id") % 2 == 0, topk.Plan(query_rows=8, candidate_rows=8))
    plan = got._jdf.queryExecution().executedPlan().toString()
    # A block that is repeated for every block it meets, and sent around, passes through the driver as often.
    assert "Broadcast" not in plan and "Generate" not in plan
    assert got.groupBy("query_id").count().where("count = 5").count() == 100


def test_bounds_leave_candidates_out(monkeypatch):
    rng = np.random.default_rng(5)
    cells = np.floor(rng.normal(0, 100, (64, 3000)) * (0.9 ** np.arange(64))[:, None])
    query, ids, plan = np.floor(rng.normal(0, 100, 64) * 0.9 ** np.arange(64)), np.arange(3000), topk.Plan()
    tail = np.cumsum((cells ** 2)[::-1], axis=0)[::-1]
    seen = []
    first = topk._first
    monkeypatch.setattr(topk, "_first", lambda scores, left, k: seen.append(len(left)) or first(scores, left, k))
    found, scores = topk.search(query, -1, ids, cells, [np.sqrt(tail[lo]) for lo in range(0, 64, 16)], plan)
    assert found.tolist() == np.lexsort((ids, -(query @ cells)))[:5].tolist() and seen[-1] < 300


# Packing


def test_near_copies_share_no_bin(spark, tmp_path):
    words = [f"w{k}" for k in range(60)]
    edited = [" ".join(words[:k] + ["other"] + words[k + 1:]) for k in (0, 1, 58, 59)]
    rows = [(k, text, f"s{k}") for k, text in enumerate([" ".join(words), *edited, " ".join(words).upper(), "far from the others"])]
    rows += [(None, " ".join(words), "s8"), (None, edited[0], "s9"), (None, edited[0], "s10")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"file://{tmp_path}/documents.parquet")
    got = queries.packed_documents(spark, f"file://{tmp_path}").collect()
    bins = [row["bin_id"] for row in got if row["doc_id"] != 6]
    assert len(got) == 10 and len(bins) == 9 == len(set(bins)) and None not in bins


def test_packing_keeps_its_promises(spark, odd, none):
    rng = random.Random(2)
    rows = [(k, rng.choice([0, 1, 5, 40, 99, 100, 101, 250, rng.randint(1, 100)]), rng.choice(["hot", "hot", "a", "b", None]), rng.choice([1, 2, 3, None]))
            for k in range(3000)] + [(None, 7, "a", 1), (1, None, "a", 1)]
    table = spark.createDataFrame([(*row, 0) for row in rows], "doc_id long, size int, source string, cluster int, bin_id int").repartition(5)
    plan = packing.Plan(capacity=100, shard_rows=500)
    got = packing.pack(table, "doc_id", F.col("size"), F.col("source"), F.col("cluster"), plan)
    found = got.collect()
    assert sorted(map(str, found)) == sorted(map(str, packing.pack(table.repartition(2), "doc_id", F.col("size"), F.col("source"), F.col("cluster"), plan).collect()))
    by_id = {row[0]: row for row in rows[:3000]}
    total, bins = defaultdict(int), defaultdict(list)
    for row in found:
        total[row["id"]] += row["n_tokens"]
        if row["bin_id"] is not None:
            bins[row["bin_id"]].append(row)
    assert all(total[key] == (size or 0) for key, size, *_ in rows[:3000] if key != 1) and total[None] == 7
    for members in bins.values():
        assert sum(row["n_tokens"] for row in members) + members[0]["free"] == 100 and members[0]["free"] >= 0
        for column in (2, 3):
            marks = [by_id[row["id"]][column] for row in members if row["id"] is not None]
            marks = [mark for mark in marks if mark is not None]
            assert len(marks) == len(set(marks))
    pieces_of = sorted((row["piece"], row["start"], row["n_tokens"]) for row in found if row["id"] == next(k for k, s, *_ in rows if s == 250))
    assert pieces_of == [(0, 0, 100), (1, 100, 100), (2, 200, 50)]
    text = F.col("text")
    packed = packing.pack(odd, "doc_id", packing.n_words(text), F.col("source"), packing.normal_key(text)).collect()
    assert {row["id"] for row in packed if row["bin_id"] is None} == {0, 1, 2} and len({row["id"] for row in packed}) == 14
    assert packing.pack(none, "doc_id", packing.n_words(text), F.col("source"), packing.normal_key(text)).count() == 0


def test_best_fit_takes_the_tightest_compatible_bin():
    def plain(sizes, groups, capacity):
        left, marks, bins = [], [], [0] * len(sizes)
        for at in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
            mine = {(g, codes[at]) for g, codes in enumerate(groups) if codes[at] >= 0}
            fits = [(rest, b) for b, rest in enumerate(left) if rest >= sizes[at] and rest > 0 and not mine & marks[b]]
            if fits:
                b = min(fits)[1]
            else:
                b = len(left)
                left.append(capacity)
                marks.append(set())
            left[b] -= sizes[at]
            marks[b] |= mine
            bins[at] = b
        return bins

    rng = np.random.default_rng(6)
    for _ in range(20):
        sizes = rng.integers(1, 101, 200)
        groups = [rng.integers(-1, 6, 200), np.where(rng.random(200) < 0.4, 0, rng.integers(0, 90, 200))]
        assert packing.best_fit(sizes, groups, 100).tolist() == plain(sizes.tolist(), [g.tolist() for g in groups], 100)


# Pieces


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.load(MODEL)


def some_texts():
    rng = random.Random(8)
    texts = ["".join(rng.choice(["a", "b", "x", " ", "the", "ing", " the", ".", ",", "io", "\n", "é", "\U0001f600", "  "]) for _ in range(rng.randint(1, 25))) for _ in range(300)]
    return texts + ["", " ", "  lead", "trail ", "Hello  world", "\x00\x01", "日本語 test", "a\tb\r\nc"]


def test_path_has_the_best_score_and_decodes(vocabulary):
    texts = some_texts()
    scores = {p: s for p, s, u in zip(vocabulary.pieces, vocabulary.scores, vocabulary.usable) if u}
    ids, bounds = pieces.encode_texts(texts, vocabulary)
    assert pieces.decode_ids(ids, bounds, vocabulary) == texts
    byte_ids = set(vocabulary.byte_ids)
    for text, lo, hi in zip(texts, bounds, bounds[1:]):
        shown = pieces.BLANK + text.replace(" ", pieces.BLANK) if text else ""
        unknown = sum(1 for c in shown if c not in scores)
        got = sum(vocabulary.scores[i] for i in ids[lo:hi].tolist() if i not in byte_ids) + unknown * vocabulary.unknown_score
        assert got == pytest.approx(brute.best_score(shown, scores, vocabulary.unknown_score), rel=1e-12)


def test_no_worse_than_the_public_library(vocabulary):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    model.ParseFromString(open(MODEL, "rb").read())
    model.trainer_spec.model_type = 1
    library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    texts = [text for text in some_texts() if re.fullmatch("[a-z., ]+", text)]
    ids, bounds = pieces.encode_texts(texts, vocabulary)
    for text, lo, hi in zip(texts, bounds, bounds[1:]):
        own, other = ids[lo:hi].tolist(), library.encode(text)
        assert own == other or sum(vocabulary.scores[i] for i in own) >= sum(vocabulary.scores[i] for i in other)


def test_words_and_whole_texts_give_one_answer(vocabulary):
    parts = {name: getattr(vocabulary, name) for name in ("pieces", "scores", "usable", "byte_ids", "unknown", "dummy_prefix")}
    whole = pieces.Vocabulary(**parts, whole_words=False)
    texts = [text for text in some_texts() if re.fullmatch("[a-z., \n]+", text)]
    a, b = pieces.encode_texts(texts, vocabulary), pieces.encode_texts(texts, whole)
    assert a[0].tolist() == b[0].tolist() and a[1].tolist() == b[1].tolist()


def test_vocabulary_without_byte_pieces():
    small = pieces.Vocabulary(["<unk>", "▁", "a", "b", "ab", "▁ab"], [0, -4, -3, -3, -2, -1.5], [False] + [True] * 5, [], 0, True, True)
    ids, bounds = pieces.encode_texts(["ab aab", "azzb", "é"], small)
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [[5, 1, 2, 4], [1, 2, 0, 3], [1, 0]]


def test_pieces_of_odd_rows(spark, odd, none, vocabulary):
    rows = pieces.encode(odd, "doc_id", "text", vocabulary)
    got = {row["id"]: row for row in rows.collect()}
    assert got[0]["ids"] == got[1]["ids"] == [] and [k for k, row in got.items() if not row["round_trip"]] == [10]
    texts = {row["id"]: row["text"] for row in pieces.decode(rows, "id", "ids", vocabulary).collect()}
    want = {row["doc_id"]: (row["text"] or "").replace(pieces.BLANK, " ") for row in odd.collect()}
    assert texts == want and pieces.encode(none, "doc_id", "text", vocabulary).count() == 0
    bad = spark.createDataFrame([(1, None), (2, []), (3, [None, -1, 99_999_999])], "id long, ids array<int>")
    assert {row["id"]: row["text"] for row in pieces.decode(bad, "id", "ids", vocabulary).collect()} == {1: "", 2: "", 3: "⁇⁇⁇"}


# Fingerprints


@pytest.mark.parametrize("parts", ["1", "3", "8"])
def test_fingerprints_of_edited_texts(spark, odd, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        docs = odd.select("doc_id", "text", "id").unionByName(
            spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id + 1000 AS doc_id", "text", "lang AS id")
        )
        terms = imatch.lexicon(docs, "text")
        got = imatch.compare_with_next(docs, "doc_id", "text", terms).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda row: (row[0] is None, -(row[0] or 0), row[1] or ""))
    want, prints = [], {row["fingerprint"] for row in got}
    for row, following in zip(rows, rows[1:] + rows[:1]):
        a, b = row[1] or "", following[1] or ""
        half = len(a) // 2
        edited = a[:len(a) - half] + b[:half]
        want.append((row[0], len(a), hashlib.sha256(edited.encode()).hexdigest()))
    assert sorted(map(str, want)) == sorted(str((row["id"], row["n_chars"], row["edited_sha256"])) for row in got)
    plain = {row["id"]: row["fingerprint"] for row in imatch.fingerprint(docs, "doc_id", "text", terms).collect()}
    text_of = {row[0]: row[1] or "" for row in rows}
    assert all(plain[row["id"]] == row["fingerprint"] for row in got)
    assert len(prints) >= 0.95 * len(set(text_of.values())) and len({plain[0], plain[1]}) == 1
    assert all(0 <= row["near_edited"] <= 1 and 0 <= row["near_next"] <= 1 for row in got)
    long = [row for row in got if row["id"] is not None and row["id"] >= 1000 and row["n_chars"] > 300]
    assert np.mean([row["near_edited"] > row["near_next"] for row in long]) > 0.9


def test_lexicon_is_the_band_of_document_frequencies(spark):
    texts = ["Alpha beta", "alpha, gamma gamma", "alpha-delta", "beta gamma", "", None, "omega", "beta beta (beta)"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    plan = imatch.Plan(min_idf=math.log(8 / 3) - 0.01, max_idf=math.log(8 / 2) + 0.01)
    want = [flat.word_hashes(*flat.utf8(pa.array([word])), gaps=flat.NO_TERM)[0][0] for word in ("alpha", "beta", "gamma")]
    assert imatch.lexicon(docs, "text", plan).tolist() == sorted(want)
    assert len(imatch.lexicon(docs.limit(0), "text", plan)) == 0
    assert imatch.compare_with_next(docs.limit(0), "id", "text", np.zeros(0, np.uint64)).count() == 0


# Personal data


def fuzz_texts():
    rng = random.Random(3)
    letters = "a1.2@+- ()b9.8%é\U0001f600\n-_"
    out = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    out += ["".join(rng.choice("0123456789. -+") for _ in range(60)) for _ in range(700)]
    return out + ["a@b.c%x@d.e", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "x" * 5000 + "@" + "a." * 3000 + "b", "1" * 20_000, "a" * 200_000 + " @", "+" * 3000 + "1 5"]


def test_base_spans_equal_brute_force(spark, odd):
    rows = list(enumerate(fuzz_texts()))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    docs = docs.unionByName(odd.where("doc_id IS NOT NULL").selectExpr("doc_id + 100000 AS doc_id", "text"))
    texts = {row[0]: row[1] for row in docs.collect()}
    for row in pii.report(docs, "doc_id", "text").collect():
        found = brute.personal_spans(texts[row["id"]])
        listed = ",".join(f"{kind}:{start}:{end}" for start, _, end, kind in found)
        assert row["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert [row[f"n_{kind}"] for kind, _ in brute.KINDS] == [sum(span[1] == k for span in found) for k in range(4)]
        if not row["n_term"]:
            assert row["spans"] == listed


def disclosure_rows():
    plain = [f"common words stand here number{k} and there" for k in range(60)]
    known = [f"case{k} common words the zyxgardener of x.y@z.org lives and there" for k in range(6)]
    other = [f"case{k} common words the plumber of q{k}@z.org lives and there" for k in range(20)]
    return plain + known + other + ["zyxgardener alone common words", known[0], known[0], ""]


def found_terms(spark, rows, plan):
    """The terms of every row, held against the plain version."""
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4)
    got = {}
    for row in pii.report(docs, "doc_id", "text", plan).collect():
        spans = [span.split(":") for span in row["spans"].split(",") if span.startswith("term")]
        got[row["id"]] = [(rows[row["id"]] or "")[int(a):int(b)] for _, a, b in spans]
        assert len(spans) == row["n_term"]
    assert [got[at] for at in range(len(rows))] == brute.term_spans(rows, plan)
    return got


@pytest.mark.parametrize("broadcast", [50_000, 0])
def test_terms_that_disclose_an_entity(spark, broadcast):
    rows = disclosure_rows()
    plan = pii.Plan(broadcast_terms=broadcast, min_bits=2.0)
    got = found_terms(spark, rows, plan)
    for at, text in enumerate(rows):
        assert ("zyxgardener" in got[at]) == ("x.y@z.org" in text) and not {"common", "words", "there"} & set(got[at]), text
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").withColumn("terms", F.lit("clash")).withColumn("base", F.lit(1))
    clean = pii.sanitise(docs, "text", plan)
    assert clean.columns == docs.columns
    texts = {row["doc_id"]: row["text"] for row in clean.collect()}
    assert all(("zyxgardener" in texts[at]) == (text.startswith("zyxgardener")) and "@" not in texts[at] for at, text in enumerate(rows))
    assert all(texts[at] == text for at, text in enumerate(rows) if "@" not in text) and len(texts) == len(rows)


def test_copies_hide_no_disclosing_term(spark):
    rows = disclosure_rows()
    rows += [rows[60]] * 300 + [rows[0]] * 300
    for broadcast in (50_000, 0):
        got = found_terms(spark, rows, pii.Plan(broadcast_terms=broadcast, min_bits=2.0))
        assert {at for at in got if "zyxgardener" in got[at]} == {at for at, text in enumerate(rows) if "x.y@z.org" in text}


def test_production_plan_judges_hot_and_rare_entities(spark):
    rows = disclosure_rows()
    rows += [f"note{k} common words the hotkeeper of hot@z.org lives and there" for k in range(60)]
    rows += [f"item{k} common words the miller of nothing lives and there" for k in range(60)]
    rows += [f"memo{k} common words the rarebaker of rare@z.org lives and there" for k in range(2)]
    got = found_terms(spark, rows, pii.Plan())
    known = {"x.y@z.org": "zyxgardener", "hot@z.org": "hotkeeper", "rare@z.org": "rarebaker"}
    for at, text in enumerate(rows):
        for mail, term in known.items():
            assert (term in got[at]) == (mail in text), text
        assert not {"common", "words", "lives", "there"} & set(got[at])


@pytest.mark.parametrize("broadcast", [50_000, 0])
def test_disclosing_terms_have_any_length(spark, broadcast):
    long = "h" * 60
    rows = disclosure_rows() + [f"note{k} common words the {term} of l@z.org lives and there" for k in range(4) for term in ("Li", "李", long)]
    got = found_terms(spark, rows, pii.Plan(broadcast_terms=broadcast))
    for at, text in enumerate(rows):
        if "l@z.org" in text:
            assert text.split()[4] in got[at], text


def test_values_of_one_text_are_judged_by_their_group(spark):
    """Every value stands in one text; the terms stand far from it, in other cases, and twice."""
    far = " ".join(f"filler{k % 7}" for k in range(300))
    rows = [f"{far} only{k}" for k in range(80)] + [None, ""]
    rows += [f"Millwright {far} write to p{k}@guild{k % 2}.org or 10.7.{k % 2}.{k} millwright" for k in range(6)]
    rows += [f"the cooper {far} calls +49 30 55{k}5501{k} and pays 4111 1111 1111 1111" for k in range(3)]
    got = found_terms(spark, rows, pii.Plan())
    for at, text in enumerate(rows):
        assert [term for term in got[at] if term.lower() in ("millwright", "cooper")] == (
            ["Millwright", "millwright"] if "guild" in (text or "") else ["cooper"] if "cooper" in (text or "") else [])


def test_counts_of_the_disclosure(spark):
    rows = disclosure_rows() + [f"m{k} lives near 10.0.0.{k % 4} and +49 30 1234 56{k}" for k in range(8)] + [None]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4)
    holding = pii.with_base(docs.select("text"), "text").where("text_key IS NOT NULL").dropDuplicates(["text_key"])
    _, counted = pii.counts(docs, holding, F.coalesce("text", F.lit("")))
    got = sorted((row["n_te"], row["n_t"], row["n_e"], row["n"]) + (row["term"],) for row in counted.collect())
    n_te, n_t, n_e, n = brute.co_occurrence(rows)
    least, plan = Counter(), pii.Plan()
    for text in set(rows) - {None}:
        held = set().union(*(brute.entities(a, kind, b, text) for a, kind, b, _ in brute.personal_spans(text)))
        if any(n_e[entity] >= plan.min_texts for entity in held):
            least.update({term.lower() for term in re.findall(r"[^\W_]+", text)})
    want = [
        (both, n_t[term], n_e[entity], n, term) for (term, entity), both in n_te.items()
        if both >= plan.min_texts and both >= plan.min_disclosure * least[term]
    ]
    assert got == sorted(want) and got


def test_overlapping_and_odd_spans_are_replaced(spark, odd, none):
    docs = spark.createDataFrame([
        (1, "call +49 30 1234567 or 1.2.3.4 now"), (2, "é\U0001f600 4111 1111 1111 1111 ü a@b.co"), (3, "+1.2.3.4 5678901 x"), (4, None),
    ], "doc_id long, text string")
    got = {row["doc_id"]: row["text"] for row in pii.sanitise(docs, "text").collect()}
    assert got == {1: "call [PHONE] or [IP] now", 2: "é\U0001f600 [CARD] ü [EMAIL]", 3: "[PHONE] x", 4: None}
    clean = pii.sanitise(odd, "text")
    assert sorted(map(str, clean.collect())) == sorted(map(str, odd.collect()))
    assert pii.sanitise(none, "text").count() == 0 and pii.report(none, "doc_id", "text").count() == 0


def test_personal_data_runs_no_python(spark):
    plan = pii.report(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id", "text")._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# Archive


def page_rows():
    big = "<p>é</p>" * 200
    return [
        (1, "http://a/1", big), (2, "http://a/2", big), (9, None, big), (9, "http://a/9", big), (None, "http://a/n", big),
        (3, "http://a/3", "short"), (4, "http://a/4", "short"), (5, "http://a/5", None), (6, "http://a/6", ""), (7, "http://a/ 7\r\nX: y", "x\r\n\r\ny" * 300),
        (8, "http://a/8", "z" * 999), (10, "http://a/10", "z" * 999), (11, "u", "z" * 1000), (12, "u", "z" * 1000), (None, "u", "only nameless" * 100),
    ]


def test_archive(spark):
    pages = spark.createDataFrame([(*row, "clash", "clash") for row in page_rows()], "page_id long, url string, html string, sha256 string, payload string")
    archive = warc.write(pages.repartition(3), "page_id", "url", "html")
    got = sorted(((row["id"], row["payload_bytes"], row["payload_digest"], row["record_type"], row["refers_to"]) for row in warc.read(archive).collect()), key=str)
    last = defaultdict(lambda: None)
    for key, _, html in page_rows():
        if key is not None:
            last[html or ""] = max(last[html or ""] or key, key)
    want = []
    for key, _, html in page_rows():
        data = (html or "").encode()
        whole = len(data) < 1000 or key == last[html or ""]
        want.append((key, len(data), hashlib.sha1(data).hexdigest(), "response" if whole else "revisit", None if whole else last[html or ""]))
    assert got == sorted(want, key=str)
    assert archive.payloads.count() == len({html or "" for _, _, html in page_rows()})
    for row in warc.records(archive).collect():
        head, _, body = bytes(row["record"]).partition(b"\r\n\r\n")
        length = int(re.search(rb"Content-Length: (\d+)", head)[1])
        assert head.startswith(b"WARC/1.1\r\n") and len(body) == length
        if b"WARC-Type: response" in head:
            assert hashlib.sha256(body.partition(b"\r\n\r\n")[2]).hexdigest() == row["sha256"]
        else:
            assert b"WARC-Refers-To: <urn:page:" in head and row["payload"] is None
    assert warc.read(archive).where("id = 7").first()["url"] == "http://a/%207%20%20X:%20y"
    empty = warc.write(pages.limit(0), "page_id", "url", "html")
    assert warc.read(empty).count() == 0


def test_text_ids_and_export(spark, tmp_path):
    pages = spark.createDataFrame([("a>b c", "u", "one"), ("null+", "u", "two"), (None, "u", "three")], "page_id string, url string, html string")
    archive = warc.write(pages, "page_id", "url", "html")
    assert {row["id"] for row in warc.read(archive).collect()} == {"a>b c", "null+", None}
    warc.export(archive, f"file://{tmp_path}/warc")
    written = b"".join(path.read_bytes() for path in sorted((tmp_path / "warc").glob("part-*")))
    assert written.count(b"WARC/1.1\r\n") == 3 and written.endswith(b"\r\n\r\n")


def test_many_candidate_terms_move_no_other_words(spark):
    docs = spark.createDataFrame([("w1 w2 other",), ("w2 w59999 other other",), ("w2 w59999 other other",)], "text string")
    wanted = spark.range(60_000).select(F.concat(F.lit("w"), "id").alias("term"))
    held = pii._texts_holding(docs, F.col("text"), wanted, pii.Plan())
    assert "SortMergeJoin" not in held._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, held.collect())) == [("w1", 1), ("w2", 2), ("w59999", 1)]
