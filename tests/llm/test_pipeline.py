"""Each stage on its own input, against its brute-force version; the run as a whole."""

import pytest

import corpus_pipeline
from quern.llm import langid, quality
from tests.llm import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    steps = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, steps[-1][1], SF).write.parquet(f"file://{folder}/{name}")
        steps.append((name, spark.read.parquet(f"file://{folder}/{name}")))
    return dict(steps)


def rows(df):
    return {row["doc_id"]: row for row in df.collect()}


def test_columns_stay_until_the_last_stage(stages):
    columns = stages["documents"].columns
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "quality", "near_duplicates", "personal_data", "packing"]
    assert all(stages[name].dtypes == stages["documents"].dtypes for name in list(stages)[:-1]) and columns


def test_language_and_quality_keep_what_their_scores_say(spark, stages):
    docs = stages["documents"]
    model = langid.train(docs.where(~corpus_pipeline._held_out(3, 1)), "doc_id", "text", "lang")
    kept = {
        row["id"] for row in langid.predict(docs, "doc_id", "text", model).collect()
        if row["lang_pred"] != "und" and not (row["n_grams"] >= 20 and row["coverage"] < 0.2)
    }
    assert set(rows(stages["language"])) == kept
    docs, labels = stages["language"], spark.read.parquet(f"{SF}/labels.parquet")
    train = ~corpus_pipeline._held_out(5, 0)
    network = quality.train(docs.where(train), labels.where(train), "doc_id", "text", "quality")
    kept = {row["id"] for row in quality.score(docs, "doc_id", "text", network).collect() if row["score"] >= 0.3}
    assert set(rows(stages["quality"])) == kept


def test_one_document_of_each_group_stays(stages):
    found = brute.near_groups([(row["doc_id"], row["text"]) for row in stages["quality"].collect()], 5)
    assert sorted(row["doc_id"] for row in stages["near_duplicates"].collect()) == sorted({root for _, root in found.values()})


def test_personal_data_is_replaced_and_nothing_else(stages):
    before, after = rows(stages["near_duplicates"]), rows(stages["personal_data"])
    assert set(before) == set(after)
    for key, row in before.items():
        text, at, out = row["text"] or "", 0, []
        for start, _, end, kind in brute.personal_spans(text):
            if start >= at:
                out += [text[at:start], f"[{kind.upper()}]"]
            at = max(at, end)
        want = "".join(out) + text[at:]
        assert after[key]["text"] == want and after[key]["n_chars"] == len(want)


def test_every_word_is_packed_once(stages):
    docs, bins = rows(stages["personal_data"]), {}
    total = dict.fromkeys(docs, 0)
    for row in stages["packing"].collect():
        total[row["doc_id"]] += row["n_tokens"]
        bins.setdefault(row["bin_id"], []).append(row)
    assert total == {key: len((row["text"] or "").split()) for key, row in docs.items()}
    bins.pop(None, None)
    for members in bins.values():
        sources = [docs[row["doc_id"]]["source"] for row in members]
        assert len(sources) == len(set(sources)) and sum(row["n_tokens"] for row in members) <= 2048


def test_run_gives_the_rows_of_the_last_stage(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    assert sorted(map(str, got.collect())) == sorted(map(str, stages["packing"].collect()))


def test_odd_and_empty_tables(spark, odd, none, tmp_path):
    spark.createDataFrame([(8, 1, 0), (9, 0, 0), (None, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    for first in (odd, none):
        docs = first
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, f"file://{tmp_path}")
            docs = spark.createDataFrame(docs.collect(), docs.schema)
            assert name == "packing" or docs.columns == first.columns
        assert (docs.count() == 0) == (first is none)
