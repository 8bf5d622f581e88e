"""Batches of a stream take effect once, also if they come twice or stop half way."""

import pytest

from quern.sources.incremental import outcome_counts
from quern.streaming import batches

SCHEMA = "recipe_id bigint, title string"


def rows(spark, target):
    found = batches.committed(spark, target)
    return [] if found is None else sorted((r.recipe_id is not None, r.recipe_id, r.title) for r in found.collect())


def shown(values):
    return sorted((key is not None, key, title) for key, title in values)


def test_a_batch_that_comes_twice_writes_once(spark, tmp_path):
    target = str(tmp_path / "t")
    batches.prepare(spark, target)
    stored = spark.createDataFrame([(1,)], "recipe_id bigint")
    work = batches.unseen("recipe_id", stored)
    first = spark.createDataFrame([(1, "known"), (2, "a"), (2, "again"), (None, "no id")], SCHEMA)
    assert batches.handle(first, 0, "s", target, work)
    want = shown([(2, "a"), (2, "again"), (None, "no id")])
    assert rows(spark, target) == want
    assert not batches.handle(first, 0, "s", target, work)
    assert rows(spark, target) == want
    # The same rows in a later batch, and in one of another stream, are not new, but for those without an id.
    batches.handle(spark.createDataFrame([(2, "late"), (3, "b")], SCHEMA), 1, "s", target, work)
    batches.handle(spark.createDataFrame([(3, "late"), (4, "c")], SCHEMA), 0, "other", target, work)
    assert rows(spark, target) == shown([*((key, title) for _, key, title in want), (3, "b"), (4, "c")])


def test_a_batch_that_stopped_before_its_commit(spark, tmp_path, monkeypatch):
    source, target, checkpoint = (str(tmp_path / name) for name in ("source", "t", "c"))
    schema = spark.createDataFrame([], SCHEMA).schema
    spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], SCHEMA).coalesce(1).write.parquet(source)
    commit = batches.commit

    def stop(*_):
        raise RuntimeError("stopped")

    monkeypatch.setattr(batches, "commit", stop)
    with pytest.raises(Exception, match="stopped"):
        batches.run(spark, source, schema, target, checkpoint, batches.unseen("recipe_id"))
    assert rows(spark, target) == [] and spark.read.parquet(f"{target}/rows").count() == 3
    monkeypatch.setattr(batches, "commit", commit)
    for _ in range(2):
        batches.run(spark, source, schema, target, checkpoint, batches.unseen("recipe_id"))
        assert rows(spark, target) == shown([(1, "a"), (1, "b"), (2, "c")])
    spark.createDataFrame([(2, "late"), (5, "new")], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    batches.run(spark, source, schema, target, checkpoint, batches.unseen("recipe_id"))
    assert rows(spark, target) == shown([(1, "a"), (1, "b"), (2, "c"), (5, "new")])
    # A lost checkpoint reads everything again and finds nothing new.
    batches.run(spark, source, schema, target, str(tmp_path / "c2"), batches.unseen("recipe_id"))
    assert rows(spark, target) == shown([(1, "a"), (1, "b"), (2, "c"), (5, "new")])


def test_outcomes_add_up_over_batches(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / name) for name in ("source", "t", "c"))
    log = spark.createDataFrame([(at, [200, 404, None, 503, 204][at % 5]) for at in range(37)], "id int, status int")
    log.repartition(4).write.parquet(source)
    for _ in range(2):
        batches.run(spark, source, log.schema, target, checkpoint, batches.tallies(), files_per_batch=1)
        assert sorted(map(tuple, batches.tallied(spark, target).collect())) == sorted(map(tuple, outcome_counts(log).collect()))
    assert batches.commits(spark, target).count() == 4
    batches.prepare(spark, str(tmp_path / "empty"))
    assert batches.tallied(spark, str(tmp_path / "empty")).isEmpty()
