"""Narrow tables whose rows cost much are divided by rows, not by bytes."""

from quern.plans.checks import records
from quern.plans.tables import derive
from quern.sources.tables import divided


def test_a_task_gets_a_bounded_number_of_rows(spark, tmp_path):
    rows = spark.range(100_000).selectExpr("id AS event_id", "'view' AS event_type", "1.0D AS value", "'{\"k\": 1}' AS props")
    rows.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    found = derive(spark, str(tmp_path), records.DOCUMENTS, records.EVENTS_PER_TASK)
    sizes = found.rdd.glom().map(len).collect()
    assert sum(sizes) == 100_000 and max(sizes) <= 1.1 * records.EVENTS_PER_TASK
    assert found.select("event_id").distinct().count() == 100_000


def test_enough_splits_stay(spark):
    df = spark.range(0, 1000, 1, 8)
    assert divided(df, 500) is df and divided(df, 10).rdd.getNumPartitions() == 100
