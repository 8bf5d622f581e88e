"""Every registered query against its SQL on the smallest data."""

import duckdb
import pytest

from oracle_check import TABLES, rows_of
from quern.plans.checks import collect

CHECKS = collect()


@pytest.fixture(scope="module")
def con(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", CHECKS)
def test_query_equals_sql(spark, sf_dir, con, name):
    df = CHECKS[name].query(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    if CHECKS[name].sql is None:
        return
    result = con.sql(CHECKS[name].sql)
    assert sorted(df.columns) == sorted(result.columns)
    assert got == rows_of(result.columns, result.fetchall())


def test_every_operator_of_the_inventory_is_registered():
    wanted = {"s": 13, "e": 15, "p": 7, "i": 6, "q": 18, "n": 11, "v": 15, "a": 15, "c": 16}
    names = {name.split("_")[0] for name in CHECKS}
    numbered = {f"{part[0]}{int(part[1:])}" for part in names}
    assert {f"{letter}{at}" for letter, count in wanted.items() for at in range(1, count + 1)} <= numbered
