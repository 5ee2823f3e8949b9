"""The driver's contract, without the training-data queries."""

import os

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
CORE = __spark_entry__._core()[0]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def rows(frame):
    cols = sorted(frame.columns)
    text = frame[cols].map(lambda v: str(round(v, 6) if isinstance(v, float) else v))
    return cols, sorted(map(tuple, text.to_numpy().tolist()))


@pytest.mark.parametrize("name", sorted(CORE))
def test_query_equals_sql(spark, duck, name):
    assert rows(CORE[name](spark, SF).toPandas()) == rows(duck.execute(__spark_entry__.oracle_sql()[name]).df())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__._core()[1]) == set(CORE)
