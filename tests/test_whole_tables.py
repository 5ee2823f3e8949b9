"""Queries that run over whole tables, against their SQL."""

import os

import duckdb
import pytest
from test_entry import CORE, rows

import __spark_entry__
from emberline.plans import registry

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", ["spatial_within_all_boxes", "rasterize_all_boxes_latest", "spatial_nearest_all_boxes"])
def test_every_supplier(spark, duck, name):
    got = CORE[name](spark, SF).toPandas()
    assert rows(got) == rows(duck.execute(__spark_entry__.oracle_sql()[name]).df())
    assert got.id.max() > 40


def test_every_value(spark, duck):
    name = "truncated_days_vs_all_values"
    got = CORE[name](spark, SF).toPandas()
    assert rows(got) == rows(duck.execute(__spark_entry__.oracle_sql()[name]).df())
    events = registry.table(spark, SF, "events").filter("event_type IN ('error', 'purchase')")
    assert got.n[0] > registry._truncated_days(events.filter("value > 60")).first().n
