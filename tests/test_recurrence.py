"""Golden values worked out by hand."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from emberline.functions import codes, grid
from emberline.operators import distribution, layers, recurrence, spatial
from emberline.sources import tables

D = datetime


@pytest.fixture(scope="module")
def points(spark):
    rows = []
    for cell in (1, 2):
        rows += [(cell, "A", D(2000, 1, 1), 1, 6, 42, 10), (cell, "B", D(2010, 1, 1), 3, 6, 52, 11), (cell, "C", D(2010, 3, 1), 2, 6, 52, 12)]
    rows += [(3, "D", D(2005, 6, 15), 4, 10, 71, 13), (4, "E", D(1990, 1, 1), 1, 6, 42, 14), (4, "F", D(2020, 1, 1), None, 6, 42, 15)]
    schema = "geohash long, Event_ID string, Ig_Date timestamp_ntz, bs int, eco_lvl_1 int, nlcd int, perim_index int"
    df = spark.createDataFrame(rows, schema)
    return df.withColumn("eco_lvl_2", F.lit(1)).withColumn("eco_lvl_3", F.lit(1))


def values(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_pair_gaps(points):
    got = values(recurrence.pair_gaps(points), "geohash", "dt", "bs_1", "bs_2")
    assert got == [(c, pytest.approx(dt), a, b) for c in (1, 2) for dt, a, b in ((59 / 365, 3, 2), (3653 / 365, 1, 3))]
    with pytest.raises(ValueError):
        recurrence.pair_gaps(points, ["bs"])


def test_survival(points):
    got = values(recurrence.survival(points), "geohash", "n", "st", "bs")
    assert got == [(1, 3, pytest.approx(3593 / 365), 2), (2, 3, pytest.approx(3593 / 365), 2), (3, 1, pytest.approx(5313 / 365), 4)]


def test_histories(points):
    h = recurrence.event_histories(points, varied=["nlcd"])
    assert values(h, "# Fires", "Pixel_Count") == [(1, 1), (2, 1), (3, 2)]
    assert recurrence.event_histories(points, varied=["bs"]).count() == 3
    assert values(recurrence.history_gaps(h, {"nlcd": [42, 52]}), "dt", "Pixel_Count", "nlcd") == [(pytest.approx(3653 / 365), 2, 52), (pytest.approx(10957 / 365), 1, 42)]
    assert values(recurrence.history_starts(h, filters={"nlcd": [42]}), "ut", "Pixel_Count") == [(0.0, 1), (pytest.approx(3652 / 365), 2)]
    assert values(recurrence.history_ends(h, filters={"nlcd": [52]}), "ct", "Pixel_Count") == [(pytest.approx(3593 / 365), 2)]
    assert recurrence.blank_entities(h, 100).first()["blank"] == 96
    spans = values(recurrence.history_spans(h), F.expr("extract(DAY FROM ct)"), F.expr("extract(DAY FROM ut)"), "Pixel_Count")
    assert spans == [(0, 0, 1), (3593, 3652, 2), (5313, 5644, 1)]
    assert recurrence.history_starts(h).count() == 3


def test_keep_last(spark):
    df = spark.createDataFrame([(7, "A", D(2001, 5, 5)), (7, "B", D(2001, 5, 5))], "geohash long, Event_ID string, Ig_Date timestamp_ntz")
    assert [r["Event_ID"] for r in recurrence.keep_last(df).collect()] == ["B"]


def test_grid(spark):
    df = spark.createDataFrame([(0,), (157144,), (8000000000,), (15737971599,)], "g long")
    lon, lat = grid.to_lonlat(grid.centre_x(F.col("g")), grid.centre_y(F.col("g")))
    got = df.select("g", grid.centre_x(F.col("g")).alias("x"), grid.centre_y(F.col("g")).alias("y"), F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat")).collect()
    assert tuple(got[2]) == (8000000000, 991320.0, 1695330.0, -84.612887, 37.759484)
    assert tuple(got[0][1:]) == (-2406120.0, 3222570.0, -128.736695, 48.23438)
    x, y = grid.from_lonlat(F.lit(-120.0), F.lit(40.0))
    row = spark.range(1).select(x.alias("x"), y.alias("y"), grid.cell_of(x, y).alias("cell"), grid.cell_of(F.lit(-2406136.0), F.lit(0.0)).alias("out")).first()
    assert (round(row.x, 4), round(row.y, 4), row.cell, row.out) == (-2009423.5932, 2142068.0284, 5659868671, None)
    with pytest.raises(Exception):
        spark.range(1).select(grid.cell_of(F.lit(-2406136.0), F.lit(0.0), strict=True)).collect()


def test_codes(spark):
    one = spark.range(1)
    assert tuple(one.select(*codes.eco_levels(F.lit("15.4.1"))).first()) == (15, 154, 15401)
    years = [1984, 1999, 2000, 2019, 2020]
    assert [one.select(codes.vintage(F.lit(y))).first()[0] for y in years] == [1990, 1990, 2000, 2010, 2020]
    assert tuple(one.select(*codes.cover_years(F.lit(1984))).first()) == (1984, 1984, 1985)
    assert tuple(one.select(codes.survival_days(F.lit(None).cast("date"), 1984, 2000), codes.survival_days(F.lit("1999-12-31").cast("date"), 1984, 2000)).first()) == (5840, 1)
    days = codes.whole_days(F.lit("2000-01-01 23:00").cast("timestamp_ntz"), F.lit("2000-01-03 01:00").cast("timestamp_ntz"))
    assert one.select(days).first()[0] == 1
    assert one.select(codes.encode(F.lit("a"), {"a": 3})).first()[0] == 3
    with pytest.raises(Exception):
        one.select(codes.encode(F.concat(F.lit("z"), F.col("id").cast("string")), {"a": 3})).collect()
    assert one.select(codes.encode(F.lit("z"), {"a": 3}, strict=False)).first()[0] is None


def test_bins_and_weights(spark):
    df = spark.createDataFrame([(0.0,), (37.99,), (38.0,), (38.01,)], "dt double")
    assert values(distribution.histogram(df, 38), "bin", "n") == [(0, 1), (37, 2)]
    w = spark.createDataFrame([(0.9,), (19.5,), (38.2,)], "dt double")
    assert values(distribution.histogram(w, 39, weighted=True), "bin", "weight") == [(0, 1.0), (19, 2.0)]


def test_spatial(spark):
    square = [(1, 0.0, 0.0, 4.0, 0.0), (1, 4.0, 0.0, 4.0, 4.0), (1, 4.0, 4.0, 0.0, 4.0), (1, 0.0, 4.0, 0.0, 0.0)]
    hole = [(1, 1.0, 1.0, 3.0, 1.0), (1, 3.0, 1.0, 3.0, 3.0), (1, 3.0, 3.0, 1.0, 3.0), (1, 1.0, 3.0, 1.0, 1.0)]
    edges = spark.createDataFrame(square + hole, "id int, x1 double, y1 double, x2 double, y2 double")
    runs = spatial.scanline_runs(edges)
    points = spark.createDataFrame([(i * 6 + j, i, j) for i in range(6) for j in range(6)], "pid int, row int, col int")
    inside = {r["pid"] for r in spatial.within(points, runs).collect()}
    assert inside == {i * 6 + j for i in range(4) for j in range(4) if not (i in (1, 2) and j in (1, 2))}
    assert spatial.assign(points, runs, edges, "pid").count() == 36
    assert spatial.dissolve(runs, "id").count() == 12


def test_layers(spark, tmp_path):
    p = spark.createDataFrame([(1, 2000), (2, 2000)], "geohash long, year int")
    layer = spark.createDataFrame([(1, 5), (2, None)], "geohash long, value int")
    assert layers.attach(p, layer, "v").count() == 1
    assert layers.attach(p, layer, "v", how="left").count() == 2
    with pytest.raises(ValueError):
        layers.require_years(p, [2000, 2001])
    assert layers.backfill_year(p, 2000, 1999).count() == 4
    dem = spark.createDataFrame([(i, j, float(30 * j)) for i in range(4) for j in range(4)], "row int, col int, z double")
    got = layers.dominant_slope(dem).collect()
    assert len(got) == 4 and all(abs(r.slope - 45) < 1e-9 and abs(r.aspect - 270) < 1e-9 for r in got)
    near = layers.proximity(dem.select("row", "col"), dem.filter("row = 0 AND col = 0").select("row", "col"))
    assert {(r.row, r.col): r.proximity for r in near.collect()}[(3, 0)] == 90
    path = str(tmp_path / "frame")
    assert tables.missing_years(spark, path, [2000]) == [2000]
    tables.write_frame(p, path, by="year")
    assert tables.missing_years(spark, path, [2000, 2001]) == [2001]
    tables.write_frame(p, path, mode="ignore", by="year")
    with pytest.raises(Exception):
        tables.write_frame(p, path, by="year")
