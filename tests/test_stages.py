"""Selecting, pairing, clipping and distances against plain versions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from emberline.functions import codes
from emberline.operators import layers, prepare, recurrence, spatial
from emberline.plans import extract
from emberline.sources import tables

EDGES = "id int, x1 double, y1 double, x2 double, y2 double"


def ring(key, *points):
    return [(key, *map(float, a), *map(float, b)) for a, b in zip(points, [*points[1:], points[0]])]


def test_nearest_everywhere(spark):
    rng = random.Random(1)
    edges = [(k, *(rng.uniform(-40, 400) for _ in range(2)), 0.0, 0.0) for k in range(40)]
    edges = [(k, x, y, x + rng.uniform(-30, 30), y + rng.uniform(-30, 30)) for k, x, y, _, _ in edges]
    points = [(k, rng.randrange(-2000, 2000), rng.randrange(-200, 600)) for k in range(150)]

    def d2(px, py, e):
        _, x1, y1, x2, y2 = e
        dx, dy = x2 - x1, y2 - y1
        t = max(0.0, min(1.0, ((px - x1) * dx + (py - y1) * dy) / (dx * dx + dy * dy)))
        return (px - x1 - t * dx) ** 2 + (py - y1 - t * dy) ** 2

    want = {p: min(edges, key=lambda e: d2(c + 0.5, r + 0.5, e))[0] for p, r, c in points}
    got = spatial.nearest(spark.createDataFrame(points, "pid int, row int, col int"), spark.createDataFrame(edges, EDGES), "pid").collect()
    assert {r.pid: r.id for r in got} == want and len(got) == len(points)
    none = spatial.nearest(spark.createDataFrame(points, "pid int, row int, col int"), spark.createDataFrame([], EDGES), "pid")
    assert none.count() == 0


def test_proximity_everywhere(spark):
    rng = random.Random(2)
    cells = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)]
    targets = [(rng.randrange(60), rng.randrange(60)) for _ in range(12)]
    got = layers.proximity(spark.createDataFrame(cells, "row int, col int").distinct(), spark.createDataFrame(targets, "row int, col int"), cap=3000.0)
    for r in got.collect():
        assert r.proximity == int(min(3000.0, min(math.hypot(r.row - a, r.col - b) for a, b in targets) * 30))


def test_intersecting(spark):
    area = ring(0, (0, 0), (20, 0), (20, 20), (10, 5), (0, 20))  # a notch from below
    shapes = ring(1, (1, 1), (3, 1), (3, 3)) + ring(2, (9, 15), (11, 15), (11, 18)) + ring(3, (-50, -50), (90, -50), (90, 90), (-50, 90))
    shapes += ring(4, (-5, 8), (30, 8), (30, 9), (-5, 9)) + ring(5, (40, 0), (45, 0), (45, 5)) + ring(6, (20, 10), (25, 10), (25, 12))
    edges, one = spark.createDataFrame(shapes, EDGES), spark.createDataFrame([a[1:] for a in area], "x1 double, y1 double, x2 double, y2 double")
    assert {r.id for r in spatial.intersecting(edges, one).collect()} == {1, 3, 4, 6}
    assert {r.id for r in spatial.intersecting(edges, one, buffer=20.0).collect()} == {1, 2, 3, 4, 5, 6}
    with pytest.raises(ValueError):
        spatial.intersecting(edges, one, most_edges=2)
    got = {r.id: (r.area_m2, r.area_acres) for r in spatial.areas(edges).collect()}
    assert got[1] == (2 * 900.0, pytest.approx(1800 * 0.0002471054))


def test_slope_at_edges(spark):
    dem = spark.createDataFrame([(i, j, float(30 * j)) for i in range(4) for j in range(5) if (i, j) != (1, 2)], "row int, col int, z double")
    got = layers.slope_with_edges(dem).collect()
    assert len(got) == 19 and all(r.slope == pytest.approx(45) and r.aspect == pytest.approx(270) for r in got)
    assert [(r.slope, r.aspect) for r in layers.slope_with_edges(dem.limit(1)).collect()] == [(0.0, -1.0)]


def test_paths_and_years(spark, tmp_path):
    assert tables.paired([2001, 2000], ["b/x_2001.tif", "a/y_2000.tif"]) == [(2000, "a/y_2000.tif"), (2001, "b/x_2001.tif")]
    for paths in (["a_2000"], ["a_2000", "b_2000"], ["a_2000", "none"], ["a_2000", "b_2001", "c_2002"]):
        with pytest.raises(ValueError):
            tables.paired([2000, 2001], paths)
    spark.range(3).write.parquet(str(tmp_path / "x_2003.parquet"))
    with pytest.raises(FileNotFoundError):
        tables.read_yearly(spark, str(tmp_path / "x_2003.parquet"), 2500)
    assert tables.described(spark.range(1), "id", "a count").schema["id"].metadata == {"comment": "a count"}


def test_flags_and_checks(spark, tmp_path):
    rows = spark.createDataFrame([(1, 5), (2, None), (3, -1)], "id int, v int")
    assert [r[0] for r in rows.orderBy("id").select(codes.flag(F.col("v"))).collect()] == [1, 0, 0]
    assert rows.filter(prepare.differs(F.col("v"), 5)).count() == 2
    with pytest.raises(ValueError):
        recurrence.survival(rows, extra=["bs"])
    frame, seen = prepare.counted(rows, "rows")
    frame.collect()
    assert seen.get == {"rows": 3}
    assert prepare.tidy(rows, keep=["v"], rename={"v": "w"}).columns == ["w"]


def test_extract_writes(spark, tmp_path):
    box = spark.createDataFrame(ring(7, (0, 0), (4, 0), (4, 4), (0, 4)), EDGES)
    cells = spark.createDataFrame([(i * 6 + j, i, j) for i in range(6) for j in range(6)], "geohash int, row int, col int")
    events = spark.createDataFrame([(7, "2000-01-01", "A")], "perimeter int, date string, event string")
    layer = cells.select("geohash", F.when(F.col("geohash") != 0, F.col("row")).alias("value"))
    path = str(tmp_path / "frame")
    _, seen = extract.extract(cells, extract.Zones(box, box, box, box), events, {"a": layer}, path + "2")
    assert [o.get["rows"] for o in seen.values()] == [16, 16, 16, 15]
    assert spark.read.parquet(path + "2").count() == 15
