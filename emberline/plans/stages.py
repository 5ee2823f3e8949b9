"""Queries of selecting, preparing, clipping and extracting, each with the SQL of its rows.

Stand-ins: boxes of suppliers are polygons, customers are cells of a grid, orders events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codes, grid
from ..operators import distribution as dist
from ..operators import layers, prepare, recurrence, spatial
from . import extract
from .registry import ALL_BOXES, CELLS, LONLAT, O, PAIRS, _box_edges, _cells, _gaps, _spread, grid_lonlat, table


def columns_tidy(spark, d):
    s = prepare.tidy(table(spark, d, "supplier"), drop=["s_acctbal"], rename=lambda c: c[2:])
    return s.select((F.col("suppkey") - 1).alias("suppkey"), "name", F.col("nationkey").cast("tinyint").alias("nationkey"))


def _segments(spark, d):
    c = table(spark, d, "customer")
    return c.withColumn("segment", F.when(F.col("c_custkey") % 7 != 0, F.col("c_mktsegment")))


def filters_null_kept(spark, d):
    c = _segments(spark, d).filter(prepare.differs(F.col("segment"), "BUILDING") & ~F.col("c_nationkey").isin(3, 4))
    return c.filter(F.col("c_nationkey").cast("string").cast("int") < 20).select("c_custkey", "segment")


def filter_constant(spark, d):
    return table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select("c_custkey")


def filter_year(spark, d):
    return table(spark, d, "orders").filter(F.year("o_orderdate") == 1997).select("o_orderkey")


def sorted_orders(spark, d):
    return table(spark, d, "orders").orderBy(F.col("o_custkey").asc_nulls_first(), F.col("o_orderdate").asc_nulls_first(), "o_orderkey").select("o_custkey", "o_orderdate", "o_orderkey")


def polygon_area(spark, d):
    out = spatial.areas(_box_edges(_spread(spark, d)[0]))
    return out.select("id", "area_m2", F.round("area_acres", 6).alias("area_acres"))


def _area(edges: DataFrame) -> DataFrame:
    return edges.filter("id = 1").drop("id")


def aoi_intersects(spark, d):
    edges = _box_edges(_spread(spark, d)[0])
    return spatial.intersecting(edges, _area(edges))


def aoi_buffered(spark, d):
    edges = _box_edges(_spread(spark, d)[0])
    return spatial.intersecting(edges, _area(edges), buffer=12.0)


def clip_box(spark, d):
    return spatial.clip_box(_spread(spark, d)[1], 5, 3, 30, 41).select("pid")


def clip_polygons(spark, d):
    boxes, points = _spread(spark, d)
    return spatial.clip(points, spatial.scanline_runs(_box_edges(boxes))).select("pid")


def zone_counts(spark, d):
    """Dissolve polygons by zone, clip cells to them, count values."""
    boxes, points = _spread(spark, d)
    runs = spatial.scanline_runs(_box_edges(boxes)).join(table(spark, d, "supplier").select(F.col("s_suppkey").cast("int").alias("id"), F.col("s_nationkey").alias("zone")), "id")
    cells = spatial.dissolve(runs, "zone").join(points, ["row", "col"])
    cells = cells.join(table(spark, d, "customer").select(F.col("c_custkey").alias("pid"), F.col("c_mktsegment").alias("value")), "pid")
    return layers.zonal_counts(cells, "zone", "value").orderBy("zone", "value")


def bars_by_zone_and_severity(spark, d):
    return dist.histogram(_gaps(spark, d).filter("eco1 <> 4"), 38, by=("eco1", "bs_1", "bs_2"))


def distinct_zones(spark, d):
    return prepare.distinct_sorted(_gaps(spark, d), "eco1", "bs_1")


def state_rollups(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    states = c.groupBy(F.col("n_nationkey").alias("geoid"), F.col("n_name").alias("name"), "n_regionkey").agg(F.count("*").alias("land"), F.sum("c_custkey").alias("water"))
    west = prepare.rolled_up(states, F.col("n_regionkey").isin(1, 2), ["land", "water"], {"geoid": 90, "name": "WEST", "code": "--"})
    whole = prepare.rolled_up(states, None, ["land", "water"], {"geoid": 99, "name": "ALL", "code": "--"})
    return states.select("geoid", "name", F.lit("S").alias("code"), "land", "water").unionByName(west).unionByName(whole)


def rollup_cells(spark, d):
    """Cells of the union of several polygons, overlaps once."""
    boxes, _ = _spread(spark, d)
    runs = spatial.scanline_runs(_box_edges(boxes)).withColumn("part", F.col("id") % 3)
    return spatial.dissolve(runs, "part").groupBy("part").agg(F.count("*").alias("cells"))


def survival_resume(spark, d):
    """Days since the last event in 1998 and, from that year's maximum on, in 2000."""
    cells = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.lit(None).cast("int").alias("dse"))
    orders = table(spark, d, "orders")
    early, first = layers.survival_onwards(cells, orders.filter(F.year("o_orderdate") < 1998), "o_custkey", "o_orderdate", 1995, 1998)
    _, second = layers.survival_onwards(early, orders.filter(F.year("o_orderdate") >= 1998), "o_custkey", "o_orderdate", 1995, 2000)
    return first.withColumnRenamed("st", "st_1998").join(second.withColumnRenamed("st", "st_2000"), "o_custkey")


def flag_null(spark, d):
    value = F.when(F.col("s_suppkey") % 3 != 0, F.col("s_acctbal"))
    return table(spark, d, "supplier").select("s_suppkey", codes.flag(value).cast("int").alias("flag"))


def epoch_days(spark, d):
    dse = codes.days_since_epoch(F.col("o_orderdate"))
    return table(spark, d, "orders").select("o_orderkey", dse.alias("dse"), F.date_from_unix_date(dse).cast("string").alias("day"))


def cell_geometry(spark, d):
    return _cells(spark, d).select("c_custkey", grid.geometry_of(F.col("cell")).alias("g")).select("c_custkey", "g.x", "g.y")


def resample_nearest(spark, d):
    """Cells take the nearest value of a grid of ten degrees."""
    n = spark.range(18 * 36).select(F.floor(F.col("id") / 36).alias("row"), (F.col("id") % 36).alias("col"), (F.col("id") * 7 % 100).alias("value"))
    out = layers.resample(grid_lonlat(spark, d), n, F.floor((90 - F.col("lat")) / 10), F.floor((F.col("lon") + 180) / 10))
    return out.select("cell", "value")


def proximity_capped(spark, d):
    points = _spread(spark, d)[1]
    return layers.proximity(points.select("row", "col").distinct(), points.filter("pid % 50 = 0").select("row", "col").distinct(), cap=300.0)


def _bands(spark, d, across: int, along: int, vertical: bool):
    """Rectangles ``along`` wide, one every ``across`` cells, over the whole grid."""
    side = table(spark, d, "supplier").agg((F.ceil(F.sqrt(F.lit(22.5) * F.count("*"))).cast("int") + 10).alias("side"))
    at = side.select("side", F.explode(F.sequence(F.lit(0), F.floor(F.col("side") / across).cast("int"))).alias("id"))
    a, w = F.col("id") * across, F.lit(along)
    box = (a, F.lit(0), w, F.col("side")) if vertical else (F.lit(0), a, F.col("side"), w)
    return _box_edges(at.select("id", *[c.cast("int").alias(n) for c, n in zip(box, ("x0", "y0", "w", "h"), strict=True)]))


#: Twelve layers; the values of every third are null for some cells.
LAYERS = {f"layer{k}": k for k in range(1, 13)}


def _extract(spark, d):
    boxes, points = _spread(spark, d)
    cells = points.withColumnRenamed("pid", "geohash")
    hexagons = _bands(spark, d, 9, 9, True)
    zones = extract.Zones(_box_edges(boxes), _bands(spark, d, 10, 9, False), _bands(spark, d, 10, 8, True), hexagons)
    events = table(spark, d, "supplier").select(F.col("s_suppkey").cast("int").alias("perimeter"), (F.col("s_suppkey") % 5).alias("date"), F.col("s_suppkey").alias("event"))
    key = F.col("c_custkey")
    attributes = {}
    for name, k in LAYERS.items():
        value = (key * (k + 2)) % 17
        value = F.when(value != 0, value) if k % 3 == 0 else value
        attributes[name] = table(spark, d, "customer").select(key.alias("geohash"), value.alias("value"))
    return extract.extract(cells, zones, events, attributes)


def extract_frame(spark, d):
    return _extract(spark, d)[0].select("geohash", "perimeter", "state", "eco", "hexagon", "date", *LAYERS)


def extract_stage_rows(spark, d):
    """Rows after each stage, observed while the frame is counted."""
    frame, seen = _extract(spark, d)
    frame.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(name, o.get["rows"]) for name, o in seen.items()], "stage string, n long")


def _yearly_events(spark, d):
    """Every order of every status and priority, the last of a customer's year."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.date_trunc("year", F.col("o_orderdate").cast("timestamp")).cast("timestamp_ntz").alias("o_orderdate"), "o_orderstatus")
    return recurrence.keep_last(o, O).withColumn("perim_index", F.year("o_orderdate"))


def _status_histories(spark, d, max_date=None):
    return recurrence.event_histories(_yearly_events(spark, d), max_date, varied=["o_orderstatus"], names=O)


UNTIL = "1999-01-01 00:00:00"


def gaps_by_status(spark, d):
    h = recurrence.history_gaps(_status_histories(spark, d), {"o_orderstatus": ["F", "P"]}, O)
    return h.groupBy("o_orderstatus", "dt").agg(F.sum("Pixel_Count").alias("n"))


def starts_by_status(spark, d):
    h = recurrence.history_starts(_status_histories(spark, d), filters={"o_orderstatus": ["O"]}, names=O)
    return h.groupBy(F.round("ut", 9).alias("ut")).agg(F.sum("Pixel_Count").alias("n"))


def ends_by_status(spark, d):
    h = recurrence.history_ends(_status_histories(spark, d), filters={"o_orderstatus": ["F"]}, names=O)
    return h.groupBy(F.round("ct", 9).alias("ct")).agg(F.sum("Pixel_Count").alias("n"))


def histories_until(spark, d):
    h = _status_histories(spark, d, F.lit(UNTIL).cast("timestamp_ntz"))
    return h.groupBy(F.col("# Fires").alias("fires")).agg(F.sum("Pixel_Count").alias("n"), F.count("*").alias("histories"))


BOX_DISTANCE = "greatest(b.x0 - a.x0 - a.w, a.x0 - b.x0 - b.w, 0) ** 2 + greatest(b.y0 - a.y0 - a.h, a.y0 - b.y0 - b.h, 0) ** 2"
EXTRACT = (
    ALL_BOXES
    + """,
z AS (SELECT p.pid AS geohash, cells.id AS perimeter, p."row" // 10 AS state, p.col // 9 AS hexagon,
  CASE WHEN p.col % 10 = 9 AND (p.col // 10 + 1) * 10 <= side + 10 THEN p.col // 10 + 1 ELSE p.col // 10 END AS eco
  FROM p JOIN cells ON cells."row" = p."row" AND cells.col = p.col, k WHERE p."row" % 10 < 9),
l AS (SELECT * FROM (SELECT *, perimeter % 5 AS date, row_number() OVER (PARTITION BY geohash, perimeter % 5 ORDER BY perimeter DESC) AS k FROM z) WHERE k = 1)"""
)
_VALUES = ", ".join(f"CAST(geohash * {k + 2} % 17 AS BIGINT) AS {name}" for name, k in LAYERS.items())
_THERE = " AND ".join(f"geohash * {k + 2} % 17 <> 0" for k in LAYERS.values() if k % 3 == 0)
STATUS = """y AS (SELECT o_custkey, date_trunc('year', o_orderdate)::TIMESTAMP AS dt0, o_orderstatus AS s, o_orderkey FROM orders),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, dt0 ORDER BY o_orderkey DESC) AS k FROM y) WHERE k = 1)"""

SQL = {
    "columns_tidy": "SELECT s_suppkey - 1 AS suppkey, s_name AS name, CAST(s_nationkey AS TINYINT) AS nationkey FROM supplier",
    "filters_null_kept": "SELECT c_custkey, segment FROM (SELECT *, CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment END AS segment FROM customer) WHERE segment IS DISTINCT FROM 'BUILDING' AND c_nationkey NOT IN (3, 4) AND c_nationkey < 20",
    "filter_constant": "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'",
    "filter_year": "SELECT o_orderkey FROM orders WHERE year(o_orderdate) = 1997",
    "sorted_orders": "SELECT o_custkey, o_orderdate, o_orderkey FROM orders ORDER BY 1 NULLS FIRST, 2 NULLS FIRST, 3",
    "polygon_area": f"WITH {ALL_BOXES} SELECT id, CAST(w * h * 900 AS DOUBLE) AS area_m2, round(w * h * 900 * 0.0002471054::DOUBLE, 6) AS area_acres FROM b",
    "aoi_intersects": f"WITH {ALL_BOXES} SELECT b.id FROM b, b a WHERE a.id = 1 AND {BOX_DISTANCE} <= 0",
    "aoi_buffered": f"WITH {ALL_BOXES} SELECT b.id FROM b, b a WHERE a.id = 1 AND {BOX_DISTANCE} <= 144",
    "clip_box": f'WITH {ALL_BOXES} SELECT pid FROM p WHERE "row" >= 5 AND "row" < 30 AND col >= 3 AND col < 41',
    "clip_polygons": f'WITH {ALL_BOXES} SELECT pid FROM p WHERE EXISTS (SELECT 1 FROM cells WHERE cells."row" = p."row" AND cells.col = p.col)',
    "zone_counts": f'WITH {ALL_BOXES}, z AS (SELECT DISTINCT s_nationkey AS zone, "row", col FROM cells JOIN supplier ON s_suppkey = id) SELECT zone, c_mktsegment AS value, count(*) AS "count" FROM z JOIN p ON p."row" = z."row" AND p.col = z.col JOIN customer ON c_custkey = pid GROUP BY 1, 2',
    "bars_by_zone_and_severity": f"{PAIRS} SELECT eco1, bs_1, bs_2, CAST(least(floor(days / 365.0::DOUBLE), 37) AS INT) AS bin, count(*) AS n FROM p WHERE eco1 <> 4 AND days / 365.0::DOUBLE BETWEEN 0 AND 38 GROUP BY ALL",
    "distinct_zones": f"{PAIRS} SELECT DISTINCT eco1, bs_1 FROM p WHERE days IS NOT NULL",
    "state_rollups": """WITH s AS (SELECT n_nationkey AS geoid, n_name AS name, n_regionkey, count(*) AS land, CAST(sum(c_custkey) AS BIGINT) AS water FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL)
SELECT geoid, name, 'S' AS code, land, water FROM s UNION ALL SELECT 90, 'WEST', '--', CAST(sum(land) AS BIGINT), CAST(sum(water) AS BIGINT) FROM s WHERE n_regionkey IN (1, 2) UNION ALL SELECT 99, 'ALL', '--', CAST(sum(land) AS BIGINT), CAST(sum(water) AS BIGINT) FROM s""",
    "rollup_cells": f'WITH {ALL_BOXES} SELECT id % 3 AS part, count(DISTINCT ("row", col)) AS cells FROM cells GROUP BY 1',
    "survival_resume": """WITH m AS (SELECT c_custkey AS o_custkey, max(o_orderdate) FILTER (year(o_orderdate) < 1998) AS a, max(o_orderdate) FILTER (year(o_orderdate) < 2000) AS b FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)
SELECT o_custkey, CAST(coalesce(date_diff('day', CAST(a AS DATE), DATE '1998-01-01'), 3 * 365) AS INT) AS st_1998, CAST(coalesce(date_diff('day', CAST(b AS DATE), DATE '2000-01-01'), 5 * 365) AS INT) AS st_2000 FROM m""",
    "flag_null": "SELECT s_suppkey, CASE WHEN s_suppkey % 3 <> 0 AND s_acctbal > 0 THEN 1 ELSE 0 END AS flag FROM supplier",
    "epoch_days": "SELECT o_orderkey, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS INT) AS dse, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM orders",
    "cell_geometry": f"WITH {CELLS} SELECT c_custkey, x, y FROM g",
    "resample_nearest": f"SELECT cell, CAST((floor((90 - lat) / 10) * 36 + floor((lon + 180) / 10)) * 7 % 100 AS BIGINT) AS value FROM ({LONLAT})",
    "proximity_capped": f"""WITH {ALL_BOXES}, c AS (SELECT DISTINCT "row", col FROM p), t AS (SELECT DISTINCT "row", col FROM p WHERE pid % 50 = 0)
SELECT c."row", c.col, CAST(floor(least(300, min(sqrt((c."row" - t."row") ** 2 + (c.col - t.col) ** 2) * 30))) AS INT) AS proximity FROM c, t GROUP BY 1, 2""",
    "extract_frame": f"WITH {EXTRACT} SELECT geohash, perimeter, CAST(state AS INT) AS state, CAST(eco AS INT) AS eco, CAST(hexagon AS INT) AS hexagon, CAST(date AS BIGINT) AS date, {_VALUES} FROM l WHERE {_THERE}",
    "extract_stage_rows": f"WITH {EXTRACT} SELECT 'zones' AS stage, count(*) AS n FROM z UNION ALL SELECT 'events', count(*) FROM z UNION ALL SELECT 'last of a day', count(*) FROM l UNION ALL SELECT 'layers', count(*) FROM l WHERE {_THERE}",
    "gaps_by_status": f"WITH {STATUS}, g AS (SELECT s, date_sub('day', lag(dt0) OVER (PARTITION BY o_custkey ORDER BY dt0), dt0) / 365.0::DOUBLE AS dt FROM f) SELECT s AS o_orderstatus, dt, count(*) AS n FROM g WHERE s IN ('F', 'P') AND dt > 0.25 GROUP BY 1, 2",
    "starts_by_status": f"WITH {STATUS}, h AS (SELECT o_custkey, min(dt0) AS a, arg_min(s, dt0) AS s FROM f GROUP BY 1) SELECT round(date_sub('day', (SELECT min(dt0) FROM f), a) / 365.0::DOUBLE, 9) AS ut, count(*) AS n FROM h WHERE s = 'O' GROUP BY 1",
    "ends_by_status": f"WITH {STATUS}, h AS (SELECT o_custkey, max(dt0) AS a, arg_max(s, dt0) AS s FROM f GROUP BY 1) SELECT round(date_sub('day', a, (SELECT max(dt0) FROM f)) / 365.0::DOUBLE, 9) AS ct, count(*) AS n FROM h WHERE s = 'F' GROUP BY 1",
    "histories_until": f"WITH {STATUS}, h AS (SELECT o_custkey, list(dt0 ORDER BY dt0) AS dates, list(s ORDER BY dt0) AS states FROM f WHERE dt0 <= TIMESTAMP '{UNTIL}' GROUP BY 1), c AS (SELECT dates, states, count(*) AS w FROM h GROUP BY ALL) SELECT CAST(len(dates) AS BIGINT) AS fires, CAST(sum(w) AS BIGINT) AS n, count(*) AS histories FROM c GROUP BY 1",
}

QUERIES = {name: globals()[name] for name in SQL}
