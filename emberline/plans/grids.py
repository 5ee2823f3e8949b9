"""Queries of tiles, terrain, files of layers and written tables, each with the SQL of its rows.

Stand-ins: customers are cells of a grid, orders rows of yearly files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import grid
from ..operators import layers
from ..sources.tables import missing_years, read_tables, scratch, tile_points, write_frame
from .registry import CELLS, _cells, table

#: Customers in a row of the terrain, and the one in how many that is a void.
ACROSS, VOID = 40, 97


def tile_cells(spark, d):
    """Tiles of ten by ten values, with voids, as cells."""
    c = table(spark, d, "customer").select(F.expr("CAST(c_custkey div 100 AS INT)").alias("tile"), F.struct("c_custkey", F.nullif("c_nationkey", F.lit(3)).alias("value")).alias("at"))
    tiles = c.groupBy("tile").agg(F.transform(F.array_sort(F.collect_list("at")), lambda x: x["value"]).alias("values"))
    return tile_points(tiles.select((F.col("tile") * 10).alias("row0"), F.lit(0).alias("col0"), F.lit(10).alias("width"), "values"))


def _terrain(spark, d) -> DataFrame:
    c = table(spark, d, "customer").filter(F.col("c_custkey") % VOID != 0)
    c = c.select(F.expr(f"CAST(c_custkey div {ACROSS} AS INT)").alias("row"), (F.col("c_custkey") % ACROSS).cast("int").alias("col"))
    return c.withColumn("z", (F.col("row") * F.col("row") * 3 + F.col("col") * 7 + F.col("row") * F.col("col") % 11).cast("double"))


def slope_full(spark, d):
    return layers.dominant_slope(_terrain(spark, d)).select("row", "col", F.round("slope", 6).alias("slope"), F.round("aspect", 6).alias("aspect"))


def slope_edges(spark, d):
    return layers.slope_with_edges(_terrain(spark, d)).select("row", "col", F.round("slope", 6).alias("slope"), F.round("aspect", 6).alias("aspect"))


def layer_files(spark, d):
    """Files but the last two, with the year and the code in their names."""
    name = F.concat(F.lit("eco_"), (1990 + F.col("c_custkey") % 30).cast("string"), F.lit("_c"), F.col("c_custkey").cast("string"), F.lit("_"), (10000 + F.col("c_nationkey")).cast("string"), F.lit(".tif"))
    paths = layers.drop_last_files(table(spark, d, "customer").select(name.alias("path")))
    return paths.select("path", layers.year_of_path(F.col("path")).alias("year"), layers.eco_of_path(F.col("path")).alias("eco"))


def backfilled_years(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"))
    return layers.backfill_year(o, 1995, 1994).groupBy("year").agg(F.count("*").alias("n"))


def layer_to_frame(spark, d):
    """Values of a layer for a frame's cells that another layer holds."""
    frame = table(spark, d, "documents").select(F.col("doc_id").alias("geohash"), "lang")
    labels = table(spark, d, "labels").withColumnRenamed("doc_id", "geohash")
    valid = labels.filter("toxic = 0").select("geohash")
    return layers.join_layer_to_frame(frame, labels.select("geohash", F.col("quality").alias("value")), valid, "quality").select("geohash", "lang", "quality")


def albers_there_and_back(spark, d):
    """Cell centres to the centimetre; the series for the latitude leaves up to a millimetre."""
    c = _cells(spark, d)
    x, y = grid.from_lonlat(*grid.to_lonlat(grid.centre_x(F.col("cell")), grid.centre_y(F.col("cell"))))
    return c.select("c_custkey", F.round(x, 2).alias("x"), F.round(y, 2).alias("y"), grid.cell_of(x, y).alias("cell"))


def _written(spark, d) -> str:
    """Orders in a table by year, of which two years are then written anew with finished orders alone."""
    path = scratch(spark, "orders-by-year")
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.year("o_orderdate").alias("year")).repartition("year")
    write_frame(o, path, by="year")
    write_frame(o.filter("year IN (1997, 1998) AND o_orderstatus = 'F'"), path, "overwrite", by="year")
    return path


def years_written_anew(spark, d):
    return spark.read.parquet(_written(spark, d)).groupBy("year", "o_orderstatus").agg(F.count("*").alias("n"))


def years_read_together(spark, d):
    path = _written(spark, d)
    return read_tables(spark, [f"{path}/year={y}" for y in (1996, 1997)], {"o_orderkey": "event"}, "*.parquet").select("event", "o_orderstatus")


def years_to_write(spark, d):
    """Years of 1990 to 2010 that the table has no partition of."""
    left = missing_years(spark, _written(spark, d), list(range(1990, 2011)))
    return spark.createDataFrame([(y,) for y in left], "year int")


_STEPS = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
_JOINS = " ".join(f'LEFT JOIN t n{i + 1}{j + 1} ON n{i + 1}{j + 1}."row" = a."row" + {i} AND n{i + 1}{j + 1}.col = a.col + {j}' for i, j in _STEPS)
TERRAIN = f"""WITH t AS (SELECT *, CAST("row" * "row" * 3 + col * 7 + "row" * col % 11 AS DOUBLE) AS z FROM (SELECT CAST(c_custkey // {ACROSS} AS INT) AS "row", CAST(c_custkey % {ACROSS} AS INT) AS col FROM customer WHERE c_custkey % {VOID} <> 0)),
n AS (SELECT a."row", a.col, {", ".join(f"n{i + 1}{j + 1}.z AS z{i + 1}{j + 1}" for i, j in _STEPS)} FROM t a {_JOINS})"""
HORN = """g AS (SELECT *, (f02 + 2 * f12 + f22 - f00 - 2 * f10 - f20) / 240 AS dx, (f20 + 2 * f21 + f22 - f00 - 2 * f01 - f02) / 240 AS dy FROM f),
h AS (SELECT *, degrees(atan2(dy, -dx)) AS turn FROM g)
SELECT "row", col, round(degrees(atan(sqrt(dx * dx + dy * dy))), 6) AS slope, round(CASE WHEN dx = 0 AND dy = 0 THEN -1 WHEN turn > 90 THEN 450 - turn ELSE 90 - turn END, 6) AS aspect FROM h"""

SQL = {
    "tile_cells": 'SELECT CAST(c_custkey // 100 * 10 + c_custkey % 100 // 10 AS INT) AS "row", CAST(c_custkey % 10 AS INT) AS col, c_nationkey AS value FROM customer WHERE c_nationkey <> 3',
    "slope_full": f"""{TERRAIN}, f AS (SELECT "row", col, {", ".join(f"z{k} AS f{k}" for k in ("00", "01", "02", "10", "11", "12", "20", "21", "22"))} FROM n
WHERE {" AND ".join(f"z{i + 1}{j + 1} IS NOT NULL" for i, j in _STEPS)}), {HORN}""",
    "slope_edges": f"""{TERRAIN}, s AS (SELECT *, coalesce(z01, 2 * z11 - z21, z11) AS f01, coalesce(z21, 2 * z11 - z01, z11) AS f21, coalesce(z10, 2 * z11 - z12, z11) AS f10, coalesce(z12, 2 * z11 - z10, z11) AS f12 FROM n),
f AS (SELECT *, coalesce(z00, 2 * z10 - z20, 2 * z01 - z02, f01 + f10 - z11) AS f00, coalesce(z02, 2 * z12 - z22, 2 * z01 - z00, f01 + f12 - z11) AS f02,
coalesce(z20, 2 * z10 - z00, 2 * z21 - z22, f21 + f10 - z11) AS f20, coalesce(z22, 2 * z12 - z02, 2 * z21 - z20, f21 + f12 - z11) AS f22 FROM s), {HORN}""",
    "layer_files": """WITH p AS (SELECT 'eco_' || (1990 + c_custkey % 30) || '_c' || c_custkey || '_' || (10000 + c_nationkey) || '.tif' AS path, CAST(1990 + c_custkey % 30 AS INT) AS year, CAST(10000 + c_nationkey AS INT) AS eco FROM customer)
SELECT path, year, eco FROM (SELECT *, row_number() OVER (ORDER BY path DESC) AS k FROM p) WHERE k > 2""",
    "backfilled_years": "WITH y AS (SELECT CAST(year(o_orderdate) AS INT) AS year FROM orders) SELECT year, count(*) AS n FROM (SELECT year FROM y UNION ALL SELECT 1994 FROM y WHERE year = 1995) GROUP BY 1",
    "layer_to_frame": "SELECT doc_id AS geohash, lang, quality FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND doc_id IN (SELECT doc_id FROM labels WHERE toxic = 0)",
    "albers_there_and_back": f"WITH {CELLS} SELECT c_custkey, x, y, cell FROM g",
    "years_written_anew": "SELECT CAST(year(o_orderdate) AS INT) AS year, o_orderstatus, count(*) AS n FROM orders WHERE year(o_orderdate) NOT IN (1997, 1998) OR o_orderstatus = 'F' GROUP BY 1, 2",
    "years_read_together": "SELECT o_orderkey AS event, o_orderstatus FROM orders WHERE year(o_orderdate) = 1996 OR year(o_orderdate) = 1997 AND o_orderstatus = 'F'",
    "years_to_write": "SELECT CAST(y AS INT) AS year FROM range(1990, 2011) r(y) WHERE y NOT IN (SELECT year(o_orderdate) FROM orders)",
}

QUERIES = {name: globals()[name] for name in SQL}
