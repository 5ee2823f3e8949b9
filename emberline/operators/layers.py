"""Attribute layers joined to the fact table by cell and year, and grid aggregates."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.codes import survival_days
from .spatial import near_buckets


def attach(points: DataFrame, layer: DataFrame, name: str, on: str | list[str] = "geohash", how: str = "inner") -> DataFrame:
    """Join one layer (unique by ``on``, value column ``value``); its null cells are dropped first."""
    return points.join(layer.filter(F.col("value").isNotNull()).withColumnRenamed("value", name), on, how)


def attach_all(points: DataFrame, layers: dict[str, DataFrame], on: str = "geohash") -> DataFrame:
    """Inner joins of several layers: a cell that misses in any of them is dropped."""
    return reduce(lambda df, item: attach(df, item[1], item[0], on), layers.items(), points)


def mask(df: DataFrame, by: DataFrame, on: str = "geohash") -> DataFrame:
    return df.join(by.select(on).distinct(), on, "left_semi")


def orphans(df: DataFrame, matched: DataFrame, on: str = "geohash") -> DataFrame:
    return df.join(matched.select(on), on, "left_anti")


def require_years(layer: DataFrame, years: list[int], column: str = "year") -> None:
    """An inner join with an absent layer year would drop rows silently; raise instead."""
    found = {r[0] for r in layer.filter(F.col(column).isin(years)).select(column).distinct().collect()}
    if missing := sorted(set(years) - found):
        raise ValueError(f"no layer for years {missing}")


def backfill_year(layer: DataFrame, source: int = 1985, target: int = 1984) -> DataFrame:
    return layer.unionByName(layer.filter(F.col("year") == source).withColumn("year", F.lit(target).cast(layer.schema["year"].dataType)))


def join_layer_to_frame(frame: DataFrame, layer: DataFrame, valid: DataFrame, name: str) -> DataFrame:
    """Add a layer to a built frame: only its cells that are valid in another layer."""
    return attach(frame, mask(layer, valid), name)


def union_years(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def zonal_counts(cells: DataFrame, zone: str, value: str) -> DataFrame:
    return cells.filter(F.col(value).isNotNull()).groupBy(zone, value).agg(F.count("*").alias("count"))


def cell_mode(cells: DataFrame, key: str, value: str) -> DataFrame:
    """Most frequent value per cell; of equally frequent ones the least."""
    counts = cells.groupBy(key, value).agg(F.count("*").alias("n"))
    return counts.groupBy(key).agg(F.max_by(value, F.struct("n", -F.col(value))).alias("mode"))


def latest(previous: DataFrame | None, new: DataFrame, key: str, value: str) -> DataFrame:
    """Maximum per cell, from last year's maximum and new rows."""
    rows = new if previous is None else previous.unionByName(new)
    return rows.groupBy(key).agg(F.max(value).alias(value))


def survival_grid(cells: DataFrame, events: DataFrame, key: str, date: str, start: int, end: int) -> DataFrame:
    """Days since the last event on 1 January of ``end``, for every cell."""
    last = events.filter(F.year(date).between(start, end - 1)).groupBy(key).agg(F.max(F.to_date(date)).alias("_last"))
    return cells.join(last, key, "left").select(key, survival_days(F.col("_last"), start, end).alias("st"))


def drop_last_files(paths: DataFrame, column: str = "path", n: int = 2) -> DataFrame:
    w = W.orderBy(F.col(column).desc())
    return paths.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") > n).drop("_n")


def year_of_path(path: Column) -> Column:
    return F.regexp_extract(path, r"(\d{4})", 1).try_cast("int")


def eco_of_path(path: Column) -> Column:
    return F.regexp_extract(path, r"(\d{5})\.[a-z]+$", 1).try_cast("int")


def dominant_slope(dem: DataFrame, cell: float = 30.0) -> DataFrame:
    """Slope (degrees) and aspect (degrees from north, flat -1) of row, col, z by Horn's formula; full neighbourhoods only."""
    near = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    spread = dem.select(F.explode(F.array(*near)).alias("o"), "row", "col", "z").select((F.col("row") + F.col("o.i")).alias("row"), (F.col("col") + F.col("o.j")).alias("col"), (-F.col("o.i")).alias("i"), (-F.col("o.j")).alias("j"), "z")
    weight = F.when((F.col("i") == 0) | (F.col("j") == 0), 2).otherwise(1)
    sums = spread.groupBy("row", "col").agg(F.count("*").alias("n"), (F.sum(F.col("j") * weight * F.col("z")) / (8 * cell)).alias("dx"), (F.sum(F.col("i") * weight * F.col("z")) / (8 * cell)).alias("dy"), F.max(((F.col("i") == 0) & (F.col("j") == 0)).cast("int")).alias("own"))
    full = sums.filter("n = 9 AND own = 1")
    return full.select("row", "col", *_slope_aspect())


def proximity(cells: DataFrame, targets: DataFrame, cap: float = 70_000.0, cell: float = 30.0, bucket: int = 32) -> DataFrame:
    """Distance in metres from each cell (row, col) to the nearest target, at most ``cap``.

    Cells meet only the targets in the buckets that can hold the nearest one.
    """

    def dealt(df: DataFrame) -> DataFrame:
        return df.select("row", "col", F.floor(F.col("row") / bucket).cast("int").alias("br"), F.floor(F.col("col") / bucket).cast("int").alias("bc"))

    c, t = dealt(cells), dealt(targets)
    levels = max(1, math.ceil(math.log2(cap / (cell * bucket))) + 1)
    t = t.select(F.col("row").alias("tr"), F.col("col").alias("tc"), F.col("br").alias("nr"), F.col("bc").alias("nc"))
    dr, dc = F.col("row") - F.col("tr"), F.col("col") - F.col("tc")
    near = near_buckets(c, t.select(F.col("nr").alias("br"), F.col("nc").alias("bc")), levels)
    found = c.join(near, ["br", "bc"]).join(t, ["nr", "nc"]).groupBy("row", "col").agg(F.min(dr * dr + dc * dc).alias("d2"))
    return cells.join(found, ["row", "col"], "left").select("row", "col", F.least(F.lit(cap), F.coalesce(F.sqrt("d2") * cell, F.lit(cap))).cast("int").alias("proximity"))


def slope_with_edges(dem: DataFrame, cell: float = 30.0) -> DataFrame:
    """``dominant_slope`` of every cell: a missing neighbour is carried on from the two cells beside it, or is the cell itself."""
    steps = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    near = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in steps])
    spread = dem.select(F.explode(near).alias("o"), (F.col("row") - F.col("o.i")).alias("row"), (F.col("col") - F.col("o.j")).alias("col"), "z")
    z = {(i, j): F.max(F.when((F.col("o.i") == i) & (F.col("o.j") == j), F.col("z"))).alias(f"z{i + 1}{j + 1}") for i, j in steps}
    wide = spread.groupBy("row", "col").agg(*z.values()).filter("z11 IS NOT NULL")

    def at(i: int, j: int) -> Column:
        return F.col(f"z{i + 1}{j + 1}")

    filled = {}
    for i, j in sorted(steps, key=lambda s: abs(s[0]) + abs(s[1])):
        tries = [at(i, j)]
        if i:
            tries.append(at(0, j) * 2 - at(-i, j))
        if j:
            tries.append(at(i, 0) * 2 - at(i, -j))
        # a corner without any of these lies on the plane of the two sides
        filled[i, j] = F.coalesce(*tries, filled[i, 0] + filled[0, j] - at(0, 0) if i and j else at(0, 0))
    weight = {(i, j): 1 if i and j else 2 for i, j in steps}
    dx = sum((filled[i, j] * (j * weight[i, j]) for i, j in steps if j), F.lit(0.0)) / (8 * cell)
    dy = sum((filled[i, j] * (i * weight[i, j]) for i, j in steps if i), F.lit(0.0)) / (8 * cell)
    return wide.select("row", "col", dx.alias("dx"), dy.alias("dy")).select("row", "col", *_slope_aspect())


def _slope_aspect() -> list[Column]:
    slope = F.degrees(F.atan(F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))))
    turn = F.degrees(F.atan2(F.col("dy"), -F.col("dx")))
    aspect = F.when((F.col("dx") == 0) & (F.col("dy") == 0), -1.0).when(turn > 90, 450.0 - turn).otherwise(90.0 - turn)
    return [slope.alias("slope"), aspect.alias("aspect")]


def resample(cells: DataFrame, source: DataFrame, row: Column, col: Column) -> DataFrame:
    """Nearest value of a source grid (row, col, value) for each cell; ``row`` and ``col`` are the source's, from the cell's centre."""
    at = cells.withColumn("_row", row.cast("long")).withColumn("_col", col.cast("long"))
    s = source.select(F.col("row").cast("long").alias("_row"), F.col("col").cast("long").alias("_col"), "value")
    return at.join(s, ["_row", "_col"]).drop("_row", "_col")


def survival_onwards(previous: DataFrame, events: DataFrame, key: str, date: str, start: int, end: int) -> tuple[DataFrame, DataFrame]:
    """(key, dse) of the last events before ``end`` and (key, st) on its 1 January, from the last ones of an earlier year.

    ``previous`` has every cell, with null dse where nothing has happened since ``start``.
    """
    new = events.filter(F.year(date) < end).select(key, F.unix_date(F.to_date(date)).alias("dse"))
    now = latest(previous, new, key, "dse")
    return now, now.select(key, survival_days(F.date_from_unix_date("dse"), start, end).alias("st"))
