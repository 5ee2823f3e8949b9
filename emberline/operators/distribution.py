"""Binned, weighted and cumulative distributions of gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.codes import WINDOW_YEARS, truncation_weight


def unit_bin(value: Column, bins: int) -> Column:
    """Bin 0 .. bins - 1 of unit width; the last includes its right edge; outside: null."""
    return F.when(value.between(0, bins), F.least(F.floor(value), F.lit(bins - 1))).cast("int")


def histogram(gaps: DataFrame, bins: int, by: tuple[str, ...] = (), weighted: bool = False) -> DataFrame:
    """Counts (or sums of truncation weights) of dt per unit bin and category.

    The weight has a pole at the window's end; gaps there are left out of a weighted histogram.
    """
    binned = gaps.withColumn("bin", unit_bin(F.col("dt"), bins)).filter("bin IS NOT NULL")
    if weighted:
        binned = binned.filter(F.floor("dt") < WINDOW_YEARS)
    value = F.sum(truncation_weight(F.col("dt"))).alias("weight") if weighted else F.count("*").alias("n")
    return binned.groupBy(*by, "bin").agg(value)


def ecdf(gaps: DataFrame, by: str) -> DataFrame:
    """Cumulative count of each value of dt within its category."""
    counts = gaps.groupBy(by, "dt").agg(F.count("*").alias("n"))
    w = W.partitionBy(by).orderBy("dt").rowsBetween(W.unboundedPreceding, 0)
    return counts.select(by, "dt", F.sum("n").over(w).alias("cum"))


def summary(gaps: DataFrame, spans: DataFrame, totals: DataFrame, by: str) -> DataFrame:
    """Per configuration: gap and survival weights and rows, total, empty and its fraction (not clamped)."""
    g = gaps.groupBy(by).agg(F.sum("Pixel_Count").alias("dt_pixels"), F.count("*").alias("dt_polygons"))
    s = spans.groupBy(by).agg(F.sum("Pixel_Count").alias("st_pixels"), F.count("*").alias("st_polygons"))
    out = totals.join(g, by, "left").join(s, by, "left").na.fill(0, ["dt_pixels", "dt_polygons", "st_pixels", "st_polygons"])
    empty = F.col("total_pixels") - F.col("st_pixels")
    return out.select(by, "dt_pixels", "dt_polygons", "st_pixels", "st_polygons", "total_pixels", empty.alias("empty_pixels"), (empty / F.col("total_pixels")).alias("pc_empty"))
