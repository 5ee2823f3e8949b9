"""Reading and writing tables: partitioned, resumable, sized by rows."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS_PER_FILE = 1_200_000
ROOT_VARIABLE = "EMBERLINE_DATA"
FRAME = "events_{aoi}_{year}"
SHARED = "spark.checkpoint.dir"


def root() -> str:
    return os.environ.get(ROOT_VARIABLE, "data")


def frame_path(aoi: str, year: int | str) -> str:
    return f"{root()}/" + FRAME.format(aoi=aoi, year=year)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share; a local session (tests) that names none gets one."""
    folder = spark.conf.get(SHARED, None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {SHARED} to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="emberline-")
        spark.conf.set(SHARED, folder)
    return f"{folder.rstrip('/')}/emberline/{name}-{uuid.uuid4().hex}"


def read_tables(spark: SparkSession, paths: list[str], rename: dict[str, str] | None = None, pattern: str | None = None) -> DataFrame:
    """Several Parquet tables as one; ``pattern`` chooses files of directories."""
    reader = spark.read.option("mergeSchema", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.parquet(*paths).withColumnsRenamed(rename or {})


def read_yearly(spark: SparkSession, path: str, first: int) -> DataFrame:
    """Files named with a 4-digit year, with that year as a column, from ``first`` on."""
    df = spark.read.parquet(path).withColumn("year", F.regexp_extract(F.col("_metadata.file_name"), r"(\d{4})", 1).try_cast("int"))
    df = df.filter(F.col("year") >= first)
    if df.isEmpty():
        raise FileNotFoundError(f"no rows of {first} or later in {path}")
    return df


def paired(years: list[int], paths: list[str]) -> list[tuple[int, str]]:
    """Years with the paths that name them; each year must have exactly one."""
    named = {}
    for path in sorted(paths):
        found = re.search(r"(\d{4})", os.path.basename(path))
        if found is None or int(found.group(1)) in named:
            raise ValueError(f"{path} names no year or one that has a path already")
        named[int(found.group(1))] = path
    if sorted(named) != sorted(years):
        raise ValueError(f"paths are of {sorted(named)}, wanted {sorted(years)}")
    return [(y, named[y]) for y in sorted(years)]


def described(df: DataFrame, column: str, text: str) -> DataFrame:
    """``df`` with a comment on a column; only metadata changes."""
    return df.withColumn(column, F.col(column).alias(column, metadata={"comment": text}))


def tile_points(tiles: DataFrame) -> DataFrame:
    """Tiles (row0, col0, width, values[]) as cells (row, col, value), nulls dropped."""
    cells = tiles.select("row0", "col0", "width", F.posexplode("values").alias("k", "value")).filter("value IS NOT NULL")
    return cells.select((F.col("row0") + F.floor(F.col("k") / F.col("width"))).cast("int").alias("row"), (F.col("col0") + F.col("k") % F.col("width")).cast("int").alias("col"), "value")


def write_frame(df: DataFrame, path: str, mode: str = "errorifexists", by: str | None = None, single: bool = False) -> None:
    """mode: errorifexists, ignore (resume) or overwrite (with ``by``: only the partitions in ``df``)."""
    out = (df.coalesce(1) if single else df).write.mode(mode).option("maxRecordsPerFile", ROWS_PER_FILE).option("compression", "zstd")
    if by:
        out = out.partitionBy(by).option("partitionOverwriteMode", "dynamic")
    out.parquet(path)


def missing_years(spark: SparkSession, path: str, years: list[int]) -> list[int]:
    """Requested years without a partition yet."""
    try:
        done = {r[0] for r in spark.read.parquet(path).select("year").distinct().collect()}
    except Exception as error:  # no table yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
        done = set()
    return [y for y in years if y not in done]
