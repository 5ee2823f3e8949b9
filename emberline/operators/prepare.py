"""Selecting, renaming and rolling up tables, and counting rows along the way."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def tidy(df: DataFrame, keep: Sequence[str] | None = None, drop: Sequence[str] = (), rename: Callable[[str], str] | dict | None = None) -> DataFrame:
    """Keep or drop columns, then rename them by a function or a map."""
    df = df.select(*keep) if keep is not None else df
    df = df.drop(*drop)
    names = rename if isinstance(rename, dict) else {c: rename(c) for c in df.columns} if rename else {}
    return df.withColumnsRenamed(names)


def differs(column: Column, value) -> Column:
    """Not equal, where null differs from every value."""
    return ~column.eqNullSafe(F.lit(value))


def rolled_up(df: DataFrame, chosen: Column | None, sums: Sequence[str], labels: dict) -> DataFrame:
    """One row of the chosen rows' sums, under synthetic labels; other columns are absent."""
    rows = df if chosen is None else df.filter(chosen)
    return rows.agg(*[F.sum(c).alias(c) for c in sums]).select(*[F.lit(v).alias(k) for k, v in labels.items()], *sums)


def counted(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """``df`` and an observation of its number of rows, filled by the action that reads it; no extra job."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def distinct_sorted(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns).distinct().orderBy(*columns)
