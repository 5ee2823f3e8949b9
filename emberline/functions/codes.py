"""Codes, calendar rules and time arithmetic, as Column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
DAYS_IN_YEAR = 365.0
FIRST_YEAR = 1984
WINDOW_YEARS = 38
SQ_M_TO_ACRES = 0.0002471054


def encode(value: Column, codes: dict, strict: bool = True) -> Column:
    """Code of a value; an unknown value is an error if ``strict``, else null."""
    table = F.create_map(*[F.lit(x) for x in chain(*codes.items())])
    found = F.try_element_at(table, value)
    if not strict:
        return found
    kind = type(next(iter(codes.values()))).__name__
    return F.when(value.isNull() | found.isNotNull(), found).otherwise(F.raise_error(F.concat(F.lit("unknown value "), value)).cast("int" if kind == "int" else "string"))


def eco_levels(code: Column) -> list[Column]:
    """Levels 1 to 3 of a code "XX.Y.ZZ" as integers."""
    parts = F.split(code, r"\.", 3)
    whole = parts[0].cast("int") * 1000 + parts[1].cast("int") * 100 + parts[2].cast("int")
    return [F.floor(whole / 1000).cast("int"), F.floor(whole / 100).cast("int"), whole]


def flag(value: Column) -> Column:
    """1 above zero, else 0, null too."""
    return F.coalesce(value > 0, F.lit(False)).cast("tinyint")


def days_since_epoch(date: Column) -> Column:
    return F.unix_date(F.to_date(date))


def whole_days(a: Column, b: Column) -> Column:
    """Elapsed whole days from a to b, truncated; not the number of midnights."""
    return F.timestamp_diff("DAY", a, b)


def years(days: Column) -> Column:
    return days / F.lit(DAYS_IN_YEAR)


def vintage(year: Column) -> Column:
    """The survey that holds for a year: the decade's, clamped to 1990 and 2020."""
    return F.greatest(F.lit(1990), F.least(F.lit(2020), F.floor(year / 10) * 10)).cast("int")


def cover_years(year: Column) -> tuple[Column, Column, Column]:
    """Land-cover years: this, the one before (from 1984 on), the one after."""
    return year, F.greatest(year - 1, F.lit(FIRST_YEAR)), year + 1


def survival_days(last: Column, start_year: int, end_year: int) -> Column:
    """Days from the last event to 1 January of ``end_year``; never: all years of 365 days."""
    return F.coalesce(F.datediff(F.make_date(F.lit(end_year), F.lit(1), F.lit(1)), last), F.lit((end_year - start_year) * 365)).cast("int")


def truncation_weight(dt: Column, window: int = WINDOW_YEARS) -> Column:
    """window / (window - whole years): corrects for gaps that the record cuts off."""
    return F.lit(float(window)) / F.nullif(F.lit(window) - F.floor(dt), F.lit(0))
