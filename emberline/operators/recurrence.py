"""Recurrence and survival of events per entity, and weighted event histories.

Every function takes the event table's column names through ``Names`` and returns
a DataFrame. Ties of dates are ordered by the event id, so results are
deterministic.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.codes import whole_days, years

MIN_GAP_YEARS = 0.25


@dataclass(frozen=True)
class Names:
    key: str = "geohash"
    date: str = "Ig_Date"
    event: str = "Event_ID"
    severity: str = "bs"
    eco: tuple[str, ...] = ("eco_lvl_1", "eco_lvl_2", "eco_lvl_3")
    perimeter: str = "perim_index"


def keep_last(events: DataFrame, names: Names = Names(), by: Sequence[str] | None = None) -> DataFrame:
    """One row per (key, date): the one with the greatest event id."""
    w = W.partitionBy(*(by or (names.key, names.date))).orderBy(F.col(names.event).desc_nulls_last())
    return events.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def pair_gaps(events: DataFrame, extra: Sequence[str] = (), names: Names = Names()) -> DataFrame:
    """One row per consecutive pair of a key's events; pairs with any null are dropped."""
    if names.severity in extra:
        raise ValueError("the severity is always included")
    w = W.partitionBy(names.key).orderBy(names.date, names.event)
    columns = [names.severity, *extra]
    head = [F.first(c).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias(f"eco{i}") for i, c in enumerate(names.eco, 1)]
    pairs = [x for c in columns for x in (F.col(c).alias(f"{c}_1"), F.lead(c).over(w).alias(f"{c}_2"))]
    following = F.lead(names.date).over(w)
    dt = years(whole_days(F.col(names.date), following)).alias("dt")
    return events.select(names.key, *head, dt, following.alias("_next"), *pairs).filter("_next IS NOT NULL").drop("_next").dropna("any")


def last_date(events: DataFrame, names: Names = Names()) -> DataFrame:
    return events.agg(F.max(names.date).alias("_max"))


def survival(events: DataFrame, max_date: Column | None = None, extra: Sequence[str] = (), names: Names = Names()) -> DataFrame:
    """Per key: number of events, the last one's columns, and years since it; rows with any null are dropped."""
    if names.severity in extra:
        raise ValueError("the severity is always included")
    if max_date is not None:
        events = events.filter(F.col(names.date) <= max_date)
    taken = [names.date, *names.eco, names.severity, *extra]
    last = F.max_by(F.struct(*taken), F.struct(names.date, names.event)).alias("_last")
    out = events.groupBy(names.key).agg(F.count("*").alias("n"), last)
    if max_date is None:
        out, max_date = out.crossJoin(F.broadcast(last_date(events, names))), F.col("_max")  # one row
    st = years(whole_days(F.col(f"_last.{names.date}"), max_date)).alias("st")
    return out.select(names.key, "n", *[f"_last.{c}" for c in names.eco], st, *[f"_last.{c}" for c in (names.severity, *extra)]).dropna("any")


def event_histories(events: DataFrame, max_date: Column | None = None, fixed: Sequence[str] = (), varied: Sequence[str] = (), names: Names = Names()) -> DataFrame:
    """Distinct histories with the number of keys that have them.

    A fixed pivot that varies within a key splits the key's history. The lists are
    in order of (date, event).
    """
    if max_date is not None:
        events = events.filter(F.col(names.date) <= max_date)
    item = F.struct(names.date, names.event, names.perimeter, *varied)
    lists = events.groupBy(names.key, *fixed).agg(F.array_sort(F.collect_list(item)).alias("_h"), F.count("*").alias("# Fires"))
    columns = [names.date, names.perimeter, *varied]
    lists = lists.select(*fixed, "# Fires", *[F.col(f"_h.{c}").alias(c) for c in columns])
    return lists.groupBy(names.date, "# Fires", names.perimeter, *fixed, *varied).agg(F.count("*").alias("Pixel_Count")).dropna("any")


def _all(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def history_gaps(histories: DataFrame, filters: dict | None = None, names: Names = Names(), least: float = MIN_GAP_YEARS) -> DataFrame:
    """Weighted gaps; filters apply to the later event's values, and gaps must exceed ``least`` years."""
    filters = filters or {}
    h = histories.filter("`# Fires` > 1")
    others = [c for c in h.columns if c not in (names.date, "# Fires", names.perimeter, *filters)]
    d = f"`{names.date}`"
    gap = F.expr(f"transform(sequence(1, size({d})), i -> timestampdiff(DAY, get({d}, i - 2), get({d}, i - 1)))").alias("days")
    zipped = F.arrays_zip(gap, *[F.col(c) for c in filters])
    out = h.select(*others, F.explode(zipped).alias("_z")).select(*others, years(F.col("_z.days")).alias("dt"), *[F.col(f"_z.{c}").alias(c) for c in filters])
    out = out.filter(_all([F.col(c).isin(list(v)) for c, v in filters.items()])).filter(F.col("dt") > least).dropna("any")
    return out.select("dt", "Pixel_Count", *filters)


def _bounds(histories: DataFrame, names: Names) -> DataFrame:
    return histories.agg(F.min(F.array_min(names.date)).alias("_min"), F.max(F.array_max(names.date)).alias("_max"))


def _with_bounds(histories: DataFrame, min_date, max_date, names: Names) -> tuple[DataFrame, Column, Column]:
    if min_date is None or max_date is None:
        histories = histories.crossJoin(F.broadcast(_bounds(histories, names)))  # one row
    return histories, F.col("_min") if min_date is None else min_date, F.col("_max") if max_date is None else max_date


def history_spans(histories: DataFrame, min_date: Column | None = None, max_date: Column | None = None, fixed: Sequence[str] = (), varied: Sequence[str] = (), names: Names = Names()) -> DataFrame:
    """ct and ut as day-time intervals, with weight and pivots."""
    h, low, high = _with_bounds(histories, min_date, max_date, names)
    first, last = F.element_at(names.date, 1), F.element_at(names.date, -1)
    return h.select((high - last).alias("ct"), (first - low).alias("ut"), "Pixel_Count", *fixed, *varied)


def history_starts(histories: DataFrame, min_date: Column | None = None, filters: dict | None = None, names: Names = Names()) -> DataFrame:
    """ut: years from the start of the record to the first event, filtered by its values."""
    filters = filters or {}
    h, low, _ = _with_bounds(histories, min_date, F.lit(None), names) if min_date is None else (histories, min_date, None)
    days = whole_days(low, F.element_at(names.date, 1))
    return h.filter(_all([F.element_at(c, 1).isin(list(v)) for c, v in filters.items()])).select(years(days).alias("ut"), "Pixel_Count", *filters)


def history_ends(histories: DataFrame, max_date: Column | None = None, filters: dict | None = None, names: Names = Names()) -> DataFrame:
    """ct: years from the last event to the end of the record, filtered by its values."""
    filters = filters or {}
    h, _, high = _with_bounds(histories, F.lit(None), max_date, names) if max_date is None else (histories, None, max_date)
    days = whole_days(F.element_at(names.date, -1), high)
    return h.filter(_all([F.element_at(c, -1).isin(list(v)) for c, v in filters.items()])).select(years(days).alias("ct"), "Pixel_Count", *filters)


def blank_entities(histories: DataFrame, total: int | Column) -> DataFrame:
    total = total if isinstance(total, Column) else F.lit(total)
    return histories.agg((F.coalesce(F.sum("Pixel_Count"), F.lit(0))).alias("_s")).select((total - F.col("_s")).cast("long").alias("blank"))
