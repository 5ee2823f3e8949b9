"""The fact table of burned cells: zones by polygons, one event a cell and day, attribute layers, sized files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import layers, prepare, recurrence, spatial
from ..operators.recurrence import Names
from ..sources.tables import write_frame


@dataclass(frozen=True)
class Zones:
    """Edges (id, x1, y1, x2, y2) of the polygons that cells are joined to."""

    perimeters: DataFrame
    states: DataFrame
    eco: DataFrame
    hexagons: DataFrame


def _zoned(cells: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    return spatial.within(cells, spatial.scanline_runs(edges)).withColumnRenamed("id", name)


def zoned(cells: DataFrame, zones: Zones) -> DataFrame:
    """Cells (geohash, row, col) with perimeter, state, eco and hexagon.

    A cell has a row for each perimeter over it. Cells outside all states, and those
    outside all hexagons, are dropped; one outside all eco regions gets the nearest.
    """
    out = _zoned(_zoned(cells, zones.perimeters, "perimeter"), zones.states, "state")
    places = out.select("geohash", "row", "col").distinct()
    eco = spatial.assign(places, spatial.scanline_runs(zones.eco), zones.eco, "geohash").select("geohash", F.col("id").alias("eco"))
    return _zoned(out.join(eco, "geohash"), zones.hexagons, "hexagon")


def extract(cells: DataFrame, zones: Zones, events: DataFrame, attributes: dict[str, DataFrame], path: str | None = None) -> tuple[DataFrame, dict]:
    """The fact table, and observations of its rows after each stage.

    ``events`` gives each perimeter its date and event id; the last event of a cell's
    day stays. ``attributes`` are layers (geohash, value), nulls dropped, all inner: a
    cell that misses in any is dropped. With ``path`` the table is written there.
    """
    seen = {}

    def noted(df: DataFrame, name: str) -> DataFrame:
        df, seen[name] = prepare.counted(df, name)
        return df

    out = noted(zoned(cells, zones), "zones")
    out = noted(out.join(events, "perimeter"), "events")
    out = noted(recurrence.keep_last(out, Names(date="date", event="event")), "last of a day")
    out = noted(layers.attach_all(out, attributes), "layers")
    if path:
        write_frame(out, path)
    return out, seen
