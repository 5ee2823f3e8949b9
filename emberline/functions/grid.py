"""Cell ids of the fixed 30 m Albers grid, as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The grid's affine, shape, and the projection (GRS80, Albers equal area).
CELL, LEFT, TOP = 30, -2406135, 3222585
ROWS, COLS = 100150, 157144
A, INVERSE_F = 6378137.0, 298.257222101
PARALLELS, ORIGIN = (29.5, 45.5), (23.0, -96.0)

_F = 1 / INVERSE_F
_E2 = _F * (2 - _F)
_E = math.sqrt(_E2)


def _q(s: float) -> float:
    return (1 - _E2) * (s / (1 - _E2 * s * s) - math.log((1 - _E * s) / (1 + _E * s)) / (2 * _E))


def _m2(s: float) -> float:
    return (1 - s * s) / (1 - _E2 * s * s)


_S1, _S2, _S0 = (math.sin(math.radians(v)) for v in (*PARALLELS, ORIGIN[0]))
N = (_m2(_S1) - _m2(_S2)) / (_q(_S2) - _q(_S1))
C = _m2(_S1) + N * _q(_S1)
RHO0 = A * math.sqrt(C - N * _q(_S0)) / N
QP = _q(1.0)


def in_grid(row: Column, col: Column) -> Column:
    return row.between(0, ROWS - 1) & col.between(0, COLS - 1)


def cell_of(x: Column, y: Column, strict: bool = False) -> Column:
    """Cell id of a point; outside the grid null, or an error if ``strict``."""
    col = F.floor((x - LEFT) / CELL)
    row = F.floor((y - TOP) / -CELL)
    miss = F.raise_error(F.lit("point outside the grid")).cast("long") if strict else F.lit(None).cast("long")
    return F.when(in_grid(row, col), row * F.lit(COLS).cast("long") + col).otherwise(miss)


def row_of(cell: Column) -> Column:
    return F.floor(cell / F.lit(COLS)).cast("long")


def col_of(cell: Column) -> Column:
    return (cell % F.lit(COLS)).cast("long")


def cell_from_row_col(row: Column, col: Column) -> Column:
    return F.when(in_grid(row, col), row.cast("long") * F.lit(COLS) + col)


def centre_x(cell: Column) -> Column:
    return (col_of(cell) * CELL + LEFT + CELL // 2).cast("double")


def centre_y(cell: Column) -> Column:
    return (row_of(cell) * -CELL + TOP - CELL // 2).cast("double")


def geometry_of(cell: Column) -> Column:
    """The cell's centre as a point."""
    return F.struct(centre_x(cell).alias("x"), centre_y(cell).alias("y"))


def to_lonlat(x: Column, y: Column) -> tuple[Column, Column]:
    """Inverse Albers: degrees of longitude and latitude of grid coordinates."""
    dy = F.lit(RHO0) - y
    q = (F.lit(C) - (x * x + dy * dy) * (N * N / (A * A))) / N
    b = F.asin(q / QP)
    e4, e6 = _E2**2, _E2**3
    lat = b + (_E2 / 3 + 31 * e4 / 180 + 517 * e6 / 5040) * F.sin(b * 2) + (23 * e4 / 360 + 251 * e6 / 3780) * F.sin(b * 4) + (761 * e6 / 45360) * F.sin(b * 6)
    return F.degrees(F.atan2(x, dy) / N) + ORIGIN[1], F.degrees(lat)


def from_lonlat(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Forward Albers: grid coordinates of degrees."""
    s = F.sin(F.radians(lat))
    q = (s / (1 - s * s * _E2) - F.log((1 - s * _E) / (1 + s * _E)) / (2 * _E)) * (1 - _E2)
    rho = F.sqrt(F.lit(C) - q * N) * (A / N)
    theta = F.radians(lon - ORIGIN[1]) * N
    return rho * F.sin(theta), F.lit(RHO0) - rho * F.cos(theta)
