"""Grid index over latitude and longitude: points meet only the points of near cells.

Cells have a fixed size in degrees.  A point joins the cells that a cap around it can touch: the cap's
bounding box, whose width in longitude grows towards the poles, wraps around the date line and takes the
whole ring where the cap holds a pole.  So a radius search is an equi-join on cells followed by the exact
distance, and no key (a state, a plan) is ever joined on alone.

``nearest`` grows rings: each round searches a radius four times as large, with cells of that size, for the
points whose k-th neighbour is not below the last ring's edge yet.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rxgrid.config import EARTH_RADIUS_KM, KM_TO_MILES
from rxgrid.functions.geo import acos_miles
from rxgrid.session import shared_table

_RADIUS = EARTH_RADIUS_KM * KM_TO_MILES
#: No two points are farther apart.
FARTHEST = math.pi * _RADIUS * 1.000001
_GROWTH = 4.0


def _columns(miles: float) -> int:
    """Cells around the equator: as wide as `miles`, at least 4 and at most a few million."""
    return max(4, min(1 << 22, int(2 * math.pi * _RADIUS / max(miles, 1e-3))))


def cell(lat: Column, lng: Column, columns: int) -> Column:
    """Cell (y, x) of a point; `columns` cells around the equator, cells are square in degrees."""
    size = 360.0 / columns
    x = F.floor((lng + 180.0) / size)
    return F.struct(F.floor((lat + 90.0) / size).cast("long").alias("y"), F.pmod(x, F.lit(columns)).cast("long").alias("x"))


def cells_around(lat: Column, lng: Column, miles: float, columns: int) -> Column:
    """Array of all cells that the cap of radius `miles` around a point can touch."""
    size = 360.0 / columns
    r = min(miles / _RADIUS * (1 + 1e-9) + 1e-9, math.pi)
    high = F.degrees(F.lit(r))
    south, north = F.greatest(lat - high, F.lit(-90.0)), F.least(lat + high, F.lit(90.0))
    flat = F.cos(F.radians(lat))
    pole = (F.abs(lat) + high >= 90.0) | F.lit(r >= math.pi / 2)
    wide = F.when(pole, F.lit(180.0)).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), F.lit(math.sin(r)) / flat))) + 1e-9)
    first = F.floor((lng - wide + 180.0) / size).cast("long")
    last = F.least(F.floor((lng + wide + 180.0) / size).cast("long"), first + F.lit(columns - 1))
    ys = F.sequence(F.floor((south + 90.0) / size).cast("long"), F.floor((north + 90.0) / size).cast("long"))
    xs = F.sequence(first, last)
    return F.flatten(F.transform(ys, lambda y: F.transform(xs, lambda x: F.struct(y.alias("y"), F.pmod(x, F.lit(columns)).cast("long").alias("x")))))


def _rounded(d: Column, digits: int | None) -> Column:
    return d if digits is None else F.round(d.cast("decimal(24,6)"), digits).cast("double")


def within(left: DataFrame, right: DataFrame, miles: float, keys: Sequence[str] = (), digits: int | None = None,
           left_at: tuple[str, str] = ("lat", "lng"), right_at: tuple[str, str] = ("p_lat", "p_lng"),
           out_col: str = "distance_miles") -> DataFrame:
    """All pairs of equal `keys` at most `miles` apart (acos form; rounded to `digits` before the comparison).

    Both sides keep their columns, which must differ but for `keys`; points without coordinates meet nothing.
    """
    slack = 0.0 if digits is None else 0.5 * 10.0**-digits + 1e-6
    columns = _columns(miles)
    lat, lng, p_lat, p_lng = (F.col(c) for c in (*left_at, *right_at))
    a = left.where(lat.isNotNull() & lng.isNotNull()).withColumn("_cell", F.explode(cells_around(lat, lng, miles + slack, columns)))
    b = right.where(p_lat.isNotNull() & p_lng.isNotNull()).withColumn("_cell", cell(p_lat, p_lng, columns))
    a, b = (x.select("*", F.col("_cell.y").alias("_y"), F.col("_cell.x").alias("_x")).drop("_cell") for x in (a, b))
    both = a.join(b, [*keys, "_y", "_x"]).drop("_y", "_x")
    return both.withColumn(out_col, _rounded(acos_miles(lat, lng, p_lat, p_lng), digits)).where(F.col(out_col) <= miles)


def nearest(left: DataFrame, right: DataFrame, ids: Sequence[str], order: Sequence[str], k: int = 1, keys: Sequence[str] = (),
            digits: int | None = None, first_miles: float = 10.0, left_at: tuple[str, str] = ("lat", "lng"),
            right_at: tuple[str, str] = ("p_lat", "p_lng"), out_col: str = "distance_miles") -> DataFrame:
    """The `k` nearest right rows (all, where there are fewer) of each left row with equal `keys`, with their `rank`.

    `ids` name a left row, `order` breaks ties of the distance.
    """
    p_lat, p_lng = (F.col(c) for c in right_at)
    right = right.where(p_lat.isNotNull() & p_lng.isNotNull())
    some = right.groupBy(*keys).agg(F.least(F.count(F.lit(1)), F.lit(k)).alias("_want"))
    there = left.where(F.col(left_at[0]).isNotNull() & F.col(left_at[1]).isNotNull())
    open_ = shared_table(there.join(some, list(keys)) if keys else there.crossJoin(some.where("_want > 0")), "rings")
    ranks = Window.partitionBy(*ids).orderBy(out_col, *order)
    found, miles = None, first_miles
    while not open_.isEmpty():
        near = within(open_, right, miles, keys, digits, left_at, right_at, out_col)
        near = near.withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= k)
        near = shared_table(near.withColumn("_have", F.max("rank").over(Window.partitionBy(*ids))), "rings")
        full = near.where("_have >= _want").drop("_have", "_want")
        found = full if found is None else found.unionByName(full)
        if miles >= FARTHEST:
            break
        open_ = shared_table(open_.join(full.select(*ids).distinct(), list(ids), "left_anti"), "rings")
        miles = min(miles * _GROWTH, FARTHEST)
    if found is None:
        found = within(open_, right, miles, keys, digits, left_at, right_at, out_col).drop("_want").withColumn("rank", F.lit(1))
    return found


def all_pairs(left: DataFrame, right: DataFrame, key: str, cell_miles: float = 300.0, digits: int | None = None,
              left_at: tuple[str, str] = ("lat", "lng"), right_at: tuple[str, str] = ("p_lat", "p_lng"),
              out_col: str = "distance_miles") -> DataFrame:
    """All pairs of one key with their distance, for measures over all of them; a key's work is dealt by the right side's cells."""
    columns = _columns(cell_miles)
    lat, lng, p_lat, p_lng = (F.col(c) for c in (*left_at, *right_at))
    b = right.withColumn("_cell", cell(p_lat, p_lng, columns)).select("*", F.col("_cell.y").alias("_y"), F.col("_cell.x").alias("_x")).drop("_cell")
    a = left.join(b.select(key, "_y", "_x").distinct(), key)  # the cells in which a key has points at all
    both = a.join(b, [key, "_y", "_x"]).drop("_y", "_x")
    return both.withColumn(out_col, _rounded(acos_miles(lat, lng, p_lat, p_lng), digits))
