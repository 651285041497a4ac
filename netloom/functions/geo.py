"""Great-circle distance and grid cells as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0
EARTH_RADIUS_M = 6_371_000.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float) -> Column:
    half_lat = F.sin(F.radians(lat2 - lat1) / 2.0)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2.0)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    # Rounding can push `a` past one at the antipode, where asin is NaN, and below zero where a latitude beyond the pole names
    # the same place; a missing coordinate stays NULL.  Each input is evaluated once.
    return F.lit(2.0 * radius) * F.nanvl(F.asin(F.sqrt(F.abs(a))), F.lit(math.pi / 2))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return haversine(lat1, lon1, lat2, lon2, EARTH_RADIUS_KM)


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return haversine(lat1, lon1, lat2, lon2, EARTH_RADIUS_M)


def cell_size(level: int) -> float:
    """Degrees per cell: the globe's 360 degrees halved ``level`` times."""
    return 360.0 / (1 << level)


def cell_x(lon: Column, level: int) -> Column:
    return F.pmod(F.floor((lon + F.lit(180.0)) / F.lit(cell_size(level))), F.lit(1 << level))


def cell_y(lat: Column, level: int) -> Column:
    return F.floor((lat + F.lit(90.0)) / F.lit(cell_size(level)))


def lat_reach(radius_m: Column) -> Column:
    """Degrees of latitude covered by a radius, rounded outwards."""
    return F.degrees(radius_m / F.lit(EARTH_RADIUS_M)) * F.lit(1.0 + 1e-9) + F.lit(1e-9)


def lon_reach(lat: Column, radius_m: Column) -> Column:
    """Degrees of longitude a circle spans; 180 where it reaches a pole."""
    r = radius_m / F.lit(EARTH_RADIUS_M)
    ratio = F.sin(r) / F.cos(F.radians(lat))
    touches_pole = (F.abs(F.radians(lat)) + r >= F.lit(math.pi / 2 - 1e-6)) | (ratio >= F.lit(1.0))
    return F.when(touches_pole, F.lit(180.0)).otherwise(
        F.degrees(F.asin(F.least(F.lit(1.0), ratio))) * F.lit(1.0 + 1e-9) + F.lit(1e-9))


def ball_cells(lat: Column, lon: Column, radius_m: float, around: bool = False) -> Column:
    """Key of the cube of space that holds a point of the unit sphere, or, with ``around``, an array of the one to eight cubes that
    may hold points within ``radius_m`` of it.

    A cube is twice the radius wide, so a point costs as much at a pole as anywhere; the straight way through the sphere is never
    longer than the arc.  Coordinates beyond the ranges of latitude and longitude stand where the haversine formula has them.
    """
    reach = radius_m / EARTH_RADIUS_M * (1.0 + 1e-9) + 1e-12
    la, lo = F.radians(lat), F.radians(lon)
    axes = [F.cos(la) * F.cos(lo), F.cos(la) * F.sin(lo), F.sin(la)]
    cell = lambda c: F.floor(c / F.lit(2.0 * reach)).cast("int")
    if not around:
        return F.struct(*[cell(c).alias(n) for n, c in zip("xyz", axes)])
    xs, ys, zs = ([F.sequence(cell(c - F.lit(reach)), cell(c + F.lit(reach))) for c in axes])
    return F.flatten(F.transform(xs, lambda x: F.flatten(F.transform(ys, lambda y: F.transform(
        zs, lambda z: F.struct(x.alias("x"), y.alias("y"), z.alias("z")))))))


def planar_projection(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column,
                      ) -> tuple[Column, Column]:
    """Parameter t in [0,1] of the foot of the perpendicular on segment a-b, and the
    squared planar distance to it.  Inputs are already in a common planar unit."""
    dx, dy = bx - ax, by - ay
    len2 = dx * dx + dy * dy
    t = F.when(len2 == 0, F.lit(0.0)).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / len2)))
    ex, ey = px - (ax + t * dx), py - (ay + t * dy)
    return t, ex * ex + ey * ey
