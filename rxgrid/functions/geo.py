"""Distance expressions and distance classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rxgrid.config import EARTH_RADIUS_KM, EARTH_RADIUS_MILES, KM_TO_MILES


def haversine_miles(lat1: Column, lng1: Column, lat2: Column, lng2: Column,
                    radius: float = EARTH_RADIUS_MILES) -> Column:
    """Great-circle miles by the haversine formula with atan2."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    dphi = F.radians(lat2 - lat1)
    dlmb = F.radians(lng2 - lng1)
    a = F.pow(F.sin(dphi / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dlmb / 2), 2)
    return F.lit(radius) * 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def acos_miles(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Spherical law of cosines with the cosine clamped to [-1, 1], km -> miles."""
    c = F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(F.radians(lng2) - F.radians(lng1)) + F.sin(
        F.radians(lat1)
    ) * F.sin(F.radians(lat2))
    return F.lit(EARTH_RADIUS_KM) * F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), c))) * F.lit(KM_TO_MILES)


def distance_category_training(miles: Column) -> Column:
    """E7 (training): very_close < 3, nearby < 8, moderate < 15, else far."""
    return F.when(miles < 3, "very_close").when(miles < 8, "nearby").when(miles < 15, "moderate").otherwise("far")


def distance_category_display(miles: Column) -> Column:
    """E7 (display): < 0.5 Local, <= 10 Nearby, <= 25 Moderate, else Distant."""
    return F.when(miles < 0.5, "Local").when(miles <= 10, "Nearby").when(miles <= 25, "Moderate").otherwise("Distant")


def distance_penalty(miles: Column, weight: Column | float | None = None) -> Column:
    """$200 beyond 15 miles, $100 beyond 8, optionally scaled by weight / 50."""
    base = F.when(miles > 15, 200.0).when(miles > 8, 100.0).otherwise(0.0)
    if weight is None:
        return base
    w = F.lit(float(weight)) if isinstance(weight, (int, float)) else weight
    return base * (w / 50.0)
