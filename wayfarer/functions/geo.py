"""Distances and small geometry, as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in kilometres."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def ring_offset(position: Column, n: Column, radius: float = 13.0) -> Column:
    """Where the position-th (from 0) of n things with one coordinate is drawn: on a ring, from the top; one stays put."""
    angle = 2 * math.pi * position / n - math.pi / 2
    return F.when(n > 1, F.struct((radius * F.cos(angle)).alias("dx"), (radius * F.sin(angle)).alias("dy"))).otherwise(F.struct(F.lit(0.0).alias("dx"), F.lit(0.0).alias("dy")))


def in_frame(lat: Column, lon: Column, lat_range: tuple = (-90, 90), lon_range: tuple = (-180, 180)) -> Column:
    """Whether a point lies in a frame; null coordinates are outside."""
    return F.coalesce(lat.between(*lat_range) & lon.between(*lon_range), F.lit(False))
