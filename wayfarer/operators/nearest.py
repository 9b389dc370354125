"""The nearest other site of a group on the sphere, over cells of space that grow until no site outside them can be nearer."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfarer.functions.geo import EARTH_KM, haversine_km
from wayfarer.sources.scratch import written

#: Times by which cells grow from round to round.
GROWTH = 4.0


def _cell(h: float) -> list[Column]:
    return [F.floor((F.col(c) + 1) / h).alias(f"c{c}") for c in "xyz"]


def nearest(sites: DataFrame, key: str, group: str, lat: str, lon: str) -> DataFrame:
    """``sites`` with ``km``, the distance to the nearest other site of the group; null where there is none or a coordinate is null.

    Sites are points of the unit sphere in three dimensions, so that poles and
    the date line are places like any other, and lie in cubes.  A site looks at its cube and
    the 26 around it: a site there that is no farther than a cube's edge is the
    nearest.  Those that find none look again with larger cubes.  The first cubes hold about
    one site of the largest group each, if sites are even.  Sites at one place are one point
    with a count.
    """
    columns = sites.columns
    placed = sites.where(F.col(lat).isNotNull() & F.col(lon).isNotNull() & F.col(group).isNotNull())
    points = placed.groupBy(F.col(group).alias("g"), F.col(lat).alias("lat"), F.col(lon).alias("lon")).agg(F.count("*").alias("n"))
    phi, lam = F.radians("lat"), F.radians("lon")
    points = written(points.withColumns({"x": F.cos(phi) * F.cos(lam), "y": F.cos(phi) * F.sin(lam), "z": F.sin(phi)}))
    sizes = points.groupBy("g").agg(F.count("*").alias("of"))
    most = sizes.agg(F.max("of")).first()[0] or 1
    found = [points.where("n > 1").select("g", "lat", "lon", F.lit(0.0).alias("km"))]
    still = written(points.where("n = 1").join(sizes.where("of > 1").select("g"), "g").drop("n"))
    edge = min(2.0, math.sqrt(4 * math.pi / most))
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(k).alias("k")) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)])
    while not still.isEmpty():
        cells = points.select("g", F.col("lat").alias("olat"), F.col("lon").alias("olon"), *_cell(edge))
        asks = still.select("g", "lat", "lon", "x", "y", "z", *_cell(edge), F.explode(around).alias("d"))
        asks = asks.select("g", "lat", "lon", "x", "y", "z", *[(F.col(f"c{c}") + F.col(f"d.{n}")).alias(f"c{c}") for c, n in zip("xyz", "ijk", strict=True)])
        met = asks.join(cells, ["g", "cx", "cy", "cz"]).where((F.col("lat") != F.col("olat")) | (F.col("lon") != F.col("olon")))
        km = met.groupBy("g", "lat", "lon").agg(F.min(haversine_km(F.col("lat"), F.col("lon"), F.col("olat"), F.col("olon"))).alias("km"))
        # the straight distance is at most an edge; beyond the diameter all have been seen
        sure = F.lit(True) if edge >= 2 else 2 * F.sin(F.col("km") / (2 * EARTH_KM)) <= edge * (1 - 1e-9)
        looked = written(still.join(km, ["g", "lat", "lon"], "left"))
        found.append(looked.where(F.coalesce(sure & F.col("km").isNotNull(), F.lit(edge >= 2))).select("g", "lat", "lon", "km"))
        if edge >= 2:
            break
        still = written(looked.where(~F.coalesce(sure & F.col("km").isNotNull(), F.lit(False))).drop("km"))
        edge = min(2.0, edge * GROWTH)
    whole = found[0]
    for f in found[1:]:
        whole = whole.unionByName(f)
    whole = whole.select(F.col("g").alias("_g"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), F.col("km").alias("_km"))
    joined = sites.join(whole, (F.col(group) == F.col("_g")) & (F.col(lat) == F.col("_lat")) & (F.col(lon) == F.col("_lon")), "left")
    return joined.select(*columns, F.col("_km").alias("km"))
