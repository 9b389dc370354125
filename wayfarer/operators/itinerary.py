"""Sections of an itinerary: focus places, stops within views, review rows, regrouped passages and converging paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def focus(sections: DataFrame, route: list[str], order: str, destination: Column, mapped: Column, generated: Column) -> DataFrame:
    """``focus`` of each section: its first destination, else its first mapped place, else the last focus with a place on the map, else its first new place.

    ``destination`` and ``generated`` are keys or null, ``mapped`` the first key
    of the section with coordinates; a destination is carried on only if it is
    ``mapped_destination``, a column of the sections.
    """
    w = Window.partitionBy(*route).orderBy(order)
    own = F.coalesce(destination, mapped)
    on_map = F.when(destination.isNotNull(), F.when(F.col("mapped_destination"), destination)).otherwise(mapped)
    carried = F.last("_on_map", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = sections.withColumns({"_own": own, "_on_map": on_map})
    return rows.withColumn("focus", F.coalesce("_own", carried, generated)).drop("_own", "_on_map")


def visits(reviews: DataFrame, section: str, items: str, sites: DataFrame, key: str, low: int, high: int) -> DataFrame:
    """The reviewed items of the sections from ``low`` to ``high``, numbered, each with its site of the view (or none) and an id."""
    rows = reviews.where(F.col(section).between(low, high)).select(section, F.posexplode(items).alias("_at", key))
    found = rows.join(sites.withColumn("_site", F.lit(True)), key, "left")
    number = F.col("_at") + 1
    name = F.concat(F.lit("section_"), F.lpad(F.col(section).cast("string"), 4, "0"), F.lit("_focus_"), F.lpad(number.cast("string"), 2, "0"))
    return found.select(section, number.alias("focus_order"), name.alias("focus_id"), key, F.coalesce("_site", F.lit(False)).alias("has_site"))


def path_key(*parts: Column) -> Column:
    """A chapter's key: its path of book and chapter, whatever is null left out."""
    return F.concat_ws(".", *[p.cast("string") for p in parts])


def review_queue(candidates: DataFrame, fields: list[str]) -> DataFrame:
    """A row for each candidate with empty fields for the reviewer."""
    return candidates.withColumns({f: F.lit("") for f in fields})


def nested(rows: DataFrame, outer: str, inner: list[str], name: str, order: list[str]) -> DataFrame:
    """Rows put back below their outer key, in order, as an array of structs."""
    held = F.array_sort(F.collect_list(F.struct(*order, *[c for c in inner if c not in order])))
    return rows.groupBy(outer).agg(held.alias(name))


def converging(df: DataFrame, route: str, at: Column, corridors: DataFrame, path: str) -> DataFrame:
    """The place of each row in front of its route's corridor: the path along which it joins; none where the route has no corridor."""
    joined = df.withColumn("_at", at).join(corridors, route)
    return joined.withColumn(path, F.concat(F.array("_at"), F.col(path))).drop("_at")
