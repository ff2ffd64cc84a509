"""Saved points: a small dimension table that keeps its order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geostride.functions.geo import bearing_deg, haversine_m, target_text
from geostride.functions.nmea import coarse

MOST, NAME_BYTES, CLOCK_SET = 32, 23, 100_000


def cut_name(name: Column) -> Column:
    """At most NAME_BYTES bytes of a name; a character that would be split goes whole."""
    fits = F.filter(F.sequence(F.lit(0), F.lit(NAME_BYTES)), lambda n: F.octet_length(F.substring(name, F.lit(1), n)) <= NAME_BYTES)
    return F.substring(name, F.lit(1), F.array_max(fits))


def default_name(number: Column, local_time: Column, epoch: Column) -> Column:
    """HH:MM where the clock is set, else `pin N`."""
    return F.when(epoch > CLOCK_SET, F.date_format(local_time, "HH:mm")).otherwise(F.concat(F.lit("pin "), number.cast("string")))


def add(points: DataFrame, lat: float, lon: float, name: str | None, epoch: int = 0, local_time: str = "1970-01-01 00:00:00") -> DataFrame:
    """points (idx, lat, lon, name, saved_utc) with one more, unless MOST are there."""
    n = points.agg(F.count("*").alias("n"))
    given = F.lit(name) if name else default_name(F.col("n") + 1, F.lit(local_time).cast("timestamp_ntz"), F.lit(epoch))
    saved = F.when(F.lit(epoch) > CLOCK_SET, F.lit(epoch).cast("long"))
    new = n.filter(F.col("n") < MOST).select(F.col("n").cast("int").alias("idx"), F.lit(lat).alias("lat"), F.lit(lon).alias("lon"), cut_name(given).alias("name"), saved.alias("saved_utc"))
    return points.unionByName(new)


def add_from_fix(points: DataFrame, fix: dict, name: str | None, epoch: int = 0) -> DataFrame:
    """add, refused without a position."""
    return add(points, fix["lat"], fix["lon"], name, epoch) if fix["status"] == "A" else points


def remove(points: DataFrame, idx: int) -> DataFrame:
    """points without one; later ones move up."""
    left = points.filter(F.col("idx") != idx)
    return left.withColumn("idx", (F.row_number().over(Window.orderBy("idx")) - 1).cast("int"))


def target_after_remove(target: int, removed: int) -> int:
    """-1 where the target went, one less where it stood later."""
    return -1 if target == removed else target - 1 if target > removed else target


def set_target(points: DataFrame, idx: int) -> DataFrame:
    """At most one row: the point aimed at; none for an index out of range."""
    return points.filter(F.col("idx") == idx)


def target_range(fixes: DataFrame, target: DataFrame) -> DataFrame:
    """Fixes with metres, bearing and text to the target (a table of one row at most, so a broadcast of one row). target:
    lat, lon, and name where it has one."""
    named = F.col("name") if "name" in target.columns else F.lit(None).cast("string")
    t = F.broadcast(target.limit(1).select(F.col("lat").alias("_tlat"), F.col("lon").alias("_tlon"), named.alias("_tname")))
    rows = fixes.filter(coarse(F.col("status"))).join(t, F.lit(True))
    rows = rows.withColumn("metres", haversine_m(F.col("lat"), F.col("lon"), F.col("_tlat"), F.col("_tlon"))).withColumn("bearing", bearing_deg(F.col("lat"), F.col("lon"), F.col("_tlat"), F.col("_tlon")))
    return rows.withColumn("text", target_text(F.col("metres"), F.col("bearing"), F.col("_tname") if "name" in target.columns else None)).drop("_tlat", "_tlon", "_tname")
