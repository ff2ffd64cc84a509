"""Squares, grids and what is missing of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geostride.functions.tiles import grid_origin, mercator, slot_rank, valid_y, wrap_x


def square_around(points: DataFrame, z: int, radius: int = 7, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Distinct tiles (z, x, y) of the square of `radius` tiles around each point. x wraps round the world; rows beyond a
    pole are left out."""
    zoom = F.lit(z)
    m = points.select(mercator(F.col(lat), F.col(lon), zoom).alias("m")).select(F.floor("m.fx").alias("cx"), F.floor("m.fy").alias("cy")).distinct()
    steps = F.sequence(F.lit(-radius), F.lit(radius))
    spread = m.withColumn("dx", F.explode(steps)).withColumn("dy", F.explode(steps))
    tiles = spread.select(zoom.alias("z"), wrap_x(F.col("cx") + F.col("dx"), zoom).alias("x"), (F.col("cy") + F.col("dy")).alias("y"))
    return tiles.filter(valid_y(F.col("y"), zoom)).distinct()


def missing(wanted: DataFrame, held: DataFrame) -> DataFrame:
    return wanted.join(held, ["z", "x", "y"], "left_anti")


def prefetch_counts(resolved: DataFrame) -> DataFrame:
    """One row: tiles fetched, cached, offline and missing."""
    count = lambda s: F.count(F.when(F.col("source") == s, 1))
    return resolved.agg(count("remote").alias("fetched"), count("cache").alias("cached"), count("local").alias("offline"), count("miss").alias("missing"))


def visible_tiles(fixes: DataFrame, z: int, n: int = 2, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """The n x n grid around each fix: slot, id, state (pending or nodata) and rank from the middle."""
    zoom = F.lit(z)
    m = fixes.withColumn("_m", mercator(F.col(lat), F.col(lon), zoom))
    m = m.withColumn("_ox", grid_origin(F.col("_m.fx"), n)).withColumn("_oy", grid_origin(F.col("_m.fy"), n))
    slots = m.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(n * n - 1))))
    row, col = F.floor(F.col("slot") / n), F.col("slot") % n
    out = slots.withColumn("z", zoom).withColumn("x", wrap_x(F.col("_ox") + col, zoom)).withColumn("y", F.col("_oy") + row).withColumn("rank", slot_rank(row, col, n).cast("int"))
    return out.withColumn("state", F.when(valid_y(F.col("y"), zoom), "pending").otherwise("nodata")).drop("_m", "_ox", "_oy")


def grid_jobs(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Slots of the new grid that the old one doesn't hold, in drawing order. keys: what names a grid, such as device."""
    fresh = new.filter("state = 'pending'").join(old.select(*keys, "z", "x", "y"), [*keys, "z", "x", "y"], "left_anti")
    return fresh.orderBy(*keys, "rank", "slot")


def accept_results(slots: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """Results whose generation and tile are still those of their slot."""
    return results.join(slots.select(*keys, "slot", "generation", "z", "x", "y"), [*keys, "slot", "generation", "z", "x", "y"], "left_semi")


def world_floor(spark, max_zoom: int = 6) -> DataFrame:
    """All tiles of zooms 0 to max_zoom."""
    rows = spark.range((4 ** (max_zoom + 1) - 1) // 3).withColumnRenamed("id", "tile_id")
    from geostride.functions.tiles import hilbert_zxy

    return rows.select("tile_id", hilbert_zxy(F.col("tile_id")).alias("t")).select("tile_id", "t.*")


def shared_rectangle(a, b):
    """struct(x0, y0, x1, y1) that two rectangles share; null where they share no area."""
    x0, y0, x1, y1 = F.greatest(a["x0"], b["x0"]), F.greatest(a["y0"], b["y0"]), F.least(a["x1"], b["x1"]), F.least(a["y1"], b["y1"])
    return F.when((x0 < x1) & (y0 < y1), F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1")))


def resume_floor(wanted: DataFrame, path: str, fetch, most: int = 1000) -> int:
    """Fetch up to `most` of the tiles (tile_id, z, x, y) that path doesn't hold yet, the lowest ids first, and append them
    there; how many were left. fetch: a function of a DataFrame of tiles to one with what is kept of them. Every call
    appends whole or not at all, so a run that was cut off goes on where it stopped."""
    spark = wanted.sparkSession
    store = spark._jvm.org.apache.hadoop.fs.Path(path)
    if store.getFileSystem(spark._jsc.hadoopConfiguration()).exists(store):
        wanted = wanted.join(spark.read.parquet(path).select("tile_id"), "tile_id", "left_anti")
    left = wanted.count()
    if left:
        fetch(wanted.orderBy("tile_id").limit(most)).write.mode("append").parquet(path)
    return max(0, left - most)


def clear_floor(spark, path: str) -> None:
    """Forget what was fetched: a new build begins anew."""
    from geostride.session import delete_path

    delete_path(spark, path)
