"""What a map keeps between runs: tiles of a build, the build itself, and how far the world's floor has come. Tiles are
Parquet, one partition a build; the rest are lines of text written whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geostride.operators.archive import put_tiles
from geostride.session import delete_path

TILES = "tile_id long, length long, payload binary"


def _store(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def write_line(spark: SparkSession, path: str, text: str) -> None:
    store, at = _store(spark, path)
    out = store.create(at, True)
    out.write(bytearray(text.encode()))
    out.close()


def read_lines(spark: SparkSession, path: str) -> list[str]:
    """Lines of a small file; none where it isn't there."""
    store, at = _store(spark, path)
    return [r.value for r in spark.read.text(path).collect()] if store.exists(at) else []


def save_manifest(spark: SparkSession, path: str, build: str, adopted_day: int) -> None:
    """The build in use, and the day (since 1970) it was taken."""
    write_line(spark, path, f"{build}\n{adopted_day}\n")


def load_manifest(spark: SparkSession, path: str) -> tuple[str, int] | None:
    """(build, day); None without a file or for a build that isn't eight signs long."""
    lines = [line.strip() for line in read_lines(spark, path)]
    if len(lines) < 2 or len(lines[0]) != 8 or not lines[1].isdigit():
        return None
    return lines[0], int(lines[1])


def save_cursor(spark: SparkSession, path: str, build: str, z: int, x: int, y: int) -> None:
    """How far the world's floor has come."""
    write_line(spark, path, f"{build} {z} {x} {y}\n")


def load_cursor(spark: SparkSession, path: str, build: str) -> tuple[int, int, int] | None:
    """(z, x, y); None without a file, and for one of another build, whose cache is gone."""
    lines = read_lines(spark, path)
    parts = lines[0].split() if lines else []
    if len(parts) != 4 or parts[0] != build or not all(p.isdigit() for p in parts[1:]):
        return None
    return tuple(map(int, parts[1:]))


def clear_cursor(spark: SparkSession, path: str) -> None:
    delete_path(spark, path)


def open_cache(spark: SparkSession, path: str, build: str) -> DataFrame:
    """(tile_id, length, payload) of a build; length 0 marks a tile known to be empty."""
    store, at = _store(spark, f"{path}/build={build}")
    if not store.exists(at):
        return spark.createDataFrame([], TILES)
    return spark.read.schema(TILES).parquet(f"{path}/build={build}")


def put_cache(tiles: DataFrame, path: str, build: str) -> None:
    """Append tiles (tile_id, payload; null payload: known to be empty) that the build's cache doesn't hold."""
    spark = tiles.sparkSession
    rows = tiles.select("tile_id", F.coalesce(F.octet_length("payload"), F.lit(0)).cast("long").alias("length"), "payload")
    held = open_cache(spark, path, build)
    fresh = put_tiles(held.limit(0), rows.join(held.select("tile_id"), "tile_id", "left_anti"))
    fresh.select("tile_id", "length", "payload").write.mode("append").parquet(f"{path}/build={build}")


def roll_over(spark: SparkSession, path: str, build: str) -> None:
    """Drop the caches of all builds but one."""
    store, at = _store(spark, path)
    if store.exists(at):
        for status in store.listStatus(at):
            if status.getPath().getName() != f"build={build}":
                store.delete(status.getPath(), True)


def lookups(asked: DataFrame, cache: DataFrame, room: int | None = None) -> DataFrame:
    """asked (tile_id) with length and found: hit, empty (known to be), or miss (not there, or larger than room)."""
    rows = asked.join(cache.select("tile_id", "length"), "tile_id", "left")
    large = F.lit(False) if room is None else F.col("length") > room
    return rows.withColumn("found", F.when(F.col("length").isNull() | large, "miss").when(F.col("length") == 0, "empty").otherwise("hit"))


def cache_counters(found: DataFrame, cache: DataFrame) -> DataFrame:
    """One row: hits (known to be empty is one), misses, entries and bytes."""
    counted = found.agg(F.count(F.when(F.col("found") != "miss", 1)).alias("hits"), F.count(F.when(F.col("found") == "miss", 1)).alias("misses"))
    return counted.crossJoin(cache.agg(F.count("*").alias("entries"), F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("bytes")))  # one row each
