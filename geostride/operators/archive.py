"""Which archive and which entry hold a tile, and where a tile comes from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geostride.functions.tiles import hilbert_id, tile_bounds_e7
from geostride.session import materialize


def locate_entries(tiles: DataFrame, entries: DataFrame, on: list[str] | None = None, bucket: int = 64) -> DataFrame:
    """Tiles (with tile_id) with the entry that covers them (entry_id, run_length, length, offset), by containment:
    entry_id <= tile_id < entry_id + run_length. on: further equal columns, such as path.

    Ids are cut into buckets, so that the join is one on equal keys. Entries don't overlap, so a tile meets at most
    `bucket` of them. An entry that reaches over some buckets is listed in each; one that reaches over more than `bucket`
    is listed in buckets `bucket` squared times as large instead, of which none meets more than `bucket` either."""
    on = on or []
    wide = bucket**3
    e = entries.select(*on, F.col("tile_id").alias("entry_id"), "run_length", "length", "offset").filter("run_length > 0")
    end = F.col("entry_id") + F.col("run_length") - 1
    part = lambda c, size: F.floor(c / size)
    first, last = part(F.col("entry_id"), bucket), part(end, bucket)
    inside = (F.col("tile_id") >= F.col("entry_id")) & (F.col("tile_id") < F.col("entry_id") + F.col("run_length"))
    short = e.filter(last - first <= bucket).withColumn("_b", F.explode(F.sequence(first, last)))
    found = tiles.withColumn("_b", part(F.col("tile_id"), bucket)).join(short, [*on, "_b"]).filter(inside).drop("_b")
    far = e.filter(last - first > bucket).withColumn("_w", F.explode(F.sequence(part(F.col("entry_id"), wide), part(end, wide))))
    more = tiles.withColumn("_w", part(F.col("tile_id"), wide)).join(far, [*on, "_w"]).filter(inside).drop("_w")
    return found.unionByName(more)


def with_offsets(entries: DataFrame, partition: list[str], order: str, stored: str = "stored", length: str = "length") -> DataFrame:
    """Adds offset: stored - 1, or where stored is 0 the end of the entry before it (0 for a first one)."""
    w = Window.partitionBy(*partition).orderBy(order)
    island = F.sum((F.col(stored) != 0).cast("int")).over(w)
    rows = entries.withColumn("_island", island)
    inside = Window.partitionBy(*partition, "_island").orderBy(order)
    anchor = F.max(F.when(F.col(stored) != 0, F.col(stored) - 1)).over(inside)
    before = F.coalesce(F.sum(length).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("offset", F.coalesce(anchor, F.lit(0)) + before).drop("_island")


def with_ids(entries: DataFrame, partition: list[str], order: str, step: str = "step") -> DataFrame:
    """Adds tile_id: the running sum of the id steps."""
    return entries.withColumn("tile_id", F.sum(step).over(Window.partitionBy(*partition).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


BOUNDS = ("min_lon_e7", "max_lon_e7", "min_lat_e7", "max_lat_e7")


def with_bounds(tiles: DataFrame) -> DataFrame:
    """Tiles with their bounds (_t: lon0, lon1, lat0, lat1), worked out once a tile rather than once a pair."""
    return tiles.withColumn("_t", tile_bounds_e7(F.col("z"), F.col("x"), F.col("y")))


def covers(head: str = "") -> Column:
    """Whether an archive's zooms and bounds (inclusive, in 1e-7 degrees) meet a tile of with_bounds."""
    h = lambda c: F.col(head + c)
    return F.col("z").between(h("min_zoom"), h("max_zoom")) & (F.col("_t.lon1") >= h("min_lon_e7")) & (F.col("_t.lon0") <= h("max_lon_e7")) & (F.col("_t.lat1") >= h("min_lat_e7")) & (F.col("_t.lat0") <= h("max_lat_e7"))


def covered(tiles: DataFrame, headers: DataFrame) -> DataFrame:
    """Tiles that some archive covers. headers is a table of a few archives; it is broadcast only as far as the session's
    threshold allows."""
    h = headers.select("min_zoom", "max_zoom", *BOUNDS)
    return with_bounds(tiles).join(h, covers(), "left_semi").drop("_t")


def world_floor_complete(headers: DataFrame) -> DataFrame:
    """One row (complete): z0 and the four corners of z6 are all covered."""
    corners = headers.sparkSession.createDataFrame([(0, 0, 0), (6, 0, 0), (6, 63, 0), (6, 0, 63), (6, 63, 63)], "z int, x long, y long")
    return covered(corners, headers).agg((F.count("*") == 5).alias("complete"))


def local_entry(tiles: DataFrame, archives: DataFrame, entries: DataFrame) -> DataFrame:
    """(z, x, y, path, offset, length): of the archives that cover a tile and hold it, the first in list order.
    archives: headers with archive_order."""
    if "tile_id" not in tiles.columns:
        tiles = tiles.withColumn("tile_id", hilbert_id(F.col("z"), F.col("x"), F.col("y")))
    wanted = with_bounds(tiles)
    h = archives.select("path", "archive_order", *(F.col(c).alias(f"_{c}") for c in ("min_zoom", "max_zoom", *BOUNDS)))
    pairs = wanted.join(h, covers("_")).select("z", "x", "y", "tile_id", "path", "archive_order")
    held = locate_entries(pairs, entries, ["path"])
    best = F.min_by(F.struct("path", "offset", "length"), "archive_order").alias("b")
    return held.groupBy("z", "x", "y").agg(best).select("z", "x", "y", "b.*")


def resolve(tiles: DataFrame, cache: DataFrame, archives: DataFrame, entries: DataFrame, remote: DataFrame | None = None) -> DataFrame:
    """(z, x, y, source, path, offset, length): cache, else local, else remote, else miss. cache: (tile_id, length), length
    0 for a tile known to be empty, which keeps it from being asked for remotely. remote: (z, x, y, offset, length); None
    for local sources only."""
    # written once: the ids would otherwise be worked out again in every condition that uses them
    wanted = materialize(tiles.select("z", "x", "y").distinct().withColumn("tile_id", hilbert_id(F.col("z"), F.col("x"), F.col("y"))), "wanted")
    rows = wanted.join(cache.select("tile_id", F.col("length").alias("c_length")), "tile_id", "left")
    local = local_entry(wanted, archives, entries).withColumnsRenamed({"offset": "l_offset", "length": "l_length"})
    rows = rows.join(local, ["z", "x", "y"], "left")
    if remote is not None:
        rows = rows.join(remote.select("z", "x", "y", F.col("offset").alias("r_offset"), F.col("length").alias("r_length")), ["z", "x", "y"], "left")
    else:
        rows = rows.withColumn("r_offset", F.lit(None).cast("long")).withColumn("r_length", F.lit(None).cast("long"))
    hit, own, far = F.col("c_length") > 0, F.col("l_offset").isNotNull(), F.col("r_offset").isNotNull() & (F.coalesce("c_length", F.lit(-1)) != 0)
    source = F.when(hit, "cache").when(own, "local").when(far, "remote").otherwise("miss")
    pick = lambda a, b: F.when(F.col("source") == "local", F.col(a)).when(F.col("source") == "remote", F.col(b))
    rows = rows.withColumn("source", source)
    return rows.select("z", "x", "y", "source", F.when(F.col("source") == "local", F.col("path")).alias("path"), pick("l_offset", "r_offset").alias("offset"), F.coalesce(pick("l_length", "r_length"), F.when(F.col("source") == "cache", F.col("c_length"))).alias("length"))


def distinct_reads(resolved: DataFrame) -> DataFrame:
    """The blobs to read: one row for each (path, offset, length), however many tiles share it."""
    return resolved.filter("offset is not null").select("path", "offset", "length").distinct()


def put_tiles(cache: DataFrame, new: DataFrame) -> DataFrame:
    """The cache with the new tiles; ids that it has stay as they are."""
    return cache.unionByName(new.dropDuplicates(["tile_id"]).join(cache.select("tile_id"), "tile_id", "left_anti"))


def newest_build(available: DataFrame, today: Column, days: int = 8) -> DataFrame:
    """(build): the newest of the last `days` dates that is available. available: (build date)."""
    recent = available.sparkSession.range(1).select(F.explode(F.sequence(today, F.date_sub(today, days - 1), F.expr("interval -1 day"))).alias("build"))
    return recent.join(available, "build", "left_semi").agg(F.max("build").alias("build"))


def build_stale(adopted: Column, today: Column, days: int = 30) -> Column:
    return F.datediff(today, adopted) >= days
