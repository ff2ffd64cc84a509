"""Queries over real archives and tiles: bytes are written from the driver's tables (geostride.plans.encode), stored below
the shared folder where a file is needed, and read back through the sources. DuckDB gives the same rows from the tables."""

from __future__ import annotations

import gzip
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geostride.operators import archive as archives
from geostride.operators import places, raster
from geostride.plans import encode
from geostride.plans.registry import query
from geostride.session import fresh_path, ship, table
from geostride.sources import bytes as raw
from geostride.sources import mvt, pmtiles

#: Features of a tile, layers in order, and their kinds.
FEATURES, LAYERS = 50, ("places", "roads", "landuse", "pois")
KINDS = {"places": ("country", "region", "locality", "neighbourhood", None), "roads": ("highway", "path", "odd"), "landuse": ("park",), "pois": ("cafe",)}


def _feature(c: int, name: str) -> tuple[str, tuple]:
    """(layer, feature) of a customer."""
    layer, k = LAYERS[c % 4], c // 4
    x, y, size = c * 37 % 4224 - 64, c * 91 % 4224 - 64, c % 90 + 10
    tags = {"kind": KINDS[layer][k % len(KINDS[layer])], "name": name if layer == "places" or k % 2 == 0 else None}
    tags = {t: v for t, v in tags.items() if v is not None}
    if layer == "places":
        return layer, (c, "point", tags, [[(x, y)]])
    if layer == "pois":
        return layer, (c, "point", tags, [[(x, y), (x + 5, y - 7)]])
    if layer == "roads":
        return layer, (c, "line", tags, [[(x, y), (x + size, y), (x + size, y + 3)], [(0, 0), (size, size)]])
    ring = [(x, y), (x + size, y), (x + size, y + size), (x, y + size), (x, y)]
    return layer, (c, "polygon", tags, [ring[:: -1 if k % 2 else 1]])


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(z, x, y, payload): customers as features, FEATURES a tile; every seventh tile ends in a damaged layer."""
    ship(spark)

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        k = int(frame["k"].iloc[0])
        found: dict[str, list] = {layer: [] for layer in LAYERS}
        for c, name in sorted(zip(frame["c_custkey"].tolist(), frame["c_name"].tolist(), strict=True)):
            layer, feature = _feature(c, name)
            found[layer].append(feature)
        body = encode.tile([(layer, 4096, fs) for layer, fs in found.items() if fs]) + b"\x1a\xff\x01" * (k % 7 == 1)
        return pd.DataFrame({"z": [10], "x": [k % 1024], "y": [k // 1024], "payload": [gzip.compress(body, mtime=0)]})

    k = F.floor(F.col("c_custkey") / FEATURES)
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name", k.alias("k")).groupBy("k").applyInPandas(pack, "z int, x long, y long, payload binary")


_case = lambda layer: "CASE k % {n} {w} END".format(n=len(KINDS[layer]), w=" ".join(f"WHEN {i} THEN {'NULL' if v is None else repr(v)}" for i, v in enumerate(KINDS[layer])))
FEATURES_SQL = f"""
c AS (SELECT c_custkey AS c, c_name, CAST(c_custkey // {FEATURES} AS BIGINT) AS tile, c_custkey // 4 AS k, c_custkey % 4 AS layer_no, c_custkey * 37 % 4224 - 64 AS x0, c_custkey * 91 % 4224 - 64 AS y0, c_custkey % 90 + 10 AS size FROM customer),
f AS (SELECT *, tile % 1024 AS x, tile // 1024 AS y, ['places','roads','landuse','pois'][CAST(layer_no AS BIGINT) + 1] AS layer,
  CASE layer_no WHEN 0 THEN {_case('places')} WHEN 1 THEN {_case('roads')} WHEN 2 THEN 'park' ELSE 'cafe' END AS kind, CASE WHEN layer_no = 0 OR k % 2 = 0 THEN c_name END AS name,
  dense_rank() OVER (PARTITION BY tile ORDER BY layer_no) - 1 AS layer_index, row_number() OVER (PARTITION BY tile, layer_no ORDER BY c) - 1 AS feature_index FROM c),
p AS (SELECT *, part.p AS part_index, CASE layer_no WHEN 0 THEN 1 WHEN 1 THEN 3 - part.p WHEN 2 THEN 5 ELSE 2 END AS points,
  CASE WHEN layer_no = 1 AND part.p = 1 THEN 0 ELSE x0 END AS first_x, CASE WHEN layer_no <> 2 THEN 0 WHEN k % 2 = 0 THEN 2 * size * size ELSE -2 * size * size END AS area2
  FROM f, range(2) part(p) WHERE part.p = 0 OR layer_no = 1)
"""
PART_SQL = "x, y, layer, CAST(layer_index AS INTEGER) AS layer_index, CAST(feature_index AS INTEGER) AS feature_index, c AS feature_id, CASE layer_no WHEN 1 THEN 'line' WHEN 2 THEN 'polygon' ELSE 'point' END AS geom, CAST(part_index AS INTEGER) AS part_index, kind, name, CAST(points AS INTEGER) AS points, CAST(first_x AS INTEGER) AS first_x, CAST(area2 AS BIGINT) AS area2, layer_no <> 2 OR area2 > 0 AS is_outer"
PART = ("x", "y", "layer", "layer_index", "feature_index", "feature_id", "geom", "part_index", "kind", "name")


def _part_rows(parts: DataFrame) -> DataFrame:
    return parts.filter("error is null").select(*PART, F.size("pts").alias("points"), F.col("pts")[0]["x"].alias("first_x"), "area2", "is_outer")


@query(f"WITH {FEATURES_SQL} SELECT {PART_SQL} FROM p")
def decoded_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part of every feature, decoded from compressed tiles."""
    return _part_rows(mvt.decode_tiles(tiles(spark, sf_dir)))


@query(f"WITH {FEATURES_SQL} SELECT {PART_SQL} FROM p WHERE layer IN ('landuse', 'places')")
def decoded_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of two layers; bodies of the others are skipped."""
    return _part_rows(mvt.decode_tiles(tiles(spark, sf_dir), layers=["places", "landuse"]))


@query(f"WITH {FEATURES_SQL} SELECT {PART_SQL} FROM p")
def decode_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through the table function."""
    mvt.register(spark)
    tiles(spark, sf_dir).createOrReplaceTempView("geostride_tiles")
    return _part_rows(spark.sql("SELECT t.x, t.y, d.* FROM geostride_tiles t, LATERAL decode_mvt(t.payload) d"))


@query(f"""WITH {FEATURES_SQL} SELECT count(DISTINCT (tile, layer_no)) AS layers, count(DISTINCT c) AS features, count(*) AS parts, CAST(sum(points) AS BIGINT) AS points, CAST(max(points) AS INTEGER) AS most_points,
  (SELECT count(DISTINCT tile) FROM c WHERE tile % 7 = 1) AS damaged FROM p""")
def decoder_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the decoder met."""
    return mvt.decoder_stats(mvt.decode_tiles(tiles(spark, sf_dir)))


@query(f"WITH {FEATURES_SQL} SELECT DISTINCT x, y FROM c JOIN f USING (c) WHERE f.tile % 7 = 1")
def quarantined_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The damaged tiles, once each."""
    return mvt.quarantine(mvt.decode_tiles(tiles(spark, sf_dir))).select("x", "y")


STYLE_SQL = "CASE WHEN layer = 'pois' THEN 'poi' WHEN kind = 'neighbourhood' THEN 'hood' ELSE kind END"


@query(f"""WITH {FEATURES_SQL} SELECT x, y, c AS feature_id, {STYLE_SQL} AS style, name, CAST(first_x / 4096.0::DOUBLE AS FLOAT) AS fx, CAST(y0 / 4096.0::DOUBLE AS FLOAT) AS fy
FROM p WHERE layer IN ('places', 'pois') AND kind IS NOT NULL AND name IS NOT NULL AND first_x BETWEEN 0 AND 4095 AND y0 BETWEEN 0 AND 4095""")
def tile_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels: named points of a labelled style that lie in their tile, not in its buffer."""
    return places.captured_labels(places.with_style(mvt.decode_tiles(tiles(spark, sf_dir)))).select("x", "y", "feature_id", "style", "name", "fx", "fy")


@query(f"""WITH {FEATURES_SQL} SELECT 10 AS z, round(x + first_x / 4096.0::DOUBLE, 9) AS fx, round(y + y0 / 4096.0::DOUBLE, 9) AS fy, {STYLE_SQL} AS rank, name FROM p WHERE layer = 'places' AND kind IN ('locality', 'neighbourhood')""")
def tile_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fine places by rank, those in a tile's buffer too."""
    found = places.places_of(places.with_style(mvt.decode_tiles(tiles(spark, sf_dir), layers=["places"])), ("hood", "locality"))
    return found.select("z", F.round("fx", 9).alias("fx"), F.round("fy", 9).alias("fy"), "rank", "name")


#: Parts of an archive, and entries of one of its leaves.
ENTRIES, LEAF = 500, 64


def stored(spark: SparkSession, sf_dir: str) -> str:
    """A folder of archives: parts as entries with a run of one to three tiles, brand and size as payload; every fifth
    archive has lost its last byte."""
    ship(spark)
    folder = fresh_path(spark, "archives")

    def write(frame: pd.DataFrame) -> pd.DataFrame:
        a = int(frame["a"].iloc[0])
        rows = {(p * 4, 1 + p % 3): f"{brand}-{size}".encode() for p, brand, size in zip(frame["p_partkey"].tolist(), frame["p_brand"], frame["p_size"].tolist(), strict=True)}
        body = encode.archive(rows, LEAF, zooms=(0, 12))
        store, path = raw.filesystem(f"{folder}/{a:06d}.pmtiles")
        store.create_dir(path.rpartition("/")[0], recursive=True)
        with store.open_output_stream(path) as out:
            out.write(body[:-1] if a % 5 == 4 else body)
        return pd.DataFrame({"a": [a]})

    a = F.floor(F.col("p_partkey") / ENTRIES)
    table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", a.alias("a")).groupBy("a").applyInPandas(write, "a long").count()
    return folder


def _read(spark: SparkSession, folder: str, what: str, **options) -> DataFrame:
    pmtiles.register(spark)
    rows = spark.read.format("pmtiles").options(path=f"{folder}/*.pmtiles", what=what, partitions="4", **options).load()
    return rows.withColumn("a", F.regexp_extract("path", "([0-9]+)[.]pmtiles$", 1).cast("long"))


STORED_SQL = f"""
s AS (SELECT CAST(p_partkey // {ENTRIES} AS BIGINT) AS a, p_partkey * 4 AS tile_id, 1 + p_partkey % 3 AS run_length, p_brand || '-' || p_size AS payload FROM part),
b AS (SELECT a, payload, min(tile_id) AS first_id, length(payload) AS length FROM s GROUP BY a, payload),
o AS (SELECT *, CAST(coalesce(sum(length) OVER (PARTITION BY a ORDER BY first_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM b)
"""


@query(f"""WITH {STORED_SQL} SELECT s.a, CASE WHEN s.a % 5 < 4 THEN count(*) END AS n_entries, CASE WHEN s.a % 5 < 4 THEN count(DISTINCT payload) END AS n_contents,
  CASE WHEN s.a % 5 < 4 THEN 0 END AS min_zoom, CASE WHEN s.a % 5 < 4 THEN 12 END AS max_zoom, s.a % 5 = 4 AS damaged FROM s GROUP BY s.a""")
def archive_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each archive found, with the reason where its header can't be taken."""
    rows = _read(spark, stored(spark, sf_dir), "header")
    return rows.select("a", "n_entries", "n_contents", "min_zoom", "max_zoom", F.col("error").isNotNull().alias("damaged"))


@query(f"""WITH {STORED_SQL} SELECT a, tile_id, CAST(run_length AS BIGINT) AS run_length, CAST(length AS BIGINT) AS length, "offset" FROM s JOIN o USING (a, payload) WHERE a % 5 < 4""")
def archive_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of root and leaf directories."""
    return _read(spark, stored(spark, sf_dir), "entries", skip_damaged="true").select("a", "tile_id", "run_length", "length", "offset")


@query(f"""WITH {STORED_SQL} SELECT a, "offset", CAST(length AS BIGINT) AS length, payload FROM o WHERE a % 5 < 4""")
def archive_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored blobs, each once however many entries share it."""
    return _read(spark, stored(spark, sf_dir), "blobs", skip_damaged="true").select("a", "offset", "length", F.col("payload").cast("string").alias("payload"))


@query(f"""WITH {STORED_SQL}, q AS (SELECT DISTINCT CAST(l_partkey AS BIGINT) * 4 + l_linenumber % 4 AS tile_id FROM lineitem)
SELECT q.tile_id, a, payload FROM q JOIN s ON q.tile_id >= s.tile_id AND q.tile_id < s.tile_id + run_length WHERE a % 5 < 4""")
def tile_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asked tiles to their bytes: entry by containment, then one read for each distinct blob."""
    entries = _read(spark, stored(spark, sf_dir), "entries", skip_damaged="true")
    asked = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") * 4 + F.col("l_linenumber") % 4).alias("tile_id")).distinct()
    asked = asked.withColumn("a", F.floor(F.col("tile_id") / (4 * ENTRIES)))
    found = archives.locate_entries(asked, entries.select("a", "tile_id", "run_length", "length", "offset"), ["a"]).join(entries.select("a", "path").distinct(), "a")
    got = found.join(pmtiles.read_blobs(archives.distinct_reads(found)), ["path", "offset", "length"])
    return got.select("tile_id", "a", F.col("payload").cast("string").alias("payload"))


@query("SELECT p_partkey AS id, p_name AS text, CAST(CASE WHEN p_partkey % 3 = 1 THEN length(p_name) ELSE 0 END AS BIGINT) AS stated FROM part")
def inflated_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts packed as zlib, gzip or raw streams and unpacked again; the length that a gzip member states."""
    from geostride.functions.scalars import gzip_isize

    @F.pandas_udf("binary")
    def packed(ids: pd.Series, texts: pd.Series) -> pd.Series:
        def one(k: int, text: str) -> bytes:
            if k % 3 == 1:
                return gzip.compress(text.encode(), mtime=0)
            c = zlib.compressobj(wbits=15 if k % 3 == 0 else -15)
            return c.compress(text.encode()) + c.flush()

        return pd.Series([one(k, t) for k, t in zip(ids, texts, strict=True)])

    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), packed("p_partkey", "p_name").alias("payload"))
    rows = rows.withColumn("stated", gzip_isize(F.col("payload")).cast("long"))
    return raw.inflated(rows, "payload").select("id", F.col("payload").cast("string").alias("text"), "stated")


@query("SELECT p_partkey AS id, p_size AS frame_class, CAST(p_partkey % 256 AS INTEGER) AS frame_id, p_name AS text, p_partkey % 9 <> 0 AS checksum_ok FROM part")
def binary_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames written between other bytes, found again; every ninth has a wrong checksum."""
    from geostride.functions.nmea import fletcher8

    byte = lambda c: F.lpad(F.hex(c), 2, "0")
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("c"), "p_name")
    size = F.octet_length("p_name")
    p = p.withColumn("body", F.concat(byte(F.col("c")), byte(F.col("id") % 256), byte(size % 256), byte(F.floor(size / 256)), F.hex("p_name")))
    bytes_ = F.transform(F.sequence(F.lit(0), (F.length("body") / 2).cast("int") - 1), lambda i: F.conv(F.substring("body", i * 2 + 1, F.lit(2)), 16, 10).cast("int"))
    p = p.withColumn("k", fletcher8(bytes_))
    wrong = F.when(F.col("id") % 9 == 0, (F.col("k.a") + 1) % 256).otherwise(F.col("k.a"))
    streams = p.select("id", F.unhex(F.concat(F.lit("00B500"), F.lit("B562"), F.col("body"), byte(wrong), byte(F.col("k.k")), F.lit("2447"))).alias("content"))
    return mvt.ubx_frames(streams).select("id", "frame_class", "frame_id", F.col("payload").cast("string").alias("text"), "checksum_ok")


@query("""SELECT s_suppkey AS id, CAST((1 + s_suppkey % 20) * (1 + s_suppkey % 13) AS INTEGER) AS water, CAST(4 * (1 + s_suppkey % 30) AS INTEGER) AS road, CAST(1024 - (1 + s_suppkey % 20) * (1 + s_suppkey % 13) - 6 * (1 + s_suppkey % 30) AS INTEGER) AS bare FROM supplier""")
def rendered_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of tiles with a pond and a road each, on whole pixels: pure water, pure road (its rim is blended), and bare."""
    k = F.col("s_suppkey")
    px = 128  # a pixel in tile units
    at = lambda x, y: F.struct(x.cast("int").alias("x"), F.lit(y).cast("int").alias("y") if isinstance(y, int) else y.cast("int").alias("y"))
    right, low = (5 + 1 + k % 20) * px, (5 + 1 + k % 13) * px
    pond = F.struct(F.lit("water").alias("layer"), F.lit("water").alias("style"), F.lit("polygon").alias("geom"), F.array(at(F.lit(5 * px), 5 * px), at(right, 5 * px), at(right, low), at(F.lit(5 * px), low), at(F.lit(5 * px), 5 * px)).alias("pts"))
    road = F.struct(F.lit("roads").alias("layer"), F.lit("major").alias("style"), F.lit("line").alias("geom"), F.array(at(F.lit(2 * px), 28 * px), at((2 + 1 + k % 30) * px, 28 * px)).alias("pts"))
    rows = table(spark, sf_dir, "supplier").select(F.lit(10).alias("z"), k.alias("x"), F.lit(0).cast("long").alias("y"), F.explode(F.array(road, pond)).alias("p"))
    parts = rows.select("z", "x", "y", "p.*", F.lit(0).alias("feature_index"), F.lit(0).alias("part_index"), F.lit(4096).alias("extent"), F.lit(None).cast("string").alias("error"))
    drawn = raster.render(parts, 32).withColumn("h", F.regexp_replace(F.hex("pixels"), "(.{4})", ",$1,"))
    count = lambda c: ((F.length("h") - F.length(F.replace(F.col("h"), F.lit(f",{c},"), F.lit("")))) / 6).cast("int")
    of = lambda rgb: int(raster.pack565(np.array(rgb))).to_bytes(2, "little").hex().upper()
    return drawn.select(F.col("x").alias("id"), count(of(places.PALETTE["water"][0])).alias("water"), count(of(places.PALETTE["major"][0])).alias("road"), count(of((228, 226, 220))).alias("bare"))
