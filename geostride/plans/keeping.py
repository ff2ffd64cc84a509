"""Queries over what a device writes and reads back, over survey tables, grids and outlines, and over small functions."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geostride.functions import compass, geo, scalars, sun, tiles
from geostride.operators import archive, coverage, magnet, places, policies, raster, rings, state, waypoints, wifi
from geostride.plans.queries import HEADS_SQL, SQUARE_SQL, _square, heads, observations
from geostride.plans.registry import query
from geostride.plans.surrogates import CUSTOMERS_SQL, EVENTS_SQL, FX, FY, HILBERT, SEQ_SQL, customers, events, line_seq
from geostride.session import fresh_path, table
from geostride.sources import bytes as raw
from geostride.sources import tables

r6 = lambda c: F.round(c, 6)

OBS_SQL = f"""
o AS (SELECT l_partkey AS id, l_orderkey % 2 AS half, {SEQ_SQL} AS seq, -60 - CAST(l_orderkey % 40 AS INTEGER) AS rssi,
  42.0::DOUBLE + (l_partkey % 100) / 1000.0::DOUBLE + (l_orderkey * 31 % 97) / 97.0::DOUBLE * (CASE WHEN l_partkey % 7 = 0 THEN 0.01::DOUBLE ELSE 0.0005::DOUBLE END) AS lat,
  -83.0::DOUBLE + (l_partkey % 89) / 1000.0::DOUBLE + (l_orderkey * 17 % 89) / 89.0::DOUBLE * 0.0005::DOUBLE AS lon FROM lineitem),
f AS (SELECT *, CAST(lat AS FLOAT) AS flat, CAST(lon AS FLOAT) AS flon FROM o WHERE rssi >= -88),
x AS (SELECT *, count(*) OVER w AS k, sqrt(pow(CAST(max(flon) OVER w - min(flon) OVER w AS DOUBLE) * 111320.0::DOUBLE * cos(radians(lat)), 2) + pow(CAST(max(flat) OVER w - min(flat) OVER w AS DOUBLE) * 111320.0::DOUBLE, 2)) AS extent FROM f WINDOW w AS (PARTITION BY id, half ORDER BY seq ROWS UNBOUNDED PRECEDING)),
a AS (SELECT id, half, count(*) AS n, sum(lat) AS sum_lat, sum(lon) AS sum_lon, min(flat) AS min_lat, max(flat) AS max_lat, min(flon) AS min_lon, max(flon) AS max_lon, CAST(max(rssi) AS INTEGER) AS best_rssi, bool_or(k >= 3 AND extent > 400) AS mobile FROM x GROUP BY id, half)
"""


@query(f"""WITH {OBS_SQL}, j AS (SELECT id, sum(n) AS n, sum(sum_lat) AS sum_lat, sum(sum_lon) AS sum_lon, min(min_lat) AS min_lat, max(max_lat) AS max_lat, min(min_lon) AS min_lon, max(max_lon) AS max_lon, max(best_rssi) AS best_rssi, bool_or(mobile) AS mobile FROM a GROUP BY id)
SELECT id, CAST(n AS BIGINT) AS n, round(sum_lat / n, 7) AS lat, min_lat, max_lon, best_rssi, mobile OR (n >= 3 AND sqrt(pow(CAST(max_lon - min_lon AS DOUBLE) * 111320.0::DOUBLE * cos(radians(sum_lat / n)), 2) + pow(CAST(max_lat - min_lat AS DOUBLE) * 111320.0::DOUBLE, 2)) > 400) AS mobile FROM j""")
def survey_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two halves of a survey folded into one table."""
    o = observations(spark, sf_dir)
    half = lambda k: wifi.learn(o.filter(F.col("scan_id") % 2 == k))
    return wifi.fold(half(0), half(1)).select("id", "n", F.round(F.col("sum_lat") / F.col("n"), 7).alias("lat"), "min_lat", "max_lon", "best_rssi", "mobile")


@query(f"""WITH {OBS_SQL} SELECT id, n AS obs, round(sum_lat / n, 7) AS lat, round(sum_lon / n, 7) AS lon, round(CAST(min_lat AS DOUBLE), 4) AS min_lat, best_rssi, CAST(mobile AS INTEGER) AS mobile FROM a WHERE half = 0""")
def access_point_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The survey's file, written whole, put in place, and read back."""
    path = fresh_path(spark, "apdb") + ".csv"
    tables.replace_ap_database(wifi.learn(observations(spark, sf_dir).filter("scan_id % 2 = 1")), path)  # replaced by the next
    tables.replace_ap_database(wifi.learn(observations(spark, sf_dir).filter("scan_id % 2 = 0")), path)
    return tables.read_ap_database(spark, path).filter("not bad").select("id", "obs", F.round("lat", 7).alias("lat"), F.round("lon", 7).alias("lon"), F.round(F.col("min_lat").cast("double"), 4).alias("min_lat"), "best_rssi", "mobile")


@query(f"""WITH e AS ({EVENTS_SQL}), s AS (SELECT device, seq, seq % 30 / 1.0::DOUBLE AS took, seq % 11 / 20000.0::DOUBLE AS d, lat, seq % 3 <> 0 AS fine FROM e)
SELECT device, seq FROM s WHERE fine AND sqrt(pow(d * 111320.0::DOUBLE * cos(radians(lat)), 2) + pow(d * 111320.0::DOUBLE, 2)) <= 12 / 3.6::DOUBLE * took + 10""")
def usable_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scans that moved little enough to learn from."""
    s = F.col("seq")
    d = s % 11 / 20000.0
    rows = events(spark, sf_dir).select("device", "seq", "lat", "lon", (F.col("lat") - d).alias("start_lat"), (F.col("lon") - d).alias("start_lon"), (s % 30).cast("double").alias("took_s"), (s % 3 != 0).alias("end_fine"))
    return wifi.usable_scans(rows).select("device", "seq")


@query("SELECT o_orderkey AS id, o_orderkey % 800 >= 400 OR (o_orderkey % 800 > 0 AND o_custkey % 300 >= 180) AS flush, o_custkey % 7 = 0 OR o_orderkey % 100 <= 72 AS assist, o_custkey % 60 / 10.0::DOUBLE > 0.2 AND o_custkey % 60 / 10.0::DOUBLE < 5 AND o_orderkey % 2000 < 1000 AS calibration FROM orders")
def kept_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When a table is flushed, whether assistance data are young enough, whether a calibration is plausible."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    scale = c % 60 / 10.0
    saved = F.when(c % 7 == 0, 0).otherwise(1_000_000_000)
    return table(spark, sf_dir, "orders").select(
        o.alias("id"), wifi.flush_due(o % 800, c % 300).alias("flush"), tables.assist_usable(saved, F.lit(1_000_000_000) + o % 100 * 3600).alias("assist"),
        tables.calibration_plausible([o % 2000 * 1.0, F.lit(0.0), -(o % 2000) * 1.0], [scale, F.lit(1.0), scale]).alias("calibration"),
    )


MAG_SQL = f"e AS ({EVENTS_SQL}), m AS (SELECT *, us // 1000 AS ms, seq % 64 / 2.0::DOUBLE AS v, row_number() OVER (PARTITION BY device ORDER BY us // 1000, seq) AS rn FROM e)"


@query(f"WITH {MAG_SQL} SELECT ms, v AS speed_kmh, v * 10 AS heading_deg, v AS mag_raw_x, CAST(seq % 20 AS INTEGER) AS sats, CAST(seq % 2 AS INTEGER) AS calibrated FROM m")
def magnetometer_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as lines with its fixed decimals, appended as CSV, and read back."""
    path = fresh_path(spark, "maglog")
    tables.append_mag_log(_mag_rows(spark, sf_dir).filter("seq % 2 = 0"), path)
    tables.append_mag_log(_mag_rows(spark, sf_dir).filter("seq % 2 = 1"), path)
    return tables.read_mag_log(spark, path).select("ms", "speed_kmh", "heading_deg", "mag_raw_x", "sats", "calibrated")


def _mag_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("seq")
    v = s % 64 / 2.0
    plain = {c: v for c in tables.MAG_HEADER.split(",")[3:]} | {"heading_deg": v * 10, "sats": (s % 20).cast("int"), "mode": F.lit(3), "calibrated": (s % 2).cast("int")}
    return events(spark, sf_dir).select("device", "seq", F.floor(F.col("us") / 1000).alias("ms"), F.lit("120000").alias("utc"), F.lit("010124").alias("date"), *(c.alias(n) for n, c in plain.items()))


@query(f"WITH {MAG_SQL}, b AS (SELECT *, CAST(sum(length(device::VARCHAR) + 30) OVER (PARTITION BY device ORDER BY ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT) AS before FROM m) SELECT device, seq FROM b WHERE coalesce(before, 0) < 500")
def capped_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a device up to a number of bytes."""
    # a line of ms alone: device and digits padded to 29 bytes, and its end
    rows = _mag_rows(spark, sf_dir).select("device", "seq", F.col("ms").alias("t"), F.concat(F.col("device").cast("string"), F.repeat(F.lit("x"), F.lit(29))).alias("utc"))
    return tables.within_bytes(rows.withColumn("order", F.col("t") * 100_000 + F.col("seq") % 100_000), "order", 500).select("device", "seq")


@query("""WITH p AS (SELECT c_custkey - 1 AS idx, c_custkey * 1.5::DOUBLE AS lat, c_custkey * -2.5::DOUBLE AS lon, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN 1700000000 + c_custkey END AS saved FROM customer WHERE c_custkey BETWEEN 1 AND 32)
SELECT CAST(idx AS INTEGER) AS idx, lat, lon, name[1:23] AS name, CAST(coalesce(saved, -1) AS BIGINT) AS saved_utc FROM p""")
def waypoint_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved points written as a file and read back."""
    k = F.col("c_custkey")
    p = table(spark, sf_dir, "customer").filter(k.between(1, 32)).select((k - 1).cast("int").alias("idx"), (k * 1.5).alias("lat"), (k * -2.5).alias("lon"), F.col("c_name").alias("name"), F.when(k % 2 == 0, 1_700_000_000 + k).alias("saved_utc"))
    path = fresh_path(spark, "waypoints") + ".bin"
    tables.write_waypoints(p, path)
    return tables.read_waypoints(spark, path).drop("path").withColumn("saved_utc", F.coalesce("saved_utc", F.lit(-1)))


@query("""WITH p AS (SELECT CAST(c_custkey - 1 AS INTEGER) AS idx, c_name AS name FROM customer WHERE c_custkey BETWEEN 1 AND 5),
a AS (SELECT idx, name FROM p UNION ALL SELECT 5, 'pin 6' UNION ALL SELECT 6, 'home') SELECT CAST(CASE WHEN idx > 2 THEN idx - 1 ELSE idx END AS INTEGER) AS idx, name, idx = 4 AS is_target FROM a WHERE idx <> 2""")
def waypoint_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points added (one without a name, one from a fix, one refused), one removed, and the target that moves up with it."""
    k = F.col("c_custkey")
    p = table(spark, sf_dir, "customer").filter(k.between(1, 5)).select((k - 1).cast("int").alias("idx"), k.cast("double").alias("lat"), k.cast("double").alias("lon"), F.col("c_name").alias("name"), F.lit(None).cast("long").alias("saved_utc"))
    p = waypoints.add(p, 1.0, 2.0, None)
    p = waypoints.add_from_fix(p, {"status": "A", "lat": 3.0, "lon": 4.0}, "home")
    p = waypoints.remove(waypoints.add_from_fix(p, {"status": "V", "lat": 3.0, "lon": 4.0}, "nowhere"), 2)
    target = waypoints.set_target(p, waypoints.target_after_remove(4, 2)).select(F.col("idx").alias("t"))
    return p.join(F.broadcast(target), p["idx"] == F.col("t"), "left").select("idx", "name", F.col("t").isNotNull().alias("is_target"))


@query(f"""WITH c AS ({CUSTOMERS_SQL}), e AS ({EVENTS_SQL}), t AS (SELECT lat AS tlat, lon AS tlon, c_name FROM c JOIN customer ON id = c_custkey WHERE id = 1),
h AS (SELECT *, pow(sin(radians(tlat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(tlat)) * pow(sin(radians(tlon - lon) / 2), 2) AS hv FROM e, t WHERE status = 'A'),
m AS (SELECT *, 2 * 6371008.8::DOUBLE * atan2(sqrt(hv), sqrt(1 - hv)) AS metres FROM h) SELECT device, seq, c_name || ': ' AS starts, metres >= 1000 AS far FROM m""")
def target_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text to the point aimed at: its name first, kilometres from 1000 m on."""
    c = customers(spark, sf_dir).join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), "id").select((F.col("id") - 1).cast("int").alias("idx"), "lat", "lon", "name")
    rows = waypoints.target_range(events(spark, sf_dir), waypoints.set_target(c, 0))
    return rows.select("device", "seq", F.regexp_extract("text", "^[^:]*: ", 0).alias("starts"), F.col("text").contains(" km ").alias("far"))


@query("SELECT CAST(max(CAST(o_orderdate AS DATE)) AS VARCHAR) AS build, date_diff('day', max(CAST(o_orderdate AS DATE)), DATE '1998-08-05') >= 30 AS stale FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1998-07-29' AND DATE '1998-08-05'")
def newest_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest build of the last eight days, and whether it is stale."""
    available = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("build")).distinct()
    today = F.lit("1998-08-05").cast("date")
    return archive.newest_build(available, today).select(F.col("build").cast("string").alias("build"), archive.build_stale(F.col("build"), today).alias("stale"))


@query("SELECT CAST(n_nationkey AS INTEGER) AS feature, 0 AS polygon, CAST(r AS INTEGER) AS ring, 4 + n_regionkey AS points, n_nationkey + r / 2.0::DOUBLE AS x0 FROM nation, range(2) t(r) WHERE r = 0 OR n_nationkey % 3 = 0")
def geojson_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings of polygons written as GeoJSON and read back."""
    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey").orderBy("n_nationkey").collect()  # 25 rows
    ring = lambda n, k, r: [[n + r / 2, float(j)] for j in range(4 + k)]
    shape = lambda n, k: [ring(n, k, r) for r in ((0, 1) if n % 3 == 0 else (0,))]
    features = [{"geometry": {"type": "MultiPolygon" if n % 2 else "Polygon", "coordinates": [shape(n, k)] if n % 2 else shape(n, k)}} for n, k in map(tuple, rows)]
    path = fresh_path(spark, "geojson")
    spark.createDataFrame([(json.dumps({"features": features}),)], "value string").coalesce(1).write.text(path)
    out = tables.read_geojson_rings(spark, path)
    return out.select("feature", "polygon", "ring", F.size("pts").cast("long").alias("points"), F.col("pts")[0]["x"].alias("x0"))


@query("SELECT o_orderkey AS id, round(o_custkey / 4.0::DOUBLE * CASE o_orderkey % 5 WHEN 0 THEN 1e-9 WHEN 1 THEN 1e-6 WHEN 2 THEN 1e-3 WHEN 3 THEN 1.0 ELSE 1e3 END, 12) AS gb FROM orders")
def archive_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes out of a tool's lines, in gigabytes."""
    o = F.col("o_orderkey")
    unit = F.element_at(F.array(*map(F.lit, ("B", "KB", "MB", "GB", "TB"))), (o % 5 + 1).cast("int"))
    line = F.format_string("fetching 12 dirs, archive size of %.2f %s, done", F.col("o_custkey") / 4.0, unit)
    return table(spark, sf_dir, "orders").select(o.alias("id"), F.round(scalars.size_gb(line), 12).alias("gb"))


@query(f"WITH RECURSIVE t AS (SELECT (x * 64 + y) * 8 + z AS k, z::INTEGER AS z, x, y FROM range(7) a(z), range(64) b(x), range(64) c(y) WHERE x < 1::BIGINT << z AND y < 1::BIGINT << z), {HILBERT} SELECT ids.tile_id, t.z, t.x, t.y FROM t JOIN ids USING (k)")
def world_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tiles of zooms 0 to 6 with their ids."""
    return coverage.world_floor(spark)


@query(f"""WITH {HEADS_SQL}, w AS (SELECT -3::INTEGER AS z0), c(z, x, y) AS (VALUES (0, 0::BIGINT, 0::BIGINT), (6, 0, 0), (6, 63, 0), (6, 0, 63), (6, 63, 63))
SELECT count(*) = 5 AS complete FROM c WHERE EXISTS (SELECT 1 FROM heads WHERE z BETWEEN 0 AND max_zoom AND -1800000000 + (3600000000::BIGINT * (x + 1)) // (1::BIGINT << z) >= -1800000000 AND -1800000000 + (3600000000::BIGINT * x) // (1::BIGINT << z) <= 1800000000)""")
def floor_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the archives, taken as whole worlds, cover zoom 0 and the corners of zoom 6."""
    h = heads(spark, sf_dir).withColumns({"min_zoom": F.lit(0), "min_lon_e7": F.lit(-1800000000).cast("long"), "max_lon_e7": F.lit(1800000000).cast("long"), "min_lat_e7": F.lit(-900000000).cast("long"), "max_lat_e7": F.lit(900000000).cast("long")})
    return archive.world_floor_complete(h)


@query(f"""WITH p AS (SELECT *, {FX.format(n=16384)} AS fx, {FY.format(n=16384)} AS fy FROM ({CUSTOMERS_SQL})),
g AS (SELECT id, v, CAST(s AS INTEGER) AS slot, (CAST(floor(fx + v * 0.8::DOUBLE - 0.5) AS BIGINT) + s % 2 + 16384) % 16384 AS x, CAST(floor(fy - 0.5) AS BIGINT) + s // 2 AS y FROM p, range(4) r(s), range(2) q(v))
SELECT n.id, n.slot, n.x, n.y FROM g n WHERE v = 1 AND y BETWEEN 0 AND 16383 AND NOT EXISTS (SELECT 1 FROM g o WHERE o.v = 0 AND o.id = n.id AND o.x = n.x AND o.y = n.y)""")
def grid_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles to draw when each customer's grid moves east by most of a tile."""
    c = customers(spark, sf_dir)
    moved = c.withColumn("lon", F.col("lon") + 0.8 * 360 / 16384)
    return coverage.grid_jobs(coverage.visible_tiles(c, 14), coverage.visible_tiles(moved, 14), ["id"]).select("id", "slot", "x", "y")


@query("SELECT l_orderkey AS id, l_linenumber % 4 AS slot, l_orderkey % 3 AS generation, l_partkey AS tile FROM lineitem WHERE l_orderkey % 3 = l_linenumber % 3 AND l_partkey % 50 = l_orderkey % 50")
def accepted_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results whose generation and tile are still those of their slot."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    z = F.lit(14)
    results = li.select(F.col("l_orderkey").alias("id"), (F.col("l_linenumber") % 4).alias("slot"), (F.col("l_linenumber") % 3).cast("long").alias("generation"), z.alias("z"), (F.col("l_partkey") % 50).alias("x"), F.lit(0).cast("long").alias("y"), F.col("l_partkey").alias("tile"))
    slots = o.withColumn("slot", F.explode(F.array(*map(F.lit, range(4))))).select("id", "slot", (F.col("id") % 3).alias("generation"), z.alias("z"), (F.col("id") % 50).alias("x"), F.lit(0).cast("long").alias("y"))
    return coverage.accept_results(slots, results, ["id"]).select("id", F.col("slot").cast("long").alias("slot"), "generation", "tile")


@query("SELECT tile_id, length FROM (SELECT DISTINCT o_custkey * 3 AS tile_id, 7::BIGINT AS length FROM orders UNION ALL (SELECT DISTINCT l_partkey * 2, CAST(l_partkey % 5 AS BIGINT) FROM lineitem WHERE l_partkey * 2 NOT IN (SELECT o_custkey * 3 FROM orders)))")
def cache_put(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache with new tiles; ids that it holds keep theirs."""
    held = table(spark, sf_dir, "orders").select((F.col("o_custkey") * 3).alias("tile_id"), F.lit(7).cast("long").alias("length")).distinct()
    new = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") * 2).alias("tile_id"), (F.col("l_partkey") % 5).cast("long").alias("length"))
    return archive.put_tiles(held, new)


@query("""WITH v AS (SELECT label AS device, vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS k FROM embeddings),
s AS (SELECT *, CASE WHEN k < 128 THEN k ELSE k // 4 % 128 END AS slot FROM v WHERE k < 128 OR k % 4 = 0)
SELECT device, CAST(slot AS INTEGER) AS slot, arg_max(x, k) AS x, arg_max(y, k) AS y, arg_max(z, k) AS z FROM s GROUP BY device, slot""")
def kept_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points that a fit is judged by."""
    return magnet.kept_points(_readings(spark, sf_dir))


def _readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("device"), F.col("vec_id").alias("seq"), *(F.col("embedding")[k].cast("double").alias(a) for k, a in enumerate("xyz")))


@query("""WITH v AS (SELECT label AS device, CASE WHEN vec_id % 2 = 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS w, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings)
SELECT device, count(*) AS n, round(sum(w * (x * x)), 6) AS b_xx, round(sum(w * y), 6) AS b_y, round(sum(w * (x * x * (y * y))), 6) AS a_xx_yy, round(sum(w * (x * y)), 6) AS a_x_y FROM v GROUP BY device""")
def refined_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of a calibration refined by new readings: the old ones at half weight."""
    v = _readings(spark, sf_dir)
    merged = magnet.merge_sums(magnet.normal_equations(v.filter("seq % 2 = 0")), magnet.normal_equations(v.filter("seq % 2 = 1")))
    return merged.select("device", "n", *(r6(F.col(c)).alias(c) for c in ("b_xx", "b_y", "a_xx_yy", "a_x_y")))


@query("""WITH g AS (SELECT p_partkey AS device, p_partkey % 7 <> 0 AS ok, 1.0::DOUBLE + p_partkey % 30 / 100.0::DOUBLE AS gx, 1.0::DOUBLE + p_partkey % 40 / 100.0::DOUBLE AS ox, p_partkey % 5 <> 0 AS had FROM part)
SELECT device, ok AND (NOT had OR NOT (greatest(gx, 1.0) / least(gx, 1.0) - 1 > 0.15 AND greatest(gx, 1.0) / least(gx, 1.0) > greatest(ox, 1.0) / least(ox, 1.0))) AS accepted FROM g""")
def refined_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a refined calibration replaces the one before."""
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part")
    one = F.lit(1.0)
    fit = p.select(k.alias("device"), (k % 7 != 0).alias("ok"), (1.0 + k % 30 / 100.0).alias("gx"), one.alias("gy"), one.alias("gz"))
    before = p.filter(k % 5 != 0).select(k.alias("device"), (1.0 + k % 40 / 100.0).alias("gx"), one.alias("gy"), one.alias("gz"))
    return magnet.accept_refined(fit, before).select("device", "accepted")


@query("""SELECT p_partkey AS id, CAST(trunc(least(1.0::DOUBLE, least(p_partkey % 90 / 40.0::DOUBLE, least(p_size / 40.0::DOUBLE, 1.0::DOUBLE))) * 100) AS INTEGER) AS progress, CASE WHEN p_partkey % 3 = 0 THEN 99.0 ELSE round(greatest(1.0::DOUBLE, p_size / 10.0::DOUBLE) / least(1.0::DOUBLE, p_size / 10.0::DOUBLE) - 1, 9) END AS spread,
  CASE WHEN p_size % 10 = 0 THEN '--' ELSE ['N','NNE','NE','ENE','E','ESE','SE','SSE','S','SSW','SW','WSW','W','WNW','NW','NNW'][CAST(floor((p_partkey % 360 + 11.25) / 22.5) AS BIGINT) % 16 + 1] END AS heading,
  CASE WHEN p_size % 2 = 0 THEN greatest(30, CAST(floor(p_partkey % 256 * 40 / 100) AS INTEGER)) ELSE CAST(p_partkey % 256 AS INTEGER) END AS brightness,
  CASE WHEN p_partkey % 40 / 10.0::DOUBLE - (1 + 1.0::DOUBLE) < -0.5 THEN -1 WHEN p_partkey % 40 / 10.0::DOUBLE - (1 + 1.0::DOUBLE) >= 0.5 THEN 1 ELSE 0 END AS drift,
  round((p_partkey % 360 - 180 + 180.0::DOUBLE) / 360.0::DOUBLE, 9) AS mx, round(0.5::DOUBLE - ln((1 + sin(radians(p_size * 1.0::DOUBLE))) / (1 - sin(radians(p_size * 1.0::DOUBLE)))) / (4 * pi()), 9) AS my FROM part""")
def small_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sweep progress, gain spread, headings, idle brightness, grid drift and the logarithmic projection."""
    k, s, one = F.col("p_partkey"), F.col("p_size"), F.lit(1.0)
    zero = F.lit(0.0)
    progress = compass.sweep_progress(zero, k % 90 * 1.0, zero, s * 1.0, zero, F.lit(400.0))
    m = tiles.mercator_log(s * 1.0, k % 360 - 180)
    return table(spark, sf_dir, "part").select(
        k.alias("id"), progress.alias("progress"), F.round(compass.gain_spread(F.when(k % 3 == 0, 0.01).otherwise(one), s / 10.0, one), 9).alias("spread"),
        geo.heading_label(F.when(s % 10 == 0, -1.0).otherwise(k % 360)).alias("heading"), sun.idle_brightness((k % 256).cast("int"), s % 2 == 0).alias("brightness"),
        tiles.grid_drift(k % 40 / 10.0, F.lit(1)).alias("drift"), F.round(m["x"], 9).alias("mx"), F.round(m["y"], 9).alias("my"),
    )


_channel = lambda s, m: "((({v}) + ({v}) // 256) // 256 << {s})".format(v=f"(src >> {s} & {m}) * a + (dst >> {s} & {m}) * (255 - a) + 128", s=s)


@query(f"WITH p AS (SELECT p_partkey AS id, CAST(p_partkey * 7919 % 65536 AS BIGINT) AS dst, CAST(p_partkey * 104729 % 65536 AS BIGINT) AS src, CAST(p_partkey % 260 AS BIGINT) AS a FROM part) SELECT id, CAST(CASE WHEN a >= 255 THEN src WHEN a <= 0 THEN dst ELSE {_channel(11, 31)} | {_channel(5, 63)} | {_channel(0, 31)} END AS INTEGER) AS pixel FROM p")
def blended_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of a source over others, by coverage."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k.alias("id"), scalars.blend565((k * 7919 % 65536).cast("int"), (k * 104729 % 65536).cast("int"), (k % 260).cast("int")).alias("pixel"))


@query("""WITH f AS (SELECT user_id AS device, event_id AS seq, CASE WHEN event_id % 3 = 0 THEN 'h' || event_id % 5 END AS hood, CASE WHEN event_id % 4 = 0 THEN 'l' || event_id % 3 END AS locality, CASE WHEN event_id % 7 = 0 THEN 'x' END AS region, CASE WHEN event_id % 11 = 0 THEN CASE WHEN event_id % 2 = 0 THEN 'x' ELSE 'c' END END AS country FROM events),
h AS (SELECT device, seq, hood, last_value(locality IGNORE NULLS) OVER w AS l, last_value(region IGNORE NULLS) OVER w AS r, last_value(country IGNORE NULLS) OVER w AS c FROM f WINDOW w AS (PARTITION BY device ORDER BY seq ROWS UNBOUNDED PRECEDING))
SELECT device, seq, concat_ws(', ', hood, l, r, CASE WHEN c IS DISTINCT FROM r THEN c END) AS place FROM h""")
def held_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place's text as its names come and go."""
    s = F.col("event_id")
    f = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("device"), s.alias("seq"), F.when(s % 3 == 0, F.concat(F.lit("h"), (s % 5).cast("string"))).alias("hood"), F.when(s % 4 == 0, F.concat(F.lit("l"), (s % 3).cast("string"))).alias("locality"),
        F.when(s % 7 == 0, "x").alias("region"), F.when(s % 11 == 0, F.when(s % 2 == 0, "x").otherwise("c")).alias("country"),
    )
    return places.hold_names(f, "device", "seq").select("device", "seq", "place")


_STYLES = ", ".join(f"('{la}', {'NULL' if ki is None else repr(ki)}, '{st}', {places.DRAW_ORDER.index(la)}, {places.STROKES.get(st, 0) * 2})" for la, ki, st in places.STYLES)


@query(f"SELECT layer, kind, style, CAST(z_order AS INTEGER) AS z_order, CAST(stroke AS INTEGER) AS stroke FROM (VALUES {_STYLES}) t(layer, kind, style, z_order, stroke)")
def style_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Styles, painting order and stroke widths at 512 pixels."""
    return places.style_table(spark, 512)


@query(f"""WITH c AS (SELECT id, lat * 0.9 AS lat, lon * 0.9 AS lon, 2.0::DOUBLE + id % 5 / 2.0::DOUBLE AS d FROM ({CUSTOMERS_SQL})),
q AS (SELECT id, id % 3 <> 0 AS pointed, round_even((lon - d + 180) / 360.0::DOUBLE * 65535, 0) AS west, 0.5::DOUBLE - ln((1 + sin(radians(lat - d))) / (1 - sin(radians(lat - d)))) / (4 * pi()) AS south, 0.5::DOUBLE - ln((1 + sin(radians(lat + d))) / (1 - sin(radians(lat + d)))) / (4 * pi()) AS north FROM c)
SELECT row_number() OVER (ORDER BY CASE WHEN pointed THEN 6 ELSE 5 END DESC, id) - 1 AS ring_id, id AS ord, CASE WHEN pointed THEN 6 ELSE 5 END AS points, CAST(west AS INTEGER) AS west, CAST(round_even(south * 65535, 0) AS INTEGER) AS south, CAST(round_even(north * 65535, 0) AS INTEGER) AS north FROM q""")
def outline_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings around the customers, squares and pointed ones: projected, simplified (nothing to take away), quantised, and
    numbered by length."""
    d = 2.0 + F.col("id") % 5 / 2.0
    lat, lon = F.col("lat") * 0.9, F.col("lon") * 0.9
    p = lambda x, y: F.struct((lon + d * x).alias("x"), (lat + d * y).alias("y"))
    ring = F.when(F.col("id") % 3 == 0, F.array(p(-1, -1), p(1, -1), p(1, 1), p(-1, 1), p(-1, -1))).otherwise(F.array(p(-1, -1), p(1, -1), p(2, 0), p(1, 1), p(-1, 1), p(-1, -1)))
    out = rings.outline(customers(spark, sf_dir).select(F.col("id").alias("ord"), ring.alias("pts")))
    last = lambda k: F.col("pts")[F.size("pts") - k]
    return out.select("ring_id", "ord", F.size("pts").alias("points"), F.col("pts")[0]["x"].alias("west"), F.col("pts")[0]["y"].alias("south"), last(2)["y"].alias("north"))


@query(f"""WITH RECURSIVE m AS (SELECT id, CAST(floor({FX.format(n=64)}) AS BIGINT) AS x, CAST(floor({FY.format(n=64)}) AS BIGINT) AS y FROM ({CUSTOMERS_SQL})),
t AS (SELECT id AS k, 6 AS z, x, y FROM m), {HILBERT}, d AS (SELECT DISTINCT x, tile_id, degrees(atan(sinh(pi() * (1 - 2 * (y + 0.5::DOUBLE) / 64)))) AS lat FROM t JOIN ids USING (k))
SELECT x, round(sum((tile_id % 1000 + 1) * 1000) / 1e9::DOUBLE, 9) AS gb FROM d WHERE lat BETWEEN -85 AND 85 GROUP BY x""")
def column_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of an archive's zoom 6 by tile column (a blob for each tile that holds a customer)."""
    m = customers(spark, sf_dir).withColumn("m", tiles.mercator(F.col("lat"), F.col("lon"), F.lit(6)))
    t = m.select(tiles.hilbert_id(F.lit(6), F.floor("m.fx"), F.floor("m.fy")).alias("tile_id")).distinct()
    entries = t.select("tile_id", F.lit(1).cast("long").alias("run_length"), (F.col("tile_id") * 5000).alias("offset"), ((F.col("tile_id") % 1000 + 1) * 1000).alias("length"))
    return rings.column_bytes(entries, 6).select("x", F.round("gb", 9).alias("gb"))


@query("""SELECT a.n_nationkey AS a, b.n_nationkey AS b, greatest(a.n_nationkey * 2, b.n_nationkey * 3) AS x0, greatest(a.n_regionkey, b.n_regionkey * 2) AS y0, least(a.n_nationkey * 2 + 9, b.n_nationkey * 3 + 7) AS x1, least(a.n_regionkey + 3, b.n_regionkey * 2 + 2) AS y1
FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey WHERE greatest(a.n_nationkey * 2, b.n_nationkey * 3) < least(a.n_nationkey * 2 + 9, b.n_nationkey * 3 + 7) AND greatest(a.n_regionkey, b.n_regionkey * 2) < least(a.n_regionkey + 3, b.n_regionkey * 2 + 2)""")
def shared_rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts that rectangles of nations share."""
    n = table(spark, sf_dir, "nation")
    k, r = F.col("n_nationkey"), F.col("n_regionkey")
    box = lambda x, y, w, h: F.struct(x.alias("x0"), y.alias("y0"), (x + w).alias("x1"), (y + h).alias("y1"))
    a, b = n.select(k.alias("a"), box(k * 2, r, 9, 3).alias("p")), n.select(k.alias("b"), box(k * 3, r * 2, 7, 2).alias("q"))
    shared = a.join(b, F.col("a") < F.col("b")).withColumn("s", coverage.shared_rectangle(F.col("p"), F.col("q"))).filter("s is not null")
    return shared.select("a", "b", "s.*")


@query(f"""
WITH RECURSIVE {SQUARE_SQL}, {HEADS_SQL}, t AS (SELECT x * 1000 + y AS k, z, x, y FROM q), {HILBERT},
c AS (SELECT DISTINCT 21845 + o_custkey * 13 % 65000 AS tile_id, CASE WHEN o_custkey % 3 = 0 THEN 0 ELSE 77 END AS length FROM orders)
SELECT t.z, t.x, t.y, CASE WHEN c.length > 0 THEN 'cache' ELSE 'miss' END AS source FROM t JOIN ids USING (k) LEFT JOIN c ON c.tile_id = ids.tile_id
""")
def local_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where tiles come from without the network and with empty archives: the cache, unless it marks them empty."""
    o = table(spark, sf_dir, "orders")
    c = o.select((F.lit(21845) + F.col("o_custkey") * 13 % 65000).alias("tile_id"), F.when(F.col("o_custkey") % 3 == 0, 0).otherwise(77).alias("length")).distinct()
    none = o.limit(0).select(F.lit("").alias("path"), F.col("o_orderkey").alias("tile_id"), F.lit(1).alias("run_length"), F.col("o_orderkey").alias("offset"), F.lit(1).cast("long").alias("length"))
    return archive.resolve(_square(spark, sf_dir), c, heads(spark, sf_dir), none).select("z", "x", "y", "source")


@query("""WITH t AS (SELECT p_partkey * 3 AS tile_id, CASE WHEN p_partkey % 4 <> 0 THEN length(p_name) ELSE 0 END AS length FROM part WHERE p_partkey % 3 <> 0), q AS (SELECT DISTINCT l_partkey * 3 AS tile_id FROM lineitem)
SELECT tile_id, CASE WHEN length IS NULL OR length > 9 THEN 'miss' WHEN length = 0 THEN 'empty' ELSE 'hit' END AS found FROM q LEFT JOIN t USING (tile_id)""")
def cached_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asked tiles in the cache of the build in use: filled in two steps that overlap, an older build dropped."""
    path = fresh_path(spark, "tilecache")
    k = F.col("p_partkey")
    tiles_ = table(spark, sf_dir, "part").select((k * 3).alias("tile_id"), F.when(k % 4 != 0, F.col("p_name").cast("binary")).alias("payload"), k.alias("k"))
    state.put_cache(tiles_.filter("k % 3 = 0").drop("k"), path, "20240101")
    state.put_cache(tiles_.filter("k % 3 = 1").drop("k"), path, "20240201")
    state.put_cache(tiles_.filter("k % 3 > 0").drop("k"), path, "20240201")
    state.save_manifest(spark, f"{path}-manifest", "20240201", 19_754)
    state.save_cursor(spark, f"{path}-cursor", "20240101", 3, 1, 2)
    build, _ = state.load_manifest(spark, f"{path}-manifest")
    if state.load_cursor(spark, f"{path}-cursor", build) is None:  # of another build
        state.clear_cursor(spark, f"{path}-cursor")
    state.roll_over(spark, path, build)
    asked = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") * 3).alias("tile_id")).distinct()
    return state.lookups(asked, state.open_cache(spark, path, build), 9).select("tile_id", "found")


@query("""WITH t AS (SELECT o_custkey * 2 AS tile_id, max(o_orderkey % 5) AS length FROM orders GROUP BY o_custkey), q AS (SELECT l_partkey AS tile_id FROM lineitem)
SELECT (SELECT count(*) FROM q JOIN t USING (tile_id)) AS hits, (SELECT count(*) FROM q WHERE tile_id NOT IN (SELECT tile_id FROM t)) AS misses, (SELECT count(*) FROM t) AS entries, CAST((SELECT sum(length) FROM t) AS BIGINT) AS bytes""")
def cache_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits, misses, entries and bytes of a cache."""
    cache = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") * 2).alias("tile_id")).agg(F.max(F.col("o_orderkey") % 5).alias("length"))
    asked = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("tile_id"))
    return state.cache_counters(state.lookups(asked, cache), cache)


@query("SELECT CAST(n_nationkey AS INTEGER) AS id, CAST(n_nationkey * 50 AS DOUBLE) AS ox, 0.5::DOUBLE + n_regionkey AS gx, CAST(n_nationkey % 130 AS INTEGER) AS fit_n, n_nationkey % 2 = 0 AS fitted FROM nation WHERE n_nationkey * 50 < 1000 AND n_nationkey % 7 <> 3")
def saved_calibrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrations written as files and read back: those with implausible numbers, or cut short, are left out."""
    folder = fresh_path(spark, "calibrations")
    store, inner = raw.filesystem(folder)
    store.create_dir(inner, recursive=True)
    for n, r in table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey").collect():  # 25 rows
        body = tables.pack_calibration((n * 50.0, 0.0, 0.0), (0.5 + r, 1.0, 1.0), 0.1, n % 2 == 0, points=((1.0, 2.0, 3.0),) * (n % 130))
        with store.open_output_stream(f"{inner}/{n:03d}.cal") as out:
            out.write(body[:-1] if n % 7 == 3 else body)
    return tables.read_calibrations(spark, folder).select(F.regexp_extract("path", "([0-9]+)[.]cal$", 1).cast("int").alias("id"), "ox", "gx", "fit_n", "fitted")


@query(f"""
WITH RECURSIVE e AS ({EVENTS_SQL}), k AS (SELECT device, seq, us // 1000 AS ms, event_type <> 'click' AS is_fix, status = 'A' AND mode = 3 AND hdop > 0 AND hdop < 2.5 AND speed_kmh >= 8 AS usable, seq % 5 = 0 AS calibrating FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY device ORDER BY ms) AS rn FROM k),
s AS (SELECT DISTINCT device, 0::BIGINT AS rn, 0::BIGINT AS seq, NULL::BIGINT AS sample, NULL::BIGINT AS used, NULL::BIGINT AS logged FROM k
  UNION ALL SELECT r.device, r.rn, r.seq, CASE WHEN r.is_fix THEN s.sample WHEN r.calibrating THEN NULL ELSE r.seq END,
    CASE WHEN r.is_fix AND r.usable AND s.sample IS NOT NULL AND s.sample IS DISTINCT FROM s.used THEN s.sample ELSE s.used END,
    CASE WHEN r.is_fix AND r.usable AND s.sample IS NOT NULL AND s.sample IS DISTINCT FROM s.used THEN s.sample END FROM s JOIN r ON r.device = s.device AND r.rn = s.rn + 1)
SELECT device, seq, logged FROM s WHERE logged IS NOT NULL""")
def log_as_it_comes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log folded over fixes and samples (clicks) as they arrive, none during a calibration; any age and pace, since the
    events are hours apart."""
    e = events(spark, sf_dir).withColumn("ms", F.floor(F.col("us") / 1000))
    rows = e.select("device", "seq", "ms", F.when(F.col("event_type") == "click", "sample").otherwise("fix").alias("kind"), "status", "mode", "hdop", "speed_kmh", (F.col("seq") % 5 == 0).alias("calibrating"))

    def step(s, r):
        # an hour counts as a millisecond: every sample is fresh
        return policies.log_step(s and s | {"line": None, "sample": s["sample"] and (s["sample"][0], r["ms"])}, r)

    return policies.run_policy(rows, step, "logged long").filter("logged is not null").select("device", "seq", "logged")


_HELD = "seq * 137 % 3000 - 700"


@query(f"WITH e AS ({EVENTS_SQL}), p AS (SELECT device, seq, {_HELD} AS sx, seq * 71 % 1500 - 300 AS sy FROM e), v AS (SELECT *, row_number() OVER (PARTITION BY device ORDER BY seq) AS k FROM p WHERE sx BETWEEN -60 AND 1340 AND sy BETWEEN -60 AND 780) SELECT device, seq FROM v WHERE k <= 16")
def pins_in_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pins near the screen, the first sixteen of each device."""
    s = F.col("seq")
    p = events(spark, sf_dir).select("device", "seq", (s * 137 % 3000 - 700).alias("sx"), (s * 71 % 1500 - 300).alias("sy"))
    return places.first_of(p.filter(places.pin_visible(F.col("sx"), F.col("sy"))), ["device"], ["seq"], 16).select("device", "seq")


@query("""WITH p AS (SELECT p_partkey AS id, ['water','major','path','poi','none','building'][CAST(p_partkey % 6 AS BIGINT) + 1] AS style, ['polygon','line','point'][CAST(p_partkey // 6 % 3 AS BIGINT) + 1] AS geom FROM part)
SELECT id, (style IN ('water', 'building', 'poi') AND geom = 'polygon') OR (style IN ('major', 'path') AND geom = 'line') AS painted FROM p""")
def painted_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which parts leave paint."""
    k = F.col("p_partkey")
    pick = lambda names, at: F.element_at(F.array(*map(F.lit, names)), at.cast("int") + 1)
    style, geom = pick(("water", "major", "path", "poi", "none", "building"), k % 6), pick(("polygon", "line", "point"), F.floor(k / 6) % 3)
    return table(spark, sf_dir, "part").select(k.alias("id"), raster.is_painted(style, geom).alias("painted"))


@query(f"""WITH m AS (SELECT id, CAST(floor({FX.format(n=4096)}) AS BIGINT) AS cx, CAST(floor({FY.format(n=4096)}) AS BIGINT) AS cy FROM ({CUSTOMERS_SQL}))
SELECT DISTINCT 12 AS z, (cx + dx + 4096) % 4096 AS x, cy + dy AS y FROM m, range(-1, 2) a(dx), range(-1, 2) b(dy) WHERE cy + dy BETWEEN 0 AND 4095""")
def place_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nine tiles around each customer whose places are looked at."""
    return coverage.square_around(customers(spark, sf_dir), 12, radius=1)


@query(f"""WITH m AS (SELECT DISTINCT CAST(floor({FX.format(n=64)}) AS BIGINT) AS x, CAST(floor({FY.format(n=64)}) AS BIGINT) AS y FROM ({CUSTOMERS_SQL}))
SELECT count(DISTINCT x) AS files, round(sum((x + 1) * (y + 1)) / 1000.0::DOUBLE, 6) AS gb FROM m""")
def band_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and bytes of bands, a tile column each."""
    m = customers(spark, sf_dir).withColumn("m", tiles.mercator(F.col("lat"), F.col("lon"), F.lit(6))).select(F.floor("m.fx").alias("x"), F.floor("m.fy").alias("y")).distinct()
    bands = m.groupBy("x").agg((F.sum((F.col("x") + 1) * (F.col("y") + 1)) / 1000.0).alias("gb"))
    return rings.band_totals(bands).select("files", F.round("gb", 6).alias("gb"))
