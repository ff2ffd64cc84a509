"""Queries over the driver's tables, each through the library's operators, with the same result in DuckDB.

Positions, sentences and scans are surrogates (geostride.plans.surrogates). Where a device's threshold would never be met
by them, the query says which one it uses instead."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geostride.functions import compass, geo, nmea, scalars, sun, tiles
from geostride.operators import archive, coverage, gnss, magnet, places, rings, trust, waypoints, wifi
from geostride.plans.registry import ORACLE_SQL, QUERIES, query
from geostride.plans.surrogates import CUSTOMERS_SQL, EVENTS_SQL, FX, FY, HILBERT, LAT_SQL, LON_SQL, SEQ_SQL, customers, events, lat_of, line_seq, lon_of
from geostride.session import table

Z = 14

r6 = lambda c: F.round(c, 6)

@query(f"""
WITH RECURSIVE p AS (SELECT *, {FX.format(n=16384)} AS fx, {FY.format(n=16384)} AS fy FROM ({CUSTOMERS_SQL})),
t AS (SELECT id AS k, 14 AS z, CAST(floor(fx) AS BIGINT) AS x, CAST(floor(fy) AS BIGINT) AS y FROM p), {HILBERT}
SELECT p.id, t.x, t.y, tile_id, CAST(floor((fx - floor(fx)) * 512) AS INTEGER) AS px, CAST(floor((fy - floor(fy)) * 512) AS INTEGER) AS py,
  round(40075016.685578488::DOUBLE * cos(radians(lat)) / (512 * 16384.0::DOUBLE), 6) AS m_per_px
FROM p JOIN t ON p.id = t.k JOIN ids ON ids.k = p.id
""")
def tile_of_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tile, Hilbert id, pixel and ground resolution of each customer's point at z14."""
    z = F.lit(Z)
    p = customers(spark, sf_dir).withColumn("m", tiles.mercator(F.col("lat"), F.col("lon"), z)).withColumn("x", F.floor("m.fx")).withColumn("y", F.floor("m.fy"))
    return p.select("id", "x", "y", tiles.hilbert_id(z, F.col("x"), F.col("y")).alias("tile_id"), tiles.pixel_in_tile(F.col("m.fx"), F.lit(512)).alias("px"), tiles.pixel_in_tile(F.col("m.fy"), F.lit(512)).alias("py"), r6(tiles.ground_resolution(F.col("lat"), z, F.lit(512))).alias("m_per_px"))


@query("""
WITH k AS (SELECT o_orderkey AS id, CAST(o_orderkey AS BIGINT) * 2654435761 % 5592405 AS tile_id FROM orders),
zs AS (SELECT *, CAST((SELECT count(*) FROM range(1, 31) r(z) WHERE ((1::BIGINT << (2 * z)) - 1) // 3 <= tile_id) AS INTEGER) AS z FROM k)
SELECT id, tile_id, z, tile_id AS back, z AS parent_z_plus_2 FROM zs
""")
def tile_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Id to tile and back; the tile two zooms up and its place in it lead back too."""
    k = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey").cast("long") * 2654435761 % 5592405).alias("tile_id"))
    p = k.withColumn("t", tiles.hilbert_zxy(F.col("tile_id")))
    up = tiles.parent_tile(F.col("t.z"), F.col("t.x"), F.col("t.y"), F.least(F.lit(2), F.col("t.z")))
    p = p.withColumn("u", up).withColumn("s", F.least(F.lit(2), F.col("t.z")))
    x = F.col("u.x") * F.pow(F.lit(2.0), "s").cast("long") + F.col("u.qx")
    y = F.col("u.y") * F.pow(F.lit(2.0), "s").cast("long") + F.col("u.qy")
    return p.select("id", "tile_id", "t.z", tiles.hilbert_id(F.col("t.z"), x, y).alias("back"), (F.col("u.z") + F.col("s")).cast("int").alias("parent_z_plus_2"))


ENTRIES_SQL = "SELECT o_orderkey * 10 AS entry_id, CAST(CASE WHEN o_orderkey % 97 = 0 THEN 10 ELSE o_orderkey % 9 + 1 END AS BIGINT) AS run_length, CAST(o_totalprice AS BIGINT) AS length, o_orderkey * 1000 AS \"offset\" FROM orders"


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select((o * 10).alias("tile_id"), F.when(o % 97 == 0, 10).otherwise(o % 9 + 1).cast("long").alias("run_length"), F.bround("o_totalprice").cast("long").alias("length"), (o * 1000).alias("offset"))


@query(f"""
WITH e AS ({ENTRIES_SQL}), t AS (SELECT l_orderkey * 10 + l_linenumber * 3 % 11 AS tile_id, l_orderkey AS line_order, l_linenumber AS line FROM lineitem)
SELECT line_order, line, tile_id, entry_id, run_length, "offset" FROM t JOIN e ON tile_id >= entry_id AND tile_id < entry_id + run_length
""")
def asof_tile_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The directory entry that covers each asked tile."""
    t = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("line_order"), F.col("l_linenumber").alias("line"), (F.col("l_orderkey") * 10 + F.col("l_linenumber") * 3 % 11).alias("tile_id"))
    return archive.locate_entries(t, entries(spark, sf_dir)).select("line_order", "line", "tile_id", "entry_id", "run_length", "offset")


PAIRS_SQL = f"SELECT a.n_nationkey AS a, b.n_nationkey AS b, {LAT_SQL.format(k='(a.n_nationkey + 1)')} AS lat1, {LON_SQL.format(k='(a.n_nationkey + 1)')} AS lon1, {LAT_SQL.format(k='(b.n_nationkey + 1)')} AS lat2, {LON_SQL.format(k='(b.n_nationkey + 1)')} AS lon2 FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey"
POINTS_SQL = "['N','NNE','NE','ENE','E','ESE','SE','SSE','S','SSW','SW','WSW','W','WNW','NW','NNW']"


@query(f"""
WITH p AS ({PAIRS_SQL}),
h AS (SELECT *, pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2) AS hv,
  degrees(atan2(sin(radians(lon2 - lon1)) * cos(radians(lat2)), cos(radians(lat1)) * sin(radians(lat2)) - sin(radians(lat1)) * cos(radians(lat2)) * cos(radians(lon2 - lon1)))) AS b0 FROM p),
m AS (SELECT *, 2 * 6371008.8::DOUBLE * atan2(sqrt(hv), sqrt(1 - hv)) AS d, CASE WHEN b0 < 0 THEN b0 + 360 ELSE b0 END AS deg FROM h)
SELECT a, b, round(d, 3) AS metres, round(deg, 6) AS bearing, {POINTS_SQL}[CAST(floor((deg + 11.25) / 22.5) AS BIGINT) % 16 + 1] AS point,
  round(sqrt(pow((lon2 - lon1) * 111320.0::DOUBLE * cos(radians((lat1 + lat2) * 0.5::DOUBLE)), 2) + pow((lat2 - lat1) * 111320.0::DOUBLE, 2)), 3) AS flat_m
FROM m
""")
def great_circle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance, bearing and compass point between nations' points."""
    n = table(spark, sf_dir, "nation").select("n_nationkey")
    a, b = n.select(F.col("n_nationkey").alias("a")), n.select(F.col("n_nationkey").alias("b"))
    p = a.join(b, F.col("a") < F.col("b")).select("a", "b", *(f(F.col(k) + 1).alias(f"{c}{i}") for i, k in ((1, "a"), (2, "b")) for c, f in (("lat", lat_of), ("lon", lon_of))))
    at = (F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))
    deg = geo.bearing_deg(*at)
    return p.select("a", "b", F.round(geo.haversine_m(*at), 3).alias("metres"), r6(deg).alias("bearing"), geo.compass16(deg).alias("point"), F.round(geo.flat_m_mean(*at), 3).alias("flat_m"))


MOTION_SQL = f"""
e AS ({EVENTS_SQL}), s AS (SELECT *, sum(CASE WHEN status <> 'A' THEN 1 ELSE 0 END) OVER (PARTITION BY device ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS session FROM e),
l AS (SELECT *, lag(status) OVER w AS ps, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon, lag(ts) OVER w AS pts, lag(altitude) OVER w AS palt FROM s WINDOW w AS (PARTITION BY device, session ORDER BY ts, seq)),
m AS (SELECT *, CASE WHEN status = 'A' AND ps = 'A' THEN sqrt(pow((lon - plon) * 111320.0::DOUBLE * cos(radians((plat + lat) * 0.5::DOUBLE)), 2) + pow((lat - plat) * 111320.0::DOUBLE, 2)) END AS moved_m,
  CASE WHEN status = 'A' AND ps = 'A' THEN ts - pts END AS dt_s, CASE WHEN status = 'A' AND ps = 'A' THEN abs(altitude - palt) END AS alt_step FROM l),
v AS (SELECT *, CASE WHEN dt_s > 0.25 THEN moved_m / dt_s * 3.6::DOUBLE END AS implied_kmh FROM m)
"""


@query(f"""
WITH {MOTION_SQL}
SELECT device, seq, round(moved_m, 4) AS moved_m, round(implied_kmh, 4) AS implied_kmh,
  coalesce(greatest(speed_kmh, implied_kmh) > 15 AND (greatest(speed_kmh, implied_kmh) - least(speed_kmh, implied_kmh)) / greatest(speed_kmh, implied_kmh) > 0.5, false) AND implied_kmh IS NOT NULL AS disagrees
FROM v
""")
def implied_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speed that two fixes imply, and whether it disagrees with the receiver's."""
    rows = trust.with_motion(events(spark, sf_dir))
    return rows.select("device", "seq", F.round("moved_m", 4).alias("moved_m"), F.round("implied_kmh", 4).alias("implied_kmh"), (F.coalesce(trust.speed_disagrees(F.col("speed_kmh"), F.col("implied_kmh")), F.lit(False)) & F.col("implied_kmh").isNotNull()).alias("disagrees"))


FREEZE_SQL = """
f AS (SELECT *, status = 'A' AND (altitude < -450 OR altitude > 12000) AS alt_out FROM v),
g AS (SELECT *, (status = 'A' AND NOT alt_out AND alt_step IS NOT NULL) AS acting, (status = 'A' AND NOT alt_out AND alt_step IS NOT NULL AND alt_step < 0.01 AND moved_m > 20) AS still FROM f),
h AS (SELECT *, sum(CASE WHEN acting AND NOT still THEN 1 ELSE 0 END) OVER (PARTITION BY device ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS run FROM g),
i AS (SELECT *, CAST(sum(CASE WHEN still THEN 1 ELSE 0 END) OVER (PARTITION BY device, run ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS INTEGER) AS same_count FROM h)
"""


@query(f"WITH {MOTION_SQL}, {FREEZE_SQL} SELECT device, seq, alt_out, same_count, still AND same_count > 30 AS frozen FROM i")
def alt_freeze_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of moving steps with an unchanged altitude."""
    return trust.with_freeze(trust.with_motion(events(spark, sf_dir))).select("device", "seq", "alt_out", "same_count", "frozen")


BITS_SQL = ", ".join(f"max((raised >> {k}) & 1) OVER w AS b{k}" for k in (0, 1, 6))


@query(f"""
WITH {MOTION_SQL}, {FREEZE_SQL},
j AS (SELECT *, CASE WHEN status <> 'A' THEN 0 ELSE CAST(coalesce(implied_kmh > 400, false) AS INTEGER)
  + 2 * CAST(coalesce(implied_kmh IS NOT NULL AND greatest(speed_kmh, implied_kmh) > 15 AND (greatest(speed_kmh, implied_kmh) - least(speed_kmh, implied_kmh)) / greatest(speed_kmh, implied_kmh) > 0.5, false) AS INTEGER)
  + 64 * CAST(alt_out OR (still AND same_count > 30) AS INTEGER) END AS raised FROM i),
k AS (SELECT *, {BITS_SQL} FROM j WINDOW w AS (PARTITION BY device ORDER BY ts RANGE BETWEEN 43200.0 PRECEDING AND CURRENT ROW)),
o AS (SELECT *, b0 + 2 * b1 + 64 * b6 AS flags, CASE WHEN status = 'A' THEN CASE b0 + b1 + b6 WHEN 0 THEN 'OK' WHEN 1 THEN 'ODD' ELSE 'BAD' END END AS own FROM k)
SELECT device, seq, CAST(flags AS INTEGER) AS flags,
  CASE WHEN status = 'A' THEN own WHEN flags = 0 THEN 'UNKNOWN' ELSE coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY device ORDER BY ts, seq ROWS UNBOUNDED PRECEDING), 'UNKNOWN') END AS level,
  concat_ws(', ', CASE WHEN b0 = 1 THEN 'jump' END, CASE WHEN b1 = 1 THEN 'speed' END, CASE WHEN b6 = 1 THEN 'altitude' END) AS text
FROM o
""")
def trust_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seven checks, held (for half a day here: the events are hours apart), with level and text."""
    return trust.trust(events(spark, sf_dir), hold_s=43200.0).select("device", "seq", "flags", "level", "text")


@query(f"""
WITH g AS (SELECT l_suppkey AS device, {SEQ_SQL} AS seq, CAST(l_partkey % 4 AS INTEGER) AS con, l_linenumber AS message, CAST(l_quantity AS INTEGER) % 12 AS visible, [CAST(l_partkey % 50 AS INTEGER), CAST(l_orderkey % 47 AS INTEGER)] AS snr FROM lineitem),
h AS (SELECT *, CAST(sum(CASE WHEN message = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY device, con ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS group_no FROM g)
SELECT device, con, group_no, seq, visible, coalesce(max(list_max(list_filter(snr, lambda x: x > 0))) OVER w, 0) AS best_snr, coalesce(min(list_min(list_filter(snr, lambda x: x > 0))) OVER w, 0) AS worst_snr
FROM h WINDOW w AS (PARTITION BY device, con, group_no ORDER BY seq ROWS UNBOUNDED PRECEDING)
""")
def constellation_snr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visibility sentences written from line items, parsed again, with best and worst signal of each sweep."""
    talker = F.element_at(F.array(*map(F.lit, nmea.TALKERS)), (F.col("l_partkey") % 4 + 1).cast("int"))
    line = F.format_string("$%sGSV,3,%d,%d,01,40,083,%d,02,17,308,%d*7F", talker, F.col("l_linenumber"), F.col("l_quantity").cast("int") % 12, F.col("l_partkey") % 50, F.col("l_orderkey") % 47)
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("device"), line_seq().alias("seq"), line.alias("line"))
    return gnss.constellations(lines)


OBS_SQL = f"""
o AS (SELECT l_partkey AS id, {SEQ_SQL} AS seq, -60 - CAST(l_orderkey % 40 AS INTEGER) AS rssi,
  42.0::DOUBLE + (l_partkey % 100) / 1000.0::DOUBLE + (l_orderkey * 31 % 97) / 97.0::DOUBLE * (CASE WHEN l_partkey % 7 = 0 THEN 0.01::DOUBLE ELSE 0.0005::DOUBLE END) AS lat,
  -83.0::DOUBLE + (l_partkey % 89) / 1000.0::DOUBLE + (l_orderkey * 17 % 89) / 89.0::DOUBLE * 0.0005::DOUBLE AS lon FROM lineitem),
f AS (SELECT *, CAST(lat AS FLOAT) AS flat, CAST(lon AS FLOAT) AS flon FROM o WHERE rssi >= -88),
x AS (SELECT *, count(*) OVER w AS k, sqrt(pow(CAST(max(flon) OVER w - min(flon) OVER w AS DOUBLE) * 111320.0::DOUBLE * cos(radians(lat)), 2) + pow(CAST(max(flat) OVER w - min(flat) OVER w AS DOUBLE) * 111320.0::DOUBLE, 2)) AS extent FROM f WINDOW w AS (PARTITION BY id ORDER BY seq ROWS UNBOUNDED PRECEDING)),
a AS (SELECT id, count(*) AS n, sum(lat) AS sum_lat, sum(lon) AS sum_lon, min(flat) AS min_lat, max(flat) AS max_lat, min(flon) AS min_lon, max(flon) AS max_lon, CAST(max(rssi) AS INTEGER) AS best_rssi, bool_or(k >= 3 AND extent > 400) AS mobile FROM x GROUP BY id)
"""


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, o = F.col("l_partkey"), F.col("l_orderkey")
    lat = F.lit(42.0) + p % 100 / 1000.0 + o * 31 % 97 / 97.0 * F.when(p % 7 == 0, 0.01).otherwise(0.0005)
    lon = F.lit(-83.0) + p % 89 / 1000.0 + o * 17 % 89 / 89.0 * 0.0005
    return table(spark, sf_dir, "lineitem").select(p.alias("id"), line_seq().alias("seq"), (-60 - (o % 40).cast("int")).alias("rssi"), lat.alias("lat"), lon.alias("lon"), o.alias("scan_id"), F.col("l_linenumber").alias("ord"))


@query(f"WITH {OBS_SQL} SELECT id, n, round(sum_lat / n, 7) AS lat, round(sum_lon / n, 7) AS lon, min_lat, max_lat, min_lon, max_lon, best_rssi, mobile FROM a")
def ap_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The survey table of access points."""
    a = wifi.learn(observations(spark, sf_dir))
    return a.select("id", "n", F.round(F.col("sum_lat") / F.col("n"), 7).alias("lat"), F.round(F.col("sum_lon") / F.col("n"), 7).alias("lon"), "min_lat", "max_lat", "min_lon", "max_lon", "best_rssi", "mobile")


@query(f"""
WITH {OBS_SQL},
h AS (SELECT l_orderkey AS scan_id, l_linenumber AS ord, l_partkey AS id, -60 - CAST(l_orderkey % 40 AS INTEGER) AS rssi FROM lineitem),
u AS (SELECT h.*, pow(10.0::DOUBLE, rssi / 10.0::DOUBLE) AS w, sum_lat / n AS clat, sum_lon / n AS clon FROM h JOIN a USING (id) WHERE rssi >= -88 AND NOT mobile AND n >= 3),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY ord) AS rk FROM u) WHERE rk <= 32),
m AS (SELECT scan_id, sum(w * clat) / sum(w) AS lat, sum(w * clon) / sum(w) AS lon FROM k GROUP BY scan_id)
SELECT scan_id, round(m.lat, 7) AS lat, round(m.lon, 7) AS lon, round(sqrt(sum(w * (pow((clon - m.lon) * 111320.0::DOUBLE * cos(radians(m.lat)), 2) + pow((clat - m.lat) * 111320.0::DOUBLE, 2))) / sum(w)), 2) AS spread_m, count(*) AS used
FROM k JOIN m USING (scan_id) GROUP BY scan_id, m.lat, m.lon HAVING count(*) >= 3
""")
def wifi_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions from scans: orders as scans, parts as access points."""
    o = observations(spark, sf_dir)
    e = wifi.locate(o.select("scan_id", "ord", "id", "rssi"), wifi.learn(o))
    return e.select("scan_id", F.round("lat", 7).alias("lat"), F.round("lon", 7).alias("lon"), F.round("spread_m", 2).alias("spread_m"), "used")


PLACES_SQL = f"""
pl AS (SELECT CASE WHEN s_suppkey % 4 < 2 THEN 12 ELSE 6 END AS z, s_suppkey AS ord, ['hood', 'locality', 'region', 'country'][CAST(s_suppkey % 4 AS BIGINT) + 1] AS rank, s_name AS name, lat, lon FROM (SELECT *, {LAT_SQL.format(k='s_suppkey')} AS lat, {LON_SQL.format(k='s_suppkey')} AS lon FROM supplier)),
w AS (SELECT *, CAST({FX.format(n='(1::BIGINT << z)')} AS DOUBLE) AS fx, CAST({FY.format(n='(1::BIGINT << z)')} AS DOUBLE) AS fy FROM pl),
c AS (SELECT *, {FX.format(n=64)} AS px, {FY.format(n=64)} AS py FROM ({CUSTOMERS_SQL}))
"""


@query(f"""
WITH {PLACES_SQL},
d AS (SELECT c.id, w.rank, w.name, w.ord, pow(w.fx - px * pow(2.0::DOUBLE, z - 6), 2) + pow(w.fy - py * pow(2.0::DOUBLE, z - 6), 2) AS d2, CASE rank WHEN 'hood' THEN 0.4::DOUBLE * pow(2.0::DOUBLE, z - 6) WHEN 'locality' THEN 4.0::DOUBLE * pow(2.0::DOUBLE, z - 6) END AS lim FROM c, w),
b AS (SELECT *, row_number() OVER (PARTITION BY id, rank ORDER BY d2, ord) AS k FROM d WHERE lim IS NULL OR d2 <= lim * lim)
SELECT id, rank, name FROM b WHERE k = 1
""")
def nearest_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest place of each rank (suppliers as places, display zoom 6)."""
    k = F.col("s_suppkey")
    p = table(spark, sf_dir, "supplier").select(F.when(k % 4 < 2, 12).otherwise(6).alias("z"), k.alias("ord"), F.element_at(F.array(*map(F.lit, places.RANKS)), (k % 4 + 1).cast("int")).alias("rank"), F.col("s_name").alias("name"), lat_of(k).alias("lat"), lon_of(k).alias("lon"))
    p = p.withColumn("m", tiles.mercator(F.col("lat"), F.col("lon"), F.col("z"))).select("z", "ord", "rank", "name", "m.fx", "m.fy")
    c = customers(spark, sf_dir).withColumn("m", tiles.mercator(F.col("lat"), F.col("lon"), F.lit(6))).select("id", "m.fx", "m.fy")
    return places.nearest_places(c, p, "id", 6).select("id", "rank", "name")


SQUARE_SQL = f"""
m AS (SELECT DISTINCT CAST(floor({FX.format(n=256)}) AS BIGINT) AS cx, CAST(floor({FY.format(n=256)}) AS BIGINT) AS cy FROM ({CUSTOMERS_SQL})),
q AS (SELECT DISTINCT 8 AS z, (cx + dx + 256) % 256 AS x, cy + dy AS y FROM m, range(-7, 8) a(dx), range(-7, 8) b(dy) WHERE cy + dy BETWEEN 0 AND 255),
held AS (SELECT DISTINCT 8 AS z, CAST(o_orderkey * 31 % 256 AS BIGINT) AS x, CAST(o_orderkey * 17 % 251 AS BIGINT) AS y FROM orders)
"""


def _square(spark, sf_dir):
    return coverage.square_around(customers(spark, sf_dir), 8)


def _held(spark, sf_dir):
    o = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(F.lit(8).alias("z"), (o * 31 % 256).alias("x"), (o * 17 % 251).alias("y")).distinct()


@query(f"WITH {SQUARE_SQL} SELECT z, x, y FROM q EXCEPT SELECT z, x, y FROM held")
def coverage_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of the squares around all customers that aren't held."""
    return coverage.missing(_square(spark, sf_dir), _held(spark, sf_dir))


HEADS_SQL = """heads AS (SELECT n_name AS path, n_nationkey AS archive_order, CAST(n_nationkey % 4 AS INTEGER) AS min_zoom, CAST(6 + n_nationkey % 9 AS INTEGER) AS max_zoom,
  CAST(-1800000000 + CAST(n_nationkey AS BIGINT) * 140000000 AS BIGINT) AS min_lon_e7, CAST(-1800000000 + CAST(n_nationkey AS BIGINT) * 140000000 + 400000000 AS BIGINT) AS max_lon_e7,
  CAST(-800000000 + CAST(n_regionkey AS BIGINT) * 300000000 AS BIGINT) AS min_lat_e7, CAST(-800000000 + CAST(n_regionkey AS BIGINT) * 300000000 + 400000000 AS BIGINT) AS max_lat_e7 FROM nation)"""
COVERS_SQL = """z BETWEEN min_zoom AND max_zoom AND -1800000000 + (3600000000::BIGINT * (x + 1)) // (1::BIGINT << z) >= min_lon_e7 AND -1800000000 + (3600000000::BIGINT * x) // (1::BIGINT << z) <= max_lon_e7
  AND CAST(trunc(degrees(atan(sinh(pi() * (1 - 2 * y / (1::BIGINT << z)::DOUBLE)))) * 1e7::DOUBLE) AS BIGINT) >= min_lat_e7 AND CAST(trunc(degrees(atan(sinh(pi() * (1 - 2 * (y + 1) / (1::BIGINT << z)::DOUBLE)))) * 1e7::DOUBLE) AS BIGINT) <= max_lat_e7"""


def heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = F.col("n_nationkey").cast("long"), F.col("n_regionkey").cast("long")
    low = F.lit(-1800000000).cast("long") + n * 140000000
    south = F.lit(-800000000).cast("long") + r * 300000000
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("path"), n.cast("int").alias("archive_order"), (n % 4).cast("int").alias("min_zoom"), (6 + n % 9).cast("int").alias("max_zoom"), low.alias("min_lon_e7"), (low + 400000000).alias("max_lon_e7"), south.alias("min_lat_e7"), (south + 400000000).alias("max_lat_e7"))


@query(f"WITH {SQUARE_SQL}, {HEADS_SQL} SELECT z, x, y FROM q WHERE EXISTS (SELECT 1 FROM heads WHERE {COVERS_SQL})")
def archive_covers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles that some archive's zooms and bounds cover."""
    return coverage_covered(spark, sf_dir)


def coverage_covered(spark, sf_dir):
    return archive.covered(_square(spark, sf_dir), heads(spark, sf_dir))


@query(f"""
WITH RECURSIVE {SQUARE_SQL}, {HEADS_SQL}, t AS (SELECT x * 1000 + y AS k, z, x, y FROM q), {HILBERT},
e AS (SELECT n_name AS path, 21845 + o_orderkey * 7 % 65000 // 4 * 4 AS entry_id, 3 AS run_length, min(o_orderkey * 100) AS "offset", 500 AS length FROM orders JOIN nation ON o_custkey % 25 = n_nationkey GROUP BY ALL),
c AS (SELECT DISTINCT 21845 + o_custkey * 13 % 65000 AS tile_id, CASE WHEN o_custkey % 3 = 0 THEN 0 ELSE 77 END AS length FROM orders),
far AS (SELECT z, x, y, x * 7 + y AS "offset", 900 AS length FROM q WHERE (x + y) % 2 = 0),
l AS (SELECT k, path, "offset", length, archive_order, row_number() OVER (PARTITION BY k ORDER BY archive_order) AS rk FROM t JOIN ids USING (k) JOIN heads ON {COVERS_SQL} JOIN e USING (path) WHERE tile_id >= entry_id AND tile_id < entry_id + run_length)
SELECT t.z, t.x, t.y, CASE WHEN c.length > 0 THEN 'cache' WHEN l.k IS NOT NULL THEN 'local' WHEN far."offset" IS NOT NULL AND coalesce(c.length, -1) <> 0 THEN 'remote' ELSE 'miss' END AS source,
  CASE WHEN c.length > 0 THEN NULL ELSE l.path END AS path
FROM t JOIN ids USING (k) LEFT JOIN c ON c.tile_id = ids.tile_id LEFT JOIN l ON l.k = t.k AND l.rk = 1 LEFT JOIN far ON far.z = t.z AND far.x = t.x AND far.y = t.y
""")
def resolve_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each asked tile comes from: cache, a local archive (the first that holds it), remote, or nowhere."""
    q, o = _square(spark, sf_dir), table(spark, sf_dir, "orders")
    names = table(spark, sf_dir, "nation").select(F.col("n_name").alias("path"), F.col("n_nationkey").alias("_n"))
    e = o.join(names, F.col("o_custkey") % 25 == F.col("_n")).select("path", (F.lit(21845) + F.floor(F.col("o_orderkey") * 7 % 65000 / 4).cast("long") * 4).alias("tile_id"), F.lit(3).alias("run_length"), (F.col("o_orderkey") * 100).alias("o"))
    e = e.groupBy("path", "tile_id", "run_length").agg(F.min("o").alias("offset")).withColumn("length", F.lit(500).cast("long"))
    c = o.select((F.lit(21845) + F.col("o_custkey") * 13 % 65000).alias("tile_id"), F.when(F.col("o_custkey") % 3 == 0, 0).otherwise(77).alias("length")).distinct()
    far = q.filter("(x + y) % 2 = 0").select("z", "x", "y", (F.col("x") * 7 + F.col("y")).alias("offset"), F.lit(900).cast("long").alias("length"))
    return archive.resolve(q, c, heads(spark, sf_dir), e, far).select("z", "x", "y", "source", "path")


@query(f"""
WITH {SQUARE_SQL} SELECT count(CASE WHEN held.x IS NULL AND (q.x + q.y) % 3 = 0 THEN 1 END) AS fetched, count(CASE WHEN held.x IS NOT NULL THEN 1 END) AS cached,
  count(CASE WHEN held.x IS NULL AND (q.x + q.y) % 3 = 1 THEN 1 END) AS offline, count(CASE WHEN held.x IS NULL AND (q.x + q.y) % 3 = 2 THEN 1 END) AS missing
FROM q LEFT JOIN held ON q.x = held.x AND q.y = held.y
""")
def prefetch_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of a prefetch."""
    q = _square(spark, sf_dir).join(_held(spark, sf_dir).withColumn("h", F.lit(1)), ["z", "x", "y"], "left")
    k = (F.col("x") + F.col("y")) % 3
    return coverage.prefetch_counts(q.withColumn("source", F.when(F.col("h") == 1, "cache").when(k == 0, "remote").when(k == 1, "local").otherwise("miss")))


@query(f"""
WITH p AS (SELECT *, {FX.format(n=16384)} AS fx, {FY.format(n=16384)} AS fy FROM ({CUSTOMERS_SQL}))
SELECT id, CAST(s AS INTEGER) AS slot, (CAST(floor(fx - 0.5) AS BIGINT) + s % 2 + 16384) % 16384 AS x, CAST(floor(fy - 0.5) AS BIGINT) + s // 2 AS y, 2 AS rank,
  CASE WHEN CAST(floor(fy - 0.5) AS BIGINT) + s // 2 BETWEEN 0 AND 16383 THEN 'pending' ELSE 'nodata' END AS state
FROM p, range(4) r(s)
""")
def visible_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2 x 2 grid around each customer's point."""
    return coverage.visible_tiles(customers(spark, sf_dir), Z).select("id", "slot", "x", "y", "rank", "state")


@query(f"""
WITH e AS (SELECT l_orderkey AS dir, {SEQ_SQL} AS ord, CAST(l_quantity AS BIGINT) AS length, CASE WHEN l_linenumber % 3 = 1 THEN CAST(l_partkey AS BIGINT) + 1 ELSE 0 END AS stored, CAST(l_suppkey AS BIGINT) AS step FROM lineitem),
i AS (SELECT *, sum(CASE WHEN stored <> 0 THEN 1 ELSE 0 END) OVER w AS island, CAST(sum(step) OVER w AS BIGINT) AS tile_id FROM e WINDOW w AS (PARTITION BY dir ORDER BY ord ROWS UNBOUNDED PRECEDING))
SELECT dir, ord, tile_id, CAST(coalesce(max(CASE WHEN stored <> 0 THEN stored - 1 END) OVER w, 0) + coalesce(sum(length) OVER (PARTITION BY dir, island ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset"
FROM i WINDOW w AS (PARTITION BY dir, island ORDER BY ord ROWS UNBOUNDED PRECEDING)
""")
def offset_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and offsets of directories from their steps and stored offsets (orders as directories)."""
    e = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("dir"), line_seq().alias("ord"), F.col("l_quantity").cast("long").alias("length"), F.when(F.col("l_linenumber") % 3 == 1, F.col("l_partkey") + 1).otherwise(0).alias("stored"), F.col("l_suppkey").alias("step"))
    return archive.with_offsets(archive.with_ids(e, ["dir"], "ord"), ["dir"], "ord").select("dir", "ord", "tile_id", "offset")


@query("""
WITH v AS (SELECT label AS device, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings)
SELECT device, count(*) AS n, round(sum(x * x), 6) AS b_xx, round(sum(x), 6) AS b_x, round(sum(x * x * (x * x)), 6) AS a_xx_xx, round(sum(x * x * (y * y)), 6) AS a_xx_yy, round(sum(z * z * z), 6) AS a_zz_z, round(sum(y * z), 6) AS a_y_z FROM v GROUP BY device
""")
def ellipsoid_normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of a calibration (first components of the embeddings as readings)."""
    v = table(spark, sf_dir, "embeddings").select(F.col("label").alias("device"), *(F.col("embedding")[k].cast("double").alias(a) for k, a in enumerate("xyz")))
    return magnet.normal_equations(v).select("device", "n", *(r6(F.col(c)).alias(c) for c in ("b_xx", "b_x", "a_xx_xx", "a_xx_yy", "a_zz_z", "a_y_z")))


@query(f"""
WITH e AS ({EVENTS_SQL})
SELECT device, seq, coalesce(last_value(CASE WHEN seq % 4 = 0 THEN status END IGNORE NULLS) OVER w, 'V') AS status,
  round(coalesce(last_value(CASE WHEN seq % 4 = 0 AND status = 'A' THEN 12 + (seq % 60) / 60.0::DOUBLE END IGNORE NULLS) OVER w, 0), 6) AS lat,
  round(coalesce(last_value(CASE WHEN seq % 4 = 0 AND status = 'A' THEN -(123 + (seq % 50) / 60.0::DOUBLE) END IGNORE NULLS) OVER w, 0), 6) AS lon,
  coalesce(last_value(CASE WHEN seq % 4 = 1 THEN speed_kmh END IGNORE NULLS) OVER w, 0) AS speed_kmh,
  CAST(coalesce(last_value(CASE WHEN seq % 4 = 2 THEN seq % 13 END IGNORE NULLS) OVER w, 0) AS INTEGER) AS sats,
  coalesce(last_value(CASE WHEN seq % 4 = 2 THEN CASE WHEN seq % 5 = 0 THEN 99.99::DOUBLE ELSE (seq % 50) / 10.0::DOUBLE END END IGNORE NULLS) OVER w, 99.99::DOUBLE) AS hdop
FROM e WINDOW w AS (PARTITION BY device ORDER BY seq ROWS UNBOUNDED PRECEDING)
""")
def nmea_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences written from events, parsed and folded into fixes."""
    e, s = events(spark, sf_dir), F.col("seq")
    rmc = F.format_string("$GPRMC,120000.00,%s,12%02d.0000,N,123%02d.0000,W,1.0,2.0,010124,,,A*00", F.col("status"), s % 60, s % 50)
    vtg = F.format_string("$GPVTG,12.5,T,,M,1.0,N,%.1f,K*00", F.col("speed_kmh"))
    gga = F.format_string("$GPGGA,120000.00,1200.0,N,12300.0,W,1,%02d,%s,120.5,M,,*00", s % 13, F.when(s % 5 == 0, "").otherwise(F.format_string("%.1f", s % 50 / 10.0)))
    line = F.when(s % 4 == 0, rmc).when(s % 4 == 1, vtg).when(s % 4 == 2, gga).otherwise("$GPTXT,not,used*00")
    return gnss.fixes(e.select("device", "seq", line.alias("line"))).select("device", "seq", "status", r6(F.col("lat")).alias("lat"), r6(F.col("lon")).alias("lon"), "speed_kmh", "sats", "hdop")


@query(f"""
WITH e AS ({EVENTS_SQL})
SELECT device, min(CASE WHEN status = 'A' THEN us END) AS first_coarse, min(CASE WHEN status = 'A' AND mode = 3 AND hdop > 0 AND hdop < 2.5 THEN us END) AS first_fine FROM e GROUP BY device
""")
def first_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First position and first good one of each device."""
    return gnss.first_fix_times(events(spark, sf_dir), ts="us")


@query(f"""
WITH e AS ({EVENTS_SQL}), g AS (SELECT device, us // 1000 AS from_ms, lead(us // 1000) OVER (PARTITION BY device ORDER BY us // 1000) AS to_ms FROM e)
SELECT * FROM g WHERE to_ms - from_ms > 86400000
""")
def silent_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps without a sentence of more than a day (the events are hours apart)."""
    e = events(spark, sf_dir).withColumn("ms", F.floor(F.col("us") / 1000))
    return gnss.silent_since(e, limit_ms=86_400_000)


@query("""
WITH v AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z, CAST(embedding[4] AS DOUBLE) AS ax, CAST(embedding[5] AS DOUBLE) AS ay, CAST(embedding[6] AS DOUBLE) + 1 AS az FROM embeddings),
c AS (SELECT *, -((y - 0.02::DOUBLE) * 0.9::DOUBLE) AS mx, (x - 0.01::DOUBLE) * 1.1::DOUBLE AS my, (z + 0.03::DOUBLE) * 1.0::DOUBLE AS mz FROM v),
r AS (SELECT *, atan2(ay, az) AS roll, atan2(-ax, sqrt(ay * ay + az * az)) AS pitch FROM c),
h AS (SELECT *, degrees(atan2(mx * sin(roll) * sin(pitch) + my * cos(roll) - mz * sin(roll) * cos(pitch), mx * cos(pitch) + mz * sin(pitch))) - 4.3::DOUBLE AS deg FROM r)
SELECT vec_id, round(CASE WHEN deg < 0 THEN deg + 360 ELSE deg END, 6) AS heading, round(degrees(roll), 6) AS roll, round(degrees(pitch), 6) AS pitch, round(sqrt(mx * mx + my * my + mz * mz), 6) AS field FROM h
""")
def compass_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrated, tilt-compensated headings (embedding components as readings)."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", *(F.col("embedding")[k].cast("double").alias(a) for k, a in enumerate(("x", "y", "z", "ax", "ay"))), (F.col("embedding")[5].cast("double") + 1).alias("az"))
    m = v.withColumn("m", compass.calibrated(F.col("x"), F.col("y"), F.col("z"), tuple(map(F.lit, (0.01, 0.02, -0.03))), tuple(map(F.lit, (1.1, 0.9, 1.0)))))
    a = (F.col("ax"), F.col("ay"), F.col("az"))
    return m.select("vec_id", r6(compass.heading_deg(F.col("m.x"), F.col("m.y"), F.col("m.z"), *a, -4.3)).alias("heading"), r6(F.degrees(compass.roll_rad(*a[1:]))).alias("roll"), r6(F.degrees(compass.pitch_rad(*a))).alias("pitch"), r6(F.col("m.field")).alias("field"))


SUN_SQL = f"""
g AS (SELECT id, lat, lon, id % 365 + 1 AS doy, id * 37 % 1440 AS now_min, 2 * pi() / 365.0::DOUBLE * (id % 365) AS g FROM ({CUSTOMERS_SQL})),
d AS (SELECT *, 229.18::DOUBLE * (0.000075::DOUBLE + 0.001868::DOUBLE * cos(g) - 0.032077::DOUBLE * sin(g) - 0.014615::DOUBLE * cos(2 * g) - 0.040849::DOUBLE * sin(2 * g)) AS eq,
  0.006918::DOUBLE - 0.399912::DOUBLE * cos(g) + 0.070257::DOUBLE * sin(g) - 0.006758::DOUBLE * cos(2 * g) + 0.000907::DOUBLE * sin(2 * g) - 0.002697::DOUBLE * cos(3 * g) + 0.00148::DOUBLE * sin(3 * g) AS decl FROM g),
c AS (SELECT *, cos(radians(90.833::DOUBLE)) / (cos(radians(lat)) * cos(decl)) - tan(radians(lat)) * tan(decl) AS ch FROM d),
s AS (SELECT *, CASE WHEN abs(ch) <= 1 THEN 720 - 4 * lon - eq - degrees(acos(greatest(-1, least(1, ch)))) * 4 END AS rise, CASE WHEN abs(ch) <= 1 THEN 720 - 4 * lon - eq + degrees(acos(greatest(-1, least(1, ch)))) * 4 END AS sunset FROM c),
n AS (SELECT *, (rise % 1440 + 1440) % 1440 AS a, (sunset % 1440 + 1440) % 1440 AS b FROM s),
u AS (SELECT *, CASE WHEN a IS NULL THEN true WHEN a < b THEN now_min >= a AND now_min < b ELSE now_min >= a OR now_min < b END AS up,
  CASE WHEN a IS NULL THEN -1 ELSE least(least(abs(now_min - a), 1440 - abs(now_min - a)), least(abs(now_min - b), 1440 - abs(now_min - b))) END AS tw FROM n)
"""


@query(f"WITH {SUN_SQL} SELECT id, round(rise, 4) AS rise, round(sunset, 4) AS sunset, up, round(tw, 4) AS to_twilight, CASE WHEN tw BETWEEN 0 AND 30 THEN 140 WHEN up THEN 255 ELSE 60 END AS brightness FROM u")
def sun_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sunrise, sunset, day, twilight and backlight at each customer's point, a day and minute from its id."""
    c = customers(spark, sf_dir).withColumn("s", sun.sun_minutes(F.col("lat"), F.col("lon"), F.col("id") % 365 + 1)).withColumn("now", (F.col("id") * 37 % 1440).cast("double"))
    c = c.withColumn("up", sun.is_day(F.col("s.rise"), F.col("s.set"), F.col("now"))).withColumn("tw", sun.minutes_to_twilight(F.col("s.rise"), F.col("s.set"), F.col("now")))
    return c.select("id", F.round("s.rise", 4).alias("rise"), F.round("s.set", 4).alias("sunset"), "up", F.round("tw", 4).alias("to_twilight"), sun.brightness(F.lit("auto"), F.lit("auto"), F.col("tw"), ~F.col("up")).alias("brightness"))


@query(f"SELECT id, round(degrees(atan2(sin(radians(164.0::DOUBLE) - radians(lon)) * cos(radians(86.5::DOUBLE)), cos(radians(lat)) * sin(radians(86.5::DOUBLE)) - sin(radians(lat)) * cos(radians(86.5::DOUBLE)) * cos(radians(164.0::DOUBLE) - radians(lon)))), 6) AS declination FROM ({CUSTOMERS_SQL})")
def declination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declination of the dipole at each customer's point."""
    return customers(spark, sf_dir).select("id", r6(compass.declination_deg(F.col("lat"), F.col("lon"))).alias("declination"))


@query("""
WITH p AS (SELECT o_custkey AS id, o_orderkey AS k, CAST(o_orderkey * 37 % 4096 AS BIGINT) AS x, CAST(o_orderkey * 91 % 4096 AS BIGINT) AS y FROM orders),
q AS (SELECT *, count(*) OVER (PARTITION BY id) AS n, coalesce(lag(x) OVER w, last_value(x) OVER (PARTITION BY id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS px, coalesce(lag(y) OVER w, last_value(y) OVER (PARTITION BY id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS py FROM p WINDOW w AS (PARTITION BY id ORDER BY k))
SELECT id, CAST(CASE WHEN max(n) >= 3 THEN sum(px * y - x * py) ELSE 0 END AS BIGINT) AS area2 FROM q GROUP BY id
""")
def ring_area2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twice the signed area of rings (a customer's orders as points)."""
    o = F.col("o_orderkey")
    p = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), o.alias("k"), (o * 37 % 4096).cast("int").alias("x"), (o * 91 % 4096).cast("int").alias("y"))
    r = p.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "x", "y"))), lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y"))).alias("pts"))
    return r.select("id", scalars.shoelace2(F.col("pts")).alias("area2"))


_STYLES = ", ".join(f"('{a}', {'NULL' if b is None else repr(b)}, '{c}', {places.DRAW_ORDER.index(a)})" for a, b, c in places.STYLES)


@query(f"""
WITH st(layer, kind, style, z_order) AS (VALUES {_STYLES}),
p AS (SELECT p_partkey AS id, ['earth','landuse','water','roads','buildings','pois','places','other'][CAST(p_partkey % 8 AS BIGINT) + 1] AS layer, ['park','highway','country','rail','grass','locality','odd',NULL][CAST(p_partkey // 8 % 8 AS BIGINT) + 1] AS kind FROM part)
SELECT id, p.layer, p.kind, CASE WHEN p.kind IS NULL THEN 'none' ELSE coalesce(a.style, b.style, 'none') END AS style, b.z_order FROM p LEFT JOIN st a ON a.layer = p.layer AND a.kind = p.kind LEFT JOIN st b ON b.layer = p.layer AND b.kind IS NULL
""")
def style_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Styles of features by layer and kind, with each layer's default."""
    k = F.col("p_partkey")
    layer = F.element_at(F.array(*map(F.lit, (*places.DRAW_ORDER[:7], "other"))), (k % 8 + 1).cast("int"))
    kind = F.element_at(F.array(*map(F.lit, ("park", "highway", "country", "rail", "grass", "locality", "odd", None))), (F.floor(k / 8) % 8 + 1).cast("int"))
    return places.with_style(table(spark, sf_dir, "part").select(k.alias("id"), layer.alias("layer"), kind.alias("kind"))).select("id", "layer", "kind", "style", "z_order")


@query("""
WITH w AS (SELECT event_type, time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS start, arg_max(value, struct_pack(a := ts, b := event_id)) AS last, max(value) AS most, round(avg(value), 6) AS mean FROM events GROUP BY ALL)
SELECT event_type, start, last, most, mean, max(most) OVER (PARTITION BY event_type ORDER BY start ROWS UNBOUNDED PRECEDING) AS peak FROM w
""")
def windowed_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last, most and mean of daily windows and the peak since the start (a day: the events are hours apart)."""
    from geostride.operators.policies import windowed_metrics as metrics

    e = table(spark, sf_dir, "events")
    return metrics(e, "ts", "value", ["event_type"], "1 day").select("event_type", "start", "last", "most", F.round("mean", 6).alias("mean"), "peak")


@query("""
SELECT l_orderkey AS k, l_linenumber AS line,
  CAST((l_partkey >> 1) # (-(l_partkey & 1)) AS INTEGER) AS zigzag,
  CAST(((l_partkey % 256 >> 3) << 11) | ((l_suppkey % 256 >> 2) << 5) | (l_orderkey % 256 >> 3) AS INTEGER) AS rgb,
  CASE WHEN l_orderkey % 9000 < 2500 THEN -1 ELSE CAST(greatest(0, least(100, trunc(((l_orderkey % 9000) // 2 - 3300) * 100 / 850.0::DOUBLE))) AS INTEGER) END AS battery,
  CAST(greatest(200, least(10000, l_partkey % 20000)) AS INTEGER) AS rate,
  CAST(l_partkey * 1099511 % 281474976710656 AS BIGINT) AS bssid,
  round(pow(10.0::DOUBLE, -(l_orderkey % 90) / 10.0::DOUBLE), 12) AS power
FROM lineitem
""".replace("#", "XOR_PLACEHOLDER").replace("(l_partkey >> 1) XOR_PLACEHOLDER (-(l_partkey & 1))", "xor(l_partkey >> 1, -(l_partkey & 1))"))
def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The small scalar functions over line items."""
    p, o, s = F.col("l_partkey"), F.col("l_orderkey"), F.col("l_suppkey")
    mac = p * 1099511 % 281474976710656
    return table(spark, sf_dir, "lineitem").select(
        o.alias("k"), F.col("l_linenumber").alias("line"), scalars.zigzag(p).alias("zigzag"), scalars.rgb565((p % 256).cast("int"), (s % 256).cast("int"), (o % 256).cast("int")).alias("rgb"),
        scalars.battery_percent(o % 9000).alias("battery"), nmea.rate_ms((p % 20000).cast("int")).alias("rate"), scalars.bssid_pack(scalars.bssid_text(mac)).alias("bssid"), F.round(scalars.linear_power(-(o % 90)), 12).alias("power"),
    )


@query(f"""
WITH e AS ({EVENTS_SQL}), s AS (SELECT user_id AS device, epoch_us(ts) AS s_us, event_id AS s_seq FROM events WHERE event_type = 'click')
SELECT device, seq, s_seq FROM (SELECT e.device, e.seq, e.us, s.s_seq, s.s_us, row_number() OVER (PARTITION BY e.device, e.seq ORDER BY s.s_us DESC, s.s_seq DESC) AS k FROM e LEFT JOIN s ON s.device = e.device AND s.s_us <= e.us AND e.us - s.s_us <= 86400000000) WHERE k = 1
""")
def asof_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with the latest click of its device within a day."""
    e = events(spark, sf_dir)
    right = e.filter("event_type = 'click'").select("device", F.col("us").alias("s_us"), F.col("seq").alias("s_seq"))
    return gnss.as_of(e.select("device", "seq", "us"), right, "device", "us", "s_us", within=86400e6).select("device", "seq", F.col("match.s_seq").alias("s_seq"))


@query(f"""
WITH t AS (SELECT {LAT_SQL.format(k=1)} AS tlat, {LON_SQL.format(k=1)} AS tlon), e AS ({EVENTS_SQL}),
h AS (SELECT *, pow(sin(radians(tlat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(tlat)) * pow(sin(radians(tlon - lon) / 2), 2) AS hv FROM e, t WHERE status = 'A')
SELECT device, seq, round(2 * 6371008.8::DOUBLE * atan2(sqrt(hv), sqrt(1 - hv)), 3) AS metres FROM h
""")
def target_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of each fix to the one saved point aimed at."""
    c = customers(spark, sf_dir).select((F.col("id") - 1).cast("int").alias("idx"), "lat", "lon")
    return waypoints.target_range(events(spark, sf_dir), waypoints.set_target(c, 0)).select("device", "seq", F.round("metres", 3).alias("metres"))


@query("""
WITH p AS (SELECT o_custkey AS id, list(struct_pack(k := o_orderkey, x := o_orderkey * 37 % 1000 / 999.0::DOUBLE, y := o_orderkey * 91 % 1000 / 999.0::DOUBLE) ORDER BY o_orderkey) AS pts FROM orders GROUP BY o_custkey)
SELECT id, round(abs(list_sum(list_transform(range(1, len(pts)), lambda i: pts[i].x * pts[i + 1].y - pts[i + 1].x * pts[i].y))) / 2, 9) AS area FROM p WHERE len(pts) > 1
""")
def outline_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas of open rings."""
    o = F.col("o_orderkey")
    p = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.sort_array(F.collect_list(F.struct(o.alias("k"), (o * 37 % 1000 / 999.0).alias("x"), (o * 91 % 1000 / 999.0).alias("y")))).alias("pts"))
    return p.filter(F.size("pts") > 1).select("id", F.round(rings.ring_area(F.col("pts")), 9).alias("area"))


@query("""
WITH r AS (SELECT l_suppkey AS device, l_orderkey * 10 + l_linenumber AS seq, CASE WHEN l_shipdate < TIMESTAMP '1994-01-01' THEN 0 ELSE 1 END AS theme, l_quantity AS x, l_discount * 400 AS y, l_tax * 500 AS z FROM lineitem)
SELECT device, (max(x) + min(x)) / 2 AS offset_x, round((max(y) + min(y)) / 2, 6) AS offset_y, round((max(z) + min(z)) / 2, 6) AS offset_z,
  round((max(x) - min(x) + max(y) - min(y) + max(z) - min(z)) / 6, 6) AS mean_radius FROM r GROUP BY device
""")
def midrange_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The simple calibration of each device (suppliers as devices)."""
    s = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("device"), F.col("l_quantity").alias("x"), (F.col("l_discount") * 400).alias("y"), (F.col("l_tax") * 500).alias("z"))
    return magnet.midrange(s).select("device", "offset_x", *(r6(F.col(c)).alias(c) for c in ("offset_y", "offset_z", "mean_radius")))


@query(f"""
WITH e AS ({EVENTS_SQL}), f AS (SELECT *, CASE WHEN status <> 'A' OR mode <> 3 THEN 1000 WHEN speed_kmh >= 12 THEN 1000 WHEN speed_kmh >= 4 THEN 2000 ELSE 5000 END AS want FROM e)
SELECT device, seq, want FROM f
""")
def rate_wanted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rate that each fix asks for."""
    from geostride.operators.policies import FAST_MS, IDLE_MS, MOVING_KMH, SLOW_KMH, WALK_MS

    v = F.col("speed_kmh")
    want = F.when((F.col("status") != "A") | (F.col("mode") != 3) | (v >= MOVING_KMH), FAST_MS).when(v >= SLOW_KMH, WALK_MS).otherwise(IDLE_MS)
    return events(spark, sf_dir).select("device", "seq", want.alias("want"))


@query(None)
def calibration_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ellipsoid fits (elimination and judgement in numpy on one row a device)."""
    v = table(spark, sf_dir, "embeddings").select(F.col("label").alias("device"), F.col("vec_id").alias("seq"), *((F.col("embedding")[k].cast("double") * 300).alias(a) for k, a in enumerate("xyz")))
    return magnet.fits(v)


@query("""
WITH RECURSIVE l AS (SELECT s_nationkey AS view, CAST(s_suppkey % 4 AS INTEGER) AS slot, CAST(s_suppkey AS INTEGER) AS ord, CAST(s_suppkey % 5 AS INTEGER) AS rank, s_suppkey * 137 % 1280 AS sx, s_suppkey * 71 % 720 AS sy, 60 + s_suppkey % 90 AS w0 FROM supplier),
b AS (SELECT *, row_number() OVER (PARTITION BY view ORDER BY rank, slot, ord) AS rn, CAST(sx - w0 // 2 - 5 AS INTEGER) AS x, CAST(CASE WHEN rank = 4 THEN sy - 31 ELSE sy - 13 END AS INTEGER) AS y, CAST(w0 + 10 AS INTEGER) AS w, CAST(CASE WHEN rank = 4 THEN 39 ELSE 26 END AS INTEGER) AS h FROM l),
f(view, rn, boxes, ok) AS (SELECT DISTINCT view, 0::BIGINT, CAST([] AS STRUCT(x INTEGER, y INTEGER, w INTEGER, h INTEGER)[]), false FROM b
  UNION ALL SELECT view, rn, CASE WHEN ok THEN list_append(boxes, {'x': x, 'y': y, 'w': w, 'h': h}) ELSE boxes END, ok FROM (
    SELECT b.view, b.rn, f.boxes, b.x, b.y, b.w, b.h, len(f.boxes) < 40 AND NOT (b.x + b.w < 0 OR b.x > 1280 OR b.y + b.h < 0 OR b.y > 720)
      AND len(list_filter(f.boxes, lambda o: b.x < o.x + o.w AND o.x < b.x + b.w AND b.y < o.y + o.h AND o.y < b.y + b.h)) = 0 AS ok FROM f JOIN b ON b.view = f.view AND b.rn = f.rn + 1))
SELECT b.view, ord, x AS left_px, y AS top_px, w AS box_w, h AS box_h FROM f JOIN b USING (view, rn) WHERE ok
""")
def labels_placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy labels of views (suppliers' nations as views; each label depends on those before it)."""
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("view"), (k % 4).cast("int").alias("slot"), k.cast("int").alias("ord"), F.element_at(F.array(*map(F.lit, ("country", "region", "locality", "hood", "poi"))), (k % 5 + 1).cast("int")).alias("style"), (k * 137 % 1280).cast("int").alias("sx"), (k * 71 % 720).cast("int").alias("sy"), (60 + k % 90).cast("int").alias("width_px"), F.lit(20).alias("height_px"), F.col("s_name").alias("text"))
    return places.place_labels(s).select("view", "ord", "left_px", "top_px", "box_w", "box_h")


from geostride.plans import decoding, devices, keeping  # noqa: E402, F401  register their queries
