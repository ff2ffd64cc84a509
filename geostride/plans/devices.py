"""Queries over what a device keeps and decides: its files, its folds from row to row, its checks. Files are written below
the shared folder and read back; folds are recursions in DuckDB, a row of every device at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geostride.functions import compass, geo, nmea, scalars, sun, tiles
from geostride.operators import archive, coverage, gnss, magnet, places, policies, rings, trust, waypoints, wifi
from geostride.plans.registry import query
from geostride.plans.surrogates import CUSTOMERS_SQL, EVENTS_SQL, FX, FY, HILBERT, LAT_SQL, LON_SQL, SEQ_SQL, customers, events, line_seq
from geostride.session import fresh_path, table
from geostride.sources import tables

r6 = lambda c: F.round(c, 6)
FLAT = "sqrt(pow({dlon} * 111320.0::DOUBLE * cos(radians({at})), 2) + pow({dlat} * 111320.0::DOUBLE, 2))"


def folded(rows: str, start: str, step: str, out: str) -> str:
    """SQL of a fold. rows: a query with device, seq, ms and what the step reads. start: the state before the first row of
    a device; step: the state after a row, as expressions over s (the state before) and r (the row); out: the result's
    columns over f (states with their rows)."""
    return f"""
WITH RECURSIVE e AS ({EVENTS_SQL}), g AS ({rows}),
r AS (SELECT *, row_number() OVER (PARTITION BY device ORDER BY ms, seq) AS rn FROM g),
s AS (SELECT DISTINCT device, 0::BIGINT AS rn, 0::BIGINT AS seq, {start} FROM g UNION ALL SELECT r.device, r.rn, r.seq, {step} FROM s JOIN r ON r.device = s.device AND r.rn = s.rn + 1)
SELECT {out} FROM s f JOIN r USING (device, rn, seq)"""


ROWS = "SELECT *, us // 1000 AS ms FROM e"


def timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).withColumn("ms", F.floor(F.col("us") / 1000))


_want = "CASE WHEN r.status <> 'A' OR r.mode <> 3 OR r.speed_kmh >= 12 THEN 1000 WHEN r.speed_kmh >= 4 THEN 2000 ELSE 5000 END"
_settled = f"{_want} = s.pending AND r.ms - s.since >= 10000 AND (s.changed IS NULL OR r.ms - s.changed >= 10000)"


@query(folded(
    ROWS, "1000 AS rate, 0 AS pending, 0::BIGINT AS since, NULL::BIGINT AS changed",
    f"CASE WHEN {_want} <> s.rate AND {_settled} THEN {_want} ELSE s.rate END, CASE WHEN {_want} = s.rate OR ({_settled}) THEN 0 ELSE {_want} END, CASE WHEN {_want} <> s.rate AND {_want} <> s.pending THEN r.ms ELSE s.since END, CASE WHEN {_want} <> s.rate AND {_settled} THEN r.ms ELSE s.changed END",
    "device, seq, CAST(f.rate AS INTEGER) AS rate_ms",
))
def rate_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The receiver's rate in force after each fix."""
    e = timed(spark, sf_dir).select("device", "seq", "ms", "status", "mode", "speed_kmh")
    return policies.run_policy(e, policies.rate_step, "rate_ms int").select("device", "seq", "rate_ms")


_fine = "(r.status = 'A' AND r.mode = 3 AND r.hdop > 0 AND r.hdop < 2.5)"
_go = f"({_fine} AND (s.at IS NULL OR r.ms - s.at >= 20000) AND r.speed_kmh <= 12 AND (s.lat IS NULL OR {FLAT.format(dlon='(r.lon - s.lon)', dlat='(r.lat - s.lat)', at='r.lat')} >= 40))"
_locate = f"(NOT {_fine} AND r.status <> 'A' AND s.lost IS NOT NULL AND r.ms - s.lost >= 15000 AND (s.located IS NULL OR r.ms - s.located >= 20000))"


@query(folded(
    ROWS, "NULL::BIGINT AS at, NULL::DOUBLE AS lat, NULL::DOUBLE AS lon, NULL::BIGINT AS lost, NULL::BIGINT AS located, 'none' AS why",
    f"CASE WHEN {_go} THEN r.ms ELSE s.at END, CASE WHEN {_go} THEN r.lat ELSE s.lat END, CASE WHEN {_go} THEN r.lon ELSE s.lon END, CASE WHEN r.status = 'A' THEN NULL ELSE coalesce(s.lost, r.ms) END, CASE WHEN {_locate} THEN r.ms ELSE s.located END, CASE WHEN {_go} THEN 'learn' WHEN {_locate} THEN 'locate' ELSE 'none' END",
    "device, seq, f.why AS why",
).replace("s.at", "s.at_ms").replace(" AS at,", " AS at_ms,"))
def survey_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When a device would scan, and why."""
    e = timed(spark, sf_dir).select("device", "seq", "ms", "status", "mode", "hdop", "speed_kmh", "lat", "lon")
    return policies.run_policy(e, policies.survey_step, "why string").select("device", "seq", "why")


_zoom = "CASE WHEN r.speed_kmh > 25 OR (r.speed_kmh > 15 AND s.zoom = 12) THEN 12 ELSE 15 END"


@query(folded(ROWS, "15 AS zoom, -8000::BIGINT AS changed", f"CASE WHEN {_fine} AND r.ms - s.changed >= 8000 THEN {_zoom} ELSE s.zoom END, CASE WHEN {_fine} AND r.ms - s.changed >= 8000 AND {_zoom} <> s.zoom THEN r.ms ELSE s.changed END", "device, seq, CAST(f.zoom AS INTEGER) AS zoom"))
def zoom_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zoom by speed, with a dead band and a hold."""
    e = timed(spark, sf_dir).select("device", "seq", "ms", "status", "mode", "hdop", "speed_kmh")
    return policies.run_policy(e, policies.zoom_step(12, 15), "zoom int").select("device", "seq", "zoom")


_dark = "CASE r.theme WHEN 'day' THEN false WHEN 'night' THEN true ELSE NOT r.sun_up END"
_flips = f"({_dark} <> s.dark AND (r.theme <> s.theme OR s.flip IS NULL OR r.ms - s.flip > 30000))"


@query(folded("SELECT *, us // 1000 AS ms, CASE seq % 7 WHEN 0 THEN 'day' WHEN 1 THEN 'night' ELSE 'auto' END AS theme, seq % 3 = 0 AS sun_up FROM e", "false AS dark, NULL::BIGINT AS flip, 'auto' AS theme", f"CASE WHEN {_flips} THEN {_dark} ELSE s.dark END, CASE WHEN {_flips} THEN r.ms ELSE s.flip END, r.theme", "device, seq, f.dark AS dark"))
def theme_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Palette by theme or sun, with a hold on automatic changes."""
    s = F.col("seq")
    e = timed(spark, sf_dir).select("device", "seq", "ms", F.when(s % 7 == 0, "day").when(s % 7 == 1, "night").otherwise("auto").alias("theme"), (s % 3 == 0).alias("sun_up"))
    return policies.run_policy(e, policies.theme_step, "dark boolean").select("device", "seq", "dark")


_axis = lambda v, w, o, span: "least(greatest(CASE WHEN {v} < {w} - {span} * 2 / 3.0::DOUBLE THEN {w} - {span} / 3.0::DOUBLE WHEN {v} > {w} - {span} / 3.0::DOUBLE THEN {w} - {span} * 2 / 3.0::DOUBLE ELSE {v} END, {o}), {o} + 2 - {span})".format(v=v, w=w, o=o, span=span)


@query(folded("SELECT *, us // 1000 AS ms, 10 + seq % 37 / 37.0::DOUBLE * 2 AS wx, 20 + seq % 53 / 53.0::DOUBLE * 2 AS wy FROM e", "NULL::DOUBLE AS x, NULL::DOUBLE AS y", f"CASE WHEN s.rn = 0 THEN r.wx - 0.6::DOUBLE ELSE {_axis('s.x', 'r.wx', '10', '1.2::DOUBLE')} END, CASE WHEN s.rn = 0 THEN r.wy - 0.4::DOUBLE ELSE {_axis('s.y', 'r.wy', '20', '0.8::DOUBLE')} END", "device, seq, round(f.x, 6) AS view_x, round(f.y, 6) AS view_y"))
def view_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view that follows its marker with a dead band."""
    s = F.col("seq")
    e = timed(spark, sf_dir).select("device", "seq", "ms", (10 + s % 37 / 37.0 * 2).alias("wx"), (20 + s % 53 / 53.0 * 2).alias("wy"), F.lit(10.0).alias("ox"), F.lit(20.0).alias("oy"))
    return policies.run_policy(e, policies.view_step(1.2, 0.8), "view_x double, view_y double").select("device", "seq", r6("view_x").alias("view_x"), r6("view_y").alias("view_y"))


_seen = "(coalesce(r.ms - r.touch_ms < 120000, false) OR coalesce(r.ms - r.motion_ms < 15000, false))"
_hav = "2 * 6371008.8::DOUBLE * asin(least(1.0::DOUBLE, sqrt(pow(sin(radians(s.lat - r.lat) / 2), 2) + cos(radians(r.lat)) * cos(radians(s.lat)) * pow(sin(radians(s.lon - r.lon) / 2), 2))))"
_away = f"({_hav} >= 25)"
_anchor = f"(s.lat IS NULL OR {_away} OR r.ms - s.since >= 30000)"
_lost = "(r.status <> 'A' OR r.mode <> 3)"


@query(folded(
    "SELECT *, us // 1000 AS ms, CASE WHEN seq % 4 = 0 THEN us // 1000 - 60000 END AS touch_ms, CASE WHEN seq % 5 = 0 THEN us // 1000 - seq % 40 * 1000 END AS motion_ms, CASE WHEN seq % 3 = 0 THEN us // 1000 - seq % 90 * 1000 END AS stir_ms, CASE WHEN seq % 2 = 0 THEN 5000 ELSE 1000 END AS rate_ms FROM e",
    "NULL::DOUBLE AS lat, NULL::DOUBLE AS lon, 0::BIGINT AS since, false AS dimmed",
    f"CASE WHEN {_seen} THEN s.lat WHEN {_lost} THEN NULL WHEN {_anchor} THEN r.lat ELSE s.lat END, CASE WHEN {_seen} THEN s.lon WHEN {_lost} THEN NULL WHEN {_anchor} THEN r.lon ELSE s.lon END, CASE WHEN {_seen} THEN s.since WHEN {_lost} THEN 0 WHEN {_anchor} THEN r.ms ELSE s.since END, NOT {_seen} AND r.rate_ms = 5000 AND NOT (NOT {_lost} AND s.lat IS NOT NULL AND {_away} AND coalesce(r.ms - r.stir_ms < 60000, false))",
    "device, seq, coalesce(f.dimmed, r.rate_ms = 5000) AS dimmed",
))
def dim_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the screen is dimmed, by touch, motion and an anchor."""
    s, ms = F.col("seq"), F.col("ms")
    e = timed(spark, sf_dir).select(
        "device", "seq", "ms", "status", "mode", "lat", "lon", F.when(s % 4 == 0, ms - 60000).alias("touch_ms"), F.when(s % 5 == 0, ms - s % 40 * 1000).alias("motion_ms"),
        F.when(s % 3 == 0, ms - s % 90 * 1000).alias("stir_ms"), F.when(s % 2 == 0, 5000).otherwise(1000).alias("rate_ms"),
    )
    return policies.run_policy(e, policies.dim_step, "dimmed boolean").select("device", "seq", "dimmed")


_passes = "(s.rn = 0 OR s.lat IS DISTINCT FROM r.lat2 OR s.status IS DISTINCT FROM r.status OR r.ms - s.passed >= 200000000)"


@query(folded("SELECT *, us // 1000 AS ms, CAST(seq % 2 AS DOUBLE) AS lat2 FROM e", "NULL::DOUBLE AS lat, NULL::VARCHAR AS status, NULL::BIGINT AS passed, false AS passes", f"r.lat2, r.status, CASE WHEN {_passes} THEN r.ms ELSE s.passed END, {_passes}", "device, seq") + " WHERE f.passes")
def changed_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixes without repeats of the one before (within two days and some: the events are hours apart)."""
    e = timed(spark, sf_dir).select("device", "seq", "ms", "status", (F.col("seq") % 2).cast("double").alias("lat"))
    return gnss.changed_fixes(e, ("lat", "status"), hold_ms=200_000_000).select("device", "seq")


@query(folded(
    """SELECT p.* FROM (SELECT o.*, row_number() OVER (PARTITION BY device, sample ORDER BY ms, seq) AS nth FROM (
      SELECT a.device, a.seq, a.us // 1000 AS ms, max(b.us // 1000) AS sample_ms, arg_max(b.seq, b.us) AS sample FROM e a JOIN e b ON a.device = b.device AND b.event_type = 'click' AND b.us <= a.us AND a.us // 1000 - b.us // 1000 <= 86400000
      WHERE a.status = 'A' AND a.mode = 3 AND a.hdop > 0 AND a.hdop < 2.5 AND a.speed_kmh >= 8 GROUP BY ALL) o) p WHERE nth = 1""",
    "NULL::BIGINT AS last, false AS passes", "CASE WHEN s.last IS NULL OR r.ms - s.last >= 100000000 THEN r.ms ELSE s.last END, s.last IS NULL OR r.ms - s.last >= 100000000", "device, seq, r.sample AS sample") + " WHERE f.passes")
def paired_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixes with a usable course and the latest sample (clicks; fresh for a day, a row a day and some)."""
    e = timed(spark, sf_dir)
    samples = e.filter("event_type = 'click'").select("device", "seq", "ms")
    out = magnet.paired_log(e.select("device", "seq", "ms", "status", "mode", "hdop", "speed_kmh"), samples, fresh_ms=86_400_000, every_ms=100_000_000)
    return out.select("device", "seq", F.col("sample.seq").alias("sample"))


@query(f"""
WITH RECURSIVE m AS (SELECT l_suppkey AS device, {SEQ_SQL} AS seq, (l_orderkey * 7919 + l_linenumber * 31) % 1009 AS h FROM lineitem),
r AS (SELECT *, h * 3.0::DOUBLE AS ax, h % 100 * 5.0::DOUBLE AS ay, row_number() OVER (PARTITION BY device ORDER BY seq) AS rn FROM m),
s AS (SELECT device, rn, seq, ax AS x, ay AS y, 16000.0::DOUBLE AS z, 0.0::DOUBLE AS dev, false AS large, false AS moved FROM r WHERE rn = 1
  UNION ALL SELECT r.device, r.rn, r.seq, s.x + 0.08::DOUBLE * (r.ax - s.x), s.y + 0.08::DOUBLE * (r.ay - s.y), s.z, sqrt(pow(r.ax - s.x, 2) + pow(r.ay - s.y, 2)), sqrt(pow(r.ax - s.x, 2) + pow(r.ay - s.y, 2)) > 1500, s.large AND sqrt(pow(r.ax - s.x, 2) + pow(r.ay - s.y, 2)) > 1500
  FROM s JOIN r ON r.device = s.device AND r.rn = s.rn + 1)
SELECT device, seq, round(dev, 1) AS deviation, dev > 500 AS stirred, moved FROM s""")
def motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Motion flags over smoothed gravity (a recursion, worked out in blocks)."""
    h = (F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 31) % 1009
    s = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("device"), line_seq().alias("seq"), (h * 3.0).alias("ax"), (h % 100 * 5.0).alias("ay"), F.lit(16000.0).alias("az"))
    return magnet.motion_flags(s).select("device", "seq", F.round("deviation", 1).alias("deviation"), "stirred", "moved")


EXTRA_SQL = f"""
e AS ({EVENTS_SQL}), x AS (SELECT *, seq * 7919 % 1009 AS h FROM e),
k AS (SELECT *, us // 1000000 + 100000000 AS gnss_epoch, us // 1000000 + 100000000 + CASE WHEN h % 13 = 0 THEN 1000 ELSE 0 END AS rtc_epoch, 800 + h % 400 AS pps_ms,
  h % 12 AS v1, h % 50 AS b1, h % 47 AS w1, h % 7 AS v2, h % 45 AS b2, h % 43 AS w2, lat + 0.05::DOUBLE * (h % 3) AS wlat, lon AS wlon, h % 5 * 100.0::DOUBLE AS acc, h % 9 AS used, h % 90 AS age FROM x)
"""


@query(f"""
WITH {EXTRA_SQL},
s AS (SELECT *, sum(CASE WHEN status <> 'A' THEN 1 ELSE 0 END) OVER (PARTITION BY device ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS session FROM k),
l AS (SELECT *, lag(status) OVER w AS ps, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon, lag(ts) OVER w AS pts, lag(altitude) OVER w AS palt FROM s WINDOW w AS (PARTITION BY device, session ORDER BY ts, seq)),
m AS (SELECT *, CASE WHEN ps = 'A' THEN {FLAT.format(dlon='(lon - plon)', dlat='(lat - plat)', at='(plat + lat) * 0.5::DOUBLE')} END AS moved, CASE WHEN ps = 'A' THEN ts - pts END AS dt, CASE WHEN ps = 'A' THEN abs(altitude - palt) END AS step FROM l),
v AS (SELECT *, CASE WHEN dt > 0.25 THEN moved / dt * 3.6::DOUBLE END AS kmh, status = 'A' AND (altitude < -450 OR altitude > 12000) AS alt_out FROM m),
a AS (SELECT *, status = 'A' AND NOT alt_out AND step IS NOT NULL AS acting, status = 'A' AND NOT alt_out AND step IS NOT NULL AND step < 0.01 AND moved > 20 AS still FROM v),
b AS (SELECT *, sum(CASE WHEN acting AND NOT still THEN 1 ELSE 0 END) OVER (PARTITION BY device ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS run FROM a),
c AS (SELECT *, sum(CASE WHEN still THEN 1 ELSE 0 END) OVER (PARTITION BY device, run ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS same FROM b),
t AS (SELECT *, v1 > 0 AND b1 > 0 AS t1, v2 > 0 AND b2 > 0 AS t2 FROM c),
q AS (SELECT *, CASE WHEN status <> 'A' THEN 0 ELSE CAST(coalesce(kmh > 400, false) AS INTEGER)
  + 2 * CAST(coalesce(kmh IS NOT NULL AND greatest(speed_kmh, kmh) > 15 AND (greatest(speed_kmh, kmh) - least(speed_kmh, kmh)) / greatest(speed_kmh, kmh) > 0.5, false) AS INTEGER)
  + 4 * CAST(gnss_epoch > 0 AND rtc_epoch > 1767225600 AND abs(gnss_epoch - rtc_epoch) > 180 AS INTEGER)
  + 8 * CAST(coalesce(v1 + v2 >= 8 AND t1 AND t2 AND greatest(b1, b2) - least(CASE WHEN w1 > 0 THEN w1 END, CASE WHEN w2 > 0 THEN w2 END) < 4, false) AS INTEGER)
  + 16 * CAST(mode >= 3 AND (pps_ms < 900 OR pps_ms > 1100) AS INTEGER)
  + 32 * CAST(used >= 5 AND age <= 60 AND {FLAT.format(dlon='(wlon - lon)', dlat='(wlat - lat)', at='(lat + wlat) * 0.5::DOUBLE')} > 3000 + acc AS INTEGER)
  + 64 * CAST(alt_out OR (still AND same > 30) AS INTEGER) END AS raised FROM t),
h AS (SELECT *, {', '.join(f'max(CAST(raised AS BIGINT) & {1 << k}) OVER w AS f{k}' for k in range(7))} FROM q WINDOW w AS (PARTITION BY device ORDER BY ts RANGE BETWEEN 43200.0 PRECEDING AND CURRENT ROW)),
o AS (SELECT *, f0 + f1 + f2 + f3 + f4 + f5 + f6 AS flags FROM h),
p AS (SELECT *, CASE WHEN status = 'A' THEN CASE bit_count(flags) WHEN 0 THEN 'OK' WHEN 1 THEN 'ODD' ELSE 'BAD' END END AS own FROM o)
SELECT device, seq, CAST(flags AS INTEGER) AS flags, CASE WHEN status = 'A' THEN own WHEN flags = 0 THEN 'UNKNOWN' ELSE coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY device ORDER BY ts, seq ROWS UNBOUNDED PRECEDING), 'UNKNOWN') END AS level FROM p
""")
def trust_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All seven checks of a fix, held, with the level."""
    h, us = F.col("seq") * 7919 % 1009, F.col("us")
    epoch = F.floor(us / 1_000_000) + 100_000_000
    con = lambda v, b, w: F.struct((h % v).cast("int").alias("visible"), (h % b).cast("int").alias("best_snr"), (h % w).cast("int").alias("worst_snr"))
    at = F.struct((F.col("lat") + 0.05 * (h % 3)).alias("lat"), F.col("lon").alias("lon"), (h % 5 * 100.0).alias("acc"), (h % 9).alias("used"), (h % 90).cast("double").alias("age_s"))
    e = events(spark, sf_dir).withColumns({"gnss_epoch": epoch, "rtc_epoch": epoch + F.when(h % 13 == 0, 1000).otherwise(0), "cons": F.array(con(12, 50, 47), con(7, 45, 43)), "pps_ms": 800 + h % 400, "wifi": at})
    return trust.trust(e, hold_s=43200.0).select("device", "seq", "flags", "level")


@query(f"""WITH e AS ({EVENTS_SQL}) SELECT device, seq, status <> 'A' AND seq % 4 < 2 AS estimated, CASE WHEN status <> 'A' AND seq % 4 < 2 THEN 'A' ELSE status END AS status, CASE WHEN status <> 'A' AND seq % 4 < 2 THEN 2 ELSE mode END AS mode,
  CASE WHEN status <> 'A' AND seq % 4 < 2 THEN greatest(seq % 200 / 20.0::DOUBLE, 3.0) ELSE hdop END AS hdop, CASE WHEN status <> 'A' AND seq % 4 < 2 THEN 0.0 ELSE speed_kmh END AS speed_kmh, CASE WHEN status <> 'A' AND seq % 4 < 2 THEN 50.0 ELSE round(lat, 6) END AS lat FROM e""")
def effective_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimates that stand in where a fix has no position."""
    s = F.col("seq")
    e = events(spark, sf_dir).withColumn("course", F.lit(10.0)).withColumn("est", F.when(s % 4 < 2, F.struct(F.lit(50.0).alias("lat"), F.lit(8.0).alias("lon"), (s % 200).cast("double").alias("acc"))))
    return gnss.effective_position(e).select("device", "seq", "estimated", "status", "mode", "hdop", "speed_kmh", r6("lat").alias("lat"))


@query(f"""WITH e AS ({EVENTS_SQL}), p AS (SELECT device, seq, us // 3600000000 AS ms FROM e), l AS (SELECT *, ms - lag(ms) OVER (PARTITION BY device ORDER BY ms, seq) AS interval_ms FROM p)
SELECT device, CAST(interval_ms AS BIGINT) AS interval_ms, count(*) AS n FROM l WHERE interval_ms < 6 GROUP BY ALL""")
def pulse_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short intervals between pulses (an hour of the events as a millisecond)."""
    p = events(spark, sf_dir).select("device", "seq", F.floor(F.col("us") / 3_600_000_000).alias("ms"))
    return gnss.pps_intervals(p, below_ms=6).groupBy("device", "interval_ms").agg(F.count("*").alias("n"))


@query(f"""WITH e AS ({EVENTS_SQL}), a AS (SELECT device, seq, us // 1000 - min(us // 1000) OVER (PARTITION BY device) AS ms, max(CASE WHEN seq % 41 = 7 THEN 1 ELSE 0 END) OVER (PARTITION BY device ORDER BY us // 1000, seq ROWS UNBOUNDED PRECEDING) AS seen FROM e)
SELECT device, seq, seen = 0 AND ms > 90000 AS suspect FROM a""")
def antenna_suspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Devices that have seen no satellite for long."""
    from pyspark.sql import Window

    e = timed(spark, sf_dir).withColumn("ms", F.col("ms") - F.min("ms").over(Window.partitionBy("device")))
    rows = e.select("device", "seq", "ms", F.when(F.col("seq") % 41 == 7, 3).otherwise(0).alias("visible"), F.lit(0).alias("best_snr"))
    return gnss.antenna_suspect(rows).select("device", "seq", "suspect")


@query("""
WITH p AS (SELECT l_orderkey AS k, l_linenumber AS line, CAST(l_orderkey % 34 AS INTEGER) AS d, CAST(l_partkey % 14 AS INTEGER) AS m, CAST(l_suppkey % 100 AS INTEGER) AS y, CAST(l_orderkey % 24 AS INTEGER) AS hh, l_linenumber AS mi, CAST(l_quantity AS INTEGER) AS ss, l_partkey % 19 = 0 AS short FROM lineitem)
SELECT k, line, d, m, y, CASE WHEN short OR m NOT BETWEEN 1 AND 12 OR d NOT BETWEEN 1 AND 31 THEN 0 ELSE CAST(date_diff('day', DATE '1970-01-01', make_date(CASE WHEN y < 80 THEN 2000 + y ELSE 1900 + y END, m, 1)) + d - 1 AS BIGINT) * 86400 + hh * 3600 + mi * 60 + ss END AS epoch,
  NOT short AND m BETWEEN 1 AND 12 AND d BETWEEN 1 AND 31 AND y BETWEEN 26 AND 36 AS plausible FROM p
""")
def sentence_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds of a sentence's time and date, and whether a clock may show that date."""
    o = F.col("l_orderkey")
    p = table(spark, sf_dir, "lineitem").select(o.alias("k"), F.col("l_linenumber").alias("line"), (o % 34).cast("int").alias("d"), (F.col("l_partkey") % 14).cast("int").alias("m"), (F.col("l_suppkey") % 100).cast("int").alias("y"), F.col("l_partkey"), F.col("l_quantity").cast("int").alias("ss"))
    p = p.withColumn("date", F.when(F.col("l_partkey") % 19 == 0, "0101").otherwise(F.format_string("%02d%02d%02d", "d", "m", "y"))).withColumn("utc", F.format_string("%02d%02d%02d.00", F.col("k") % 24, F.col("line"), F.col("ss")))
    return p.select("k", "line", "d", "m", "y", nmea.epoch(F.col("utc"), F.col("date")).alias("epoch"), nmea.plausible_date(F.col("date")).alias("plausible"))
