"""Columns derived from the driver's tables by whole-number arithmetic that every engine does alike. They hold no real
positions: a query over them shows that an operator computes what it says, nothing about receivers or maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geostride.session import table


def spread(key: Column, factor: int, modulus: int) -> Column:
    """0 <= x < 1, from an id."""
    return (key.cast("long") * factor % modulus) / float(modulus)


def lat_of(key: Column) -> Column:
    return spread(key, 48271, 1000003) * 160.0 - 80.0


def lon_of(key: Column) -> Column:
    return spread(key, 69621, 999983) * 360.0 - 180.0


LAT_SQL = "((CAST({k} AS BIGINT) * 48271 % 1000003) / 1000003.0::DOUBLE * 160.0::DOUBLE - 80.0::DOUBLE)"
LON_SQL = "((CAST({k} AS BIGINT) * 69621 % 999983) / 999983.0::DOUBLE * 360.0::DOUBLE - 180.0::DOUBLE)"


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, lat, lon)."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("id"), lat_of(k).alias("lat"), lon_of(k).alias("lon"))


CUSTOMERS_SQL = f"SELECT c_custkey AS id, {LAT_SQL.format(k='c_custkey')} AS lat, {LON_SQL.format(k='c_custkey')} AS lon FROM customer"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixes of a device (the user): ts in seconds, a walk around the device's place, speed, altitude, status, mode, hdop."""
    e, u, i = table(spark, sf_dir, "events"), F.col("user_id"), F.col("event_id")
    h = i.cast("long") * 7919 % 1009
    return e.select(
        u.alias("device"), i.alias("seq"), F.expr("unix_micros(cast(ts as timestamp))").alias("us"), (F.expr("unix_micros(cast(ts as timestamp))") / 1e6).alias("ts"), F.col("ts").alias("at"),
        (lat_of(u) * 0.5 + h / 1009.0 * 0.4).alias("lat"), (lon_of(u) * 0.5 + (h % 101) / 101.0 * 0.4).alias("lon"),
        (h % 97).cast("double").alias("speed_kmh"), F.when(h % 5 == 0, (h % 31 - 10) * 500.0).otherwise(120.0).alias("altitude"),
        F.when(h % 11 == 0, "V").otherwise("A").alias("status"), (h % 3 + 1).cast("int").alias("mode"), (h % 40 / 10.0).alias("hdop"), F.col("event_type"), F.col("value"),
    )


EVENTS_SQL = f"""
SELECT user_id AS device, event_id AS seq, epoch_us(ts) AS us, epoch_us(ts) / 1e6::DOUBLE AS ts, ts AS "at",
  {LAT_SQL.format(k='user_id')} * 0.5::DOUBLE + h / 1009.0::DOUBLE * 0.4::DOUBLE AS lat, {LON_SQL.format(k='user_id')} * 0.5::DOUBLE + (h % 101) / 101.0::DOUBLE * 0.4::DOUBLE AS lon,
  CAST(h % 97 AS DOUBLE) AS speed_kmh, CASE WHEN h % 5 = 0 THEN (h % 31 - 10) * 500.0::DOUBLE ELSE 120.0::DOUBLE END AS altitude,
  CASE WHEN h % 11 = 0 THEN 'V' ELSE 'A' END AS status, CAST(h % 3 + 1 AS INTEGER) AS mode, h % 40 / 10.0::DOUBLE AS hdop, event_type, value
FROM (SELECT *, CAST(event_id AS BIGINT) * 7919 % 1009 AS h FROM events)
"""

#: An order of the line items without ties (their line numbers repeat).
SEQ_SQL = "((((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey) * 100 + CAST(l_quantity AS BIGINT))"


def line_seq():
    c = F.col
    return (((c("l_orderkey") * 10 + c("l_linenumber")) * 100000 + c("l_partkey")) * 10000 + c("l_suppkey")) * 100 + c("l_quantity").cast("long")


#: DuckDB: fractional tile coordinates at zoom z of lat, lon.
FX = "((lon + 180.0::DOUBLE) / 360.0::DOUBLE * {n}::DOUBLE)"
FY = "((1.0::DOUBLE - asinh(tan(radians(greatest(-85.05112877980659::DOUBLE, least(85.05112877980659::DOUBLE, lat))))) / pi()) / 2.0::DOUBLE * {n}::DOUBLE)"
#: DuckDB: Hilbert id of (z, x, y) rows in t(k, z, x, y), walked bit by bit.
HILBERT = """
walk(k, z, b, d, x, y) AS (
  SELECT k, z, z - 1, 0::BIGINT, x::BIGINT, y::BIGINT FROM t
  UNION ALL
  SELECT k, z, b - 1,
    d + (1::BIGINT << (2 * b)) * (CASE WHEN (y >> b) = 0 THEN 3 * (x >> b) ELSE (x >> b) + 1 END),
    CASE WHEN (y >> b) = 0 THEN (CASE WHEN (x >> b) = 1 THEN (1::BIGINT << b) - 1 - (y & ((1::BIGINT << b) - 1)) ELSE (y & ((1::BIGINT << b) - 1)) END) ELSE (x & ((1::BIGINT << b) - 1)) END,
    CASE WHEN (y >> b) = 0 THEN (CASE WHEN (x >> b) = 1 THEN (1::BIGINT << b) - 1 - (x & ((1::BIGINT << b) - 1)) ELSE (x & ((1::BIGINT << b) - 1)) END) ELSE (y & ((1::BIGINT << b) - 1)) END
  FROM walk WHERE b >= 0),
ids AS (SELECT k, ((1::BIGINT << (2 * z)) - 1) // 3 + d AS tile_id FROM walk WHERE b = -1)
"""
