"""How far a stream of fixes can be trusted: seven checks per fix, held for a while, and a level.

The checks are made once for each fix row of a device (ts in seconds as double, in order; equal times by seq where rows
have it)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geostride.functions.geo import flat_m_mean
from geostride.operators.ordering import in_order

#: Bits by name, in order; bit k is 2^k. Fixed values.
FLAGS = ("jump", "speed", "clock", "sat SNR", "PPS", "wifi disagrees", "altitude")
#: Thresholds of the checks. Fixed values.
HOLD_S = 8.0
MAX_KMH, SPEED_MIN_KMH, SPEED_TOLERANCE = 400.0, 15.0, 0.5
ALT_MIN, ALT_MAX, FREEZE_STEPS, FREEZE_M = -450.0, 12000.0, 30, 20.0
CLOCK_TOLERANCE_S, CLOCK_VALID_FROM = 180, 1767225600
SNR_MIN_SATS, SNR_MIN_SPREAD = 8, 4
PPS_LOW, PPS_HIGH = 900, 1100
WIFI_M, WIFI_USED, WIFI_AGE_S = 3000.0, 5, 60.0


def sessions(fixes: DataFrame, device: str = "device", ts: str = "ts") -> DataFrame:
    """Adds session: a count of the fixes without a position so far; history doesn't reach over one."""
    w = Window.partitionBy(device).orderBy(*in_order(fixes, ts)).rowsBetween(Window.unboundedPreceding, 0)
    return fixes.withColumn("session", F.sum((F.col("status") != "A").cast("int")).over(w))


def with_motion(fixes: DataFrame, device: str = "device", ts: str = "ts") -> DataFrame:
    """Adds session, moved_m, dt_s, implied_kmh (null without a usable row before) and alt_step."""
    rows = sessions(fixes, device, ts)
    w = Window.partitionBy(device, "session").orderBy(*in_order(rows, ts))
    fixed = F.col("status") == "A"
    # the row that opens a session is the one without a position; its successor has no history
    before = lambda c: F.when(F.lag("status").over(w) == "A", F.lag(c).over(w))
    rows = rows.withColumn("moved_m", F.when(fixed, flat_m_mean(before("lat"), before("lon"), F.col("lat"), F.col("lon")))).withColumn("dt_s", F.when(fixed, F.col(ts) - before(ts))).withColumn("alt_step", F.when(fixed, F.abs(F.col("altitude") - before("altitude"))))
    return rows.withColumn("implied_kmh", F.when(F.col("dt_s") > 0.25, F.col("moved_m") / F.col("dt_s") * 3.6))


def with_freeze(rows: DataFrame, device: str = "device", ts: str = "ts") -> DataFrame:
    """Adds alt_out and frozen: the altitude out of range, or unchanged over more than FREEZE_STEPS moving steps in a row.
    A step that moves with the altitude unchanged counts up, another one in range sets the count back; rows out of range,
    without a position or without history leave it alone."""
    fixed = F.col("status") == "A"
    out = fixed & ((F.col("altitude") < ALT_MIN) | (F.col("altitude") > ALT_MAX))
    acting = fixed & ~out & F.col("alt_step").isNotNull()
    still = acting & (F.col("alt_step") < 0.01) & (F.col("moved_m") > FREEZE_M)
    by = in_order(rows, ts)
    w = Window.partitionBy(device).orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("alt_out", out).withColumn("_still", still).withColumn("_run", F.sum((acting & ~still).cast("int")).over(w))
    count = F.sum(F.col("_still").cast("int")).over(Window.partitionBy(device, "_run").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("same_count", count.cast("int")).withColumn("frozen", F.col("_still") & (F.col("same_count") > FREEZE_STEPS)).drop("_still", "_run")


def speed_disagrees(speed: Column, implied: Column) -> Column:
    big, small = F.greatest(speed, implied), F.least(speed, implied)
    return (big > SPEED_MIN_KMH) & ((big - small) / big > SPEED_TOLERANCE)


def snr_bunched(cons: Column) -> Column:
    """cons: array of struct(visible, best_snr, worst_snr)."""
    tracked = F.filter(cons, lambda c: (c["visible"] > 0) & (c["best_snr"] > 0))
    total = F.aggregate(cons, F.lit(0), lambda a, c: a + c["visible"])
    best = F.array_max(F.transform(tracked, lambda c: c["best_snr"]))
    worst = F.array_min(F.transform(F.filter(tracked, lambda c: c["worst_snr"] > 0), lambda c: c["worst_snr"]))
    return F.coalesce((total >= SNR_MIN_SATS) & (F.size(tracked) >= 2) & (best - worst < SNR_MIN_SPREAD), F.lit(False))


def raised(rows: DataFrame) -> Column:
    """Bits that a fix raises itself. Uses the columns that are there: gnss_epoch and rtc_epoch, cons, pps_ms, wifi (a
    struct of lat, lon, acc, used, age_s)."""
    has = rows.columns
    fixed = F.col("status") == "A"
    checks: list[Column] = [F.col("implied_kmh") > MAX_KMH, speed_disagrees(F.col("speed_kmh"), F.col("implied_kmh"))]
    never = F.lit(False)
    checks.append((F.col("gnss_epoch") > 0) & (F.col("rtc_epoch") > CLOCK_VALID_FROM) & (F.abs(F.col("gnss_epoch") - F.col("rtc_epoch")) > CLOCK_TOLERANCE_S) if {"gnss_epoch", "rtc_epoch"} <= {*has} else never)
    checks.append(snr_bunched(F.col("cons")) if "cons" in has else never)
    checks.append((F.col("mode") >= 3) & (F.col("pps_ms") > 0) & ~F.col("pps_ms").between(PPS_LOW, PPS_HIGH) if "pps_ms" in has else never)
    if "wifi" in has:
        apart = flat_m_mean(F.col("lat"), F.col("lon"), F.col("wifi.lat"), F.col("wifi.lon"))
        checks.append((F.col("wifi.used") >= WIFI_USED) & (F.col("wifi.age_s") <= WIFI_AGE_S) & (apart > WIFI_M + F.col("wifi.acc")))
    else:
        checks.append(never)
    checks.append(F.col("alt_out") | F.col("frozen"))
    bits = F.lit(0)
    for k, c in enumerate(checks):
        bits = bits + F.when(fixed & F.coalesce(c, F.lit(False)), 1 << k).otherwise(0)
    return bits


def trust(fixes: DataFrame, device: str = "device", ts: str = "ts", hold_s: float = HOLD_S) -> DataFrame:
    """Adds flags (bits held over the last hold_s seconds), level (UNKNOWN, OK, ODD, BAD) and text. Without a position
    the level before stays as long as a flag is held, and is UNKNOWN after."""
    rows = with_freeze(with_motion(fixes, device, ts), device, ts)
    rows = rows.withColumn("raised", raised(rows))
    # a range in fractions of a second: SQL takes it, the window builder takes whole numbers only
    over = f"over (partition by `{device}` order by `{ts}` range between {float(hold_s)!r}D preceding and current row)"
    held = F.lit(0)
    for k in range(len(FLAGS)):
        held = held + F.expr(f"max(raised & {1 << k}) {over}")
    rows = rows.withColumn("flags", held)
    count = F.bit_count("flags")
    own = F.when(F.col("status") == "A", F.when(count == 0, "OK").when(count == 1, "ODD").otherwise("BAD"))
    last = F.last(own, ignorenulls=True).over(Window.partitionBy(device).orderBy(*in_order(rows, ts)).rowsBetween(Window.unboundedPreceding, 0))
    level = F.when(F.col("status") == "A", own).when(F.col("flags") == 0, "UNKNOWN").otherwise(F.coalesce(last, F.lit("UNKNOWN")))
    return rows.withColumn("level", level).withColumn("text", flag_text(F.col("flags")))


def flag_text(flags: Column) -> Column:
    names = [F.when(flags.bitwiseAND(F.lit(1 << k)) != 0, n) for k, n in enumerate(FLAGS)]
    return F.substring(F.array_join(F.array_compact(F.array(*names)), ", "), 1, 63)
