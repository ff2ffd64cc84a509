"""Sentence streams to position fixes, and what is read off them.

A fix is the state after a sentence: each sentence type sets some of the fields and leaves the rest. Over a batch that is
a forward fill of each field within a device, in the order of seq (arrival). One window per device serves all fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geostride.functions import nmea
from geostride.operators.policies import run_policy

FIELDS = ("status", "utc", "date", "lat", "lon", "course", "speed_kmh", "sats", "hdop", "altitude", "mode")


def parsed(lines: DataFrame, line: str = "line", verify_checksum: bool = False) -> DataFrame:
    """The lines that are sentences with the fields that each one sets (null where it sets none)."""
    rows = lines.filter(F.startswith(line, F.lit("$")))
    if verify_checksum:
        rows = rows.filter(nmea.checksum_ok(F.col(line)))
    # talker and type come from the line itself: a filter on them parts no line into fields
    rows = rows.withColumn("talker", F.substring(line, 2, 2)).withColumn("type", F.substring(line, 4, 3)).withColumn("f", nmea.fields(F.col(line))).withColumn("n", F.size("f"))
    f = lambda k: F.get("f", F.lit(k))
    is_ = lambda t: (F.col("type") == t) & (F.col("n") >= nmea.LEAST_FIELDS[t])
    status = F.when(is_("RMC"), F.when(f(2) == "", "V").otherwise(F.substring(f(2), 1, 1)))
    sets = {
        "status": status, "utc": F.when(is_("RMC"), f(1)), "date": F.when(is_("RMC"), f(9)),
        "lat": F.when(is_("RMC") & (status == "A"), nmea.coordinate(f(3), f(4))), "lon": F.when(is_("RMC") & (status == "A"), nmea.coordinate(f(5), f(6))),
        "course": F.when(is_("VTG"), nmea.as_float(f(1))), "speed_kmh": F.when(is_("VTG"), nmea.as_float(f(7))),
        "sats": F.when(is_("GGA"), nmea.as_int(f(7))), "hdop": F.when(is_("GGA"), F.when(f(8) == "", 99.99).otherwise(nmea.as_float(f(8)))), "altitude": F.when(is_("GGA"), nmea.as_float(f(9))),
        "set_mode": F.when(is_("GSA"), nmea.as_int(f(2))),
    }
    for name, value in sets.items():
        rows = rows.withColumn(name, value)
    return rows


def fixes(lines: DataFrame, device: str = "device", seq: str = "seq", line: str = "line", mode_policy: str = "compat", verify_checksum: bool = False) -> DataFrame:
    """The state after every sentence. mode_policy compat: the mode only rises, until a 1 sets it back; latest: as sent."""
    rows = parsed(lines, line, verify_checksum)
    w = Window.partitionBy(device).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    default = {"status": F.lit("V"), "utc": F.lit(""), "date": F.lit(""), "hdop": F.lit(99.99), "sats": F.lit(0)}
    for name in FIELDS[:-1]:
        rows = rows.withColumn(name, F.coalesce(F.last(name, ignorenulls=True).over(w), default.get(name, F.lit(0.0))))
    if mode_policy == "latest":
        mode = F.last("set_mode", ignorenulls=True).over(w)
    else:
        rows = rows.withColumn("_reset", F.sum(F.when(F.col("set_mode") == 1, 1).otherwise(0)).over(w))
        mode = F.max("set_mode").over(Window.partitionBy(device, "_reset").orderBy(seq).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("mode", F.coalesce(mode, F.lit(0)))
    return rows.drop("set_mode", "_reset", "f", "n", "talker")


def constellations(lines: DataFrame, device: str = "device", seq: str = "seq", line: str = "line") -> DataFrame:
    """(device, con, group_no, seq, visible, best_snr, worst_snr) after each visibility sentence: a message 1 starts a
    new group; best and worst are over the tracked satellites of the group so far; 0 means none."""
    f = lambda k: F.get("f", F.lit(k))
    rows = parsed(lines, line).filter(F.col("type") == "GSV").withColumn("con", nmea.constellation(F.col("talker"))).filter("con >= 0")
    # a sentence has up to five signals, in fields 7, 11, ..
    whole = F.col("n") >= nmea.LEAST_FIELDS["GSV"]
    signal = lambda k: F.when(F.col("n") > k, nmea.as_int(f(k)))
    places = range(7, nmea.MAX_FIELDS, 4)
    rows = rows.select(device, "con", seq, whole.alias("_whole"), F.when(whole, nmea.as_int(f(2))).alias("_message"), nmea.as_int(f(3)).alias("visible"), *(signal(k).alias(f"_{k}") for k in places))
    signals = [F.when(F.col("_whole") & (F.col(f"_{k}") > 0), F.col(f"_{k}")) for k in places]
    rows = rows.withColumn("_best", F.greatest(*signals)).withColumn("_worst", F.least(*signals))
    w = Window.partitionBy(device, "con").orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("group_no", F.sum(F.when(F.col("_message") == 1, 1).otherwise(0)).over(w))
    g = Window.partitionBy(device, "con", "group_no").orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    best, worst = F.max("_best").over(g), F.min("_worst").over(g)
    # cut sentences add nothing above; they go last, as a filter before would part every line once more
    rows = rows.withColumn("best_snr", F.coalesce(best, F.lit(0))).withColumn("worst_snr", F.coalesce(worst, F.lit(0))).filter("_whole")
    return rows.select(device, "con", "group_no", seq, "visible", "best_snr", "worst_snr")


def first_fix_times(fix_rows: DataFrame, device: str = "device", ts: str = "ts") -> DataFrame:
    """(device, first_coarse, first_fine)."""
    return fix_rows.groupBy(device).agg(F.min(F.when(nmea.coarse(F.col("status")), F.col(ts))).alias("first_coarse"), F.min(F.when(nmea.fine(F.col("status"), F.col("mode"), F.col("hdop")), F.col(ts))).alias("first_fine"))


def pps_intervals(pulses: DataFrame, device: str = "device", ms: str = "ms", below_ms: int = 2000) -> DataFrame:
    """Intervals between pulses, those under below_ms."""
    rows = pulses.withColumn("interval_ms", F.col(ms) - F.lag(ms).over(Window.partitionBy(device).orderBy(ms)))
    return rows.filter(F.col("interval_ms") < below_ms)


def changed_fixes(fix_rows: DataFrame, keys: tuple[str, ...] = ("lat", "lon", "status"), device: str = "device", ms: str = "ms", hold_ms: int = 1000) -> DataFrame:
    """Fixes without those that repeat the row before within hold_ms of the last one let through. In a run of equal rows
    one passes each time hold_ms have gone by since the one before that passed: a fold over each device's sorted rows."""

    def step(s: dict | None, r: dict) -> tuple[dict, dict]:
        now = tuple(r[k] for k in keys)
        passes = s is None or now != s["row"] or r[ms] - s["passed"] >= hold_ms
        return {"row": now, "passed": r[ms] if passes else s["passed"]}, {"_passes": passes}

    return run_policy(fix_rows, step, "_passes boolean", device, ms).filter("_passes").drop("_passes")


def silent_since(fix_rows: DataFrame, device: str = "device", ms: str = "ms", limit_ms: int = 3000) -> DataFrame:
    """(device, from_ms, to_ms) of the gaps without any sentence longer than limit_ms."""
    w = Window.partitionBy(device).orderBy(ms)
    return fix_rows.select(device, F.col(ms).alias("from_ms"), F.lead(ms).over(w).alias("to_ms")).filter(F.col("to_ms") - F.col("from_ms") > limit_ms)


def antenna_suspect(rows: DataFrame, device: str = "device", ms: str = "ms", after_ms: int = 90_000) -> DataFrame:
    """Adds suspect: no satellite and no signal seen up to this row, and later than after_ms. rows: visible, best_snr."""
    seen = F.max(((F.col("visible") > 0) | (F.col("best_snr") > 0)).cast("int")).over(Window.partitionBy(device).orderBy(ms).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("suspect", (seen == 0) & (F.col(ms) > after_ms))


def effective_position(fix_rows: DataFrame, estimate: str = "est") -> DataFrame:
    """Fixes with an estimate struct (lat, lon, acc; null if none is fresh): where a fix has no position, the estimate
    stands in for it."""
    use = (F.col("status") != "A") & F.col(estimate).isNotNull()
    pick = lambda c, v: F.when(use, v).otherwise(F.col(c))
    values: dict[str, Column] = {
        "lat": F.col(f"{estimate}.lat"), "lon": F.col(f"{estimate}.lon"), "mode": F.lit(2), "hdop": F.greatest(F.col(f"{estimate}.acc") / 20.0, F.lit(3.0)),
        "speed_kmh": F.lit(0.0), "course": F.lit(0.0), "status": F.lit("A"),
    }
    return fix_rows.withColumns({"estimated": use} | {c: pick(c, v) for c, v in values.items()})


def as_of(left: DataFrame, right: DataFrame, on: str, ts: str, right_ts: str, value: str = "match", within: float | None = None) -> DataFrame:
    """left with struct `value`: the latest row of right with the same `on` at or before its time, not older than
    `within`. A union in time order and a forward fill: one exchange, one sort, no pairs."""
    columns = left.columns
    payload = F.struct(*(F.col(c) for c in right.columns if c != on))
    l_rows = left.withColumn("_t", F.col(ts).cast("double")).withColumn("_side", F.lit(1)).withColumn("_p", F.lit(None).cast(right.select(payload.alias("p")).schema["p"].dataType))
    r_rows = right.select(F.col(on), F.col(right_ts).cast("double").alias("_t"), F.lit(0).alias("_side"), payload.alias("_p"))
    w = Window.partitionBy(on).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    rows = l_rows.unionByName(r_rows, allowMissingColumns=True).withColumn(value, F.last("_p", ignorenulls=True).over(w)).filter("_side = 1")
    if within is not None:
        rows = rows.withColumn(value, F.when(F.col("_t") - F.col(f"{value}.{right_ts}").cast("double") <= within, F.col(value)))
    return rows.select(*columns, value)
