"""Policies with memory: what a device decides from one fix to the next. Each is a fold over a device's rows in order,
written once as a plain step function and run in batch (a sorted stream of each device, in Arrow batches, with only the
state kept) and in streams (geostride.streaming)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geostride.session import ship

Row = dict[str, Any]
Step = Callable[[Any, Row], tuple[Any, dict]]

FAST_MS, WALK_MS, IDLE_MS = 1000, 2000, 5000
MOVING_KMH, SLOW_KMH, SETTLE_MS = 12.0, 4.0, 10_000
ZOOM_HOLD_MS, WIDE_KMH, CLOSE_KMH = 8000, 25.0, 15.0
DIM_MS, HAND_MS, ANCHOR_MOVE_M, STIR_MS, ANCHOR_MS = 120_000, 15_000, 25.0, 60_000, 30_000
FLIP_MS = 30_000
LOG_MS, FRESH_MS = 1000, 300


def _fine(r: Row) -> bool:
    return r["status"] == "A" and r["mode"] == 3 and 0 < r["hdop"] < 2.5


def _haversine(a: float, b: float, c: float, d: float) -> float:
    from math import asin, cos, radians, sin, sqrt

    h = sin(radians(c - a) / 2) ** 2 + cos(radians(a)) * cos(radians(c)) * sin(radians(d - b) / 2) ** 2
    return 2 * 6371008.8 * asin(min(1.0, sqrt(h)))


def _flat(dlat: float, dlon: float, at: float) -> float:
    from math import cos, hypot, radians

    return hypot(dlon * 111320.0 * cos(radians(at)), dlat * 111320.0)


def rate_step(s: dict | None, r: Row) -> tuple[dict, dict]:
    """Receiver rate: a wanted rate has to hold SETTLE_MS, and changes are that far apart. r: ms, status, mode, speed_kmh."""
    s = s or {"rate": FAST_MS, "pending": 0, "since": 0, "changed": None}
    v = r["speed_kmh"]
    want = FAST_MS if r["status"] != "A" or r["mode"] != 3 or v >= MOVING_KMH else WALK_MS if v >= SLOW_KMH else IDLE_MS
    if want == s["rate"]:
        s["pending"] = 0
    elif want != s["pending"]:
        s["pending"], s["since"] = want, r["ms"]
    elif r["ms"] - s["since"] >= SETTLE_MS and (s["changed"] is None or r["ms"] - s["changed"] >= SETTLE_MS):
        s["rate"], s["changed"], s["pending"] = want, r["ms"], 0
    return s, {"rate_ms": s["rate"]}


def zoom_step(wide: int, close: int) -> Step:
    def step(s: dict | None, r: Row) -> tuple[dict, dict]:
        """Zoom by speed with a dead band; a change holds for ZOOM_HOLD_MS."""
        s = s or {"zoom": close, "changed": -ZOOM_HOLD_MS}
        if wide != close and _fine(r) and r["ms"] - s["changed"] >= ZOOM_HOLD_MS:
            v = r["speed_kmh"]
            want = wide if v > WIDE_KMH or (v > CLOSE_KMH and s["zoom"] == wide) else close
            if want != s["zoom"]:
                s["zoom"], s["changed"] = want, r["ms"]
        return s, {"zoom": s["zoom"]}

    return step


def learn_step(s: dict | None, r: Row) -> tuple[dict, dict]:
    """When a survey scan starts: a fine fix, LEARN_S after the last one, not too fast, LEARN_M from the last place."""
    from geostride.operators.wifi import LEARN_M, LEARN_S, MOST_KMH

    s = s or {"ms": None, "lat": None, "lon": None}
    go = _fine(r) and (s["ms"] is None or r["ms"] - s["ms"] >= LEARN_S * 1000) and r["speed_kmh"] <= MOST_KMH
    if go and s["lat"] is not None:
        go = _flat(r["lat"] - s["lat"], r["lon"] - s["lon"], r["lat"]) >= LEARN_M
    if go:
        s = {"ms": r["ms"], "lat": r["lat"], "lon": r["lon"]}
    return s, {"scan": go}


def survey_step(s: dict | None, r: Row) -> tuple[dict, dict]:
    """learn_step, and locating: no position for LOST_S starts a scan to locate, again every RETRY_S. Gives `why`."""
    from geostride.operators.wifi import LOST_S, RETRY_S

    s = s or {"learn": None, "lost": None, "located": None}
    if _fine(r):
        s["lost"] = None
        s["learn"], out = learn_step(s["learn"], r)
        return s, {"why": "learn" if out["scan"] else "none"}
    if r["status"] == "A":
        s["lost"] = None
        return s, {"why": "none"}
    if s["lost"] is None:
        s["lost"] = r["ms"]
        return s, {"why": "none"}
    if r["ms"] - s["lost"] < LOST_S * 1000 or (s["located"] is not None and r["ms"] - s["located"] < RETRY_S * 1000):
        return s, {"why": "none"}
    s["located"] = r["ms"]
    return s, {"why": "locate"}


def scan_step(s: dict | None, r: Row) -> tuple[dict, dict]:
    """Scans from their start to what they teach. r: a fix (ms, status, mode, hdop, speed_kmh, lat, lon), scan_done
    (whether the scan under way has finished with this row), and est_lat, est_lon, est_acc (where a finished scan to locate
    has told a place).

    A scan under way keeps others from starting; one that takes longer than TIMEOUT_S is abandoned. A scan to learn counts
    only if the fix is still fine and has moved no further than the time and MOST_KMH allow. A told place is good for
    STALE_S. Gives event (learn, locate: begun; learned, discarded, located, nothing, abandoned: ended; none) and
    the place in force."""
    from geostride.operators.wifi import MOST_KMH, SLACK_M, STALE_S, TIMEOUT_S

    s = s or {"survey": None, "scan": None, "est": None}
    event, scan = "none", s["scan"]
    if scan is None:
        s["survey"], out = survey_step(s["survey"], r)
        if out["why"] != "none":
            event = out["why"]
            s["scan"] = {"why": event, "ms": r["ms"], "lat": r["lat"], "lon": r["lon"]}
    elif not r["scan_done"]:
        if r["ms"] - scan["ms"] > TIMEOUT_S * 1000:
            s["scan"], event = None, "abandoned"
    else:
        s["scan"] = None
        if scan["why"] == "locate":
            event = "nothing" if r["est_lat"] is None else "located"
            if event == "located":
                s["est"] = {"lat": r["est_lat"], "lon": r["est_lon"], "acc": r["est_acc"], "ms": r["ms"]}
        else:
            near = _fine(r) and _flat(r["lat"] - scan["lat"], r["lon"] - scan["lon"], r["lat"]) <= MOST_KMH / 3.6 * (r["ms"] - scan["ms"]) / 1000 + SLACK_M
            event = "learned" if near else "discarded"
    est = s["est"] if s["est"] and r["ms"] - s["est"]["ms"] <= STALE_S * 1000 else None
    s["est"] = est
    return s, {"event": event, "place_lat": est and est["lat"], "place_lon": est and est["lon"], "place_age_ms": est and r["ms"] - est["ms"]}


SCAN = "event string, place_lat double, place_lon double, place_age_ms long"


def scan_silence(s: dict | None) -> tuple[dict | None, dict]:
    """What becomes of scan_step's state when a device has been silent for as long as a told place is good: the scan under
    way is abandoned, and the place is gone."""
    if s is not None:
        s = s | {"scan": None, "est": None}
    return s, {"event": "silent", "place_lat": None, "place_lon": None, "place_age_ms": None}


def log_step(s: dict | None, r: Row) -> tuple[dict, dict]:
    """The magnetometer's log as rows arrive. r: kind (fix or sample), ms; of a fix status, mode, hdop, speed_kmh; of a
    sample seq and calibrating. A fix with a usable course writes a line (logged: the sample's seq) if the latest sample is
    one that no line has had, is fresh, and was taken outside a calibration, and the last line is a second old."""
    s = s or {"sample": None, "used": None, "line": None}
    if r["kind"] == "sample":
        s["sample"] = None if r["calibrating"] else (r["seq"], r["ms"])
        return s, {"logged": None}
    usable = _fine(r) and r["speed_kmh"] >= 8.0 and (s["line"] is None or r["ms"] - s["line"] >= LOG_MS)
    if not usable or s["sample"] is None or s["sample"][0] == s["used"] or r["ms"] - s["sample"][1] > FRESH_MS:
        return s, {"logged": None}
    s["used"], s["line"] = s["sample"][0], r["ms"]
    return s, {"logged": s["used"]}


def dim_step(s: dict | None, r: Row) -> tuple[dict, dict]:
    """Whether the screen is dimmed for want of anyone looking. r: also touch_ms, motion_ms, stir_ms (null: never) and
    rate_ms."""
    s = s or {"lat": None, "lon": None, "ms": 0}
    ago = lambda c: None if r[c] is None else r["ms"] - r[c]
    if ago("touch_ms") is not None and ago("touch_ms") < DIM_MS or ago("motion_ms") is not None and ago("motion_ms") < HAND_MS:
        return s, {"dimmed": False}
    here = {"lat": r["lat"], "lon": r["lon"], "ms": r["ms"]}
    if r["status"] != "A" or r["mode"] != 3:
        s = {"lat": None, "lon": None, "ms": 0}
    elif s["lat"] is None:
        s = here
    elif _haversine(r["lat"], r["lon"], s["lat"], s["lon"]) >= ANCHOR_MOVE_M:
        s = here
        if ago("stir_ms") is not None and ago("stir_ms") < STIR_MS:
            return s, {"dimmed": False}
    elif r["ms"] - s["ms"] >= ANCHOR_MS:
        s = here
    return s, {"dimmed": r["rate_ms"] == IDLE_MS}


def theme_step(s: dict | None, r: Row) -> tuple[dict, dict]:
    """Palette: follows the sun, or the mode (day, night); an automatic change at most every FLIP_MS. r: ms, theme, sun_up."""
    s = s or {"dark": False, "flip": None, "theme": "auto"}
    want = {"day": False, "night": True}.get(r["theme"], not r["sun_up"])
    manual = r["theme"] != s["theme"]
    s["theme"] = r["theme"]
    if want != s["dark"] and (manual or s["flip"] is None or r["ms"] - s["flip"] > FLIP_MS):
        s["dark"], s["flip"] = want, r["ms"]
    return s, {"dark": s["dark"]}


def view_step(width: float, height: float, band: float = 1 / 3, grid: float = 2.0) -> Step:
    """View of width x height (in tiles) that follows a marker: it stays while the marker is in the middle band and steps
    over by the whole band when it leaves; never beyond the grid. r: wx, wy, ox, oy."""

    def follow(view: float, at: float, span: float, origin: float) -> float:
        edge = span * (1 - band) / 2
        low, high = at - (span - edge), at - edge
        if view < low:
            view = high
        if view > high:
            view = low
        return min(max(view, origin), origin + grid - span)

    def step(s: dict | None, r: Row) -> tuple[dict, dict]:
        if s is None:
            s = {"x": r["wx"] - width / 2, "y": r["wy"] - height / 2}
        else:
            s = {"x": follow(s["x"], r["wx"], width, r["ox"]), "y": follow(s["y"], r["wy"], height, r["oy"])}
        return s, {"view_x": s["x"], "view_y": s["y"]}

    return step


def run_policy(rows: DataFrame, step: Step, adds: str, key: str = "device", order: str = "ms") -> DataFrame:
    """rows with the columns that step adds. Devices are hashed over tasks and sorted there; a task streams through its
    devices' rows with one state at a time, however many rows a device has."""
    ship(rows.sparkSession)
    names = [f.split()[0] for f in adds.split(", ")]
    columns = rows.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, now = None, None
        for frame in frames:
            out = []
            for values in frame.itertuples(index=False, name=None):
                r = {c: None if v is pd.NaT or v != v else v for c, v in zip(columns, values, strict=True)}
                if now is None or r[key] != now[0]:
                    state, now = None, (r[key],)
                state, added = step(state, r)
                out.append(tuple(added[n] for n in names))
            yield pd.concat([frame.reset_index(drop=True), pd.DataFrame(out, columns=names)], axis=1)

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), adds])
    return rows.repartition(F.col(key)).sortWithinPartitions(key, order).mapInPandas(run, schema)


def windowed_metrics(samples: DataFrame, ts: str, value: str, keys: list[str], every: str = "15 seconds") -> DataFrame:
    """(keys, start, last, most, mean, peak): of each window, and the peak since the start."""
    from pyspark.sql import Window

    w = samples.groupBy(*keys, F.window(ts, every).alias("w")).agg(F.max_by(value, ts).alias("last"), F.max(value).alias("most"), F.avg(value).alias("mean"))
    w = w.withColumn("start", F.col("w.start")).drop("w")
    return w.withColumn("peak", F.max("most").over(Window.partitionBy(*keys).orderBy("start").rowsBetween(Window.unboundedPreceding, 0)))
