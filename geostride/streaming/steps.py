"""Steps of streams: sentences to fixes, fixes to trust, samples to the log."""

from __future__ import annotations

from math import cos, hypot, radians
from typing import Any

from geostride.functions.nmea import LEAST_FIELDS, MAX_FIELDS, MAX_LINE, TALKERS
from geostride.operators import trust as T

Row = dict[str, Any]
CONS = "cons array<struct<visible:int,best_snr:int,worst_snr:int>>"
FIX = "status string, utc string, date string, lat double, lon double, course double, speed_kmh double, sats int, hdop double, altitude double, mode int"


def _number(text: str) -> float:
    import re

    m = re.match(r"\s*[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?", text)
    return float(m[0]) if m else 0.0


def _whole(text: str) -> int:
    import re

    m = re.match(r"\s*[+-]?\d{1,9}", text)
    return int(m[0]) if m else 0


def _degrees(value: str, side: str) -> float:
    if not value:
        return 0.0
    raw = _number(value)
    deg = int(raw / 100)
    d = deg + (raw - deg * 100) / 60.0
    return -d if side[:1] in ("S", "W") else d


def fix_step(s: dict | None, r: Row) -> tuple[dict, dict]:
    """r: line. The state after a sentence; among what is given cons too, the constellations met so far (CONS)."""
    s = s or {"status": "V", "utc": "", "date": "", "lat": 0.0, "lon": 0.0, "course": 0.0, "speed_kmh": 0.0, "sats": 0, "hdop": 99.99, "altitude": 0.0, "mode": 0, "cons": {}}
    line = (r["line"] or "").replace("\r", "").replace("\n", "")[:MAX_LINE]
    if line.startswith("$"):
        f = line.split("*")[0].split(",")[:MAX_FIELDS]
        talker, kind = line[1:3], line[3:6]
        if kind in LEAST_FIELDS and len(f) >= LEAST_FIELDS[kind]:
            if kind == "RMC":
                s["status"], s["utc"], s["date"] = f[2][:1] or "V", f[1], f[9]
                if s["status"] == "A":
                    s["lat"], s["lon"] = _degrees(f[3], f[4]), _degrees(f[5], f[6])
            elif kind == "VTG":
                s["course"], s["speed_kmh"] = _number(f[1]), _number(f[7])
            elif kind == "GGA":
                s["sats"], s["hdop"], s["altitude"] = _whole(f[7]), _number(f[8]) if f[8] else 99.99, _number(f[9])
            elif kind == "GSA":
                m = _whole(f[2])
                s["mode"] = m if m > s["mode"] or m == 1 else s["mode"]
            elif talker in TALKERS:
                con = s["cons"].setdefault(TALKERS.index(talker), {"visible": 0, "best_snr": 0, "worst_snr": 0})
                if _whole(f[2]) == 1:
                    con["best_snr"] = con["worst_snr"] = 0
                con["visible"] = _whole(f[3])
                for snr in (_whole(f[i + 3]) for i in range(4, len(f) - 3, 4)):
                    if snr > 0:
                        con["best_snr"] = max(con["best_snr"], snr)
                        con["worst_snr"] = min(con["worst_snr"] or snr, snr)
    added = {n.split()[0]: s[n.split()[0]] for n in FIX.split(", ")}
    return s, added | {"cons": [s["cons"][k] for k in sorted(s["cons"])]}


def trust_step(s: dict | None, r: Row) -> tuple[dict, dict]:
    """r: ts (seconds), status, lat, lon, altitude, speed_kmh, mode; and cons, pps_ms, wifi, gnss_epoch, rtc_epoch where
    they are known. Gives flags, level, text."""
    s = s or {"before": None, "same": 0, "held": {}, "level": "UNKNOWN"}
    now = r["ts"]
    s["held"] = {k: t for k, t in s["held"].items() if now - t <= T.HOLD_S}
    if r["status"] != "A":
        s["before"] = None
        if not s["held"]:
            s["level"] = "UNKNOWN"
    else:
        b, fired = s["before"], []
        moved = None
        if b is not None:
            moved = hypot((r["lon"] - b["lon"]) * 111320.0 * cos(radians((r["lat"] + b["lat"]) / 2)), (r["lat"] - b["lat"]) * 111320.0)
            if now - b["ts"] > 0.25:
                kmh = moved / (now - b["ts"]) * 3.6
                big, small = max(kmh, r["speed_kmh"]), min(kmh, r["speed_kmh"])
                fired += [0] * (kmh > T.MAX_KMH) + [1] * (big > T.SPEED_MIN_KMH and (big - small) / big > T.SPEED_TOLERANCE)
        if not T.ALT_MIN <= r["altitude"] <= T.ALT_MAX:
            fired.append(6)
        elif b is not None:
            s["same"] = s["same"] + 1 if abs(r["altitude"] - b["altitude"]) < 0.01 and moved > T.FREEZE_M else 0
            fired += [6] * (s["same"] > T.FREEZE_STEPS)
        g, c = r.get("gnss_epoch"), r.get("rtc_epoch")
        fired += [2] * bool(g and c and c > T.CLOCK_VALID_FROM and abs(g - c) > T.CLOCK_TOLERANCE_S)
        cons = list(r.get("cons") or [])
        tracked = [x for x in cons if x["visible"] and x["best_snr"]]
        worst = [x["worst_snr"] for x in tracked if x["worst_snr"]]
        fired += [3] * bool(sum(x["visible"] for x in cons) >= T.SNR_MIN_SATS and len(tracked) >= 2 and worst and max(x["best_snr"] for x in tracked) - min(worst) < T.SNR_MIN_SPREAD)
        pps = r.get("pps_ms")
        fired += [4] * bool(r["mode"] >= 3 and pps and not T.PPS_LOW <= pps <= T.PPS_HIGH)
        w = r.get("wifi")
        if w and w["used"] >= T.WIFI_USED and w["age_s"] <= T.WIFI_AGE_S:
            apart = hypot((w["lon"] - r["lon"]) * 111320.0 * cos(radians((r["lat"] + w["lat"]) / 2)), (w["lat"] - r["lat"]) * 111320.0)
            fired += [5] * (apart > T.WIFI_M + w["acc"])
        s["held"] |= dict.fromkeys(fired, now)
        s["before"] = {k: r[k] for k in ("lat", "lon", "altitude", "ts")}
        s["level"] = ("OK", "ODD")[len(s["held"])] if len(s["held"]) < 2 else "BAD"
    held = sorted(s["held"])
    return s, {"flags": sum(1 << k for k in held), "level": s["level"], "text": ", ".join(T.FLAGS[k] for k in held)[:63]}


TRUST = "flags int, level string, text string"


def sentence_trust_step(s: dict | None, r: Row) -> tuple[dict, dict]:
    """r: line, ts (seconds), and what trust_step takes besides a fix. From sentences to fixes to trust in one state: the
    checks are made once for each new position sentence, and hold in between."""
    s = s or {"fix": None, "trust": None, "last": {"flags": 0, "level": "UNKNOWN", "text": ""}}
    s["fix"], fix = fix_step(s["fix"], r)
    if (r["line"] or "")[3:6] == "RMC":
        s["trust"], s["last"] = trust_step(s["trust"], r | fix)
    return s, {k: fix[k] for k in (n.split()[0] for n in FIX.split(", "))} | s["last"]
