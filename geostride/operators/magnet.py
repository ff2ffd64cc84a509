"""Magnetometer calibration by an axis-aligned ellipsoid, motion flags, and the log that pairs fixes with samples."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geostride.functions.nmea import course_usable
from geostride.operators.gnss import as_of
from geostride.operators.policies import run_policy
from geostride.session import materialize, ship

TERMS = ("xx", "yy", "zz", "x", "y", "z")
KEEP, STRIDE, LEAST_POINTS = 128, 4, 32
LEAST_PIVOT, MOST_RESIDUAL, MOST_SPREAD = 1e-9, 0.15, 0.15
MEAN_RADIUS = (5.0, 200.0)
SMOOTHING, MOTION, STIR = 0.08, 1500.0, 500.0
FIT = "ok boolean, reason string, cx double, cy double, cz double, gx double, gy double, gz double, residual double, points int"


def normal_equations(samples: DataFrame, key: str = "device") -> DataFrame:
    """(key, n, b_*, a_*_*): sums of the terms and of their products, upper half. Sums merge, so partial aggregates do."""
    rows = samples.select(key, *(v.alias(t) for t, v in zip(TERMS, (F.col("x") * F.col("x"), F.col("y") * F.col("y"), F.col("z") * F.col("z"), F.col("x"), F.col("y"), F.col("z")), strict=True)))
    sums = [F.sum(t).alias(f"b_{t}") for t in TERMS] + [F.sum(F.col(s) * F.col(t)).alias(f"a_{s}_{t}") for i, s in enumerate(TERMS) for t in TERMS[i:]]
    return rows.groupBy(key).agg(F.count("*").alias("n"), *sums)


def kept_points(samples: DataFrame, key: str = "device", order: str = "seq") -> DataFrame:
    """The points a fit is judged by: the first KEEP, of which later ones (each STRIDEth) overwrite slot after slot; at
    most KEEP a key."""
    w = Window.partitionBy(key).orderBy(order)
    rows = samples.withColumn("_k", F.row_number().over(w) - 1)
    rows = rows.filter((F.col("_k") < KEEP) | (F.col("_k") % STRIDE == 0))
    slot = F.when(F.col("_k") < KEEP, F.col("_k")).otherwise(F.floor(F.col("_k") / STRIDE) % KEEP)
    return rows.groupBy(key, slot.cast("int").alias("slot")).agg(F.max_by(F.struct("x", "y", "z"), "_k").alias("p")).select(key, "slot", "p.*")


def merge_sums(old: DataFrame, new: DataFrame, key: str = "device", weight: float = 0.5) -> DataFrame:
    """Old sums at half weight with new ones: a refined calibration's equations."""
    names = [c for c in old.columns if c.startswith(("a_", "b_"))]
    faded = old.select(key, "n", *((F.col(c) * weight).alias(c) for c in names))
    return faded.unionByName(new.select(key, "n", *names)).groupBy(key).agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in names))


def solve(a: np.ndarray, b: np.ndarray) -> np.ndarray | None:
    """Elimination with the largest pivot; None where a pivot vanishes."""
    m = np.column_stack([np.asarray(a, float), np.asarray(b, float)])
    n = len(m)
    for c in range(n):
        p = c + int(np.argmax(np.abs(m[c:, c])))
        if abs(m[p, c]) < LEAST_PIVOT:
            return None
        m[[c, p]] = m[[p, c]]
        m[c + 1 :] -= np.outer(m[c + 1 :, c] / m[c, c], m[c])
    out = np.zeros(n)
    for r in reversed(range(n)):
        out[r] = (m[r, n] - m[r, r + 1 : n] @ out[r + 1 :]) / m[r, r]
    return out


def fit_ellipsoid(a: np.ndarray, b: np.ndarray, points: np.ndarray) -> tuple:
    """(ok, reason, centre, gains, residual) of sums a, b and the kept points."""
    none = (np.nan,) * 3
    if len(points) < LEAST_POINTS:
        return False, "too few points", none, none, np.nan
    p = solve(a, b)
    if p is None:
        return False, "singular", none, none, np.nan
    q, lin = p[:3], p[3:]
    if not ((q > 0).all() or (q < 0).all()):
        return False, "hyperboloid", none, none, np.nan
    centre = -lin / (2 * q)
    squares = (1 + (q * centre**2).sum()) / q
    if (squares <= 0).any():
        return False, "imaginary radius", none, none, np.nan
    radius = np.sqrt(squares)
    mean = radius.mean()
    if not MEAN_RADIUS[0] <= mean <= MEAN_RADIUS[1]:
        return False, "implausible mean radius", none, none, np.nan
    if (radius < mean / 3).any() or (radius > mean * 3).any():
        return False, "one axis far from the others", none, none, np.nan
    gains = mean / radius
    length = np.sqrt((((points - centre) * gains / mean) ** 2).sum(1))
    residual = float(np.sqrt(((length - 1) ** 2).mean()))
    return residual <= MOST_RESIDUAL, "ok" if residual <= MOST_RESIDUAL else "residual too high", tuple(centre), tuple(gains), residual


def fits(samples: DataFrame, key: str = "device", order: str = "seq", sums: DataFrame | None = None) -> DataFrame:
    """A fit for each key. A group that reaches Python is one row of sums with at most KEEP points."""
    ship(samples.sparkSession)
    sums = normal_equations(samples, key) if sums is None else sums
    points = kept_points(samples, key, order).groupBy(key).agg(F.collect_list(F.struct("x", "y", "z")).alias("points"))
    schema = f"{key} {samples.schema[key].dataType.simpleString()}, {FIT}"

    def run(batches):
        for frame in batches:
            out = []
            for r in frame.itertuples():
                a = np.zeros((6, 6))
                for i, s in enumerate(TERMS):
                    for j in range(i, 6):
                        a[i, j] = a[j, i] = getattr(r, f"a_{s}_{TERMS[j]}")
                pts = np.array([(p["x"], p["y"], p["z"]) for p in r.points], float)
                ok, why, c, g, res = fit_ellipsoid(a, np.array([getattr(r, f"b_{t}") for t in TERMS]), pts)
                out.append((getattr(r, key), ok, why, *c, *g, res, len(pts)))
            yield pd.DataFrame(out, columns=[key, *(f.split()[0] for f in FIT.split(", "))])

    return sums.join(points, key).mapInPandas(run, schema)


def accept_refined(fit: DataFrame, before: DataFrame, key: str = "device") -> DataFrame:
    """Adds accepted: a refined fit replaces the one before unless it failed, or its gains spread by more than
    MOST_SPREAD and more than before. before: (key, gx, gy, gz)."""
    spread = lambda p: F.when(F.least(p("gx"), p("gy"), p("gz")) <= 0.01, 99.0).otherwise(F.greatest(p("gx"), p("gy"), p("gz")) / F.least(p("gx"), p("gy"), p("gz")) - 1)
    old = before.select(key, *(F.col(c).alias(f"_{c}") for c in ("gx", "gy", "gz")))
    now, was = spread(F.col), spread(lambda c: F.col(f"_{c}"))
    rows = fit.join(old, key, "left")
    return rows.withColumn("accepted", F.col("ok") & (F.col("_gx").isNull() | ~((now > MOST_SPREAD) & (now > was)))).drop("_gx", "_gy", "_gz")


def midrange(samples: DataFrame, key: str = "device") -> DataFrame:
    """The simple calibration: offsets in the middle of each axis' range, gains 1; uneven where the radii differ by more
    than 15 %."""
    out = samples.groupBy(key).agg(*(f(a).alias(f"{n}_{a}") for a in "xyz" for n, f in (("min", F.min), ("max", F.max))))
    radius = {a: (F.col(f"max_{a}") - F.col(f"min_{a}")) / 2 for a in "xyz"}
    mean = (radius["x"] + radius["y"] + radius["z"]) / 3
    apart = F.greatest(*(F.abs(r - mean) for r in radius.values())) / F.greatest(mean, F.lit(0.1))
    return out.select(key, *((F.col(f"max_{a}") + F.col(f"min_{a}")).__truediv__(2).alias(f"offset_{a}") for a in "xyz"), mean.alias("mean_radius"), (apart > MOST_SPREAD).alias("uneven"))


def motion_flags(samples: DataFrame, key: str = "device", order: str = "seq", block: int = 512) -> DataFrame:
    """Adds deviation from smoothed gravity, stirred, and moved (two large deviations in a row).

    The smoothing g' = g + SMOOTHING (a - g) is linear, so a block of rows acts on the state before it by a factor and a
    sum. Blocks are stretches of the order that hold at most `block` rows, and are summed up side by side; only the blocks of a device, not its rows, are walked in order for the state before each of them; then the rows of each
    block are filled in. So a device's rows are spread over tasks."""
    keep = 1 - SMOOTHING
    span = samples.groupBy(key).agg(F.min(order).alias("_first"), F.max(order).alias("_last"), F.count("*").alias("_all"))
    span = materialize(span.select(key, "_first", F.greatest(F.lit(1.0), (F.col("_last") - F.col("_first") + 1) / F.ceil(F.col("_all") / block)).alias("_width")), "motion-spans")
    rows = samples.join(span, key).withColumn("_block", F.floor((F.col(order) - F.col("_first")) / F.col("_width"))).drop("_first", "_width")
    inside = Window.partitionBy(key, "_block")
    # a stretch with more rows than others is more blocks, so that the powers below stay in range
    rows = rows.withColumn("_i", F.row_number().over(inside.orderBy(order)) - 1)
    rows = rows.withColumn("_block", F.col("_block") * (1 << 32) + F.floor(F.col("_i") / block)).withColumn("_i", F.col("_i") % block)
    # the first row of all sets the state: it enters with weight 1 (block 0 is never empty)
    first = (F.col("_block") == 0) & (F.col("_i") == 0)
    rows = materialize(rows, "motion-rows")
    weight = F.when(first, 1.0).otherwise(SMOOTHING) * F.pow(F.lit(keep), F.count("*").over(inside) - 1 - F.col("_i"))
    sums = rows.withColumn("_w", weight).groupBy(key, "_block").agg(F.count("*").alias("_n"), *(F.sum(F.col("_w") * F.col(a)).alias(f"_s{v}") for v, a in zip("xyz", ("ax", "ay", "az"), strict=True)))

    def state(s: dict | None, r: dict) -> tuple[dict, dict]:
        s = s or dict.fromkeys("xyz", 0.0)
        return {v: s[v] * keep ** r["_n"] + r[f"_s{v}"] for v in "xyz"}, {f"_g{v}": s[v] for v in "xyz"}

    before = run_policy(sums, state, "_gx double, _gy double, _gz double", key, "_block").select(key, "_block", "_gx", "_gy", "_gz")
    rows = rows.join(before, [key, "_block"])
    past = inside.orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)
    g = []
    for v, a in zip("xyz", ("ax", "ay", "az"), strict=True):
        # state before row i: keep^i g + sum over j < i of w_j keep^(i - 1 - j) a_j, with the power taken out of the sum
        scaled = F.when(first, 1.0).otherwise(SMOOTHING) * F.col(a) * F.pow(F.lit(keep), -F.col("_i") - 1)
        g.append(F.pow(F.lit(keep), F.col("_i")) * (F.col(f"_g{v}") + F.coalesce(F.sum(scaled).over(past), F.lit(0.0))))
    square = sum(((F.col(a) - gv) * (F.col(a) - gv) for a, gv in zip(("ax", "ay", "az"), g, strict=True)), F.lit(0.0))
    rows = rows.withColumn("deviation", F.when(first, 0.0).otherwise(F.sqrt(square)))
    rows = materialize(rows.withColumn("stirred", F.col("deviation") > STIR).withColumn("_large", F.col("deviation") > MOTION), "motion-deviations")
    # the row before a block's first is the last of the block before
    ends = rows.groupBy(key, "_block").agg(F.max_by("_large", "_i").alias("_end"))
    ends = ends.select(key, "_block", F.coalesce(F.lag("_end").over(Window.partitionBy(key).orderBy("_block")), F.lit(False)).alias("_before"))
    last = F.coalesce(F.lag("_large").over(inside.orderBy("_i")), F.col("_before"))
    rows = rows.join(ends, [key, "_block"]).withColumn("moved", F.col("_large") & last)
    return rows.select(*samples.columns, "deviation", "stirred", "moved")


def motion_peaks(rows: DataFrame, key: str = "device", ts: str = "ts", every: str = "15 seconds") -> DataFrame:
    """Largest deviation of each window."""
    return rows.groupBy(key, F.window(ts, every).alias("w")).agg(F.max("deviation").alias("peak")).select(key, F.col("w.start").alias("start"), "peak")


def paired_log(fixes: DataFrame, samples: DataFrame, key: str = "device", ms: str = "ms", fresh_ms: int = 300, every_ms: int = 1000) -> DataFrame:
    """Fixes with a usable course and the latest sample (seq, ms, ..) not older than fresh_ms; each sample once, and rows
    of a device at least every_ms apart, from the first one on."""
    usable = fixes.filter(course_usable(F.col("status"), F.col("mode"), F.col("hdop"), F.col("speed_kmh")))
    joined = as_of(usable, samples.withColumnRenamed("ms", "sample_ms"), key, ms, "sample_ms", "sample", fresh_ms).filter("sample is not null")
    once = joined.withColumn("_first", F.row_number().over(Window.partitionBy(key, "sample.seq").orderBy(ms))).filter("_first = 1").drop("_first")

    def gate(last: int | None, r: dict) -> tuple[int, dict]:
        passes = last is None or r[ms] - last >= every_ms
        return (r[ms] if passes else last), {"_passes": passes}

    times = run_policy(once.select(key, ms, F.col("sample.seq").alias("_seq")), gate, "_passes boolean", key, ms).filter("_passes").select(key, ms, "_seq")
    return once.join(times, (once[key] == times[key]) & (once[ms] == times[ms]) & (F.col("sample.seq") == F.col("_seq")), "left_semi")
