"""World outlines from polygons: project, simplify, drop the small, quantise, order; and bands of an archive."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geostride.functions.tiles import from_mercator, hilbert_zxy, mercator_log
from geostride.operators.ordering import numbered
from geostride.session import ship

TARGET_PX, SIMPLIFY_PX, LAND_PX, LAKE_PX, GRID = 1280, 0.7, 2.0, 2.5, 65535


def simplify(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas-Peucker: a stretch keeps its farthest point if that is over the tolerance from the line of its ends (the
    first of equal ones)."""
    n = len(points)
    if n < 3:
        return points
    keep = np.zeros(n, bool)
    keep[[0, -1]] = True
    open_ = [(0, n - 1)]
    while open_:
        i, j = open_.pop()
        if j - i < 2:
            continue
        (ax, ay), (dx, dy) = points[i], points[j] - points[i]
        rel = points[i + 1 : j] - (ax, ay)
        norm = np.hypot(dx, dy)
        d = np.hypot(rel[:, 0], rel[:, 1]) if norm == 0 else np.abs(dx * rel[:, 1] - dy * rel[:, 0]) / norm
        k = int(np.argmax(d))
        if d[k] > tolerance:
            keep[i + 1 + k] = True
            open_ += [(i, i + 1 + k), (i + 1 + k, j)]
    return points[keep]


def simplify_rings(rings: DataFrame, tolerance: float, pts: str = "pts") -> DataFrame:
    """Replaces each row's points (array of struct(x, y)) by the simplified ones, in Arrow batches."""
    ship(rings.sparkSession)

    @F.pandas_udf("array<struct<x:double,y:double>>")
    def run(column: pd.Series) -> pd.Series:
        out = []
        for ring in column:
            p = np.array([(c["x"], c["y"]) for c in ring], float).reshape(-1, 2)
            out.append([{"x": x, "y": y} for x, y in simplify(p, tolerance).tolist()])
        return pd.Series(out)

    return rings.withColumn(pts, run(F.col(pts)))


def ring_area(pts):
    """Area of an array of struct(x, y), from each pair of neighbours (the ring is closed)."""
    edges = F.zip_with(F.slice(pts, F.lit(1), F.size(pts) - 1), F.slice(pts, F.lit(2), F.size(pts) - 1), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.abs(F.aggregate(edges, F.lit(0.0), lambda s, e: s + e)) / 2


def quantised(pts):
    """Points on the GRID (halves to even), without repeats of the point before."""
    cell = lambda v: F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)) * GRID, 0).cast("int")
    q = F.transform(pts, lambda p: F.struct(cell(p["x"]).alias("x"), cell(p["y"]).alias("y")))
    fresh = F.filter(F.transform(q, lambda p, i: F.when((i == 0) | (F.get(q, i - 1) != p), p)), lambda p: p.isNotNull())
    return F.transform(F.array(q), lambda _: fresh)[0]


def outline(rings: DataFrame, min_area_px: float = LAND_PX) -> DataFrame:
    """rings: (ord, pts as lon, lat). (ring_id, ord, pts in 0..GRID): the longest first, ties in the given order."""
    projected = rings.withColumn("pts", F.transform("pts", lambda p: mercator_log(p["y"], p["x"])))
    rows = simplify_rings(projected, SIMPLIFY_PX / TARGET_PX).filter(F.size("pts") >= 4)
    rows = rows.filter(ring_area(F.col("pts")) >= (min_area_px / TARGET_PX) ** 2)
    rows = rows.withColumn("pts", quantised(F.col("pts"))).filter(F.size("pts") >= 4)
    return numbered(rows, [F.desc(F.size("pts")), F.col("ord")], "ring_id").select("ring_id", "ord", "pts")


def column_bytes(entries: DataFrame, z: int, south: float = -85.0, north: float = 85.0) -> DataFrame:
    """(x, gb): bytes of a zoom's tiles by tile column, each blob once for each column that uses it."""
    low, high = (4**z - 1) // 3, (4 ** (z + 1) - 1) // 3
    rows = entries.filter((F.col("tile_id") < high) & (F.col("tile_id") + F.col("run_length") > low))
    rows = rows.withColumn("t", F.explode(F.sequence(F.greatest(F.lit(low), F.col("tile_id")), F.least(F.lit(high - 1), F.col("tile_id") + F.col("run_length") - 1))))
    rows = rows.withColumn("p", hilbert_zxy(F.col("t"))).withColumn("lat", from_mercator(F.col("p.x") + 0.5, F.col("p.y") + 0.5, F.lit(z))["lat"]).filter(F.col("lat").between(south, north))
    return rows.select(F.col("p.x").alias("x"), "offset", "length").distinct().groupBy("x").agg((F.sum("length") / 1e9).alias("gb")).orderBy("x")


def plan_bands(columns: list[tuple[int, float]], z: int, target_gb: float = 3.2, most: int = 41, steps: int = 8) -> list[tuple[float, float, float, bool]]:
    """(west, east, gb, over target) bands from the bytes of each tile column (at most 2^z numbers): each band is widened
    to the east by bisection until it is near the target; one that can't be is a degree wide."""
    n = 2**z
    sizes = np.zeros(n)
    for x, gb in columns:
        sizes[x] += gb
    total = np.concatenate([[0], np.cumsum(sizes)])
    column = lambda lon: (lon + 180.0) / 360.0 * n
    # a band takes every column that it touches
    weigh = lambda w, e: float(total[min(n, int(np.ceil(column(e))))] - total[max(0, int(np.floor(column(w))))])
    bands: list[tuple[float, float, float, bool]] = []
    west = -180.0
    while west < 180.0:
        if weigh(west, 180.0) <= target_gb:
            bands.append((west, 180.0, weigh(west, 180.0), False))
            break
        low, high, east = west, 180.0, None
        for _ in range(steps):
            mid = (low + high) / 2
            if weigh(west, mid) > target_gb:
                high = mid
            else:
                low = east = mid
        over = east is None
        east = min(west + 1.0, 180.0) if over else east
        bands.append((west, east, weigh(west, east), over))
        west = east
        if len(bands) >= most:
            raise ValueError("too many bands for this target")
    return bands


def band_totals(bands: DataFrame) -> DataFrame:
    return bands.agg(F.count("*").alias("files"), F.sum("gb").alias("gb"))
