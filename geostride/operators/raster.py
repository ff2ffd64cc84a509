"""Tiles to pixels, a task per tile in numpy: nonzero-winding fills with two rows of samples a pixel row, and strokes as
quads. For previews; the DataFrame operators never need it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geostride.operators.places import DRAW_ORDER, PALETTE, STROKES
from geostride.session import ship

SUB = 2


def coverage(rings: list[np.ndarray], size: int, rule: str = "nonzero") -> np.ndarray:
    """Coverage 0..1 of each pixel by closed rings (pixel coordinates)."""
    out = np.zeros((size, size))
    edges = np.concatenate([np.column_stack([r, np.roll(r, -1, 0)]) for r in rings if len(r) >= 3] or [np.zeros((0, 4))])
    edges = edges[edges[:, 1] != edges[:, 3]]
    up = edges[:, 3] > edges[:, 1]
    x0, y0, x1, y1 = np.where(up[:, None], edges, edges[:, [2, 3, 0, 1]]).T if len(edges) else np.zeros((4, 0))
    turn = np.where(up, 1, -1)
    low, high = (float(y0.min()), float(y1.max())) if len(y0) else (0.0, 0.0)
    for k in range(max(0, int(low * SUB) - 1), min(size * SUB, int(high * SUB) + 2)):
        y = (k + 0.5) / SUB
        hit = (y0 <= y) & (y < y1)
        if not hit.any():
            continue
        x = x0[hit] + (y - y0[hit]) * (x1[hit] - x0[hit]) / (y1[hit] - y0[hit])
        order = np.argsort(x, kind="stable")
        x, wind = x[order], np.cumsum(turn[hit][order])
        inside = wind[:-1] != 0 if rule == "nonzero" else np.arange(len(x) - 1) % 2 == 0
        for a, b in zip(np.clip(x[:-1][inside], 0, size), np.clip(x[1:][inside], 0, size), strict=True):
            if b <= a:
                continue
            p, q = int(a), min(size - 1, int(np.ceil(b)) - 1)
            row = out[k // SUB]
            if p == q:
                row[p] += (b - a) / SUB
            else:
                row[p] += (p + 1 - a) / SUB
                row[p + 1 : q] += 1 / SUB
                row[q] += (b - q) / SUB
    return np.minimum(out, 1.0)


def stroke_rings(path: np.ndarray, width: float) -> list[np.ndarray]:
    """A quad for each step of a path that is at least half a pixel."""
    width = max(1.0, width)
    kept = [path[0]]
    for p in path[1:]:
        if np.abs(p - kept[-1]).max() >= 0.5:
            kept.append(p)
    out = []
    for a, b in zip(kept, kept[1:], strict=False):
        d = b - a
        n = np.array([-d[1], d[0]]) / np.hypot(*d) * width / 2
        out.append(np.array([a + n, b + n, b - n, a - n]))
    return out


def pack565(rgb: np.ndarray) -> np.ndarray:
    r, g, b = (rgb[..., k].astype(np.uint16) for k in range(3))
    return r >> 3 << 11 | g >> 2 << 5 | b >> 3


def paint(parts: pd.DataFrame, size: int, dark: bool = False) -> np.ndarray:
    """RGB565 of a tile's parts (layer, style, geom, feature_index, part_index, pts, extent)."""
    canvas = np.empty((size, size, 3))
    canvas[:] = (18, 20, 24) if dark else (228, 226, 220)
    k = max(1, size // 256)
    for layer in DRAW_ORDER:
        own = parts[parts["layer"] == layer]
        if own.empty:
            continue
        own = own.sort_values(["feature_index", "part_index"])
        for _, feature in own.groupby("feature_index", sort=True):
            style, geom = feature["style"].iloc[0], feature["geom"].iloc[0]
            if style not in PALETTE or geom == "point":
                continue
            shapes = [np.array([(p["x"], p["y"]) for p in pts], float) * size / e for pts, e in zip(feature["pts"], feature["extent"], strict=True)]
            if geom == "polygon" and style not in STROKES:
                masks = [coverage(shapes, size)]
            elif geom == "line" and style in STROKES:
                masks = [coverage([q], size) for s in shapes if len(s) > 1 for q in stroke_rings(s, STROKES[style] * k)]
            else:
                continue
            for m in masks:
                canvas += (np.array(PALETTE[style][dark]) - canvas) * m[..., None]
    return pack565(np.rint(canvas))


def is_painted(style: Column, geom: Column) -> Column:
    """Whether a part of this style and geometry leaves any paint: fills take polygons, strokes take lines, and no style
    of a point has a fill."""
    stroke = style.isin(*STROKES)
    return F.coalesce(style.isin(*PALETTE) & (((geom == "polygon") & ~stroke) | ((geom == "line") & stroke)), F.lit(False))


def backdrop(land: list[np.ndarray], lakes: list[np.ndarray], size: int) -> np.ndarray:
    """0 sea, 1 land, 2 lake: land by the even-odd rule over all its rings, then lakes over it."""
    out = (coverage(land, size, "evenodd") >= 0.5).astype(np.uint8)
    out[coverage(lakes, size, "evenodd") >= 0.5] = 2
    return out


def diamond(x: float, y: float, radius: float) -> np.ndarray:
    """The ring of a point."""
    return np.array([(x, y - radius), (x + radius, y), (x, y + radius), (x - radius, y)], float)


def upscaled(pixels: np.ndarray, factor: int, qx: int, qy: int) -> np.ndarray:
    """The part (qx, qy) of a tile drawn `factor` times as large, by nearest pixels."""
    n = len(pixels) // factor
    return np.repeat(np.repeat(pixels[qy * n : (qy + 1) * n, qx * n : (qx + 1) * n], factor, 0), factor, 1)


def render(parts: DataFrame, size: int = 256, dark: bool = False) -> DataFrame:
    """(z, x, y, pixels as little-endian RGB565 rows). A group is one tile."""
    ship(parts.sparkSession)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        z, x, y = (int(frame[c].iloc[0]) for c in "zxy")
        return pd.DataFrame({"z": [z], "x": [x], "y": [y], "pixels": [paint(frame, size, dark).astype("<u2").tobytes()]})

    columns = ("z", "x", "y", "layer", "style", "geom", "feature_index", "part_index", "pts", "extent")
    return parts.filter("error is null").select(*columns).groupBy("z", "x", "y").applyInPandas(run, "z int, x long, y long, pixels binary")
