"""Tile arithmetic as column expressions: Web Mercator, Hilbert tile ids, grids. No UDFs."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

LAT_LIMIT = 85.05112877980659
CIRCUMFERENCE_M = 40075016.685578488
#: Ids of zooms up to this one fit a signed 64-bit integer.
MAX_ZOOM = 30


def _shl(b: Column) -> Column:
    """2^b as a long, without floating point."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), b)


def _shr(v: Column, b: Column) -> Column:
    return F.call_function("shiftright", v, b)


def _once(value: Column, f) -> Column:
    """f(value) worked out once, however many of its fields are read: the optimizer doesn't copy a transform."""
    return F.transform(F.array(value), f)[0]


def _pow2(z: Column) -> Column:
    return F.pow(F.lit(2.0), z)


def clamp_lat(lat: Column) -> Column:
    return F.least(F.lit(LAT_LIMIT), F.greatest(F.lit(-LAT_LIMIT), lat))


def wrap_lon(lon: Column) -> Column:
    """Into [-180, 180)."""
    return F.pmod(lon + 180.0, F.lit(360.0)) - 180.0


def mercator(lat: Column, lon: Column, z: Column) -> Column:
    """struct(fx, fy): fractional tile coordinates at zoom z."""
    phi = F.radians(clamp_lat(lat))
    return F.struct(((wrap_lon(lon) + 180.0) / 360.0 * _pow2(z)).alias("fx"), ((F.lit(1.0) - F.asinh(F.tan(phi)) / math.pi) / 2.0 * _pow2(z)).alias("fy"))


def mercator_log(lat: Column, lon: Column) -> Column:
    """struct(x, y) over 0..1, by the logarithmic form."""
    s = F.sin(F.radians(F.least(F.lit(85.05112878), F.greatest(F.lit(-85.05112878), lat))))
    return F.struct(((lon + 180.0) / 360.0).alias("x"), (F.lit(0.5) - F.log((1 + s) / (1 - s)) / (4 * math.pi)).alias("y"))


def from_mercator(fx: Column, fy: Column, z: Column) -> Column:
    """struct(lat, lon) of fractional tile coordinates."""
    n = _pow2(z)
    return F.struct(F.degrees(F.atan(F.sinh(math.pi * (1 - 2 * fy / n)))).alias("lat"), (fx / n * 360.0 - 180.0).alias("lon"))


def ground_resolution(lat: Column, z: Column, px: Column) -> Column:
    """Metres a pixel of a tile of px pixels."""
    return CIRCUMFERENCE_M * F.cos(F.radians(clamp_lat(lat))) / (px * _pow2(z))


def pixel_in_tile(f: Column, px: Column) -> Column:
    return ((f - F.floor(f)) * px).cast("int")


def valid_y(y: Column, z: Column) -> Column:
    return (y >= 0) & (y < _pow2(z).cast("long"))


def wrap_x(x: Column, z: Column) -> Column:
    return F.pmod(x.cast("long"), _pow2(z).cast("long"))


def hilbert_id(z: Column, x: Column, y: Column) -> Column:
    """Tile id: the tiles of all lower zooms, then the place along the Hilbert curve of zoom z. Null outside the zoom's
    square and over MAX_ZOOM."""
    return _once(F.struct(z.cast("int").alias("z"), x.cast("long").alias("x"), y.cast("long").alias("y")), lambda t: _walked(t["z"], t["x"], t["y"]))


def _walked(z: Column, x: Column, y: Column) -> Column:
    def step(acc: Column, b: Column) -> Column:
        # x and y have b + 1 bits; the top ones name the quadrant. In the two quadrants with y's bit 0 the curve is mirrored
        # (x's bit 0: the coordinates change places) or turned over (1: their lower bits are inverted too)
        low = _shl(b) - 1
        right = _shr(acc["x"], b)
        keep = _shr(acc["y"], b) == 1
        turn = F.when(keep, F.lit(0).cast("long")).otherwise(-right)
        nx, ny = acc["x"].bitwiseXOR(turn).bitwiseAND(low), acc["y"].bitwiseXOR(turn).bitwiseAND(low)
        quadrant = F.when(keep, right + 1).otherwise(right * 3)
        return F.struct(F.call_function("shiftleft", acc["d"], F.lit(2)).bitwiseOR(quadrant).alias("d"), F.when(keep, nx).otherwise(ny).alias("x"), F.when(keep, ny).otherwise(nx).alias("y"))

    bits = F.when(z > 0, F.sequence(z - 1, F.lit(0), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    walked = F.aggregate(bits, F.struct(F.lit(0).cast("long").alias("d"), x.alias("x"), y.alias("y")), step, lambda acc: acc["d"])
    side = _shl(z)
    inside = z.between(0, MAX_ZOOM) & (x >= 0) & (x < side) & (y >= 0) & (y < side)
    return F.when(inside, lower_zooms(z) + walked)


def lower_zooms(z: Column) -> Column:
    """(4^z - 1) / 3 as an integer."""
    # 4^z - 1 is all ones; every second one of them is a third of it
    return F.lit(0x5555555555555555).bitwiseAND(_shl(z * 2) - 1)


def zoom_of_id(tile_id: Column) -> Column:
    """Zoom of a tile id: half the bits of 3 id + 1, which lies in [4^z, 4^(z+1))."""
    return F.floor((F.length(F.bin(tile_id.cast("long") * 3 + 1)) - 1) / 2).cast("int")


def hilbert_zxy(tile_id: Column) -> Column:
    """struct(z, x, y) of a tile id; null for negative ids and those over MAX_ZOOM."""
    ok = (tile_id >= 0) & (tile_id < F.lit((4 ** (MAX_ZOOM + 1) - 1) // 3))
    sound = F.when(ok, tile_id.cast("long"))
    return _once(F.struct(sound.alias("id"), zoom_of_id(sound).alias("z")), lambda s: F.when(s["id"].isNotNull(), _walked_back(s["id"], s["z"])))


#: Every second bit of a long; and the steps that part the bits at even places from those at odd ones.
EVEN = 0x5555555555555555
UNSHUFFLE = ((1, 0x2222222222222222), (2, 0x0C0C0C0C0C0C0C0C), (4, 0x00F000F000F000F0), (8, 0x0000FF000000FF00), (16, 0x00000000FFFF0000))


def _walked_back(tile_id: Column, z: Column) -> Column:
    """A place along the curve to x and y, all zoom steps at once: whether the curve is mirrored or turned over at a step
    is the exclusive or of what the steps before did, a prefix that takes as many rounds as the logarithm of the steps."""
    down = F.shiftrightunsigned
    even = F.lit(EVEN)
    # pairs of bits above the zoom that change nothing
    padded = (tile_id - lower_zooms(z)).bitwiseOR(F.call_function("shiftleft", even, z * 2))

    def with_above(k: int):
        return lambda c: c.bitwiseXOR(down(c, k))

    def parted(shift: int, mask: int):
        return lambda v: _once(v.bitwiseXOR(down(v, shift)).bitwiseAND(F.lit(mask)), lambda t: v.bitwiseXOR(t).bitwiseXOR(F.shiftleft(t, shift)))

    def quadrants(s: Column) -> Column:
        high = down(s, 1).bitwiseAND(even)
        state = (s.bitwiseAND(even) + high).bitwiseXOR(even)
        for k in (2, 4, 8, 16, 32):
            state = _once(state, with_above(k))
        return _once(F.struct(high.alias("high"), state.alias("state")), lambda p: combined(s, p["high"], p["state"]))

    def combined(s: Column, high: Column, state: Column) -> Column:
        turned = s.bitwiseAND(state.bitwiseAND(even)).bitwiseXOR(down(state, 1).bitwiseAND(even))
        return s.bitwiseXOR(high).bitwiseXOR(turned).bitwiseXOR(F.shiftleft(turned, 1))

    bits = _once(padded, quadrants).bitwiseAND(_shl(z * 2) - 1)
    for shift, mask in UNSHUFFLE:
        bits = _once(bits, parted(shift, mask))
    return _once(bits, lambda v: F.struct(z.alias("z"), down(v, 32).alias("x"), v.bitwiseAND(F.lit(0xFFFFFFFF)).alias("y")))


def parent_tile(z: Column, x: Column, y: Column, s: Column) -> Column:
    """struct(z, x, y, qx, qy): the tile s zooms up and the place of this one in it."""
    low = _shl(s.cast("int")) - 1
    given = F.struct(z.alias("z"), x.alias("x"), y.alias("y"), s.cast("int").alias("s"), low.alias("low"))
    return _once(given, lambda t: F.struct((t["z"] - t["s"]).alias("z"), _shr(t["x"], t["s"]).alias("x"), _shr(t["y"], t["s"]).alias("y"), t["x"].bitwiseAND(t["low"]).alias("qx"), t["y"].bitwiseAND(t["low"]).alias("qy")))


def grid_origin(f: Column, n: int = 2) -> Column:
    """First tile of an n-wide grid around a marker."""
    return F.floor(f - n / 2.0 + 0.5).cast("long")


def grid_drift(f: Column, origin: Column, n: int = 2) -> Column:
    """-1, 0 or 1: where the marker has left the middle of the grid."""
    r = f - (origin + n / 2.0)
    return F.when(r < -0.5, -1).when(r >= 0.5, 1).otherwise(0)


def slot_rank(row: Column, col: Column, n: int = 2) -> Column:
    """Squared doubled distance of a slot from the grid's middle."""
    dr, dc = 2 * row - (n - 1), 2 * col - (n - 1)
    return dr * dr + dc * dc


def tile_bounds_e7(z: Column, x: Column, y: Column) -> Column:
    """struct(lon0, lon1, lat0, lat1) in 1e-7 degrees."""
    n = F.pow(F.lit(2.0), z).cast("long")
    edge = lambda k: F.lit(-1800000000) + F.floor((F.lit(3600000000) * k).cast("decimal(30,0)") / n).cast("long")
    lat = lambda k: (from_mercator(F.lit(0.0), k.cast("double"), z)["lat"] * 1e7).cast("long")
    return F.struct(edge(x).alias("lon0"), edge(x + 1).alias("lon1"), lat(y + 1).alias("lat0"), lat(y).alias("lat1"))
