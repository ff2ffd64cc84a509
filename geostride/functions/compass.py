"""Magnetometer and attitude as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: North pole of the geomagnetic dipole, degrees. Fixed values.
POLE_LAT, POLE_LON = 86.5, 164.0


def calibrated(x: Column, y: Column, z: Column, offset: tuple[Column, Column, Column], scale: tuple[Column, Column, Column]) -> Column:
    """struct(x, y, z, field): centred, scaled, then turned into the accelerometer's frame (-y, x, z)."""
    cx, cy, cz = ((v - o) * s for v, o, s in zip((x, y, z), offset, scale, strict=True))
    return F.struct((-cy).alias("x"), cx.alias("y"), cz.alias("z"), F.sqrt(cx * cx + cy * cy + cz * cz).alias("field"))


def roll_rad(ay: Column, az: Column) -> Column:
    return F.atan2(ay, az)


def pitch_rad(ax: Column, ay: Column, az: Column) -> Column:
    return F.atan2(-ax, F.sqrt(ay * ay + az * az))


def heading_deg(mx: Column, my: Column, mz: Column, ax: Column, ay: Column, az: Column, declination: Column | float = 0.0) -> Column:
    """Tilt-compensated heading, 0 to 360."""
    r, p = roll_rad(ay, az), pitch_rad(ax, ay, az)
    xh = mx * F.cos(p) + mz * F.sin(p)
    yh = mx * F.sin(r) * F.sin(p) + my * F.cos(r) - mz * F.sin(r) * F.cos(p)
    return F.pmod(F.degrees(F.atan2(yh, xh)) + declination, F.lit(360.0))


def declination_deg(lat: Column, lon: Column) -> Column:
    """Bearing to the dipole's pole, -180 to 180."""
    p, s = math.radians(POLE_LAT), F.radians(lat)
    d = F.lit(math.radians(POLE_LON)) - F.radians(lon)
    return F.degrees(F.atan2(F.sin(d) * math.cos(p), F.cos(s) * math.sin(p) - F.sin(s) * math.cos(p) * F.cos(d)))


def gain_spread(gx: Column, gy: Column, gz: Column) -> Column:
    low = F.least(gx, gy, gz)
    return F.when(low <= 0.01, 99.0).otherwise(F.greatest(gx, gy, gz) / low - 1)


def sweep_progress(min_x: Column, max_x: Column, min_y: Column, max_y: Column, min_z: Column, max_z: Column, target: float = 40.0) -> Column:
    """Percent of the range that the least swept axis has of what it needs, cut to a whole number."""
    share = [F.least(F.lit(1.0), (b - a) / target) for a, b in ((min_x, max_x), (min_y, max_y), (min_z, max_z))]
    return (F.least(*share) * 100).cast("int")
