"""Sunrise, sunset and what follows from them, as column expressions.

The times come from NOAA's published equations (Spencer's Fourier series for declination and the equation of time,
zenith 90.833 degrees)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

ZENITH = 90.833
DAY, DUSK, NIGHT = 255, 140, 60
TWILIGHT_MIN = 30.0
DIM_PERCENT, DIM_FLOOR = 40, 30


def sun_minutes(lat: Column, lon: Column, day_of_year: Column) -> Column:
    """struct(rise, set) in minutes of the UTC day (may lie outside 0..1440); both null where the sun doesn't cross."""
    g = 2 * math.pi / 365.0 * (day_of_year - 1)
    eq = 229.18 * (0.000075 + 0.001868 * F.cos(g) - 0.032077 * F.sin(g) - 0.014615 * F.cos(2 * g) - 0.040849 * F.sin(2 * g))
    decl = 0.006918 - 0.399912 * F.cos(g) + 0.070257 * F.sin(g) - 0.006758 * F.cos(2 * g) + 0.000907 * F.sin(2 * g) - 0.002697 * F.cos(3 * g) + 0.00148 * F.sin(3 * g)
    phi = F.radians(lat)
    cos_h = math.cos(math.radians(ZENITH)) / (F.cos(phi) * F.cos(decl)) - F.tan(phi) * F.tan(decl)
    half = F.when(F.abs(cos_h) <= 1, F.degrees(F.acos(cos_h)) * 4)
    noon = 720 - 4 * lon - eq
    return F.struct((noon - half).alias("rise"), (noon + half).alias("set"))


def is_day(rise: Column, set_: Column, now_min: Column) -> Column:
    """Whether the sun is up; a day without a crossing counts as one."""
    r, s = F.pmod(rise, F.lit(1440.0)), F.pmod(set_, F.lit(1440.0))
    return F.when(rise.isNull() | set_.isNull() | (r == s), True).when(r < s, (now_min >= r) & (now_min < s)).otherwise((now_min >= r) | (now_min < s))


def minutes_to_twilight(rise: Column, set_: Column, now_min: Column) -> Column:
    """Minutes on the clock's circle to the nearer crossing, -1 without one."""
    r, s = F.pmod(rise, F.lit(1440.0)), F.pmod(set_, F.lit(1440.0))
    circle = lambda a: F.when(F.abs(now_min - a) > 720, 1440 - F.abs(now_min - a)).otherwise(F.abs(now_min - a))
    return F.when(rise.isNull() | set_.isNull() | (r == s), -1.0).otherwise(F.least(circle(r), circle(s)))


def brightness(theme: Column, level: Column, to_twilight: Column, dark: Column) -> Column:
    """Backlight: a fixed level (low, med, high) beats the theme (day, night), which beats the sun."""
    auto = F.when(theme == "day", DAY).when(theme == "night", NIGHT).when(to_twilight.between(0.0, TWILIGHT_MIN), DUSK).when(dark, NIGHT).otherwise(DAY)
    return F.when(level == "low", NIGHT).when(level == "med", DUSK).when(level == "high", DAY).otherwise(auto)


def idle_brightness(want: Column, dimmed: Column) -> Column:
    return F.when(dimmed, F.greatest(F.lit(DIM_FLOOR), F.floor(want * DIM_PERCENT / 100).cast("int"))).otherwise(want)
