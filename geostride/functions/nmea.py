"""Satellite-navigation sentences as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_LINE, MAX_FIELDS = 127, 24
#: Constellations by talker; others are ignored. Fixed values.
TALKERS = ("GP", "GL", "GA", "GB")
#: Fields a sentence has at least.
LEAST_FIELDS = {"RMC": 10, "VTG": 8, "GGA": 10, "GSA": 18, "GSV": 4}


def as_float(field: Column) -> Column:
    """Leading number of a text, 0 without one."""
    return F.coalesce(F.regexp_extract(field, r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)", 1).try_cast("double"), F.lit(0.0))


def as_int(field: Column) -> Column:
    """Leading whole number of a text (nine digits at most), 0 without one. The expression is for what isn't plainly one."""
    plain = F.when(F.length(field) <= 9, field.try_cast("int"))
    leading = F.regexp_extract(field, r"^\s*([+-]?[0-9]{1,9})", 1).try_cast("int")
    return F.when(F.coalesce(field, F.lit("")) == "", 0).otherwise(F.coalesce(plain, leading, F.lit(0)))


def coordinate(value: Column, hemisphere: Column) -> Column:
    """Degrees of ddmm.mmmm or dddmm.mmmm; south and west are negative; 0 where empty."""
    raw = as_float(value)
    deg = (raw / 100).cast("int")
    d = deg + (raw - deg * 100) / 60.0
    return F.when(F.coalesce(value, F.lit("")) == "", 0.0).when(F.substring(hemisphere, 1, 1).isin("S", "W"), -d).otherwise(d)


def constellation(talker: Column) -> Column:
    """0 to 3, or -1."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, TALKERS)), talker).cast("int") - 1, F.lit(-1))


def fields(line: Column) -> Column:
    """Fields of a sentence: up to the checksum's star, commas part them, the 24th takes what is left."""
    body = F.substring_index(F.substring(F.translate(line, "\r\n", ""), 1, MAX_LINE), "*", 1)
    return F.slice(F.split(body, ",", -1), 1, MAX_FIELDS)


def sentence(line: Column) -> Column:
    """struct(talker, type, f, n), null for a line that is no sentence."""
    f = fields(line)
    return F.when(F.startswith(line, F.lit("$")), F.struct(F.substring(line, 2, 2).alias("talker"), F.substring(line, 4, 3).alias("type"), f.alias("f"), F.size(f).alias("n")))


def checksum_ok(line: Column) -> Column:
    """Whether the two digits after the star are the exclusive or of what stands between `$` and it."""
    body = F.regexp_extract(line, r"^\$([^*]*)\*", 1)
    total = F.aggregate(F.transform(F.split(body, ""), lambda c: F.ascii(c)), F.lit(0), lambda a, c: a.bitwiseXOR(c))
    return F.lpad(F.hex(total), 2, "0") == F.upper(F.regexp_extract(line, r"\*([0-9A-Fa-f]{2})", 1))


#: Years that a clock may show before it is set by a satellite. Fixed values.
PLAUSIBLE_YEARS = (2026, 2036)


def plausible_date(date: Column) -> Column:
    """Whether ddmmyy is a day of a month in the range, and its year (20yy) one that a clock may show."""
    part = lambda k: F.substring(date, k, 2).try_cast("int")
    ok = (F.length(date) == 6) & part(1).between(1, 31) & part(3).between(1, 12) & (part(5) + 2000).between(*PLAUSIBLE_YEARS)
    return F.coalesce(ok, F.lit(False))


def epoch(utc: Column, date: Column) -> Column:
    """Seconds since 1970 of hhmmss and ddmmyy (years under 80 are 20yy); 0 where a field is short or out of range."""
    part = lambda c, k: F.coalesce(F.substring(c, k, 2).try_cast("int"), F.lit(0))
    day, month, yy = part(date, 1), part(date, 3), part(date, 5)
    year = F.when(yy < 80, 2000 + yy).otherwise(1900 + yy)
    start = F.try_make_timestamp(year, month, F.lit(1), F.lit(0), F.lit(0), F.lit(0.0), F.lit("UTC"))
    seconds = F.unix_seconds(start) + (day - 1) * 86400 + part(utc, 1) * 3600 + part(utc, 3) * 60 + part(utc, 5)
    ok = (F.length(utc) >= 6) & (F.length(date) >= 6) & month.between(1, 12) & day.between(1, 31)
    return F.coalesce(F.when(ok, seconds), F.lit(0)).cast("long")


def coarse(status: Column) -> Column:
    return status == "A"


def fine(status: Column, mode: Column, hdop: Column) -> Column:
    return (status == "A") & (mode == 3) & (hdop > 0) & (hdop < 2.5)


def course_usable(status: Column, mode: Column, hdop: Column, speed_kmh: Column) -> Column:
    return fine(status, mode, hdop) & (speed_kmh >= 8.0)


def fletcher8(bytes_: Column) -> Column:
    """struct(a, k): running sums modulo 256 over an array of byte values."""
    return F.aggregate(bytes_, F.struct(F.lit(0).alias("a"), F.lit(0).alias("k")), lambda s, b: F.struct(((s["a"] + b) % 256).alias("a"), ((s["k"] + (s["a"] + b) % 256) % 256).alias("k")))


def rate_ms(ms: Column) -> Column:
    return F.greatest(F.lit(200), F.least(F.lit(10000), ms))
