import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from geostride.functions import compass, geo, nmea, scalars, sun, tiles

from . import fixtures as fx


def column(spark, rows, schema, expr):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def hilbert(z, x, y):
    """Published curve: quadrant by quadrant from the top."""
    d, n = 0, 1 << z
    for s in (n >> k for k in range(1, z + 1)):
        rx, ry = int(x & s > 0), int(y & s > 0)
        d += s * s * ((3 * rx) ^ ry)
        if not ry:
            if rx:
                x, y = s - 1 - (x & (s - 1)), s - 1 - (y & (s - 1))
            x, y = y, x
        x, y = x & (s - 1), y & (s - 1)
    return (4**z - 1) // 3 + d


def test_hilbert_ids_of_the_world_floor_and_of_deep_tiles(spark):
    every = spark.range(5461).select(F.col("id"), tiles.hilbert_zxy(F.col("id")).alias("t")).select("id", "t.*")
    back = every.withColumn("back", tiles.hilbert_id(F.col("z"), F.col("x"), F.col("y"))).collect()
    assert all(r.id == r.back == hilbert(r.z, r.x, r.y) for r in back)
    assert {(r.z, r.x, r.y) for r in back} == {(z, x, y) for z in range(7) for x in range(1 << z) for y in range(1 << z)}
    r = random.Random(1)
    deep = [(z, r.randrange(1 << z), r.randrange(1 << z)) for z in range(7, 31) for _ in range(6)]
    ids = [hilbert(*t) for t in deep]
    assert column(spark, deep, "z int, x long, y long", tiles.hilbert_id(F.col("z"), F.col("x"), F.col("y"))) == ids
    assert [tuple(t) for t in column(spark, [(i,) for i in ids], "i long", tiles.hilbert_zxy(F.col("i")))] == deep
    # the first ids of the published table
    assert [hilbert(*t) for t in ((0, 0, 0), (1, 0, 0), (1, 0, 1), (1, 1, 1), (1, 1, 0), (2, 0, 0))] == [0, 1, 2, 3, 4, 5]
    outside = [(31, 0, 0), (2, 4, 0), (2, 0, -1), (-1, 0, 0)]
    assert column(spark, outside, "z int, x long, y long", tiles.hilbert_id(F.col("z"), F.col("x"), F.col("y"))) == [None] * 4
    assert column(spark, [(-1,), ((4**31 - 1) // 3,)], "i long", tiles.hilbert_zxy(F.col("i"))) == [None, None]


def test_mercator_there_and_back(spark):
    r = random.Random(2)
    points = [(r.uniform(-85, 85), r.uniform(-180, 179.999), r.randint(0, 20)) for _ in range(200)]
    m = tiles.mercator(F.col("lat"), F.col("lon"), F.col("z"))
    rows = spark.createDataFrame(points, "lat double, lon double, z int").withColumn("m", m).withColumn("b", tiles.from_mercator(F.col("m.fx"), F.col("m.fy"), F.col("z"))).collect()
    for q in rows:
        assert q.b.lat == pytest.approx(q.lat, abs=1e-9) and q.b.lon == pytest.approx(q.lon, abs=1e-9)
        assert q.m.fy == pytest.approx((1 - math.asinh(math.tan(math.radians(q.lat))) / math.pi) / 2 * 2**q.z)
    edge = spark.createDataFrame([(90.0, 180.0), (-90.0, -180.0), (0.0, 540.0)], "lat double, lon double").select(tiles.mercator(F.col("lat"), F.col("lon"), F.lit(1)).alias("m")).collect()
    assert [(round(e.m.fx, 9), round(e.m.fy, 9)) for e in edge] == [(0, 0), (0, 2), (0, 1)]
    low = spark.createDataFrame(points, "lat double, lon double, z int").select("lat", "lon", tiles.mercator_log(F.col("lat"), F.col("lon")).alias("l"), tiles.mercator(F.col("lat"), F.col("lon"), F.lit(0)).alias("m")).collect()
    assert all(q.l.x == pytest.approx(q.m.fx) and q.l.y == pytest.approx(q.m.fy) for q in low)


def test_grid_functions(spark):
    f = [(0.4,), (0.5,), (1.49,), (1.5,), (2.6,)]
    assert column(spark, f, "f double", tiles.grid_origin(F.col("f"), 2)) == [-1, 0, 0, 1, 2]
    assert column(spark, f, "f double", tiles.grid_drift(F.col("f"), F.lit(0), 2)) == [-1, 0, 0, 1, 1]
    slots = [(k // 3, k % 3) for k in range(9)]
    assert column(spark, slots, "r int, c int", tiles.slot_rank(F.col("r"), F.col("c"), 3)) == [8, 4, 8, 4, 0, 4, 8, 4, 8]
    assert column(spark, [(5, -1), (5, 32), (5, 31)], "z int, x long", tiles.wrap_x(F.col("x"), F.col("z"))) == [31, 0, 31]
    assert column(spark, [(14, 10001, 6003)], "z int, x long, y long", tiles.parent_tile(F.col("z"), F.col("x"), F.col("y"), F.lit(2))) == [(12, 2500, 1500, 1, 3)]


def test_known_distances_and_bearings(spark):
    rows = [(51.5007, -0.1246, 48.8584, 2.2945), (0.0, 0.0, 0.0, 90.0), (10.0, 20.0, 10.0, 20.0), (0.0, 0.0, -1.0, 0.0)]
    schema = "a double, b double, c double, d double"
    at = tuple(map(F.col, "abcd"))
    d = column(spark, rows, schema, geo.haversine_m(*at))
    assert d[0] == pytest.approx(340_540, rel=2e-3) and d[1] == pytest.approx(math.pi / 2 * geo.EARTH_M) and d[2] == 0
    b = column(spark, rows, schema, geo.bearing_deg(*at))
    assert b[0] == pytest.approx(148.7, abs=0.3) and b[1] == pytest.approx(90) and b[3] == pytest.approx(180)
    flat = column(spark, [(10.0, 20.0, 10.001, 20.001)], schema, geo.flat_m_mean(*at))[0]
    assert flat == pytest.approx(math.hypot(111.32, 111.32 * math.cos(math.radians(10.0005))))


def test_compass_points_and_texts(spark):
    deg = [(0.0,), (11.24,), (11.25,), (348.74,), (348.75,), (180.0,), (359.9,)]
    assert column(spark, deg, "d double", geo.compass16(F.col("d"))) == ["N", "N", "NNE", "NNW", "N", "S", "N"]
    assert column(spark, [(-1.0,), (45.0,)], "d double", geo.heading_label(F.col("d"))) == ["--", "NE"]
    text = [(29.99, 0.0), (30.0, 90.0), (999.99, 90.0), (1000.0, 225.0), (12345.0, 0.0)]
    assert column(spark, text, "m double, b double", geo.target_text(F.col("m"), F.col("b"))) == ["here (29m)", "30 m E", "999 m E", "1.0 km SW", "12.3 km N"]


def test_sentence_fields(spark):
    coordinates = [("4807.038", "N"), ("01131.000", "W"), ("", "N"), ("4807.038", "S"), ("junk", "N"), ("4807.038", "")]
    got = column(spark, coordinates, "v string, h string", nmea.coordinate(F.col("v"), F.col("h")))
    assert got == pytest.approx([48.1173, -11.516667, 0, -48.1173, 0, 48.1173], abs=1e-6)
    assert column(spark, [("GP",), ("GL",), ("GA",), ("GB",), ("GN",), ("BD",)], "t string", nmea.constellation(F.col("t"))) == [0, 1, 2, 3, -1, -1]
    assert column(spark, [("12.5abc",), ("",), ("-3",), (" 7 ",), ("x",)], "v string", nmea.as_float(F.col("v"))) == [12.5, 0, -3, 7, 0]
    good = fx.sentence("GPRMC,123519,A,4807.038,N,01131.000,E,022.4,084.4,230394,003.1,W")
    assert good.endswith("*6A")  # the published example's checksum
    lines = [(good,), (good[:-1] + "B",), ("no sentence",)]
    assert column(spark, lines[:2], "l string", nmea.checksum_ok(F.col("l"))) == [True, False]
    s = column(spark, [*lines, ("$GPGGA,a,b*c,d",), ("$" + "x," * 99,)], "l string", nmea.sentence(F.col("l")))
    assert (s[0].talker, s[0].type, s[0].n, s[0].f[2]) == ("GP", "RMC", 12, "A") and s[2] is None and s[3].f == ["$GPGGA", "a", "b"] and s[4].n == 24


def test_epochs(spark):
    rows = [("120000.00", "010126"), ("000000", "010180"), ("235959", "311299"), ("12", "010126"), ("120000", "001326"), ("120000", "320126"), ("120000", "")]
    assert column(spark, rows, "u string, d string", nmea.epoch(F.col("u"), F.col("d"))) == [1767268800, 315532800, 946684799, 0, 0, 0, 0]


def test_gates(spark):
    rows = [("A", 3, 2.49, 8.0), ("A", 3, 2.5, 8.0), ("A", 3, 0.0, 8.0), ("A", 2, 1.0, 8.0), ("V", 3, 1.0, 8.0), ("A", 3, 1.0, 7.99)]
    schema = "s string, m int, h double, v double"
    assert column(spark, rows, schema, nmea.fine(F.col("s"), F.col("m"), F.col("h"))) == [True, False, False, False, False, True]
    assert column(spark, rows, schema, nmea.course_usable(F.col("s"), F.col("m"), F.col("h"), F.col("v"))) == [True, False, False, False, False, False]


def test_small_scalars(spark):
    assert column(spark, [(0,), (1,), (2,), (3,), (4294967294,), (4294967295,)], "v long", scalars.zigzag(F.col("v"))) == [0, -1, 1, -2, 2147483647, -2147483648]
    assert column(spark, [(255, 255, 255), (8, 4, 8), (7, 3, 7)], "r int, g int, b int", scalars.rgb565(*map(F.col, "rgb"))) == [65535, 2081, 0]
    assert column(spark, [(0, 65535, 255), (0, 65535, 0), (0, 65535, 128)], "d int, s int, a int", scalars.blend565(F.col("d"), F.col("s"), F.col("a"))) == [65535, 0, 16 << 11 | 32 << 5 | 16]
    assert column(spark, [("aa:bb:cc:dd:ee:ff",)], "b string", scalars.bssid_text(scalars.bssid_pack(F.col("b")))) == ["aa:bb:cc:dd:ee:ff"]
    sizes = [("archive size of 1.5 GB",), ("x archive size of 250 MB y",), ("archive size of 2 TB",), ("nothing",)]
    assert column(spark, sizes, "t string", scalars.size_gb(F.col("t"))) == [1.5, 0.25, 2000.0, None]
    assert column(spark, [(2499,), (6600,), (8300,), (9999,), (7450,), (None,)], "mv int", scalars.battery_percent(F.col("mv"))) == [-1, 0, 100, 100, 50, -1]
    assert column(spark, [(b"123456789",)], "d binary", F.crc32("d")) == [0xCBF43926 == zlib.crc32(b"123456789") and 0xCBF43926]
    assert column(spark, [([1, 7, 0, 0],)], "b array<int>", nmea.fletcher8(F.col("b"))) == [(8, 25)]
    ring = [([(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)],), ([(0, 0), (0, 10), (10, 10), (10, 0)],), ([(1, 1), (2, 2)],)]
    assert column(spark, ring, "p array<struct<x:int,y:int>>", scalars.shoelace2(F.col("p"))) == [200, -200, 0]


def test_headings(spark):
    level = [(1.0, 0.0, 5.0), (0.0, 1.0, 5.0), (-1.0, 0.0, 5.0), (0.0, -1.0, 5.0)]
    h = compass.heading_deg(F.col("x"), F.col("y"), F.col("z"), F.lit(0.0), F.lit(0.0), F.lit(1.0))
    assert column(spark, level, "x double, y double, z double", h) == pytest.approx([0, 90, 180, 270], abs=1e-9)
    # turned about the pitch axis the heading stays
    for pitch in (-0.6, 0.3, 0.9):
        c, s = math.cos(pitch), math.sin(pitch)
        rolled = [(c * x - s * z, y, s * x + c * z) for x, y, z in level]
        tilted = compass.heading_deg(F.col("x"), F.col("y"), F.col("z"), F.lit(-s), F.lit(0.0), F.lit(c))
        assert column(spark, rolled, "x double, y double, z double", tilted) == pytest.approx([0, 90, 180, 270], abs=1e-6)
    cal = compass.calibrated(F.lit(3.0), F.lit(5.0), F.lit(7.0), tuple(map(F.lit, (1.0, 1.0, 1.0))), tuple(map(F.lit, (2.0, 1.0, 1.0))))
    assert tuple(spark.range(1).select(cal).first()[0]) == pytest.approx((-4, 4, 6, math.sqrt(68)))
    assert column(spark, [(1.0, 1.2, 0.8), (0.01, 1.0, 1.0)], "a double, b double, c double", compass.gain_spread(*map(F.col, "abc"))) == pytest.approx([0.5, 99.0])
    assert column(spark, [(0.0, 40.0, 0.0, 20.0, 0.0, 80.0)], "a double, b double, c double, d double, e double, f double", compass.sweep_progress(*map(F.col, "abcdef"))) == [50]
    assert -20 < column(spark, [(42.0, -83.0)], "a double, b double", compass.declination_deg(F.col("a"), F.col("b")))[0] < 0


def test_sun(spark):
    rows = [(51.5, 0.0, 172), (51.5, 0.0, 355), (0.0, 0.0, 80), (80.0, 0.0, 172)]
    t = [r[0] for r in spark.createDataFrame(rows, "lat double, lon double, d int").select(sun.sun_minutes(F.col("lat"), F.col("lon"), F.col("d"))).collect()]
    assert t[0].rise == pytest.approx(3 * 60 + 43, abs=4) and t[0].set == pytest.approx(20 * 60 + 21, abs=4)  # London, midsummer (UTC)
    assert t[1].rise == pytest.approx(8 * 60 + 4, abs=4) and t[2].set - t[2].rise == pytest.approx(727, abs=4) and t[3].rise is None
    cases = [(360.0, 1080.0, 359.0), (360.0, 1080.0, 360.0), (360.0, 1080.0, 1080.0), (600.0, 1487.0, 30.0), (600.0, 1487.0, 60.0), (None, None, 5.0), (10.0, 10.0, 700.0)]
    assert column(spark, cases, "r double, s double, n double", sun.is_day(F.col("r"), F.col("s"), F.col("n"))) == [False, True, False, True, False, True, True]
    near = [(10.0, 700.0, 1430.0), (360.0, 1080.0, 720.0), (None, None, 1.0)]
    assert column(spark, near, "r double, s double, n double", sun.minutes_to_twilight(F.col("r"), F.col("s"), F.col("n"))) == [20.0, 360.0, -1.0]
    levels = [("auto", "auto", 30.0, False), ("auto", "auto", 30.1, True), ("day", "auto", 1.0, True), ("night", "high", 1.0, True), ("auto", "auto", -1.0, False)]
    assert column(spark, levels, "t string, l string, m double, d boolean", sun.brightness(*map(F.col, "tlmd"))) == [140, 60, 255, 255, 255]
    assert column(spark, [(255, True), (60, True), (255, False)], "w int, d boolean", sun.idle_brightness(F.col("w"), F.col("d"))) == [102, 30, 255]
