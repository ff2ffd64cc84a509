import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from geostride.operators import archive, coverage, gnss, magnet, places, policies, raster, rings, state, trust, waypoints, wifi
from geostride.streaming.fold import batch_fold
from geostride.streaming.steps import fix_step, trust_step

from . import fixtures as fx
from .test_functions import hilbert


def test_offsets_and_ids(spark):
    rows = [("a", 0, 5, 10, 0), ("a", 1, 2, 20, 0), ("a", 2, 1, 30, 101), ("a", 3, 4, 40, 0), ("b", 0, 9, 1, 8)]
    e = spark.createDataFrame(rows, "dir string, ord int, step long, length long, stored long")
    got = {(r.dir, r.ord): (r.tile_id, r.offset) for r in archive.with_offsets(archive.with_ids(e, ["dir"], "ord"), ["dir"], "ord").collect()}
    assert got == {("a", 0): (5, 0), ("a", 1): (7, 10), ("a", 2): (8, 100), ("a", 3): (12, 130), ("b", 0): (9, 7)}


HEADS = "path string, archive_order int, min_zoom int, max_zoom int, min_lon_e7 int, max_lon_e7 int, min_lat_e7 int, max_lat_e7 int"


def test_resolution_order(spark):
    world = (-1800000000, 1800000000, -850511287, 850511287)
    heads = spark.createDataFrame([("first", 0, 0, 2, *world), ("second", 1, 0, 2, *world), ("east", 2, 0, 2, 1, 1800000000, -850511287, 850511287)], HEADS)
    ids = {t: hilbert(*t) for t in ((2, x, y) for x in range(4) for y in range(4))}
    a, b, c, d, e = (2, 0, 0), (2, 1, 1), (2, 2, 2), (2, 3, 3), (2, 0, 3)
    entries = spark.createDataFrame([("second", ids[a], 1, 10, 1), ("first", ids[b], 1, 20, 2), ("second", ids[b], 1, 21, 3), ("first", ids[c], 1, 30, 4)], "path string, tile_id long, run_length long, length long, offset long")
    cache = spark.createDataFrame([(ids[c], 99), (ids[d], 0), (ids[a], 0)], "tile_id long, length int")
    remote = spark.createDataFrame([(*t, 7, 8) for t in (a, b, d, e)], "z int, x long, y long, offset long, length long")
    asked = spark.createDataFrame([*[a, b, c, d, e, a], (2, 3, 0)], "z int, x long, y long")
    got = {(r.z, r.x, r.y): (r.source, r.path, r.offset, r.length) for r in archive.resolve(asked, cache, heads, entries, remote).collect()}
    assert got == {a: ("local", "second", 1, 10), b: ("local", "first", 2, 20), c: ("cache", None, None, 99), d: ("miss", None, None, None), e: ("remote", None, 7, 8), (2, 3, 0): ("miss", None, None, None)}
    offline = {(r.z, r.x, r.y): r.source for r in archive.resolve(asked, cache, heads, entries).collect()}
    assert offline[e] == "miss" and offline[a] == "local"
    assert archive.distinct_reads(archive.resolve(asked, cache, heads, entries, remote)).count() == 3
    assert not archive.world_floor_complete(heads).first().complete
    deep = spark.createDataFrame([("all", 0, 0, 6, *world)], HEADS)
    assert archive.world_floor_complete(deep).first().complete
    put = archive.put_tiles(cache, spark.createDataFrame([(ids[c], 1), (500, 5)], "tile_id long, length int"))
    assert {(r.tile_id, r.length) for r in put.collect()} == {(ids[c], 99), (ids[d], 0), (ids[a], 0), (500, 5)}


def test_bounds_are_inclusive(spark):
    heads = spark.createDataFrame([("x", 0, 3, 3, 450000000, 450000000, 0, 0)], HEADS)
    asked = spark.createDataFrame([(3, x, y) for x in range(8) for y in range(8)], "z int, x long, y long")
    assert {(r.x, r.y) for r in archive.covered(asked, heads).collect()} == {(4, 3), (4, 4), (5, 3), (5, 4)}


def test_newest_build(spark):
    available = spark.sql("select explode(array(date'2026-01-01', date'2026-01-05', date'2026-01-12')) build")
    assert str(archive.newest_build(available, F.lit("2026-01-10").cast("date")).first().build) == "2026-01-05"
    assert archive.newest_build(available, F.lit("2027-01-10").cast("date")).first().build is None


def test_squares_wrap_and_stop_at_the_poles(spark):
    p = spark.createDataFrame([(84.9, 179.9)], "lat double, lon double")
    got = {(r.x, r.y) for r in coverage.square_around(p, 5, 1).collect()}
    assert got == {(x % 32, y) for x in (30, 31, 32) for y in (0, 1)}
    held = spark.createDataFrame([(5, 31, 0)], "z int, x long, y long")
    assert coverage.missing(coverage.square_around(p, 5, 1), held).count() == 5
    assert coverage.world_floor(spark, 3).count() == 85


def test_grids_keep_their_invariants(spark):
    fixes = spark.createDataFrame([("a", 1, 52.0, 13.0), ("a", 2, 52.0, 13.03), ("b", 1, 85.0, 179.99)], "device string, step int, lat double, lon double")
    grid = coverage.visible_tiles(fixes, 14)
    assert grid.count() == 12 and grid.filter("state = 'nodata' and y >= 0").count() == 0
    g = {k: {(r.x, r.y) for r in grid.filter(f"device = 'a' and step = {k}").collect()} for k in (1, 2)}
    jobs = coverage.grid_jobs(grid.filter("step = 1"), grid.filter("device = 'a' and step = 2"), ["device"]).collect()
    assert {(j.x, j.y) for j in jobs} == g[2] - g[1] and len(g[2]) == 4
    slots = grid.filter("step = 1").withColumn("generation", F.lit(3))
    results = slots.withColumn("generation", F.when(F.col("slot") == 0, 2).otherwise(3)).withColumn("pixels", F.lit(1))
    assert coverage.accept_results(slots, results, ["device"]).count() == 6


def test_nearest_places_equal_every_pair(spark):
    r = random.Random(5)
    points = [(k, r.uniform(0, 64), r.uniform(0, 64)) for k in range(60)]
    spots = [(r.choice((6, 8)), k, r.choice(places.RANKS), f"p{k}") for k in range(80)]
    rows = [(z, o, rank, n, r.uniform(0, 64) * 2 ** (z - 6), r.uniform(0, 64) * 2 ** (z - 6)) for z, o, rank, n in spots]
    rows.append((6, 900, "country", "same", *rows[0][4:])) if rows[0][0] == 6 else None
    want = {}
    for k, px, py in points:
        for z, o, rank, n, fx_, fy in rows:
            s = 2 ** (z - 6)
            d2, reach = (fx_ - px * s) ** 2 + (fy - py * s) ** 2, places.REACH.get(rank)
            if reach is None or d2 <= (reach * s) ** 2:
                want[(k, rank)] = min(want.get((k, rank), (9e9, 0, "")), (d2, o, n))
    got = places.nearest_places(spark.createDataFrame(points, "id long, fx double, fy double"), spark.createDataFrame(rows, "z int, ord long, rank string, name string, fx double, fy double"), "id", 6)
    assert {(g.id, g["rank"]): g.name for g in got.collect()} == {k: v[2] for k, v in want.items()}


def test_place_text_and_memory(spark):
    rows = [("d", 1, "Old Town", "Dexter", "Michigan", "US"), ("d", 2, None, None, None, None), ("d", 3, None, "Michigan", None, None), ("d", 4, "H", None, None, None)]
    got = places.hold_names(spark.createDataFrame(rows, "device string, ms int, hood string, locality string, region string, country string"), "device", "ms").orderBy("ms").collect()
    assert [g.place for g in got] == ["Old Town, Dexter, Michigan, US", "Dexter, Michigan, US", "Michigan, US", "H, Michigan, US"]


def test_styles_and_labels(spark):
    parts = spark.createDataFrame([("roads", "rail", 1), ("roads", "odd", 2), ("landuse", "wood", 3), ("places", "village", 4), ("nothing", "x", 5), ("water", None, 6)], "layer string, kind string, k int")
    assert [r.style for r in places.with_style(parts).orderBy("k").collect()] == ["rail", "minor", "park", "hood", "none", "none"]
    shape = "z int, x long, y long, extent int, geom string, name string, style string, pts array<struct<x:int,y:int>>"
    p = spark.createDataFrame([(6, 3, 4, 4096, "point", "in", "locality", [(0, 4095), (9, 9)]), (6, 3, 4, 4096, "point", "buffer", "locality", [(-1, 5)]), (6, 3, 4, 4096, "point", None, "poi", [(1, 1)]), (6, 3, 4, 4096, "line", "l", "poi", [(1, 1)]), (6, 3, 4, 4096, "point", "r", "rail", [(1, 1)])], shape)
    assert [r.name for r in places.captured_labels(p).collect()] == ["in"]
    assert {(r.name, r.fx) for r in places.places_of(p, ("locality",)).collect()} == {("in", 3.0), ("buffer", 3 - 1 / 4096)}


def test_greedy_labels(spark):
    rows = [(1, 0, k, s, x, y, 80, 20, f"t{k}") for k, (s, x, y) in enumerate([("poi", 100, 100), ("country", 110, 95), ("hood", 300, 300), ("locality", 305, 305), ("poi", 3000, 100), ("hood", 600, 600)])]
    schema = "view int, slot int, ord int, style string, sx int, sy int, width_px int, height_px int, text string"
    placed = places.place_labels(spark.createDataFrame(rows, schema)).collect()
    assert {p.ord for p in placed} == {1, 3, 5}
    assert {p.ord for p in places.place_labels(spark.createDataFrame(rows, schema), most=2).collect()} == {1, 3}


LINES = [
    "GPRMC,120000.00,A,4807.038,N,01131.000,E,1,2,010126,,", "GPVTG,12.5,T,,M,1.0,N,30.5,K", "GPGGA,120000.00,4807.0,N,01131.0,E,1,09,0.9,545.4,M,,", "GPGSA,A,3,1,2,3,4,5,6,7,8,9,10,11,12,1,1,1",
    "GPRMC,120001.00,V,,,,,,,010126,,", "GPGSA,A,2,1,2,3,4,5,6,7,8,9,10,11,12,1,1,1", "GPGSA,A,1,1,2,3,4,5,6,7,8,9,10,11,12,1,1,1", "GPGSA,A,2,1,2,3,4,5,6,7,8,9,10,11,12,1,1,1", "GPGGA,120000.00,4807.0,N,01131.0,E,1,,,,M,,",
    "GPRMC,120002.00,A,4807.040,S,01131.002,W,1,2,010126,,", "GPVTG,,T,,M,,N,0.0,K", "GPRMC,short", "GNGSV,1,1,04,01,40,083,46",
]


def test_fixes_fold_as_they_arrive(spark):
    lines = [("d", k, fx.sentence(b) + "\r\n") for k, b in enumerate(LINES)] + [("d", 99, "junk"), ("e", 1, fx.sentence(LINES[0])[:-2] + "00")]
    df = spark.createDataFrame(lines, "device string, seq long, line string")
    got = {(r.device, r.seq): r for r in gnss.fixes(df).collect()}
    want = {(r["device"], r["seq"]): r for r in batch_fold(pd.DataFrame(lines, columns=["device", "seq", "line"]), fix_step, order="seq")}
    for k, g in got.items():
        for c in ("status", "utc", "date", "lat", "lon", "course", "speed_kmh", "sats", "hdop", "altitude", "mode"):
            assert g[c] == pytest.approx(want[k][c]) if isinstance(g[c], float) else g[c] == want[k][c], (k, c)
    assert ("d", 99) not in got and [got[("d", k)].mode for k in (3, 5, 6, 7)] == [3, 3, 1, 2]
    assert got[("d", 4)].lat == got[("d", 0)].lat and got[("d", 8)].hdop == 99.99 and got[("e", 1)].status == "A"
    assert {r.device for r in gnss.fixes(df, verify_checksum=True).collect()} == {"d"}
    assert [r.mode for r in gnss.fixes(df.filter("seq in (3, 5)"), mode_policy="latest").orderBy("seq").collect()] == [3, 2]


def test_constellations(spark):
    lines = ["GPGSV,2,1,07,01,40,083,46,02,17,308,", "GPGSV,2,2,07,12,07,344,39,14,22,228,45", "GLGSV,1,1,02,70,40,083,20", "GPGSV,1,1,05,01,40,083,30", "GNGSV,1,1,05,01,40,083,99"]
    df = spark.createDataFrame([("d", k, fx.sentence(b)) for k, b in enumerate(lines)], "device string, seq long, line string")
    got = [(r.seq, r.con, r.visible, r.best_snr, r.worst_snr) for r in gnss.constellations(df).orderBy("seq").collect()]
    assert got == [(0, 0, 7, 46, 46), (1, 0, 7, 46, 39), (2, 1, 2, 20, 20), (3, 0, 5, 30, 30)]


def walk(n=400, seed=6):
    r = random.Random(seed)
    lat, lon, alt, rows = 10.0, 20.0, 100.0, []
    for k in range(n):
        step = r.choice((0, 0.0003, 0.0003, 0.0003, 0.002 if r.random() < 0.1 else 0.0003))
        lat, lon = lat + step, lon + r.choice((0, step))
        if 150 < k < 260:
            pass  # a frozen altitude
        else:
            alt += r.uniform(-1, 1)
        status = "V" if r.random() < 0.04 else "A"
        rows.append(("d", float(k) if k % 50 else k + 0.2, status, lat, lon, -1000.0 if k % 97 == 0 else alt, r.choice((5.0, 60.0, 120.0)), 3, 1000 if k % 31 else 1500, 1767225700 + k, 1767225700 + k + (400 if k % 83 == 0 else 0), [(6, 40 + k % 7, 39), (6, 42, 40 - k % 9)]))
    return rows


WALK = "device string, ts double, status string, lat double, lon double, altitude double, speed_kmh double, mode int, pps_ms int, gnss_epoch long, rtc_epoch long, cons array<struct<visible:int,best_snr:int,worst_snr:int>>"


def test_trust_windows_equal_the_step_by_step_fold(spark):
    rows = walk()
    df = spark.createDataFrame(rows, WALK)
    got = {r.ts: (r.flags, r.level, r.text) for r in trust.trust(df).collect()}
    frame = pd.DataFrame(rows, columns=[c.split()[0] for c in WALK.split(", ")])
    frame["cons"] = [[dict(zip(("visible", "best_snr", "worst_snr"), c, strict=True)) for c in cs] for cs in frame["cons"]]
    want = {r["ts"]: (r["flags"], r["level"], r["text"]) for r in batch_fold(frame, trust_step, order="ts")}
    assert got == want
    assert {name for _, _, text in got.values() for name in text.split(", ") if name} >= {"speed", "clock", "sat SNR", "PPS", "altitude"}


def test_the_31st_frozen_step_counts(spark):
    rows = [("d", float(k), "A", 10 + k * 0.0003, 20.0, 50.0 if k <= 32 else 60.0) for k in range(36)]
    df = spark.createDataFrame(rows, "device string, ts double, status string, lat double, lon double, altitude double")
    frozen = [r.ts for r in trust.with_freeze(trust.with_motion(df)).filter("frozen").orderBy("ts").collect()]
    assert frozen == [31.0, 32.0]


def test_wifi_disagreement(spark):
    rows = [("d", 1.0, "A", 10.0, 20.0, 5.0, 0.0, (10.0, 20.0 + d, acc, used, age)) for d, acc, used, age in ((0.05, 0.0, 5, 1.0), (0.05, 3000.0, 5, 1.0), (0.05, 0.0, 4, 1.0), (0.05, 0.0, 5, 61.0), (0.01, 0.0, 9, 1.0))]
    schema = "device string, ts double, status string, lat double, lon double, altitude double, speed_kmh double, wifi struct<lat:double,lon:double,acc:double,used:int,age_s:double>"
    flags = [trust.trust(spark.createDataFrame([r], schema)).first().flags for r in rows]
    assert flags == [32, 0, 0, 0, 0]


def test_survey_and_location(spark):
    obs = [(1, -60, 42.0, -83.0, k) for k in range(3)] + [(2, -60, 42.0, -83.0, 0), (2, -60, 42.0, -83.0, 1)] + [(3, -60, 42.0 + k * 0.0018, -83.0, k) for k in range(4)] + [(4, -88, 42.001, -83.0, k) for k in range(3)] + [(5, -89, 42.0, -83.0, k) for k in range(5)] + [(6, -50, 42.0005, -83.001, k) for k in range(4)]
    table = wifi.learn(spark.createDataFrame(obs, "id long, rssi int, lat double, lon double, seq long"))
    rows = {r.id: r for r in table.collect()}
    assert set(rows) == {1, 2, 3, 4, 6} and rows[3].mobile and not rows[1].mobile and rows[1].n == 3 and rows[4].best_rssi == -88
    hits = spark.createDataFrame([(1, k, i, s) for k, (i, s) in enumerate([(1, -50), (2, -40), (3, -40), (4, -60), (6, -60), (9, -50)])] + [(2, 0, 1, -50), (2, 1, 4, -89), (2, 2, 6, -50)], "scan_id long, ord int, id long, rssi int")
    got = wifi.locate(hits, table).collect()
    w = np.array([1e-5, 1e-6, 1e-6])
    lat = (w * [42.0, 42.001, 42.0005]).sum() / w.sum()
    assert [(g.scan_id, g.used) for g in got] == [(1, 3)] and got[0].lat == pytest.approx(lat) and 0 < got[0].spread_m < 200
    many = spark.createDataFrame([(1, k, k, -60) for k in range(40)], "scan_id long, ord int, id long, rssi int")
    known = spark.createDataFrame([(k, 3, 126.0 + k, -249.0, 42.0, 42.0, -83.0, -83.0, -60, False) for k in range(40)], "id long, n long, sum_lat double, sum_lon double, min_lat float, max_lat float, min_lon float, max_lon float, best_rssi int, mobile boolean")
    assert [wifi.locate(many, known, most_hits=m).first().used for m in (32, None)] == [32, 40]


def test_partial_tables_fold_to_the_whole(spark):
    r = random.Random(8)
    obs = [(r.randrange(20), -r.randint(40, 95), 42 + r.random() * 0.001, -83 + r.random() * 0.001, k) for k in range(600)]
    schema = "id long, rssi int, lat double, lon double, seq long"
    whole = {x.id: x for x in wifi.learn(spark.createDataFrame(obs, schema)).collect()}
    halves = wifi.fold(wifi.learn(spark.createDataFrame(obs[:300], schema)), wifi.learn(spark.createDataFrame(obs[300:], schema)))
    for x in halves.collect():
        w = whole[x.id]
        assert (x.n, x.min_lat, x.max_lon, x.best_rssi, x.mobile) == (w.n, w.min_lat, w.max_lon, w.best_rssi, w.mobile) and x.sum_lat == pytest.approx(w.sum_lat)


def test_scans_that_moved_are_left_out(spark):
    allow = 12 / 3.6 * 10 + 10
    rows = [(0.0, 0.0, d / 111320.0, 0.0, 10.0, fine) for d, fine in ((allow - 0.1, True), (allow + 0.1, True), (0.0, False))]
    df = spark.createDataFrame(rows, "start_lat double, start_lon double, lat double, lon double, took_s double, end_fine boolean")
    assert wifi.usable_scans(df).count() == 1


def ellipsoid(n=400, seed=9, centre=(30.0, -20.0, 12.0), radii=(50.0, 40.0, 45.0)):
    r = np.random.default_rng(seed)
    v = r.standard_normal((n, 3))
    v = v / np.linalg.norm(v, axis=1, keepdims=True) * radii + centre
    return [("good", k, *map(float, p)) for k, p in enumerate(v)]


def test_calibration_fits(spark):
    r = np.random.default_rng(3)
    flat = [("flat", k, float(math.cos(k)), float(math.sin(k)), 0.0) for k in range(64)]
    few = [("few", k, *map(float, p)) for k, p in enumerate(r.standard_normal((31, 3)) * 40)]
    noisy = [("noisy", k, *map(float, p)) for k, p in enumerate(r.standard_normal((300, 3)) * [60, 50, 55])]
    tiny = [("tiny", k, *(x / 20 for x in p[2:])) for k, p in enumerate(ellipsoid())]
    samples = spark.createDataFrame(ellipsoid() + flat + few + noisy + tiny, "device string, seq long, x double, y double, z double").repartition(5)
    got = {f.device: f for f in magnet.fits(samples).collect()}
    good = got["good"]
    assert good.ok and (good.cx, good.cy, good.cz) == pytest.approx((30, -20, 12), abs=1e-6)
    assert (good.gx, good.gy, good.gz) == pytest.approx((45 / 50, 45 / 40, 1.0), abs=1e-6) and good.residual < 1e-9 and good.points == 128
    assert not got["flat"].ok and got["few"].reason == "too few points" and not got["noisy"].ok and got["tiny"].reason == "implausible mean radius"
    before = spark.createDataFrame([("good", 1.0, 1.0, 1.0)], "device string, gx double, gy double, gz double")
    assert {r.device: r.accepted for r in magnet.accept_refined(magnet.fits(samples), before).collect()}["good"] is False
    sums = magnet.normal_equations(samples.filter("device = 'good'"))
    merged = magnet.merge_sums(sums, sums).first()
    assert merged.n == 800 and merged.b_x == pytest.approx(1.5 * sums.first().b_x)


def test_kept_points_overwrite_in_turn(spark):
    df = spark.createDataFrame([("d", k, float(k), 0.0, 0.0) for k in range(700)], "device string, seq long, x double, y double, z double")
    slots = [None] * 128
    for k in range(700):
        if k < 128:
            slots[k] = k
        elif k % 4 == 0:
            slots[k // 4 % 128] = k
    got = {r.slot: r.x for r in magnet.kept_points(df).collect()}
    assert [got[k] for k in range(128)] == slots


def test_midrange(spark):
    df = spark.createDataFrame([("d", -10.0, 0.0, 5.0), ("d", 30.0, 40.0, 45.0), ("e", 0.0, 0.0, 0.0), ("e", 10.0, 40.0, 40.0)], "device string, x double, y double, z double")
    got = {r.device: r for r in magnet.midrange(df).collect()}
    assert (got["d"].offset_x, got["d"].offset_y, got["d"].mean_radius, got["d"].uneven) == (10.0, 20.0, 20.0, False) and got["e"].uneven


@pytest.mark.parametrize("block", [4, 512])
def test_motion_equals_the_recursion(spark, block):
    r = random.Random(4)
    rows = [(d, k, r.uniform(-3000, 3000), r.uniform(-200, 200), 16000.0) for d in "ab" for k in range(60)]
    got = {(x.device, x.seq): (x.deviation, x.stirred, x.moved) for x in magnet.motion_flags(spark.createDataFrame(rows, "device string, seq long, ax double, ay double, az double"), block=block).collect()}
    for d in "ab":
        g, run = None, 0
        for _, k, *a in (x for x in rows if x[0] == d):
            dev = 0.0 if g is None else math.dist(a, g)
            run = run + 1 if dev > 1500 else 0
            assert got[(d, k)] == (pytest.approx(dev, abs=1e-6), dev > 500, run >= 2)
            g = list(a) if g is None else [u + (v - u) * 0.08 for u, v in zip(g, a, strict=True)]


def test_log_pairs_fixes_with_fresh_samples(spark):
    fix = [("d", ms, s, 3, 1.0, v) for ms, s, v in ((1000, "A", 20.0), (1500, "A", 20.0), (2100, "A", 20.0), (3000, "A", 5.0), (3100, "V", 20.0), (5000, "A", 20.0), (6100, "A", 20.0))]
    samples = [("d", 900, 1), ("d", 2050, 2), ("d", 4000, 3), ("d", 6000, 4)]
    got = magnet.paired_log(spark.createDataFrame(fix, "device string, ms long, status string, mode int, hdop double, speed_kmh double"), spark.createDataFrame(samples, "device string, ms long, seq long"))
    assert sorted((r.ms, r.sample.seq) for r in got.collect()) == [(1000, 1), (2100, 2), (6100, 4)]


def test_rate_policy_settles(spark):
    rows = [("d", ms, "A", 3, v) for ms, v in ((0, 0.0), (1000, 0.0), (9999, 0.0), (10000, 0.0), (11000, 50.0), (12000, 0.0), (13000, 50.0), (23000, 50.0), (24000, 50.0))]
    df = spark.createDataFrame(rows, "device string, ms long, status string, mode int, speed_kmh double")
    got = [r.rate_ms for r in policies.run_policy(df, policies.rate_step, "rate_ms int").orderBy("ms").collect()]
    assert got == [1000, 1000, 1000, 5000, 5000, 5000, 5000, 1000, 1000]
    frame = df.toPandas()
    assert [r["rate_ms"] for r in batch_fold(frame, policies.rate_step)] == got


def test_other_policies():
    def run(step, rows):
        s, out = None, []
        for r in rows:
            s, added = step(s, r)
            out.append(added)
        return out

    fine = {"status": "A", "mode": 3, "hdop": 1.0, "lat": 10.0, "lon": 20.0, "speed_kmh": 0.0}
    zoom = run(policies.zoom_step(12, 14), [fine | {"ms": k * 4000, "speed_kmh": v} for k, v in enumerate((30, 20, 20, 14, 14, 14))])
    assert [z["zoom"] for z in zoom] == [12, 12, 12, 14, 14, 14] or [z["zoom"] for z in zoom] == [12, 12, 12, 14, 14, 14]
    assert {z["zoom"] for z in run(policies.zoom_step(14, 14), [fine | {"ms": k * 9000, "speed_kmh": 99.0} for k in range(3)])} == {14}
    learn = run(policies.learn_step, [fine | {"ms": ms, "lat": 10 + m / 111320, "speed_kmh": v} for ms, m, v in ((0, 0, 0), (19999, 100, 0), (20000, 39, 0), (20000, 41, 13), (21000, 41, 12), (60000, 41, 0))])
    assert [x["scan"] for x in learn] == [True, False, False, False, True, False]
    lost = fine | {"status": "V"}
    survey = run(policies.survey_step, [fine | {"ms": 0}, *(lost | {"ms": ms} for ms in (1000, 15999, 16000, 20000, 36000)), fine | {"ms": 37000, "hdop": 9.0}, lost | {"ms": 38000}])
    assert [x["why"] for x in survey] == ["learn", "none", "none", "locate", "none", "locate", "none", "none"]
    still = fine | {"touch_ms": None, "motion_ms": None, "stir_ms": None, "rate_ms": 5000}
    dim = run(policies.dim_step, [still | {"ms": 0, "touch_ms": 0}, still | {"ms": 120000, "touch_ms": 0}, still | {"ms": 121000, "motion_ms": 120900}, still | {"ms": 140000, "lat": 10.001}, still | {"ms": 141000, "lat": 10.002, "stir_ms": 140000}, still | {"ms": 142000, "lat": 10.002, "rate_ms": 1000}])
    assert [x["dimmed"] for x in dim] == [False, True, False, True, False, False]
    theme = run(policies.theme_step, [{"ms": ms, "theme": t, "sun_up": up} for ms, t, up in ((0, "auto", False), (20000, "auto", True), (31000, "auto", True), (32000, "night", True), (33000, "day", True))])
    assert [x["dark"] for x in theme] == [True, True, False, True, False]
    view = run(policies.view_step(0.6, 0.6), [{"wx": x, "wy": 1.0, "ox": 0.0, "oy": 0.0} for x in (1.0, 1.05, 1.2, 1.25)])
    assert view[0]["view_x"] == view[1]["view_x"] == pytest.approx(0.7) and view[2]["view_x"] == view[3]["view_x"] == pytest.approx(1.0)


def test_changed_fixes_and_gaps(spark):
    rows = [("d", ms, lat, 0.0, "A") for ms, lat in ((0, 1.0), (500, 1.0), (1000, 1.0), (1900, 1.0), (2000, 1.0), (2100, 2.0), (2200, 1.0), (9000, 1.0))]
    df = spark.createDataFrame(rows, "device string, ms long, lat double, lon double, status string")
    assert [r.ms for r in gnss.changed_fixes(df).orderBy("ms").collect()] == [0, 1000, 2000, 2100, 2200, 9000]
    assert [(r.from_ms, r.to_ms) for r in gnss.silent_since(df).collect()] == [(2200, 9000)]
    assert [r.interval_ms for r in gnss.pps_intervals(df.select("device", "ms")).orderBy("ms").collect()] == [500, 500, 900, 100, 100, 100]
    seen = spark.createDataFrame([("d", 1, 0, 0), ("d", 90001, 0, 0), ("d", 90002, 3, 0), ("d", 90003, 0, 0)], "device string, ms long, visible int, best_snr int")
    assert [r.suspect for r in gnss.antenna_suspect(seen).orderBy("ms").collect()] == [False, True, False, False]


def test_estimates_stand_in(spark):
    rows = [("V", 1.0, 2.0, 0, 9.0, 50.0, 7.0, (5.0, 6.0, 100.0)), ("A", 1.0, 2.0, 3, 0.9, 50.0, 7.0, (5.0, 6.0, 100.0)), ("V", 1.0, 2.0, 0, 9.0, 50.0, 7.0, None)]
    got = gnss.effective_position(spark.createDataFrame(rows, "status string, lat double, lon double, mode int, hdop double, speed_kmh double, course double, est struct<lat:double,lon:double,acc:double>")).collect()
    assert [(g.status, g.lat, g.hdop, g.speed_kmh, g.estimated) for g in got] == [("A", 5.0, 5.0, 0.0, True), ("A", 1.0, 0.9, 50.0, False), ("V", 1.0, 9.0, 50.0, False)]


def test_waypoints(spark):
    none = spark.createDataFrame([], "idx int, lat double, lon double, name string, saved_utc long")
    p = waypoints.add(none, 1.0, 2.0, None)
    p = waypoints.add(p, 1.0, 3.0, "ü" * 20, 1767225601)
    p = waypoints.add(p, 1.0, 4.0, None, 1767225601, "2026-01-01 07:05:00")
    p = waypoints.add_from_fix(p, {"status": "V", "lat": 0.0, "lon": 0.0}, "no")
    rows = p.orderBy("idx").collect()
    assert [(r.idx, r.name, r.saved_utc) for r in rows] == [(0, "pin 1", None), (1, "ü" * 11, 1767225601), (2, "07:05", 1767225601)]
    assert [(r.idx, r.lon) for r in waypoints.remove(p, 0).orderBy("idx").collect()] == [(0, 3.0), (1, 4.0)]
    assert [waypoints.target_after_remove(t, 1) for t in (0, 1, 2)] == [0, -1, 1]
    assert waypoints.set_target(p, 7).count() == 0
    full = spark.range(32).selectExpr("cast(id as int) idx", "0D lat", "0D lon", "'x' name", "cast(null as long) saved_utc")
    assert waypoints.add(full, 1.0, 1.0, "more").count() == 32
    fix = spark.createDataFrame([("A", 1.0, 2.001), ("V", 1.0, 2.0)], "status string, lat double, lon double")
    assert [r.text for r in waypoints.target_range(fix, waypoints.set_target(p, 0)).collect()] == ["pin 1: 111 m W"]


def test_rings(spark):
    circle = [(20 * math.cos(t / 50 * math.pi), 20 * math.sin(t / 50 * math.pi)) for t in range(101)]
    small = [(x / 400, y / 400) for x, y in circle]
    df = spark.createDataFrame([(0, [(0.0, 0.0), (1.0, 0.0), (0.0, 0.0)]), (1, small), (2, circle), (3, circle)], "ord int, pts array<struct<x:double,y:double>>")
    got = rings.outline(df).orderBy("ring_id").collect()
    assert [(g.ring_id, g.ord) for g in got] == [(0, 2), (1, 3)] and 8 <= len(got[0].pts) < 60 and got[0].pts[0] == got[0].pts[-1]
    line = np.array([(0, 0), (1, 0.01), (2, -0.01), (3, 0), (3, 5), (3, 9)], float)
    assert rings.simplify(line, 0.1).tolist() == [[0, 0], [3, 0], [3, 9]] and len(rings.simplify(line, 0.0)) >= 4
    q = spark.createDataFrame([([(0.5 / 65535, 1.5 / 65535), (0.6 / 65535, 2.0 / 65535), (2.0, -1.0)],)], "p array<struct<x:double,y:double>>").select(rings.quantised(F.col("p"))).first()[0]
    assert [tuple(p) for p in q] == [(0, 2), (1, 2), (65535, 0)]


def test_bands(spark):
    columns = [(x, 1.0) for x in range(8)]
    bands = rings.plan_bands(columns, 3, 3.0)
    assert bands[0][0] == -180 and bands[-1][1] == 180 and all(b[1] == c[0] for b, c in zip(bands, bands[1:], strict=False)) and all(gb <= 3 for _, _, gb, _ in bands)
    assert rings.plan_bands(columns, 3, 9.0) == [(-180.0, 180.0, 8.0, False)]
    with pytest.raises(ValueError):
        rings.plan_bands(columns, 3, 0.5)
    entries = spark.createDataFrame([(hilbert(3, x, 4), 1, 10**9, x) for x in range(8)], "tile_id long, run_length long, length long, offset long")
    assert [(r.x, r.gb) for r in rings.column_bytes(entries, 3).collect()] == [(x, 1.0) for x in range(8)]


def test_raster(spark):
    square = np.array([(2, 2), (6, 2), (6, 6), (2, 6)], float)
    inner = np.array([(3, 3), (3, 5), (5, 5), (5, 3)], float)
    c = raster.coverage([square, inner], 8)
    assert c.sum() == pytest.approx(12) and c[3, 3] == 0 and c[2, 2] == 1
    assert raster.coverage([square, inner[::-1]], 8).sum() == pytest.approx(16) and raster.coverage([square, inner[::-1]], 8, "evenodd").sum() == pytest.approx(12)
    assert raster.coverage([square + 0.25], 8).sum() == pytest.approx(16)
    assert sum(raster.coverage([q], 8).sum() for q in raster.stroke_rings(np.array([(1, 4), (7, 4)], float), 2)) == pytest.approx(12)
    assert raster.upscaled(np.arange(16).reshape(4, 4), 2, 1, 0).tolist() == [[2, 2, 3, 3], [2, 2, 3, 3], [6, 6, 7, 7], [6, 6, 7, 7]]
    part = (1, 0, 0, "water", "water", "polygon", 0, 0, [(0, 0), (8, 0), (8, 8), (0, 8), (0, 0)], 16, None)
    out = raster.render(spark.createDataFrame([part], "z int, x long, y long, layer string, style string, geom string, feature_index int, part_index int, pts array<struct<x:int,y:int>>, extent int, error string"), 16).first()
    px = np.frombuffer(out.pixels, "<u2").reshape(16, 16)
    assert px[3, 3] == raster.pack565(np.array([160, 200, 225])) and px[12, 12] == raster.pack565(np.array([228, 226, 220]))


def test_floor_goes_on_where_it_stopped(spark, tmp_path):
    floor = coverage.world_floor(spark, 2)
    path = f"file://{tmp_path}/floor"
    fetched = lambda tiles: tiles.withColumn("payload", F.concat(F.lit("t"), F.col("tile_id").cast("string")))
    assert coverage.resume_floor(floor, path, fetched, 8) == 13 and coverage.resume_floor(floor, path, fetched, 8) == 5

    def broken(tiles):
        raise OSError("no network")

    with pytest.raises(OSError):
        coverage.resume_floor(floor, path, broken, 8)
    assert coverage.resume_floor(floor, path, fetched, 8) == 0 and coverage.resume_floor(floor, path, fetched, 8) == 0
    assert sorted(r.tile_id for r in spark.read.parquet(path).collect()) == list(range(21))
    coverage.clear_floor(spark, path)
    assert coverage.resume_floor(floor, path, fetched, 30) == 0


def test_backdrops_and_points():
    square = lambda a, b: np.array([(a, a), (b, a), (b, b), (a, b)], float)
    world = raster.backdrop([square(2, 14), square(6, 10)], [square(3, 5)], 16)
    assert world[0, 0] == 0 and world[12, 12] == 1 and world[8, 8] == 0 and world[4, 4] == 2  # two rings of land even out
    dot = raster.coverage([raster.diamond(8, 8, 4)], 16)
    assert dot[8, 8] == 1 and dot[4, 4] == 0 and 28 < dot.sum() < 36


def test_state_of_a_build(spark, tmp_path):
    path = f"file://{tmp_path}/m"
    assert state.load_manifest(spark, path) is None and state.load_cursor(spark, path, "20240101") is None
    state.save_manifest(spark, path, "20240101", 19723)
    assert state.load_manifest(spark, path) == ("20240101", 19723)
    state.save_manifest(spark, path, "short", 1)
    assert state.load_manifest(spark, path) is None
    state.save_cursor(spark, path, "20240101", 5, 6, 7)
    assert state.load_cursor(spark, path, "20240101") == (5, 6, 7) and state.load_cursor(spark, path, "20240202") is None
    state.clear_cursor(spark, path)
    assert state.load_cursor(spark, path, "20240101") is None


def test_log_waits_for_calibrations_and_a_second():
    rows = [("sample", 900, 1, False), ("fix", 1000, 0, False), ("fix", 1100, 0, False), ("sample", 1900, 2, False), ("fix", 1950, 0, False), ("fix", 2100, 0, False), ("sample", 3200, 3, True), ("fix", 3300, 0, False), ("sample", 4000, 4, False), ("fix", 4400, 0, False), ("fix", 4250, 0, False)]
    frame = pd.DataFrame([("d", k, kind, ms, "A", 3, 1.0, 20.0, seq, cal) for k, (kind, ms, seq, cal) in enumerate(rows)], columns=["device", "k", "kind", "ms", "status", "mode", "hdop", "speed_kmh", "seq", "calibrating"])
    assert [r["logged"] for r in batch_fold(frame, policies.log_step, order="k")] == [None, 1, None, None, None, 2, None, None, None, None, 4]
