import gzip
import json
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from geostride.functions.scalars import gzip_isize
from geostride.operators import archive as A
from geostride.sources import bytes as B
from geostride.sources import mvt, pmtiles, tables

from . import fixtures as fx


def test_varints():
    for v in (0, 1, 127, 128, 300, (1 << 63) - 1, (1 << 64) - 1):
        assert B.varint(fx.varint(v), 0, 99 if v < 0 else len(fx.varint(v))) == (v, len(fx.varint(v)))
    for bad in (b"", b"\x80", b"\xff" * 11):
        with pytest.raises(B.FormatError):
            B.varint(bad, 0, len(bad))


def test_inflate_tells_the_formats_apart():
    raw = b"abc" * 999
    d = zlib.compressobj(9, zlib.DEFLATED, -15)
    deflated = d.compress(raw) + d.flush()
    for packed in (gzip.compress(raw), zlib.compress(raw), deflated):
        assert B.inflate(packed) == B.inflate(packed, verify=False) == raw
    damaged = bytearray(gzip.compress(raw))
    damaged[-8] ^= 1
    with pytest.raises(B.FormatError):
        B.inflate(bytes(damaged))
    assert B.inflate(bytes(damaged), verify=False) == raw
    damaged[-1] ^= 1
    with pytest.raises(B.FormatError):
        B.inflate(bytes(damaged), verify=False)
    for bad in (gzip.compress(raw)[:-9], b"\x1f\x8b\x08", b"\xff\xff\xff", zlib.compress(raw)[:9]):
        with pytest.raises(B.FormatError):
            B.inflate(bad)
    with pytest.raises(B.FormatError):
        B.inflate(gzip.compress(raw), most=10)


def test_isize(spark):
    df = spark.createDataFrame([(gzip.compress(b"x" * 1234),), (b"plain bytes without a frame",)], "d binary")
    assert [r[0] for r in df.select(gzip_isize(F.col("d"))).collect()] == [1234, 0]


def test_archive_by_hand(tmp_path):
    """An archive written byte by byte: two entries, the second contiguous with the first, no compression."""
    root = bytes([2, 5, 7, 1, 3, 4, 6, 1, 0])  # two; ids 5, 12; runs 1, 3; lengths 4, 6; offsets 0+1, follows
    head = b"PMTiles\x03" + struct.pack("<11Q", 127, len(root), 0, 0, 0, 0, 136, 10, 4, 2, 2) + bytes([1, 1, 1, 1, 0, 3]) + struct.pack("<4i", -10, -20, 30, 40) + bytes([2]) + struct.pack("<2i", 5, 6)
    path = tmp_path / "a.pmtiles"
    path.write_bytes(head + root + b"aaaabbbbbb")
    a = pmtiles.Archive(str(path))
    assert [(e.tile_id, e.run, e.length, e.offset) for e in a.root()] == [(5, 1, 4, 0), (12, 3, 6, 4)]
    assert (a.head["min_lon_e7"], a.head["max_lat_e7"], a.head["center_zoom"], a.head["center_lat_e7"]) == (-10, 40, 2, 6)


@pytest.mark.parametrize(("leaf", "codec"), [(None, 1), (None, 2), (7, 2), (1, 1)])
def test_archive_round_trip(spark, tmp_path, leaf, codec):
    pmtiles.register(spark)
    tiles = {(k * 5, 1 + k % 4): gzip.compress(f"tile {k % 11}".encode(), mtime=0) for k in range(60)}
    fx.archive(tmp_path / "m.pmtiles", tiles, leaf, codec)
    read = lambda **o: spark.read.format("pmtiles").options(path=f"{tmp_path}/*.pmtiles", partitions="3", **o).load()
    head = read(what="header").collect()
    assert len(head) == 1 and head[0].error is None and head[0].n_entries == 60 and head[0].max_zoom == 14
    entries = read(what="entries")
    assert sorted((e.tile_id, e.run_length) for e in entries.collect()) == sorted(tiles)
    stored = read(what="blobs").collect()
    blobs = {(b.offset, b.length): bytes(b.payload) for b in stored}
    assert len(stored) == len(blobs) == 11
    assert sorted(map(tuple, pmtiles.read_blobs(entries).collect())) == sorted(map(tuple, stored))
    asked = spark.range(310).select(F.col("id").alias("tile_id"))
    found = {r.tile_id: blobs[(r.offset, r.length)] for r in A.locate_entries(asked, entries, bucket=8).collect()}
    want = {t: v for (first, run), v in tiles.items() for t in range(first, first + run)}
    assert found == want and set(blobs.values()) == set(tiles.values())
    some = read(what="entries", minzoom="2", maxzoom="2").collect()
    assert {e.tile_id for e in some} == {t for t, run in tiles if t < 21 and t + run > 5}


def test_runs_over_many_buckets(spark):
    entries = spark.createDataFrame([(10, 5000, 1, 0), (5010, 3, 1, 1), (9000, 0, 1, 2)], "tile_id long, run_length long, length long, offset long")
    asked = spark.createDataFrame([(9,), (10,), (2500,), (5009,), (5010,), (5013,), (9000,)], "tile_id long")
    got = {r.tile_id: r.entry_id for r in A.locate_entries(asked, entries, bucket=16).collect()}
    assert got == {10: 10, 2500: 10, 5009: 10, 5010: 5010}


def test_damaged_archives(spark, tmp_path):
    pmtiles.register(spark)
    fx.archive(tmp_path / "v2.pmtiles", {(0, 1): b"x"}, version=2)
    fx.archive(tmp_path / "good.pmtiles", {(0, 1): b"x"})
    whole = (tmp_path / "good.pmtiles").read_bytes()
    (tmp_path / "cut.pmtiles").write_bytes(whole[:-1])
    (tmp_path / "magic.pmtiles").write_bytes(b"Q" + whole[1:])
    (tmp_path / "short.pmtiles").write_bytes(whole[:50])
    (tmp_path / "rootless.pmtiles").write_bytes(whole[:16] + bytes(8) + whole[24:])
    errors = {r.path.rpartition("/")[2]: r.error for r in spark.read.format("pmtiles").options(path=f"{tmp_path}/*.pmtiles", what="header").load().collect()}
    assert errors.pop("good.pmtiles") is None and len(errors) == 5 and all(errors.values())
    entries = spark.read.format("pmtiles").options(path=f"{tmp_path}/*.pmtiles", what="entries", skip_damaged="true").load().collect()
    assert [(e.path.rpartition("/")[2], e.tile_id) for e in entries] == [("good.pmtiles", 0)]
    with pytest.raises(B.FormatError):
        pmtiles.parse_directory(b"\xff\xff\xff\x7f\x01")
    with pytest.raises(B.FormatError):
        pmtiles.parse_directory(fx.directory([(1, 1, 1, 1)])[:-1])


RING = [(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)]
HOLE = [(2, 2), (2, 8), (8, 8), (8, 2), (2, 2)]


def test_tile_round_trip(spark):
    layers = [
        ("water", 4096, [(1, "polygon", {"kind": "lake"}, [RING, HOLE])]), ("roads", 512, [(2, "line", {"kind": "path", "name": "é"}, [[(0, 0), (5, -5)], [(7, 7), (9, 9), (1, 1)]]), (3, "line", {"kind": 7}, [[(1, 1), (2, 2)]])]),
        ("places", 4096, [(4, "point", {"name": "Town", "kind": "locality"}, [[(100, 200), (-3, 5000)]]), (5, "none", {}, [[(1, 1)]])]),
    ]
    rows = list(mvt.decode_tile(fx.tile(layers)))
    parts = [(r[0], r[4], r[6], r[7], r[8], r[9], r[10]) for r in rows]
    assert parts == [
        ("water", 0, "polygon", 0, "lake", None, RING), ("water", 0, "polygon", 1, "lake", None, HOLE), ("roads", 0, "line", 0, "path", "é", [(0, 0), (5, -5)]), ("roads", 0, "line", 1, "path", "é", [(7, 7), (9, 9), (1, 1)]),
        ("roads", 1, "line", 0, None, None, [(1, 1), (2, 2)]), ("places", 0, "point", 0, "locality", "Town", [(100, 200), (-3, 5000)]),
    ]
    assert [(r[11], r[12]) for r in rows[:2]] == [(200, True), (-72, False)] and rows[2][2] == 512
    packed = gzip.compress(fx.tile(layers))
    df = spark.createDataFrame([(6, 1, 2, packed), (6, 1, 3, b"junk"), (6, 1, 4, None)], "z int, x long, y long, payload binary")
    got = mvt.decode_tiles(df).collect()
    assert len(got) == 8 and [r.error for r in got if r.y > 2] == ["no gzip frame"] * 2
    only = mvt.decode_tiles(df.filter("y = 2"), layers=["places"]).collect()
    assert [(r.layer, r.name, len(r.pts)) for r in only] == [("places", "Town", 2)]
    mvt.register(spark)
    df.filter("y = 2").createOrReplaceTempView("tiles_of_test")
    assert spark.sql("select count(*) from tiles_of_test, lateral decode_mvt(payload)").first()[0] == 6


def test_damaged_tiles_keep_what_came_before():
    good = ("water", 4096, [(1, "polygon", {}, [RING])])
    for broken in (fx.varint(2 << 3 | 2), fx.varint(1 << 3 | 7), fx.varint(1 << 3 | 3), fx.varint(1 << 3 | 1) + b"\x02"):
        rows = list(mvt.decode_tile(fx.tile([good, ("roads", 4096, [(2, "line", {}, broken)])])))
        assert rows[0][10] == RING and rows[-1][-1] and len(rows) == 2
    assert list(mvt.decode_tile(fx.tile([("roads", 0, [])])))[0][-1] == "extent 0"
    damaged = fx.tile([good]) + fx.message((3, fx.message((1, b"roads")) + b"\x12\x7f"))
    assert [r[-1] for r in mvt.decode_tile(damaged, frozenset(["water"]))] == [None]
    assert list(mvt.decode_tile(damaged))[-1][-1]


def test_frames_of_a_binary_stream():
    body = b"\x01\x07" + struct.pack("<H", 3) + b"xyz"
    a = k = 0
    for b in body:
        a = (a + b) & 255
        k = (k + a) & 255
    stream = b"noise\xb5\x62" + body + bytes((a, k)) + b"\xb5\x62" + body + b"\0\0" + b"\xb5\x62\x01\x07\xff\xff"
    assert list(mvt.split_ubx(stream)) == [(1, 7, b"xyz", True), (1, 7, b"xyz", False)]


def test_access_point_database(spark, tmp_path):
    text = f"{tables.AP_HEADER}\r\naa:bb:cc:00:01:02,4,42.5,-83.25,42.4,42.6,-83.3,-83.2,-40,0\nbad row\naa:bb:cc:00:01:03,0,1,1,1,1,1,1,-40,0\n\n"
    (tmp_path / "good.csv").write_text(text)
    (tmp_path / "other.csv").write_text("x" + text)
    rows = tables.read_ap_database(spark, str(tmp_path / "good.csv")).collect()
    assert [r.bad for r in rows] == [False, True, True] and rows[0].sum_lat == 170.0 and rows[0].id == 0xAABBCC000102 and rows[0].mobile == 0
    assert tables.read_ap_database(spark, str(tmp_path / "other.csv")).count() == 0
    good = spark.createDataFrame([(0xAABBCC000102, 4, 170.0, -333.0, 42.4, 42.6, -83.3, -83.2, -40, False)], "id long, n long, sum_lat double, sum_lon double, min_lat float, max_lat float, min_lon float, max_lon float, best_rssi int, mobile boolean")
    tables.replace_ap_database(good, str(tmp_path / "good.csv"))
    again = tables.read_ap_database(spark, str(tmp_path / "good.csv")).collect()
    assert [(r.id, r.obs, r.lat, r.mobile, r.bad) for r in again] == [(0xAABBCC000102, 4, 42.5, 0, False)]


def test_waypoint_files(spark, tmp_path):
    points = [(1.5, 2.5, "home", 1767225601), (-3.0, 4.0, "a name that is longer than it may be", None)]
    raw = tables.pack_waypoints(points)
    (tmp_path / "w.bin").write_bytes(raw)
    (tmp_path / "cut.bin").write_bytes(raw[:-1])
    (tmp_path / "bad.bin").write_bytes(b"\0" + raw[1:])
    read = lambda n: [tuple(r)[1:] for r in tables.read_waypoints(spark, f"{tmp_path}/{n}").collect()]
    assert read("w.bin") == [(0, 1.5, 2.5, "home", 1767225601), (1, -3.0, 4.0, "a name that is longer th"[:23], None)]
    assert len(read("cut.bin")) == 1 and read("bad.bin") == []
    (tmp_path / "fix.bin").write_bytes(b"LFX1" + struct.pack("<ffq", 1.5, 2.5, 99))
    assert [tuple(r)[1:] for r in tables.read_last_fix(spark, f"{tmp_path}/fix.bin").collect()] == [(1.5, 2.5, 99)]


def test_geojson(spark, tmp_path):
    square = [[0, 0], [9, 0], [9, 9], [0, 9], [0, 0]]
    doc = {"type": "FeatureCollection", "features": [{"geometry": {"type": "Polygon", "coordinates": [square, square]}}, {"geometry": None}, {"geometry": {"type": "MultiPolygon", "coordinates": [[square], [square]]}}]}
    (tmp_path / "r.geojson").write_text(json.dumps(doc))
    rows = tables.read_geojson_rings(spark, f"{tmp_path}/r.geojson").collect()
    assert sorted((r.feature, r.polygon, r.ring) for r in rows) == [(0, 0, 0), (0, 0, 1), (2, 0, 0), (2, 1, 0)] and rows[0].pts[1].x == 9.0


def test_magnetometer_log_round_trip(spark, tmp_path):
    columns = tables.MAG_HEADER.split(",")
    row = [1000, "120000", "010124", 42.12345678, -83.0, 12.345, 90.0, 0.9, 9, 3, 91.237, 48.0, 1.0, 2.0, 1.04, 2.0, 3.0, 4.0, 5.0, 6.0, 100.4, -200.0, 16000.0, 1]
    df = spark.createDataFrame([tuple(row)], tables.MAG_SCHEMA)
    lines = tables.mag_lines(df)
    assert lines.columns == columns and lines.first()[3:6] == ("42.1234568", "-83.0000000", "12.35") and lines.first().acc_x == "100"
    lines.coalesce(1).write.option("header", "true").csv(f"{tmp_path}/log")
    back = tables.read_mag_log(spark, f"{tmp_path}/log").first()
    assert back.ms == 1000 and back.lat == 42.1234568 and back.calibrated == 1
    many = lines.withColumn("device", F.lit("d")).crossJoin(spark.range(10))
    kept = tables.within_bytes(many, "id", most=300)
    assert kept.count() == 3
