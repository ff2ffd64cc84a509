import json
import os
import random
import time

import pytest

from geostride.operators import policies
from geostride.streaming.fold import batch_fold, stream_fold
from geostride.streaming.steps import FIX, TRUST, fix_step, sentence_trust_step, trust_step

from . import fixtures as fx
from .test_operators import LINES, WALK, walk


def run_stream(spark, tmp_path, rows, schema, step, adds, order, parts=3):
    """Rows in a few files, one a micro-batch, through the stream; and what the fold gives."""
    names = [c.split()[0] for c in schema.split(", ")]
    source = tmp_path / "in"
    source.mkdir()
    size = -(-len(rows) // parts)
    for k in range(parts):
        text = "\n".join(json.dumps(dict(zip(names, r, strict=True))) for r in rows[k * size : (k + 1) * size])
        (source / f"{k}.json").write_text(text)
        os.utime(source / f"{k}.json", (1_700_000_000 + 60 * k,) * 2)  # files are taken in the order of their times
    read = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source))
    query = stream_fold(read, step, adds, order=order).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r.device, r[order]): tuple(r[c.split()[0]] for c in adds.split(", ")) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    frame = spark.createDataFrame(rows, schema).toPandas()
    want = {(r["device"], r[order]): tuple(r[c.split()[0]] for c in adds.split(", ")) for r in batch_fold(frame, step, order=order)}
    return got, want


def test_sentences(spark, tmp_path):
    rows = [(d, k, fx.sentence(b)) for d in ("a", "b") for k, b in enumerate(LINES * 3)]
    rows.sort(key=lambda r: r[1])
    got, want = run_stream(spark, tmp_path, rows, "device string, seq long, line string", fix_step, FIX, "seq")
    assert got == want and len(got) == len(rows)


def test_trust(spark, tmp_path):
    schema = ", ".join(WALK.split(", ")[:8])
    rows = [r[:8] for r in walk(120)]
    got, want = run_stream(spark, tmp_path, rows, schema, trust_step, "flags int, level string, text string", "ts")
    assert got == want


@pytest.mark.parametrize("step", ["rate", "survey"])
def test_policies(spark, tmp_path, step):
    r = random.Random(3)
    rows = [("d", k * 3000, "V" if 50 < k < 65 or r.random() < 0.05 else "A", 3, 1.0, (0.0, 5.0, 50.0)[k // 15 % 3], 10 + k * 0.0004, 20.0) for k in range(90)]
    schema = "device string, ms long, status string, mode int, hdop double, speed_kmh double, lat double, lon double"
    function, adds = {"rate": (policies.rate_step, "rate_ms int"), "survey": (policies.survey_step, "why string")}[step]
    got, want = run_stream(spark, tmp_path, rows, schema, function, adds, "ms")
    assert got == want and len({v for v in got.values()}) > 1


def test_sentences_to_trust(spark, tmp_path):
    """One stream from sentences to trust: bunched signals of two constellations are an odd thing."""
    bodies = ["GPGSV,1,1,08,01,40,083,30,02,17,308,31", "GLGSV,1,1,08,65,40,083,30,66,17,308,32", "GPRMC,120000.00,A,1200.0000,N,02000.0000,E,1.0,2.0,010124,,,A", "GPRMC,120001.00,A,1200.0100,N,02000.0000,E,1.0,2.0,010124,,,A", "GPRMC,120002.00,V,,,,,,,010124,,,N"]
    rows = [("d", float(k), fx.sentence(b)) for k, b in enumerate(bodies * 3)]
    got, want = run_stream(spark, tmp_path, rows, "device string, ts double, line string", sentence_trust_step, f"{FIX}, {TRUST}", "ts")
    assert got == want and got[("d", 2.0)][-3:] == (8, "ODD", "sat SNR") and got[("d", 1.0)][-2] == "UNKNOWN"


SCANS = "device string, ms long, status string, mode int, hdop double, speed_kmh double, lat double, lon double, scan_done boolean, est_lat double, est_lon double, est_acc double"


def scans():
    fine, lost = ("A", 3, 1.0, 5.0), ("V", 1, 99.0, 0.0)
    steps = [(0, fine, 1.0, False, None), (3000, fine, 1.00005, True, None), (25_000, fine, 1.01, False, None), (45_000, fine, 1.01, False, None), (50_000, fine, 1.02, False, None), (52_000, fine, 1.5, True, None)]
    steps += [(60_000, lost, 1.5, False, None), (76_000, lost, 1.5, False, None), (78_000, lost, 1.5, True, 7.0), (100_000, lost, 1.5, False, None), (102_000, lost, 1.5, True, None), (139_000, lost, 1.5, False, None), (139_001, fine, 1.5, False, None)]
    return [("d", ms, *fix, lat, 2.0, done, est, est and 8.0, est and 50.0) for ms, fix, lat, done, est in steps]


def test_scans_begin_and_end(spark, tmp_path):
    got, want = run_stream(spark, tmp_path, scans(), SCANS, policies.scan_step, policies.SCAN, "ms")
    assert got == want
    assert [v[0] for _, v in sorted(got.items())] == ["learn", "learned", "learn", "abandoned", "learn", "discarded", "none", "locate", "located", "locate", "nothing", "locate", "none"]
    assert got[("d", 100_000)][1:] == (7.0, 8.0, 22_000) and got[("d", 139_000)][1] is None


def test_silence_ends_a_scan_and_a_place(spark, tmp_path):
    """A timer, not a row, tells that a device has gone silent."""
    source = tmp_path / "in"
    source.mkdir()
    names = [c.split()[0] for c in SCANS.split(", ")]
    (source / "0.json").write_text("\n".join(json.dumps(dict(zip(names, r, strict=True))) for r in scans()[:9]))
    read = spark.readStream.schema(SCANS).json(str(source))
    rows = stream_fold(read, policies.scan_step, policies.SCAN, silent_ms=500, on_silence=policies.scan_silence)
    query = rows.writeStream.format("memory").queryName("silence").option("checkpointLocation", f"{tmp_path}/cp").trigger(processingTime="300 milliseconds").start()
    try:
        end = time.time() + 60
        while time.time() < end and not spark.sql("select * from silence where event = 'silent'").count():
            time.sleep(0.5)
        found = spark.sql("select * from silence").collect()
    finally:
        query.stop()
    silent = [r for r in found if r.event == "silent"]
    assert len(found) == 10 and [(r.device, r.ms, r.place_lat) for r in silent] == [("d", None, None)]
