"""Sources, sinks, kernels and streams against files, brute force and analytic cases."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigloom.functions import scalars as X
from sigloom.operators import artifacts, clean, optical, subspace, timebase
from sigloom.schemas import PROCESSED_SEGMENT
from sigloom.sources import marker_files, segments
from sigloom.streaming import recordings


def write(path, header, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join([header, *(",".join(map(str, r)) for r in rows)]) + "\n")


RAW = "timestamp,ch_1,ch_2,ch_3,ch_4"


def test_segment_scans(spark, tmp_path):
    for session, base in (("20260522_161000", 0), ("20260522_161130", 90), ("20260522_170000", 3000)):
        for seg in (1, 2):
            write(tmp_path / session / f"EEG_seg{seg:04d}.csv", RAW, [(f"{base + seg:.6f}", "1.5", "nan", "", "inf")])
    rows = segments.scan_recordings(spark, str(tmp_path), "raw")
    assert rows.count() == 6 and {(r.session_id, r.segment) for r in rows.collect()} == {(s, k) for s in ("20260522_161000", "20260522_161130", "20260522_170000") for k in (1, 2)}
    one = rows.first()
    assert one.ch_1 == 1.5 and one.ch_2 is one.ch_3 is one.ch_4 is None
    near = segments.scan_recordings(spark, str(tmp_path), "raw", near="20260522_161000")
    assert {r.session_id for r in near.collect()} == {"20260522_161000", "20260522_161130"}
    assert [tuple(r) for r in segments.time_range(near.filter("session_id = '20260522_161000'")).collect()] == [("20260522_161000", 1.0, 2.0)]
    write(tmp_path / "20260522_161000" / "EEG_seg0001_preprocessed.csv", "timestamp,CH1,CH2,CH3,CH4", [(1, 2, 3, 4, 5)])
    assert segments.scan_preprocessed(spark, str(tmp_path), PROCESSED_SEGMENT).first().CH4 == 5.0
    assert segments.rows_a_segment(4, 256.0, seconds=60) == 15360 and segments.rows_a_segment(4, 256.0, size=910) == 10 and segments.rows_a_segment(4, 256.0, samples=7) == 7 and segments.rows_a_segment(4, 256.0) == 15360


def test_marker_files_round_trip(spark, tmp_path):
    marks = [{"id": i, "content": f"课 {i}", "start_ts": 10.0 + i, "end_ts": 12.5 + i, "start_str": "2026-05-22 16:10:00", "end_str": "2026-05-22 16:10:02", "duration_s": 2.5} for i in range(3)]
    record = {"session_id": "20260522_161000", "received_at": "x", "start_time": "2026-05-22 16:10:00", "start_ts": 10.0, "end_time": None, "end_ts": None, "duration_seconds": None, "marker_count": 3, "markers": marks}
    root = tmp_path / "in"
    for name in ("20260522_161000", "20260526_140000"):
        (root / name).mkdir(parents=True)
        (root / name / "session.json").write_text(json.dumps(record | {"session_id": name}, indent=1, ensure_ascii=False))
    (root / "broken").mkdir()
    (root / "broken" / "session.json").write_text("{oops")
    write(root / "20260522_161000" / "markers.csv", "﻿" + ",".join(marker_files.COLUMNS), [tuple(m[c] for c in marker_files.COLUMNS) for m in marks])
    sessions = marker_files.scan_sessions(spark, str(root))
    assert [r.session_id for r in sessions.collect()] == ["20260526_140000", "20260522_161000"]
    table = marker_files.scan_marker_table(spark, str(root)).orderBy("id").collect()
    assert [tuple(r) for r in table] == [tuple(r) for r in marker_files.marker_rows(sessions).filter("session_id = '20260522_161000'").orderBy("id").collect()]
    out = str(tmp_path / "out")
    marker_files.write_sessions(sessions, out)
    marker_files.write_sessions(sessions.filter("session_id = '20260522_161000'").withColumn("marker_count", F.lit(9).cast("bigint")), out)  # replaces its own folder only
    back = spark.read.json(f"{out}/sessions")
    assert {(r.session_id, r.marker_count) for r in back.collect()} == {("20260522_161000", 9), ("20260526_140000", 3)}


def direct(x, sections, pad):
    """Zero-phase filtering with the sections multiplied out, sample by sample."""
    b, a = np.ones(1), np.ones(1)
    for sb, sa in sections:
        b, a = np.polymul(b, sb), np.polymul(a, sa)
    n = len(a) - 1
    m = np.zeros((n, n))
    m[:-1, 1:] = np.eye(n - 1)
    m[:, 0] -= a[1:]
    state0 = np.linalg.solve(np.eye(n) - m, b[1:] - a[1:] * b[0])
    y = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    for _ in range(2):
        s, out = state0 * y[0], []
        for v in y:
            w = b[0] * v + s[0]
            s = np.append(s[1:], 0) + b[1:] * v - a[1:] * w
            out.append(w)
        y = np.array(out)[::-1]
    return y[pad:-pad]


@pytest.mark.parametrize("kind, edges, order", [("high", [1.0], 5), ("low", [30.0], 5), ("stop", [49.0, 51.0], 2), ("band", [0.5, 4.0], 3)])
def test_filters_equal_the_direct_recurrence(kind, edges, order):
    x = np.random.default_rng(1).standard_normal(300).cumsum()
    sections = clean.butterworth(order, edges, 256.0, kind)
    pad = clean.padding(sections)
    assert pad == 3 * (order * (2 if kind in ("stop", "band") else 1) + 1)
    assert np.allclose(clean.filtfilt(x[:, None], sections)[:, 0], direct(x, sections, pad), atol=1e-5)


def test_rates_that_cannot_carry_the_filters_are_errors():
    for fs in (60.0, 90.0, 100.0, 102.0):
        with pytest.raises(ValueError):
            clean.filter_steps(fs)
    assert all(len(s) for s in clean.filter_steps(102.5))


def test_spline_gives_cubics_back_and_holds_its_ends():
    x = np.sort(np.random.default_rng(2).random(12)) * 10
    cubic = lambda t: np.stack([t**3 - 4 * t**2 + 1, 2 - t], axis=1)
    at = np.linspace(x[0], x[-1], 50)
    assert np.allclose(artifacts.spline(x, cubic(x), at), cubic(at), atol=1e-8)
    assert np.allclose(artifacts.spline(x, cubic(x), np.array([-5.0, 99.0])), cubic(x[[0, -1]]))
    assert np.allclose(artifacts.spline(x[:3], (x[:3] ** 2)[:, None], at[:9])[:, 0], np.clip(at[:9], x[0], x[2]) ** 2) and np.allclose(artifacts.spline(x[:2], x[:2, None] * 3, x[:1])[:, 0], 3 * x[0]) and artifacts.spline(x[:1], np.array([[7.0]]), x)[:, 0].tolist() == [7.0] * 12


def test_adaptive_filter_goes_on_between_windows_and_resets(spark):
    rng = np.random.default_rng(3)
    ref = rng.standard_normal((240, 2))
    signal = np.stack([0.7 * ref[:, 0] - 0.2 * np.roll(ref[:, 1], 1), ref.sum(1)], axis=1)
    levels = ["nlms", "still", "nlms", "gated", "gated", "nlms", "gated", "gated", "gated", "nlms", "nlms", "nlms"]
    signal[25, 1] = np.nan
    want, weights, line, run = {}, np.zeros((2, 6)), np.zeros((3, 2)), 0
    for w, level in enumerate(levels):
        run = run + 1 if level == "gated" else 0
        if run >= 3:
            weights, line = np.zeros((2, 6)), np.zeros((3, 2))
        for t in range(w * 20, w * 20 + 20):
            if level == "still":
                want[t] = signal[t]
            elif level == "nlms":
                line = np.concatenate([ref[t : t + 1], line[:-1]])
                x = line.ravel()
                e = signal[t] - weights @ x
                weights = weights + np.where(np.isnan(e), 0, e)[:, None] * 0.5 * x / (x @ x + 1e-6)
                want[t] = e
    rows = [(1, t // 20, t, levels[t // 20], *(None if np.isnan(v) else float(v) for v in signal[t]), *map(float, ref[t])) for t in range(240)]
    made = spark.createDataFrame(rows, "session_id bigint, win bigint, seq bigint, level string, A double, B double, X double, Y double")
    got = {r.seq: (r.A, r.B) for r in artifacts.adaptive_filter(made, ["A", "B"], ["X", "Y"], taps=3).collect()}
    assert got.keys() == want.keys() and all(np.allclose([np.nan if v is None else v for v in got[t]], want[t], equal_nan=True) for t in want)
    with pytest.raises(ValueError):
        artifacts.adaptive_filter(made, ["A"], ["X"], rate=2.0)


def test_subspace_cleaning_removes_a_burst_and_keeps_the_rest(spark, tmp_path):
    rng = np.random.default_rng(4)
    mix = rng.standard_normal((4, 4))
    x = rng.standard_normal((40 * 32, 4)) @ mix
    x[32 * 35 : 32 * 36] += 80 * rng.standard_normal((32, 1)) @ rng.standard_normal((1, 4))
    rows = [(1, t // 32, t, t / 32, *map(float, x[t])) for t in range(len(x))]
    wide = spark.createDataFrame(rows, "session_id bigint, win bigint, seq bigint, time double, A double, B double, C double, D double")
    names = ["A", "B", "C", "D"]
    state = subspace.calibrate(wide.filter("win < 32"), names, 32.0, cutoff=5.0)
    assert subspace.baseline_quality(state).first().seconds == 32.0
    subspace.save(state, str(tmp_path / "state"))
    loaded = subspace.load(spark, str(tmp_path / "state"))
    assert loaded.first().seconds is None
    got = np.array([[r.A, r.B, r.C, r.D] for r in subspace.clean_windows(wide, loaded, names).orderBy("seq").collect()])
    burst = slice(32 * 35, 32 * 36)
    assert np.allclose(np.delete(got, np.arange(len(x))[burst], 0), np.delete(x, np.arange(len(x))[burst], 0)) and np.abs(got[burst]).mean() < 0.2 * np.abs(x[burst]).mean()
    assert subspace.clean_windows(wide, loaded.limit(0), names).count() == len(x)


def test_heart_rate_and_saturation(spark):
    fs, n = 64.0, 1280
    t = np.arange(n) / fs
    pulse = np.sin(2 * np.pi * 1.2 * t) + 3 * t  # 72 beats a minute on a drift
    rows = [(1, i, float(t[i]), 10.0, float(1010 + pulse[i]), float(510 + 0.4 * pulse[i])) for i in range(n)]
    made = spark.createDataFrame(rows, "session_id bigint, seq bigint, time double, ambient double, ir double, red double")
    got = optical.vitals(made, fs).orderBy("tick").collect()
    assert [r.tick for r in got] == list(range(4, 20)) and all(abs(r.heart_rate - 72) < 2 for r in got if r.tick >= 9)
    assert all(abs(r.spo2 - (100.67 - 9.14 * 0.4 * (1000 / 500))) < 0.8 for r in got)
    assert optical.peaks(np.array([0, 2, 2, 0, 1, 0, 3, 0.0]), 2, 0.5).tolist() == [1, 4, 6] and optical.peaks(np.array([0, 2, 2, 0, 1, 0, 3, 0.0]), 3, 0.5).tolist() == [1, 6]
    assert optical.heart_rate(np.ones(10), 64.0) is None and optical.band_pass(np.ones(5), 64.0).tolist() == [1.0] * 5 and optical.band_pass(np.ones(15), 64.0) is None


def test_texts(spark):
    df = spark.createDataFrame([("2024-01-02T03:04:05.25",), ("2024-01-02 03:04:05",), ("03:04:05",), ("12.5",), ("2024-01-02",), ("x",), (None,)], "t string")
    assert [r[0] for r in df.select(X.parse_time(F.col("t"), F.lit("2024-01-02"))).collect()] == [1704164645.25, 1704164645.0, 1704164645.0, 12.5, None, None, None]
    numbers = spark.createDataFrame([(123.456,), (12.3456,), (0.0123456,), (0.000123,), (None,)], "v double")
    assert [r[0] for r in numbers.select(X.number_text(F.col("v"))).collect()] == ["123.5", "12.346", "0.0123", "1.23e-4", "--"]


def test_downsample_of_every_size(spark):
    for n in (1, 2, 7, 50, 101):
        rows = spark.createDataFrame([(1, i) for i in range(n)], "session_id bigint, seq bigint")
        for most in (1, 2, 3, 10, 49):
            got = sorted(r.seq for r in timebase.downsample(rows, most).collect())
            assert got == (list(range(n)) if n <= most else [0] if most == 1 else sorted({int(np.round(v)) for v in np.linspace(0, n - 1, most)})), (n, most)


def test_new_segment_files_are_read_once(spark, tmp_path):
    root, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "checkpoint")
    write(root / "a" / "EEG_seg0001.csv", RAW, [(1, 1, 2, 3, 4), (2, 1, 2, 3, 4)])
    first = recordings.run_available(recordings.segment_stream(spark, str(root), "raw"), out, checkpoint).count()
    write(root / "a" / "EEG_seg0002.csv", RAW, [(3, 1, 2, 3, 4)])
    write(root / "a" / "IMU_seg0001.csv", "timestamp,AccX", [(3, 1)])
    second = recordings.run_available(recordings.segment_stream(spark, str(root), "raw"), out, checkpoint).collect()
    assert first == 2 and sorted((r.session_id, r.segment, r.timestamp) for r in second) == [("a", 1, 1.0), ("a", 1, 2.0), ("a", 2, 3.0)]


def test_live_results_are_the_last_of_each_batch(spark, tmp_path):
    shown, folder = [], str(tmp_path / "in")
    for part in range(2):
        spark.createDataFrame([(s, part * 3 + i, float(s * 10 + part * 3 + i)) for s in (1, 2) for i in range(3)], "session_id bigint, epoch bigint, score double").coalesce(1).write.mode("append").parquet(folder)
    stream = recordings.rows_stream(spark, folder, "session_id bigint, epoch bigint, score double")
    recordings.live_latest(stream, ["score"], lambda df, n: shown.append({r.session_id: r.score for r in df.collect()}), str(tmp_path / "c")).awaitTermination()
    assert shown == [{1: 12.0, 2: 22.0}, {1: 15.0, 2: 25.0}]


def test_event_time_windows(spark, tmp_path):
    folder = str(tmp_path / "in")
    spark.createDataFrame([(1, i, float(i)) for i in range(40)], "session_id bigint, s bigint, v double").select("session_id", F.timestamp_seconds("s").alias("ts"), "v").coalesce(1).write.parquet(folder)
    stream = recordings.rows_stream(spark, folder, "session_id bigint, ts timestamp, v double")
    got = {r.start.second: (r.n, r["mean"]) for r in recordings.run_available(recordings.windowed_means(stream, "v"), str(tmp_path / "out"), str(tmp_path / "c")).filter("n = 10").collect()}
    assert got and all(v == (10, s + 4.5) for s, v in got.items())


def test_snapshots_and_feature_folders(spark, tmp_path):
    rows = spark.createDataFrame([(f"s{i % 2}", f"f{i % 3}", float(i)) for i in range(12)], "session_id string, file string, v double")
    assert segments.snapshot(rows, str(tmp_path), "_cleaned").agg(F.sum("v")).first()[0] == 66.0
    segments.write_features(rows, str(tmp_path / "features"))
    back = spark.read.parquet(str(tmp_path / "features")).filter("session_id = 's1' and file = 'f2'")
    assert sorted(r.v for r in back.collect()) == [5.0, 11.0]
