"""Live steps: a replay cut at odd places gives the rows of the batch form."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigloom.operators import artifacts, quality, subspace, timebase
from sigloom.streaming import recordings, states

CH = ["A", "B"]


def replay(spark, folder, rows, cuts, order="seq"):
    """The rows as a stream, one micro-batch up to each cut."""
    bounds = [-(10**9), *cuts, 10**9]
    for a, b in zip(bounds, bounds[1:]):
        rows.filter((F.col(order) >= a) & (F.col(order) < b)).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def done(tmp_path, stream):
    return recordings.run_available(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"))


def same(a, b, digits=9):
    shape = lambda rows: sorted((tuple(round(v, digits) if isinstance(v, float) else v for v in r) for r in rows), key=repr)
    assert shape(a.collect()) == shape(b.select(*a.columns).collect())


def peaks(spark):
    rng = np.random.default_rng(5)
    rows = [(s, w, None if rng.random() < 0.1 else float(rng.lognormal(3, 1.2)), None if rng.random() < 0.1 else float(rng.lognormal(2, 0.5))) for s in (1, 2) for w in range(70)]
    return spark.createDataFrame(rows, "session_id bigint, win bigint, peak double, typical double")


@pytest.mark.parametrize("cuts", [[25, 26, 61]])
def test_thresholds(spark, tmp_path, cuts):
    rows = peaks(spark)
    got = done(tmp_path, states.adaptive_thresholds(replay(spark, str(tmp_path / "in"), rows, cuts, "win")))
    want = artifacts.adaptive_thresholds(rows)
    assert {r.clean for r in want.collect()} == {True, False} and {r.warmed_up for r in want.collect()} == {True, False}
    same(want, got)


def test_window_peaks(spark, tmp_path):
    rows = spark.createDataFrame([(s, i, None if i % 7 == s or 20 <= i < 40 else float(np.sin(i) * i), None if i % 3 else float(i)) for s in (1, 2) for i in range(107)], "session_id bigint, seq bigint, A double, B double")
    got = done(tmp_path, states.window_peaks(replay(spark, str(tmp_path / "in"), rows, [3, 50]), 10, CH))
    want = artifacts.window_peaks(rows.filter("seq < 100").withColumn("win", F.floor(F.col("seq") / 10).cast("bigint")), CH)
    same(want, got)


def test_count_windows(spark, tmp_path):
    rows = spark.createDataFrame([(1, i, float(i), None if i == 5 else float(-i)) for i in range(47)], "session_id bigint, seq bigint, A double, B double")
    got = done(tmp_path, states.count_windows(replay(spark, str(tmp_path / "in"), rows, [13, 14]), 10, CH)).collect()
    assert sorted((r.win, r.seq, r.A) for r in got) == [(i // 10, i, float(i)) for i in range(40)]


@pytest.mark.parametrize("cuts", [[33, 100, 171]])
def test_adaptive_filter_and_gate(spark, tmp_path, cuts):
    rng = np.random.default_rng(3)
    levels = ["nlms", "still", "nlms", "gated", "gated", "nlms", "gated", "gated", "gated", "nlms", "nlms", "nlms"]
    rows = [(s, t // 20, t, levels[t // 20], *(None if t == 25 else float(v) for v in rng.standard_normal(2)), *map(float, rng.standard_normal(2))) for s in (1, 2) for t in range(240)]
    made = spark.createDataFrame(rows, "session_id bigint, win bigint, seq bigint, level string, A double, B double, X double, Y double")
    got = done(tmp_path, states.adaptive_filter(replay(spark, str(tmp_path / "in"), made, cuts), CH, ["X", "Y"], taps=3))
    same(artifacts.adaptive_filter(made, CH, ["X", "Y"], taps=3), got)


def test_gate(spark, tmp_path):
    rng = np.random.default_rng(7)
    rows = spark.createDataFrame([(s, w, str(rng.choice(["gated", "gated", "nlms"]))) for s in (1, 2) for w in range(40)], "session_id bigint, win bigint, level string")
    got = done(tmp_path, states.gated_runs(replay(spark, str(tmp_path / "in"), rows, [5, 6], "win")))
    same(quality.gated_runs(rows), got)


def test_smoothing_is_reset(spark, tmp_path):
    rows = [(s, i, i in (17, 18, 30), None if i in (17, 18, 30) else float(i * s)) for s in (1, 2) for i in range(50)]
    made = spark.createDataFrame(rows, "session_id bigint, epoch bigint, reset boolean, score double")
    got = done(tmp_path, states.smooth(replay(spark, str(tmp_path / "in"), made, [16, 31], "epoch"), ["score"], width=4)).collect()
    want = []
    for s in (1, 2):
        segment, ring = 0, []
        for i in range(50):
            if i in (17, 18, 30):
                segment, ring = segment + 1, []
                continue
            ring = [*ring, i * s][-4:]
            if len(ring) == 4:
                want.append((s, segment, i, sum(ring) / 4))
    assert sorted((r.session_id, r.segment, r.epoch, r.score) for r in got) == want


def test_dejitter(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = spark.createDataFrame([(s, i, (i + (i > 30)) // 6 if i not in (12, 13) else 100 + i, 1.7e9 + i / 50 + float(rng.normal(0, 0.01))) for s in (1, 2) for i in range(100)], "session_id bigint, seq bigint, chunk bigint, time double")
    rows = rows.withColumn("chunk", F.when(F.col("seq") < 12, F.col("chunk")).when(F.col("seq") < 14, F.col("seq") + 50).otherwise(F.col("chunk") + 200))
    got = done(tmp_path, states.dejitter_sliding(replay(spark, str(tmp_path / "in"), rows, [4, 55]), 20))
    last = rows.agg(F.max("chunk")).first()[0]
    same(timebase.dejitter_sliding(rows, F.col("chunk"), 20).filter(F.col("chunk") < last).select("session_id", "seq", "time"), got, 4)


def test_rings(spark, tmp_path):
    rows = spark.createDataFrame([(s, i, i / 10, float(i)) for s in (1, 2) for i in range(90) if s == 1 or i < 40], "session_id bigint, seq bigint, time double, A double")
    got = done(tmp_path, states.recent(replay(spark, str(tmp_path / "in"), rows, [7, 60]), ["A"], count=25, horizon=1.5)).collect()
    latest = {s: max((r for r in got if r.session_id == s), key=lambda r: r.upto) for s in (1, 2)}
    assert latest[1].A == [float(i) for i in range(75, 90)] and latest[2].seq == list(range(25, 40)) and all(len(r.A) <= 25 for r in got)


def test_rings_that_expire(spark, tmp_path):
    rows = spark.createDataFrame([(1, i, i / 10, float(i)) for i in range(9)], "session_id bigint, seq bigint, time double, A double")
    stream = states.recent(replay(spark, str(tmp_path / "in"), rows, []), ["A"], count=5, ttl_seconds=60)
    query = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="1 second").start(str(tmp_path / "out"))
    try:  # by the clock there is always another micro-batch, so the query does not end by itself
        until = time.time() + 120
        while time.time() < until and not any(p["numInputRows"] for p in query.recentProgress):
            time.sleep(1)
    finally:
        query.stop()
    (row,) = spark.read.parquet(str(tmp_path / "out")).collect()
    assert row.A == [4.0, 5.0, 6.0, 7.0, 8.0] and row.upto == 8


def test_baseline_recordings(spark, tmp_path):
    samples = [(s, i, i / 10, float(i), None if i == 60 else 1.0) for s in (1, 2, 3) for i in range(400) if s < 3 or i < 55]
    control = [(1, 5.05, "start"), (1, 12.0, "stop"), (1, 13.0, "stop"), (1, 20.0, "start"), (2, 3.0, "start"), (2, 4.0, "start"), (3, 4.0, "start")]
    made = spark.createDataFrame([(*r, "sample") for r in samples], "session_id bigint, seq bigint, time double, A double, B double, kind string")
    made = made.unionByName(spark.createDataFrame(control, "session_id bigint, time double, kind string"), allowMissingColumns=True).withColumn("at", F.floor(F.col("time") * 10).cast("bigint"))
    stream = replay(spark, str(tmp_path / "in"), made, [70, 133], "at")
    out = states.baseline_recordings(stream.filter("kind = 'sample'"), stream.filter("kind <> 'sample'"), CH, size=16, limit=10.0, late="1 seconds")
    got = done(tmp_path, out).collect()
    rows = sorted((r.session_id, r.recording, r.win, r.seq) for r in got if r.event == "window")
    whole = lambda s, k, a, b: [(s, k, (i - a) // 16, i) for i in range(a, a + (b - a) // 16 * 16)]
    assert rows == sorted([*whole(1, 1, 51, 120), *whole(1, 2, 200, 300), *whole(2, 2, 40, 140)])
    said = sorted((r.session_id, r.recording, r.event, r.win, r.time) for r in got if r.event != "window")
    assert said == [(1, 1, "ready", 4, 12.0), (1, 1, "recording", 0, 5.05), (1, 2, "ready", 6, 30.0), (1, 2, "recording", 0, 20.0), (2, 1, "recording", 0, 3.0), (2, 2, "ready", 6, 14.0), (2, 2, "recording", 0, 4.0), (3, 1, "idle", 0, 14.0), (3, 1, "recording", 0, 4.0)]
    assert [r.B for r in got if r.seq == 60 and r.session_id == 1] == [None]


def test_a_recording_is_cleaned_and_calibrated(spark):
    rng = np.random.default_rng(8)
    rows = [(1, 1, i // 256, i, i / 256, *map(float, 800 + 10 * rng.standard_normal(2).cumsum())) for i in range(256 * 20)]
    windows = spark.createDataFrame(rows, "session_id bigint, recording bigint, win bigint, seq bigint, time double, A double, B double")
    state = subspace.baseline_quality(subspace.calibrate_recording(windows, CH, 256.0)).first()
    assert state.seconds == 20.0 and state.ok and len(state.cov) == 2


def test_segmented_sink(spark, tmp_path):
    rows = spark.createDataFrame([(s, i, i / 10, float(i)) for s in (1, 2) for i in range(95)], "session_id bigint, i bigint, time double, A double")
    stream = states.segmented(replay(spark, str(tmp_path / "in"), rows, [31, 64], "i"), 20, ["A"])
    folder, checkpoint = str(tmp_path / "segments"), str(tmp_path / "checkpoint")
    for _ in range(2):  # a second start finds nothing new
        states.segment_sink(stream, folder, "raw", ["A"], checkpoint).awaitTermination()
    got = states.read_segment_sink(spark, folder, ["A"])
    assert sorted((r.session_id, r.segment, r.seq, r.timestamp, r.A) for r in got.collect()) == [(s, i // 20 + 1, i, i / 10, float(i)) for s in (1, 2) for i in range(95)]
    assert len(list((tmp_path / "segments").glob("batch=*/*.csv"))) < 13


def test_session_windows_and_late_rows(spark, tmp_path):
    rows = [(1, 0, t, 1.0) for t in (0, 50, 100)] + [(1, 1, t, 2.0) for t in (400, 450)] + [(2, 1, 5_000, 3.0)] + [(2, 2, 6_000, 5.0), (1, 3, 10, 9.0), (2, 3, 9_000, 4.0)]
    made = spark.createDataFrame(rows, "session_id bigint, part bigint, t bigint, v double").select("session_id", "part", F.timestamp_seconds("t").alias("ts"), "v")
    stream = states.active_sessions(replay(spark, str(tmp_path / "in"), made, [1, 2, 3], "part"), "v", gap="120 seconds", late="10 minutes")
    query = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out"))
    query.awaitTermination()
    got = {(r.session_id, r.start.minute * 60 + r.start.second, r.n, r["mean"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(1, 0, 3, 1.0), (1, 400, 2, 2.0), (2, 1_400, 1, 3.0), (2, 2_400, 1, 5.0)}  # 5,000 s is 83 min 20 s
    assert states.late_rows(query) == 1
