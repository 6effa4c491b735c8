"""Filters against their known response, gaps at edges, gates at their limits."""

import numpy as np

from sigloom.operators import clean, quality, timebase


def gain(kind, edges, hz, fs=256.0):
    t = np.arange(2048) / fs
    x = np.sin(2 * np.pi * hz * t)[:, None]
    y = clean.filtfilt(x, clean.butterworth(5, edges, fs, kind))
    return np.abs(y[512:1536]).max()


def test_filters_have_half_power_squared_at_their_edges():
    assert abs(gain("high", [1.0], 1.0) - 0.5) < 0.02 and abs(gain("low", [30.0], 30.0) - 0.5) < 0.02
    assert abs(gain("low", [30.0], 10.0) - 1) < 0.01 and gain("stop", [49.0, 51.0], 50.0) < 0.01 and abs(gain("stop", [49.0, 51.0], 20.0) - 1) < 0.01


def test_filter_windows_nulls(spark):
    rows = [(1, i, i / 256, float(np.sin(i / 4)), None if i == 5 else 1.0) for i in range(300)] + [(2, i, i / 256, 1.0, 1.0) for i in range(33)]
    wide = spark.createDataFrame(rows, "session_id bigint, seq bigint, time double, A double, B double")
    got = clean.filter_windows(wide, 256.0, ["A", "B"], ("session_id",)).collect()
    assert len(got) == 333
    assert all(r.B is None for r in got if r.session_id == 1) and all(r.A is None for r in got if r.session_id == 2) and all(r.A is not None for r in got if r.session_id == 1)


def test_gaps_at_edges(spark):
    values = [None, 1.0, None, None, 4.0, None]
    rows = spark.createDataFrame([(1, i, "a", v) for i, v in enumerate(values)] + [(1, i, "b", None) for i in range(2)], "session_id bigint, seq bigint, ch string, value double")
    got = clean.fill_gaps(rows).orderBy("ch", "seq").collect()
    assert [r.value for r in got] == [1.0, 1.0, 2.0, 3.0, 4.0, 4.0, None, None]


def test_downsample_keeps_both_ends(spark):
    rows = spark.createDataFrame([(1, i) for i in range(101)], "session_id bigint, seq bigint")
    got = [r.seq for r in timebase.downsample(rows, 11).orderBy("seq").collect()]
    assert got == list(range(0, 101, 10)) and timebase.downsample(rows, 200).count() == 101


def test_gated_runs(spark):
    levels = ["still", "gated", "gated", "gated", "nlms", "gated"]
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate(levels)], "session_id bigint, win bigint, level string")
    assert [r.run for r in quality.gated_runs(rows).orderBy("win").collect()] == [0, 1, 2, 3, 0, 1]
