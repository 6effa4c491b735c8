"""Analytic cases: sines, constants, short tails."""

import math

from sigloom.operators import features as feat
from sigloom.operators import indices


def sine(spark, hz, fs=128, n=256, session=1):
    rows = [(session, i, i / fs, "CH1", 10 * math.sin(2 * math.pi * hz * i / fs)) for i in range(n)]
    return spark.createDataFrame(rows, "session_id bigint, seq bigint, time double, ch string, value double")


def test_sine_lands_in_its_band(spark):
    for hz, band in ((2, "delta"), (6, "theta"), (10, "alpha"), (36, "gamma")):
        row = feat.epoch_features(sine(spark, hz), 128.0, 128).first()
        shares = {b: row[f"{b}_rel"] for b in feat.BANDS}
        assert max(shares, key=shares.get) == band and shares[band] > 0.9


def test_constant_and_tail(spark):
    rows = [(1, i, float(i), "CH1", 3.0) for i in range(13)]
    frame = spark.createDataFrame(rows, "session_id bigint, seq bigint, time double, ch string, value double")
    found = feat.epoch_features(frame, 8.0, 8).orderBy("epoch").collect()
    assert [r.n for r in found] == [8, 5]
    assert found[0].std == 0 and found[0].hjorth_mobility == 0 and found[0].skew is None and found[0].zcr == 0
    assert feat.epochs(frame.limit(11), 8).count() == 1


def test_missing_sample_gives_null(spark):
    frame = sine(spark, 6).selectExpr("session_id", "seq", "time", "ch", "if(seq = 5, null, value) value")
    first, second = feat.epoch_features(frame, 128.0, 128).orderBy("epoch").collect()
    assert first["mean"] is None and first.theta_power is None and first.theta_rel is None and second.theta_power > 0


def test_smoothing_needs_a_full_window(spark):
    rows = spark.createDataFrame([(1, i, float(i)) for i in range(7)], "session_id bigint, epoch bigint, score double")
    assert [r.score for r in indices.smooth(rows, ["score"], "score").orderBy("epoch").collect()] == [2.0, 3.0, 4.0]
