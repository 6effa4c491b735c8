"""Queries of blinks, motion, resampling, subspace cleaning and optical vitals."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import artifacts, history, markers, optical, quality, report, subspace, timebase
from ..operators import features as feat
from ..functions import scalars as X
from ..streaming import recordings
from ..sources.segments import scratch
from . import views as V
from .feature_queries import FS, SIZE, attention_level, rounded
from .signal_queries import CH, _levels, _with

WIN = ("session_id", "win")


def _thresholds(spark, d):
    return artifacts.adaptive_thresholds(artifacts.window_peaks(V.blinks(spark, d), CH))


def window_peaks(spark, d):
    return rounded(artifacts.window_peaks(V.blinks(spark, d), CH))


def adaptive_thresholds(spark, d):
    return rounded(_thresholds(spark, d).select("session_id", "win", "threshold", "warmed_up", "clean"))


def blinks_repaired(spark, d):
    wide = V.blinks(spark, d).withColumn("CH4", F.when(F.col("win") % 5 != 2, F.col("CH4")).otherwise(F.when(F.col("seq") % 16 < 1, F.col("CH4"))))
    return rounded(artifacts.repair_blinks(wide, _thresholds(spark, d), CH, 16.0).select("session_id", "win", "seq", *CH, "blink_detected"))


def blink_gate_mixed(spark, d):
    """Windows that are kept and windows that go; negative blinks count."""
    wide = V.blinks(spark, d).withColumn("CH1", -F.col("CH1"))
    return rounded(quality.blink_gate(wide, CH, 64.0, WIN, threshold=140.0))


def _windows(spark, d):
    return V.imu(spark, d).groupBy("session_id", F.floor(F.col("seq") / 60).cast("bigint").alias("win")).agg(F.min("time").alias("t0"), F.max("time").alias("t1"))


def imu_of_windows(spark, d):
    held = artifacts.imu_of_windows(_windows(spark, d), V.imu(spark, d), 0.1, 2.0)
    return rounded(held.groupBy("session_id", "win").agg(F.count(F.lit(1)).alias("n"), F.min("time").alias("first"), F.max("time").alias("last")))


def motion_gated(spark, d):
    """Windows that motion lets pass; every fourth has no motion data."""
    levels = _levels(spark, d)
    return artifacts.motion_gate(levels.select("session_id", "win"), levels.filter("win % 4 > 0")).select("session_id", "win", "level")


def _imu_odd(spark, d):
    """IMU rows, some without values and some twice at one time."""
    i = V.imu(spark, d)
    late = i.filter("seq % 10 = 3").withColumn("seq", F.col("seq") + 5000).withColumn("AccX", F.col("AccX") + 1)
    return i.withColumn("GyrZ", F.when(F.col("seq") % 7 != 0, F.col("GyrZ"))).unionByName(late)


def ordered_imu(spark, d):
    return rounded(artifacts.ordered_imu(_imu_odd(spark, d)))


def resampled_linear(spark, d):
    times = V.sig_wide(spark, d).select("session_id", "seq", (F.col("time") / 2.0137 - 0.0513).alias("time"))
    return rounded(artifacts.resample_linear(times, _imu_odd(spark, d)))


def _eeg_windows(spark, d):
    return V.sig_wide(spark, d, 256.0).withColumn("win", F.floor(F.col("seq") / 64).cast("bigint"))


def _resampled(spark, d):
    wide = _eeg_windows(spark, d)
    bounds = wide.groupBy(*WIN).agg(F.min("time").alias("t0"), F.max("time").alias("t1"))
    return wide, artifacts.resample_spline(wide, artifacts.imu_of_windows(bounds, V.imu(spark, d)))


def resampled_spline(spark, d):
    return rounded(_resampled(spark, d)[1])


def motion_filtered(spark, d):
    """The adaptive filter over windows by level: still, nlms, gated in turn."""
    wide, axes = _resampled(spark, d)
    level = F.element_at(F.array(F.lit("still"), F.lit("nlms"), F.lit("nlms"), F.lit("gated")), (F.col("win") % 4 + 1).cast("int"))
    rows = wide.join(axes.drop("time"), ["session_id", "win", "seq"]).withColumn("level", level)
    return rounded(artifacts.adaptive_filter(rows, CH), 4)


def baseline_state(spark, d):
    """Calibration on the first quarter of each recording."""
    rows = subspace.recorded(V.sig_wide(spark, d, 256.0), F.lit(0.0), F.lit(1.0), 32)
    return subspace.baseline_quality(subspace.calibrate(rows, CH, 256.0)).select("seconds", F.size("cov").cast("bigint").alias("n"), "ok", F.array_join("errors", ",").alias("errors"), F.array_join("warns", ",").alias("warns"))


def subspace_cleaned(spark, d):
    rows = subspace.recorded(V.sig_wide(spark, d, 256.0), F.lit(0.0), F.lit(1.0), 32)
    return rounded(subspace.clean_windows(_eeg_windows(spark, d), subspace.calibrate(rows, CH, 256.0, cutoff=2.0), CH), 3)


def baseline_quality(spark, d):
    """Verdicts on states of all kinds, made from embeddings."""
    e = V.table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda v: F.abs(v.cast("double"))).alias("v"))
    i = F.col("vec_id")
    cell = lambda r, c: F.when((i % 11 == 3) & F.lit(r == c), F.lit(float("nan"))).otherwise(F.get("v", F.lit(4 * r + c)) + (1.0 if r == c else 0.0)) if r == c else F.get("v", F.lit(4 * r + c))
    cov = F.array(*(F.array(*((cell(r, c) if r or c else F.when(i % 3 == 0, 9.0).otherwise(cell(0, 0))) for c in range(4))) for r in range(4)))
    threshold = F.array(F.array(F.get("v", F.lit(20)), F.when(i % 7 == 0, 60.0).when(i % 7 == 1, F.lit(float("inf"))).otherwise(1.0)))
    state = e.select("vec_id", F.when(i % 5 > 0, (i % 50).cast("double")).alias("seconds"), F.when(i % 13 > 0, cov).alias("cov"), threshold.alias("threshold"))
    return subspace.baseline_quality(state).select("vec_id", "ok", F.array_join("errors", ",").alias("errors"), F.array_join("warns", ",").alias("warns"))


def optical_vitals(spark, d):
    return rounded(optical.vitals(V.ppg(spark, d), 64.0), 3)


def optical_windows(spark, d):
    """Sliding windows with their rates and the means of the light."""
    rows = optical.less_ambient(V.ppg(spark, d))
    w = optical.sliding_windows(rows, 64.0, seconds=2.0)
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda t, v: t + v) / F.size(c)
    return rounded(w.select("session_id", "tick", "n", "rate", mean("ir").alias("ir_dc"), mean("red").alias("red_dc")), 5)


def saturation_smoothed(spark, d):
    u = V.sig_user(spark, d).select("session_id", F.col("seq").alias("tick"), F.when(V.k_of() % 6 > 0, F.col("value")).alias("spo2"))
    return rounded(optical.smoothed(u, Window.partitionBy("session_id").orderBy("tick"), 8), 5)


def canonical_sessions(spark, d):
    kinds = F.array(*(F.lit(k) for k in ("raw", "processed", "features", "attention", "cognitive_load", "imu")))
    u = V.sig_user(spark, d).groupBy("session_id").agg(F.min("time").alias("start"))
    named = u.select(F.format_string("s%05d", "session_id").alias("session"), F.get(kinds, (F.col("session_id") % 6).cast("int")).alias("kind"), "start")
    return rounded(history.canonical(named, 3600.0), 3)


def canonical_catalogue(spark, d):
    placed = canonical_sessions(spark, d).withColumn("end", F.col("start") + 60)
    out = history.catalogue(placed)
    return out.select("canonical", F.array_join("types", ",").alias("types"), "start_text", "end_text", "display")


def history_load(spark, d):
    """A range of each session, 20 rows at most, with clock texts."""
    start, end = 1_704_500_000.0, 1_706_000_000.0
    return rounded(history.load(V.sig_user(spark, d).select("session_id", "seq", "time", "value"), start=start, end=end, most=20), 3)


def ring_snapshot(spark, d):
    s = history.snapshot(V.sig_user(spark, d).select("session_id", "seq", "event_id"), ["event_id"], 7)
    return s.select("session_id", F.array_join(F.transform("event_id", lambda v: v.cast("string")), ",").alias("events"))


def latest_values(spark, d):
    return rounded(history.latest(V.sig_user(spark, d), ["value", "event_type"]))


def band_series(spark, d):
    wide = feat.to_wide(feat.epoch_features(feat.to_long(V.sig_wide(spark, d, FS)), FS, SIZE, time=False), feat.FREQUENCY)
    return rounded(history.band_series(wide).select("session_id", "epoch", F.col("CH1.delta").alias("delta1"), F.col("CH2.theta").alias("theta2"), F.col("CH4.gamma").alias("gamma4")))


def _scores(spark, d):
    u = V.sig_user(spark, d).withColumn("k", V.k_of())
    attention = u.select("session_id", F.col("seq").alias("epoch"), (F.least("value", F.lit(100.0)) / 100 * F.when(F.col("session_id") % 3 == 0, 2).otherwise(1)).alias("attention_score"))
    loads = u.filter("session_id % 5 > 0").select("session_id", F.col("seq").alias("epoch"), (F.when(F.col("session_id") % 4 == 0, F.col("k") / 100).otherwise(0.4 + F.col("k") / 400)).alias("cog_load_score"), (F.col("k") / 50).alias("cognitive_load_index"))
    return attention.withColumn("level", X.level(F.col("attention_score"))), loads.withColumn("level", X.level(F.col("cog_load_score")))


def load_summaries(spark, d):
    return rounded(report.load_summary(_scores(spark, d)[1]), 5)


def joint_reports(spark, d):
    """Both summaries, efficiency, grade and all rules with their levels."""
    out = report.joint_report(*_scores(spark, d))
    rules = F.array_join(F.transform("recommendations", lambda r: F.concat(r["type"], F.lit(":"), r["level"])), ",")
    messages = F.array_join(F.transform("recommendations", lambda r: r["message"]), " ")
    return out.select("session_id", F.round("attention.focus", 6).alias("focus"), F.round("load.optimal", 6).alias("optimal"), "fatigue", F.round("efficiency", 6).alias("efficiency"), "grade", rules.alias("rules"), messages.alias("messages"))


def attention_summaries(spark, d):
    """Scores of all levels with engagement and ratio; in every seventh session these are missing."""
    attention, u = _scores(spark, d)[0], V.sig_user(spark, d).withColumn("k", V.k_of())
    other = u.select("session_id", F.col("seq").alias("epoch"), F.when(F.col("session_id") % 7 > 0, F.col("k") / 40).alias("engagement_index"), F.when(F.col("session_id") % 7 > 0, F.col("value") / 30).alias("theta_alpha_ratio"))
    out = report.attention_summary(attention.join(other, ["session_id", "epoch"]))
    return rounded(out.select("session_id", "n", "max_score", "high_share", "low_share", "trend", "focus", F.col("mean_ei").alias("ei"), F.col("mean_tar").alias("tar")), 4)


def session_reports(spark, d):
    """The report of each session with the lengths of its series and its markers."""
    attention, loads = _scores(spark, d)
    short = lambda rows: timebase.downsample(rows, 50, order="epoch")
    out = history.session_report(short(attention), short(loads), V.markers(spark, d), report.joint_report(attention, loads))
    return out.select("session_id", F.size("attention_series").cast("bigint").alias("n_attention"), F.coalesce(F.size("load_series").cast("bigint"), F.lit(0)).alias("n_load"), F.size("markers").cast("bigint").alias("n_markers"))


def parsed_markers(spark, d):
    m = markers.parse_markers(V.requests(spark, d))
    return rounded(m.select("session_id", "id", "content", "start_ts", "end_ts", "start_str", "duration_s", F.element_at("extras", "note").alias("note")), 3)


def _sessions(spark, d):
    """Two requests per session, the later one counts; a third have no name of their own and stay apart by user where they begin in the same second."""
    r = V.requests(spark, d)
    head = r.groupBy("session_id", "start_ts").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "marker"))), lambda s: s["marker"]).alias("markers"))
    name = F.when(F.col("session_id") % 3 > 0, F.format_string("u%05d", "session_id"))
    first = lambda k: head.select(name.alias("session_id"), F.col("session_id").alias("user"), X.date_text(F.col("start_ts")).alias("start_time"), F.when(F.col("session_id") % 2 == 0, X.date_text(F.col("start_ts") + 100 * k)).alias("end_time"), F.when(F.lit(k) > 1, F.col("markers")).otherwise(F.slice("markers", 1, 1)).alias("markers"), F.lit(k).cast("bigint").alias("received"))
    return markers.save_sessions(first(1).unionByName(first(2)).unionByName(first(1).withColumn("start_time", F.lit(None).cast("string"))), "user")


def marker_sessions(spark, d):
    return rounded(markers.listed(_sessions(spark, d)), 3)


def markers_appended(spark, d):
    """One marker more for each named session, and one for a session that was not there."""
    s = _sessions(spark, d)
    more = V.requests(spark, d).select(F.format_string("u%05d", "session_id").alias("session_id"), "pos", "marker").filter("pos = 0")
    out = markers.append_markers(s, more.unionByName(spark.createDataFrame([("zz", 0, '{"time_range":[1704103200,1704103260],"content":"new"}')], "session_id string, pos bigint, marker string")))
    return out.select("session_id", "marker_count", F.try_element_at("markers", F.lit(-1))["id"].alias("last_id"), F.try_element_at("markers", F.lit(-1))["content"].alias("last"))


def session_times_patched(spark, d):
    s = _sessions(spark, d).filter("session_id like 'u%'")
    patches = s.filter("marker_count % 2 = 0").select("session_id", F.lit("2024-02-01 00:00:00").alias("start_time"), F.when(F.col("end_ts").isNull(), "2024-02-01T00:01:40").alias("end_time")).unionByName(spark.createDataFrame([("none", "2024-02-01 00:00:00", None)], "session_id string, start_time string, end_time string"))
    return rounded(markers.update_times(s, patches).select("session_id", "start_time", "end_time", "duration_seconds", "marker_count"), 3)


def recordings_matched(spark, d):
    """Recordings against marker sessions of other days, near ones and namesakes."""
    u = V.sig_user(spark, d).groupBy("session_id").agg(F.min("time").alias("start"))
    rec = u.select(F.format_string("n%05d", "session_id").alias("session_id"), "start")
    own = u.filter("session_id % 4 = 0").select(F.format_string("n%05d", "session_id").alias("session_id"), (F.col("start") + 90000).alias("start_ts"))
    near = u.select(F.format_string("m%05d", "session_id").alias("session_id"), (F.col("start") + F.col("session_id") % 7 * 60).alias("start_ts"))
    return rounded(markers.match_recordings(rec, own.unionByName(near)), 3)


def _replayed(rows, spark, name, order, step):
    """Rows that come in three parts, each a stretch of every session, taken through ``step``."""
    at = F.floor(F.col(order) / (300 if order == "seq" else 9))
    folder, out, checkpoint = scratch(spark, "replay"), scratch(spark, name), scratch(spark, "checkpoint")
    parts = [rows.filter(at == 0), rows.filter(at == 1), rows.filter(at >= 2)]
    return recordings.replayed(parts, folder, lambda stream: recordings.run_available(step(stream), out, checkpoint))


def streamed_epochs(spark, d):
    """Epochs of a stream in three micro-batches: the whole ones of the batch form."""
    out = _replayed(V.sig_wide(spark, d, FS), spark, "epochs", "seq", lambda stream: recordings.epochs(stream, SIZE, CH))
    return rounded(out.select("session_id", "epoch", "ch", "timestamp", "n", F.get("x", F.lit(0)).alias("first"), F.element_at("x", -1).alias("last")))


def streamed_attention(spark, d):
    """Smoothing carried from one micro-batch to the next."""
    from ..operators import indices

    raw = indices.attention(feat.epoch_features(feat.to_long(V.sig_wide(spark, d, FS)), FS, SIZE, time=False)).select("session_id", "epoch", "attention_score", "engagement_index")
    out = _replayed(raw, spark, "smooth", "epoch", lambda stream: recordings.smooth(stream, ["attention_score", "engagement_index"], "attention_score"))
    return rounded(out)


def streamed_downsample(spark, d):
    out = _replayed(V.sig_wide(spark, d, FS), spark, "nth", "seq", lambda stream: recordings.every_nth(stream, 16))
    return rounded(out.select("session_id", "seq", "CH1"))


QUERIES = {f.__name__: f for f in (window_peaks, adaptive_thresholds, blinks_repaired, blink_gate_mixed, imu_of_windows, motion_gated, ordered_imu, resampled_linear, resampled_spline, motion_filtered, baseline_state, subspace_cleaned, baseline_quality, optical_vitals, optical_windows, saturation_smoothed, canonical_sessions, canonical_catalogue, history_load, ring_snapshot, latest_values, band_series, load_summaries, attention_summaries, joint_reports, session_reports, parsed_markers, marker_sessions, markers_appended, session_times_patched, recordings_matched, streamed_epochs, streamed_attention, streamed_downsample)}

_LV = """n AS (SELECT session_id, seq // 52 AS win, sqrt(AccX * AccX + AccY * AccY + AccZ * AccZ) AS a, sqrt(GyrX * GyrX + GyrY * GyrY + GyrZ * GyrZ) AS g FROM imu),
mo AS (SELECT session_id, win, quantile_cont(abs(a - 1), 0.95) AS acc95, quantile_cont(g, 0.95) AS gyr95, stddev_pop(a) AS acc_std FROM n GROUP BY ALL),
lv AS (SELECT *, CASE WHEN acc95 > 0.5 OR gyr95 > 30 THEN 'gated' WHEN acc95 > 0.15 OR acc_std > 0.05 OR gyr95 > 15 THEN 'nlms' ELSE 'still' END AS level FROM mo)"""
_ODD = """odd AS (SELECT session_id, seq, time, AccX, AccY, AccZ, GyrX, GyrY, CASE WHEN seq % 7 <> 0 THEN GyrZ END AS GyrZ FROM imu UNION ALL SELECT session_id, seq + 5000, time, AccX + 1, AccY, AccZ, GyrX, GyrY, GyrZ FROM imu WHERE seq % 10 = 3),
ord AS (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY session_id, time ORDER BY seq) AS r FROM odd WHERE GyrZ IS NOT NULL) WHERE r = 1)"""
_AXES = ["AccX", "AccY", "AccZ", "GyrX", "GyrY", "GyrZ"]
_LEVEL = lambda c: f"CASE WHEN {c} >= 0.65 THEN 'high' WHEN {c} >= 0.4 THEN 'medium' ELSE 'low' END"
_SC = f"""a0 AS (SELECT session_id, seq AS epoch, least(value, 100) / 100.0::DOUBLE * CASE WHEN session_id % 3 = 0 THEN 2 ELSE 1 END AS s, count(*) OVER (PARTITION BY session_id) AS n FROM ku),
a1 AS (SELECT *, {_LEVEL('s')} AS level, avg(s) FILTER (epoch < n // 2) OVER (PARTITION BY session_id) AS f, avg(s) FILTER (epoch >= n // 2) OVER (PARTITION BY session_id) AS g FROM a0),
a AS (SELECT session_id, count(*) AS n, avg(s) AS m, round_even(round_even(avg(CAST(level = 'high' AS INT)), 3) + round_even(avg(CAST(level = 'medium' AS INT)), 3), 3) AS focus, regr_slope(s, epoch) AS sl, any_value(f) AS f, any_value(g) AS g FROM a1 GROUP BY 1),
ar AS (SELECT *, CASE WHEN n >= 4 AND m >= 1e-6 AND sl * n / m > 0.1 THEN 'improving' WHEN n >= 4 AND m >= 1e-6 AND sl * n / m < -0.1 THEN 'declining' ELSE 'stable' END AS trend, coalesce(n >= 10 AND f > 0.1 AND (f - g) / f > 0.15, false) AS fatigue FROM a),
l0 AS (SELECT session_id, seq AS epoch, CASE WHEN session_id % 4 = 0 THEN k / 100.0::DOUBLE ELSE 0.4 + k / 400.0::DOUBLE END AS s, k / 50.0::DOUBLE AS ci FROM ku WHERE session_id % 5 > 0),
l AS (SELECT session_id, count(*) AS n, avg(s) AS m, avg(ci) AS ci, regr_slope(s, epoch) AS sl, round_even(avg(CAST({_LEVEL('s')} = 'medium' AS INT)), 3) AS optimal, round_even(avg(CAST({_LEVEL('s')} = 'high' AS INT)), 3) AS overload, round_even(avg(CAST({_LEVEL('s')} = 'low' AS INT)), 3) AS underload FROM l0 GROUP BY 1)"""
_REQ = """rq AS (SELECT *, k % 6 AS form, min(time) OVER (PARTITION BY session_id) AS s0 FROM ku),
mk AS (SELECT session_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY seq) - 1 AS BIGINT) AS id, event_type AS content, CASE form WHEN 0 THEN s0 + k WHEN 1 THEN s0 + k WHEN 2 THEN 1704103200 + k WHEN 3 THEN epoch(TIMESTAMP '2024-01-05 10:00:00') END::DOUBLE AS start_ts,
  CASE form WHEN 0 THEN s0 + k + 7 WHEN 1 THEN s0 + k + 5 WHEN 2 THEN 1704103200 + k WHEN 3 THEN epoch(TIMESTAMP '2024-01-05 10:00:00') + k % 60 + 0.25 END::DOUBLE AS end_ts, CASE WHEN form = 2 THEN 'n' END AS note FROM rq WHERE form <> 4)"""
_TEXT = lambda c: f"strftime(make_timestamp(CAST(floor({c} * 1000000) AS BIGINT)), '%Y-%m-%d %H:%M:%S')"
_SES = f"""hd AS (SELECT session_id AS u, floor(min(time)) AS st, CASE WHEN session_id % 2 = 0 THEN floor(min(time) + 200) END AS et FROM usr GROUP BY 1), nm AS (SELECT *, CASE WHEN u % 3 > 0 THEN printf('u%05d', u) ELSE strftime(make_timestamp(CAST(st * 1000000 AS BIGINT)), '%Y%m%d_%H%M%S') END AS name FROM hd),
mc AS (SELECT session_id AS u, count(*) AS n FROM rq WHERE form <> 4 GROUP BY 1), se AS (SELECT name, st, et, coalesce(n, 0) AS n, u FROM nm LEFT JOIN mc USING (u))"""

SQL = {
    "window_peaks": V.sql("blkl", "SELECT session_id, win, round(peak, 6) AS peak, round(typical, 6) AS typical FROM pk"),
    "adaptive_thresholds": V.sql("thr", "SELECT session_id, win, round(threshold, 6) AS threshold, warmed_up, clean FROM f"),
    "blinks_repaired": _with(
        "thr",
        """w AS (SELECT b.session_id, b.win, b.seq, t.threshold, CH1, CH2, CH3, CASE WHEN b.win % 5 <> 2 OR b.seq % 16 < 1 THEN CH4 END AS CH4 FROM blk b JOIN f t ON b.session_id = t.session_id AND b.win = t.win),
lw AS (SELECT session_id, win, seq, threshold, unnest(['CH1','CH2','CH3','CH4']) AS ch, unnest([CH1, CH2, CH3, CH4]) AS v FROM w), lo AS (SELECT *, coalesce(abs(v) > threshold, false) AS o FROM lw),
ro AS (SELECT session_id, win, seq, max(CAST(o AS INT)) AS o FROM lo GROUP BY ALL), rn AS (SELECT *, max(o) OVER (PARTITION BY session_id, win ORDER BY seq ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near FROM ro), gt AS (SELECT session_id, win, max(o) > 0 AS blink FROM rn GROUP BY ALL HAVING avg(near) <= 0.3 AND sum(1 - near) >= 2),
md AS (SELECT lo.*, blink, max(CAST(o AS INT)) OVER (PARTITION BY lo.session_id, lo.win, ch ORDER BY seq ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) = 1 AS bad FROM lo JOIN gt ON lo.session_id = gt.session_id AND lo.win = gt.win),
k AS (SELECT *, session_id || '-' || win || '-' || ch AS w, CASE WHEN NOT bad THEN v END AS g, count(CASE WHEN NOT bad THEN v END) OVER (PARTITION BY session_id, win, ch) AS good FROM md), kg AS (SELECT * FROM k WHERE g IS NOT NULL),
p AS (SELECT k.*, a.seq AS i, a.g AS x FROM k ASOF LEFT JOIN kg a ON k.w = a.w AND k.seq >= a.seq), q AS (SELECT p.*, b.seq AS j, b.g AS y FROM p ASOF LEFT JOIN kg b ON p.w = b.w AND p.seq <= b.seq),
z AS (SELECT *, CASE WHEN good < 2 THEN NULL WHEN NOT bad THEN v WHEN i IS NULL THEN y WHEN j IS NULL THEN x ELSE x + (y - x) * ((seq - i) / (j - i)) END AS r FROM q)""",
        "SELECT session_id, win, seq, " + ", ".join(f"round(max(r) FILTER (ch = '{c}'), 6) AS {c}" for c in CH) + ", any_value(blink) AS blink_detected FROM z GROUP BY session_id, win, seq",
    ),
    "blink_gate_mixed": _with(
        "blk", "o AS (SELECT session_id, win, seq, CAST(coalesce(greatest(abs(CH1), abs(CH2), abs(CH3), abs(CH4)) > 140, false) AS INT) AS f FROM blk), k AS (SELECT *, max(f) OVER (PARTITION BY session_id, win ORDER BY seq ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) AS m FROM o)",
        "SELECT session_id, win, max(f) > 0 AS blink_detected, round(avg(m), 6) AS contamination, avg(m) <= 0.3 AND sum(1 - m) >= 2 AS kept FROM k GROUP BY ALL",
    ),
    "imu_of_windows": _with("imu", "w AS (SELECT session_id, seq // 60 AS win, min(time) AS t0, max(time) AS t1 FROM imu GROUP BY ALL)", "SELECT w.session_id, win, count(*) AS n, round(min(time), 6) AS first, round(max(time), 6) AS last FROM w JOIN imu i ON w.session_id = i.session_id AND time >= t0 - 0.1::DOUBLE AND time <= t1 + 0.1::DOUBLE GROUP BY ALL"),
    "motion_gated": _with("imu", _LV, "SELECT session_id, win, CASE WHEN win % 4 > 0 THEN level END AS level FROM lv WHERE win % 4 = 0 OR level <> 'gated'"),
    "ordered_imu": _with("imu", _ODD, "SELECT session_id, seq, round(time, 6) AS time, " + ", ".join(f"round({a}, 6) AS {a}" for a in _AXES) + " FROM ord"),
    "resampled_linear": _with(
        "sig imu", _ODD + ", t AS (SELECT session_id, seq, time / 2.0137::DOUBLE - 0.0513::DOUBLE AS time FROM sig), p AS (SELECT t.*, " + ", ".join(f"o.{a} AS a_{a}" for a in ["time", *_AXES]) + " FROM t ASOF LEFT JOIN ord o ON t.session_id = o.session_id AND t.time >= o.time), q AS (SELECT p.*, " + ", ".join(f"o.{a} AS b_{a}" for a in ["time", *_AXES]) + " FROM p ASOF LEFT JOIN ord o ON p.session_id = o.session_id AND p.time <= o.time)",
        "SELECT session_id, seq, round(time, 6) AS time, " + ", ".join(f"round(CASE WHEN a_time IS NULL THEN b_{a} WHEN b_time IS NULL THEN a_{a} WHEN b_time > a_time THEN a_{a} + (b_{a} - a_{a}) * (time - a_time) / (b_time - a_time) ELSE a_{a} END, 6) AS {a}" for a in _AXES) + " FROM q",
    ),
    "baseline_quality": """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE))) AS v FROM embeddings),
s AS (SELECT vec_id, CASE WHEN vec_id % 5 > 0 THEN vec_id % 50 END AS sec, vec_id % 13 > 0 AS known, CASE WHEN vec_id % 11 = 3 THEN [0.0::DOUBLE / 0, 0, 0, 0] ELSE [v[1] + 1, v[6] + 1, v[11] + 1, v[16] + 1] END AS d0, v[21] AS t1 FROM e),
d AS (SELECT *, CASE WHEN vec_id % 3 = 0 THEN list_concat([9.0::DOUBLE], d0[2:4]) ELSE d0 END AS d FROM (SELECT *, vec_id % 11 = 3 AS bad FROM s)),
h AS (SELECT *, list_filter([CASE WHEN d[1] > (d[2] + d[3] + d[4]) / 3 * 3 THEN 'imbalance CH1' END, CASE WHEN d[2] > (d[1] + d[3] + d[4]) / 3 * 3 THEN 'imbalance CH2' END, CASE WHEN d[3] > (d[1] + d[2] + d[4]) / 3 * 3 THEN 'imbalance CH3' END, CASE WHEN d[4] > (d[1] + d[2] + d[3]) / 3 * 3 THEN 'imbalance CH4' END], lambda x: x IS NOT NULL) AS heavy FROM d),
g AS (SELECT vec_id, array_to_string(list_concat(CASE WHEN sec < 15 THEN ['too short'] ELSE [] END, CASE WHEN NOT known THEN ['no covariance'] WHEN bad THEN ['covariance not finite'] ELSE heavy END, CASE WHEN vec_id % 7 = 1 THEN ['threshold not finite'] ELSE [] END), ',') AS errors,
  array_to_string(list_concat(CASE WHEN sec >= 15 AND sec < 30 THEN ['short'] ELSE [] END, CASE WHEN vec_id % 7 = 0 THEN ['extreme threshold'] ELSE [] END), ',') AS warns FROM h)
SELECT vec_id, errors = '' AS ok, errors, warns FROM g""",
    "optical_windows": _with(
        "ppg", "r AS (SELECT session_id, seq, time, ir - ambient AS ir, red - ambient AS red, max(seq) OVER (PARTITION BY session_id) AS last FROM ppg), t AS (SELECT r.*, unnest(range(seq // 64, (seq + 64) // 64 + 1)) AS tick FROM r)",
        "SELECT session_id, tick, count(*) AS n, round(count(*) / (max(time) - min(time)), 5) AS rate, round(avg(ir), 5) AS ir_dc, round(avg(red), 5) AS red_dc FROM t WHERE (tick + 1) * 64 - 1 <= last GROUP BY ALL HAVING count(*) >= 64",
    ),
    "saturation_smoothed": _with(
        "ku", "s AS (SELECT session_id, seq AS tick, CASE WHEN k % 6 > 0 THEN value END AS spo2 FROM ku), r AS (SELECT *, count(spo2) OVER (PARTITION BY session_id ORDER BY tick) AS c FROM s), v AS (SELECT session_id, c, spo2 FROM r WHERE spo2 IS NOT NULL)",
        "SELECT r.session_id, tick, round(any_value(r.spo2), 5) AS spo2, round(avg(v.spo2), 5) AS spo2_smooth FROM r LEFT JOIN v ON r.session_id = v.session_id AND v.c <= r.c AND v.c > r.c - 8 GROUP BY r.session_id, tick",
    ),
    "history_load": V.sql("usr", "SELECT session_id, seq, round(time, 3) AS time, round(value, 3) AS value, strftime(make_timestamp(CAST(floor(time * 1000000) AS BIGINT)), '%H:%M:%S.%g') AS clock FROM (SELECT *, count(*) OVER (PARTITION BY session_id) AS n, row_number() OVER (PARTITION BY session_id ORDER BY seq) - 1 AS i FROM usr WHERE time BETWEEN 1704500000 AND 1706000000) WHERE n <= 20 OR list_contains(list_transform(range(0, 20), lambda k: round_even(k * ((n - 1) / 19.0::DOUBLE), 0)), i)"),
    "ring_snapshot": V.sql("usr", "SELECT session_id, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY seq) AS events FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) AS r FROM usr) WHERE r <= 7 GROUP BY 1"),
    "latest_values": V.sql("usr", "SELECT session_id, round(max_by(value, seq), 6) AS value, max_by(event_type, seq) AS event_type FROM usr GROUP BY 1"),
    "band_series": V.sql("bands", "SELECT session_id, epoch, round(max(delta) FILTER (ch = 'CH1'), 6) AS delta1, round(max(theta) FILTER (ch = 'CH2'), 6) AS theta2, round(max(gamma) FILTER (ch = 'CH4'), 6) AS gamma4 FROM bp GROUP BY ALL"),
    "load_summaries": _with("ku", _SC, "SELECT session_id, round(round_even(m, 3), 5) AS mean_score, optimal, overload, underload, CASE WHEN n >= 4 AND m >= 1e-6 AND sl * n / m > 0.1 THEN 'improving' WHEN n >= 4 AND m >= 1e-6 AND sl * n / m < -0.1 THEN 'declining' ELSE 'stable' END AS trend, round_even(CASE WHEN n >= 4 THEN sl ELSE 0 END, 5) AS slope, round_even(ci, 3) AS mean_ci, n FROM l"),
    "joint_reports": _with(
        "ku", _SC + """, j AS (SELECT ar.session_id, ar.n, focus, trend, fatigue, optimal, overload, underload, round_even(CASE WHEN optimal IS NULL THEN focus ELSE greatest(0, least(1, focus * (0.5 + optimal) - overload * 0.5)) END, 3) AS e FROM ar LEFT JOIN l USING (session_id)),
w AS (SELECT x.session_id, x.epoch FROM a1 x JOIN a1 y ON x.session_id = y.session_id AND x.epoch >= greatest(3, x.n // 10) AND y.epoch < x.epoch AND y.epoch >= x.epoch - greatest(3, x.n // 10) GROUP BY x.session_id, x.epoch, x.f HAVING avg(y.s) < 0.85 * x.f),
u AS (SELECT session_id, min(epoch) AS first FROM w GROUP BY 1), k AS (SELECT j.*, round_even(first / n, 2) AS onset FROM j LEFT JOIN u USING (session_id))""",
        """SELECT session_id, round(focus, 6) AS focus, round(optimal, 6) AS optimal, fatigue, round(e, 6) AS efficiency, CASE WHEN e >= 0.7 THEN 'excellent' WHEN e >= 0.5 THEN 'good' WHEN e >= 0.3 THEN 'fair' ELSE 'poor' END AS grade,
coalesce(nullif(concat_ws(',', CASE WHEN focus >= 0.8 THEN 'attention:good' END, CASE WHEN focus < 0.5 THEN 'attention:warning' END, CASE WHEN trend = 'declining' THEN 'attention:warning' END, CASE WHEN trend = 'improving' THEN 'attention:good' END, CASE WHEN overload > 0.4 THEN 'cognitive_load:warning' WHEN underload > 0.4 THEN 'cognitive_load:info' END, CASE WHEN optimal >= 0.5 THEN 'cognitive_load:good' END, CASE WHEN fatigue THEN 'fatigue:warning' END), ''), 'general:info') AS rules,
coalesce(nullif(concat_ws(' ', CASE WHEN focus >= 0.8 THEN 'Focused in ' || round_even(focus * 100, 0)::INT || '% of the epochs.' END, CASE WHEN focus < 0.5 THEN 'Focused in only ' || round_even(focus * 100, 0)::INT || '% of the epochs: shorter blocks with pauses may help.' END,
 CASE WHEN trend = 'declining' THEN 'Attention falls over the recording: put the hardest part first.' END, CASE WHEN trend = 'improving' THEN 'Attention rises over the recording.' END,
 CASE WHEN overload > 0.4 THEN 'Load is high in ' || round_even(overload * 100, 0)::INT || '% of the epochs: split the task or lower its difficulty.' WHEN underload > 0.4 THEN 'Load is low in ' || round_even(underload * 100, 0)::INT || '% of the epochs: the task can be harder.' END,
 CASE WHEN optimal >= 0.5 THEN 'Load is in the middle range in ' || round_even(optimal * 100, 0)::INT || '% of the epochs.' END,
 CASE WHEN fatigue THEN 'Signs of fatigue ' || coalesce('from minute ' || printf('%.1f', round_even(onset * n / 60, 1)) || ' on (' || round_even(onset * 100, 0)::INT || '% of the recording)', 'in the second half') || ': plan a pause before it.' END), ''), 'Too few epochs for advice.') AS messages FROM k""",
    ),
    "attention_summaries": _with(
        "ku", _SC + ", g AS (SELECT session_id, max(s) AS m, round_even(avg(CAST(level = 'high' AS INT)), 3) AS high_share, round_even(avg(CAST(level = 'low' AS INT)), 3) AS low_share FROM a1 GROUP BY 1), e AS (SELECT session_id, round_even(avg(k / 40.0::DOUBLE), 3) AS ei, round_even(avg(value / 30.0::DOUBLE), 3) AS tar FROM ku WHERE session_id % 7 > 0 GROUP BY 1)",
        "SELECT session_id, n, round(g.m, 4) AS max_score, round(high_share, 4) AS high_share, round(low_share, 4) AS low_share, trend, round(focus, 4) AS focus, round(ei, 4) AS ei, round(tar, 4) AS tar FROM ar JOIN g USING (session_id) LEFT JOIN e USING (session_id)",
    ),
    "session_reports": V.sql("ku", "SELECT session_id, least(count(*), 50) AS n_attention, CASE WHEN session_id % 5 > 0 THEN least(count(*), 50) ELSE 0 END AS n_load, count(*) AS n_markers FROM ku GROUP BY 1"),
    "parsed_markers": _with("ku", _REQ, f"SELECT session_id, id, content, round(start_ts, 3) AS start_ts, round(end_ts, 3) AS end_ts, {_TEXT('start_ts')} AS start_str, round(round_even(end_ts - start_ts, 3), 3) AS duration_s, note FROM mk"),
    "marker_sessions": _with("ku", _REQ + ", " + _SES, f"SELECT name AS session_id, {_TEXT('st')} AS start_time, {_TEXT('et')} AS end_time, round(et - st, 3) AS duration_seconds, n AS marker_count, CAST(2 AS BIGINT) AS received FROM se"),
    "markers_appended": _with(
        "ku", _REQ + ", " + _SES + ", ad AS (SELECT printf('u%05d', session_id) AS name, event_type, form <> 4 AS ok FROM rq WHERE seq = 0), lt AS (SELECT session_id AS u, max_by(event_type, seq) AS last FROM rq WHERE form <> 4 GROUP BY 1), al AS (SELECT coalesce(se.name, ad.name) AS name, coalesce(n, 0) AS n, coalesce(ok, false) AS ok, event_type, last FROM se FULL JOIN ad ON se.name = ad.name LEFT JOIN lt ON se.u = lt.u)",
        "SELECT name AS session_id, n + CAST(ok AS BIGINT) AS marker_count, nullif(n + CAST(ok AS BIGINT) - 1, -1) AS last_id, CASE WHEN ok THEN event_type ELSE last END AS last FROM al UNION ALL SELECT 'zz', 1, 0, 'new'",
    ),
    "session_times_patched": _with(
        "ku", _REQ + ", " + _SES + ", pt AS (SELECT *, n % 2 = 0 AS p, CASE WHEN n % 2 = 0 THEN epoch(TIMESTAMP '2024-02-01') ELSE st END AS s2, CASE WHEN n % 2 = 0 AND et IS NULL THEN epoch(TIMESTAMP '2024-02-01') + 100 ELSE et END AS e2 FROM se WHERE name LIKE 'u%')",
        f"SELECT name AS session_id, {_TEXT('s2')} AS start_time, {_TEXT('e2')} AS end_time, round(e2 - s2, 3) AS duration_seconds, n AS marker_count FROM pt",
    ),
    "recordings_matched": _with(
        "usr", "u AS (SELECT session_id AS u, min(time) AS start FROM usr GROUP BY 1), m AS (SELECT printf('n%05d', u) AS id, start + 90000 AS t FROM u WHERE u % 4 = 0 UNION ALL SELECT printf('m%05d', u), start + u % 7 * 60 FROM u)",
        "SELECT printf('n%05d', u) AS session_id, round(start, 3) AS start, coalesce(max(m.id) FILTER (m.id = printf('n%05d', u)), max(m.id) FILTER (abs(m.t - start) < 300)) AS marker_session FROM u LEFT JOIN m ON abs(m.t - start) < 300 OR m.id = printf('n%05d', u) GROUP BY u, start",
    ),
    "streamed_epochs": V.sql("ep", "SELECT session_id, epoch, ch, round(min(time), 6) AS timestamp, count(*) AS n, round(min_by(value, i), 6) AS first, round(max_by(value, i), 6) AS last FROM ep WHERE n = 32 GROUP BY ALL"),
    "streamed_attention": V.sql("att", "SELECT session_id, epoch, round(attention_score, 6) AS attention_score, round(engagement_index, 6) AS engagement_index, level FROM att"),
    "streamed_downsample": V.sql("sig", "SELECT session_id, seq, round(CH1, 6) AS CH1 FROM sig WHERE seq % 16 = 0"),
}
_GREEDY = """WITH RECURSIVE u AS (SELECT printf('s%05d', user_id) AS session, user_id % 6 AS r, min(epoch_us(ts) / 1e6::DOUBLE) AS start FROM events GROUP BY user_id), o AS (SELECT *, row_number() OVER (ORDER BY r, session) AS i FROM u),
g AS (SELECT i, session, r, start, session AS canonical, [{'s': session, 't': start}] AS held FROM o WHERE i = 1
  UNION ALL SELECT i, session, r, start, coalesce(hit.s, session), CASE WHEN hit IS NULL THEN list_append(held, {'s': session, 't': start}) ELSE held END
  FROM (SELECT o.*, held, list_filter(held, lambda x: abs(x.t - o.start) < 3600)[1] AS hit FROM g JOIN o ON o.i = g.i + 1)),
kinds AS (SELECT *, ['raw', 'processed', 'features', 'attention', 'cognitive_load', 'imu'][r + 1] AS kind FROM g)"""
SQL["canonical_sessions"] = _GREEDY + " SELECT session, kind, round(start, 3) AS start, canonical FROM kinds"
SQL["canonical_catalogue"] = _GREEDY + f" SELECT canonical, string_agg(DISTINCT kind, ',' ORDER BY kind) AS types, {_TEXT('min(round(start, 3))')} AS start_text, {_TEXT('max(round(start, 3) + 60)')} AS end_text, canonical AS display FROM kinds GROUP BY 1"
