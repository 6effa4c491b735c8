"""Queries of cleaning, quality, times and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import clean, quality, report, timebase
from ..operators import features as feat
from ..sources import segments
from . import views as V
from .feature_queries import attention_level, rounded

CH = ["CH1", "CH2", "CH3", "CH4"]
BY_EPOCH = ("session_id", "epoch", "ch")


def _epoch():
    return F.floor(F.col("seq") / 32).cast("bigint")


def _long(spark, d) -> DataFrame:
    return feat.to_long(V.sig_wide(spark, d, 32.0)).withColumn("epoch", _epoch())


def _gaps(spark, d) -> DataFrame:
    return feat.to_long(V.sig_gaps(spark, d))


def _levels(spark, d) -> DataFrame:
    return quality.motion(V.imu(spark, d).withColumn("win", F.floor(F.col("seq") / 52).cast("bigint")), ["session_id", "win"])


def effective_rate(spark, d):
    return V.sig_user(spark, d).groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.round(clean.sample_rate(), 9).alias("fs"))


def drop_empty_rows(spark, d):
    """Every seventh sample has no channel."""
    gaps = V.sig_gaps(spark, d)
    return rounded(clean.drop_empty(gaps.withColumns({c: F.when(F.col("seq") % 7 > 0, F.col(c)) for c in CH}), CH))


def baseline_corrected(spark, d):
    return rounded(clean.baseline(_long(spark, d), 32.0, keys=BY_EPOCH).select("session_id", "epoch", "ch", "seq", "value"))


def gaps_filled(spark, d):
    return rounded(clean.fill_gaps(clean.outliers_to_null(_gaps(spark, d), 200.0)).select("session_id", "ch", "seq", "value"))


def scaled(spark, d):
    return rounded(_long(spark, d).select("session_id", "epoch", "ch", "seq", clean.min_max(keys=BY_EPOCH).alias("min_max"), clean.z_score(keys=BY_EPOCH).alias("z_score")))


def dead_channels_repaired(spark, d):
    """CH2 has no samples in every third epoch."""
    wide = V.sig_wide(spark, d).withColumn("epoch", _epoch()).withColumn("CH2", F.when(F.col("epoch") % 3 != 0, F.col("CH2")))
    return rounded(clean.repair_dead(wide, CH, ("session_id", "epoch")).select("session_id", "seq", *CH))


def zero_phase_filter(spark, d):
    return rounded(clean.filter_windows(V.sig_wide(spark, d, 256.0), 256.0, CH, ("session_id",)), 4)


def channel_quality(spark, d):
    return rounded(quality.assess(_long(spark, d), ["session_id", "epoch", "ch"]))


def blink_windows(spark, d):
    wide = V.sig_gaps(spark, d).withColumn("win", F.floor(F.col("seq") / 256).cast("bigint"))
    return rounded(quality.blink_gate(wide, CH, 256.0, ("session_id", "win")))


def motion_levels(spark, d):
    return rounded(_levels(spark, d))


def gated_window_runs(spark, d):
    """Quarter windows, so that four in a row are gated."""
    levels = quality.motion(V.imu(spark, d).withColumn("win", F.floor(F.col("seq") / 13).cast("bigint")), ["session_id", "win"])
    return quality.gated_runs(levels).select("session_id", "win", "level", "run", "reset")


def packets_to_samples(spark, d):
    e = V.table(spark, d, "events").withColumn("packet", F.floor(F.col("event_id") / 12).cast("bigint"))
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    p = e.groupBy("packet").agg(F.lit(0).cast("bigint").alias("session_id"), F.max(t).alias("ts"), F.transform(F.array_sort(F.collect_list(F.struct("event_id", "value"))), lambda s: s["value"]).alias("samples"))
    return rounded(timebase.packet_samples(p, 256.0).select("packet", F.col("i").cast("bigint").alias("i"), "time", "value"), 4)


def dejittered(spark, d):
    return V.sig_user(spark, d).transform(timebase.dejitter, 16).select("session_id", "seq", F.round("time", 3).alias("time"))


def downsampled(spark, d):
    return rounded(timebase.downsample(V.sig_user(spark, d), 20).select("session_id", "seq", "value"))


def session_catalogue(spark, d):
    u = V.sig_user(spark, d).groupBy("session_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("types"), F.min("time").alias("a"), F.max("time").alias("b"))
    return u.select("session_id", "types", X.date_text(F.col("a")).alias("start_text"), X.date_text(F.col("b")).alias("end_text"))


def neighbouring_sessions(spark, d):
    u = V.sig_user(spark, d).groupBy(F.col("session_id").alias("session")).agg(F.min("time").alias("start"))
    return timebase.near_sessions(u, u, 3600.0).filter("session < other").select("session", "other", F.round("delta", 3).alias("delta"))


def segment_index(spark, d):
    return segments.with_segment(V.sig_user(spark, d), 30).groupBy("session_id", "segment").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"))


def marker_intervals(spark, d):
    found = timebase.in_intervals(V.sig_user(spark, d).select("session_id", "time", "value"), V.markers(spark, d).select("session_id", "id", "start_ts", "end_ts"), 120.0)
    return found.groupBy("session_id", "id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean_value"))


def optical_ratio(spark, d):
    """SpO2 by windows of 640 samples, ambient light taken off."""
    p = V.ppg(spark, d).select("session_id", F.floor(F.col("seq") / 640).cast("bigint").alias("win"), (F.col("ir") - F.col("ambient")).alias("ir"), (F.col("red") - F.col("ambient")).alias("red"))
    m = p.groupBy("session_id", "win").agg(*(f(c).alias(f"{c}_{k}") for c in ("ir", "red") for k, f in (("ac", F.stddev_pop), ("dc", F.avg))))
    r = F.try_divide(F.try_divide(F.col("red_ac"), F.col("red_dc")), F.try_divide(F.col("ir_ac"), F.col("ir_dc")))
    return m.select("session_id", "win", F.round(100.67 - 9.14 * F.abs(r), 3).alias("spo2"))


def attention_report(spark, d):
    out = report.with_grade(report.summary(attention_level(spark, d), "attention_score"))
    return rounded(out, 5)


def report_advice(spark, d):
    out = report.recommendations(report.with_grade(report.summary(attention_level(spark, d), "attention_score")))
    return out.select("session_id", F.to_json("recommendations").alias("advice"))


def fatigue_onset(spark, d):
    u = V.sig_user(spark, d).select("session_id", "seq", (F.col("value") / 100).alias("score"))
    return rounded(report.fatigue(u, "score", order="seq"), 5)


QUERIES = {f.__name__: f for f in (effective_rate, drop_empty_rows, baseline_corrected, gaps_filled, scaled, dead_channels_repaired, zero_phase_filter, channel_quality, blink_windows, motion_levels, gated_window_runs, packets_to_samples, dejittered, downsampled, session_catalogue, neighbouring_sessions, segment_index, marker_intervals, optical_ratio, attention_report, report_advice, fatigue_onset)}

_E = "e AS (SELECT session_id, seq // 32 AS epoch, ch, seq, value FROM long)"
_MOTION = """n AS (SELECT session_id, seq // 52 AS win, sqrt(AccX * AccX + AccY * AccY + AccZ * AccZ) AS a, sqrt(GyrX * GyrX + GyrY * GyrY + GyrZ * GyrZ) AS g FROM imu),
m AS (SELECT session_id, win, quantile_cont(abs(a - 1), 0.95) AS acc95, quantile_cont(g, 0.95) AS gyr95, stddev_pop(a) AS acc_std FROM n GROUP BY ALL),
lv AS (SELECT *, CASE WHEN acc95 > 0.5 OR gyr95 > 30 THEN 'gated' WHEN acc95 > 0.15 OR acc_std > 0.05 OR gyr95 > 15 THEN 'nlms' ELSE 'still' END AS level FROM m)"""
_SUMMARY = """i AS (SELECT *, round(attention_score, 6) AS s, CAST(row_number() OVER (PARTITION BY session_id ORDER BY epoch) - 1 AS DOUBLE) AS x FROM att),
g AS (SELECT session_id, count(*) AS n, avg(s) AS mean_score, max(s) AS max_score, round_even(avg(CAST(level = 'high' AS INT)), 3) AS high_share, round_even(avg(CAST(level = 'medium' AS INT)), 3) AS medium_share, round_even(avg(CAST(level = 'low' AS INT)), 3) AS low_share, regr_slope(s, x) AS sl FROM i GROUP BY ALL),
h AS (SELECT session_id, n, mean_score, max_score, high_share, medium_share, low_share, CASE WHEN n >= 4 THEN sl ELSE 0 END AS slope, CASE WHEN n >= 4 AND mean_score >= 1e-6 AND sl * n / mean_score > 0.1 THEN 'improving' WHEN n >= 4 AND mean_score >= 1e-6 AND sl * n / mean_score < -0.1 THEN 'declining' ELSE 'stable' END AS trend, round_even(high_share + medium_share, 3) AS focus FROM g)"""


def _with(names: str, ctes: str, body: str) -> str:
    """A query over views and further common table expressions."""
    return f"{V.sql(names, '@').rsplit(' @', 1)[0]}, {ctes} {body}"


SQL = {
    "effective_rate": V.sql("usr", "SELECT session_id, count(*) AS n, round((count(*) - 1) / nullif(max_by(time, seq) - min_by(time, seq), 0), 9) AS fs FROM usr GROUP BY 1"),
    "drop_empty_rows": V.sql("gaps", "SELECT session_id, seq, round(time, 6) AS time, round(CH1, 6) AS CH1, round(CH2, 6) AS CH2, round(CH3, 6) AS CH3, round(CH4, 6) AS CH4 FROM gaps WHERE seq % 7 > 0 AND coalesce(CH1, CH2, CH3, CH4) IS NOT NULL"),
    "baseline_corrected": _with("long", _E, "SELECT session_id, epoch, ch, seq, round(value - avg(value) FILTER (seq % 32 < 6) OVER (PARTITION BY session_id, epoch, ch), 6) AS value FROM e"),
    "gaps_filled": _with(
        "glong",
        "c AS (SELECT session_id, ch, seq, CASE WHEN abs(value) <= 200 THEN value END AS v FROM glong), k AS (SELECT * FROM c WHERE v IS NOT NULL), p AS (SELECT c.*, a.seq AS i, a.v AS x FROM c ASOF LEFT JOIN k a ON c.session_id = a.session_id AND c.ch = a.ch AND c.seq >= a.seq), q AS (SELECT p.*, b.seq AS j, b.v AS y FROM p ASOF LEFT JOIN k b ON p.session_id = b.session_id AND p.ch = b.ch AND p.seq <= b.seq)",
        "SELECT session_id, ch, seq, round(coalesce(v, CASE WHEN i IS NULL THEN y WHEN j IS NULL THEN x ELSE x + (y - x) * ((seq - i) / (j - i)) END), 6) AS value FROM q",
    ),
    "scaled": _with("long", _E, "SELECT session_id, epoch, ch, seq, round((value - min(value) OVER w) / nullif(max(value) OVER w - min(value) OVER w, 0), 6) AS min_max, round((value - avg(value) OVER w) / nullif(stddev_samp(value) OVER w, 0), 6) AS z_score FROM e WINDOW w AS (PARTITION BY session_id, epoch, ch)"),
    "dead_channels_repaired": V.sql("sig", "SELECT session_id, seq, round(CH1, 6) AS CH1, round(CASE WHEN (seq // 32) % 3 = 0 THEN (CH1 + CH3) / 2 ELSE CH2 END, 6) AS CH2, round(CH3, 6) AS CH3, round(CH4, 6) AS CH4 FROM sig"),
    "channel_quality": _with(
        "long", _E + ", a AS (SELECT session_id, epoch, ch, avg(CAST(value <= 1 OR value >= 1449 AS INT)) AS s, stddev_pop(value) < 1 AS flatline FROM e GROUP BY ALL)",
        "SELECT session_id, epoch, ch, round(s, 6) AS sat_rate, flatline, 0.0::DOUBLE AS hf_ratio, CASE WHEN flatline OR s > 0.1 THEN 'bad' WHEN s > 0.05 THEN 'poor' ELSE 'good' END AS quality, CASE WHEN flatline THEN 'flatline' WHEN s > 0.05 THEN printf('sat=%.1f%%', s * 100) ELSE '' END AS reason FROM a",
    ),
    "blink_windows": _with(
        "gaps", "o AS (SELECT session_id, seq // 256 AS win, seq, CAST(coalesce(greatest(CH1, CH2, CH3, CH4) > 200, false) AS INT) AS f FROM gaps), k AS (SELECT *, max(f) OVER (PARTITION BY session_id, win ORDER BY seq ROWS BETWEEN 25 PRECEDING AND 25 FOLLOWING) AS m FROM o)",
        "SELECT session_id, win, max(f) > 0 AS blink_detected, round(avg(m), 6) AS contamination, avg(m) <= 0.3 AND sum(1 - m) >= 2 AS kept FROM k GROUP BY ALL",
    ),
    "motion_levels": _with("imu", _MOTION, "SELECT session_id, win, round(acc95, 6) AS acc95, round(gyr95, 6) AS gyr95, round(acc_std, 6) AS acc_std, level FROM lv"),
    "gated_window_runs": _with(
        "imu", _MOTION.replace("// 52 AS win", "// 13 AS win") + ", b AS (SELECT *, count(*) FILTER (level <> 'gated') OVER (PARTITION BY session_id ORDER BY win) AS island FROM lv), r AS (SELECT *, count(*) FILTER (level = 'gated') OVER (PARTITION BY session_id, island ORDER BY win) AS run FROM b)",
        "SELECT session_id, win, level, run, run >= 3 AS reset FROM r",
    ),
    "packets_to_samples": "WITH e AS (SELECT event_id // 12 AS packet, value, epoch_us(ts) / 1e6::DOUBLE AS t, row_number() OVER (PARTITION BY event_id // 12 ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY event_id // 12) AS n FROM events) SELECT packet, i, round(max(t) OVER (PARTITION BY packet) - (n - 1 - i) / 256.0::DOUBLE, 4) AS time, round(value, 4) AS value FROM e",
    "dejittered": _with(
        "usr", "c AS (SELECT *, seq // 16 AS k, time - min(time) OVER (PARTITION BY session_id, seq // 16) AS t, min(time) OVER (PARTITION BY session_id, seq // 16) AS t0 FROM usr), r AS (SELECT *, count(*) OVER w AS n, avg(t) OVER w AS mt, avg(seq) OVER w AS mx, covar_pop(t, seq) OVER w AS cv, var_pop(seq) OVER w AS vx FROM c WINDOW w AS (PARTITION BY session_id, k))",
        "SELECT session_id, seq, round(CASE WHEN n > 1 THEN t0 + mt + cv / vx * (seq - mx) ELSE time END, 3) AS time FROM r",
    ),
    "downsampled": V.sql("usr", "SELECT session_id, seq, round(value, 6) AS value FROM (SELECT *, count(*) OVER (PARTITION BY session_id) AS n FROM usr) WHERE n <= 20 OR list_contains(list_transform(range(0, 20), lambda k: round_even(k * ((n - 1) / 19.0::DOUBLE), 0)), seq)"),
    "session_catalogue": "SELECT user_id AS session_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS types, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start_text, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS end_text FROM events GROUP BY 1",
    "neighbouring_sessions": V.sql("usr", "SELECT a.s AS session, b.s AS other, round(b.t - a.t, 3) AS delta FROM (SELECT session_id AS s, min(time) AS t FROM usr GROUP BY 1) a JOIN (SELECT session_id AS s, min(time) AS t FROM usr GROUP BY 1) b ON a.s < b.s AND abs(a.t - b.t) < 3600"),
    "segment_index": V.sql("usr", "SELECT session_id, seq // 30 + 1 AS segment, count(*) AS n, min(seq) AS first FROM usr GROUP BY ALL"),
    "marker_intervals": V.sql("usr mrk", "SELECT m.session_id, m.id, count(*) AS n, round(avg(u.value), 6) AS mean_value FROM mrk m JOIN usr u ON m.session_id = u.session_id AND u.time >= start_ts AND u.time < end_ts GROUP BY ALL"),
    "optical_ratio": V.sql("ppg", "SELECT session_id, seq // 640 AS win, round(100.67 - 9.14 * abs((stddev_pop(red - ambient) / avg(red - ambient)) / (stddev_pop(ir - ambient) / avg(ir - ambient))), 3) AS spo2 FROM ppg GROUP BY ALL"),
    "attention_report": _with("att", _SUMMARY, "SELECT session_id, n, round(mean_score, 5) AS mean_score, round(max_score, 5) AS max_score, high_share, medium_share, low_share, round(slope, 5) AS slope, trend, focus, focus AS efficiency, CASE WHEN focus >= 0.7 THEN 'excellent' WHEN focus >= 0.5 THEN 'good' WHEN focus >= 0.3 THEN 'fair' ELSE 'poor' END AS grade FROM h"),
    "report_advice": _with("att", _SUMMARY, """SELECT session_id, '[' || coalesce(nullif(concat_ws(',', CASE WHEN focus >= 0.8 THEN '{"type":"focus","level":"good"}' END, CASE WHEN focus < 0.5 THEN '{"type":"focus","level":"warning"}' END, CASE WHEN trend = 'declining' THEN '{"type":"trend","level":"warning"}' END, CASE WHEN trend = 'improving' THEN '{"type":"trend","level":"good"}' END), ''), '{"type":"general","level":"info"}') || ']' AS advice FROM h"""),
    "fatigue_onset": _with(
        "usr", """a AS (SELECT session_id, seq, value / 100 AS s, count(*) OVER (PARTITION BY session_id) AS n FROM usr),
b AS (SELECT *, avg(s) FILTER (seq < n // 2) OVER (PARTITION BY session_id) AS f, avg(s) FILTER (seq >= n // 2) OVER (PARTITION BY session_id) AS g FROM a),
o AS (SELECT x.session_id, x.seq FROM b x JOIN b y ON x.session_id = y.session_id AND x.seq >= greatest(3, x.n // 10) AND y.seq < x.seq AND y.seq >= x.seq - greatest(3, x.n // 10) GROUP BY x.session_id, x.seq, x.f HAVING avg(y.s) < 0.85 * x.f),
t AS (SELECT session_id, any_value(n) AS n, any_value(f) AS f, any_value(g) AS g FROM b GROUP BY 1), u AS (SELECT session_id, min(seq) AS k FROM o GROUP BY 1)""",
        "SELECT session_id, n, round(f, 5) AS first_half, round(g, 5) AS second_half, coalesce(n >= 10 AND f > 0.1 AND (f - g) / f > 0.15, false) AS fatigue, CASE WHEN n >= 10 AND f > 0.1 AND (f - g) / f > 0.15 THEN round_even(k / n, 2) END AS onset FROM t LEFT JOIN u USING (session_id)",
    ),
}
