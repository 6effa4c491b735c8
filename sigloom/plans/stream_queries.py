"""Queries of live steps: each replays a view in micro-batches that are cut at odd places, and is held against the batch form's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import quality
from ..sources.segments import scratch
from ..streaming import recordings, states
from . import views as V
from .artifact_queries import SQL as _ARTIFACT
from .feature_queries import rounded
from .recording_queries import SQL as _RECORDING
from .signal_queries import CH, _with
from .signal_queries import SQL as _SIGNAL


def _replay(spark, rows: DataFrame, order: str, cuts: list, run) -> DataFrame | None:
    """A view as a stream, one micro-batch up to each cut of ``order``."""
    at = F.col(order)
    parts = [rows.filter((F.lit(True) if low is None else at >= low) & (F.lit(True) if high is None else at < high)) for low, high in zip([None, *cuts], [*cuts, None])]
    return recordings.replayed(parts, scratch(spark, "replay"), run)


def _done(spark, rows: DataFrame, order: str, cuts: list, step) -> DataFrame:
    out, checkpoint = scratch(spark, "live"), scratch(spark, "checkpoint")
    return _replay(spark, rows, order, cuts, lambda stream: recordings.run_available(step(stream), out, checkpoint))


def live_thresholds(spark, d):
    """Peaks of windows as they fill up, then the threshold from the clean ones before: two states in one stream."""
    rows = V.blinks(spark, d).select("session_id", "seq", *CH)
    out = _done(spark, rows, "seq", [131, 517], lambda stream: states.adaptive_thresholds(states.window_peaks(stream, 16, CH)))
    return rounded(out.select("session_id", "win", "threshold", "warmed_up", "clean"))


_LEVELS = ["still", "nlms", "nlms", "gated", "gated", "gated"]


def live_motion_filter(spark, d):
    """The adaptive filter on two axes and two taps; weights start anew after three gated windows."""
    level = F.element_at(F.array(*(F.lit(v) for v in _LEVELS)), (F.col("win") % 6 + 1).cast("int"))
    rows = V.sig_wide(spark, d).select("session_id", "seq", "CH1", "CH2").join(V.imu(spark, d).select("session_id", "seq", "AccX", "GyrX"), ["session_id", "seq"])
    rows = rows.withColumn("win", F.floor(F.col("seq") / 32).cast("bigint")).withColumn("level", level)
    return rounded(_done(spark, rows, "seq", [75, 410], lambda stream: states.adaptive_filter(stream, ["CH1", "CH2"], ["AccX", "GyrX"], taps=2)), 5)


def live_gated_runs(spark, d):
    levels = quality.motion(V.imu(spark, d).withColumn("win", F.floor(F.col("seq") / 13).cast("bigint")), ["session_id", "win"])
    return _done(spark, levels.select("session_id", "win", "level"), "win", [5, 38], states.gated_runs)


def live_smoothing(spark, d):
    """Trailing means of three; every ninth kind of row is a reset."""
    reset = V.k_of() % 9 == 0
    rows = V.sig_user(spark, d).select("session_id", F.col("seq").alias("epoch"), reset.alias("reset"), F.when(~reset, F.col("value")).alias("score"))
    return rounded(_done(spark, rows, "epoch", [7, 31], lambda stream: states.smooth(stream, ["score"], width=3)))


def live_dejittered(spark, d):
    """Chunks of seven rows, lines over the last twenty; the chunk that a session ends with is still open."""
    rows = V.sig_user(spark, d).select("session_id", "seq", F.floor(F.col("seq") / 7).alias("chunk"), "time")
    return _done(spark, rows, "seq", [10, 33], lambda stream: states.dejitter_sliding(stream, 20)).select("session_id", "seq", F.round("time", 2).alias("time"))


def live_rings(spark, d):
    """Rings as the last micro-batch leaves them: at most 40 rows of the last half second."""
    rows = V.imu(spark, d).select("session_id", "seq", "time", "AccX")
    out = _done(spark, rows, "seq", [75, 410], lambda stream: states.recent(stream, ["AccX"], count=40, horizon=0.5))
    last = out.groupBy("session_id").agg(F.max_by(F.struct("upto", "seq", "AccX"), "upto").alias("r"))
    return rounded(last.select("session_id", "r.upto", F.size("r.seq").cast("bigint").alias("n"), F.array_min("r.seq").alias("first"), F.aggregate("r.AccX", F.lit(0.0), lambda t, v: t + v).alias("total")))


def live_baselines(spark, d):
    """Starts in every session, stops in every other; the rest ends after ten seconds."""
    wide = V.sig_wide(spark, d).select("session_id", "seq", "time", *CH)
    at = lambda seq: (seq / 32.0).alias("time")
    first = wide.select("session_id").distinct().withColumn("s", 100 + 50 * (F.col("session_id") % 3))
    control = first.select("session_id", at(F.col("s")), F.lit("start").alias("kind")).unionByName(first.filter("session_id % 2 = 0").select("session_id", at(F.col("s") + 200), F.lit("stop").alias("kind")))
    rows = wide.withColumn("kind", F.lit("sample")).unionByName(control, allowMissingColumns=True)
    out = _done(spark, rows, "time", [5.1, 9.9], lambda stream: states.baseline_recordings(stream.filter("kind = 'sample'"), stream.filter("kind <> 'sample'"), CH, size=64, limit=10.0))
    return rounded(out.select("session_id", "recording", "event", "win", "seq", "time", "CH1"))


def live_segments(spark, d):
    """Rows as CSV segments of 60, written by micro-batch and read back."""
    folder, checkpoint = scratch(spark, "segments"), scratch(spark, "checkpoint")
    rows = V.sig_user(spark, d).select("session_id", "seq", "time", "value")
    _replay(spark, rows, "seq", [25, 61], lambda stream: states.segment_sink(states.segmented(stream, 60, ["value"], order=("seq",)), folder, "raw", ["value"], checkpoint).awaitTermination())
    back = states.read_segment_sink(spark, folder, ["value"])
    return back.select("session_id", "data_type", "segment", F.round("timestamp", 3).alias("timestamp"), F.round("value", 6).alias("value"))


def live_activity(spark, d):
    """Runs of a user's events less than six hours apart, once the watermark has passed them."""
    e = V.table(spark, d, "events").select(F.col("user_id").alias("session_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").cast("double").alias("value"))
    low, high = e.agg(F.min("ts"), F.max("ts")).first()
    out = _done(spark, e, "ts", [low + (high - low) * 0.3, low + (high - low) * 0.8], lambda stream: states.active_sessions(stream, "value", gap="6 hours", late="1 day"))
    return rounded(out.select("session_id", F.unix_millis("start").alias("start_ms"), F.unix_millis("end").alias("end_ms"), "n", "mean"))


QUERIES = {f.__name__: f for f in (live_thresholds, live_motion_filter, live_gated_runs, live_smoothing, live_dejittered, live_rings, live_baselines, live_segments, live_activity)}

_W = lambda w, e: f"CASE WHEN level = 'nlms' THEN list_transform(range(1, 5), lambda i: {w}[i] + 0.5 * {e} / (xx + 1e-6) * x[i]) WHEN level = 'gated' AND g >= 3 THEN [0.0::DOUBLE, 0.0, 0.0, 0.0] ELSE {w} END"
SQL = {
    "live_thresholds": V.sql("thr", "SELECT session_id, win, round(threshold, 6) AS threshold, warmed_up, clean FROM f WHERE (session_id, win) IN (SELECT (session_id, win) FROM blk GROUP BY session_id, win HAVING count(*) = 16)"),
    "live_motion_filter": "WITH RECURSIVE "
    + ", ".join(V.SQL[n] for n in ("sig", "imu"))
    + f""", o AS (SELECT session_id, seq, CH1, CH2, AccX, GyrX, seq // 32 AS win, {_LEVELS}[(seq // 32) % 6 + 1] AS level, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS r FROM sig JOIN imu USING (session_id, seq)),
f(session_id, r, seq, win, level, y1, y2, w1, w2, x, g) AS (
  SELECT DISTINCT session_id, 0::BIGINT, 0::BIGINT, -1::BIGINT, '', 0.0::DOUBLE, 0.0::DOUBLE, [0.0::DOUBLE, 0.0, 0.0, 0.0], [0.0::DOUBLE, 0.0, 0.0, 0.0], [0.0::DOUBLE, 0.0, 0.0, 0.0], 0::BIGINT FROM o
  UNION ALL
  SELECT session_id, r, seq, win, level, CASE level WHEN 'nlms' THEN e1 WHEN 'still' THEN CH1 END, CASE level WHEN 'nlms' THEN e2 WHEN 'still' THEN CH2 END,
         {_W("w1", "e1")}, {_W("w2", "e2")}, CASE WHEN level = 'nlms' THEN x WHEN level = 'gated' AND g >= 3 THEN [0.0::DOUBLE, 0.0, 0.0, 0.0] ELSE before END, g
  FROM (SELECT *, CH1 - list_dot_product(w1, x) AS e1, CH2 - list_dot_product(w2, x) AS e2, list_dot_product(x, x) AS xx
        FROM (SELECT o.*, w1, w2, f.x AS before, [AccX, GyrX, f.x[1], f.x[2]] AS x, CASE WHEN o.level = 'gated' THEN f.g + CAST(o.win <> f.win AS BIGINT) ELSE 0 END AS g FROM f JOIN o ON o.session_id = f.session_id AND o.r = f.r + 1)))
SELECT session_id, win, seq, round(y1, 5) AS CH1, round(y2, 5) AS CH2 FROM f WHERE r > 0 AND level <> 'gated'""",
    "live_gated_runs": _SIGNAL["gated_window_runs"],
    "live_smoothing": _with(
        "ku",
        "s AS (SELECT session_id, seq AS epoch, k % 9 = 0 AS reset, value, sum(CAST(k % 9 = 0 AS BIGINT)) OVER (PARTITION BY session_id ORDER BY seq) AS segment FROM ku), m AS (SELECT session_id, CAST(segment AS BIGINT) AS segment, epoch, avg(value) OVER w AS score, count(*) OVER w AS n FROM s WHERE NOT reset WINDOW w AS (PARTITION BY session_id, segment ORDER BY epoch ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))",
        "SELECT session_id, segment, epoch, round(score, 6) AS score FROM m WHERE n = 3",
    ),
    "live_dejittered": f"SELECT * FROM ({_RECORDING['dejittered_sliding']}) WHERE (session_id, seq // 7) NOT IN (SELECT (session_id, max(seq) // 7) FROM (SELECT user_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq FROM events) GROUP BY session_id)",
    "live_rings": _with(
        "imu",
        "l AS (SELECT *, max(time) OVER (PARTITION BY session_id) AS t, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) AS r FROM imu)",
        "SELECT session_id, max(seq) AS upto, count(*) AS n, min(seq) AS first, round(sum(AccX), 6) AS total FROM l WHERE r <= 40 AND time > t - 0.5 GROUP BY session_id",
    ),
    "live_baselines": _with(
        "sig",
        "c AS (SELECT *, 100 + 50 * (session_id % 3) AS s, 100 + 50 * (session_id % 3) + CASE WHEN session_id % 2 = 0 THEN 200 ELSE 320 END AS e FROM sig), i AS (SELECT *, (seq - s) // 64 AS win FROM c WHERE seq >= s AND seq < e), w AS (SELECT *, count(*) OVER (PARTITION BY session_id, win) AS n FROM i), "
        "k AS (SELECT c.session_id, any_value(s) AS s, any_value(e) AS e, (SELECT count(DISTINCT win) FROM w WHERE w.session_id = c.session_id AND n = 64) AS wins, max(seq) AS last FROM c GROUP BY c.session_id)",
        "SELECT session_id, 1::BIGINT AS recording, 'window' AS event, win, seq, round(time, 6) AS time, round(CH1, 6) AS CH1 FROM w WHERE n = 64 UNION ALL SELECT session_id, 1, 'recording', 0, NULL, round(s / 32.0::DOUBLE, 6), NULL FROM k UNION ALL SELECT session_id, 1, CASE WHEN wins > 0 THEN 'ready' ELSE 'idle' END, wins, NULL, round(e / 32.0::DOUBLE, 6), NULL FROM k",
    ),
    "live_segments": _RECORDING["segmented_sink"],
    "live_activity": """WITH e AS (SELECT user_id AS session_id, epoch_us(ts) AS t, value, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events),
s AS (SELECT *, sum(CAST(p IS NULL OR t - p >= 21600000000 AS INT)) OVER (PARTITION BY session_id ORDER BY t) AS g FROM e)
SELECT session_id, min(t) // 1000 AS start_ms, max(t) // 1000 AS end_ms, count(*) AS n, round(avg(value), 8) AS mean FROM s GROUP BY session_id, g HAVING max(t) + 21600000000 <= (SELECT max(epoch_us(ts)) - 86400000000 FROM events)""",
}
