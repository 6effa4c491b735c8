"""Queries of sources, sinks, the control channel, times and cleaning steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import clean, control, history, quality, timebase
from ..operators import features as feat
from ..sources import segments
from . import views as V
from .feature_queries import rounded
from .signal_queries import CH, _with

GAP_KEYS = ("session_id", "ch")


def _gaps(spark, d) -> DataFrame:
    return feat.to_long(V.sig_gaps(spark, d))


def segmented_sink(spark, d):
    """Rows written as CSV segments of 60 rows and read back."""
    folder = segments.write_segments(V.sig_user(spark, d), segments.scratch(spark, "segments"), "raw", ["value"], segments.rows_a_segment(1, 256.0, samples=60))
    back = segments.read_segments(spark, folder, ["value"])
    return back.select(F.col("session_id").cast("bigint").alias("session_id"), "data_type", "segment", F.round("timestamp", 3).alias("timestamp"), F.round("value", 6).alias("value"))


def time_ranges(spark, d):
    return rounded(segments.time_range(V.sig_user(spark, d), time="time"), 3)


def pending_segments(spark, d):
    """Files as a watcher sees them: sizes and the sizes of the look before; every fifth is done."""
    u = V.sig_user(spark, d).withColumn("k", V.k_of())
    path = F.format_string("/data/%d/EEG_seg%04d.csv", "session_id", F.col("seq") + 1)
    files = u.filter("k % 4 > 0").select(path.alias("path"), (F.col("k") % 3).alias("size"), (F.col("k") % 2).alias("was"))
    done = u.filter("k % 5 = 0").select(path.alias("path"))
    return segments.pending(files, done).select("path", segments.segment_of(F.col("path")).alias("segment"), segments.next_segment(F.col("path")).alias("following"))


def json_responses(spark, d):
    u = V.sig_user(spark, d).withColumn("k", V.k_of())
    return segments.response(u.select("event_id", "event_type", F.when(F.col("k") % 10 == 0, F.lit(float("nan"))).when(F.col("k") % 10 == 1, F.lit(float("inf"))).otherwise(F.col("k").cast("double")).alias("score")), ("event_id",))


def control_messages(spark, d):
    m = control.messages(V.chunks(spark, d))
    return m.select("session_id", "msg", F.col("body")["ps"].cast("bigint").alias("ps"), F.col("body")["rc"].alias("rc"), F.size("body").cast("bigint").alias("n_keys"))


def battery_readings(spark, d):
    return control.battery(control.messages(V.chunks(spark, d)))


def state_changes(spark, d):
    m = control.messages(V.chunks(spark, d)).select("session_id", F.col("msg").alias("seq"), F.col("body")["ps"].cast("bigint").alias("state"))
    return control.state_changes(m).select("session_id", "seq", "state", "changed")


def unknown_keys(spark, d):
    return control.unknown_keys(control.messages(V.chunks(spark, d))).select("session_id", "msg", F.array_join(F.array_sort(F.map_keys("unknown")), ",").alias("keys"))


def described_streams(spark, d):
    k = V.k_of()
    names = F.array(*(F.lit(n) for n in ("EEG", "PPG_1", "Accelerometer", "Battery", "unknown", "Alpha_Relative")))
    s = V.table(spark, d, "events").select(F.get(names, (k % 6).cast("int")).alias("name"), F.when(k % 4 == 0, "EEG").when(k % 4 == 1, "Therm").otherwise("x").alias("type"))
    return control.describe_streams(s).select("name", "type", "key", F.size("labels").cast("bigint").alias("n_labels"), "whole")


def channel_names(spark, d):
    """Names by number of channels: configured, the stream's own, the catalogue's, numbered."""
    k = V.k_of()
    n = (k % 4 + 1).cast("int")
    text = lambda *names: F.array(*(F.lit(v) for v in names))
    made = control.channel_labels(n, text("a", "b"), F.when(k % 3 == 0, text("s")), text("Ambient", "IR", "Red"))
    return V.table(spark, d, "events").select("event_id", F.array_join(made, ",").alias("names"))


def throttled_samples(spark, d):
    return rounded(control.throttled(V.sig_user(spark, d).select("session_id", "seq", "time", "value"), ("session_id",), 3600.0).select("session_id", "seq", "value"))


def sample_counters(spark, d):
    """Running number of samples and of packets of 12, per stream."""
    return V.sig_user(spark, d).groupBy("session_id").agg(F.count(F.lit(1)).alias("samples"), F.count_if(F.col("seq") % 12 == 0).alias("packets"), F.count_if(V.k_of() > 50).alias("succeeded"))


def corrected_times(spark, d):
    u = V.sig_user(spark, d).withColumn("correction", F.when(F.col("seq") % 20 == 3, V.k_of() / 1000.0))
    return timebase.corrected(u, "correction", 0.5).select("session_id", "seq", F.round("time", 3).alias("time"))


def dejittered_sliding(spark, d):
    u = V.sig_user(spark, d)
    return timebase.dejitter_sliding(u, F.floor(F.col("seq") / 7), 20).select("session_id", "seq", F.round("time", 2).alias("time"))


def anchored_sessions(spark, d):
    u = V.sig_user(spark, d)
    name = F.when(F.col("session_id") % 3 > 0, F.format_string("20240301_10%02d00", F.col("session_id") % 60)).otherwise(F.format_string("s%d", "session_id"))
    return timebase.anchored(u.withColumn("name", name), "name").select("session_id", "seq", F.round("time", 3).alias("time"))


def canonical_columns(spark, d):
    """Raw names to canonical ones, required and optional."""
    raw = V.sig_wide(spark, d).withColumnsRenamed({"CH1": "ch_1", "CH2": "ch_2", "CH3": "ch_3", "CH4": "ch_4", "time": "timestamp"})
    piped = clean.adapt(raw, {"timestamp": "timestamps", "ch_1": "eeg_1", "ch_2": "eeg_2", "ch_3": "eeg_3", "ch_4": "eeg_4", "absent": "gone"})
    return rounded(clean.select_channels(piped, {"timestamps": "time", "eeg_1": "CH1", "eeg_2": "CH2", "eeg_3": "CH3", "eeg_4": "CH4"}))


def offset_removed(spark, d):
    return rounded(clean.dc_offset(_gaps(spark, d)).select("session_id", "ch", "seq", "value"))


def outliers_corrected(spark, d):
    """By half-second windows, so that channels without an outlier keep their gaps."""
    rows = _gaps(spark, d).withColumn("win", F.floor(F.col("seq") / 16).cast("bigint"))
    return rounded(clean.correct_outliers(rows, 200.0, ("session_id", "win", "ch")).select("session_id", "win", "ch", "seq", "value"))


def saturation_repaired(spark, d):
    rows = _gaps(spark, d).withColumn("win", F.floor(F.col("seq") / 16).cast("bigint"))
    return rounded(clean.repair_where(rows, quality.saturated(F.col("value"), 5.0, 120.0), ("session_id", "win", "ch")).select("session_id", "win", "ch", "seq", "value"))


def bad_channels_masked(spark, d):
    """Verdicts of each window and channel put back on its samples: bad ones become NULL."""
    rows = V.sig_gaps(spark, d).withColumn("CH2", F.col("CH2") / 1000).withColumn("CH3", F.when(F.col("seq") % 9 == 0, 2000.0).otherwise(F.col("CH3")))
    long = feat.to_long(rows).withColumn("win", F.floor(F.col("seq") / 64).cast("bigint"))
    verdicts = quality.assess(long, ["session_id", "win", "ch"]).select("session_id", "win", "ch", "quality", "reason")
    return rounded(quality.masked(long, verdicts, ("session_id", "win", "ch")).select("session_id", "win", "ch", "seq", "quality", "reason", "value"))


def padded_channels(spark, d):
    """Samples as columns, 0 where a row is too short."""
    e = V.table(spark, d, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, (F.col("vec_id") % 5 + 1).cast("int")), lambda v: v.cast("double")).alias("v"))
    return rounded(e.select("vec_id", *history.padded(F.col("v"), ["a", "b", "c", "d"])))


def offset_traces(spark, d):
    w = V.sig_wide(spark, d).select("session_id", "seq", F.array(*CH).alias("values"))
    return rounded(history.offset_traces(w).select("session_id", "seq", F.col("channel").cast("bigint").alias("channel"), "value"))


def processed_windows(spark, d):
    """The whole cleaning of two-second windows; CH3 has no samples in every third."""
    wide = V.sig_gaps(spark, d).withColumn("win", F.floor(F.col("seq") / 512).cast("bigint")).withColumn("CH3", F.when(F.col("win") % 3 != 1, F.col("CH3")))
    return rounded(clean.process(wide, 256.0, CH, ("session_id", "win"), threshold=200.0), 4)


def display_texts(spark, d):
    """Clock and session texts, numbers of cards and bars."""
    u = V.sig_user(spark, d).withColumn("k", V.k_of())
    small = F.col("value") * 1.00037 / F.pow(F.lit(10.0), (F.col("k") % 7).cast("double"))
    name = F.when(F.col("k") % 2 == 0, F.format_string("202401%02d_0910%02d", F.col("k") % 28 + 1, F.col("k") % 60)).otherwise(F.format_string("x%d", "k"))
    return u.select(
        "event_id",
        X.clock_text(F.col("time")).alias("clock"),
        X.session_text(name).alias("session"),
        X.number_text(F.when(F.col("k") % 13 > 0, small)).alias("number"),
        F.round(X.bar_percent(F.col("value"), F.lit(80.0)), 6).alias("bar"),
        F.round(X.display_mean([F.col("value"), F.when(F.col("k") % 2 == 0, F.col("value") * 2), F.lit(None).cast("double")]), 6).alias("shown"),
        X.optional_number(F.when(F.col("k") % 3 == 0, F.col("k").cast("string")).when(F.col("k") % 3 == 1, "").otherwise("nan")).alias("parsed"),
        X.duration_text(X.clock_text(F.col("time")), X.clock_text(F.col("time") + F.col("k") * 1000), F.col("k")).alias("duration"),
    )


QUERIES = {f.__name__: f for f in (segmented_sink, time_ranges, pending_segments, json_responses, control_messages, battery_readings, state_changes, unknown_keys, described_streams, channel_names, throttled_samples, sample_counters, corrected_times, dejittered_sliding, anchored_sessions, canonical_columns, offset_removed, outliers_corrected, saturation_repaired, bad_channels_masked, padded_channels, offset_traces, processed_windows, display_texts)}

_MSG = "m AS (SELECT *, CAST(k % 3 AS BIGINT) AS ps FROM ku WHERE k % 11 <> 0)"
#: Gaps bridged within windows of 16 rows: ``c`` holds the samples to keep as v, in rows named by w.
_BRIDGE = "g AS (SELECT * FROM c WHERE v IS NOT NULL), p AS (SELECT c.*, a.seq AS i, a.v AS x FROM c ASOF LEFT JOIN g a ON c.w = a.w AND c.seq >= a.seq), q AS (SELECT p.*, b.seq AS j, b.v AS y FROM p ASOF LEFT JOIN g b ON p.w = b.w AND p.seq <= b.seq), z AS (SELECT *, coalesce(v, CASE WHEN i IS NULL THEN y WHEN j IS NULL THEN x ELSE x + (y - x) * ((seq - i) / (j - i)) END) AS line FROM q)"
_W16 = "session_id || '-' || ch || '-' || (seq // 16)"

SQL = {
    "segmented_sink": V.sql("usr", "SELECT session_id, 'raw' AS data_type, seq // 60 + 1 AS segment, round(time, 3) AS timestamp, round(value, 6) AS value FROM usr"),
    "time_ranges": V.sql("usr", "SELECT session_id, round(min(time), 3) AS start_ts, round(max(time), 3) AS end_ts FROM usr GROUP BY 1"),
    "pending_segments": V.sql("ku", "SELECT printf('/data/%d/EEG_seg%04d.csv', a.session_id, a.seq + 1) AS path, a.seq + 1 AS segment, printf('/data/%d/EEG_seg%04d.csv', a.session_id, a.seq + 2) AS following FROM ku a LEFT JOIN ku b ON a.session_id = b.session_id AND b.seq = a.seq + 1 AND b.k % 4 > 0 WHERE a.k % 4 > 0 AND a.k % 5 <> 0 AND (b.seq IS NOT NULL OR (a.k % 3 > 0 AND a.k % 3 = a.k % 2))"),
    "json_responses": V.sql("ku", """SELECT event_id, '{"event_type":"' || event_type || '","score":' || CASE WHEN k % 10 < 2 THEN 'null' ELSE k || '.0' END || '}' AS json FROM ku"""),
    "control_messages": _with("ku", _MSG, "SELECT session_id, seq AS msg, ps, '0' AS rc, 2 + CAST(k % 5 = 0 AS BIGINT) + CAST(k % 10 = 0 AS BIGINT) + CAST(k % 7 = 0 AS BIGINT) AS n_keys FROM m"),
    "battery_readings": _with("ku", _MSG, "SELECT session_id, seq AS msg, k + 0.5::DOUBLE AS percent, 0.0::DOUBLE AS voltage, CASE WHEN k % 10 = 0 THEN k ELSE 0 END::DOUBLE AS temperature FROM m WHERE k % 5 = 0"),
    "state_changes": _with("ku", _MSG, "SELECT session_id, seq, ps AS state, xor(ps, was) AS changed FROM (SELECT *, lag(ps) OVER (PARTITION BY session_id ORDER BY seq) AS was FROM m) WHERE was IS NOT NULL AND ps <> was"),
    "unknown_keys": _with("ku", _MSG, "SELECT session_id, seq AS msg, 'zz' AS keys FROM m WHERE k % 7 = 0"),
    "described_streams": """WITH s AS (SELECT DISTINCT ['EEG','PPG_1','Accelerometer','Battery','unknown','Alpha_Relative'][k % 6 + 1] AS name, CASE k % 4 WHEN 0 THEN 'EEG' WHEN 1 THEN 'Therm' ELSE 'x' END AS type FROM (SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)),
c(r, key, n) AS (VALUES (0, 'EEG', 6), (1, 'PPG', 3), (3, 'Accelerometer', 3), (5, 'Batt', 3), (15, 'Therm', 1), (16, 'Alpha_Relative', 4))
SELECT name, type, min_by(key, r) AS key, CAST(coalesce(min_by(n, r), 0) AS BIGINT) AS n_labels, false AS whole FROM s LEFT JOIN c ON starts_with(name, key) OR starts_with(type, key) GROUP BY ALL""",
    "channel_names": "SELECT event_id, CASE k % 4 WHEN 1 THEN 'a,b' WHEN 2 THEN 'Ambient,IR,Red' WHEN 3 THEN 'channel_0,channel_1,channel_2,channel_3' ELSE CASE WHEN k % 3 = 0 THEN 's' ELSE 'channel_0' END END AS names FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)",
    "throttled_samples": V.sql("usr", "SELECT session_id, max(seq) AS seq, round(max_by(value, seq), 6) AS value FROM usr GROUP BY session_id, floor(time / 3600)"),
    "sample_counters": V.sql("ku", "SELECT session_id, count(*) AS samples, count(*) FILTER (seq % 12 = 0) AS packets, count(*) FILTER (k > 50) AS succeeded FROM ku GROUP BY 1"),
    "corrected_times": V.sql("ku", "SELECT session_id, seq, round(time + coalesce(last_value(CASE WHEN seq % 20 = 3 THEN k / 1000.0::DOUBLE END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY seq ROWS UNBOUNDED PRECEDING), 0) + 0.5, 3) AS time FROM ku"),
    "dejittered_sliding": _with(
        "usr",
        "c AS (SELECT *, seq // 7 AS c, count(*) OVER (PARTITION BY session_id, seq // 7) AS n, min(time) OVER (PARTITION BY session_id) AS t0 FROM usr), e AS (SELECT session_id, c, max(seq) AS last FROM c WHERE n > 1 GROUP BY ALL), "
        "o AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS r FROM c WHERE n > 1), l AS (SELECT e.session_id, e.c, o.r FROM e JOIN o ON e.session_id = o.session_id AND e.last = o.seq), "
        "f AS (SELECT l.session_id, l.c, avg(o.time - o.t0) AS mt, avg(o.seq) AS mx, covar_pop(o.time - o.t0, o.seq) / var_pop(o.seq) AS s FROM l JOIN o ON l.session_id = o.session_id AND o.r BETWEEN l.r - 19 AND l.r GROUP BY ALL)",
        "SELECT c.session_id, seq, round(CASE WHEN n > 1 THEN t0 + mt + s * (seq - mx) ELSE time END, 2) AS time FROM c LEFT JOIN f ON c.session_id = f.session_id AND c.c = f.c",
    ),
    "anchored_sessions": V.sql("usr", "SELECT session_id, seq, round(CASE WHEN session_id % 3 > 0 THEN time - min_by(time, seq) OVER (PARTITION BY session_id) + epoch(strptime(printf('20240301_10%02d00', session_id % 60), '%Y%m%d_%H%M%S')) ELSE time END, 3) AS time FROM usr"),
    "canonical_columns": V.sql("sig", "SELECT session_id, seq, round(time, 6) AS time, round(CH1, 6) AS CH1, round(CH2, 6) AS CH2, round(CH3, 6) AS CH3, round(CH4, 6) AS CH4 FROM sig"),
    "offset_removed": V.sql("glong", "SELECT session_id, ch, seq, round(value - 800, 6) AS value FROM glong"),
    "outliers_corrected": _with("glong", f"c AS (SELECT *, seq // 16 AS win, {_W16} AS w, CASE WHEN abs(value) <= 200 THEN value END AS v, coalesce(max(abs(value)) OVER (PARTITION BY session_id, ch, seq // 16) > 200, false) AS o FROM glong), {_BRIDGE}", "SELECT session_id, win, ch, seq, round(CASE WHEN o THEN line ELSE value END, 6) AS value FROM z"),
    "saturation_repaired": _with("glong", f"b AS (SELECT *, coalesce(value <= 5 OR value >= 120, false) AS bad FROM glong), c AS (SELECT *, seq // 16 AS win, {_W16} AS w, CASE WHEN NOT bad THEN value END AS v, count(CASE WHEN NOT bad THEN value END) OVER (PARTITION BY session_id, ch, seq // 16) AS good FROM b), {_BRIDGE}", "SELECT session_id, win, ch, seq, round(CASE WHEN bad AND good >= 2 THEN line ELSE value END, 6) AS value FROM z"),
    "bad_channels_masked": _with(
        "glong",
        "r AS (SELECT session_id, seq, seq // 64 AS win, ch, CASE WHEN ch = 'CH2' THEN value / 1000 WHEN ch = 'CH3' AND seq % 9 = 0 THEN 2000 ELSE value END AS value FROM glong), a AS (SELECT session_id, win, ch, avg(CAST(value <= 1 OR value >= 1449 AS INT)) AS s, stddev_pop(value) < 1 AS flat FROM r GROUP BY ALL), v AS (SELECT *, CASE WHEN flat OR s > 0.1 THEN 'bad' WHEN s > 0.05 THEN 'poor' ELSE 'good' END AS quality, CASE WHEN flat THEN 'flatline' WHEN s > 0.05 THEN printf('sat=%.1f%%', s * 100) ELSE '' END AS reason FROM a)",
        "SELECT r.session_id, r.win, r.ch, seq, quality, reason, round(CASE WHEN quality <> 'bad' THEN value END, 6) AS value FROM r JOIN v ON r.session_id = v.session_id AND r.win = v.win AND r.ch = v.ch",
    ),
    "padded_channels": "SELECT vec_id, " + ", ".join(f"round(CASE WHEN vec_id % 5 >= {i} THEN CAST(embedding[{i + 1}] AS DOUBLE) ELSE 0 END, 6) AS {n}" for i, n in enumerate("abcd")) + " FROM embeddings",
    "offset_traces": V.sql("sig", "SELECT session_id, seq, CAST(c AS BIGINT) AS channel, round(v + c * 150, 6) AS value FROM (SELECT session_id, seq, unnest([0, 1, 2, 3]) AS c, unnest([CH1, CH2, CH3, CH4]) AS v FROM sig)"),
    "display_texts": _with(
        "ku", "d AS (SELECT *, value * 1.00037::DOUBLE / pow(10.0::DOUBLE, k % 7) AS small, make_timestamp(CAST(floor(time * 1000000) AS BIGINT)) AS t FROM ku), n AS (SELECT *, CASE WHEN k % 13 > 0 THEN small END AS x, floor(k * 1000 % 86400) AS g FROM d)",
        """SELECT event_id, strftime(t, '%H:%M:%S.%g') AS clock, CASE WHEN k % 2 = 0 THEN printf('2024-01-%02d 09:10:%02d', k % 28 + 1, k % 60) ELSE 'x' || k END AS session,
CASE WHEN x IS NULL THEN '--' WHEN x >= 100 THEN printf('%.1f', x) WHEN x >= 1 THEN printf('%.3f', x) WHEN x >= 0.001 THEN printf('%.4f', x) ELSE regexp_replace(printf('%.2e', x), 'e([+-])0?(\\d+)$', 'e\\1\\2') END AS number,
round(least(100.0, value / 80.0 * 100), 6) AS bar, round((value + CASE WHEN k % 2 = 0 THEN value * 2 ELSE 0 END) / 3, 6) AS shown, CASE WHEN k % 3 = 0 THEN k END::DOUBLE AS parsed,
CASE WHEN k < 2 THEN 'unknown' ELSE CAST(CAST(g AS BIGINT) // 60 AS VARCHAR) || ' min ' || CAST(CAST(g AS BIGINT) % 60 AS VARCHAR) || ' s' END AS duration FROM n""",
    ),
}
