"""Queries of recordings on disk: written in the layout of the scans, scanned, probed, watched."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import markers
from ..sources import marker_files, segments
from ..streaming import recordings, watcher
from . import views as V
from .artifact_queries import SQL as _ARTIFACT
from .signal_queries import _with

_CH = ["ch_1", "ch_2", "ch_3", "ch_4"]


def _named(spark, d) -> DataFrame:
    """Samples of short recordings: sessions named by their start, 50 seconds apart, or by other names."""
    w = V.sig_wide(spark, d).withColumnsRenamed({f"CH{k}": f"ch_{k}" for k in range(1, 5)})
    part = F.col("session_id") * 4 + F.floor(F.col("seq") / 256)
    name = F.when(part % 5 > 0, F.date_format(F.timestamp_seconds(F.lit(1_709_287_200) + part * 50), "yyyyMMdd_HHmmss")).otherwise(F.format_string("x%05d", part.cast("bigint")))
    return w.select(name.alias("session_id"), (F.col("seq") % 256).alias("seq"), "time", *_CH)


def _written(spark, d) -> str:
    return segments.write_recordings(_named(spark, d), segments.scratch(spark, "recordings"), "raw", _CH, 100)


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select("session_id", "segment", F.round("timestamp", 5).alias("timestamp"), *(F.round(c, 5).alias(c) for c in _CH))


def recordings_scanned(spark, d):
    return _shown(segments.scan_recordings(spark, _written(spark, d), "raw"))


def recordings_near(spark, d):
    """Segments of the recordings that began less than two minutes from one of them."""
    return _shown(segments.scan_recordings(spark, _written(spark, d), "raw", near="20240301_100320"))


def recordings_probed(spark, d):
    """Ranges from outer segments alone, anchored to the names."""
    out = segments.probed_range(spark, _written(spark, d), "raw", anchor=True)
    return out.select("session_id", "segments", F.round("start_ts", 3).alias("start_ts"), F.round("end_ts", 3).alias("end_ts"))


def recordings_watched(spark, d):
    """What one look of the watcher gives: every segment that has a successor."""
    stream = watcher.watched_segments(spark, _written(spark, d), "raw", segments.scratch(spark, "looks"), interval=3600.0)
    return _shown(recordings.run_available(stream, segments.scratch(spark, "watched"), segments.scratch(spark, "checkpoint")))


def marker_tables(spark, d):
    """Markers written as CSV with a byte-order mark, the odd ones appended to the even ones, and read back with their extra columns."""
    made = markers.parse_markers(V.requests(spark, d)).withColumn("session_id", F.format_string("u%05d", "session_id"))
    parsed, root = segments.scratch(spark, "parsed"), segments.scratch(spark, "markers")
    made.write.parquet(parsed)  # both writes read it, so a marker is parsed once
    made = spark.read.parquet(parsed)
    marker_files.write_marker_tables(made.filter("id % 2 = 0"), root)
    marker_files.write_marker_tables(made.filter("id % 2 = 1"), root, append=True)
    back = marker_files.scan_marker_tables(spark, root)
    return back.select("session_id", "id", "content", F.round("start_ts", 3).alias("start_ts"), F.round("end_ts", 3).alias("end_ts"), "start_str", F.round("duration_s", 3).alias("duration_s"), F.col("extras")["note"].alias("note"))


QUERIES = {f.__name__: f for f in (recordings_scanned, recordings_near, recordings_probed, recordings_watched, marker_tables)}

_N = "p AS (SELECT *, session_id * 4 + seq // 256 AS part, seq % 256 AS i FROM sig), n AS (SELECT *, CASE WHEN part % 5 > 0 THEN strftime(make_timestamp((1709287200 + part * 50) * 1000000), '%Y%m%d_%H%M%S') ELSE printf('x%05d', part) END AS name, 1709287200 + part * 50 AS began, i // 100 + 1 AS segment FROM p)"
_S = "SELECT name AS session_id, segment, round(time, 5) AS timestamp, round(CH1, 5) AS ch_1, round(CH2, 5) AS ch_2, round(CH3, 5) AS ch_3, round(CH4, 5) AS ch_4 FROM n"
SQL = {
    "recordings_scanned": _with("sig", _N, _S),
    "recordings_near": _with("sig", _N, _S + " WHERE part % 5 > 0 AND abs(began - 1709287400) < 120"),
    "recordings_probed": _with("sig", _N, "SELECT name AS session_id, max(segment) AS segments, round(CASE WHEN any_value(part) % 5 > 0 THEN any_value(began) ELSE min(time) END, 3) AS start_ts, round(CASE WHEN any_value(part) % 5 > 0 THEN any_value(began) + max(time) - min(time) ELSE max(time) END, 3) AS end_ts FROM n GROUP BY name"),
    "recordings_watched": _with("sig", _N + ", m AS (SELECT name, max(segment) AS last FROM n GROUP BY name)", _S.replace("FROM n", "FROM n JOIN m USING (name)") + " WHERE segment < last"),
    "marker_tables": f"SELECT printf('u%05d', session_id) AS session_id, * EXCLUDE (session_id) FROM ({_ARTIFACT['parsed_markers']})",
}
