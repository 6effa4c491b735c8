"""Queries written in Spark SQL over the registered table functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import table_functions
from . import views as V
from .feature_queries import rounded
from .signal_queries import _with


def _windows(spark, d, size: int):
    table_functions.register(spark)
    return V.sig_wide(spark, d).select("session_id", F.floor(F.col("seq") / size).cast("bigint").alias("win"), "seq", "time", F.col("CH1").alias("value"))


def sql_window_peaks(spark, d):
    """All local maxima of windows of 64 rows, middles of plateaus."""
    return rounded(spark.sql("SELECT * FROM window_peaks(TABLE({w}) PARTITION BY (session_id, win) ORDER BY (seq), 1, 0.0)", w=_windows(spark, d, 64)))


def sql_spline_filled(spark, d):
    """Windows of four rows whose third value is missing: three known points give a parabola."""
    w = _windows(spark, d, 4).withColumn("value", F.when(F.col("seq") % 4 != 2, F.col("value")))
    return rounded(spark.sql("SELECT * FROM spline_filled(TABLE({w}) PARTITION BY (session_id, win) ORDER BY (seq))", w=w))


QUERIES = {f.__name__: f for f in (sql_window_peaks, sql_spline_filled)}

SQL = {
    "sql_window_peaks": _with(
        "sig",
        "a AS (SELECT session_id, seq // 64 AS win, seq, CH1 AS v, lag(CH1) OVER w AS p FROM sig WINDOW w AS (PARTITION BY session_id, seq // 64 ORDER BY seq)), b AS (SELECT *, sum(CAST(p IS NULL OR p <> v AS INT)) OVER (PARTITION BY session_id, win ORDER BY seq) AS r FROM a), "
        "c AS (SELECT session_id, win, r, any_value(v) AS v, min(seq) AS f, max(seq) AS l FROM b GROUP BY ALL), e AS (SELECT *, lag(v) OVER w AS p, lead(v) OVER w AS q FROM c WINDOW w AS (PARTITION BY session_id, win ORDER BY r))",
        "SELECT session_id, win, win * 64 + (f - win * 64 + l - win * 64) // 2 AS seq, round(v, 6) AS value FROM e WHERE v > p AND v > q",
    ),
    "sql_spline_filled": _with(
        "sig",
        "g AS (SELECT *, seq // 4 AS win, CASE WHEN seq % 4 = 2 THEN lag(CH1, 1) OVER w + (lead(CH1, 1) OVER w - lag(CH1, 2) OVER w) / 3 ELSE CH1 END AS v, count(*) OVER (PARTITION BY session_id, seq // 4) AS n, lag(CH1, 1) OVER w AS c1, lag(CH1, 2) OVER w AS c2 FROM sig WINDOW w AS (PARTITION BY session_id, seq // 4 ORDER BY seq))",
        "SELECT session_id, win, round(time, 6) AS time, round(CASE WHEN n = 3 AND seq % 4 = 2 THEN c1 ELSE v END, 6) AS value FROM g",
    ),
}
