"""Kernels as SQL table functions: ``SELECT * FROM zero_phase(TABLE(t) PARTITION BY (session_id, win) ORDER BY (seq), 256.0)``.

Each takes a table whose partitions are windows, in order, and gives rows with the window's keys; the columns ``session_id``, ``win``, ``seq`` (or ``time``) and
``value`` are found by name, others are ignored.  A partition is one window and so of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from ..operators.artifacts import spline
from ..operators.clean import filter_steps, filtfilt, padding
from ..operators.optical import peaks


class _Window:
    """Gathers the rows of a partition."""

    def __init__(self):
        self.rows: list[Row] = []
        self.options: tuple = ()

    def eval(self, row: Row, *options) -> None:
        self.rows.append(row)
        self.options = options

    def values(self) -> np.ndarray:
        return np.array([np.nan if r["value"] is None else float(r["value"]) for r in self.rows])

    def key(self) -> tuple[int, int]:
        return self.rows[0]["session_id"], self.rows[0]["win"]


@udtf(returnType="session_id bigint, win bigint, seq bigint, value double")
class ZeroPhase(_Window):
    """High-pass, low-pass and notch of each window, as ``clean.filter_windows``: (table, rate)."""

    def terminate(self) -> Iterator[tuple]:
        if not self.rows:
            return
        x, steps = self.values(), filter_steps(float(self.options[0]))
        sound = len(x) > max(padding(s) for s in steps) and not np.isnan(x).any()
        y = x[:, None]
        for s in steps if sound else ():
            y = filtfilt(y, s)
        for r, v in zip(self.rows, y[:, 0]):
            yield *self.key(), r["seq"], float(v) if sound else None


@udtf(returnType="session_id bigint, win bigint, seq bigint, value double")
class Peaks(_Window):
    """Peaks of each window, as ``optical.peaks``: (table, least distance in rows, least prominence).  Windows with missing samples give none."""

    def terminate(self) -> Iterator[tuple]:
        x = self.values()
        if len(x) < 3 or np.isnan(x).any():
            return
        for i in peaks(x, int(self.options[0]), float(self.options[1])):
            yield *self.key(), self.rows[i]["seq"], float(x[i])


@udtf(returnType="session_id bigint, win bigint, time double, value double")
class SplineFilled(_Window):
    """Rows without a value get it from ``artifacts.spline`` through those that have one: (table).  Of equal times the first known one counts; windows without any keep NULL."""

    def terminate(self) -> Iterator[tuple]:
        if not self.rows:
            return
        x, t = self.values(), np.array([float(r["time"]) for r in self.rows])
        known = np.flatnonzero(~np.isnan(x))
        if len(known):
            at, first = np.unique(t[known], return_index=True)
            x = np.where(np.isnan(x), spline(at, x[known][first][:, None], t)[:, 0], x)
        for time, v in zip(t, x):
            yield *self.key(), float(time), None if np.isnan(v) else float(v)


def register(spark: SparkSession) -> None:
    """Make ``zero_phase``, ``window_peaks`` and ``spline_filled`` known to the session's SQL."""
    for name, made in (("zero_phase", ZeroPhase), ("window_peaks", Peaks), ("spline_filled", SplineFilled)):
        spark.udtf.register(name, made)
