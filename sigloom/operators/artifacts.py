"""Artifacts: adaptive blink threshold and repair, motion gate, IMU resampling, adaptive filter.

What depends on the windows before is a small state machine over one row per window (or a filter over a session's
samples): rows are dealt by session, sorted and streamed through an Arrow kernel that keeps only the state.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import IMU_AXES
from .clean import dilated, repair_where


def window_peaks(wide: DataFrame, channels: list[str], keys: tuple[str, ...] = ("session_id", "win")) -> DataFrame:
    """Per window: ``peak`` (highest magnitude of any channel) and ``typical`` (median over live channels of each one's highest)."""
    top = wide.groupBy(*keys).agg(*(F.max(F.abs(F.col(c))).alias(c) for c in channels))
    live = F.array_sort(F.filter(F.array(*(F.col(c) for c in channels)), lambda v: v.isNotNull()))
    n = F.size("_l")
    median = F.when(n > 0, (F.get("_l", F.floor((n - 1) / 2).cast("int")) + F.get("_l", F.floor(n / 2).cast("int"))) / 2)
    return top.withColumn("_l", live).select(*keys, F.element_at(F.when(n > 0, F.col("_l")), -1).alias("peak"), median.alias("typical"))


def adaptive_thresholds(peaks: DataFrame, *, fallback: float = 200.0, factor: float = 5.0, history: int = 20) -> DataFrame:
    """Adds ``threshold``, ``warmed_up`` and ``clean`` to one row per window, in order of ``win`` within each session.

    The threshold is ``factor`` times the median of ``typical`` over the last ``history`` clean windows once there are so
    many, else ``fallback``.  A window is clean if its peak does not exceed the threshold; windows without samples
    change nothing.
    """
    kind = "session_id bigint, win bigint, peak double, typical double, threshold double, warmed_up boolean, clean boolean"
    schema = pa.schema([("session_id", pa.int64()), ("win", pa.int64()), ("peak", pa.float64()), ("typical", pa.float64()), ("threshold", pa.float64()), ("warmed_up", pa.bool_()), ("clean", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = object(), deque(maxlen=history)
        for batch in batches:
            out = []
            for session, win, peak, typical in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if session != now:
                    now, held = session, deque(maxlen=history)
                warm = len(held) >= history
                limit = factor * float(np.median(held)) if warm else fallback
                clean = peak is None or peak <= limit
                if clean and typical is not None:
                    held.append(typical)
                out.append((session, win, peak, typical, limit, warm, clean))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(schema)], schema=schema)

    rows = peaks.select(F.col("session_id").cast("bigint"), F.col("win").cast("bigint"), F.col("peak").cast("double"), F.col("typical").cast("double"))
    return rows.repartition("session_id").sortWithinPartitions("session_id", "win").mapInArrow(run, kind)


def repair_blinks(wide: DataFrame, thresholds: DataFrame, channels: list[str], fs: float, *, most: float = 0.30) -> DataFrame:
    """Windows by their own threshold: contaminated ones go, blinks of the others are bridged channel by channel.

    A row is contaminated if any channel exceeds the threshold within 100 ms; more than ``most`` of the rows, or fewer
    than two clean rows, and the window goes.  A channel is bridged from its own good samples; with fewer than two it becomes NULL.
    """
    keys = ("session_id", "win")
    margin = max(1, int(0.1 * fs))
    limit = wide.join(thresholds.select(*keys, "threshold"), list(keys))
    over = F.greatest(*(F.coalesce((F.abs(F.col(c)) > F.col("threshold")).cast("int"), F.lit(0)) for c in channels))
    w = Window.partitionBy(*keys)
    near = limit.withColumn("_o", over).withColumn("_near", dilated(F.col("_o"), margin, keys))
    gate = near.withColumn("_share", F.avg("_near").over(w)).withColumn("_good", F.sum(1 - F.col("_near")).over(w)).withColumn("blink_detected", F.max("_o").over(w) > 0)
    kept = gate.filter((F.col("_share") <= most) & (F.col("_good") >= 2))
    rest = [c for c in wide.columns if c not in channels]
    rows = kept.unpivot([*rest, "threshold", "blink_detected"], channels, "ch", "value")
    own = (*keys, "ch")
    beyond = F.coalesce((F.abs("value") > F.col("threshold")).cast("int"), F.lit(0))
    marked = rows.withColumn("_m", dilated(beyond, margin, own))
    fixed = repair_where(marked, F.col("_m") == 1, own, otherwise=F.lit(None).cast("double"))
    out = fixed.groupBy(*rest, "blink_detected").agg(*(F.max(F.when(F.col("ch") == c, F.col("value"))).alias(c) for c in channels))
    return out.select(*wide.columns, "blink_detected")


def imu_of_windows(windows: DataFrame, imu: DataFrame, pad: float = 0.1, width: float = 10.0) -> DataFrame:
    """IMU rows of each window (session_id, win, t0, t1): those within ``pad`` seconds of it, ends included.  An equi-join on stretches of time."""
    at = lambda c: F.floor(c / width).cast("bigint")
    held = windows.select("session_id", "win", (F.col("t0") - pad).alias("_a"), (F.col("t1") + pad).alias("_b")).withColumn("_k", F.explode(F.sequence(at(F.col("_a")), at(F.col("_b")))))
    return held.join(imu.withColumn("_k", at(F.col("time"))), ["session_id", "_k"]).filter("time >= _a and time <= _b").drop("_k", "_a", "_b")


def motion_gate(windows: DataFrame, levels: DataFrame) -> DataFrame:
    """Windows without the gated ones; a window without motion data passes (level NULL)."""
    return windows.join(levels.select("session_id", "win", "level"), ["session_id", "win"], "left").filter(F.col("level").isNull() | (F.col("level") != "gated"))


def ordered_imu(imu: DataFrame) -> DataFrame:
    """IMU rows without NULLs, of equal times in a session the first by ``seq``."""
    known = imu.dropna(subset=["time", *IMU_AXES])
    first = F.row_number().over(Window.partitionBy("session_id", "time").orderBy("seq"))
    return known.withColumn("_k", first).filter("_k = 1").drop("_k")


def resample_linear(times: DataFrame, imu: DataFrame, axes: list[str] = IMU_AXES) -> DataFrame:
    """IMU axes at the times of ``times`` (session_id, seq, time): lines between neighbours, the nearest value outside."""
    clean = ordered_imu(imu)
    both = times.select("session_id", "seq", "time", F.lit(None).cast("struct<time: double, " + ", ".join(f"{a}: double" for a in axes) + ">").alias("p")).unionByName(
        clean.select("session_id", F.lit(None).cast("bigint").alias("seq"), "time", F.struct("time", *axes).alias("p"))
    )
    w = Window.partitionBy("session_id").orderBy("time", F.col("p").isNull())
    back = Window.partitionBy("session_id").orderBy(F.desc("time"), F.col("p").isNull())
    full = both.withColumn("a", F.last("p", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("b", F.last("p", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0)))
    share = F.when(F.col("b.time") > F.col("a.time"), (F.col("time") - F.col("a.time")) / (F.col("b.time") - F.col("a.time"))).otherwise(0.0)
    value = lambda c: F.coalesce(F.col(f"a.{c}") + (F.col(f"b.{c}") - F.col(f"a.{c}")) * share, F.col(f"a.{c}"), F.col(f"b.{c}"))
    return full.filter(F.col("p").isNull()).select("session_id", "seq", "time", *(value(c).alias(c) for c in axes))


def spline(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Cubic spline through (x, columns of y), third derivatives continuous at the second and last but one point; held constant outside.

    Three points give a parabola, fewer a line (one point a constant).
    """
    n, at = len(x), np.clip(at, x[0], x[-1])
    if n < 4:
        return np.stack([np.polyval(np.polyfit(x - x[0], c, n - 1), at - x[0]) for c in y.T], axis=1)
    h, d = np.diff(x), np.diff(y, axis=0) / np.diff(x)[:, None]
    below, middle, above = np.zeros(n), np.empty(n), np.zeros(n)
    r = np.zeros((n, y.shape[1]))
    below[1:-1], middle[1:-1], above[1:-1] = h[1:], 2 * (h[:-1] + h[1:]), h[:-1]
    r[1:-1] = 3 * (h[1:, None] * d[:-1] + h[:-1, None] * d[1:])
    middle[0], above[0] = h[1], h[0] + h[1]
    r[0] = ((h[0] + 2 * (h[0] + h[1])) * h[1] * d[0] + h[0] ** 2 * d[1]) / (h[0] + h[1])
    below[-1], middle[-1] = h[-1] + h[-2], h[-2]
    r[-1] = (h[-1] ** 2 * d[-2] + (2 * (h[-1] + h[-2]) + h[-1]) * h[-2] * d[-1]) / (h[-1] + h[-2])
    for k in range(1, n):  # down the three diagonals, then up
        w = below[k] / middle[k - 1]
        middle[k] -= w * above[k - 1]
        r[k] -= w * r[k - 1]
    slope = r
    slope[-1] /= middle[-1]
    for k in range(n - 2, -1, -1):
        slope[k] = (slope[k] - above[k] * slope[k + 1]) / middle[k]
    i = np.clip(np.searchsorted(x, at, "right") - 1, 0, n - 2)
    t, s = (at - x[i])[:, None], h[i][:, None]
    c = (3 * d[i] - 2 * slope[i] - slope[i + 1]) / s
    e = (slope[i] + slope[i + 1] - 2 * d[i]) / s**2
    return y[i] + t * (slope[i] + t * (c + t * e))


def resample_spline(windows: DataFrame, imu: DataFrame, axes: list[str] = IMU_AXES) -> DataFrame:
    """IMU axes at the samples of each window (session_id, win, seq, time), by ``spline`` over the window's own IMU rows.

    ``imu`` holds the rows of ``imu_of_windows``; of rows at one time the first by ``seq`` counts.  Windows without IMU rows get NULL.  A window's samples
    and points meet as arrays, and all windows of a batch pass one Arrow kernel.
    """

    @F.pandas_udf("array<array<double>>")
    def kernel(at: pd.Series, times: pd.Series, points: pd.Series) -> pd.Series:
        out = []
        for t, x, y in zip(at, times, points):
            if x is None or not len(x):
                out.append(None)
                continue
            x, first = np.unique(np.asarray(x, float), return_index=True)
            out.append(spline(x, np.stack([np.asarray(row, float) for row in y])[first], np.asarray(t, float)).tolist())
        return pd.Series(out)

    keys = ["session_id", "win"]
    samples = windows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("seq", "time"))).alias("_s"))
    known = imu.dropna(subset=["time", *axes]).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("time", "seq", *axes))).alias("_p"))
    made = samples.join(known, keys, "left").withColumn("_y", kernel(F.transform("_s", lambda v: v["time"]), F.transform("_p", lambda v: v["time"]), F.transform("_p", lambda v: F.array(*(v[a] for a in axes)))))
    rows = made.select(*keys, F.posexplode("_s").alias("_i", "_r"), "_y")
    value = lambda k: F.get(F.get("_y", F.col("_i")), F.lit(k))
    return rows.select(*keys, "_r.seq", "_r.time", *(F.when(~F.isnan(value(k)), value(k)).alias(a) for k, a in enumerate(axes)))


def nlms(signal: np.ndarray, reference: np.ndarray, weights: np.ndarray, line: np.ndarray, rate: float, eps: float = 1e-6) -> np.ndarray:
    """Signal (rows, channels) less what the delayed reference (rows, axes) explains; ``weights`` and ``line`` go on in place.

    A row with a missing reference passes; a missing sample of a channel stays missing and its weights wait.
    """
    out = signal.copy()
    for t in range(len(signal)):
        if np.isnan(reference[t]).any():
            continue
        line[1:] = line[:-1].copy()
        line[0] = reference[t]
        x = line.ravel()
        e = signal[t] - weights @ x
        ok = ~np.isnan(e)
        weights[ok] += rate / (x @ x + eps) * e[ok, None] * x
        out[t, ok] = e[ok]
    return out


def adaptive_filter(rows: DataFrame, channels: list[str], axes: list[str] = IMU_AXES, *, taps: int = 8, rate: float = 0.5, resets: int = 3) -> DataFrame:
    """NLMS over the rows of windows whose ``level`` is nlms; others pass, and gated ones go.

    ``rows``: session_id, win, seq, level, the channels and the reference axes.  The state of a session lives on from
    window to window and starts anew after ``resets`` gated windows in a row.
    """
    if not 0 < rate < 2:
        raise ValueError("the step must lie between 0 and 2")
    kept = ["session_id", "win", "seq", *channels]
    schema = "session_id bigint, win bigint, seq bigint, " + ", ".join(f"{c} double" for c in channels)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now = weights = line = None
        gated, last = 0, None
        for frame in frames:
            out = []
            for (session, win), own in frame.groupby(["session_id", "win"], sort=False):
                if session != now or weights is None:
                    now, weights, line, gated, last = session, np.zeros((len(channels), taps * len(axes))), np.zeros((taps, len(axes))), 0, None
                level = own["level"].iloc[0]
                if level == "gated":
                    gated += last != win  # a window may come in two frames
                    if gated >= resets:
                        weights[:], line[:] = 0, 0
                else:
                    gated = 0
                    own = own[kept].copy()
                    if level == "nlms":
                        own[channels] = nlms(own[channels].to_numpy(float), frame.loc[own.index, axes].to_numpy(float), weights, line, rate)
                    out.append(own)
                last = win
            if out:
                yield pd.concat(out)

    dealt = rows.select("session_id", "win", "seq", "level", *channels, *axes).repartition("session_id").sortWithinPartitions("session_id", "win", "seq")
    made = dealt.mapInPandas(run, schema)
    return made.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in channels})
