"""Artifact subspace reconstruction: calibration on a clean baseline, its quality, windows cleaned against it.

Second moments of windows are Spark aggregates; what goes to the driver is one 4 by 4 matrix.  The published method:
Mullen et al., Real-time neuroimaging and cognitive monitoring using wearable dry EEG, IEEE TBME 2015.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .clean import _field, process

STATE = "channels array<string>, cutoff double, seconds double, cov array<array<double>>, mixing array<array<double>>, threshold array<array<double>>"


def window_moments(wide: DataFrame, channels: list[str], keys: tuple[str, ...]) -> DataFrame:
    """Per window without missing samples: n and the products' means, row by row, as one array."""
    products = [F.avg(F.col(a) * F.col(b)) for a in channels for b in channels]
    known = wide.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(F.least(*(F.col(c).isNotNull().cast("int") for c in channels))).alias("_full"), F.array(*products).alias("cov"))
    return known.filter("_full = 1").drop("_full")


def calibrate(baseline: DataFrame, channels: list[str], fs: float, *, cutoff: float = 15.0, keys: tuple[str, ...] = ("session_id", "win")) -> DataFrame:
    """One row of ``STATE`` from the windows of a baseline: the median of the windows' second moments, its square root, and per
    component the mean plus ``cutoff`` deviations of the windows' root mean squares."""
    spark, k = baseline.sparkSession, len(channels)
    moments = window_moments(baseline, channels, keys)
    middle = moments.agg(*(F.percentile(F.get("cov", F.lit(i)), F.lit(0.5)).alias(f"m{i}") for i in range(k * k)), F.sum("n").alias("n")).first()
    if middle.n is None:
        return spark.createDataFrame([], STATE)
    cov = np.array([middle[f"m{i}"] for i in range(k * k)]).reshape(k, k)
    values, vectors = np.linalg.eigh((cov + cov.T) / 2)
    mixing = vectors @ np.diag(np.sqrt(np.maximum(values, 0))) @ vectors.T
    _, vectors = np.linalg.eigh(mixing)
    power = [sum(F.get("cov", F.lit(i * k + j)) * float(vectors[i, c] * vectors[j, c]) for i in range(k) for j in range(k)) for c in range(k)]
    level = moments.agg(*(f(F.sqrt(F.greatest(p, F.lit(0.0)))).alias(f"{n}{c}") for c, p in enumerate(power) for n, f in (("a", F.avg), ("s", F.stddev_pop)))).first()
    threshold = np.diag([level[f"a{c}"] + cutoff * level[f"s{c}"] for c in range(k)]) @ vectors.T
    return spark.createDataFrame([(channels, float(cutoff), middle.n / fs, cov.tolist(), mixing.tolist(), threshold.tolist())], STATE)


def baseline_quality(state: DataFrame, *, least: float = 15.0, wanted: float = 30.0, imbalance: float = 3.0, extreme: float = 50.0) -> DataFrame:
    """Adds ok, warns and errors to rows of ``STATE``; an unknown duration is not checked."""
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    diagonal = F.transform("cov", lambda row, i: F.get(row, i))
    total = F.aggregate("_d", F.lit(0.0), lambda a, v: a + v)
    others = lambda v: (total - v) / (F.size("_d") - 1)
    heavy = F.filter(F.transform("_d", lambda v, i: F.when((others(v) > 0) & (v > others(v) * imbalance), F.concat(F.lit("imbalance CH"), (i + 1).cast("string")))), lambda m: m.isNotNull())
    flat = F.flatten("threshold")
    said = lambda when, text: F.when(when, F.array(F.lit(text))).otherwise(F.array().cast("array<string>"))
    known, sound = F.col("cov").isNotNull(), F.forall("_d", finite)
    t_known, t_sound = F.col("threshold").isNotNull(), F.forall(flat, finite)
    errors = F.concat(
        said(F.col("seconds") < least, "too short"),
        said(~known, "no covariance"),
        F.when(known & sound, heavy).otherwise(said(known & ~sound, "covariance not finite")),
        said(t_known & ~t_sound, "threshold not finite"),
    )
    warns = F.concat(said((F.col("seconds") >= least) & (F.col("seconds") < wanted), "short"), said(t_known & t_sound & (F.array_max(F.transform(flat, F.abs)) > extreme), "extreme threshold"))
    return state.withColumn("_d", diagonal).withColumn("errors", errors).withColumn("warns", warns).withColumn("ok", F.size("errors") == 0).drop("_d")


def reconstruct(x: np.ndarray, mixing: np.ndarray, threshold: np.ndarray) -> np.ndarray:
    """A window (rows, channels): components whose power exceeds the baseline's are rebuilt from the others through the mixing matrix."""
    values, vectors = np.linalg.eigh(x.T @ x / len(x))
    keep = values < ((threshold @ vectors) ** 2).sum(0)
    if keep.all():
        return x
    inner = vectors.T @ mixing
    rebuild = mixing @ np.linalg.pinv(keep[:, None] * inner) @ vectors.T
    return x @ rebuild.T


def clean_windows(wide: DataFrame, state: DataFrame, channels: list[str], keys: tuple[str, ...] = ("session_id", "win")) -> DataFrame:
    """Windows of a wide frame cleaned against a calibration (at most one row; none: unchanged).  Windows with missing samples stay as they are."""
    held = state.select("mixing", "threshold").first()
    if held is None:
        return wide
    mixing, threshold = np.array(held.mixing), np.array(held.threshold)

    @F.pandas_udf("array<array<double>>")
    def kernel(samples: pd.Series) -> pd.Series:
        out = []
        for s in samples:
            x = np.array([[np.nan if v is None else v for v in row] for row in s], dtype=float).T
            if not np.isnan(x).any():
                x = reconstruct(x, mixing, threshold)
            out.append([[None if np.isnan(v) else float(v) for v in c] for c in x.T])
        return pd.Series(out)

    rest = [c for c in wide.columns if c not in (*keys, *channels, "seq")]
    made = wide.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("seq", *rest, *channels))).alias("_s"))
    made = made.withColumn("_y", kernel(F.array(*(_field("_s", c) for c in channels))))
    out = made.select(*keys, F.posexplode("_s").alias("_i", "_r"), "_y")
    value = lambda c: F.get(F.get("_y", F.lit(channels.index(c))), F.col("_i")) if c in channels else F.col(f"_r.{c}")
    return out.select(*(F.col(c) if c in keys else value(c).alias(c) for c in wide.columns))


def save(state: DataFrame, path: str) -> None:
    state.write.mode("overwrite").parquet(path)


def load(spark, path: str) -> DataFrame:
    """A stored calibration with its quality; its duration is taken as unknown."""
    held = spark.read.parquet(path)
    return baseline_quality(held.withColumn("seconds", F.lit(None).cast("double"))).withColumn("seconds", F.lit(None).cast("double"))


def recorded(rows: DataFrame, start: Column, stop: Column, size: int) -> DataFrame:
    """Rows of a baseline recording from ``start`` to ``stop`` in whole windows of ``size`` rows: adds ``win``; the rest goes."""
    inside = rows.filter((F.col("time") >= start) & (F.col("time") < stop))
    numbered = inside.withColumn("_k", F.row_number().over(Window.partitionBy("session_id").orderBy("seq")) - 1).withColumn("win", F.floor(F.col("_k") / size).cast("bigint"))
    full = F.count(F.lit(1)).over(Window.partitionBy("session_id", "win"))
    return numbered.withColumn("_n", full).filter(F.col("_n") == size).drop("_k", "_n")


def calibrate_recording(windows: DataFrame, channels: list[str], fs: float, *, cutoff: float = 15.0, **cleaning) -> DataFrame:
    """Calibration on recorded windows (session_id, recording, win, seq, time, channels), each cleaned as a whole first."""
    keys = ("session_id", "recording", "win")
    return calibrate(process(windows.select(*keys, "seq", "time", *channels), fs, channels, keys, **cleaning), channels, fs, cutoff=cutoff, keys=keys)
