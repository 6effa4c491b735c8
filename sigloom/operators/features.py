"""Epoch features: time domain by aggregates, spectrum by one Arrow kernel, bands by array functions.

Long frames: ``session_id, seq, time, ch, value``.  An epoch is ``size`` consecutive rows of a session; a tail
stays if it has at least ``max(1, size // 2)`` rows.  One exchange on (session, epoch, channel) serves all
features; an epoch's samples (bounded by ``size``) are the only arrays built.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import BANDS, CHANNELS, HIGH_BETA, LOW_BETA

TIME = ["mean", "std", "var", "skew", "kurtosis", "ptp", "zcr", "hjorth_activity", "hjorth_mobility", "hjorth_complexity"]
FREQUENCY = [f"{b}_power" for b in BANDS] + [f"{b}_rel" for b in BANDS] + ["total_power", "spectral_entropy"]


def to_long(wide: DataFrame, channels: list[str] = CHANNELS, keys: tuple[str, ...] = ("session_id", "seq", "time")) -> DataFrame:
    return wide.unpivot([*keys], channels, "ch", "value")


def to_wide(rows: DataFrame, names: list[str], channels: list[str] = CHANNELS, keys: tuple[str, ...] = ("session_id", "epoch", "timestamp")) -> DataFrame:
    """One row per key, columns ``{channel}_{name}`` in a fixed order."""
    return rows.groupBy(*keys).agg(*(F.max(F.when(F.col("ch") == c, F.col(n))).alias(f"{c}_{n}") for c in channels for n in names))


def epochs(rows: DataFrame, size: int) -> DataFrame:
    """One row per session, epoch and channel with its samples in order: timestamp, n, x (NULL where a sample is missing)."""
    least = max(1, size // 2)
    return (
        rows.groupBy("session_id", F.floor(F.col("seq") / size).cast("bigint").alias("epoch"), "ch")
        .agg(F.min_by("time", "seq").alias("timestamp"), F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("seq", "value"))).alias("s"))
        .filter(F.col("n") >= least)
        .withColumn("x", F.transform("s", lambda v: v["value"]))
        .drop("s")
    )


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda t, v: t + v)


def _moment(a: Column, mean: Column, k: int) -> Column:
    return _sum(F.transform(a, lambda v: F.pow(v - mean, F.lit(k)))) / F.size(a)


def _diff(a: Column) -> Column:
    return F.zip_with(F.slice(a, 2, F.greatest(F.size(a), F.lit(1))), F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), lambda x, y: x - y)


def _std(a: Column) -> Column:
    return F.sqrt(_moment(a, _sum(a) / F.size(a), 2))


def time_domain(frame: DataFrame) -> DataFrame:
    """Adds the ten time-domain features; NULL for epochs with missing samples."""
    full = ~F.exists("x", lambda v: v.isNull())
    x = F.when(full, F.col("x"))
    out = frame.withColumn("_x", x).withColumn("mean", _sum(F.col("_x")) / F.size("_x"))
    out = out.withColumn("var", _moment(F.col("_x"), F.col("mean"), 2)).withColumn("std", F.sqrt("var"))
    out = out.withColumn("_d1", _diff(F.col("_x")))
    out = out.withColumn("_s1", F.when(F.size("_d1") > 0, _std(F.col("_d1"))).otherwise(0.0)).withColumn("_d2", _diff(F.col("_d1")))
    out = out.withColumn("_s2", F.when(F.size("_d2") > 0, _std(F.col("_d2"))).otherwise(0.0))
    signs = F.transform("_x", lambda v: F.signum(v))
    turns = F.aggregate(F.zip_with(F.slice(signs, 2, F.size(signs)), F.slice(signs, 1, F.size(signs) - 1), lambda a, b: (a != b).cast("int")), F.lit(0), lambda t, v: t + v)
    known = F.col("_x").isNotNull()
    mobility = F.when(known, F.when(F.col("std") > 0, F.col("_s1") / F.col("std")).otherwise(0.0))
    out = out.withColumns({
        "skew": F.when(F.col("std") > 0, _moment(F.col("_x"), F.col("mean"), 3) / F.pow("var", F.lit(1.5))),
        "kurtosis": F.when(F.col("std") > 0, _moment(F.col("_x"), F.col("mean"), 4) / (F.col("var") * F.col("var")) - 3),
        "ptp": F.array_max("_x") - F.array_min("_x"),
        "zcr": F.when(F.size("_x") > 1, turns / F.size("_x")).when(known, F.lit(0.0)),
        "hjorth_activity": F.col("var"),
        "hjorth_mobility": mobility,
        "hjorth_complexity": F.when(known, F.when((F.col("_s1") > 0) & (mobility > 0), F.col("_s2") / F.col("_s1") / mobility).otherwise(0.0)),
    })
    return out.drop("_x", "_d1", "_d2", "_s1", "_s2")


def periodogram(x: np.ndarray, fs: float) -> np.ndarray:
    """One-sided density of rows of equal length: periodic Hann, mean removed."""
    n = x.shape[1]
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n) if n > 1 else np.ones(1)
    p = np.abs(np.fft.rfft((x - x.mean(1, keepdims=True)) * w)) ** 2 / (fs * (w**2).sum())
    p[:, 1 : (-1 if n % 2 == 0 else None)] *= 2
    return p


def psd(fs: float):
    """Vectorised kernel: array of samples to array of densities; epochs of one length go through one transform."""

    @F.pandas_udf("array<double>")
    def kernel(samples: pd.Series) -> pd.Series:
        out = np.empty(len(samples), object)
        ok = [i for i, s in enumerate(samples) if s is not None and len(s) > 0 and not np.isnan(np.asarray(s, dtype=float)).any()]
        sizes = {}
        for i in ok:
            sizes.setdefault(len(samples.iloc[i]), []).append(i)
        for own in sizes.values():
            for i, p in zip(own, periodogram(np.stack([np.asarray(samples.iloc[i], dtype=float) for i in own]), fs)):
                out[i] = p
        return pd.Series(out)

    return kernel


def band_power(p: Column, df: Column, low: float, high: float) -> Column:
    """Trapezoid over neighbouring bins that both lie in the closed band; no pair gives 0."""
    first, last = F.ceil(F.lit(low) / df - 1e-9).cast("int"), F.least(F.floor(F.lit(high) / df + 1e-9).cast("int"), F.size(p) - 1)
    pairs = F.zip_with(F.slice(p, first + 1, F.greatest(last - first, F.lit(0))), F.slice(p, first + 2, F.greatest(last - first, F.lit(0))), lambda a, b: (a + b) / 2)
    return F.when(last > first, _sum(pairs) * df).otherwise(0.0)


def frequency_domain(frame: DataFrame, fs: float) -> DataFrame:
    """Adds band powers (beta weighted against muscle activity), shares, total and spectral entropy; NULL without a spectrum."""
    out = frame.withColumn("_p", psd(fs)(F.col("x"))).withColumn("_df", F.lit(float(fs)) / F.col("n"))
    known = F.col("_p").isNotNull()
    out = out.withColumns({f"{b}_power": F.when(known, band_power(F.col("_p"), F.col("_df"), *r)) for b, r in BANDS.items()})
    out = out.withColumn("_low", F.when(known, band_power(F.col("_p"), F.col("_df"), *LOW_BETA))).withColumn("_high", F.when(known, band_power(F.col("_p"), F.col("_df"), *HIGH_BETA)))
    weight = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - (F.col("_high") / (F.col("_low") + 1e-10) - 1.5) / 1.5))
    out = out.withColumn("beta_power", F.col("_low") + weight * F.col("_high"))
    out = out.withColumn("total_power", sum((F.col(f"{b}_power") for b in list(BANDS)[1:]), F.col("delta_power")))
    out = out.withColumns({f"{b}_rel": F.when(known, F.when(F.col("total_power") > 0, F.col(f"{b}_power") / F.col("total_power")).otherwise(0.0)) for b in BANDS})
    share = F.transform("_p", lambda v: v / (F.col("_all") + 1e-12))
    out = out.withColumn("_all", _sum(F.col("_p"))).withColumn("_q", share).withColumn("spectral_entropy", F.when(known, -_sum(F.transform("_q", lambda q: q * F.log2(q + 1e-12)))))
    return out.drop("_p", "_df", "_low", "_high", "_all", "_q")


def epoch_features(rows: DataFrame, fs: float, size: int, *, time: bool = True, frequency: bool = True, channels: list[str] | None = None) -> DataFrame:
    """Features of each session, epoch and channel; the families and the channels can be switched."""
    own = rows if channels is None else rows.filter(F.col("ch").isin(channels))
    out = epochs(own, size)
    out = time_domain(out) if time else out
    out = frequency_domain(out, fs) if frequency else out
    return out.drop("x")


def hf_ratio(rows: DataFrame, fs: float, keys: list[str], nperseg: int = 256) -> DataFrame:
    """Share of 30-45 Hz in 1-45 Hz (sums of bins) of averaged half-overlapping segments; fewer than 32 samples give 0."""

    @F.pandas_udf("double")
    def kernel(samples: pd.Series) -> pd.Series:
        out = []
        for s in samples:
            x = np.asarray(s, dtype=float)
            n = min(nperseg, len(x))
            if len(x) < 32 or np.isnan(x).any():
                out.append(0.0)
                continue
            x = x - x.mean()
            segments = np.stack([x[a : a + n] for a in range(0, len(x) - n + 1, n - n // 2)])
            p = periodogram(segments, fs).mean(0)
            f = np.arange(len(p)) * fs / n
            total = p[(f >= 1) & (f <= 45)].sum()
            out.append(0.0 if total < 1e-12 else p[(f >= 30) & (f <= 45)].sum() / total)
        return pd.Series(out)

    return rows.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "value"))), lambda v: v["value"]).alias("_x")).withColumn("hf_ratio", kernel("_x")).drop("_x")
