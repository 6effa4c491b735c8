"""Cleaning of windows: baseline, gaps, outliers, masks, scaling, zero-phase filters.

Long frames ``session_id, seq, time, ch, value``; ``keys`` name what one window is.  All but the filter are
window expressions that share one exchange and one sort.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHANNEL = ("session_id", "ch")


def sample_rate(time: str = "time", seq: str = "seq") -> Column:
    """Aggregate: rows less one over the time between the first and the last row."""
    return F.try_divide(F.count(F.lit(1)) - 1, F.max_by(time, seq) - F.min_by(time, seq))


def drop_empty(wide: DataFrame, channels: list[str]) -> DataFrame:
    """Rows without a sample in any channel go."""
    return wide.dropna(how="all", subset=channels)


def baseline(rows: DataFrame, fs: float, span: tuple[float, float] = (0.0, 0.2), keys: tuple[str, ...] = CHANNEL) -> DataFrame:
    """Less the mean of the window's rows in ``span`` seconds; a window without samples there becomes NULL."""
    w = Window.partitionBy(*keys)
    i = F.row_number().over(w.orderBy("seq")) - 1
    inside = (F.col("_i") >= int(span[0] * fs)) & (F.col("_i") < int(span[1] * fs))
    return rows.withColumn("_i", i).withColumn("value", F.col("value") - F.avg(F.when(inside, F.col("value"))).over(w)).drop("_i")


def outliers_to_null(rows: DataFrame, threshold: float = 800.0) -> DataFrame:
    return rows.withColumn("value", F.when(F.abs("value") <= threshold, F.col("value")))


def fill_gaps(rows: DataFrame, keys: tuple[str, ...] = CHANNEL) -> DataFrame:
    """Missing samples by the straight line between their neighbours in row order, the nearest sample at both edges."""
    w = Window.partitionBy(*keys).orderBy("seq")
    point = F.when(F.col("value").isNotNull(), F.struct("seq", "value"))
    out = rows.withColumn("_a", F.last(point, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_b", F.first(point, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    share = (F.col("seq") - F.col("_a.seq")) / (F.col("_b.seq") - F.col("_a.seq"))
    line = F.col("_a.value") + (F.col("_b.value") - F.col("_a.value")) * share
    filled = F.when(F.col("value").isNotNull(), F.col("value")).when(F.col("_a").isNull(), F.col("_b.value")).when(F.col("_b").isNull(), F.col("_a.value")).otherwise(line)
    return out.withColumn("value", filled).drop("_a", "_b")


def dilated(flag: Column, margin: int, keys: tuple[str, ...], order: str = "seq") -> Column:
    """Whether a row within ``margin`` rows has the flag."""
    return F.max(flag).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(-margin, margin))


def min_max(value: str = "value", keys: tuple[str, ...] = CHANNEL) -> Column:
    w = Window.partitionBy(*keys)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return F.when(high > low, (F.col(value) - low) / (high - low))


def z_score(value: str = "value", keys: tuple[str, ...] = CHANNEL) -> Column:
    """Sample standard deviation; NULL where it is 0 or unknown."""
    w = Window.partitionBy(*keys)
    sd = F.stddev_samp(value).over(w)
    return F.when(sd > 0, (F.col(value) - F.avg(value).over(w)) / sd)


def butterworth(order: int, edges: list[float], fs: float, kind: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """Second-order sections of a digital Butterworth filter (``low``, ``high``, ``band`` or ``stop``) by the bilinear transform."""
    warped = [2 * fs * np.tan(np.pi * e / fs) for e in edges]
    angles = np.pi * (2 * np.arange(order) + order + 1) / (2 * order)
    poles = np.exp(1j * angles)
    if kind == "low":
        p, z = poles * warped[0], np.zeros(0)
    elif kind == "high":
        p, z = warped[0] / poles, np.zeros(order)
    elif kind == "band":
        width, centre = warped[1] - warped[0], np.sqrt(warped[0] * warped[1])
        half = width * poles / 2
        root = np.sqrt(half**2 - centre**2)
        p, z = np.concatenate([half + root, half - root]), np.zeros(order)
    else:
        width, centre = warped[1] - warped[0], np.sqrt(warped[0] * warped[1])
        half = width / (2 * poles)
        root = np.sqrt(half**2 - centre**2)
        p, z = np.concatenate([half + root, half - root]), np.concatenate([np.full(order, 1j * centre), np.full(order, -1j * centre)])
    move = lambda s: (2 * fs + s) / (2 * fs - s)
    p, z = move(p), np.concatenate([move(z), np.full(len(p) - len(z), -1.0)])
    middle = 2 * np.arctan(np.sqrt(warped[0] * warped[-1]) / (2 * fs))
    at = {"low": 1.0, "high": -1.0, "stop": 1.0, "band": np.exp(1j * middle)}[kind]  # where the gain is 1
    up = lambda v: sorted((c for c in v if c.imag > 1e-9), key=lambda c: (c.real, c.imag))
    paired = lambda v: [x for c in up(v) for x in (c, np.conj(c))] + sorted(c for c in np.real(v[np.abs(v.imag) <= 1e-9]))
    p, z = paired(p), paired(z)
    out = []
    for i in range(0, len(p), 2):
        b, a = np.poly(z[i : i + 2]).real, np.poly(p[i : i + 2]).real
        out.append((b * np.abs(np.polyval(a, at) / np.polyval(b, at)), a))
    return out


def _one_way(x: np.ndarray, b: np.ndarray, a: np.ndarray) -> np.ndarray:
    """One second-order section over the rows of ``x`` (time along axis 0), from its steady state at the first row.  A section's coefficients are alike for all columns or given per column."""
    b, a = (np.reshape(c, (len(c), -1)) for c in (b, a))
    if len(b) < 3:
        b, a = (np.concatenate([c, np.zeros((3 - len(c), c.shape[1]))]) for c in (b, a))
    level = b.sum(0) / a.sum(0)
    one, two = ((b[k:] - a[k:] * level).sum(0) * x[0] for k in (1, 2))
    out = np.empty_like(x)
    for t, v in enumerate(x):
        y = b[0] * v + one
        one = two + b[1] * v - a[1] * y
        two = b[2] * v - a[2] * y
        out[t] = y
    return out


def padding(sections: list[tuple[np.ndarray, np.ndarray]]) -> int:
    """Rows that continue each end: three times the order plus one.  A window must hold more rows than that."""
    return 3 * (sum(len(a) - 1 for _, a in sections) + 1)


def filtfilt(x: np.ndarray, sections: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Forward and backward, the ends continued by odd reflection."""
    pad = padding(sections)
    y = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    for _ in range(2):
        for b, a in sections:
            y = _one_way(y, b, a)
        y = y[::-1]
    return y[pad : pad + len(x)]


def zero_phase(steps: list[list[tuple[np.ndarray, np.ndarray]]]):
    """Kernel from the samples of a window to the filtered samples; NULL where a sample is missing or the window is too short.

    All windows of one length in a batch go through the recurrence together, one step of it for all.
    """
    least = max(padding(s) for s in steps)

    @F.pandas_udf("array<double>")
    def kernel(samples: pd.Series) -> pd.Series:
        out, sizes = np.empty(len(samples), object), {}
        for i, s in enumerate(samples):
            if s is not None and len(s) > least:
                x = np.asarray(s, dtype=float)
                if not np.isnan(x).any():
                    sizes.setdefault(len(x), []).append((i, x))
        for own in sizes.values():
            y = np.stack([x for _, x in own], axis=1)
            for s in steps:
                y = filtfilt(y, s)
            for k, (i, _) in enumerate(own):
                out[i] = y[:, k]
        return pd.Series(out)

    return kernel


def _field(rows: str, name: str) -> Column:
    """One field of an array of structs, as an array."""
    return F.transform(rows, lambda v: v[name])


def filter_steps(fs: float, high: float = 1.0, low: float = 30.0, notch: tuple[float, float] = (49.0, 51.0), order: int = 5) -> list[list[tuple[np.ndarray, np.ndarray]]]:
    """High-pass, low-pass and notch; an error where the rate cannot carry their edges."""
    if fs <= 2 * max(high, low, *notch):
        raise ValueError(f"a rate of {fs} Hz cannot carry filters up to {max(high, low, *notch)} Hz")
    return [butterworth(order, [high], fs, "high"), butterworth(order, [low], fs, "low"), butterworth(order, [*notch], fs, "stop")]


def filter_windows(wide: DataFrame, fs: float, channels: list[str], keys: tuple[str, ...], **filters) -> DataFrame:
    """High-pass, low-pass and notch of each window of a wide frame; channels with missing samples and windows of at most 33 rows become NULL.

    A recurrence over samples is no window frame, so the samples of a window (bounded by its keys) meet as one
    array per channel and the arrays go through an Arrow kernel.
    """
    kernel = zero_phase(filter_steps(fs, **filters))
    rest = [c for c in wide.columns if c not in (*keys, "seq")]
    held = wide.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("seq", *(c for c in rest)))).alias("_s"))
    made = held.withColumns({f"_{c}": kernel(_field("_s", c)) for c in channels})
    out = made.select(*keys, F.posexplode("_s").alias("_i", "_r"), *(f"_{c}" for c in channels))
    value = lambda c: F.get(f"_{c}", F.col("_i")) if c in channels else F.col(f"_r.{c}")
    return out.select(*(F.col(c) if c in keys else value(c).alias(c) for c in wide.columns))


def select_channels(raw: DataFrame, names: dict[str, str]) -> DataFrame:
    """Required columns under their canonical names, keys kept; a missing one is an error."""
    return raw.select(*(c for c in ("session_id", "seq") if c in raw.columns), *(F.col(k).alias(v) for k, v in names.items()))


def adapt(raw: DataFrame, names: dict[str, str]) -> DataFrame:
    """Columns renamed where they exist."""
    return raw.withColumnsRenamed(names)


def dc_offset(rows: DataFrame, offset: float = 800.0) -> DataFrame:
    return rows.withColumn("value", F.col("value") - offset)


def correct_outliers(rows: DataFrame, threshold: float = 800.0, keys: tuple[str, ...] = CHANNEL) -> DataFrame:
    """Channels with a sample beyond the threshold have it and all their gaps filled; channels without one keep their gaps."""
    beyond = F.max(F.coalesce((F.abs("value") > threshold).cast("int"), F.lit(0))).over(Window.partitionBy(*keys))
    marked = rows.withColumn("_o", beyond).withColumn("_raw", F.col("value"))
    filled = fill_gaps(outliers_to_null(marked, threshold), keys)
    return filled.withColumn("value", F.when(F.col("_o") == 1, F.col("value")).otherwise(F.col("_raw"))).drop("_o", "_raw")


def repair_where(rows: DataFrame, wrong: Column, keys: tuple[str, ...] = CHANNEL, least: int = 2, otherwise: Column | None = None) -> DataFrame:
    """Samples for which ``wrong`` holds, by the line between good neighbours in row order; channels with fewer than ``least`` good samples become ``otherwise`` (unchanged if None)."""
    bad = F.coalesce(wrong, F.lit(False))
    good = F.sum((~bad & F.col("value").isNotNull()).cast("int")).over(Window.partitionBy(*keys))
    marked = rows.withColumn("_bad", bad).withColumn("_good", good).withColumn("_raw", F.col("value")).withColumn("value", F.when(~bad, F.col("value")))
    filled = fill_gaps(marked, keys)
    value = F.when(F.col("_good") < least, F.col("_raw") if otherwise is None else otherwise).when(F.col("_bad"), F.col("value")).otherwise(F.col("_raw"))
    return filled.withColumn("value", value).drop("_bad", "_good", "_raw")


def to_columns(rows: DataFrame, channels: list[str], keys: tuple[str, ...]) -> DataFrame:
    """Long rows back to one row per sample, a column to each channel."""
    return rows.groupBy(*keys).agg(*(F.max(F.when(F.col("ch") == c, F.col("value"))).alias(c) for c in channels))


def process(wide: DataFrame, fs: float, channels: list[str], keys: tuple[str, ...], *, threshold: float = 800.0, span: tuple[float, float] = (0.0, 0.2), **filters) -> DataFrame:
    """The cleaning of windows in order: empty rows go, baseline, outliers beyond ``threshold``, gaps, filters, dead channels.

    ``wide`` holds ``keys``, seq, time and the channels; it returns the same columns.
    """
    rows = drop_empty(wide, channels).unpivot([*keys, "seq", "time"], channels, "ch", "value")
    own = (*keys, "ch")
    rows = fill_gaps(correct_outliers(baseline(rows, fs, span, own), threshold, own), own)
    return repair_dead(filter_windows(to_columns(rows, channels, (*keys, "seq", "time")), fs, channels, keys, **filters), channels, keys).select(*wide.columns)


def repair_dead(wide: DataFrame, channels: list[str], keys: tuple[str, ...]) -> DataFrame:
    """A channel without samples in its window becomes the mean of its adjacent live channels; repairs do not cascade."""
    w = Window.partitionBy(*keys)
    alive = wide.withColumns({f"_{c}": F.count(c).over(w) > 0 for c in channels})
    made = {}
    for i, c in enumerate(channels):
        near = F.array(*(F.when(F.col(f"_{n}"), F.col(n)) for n in channels[max(0, i - 1) : i] + channels[i + 1 : i + 2]))
        held = F.filter(near, lambda v: v.isNotNull())
        mean = F.try_divide(F.aggregate(held, F.lit(0.0), lambda t, v: t + v), F.size(held))
        made[c] = F.when(F.col(f"_{c}"), F.col(c)).otherwise(mean)
    return alive.select(*(made[c].alias(c) if c in made else F.col(c) for c in wide.columns))
