"""Quality and gating: channel verdicts, blink gate, motion levels and runs of gated windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import norm3
from .clean import dilated


def saturated(x: Column, low: float = 1.0, high: float = 1449.0) -> Column:
    return (x <= low) | (x >= high)


def verdict(flat: Column, saturation: Column, hf: Column) -> Column:
    return F.when(flat | (saturation > 0.10) | (hf > 0.60), "bad").when((saturation > 0.05) | (hf > 0.40), "poor").otherwise("good")


def reason(flat: Column, saturation: Column, hf: Column) -> Column:
    sat, high = F.format_string("sat=%.1f%%", F.bround(saturation * 100, 1)), F.format_string("hf=%.2f", F.bround(hf, 2))  # half-even
    return F.when(flat, "flatline").when(saturation > 0.10, sat).when(hf > 0.60, high).when(saturation > 0.05, sat).when(hf > 0.40, high).otherwise("")


def assess(rows: DataFrame, keys: list[str], hf: DataFrame | None = None) -> DataFrame:
    """Per window and channel: sat_rate, flatline (population deviation below 1), hf_ratio (0 without ``hf``), quality, reason."""
    out = rows.groupBy(*keys).agg(F.avg(saturated(F.col("value")).cast("int")).alias("sat_rate"), (F.stddev_pop("value") < 1.0).alias("flatline"))
    out = out.withColumn("hf_ratio", F.lit(0.0)) if hf is None else out.join(hf, keys, "left")
    c = [F.col("flatline"), F.col("sat_rate"), F.coalesce("hf_ratio", F.lit(0.0))]
    return out.withColumn("quality", verdict(*c)).withColumn("reason", reason(*c))


def blink_gate(wide: DataFrame, channels: list[str], fs: float, keys: tuple[str, ...], threshold: float = 200.0, most: float = 0.30) -> DataFrame:
    """Per window: blink_detected, contamination (share of rows within 100 ms of a sample beyond the threshold) and whether it is kept."""
    over = F.greatest(*(F.coalesce(F.abs(F.col(c)) > threshold, F.lit(False)).cast("int") for c in channels))
    near = wide.withColumn("_over", over).withColumn("_near", dilated(F.col("_over"), max(1, int(0.1 * fs)), keys))
    out = near.groupBy(*keys).agg((F.max("_over") > 0).alias("blink_detected"), F.avg("_near").alias("contamination"), F.sum(1 - F.col("_near")).alias("_good"))
    return out.withColumn("kept", (F.col("contamination") <= most) & (F.col("_good") >= 2)).drop("_good")


def motion(imu: DataFrame, keys: list[str]) -> DataFrame:
    """Per window: gated, nlms or still, from exact 95th percentiles of acceleration and rotation."""
    acc, gyr = norm3(F.col("AccX"), F.col("AccY"), F.col("AccZ")), norm3(F.col("GyrX"), F.col("GyrY"), F.col("GyrZ"))
    m = imu.select(*keys, acc.alias("a"), gyr.alias("g")).groupBy(*keys).agg(F.percentile(F.abs(F.col("a") - 1), F.lit(0.95)).alias("acc95"), F.percentile("g", F.lit(0.95)).alias("gyr95"), F.stddev_pop("a").alias("acc_std"))
    gated, moved = (F.col("acc95") > 0.5) | (F.col("gyr95") > 30), (F.col("acc95") > 0.15) | (F.col("acc_std") > 0.05) | (F.col("gyr95") > 15)
    return m.withColumn("level", F.when(gated, "gated").when(moved, "nlms").otherwise("still"))


def gated_runs(levels: DataFrame, keys: tuple[str, ...] = ("session_id",), order: str = "win", least: int = 3) -> DataFrame:
    """Adds ``run`` (consecutive gated windows up to here) and ``reset`` (``least`` or more of them just ended or go on)."""
    w = Window.partitionBy(*keys).orderBy(order)
    broken = F.sum((F.col("level") != "gated").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = levels.withColumn("_island", broken)
    run = F.sum((F.col("level") == "gated").cast("int")).over(Window.partitionBy(*keys, "_island").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn("run", run).withColumn("reset", F.col("run") >= least).drop("_island")


def good_channels(verdicts: DataFrame) -> DataFrame:
    """Verdicts other than bad."""
    return verdicts.filter(F.col("quality") != "bad")


def masked(rows: DataFrame, verdicts: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Samples with their window's and channel's verdict; those of bad channels become NULL."""
    return rows.join(verdicts, list(keys)).withColumn("value", F.when(F.col("quality") != "bad", F.col("value")))
