"""Attention and cognitive-load indices with trailing smoothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as X


def channel_means(features: DataFrame, bands: list[str]) -> DataFrame:
    """Per session and epoch the mean power of each band over the channels that have one; none gives 0.  n_valid_ch counts them."""
    means = [F.coalesce(F.avg(f"{b}_power"), F.lit(0.0)).alias(b) for b in bands]
    return features.groupBy("session_id", "epoch").agg(F.min("timestamp").alias("timestamp"), *means, F.count(f"{bands[0]}_power").alias("n_valid_ch"))


def attention(features: DataFrame) -> DataFrame:
    m = channel_means(features, ["theta", "alpha", "beta"])
    tar, ei = X.ratio(F.col("theta"), F.col("alpha")), X.ratio(F.col("beta"), F.col("alpha") + F.col("theta"))
    return m.select("session_id", "epoch", "timestamp", "n_valid_ch", tar.alias("theta_alpha_ratio"), ei.alias("engagement_index"), X.attention_score(ei).alias("attention_score"))


def cognitive_load(features: DataFrame) -> DataFrame:
    m = channel_means(features, ["theta", "alpha"])
    ci = X.ratio(F.col("theta"), F.col("alpha"))
    return m.select("session_id", "epoch", "timestamp", "n_valid_ch", ci.alias("cognitive_load_index"), X.load_score(ci).alias("cog_load_score"))


def smooth(rows: DataFrame, columns: list[str], score: Column | str, *, width: int = 5, keys: tuple[str, ...] = ("session_id",), order: str = "epoch") -> DataFrame:
    """Trailing mean of ``width`` rows, only where it is full, with the level of the smoothed score."""
    w = Window.partitionBy(*keys).orderBy(order)
    frame = w.rowsBetween(-(width - 1), 0)
    full = rows.select("*", F.row_number().over(w).alias("_k")).withColumns({c: F.avg(c).over(frame) for c in columns})
    return full.filter(F.col("_k") >= width).drop("_k").withColumn("level", X.level(F.col(score) if isinstance(score, str) else score))
