"""Times: packets, dejittering, down-sampling, anchors, session matching, segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import session_seconds


def packet_samples(packets: DataFrame, fs: float) -> DataFrame:
    """Rows ``session_id, packet, ts, samples``: one row per sample, dated back from the packet's time."""
    out = packets.select("session_id", "packet", "ts", F.size("samples").alias("_n"), F.posexplode("samples").alias("i", "value"))
    return out.withColumn("time", F.col("ts") - (F.col("_n") - 1 - F.col("i")) / fs).drop("_n", "ts")


def dejitter(rows: DataFrame, chunk: int, keys: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """Times replaced by their least-squares line over the row number within each chunk; a chunk of one row stays."""
    w = Window.partitionBy(*keys, "_chunk")
    out = rows.withColumn("_chunk", F.floor(F.col("seq") / chunk)).withColumn("_x", F.col("seq").cast("double"))
    start = F.min("time").over(w)  # seconds since the epoch are too large to square
    slope = F.regr_slope(F.col("time") - F.col("_t0"), F.col("_x")).over(w)
    mean_t, mean_x = F.avg(F.col("time") - F.col("_t0")).over(w), F.avg("_x").over(w)
    line = F.col("_t0") + mean_t + slope * (F.col("_x") - mean_x)
    return out.withColumn("_t0", start).withColumn("time", F.when(F.count(F.lit(1)).over(w) > 1, line).otherwise(F.col("time"))).drop("_chunk", "_x", "_t0")


def corrected(rows: DataFrame, correction: str, offset: float) -> DataFrame:
    """Stream times to the clock: plus the correction measured last (a column) and the offset between the clocks."""
    last = F.last(correction, ignorenulls=True).over(Window.partitionBy("session_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("time", F.col("time") + F.coalesce(last, F.lit(0.0)) + offset)


def dejitter_sliding(rows: DataFrame, chunk: Column, width: int, keys: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """Times of each chunk replaced by a least-squares line over the last ``width`` rows up to the chunk's end.

    The line runs over the row number ``seq``.  A chunk of one row keeps its time and no line uses it.
    """
    own = Window.partitionBy(*keys, "_c")
    marked = rows.withColumn("_c", chunk).withColumn("_n", F.count(F.lit(1)).over(own)).withColumn("_x", F.col("seq").cast("double")).withColumn("_t0", F.min("time").over(Window.partitionBy(*keys)))
    many = marked.filter("_n > 1").withColumn("_t", F.col("time") - F.col("_t0"))
    frame = Window.partitionBy(*keys).orderBy("seq").rowsBetween(-(width - 1), 0)
    fits = many.withColumns({"_s": F.regr_slope("_t", "_x").over(frame), "_mt": F.avg("_t").over(frame), "_mx": F.avg("_x").over(frame)})
    last = lambda c: F.last(c).over(own.orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    line = F.col("_t0") + last("_mt") + last("_s") * (F.col("_x") - last("_mx"))
    made = fits.withColumn("time", line).select(*rows.columns)
    return made.unionByName(marked.filter("_n = 1").select(*rows.columns))


def downsample(rows: DataFrame, most: int, keys: tuple[str, ...] = ("session_id",), order: str = "seq") -> DataFrame:
    """At most ``most`` evenly spaced rows per key, both ends kept, places rounded half to even.

    Row i is one of the evenly spaced places if ``rint(k * step) = i`` with ``step = (n - 1) / (most - 1)``; only the k next to ``i / step`` can be.
    """
    w = Window.partitionBy(*keys)
    out = rows.withColumn("_i", F.row_number().over(w.orderBy(order)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    if most < 2:
        return out.filter((F.col("_n") <= most) | (F.col("_i") < most)).drop("_i", "_n")
    step = (F.col("_n") - 1) / F.lit(float(most - 1))
    middle = F.rint(F.col("_i") / step)
    hit = lambda d: (middle + d >= 0) & (middle + d <= most - 1) & (F.rint((middle + d) * step) == F.col("_i"))
    return out.filter((F.col("_n") <= most) | hit(0) | hit(-1) | hit(1)).drop("_i", "_n")


def anchored(rows: DataFrame, session: str = "session_id", keys: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """Times shifted so that the first is the time that the session's name gives; sessions of other names stay."""
    shift = session_seconds(F.col(session)) - F.min_by("time", "seq").over(Window.partitionBy(*keys))
    return rows.withColumn("time", F.col("time") + F.coalesce(shift, F.lit(0.0)))


def near_sessions(left: DataFrame, right: DataFrame, seconds: float = 120.0) -> DataFrame:
    """Pairs (session, other) whose starts are less than ``seconds`` apart: an equi-join on buckets, then the exact test.

    Buckets are a sixteenth of ``seconds`` wide, so that few pairs fail the test and a busy hour is dealt over many tasks; the number of tasks is fixed, as the
    rows are few beside the pairs that they make.
    """
    bucket = lambda c: F.floor(F.col(c) / (seconds / 16)).cast("bigint")
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a = left.select("session", "start").withColumn("_b", F.explode(F.sequence(bucket("start") - 17, bucket("start") + 17)))
    b = right.select(F.col("session").alias("other"), F.col("start").alias("other_start")).withColumn("_b", bucket("other_start"))
    return a.repartition(tasks, "_b").join(b.repartition(tasks, "_b"), "_b").filter(F.abs(F.col("start") - F.col("other_start")) < seconds).select("session", "other", (F.col("other_start") - F.col("start")).alias("delta"))


def in_intervals(samples: DataFrame, intervals: DataFrame, width: float) -> DataFrame:
    """Samples (session_id, time, ...) inside intervals (session_id, id, start_ts, end_ts; start included, end not).

    Intervals are posted into each stretch of ``width`` seconds that they meet, so the join is on equal keys.
    """
    at = lambda c: F.floor(F.col(c) / width).cast("bigint")
    held = intervals.filter("end_ts > start_ts").withColumn("_b", F.explode(F.sequence(at("start_ts"), at("end_ts"))))
    return held.join(samples.withColumn("_b", at("time")), ["session_id", "_b"]).filter("time >= start_ts and time < end_ts").drop("_b")
