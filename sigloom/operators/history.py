"""History of recordings: canonical sessions, catalogue, range loads, snapshots, series for display."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..schemas import BANDS, CHANNELS, PREFIXES
from .timebase import anchored, downsample

DAY = 86_400.0


def islands(sessions: DataFrame, seconds: float = 120.0) -> DataFrame:
    """Rows with ``start`` get ``island``: the start of the first row of their run of starts less than ``seconds`` apart.

    Runs are found within each day; one row per day tells the day after how the last one ended.
    """
    day = sessions.withColumn("_d", F.floor(F.col("start") / DAY).cast("bigint"))
    ends = day.groupBy("_d").agg(F.max("start").alias("_end"))
    w = Window.partitionBy("_d").orderBy("start")
    before = F.coalesce(F.lag("start").over(w), F.col("_end"))
    previous = ends.select((F.col("_d") + 1).alias("_d"), "_end")
    marked = day.join(previous, "_d", "left").withColumn("_new", F.when(before.isNull() | (F.col("start") - before >= seconds), F.col("start"))).drop("_end")
    own = marked.withColumn("island", F.last("_new", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    days = own.groupBy("_d").agg(F.max("_new").alias("_last")).withColumn("_carried", F.last("_last", ignorenulls=True).over(Window.orderBy("_d").rowsBetween(Window.unboundedPreceding, -1)))  # one row per day
    return own.join(days.select("_d", "_carried"), "_d", "left").withColumn("island", F.coalesce("island", "_carried")).drop("_d", "_new", "_carried")


def canonical(sessions: DataFrame, seconds: float = 120.0) -> DataFrame:
    """Rows (session, kind, start) with ``canonical``: in order of data type and name, the first canonical session less than
    ``seconds`` away, else the session itself.  Sessions farther apart than a run's gap never meet, so each run is decided alone.
    """
    rank = F.coalesce(F.array_position(F.array(*(F.lit(k) for k in PREFIXES)), F.col("kind")).cast("int"), F.lit(0))
    schema = "session string, kind string, start double, canonical string"

    def run(own: pd.DataFrame) -> pd.DataFrame:
        names, starts, out = [], [], []
        for s, t in zip(own["session"], own["start"]):
            k = next((i for i, u in enumerate(starts) if abs(t - u) < seconds), None)
            if k is None:
                names.append(s)
                starts.append(t)
                k = len(names) - 1
            out.append(names[k])
        return own[["session", "kind", "start"]].assign(canonical=out)

    placed = islands(sessions, seconds).withColumn("_rank", rank)
    return placed.groupBy("island").applyInPandas(lambda own: run(own.sort_values(["_rank", "session"])), schema)


def catalogue(placed: DataFrame) -> DataFrame:
    """Per canonical session, newest first: types (sorted), first start and last end with their texts.  ``placed``: canonical, kind, start, end."""
    out = placed.groupBy("canonical").agg(F.array_sort(F.collect_set("kind")).alias("types"), F.min("start").alias("start_ts"), F.max("end").alias("end_ts"))
    return out.withColumns({"start_text": X.date_text(F.col("start_ts")), "end_text": X.date_text(F.col("end_ts")), "display": X.session_text(F.col("canonical"))}).orderBy(F.desc("canonical"))


def in_range(rows: DataFrame, start: float | None = None, end: float | None = None, time: str = "time") -> DataFrame:
    """Rows from ``start`` to ``end``, both included, each optional; pushed down to the scan."""
    if start is not None:
        rows = rows.filter(F.col(time) >= start)
    return rows if end is None else rows.filter(F.col(time) <= end)


def load(rows: DataFrame, *, start: float | None = None, end: float | None = None, most: int = 3000, anchor: bool = False, keys: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """A series for display: anchored to the session's name if asked, cut to a range, at most ``most`` rows, with a clock text."""
    rows = anchored(rows, keys=keys) if anchor else rows
    return downsample(in_range(rows, start, end), most, keys).withColumn("clock", X.clock_text(F.col("time")))


def newest(rows: DataFrame, keys: tuple[str, ...], count: int, order: str = "seq") -> DataFrame:
    """The last ``count`` rows of each key."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    return rows.withColumn("_k", rank).filter(F.col("_k") <= count).drop("_k")


def snapshot(rows: DataFrame, values: list[str], count: int, keys: tuple[str, ...] = ("session_id",), order: str = "seq") -> DataFrame:
    """One row per key: the last ``count`` rows as one array per value, in order; at most ``count`` long."""
    held = newest(rows, keys, count, order).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, *values))).alias("s"))
    return held.select(*keys, *(F.col("s")[c].alias(c) for c in values))


def latest(rows: DataFrame, values: list[str], keys: tuple[str, ...] = ("session_id",), order: str = "seq") -> DataFrame:
    """The last row's values of each key."""
    return rows.groupBy(*keys).agg(*(F.max_by(c, order).alias(c) for c in values))


def padded(samples: Column, names: list[str]) -> list[Column]:
    """Columns from an array of samples, 0 where it is too short."""
    return [F.coalesce(F.get(samples, F.lit(i)), F.lit(0.0)).alias(n) for i, n in enumerate(names)]


def band_series(features: DataFrame, channels: list[str] = CHANNELS, bands: list[str] | None = None) -> DataFrame:
    """The band powers of a wide feature table only, nested by channel and band."""
    bands = bands or list(BANDS)
    rest = [c for c in ("session_id", "epoch", "timestamp") if c in features.columns]
    own = {ch: [b for b in bands if f"{ch}_{b}_power" in features.columns] for ch in channels}
    return features.select(*rest, *(F.struct(*(F.col(f"{ch}_{b}_power").alias(b) for b in held)).alias(ch) for ch, held in own.items() if held))


def offset_traces(samples: DataFrame, step: float = 150.0) -> DataFrame:
    """Rows with an array ``values`` to one row per channel, each trace ``step`` above the one before."""
    rest = [c for c in samples.columns if c != "values"]
    return samples.select(*rest, F.posexplode("values").alias("channel", "value")).withColumn("value", F.col("value") + F.col("channel") * step)


def session_report(attention: DataFrame, load_rows: DataFrame, markers: DataFrame, report: DataFrame) -> DataFrame:
    """The joint report with its series and markers: arrays per session, of rows that ``downsample`` has bounded."""
    def series(rows: DataFrame, values: list[str], name: str) -> DataFrame:
        return rows.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("epoch", *values))).alias(name))

    out = report.join(series(attention, ["attention_score", "level"], "attention_series"), "session_id", "left")
    out = out.join(series(load_rows, ["cog_load_score", "level"], "load_series"), "session_id", "left")
    marks = markers.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("id", "content", "start_ts", "end_ts"))).alias("markers"))
    return out.join(marks, "session_id", "left")
