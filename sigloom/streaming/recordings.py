"""Streams of recordings: new segment files exactly once, count windows, smoothing, down-sampling, sinks.

Rows of a session are trusted to arrive in order of ``seq`` from one micro-batch to the next, as they do from
segment files; within a micro-batch they are sorted.  State is what a window, a mean or a fit still needs, never a history.
A restart goes on from the checkpoint, and file sinks commit each micro-batch once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import scalars as X
from ..schemas import PREFIXES, SEGMENTS
from ..sources.segments import segment_of, session_of


def segment_stream(spark: SparkSession, root: str, kind: str, *, files_a_batch: int = 100) -> DataFrame:
    """New segment files under ``root``, each once, oldest first: the segment's columns, session_id, segment and path."""
    rows = spark.readStream.schema(SEGMENTS[kind]).option("header", True).option("maxFilesPerTrigger", files_a_batch).option("pathGlobFilter", f"{PREFIXES[kind]}_seg*.csv").option("recursiveFileLookup", True).csv(root)
    path = F.col("_metadata.file_path")
    return rows.select(*SEGMENTS[kind].names, session_of(path).alias("session_id"), segment_of(path).alias("segment"), path.alias("path"))


def rows_stream(spark: SparkSession, folder: str, schema: str, *, files_a_batch: int | None = 1) -> DataFrame:
    """Parquet files of a folder as a stream; with None for ``files_a_batch`` all that are new make one micro-batch."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_a_batch) if files_a_batch else reader).parquet(folder)


def replayed(parts: Iterable[DataFrame], folder: str, run: Callable[[DataFrame], object]):
    """Rows that come in parts: each is written by as many tasks as hold it and makes one micro-batch of the stream that ``run`` takes up again from its
    checkpoint.  Returns what the last run did."""
    out = None
    for part in parts:
        part.write.mode("append").parquet(folder)
        out = run(rows_stream(part.sparkSession, folder, part.schema, files_a_batch=None))
    return out


def _stateful(rows: DataFrame, out: str, state: str, step: Callable, order: str, flush: bool = False) -> DataFrame:
    """``step(state, sorted rows, session) -> (new state, rows out)`` per session and micro-batch."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        own = pd.concat(list(frames)).sort_values(order, kind="stable")  # a session's share of one micro-batch
        now, made = step(held.get if held.exists else None, own, key[0])
        held.update(now)
        yield made

    return rows.groupBy("session_id").applyInPandasWithState(run, out, state, "append", GroupStateTimeout.NoTimeout)


def epochs(rows: DataFrame, size: int, channels: list[str]) -> DataFrame:
    """Whole epochs of ``size`` rows as they fill up: session_id, epoch, ch, timestamp, n, x; a rest waits for the next micro-batch.

    The same rows as the batch ``features.epochs`` but for an unfinished tail.
    """
    names = ["time", *channels]

    def step(state, own: pd.DataFrame, session):
        count, *held = state if state else (0, *([] for _ in names))
        columns = [[*old, *own[c].tolist()] for old, c in zip(held, names)]
        whole = len(columns[0]) // size
        out = [(session, count + k, ch, columns[0][k * size], size, columns[1 + i][k * size : (k + 1) * size]) for k in range(whole) for i, ch in enumerate(channels)]
        return (count + whole, *(c[whole * size :] for c in columns)), pd.DataFrame(out, columns=["session_id", "epoch", "ch", "timestamp", "n", "x"])

    state = "count bigint, " + ", ".join(f"{n} array<double>" for n in names)
    return _stateful(rows.select("session_id", "seq", *names), "session_id bigint, epoch bigint, ch string, timestamp double, n bigint, x array<double>", state, step, "seq")


def smooth(rows: DataFrame, columns: list[str], score: str, *, width: int = 5, order: str = "epoch") -> DataFrame:
    """Trailing means over ``width`` rows across micro-batches, once full, with the level of the smoothed score."""

    def step(state, own: pd.DataFrame, session):
        before = pd.DataFrame(dict(zip([order, *columns], state))) if state else own[[order, *columns]].iloc[:0]
        every = pd.concat([before, own[[order, *columns]]], ignore_index=True)
        means = every[columns].rolling(width, min_periods=width).mean()
        full = max(len(before), width - 1)  # rows before this one have no full window, or were returned already
        made = pd.concat([every[[order]], means], axis=1).iloc[full:]
        made.insert(0, "session_id", session)
        left = every.iloc[-(width - 1) :] if width > 1 else every.iloc[:0]
        return tuple(left[c].tolist() for c in [order, *columns]), made

    state = f"{order} array<bigint>, " + ", ".join(f"{c} array<double>" for c in columns)
    out = _stateful(rows.select("session_id", order, *columns), f"session_id bigint, {order} bigint, " + ", ".join(f"{c} double" for c in columns), state, step, order)
    return out.withColumn("level", X.level(F.col(score)))


def every_nth(rows: DataFrame, n: int) -> DataFrame:
    """Down-sampling that needs no state: rows whose number in the session is a multiple of ``n``."""
    return rows.filter(F.col("seq") % n == 0)


def windowed_means(rows: DataFrame, value: str, *, length: str = "10 seconds", slide: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """Event-time windows over ``ts`` (timestamp): n and mean; rows later than ``late`` are dropped.  The watermark is an extension: order was only trusted before."""
    return rows.withWatermark("ts", late).groupBy("session_id", F.window("ts", length, slide)).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean")).select("session_id", F.col("window.start").alias("start"), "n", "mean")


def run_available(stream: DataFrame, folder: str, checkpoint: str) -> DataFrame:
    """Process what is there, write Parquet once per micro-batch, return the files as a DataFrame; call again for what has come since."""
    stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(folder).awaitTermination()
    return stream.sparkSession.read.parquet(folder)


def live_latest(stream: DataFrame, values: list[str], show: Callable[[DataFrame, int], None], checkpoint: str, order: str = "epoch"):
    """Per micro-batch only the last row of each session goes to ``show``."""

    def batch(df: DataFrame, number: int) -> None:
        show(df.groupBy("session_id").agg(*(F.max_by(v, order).alias(v) for v in values)), number)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
