"""Live forms of the steps that carry something from one window to the next, on Spark's keyed state.

Each is a ``StatefulProcessor`` per session.  State is what the step still needs: twenty medians, a set of weights, a ring of rows, a
window that is not full yet; never a history, and nothing is kept on the driver.  Rows of a session are trusted to come in order from one micro-batch to the
next; within one they are sorted.  Wherever a replay is cut into micro-batches, the rows that come out are those of the batch form.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.artifacts import nlms
from ..schemas import IMU_AXES

_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Ordered(StatefulProcessor):
    """A session's share of a micro-batch, sorted, goes to ``step``; a value state ``held`` of ``kind`` lives on in between."""

    order, kind = "seq", "n bigint"

    def init(self, handle) -> None:
        self.held = handle.getValueState("held", self.kind)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        own = pd.concat(list(rows)).sort_values(self.order, kind="stable", ignore_index=True)
        now, out = self.step(key[0], self.held.get() if self.held.exists() else None, own)
        self.held.update(now)
        yield out

    def step(self, session, held: tuple | None, own: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        raise NotImplementedError

    def close(self) -> None:
        pass


def keyed(rows: DataFrame, processor: StatefulProcessor, out: str, time_mode: str = "None") -> DataFrame:
    """A processor over the sessions of a stream, its state in RocksDB under the stream's checkpoint."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)
    return rows.groupBy("session_id").transformWithStateInPandas(processor, out, "Append", time_mode)


# blink threshold


class _Thresholds(StatefulProcessor):
    def __init__(self, fallback: float, factor: float, history: int):
        self.fallback, self.factor, self.history = fallback, factor, history

    def init(self, handle) -> None:
        self.held = handle.getListState("typical", "v double")

    def handleInputRows(self, key, rows, timerValues):
        own = pd.concat(list(rows)).sort_values("win", kind="stable")
        held = deque((v for (v,) in self.held.get()) if self.held.exists() else (), maxlen=self.history)
        out = []
        for win, peak, typical in zip(own["win"], own["peak"], own["typical"]):
            warm = len(held) >= self.history
            limit = self.factor * float(np.median(held)) if warm else self.fallback
            clean = bool(np.isnan(peak) or peak <= limit)
            if clean and not np.isnan(typical):
                held.append(typical)
            out.append((key[0], win, None if np.isnan(peak) else peak, None if np.isnan(typical) else typical, limit, warm, clean))
        if held:
            self.held.put([(v,) for v in held])
        yield pd.DataFrame(out, columns=["session_id", "win", "peak", "typical", "threshold", "warmed_up", "clean"])

    def close(self) -> None:
        pass


def adaptive_thresholds(peaks: DataFrame, *, fallback: float = 200.0, factor: float = 5.0, history: int = 20) -> DataFrame:
    """``artifacts.adaptive_thresholds`` on a stream of one row per window (session_id, win, peak, typical): a list state of clean medians."""
    rows = peaks.select("session_id", "win", F.col("peak").cast("double"), F.col("typical").cast("double"))
    return keyed(rows, _Thresholds(fallback, factor, history), "session_id bigint, win bigint, peak double, typical double, threshold double, warmed_up boolean, clean boolean")


class _Windows(Ordered):
    def __init__(self, size: int, columns: list[str]):
        self.size, self.columns = size, columns
        self.kind = "count bigint, " + ", ".join(f"`{c}` array<double>" for c in ("seq", *columns))

    def step(self, session, held, own):
        count, *before = held if held else (0, *([] for _ in range(len(self.columns) + 1)))
        every = {c: np.concatenate([np.array(b, float), own[c].to_numpy(float)]) for c, b in zip(("seq", *self.columns), before)}
        whole = len(every["seq"]) // self.size
        cut = whole * self.size
        made = pd.DataFrame({c: v[:cut] for c, v in every.items()})
        made.insert(0, "win", count + np.arange(cut) // self.size)
        made.insert(0, "session_id", session)
        made["seq"] = made["seq"].astype(np.int64)
        return (count + whole, *(v[cut:].tolist() for v in every.values())), made


def count_windows(rows: DataFrame, size: int, columns: list[str]) -> DataFrame:
    """Rows of whole windows of ``size`` rows as they fill up, numbered in ``win``; the rows of one that is not full wait in the state."""
    out = "session_id bigint, win bigint, seq bigint, " + ", ".join(f"`{c}` double" for c in columns)
    return keyed(rows.select("session_id", "seq", *columns), _Windows(size, columns), out)


class _Peaks(Ordered):
    def __init__(self, size: int, channels: list[str]):
        self.size, self.channels = size, channels
        self.kind = "n bigint, " + ", ".join(f"`{c}` double" for c in channels)

    def step(self, session, held, own):
        n, *top = held if held else (0, *(None for _ in self.channels))
        top, out = np.array([np.nan if v is None else v for v in top], float), []
        values = np.abs(own[self.channels].to_numpy(float))
        at = 0
        while at < len(values):
            take = min(self.size - n % self.size, len(values) - at)
            top = np.fmax(top, np.fmax.reduce(values[at : at + take], axis=0))
            n, at = n + take, at + take
            if n % self.size == 0:
                live = top[~np.isnan(top)]
                out.append((session, n // self.size - 1, live.max() if len(live) else None, float(np.median(live)) if len(live) else None))
                top = np.full(len(self.channels), np.nan)
        return (n, *(None if np.isnan(v) else float(v) for v in top)), pd.DataFrame(out, columns=["session_id", "win", "peak", "typical"])


def window_peaks(rows: DataFrame, size: int, channels: list[str]) -> DataFrame:
    """``artifacts.window_peaks`` of count windows as they fill up; the state is one highest magnitude per channel."""
    return keyed(rows.select("session_id", "seq", *channels), _Peaks(size, channels), "session_id bigint, win bigint, peak double, typical double")


# motion


class _Nlms(Ordered):
    kind = "weights array<double>, line array<double>, gated bigint, win bigint"

    def __init__(self, channels: list[str], axes: list[str], taps: int, rate: float, resets: int):
        self.channels, self.axes, self.taps, self.rate, self.resets = channels, axes, taps, rate, resets

    def step(self, session, held, own):
        shape, delays = (len(self.channels), self.taps * len(self.axes)), (self.taps, len(self.axes))
        weights, line, gated, last = (np.array(held[0]).reshape(shape), np.array(held[1]).reshape(delays), held[2], held[3]) if held else (np.zeros(shape), np.zeros(delays), 0, None)
        out = []
        for win, part in own.groupby("win", sort=False):
            level = part["level"].iloc[0]
            if level == "gated":
                gated += last != win  # a window may be cut by a micro-batch
                if gated >= self.resets:
                    weights[:], line[:] = 0, 0
            else:
                gated = 0
                part = part.copy()
                if level == "nlms":
                    part[self.channels] = nlms(part[self.channels].to_numpy(float), part[self.axes].to_numpy(float), weights, line, self.rate)
                out.append(part)
            last = int(win)
        columns = ["session_id", "win", "seq", *self.channels]
        own = (pd.concat(out) if out else own.iloc[:0]).assign(session_id=session)[columns]
        return (weights.ravel().tolist(), line.ravel().tolist(), int(gated), last), own


def adaptive_filter(rows: DataFrame, channels: list[str], axes: list[str] = IMU_AXES, *, taps: int = 8, rate: float = 0.5, resets: int = 3) -> DataFrame:
    """``artifacts.adaptive_filter`` on a stream (session_id, win, seq, level, channels, axes): weights, delay line and gated windows in a row are the state."""
    if not 0 < rate < 2:
        raise ValueError("the step must lie between 0 and 2")
    out = "session_id bigint, win bigint, seq bigint, " + ", ".join(f"`{c}` double" for c in channels)
    made = keyed(rows.select("session_id", "win", "seq", "level", *channels, *axes), _Nlms(channels, axes, taps, rate, resets), out)
    return made.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in channels})


class _Gate(Ordered):
    order, kind = "win", "run bigint"

    def __init__(self, least: int):
        self.least = least

    def step(self, session, held, own):
        run, out = held[0] if held else 0, []
        for win, level in zip(own["win"], own["level"]):
            run = run + 1 if level == "gated" else 0
            out.append((session, win, level, run, run >= self.least))
        return (run,), pd.DataFrame(out, columns=["session_id", "win", "level", "run", "reset"])


def gated_runs(levels: DataFrame, least: int = 3) -> DataFrame:
    """``quality.gated_runs`` on a stream of one row per window (session_id, win, level)."""
    return keyed(levels.select("session_id", "win", "level"), _Gate(least), "session_id bigint, win bigint, level string, run bigint, reset boolean")


# smoothing that is reset


class _Smooth(Ordered):
    def __init__(self, columns: list[str], width: int, order: str):
        self.columns, self.width, self.order = columns, width, order
        self.kind = "segment bigint, " + ", ".join(f"`{c}` array<double>" for c in columns)

    def step(self, session, held, own):
        segment, *rings = held if held else (0, *([] for _ in self.columns))
        rings, out = [deque(r, maxlen=self.width) for r in rings], []
        for at, reset, *values in zip(own[self.order], own["reset"], *(own[c] for c in self.columns)):
            if reset:  # a control row: what came before no longer counts
                segment += 1
                for ring in rings:
                    ring.clear()
                continue
            for ring, v in zip(rings, values):
                ring.append(float(v))
            if len(rings[0]) == self.width:
                out.append((session, segment, at, *(float(np.mean(r)) for r in rings)))
        return (segment, *(list(r) for r in rings)), pd.DataFrame(out, columns=["session_id", "segment", self.order, *self.columns])


def smooth(rows: DataFrame, columns: list[str], *, width: int = 5, order: str = "epoch") -> DataFrame:
    """Trailing means over ``width`` rows, once full.  A row whose ``reset`` is true carries no values: it clears the buffers and opens the next ``segment``."""
    made = rows.select("session_id", order, F.coalesce("reset", F.lit(False)).alias("reset"), *columns)
    return keyed(made, _Smooth(columns, width, order), f"session_id bigint, segment bigint, {order} bigint, " + ", ".join(f"`{c}` double" for c in columns))


# times


class _Dejitter(Ordered):
    kind = "t0 double, chunk bigint, seqs array<bigint>, times array<double>, x array<double>, t array<double>, sums array<double>"

    def __init__(self, width: int):
        self.width = width

    def step(self, session, held, own):
        t0, chunk, seqs, times, x, t, sums = held if held else (float(own["time"].iloc[0]), None, [], [], [], [], [0.0] * 4)
        seqs, times, x, t, sums, out = list(seqs), list(times), deque(x), deque(t), np.array(sums), []
        for seq, c, time in zip(own["seq"], own["chunk"], own["time"]):
            if chunk is not None and c != chunk:
                self._close(session, t0, seqs, times, x, t, sums, out)
                seqs, times = [], []
            chunk = int(c)
            seqs.append(int(seq))
            times.append(float(time))
        return (t0, chunk, seqs, times, list(x), list(t), sums.tolist()), pd.DataFrame(out, columns=["session_id", "seq", "time"])

    def _close(self, session, t0, seqs, times, x, t, sums, out):
        """A whole chunk goes into the ring; sums of x, t, x*x and x*t follow each row that comes and goes."""
        if len(seqs) == 1:
            out.append((session, seqs[0], times[0]))
            return
        for seq, time in zip(seqs, times):
            u, v = float(seq), time - t0
            x.append(u)
            t.append(v)
            sums += (u, v, u * u, u * v)
            if len(x) > self.width:
                u, v = x.popleft(), t.popleft()
                sums -= (u, v, u * u, u * v)
        n = len(x)
        mx, mt = sums[0] / n, sums[1] / n
        slope = (sums[3] - n * mx * mt) / (sums[2] - n * mx * mx)
        out.extend((session, seq, t0 + mt + slope * (seq - mx)) for seq in seqs)


def dejitter_sliding(rows: DataFrame, width: int) -> DataFrame:
    """``timebase.dejitter_sliding`` on a stream (session_id, seq, chunk, time): a ring of ``width`` rows and their running sums.

    A chunk is put out when the next one begins.
    """
    made = rows.select("session_id", "seq", F.col("chunk").cast("bigint").alias("chunk"), F.col("time").cast("double").alias("time"))
    return keyed(made, _Dejitter(width), "session_id bigint, seq bigint, time double")


# rings


class _Recent(StatefulProcessor):
    def __init__(self, values: list[str], count: int, horizon: float | None, ttl_ms: int | None):
        self.values, self.count, self.horizon, self.ttl = values, count, horizon, ttl_ms

    def init(self, handle) -> None:
        self.held = handle.getListState("rows", "seq bigint, time double, " + ", ".join(f"`{c}` double" for c in self.values), *([self.ttl] if self.ttl else []))

    def handleInputRows(self, key, rows, timerValues):
        names = ["seq", "time", *self.values]
        before = [tuple(r) for r in self.held.get()] if self.held.exists() else []
        own = pd.concat(list(rows)).sort_values("seq", kind="stable")
        every = [*before, *((int(s), float(t), *v) for s, t, *v in zip(*(own[c].tolist() for c in names)))][-self.count :]
        if self.horizon is not None:
            every = [r for r in every if r[1] > every[-1][1] - self.horizon]
        self.held.put(every)
        yield pd.DataFrame([(key[0], every[-1][0], *([r[k] for r in every] for k in range(len(names))))], columns=["session_id", "upto", *names])

    def close(self) -> None:
        pass


def recent(rows: DataFrame, values: list[str], *, count: int, horizon: float | None = None, ttl_seconds: float | None = None) -> DataFrame:
    """Ring buffers: per session and micro-batch the last ``count`` rows, of those the ones less than ``horizon`` seconds before the last, as arrays.

    With ``ttl_seconds`` a session that sends nothing for so long (by the clock) loses its buffer.
    """
    out = "session_id bigint, upto bigint, seq array<bigint>, time array<double>, " + ", ".join(f"`{c}` array<double>" for c in values)
    ttl = int(ttl_seconds * 1000) if ttl_seconds else None
    return keyed(rows.select("session_id", "seq", "time", *values), _Recent(values, count, horizon, ttl), out, "ProcessingTime" if ttl else "None")


# baseline recording


class _Baseline(StatefulProcessor):
    def __init__(self, channels: list[str], size: int, limit: float, least: int):
        self.channels, self.size, self.limit, self.least = channels, size, limit, least

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getValueState("recording", "running boolean, recording bigint, started double, windows bigint, seq array<bigint>, time array<double>, " + ", ".join(f"`{c}` array<double>" for c in self.channels))

    def _state(self) -> dict:
        running, number, started, windows, *rows = self.held.get() if self.held.exists() else (False, 0, 0.0, 0, [], [], *([] for _ in self.channels))
        return {"running": running, "recording": number, "started": started, "windows": windows, "rows": list(zip(*rows))}

    def _keep(self, s: dict) -> None:
        columns = list(zip(*s["rows"])) if s["rows"] else [()] * (2 + len(self.channels))
        self.held.update((s["running"], s["recording"], s["started"], s["windows"], *map(list, columns)))

    def _said(self, session, s: dict, event: str, time: float) -> tuple:
        return (session, s["recording"], event, s["windows"], None, time, *(None for _ in self.channels))

    def _stop(self, session, s: dict, time: float) -> tuple:
        s["running"], s["rows"] = False, []  # a window that is not full goes
        return self._said(session, s, "ready" if s["windows"] >= self.least else "idle", time)

    def _frame(self, out: list[tuple]) -> pd.DataFrame:
        made = pd.DataFrame(out, columns=["session_id", "recording", "event", "win", "seq", "time", *self.channels])
        return made.astype({"seq": "Int64"} | {c: float for c in self.channels})

    def handleInputRows(self, key, rows, timerValues):
        own = pd.concat(list(rows)).sort_values(["time", "seq"], kind="stable", na_position="first")  # control rows come before samples of their time
        s, out = self._state(), []
        for kind, seq, time, *values in zip(own["kind"], own["seq"].tolist(), own["time"], *(own[c] for c in self.channels)):
            if s["running"] and time >= s["started"] + self.limit:
                out.append(self._stop(key[0], s, s["started"] + self.limit))
            if kind == "start":
                s |= {"running": True, "recording": s["recording"] + 1, "started": time, "windows": 0, "rows": []}
                self.handle.registerTimer(int((time + self.limit) * 1000))
                out.append(self._said(key[0], s, "recording", time))
            elif kind == "stop":
                if s["running"]:
                    out.append(self._stop(key[0], s, time))
            elif s["running"]:
                s["rows"].append((int(seq), time, *values))
                if len(s["rows"]) == self.size:
                    out.extend((key[0], s["recording"], "window", s["windows"], *r) for r in s["rows"])
                    s |= {"windows": s["windows"] + 1, "rows": []}
        self._keep(s)
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        """No sample has come since, but the clock of the stream has passed the end."""
        s, out = self._state(), []
        if s["running"] and expiredTimerInfo.getExpiryTimeInMs() >= int((s["started"] + self.limit) * 1000):
            out.append(self._stop(key[0], s, s["started"] + self.limit))
            self._keep(s)
        yield self._frame(out)

    def close(self) -> None:
        pass


def baseline_recordings(samples: DataFrame, control: DataFrame, channels: list[str], *, size: int, limit: float = 30.0, least: int = 1, late: str = "10 seconds") -> DataFrame:
    """Control of baseline recordings while a stream runs.

    ``samples``: session_id, seq, time (seconds) and channels; ``control``: session_id, time and kind (start or stop).  From a start on, whole windows of ``size``
    rows come out (event ``window``, numbered in ``win``); a stop, or ``limit`` seconds, ends the recording and what does not fill a window goes.  Rows of other
    events tell what happened: ``recording`` at a start, at the end ``ready`` if there were ``least`` windows, else ``idle``, with ``win`` = number of windows.  A start
    while one runs begins anew, a stop while none runs does nothing.  An event-time timer ends recordings whose session falls silent.
    """
    none = lambda names, kind: (F.lit(None).cast(kind).alias(c) for c in names)
    both = samples.select("session_id", F.lit("sample").alias("kind"), "seq", "time", *(F.col(c).cast("double").alias(c) for c in channels))
    both = both.unionByName(control.select("session_id", "kind", *none(["seq"], "bigint"), "time", *none(channels, "double")))
    timed = both.withColumn("ts", F.timestamp_micros((F.col("time") * 1_000_000).cast("bigint"))).withWatermark("ts", late)
    out = "session_id bigint, recording bigint, event string, win bigint, seq bigint, time double, " + ", ".join(f"`{c}` double" for c in channels)
    made = keyed(timed, _Baseline(channels, size, limit, least), out, "EventTime")
    return made.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in channels})


# segments and sessions


class _Numbered(Ordered):
    kind = "n bigint"

    def __init__(self, size: int, columns: list[str], order: list[str]):
        self.size, self.columns, self.order = size, columns, order

    def step(self, session, held, own):
        n = held[0] if held else 0
        number = n + np.arange(len(own))
        made = own[["time", *self.columns]].copy()
        made.insert(0, "seq", number)
        made.insert(0, "segment", number // self.size + 1)
        made.insert(0, "session_id", session)
        return (n + len(own),), made


def segmented(rows: DataFrame, size: int, columns: list[str], *, order: tuple[str, ...] = ("time",)) -> DataFrame:
    """Rows numbered in order of time, or of all columns of ``order`` (``seq`` from 0), and cut into ``segment``s of ``size`` rows (from 1); the state is one counter."""
    return keyed(rows.select("session_id", *dict.fromkeys(("time", *order, *columns))), _Numbered(size, columns, list(order)), "session_id bigint, segment bigint, seq bigint, time double, " + ", ".join(f"`{c}` double" for c in columns))


def segment_sink(stream: DataFrame, folder: str, kind: str, columns: list[str], checkpoint: str):
    """Write ``segmented`` rows as CSV, six decimals, one folder to a micro-batch.

    A micro-batch that runs again writes its own folder anew, so each row stands once.  Files hold many segments: their number follows
    the micro-batches, not the minutes recorded.
    """
    text = lambda c, name: F.format_string("%.6f", F.col(c)).alias(name)

    def put(df: DataFrame, number: int) -> None:
        made = df.select("session_id", F.lit(kind).alias("data_type"), "segment", "seq", text("time", "timestamp"), *(text(c, c) for c in columns))
        made.repartition("session_id").sortWithinPartitions("session_id", "segment", "seq").write.mode("overwrite").option("header", True).csv(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_segment_sink(spark: SparkSession, folder: str, columns: list[str]) -> DataFrame:
    schema = "session_id bigint, data_type string, segment bigint, seq bigint, timestamp double, " + ", ".join(f"`{c}` double" for c in columns)
    return spark.read.schema(schema).option("header", True).csv(f"{folder}/batch=*")


def active_sessions(rows: DataFrame, value: str, *, gap: str = "120 seconds", late: str = "10 minutes") -> DataFrame:
    """Runs of rows less than ``gap`` apart per session (event-time session windows): start, end (of the last row), n and mean, once the watermark has passed them."""
    windows = rows.withWatermark("ts", late).groupBy("session_id", F.session_window("ts", gap)).agg(F.max("ts").alias("end"), F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))
    return windows.select("session_id", F.col("session_window.start").alias("start"), "end", "n", "mean")


def late_rows(query) -> int:
    """How many rows a finished stream's operators dropped because they came after the watermark."""
    return sum(o.get("numRowsDroppedByWatermark", 0) for p in query.recentProgress for o in p["stateOperators"])
