"""Event markers: parsing of requests, sessions with their markers, append, patch, lists, matching with recordings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as X

RELATIVE = 1e8  # times below are seconds from the session's start
MARKER = "array<struct<id: bigint, content: string, start_ts: double, end_ts: double, start_str: string, end_str: string, duration_s: double, extras: map<string,string>>>"
#: Names under which a request may give a marker's range, its text and the ends of a range.
RANGE, CONTENT = ["time_range", "timeRange", "range"], ["content", "label", "text"]
STARTS, ENDS = ["start", "from", "begin"], ["end", "to", "stop"]


def _keys(rows: DataFrame) -> list[str]:
    """What tells sessions apart: the name and, where it is held, the ``origin`` of those that had to be named here."""
    return [c for c in ("session_id", "origin") if c in rows.columns]


def _first(json: Column, names: list[str]) -> Column:
    return F.coalesce(*(F.nullif(F.get_json_object(json, f"$.{n}"), F.lit("")) for n in names))


def parse_range(rows: DataFrame, json: str, session_start: str) -> DataFrame:
    """Adds start_ts, end_ts and duration_s (three digits) of a range given as a list or an object in column ``json``.

    Small numbers count from the session's start; a time of day belongs to the session's day.
    """
    r = F.col(json)
    ends = lambda k, names: F.when(r.startswith("["), F.get_json_object(r, f"$[{k}]")).otherwise(_first(r, names))
    texts = rows.withColumns({"_one": ends(0, STARTS), "_two": ends(1, ENDS), "_day": X.date_text(F.col(session_start)).substr(1, 10)})
    values = texts.withColumns({"_one": X.parse_time(F.col("_one"), F.col("_day")), "_two": X.parse_time(F.col("_two"), F.col("_day"))})
    absolute = lambda c: F.col(c) + F.when((F.col(c) < RELATIVE) & F.col(session_start).isNotNull(), F.col(session_start)).otherwise(0.0)
    out = values.withColumns({"start_ts": absolute("_one"), "end_ts": absolute("_two")})
    return out.withColumn("duration_s", F.bround(F.col("end_ts") - F.col("start_ts"), 3)).drop("_one", "_two", "_day")


def parse_markers(requests: DataFrame) -> DataFrame:
    """Rows ``session_id, start_ts (of the session), pos, marker`` (JSON text) to rows of markers; what is no object is skipped.

    A range that does not parse leaves the times NULL; other entries are kept in ``extras``.
    """
    j = F.col("marker")
    keys = _keys(requests)
    rows = requests.select(*keys, F.col("start_ts").alias("_start"), "pos", "marker").filter(F.trim("marker").startswith("{"))
    read = rows.withColumns({"_range": _first(j, RANGE), "content": F.coalesce(_first(j, CONTENT), F.lit("")), "_body": F.from_json("marker", "map<string,string>")}).filter("_body is not null")
    made = parse_range(read, "_range", "_start").withColumn("extras", F.map_filter("_body", lambda k, v: ~k.isin([*RANGE, *CONTENT, "session_id"])))
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("pos")) - 1
    return made.select(*keys, number.cast("bigint").alias("id"), "content", "start_ts", "end_ts", X.date_text(F.col("start_ts")).alias("start_str"), X.date_text(F.col("end_ts")).alias("end_str"), "duration_s", "extras")


def save_sessions(requests: DataFrame, origin: str | None = None) -> DataFrame:
    """Rows ``session_id (may be NULL), start_time, end_time (texts), markers (array of JSON texts)`` to session records.

    A request without a start time is dropped; a session without an id is named after its start.  Of several requests of
    one session the last by ``received`` stays.  With ``origin``, a column that says whom a request is from, sessions without an id that begin in
    the same second are one only if they are from the same; records then hold it ('' where a request had an id) beside the name that they share.
    """
    start, end = X.parse_time(F.col("start_time")), X.parse_time(F.col("end_time"))
    name = F.date_format(F.timestamp_micros((start * 1_000_000).cast("bigint")), "yyyyMMdd_HHmmss")
    head = requests.withColumn("start_ts", start).withColumn("end_ts", end).filter("start_ts is not null")
    if origin:
        head = head.withColumn("origin", F.when(F.col("session_id").isNull(), F.coalesce(F.col(origin).cast("string"), F.lit(""))).otherwise(""))
    elif "origin" in head.columns:
        head = head.drop("origin")
    head = head.withColumn("session_id", F.coalesce("session_id", name))
    keys = _keys(head)
    last = head.groupBy(*keys).agg(F.max_by(F.struct("start_ts", "end_ts", "markers", "received"), "received").alias("r")).select(*keys, "r.*")
    marks = parse_markers(last.select(*keys, "start_ts", F.posexplode("markers").alias("pos", "marker")))
    return records(last.select(*keys, "start_ts", "end_ts", "received"), marks)


def records(heads: DataFrame, marks: DataFrame) -> DataFrame:
    """Session rows and marker rows to one record per session; a session's markers are numbered anew in order of id."""
    keys, fields = _keys(heads), ["content", "start_ts", "end_ts", "start_str", "end_str", "duration_s", "extras"]
    held = marks.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("id", *(f for f in fields if f != "extras"), F.to_json("extras").alias("extras")))).alias("m"))
    numbered = F.transform("m", lambda v, i: F.struct(i.cast("bigint").alias("id"), *(v[f].alias(f) for f in fields[:-1]), F.from_json(v["extras"], "map<string,string>").alias("extras")))
    out = heads.join(held, keys, "left")
    markers = F.coalesce(numbered, F.array().cast(MARKER))
    return out.select(
        *keys, "received", X.date_text(F.col("start_ts")).alias("start_time"), "start_ts", X.date_text(F.col("end_ts")).alias("end_time"), "end_ts",
        F.bround(F.col("end_ts") - F.col("start_ts"), 3).alias("duration_seconds"), F.size(markers).cast("bigint").alias("marker_count"), markers.alias("markers"),
    )


def marker_rows(sessions: DataFrame) -> DataFrame:
    return sessions.select(*_keys(sessions), F.inline("markers"))


def append_markers(sessions: DataFrame, requests: DataFrame) -> DataFrame:
    """Markers (session_id, pos, marker) added behind those of their session, of every one where several bear its name; a session that is not there begins empty."""
    keys = _keys(sessions)
    empty = lambda c: F.coalesce(c, F.lit("")).alias(c)
    named = requests.select("session_id", "pos", "marker").join(sessions.select(*keys, "start_ts"), "session_id", "left")
    added = parse_markers(named.select("session_id", *map(empty, keys[1:]), "start_ts", "pos", "marker"))
    most = sessions.select(*keys, F.col("marker_count").alias("_n"))
    later = added.join(most, keys, "left").withColumn("id", F.col("id") + F.coalesce("_n", F.lit(0))).drop("_n")
    heads = sessions.select(*keys, "start_ts", "end_ts", "received")
    fresh = requests.select("session_id").distinct().join(heads, "session_id", "left_anti").select("session_id", *(F.lit("").alias(c) for c in keys[1:]), *(F.lit(None).cast("double").alias(c) for c in ("start_ts", "end_ts")), F.lit(None).cast(heads.schema["received"].dataType).alias("received"))
    return records(heads.unionByName(fresh), marker_rows(sessions).select(*added.columns).unionByName(later))


def update_times(sessions: DataFrame, patches: DataFrame) -> DataFrame:
    """Start and end (texts) patched where given, the duration anew, markers as they are; patches of unknown sessions change nothing."""
    new = patches.select("session_id", X.parse_time(F.col("start_time")).alias("_s"), X.parse_time(F.col("end_time")).alias("_e"))
    out = sessions.join(new, "session_id", "left").withColumn("start_ts", F.coalesce("_s", "start_ts")).withColumn("end_ts", F.coalesce("_e", "end_ts")).drop("_s", "_e")
    return out.withColumns({"start_time": X.date_text(F.col("start_ts")), "end_time": X.date_text(F.col("end_ts")), "duration_seconds": F.bround(F.col("end_ts") - F.col("start_ts"), 3)}).select(*sessions.columns)


def listed(sessions: DataFrame) -> DataFrame:
    """Six fields of each session, newest name first."""
    return sessions.select("session_id", "start_time", "end_time", "duration_seconds", "marker_count", "received").orderBy(F.desc("session_id"))


def match_recordings(recordings: DataFrame, sessions: DataFrame, seconds: float = 300.0) -> DataFrame:
    """The marker session of each recording: of the same name, else the highest name that begins less than ``seconds`` away.

    Columns session_id and start of both.  No pair is made.  Time is cut into stretches of half of ``seconds``: the sessions of a recording's own stretch are
    near, of the three after it those before start + seconds, of the three before it those after start - seconds.  So a recording is posted at its bound, and
    the highest name so far, running along a stretch forwards or backwards, answers it.
    """
    bucket = lambda c: F.floor(F.col(c) / (seconds / 2)).cast("bigint")
    post = lambda b, way, at, kind: F.struct(b.alias("b"), F.lit(way).alias("way"), at.alias("at"), F.lit(kind).alias("kind"))
    bounds = [post(bucket("start") + way * k, way, F.col("start") * way + seconds, 0) for way in (1, -1) for k in (1, 2, 3)]
    asked = recordings.filter("start is not null and not isnan(start)").select("session_id", F.explode(F.array(post(bucket("start"), 0, F.lit(1.0), 0), *bounds)).alias("p"), F.lit(None).cast("string").alias("other"))
    heads = sessions.filter("start_ts is not null and not isnan(start_ts)").groupBy("start_ts").agg(F.max("session_id").alias("other"))
    given = heads.select(F.lit(None).cast("string").alias("session_id"), F.explode(F.array(*(post(bucket("start_ts"), way, F.col("start_ts") * way, 1) for way in (0, 1, -1)))).alias("p"), "other")
    # at its bound a recording comes before the sessions, which are no longer near
    running = Window.partitionBy("p.b", "p.way").orderBy("p.at", "p.kind").rowsBetween(Window.unboundedPreceding, 0)
    found = asked.unionByName(given).withColumn("near", F.max("other").over(running)).filter("p.kind = 0")
    near = found.groupBy("session_id").agg(F.max("near").alias("near"))
    same = sessions.select("session_id", F.col("session_id").alias("same")).distinct()
    return recordings.join(same, "session_id", "left").join(near, "session_id", "left").select("session_id", "start", F.coalesce("same", "near").alias("marker_session"))
