"""Marker sessions on disk: JSON scans, JSON and CSV sinks."""

from __future__ import annotations

import csv
import io
import json
import uuid
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import MARKER_SESSION

COLUMNS = ["id", "content", "start_str", "end_str", "duration_s", "start_ts", "end_ts"]


def scan_sessions(spark: SparkSession, root: str) -> DataFrame:
    """``root/<session>/session.json``, one record a file, newest name first; files that do not parse are left out."""
    raw = spark.read.schema(MARKER_SESSION).option("multiLine", True).option("mode", "PERMISSIVE").json(f"{root.rstrip('/')}/*/session.json")
    return raw.filter(F.col("session_id").isNotNull()).orderBy(F.desc("session_id"))


def marker_rows(sessions: DataFrame) -> DataFrame:
    """One row per marker: session_id and the columns of the marker table."""
    return sessions.select("session_id", F.explode("markers").alias("m")).select("session_id", *(F.col(f"m.{c}").alias(c) for c in COLUMNS))


def scan_marker_table(spark: SparkSession, root: str) -> DataFrame:
    """``root/<session>/markers.csv``; a byte-order mark before the header is skipped with it."""
    schema = "id bigint, content string, start_str string, end_str string, duration_s double, start_ts double, end_ts double"
    rows = spark.read.schema(schema).option("header", True).option("enforceSchema", True).csv(f"{root.rstrip('/')}/*/markers.csv")
    return rows.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1).alias("session_id"), *COLUMNS)


def write_sessions(sessions: DataFrame, folder: str) -> str:
    """Records as JSON and their markers as CSV, a folder to each session; a session written again replaces itself only."""
    put = lambda df: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("session_id")
    put(sessions).json(f"{folder}/sessions")
    put(marker_rows(sessions).repartition("session_id").sortWithinPartitions("session_id", "id")).option("header", True).csv(f"{folder}/markers")
    return folder


def write_marker_tables(markers: DataFrame, root: str, *, append: bool = False) -> str:
    """``root/<session>/markers.csv`` for each session of ``markers`` (session_id, the columns of the marker table, ``extras`` map of strings); returns the root.

    A file begins with a byte-order mark and a header: the fixed columns, then the extra ones in the order in which they come.  With ``append`` rows join
    those of the file, and columns its header; a row replaces one of the same id, so that a task which runs again changes nothing.  A session's markers are few and
    pass one task together; its file is written under a name of its own and then moved.
    """
    rows = markers.select(F.col("session_id").cast("string").alias("session_id"), *(F.col(c).cast("string").alias(c) for c in COLUMNS), F.to_json("extras").alias("extras"), F.col("id").alias("_at"))
    dealt = rows.repartition("session_id").sortWithinPartitions("session_id", "_at").drop("_at")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = pafs.FileSystem.from_uri(root)
        for session, own in groupby((r for frame in frames for r in frame.itertuples(index=False)), key=lambda r: r.session_id):
            path, names, held = f"{base}/{session}/markers.csv", list(COLUMNS), {}
            if append and fs.get_file_info(path).type == pafs.FileType.File:
                with fs.open_input_stream(path) as f:
                    before = csv.DictReader(io.StringIO(f.read().decode("utf-8-sig"), newline=""))
                    names += [c for c in before.fieldnames or [] if c not in names]
                    held = {r["id"]: r for r in before}
            for r in own:
                more = json.loads(r.extras) if r.extras else {}
                names += [c for c in more if c not in names]
                held[r.id] = {c: getattr(r, c) for c in COLUMNS} | {c: v for c, v in more.items() if c not in COLUMNS}
            text = io.StringIO(newline="")
            out = csv.DictWriter(text, names, restval="")
            out.writeheader()
            out.writerows({c: "" if v is None else v for c, v in r.items()} for r in held.values())
            fs.create_dir(f"{base}/{session}", recursive=True)
            made = f"{base}/{session}/.{uuid.uuid4().hex}"
            with fs.open_output_stream(made, compression=None) as f:
                f.write(text.getvalue().encode("utf-8-sig"))
            fs.move(made, path)
            yield pd.DataFrame({"path": [path]})

    dealt.mapInPandas(run, "path string").count()
    return root


def scan_marker_tables(spark: SparkSession, root: str) -> DataFrame:
    """``scan_marker_table`` with ``extras``: a map of the columns that a file has beside the fixed ones, empty values left out.  Headers may differ from file to file."""
    fs, base = pafs.FileSystem.from_uri(root.rstrip("/"))
    folders = [(f.base_name,) for f in fs.get_file_info(pafs.FileSelector(base, allow_not_found=True)) if f.type == pafs.FileType.Directory]  # one listing; tasks open the files
    files = spark.createDataFrame(folders, "session_id string").repartition(max(1, len(folders) // 256))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = pafs.FileSystem.from_uri(root.rstrip("/"))
        for frame in frames:
            made = []
            for session in frame["session_id"]:
                try:
                    with fs.open_input_stream(f"{base}/{session}/markers.csv") as f:
                        content = f.read().decode("utf-8-sig")
                except FileNotFoundError:
                    continue
                for r in csv.DictReader(io.StringIO(content, newline="")):
                    made.append((session, *(r.get(c) or None for c in COLUMNS), json.dumps({k: v for k, v in r.items() if k and k not in COLUMNS and v})))
                if len(made) >= 10_000:
                    yield pd.DataFrame(made, columns=["session_id", *COLUMNS, "extras"])
                    made = []
            yield pd.DataFrame(made, columns=["session_id", *COLUMNS, "extras"])

    text = files.mapInPandas(run, "session_id string, " + ", ".join(f"{c} string" for c in COLUMNS) + ", extras string")
    kinds = {"id": "bigint", "duration_s": "double", "start_ts": "double", "end_ts": "double"}
    return text.select("session_id", *(F.col(c).try_cast(kinds.get(c, "string")).alias(c) for c in COLUMNS), F.from_json("extras", "map<string,string>").alias("extras"))
