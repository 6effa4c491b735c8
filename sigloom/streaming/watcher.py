"""A stream over a directory of recordings in which files still grow: a segment is read once it is whole, and once only.

A segment is whole if the next one exists, or if its size is above 0 and the same at two looks, at least ``interval`` seconds apart.  The
looks leave a log beside the stream's checkpoint, one small JSON file for each look: the files found whole, in order, and the
sizes of the others.  A stream's offset is a place in that order.  After a restart the log is read again, so an unfinished
micro-batch gets the same files, a file that was given out is never given out again, and one that grew while nothing looked waits for a second look.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.csv as pacsv
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..schemas import PREFIXES, SEGMENTS

_NAME = re.compile(r"^(.*_seg)(\d+)(\.csv)$")


class _Looks:
    """What the looks at a directory have found so far."""

    def __init__(self, root: str, prefix: str, log: str, interval: float):
        self.fs, self.root = pafs.FileSystem.from_uri(root)
        self.log_fs, self.log = pafs.FileSystem.from_uri(log)
        self.prefix, self.interval = prefix, interval
        self.log_fs.create_dir(self.log, recursive=True)
        self.order: list[str] = []
        self.sizes: dict[str, int] = {}
        self.at = 0.0
        entries = sorted(f.path for f in self.log_fs.get_file_info(pafs.FileSelector(self.log)) if f.path.endswith(".json"))
        for path in entries:
            with self.log_fs.open_input_file(path) as f:
                held = json.loads(f.read())
            self.order += held["whole"]
            self.sizes, self.at = held["sizes"], held["at"]
        self.looks = len(entries)
        self.known = set(self.order)

    def look(self) -> int:
        """Look again, unless the last look was just now; the number of files found whole."""
        now = time.time()
        if now - self.at < self.interval:
            return len(self.order)
        found = self.fs.get_file_info(pafs.FileSelector(self.root, recursive=True))
        sizes = {f.path: f.size for f in found if f.is_file and f.base_name.startswith(f"{self.prefix}_seg") and _NAME.match(f.base_name)}
        left = {p: n for p, n in sizes.items() if p not in self.known}
        whole = sorted(p for p, n in left.items() if self._next(p) in sizes or n > 0 and self.sizes.get(p) == n)
        left = {p: n for p, n in left.items() if p not in whole}
        if whole or left != self.sizes:
            held = f"{self.log}/{self.looks:09d}"
            with self.log_fs.open_output_stream(f"{held}.tmp") as f:
                f.write(json.dumps({"at": now, "whole": whole, "sizes": left}).encode())
            self.log_fs.move(f"{held}.tmp", f"{held}.json")  # a look counts once its entry stands
            self.looks += 1
        self.order += whole
        self.known.update(whole)
        self.sizes, self.at = left, now
        return len(self.order)

    @staticmethod
    def _next(path: str) -> str:
        head, number, tail = _NAME.match(path).groups()
        return f"{head}{int(number) + 1:0{len(number)}d}{tail}"


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.options, self.names, self.held = dict(options), [f.name for f in schema if f.name not in ("session_id", "segment", "path")], None

    def _looks(self) -> _Looks:
        if self.held is None:
            self.held = _Looks(self.options["root"], self.options["prefix"], self.options["log"], float(self.options.get("interval", "600")))
        return self.held

    def initialOffset(self) -> dict:
        return {"files": 0}

    def latestOffset(self) -> dict:
        return {"files": self._looks().look()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        paths = self._looks().order[start["files"] : end["files"]]
        some = max(1, -(-len(paths) // int(self.options.get("tasks", "64"))))
        return [_Files(paths[i : i + some]) for i in range(0, len(paths), some)]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(self.options["root"])
        kinds = {n: pa.float64() for n in self.names}
        for path in partition.paths:
            with fs.open_input_stream(path) as f:
                table = pacsv.read_csv(f, convert_options=pacsv.ConvertOptions(column_types=kinds, include_columns=self.names, include_missing_columns=True, null_values=["", "nan", "NaN"], strings_can_be_null=True))
            n, (folder, name) = table.num_rows, path.rsplit("/", 2)[1:]
            table = table.append_column("session_id", pa.array([folder] * n)).append_column("segment", pa.array([int(_NAME.match(name)[2])] * n, pa.int64())).append_column("path", pa.array([path] * n))
            yield from table.to_batches()

    def commit(self, end: dict) -> None:
        pass


class SegmentWatch(DataSource):
    @classmethod
    def name(cls) -> str:
        return "segment_watch"

    def schema(self) -> str:
        return "session_id string, segment bigint, path string"

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return _Reader(self.options, schema)


def watched_segments(spark: SparkSession, root: str, kind: str, log: str, *, interval: float = 600.0) -> DataFrame:
    """Rows of whole segments under ``root`` (``<session>/<prefix>_segNNNN.csv``), each file once: the segment's columns, session_id, segment, path.

    ``log`` is the folder of the looks, of this stream alone, kept as long as its checkpoint.
    """
    spark.dataSource.register(SegmentWatch)
    fields = [T.StructField(f.name, T.DoubleType()) for f in SEGMENTS[kind]]
    schema = T.StructType([*fields, T.StructField("session_id", T.StringType()), T.StructField("segment", T.LongType()), T.StructField("path", T.StringType())])
    return spark.readStream.format("segment_watch").schema(schema).option("root", root).option("prefix", PREFIXES[kind]).option("log", log).option("interval", str(interval)).load()
