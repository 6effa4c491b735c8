"""Append one computed column to a DataFrame through an Arrow kernel, every other column untouched."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

RUN_BYTES = 4 << 20


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores before it until no column of ``df`` has that name in any case."""
    held = {c.lower() for c in df.columns}
    while wanted.lower() in held:
        wanted = f"_{wanted}"
    return wanted


def give_back() -> None:
    """Return freed memory to the system at the end of a task: workers live on and would hold each kernel's peak."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def append(df: DataFrame, source: list[str], name: str, kind: str, make: Callable[[], Callable[..., pa.Array]]) -> DataFrame:
    """Add column ``name`` of DDL type ``kind`` = ``make()(*source columns)`` batch by batch.

    ``make`` runs once in each task, so it can load what the kernel needs.  Partitioning, row order
    within a task and all other columns stay as they are; there is no shuffle.  A batch goes through the
    kernel in runs of whole rows of about ``RUN_BYTES``, which bounds what a task holds at once on both sides.
    """
    at = [df.columns.index(c) for c in source]
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.StructType.fromDDL(f"x {kind}")[0].dataType)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            kernel = kernel or make()
            rows = max(1, batch.num_rows * RUN_BYTES // max(batch.nbytes, 1))
            for first in range(0, batch.num_rows, rows):
                part = batch.slice(first, rows)
                yield pa.RecordBatch.from_arrays([*part.columns, kernel(*(part.column(i) for i in at))], names=[*part.schema.names, name])
                del part
        batch = kernel = None
        give_back()

    return df.mapInArrow(run, schema)
