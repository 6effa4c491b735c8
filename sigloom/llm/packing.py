"""Packing token ids into sequences of one capacity by Karmarkar-Karp multiway differencing.

A document's whole multiples of the capacity fill sequences of their own; what is left of it, its tail, is shorter.  Each task
takes its tails in blocks of at most ``block`` (and, at the end, what is left), so no row is shuffled and a task holds one block.
Within a block:

1. Differencing.  Every tail starts as a partial partition: one window that holds it, all other windows empty.  The two
   partial partitions of the largest imbalance (largest minus smallest window) become one, the largest window of one joined with the smallest of the
   other, and so on, until one partition is left.  Its windows are near equal.
2. The number of windows is the least that the block's ids need; while the largest window exceeds the capacity it rises
   in that proportion, by one at least, and the tails are differenced again.
3. Levelling.  Near-equal windows each miss a little of the capacity.  As documents may be cut, the smallest windows are given up and their
   pieces, cut where needed, fill the others; the remainder becomes sequences whose lengths are powers of two.  So no
   sequence needs padding.

A sequence is numbered by its task and its order there, so a retried task numbers alike.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .appending import give_back
from .bytewords import slices
from .tokenbin import ChunkEncoder

Piece = tuple[int, int, int]  # document (its place in the block), first id, number of ids


def difference(sizes: list[int], windows: int) -> list[list[int]]:
    """Multiway differencing: the items of each window, windows by descending sum (empty ones left out).

    A partial partition keeps only the windows that hold something, by descending sum; a window is a linked list of items.
    """
    after = [-1] * len(sizes)
    ends: dict[int, int] = {i: i for i in range(len(sizes))}  # last item of the list that begins with an item
    heap = [(-s, i, [(s, i)]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    turn = len(sizes)
    while len(heap) > 1:
        x, y = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        if len(x) < len(y):
            x, y = y, x
        both = len(x) + len(y) - windows  # so many windows of each meet one that holds something
        if both > 0:
            alone, meet = x[: len(x) - both], x[len(x) - both :]
            merged = []
            for (s, i), (t, j) in zip(meet, reversed(y[len(y) - both :])):  # the larger of these with the smaller of those
                after[ends[i]] = j
                ends[i] = ends[j]
                merged.append((s + t, i))
            made = alone + merged + y[: len(y) - both]
        else:
            made = x + y
        made.sort(key=lambda w: -w[0])
        low = made[-1][0] if len(made) == windows else 0
        heapq.heappush(heap, (low - made[0][0], turn, made))
        turn += 1
    out = []
    for _, i in heap[0][2] if heap else []:
        own = []
        while i >= 0:
            own.append(i)
            i = after[i]
        out.append(own)
    return out


def near_equal(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows of at most ``capacity``; their number rises with what the largest exceeds it by, by one at least."""
    windows = max(1, -(-sum(sizes) // capacity))
    while True:
        out = difference(sizes, windows)
        most = sum(sizes[i] for i in out[0]) if out else 0
        if most <= capacity:
            return out
        windows = max(windows + 1, -(-windows * most // capacity))


def level(windows: list[list[Piece]], capacity: int) -> list[list[Piece]]:
    """Sequences without padding: the last windows fill the others, and what remains is cut at powers of two."""
    fill = [sum(p[2] for p in w) for w in windows]
    kept, missing, spare = len(windows), sum(capacity - f for f in fill), 0
    while kept and missing > spare:  # the smallest stand last
        kept -= 1
        missing -= capacity - fill[kept]
        spare += fill[kept]
    pool = [p for w in windows[kept:] for p in w]

    def take(n: int) -> list[Piece]:
        out = []
        while n:
            doc, first, length = pool.pop()
            cut = min(n, length)
            out.append((doc, first, cut))
            if cut < length:
                pool.append((doc, first + cut, length - cut))
            n -= cut
        return out

    out = [w + take(capacity - f) for w, f in zip(windows[:kept], fill)]
    rest = spare - missing
    while rest:
        size = min(capacity, 1 << (rest.bit_length() - 1))
        out.append(take(size))
        rest -= size
    return out


def pack(docs: DataFrame, tokenizer: str, *, id: str = "doc_id", text: str = "text", end_id: int = 1, capacity: int = 2048, block: int = 512) -> DataFrame:
    """One row per piece: ``id``, ``start`` (ids of its document before it), ``length``, ``ids`` (unsigned 32-bit little-endian), ``doc_tokens``, ``sequence_id``, ``offset`` (its place there).

    A document's ids are those of its whole text, then ``end_id``; a null or empty text has that alone.  Each id lies in exactly
    one piece; a sequence is gapless from 0 and ``capacity`` long, or a power of two.  Repeated and null ids are documents of their own.  An
    empty table gives no rows; other columns are ignored.
    """
    base = docs.select(F.col(f"`{id}`").cast("long").alias("d"), F.col(f"`{text}`").alias("t"))
    names = [id, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    schema = T.StructType([T.StructField(n, T.BinaryType() if n == "ids" else T.LongType()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = None, TaskContext.get().partitionId() << 33
        made, waiting = 0, []  # sequences so far; tails: document id, its ids, where they begin, all of its ids

        def rows(pieces: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(column, f) for column, f in zip(zip(*pieces), (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()))], names=names)

        def packed() -> Iterator[pa.RecordBatch]:
            nonlocal made
            out = []
            for window in level([[(i, 0, len(waiting[i][1])) for i in w] for w in near_equal([len(t[1]) for t in waiting], capacity)], capacity):
                at = 0
                for i, first, length in window:
                    doc, ids, begin, total = waiting[i]
                    out.append((doc, begin + first, length, ids[first : first + length].tobytes(), total, task + made, at))
                    at += length
                made += 1
            waiting.clear()
            if out:
                yield rows(out)

        for batch in batches:
            if not batch.num_rows:
                continue
            encoder = encoder or ChunkEncoder(tokenizer)
            own = batch.column(0).to_pylist()
            for first, last, data, offsets in slices(batch.column(1)):
                flat, counts = encoder.encode(data, offsets, end_id)
                flat, ends = flat.astype("<u4"), np.cumsum(counts).tolist()
                whole = []
                for doc, begin, end in zip(own[first:last], [0, *ends], ends):
                    total = end - begin
                    for k in range(total // capacity):
                        at = k * capacity
                        whole.append((doc, at, capacity, flat[begin + at : begin + at + capacity].tobytes(), total, task + made, 0))
                        made += 1
                        if len(whole) == 512:
                            yield rows(whole)
                            whole = []
                    if tail := total % capacity:
                        waiting.append((doc, flat[end - tail : end].copy(), total - tail, total))
                        if len(waiting) == block:
                            yield from packed()
                if whole:
                    yield rows(whole)
        yield from packed()
        encoder = None
        give_back()

    return base.mapInArrow(run, schema)
