"""Near-duplicate embeddings by counting collisions on one-dimensional projections.

Unit vectors are projected on ``m`` orthonormal random directions.  On each, a query collides with the
vectors inside a window centred on it; a pair's count is the number of directions on which it collides.
For a pair at exactly the threshold the difference vector has a known length and a random direction, so
the distribution of its count is known: ``calibrate`` simulates it and sets the count that such a pair
misses with a probability of about one in a million.  Pairs that reach it are verified by their cosine
in double precision; no other pair is linked.

Pairs are brought together by cells.  A table cuts ``bits`` sorted projections of its own at zero; the sides on which a vector
falls name its cell.  ``bits`` grows with the logarithm of the number of vectors, so that cells keep about ``cell_rows`` of
them, and as many tables are made as leave a pair at the threshold apart in all of them with a probability of ``loss`` at most
(``plan``); up to ``cell_rows`` vectors, one block, are one cell of one table.  So the work grows as n log n tables times a cell, not as the square of n.
A pair that shares several cells counts in the first of them.

Within a cell work is dealt in tiles of two blocks.  Projections stand in signed
bytes (clipped, which can only add collisions), so a direction costs about a tenth of a nanosecond a
pair.  A tile returns, per vector, its number of links, and a spanning forest of them: no more rows
than vectors, however many copies there are.  Equal vectors are one class throughout.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut

STEP = 0.01  # of a projection, per unit of its byte


def directions(dim: int, seed: int = 3) -> np.ndarray:
    """A random rotation: ``dim`` orthonormal directions as columns."""
    return np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))[0]


def calibrate(dim: int, threshold: float, width: float = 1.5, draws: int = 20_000, sigmas: float = 4.9) -> tuple[int, int]:
    """Half-width of the window in bytes' units and the least count of a linked pair.

    The window is ``width`` standard deviations of the difference at the threshold; the count lies
    ``sigmas`` standard deviations below its simulated mean.
    """
    far = math.sqrt(max(0.0, 2 - 2 * threshold))
    half = math.ceil(width * far / math.sqrt(dim) / STEP) + 1  # rounding moves a difference by one unit at most
    rng = np.random.default_rng(5)
    d = rng.standard_normal((draws, dim))
    d *= far / np.linalg.norm(d, axis=1, keepdims=True)
    a = rng.uniform(0, STEP, (draws, dim))
    count = (np.abs(np.round((a + d) / STEP) - np.round(a / STEP)) <= half).sum(1)
    return half, max(0, math.floor(count.mean() - sigmas * count.std()))


def labels_of(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least index of the component of each of ``n`` nodes under the edges (a, b)."""
    label = np.arange(n)
    while len(a):
        least = np.minimum(label[a], label[b])
        after = label.copy()
        np.minimum.at(after, a, least)
        np.minimum.at(after, b, least)
        after = after[after]
        if (after == label).all():
            break
        label = after
    return label


def plan(n: int, threshold: float, cell_rows: int, loss: float) -> tuple[int, int]:
    """Projections a table cuts and number of tables for ``n`` vectors: two vectors at the threshold's angle fall on one side of a random cut with a known probability."""
    bits = max(0, math.ceil(math.log2(max(n, 1) / cell_rows)))
    together = (1 - math.acos(min(1.0, max(-1.0, threshold))) / math.pi) ** bits
    return bits, 1 if together >= 1 else math.ceil(math.log(loss) / math.log1p(-together))


def cells(x: np.ndarray, cuts: np.ndarray, bits: int) -> np.ndarray:
    """The cell of each vector in each table: rows of keys.  ``cuts`` holds ``bits`` directions a table as columns."""
    tables = cuts.shape[1] // bits if bits else 1
    if not bits:
        return np.zeros((len(x), 1), np.int64)
    return (x @ cuts > 0).reshape(len(x), tables, bits) @ (np.int64(1) << np.arange(bits))


def tile(x: np.ndarray, y: np.ndarray | None, threshold: float, half: int, least: int, turn: np.ndarray, x_weight: np.ndarray, y_weight: np.ndarray, x_met: np.ndarray | None = None, y_met: np.ndarray | None = None):
    """Links between the unit vectors of two blocks (or within one, ``y`` None): weight linked to each vector, and forest edges.

    Indexes run over the first block, then the second.  ``x_met`` and ``y_met`` are the vectors' cells in earlier tables; pairs
    that share one of them have been counted there.
    """
    own = y is None
    y = x if own else y
    small = lambda v: np.clip(np.round(v @ turn / STEP), -63, 63).astype(np.int8).T.copy()
    px, py = small(x), small(y)
    links, edges = np.zeros(len(x) + (0 if own else len(y)), np.int64), []
    shift = 0 if own else len(x)
    rows = 256
    for first in range(0, len(x), rows):
        last = min(first + rows, len(x))
        begin = first if own else 0
        count = np.zeros((last - first, len(y) - begin), np.min_scalar_type(px.shape[0]))  # one byte holds 255 directions
        for j in range(px.shape[0]):
            away = (py[j, begin:][None, :] - (px[j, first:last] - np.int8(half))[:, None]).view(np.uint8)
            count += (away <= 2 * half).view(np.uint8)
        q, o = np.nonzero(count >= least)
        o += begin
        q += first
        if own:
            keep = q < o
            q, o = q[keep], o[keep]
        if not len(q):
            continue
        if len(q) * 50 > count.size:
            cosine = (x[first:last] @ y[begin:].T)[q - first, o - begin]
        else:
            cosine = np.concatenate([np.einsum("nd,nd->n", x[q[i : i + 65536]], y[o[i : i + 65536]]) for i in range(0, len(q), 65536)])
        near = cosine >= threshold
        q, o = q[near], o[near]
        if x_met is not None and x_met.shape[1] and len(q):
            fresh = np.concatenate([~(x_met[q[i : i + 65536]] == y_met[o[i : i + 65536]]).any(1) for i in range(0, len(q), 65536)])
            q, o = q[fresh], o[fresh]
        np.add.at(links, q, y_weight[o])
        np.add.at(links, o + shift, x_weight[q])
        if len(q):
            ends, both = np.unique(np.concatenate([q, o + shift]), return_inverse=True)
            label = labels_of(len(ends), both[: len(q)], both[len(q) :])
            edges.append(np.stack([ends, ends[label]]))
    if edges:
        a, b = np.concatenate(edges, axis=1)
        label = labels_of(len(links), a, b)
        touched = np.flatnonzero(label != np.arange(len(links)))
        return links, np.stack([touched, label[touched]])
    return links, np.zeros((2, 0), np.int64)


def near_duplicates(vectors: DataFrame, *, id: str = "vec_id", embedding: str = "embedding", threshold: float = 0.9, block: int = 4096, cell_rows: int = 1 << 12, loss: float = 1e-6) -> DataFrame:
    """One row per input row: ``id``, ``n_links`` (other vectors linked directly), ``component_id`` (least id reachable, itself included).

    All rows are compared, whatever their labels, with vectors of the same dimension.  Vectors that are
    null, empty, zero or hold null or non-finite components link with nothing.  Rows that repeat an id
    are vectors of their own that share an id; a null id stays alone with a null component.  An empty table gives no rows.
    """
    rows = vectors.select(F.col(id).cast("long").alias("id"), F.col(embedding).alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    usable = F.coalesce(finite & (F.size("v") > 0) & F.exists("v", lambda c: c != 0), F.lit(False)) & F.col("id").isNotNull()
    rows = rows.withColumn("v", F.when(usable, F.transform("v", lambda c: c.cast("double"))))
    classes = cut(rows.filter("v is not null").groupBy("v").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")))
    dims = [r.d for r in classes.select(F.size("v").alias("d")).distinct().collect()]  # one row per dimension
    found = None
    for dim in dims:
        own = _links(classes.filter(F.size("v") == dim), dim, threshold, block, cell_rows, loss)
        found = own if found is None else found.unionByName(own)
    if found is None:
        return rows.select(F.col("id").alias(id), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    found = cut(found)
    labels = components(found.filter("other is not null").select(F.col("rep").alias("a"), F.col("other").alias("b")))
    sums = found.groupBy("rep").agg(F.sum("links").alias("links"))
    of_class = classes.join(sums, "rep", "left").join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "rep").alias("component"))
    out = rows.join(of_class, "v", "left")
    return out.select(F.col("id").alias(id), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id"))


def _links(classes: DataFrame, dim: int, threshold: float, block: int, cell_rows: int, loss: float) -> DataFrame:
    turn = directions(dim)
    half, least = calibrate(dim, threshold)
    bits, tables = plan(classes.count(), threshold, cell_rows, loss)
    cuts = np.random.default_rng(9).standard_normal((dim, bits * tables))
    kept = classes.sparkSession.sparkContext.broadcast((turn, cuts))  # grows with the logarithm of the rows
    kind = pa.schema([("table", pa.int32()), ("cell", pa.int64()), ("rep", pa.int64()), ("copies", pa.int64()), ("data", pa.binary())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x = part.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                keys, raw = cells(x, kept.value[1], bits), pa.array([row.tobytes() for row in x], pa.binary())
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(keys[:, t]), part.column(1), part.column(2), raw], schema=kind)

    dealt = cut(classes.select("v", "rep", "copies").mapInArrow(deal, "table int, cell bigint, rep bigint, copies bigint, data binary"))
    held = dealt.groupBy("table", "cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    placed = dealt.join(held, ["table", "cell"]).withColumn("i", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    blocks = cut(placed.groupBy("table", "cell", "blocks", "i").agg(F.collect_list(F.struct("rep", "copies", "data")).alias("rows")))  # about ``block`` of them
    alone = blocks.select("table", "i", F.col("i").alias("j"), F.col("rows").alias("x"), F.lit(None).cast(blocks.schema["rows"].dataType).alias("y"))  # a block by itself is not shipped again
    one = blocks.filter("i + 1 < blocks").select("table", "cell", "i", F.explode(F.sequence(F.col("i") + 1, F.col("blocks") - 1)).alias("j"), F.col("rows").alias("x"))
    met = one.join(blocks.filter("i > 0").select("table", "cell", F.col("i").alias("j"), F.col("rows").alias("y")), ["table", "cell", "j"])

    def load(column: pa.ListArray, row: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own = column[row].values
        return np.frombuffer(b"".join(own.field(2).to_pylist()), np.float64).reshape(-1, dim), own.field(0).to_numpy(), own.field(1).to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                t, same = batch.column(0)[row].as_py(), batch.column(1)[row].as_py() == batch.column(2)[row].as_py()
                earlier = kept.value[1][:, : t * bits]
                x, x_ids, x_copies = load(batch.column(3), row)
                x_met = cells(x, earlier, bits) if t else None
                y, y_ids, y_copies, y_met = (None, x_ids, x_copies, x_met) if same else (*load(batch.column(4), row), None)
                if not same and t:
                    y_met = cells(y, earlier, bits)
                links, (a, b) = tile(x, y, threshold, half, least, kept.value[0], x_copies, y_copies, x_met, y_met)
                ids = x_ids if same else np.concatenate([x_ids, y_ids])
                some = np.flatnonzero(links)
                other = np.full(len(ids), -1, np.int64)
                other[a] = b
                joined = other[some]
                yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(links[some]), pa.array(ids[np.maximum(joined, 0)], mask=joined < 0)], names=["rep", "links", "other"])

    return alone.unionByName(met.select("table", "i", "j", "x", "y")).mapInArrow(run, "rep bigint, links bigint, other bigint")
