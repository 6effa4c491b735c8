"""A Merkle manifest of a dataset from an associative monoid of sparse forests.

The leaves of a group ascend by id and stand under one tree of known arity, the groups' roots under another.  Leaves are dealt
over tasks by ranges of (group, id), so a task holds a consecutive stretch of leaves, of few groups or of many, however large one group is.

* A task merges its own stretch level by level.  What it cannot merge, because a sibling lies in another task, are at most
  ``2 * arity`` nodes a level: its *fragment*, keyed by tree, level and index.
* Fragments form a commutative monoid (``merge``): the union of two, in which every run of siblings that is now complete becomes its
  parent.  How many siblings a run has follows from the number of leaves alone, so the last run of a level is known to be
  shorter.  The root of a group's tree is a leaf of the tree above.  ``treeReduce`` merges the fragments of all tasks to one node, the root.
* A run completed by a merge lies across tasks.  Its nodes are kept beside the fragment, because the proofs of leaves near
  a border name them: at most ``2 * arity`` a level and task, which bounds what reaches the driver and goes back by broadcast; it grows with the
  number of tasks, not of rows.
* Each task then knows every sibling on the way from each of its leaves to the root, its own from its own stretch, the
  others from there, folds the leaf that it finds and compares.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut

TOP = -1  # the tree over the groups' roots
Key = tuple[int, int, int]  # tree, level, index
Nodes = dict[Key, bytes]


def joined(parts: list[bytes]) -> bytes:
    """Hex digest of the digests of a run, as text one after the other."""
    return hashlib.sha256(b"".join(parts)).hexdigest().encode()


def heights(n: int, arity: int) -> list[int]:
    """Number of nodes on each level over ``n`` leaves, down to one."""
    out = [n]
    while out[-1] > 1:
        out.append(-(-out[-1] // arity))
    return out


class Stretch:
    """The leaves from ``first`` on of a tree of ``n`` leaves, with all nodes above them that they make alone."""

    def __init__(self, first: int, leaves: list[bytes], n: int, arity: int):
        self.arity, self.counts = arity, heights(n, arity)
        self.levels = [(first, leaves)]
        for count in self.counts[:-1]:
            lo, nodes = self.levels[-1]
            hi = lo + len(nodes)
            begin = -(-lo // arity)
            end = max(begin, -(-count // arity) if hi == count else hi // arity)
            self.levels.append((begin, [joined(nodes[i * arity - lo : (i + 1) * arity - lo]) for i in range(begin, end)]))

    def get(self, level: int, i: int) -> bytes | None:
        lo, nodes = self.levels[level]
        return nodes[i - lo] if lo <= i < lo + len(nodes) else None

    def open(self) -> Iterator[tuple[int, int, bytes]]:
        """Nodes without their parent: level, index, digest."""
        for level, (lo, nodes) in enumerate(self.levels):
            if level + 1 == len(self.levels):
                begin = end = 0
            else:
                up, parents = self.levels[level + 1]
                begin, end = up * self.arity, (up + len(parents)) * self.arity
            for i, h in enumerate(nodes, lo):
                if begin == end or not begin <= i < end:
                    yield level, i, h


def merge(x: tuple[Nodes, Nodes], y: tuple[Nodes, Nodes], counts: dict[int, list[int]], arity: int) -> tuple[Nodes, Nodes]:
    """Two fragments (open nodes, nodes of runs completed by merges) as one.  ``counts``: the level sizes of trees that lie across tasks."""
    if len(x[0]) < len(y[0]):
        x, y = y, x
    nodes, held = dict(x[0]) | y[0], dict(x[1]) | y[1]
    fresh = list(y[0])
    while fresh:
        tree, level, i = fresh.pop()
        sizes = counts[tree]
        if level + 1 == len(sizes):
            if tree != TOP and (tree, level, i) in nodes:
                nodes[TOP, 0, tree] = nodes.pop((tree, level, i))
                fresh.append((TOP, 0, tree))
            continue
        run = [(tree, level, j) for j in range(i - i % arity, min(i - i % arity + arity, sizes[level]))]
        if all(k in nodes for k in run):
            parts = [nodes.pop(k) for k in run]
            held.update(zip(run, parts))
            nodes[up := (tree, level + 1, i // arity)] = joined(parts)
            fresh.append(up)
    return nodes, held


class Layout:
    """Where each task's stretch of the sorted leaves lies: from one row a task, as in a numbering of partitions."""

    def __init__(self, summaries: list, arity: int):
        #: by task: rank of its first group, place of its first leaf in it, sizes of its first and last groups
        self.at: dict[int, tuple[int, int]] = {}
        totals: dict[int, int] = {}
        rank, before, last = -1, 0, None
        for s in sorted(summaries, key=lambda s: s.task):
            if rank < 0 or s.first != last:
                rank, before = rank + 1, 0
            self.at[s.task] = (rank, before)
            totals[rank] = totals.get(rank, 0) + s.n_first
            if s.groups > 1:
                rank, before = rank + s.groups - 1, 0
                totals[rank] = s.n_last
            before, last = before + (s.n_last if s.groups > 1 else s.n_first), s.last
        self.totals, self.groups = totals, rank + 1
        self.counts = {r: heights(n, arity) for r, n in totals.items()} | {TOP: heights(self.groups, arity)}


def _runs(column: pa.Array) -> list[tuple[str | None, int]]:
    """Runs of equal values with their lengths."""
    ree = pc.run_end_encode(column)
    return list(zip(ree.values.to_pylist(), np.diff(ree.run_ends.to_numpy(), prepend=0).tolist()))


def _summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    first = last = None
    n_first = n_last = groups = 0
    for batch in batches:
        for value, n in _runs(batch.column(1)) if batch.num_rows else []:
            if not groups or value != last:
                groups, n_last, last = groups + 1, 0, value
                first = value if groups == 1 else first
            n_last += n
            n_first += n if groups == 1 else 0
    if groups:
        yield pa.RecordBatch.from_pylist([{"task": TaskContext.get().partitionId(), "first": first, "n_first": n_first, "last": last, "n_last": n_last, "groups": groups}], schema=_SUMMARY)


_SUMMARY = pa.schema([("task", pa.int32()), ("first", pa.string()), ("n_first", pa.int64()), ("last", pa.string()), ("n_last", pa.int64()), ("groups", pa.int64())])


def _stretches(batches: Iterator[pa.RecordBatch], layout: Layout, arity: int, seen: list | None = None) -> tuple[list[tuple[int, Stretch]], Stretch | None, int]:
    """The task's stretches by rank of group, its stretch of the tree above (groups that it holds whole) and that one's first rank."""
    leaves: list[list[bytes]] = []
    last = object()
    for batch in batches:
        if not batch.num_rows:
            continue
        if seen is not None:
            seen.append(batch)
        own, i = [h.hex().encode() for h in batch.column(2).to_pylist()], 0
        for value, n in _runs(batch.column(1)):
            if not leaves or value != last:
                leaves.append([])
                last = value
            leaves[-1].extend(own[i : i + n])
            i += n
    if not leaves:
        return [], None, 0
    rank, before = layout.at[TaskContext.get().partitionId()]
    made = [(rank + j, Stretch(before if j == 0 else 0, own, layout.totals.get(rank + j, len(own)), arity)) for j, own in enumerate(leaves)]
    whole = [(r, top[0]) for r, s in made if (top := s.levels[-1][1])]  # only the first and the last can miss here
    return made, Stretch(whole[0][0], [h for _, h in whole], layout.groups, arity) if whole else None, whole[0][0] if whole else 0


def manifest(docs: DataFrame, *, columns: list[str], id: str = "doc_id", group: str = "lang", found: dict[str, Column] | None = None, arity: int = 2, task_rows: int = 500_000) -> DataFrame:
    """One row per input row: ``id``, ``group``, ``leaf``, ``subroot``, ``root``, ``proof`` (array, leaf to root), ``folded_root``, ``verified``.

    A leaf is the lower-case hex SHA-256 of ``columns``, each ``-`` if null, else its length in UTF-8 bytes, ``:`` and its value as
    text.  ``found`` names columns whose value is another one when the row is verified (default: none): the row's leaf then is folded
    from those values with the original siblings.  Groups are ordered null first, then by bytes; ids null first; equal ids by leaf, so repeated rows
    change places only with their equals.  A group of one leaf is that leaf, and a table of one group has its subroot as root.  An empty
    table gives no rows.  Other columns are ignored.
    """
    arity = int(arity)
    if arity < 2:
        raise ValueError("arity must be 2 or more")
    text = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    leaf = lambda over: F.unhex(F.sha2(F.concat(*(text(over.get(c, F.col(f"`{c}`"))) for c in columns)), 256))
    hashed = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{group}`").cast("string").alias("g"), leaf({}).alias("leaf"), (leaf(found) if found else F.lit(None).cast("binary")).alias("seen"))
    hashed = cut(hashed.withColumn("seen", F.nullif("seen", "leaf"))).withColumn("tie", F.monotonically_increasing_id())
    order = [F.asc_nulls_first("g"), F.asc_nulls_first("id"), F.asc("leaf"), F.asc("tie")]  # the tie parts rows that are equal in all
    spark = docs.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(hashed.count() / task_rows))
    dealt = cut(hashed.repartitionByRange(tasks, *order).sortWithinPartitions(*order).select("id", "g", "leaf", "seen"))

    summaries = dealt.mapInArrow(_summary, "task int, first string, n_first bigint, last string, n_last bigint, groups bigint").collect()  # one row a task
    layout = spark.sparkContext.broadcast(Layout(summaries, arity))
    out = T.StructType([T.StructField(id, docs.schema[id].dataType), T.StructField(group, T.StringType())])
    out = out.add("leaf", "string").add("subroot", "string").add("root", "string").add("proof", T.ArrayType(T.StringType())).add("folded_root", "string").add("verified", "boolean")
    if not summaries:
        return spark.createDataFrame([], out)

    def fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, top, _ = _stretches(batches, layout.value, arity)
        rows = [(r, level, i, h) for r, s in made for level, i, h in s.open() if level + 1 < len(s.counts)]
        rows += [(TOP, level, i, h) for level, i, h in top.open()] if top else []
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.binary()))], names=["tree", "level", "i", "digest"])

    nodes = dealt.mapInArrow(fragments, "tree bigint, level int, i bigint, digest binary")
    forest = nodes.rdd.mapPartitions(lambda rows: [({(r.tree, r.level, r.i): bytes(r.digest) for r in rows}, {})])
    left, held = forest.treeReduce(lambda x, y: merge(x, y, layout.value.counts, arity), depth=3)
    far = spark.sparkContext.broadcast((held | left, left[TOP, len(layout.value.counts[TOP]) - 1, 0]))

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[pa.RecordBatch] = []
        made, top, _ = _stretches(batches, layout.value, arity, seen)
        if not made:
            return
        held, root = far.value
        path = _Paths(layout.value, held, arity, top)
        rows = ((rank, s.levels[0][0] + j, s) for rank, s in made for j in range(len(s.levels[0][1])))
        for batch in seen:
            for first in range(0, batch.num_rows, 4096):
                part = batch.slice(first, 4096)
                leaves, subroots, proofs, folded = [], [], [], []
                for other in part.column(3).to_pylist():
                    rank, i, s = next(rows)
                    leaf = s.get(0, i)
                    steps, above, subroot = path.of(rank, i, s)
                    h, proof = leaf if other is None else other.hex().encode(), []
                    for left_side, right_side in (*steps, *above):
                        h = joined([*left_side, h, *right_side])
                        proof += left_side
                        proof += right_side
                    leaves.append(leaf)
                    subroots.append(subroot)
                    proofs.append(proof)
                    folded.append(h)
                lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, proofs)], dtype=np.int32), pa.array([x for p in proofs for x in p], pa.binary()).cast(pa.string()))
                hexes = lambda x: pa.array(x, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), hexes(leaves), hexes(subroots), hexes([root] * part.num_rows), lists, hexes(folded), pa.array([h == root for h in folded])], names=out.names)

    return dealt.mapInArrow(prove, out)


class _Paths:
    """Siblings on the way from a leaf to the root, left and right of it on each level."""

    def __init__(self, layout: Layout, far: Nodes, arity: int, top: Stretch | None):
        self.layout, self.far, self.arity, self.top = layout, far, arity, top
        self.rank, self.above, self.subroot = None, [], b""

    def _steps(self, tree: int, i: int, counts: list[int], s: Stretch | None) -> list[tuple[list[bytes], list[bytes]]]:
        out = []
        for level, n in enumerate(counts[:-1]):
            begin = i - i % self.arity
            near = [self._node(tree, level, j, s) if j != i else b"" for j in range(begin, min(begin + self.arity, n))]
            out.append((near[: i - begin], near[i - begin + 1 :]))
            i //= self.arity
        return out

    def _node(self, tree: int, level: int, i: int, s: Stretch | None) -> bytes:
        own = s.get(level, i) if s else None
        return self.far[tree, level, i] if own is None else own

    def of(self, rank: int, i: int, s: Stretch):
        """Steps within the group's tree, steps above it, and the group's root."""
        if rank != self.rank:
            self.rank, self.above = rank, self._steps(TOP, rank, self.layout.counts[TOP], self.top)
            whole = s.levels[-1][1]
            self.subroot = whole[0] if whole else self.far.get((TOP, 0, rank), b"")
        return self._steps(rank, i, s.counts, s), self.above, self.subroot
