"""Near-duplicate documents from bottom-k sketches of one hash function.

A document's set is its distinct word shingles, each a 64-bit hash; its sketch is the k smallest.

1. Documents with equal sets become one class, told by a 64-bit fingerprint of the whole set.
2. The ``posted`` smallest retained values are inverted.  Two sets at the threshold share at least ``least`` of the
   smallest values of their union, but for a probability of ``loss`` (the exact binomial tail), so they share one of the
   ``posted - least + 1`` values that are rarest in the corpus: a class posts only those.  Rarity is the exact
   count of classes that retain a value, so common phrases post nothing and every list stays short, save
   those of groups of near copies.
3. A list is a group; long ones with the same least member are one.  Every member meets its list's least member, the hub.
   Sizes, 256-bit maps of the posted values and the estimate from the sketch of its union filter a pair, and the exact Jaccard
   of the full sets confirms it.  Members that the hub does not link meet a star of their own, ``stars`` times at most.
   Links join components.
4. What is left are groups that hold several components.  In small ones (at most ``short`` members) each pair of different
   components goes the way of step 3.  In large ones the members outside the largest component meet all
   others in tiles of bounded size, dealt over all tasks, twice: first with their sketches alone, which tells the members that have a
   partner, then those with their full sets: a tile counts overlaps of sketches, confirms on the full
   sets in place and returns a forest, at most one row per member.  No group is capped and no pair of different components is left out.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .appending import append, free_name
from .bytewords import NONSPACE, hashes, mix, slices, spans
from .common import components, cut

_STEP = np.uint64(0xC2B2AE3D27D4EB4F)
_LONE = np.uint64(0x165667B19E3779F9)


def shingle_sets(texts: pa.Array, width: int, kind: np.ndarray = NONSPACE):
    """For each text its sorted distinct shingle hashes (signed), the whole text as one if it is shorter, none if empty."""
    for first, last, data, offsets in slices(texts):
        s, e, at = spans(data, offsets, kind)
        h = hashes(data, s, e)
        with np.errstate(over="ignore"):
            run = h.copy()
            for j in range(1, width):
                run[: len(h) - j] = run[: len(h) - j] * _STEP + h[j:]
            run = mix(run)
            for i in range(last - first):
                a, b = at[i], at[i + 1]
                if b - a >= width:
                    yield np.unique(run[a : b - width + 1].view(np.int64))
                elif b > a:
                    whole = _LONE
                    for x in h[a:b]:
                        whole = whole * _STEP + x
                    yield mix(np.array([whole], np.uint64)).view(np.int64)
                else:
                    yield np.zeros(0, np.int64)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64)))


def bit_map(s: np.ndarray, size: int = 256) -> np.ndarray:
    """The lowest bits of the elements of a set, marked in a map of ``size`` bits, as 64-bit words."""
    bits = np.zeros(size, np.uint8)
    bits[s & (size - 1)] = 1
    return np.packbits(bits, bitorder="little").view(np.int64)


def _sketches(width: int, k: int, posted: int):
    """Size, fingerprint (null for an empty set), sketch and a map of the values to be posted of each text's set."""

    def run(texts: pa.Array) -> pa.Array:
        n, mark, low, maps = [], [], [], []
        for s in shingle_sets(texts, width):
            n.append(len(s))
            mark.append(int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True) if len(s) else None)
            low.append(s[:k].copy())
            maps.append(bit_map(s[:posted]))
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(mark, pa.int64()), _lists(low), _lists(maps)], names=["n", "node", "low", "map"])

    return lambda: run


def _full(width: int):
    return lambda: lambda texts: _lists(list(shingle_sets(texts, width)))


def least_shared(k: int, percent: int, loss: float = 1e-6) -> int:
    """The largest m such that of k draws, each shared with probability ``percent``, fewer than m are with probability ``loss`` at most."""
    t, tail, m = percent / 100, 0.0, 0
    while m < k:
        tail += math.comb(k, m) * t**m * (1 - t) ** (k - m)
        if tail > loss:
            break
        m += 1
    return m


def _alike(n: Column, m: Column, percent: int) -> Column:
    """The length filter: sets of these sizes can reach the threshold."""
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def _room(n: Column, m: Column, x: Column, y: Column, posted: int, least: int, percent: int) -> Column:
    """Whether sizes and maps leave room for as many common posted values as a link has: a bit of one map alone is a value of that set alone."""
    alone = lambda a, b: sum((F.bit_count(a[i].bitwiseAND(F.bitwise_not(b[i]))) for i in range(1, 4)), F.bit_count(a[0].bitwiseAND(F.bitwise_not(b[0]))))
    most = F.least(F.least(n, F.lit(posted)) - alone(x, y), F.least(m, F.lit(posted)) - alone(y, x))
    need = F.when((n <= posted) & (m <= posted), F.ceil((n + m) * percent / (100 + percent))).otherwise(least)
    return _alike(n, m, percent) & (most >= need)


def _estimate(x: Column, y: Column, n: Column, m: Column, k: int, least: int, percent: int) -> Column:
    """Whether the sketch of the union, made from two sketches, allows a link; exact where both sketches are whole sets."""
    common = F.array_intersect(x, y)
    last = F.get(F.array_sort(F.array_union(x, y)), F.lit(k - 1))
    whole = F.size(common) * 100 >= (n + m - F.size(common)) * percent
    return F.when((n <= k) & (m <= k), whole).otherwise(F.size(F.filter(common, lambda v: v <= last)) >= least)


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Exact test of two full sets."""
    same = len(np.intersect1d(x, y, assume_unique=True))
    return same * 100 >= (len(x) + len(y) - same) * percent


def partners(x: tuple[list, list, list, list[np.ndarray]], y: tuple[list, list, list, list[np.ndarray]], k: int, least: int, percent: int) -> set[int]:
    """Nodes of two blocks (nodes, components, sizes, sketches) with a partner of another component that their sketches allow."""
    xn, xc, xm, xs = x
    yn, yc, ym, ys = y
    names, comps, sizes = np.array(yn), np.array(yc), np.array(ym)
    owner, values = np.repeat(np.arange(len(ys)), [len(s) for s in ys]), np.concatenate(ys)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    found: set[int] = set()
    for node, comp, n, s in zip(xn, xc, xm, xs):
        low, high = np.searchsorted(values, s, "left"), np.searchsorted(values, s, "right")
        count = high - low
        where = np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
        shared = np.bincount(owner[where], minlength=len(ys))
        near = _allowed(shared, sizes, n, k, least, percent) & (comps != comp)
        if near.any():
            found.add(node)
            found.update(names[near].tolist())
    return found


def _allowed(shared: np.ndarray, sizes: np.ndarray, n: int, k: int, least: int, percent: int) -> np.ndarray:
    """Whether so many values shared by sketches allow a link of a set of size ``n`` to sets of these sizes."""
    most, fewest = np.maximum(sizes, n), np.minimum(sizes, n)
    return np.where(most <= k, shared * 100 >= (sizes + n - shared) * percent, shared >= least) & (fewest * 100 >= most * percent)


def tile(x: tuple[list, list, list[np.ndarray]], y: tuple[list, list, list[np.ndarray]], k: int, least: int, percent: int) -> list[tuple[int, int]]:
    """Links between two blocks (nodes, components, full sets) that join different components: a forest over the components."""
    root: dict[int, int] = {}

    def find(c: int) -> int:
        while root.get(c, c) != c:
            root[c] = root.get(root[c], root[c])
            c = root[c]
        return c

    xn, xc, xs = x
    yn, yc, ys = y
    sizes = np.array([len(s) for s in ys])
    owner = np.repeat(np.arange(len(ys)), np.minimum(sizes, k))
    values = np.concatenate([s[:k] for s in ys])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    edges = []
    for node, comp, s in zip(xn, xc, xs):
        low, high = np.searchsorted(values, s[:k], "left"), np.searchsorted(values, s[:k], "right")
        count = high - low
        where = np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
        shared = np.bincount(owner[where], minlength=len(ys))
        near = np.flatnonzero(_allowed(shared, sizes, len(s), k, least, percent))
        for j in near[np.argsort(-shared[near], kind="stable")].tolist():
            a, b = find(comp), find(yc[j])
            if a != b and linked(s, ys[j], percent):
                root[a] = b
                edges.append((node, yn[j]))
    return edges


def _block(column: pa.Array, row: int) -> list:
    """Columns of a block: lists, the last one of arrays."""
    own = column[row].values
    *plain, sets = own.flatten()
    flat, at = sets.values.to_numpy(zero_copy_only=False), sets.offsets.to_numpy()
    return [c.to_pylist() for c in plain] + [[flat[a:b] for a, b in zip(at[:-1], at[1:])]]


def _tiles(k: int, least: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                made = tile(_block(batch.column("x"), row), _block(batch.column("y"), row), k, least, percent)
                if made:
                    a, b = zip(*made)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _partners(k: int, least: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                found = sorted(partners(_block(batch.column("x"), row), _block(batch.column("y"), row), k, least, percent))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([batch.column("g")[row].as_py()] * len(found), pa.int64()), pa.array(found, pa.int64())], names=["g", "node"])

    return run


def _in_tiles(held: DataFrame, members: list[str]) -> DataFrame:
    """Rows ``g, x, y``: the blocks of each group's tiles.  ``held``: g, node, minor, is, js and what ``members`` names; a member of
    the largest component is in the second blocks alone, and goes to every tile that it meets, in one shuffle; tiles are told by a hash of the node."""
    spread = lambda side, every: F.explode(F.transform(F.sequence(F.lit(0), F.col(every) - 1), lambda j: F.struct(F.pmod(F.xxhash64("node", F.lit(side)), F.col(f"{side}s")).cast("int").alias("own"), j.alias("other"))))
    x = held.filter("minor").withColumn("k", spread("i", "js")).select("g", F.col("k.own").alias("i"), F.col("k.other").alias("j"), F.struct(*members).alias("x"), F.lit(None).alias("y"))
    y = held.withColumn("k", spread("j", "is")).select("g", F.col("k.other").alias("i"), F.col("k.own").alias("j"), F.lit(None).alias("x"), F.struct(*members).alias("y"))
    return x.unionByName(y).groupBy("g", "i", "j").agg(F.collect_list("x").alias("x"), F.collect_list("y").alias("y")).filter("size(x) > 0 and size(y) > 0").select("g", "x", "y")


class _Sets:
    """Full sets of the classes that are asked for, each made once from the text of its least row (``lead``: node, id, h and
    whether several rows bear this id and text; only such texts are moved, to leave one)."""

    def __init__(self, base: DataFrame, lead: DataFrame, words: int, broadcast_rows: int):
        self.base, self.lead, self.words, self.broadcast_rows, self.held = base, lead, words, broadcast_rows, None

    def of(self, wanted: DataFrame) -> DataFrame | None:
        """All sets made so far (node, s), those of ``wanted`` (column node) among them."""
        wanted = wanted.distinct()
        if self.held is not None:
            wanted = wanted.join(self.held.select("node"), "node", "left_anti")
        wanted = cut(wanted.join(self.lead, "node"))
        n = wanted.count()
        if n:
            pick = self.base.join(F.broadcast(wanted) if n <= self.broadcast_rows else wanted, ["id", "h"])
            if not wanted.filter("twice").isEmpty():
                pick = pick.filter("not twice").unionByName(pick.filter("twice").dropDuplicates(["node"]))
            made = cut(append(pick, ["t"], "s", "array<bigint>", _full(self.words)).select("node", "s"))
            self.held = made if self.held is None else self.held.unionByName(made)
        return self.held


def _groups(docs: DataFrame, id: str, text: str, percent: int, words: int, k: int, posted: int, stars: int, short: int, block: int, broadcast_rows: int, loss: float) -> tuple[DataFrame, DataFrame]:
    """Rows (id, h, n, node) of all documents, h a hash of the text, and for each node its component: node, of, id and h of the component's least row."""
    base = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("t")).withColumn("h", F.xxhash64("t"))
    made = append(base, ["t"], "s", "struct<n: bigint, node: bigint, low: array<bigint>, map: array<bigint>>", _sketches(words, k, posted))
    rows = cut(made.select("id", "h", "s.n", F.when(F.col("id").isNotNull(), F.col("s.node")).alias("node"), F.col("s.low").alias("low"), F.col("s.map").alias("map")))
    classes = rows.filter("node is not null").groupBy("node").agg(F.min(F.struct("id", "h")).alias("lead"), F.first(F.struct("n", "low", "map")).alias("s"))
    classes = cut(classes.select("node", "lead.id", "lead.h", "s.n", "s.low", "s.map"))
    least = least_shared(k, percent, loss)
    twice = cut(rows.filter("node is not null").groupBy("id", "h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id", "h", F.lit(True).alias("twice")))
    lead = classes.select("node", "id", "h").join(F.broadcast(twice) if twice.count() <= broadcast_rows else twice, ["id", "h"], "left")
    full = _Sets(base, lead.withColumn("twice", F.coalesce("twice", F.lit(False))), words, broadcast_rows)

    # inverted lists of the rarest retained values; a value that one class alone retains comes first and needs no list
    post = classes.filter("n > 1").select("node", F.explode(F.slice("low", 1, posted)).alias("v"))
    often = cut(post.groupBy("v").agg(F.count(F.lit(1)).alias("often")).filter("often > 1"))
    shared = post.join(often, "v").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("often", "v"))).alias("w"))  # at most ``posted`` values
    fewest = least_shared(posted, percent, loss)
    need = F.when(F.col("n") * 100 <= posted * percent, F.ceil(F.col("n") * percent / 100)).otherwise(fewest)  # no partner of such a small set is cut off
    unique = F.least("n", F.lit(posted)) - F.size("w")
    sized = shared.join(classes.select("node", "n"), "node").select("node", "n", F.slice("w", F.lit(1), F.greatest(F.lit(0), F.least("n", F.lit(posted)) - need + 1 - unique).cast("int")).alias("w"))
    lists = cut(sized.select(F.explode("w.v").alias("v"), "node", "n"))
    alike = lambda n, m: _alike(F.col(n), F.col(m), percent)

    def confirmed(pairs: DataFrame) -> DataFrame:
        """The links among distinct pairs (a, b) of classes whose sizes are alike; only for these the maps move."""
        pairs = cut(pairs)
        of = lambda x: classes.select(F.col("node").alias(x), F.col("n").alias(f"{x}n"), F.col("map").alias(f"{x}m"))
        mapped = of("b").join(F.broadcast(pairs) if pairs.count() <= broadcast_rows else pairs, "b").join(of("a"), "a")
        pairs = cut(mapped.filter(_room(F.col("an"), F.col("bn"), F.col("am"), F.col("bm"), posted, fewest, percent)).select("a", "b"))
        ends = cut(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())  # only their sketches move
        small = ends.count() <= broadcast_rows
        held = classes.select("node", "n", "low").join(F.broadcast(ends) if small else ends, "node", "left_semi")
        sketch = lambda x: held.select(F.col("node").alias(x), F.col("n").alias(f"{x}n"), F.col("low").alias(f"{x}l"))
        near = cut(sketch("b").join(F.broadcast(pairs) if pairs.count() <= broadcast_rows else pairs, "b").join(sketch("a"), "a").filter(_estimate(F.col("al"), F.col("bl"), F.col("an"), F.col("bn"), k, least, percent)).select("a", "b"))
        sets = full.of(near.select(F.explode(F.array("a", "b")).alias("node")))
        if sets is None:
            return near
        few = near.count() <= broadcast_rows  # then no set moves for the first side
        first = near.select(F.col("a").alias("node")).distinct()  # of all sets made so far only those of pairs move
        asked = sets.join(F.broadcast(first) if few else first, "node", "left_semi").select(F.col("node").alias("a"), F.col("s").alias("x"))
        both = sets.select(F.col("node").alias("b"), F.col("s").alias("y")).join(F.broadcast(near) if few else near, "b").join(asked, "a")
        same = F.size(F.array_intersect("x", "y"))
        return cut(both.filter(same * 100 >= (F.size("x") + F.size("y") - same) * percent).select("a", "b"))

    # a long list goes by its hub, its least member: groups of copies share many lists, but meet once
    hubs = lists.groupBy("v").agg(F.min(F.struct("node", "n")).alias("hub"), F.count(F.lit(1)).alias("held")).filter("held > 1")
    hubs = cut(hubs.select("v", F.when(F.col("held") > short, F.col("hub.node")).otherwise(F.col("v")).alias("g"), F.col("hub.node").alias("hub"), F.col("hub.n").alias("hub_n")))
    groups = cut(lists.join(hubs, "v").select("g", "hub", "hub_n", "node", "n").distinct())
    links, now = None, groups.withColumn("star", F.col("hub"))
    for turn in range(stars):
        met = now.filter("node <> star").filter(alike("n", "hub_n")).select(F.col("star").alias("a"), F.col("node").alias("b"))
        more = confirmed(met.distinct())
        links = more if links is None else links.unionByName(more)
        if turn + 1 < stars:  # members that their star did not link meet one of their own
            apart = cut(now.filter("node <> star").join(more.select(F.col("a").alias("star"), F.col("b").alias("node")), ["star", "node"], "left_anti").select("g", "node", "n"))
            star = apart.groupBy("g").agg(F.min(F.struct("node", "n")).alias("s")).select("g", F.col("s.node").alias("star"), F.col("s.n").alias("hub_n"))
            now = apart.join(cut(star), "g")
    labels = components(links)

    # groups that still hold several components
    parted = groups.join(labels, "node", "left").select("g", "hub", "node", "n", F.coalesce("component", "node").alias("comp"))
    parts = parted.groupBy("g", "comp").agg(F.count(F.lit(1)).alias("p"))
    whole = parts.groupBy("g").agg(F.max_by("comp", F.struct("p", "comp")).alias("main"), F.max("p").alias("main_held"), F.sum("p").alias("held"), F.count(F.lit(1)).alias("comps")).filter("comps > 1 and held > 2")  # a hub and one member have met
    left = cut(parted.join(cut(whole.select("g", "main", "held", "main_held")), "g").select("g", "hub", "node", "n", "comp", (F.col("comp") != F.col("main")).alias("minor"), "held", "main_held"))

    few = left.filter(F.col("held") <= short)
    one, two = few.filter("minor").select("g", "hub", F.col("node").alias("x"), F.col("n").alias("xn"), F.col("comp").alias("xc")), few.select("g", F.col("node").alias("y"), F.col("n").alias("yn"), F.col("comp").alias("yc"))
    met = one.join(two, "g").filter("xc <> yc and x <> hub and y <> hub").filter(alike("xn", "yn")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    more = confirmed(met)

    many = left.filter(F.col("held") > short)
    if not many.isEmpty():
        # sketches first: most members of the list of a common value have no partner, and their sets stay where they are
        each = F.lit(max(1, block // (4 * k)))  # sketches to a block
        blocked = many.withColumns({"js": F.ceil(F.col("held") / each).cast("int"), "is": F.ceil((F.col("held") - F.col("main_held")) / each).cast("int")})
        low = classes.select("node", "low").join(F.broadcast(blocked) if many.count() <= broadcast_rows else blocked, "node")
        near = cut(_in_tiles(low, ["node", "comp", "n", "low"]).mapInArrow(_partners(k, least, percent), "g bigint, node bigint").distinct())
        many = cut(many.drop("held", "main_held").join(F.broadcast(near) if near.count() <= broadcast_rows else near, ["g", "node"], "left_semi"))
        sets = full.of(many.select("node"))
        if sets is not None:
            sums = many.groupBy("g").agg(F.ceil(F.sum("n") / block).cast("int").alias("js"), F.ceil(F.sum(F.when(F.col("minor"), F.col("n"))) / block).cast("int").alias("is"))
            blocked = cut(many.join(sums, "g"))
            held = sets.join(F.broadcast(blocked) if blocked.count() <= broadcast_rows else blocked, "node")
            tiles = _in_tiles(held, ["node", "comp", "s"])
            more = cut(more.unionByName(tiles.mapInArrow(_tiles(k, least, percent), "a bigint, b bigint")))
    if not more.isEmpty():  # the components are the nodes of what is left to join
        of_a, of_b = (labels.select(F.col("node").alias(x), F.col("component").alias(f"{x}c")) for x in "ab")
        rest = more.join(of_a, "a", "left").join(of_b, "b", "left").select(F.coalesce("ac", "a").alias("a"), F.coalesce("bc", "b").alias("b"))
        joined = components(rest).withColumnRenamed("node", "old").withColumnRenamed("component", "new")
        every = classes.select("node").join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("old"))
        labels = every.join(joined, "old").select("node", F.col("new").alias("component")).unionByName(labels.join(joined, labels["component"] == joined["old"], "left_anti"))
        labels = cut(labels)

    of = classes.join(labels, "node", "left").select("node", F.struct("id", "h").alias("lead"), F.coalesce("component", "node").alias("of"))
    first = cut(of.groupBy("of").agg(F.min("lead").alias("lead")))  # so the join back can be split where one component is large
    return rows.select("id", "h", "n", "node"), cut(of.select("node", "of").join(first, "of").select("node", "of", F.col("lead.id").alias("first_id"), F.col("lead.h").alias("first_h")))


def _options(options: dict) -> dict:
    return {"percent": 80, "words": 2, "k": 64, "posted": 32, "stars": 2, "short": 12, "block": 1 << 17, "broadcast_rows": 200_000, "loss": 1e-6} | options


def near_duplicates(docs: DataFrame, *, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per input row: ``id``, ``n_shingles``, ``component_id`` (least id reachable by links, itself included).

    Linked: ``100 * |A and B| >= percent * |A or B|`` over distinct ``words``-word shingles (A-Z lower-cased,
    words split at ASCII white space).  Null or empty texts and texts without words have an empty set
    and link with nothing.  Rows that repeat an id are documents of their own that share it.  A null id stays alone
    with a null component.  An empty table gives no rows; other columns are ignored.

    Options: ``percent`` 80, ``words`` 2, ``k`` 64 values retained, the ``posted`` 32 least of them inverted, ``loss`` 1e-6 (the probability that a pair at the
    threshold is not met), ``stars`` 2, ``short`` 12 members, ``block`` 131,072 shingles, ``broadcast_rows`` 200,000.
    """
    rows, groups = _groups(docs, id, text, **_options(options))
    out = rows.join(groups.select("node", "first_id"), "node", "left")
    return out.select(F.col("id").alias(id), F.col("n").alias("n_shingles"), F.coalesce("first_id", "id").alias("component_id"))


def deduplicate(docs: DataFrame, *, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row of each group, with its own columns only: the least id, of repeated ids one row.

    Documents without words and rows with a null id all stay.
    """
    taken = _options(options)
    rows, groups = _groups(docs, id, text, **taken)
    placed = rows.join(groups, "node")
    i, h = free_name(docs, "_id"), free_name(docs, "_h")
    gone = cut(placed.filter("id <> first_id or h <> first_h").select(F.col("id").alias(i), F.col("h").alias(h)).distinct())
    again = cut(placed.filter("id = first_id and h = first_h").groupBy(F.col("id").alias(i), F.col("h").alias(h)).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
    side = lambda df: F.broadcast(df) if df.count() <= taken["broadcast_rows"] else df
    marked = docs.withColumn(i, F.col(id).cast("long")).withColumn(h, F.xxhash64(text))
    kept = marked.join(side(gone), [i, h], "left_anti")
    if not again.isEmpty():
        kept = kept.join(side(again), [i, h], "left_anti").unionByName(kept.join(side(again), [i, h], "left_semi").dropDuplicates([i, h]))
    return kept.select(*docs.columns)
