"""Alignment of two tokenizers over a corpus: which token pairs overlap, in how many documents, and what each document adds.

1. One pass over the texts writes, in the shared folder, a row per document and *postings*: for each block of documents and each
   id of side A, the ids of side B that it is linked with and, for each of those, the documents and their multiplicities.
2. Counts of documents per pair are summed from the blocks' partial counts, a few numbers per pair, not from the postings.
3. The cogroup: counts and postings go to the same task by their A id and are sorted there by Spark's external sort, counts before
   postings.  A task reads this stream once: it takes an id's counts (at most one per id of side B), their maximum, then
   passes its postings and adds up what each document gets.  An id whose postings are large is dealt over several tasks by block, and its counts
   go to each of them; how many follows from its measured size, so no id makes one task large.
4. Contributions leave a task summed by document and meet by block, where documents are few; the sums join the document's row.

Neither tokenizer joins text across an ASCII space that follows a solid character: side A's rules begin a new word there and no piece of side B has a space
after another character (else whole texts are encoded).  Texts are cut there, both sides' tokens end there, and each distinct
stretch of a task is encoded, aligned and written once.
"""

from __future__ import annotations

import hashlib
import math
import os
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .appending import give_back
from .bytewords import hashes, slices
from .common import shared_root

_SAME = np.arange(256, dtype=np.uint8)
#: Last bytes of characters that no rule takes for white space: ASCII graphics, and of longer characters those that end no Unicode space.
_SOLID = np.array([0x21 <= b <= 0x7E or b >= 0x80 and b not in {*range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF} for b in range(256)])
_WIDTHS = [np.dtype("u1"), np.dtype("<u2"), np.dtype("<u4")]


def byte_alphabet() -> dict[str, int]:
    """Characters of a byte-level vocabulary: printable Latin-1 stands for itself, all other bytes for 256, 257, ... in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


def overlaps(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Token ends of two sides over the same bytes, ascending: places (i, j) of overlapping tokens, and the last tokens (i, j) of each group, after which both end."""
    begin = np.concatenate([[0], a[:-1]])
    low, high = np.searchsorted(b, begin, "right"), np.searchsorted(b, a, "left")
    count = high - low + 1
    i = np.repeat(np.arange(len(a)), count)
    j = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count - low, count)
    both = np.flatnonzero(b[high] == a) if len(a) else np.zeros(0, np.int64)
    return i, j, both, high[both]


class Aligner:
    """Both tokenizers and the stretches seen so far."""

    def __init__(self, a_path: str, b_path: str, most: int = 250_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b, self.most = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path), most
        self.a.encode_special_tokens = True
        alphabet, special = byte_alphabet(), {t.content for t in self.a.get_added_tokens_decoder().values()}
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for piece, i in self.a.get_vocab().items():
            self.a_bytes[i] = piece.encode() if piece in special else bytes(alphabet[c] for c in piece)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array([len(x) for x in side]) for side in (self.a_bytes, self.b_bytes))
        # ids as they stand in a group: followed by a comma, or by what ends their side of it
        self.texts = [b"%d%s" % (i, end) for n, ends in ((len(self.a_bytes), (b",", b"|")), (len(self.b_bytes), (b",", b";"))) for i in range(n) for end in ends]
        self.cuts = not any("▁" in p.lstrip("▁") for p in pieces)
        self.space = self.b.encode("a ")[len(self.b.encode("a")) :]  # the library gives nothing for an empty text, the space that it adds included
        self._clear()

    def _clear(self) -> None:
        self.index: dict[int, int] = {}
        self.shown: list[bytes] = []
        self.sizes = np.zeros((1 << 14, 4), np.int64)  # tokens of A and B, groups, links; -1 where bytes differ
        self.start = np.zeros(1 << 14, np.int64)  # of a stretch's links
        self.pairs, self.used = np.zeros(1 << 16, np.int64), 0

    def _room(self, stretches: int, links: int) -> None:
        while len(self.sizes) < stretches:
            self.sizes, self.start = (np.concatenate([x, np.zeros_like(x)]) for x in (self.sizes, self.start))
        while len(self.pairs) < links:
            self.pairs = np.concatenate([self.pairs, np.zeros_like(self.pairs)])

    def _keep(self, hs: list[int], raw: list[bytes]) -> None:
        """Encode and align new stretches, all at once; those whose bytes differ are marked."""
        texts = [x.decode() for x in raw]
        ours = [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        theirs = [b if len(x) > 1 else self.space for b, x in zip(self.b.encode([t[1:] for t in texts]), raw)]
        if any(b"".join([names[i] for ids in side for i in ids]) != b"".join(raw) for side, names in ((ours, self.a_bytes), (theirs, self.b_bytes))):
            good = [b"".join([self.a_bytes[i] for i in x]) == w == b"".join([self.b_bytes[i] for i in y]) for x, y, w in zip(ours, theirs, raw)]
        else:  # then each stretch's sizes must agree too
            sizes = [np.add.reduceat(lengths[np.fromiter(chain.from_iterable(side), np.int64)], np.cumsum([0, *map(len, side)])[:-1]) for side, lengths in ((ours, self.a_size), (theirs, self.b_size))] if all(map(len, ours)) and all(map(len, theirs)) else None
            wanted = np.array([len(w) for w in raw])
            good = (sizes[0] == wanted) & (sizes[1] == wanted) if sizes else [b"".join([self.a_bytes[i] for i in x]) == w == b"".join([self.b_bytes[i] for i in y]) for x, y, w in zip(ours, theirs, raw)]
        first, n = len(self.index), len(raw)
        self._room(first + n, 0)
        self.index.update(zip(hs, range(first, first + n)))
        self.sizes[first : first + n] = -1, 0, 0, 0
        self.start[first : first + n] = self.used
        shown = [b""] * n
        if own := np.flatnonzero(good).tolist():
            counts = [np.array([len(side[k]) for k in own]) for side in (ours, theirs)]
            a, b = (np.fromiter(chain.from_iterable(side[k] for k in own), np.int64) for side in (ours, theirs))
            i, j, ends_a, ends_b = overlaps(np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b]))
            lasts = np.cumsum(counts[0]) - 1
            last_link, last_group = np.searchsorted(i, lasts, "right"), np.searchsorted(ends_a, lasts, "right")
            links, groups = np.diff(last_link, prepend=0), np.diff(last_group, prepend=0)
            at = first + np.array(own)
            self.sizes[at] = np.stack([*counts, groups, links], axis=1)
            self._room(0, self.used + len(i))
            self.pairs[self.used : self.used + len(i)] = a[i] << 32 | b[j]
            self.start[at] = self.used + last_link - links
            self.used += len(i)
            # the ids in their order in groups: those of side A, then those of side B
            group = [np.searchsorted(e, np.arange(len(x))) for e, x in ((ends_a, a), (ends_b, b))]
            closes = [np.zeros(len(x), np.int64) for x in (a, b)]
            closes[0][ends_a] = closes[1][ends_b] = 1
            code = np.concatenate([a * 2 + closes[0], (len(self.a_bytes) + b) * 2 + closes[1]])
            order = np.argsort(np.concatenate([group[0] * 2, group[1] * 2 + 1]), kind="stable")
            parts = [self.texts[c] for c in code[order].tolist()]
            stops = np.cumsum(counts[0] + counts[1]).tolist()
            for k, x, y in zip(own, [0, *stops], stops):
                shown[k] = b"".join(parts[x:y])
        self.shown.extend(shown)

    def align(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
        """For a run of texts: sizes of each (tokens of A and B, groups, links), digests, and all links as (pair, text)."""
        n = len(offsets) - 1
        full = offsets[1:] > offsets[:-1]
        data = np.insert(data, offsets[:-1][full], 0x20)
        offsets = offsets + np.concatenate([[0], np.cumsum(full)])
        begins = np.zeros(len(data), bool)
        if self.cuts and len(data):
            begins[1:] = (data[1:] == 0x20) & _SOLID[data[:-1]]
        begins[offsets[:-1][full]] = True
        s = np.flatnonzero(begins)
        e = np.append(s[1:], len(data))
        h, first, inverse = np.unique(hashes(data, s, e, _SAME), return_index=True, return_inverse=True)
        if len(self.index) > self.most:
            self._clear()
        keys = h.tolist()
        if new := [i for i, k in enumerate(keys) if k not in self.index]:
            raw = data.tobytes()
            for at in range(0, len(new), 4096):
                own = new[at : at + 4096]
                self._keep([keys[i] for i in own], [raw[s[j] : e[j]] for j in first[own]])
        index = self.index
        known = np.fromiter((index[k] for k in keys), np.int64, len(keys))[inverse] if len(keys) else np.zeros(0, np.int64)
        at = np.searchsorted(s, offsets)
        own = self.sizes[known]
        running = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(own, axis=0)])
        total = running[at[1:]] - running[at[:-1]]
        bad = np.concatenate([[0], np.cumsum(own[:, 0] < 0)])
        lost = (bad[at[1:]] > bad[at[:-1]]) | ~full
        total[lost] = 0
        cuts, each, shown = at.tolist(), known.tolist(), self.shown
        digests = ["" if gone else hashlib.sha256(b"".join([shown[k] for k in each[i:j]])[:-1]).hexdigest() for i, j, gone in zip(cuts, cuts[1:], lost.tolist())]
        text = np.repeat(np.arange(n), np.diff(at))
        keep = ~lost[text]
        known, text, count = known[keep], text[keep], own[keep, 3]
        where = np.repeat(self.start[known] - np.cumsum(count) + count, count) + np.arange(count.sum())
        return total, digests, self.pairs[where], np.repeat(text, count)


_ROWS = pa.schema([("block", pa.int64()), ("place", pa.int32()), ("doc", pa.int64()), ("n", pa.list_(pa.int64())), ("digest", pa.string()), ("a", pa.int32()), ("b", pa.list_(pa.int32())), ("held", pa.list_(pa.int32())), ("data", pa.binary())])
_ROWS_DDL = "block bigint, place int, doc bigint, n array<bigint>, digest string, a int, b array<int>, held array<int>, data binary"


def _small(x: np.ndarray) -> tuple[int, np.ndarray]:
    """An array in the narrowest width that holds it, and which that is."""
    code = 0 if not len(x) or x.max() < 1 << 8 else 1 if x.max() < 1 << 16 else 2
    return code, x.astype(_WIDTHS[code])


def _postings(block: int, pairs: np.ndarray, places: np.ndarray, many: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A block's links, by pair and then document, as one row per id of side A."""
    order = np.lexsort((places, pairs))
    pairs, places, many = pairs[order], places[order], many[order]
    first = np.flatnonzero(np.diff(pairs, prepend=-1))
    held, kinds = np.diff(np.append(first, len(pairs))), pairs[first]
    a, b = (kinds >> 32).astype(np.int32), (kinds & 0xFFFFFFFF).astype(np.int32)
    heads = np.flatnonzero(np.diff(a, prepend=-1))
    tails = np.append(heads[1:], len(a))
    ends = np.append(first, len(pairs))
    data = []
    for i, j in zip(ends[heads].tolist(), ends[tails].tolist()):
        (x, p), (y, m) = _small(places[i:j]), _small(many[i:j])
        data.append(bytes([x << 2 | y]) + p.tobytes() + m.tobytes())
    offsets = np.append(heads, len(a)).astype(np.int32)
    for at in range(0, len(heads), 2048):
        end = min(at + 2048, len(heads))
        cut, none = pa.array(offsets[at : end + 1]), pa.nulls(end - at)
        columns = [pa.array(np.full(end - at, block)), none.cast(pa.int32()), none.cast(pa.int64()), none.cast(pa.list_(pa.int64())), none.cast(pa.string()), pa.array(a[heads[at:end]]), pa.ListArray.from_arrays(cut, pa.array(b)), pa.ListArray.from_arrays(cut, pa.array(held.astype(np.int32))), pa.array(data[at:end], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, schema=_ROWS)


def _unpack(data: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    x, y = _WIDTHS[data[0] >> 2], _WIDTHS[data[0] & 3]
    return np.frombuffer(data, x, n, 1), np.frombuffer(data, y, n, 1 + n * x.itemsize)


def write_postings(docs: DataFrame, a_tokenizer: str, b_model: str, *, id: str = "doc_id", text: str = "text", block_docs: int = 8192, block_bytes: int = 16 << 20) -> DataFrame:
    """Documents and postings of a corpus, written to the shared folder and read from there.  Nothing is shuffled."""
    base = docs.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("t"))
    folder = f"{shared_root(docs.sparkSession)}/postings-{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, block, place, size = None, TaskContext.get().partitionId() << 32, 0, 0
        parts: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            aligner = aligner or Aligner(a_tokenizer, b_model)
            names = batch.column(0)
            for first, last, data, offsets in slices(batch.column(1)):
                while first < last:
                    k = min(last - first, block_docs - place)  # the rest of the run, as far as the block has room
                    part, own = data[offsets[0] : offsets[k]], offsets[: k + 1] - offsets[0]
                    total, digests, pairs, texts = aligner.align(part, own)
                    columns = [pa.array(np.full(k, block)), pa.array(np.arange(place, place + k, dtype=np.int32)), names.slice(first, k), pa.ListArray.from_arrays(pa.array(np.arange(k + 1, dtype=np.int32) * 4), pa.array(total.ravel())), pa.array(digests)]
                    yield pa.RecordBatch.from_arrays([*columns, *(pa.nulls(k, f.type) for f in list(_ROWS)[5:])], schema=_ROWS)
                    order = np.lexsort((texts, pairs))  # equal links of a document become one with its multiplicity
                    pairs, texts = pairs[order], texts[order]
                    fresh = np.flatnonzero((np.diff(pairs, prepend=-1) != 0) | (np.diff(texts, prepend=-1) != 0))
                    if len(fresh):
                        parts.append((pairs[fresh], texts[fresh] + place, np.diff(np.append(fresh, len(pairs)))))
                    place, size, first, data, offsets = place + k, size + len(part), first + k, data[offsets[k] :], offsets[k:] - offsets[k]
                    if place >= block_docs or size >= block_bytes:
                        if parts:
                            yield from _postings(block, *map(np.concatenate, zip(*parts)))
                        parts, block, place, size = [], block + 1, 0, 0
        if parts:
            yield from _postings(block, *map(np.concatenate, zip(*parts)))
        aligner = None
        give_back()

    base.mapInArrow(run, _ROWS_DDL).write.option("compression", "zstd").parquet(folder)
    return docs.sparkSession.read.parquet(folder)


def pair_counts(written: DataFrame) -> DataFrame:
    """``a``, ``b``, ``docs``: how many documents of the corpus hold each linked pair of ids."""
    held = written.filter("a is not null").select("a", F.explode(F.arrays_zip("b", "held")).alias("p"))
    return held.groupBy("a", F.col("p.b").alias("b")).agg(F.sum("p.held").alias("docs"))


class _Sums:
    """What documents of some blocks have got so far: pre-aggregation within a task, bounded by ``most`` blocks."""

    def __init__(self, docs: int, most: int = 128):
        self.docs, self.most, self.held = docs, most, {}

    def of(self, block: int) -> np.ndarray:
        got = self.held.get(block)
        if got is None:
            got = self.held[block] = np.zeros((2, self.docs), np.int64)
        return got

    def rows(self) -> pa.RecordBatch:
        blocks, data = list(self.held), []
        for got in self.held.values():
            where = np.flatnonzero(got[0])
            data.append(len(where).to_bytes(4, "little") + where.astype("<u4").tobytes() + got[:, where].astype("<i8").tobytes())
        self.held.clear()
        return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(data, pa.binary())], names=["block", "data"])


def align(docs: DataFrame, a_tokenizer: str, b_model: str, *, id: str = "doc_id", text: str = "text", block_docs: int = 8192, block_bytes: int = 16 << 20) -> DataFrame:
    """One row per input row: ``id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``, ``groups_sha256``.

    Both tokenizers see a space and the text, without special tokens (their strings are plain text).  Tokens are linked where their
    bytes overlap; a pair's count is the number of rows that hold it linked; ``n_best`` are a row's links whose count is the highest of
    their A id, ties included, and ``count_sum`` adds the counts over all links.  Groups are the stretches between places where tokens of
    both sides end.  A null or empty text, or one whose joined token bytes differ from space and text, has zeros and no digest ('').  Rows that repeat an id, and
    null ids, are documents of their own.  An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    written = write_postings(docs, a_tokenizer, b_model, id=id, text=text, block_docs=block_docs, block_bytes=block_bytes)
    posts = written.filter("a is not null")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    # an id whose postings are over a quarter of a task's mean share is dealt over several: fewer than 4 * tasks ids are
    sizes = posts.groupBy("a").agg(F.sum(F.length("data")).alias("size"))
    share = max(1, math.ceil((sizes.agg(F.sum("size")).first()[0] or 0) / (4 * tasks)))
    hot = F.broadcast(sizes.select("a", F.ceil(F.col("size") / share).cast("int").alias("parts")).filter("parts > 1"))
    counts = pair_counts(written).groupBy("a").agg(F.sort_array(F.collect_list(F.struct("b", "docs"))).alias("c"))  # as many as side B has ids
    counts = counts.join(hot, "a", "left").select("a", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"), F.lit(None).cast("bigint").alias("block"), F.col("c.b").alias("b"), F.col("c.docs").alias("docs"), F.lit(None).cast("array<int>").alias("held"), F.lit(None).cast("binary").alias("data"))
    postings = posts.join(hot, "a", "left").select("a", F.pmod(F.xxhash64("block"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"), "block", "b", F.lit(None).cast("array<bigint>").alias("docs"), "held", "data")
    stream = counts.unionByName(postings).repartition(tasks, "a", "part").sortWithinPartitions("a", "part", F.asc_nulls_first("block"))

    def cogroup(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums(block_docs)
        known, docs_of, best = np.zeros(0, np.int32), np.zeros(0, np.int64), 0
        for batch in batches:
            blocks, data = batch.column(2).to_pylist(), batch.column(6)
            b, n, held = batch.column(3), batch.column(4), batch.column(5)
            b_flat, b_at = b.flatten().to_numpy(), _offsets(b)
            n_flat, n_at = n.flatten().to_numpy(), _offsets(n)
            h_flat, h_at = held.flatten().to_numpy(), _offsets(held)
            for row, block in enumerate(blocks):
                other = b_flat[b_at[row] : b_at[row + 1]]
                if block is None:  # an id begins with its counts
                    known, docs_of = other, n_flat[n_at[row] : n_at[row + 1]]
                    best = docs_of.max()
                    continue
                each = h_flat[h_at[row] : h_at[row + 1]]
                places, many = _unpack(data[row].as_py(), int(each.sum()))
                count = docs_of[np.searchsorted(known, other)]
                got = sums.of(block)
                np.add.at(got[0], places, np.repeat(count, each) * many)
                np.add.at(got[1], places, np.repeat(count == best, each) * many)
                if len(sums.held) >= sums.most:
                    yield sums.rows()
        if sums.held:
            yield sums.rows()

    given = stream.select("a", "part", "block", "b", "docs", "held", "data").mapInArrow(cogroup, "block bigint, data binary")
    empty = {"place": "int", "doc": "bigint", "n": "array<bigint>", "digest": "string"}
    both = given.select("block", *(F.lit(None).cast(t).alias(c) for c, t in empty.items()), "data")
    both = both.unionByName(written.filter("a is null").select("block", *empty, F.lit(None).cast("binary").alias("data")))
    both = both.repartition(tasks, "block").sortWithinPartitions("block", F.asc_nulls_first("place"))
    out = T.StructType([T.StructField(id, T.LongType()), *(T.StructField(c, T.LongType()) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), T.StructField("groups_sha256", T.StringType())])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, got = None, np.zeros((2, block_docs), np.int64)
        for batch in batches:
            rows, sums = [], []
            for row, (block, place) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if block != at:
                    at = block
                    got[:] = 0
                if place is None:  # contributions come before the block's documents
                    raw = batch.column(5)[row].as_py()
                    n = int.from_bytes(raw[:4], "little")
                    got[:, np.frombuffer(raw, "<u4", n, 4)] += np.frombuffer(raw, "<i8", 2 * n, 4 + 4 * n).reshape(2, n)
                else:
                    rows.append(row)
                    sums.append((got[1, place], got[0, place]))
            if rows:
                part = batch.take(pa.array(rows))
                n, s = part.column(3).flatten().to_numpy().reshape(-1, 4), np.array(sums, np.int64)
                yield pa.RecordBatch.from_arrays([part.column(2), *(pa.array(n[:, k]) for k in range(4)), pa.array(s[:, 0]), pa.array(s[:, 1]), part.column(4)], names=out.names)

    return both.mapInArrow(summed, out)


def _offsets(column: pa.Array) -> np.ndarray:
    """Where each row's values begin in the flattened column; a null row has none."""
    return np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
