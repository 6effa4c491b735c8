"""Token ids in binary shards: a concatenated id array with Elias-Fano coded document boundaries.

Documents are dealt by ranges of their id and sorted, so shard k holds the k-th stretch of the corpus.
A shard file is: the ids (16 bits each where the vocabulary fits, else 32) | Elias-Fano of the document
starts | Elias-Fano of the document ids | JSON footer | its length.  Select finds the i-th start from
a sampled table of 32-bit positions and a short scan, at about 2 + log2(u/n) bits per document.

Tasks write their file whole under a name of their own and return one index row; a retried task writes
another file, and only files named in the (checkpointed) index are read.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytewords import NONSPACE, hashes, slices, spans
from .common import cut, shared_root

_SAME = np.arange(256, dtype=np.uint8)
#: Words that the tokenizer's rules keep whole and that normalising only lower-cases, letter by letter.
_PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")
_ALNUM_ASCII = np.array([chr(b).isalnum() and b < 128 for b in range(256)])


class EliasFano:
    """A non-decreasing sequence of non-negative integers in near-minimal space."""

    SAMPLE = 256

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.bits, self.low, self.high, self.samples = n, bits, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values).astype(np.uint64)  # up to 2**64 - 1
        n = len(v)
        top = int(v[-1]) + 1 if n else 1
        bits = max(0, (top // max(n, 1)).bit_length() - 1)
        steps = np.arange(bits, dtype=np.uint64)
        low = [np.packbits(((v[i : i + 8192, None] >> steps) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little") for i in range(0, n, 8192)] if bits else []  # runs end at whole bytes
        low = np.concatenate(low) if low else np.zeros(0, np.uint8)
        ones = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        high[ones] = 1
        return cls(n, bits, low, np.packbits(high, bitorder="little"), ones[:: cls.SAMPLE].astype(np.uint32))

    def to_bytes(self) -> tuple[bytes, dict]:
        parts = [self.low.tobytes(), self.high.tobytes(), self.samples.astype("<u4").tobytes()]
        return b"".join(parts), {"n": self.n, "bits": self.bits, "sizes": [len(p) for p in parts]}

    @classmethod
    def from_bytes(cls, raw: bytes, head: dict) -> EliasFano:
        a, b, c = head["sizes"]
        return cls(head["n"], head["bits"], np.frombuffer(raw, np.uint8, a), np.frombuffer(raw, np.uint8, b, a), np.frombuffer(raw, "<u4", c // 4, a + b))

    def _low(self, first: int, last: int) -> np.ndarray:
        if not self.bits:
            return np.zeros(last - first, np.uint64)
        begin, end = first * self.bits, last * self.bits
        bits = np.unpackbits(self.low[begin // 8 : (end + 7) // 8], bitorder="little")[begin % 8 : begin % 8 + end - begin]
        return bits.reshape(-1, self.bits).astype(np.uint64) @ (np.uint64(1) << np.arange(self.bits, dtype=np.uint64))

    def select(self, i: int) -> int:
        """The i-th value, from the nearest sample before it."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // self.SAMPLE]), i % self.SAMPLE
        byte = at // 8
        bits = np.unpackbits(self.high[byte : byte + 64], bitorder="little")
        bits[: at % 8] = 0
        while True:
            ones = np.flatnonzero(bits)
            if len(ones) > left:
                place = byte * 8 + int(ones[left])
                return ((place - i) << self.bits) + int(self._low(i, i + 1)[0])
            left -= len(ones)
            byte += 64
            bits = np.unpackbits(self.high[byte : byte + 64], bitorder="little")

    def between(self, first: int, last: int) -> np.ndarray:
        """The values from ``first`` to ``last`` (excluded), unsigned: two samples bound the bits that are read."""
        if first >= last:
            return np.zeros(0, np.uint64)
        begin = int(self.samples[first // self.SAMPLE]) // 8
        after = -(-last // self.SAMPLE)
        stop = int(self.samples[after]) // 8 + 1 if after < len(self.samples) else len(self.high)
        ones = np.flatnonzero(np.unpackbits(self.high[begin:stop], bitorder="little")) + begin * 8
        skip = int(np.searchsorted(ones, self.samples[first // self.SAMPLE])) + first % self.SAMPLE
        own = ones[skip : skip + last - first]
        return ((own - np.arange(first, last)).astype(np.uint64) << np.uint64(self.bits)) + self._low(first, last)


class ChunkEncoder:
    """Whole texts to ids: the library encodes each distinct stretch between ASCII white space once.

    The tokenizer's own rules never join text across white space, so the ids of a text are those of its
    stretches in order.  A comma or full stop that ends a stretch after an ASCII letter or digit is a
    stretch of its own, as the rules part them there too.  Stretches are told by 64-bit hashes, which stand
    in an open table of arrays.
    """

    _held: dict[tuple, ChunkEncoder] = {}

    @classmethod
    def of(cls, path: str, job: str) -> ChunkEncoder:
        """The encoder of this process for one job: what a task has learned serves the next ones of its worker, but no other job."""
        if (path, job) not in cls._held:
            cls._held.clear()  # one at a time
            cls._held[path, job] = cls(path)
        return cls._held[path, job]

    def __init__(self, path: str, most: int = 1_500_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self._clear()
        # The library's model behind a plain split at white space, for many plain words in one call; used only
        # where every word ends with a piece that says so, and where it agrees with the whole tokenizer.
        spec = json.loads(self.tokenizer.to_str())
        self.word_end, suffix = np.zeros(self.tokenizer.get_vocab_size(), bool), spec["model"].get("end_of_word_suffix")
        if suffix:
            for piece, i in self.tokenizer.get_vocab().items():
                self.word_end[i] = piece.endswith(suffix)
        spec["normalizer"], spec["pre_tokenizer"] = None, {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
        self.words = Tokenizer.from_str(json.dumps(spec)) if suffix else None
        ids = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        whole = "The  quick,\tgröße's\n\n(x.y). don't 12,5 \U0001f600!  "
        if ids(whole) != [i for t in re.findall(r"[^ \t-\r]+", whole) for i in ids(t)] or ids("ab,") + ids("c.") != [i for t in ("ab", ",", "c", ".") for i in ids(t)]:
            raise ValueError("this tokenizer joins text across white space, so texts cannot be cut there")
        probe = ["The", "größe", "naïveté", "onerthst"]
        if self.words and any(self.words.encode(w.lower(), add_special_tokens=False).ids != self.tokenizer.encode(w, add_special_tokens=False).ids for w in probe):
            self.words = None

    def _clear(self) -> None:
        self.keys, self.place, self.known = np.zeros(1 << 18, np.uint64), np.zeros(1 << 18, np.int32), 0  # 0 is never a hash
        self.ids, self.used = np.zeros(1 << 20, np.uint16 if self.small else np.uint32), 0
        self.start, self.count = np.zeros(1 << 18, np.int64), np.zeros(1 << 18, np.int32)

    @property
    def small(self) -> bool:
        return self.tokenizer.get_vocab_size() <= 1 << 16

    def _find(self, hs: np.ndarray) -> np.ndarray:
        """The number of each stretch, -1 if it is not known."""
        found, todo, mask = np.full(len(hs), -1, np.int32), np.arange(len(hs)), np.uint64(len(self.keys) - 1)
        at = (hs & mask).astype(np.int64)
        while len(todo):
            own = self.keys[at]
            hit = own == hs[todo]
            found[todo[hit]] = self.place[at[hit]]
            on = ~hit & (own != 0)
            todo, at = todo[on], (at[on] + 1) & int(mask)
        return found

    def _put(self, hs: np.ndarray, places: np.ndarray) -> None:
        """Distinct new hashes go to the first free places from their own on; the table is at most half full."""
        if 2 * (self.known + len(hs)) > len(self.keys):
            used = np.flatnonzero(self.keys)
            hs, places = np.concatenate([self.keys[used], hs]), np.concatenate([self.place[used], places.astype(np.int32)])
            size = 1 << (4 * len(hs) - 1).bit_length()
            self.keys, self.place, self.known = np.zeros(size, np.uint64), np.zeros(size, np.int32), 0
        self.known += len(hs)
        at = (hs & np.uint64(len(self.keys) - 1)).astype(np.int64)
        while len(hs):
            free = self.keys[at] == 0
            self.keys[at[free]] = hs[free]
            mine = self.keys[at] == hs
            self.place[at[mine]] = places[mine]
            hs, places, at = hs[~mine], places[~mine], (at[~mine] + 1) & (len(self.keys) - 1)

    def _learn(self, hs: np.ndarray, texts: list[str]) -> None:
        left = np.ones(len(texts), bool)
        plain = [i for i, t in enumerate(texts) if _PLAIN.fullmatch(t)] if self.words else []
        for at in range(0, len(plain), 256):
            own = np.array(plain[at : at + 256])
            got = np.array(self.words.encode_batch_fast([" ".join(texts[i].lower() for i in own)], add_special_tokens=False)[0].ids)
            ends = np.flatnonzero(self.word_end[got]) + 1
            if len(ends) == len(own) and ends[-1] == len(got):
                self._keep(hs[own], got, np.diff(ends, prepend=0))
                left[own] = False
        rest = np.flatnonzero(left)
        for at in range(0, len(rest), 4096):
            own = rest[at : at + 4096]
            lists = [e.ids for e in self.tokenizer.encode_batch_fast([texts[i] for i in own], add_special_tokens=False)]
            self._keep(hs[own], np.array([x for ids in lists for x in ids], dtype=np.int64), np.array([len(ids) for ids in lists]))

    def _keep(self, hs: np.ndarray, flat: np.ndarray, counts: np.ndarray) -> None:
        k, n = self.known, len(hs)
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while k + n > len(self.start):
            self.start, self.count = np.concatenate([self.start, np.zeros_like(self.start)]), np.concatenate([self.count, np.zeros_like(self.count)])
        self.ids[self.used : self.used + len(flat)] = flat
        self.start[k : k + n], self.count[k : k + n] = self.used + np.cumsum(counts) - counts, counts
        self._put(hs, np.arange(k, k + n))
        self.used += len(flat)

    def encode(self, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a run of documents, ``end_id`` after each, and each document's number of ids."""
        s, e, at = spans(data, offsets, NONSPACE)
        if len(s):
            last, before = data[e - 1], data[np.maximum(e - 2, 0)]
            part = np.flatnonzero(((last == 0x2C) | (last == 0x2E)) & (e - 2 >= s) & _ALNUM_ASCII[before])
            order = np.argsort(np.concatenate([s, e[part] - 1]), kind="stable")
            bodies = e.copy()
            bodies[part] -= 1
            s, e = np.concatenate([s, e[part] - 1])[order], np.concatenate([bodies, e[part]])[order]
            at = np.searchsorted(s, offsets)
        h = hashes(data, s, e, _SAME)
        if self.known > self.most:
            self._clear()
        known = self._find(h)
        new = np.flatnonzero(known < 0)
        if len(new):
            distinct, first = np.unique(h[new], return_index=True)
            raw = data.tobytes()
            self._learn(distinct, [raw[s[j] : e[j]].decode() for j in new[first].tolist()])
            known[new] = self._find(h[new])
        count, begin = self.count[known].astype(np.int64), self.start[known]
        running = np.concatenate([[0], np.cumsum(count)])
        per_doc = running[at[1:]] - running[at[:-1]] + 1
        total = int(running[-1])
        flat = self.ids[np.repeat(begin - running[:-1], count) + np.arange(total)]
        return np.insert(flat, running[at[1:]], end_id), per_doc


def write_shards(docs: DataFrame, tokenizer: str, *, id: str = "doc_id", text: str = "text", end_id: int = 2) -> DataFrame:
    """Encode, append ``end_id`` to each document, write; one index row per shard: shard, path, n_docs, n_ids.

    Ids ascend over the shards (nulls first), equal ids by text; a null text is empty and has the end id
    alone; an empty table writes nothing.
    """
    folder = f"{shared_root(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    base = docs.select(F.col(id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    dealt = base.repartitionByRange(F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), "t")
    kind = pa.schema([("shard", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, out = None, None
        counts, ids, written, none = [], [], 0, 0
        shard = TaskContext.get().partitionId()
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                encoder = ChunkEncoder.of(tokenizer, folder)
                fs, root = pafs.FileSystem.from_uri(folder)
                fs.create_dir(root, recursive=True)
                path = f"{root}/shard-{shard:06d}-{uuid.uuid4().hex}.ids"
                out = fs.open_output_stream(path, compression=None)
                width = "<u2" if encoder.small and end_id < 1 << 16 else "<u4"
            none += batch.column(0).null_count
            ids.append(batch.column(0).drop_null().to_numpy())
            for _, _, data, offsets in slices(batch.column(1)):
                flat, per_doc = encoder.encode(data, offsets, end_id)
                out.write(flat.astype(width).tobytes())
                counts.append(per_doc)
                written += len(flat)
        if out is None:
            return
        per_doc, doc_ids = np.concatenate(counts), np.concatenate(ids)
        least = int(doc_ids[0]) if len(doc_ids) else 0
        starts, starts_head = EliasFano.encode(np.cumsum(per_doc) - per_doc).to_bytes()
        names, names_head = EliasFano.encode(doc_ids.astype(np.uint64) - np.uint64(least % (1 << 64))).to_bytes()
        footer = json.dumps({"width": width, "n_ids": written, "n_docs": len(per_doc), "nulls": none, "least": least, "starts": starts_head, "ids": names_head}).encode()
        out.write(starts + names + footer + len(footer).to_bytes(4, "little"))
        out.close()
        yield pa.RecordBatch.from_pylist([{"shard": shard, "path": f"{folder}/{path.rsplit('/', 1)[1]}", "n_docs": len(per_doc), "n_ids": written}], schema=kind)

    return cut(dealt.mapInArrow(run, "shard bigint, path string, n_docs bigint, n_ids bigint"))


class Shard:
    """One shard file, opened for random access."""

    def __init__(self, uri: str):
        fs, path = pafs.FileSystem.from_uri(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        length = int.from_bytes(self.file.read_at(4, size - 4), "little")
        self.head = json.loads(self.file.read_at(length, size - 4 - length))
        self.width = np.dtype(self.head["width"])
        at = self.head["n_ids"] * self.width.itemsize
        first, second = sum(self.head["starts"]["sizes"]), sum(self.head["ids"]["sizes"])
        self.starts = EliasFano.from_bytes(self.file.read_at(first, at), self.head["starts"])
        self.names = EliasFano.from_bytes(self.file.read_at(second, at + first), self.head["ids"])

    def ids(self, first: int, last: int) -> np.ndarray:
        return np.frombuffer(self.file.read_at((last - first) * self.width.itemsize, first * self.width.itemsize), self.width)

    def document(self, i: int) -> np.ndarray:
        """Ids of the i-th document by two selects."""
        return self.ids(self.starts.select(i), self.starts.select(i + 1) if i + 1 < self.starts.n else self.head["n_ids"])

    def _named(self, first: int, last: int) -> list[int]:
        return (self.names.between(first, last) + np.uint64(self.head["least"] % (1 << 64))).view(np.int64).tolist()  # distances may span all 64 bits

    def doc_ids(self, first: int = 0, last: int | None = None) -> list[int | None]:
        """Ids of documents by their place in the shard; null ids stand first."""
        nulls, last = self.head["nulls"], self.starts.n if last is None else last
        return [None] * max(0, min(nulls, last) - first) + self._named(max(first - nulls, 0), max(last - nulls, 0))


def read_shards(index: DataFrame, at_once: int = 4 << 20, docs_at_once: int = 8192) -> DataFrame:
    """One row per document from the files: doc_id, start (over the corpus), n_tokens, ids_crc32."""
    placed = index.withColumn("base", F.coalesce(F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row per shard

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row["path"])
                n = shard.starts.n
                for first in range(0, n, docs_at_once):  # offsets of a run of documents, then their ids in reads of bounded size
                    last = min(first + docs_at_once, n)
                    starts = np.append(shard.starts.between(first, last).view(np.int64), shard.starts.select(last) if last < n else row["n_ids"])
                    names = shard.doc_ids(first, last)
                    i = 0
                    while i < last - first:
                        j = max(i + 1, int(np.searchsorted(starts, starts[i] + at_once, "right")) - 1)
                        block = shard.ids(int(starts[i]), int(starts[j])).astype("<u4")
                        cuts = (starts[i : j + 1] - starts[i]).tolist()
                        crc = [zlib.crc32(block[a:b].tobytes()) for a, b in zip(cuts, cuts[1:])]
                        yield pa.RecordBatch.from_arrays([pa.array(names[i:j], pa.int64()), pa.array(starts[i:j] + row["base"]), pa.array(np.diff(starts[i : j + 1])), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                        i = j

    return placed.select("path", "n_ids", "base").repartition(max(1, index.count()), "path").mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
