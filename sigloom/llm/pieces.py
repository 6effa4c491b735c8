"""SentencePiece encoding by forward filtering and backward sampling, and lossless decoding.

A text with one space before it is cut between two bytes that no piece of the model holds side by side
(never inside a character); no segmentation crosses such a place, so the stretches between are
independent.  Over each stretch stands the lattice of all pieces of the model; a character that
no piece covers alone goes by its bytes.  Forward filtering sums the weights of all segmentations
that reach a node; backward sampling then draws a whole segmentation from its exact distribution.
Draws come from a counter hashed with the row's key, the stretch and the step, so a key and a seed
always give the same segmentation, wherever and in whatever batch the row runs.

A byte-pair model ranks its pieces but gives no probabilities; a piece of rank r weighs
``(r + 10) ** -sharpness`` here (Zipf's law), a byte ``(pieces + 10) ** -sharpness``.

Lattices are made for the distinct stretches of a run of documents, all at once in numpy, and kept up
to a bound; a stretch is told by a 64-bit hash.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .appending import append, free_name
from .bytewords import hashes, mix, slices

_SAME = np.arange(256, dtype=np.uint8)
_SPACE = 0x20
LEARN = 4_096  # stretches whose lattices are made together


class Sampler:
    """The pieces of a model and the lattices seen so far."""

    def __init__(self, path: str, sharpness: float = 1.0, seed: int = 0, most: int = 60_000, most_edges: int = 2_000_000):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.bytes = [b""] * n
        names, ids, weights = [], [], []
        self.byte_id = np.zeros(256, np.int64)
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[i] = bytes([int(piece[3:5], 16)])
                self.byte_id[self.bytes[i][0]] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.bytes[i] = piece.replace("▁", " ").encode()
                names.append(self.bytes[i])
                ids.append(i)
                weights.append(-sharpness * np.log(10.0 - model.get_score(i)))
        if not all(model.is_byte(int(i)) for i in self.byte_id):
            raise ValueError("the model has no byte pieces, so decoding could lose text")
        self.joined = np.zeros((256, 256), bool)
        for x in names:
            self.joined[list(x[:-1]), list(x[1:])] = True
        self.joined[:, 0x80:0xC0] = True
        self.byte_weight = -sharpness * np.log(10.0 + n)
        self.longest = max(map(len, names))
        ends = np.cumsum([len(x) for x in names])
        h = hashes(np.frombuffer(b"".join(names), np.uint8), ends - [len(x) for x in names], ends, _SAME)
        order = np.argsort(h)
        self.known, self.known_id, self.known_weight = h[order], np.array(ids)[order], np.array(weights)[order]
        heads = (self.known >> np.uint64(46)).astype(np.int64)  # a table over the first 18 bits
        self.bucket = np.searchsorted(heads, np.arange(1 << 18)).astype(np.int32)
        self.depth = int(np.bincount(heads).max())
        self.length = np.array([len(x) for x in self.bytes])
        self.first_byte = np.cumsum(self.length) - self.length
        self.all_bytes = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.seed, self.most, self.most_edges = np.uint64(seed), most, most_edges  # an edge takes 16 bytes
        self._clear()

    def _clear(self) -> None:
        self.index: dict[int, int] = {}
        self.chunks, self.nodes, self.edges = 0, 0, 0
        self.size, self.base = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int64)
        self.edge_at = np.zeros(1 << 19, np.int64)
        self.edge_cum, self.edge_len, self.edge_id = np.zeros(1 << 20, np.float32), np.zeros(1 << 20, np.int32), np.zeros(1 << 20, np.int32)

    def _put(self, name: str, at: int, values: np.ndarray) -> None:
        """Write into an array that doubles when it is full."""
        held = getattr(self, name)
        while at + len(values) > len(held):
            held = np.concatenate([held, np.zeros_like(held)])
            setattr(self, name, held)
        held[at : at + len(values)] = values

    def find(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash among the known pieces, -1 for others."""
        at = self.bucket[(h >> np.uint64(46)).astype(np.int64)]
        out = np.full(len(h), -1)
        top = len(self.known) - 1
        for j in range(self.depth):
            k = np.minimum(at + j, top)
            out = np.where(self.known[k] == h, k, out)
        return out

    def learn(self, hs: list[int], text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Add the lattices of stretches of ``text``."""
        n = ends - starts
        node0 = np.cumsum(n + 1) - (n + 1)
        chunk = np.repeat(np.arange(len(n)), n)
        pos, stop = np.arange(len(text)), ends[chunk]
        begin, length, piece, weight = [], [], [], []
        single = np.zeros(len(text), bool)
        lead = (text & 0xC0) != 0x80
        wide = np.where(text < 0x80, 1, np.where(text < 0xE0, 2, np.where(text < 0xF0, 3, 4)))
        room = stop - pos
        heads = pos[lead]
        for size in range(min(self.longest, int(n.max())), 0, -1):  # long pieces first: they are the likely ones
            at = heads[room[heads] >= size]
            if not len(at):
                continue
            k = self.find(hashes(text, at, at + size, _SAME))
            at, k = at[k >= 0], k[k >= 0]
            begin.append(at)
            length.append(np.full(len(at), size))
            piece.append(self.known_id[k])
            weight.append(self.known_weight[k])
            single[at[wide[at] == size]] = True
        bare = pos[lead & ~single]
        begin.append(bare)
        length.append(wide[bare])
        piece.append(np.full(len(bare), -1))  # goes by its bytes
        weight.append(self.byte_weight * wide[bare])
        begin, length, piece, weight = map(np.concatenate, (begin, length, piece, weight))
        source = node0[chunk[begin]] + begin - starts[chunk[begin]]
        target, place = source + length, begin - starts[chunk[begin]] + length
        order = np.argsort(target, kind="stable")
        source, target, place, length, piece, weight = (v[order] for v in (source, target, place, length, piece, weight))
        alpha = np.full(int((n + 1).sum()), -np.inf)
        alpha[node0] = 0
        short = int(n.max()) < 1 << 15
        turn = np.argsort(place.astype(np.int16) if short else place, kind="stable")
        cuts = np.searchsorted(place[turn], np.arange(int(n.max()) + 2))
        for r in range(1, int(n.max()) + 1):
            own = turn[cuts[r] : cuts[r + 1]]
            if not len(own):
                continue
            value, t = alpha[source[own]] + weight[own], target[own]
            heads = np.flatnonzero(np.diff(t, prepend=-1))
            top = np.maximum.reduceat(value, heads)
            top = np.where(np.isfinite(top), top, 0)
            with np.errstate(divide="ignore"):
                alpha[t[heads]] = top + np.log(np.add.reduceat(np.exp(value - np.repeat(top, np.diff(heads, append=len(own)))), heads))
        with np.errstate(invalid="ignore"):
            p = np.exp(alpha[source] + weight - alpha[target])
        p = np.where(np.isfinite(p), p, 0)
        counts = np.bincount(target, minlength=len(alpha))
        first = np.cumsum(counts) - counts
        cum = np.cumsum(p)
        cum -= np.repeat((cum - p)[np.minimum(first, max(len(p) - 1, 0))], counts)
        cum[(first + counts - 1)[counts > 0]] = 2.0  # the last edge of a node takes what rounding leaves
        self._put("edge_cum", self.edges, cum)
        self._put("edge_len", self.edges, length)
        self._put("edge_id", self.edges, piece)
        self._put("edge_at", self.nodes, self.edges + first)
        self._put("size", self.chunks, n)
        self._put("base", self.chunks, self.nodes + node0)
        self.index.update(zip(hs, range(self.chunks, self.chunks + len(n))))
        self.chunks, self.nodes, self.edges = self.chunks + len(n), self.nodes + len(first), self.edges + len(p)

    def encode(self, data: np.ndarray, offsets: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of a run of texts and each text's number of pieces."""
        docs = len(offsets) - 1
        full = offsets[1:] > offsets[:-1]
        buf = np.insert(data, offsets[:-1][full], np.uint8(_SPACE))
        offsets = offsets + np.concatenate([[0], np.cumsum(full)])
        if not len(buf):
            return np.zeros(0, np.int64), np.zeros(docs, np.int64)
        cut = np.ones(len(buf) + 1, bool)
        cut[1:-1] = ~self.joined[buf[:-1], buf[1:]]
        cut[offsets] = True
        places = np.flatnonzero(cut)
        s, e = places[:-1], places[1:]
        at = np.searchsorted(s, offsets)
        doc = np.repeat(np.arange(docs), np.diff(at))
        with np.errstate(over="ignore"):
            h, one, inverse = np.unique(hashes(buf, s, e, _SAME), return_index=True, return_inverse=True)
            names = h.tolist()
            if len(self.index) > self.most or self.edges > self.most_edges:
                self._clear()
            new = [i for i, k in enumerate(names) if k not in self.index]
            for i in range(0, len(new), LEARN):
                own = one[new[i : i + LEARN]]
                sizes = e[own] - s[own]
                ends = np.cumsum(sizes)
                text = buf[np.repeat(s[own] - ends + sizes, sizes) + np.arange(int(ends[-1]))]
                self.learn([names[j] for j in new[i : i + LEARN]], text, ends - sizes, ends)
            index = self.index
            unit = np.fromiter((index[k] for k in names), np.int64, len(names))[inverse]
            # backward sampling of all stretches together
            cur, base = self.size[unit].astype(np.int64), self.base[unit]
            salt = mix(mix(keys.astype(np.uint64) + self.seed * np.uint64(0x9E3779B97F4A7C15))[doc] ^ mix((np.arange(len(s)) - at[:-1][doc]).astype(np.uint64) + np.uint64(1)))
            live, steps, count = np.arange(len(s)), [], np.zeros(len(s), np.int64)
            step = 0
            while len(live):
                u = (mix(salt[live] + np.uint64(step) * np.uint64(0x8EBC6AF09C88C6E3)) >> np.uint64(11)).astype(np.float64) * 2.0**-53
                edge = self.edge_at[base[live] + cur[live]]
                seek = np.flatnonzero(u >= self.edge_cum[edge])
                while len(seek):
                    edge[seek] += 1
                    seek = seek[u[seek] >= self.edge_cum[edge[seek]]]
                steps.append((live, self.edge_id[edge], cur[live]))
                cur[live] -= self.edge_len[edge]
                count[live] += 1
                live = live[cur[live] > 0]
                step += 1
        first = np.cumsum(count) - count
        flat, stop = np.empty(int(count.sum()), np.int64), np.empty(int(count.sum()), np.int64)
        for k, (own, ids, ends) in enumerate(steps):
            where = first[own] + count[own] - 1 - k
            flat[where], stop[where] = ids, ends
        per_unit = count
        bare = np.flatnonzero(flat < 0)
        if len(bare):  # characters by their bytes
            owner = np.repeat(np.arange(len(s)), count)
            final = s[owner[bare]] + stop[bare]  # where the character ends
            start = final - 1
            for _ in range(3):
                start = np.where((buf[start] & 0xC0) == 0x80, start - 1, start)
            width = np.ones(len(flat), np.int64)
            width[bare] = final - start
            at_flat = np.cumsum(width) - width
            ids = np.repeat(flat, width)
            for j in range(4):
                more = bare[width[bare] > j]
                ids[at_flat[more] + j] = self.byte_id[buf[start[width[bare] > j] + j]]
            per_unit = np.bincount(owner, weights=width, minlength=len(s)).astype(np.int64)
            flat = ids
        running = np.concatenate([[0], np.cumsum(per_unit)])
        return flat, running[at[1:]] - running[at[:-1]]

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of one sequence of ids, without the space put before it."""
        n = self.length[ids]
        ends = np.cumsum(n)
        return self.all_bytes[np.repeat(self.first_byte[ids] - ends + n, n) + np.arange(int(ends[-1]) if len(ends) else 0)].tobytes()[1:]


def _arrays(make: Callable[[], Sampler], outputs: tuple[str, ...]):
    kinds = {"ids": pa.list_(pa.int32()), "n_pieces": pa.int64(), "ids_crc32": pa.int64(), "lossless": pa.bool_()}

    def build():
        sampler = make()

        def run(keys: pa.Array, texts: pa.Array) -> pa.Array:
            named = keys.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            out = {o: [] for o in outputs}
            for first, last, data, offsets in slices(texts, 1 << 17):
                flat, n = sampler.encode(data, offsets, named[first:last])
                ends = np.cumsum(n)
                if "n_pieces" in out:
                    out["n_pieces"].append(pa.array(n))
                if "ids" in out:
                    out["ids"].append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(flat, pa.int32())))
                if "ids_crc32" in out:
                    small = flat.astype("<i4")
                    out["ids_crc32"].append(pa.array([zlib.crc32(small[a:b].tobytes()) for a, b in zip((ends - n).tolist(), ends.tolist())], pa.int64()))
                if "lossless" in out:
                    raw = data.tobytes()
                    out["lossless"].append(pa.array([sampler.decode(flat[a:b]) == raw[c:d] for a, b, c, d in zip((ends - n).tolist(), ends.tolist(), offsets[:-1].tolist(), offsets[1:].tolist())]))
            return pa.StructArray.from_arrays([pa.concat_arrays(out[o]) if out[o] else pa.array([], kinds[o]) for o in outputs], names=list(outputs))

        return run

    return build


def encode(docs: DataFrame, model: str, *, key: str = "doc_id", text: str = "text", name: str = "pieces", seed: int = 0, sharpness: float = 1.0, outputs: tuple[str, ...] = ("ids",)) -> DataFrame:
    """Every row with a struct column ``name`` of the asked outputs: ids, n_pieces, ids_crc32 (little-endian signed
    32-bit), lossless (decoding the ids gives the text back, byte for byte).

    Rows of equal key and text get equal segmentations; a null key counts as -1; null and empty texts have
    no pieces.  Texts of any length are encoded whole; all other columns stay.
    """
    kinds = {"ids": "array<int>", "n_pieces": "bigint", "ids_crc32": "bigint", "lossless": "boolean"}
    mark = free_name(docs, "_key")
    made = append(docs.withColumn(mark, F.col(key).cast("long")), [mark, text], free_name(docs, name), "struct<" + ", ".join(f"{o}: {kinds[o]}" for o in outputs) + ">", _arrays(lambda: Sampler(model, sharpness, seed), outputs))
    return made.drop(mark)


def decode(rows: DataFrame, model: str, *, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """Every row with the text of its ids; null ids give null.  Ids that no encoder made may give bytes that are no
    UTF-8; each is replaced by U+FFFD."""

    def build():
        sampler = Sampler(model)

        def run(lists: pa.ListArray) -> pa.Array:
            flat, at = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_pylist()
            missing = lists.is_null().to_pylist()
            return pa.array([None if gone else sampler.decode(flat[a:b]).decode("utf-8", "replace") for gone, a, b in zip(missing, at[:-1], at[1:])], pa.string())

        return run

    return append(rows, [ids], free_name(rows, name), "string", build)


def stored(docs: DataFrame, model: str, folder: str, *, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ("doc_id",), seed: int = 0, sharpness: float = 1.0) -> DataFrame:
    """Encode into Parquet files in ``folder`` and read them back: the columns ``keep``, ids, n_pieces, ids_crc32, lossless.

    ``lossless`` comes from the files: the stored ids are decoded and the result's SHA-256 is held against that of
    the text (of an empty one for null).
    """
    made = encode(docs, model, key=key, text=text, name="_pieces", seed=seed, sharpness=sharpness, outputs=("ids", "n_pieces", "ids_crc32"))
    digest = lambda c: F.sha2(F.coalesce(F.col(c), F.lit("")).cast("binary"), 256)
    made.select(*keep, F.col(f"{made.columns[-1]}.*"), digest(text).alias("text_sha256")).write.parquet(folder)
    back = decode(docs.sparkSession.read.parquet(folder), model, name="_decoded")
    return back.select(*keep, "ids", "n_pieces", "ids_crc32", (digest(back.columns[-1]) == F.col("text_sha256")).alias("lossless"))
