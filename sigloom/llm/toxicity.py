"""Toxicity scores from a bidirectional gated recurrent network with attention pooling, trained in numpy.

Input of a step is a word: a hashed word embedding beside the mean of its hashed character n-grams.
A word of more than ``LETTERS`` bytes (compounds, unspaced scripts) goes as several steps: parts of that
length that cover it and share enough bytes that every n-gram lies whole in one of them.
Windows of ``SPAN`` steps overlap, all windows of a text are scored, and a document's score is that of
its worst window.  Only the label of the whole document is known, so training alternates: score all
windows of the sample, take each document's highest (toxic or not) and a random one of clean ones,
and descend on those.  The first choice and the first embedding column come from the log-odds of
words and n-grams in the sample.

Fitting uses a bounded sample (``rows`` per label, texts of at most ``chars`` characters); scoring is one
pass of an Arrow kernel, no shuffle.  What depends on a word alone (embeddings and their projections
to the gates) is computed once per distinct word of a run of documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .appending import append, free_name, give_back
from .bytewords import ALNUM, FOLD, hashes, mix, slices, spans

SPAN, STRIDE = 32, 24
WORDS, GRAMS, DIM, HIDDEN = 1 << 14, 1 << 14, 4, 8
SIZES, LETTERS = (3, 4, 5), 14
CHUNK = 8192  # distinct steps handled at once


@dataclass
class ToxicityModel:
    """Weights.  Gates are update, reset, candidate; axis 0 of the recurrent ones is the direction."""

    word: np.ndarray = field(repr=False)
    gram: np.ndarray = field(repr=False)
    into: np.ndarray = field(repr=False)
    into_bias: np.ndarray = field(repr=False)
    again: np.ndarray = field(repr=False)
    look: np.ndarray = field(repr=False)
    out: np.ndarray = field(repr=False)
    out_bias: np.ndarray = field(repr=False)

    NAMES = ("word", "gram", "into", "into_bias", "again", "look", "out", "out_bias")

    def vectors(self, w: np.ndarray, g: np.ndarray, share: np.ndarray) -> np.ndarray:
        """Inputs of words: their bucket ``w``, n-gram buckets ``g`` (padded) and each n-gram's share of the mean."""
        return np.concatenate([self.word[w], np.einsum("ugd,ug->ud", self.gram[g], share)], axis=1)

    def run(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Score of windows whose steps' gate inputs are ``x`` (windows, steps, 2, 3, hidden)."""
        b, n = mask.shape
        h = np.zeros((2, n + 1, b, HIDDEN), np.float32)
        held = []
        for t in range(n):
            # both directions advance together: step t forward, step n - 1 - t backward
            xi = np.stack([x[:, t, 0], x[:, n - 1 - t, 1]])
            u = np.matmul(h[:, t], self.again[:, :, : 2 * HIDDEN])
            zr = sigmoid(xi[:, :, :2].reshape(2, b, -1) + u)
            z, r = zr[..., :HIDDEN], zr[..., HIDDEN:]
            c = np.tanh(xi[:, :, 2] + np.matmul(r * h[:, t], self.again[:, :, 2 * HIDDEN :]))
            h[:, t + 1] = h[:, t] + z * (c - h[:, t])
            if keep:
                held.append((z, r, c))
        both = np.concatenate([h[0, 1:], h[1, :0:-1]], axis=2)  # steps, windows, 2 hidden
        a = both @ self.look
        a = np.where(mask.T, a, -1e9)
        a = np.exp(a - a.max(0))
        a /= a.sum(0)
        pooled = np.einsum("nb,nbh->bh", a, both)
        score = sigmoid(pooled @ self.out + self.out_bias[0])
        return (score, h, held, both, a, pooled) if keep else score


def sigmoid(v: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * v) + 0.5


def steps(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words' parts, whether a part continues a word, and the first part of each row (one more entry: their number)."""
    s, e, at = spans(data, offsets, ALNUM)
    stride = LETTERS - max(SIZES) + 1
    count = 1 + np.maximum(0, -(-(e - s - LETTERS) // stride))
    running = np.concatenate([[0], np.cumsum(count)])
    k = np.arange(running[-1]) - np.repeat(running[:-1], count)
    s, e = np.repeat(s, count), np.repeat(e, count)
    begin = np.maximum(np.minimum(s + k * stride, e - LETTERS), s)  # the last part ends with the word
    return begin, np.minimum(begin + LETTERS, e), k > 0, running[at]


def step_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, inner: np.ndarray) -> np.ndarray:
    """Hashes of parts; one that continues a word differs from a word of the same bytes."""
    return hashes(data, starts, ends) ^ np.where(inner, np.uint64(0xA0761D6478BD642F), np.uint64(0))


def features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word bucket, n-gram buckets and shares of parts of words given by their spans (A-Z lower-cased)."""
    w = (step_hashes(data, starts, ends, inner) % np.uint64(WORDS)).astype(np.int64)
    size = ends - starts
    at = np.minimum(starts[:, None] + np.arange(LETTERS), max(len(data) - 1, 0))
    letters = np.where(np.arange(LETTERS) < size[:, None], FOLD[data[at]].astype(np.uint64) + np.uint64(2), np.uint64(0))
    letters = np.concatenate([np.where(inner, np.uint64(258), np.uint64(1))[:, None], letters], axis=1)  # 1 begins a word, 258 continues it
    buckets, held = [], []
    with np.errstate(over="ignore"):
        for n in SIZES:
            h = np.full((len(starts), LETTERS + 2 - n), n, np.uint64)
            for j in range(n):
                h = h * np.uint64(0x100000001B3) + letters[:, j : j + LETTERS + 2 - n]
            buckets.append((mix(h) % np.uint64(GRAMS)).astype(np.int64))
            held.append(np.arange(LETTERS + 2 - n) + n <= size[:, None] + 1)
    g, ok = np.concatenate(buckets, axis=1), np.concatenate(held, axis=1)
    return w, g, (ok / np.maximum(ok.sum(1, keepdims=True), 1)).astype(np.float32)


@dataclass
class Inputs:
    """What the distinct steps of a sample look up, in few bytes: word bucket, n-gram buckets, number of n-grams, length."""

    w: np.ndarray
    g: np.ndarray
    count: np.ndarray
    size: np.ndarray

    def held(self, own: np.ndarray) -> np.ndarray:
        """Which of the padded n-gram places are n-grams, as ``features`` lays them out."""
        return np.concatenate([np.arange(LETTERS + 2 - n) + n <= self.size[own][:, None].astype(np.int64) + 1 for n in SIZES], axis=1) & (self.count[own] > 0)[:, None]

    def of(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Buckets and shares, as ``features`` gives them."""
        return self.w[own].astype(np.int64), self.g[own].astype(np.int64), (self.held(own) / np.maximum(self.count[own], 1)[:, None]).astype(np.float32)

    def chunks(self) -> Iterator[np.ndarray]:
        return (np.arange(i, min(i + CHUNK, len(self.w))) for i in range(0, len(self.w), CHUNK))


def windows_of(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First steps of all overlapping windows and their rows; ``at`` are the first steps of the rows.  A row without words has none."""
    n = np.diff(at)
    count = np.where(n > 0, np.maximum(1, -(-(n - SPAN) // STRIDE) + 1), 0)
    row = np.repeat(np.arange(len(n)), count)
    k = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    return at[:-1][row] + np.maximum(np.minimum(k * STRIDE, n[row] - SPAN), 0), row


def score_texts(model: ToxicityModel, texts: pa.Array, at_once: int = 4096) -> np.ndarray:
    """Score of each text: the highest of its windows, 0 without words."""
    out = []
    for first, last, data, offsets in slices(texts, 1 << 20):
        s, e, inner, at = steps(data, offsets)
        total = np.zeros(last - first)
        if len(s):
            _, one, inverse = np.unique(step_hashes(data, s, e, inner), return_index=True, return_inverse=True)
            x = np.concatenate([model.vectors(*features(data, s[own], e[own], inner[own])) for own in np.array_split(one, -(-len(one) // CHUNK))])
            gates = (x @ model.into.reshape(2 * DIM, -1) + model.into_bias.ravel()).astype(np.float32)
            gates = np.concatenate([gates, model.into_bias.reshape(1, -1)])  # the last row pads
            begin, row = windows_of(at)
            for i in range(0, len(begin), at_once):
                place = begin[i : i + at_once, None] + np.arange(SPAN)
                mask = place < at[1:][row[i : i + at_once]][:, None]
                ids = np.where(mask, inverse[np.where(mask, place, 0)], len(gates) - 1)
                got = model.run(gates[ids].reshape(*ids.shape, 2, 3, HIDDEN), mask)
                np.maximum.at(total, row[i : i + at_once], got)
        out.append(total)
    return np.concatenate(out) if out else np.zeros(0)


def fit(samples: list[tuple[str, int]], *, rounds: int = 6, batch: int = 64, least_batches: int = 64, rate: float = 6e-3, slow: float = 1e-3, seed: int = 11) -> ToxicityModel | None:
    """Train on (text, 0 or 1) pairs by Adam; None without any pair."""
    if not samples:
        return None
    rng = np.random.default_rng(seed)
    y = np.array([v for _, v in samples], np.float32)
    at, inverse, known, held = [np.zeros(1, np.int64)], [], 0, []
    for _, _, data, offsets in slices(pa.array([t for t, _ in samples], pa.string()), 1 << 18):  # small runs bound the driver's memory
        s, e, inner, first = steps(data, offsets)
        own, one, back = np.unique(step_hashes(data, s, e, inner), return_index=True, return_inverse=True)
        for part in np.array_split(one, -(-len(one) // CHUNK)) if len(own) else []:
            w, g, share = features(data, s[part], e[part], inner[part])
            held.append((w.astype(np.uint16), g.astype(np.uint16), (share > 0).sum(1).astype(np.uint8), (e - s)[part].astype(np.uint8)))
        at.append(at[-1][-1] + first[1:])
        inverse.append((own, (back + known).astype(np.int32)))
        known += len(own)
    if not held:
        return None
    at = np.concatenate(at)
    _, one, back = np.unique(np.concatenate([own for own, _ in inverse]), return_index=True, return_inverse=True)
    inverse = back.astype(np.int32)[np.concatenate([i for _, i in inverse])]
    pick = lambda k, pad: np.concatenate([np.concatenate([h[k] for h in held])[one], pad])
    w, count, size = pick(0, np.zeros(1, np.uint16)), pick(2, np.zeros(1, np.uint8)), pick(3, np.zeros(1, np.uint8))
    g = pick(1, np.zeros((1, held[0][1].shape[1]), np.uint16))  # the last row pads
    del held, back
    pad = len(one)
    words = Inputs(w, g, count, size)
    doc = np.repeat(np.arange(len(y)), np.diff(at))

    def odds(size: int, keys_of) -> np.ndarray:
        """Smoothed log-odds of toxic against clean documents that hold a bucket, rare ones near 0; a few documents at a time."""
        hit, of = np.zeros(size), np.zeros(size)
        for low in range(0, len(y), 64):
            own = np.arange(*np.searchsorted(doc, (low, low + 64)))
            docs, keys = keys_of(np.unique(doc[own] * len(w) + inverse[own]))
            pair = np.unique(docs * size + keys)
            hit += np.bincount(pair % size, weights=y[pair // size], minlength=size)
            of += np.bincount(pair % size, minlength=size)
        n1, n0 = max(y.sum(), 1), max((1 - y).sum(), 1)
        prior = 8 / (n1 + n0)  # eight documents of the sample's own mixture
        return (np.log(hit / n1 + prior) - np.log((of - hit) / n0 + prior)).clip(-4, 4)

    of_word = odds(WORDS, lambda pair: (pair // len(w), w[pair % len(w)].astype(np.int64)))

    def grams_of(pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        some = words.held(pair % len(w))
        return np.repeat(pair // len(w), some.sum(1)), g[pair % len(w)][some].astype(np.int64)

    of_gram = odds(GRAMS, grams_of)
    normal = lambda *shape: rng.standard_normal(shape).astype(np.float32)
    m = ToxicityModel(normal(WORDS, DIM) * 0.05, normal(GRAMS, DIM) * 0.05, normal(2 * DIM, 2, 3, HIDDEN) * 0.3, np.zeros((2, 3, HIDDEN), np.float32), normal(2, HIDDEN, 3 * HIDDEN) * 0.2, normal(2 * HIDDEN) * 0.3, normal(2 * HIDDEN) * 0.3, np.zeros(1, np.float32))
    m.word[:, 0], m.gram[:, 0] = of_word * 0.5, of_gram * 0.5
    lead = np.maximum(of_word[w], 0).astype(np.float32)
    for own in words.chunks():
        lead[own] += np.where(words.held(own), of_gram[g[own]], 0).max(1).clip(0)
    lead[pad] = 0
    del doc
    begin, row = windows_of(at)
    mask = np.arange(SPAN) < (at[1:][row] - begin)[:, None]
    ids = np.full(mask.shape, pad, np.int32)
    current = np.zeros(len(row), np.float32)
    for i in range(0, len(row), 4096):
        place = begin[i : i + 4096, None] + np.arange(SPAN)
        ids[i : i + 4096] = np.where(mask[i : i + 4096], inverse[np.where(mask[i : i + 4096], place, 0)], pad)
        current[i : i + 4096] = lead[ids[i : i + 4096]].max(1)
    first, second, step = {n: 0.0 for n in m.NAMES}, {n: 0.0 for n in m.NAMES}, 0
    lines = np.searchsorted(row, np.arange(len(y) + 1))
    full = np.flatnonzero(lines[1:] > lines[:-1])
    for turn in range(rounds):
        if turn:
            current = np.zeros(len(row), np.float32)
            gates = np.concatenate([m.vectors(*words.of(own)) @ m.into.reshape(2 * DIM, -1) + m.into_bias.ravel() for own in words.chunks()], dtype=np.float32)
            for i in range(0, len(row), 4096):
                current[i : i + 4096] = m.run(gates[ids[i : i + 4096]].reshape(-1, SPAN, 2, 3, HIDDEN), mask[i : i + 4096])
        noisy = current + rng.random(len(row)) * 1e-6
        top = np.array([lines[d] + noisy[lines[d] : lines[d + 1]].argmax() for d in full])
        other = np.array([rng.integers(lines[d], lines[d + 1]) for d in full if y[d] == 0], dtype=np.int64)
        # rare toxic documents count as if there were as many as clean ones; a small sample is gone through more often
        times = np.where(y[row[top]] == 1, max(1, round(len(other) / max(1, len(top) - len(other)))), 1)
        chosen = np.concatenate([np.repeat(top, times), other])
        passes = -(-least_batches * batch // max(len(chosen), 1))
        for own in (o for _ in range(max(1, passes)) for o in np.array_split(rng.permutation(chosen), max(1, len(chosen) // batch))):
            step += 1
            grads = gradient(m, words, ids[own], mask[own], y[row[own]])
            for n in m.NAMES:
                first[n] = 0.9 * first[n] + 0.1 * grads[n]
                second[n] = 0.99 * second[n] + 0.01 * grads[n] ** 2
                value = getattr(m, n)
                value -= ((slow if n in ("word", "gram") else rate) * (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    give_back()
    return m


def gradient(m: ToxicityModel, words: Inputs, ids: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Mean cross-entropy gradient over a batch of windows, back through attention, both directions and the inputs."""
    used, back = np.unique(ids, return_inverse=True)
    back = back.reshape(ids.shape)
    w, g, share = words.of(used)
    vectors = m.vectors(w, g, share).astype(np.float32)
    x = (vectors @ m.into.reshape(2 * DIM, -1) + m.into_bias.ravel())[back].reshape(*ids.shape, 2, 3, HIDDEN).astype(np.float32)
    score, h, held, both, a, pooled = m.run(x, mask, keep=True)
    b, n = mask.shape
    d = ((score - y) / b).astype(np.float32)
    out = {"out": pooled.T @ d, "out_bias": np.array([d.sum()])}
    dp = d[:, None] * m.out
    da = np.einsum("nbh,bh->nb", both, dp)
    ds = a * (da - (a * da).sum(0))
    out["look"] = np.einsum("nb,nbh->h", ds, both)
    dboth = a[:, :, None] * dp + ds[:, :, None] * m.look
    dh_at = np.stack([dboth[:, :, :HIDDEN], dboth[::-1, :, HIDDEN:]])  # in the order of each direction's steps
    gx, gu, dh = np.zeros_like(x), np.zeros_like(m.again), np.zeros((2, b, HIDDEN), np.float32)
    for t in range(n - 1, -1, -1):
        z, r, c = held[t]
        dh = dh + dh_at[:, t]
        dc = dh * z * (1 - c * c)
        dz = dh * (c - h[:, t]) * z * (1 - z)
        drh = np.matmul(dc, m.again[:, :, 2 * HIDDEN :].transpose(0, 2, 1))
        dr = drh * h[:, t] * r * (1 - r)
        dzr = np.concatenate([dz, dr], axis=2)
        gu[:, :, : 2 * HIDDEN] += np.matmul(h[:, t].transpose(0, 2, 1), dzr)
        gu[:, :, 2 * HIDDEN :] += np.matmul((r * h[:, t]).transpose(0, 2, 1), dc)
        dh = dh * (1 - z) + drh * r + np.matmul(dzr, m.again[:, :, : 2 * HIDDEN].transpose(0, 2, 1))
        step = np.stack([dz, dr, dc], axis=2)  # direction, windows, gate, hidden
        gx[:, t, 0] = step[0]
        gx[:, n - 1 - t, 1] = step[1]
    out["again"] = gu
    flat = np.zeros((len(used), 6 * HIDDEN), np.float32)
    np.add.at(flat, back.ravel(), gx.reshape(-1, 6 * HIDDEN))
    out["into"] = (vectors.T @ flat).reshape(m.into.shape)
    out["into_bias"] = flat.sum(0).reshape(m.into_bias.shape)
    dv = flat @ m.into.reshape(2 * DIM, -1).T
    out["word"], out["gram"] = np.zeros_like(m.word), np.zeros_like(m.gram)
    np.add.at(out["word"], w, dv[:, :DIM])
    np.add.at(out["gram"], g.ravel(), (share[:, :, None] * dv[:, None, DIM:]).reshape(-1, DIM))
    return out


def sample(docs: DataFrame, labels: DataFrame, *, id: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = 1500, chars: int = 20_000) -> list[tuple[str, int]]:
    """At most ``rows`` documents of each label with texts of at most ``chars`` characters, for fitting only."""
    known = labels.filter(F.col(label).isin(0, 1) & F.col(id).isNotNull()).select(F.col(id).alias("i"), F.col(label).cast("int").alias("y")).groupBy("i").agg(F.max("y").alias("y"))
    pick = [r for y in (0, 1) for r in known.filter(F.col("y") == y).orderBy(F.xxhash64("i"), "i").limit(rows).collect()]
    if not pick:
        return []
    chosen = docs.sparkSession.createDataFrame([(r.i, r.y) for r in pick], "i bigint, y int")  # at most 2 * rows
    got = docs.filter(F.length(text) <= chars).select(F.col(id).cast("long").alias("i"), F.col(text).alias("t")).join(F.broadcast(chosen), "i").orderBy(F.xxhash64("i"), "i", "t").limit(2 * rows).collect()
    return [(r.t, r.y) for r in got]


def _scores(kept):
    def make():
        model: ToxicityModel | None = kept.value
        return lambda texts: pa.array(score_texts(model, texts) if model else np.zeros(len(texts)), pa.float64())

    return make


def score(docs: DataFrame, model: ToxicityModel | None, *, text: str = "text", name: str = "toxicity") -> DataFrame:
    """Every row with a column ``name`` from 0 to 1.

    Texts that are null, empty or without words score 0, and so do all if there was nothing to learn
    from.  Every window of a text counts, however long it is; all other columns stay.
    """
    kept = docs.sparkSession.sparkContext.broadcast(model)
    return append(docs, [text], free_name(docs, name), "double", _scores(kept))


def keep_clean(docs: DataFrame, model: ToxicityModel | None, *, text: str = "text", least: float = 0.5) -> DataFrame:
    """The documents that score below ``least``."""
    name = free_name(docs, "toxicity")
    return score(docs, model, text=text, name=name).filter(F.col(name) < least).drop(name)
