"""Language identification with a byte convolutional network, trained here in numpy.

Bytes are embedded, filters of several widths slide over fixed-length windows, each filter keeps its
maximum over the window, and a softmax gives the languages and, learned from scrambled texts, none of them.  A document is cut into windows that
cover all of it; its probabilities are the mean over its windows.

Fitting uses a bounded sample of labelled rows of every language (``rows`` documents dealt over the languages,
first by a hash of id and text, ``cuts`` stretches of each); predicting is one pass of an Arrow kernel over the documents, no shuffle.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .appending import append, free_name, give_back
from .bytewords import slices

_ASCII_LETTER = re.compile(r"[A-Za-z]")
WINDOW = 512
WIDTHS, FILTERS, DIM = (2, 3, 4), 12, 8


def has_letter(text: str) -> bool:
    """Whether a text holds a letter of any script (Unicode category L); number signs such as ``²`` or ``Ⅷ`` are none."""
    return bool(_ASCII_LETTER.search(text)) or not text.isascii() and any(map(str.isalpha, text))


@dataclass
class LanguageModel:
    """Weights: byte embedding (row 256 pads), all filters in one matrix (narrow ones end in zero rows), output layer (its last column is no language)."""

    languages: list[str]
    embedding: np.ndarray = field(repr=False)
    filters: np.ndarray = field(repr=False)
    bias: np.ndarray = field(repr=False)
    out: np.ndarray = field(repr=False)
    out_bias: np.ndarray = field(repr=False)

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Columns of the input, best place of each filter and its activation, for an array of windows of bytes."""
        b, n = windows.shape
        wide = max(WIDTHS)
        x = self.embedding[windows]
        columns = np.lib.stride_tricks.as_strided(x, (b, n - wide + 1, wide * DIM), (x.strides[0], x.strides[1], x.strides[2])).reshape(-1, wide * DIM)
        y = (columns @ self.filters).reshape(b, n - wide + 1, -1)
        best = y.argmax(1)
        return columns, best, np.maximum(np.take_along_axis(y, best[:, None], 1)[:, 0] + self.bias, 0)

    def values(self, windows: np.ndarray) -> np.ndarray:
        b, n = windows.shape
        wide = max(WIDTHS)
        x = self.embedding[windows]
        columns = np.lib.stride_tricks.as_strided(x, (b, n - wide + 1, wide * DIM), (x.strides[0], x.strides[1], x.strides[2])).reshape(-1, wide * DIM)
        top = (columns @ self.filters).reshape(b, n - wide + 1, -1).max(1)
        return softmax(np.maximum(top + self.bias, 0) @ self.out + self.out_bias)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def windows_of(data: np.ndarray, offsets: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Windows that cover every byte of every row (the last one ends with the row), and the row of each; short rows are padded."""
    length = np.diff(offsets)
    count = np.maximum(1, -(-length // size))
    row = np.repeat(np.arange(len(length)), count)
    k = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    begin = np.maximum(np.minimum(k * size, length[row] - size), 0)
    at = begin[:, None] + np.arange(size)
    inside = at < length[row][:, None]
    if not len(data):
        return np.full((len(row), size), 256, np.int16), row
    got = data[np.where(inside, at + offsets[:-1][row][:, None], 0)].astype(np.int16)
    got[~inside] = 256
    return got, row


def unlike(texts: list[str], rng: np.random.Generator) -> list[str]:
    """Stretches in no language, one for every two texts: a text's letters dealt anew over its places, drawn evenly from
    those it holds, or from a block of code points of which no text holds any."""
    seen = {ord(c) >> 7 for t in texts for c in t}
    blocks = {b: own for b in range(1, 512) if b not in seen and (own := [c for c in map(chr, range(b << 7, (b + 1) << 7)) if c.isalpha()])}
    near = np.array([1 / b for b in blocks])  # low blocks are the alphabets, high ones mostly ideographs
    out = []
    for k, t in enumerate(texts[::2]):
        letters = [c for c in t if c.isalpha()]
        if k % 3 == 0:
            drawn = rng.permutation(letters)
        elif k % 3 == 1:
            drawn = rng.choice(sorted(set(letters)), len(letters))
        else:
            drawn = rng.choice(blocks[int(rng.choice(list(blocks), p=near / near.sum()))], len(letters))
        fresh = iter(drawn)
        out.append("".join(str(next(fresh)) if c.isalpha() else c for c in t))
    return out


def fit(samples: list[tuple[str, str]], *, epochs: int = 4, batch: int = 64, least_batches: int = 200, rate: float = 4e-3, weight: float = 0.5, seed: int = 7) -> LanguageModel | None:
    """Train on (text, language) pairs by Adam; None without any pair.

    What is ``unlike`` the texts is learned beside them as no language, each stretch at ``weight`` of a real one.  Some real
    windows get a run of it and keep their language, as texts do that hold keys, addresses or numbers.
    """
    if not samples:
        return None
    languages = sorted({y for _, y in samples})
    rng = np.random.default_rng(seed)
    samples = [*samples, *((t, None) for t in unlike([t for t, _ in samples], rng))]
    parts = [windows_of(d, o) for _, _, d, o in slices(pa.array([t for t, _ in samples], pa.string()))]
    x = np.concatenate([p[0] for p in parts])
    row = np.concatenate([p[1] + sum(q[1][-1] + 1 for q in parts[:i]) for i, p in enumerate(parts)])
    y = np.array([languages.index(v) if v is not None else len(languages) for _, v in samples])[row]
    wide, f = max(WIDTHS), FILTERS * len(WIDTHS)
    mask = np.concatenate([np.repeat((np.arange(wide) < w).astype(np.float32), DIM)[:, None] * np.ones((1, FILTERS), np.float32) for w in WIDTHS], axis=1)
    normal = lambda *s: rng.standard_normal(s).astype(np.float32)
    m = LanguageModel(languages, normal(257, DIM) * 0.5, normal(wide * DIM, f) * 0.2 * mask, np.zeros(f, np.float32), normal(f, len(languages) + 1) * 0.2, np.zeros(len(languages) + 1, np.float32))
    m.embedding[256] = 0
    none = y == len(languages)
    names = ["embedding", "filters", "bias", "out", "out_bias"]
    first, second, step = {n: 0.0 for n in names}, {n: 0.0 for n in names}, 0
    batches, noise = max(1, len(x) // batch), np.flatnonzero(none)
    for _ in range(max(epochs, -(-least_batches // batches))):
        for own in np.array_split(rng.permutation(len(x)), batches):
            w = x[own].copy()
            short = rng.random(len(own)) < 0.3  # short texts are met as well
            for i in np.flatnonzero(short):
                w[i, rng.integers(48, WINDOW) if none[own[i]] else int(WINDOW ** rng.uniform(0.3, 1)) :] = 256
            for i in np.flatnonzero((rng.random(len(own)) < 0.2) & ~none[own]):
                n = rng.integers(8, WINDOW // 3)
                a = rng.integers(0, WINDOW - n)
                w[i, a : a + n] = np.where(w[i, a : a + n] == 256, 256, x[rng.choice(noise), :n])
            columns, best, top = m.pooled(w)
            p = softmax(top @ m.out + m.out_bias)
            p[np.arange(len(own)), y[own]] -= 1
            p /= len(own)
            p[none[own]] *= weight
            g = {"out": top.T @ p, "out_bias": p.sum(0)}
            d = (p @ m.out.T) * (top > 0)
            places = (best + np.arange(len(own))[:, None] * (WINDOW - wide + 1)).ravel()
            picked = columns[places].reshape(len(own), f, wide * DIM)
            g["bias"] = d.sum(0)
            g["filters"] = np.einsum("bf,bfk->kf", d, picked) * mask
            back = (d[:, :, None] * m.filters.T[None]).reshape(len(own), f, wide, DIM)
            ge = np.zeros_like(m.embedding)
            bytes_at = w[np.arange(len(own))[:, None, None], best[:, :, None] + np.arange(wide)]
            np.add.at(ge, bytes_at.ravel(), back.reshape(-1, DIM))
            ge[256] = 0
            g["embedding"] = ge
            step += 1
            for n in names:
                first[n] = 0.9 * first[n] + 0.1 * g[n]
                second[n] = 0.99 * second[n] + 0.01 * g[n] ** 2
                value = getattr(m, n)
                value -= (rate * (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    give_back()
    return m


def share_of(counts: list[int], rows: int, each: int) -> int:
    """The largest number of rows a label that draws at most ``rows`` from labels of these counts; ``each`` at least."""
    share, left = 0, rows
    for k, n in enumerate(sorted(counts)):
        share = left // (len(counts) - k)
        if share < n:
            break
        left -= n
        share = n
    return max(share, each)


def sample(docs: DataFrame, *, id: str = "doc_id", text: str = "text", label: str = "lang", rows: int = 1500, cuts: int = 3, each: int = 100) -> list[tuple[str, str]]:
    """Labelled documents with letters of any script, ``cuts`` stretches of up to a window of each, for fitting only.

    Every label is drawn from: ``rows`` documents in all, dealt evenly over the labels (rare ones give all
    they have), and up to ``each`` of a label however many labels there are.
    """
    size = F.greatest(F.length(text), F.lit(1))
    cut = [F.substr(F.col(text), (F.lit(1) + F.pmod(F.xxhash64(F.col(id), F.lit(i)), size)).cast("int"), F.lit(WINDOW)).alias(f"c{i}") for i in range(1, cuts)]
    lettered = docs.filter(F.col(label).isNotNull() & F.col(text).rlike(r"\p{L}")).withColumn("h", F.xxhash64(F.col(id), F.col(text))).withColumn("y", F.col(label).cast("string"))
    counts = lettered.groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.min("h").alias("least")).collect()  # one row per label
    if not counts:
        return []
    share = share_of([r.n for r in counts], rows, each)
    # the first hashes hold the share all but surely, and the least one in any case; what is more goes below
    tops = [(r.y, max(r.least, min(2**63 - 1, int(-(2**63) + 2**64 * (share + 6 * share**0.5 + 6) / r.n)))) for r in counts]
    near = lettered.join(F.broadcast(docs.sparkSession.createDataFrame(tops, "y string, top bigint")), "y").filter("h <= top")
    chosen = near.select("h", "y", F.substr(F.col(text), F.lit(1), F.lit(WINDOW)).alias("c0"), *cut)
    ranked = chosen.withColumn("place", F.row_number().over(Window.partitionBy("y").orderBy("h", "c0")))
    got = sorted(ranked.filter(F.col("place") <= share).drop("place").collect(), key=lambda r: (r.h, r.y, r.c0))
    return [(t, r.y) for r in got for t in r[2:] if t and has_letter(t)]


def _predict(kept):
    def make():
        model: LanguageModel | None = kept.value

        def run(texts: pa.Array) -> pa.Array:
            names, scores = [], []
            plain = texts.fill_null("") if texts.null_count else texts
            for first, last, data, offsets in slices(plain, 256 << 10):
                n = last - first
                lettered = np.array([has_letter(t) for t in plain.slice(first, n).to_pylist()])
                total = np.zeros((n, len(model.languages) + 1 if model else 2))
                if model:
                    windows, row = windows_of(data, offsets)
                    for at in range(0, len(windows), 256):
                        np.add.at(total, row[at : at + 256], model.values(windows[at : at + 256]))
                    total /= np.bincount(row, minlength=n)[:, None]
                total = total[:, :-1]  # the last one is no language
                best = total.argmax(1)
                names += [model.languages[b] if model and ok else "und" for b, ok in zip(best, lettered)]
                scores.append(np.where(lettered, np.clip(total.max(1), 0, 1), 0.0))
            return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(np.concatenate(scores) if scores else [], pa.float64())], names=["lang", "score"])

        return run

    return make


def predict(docs: DataFrame, model: LanguageModel | None, *, text: str = "text", name: str = "language") -> DataFrame:
    """Every row with a column ``name``: struct of lang and score (0 to 1).

    ``und`` with score 0 for texts that are null, empty or without a letter, and for all if no labelled
    row was there to learn from.  Whole texts count, however long; all other columns stay.
    """
    kept = docs.sparkSession.sparkContext.broadcast(model)
    return append(docs, [text], free_name(docs, name), "struct<lang: string, score: double>", _predict(kept))


def keep_identified(docs: DataFrame, model: LanguageModel | None, *, text: str = "text", least: float = 1.04) -> DataFrame:
    """The documents whose language is told with a score of at least ``least`` times that of a guess among the learned
    languages (with one learned, between it and none); texts without a letter go."""
    name = free_name(docs, "language")
    return predict(docs, model, text=text, name=name).filter((F.col(f"{name}.lang") != "und") & (F.col(f"{name}.score") >= (least / max(len(model.languages), 2) if model else 0.0))).drop(name)
