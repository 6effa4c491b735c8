"""Words and their 64-bit hashes straight from UTF-8 bytes, vectorised with numpy.

Every code point beyond ASCII has only bytes >= 0x80, so classes of ASCII characters can be told
byte by byte.  A word's hash is a polynomial over a random table of its bytes, taken from running
sums, then mixed; equal words have equal hashes in every process, and 0 is never a word's hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_MULT = 0x9E3779B97F4A7C15 | 1
_INV = pow(_MULT, -1, 1 << 64)
_RNG = np.random.default_rng(20240229)
_TABLE = _RNG.integers(1, 1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: dict[str, np.ndarray] = {}
KEPT = 1 << 22

#: Bytes of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` once A-Z are lower-cased.
ALNUM = np.array([0x30 <= b <= 0x39 or 0x61 <= (b | 0x20) <= 0x7A and b < 0x80 or b >= 0x80 for b in range(256)])
#: Bytes of words `[^\x20\x09-\x0D]+`.
NONSPACE = np.array([not (b == 0x20 or 0x09 <= b <= 0x0D) for b in range(256)])
#: A-Z to a-z.
FOLD = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, over an array of unsigned 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power(kind: str, n: int) -> np.ndarray:
    held = _POWERS.get(kind)
    if held is None or len(held) < n:
        size = max(1 << 20, 1 << (n - 1).bit_length())
        steps = np.full(size, _MULT if kind == "up" else _INV, dtype=np.uint64)
        steps[0] = 1
        held = np.multiply.accumulate(steps)
        if size <= KEPT:  # tables of very long texts are not held on to
            _POWERS[kind] = held
    return held[:n]


def slices(column: pa.Array, most_bytes: int = 2 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into runs of whole rows of about ``most_bytes``: first row, last row + 1, bytes, row offsets.

    A row longer than that makes a run of its own; nulls are empty.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if n == 0:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=n + 1, offset=8 * column.offset)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most_bytes, side="right")) - 1)
        last = min(last, n)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def spans(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the first word of each row (one more entry: the number of words)."""
    inside = kind[data]
    before = np.empty_like(inside)
    before[1:] = inside[:-1]
    after = np.empty_like(inside)
    after[:-1] = inside[1:]
    full = offsets[:-1][offsets[1:] > offsets[:-1]]
    before[full] = False
    after[offsets[1:][offsets[1:] > offsets[:-1]] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray = FOLD) -> np.ndarray:
    """A non-zero 64-bit hash for each word."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_TABLE[fold][data] * _power("up", len(data)), out=sums[1:])
        h = (sums[ends] - sums[starts]) * _power("down", len(data))[starts]
        h = mix(h ^ ((ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
    h[h == 0] = 1
    return h
