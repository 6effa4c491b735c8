"""Benchmark decontamination with suffix arrays over the training texts.

Each run of documents (about 2 MB of text) is a shard.  Its words become 64-bit hashes with a 0 after every document.
All its suffixes are sorted by prefix doubling over ranks until their order reaches the longest window (``suffix_array``).
Every suffix of every benchmark item that begins a window is binary-searched in that array, word by word, and equal windows
of several items are searched once; so a place of a document meets one window of each length, however many items share it.
From each place that no match before it reaches the match is extended to its longest.  Nothing is sampled or capped, and no row is shuffled.

The benchmark is the query set.  Its windows are sorted once and reach the tasks in blocks of at most ``block_bytes`` of text:
one block where it fits, otherwise the documents pass through one kernel per block within one scan.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .appending import append, free_name
from .bytewords import ALNUM, hashes, slices, spans

MATCH = "struct<item: bigint, item_word: int, doc_word: int, length: int>"
FOUND = f"struct<n_words: bigint, n_hit: bigint, items: array<bigint>, matches: array<{MATCH}>>"
_KIND = pa.struct([("item", pa.int64()), ("item_word", pa.int32()), ("doc_word", pa.int32()), ("length", pa.int32())])


class Items:
    """Distinct windows of one block of benchmark items: where each first stands, its length, and the items that hold it."""

    def __init__(self, ids: list[int | None], texts: list[str], window: int):
        parts, self.ids, start, need, owner, at, row = [np.zeros(1, np.uint64)], list(ids), [], [], [], 1, 0
        self.first = np.zeros(len(ids), np.int64)
        for first, last, data, offsets in slices(pa.array(texts, pa.string())):
            s, e, rows = spans(data, offsets, ALNUM)
            h = hashes(data, s, e)
            for i in range(last - first):
                own = h[rows[i] : rows[i + 1]]
                n, w = len(own), min(window, len(own))
                self.first[row + i] = at
                if n:
                    start.append(np.arange(at, at + n - w + 1))
                    need.append(np.full(n - w + 1, w))
                    owner.append(np.full(n - w + 1, row + i))
                parts += [own, np.zeros(1, np.uint64)]
                at += n + 1
            row += last - first
        pick = lambda x: np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64)
        start, need, owner = pick(start), pick(need), pick(owner)
        self.words = np.concatenate([*parts, np.zeros(window, np.uint64)])
        # equal windows stand next to one another in the order of the items' suffixes
        window_at = np.full(len(self.words), -1, np.int64)
        window_at[start] = np.arange(len(start))
        turn = window_at[suffix_array(self.words, window + 1)]
        turn = turn[turn >= 0]
        same = need[turn[1:]] == need[turn[:-1]]
        for d in range(window):
            same &= (need[turn[1:]] <= d) | (self.words[start[turn[1:]] + d] == self.words[start[turn[:-1]] + d])
        fresh = np.flatnonzero(np.append(True, ~same)) if len(turn) else turn
        one = np.minimum.reduceat(turn, fresh) if len(turn) else turn  # the first that holds it
        self.start, self.need, self.owner = start[one], need[one].astype(np.int32), owner[one].astype(np.int32)
        group = np.repeat(np.arange(len(one)), np.diff(np.append(fresh, len(turn))))
        order = np.lexsort((owner[turn], group))
        self.holders, self.held_at = owner[turn][order].astype(np.int32), np.append(fresh, len(turn))


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Places of all suffixes in the order of their first words, at least ``depth`` of them (prefix doubling over ranks).

    Each round sorts only the suffixes that the rounds before could not tell apart.
    """
    n = len(text)
    order = np.argsort(text, kind="stable")
    new = np.concatenate([[True], text[order[1:]] != text[order[:-1]]]) if n else np.zeros(0, bool)
    lead = np.maximum.accumulate(np.where(new, np.arange(n), 0))  # a rank is the place of the first equal suffix
    rank = np.empty(n + 1, np.int64)
    rank[order], rank[n] = lead, -1
    reach = 1
    while reach < depth:
        tied = np.flatnonzero(~new | np.append(~new[1:], False))  # places in the order that share their rank with a neighbour
        if not len(tied):
            break
        own = order[tied]
        then = rank[np.minimum(own + reach, n)]
        turn = np.lexsort((then, lead[tied]))
        own, then = own[turn], then[turn]
        order[tied] = own
        same = np.concatenate([[False], (lead[tied][1:] == lead[tied][:-1]) & (then[1:] == then[:-1])])
        new[tied] = ~same
        lead = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank[order] = lead
        reach *= 2
    return order


def search(text: np.ndarray, order: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray]:
    """First and last (excluded) place in the suffix order of each distinct window."""

    def bound(upper: bool) -> np.ndarray:
        low, high = np.zeros(len(items.start), np.int64), np.full(len(items.start), len(order))
        live = np.arange(len(low))
        while len(live):
            middle = (low[live] + high[live]) // 2
            place = order[middle]
            after = np.full(len(live), upper)  # an equal window goes on to the right for the upper bound
            open_, d = np.arange(len(live)), 0
            while len(open_):
                k = live[open_]
                at = place[open_] + d
                word, wanted = np.where(at < len(text), text[np.minimum(at, len(text) - 1)], np.uint64(0)), items.words[items.start[k] + d]
                differs = word != wanted
                after[open_[differs]] = word[differs] < wanted[differs]
                d += 1
                open_ = open_[~differs & (d < items.need[k])]
            low[live], high[live] = np.where(after, middle + 1, low[live]), np.where(after, high[live], middle)
            live = live[low[live] < high[live]]
        return low

    return bound(False), bound(True)


def longest(text: np.ndarray, items: Items, place: np.ndarray, start: np.ndarray) -> np.ndarray:
    """How many words from each place equal those from each start, up to the end of the document and the item."""
    length, going, d = np.zeros(len(place), np.int64), np.arange(len(place)), 0
    while len(going):
        a, b = start[going] + d, place[going] + d
        word = items.words[np.minimum(a, len(items.words) - 1)]
        going = going[(word != 0) & (b < len(text)) & (text[np.minimum(b, len(text) - 1)] == word)]
        length[going] += 1
        d += 1
    return length


def matches(text: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All places where a window stands with the window's number, and those of them that the match before does not reach."""
    order = suffix_array(text, int(items.need.max()))
    low, high = search(text, order, items)
    count = high - low
    window = np.repeat(np.arange(len(count)), count)
    place = order[np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())]
    turn = np.lexsort((items.need[window], place))
    place, window = place[turn], window[turn]
    # a place is reached by the match before it if the item of that match goes on
    widest = np.append(place[1:] != place[:-1], True) if len(place) else np.zeros(0, bool)
    p, w = place[widest], window[widest]
    reached = np.zeros(len(p), bool)
    if len(p) > 1:
        ahead = p[:-1] + items.need[w[:-1]]
        goes = (items.words[items.start[w[:-1]] + items.need[w[:-1]]] == np.where(ahead < len(text), text[np.minimum(ahead, len(text) - 1)], np.uint64(0))) & (items.words[items.start[w[:-1]] + items.need[w[:-1]]] != 0)
        reached[1:] = (p[1:] == p[:-1] + 1) & goes & (items.need[w[1:]] <= items.need[w[:-1]])
    return place, window, p[~reached], w[~reached]


def _kernel(items: Items):
    ids = pa.array(items.ids, pa.int64())

    def run(texts: pa.Array, before: pa.Array | None = None) -> pa.Array:
        out = []
        for first, last, data, offsets in slices(texts):
            s, e, at = spans(data, offsets, ALNUM)
            h = hashes(data, s, e)
            count, docs = np.diff(at), last - first
            text = np.insert(h, at[1:], np.uint64(0))
            begin = at[:-1] + np.arange(docs)
            none = np.zeros(0, np.int64)
            place, window, p, w = matches(text, items) if len(h) and len(items.start) else (none, none, none, none)
            doc_of = lambda x: np.searchsorted(begin, x, "right") - 1  # noqa: E731, B023
            # items of each document: distinct windows first, then all that hold them
            pair = np.unique(doc_of(place) * max(len(items.start), 1) + window)
            doc, own = pair // max(len(items.start), 1), pair % max(len(items.start), 1)
            held = items.held_at[own + 1] - items.held_at[own]
            holder = items.holders[np.repeat(items.held_at[own] - np.cumsum(held) + held, held) + np.arange(held.sum())]
            found = np.unique(np.repeat(doc, held) * max(len(items.ids), 1) + holder)
            doc, holder = found // max(len(items.ids), 1), found % max(len(items.ids), 1)
            item_lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(docs + 1)), pa.int32()), ids.take(pa.array(holder)))
            length = longest(text, items, p, items.start[w])
            doc = doc_of(p)
            rows = pa.StructArray.from_arrays([ids.take(pa.array(items.owner[w])), pa.array(items.start[w] - items.first[items.owner[w]], pa.int32()), pa.array(p - begin[doc], pa.int32()), pa.array(length, pa.int32())], fields=list(_KIND))
            match_lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(docs + 1)), pa.int32()), rows)
            marks = np.zeros(len(text) + 1, np.int64)
            np.add.at(marks, place, 1)
            np.add.at(marks, place + items.need[window], -1)
            if before is not None:  # what earlier blocks found
                old = before.slice(first, docs)
                item_lists, match_lists = joined(old.field("items"), item_lists), joined(old.field("matches"), match_lists)
                flat, owner = match_lists.flatten(), np.repeat(np.arange(docs), match_lists.value_lengths().to_numpy(zero_copy_only=False))
                a = begin[owner] + flat.field("doc_word").to_numpy()
                np.add.at(marks, a, 1)
                np.add.at(marks, a + flat.field("length").to_numpy(), -1)
            inside = np.concatenate([[0], np.cumsum(np.cumsum(marks[:-1]) > 0)])
            hit = inside[begin + count] - inside[begin]
            out.append(pa.StructArray.from_arrays([pa.array(count, pa.int64()), pa.array(hit, pa.int64()), item_lists, match_lists], names=["n_words", "n_hit", "items", "matches"]))
        return pa.concat_arrays(out) if out else pa.array([], pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.int64())), ("matches", pa.list_(_KIND))]))

    return run


def joined(x: pa.ListArray, y: pa.ListArray) -> pa.ListArray:
    """Lists of two columns behind one another, row by row."""
    a, b = (v.value_lengths().to_numpy(zero_copy_only=False) for v in (x, y))
    both = pa.concat_arrays([x.flatten().cast(y.type.value_type), y.flatten()])
    owner = np.concatenate([np.repeat(np.arange(len(a)), a), np.repeat(np.arange(len(b)), b)])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(a + b)]), pa.int32()), both.take(pa.array(np.argsort(owner, kind="stable"))))


def find_matches(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, block_bytes: int = 8 << 20, name: str = "found") -> DataFrame:
    """Every document with a column ``name``: n_words, n_hit (words inside a window), items (ids of all items with a window
    there; items with equal ids once each) and matches.

    A window is ``window`` consecutive words of an item, the whole item if it has fewer; A-Z are lower-cased.
    ``matches`` cover all hit words: each begins where no match before it reaches, is the longest there for the first item that
    holds the window, and tells that item, its first word in the item and in the document (from 0) and its length.
    Null and empty texts have no words and no matches; an item without words matches nothing, one without an id
    matches as any other; an empty benchmark leaves every document clean; repeated rows each keep their own
    result; all other columns stay, whatever their names.
    """
    name = free_name(docs, name)
    held = benchmark.select(F.col(item_id).cast("long").alias("i"), F.coalesce(F.col(item_text), F.lit("")).alias("t"))
    total = held.agg(F.sum(F.octet_length("t") + 16)).first()[0] or 0
    blocks = max(1, math.ceil(1.25 * total / block_bytes)) if total > block_bytes else 1
    previous = None
    for b in range(blocks):
        part = held if blocks == 1 else held.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b)
        rows = part.collect()  # at most about block_bytes by the sum above
        kept = docs.sparkSession.sparkContext.broadcast(Items([r.i for r in rows], [r.t for r in rows], window))  # sorted once, for all tasks
        made = _maker(kept)
        step = free_name(docs, f"{name}_{b}") if b < blocks - 1 else name
        docs = append(docs, [text] if previous is None else [text, previous], step, FOUND, made)
        if previous is not None:
            docs = docs.drop(previous)
        previous = step
    return docs


def _maker(kept):
    return lambda: _kernel(kept.value)


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without any occurrence of a benchmark window, with their own columns only."""
    name = free_name(docs, "found")
    out = find_matches(docs, benchmark, name=name, **options)
    return out.filter(F.col(f"{name}.n_hit") == 0).drop(name)
