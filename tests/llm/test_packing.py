"""Packing: the contract's invariants against the library, differencing against small optima, odd tables."""

import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

from sigloom.llm import packing, queries

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id bigint, text string, start int, Length string, ids int"


def held(rows, texts, capacity=2048, end_id=1):
    """All that a packing must keep; ``texts``: list of (doc_id, text)."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    left = defaultdict(list)
    for i, t in texts:
        left[i].append(np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, end_id], "<u4"))
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(docs) == set(left)
    for i, own in docs.items():
        if len(left[i]) == 1:
            at = 0
            for r in sorted(own, key=lambda r: r.start):
                assert r.start == at and r.length > 0 and r.doc_tokens == len(left[i][0])
                assert r.ids_crc32 == zlib.crc32(left[i][0][at : at + r.length].tobytes())
                at += r.length
            assert at == len(left[i][0])
        else:
            assert sum(r.length for r in own) == sum(map(len, left[i]))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at == capacity or at < capacity and at & (at - 1) == 0


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = queries.op13_packing(spark, sf).collect()
    held(rows, [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert {(r.doc_id, r.start, r.sequence_id) for r in queries.op13_packing(spark, sf).collect()} == {(r.doc_id, r.start, r.sequence_id) for r in rows}


@pytest.mark.parametrize("capacity, block", [(2048, 1024), (64, 4), (16, 1000)])
def test_odd_tables(spark, capacity, block):
    words = "the quick brown fox jumps over lazy dogs while it rains".split()
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(90))), 0, "", 0) for i in range(60)] + [(100, None, 0, "", 0), (101, "", None, None, None), (None, "a null id", 0, "", 0), (7, "again", 0, "", 0), (102, "word, " * 9_000, 0, "", 0), (103, " \n\t ", 0, "", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = packing.pack(docs, PATH, capacity=capacity, block=block)
    from pyspark.sql import functions as F

    held(got.withColumn("ids_crc32", F.crc32("ids")).collect(), [(r[0], r[1]) for r in rows], capacity)
    assert packing.pack(docs.limit(0), PATH).collect() == []


def test_differencing():
    rng = random.Random(1)
    for _ in range(60):
        sizes, k = [rng.randrange(1, 50) for _ in range(rng.randrange(1, 8))], rng.randrange(1, 4)
        windows = packing.difference(sizes, k)
        assert sorted(itertools.chain(*windows)) == list(range(len(sizes))) and len(windows) <= k
        sums = [sum(sizes[i] for i in w) for w in windows]
        assert sums == sorted(sums, reverse=True)
        best = min(max(sum(s for s, o in zip(sizes, own) if o == w) for w in range(k)) for own in itertools.product(range(k), repeat=len(sizes)))
        assert sums[0] <= best * 4 / 3
    sizes = [rng.randrange(1, 2048) for _ in range(1024)]
    k = -(-sum(sizes) // 2048)
    sums = [sum(sizes[i] for i in w) for w in packing.difference(sizes, k)]
    assert len(sums) == k and sums[0] - sums[-1] < 0.1 * sums[0]
    # 4, 5, 6, 7, 8 on two windows: the differences 8-7, 6-5, then 4-1, 3-1 leave 2
    assert sorted(sum([4, 5, 6, 7, 8][i] for i in w) for w in packing.difference([4, 5, 6, 7, 8], 2)) == [14, 16]


def test_the_window_count_rises():
    assert len(packing.near_equal([60, 60, 60], 100)) == 3  # two windows would hold 180, but no two items fit
    assert packing.near_equal([], 100) == []
    assert [sum(p[2] for p in w) for w in packing.level([[(0, 0, 60)], [(1, 0, 60)], [(2, 0, 60)]], 100)] == [100, 64, 16]
