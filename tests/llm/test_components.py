"""Components of chains, combs, stars and random graphs, and chains of near copies through the operators."""

import random

import numpy as np
import pytest

from sigloom.llm import common, embeddings, minhash

N = 600


def brute(edges):
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {x: find(x) for x in root}


def shapes():
    """Graphs of all kinds beside one another."""
    rng = random.Random(3)
    for turn, kind in enumerate(("path", "ascending", "star", "comb", "random", "many")):
        ids = [10**6 * turn + i for i in rng.sample(range(10**5), N)]
        if kind == "path":
            yield from zip(ids, ids[1:])
        elif kind == "ascending":
            yield from zip(sorted(ids), sorted(ids)[1:])
        elif kind == "star":
            yield from ((ids[0], x) for x in ids[1:])
        elif kind == "comb":
            yield from ((ids[i], ids[i + 1]) for i in range(N // 2 - 1))
            yield from ((ids[i], ids[i + N // 2]) for i in range(N // 2))
        elif kind == "random":
            yield from ((rng.choice(ids), rng.choice(ids)) for _ in range(N // 2))
        else:
            yield from ((ids[i], ids[i + 1]) for i in range(N - 1) if i % 7)


def test_shapes(spark):
    edges = [(a - 10**6, b - 10**6) for a, b in shapes()]
    made = spark.createDataFrame([*edges, *edges[:5], (edges[0][0], edges[0][0])], "a bigint, b bigint")
    assert {r.node: r.component for r in common.components(made).collect()} == brute([e for e in edges if e[0] != e[1]])


def test_nothing_to_join(spark):
    assert common.components(spark.createDataFrame([(1, 1), (None, 2), (3, None)], "a bigint, b bigint")).collect() == []


def test_a_long_random_chain(spark, monkeypatch):
    rounds = []
    held = common.stored
    monkeypatch.setattr(common, "stored", lambda df: rounds.append(df.columns) or held(df))
    ids = random.Random(9).sample(range(10**9), 10_000)
    made = spark.createDataFrame(list(zip(ids, ids[1:])), "a bigint, b bigint")
    got = common.components(made)
    assert got.count() == 10_000 and {r.component for r in got.select("component").distinct().collect()} == {min(ids)}
    assert sum(c == ["node", "p"] for c in rounds) < 25


def test_versions_of_one_document_are_one_component(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(200)]
    rows = []
    for i in rng.sample(range(10_000), 120):  # each keeps 95 % of the words of the one before
        rows.append((i, " ".join(words)))
        for k in rng.sample(range(0, 200, 2), 5):
            words[k : k + 2] = [f"x{rng.random()}", f"y{rng.random()}"]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    least = min(r[0] for r in rows)
    assert {r.component_id for r in minhash.near_duplicates(docs).collect()} == {least}


def test_vectors_that_drift_are_one_component(spark):
    turn = 0.4  # radians: cosine 0.92
    rows = [(int(i), [float(np.cos(k * turn)), float(np.sin(k * turn)), 10.0 * 0]) for k, i in enumerate(np.random.default_rng(1).permutation(15))]
    got = {r.vec_id: r.component_id for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()}
    assert set(got.values()) == {0}


@pytest.mark.parametrize("dim", [64, 384, 768])
def test_pairs_at_the_threshold_meet_and_are_counted(dim):
    """Recall of cells and counts for pairs of exactly the least cosine, planned for tables of more than 65,536 rows."""
    rng = np.random.default_rng(dim)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    x = unit(rng.standard_normal((4_000, dim)))
    z = rng.standard_normal(x.shape)
    z = unit(z - (z * x).sum(1, keepdims=True) * x)
    y = 0.9 * x + np.sqrt(1 - 0.81) * z
    turn, (half, least) = embeddings.directions(dim), embeddings.calibrate(dim, 0.9)
    small = lambda v: np.clip(np.round(v @ turn / embeddings.STEP), -63, 63)
    counted = (np.abs(small(x) - small(y)) <= half).sum(1) >= least
    for n in (70_000, 10_000_000):
        bits, tables = embeddings.plan(n, 0.9, 1 << 12, 1e-6)
        cuts = np.random.default_rng(9).standard_normal((dim, bits * tables))
        met = (embeddings.cells(x, cuts, bits) == embeddings.cells(y, cuts, bits)).any(1)
        assert (met & counted).mean() >= 0.999


def test_only_members_with_a_partner_bring_their_sets(spark, monkeypatch):
    """Long lists of common values whose members are unlike: their full sets are never made; a repeated row brings one."""
    rng, asked, of = np.random.default_rng(11), [], minhash._Sets.of
    texts = [" ".join(rng.choice([f"w{i}" for i in range(12)], 30)) for _ in range(200)]
    rows = [*enumerate(texts), (300, texts[7] + " end"), (300, texts[7] + " end"), (301, texts[9] + " w1 end"), (302, texts[9])]
    monkeypatch.setattr(minhash._Sets, "of", lambda self, wanted: (asked.extend(r.node for r in wanted.distinct().collect()), of(self, wanted))[1])
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for options in ({}, {"broadcast_rows": 0}):
        asked.clear()
        got = sorted((r.doc_id, r.component_id) for r in minhash.near_duplicates(docs, **options).collect())
        assert got == sorted((i, {300: 7, 301: 9, 302: 9}.get(i, i)) for i, _ in rows)
        assert 4 <= len(set(asked)) < 20
