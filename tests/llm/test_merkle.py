"""The manifest against a plain recomputation of every tree, for several arities, stretches and odd tables."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from sigloom.llm import merkle, queries

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, Leaf string, g int, id int, proof int"


def H(x):
    return hashlib.sha256("".join(x).encode()).hexdigest()


def leaf_of(row):
    return H("-" if (v := row[c]) is None else f"{len(str(v).encode())}:{v}" for c in COLUMNS)


def tree(nodes, arity):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H(levels[-1][i : i + arity]) for i in range(0, len(levels[-1]), arity)])
    return levels


def climb(levels, i, arity, h, proof):
    for level in levels[:-1]:
        begin = i - i % arity
        run = level[begin : begin + arity]
        proof += run[: i - begin] + run[i - begin + 1 :]
        run[i - begin] = h
        h, i = H(run), i // arity
    return h


def brute(rows, arity=2):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r), r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])], arity) for g in names}
    top = tree([trees[g][-1][0] for g in names], arity)
    out = []
    for k, g in enumerate(names):
        for i, (_, _, leaf, r) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0 and r["n_chars"] is not None
            proof: list = []
            h = climb(top, k, arity, climb(trees[g], i, arity, leaf_of(r | {"n_chars": r["n_chars"] + 1}) if hit else leaf, proof), proof)
            out.append((r["doc_id"], leaf, trees[g][-1][0], top[-1][0], H(proof), h, h == top[-1][0]))
    return sorted(out, key=repr)


def made(spark, docs, **options):
    hit = F.coalesce(queries.held_out_of(7, 0), F.lit(False))
    out = merkle.manifest(docs, columns=COLUMNS, found={"n_chars": F.when(hit, F.try_add("n_chars", F.lit(1))).otherwise(F.col("n_chars"))}, **options)
    return sorted((tuple(r) for r in out.select("doc_id", "leaf", "subroot", "root", F.sha2(F.concat_ws("", "proof"), 256), "folded_root", "verified").collect()), key=repr)


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute([r.asDict() for r in docs.collect()])
    got = sorted((tuple(r) for r in queries.op12_merkle(spark, sf).collect()), key=repr)
    assert got == want and {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("arity, tasks", [(2, 1), (2, 7), (3, 5), (5, 16), (16, 3)])
def test_odd_tables(spark, arity, tasks):
    rows = [(i, f"text {i}" * (i % 5), [None, "a", "b", "é", "hot", "hot", "hot"][i % 7], None if i % 11 == 0 else "s", i if i % 3 else None, "x", 1, 2, 3) for i in range(139)]
    rows += [(None, None, None, None, None, None, 0, 0, 0), (None, "x", "alone", None, 2**63 - 1, None, 0, 0, 0), (5, "", "b", "", 0, "", 0, 0, 0), (5, "", "b", "", 0, "", 0, 0, 0), (6, "long " * 30_000, "b", "", 0, "", 0, 0, 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(tasks))
    try:
        assert made(spark, docs, arity=arity) == brute([r.asDict() for r in docs.collect()], arity)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)


def test_many_groups_over_many_tasks(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.concat(F.lit("g"), F.when(F.col("id") < 150, F.lit(0)).otherwise(F.col("id")).cast("string")).alias("lang"), F.lit(None).cast("string").alias("source"), F.col("id").alias("n_chars"))
    assert made(spark, docs, task_rows=9) == brute([r.asDict() for r in docs.collect()])


def test_small_tables(spark):
    docs = spark.createDataFrame([(1, "a", "x", "s", 1, "", 0, 0, 0)], SCHEMA)
    (row,) = made(spark, docs)
    assert row[1] == row[2] == row[3] and row[4] == hashlib.sha256(b"").hexdigest()
    assert made(spark, docs.limit(0)) == []
    same = spark.createDataFrame([(1, "a", "x", "s", 1, "", 0, 0, 0)] * 40, SCHEMA)
    assert made(spark, same, task_rows=6) == brute([r.asDict() for r in same.collect()])


def test_merge_is_associative_and_commutative():
    leaves = [hashlib.sha256(bytes([i])).hexdigest().encode() for i in range(37)]
    layout_counts = {0: merkle.heights(37, 3), merkle.TOP: [1]}
    cuts = [0, 4, 5, 17, 30, 37]
    parts = [({(0, level, i): h for level, i, h in merkle.Stretch(a, leaves[a:b], 37, 3).open()}, {}) for a, b in zip(cuts, cuts[1:])]
    join = lambda x, y: merkle.merge(x, y, layout_counts, 3)
    a, b, c, d, e = parts
    one, two = join(join(join(join(a, b), c), d), e), join(join(e, join(c, a)), join(d, b))
    assert one[0] == two[0] and one[1] == two[1] and list(one[0]) == [(merkle.TOP, 0, 0)]
    assert one[0][merkle.TOP, 0, 0].decode() == tree([h.decode() for h in leaves], 3)[-1][0]
