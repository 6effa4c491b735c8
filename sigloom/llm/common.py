"""Helpers shared by the training-data operators: tables, checkpoints, components.

Nothing outside this subpackage imports it, and it imports nothing from the rest of the library.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; read only through Spark, so any store that Spark reaches will do."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.  Where it is unset, a temporary one of a local
    master only: executors elsewhere could not see it, so there it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    held = spark.sparkContext.getCheckpointDir()
    if not held:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="sigloom-"))
        held = spark.sparkContext.getCheckpointDir()
    return held.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows go to the shared folder, so a lost executor costs no recomputation of the past."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, kind: str = "table") -> DataFrame:
    """The rows as a Parquet table in the shared folder, read again.  Unlike a checkpoint it brings true sizes, so that steps which build on
    steps are planned by them (the estimate of a checkpoint that was made by a join is a product, which doubles its digits each time)."""
    folder = f"{shared_root(df.sparkSession)}/{kind}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected edge list, all in DataFrames.

    ``edges`` has long columns ``a`` and ``b``.  Returns one row per node that has an edge:
    ``node``, ``component`` (smallest node reachable).  An empty edge list gives an empty result; loops, nulls and
    repeated edges change nothing.

    Each round contracts the graph: a node takes its least neighbour, then the lesser of that one and its own least neighbour, and the edges
    are written anew between the nodes taken, without those inside one.  At most about half of the nodes that still have an edge
    are left after a round whatever the shape (a path of 10,000 takes 10 rounds), because nodes are compared by a hash that changes with the round; in the
    first round by themselves, which settles stars around their least node at once.  There is no limit of rounds.
    """
    near = F.least("a", "b"), F.greatest("a", "b")
    left = stored(edges.filter("a is not null and b is not null and a <> b").select(near[0].alias("a"), near[1].alias("b")).distinct())
    steps: list[DataFrame] = []
    while not left.isEmpty():
        key = lambda c, turn=len(steps): F.struct(F.xxhash64(c, F.lit(turn)), c) if turn else F.struct(c)
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # every table is written, so that the joins below stand on plain exchanges and a node of many neighbours can be split
        least = stored(both.groupBy(F.col("a").alias("node")).agg(F.min_by("b", key(F.col("b"))).alias("p")))
        then = least.select(F.col("node").alias("p"), F.col("p").alias("q"))
        step = stored(least.join(then, "p").select("node", F.when(key(F.col("q")) < key(F.col("p")), F.col("q")).otherwise(F.col("p")).alias("to")))
        steps.append(step)
        ends = left.join(step.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").join(step.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
        left = stored(ends.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    if not steps:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    # the nodes taken in one round go on to those of the next, from the last round back to the first
    roots = steps[-1]
    for step in reversed(steps[:-1]):
        roots = stored(step.join(roots.select(F.col("node").alias("to"), F.col("to").alias("root")), "to", "left").select("node", F.coalesce("root", "to").alias("to")))
    names = stored(roots.groupBy("to").agg(F.min("node").alias("m")).select("to", F.least("m", "to").alias("component")))
    return stored(roots.join(names, "to").select("node", "component"))
