"""Connected components by alternating large and small stars; each round is checkpointed to the shared folder."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint in spark.checkpoint.dir; a folder of our own only where the session names none and its master is local, as in tests."""
    spark, context = df.sparkSession, df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        context.setCheckpointDir(base or "file://" + tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint()


def components(edges: DataFrame, max_rounds: int = 200, cut: Callable[[DataFrame], DataFrame] = cut) -> DataFrame:
    """(a, b) edges → (node, root), the smallest node of each component. Nodes without an edge have no row.

    Large star: each node's larger neighbours go to the smallest of it and its neighbours; small star: each node and its smaller
    neighbours go to the smallest of these; in turn, until no edge changes. ``cut`` ends the lineage of each round. The middle of a
    star has no smaller neighbour and its edges stay as they are: the large star writes down just the nodes that have larger and smaller
    neighbours, fewer each round, and Spark broadcasts them under its own threshold, so that a hot node's edges are not shuffled by it. Rounds grow with the logarithm of the longest path;
    should ``max_rounds`` not do, that is an error, never an unfinished result.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    before = None
    for _ in range(0 if now.isEmpty() else max_rounds):
        low = now.groupBy("u").agg(F.min("v").alias("m"))
        between = cut(now.select(F.col("v").alias("u")).distinct().join(low, "u").select(F.col("u").alias("v"), "m"))
        large = now.join(between, "v", "left").select("u", F.coalesce("m", "v").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        now = cut(moved.filter("u <> v").distinct())
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
    else:
        if before is not None:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v")).distinct()
