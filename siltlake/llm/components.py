"""Connected components by alternating star contraction.

Edges are a distributed table throughout; each round is written to the shared
folder, so lineage stays short and a lost executor costs one round at most.
Minima are taken with partial aggregation before the shuffle, and the joins with
them have one row per node on the other side, so adaptive execution can split a
node with very many edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, staged


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node hands its larger neighbours to its smallest one."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node hands its smaller neighbours, and itself, to the smallest."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    near = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return near.union(least.select("a", F.col("m").alias("b")))


def _tidy(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").filter("a <> b").distinct()


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """node and root (the smallest node reachable) of every node that has an
    edge; ``edges`` holds whole numbers a and b.

    Defined results: a null end makes no edge; loops and repeated edges change
    nothing; no edges give an empty table; other columns are not read."""
    now = staged(_tidy(edges), "edges")
    mark = None
    for _ in range(rounds):
        old, now = now, staged(_tidy(_small_star(_tidy(_large_star(now)))), "edges")
        release(old)
        new = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b"), F.col("b")).distinct())
