"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riverbed.llm.common import Scratch


def _large(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    rest = down.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return rest.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(scratch: Scratch, edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the smallest node of its component.

    Loops and repeated edges do no harm; rows with a null end are left out; no edges give no rows. Each round is written to the
    shared folder, so a lost executor costs one round at most. Both steps find a node's smallest neighbour by a partial
    aggregation and join it back, so no task gathers the neighbours of a node; edges of a common node stay few, as every
    round points nodes at their smallest neighbour.
    """
    now = scratch.save(edges.select("a", "b").filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    for _ in range(most):
        # A forest of stars: every node has one parent, and no parent has one.
        check = now.agg(F.count("*"), F.count_distinct("a")).first()
        if check[0] == check[1] and now.join(now.select(F.col("a").alias("b")).distinct(), "b", "left_semi").limit(1).count() == 0:
            break
        nxt = scratch.save(_small(_large(now)))
        if seen is not None:
            scratch.drop(seen)
        seen, now = now, nxt
    else:
        raise RuntimeError(f"no fixpoint after {most} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
