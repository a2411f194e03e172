"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from convolytics.llm.common import drop_staged, staged


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, component`` (its smallest node) of every node that occurs in
    ``edges`` (``a, b``; any direction, repeats and loops allowed). Each step
    is a minimum per node, combined before the shuffle, and a join with the
    edges; no node's neighbours are ever gathered. The table of every step
    is stored, which keeps the plans that the driver holds small, and the one
    before it deleted."""
    now = staged(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "star")
    seen = None
    for _ in range(max_rounds):
        both = now.union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = staged(both.join(low, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        # every node now points to smaller ones: link them and it to the least
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        step = (
            small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(least.select("a", F.col("m").alias("b")))
            .filter("a <> b")
            .distinct()
        )
        last, now = now, staged(step, "star")
        drop_staged(last)
        drop_staged(large)
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError("components did not settle")
    members = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return members.union(roots)
