"""Connected components over a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondage.llm._io import Scratch


def _signature(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """node, root for every node of ``links`` (a, b: both long): root is the smallest node reachable.

    Each step keeps at most one link per node and neighbour and writes it to the shared folder. Nodes with many neighbours
    are joined, not gathered: the minima are a table of their own, so both sides of the join are plain exchanges, which
    adaptive execution splits where a key is hot. Null ends, loops and repeated links are dropped.
    """
    both = links.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    now = scratch.table(both.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links-0")
    before, step = _signature(now), 0
    while before[0]:
        step += 1
        around = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = scratch.table(around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), f"low-{step}")
        large = around.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = scratch.table(large, f"large-{step}")
        low2 = scratch.table(large.groupBy("a").agg(F.min("b").alias("m")), f"lower-{step}")
        small = large.join(low2, "a").select(F.greatest("b", "m").alias("a"), F.col("m").alias("b")).filter("a <> b").unionByName(low2.select("a", F.col("m").alias("b"))).distinct()
        old, now = step - 1, scratch.table(small, f"links-{step}")
        for name in (f"links-{old}", f"low-{step}", f"large-{step}", f"lower-{step}"):
            scratch.drop(name)
        after = _signature(now)
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
