"""Connected components of a link table by alternating star contraction, in DataFrames throughout.

Every step keeps the components and moves links towards their smallest node; it ends when a whole round
changes nothing, after a number of rounds that grows with the logarithm of the longest chain. Each step is
written to the shared folder. Minima are taken with a map-side merge, and the join that hands them out is
between plain exchanges, which adaptive execution splits where a node has very many links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import Scratch


def _signature(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(links: DataFrame) -> DataFrame:
    """``links(a, b)`` of longs to ``(node, root)``: each node that has a link, with its component's smallest node."""

    def oriented(df: DataFrame, name: str) -> DataFrame:
        """Distinct links from the larger to the smaller node."""
        df = df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        return scratch.save(df, name)

    scratch = Scratch(links.sparkSession, "components")
    links = oriented(links, "links-0")
    seen = _signature(links)
    step = 0
    while seen[0]:
        # Large star: all larger neighbours of a node move to its smallest neighbour.
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = scratch.save(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), f"least-{step}")
        moved = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = oriented(moved, f"large-{step}")
        # Small star: all smaller neighbours of a node, and the node, move to the smallest of them.
        least_small = scratch.save(large.groupBy("a").agg(F.min("b").alias("m")), f"small-{step}")
        moved = large.join(least_small, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least_small.select("a", F.col("m").alias("b")))
        after = oriented(moved, f"links-{step + 1}")
        now = _signature(after)
        for name in (f"links-{step}", f"least-{step}", f"large-{step}", f"small-{step}"):
            scratch.drop(name)
        links, step = after, step + 1
        if now == seen:
            break
        seen = now
    roots = links.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
