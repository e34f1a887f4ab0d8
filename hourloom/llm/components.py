"""Connected components of links by grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourloom.llm.common import stage


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """``(fp, root)`` for every node with a link; the root is the least node of the component.

    Alternates large-star and small-star steps, each a grouped minimum and a join, until nothing changes; the number
    of rounds grows with the logarithm of the component size.  Each round is written to the shared folder.
    """
    edges = stage(edges, "links")
    before = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = stage(large.distinct(), "large")
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        edges = stage(small.filter("a != b").distinct(), "small")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("fp"), F.col("b").alias("root"))
        before = now
    raise RuntimeError("components did not settle")
