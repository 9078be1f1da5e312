"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, comp (the smallest node that it reaches) for every node of edges (a, b). Each round is written to the shared folder.

    A large star hangs every greater neighbour of a node on the least node around it, a small star every smaller
    one; both keep the components, and a table of stars is their fixed point. All steps are joins and minima, so
    that no component is ever held by one task.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    state = lambda x: x.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    before = state(e)
    for _ in range(most_rounds):
        sym = e.union(e.select("v", "u"))
        least = sym.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = sym.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(), "stars")
        after = state(e)
        if after == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(e.select("v", "v").distinct())
        before = after
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
