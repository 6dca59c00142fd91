"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docflow.llm.common import saved


def _stars(edges: DataFrame, name: str) -> DataFrame:
    """One step: neighbours move to the smallest neighbour of their centre.

    ``edges`` has columns centre and other; each centre's smallest neighbour (or
    itself) takes over all of the centre's listed neighbours and the centre.
    """
    least = edges.groupBy("centre").agg(F.min("other").alias("least"))
    least = saved(least.withColumn("least", F.least("least", "centre")), f"{name}-least")
    return edges.join(least, "centre")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes of the undirected edges (a, b); root is the smallest.

    Every round rewrites the edges so that nodes hang on smaller ones, until each
    component is a star around its smallest node. A round is two aggregates and
    two joins; the number of rounds grows with the logarithm of the longest path.
    Hot centres are split by adaptive skew joins. No edges: no rows.
    """
    edges = saved(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root"))
        .distinct(),
        "components",
    )
    before = None
    while True:
        both = edges.select(F.col("node").alias("centre"), F.col("root").alias("other")).union(
            edges.select(F.col("root").alias("centre"), F.col("node").alias("other"))
        )
        large = _stars(both, "large").where(F.col("other") > F.col("centre"))
        large = large.select(F.col("other").alias("node"), F.col("least").alias("root"))
        large = saved(large.where("node <> root").distinct(), "large")
        down = large.select(F.col("node").alias("centre"), F.col("root").alias("other"))
        small = _stars(down, "small")
        small = small.select(F.col("other").alias("node"), F.col("least").alias("root")).union(
            small.select(F.col("centre").alias("node"), F.col("least").alias("root"))
        )
        edges = saved(small.where("node <> root").distinct(), "components")
        now = edges.agg(
            F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node", "root")).alias("x")
        ).first()
        if now == before or now.n == 0:
            return edges
        before = now
