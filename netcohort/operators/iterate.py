"""Fixpoint loops over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def union_all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def connected_components(nodes: DataFrame, edges: DataFrame, keys: list[str], max_rounds: int = 200) -> DataFrame:
    """``keys, node, root``: every node with the smallest node it can reach.

    Minimum labels spread along edges and each round also jumps to the label's
    own label, so the rounds grow with the logarithm of the longest chain.
    ``edges`` holds ``keys, i, j`` once per pair.
    """
    both = edges.select(*keys, "i", "j").unionByName(
        edges.select(*keys, F.col("j").alias("i"), F.col("i").alias("j"))
    )
    both = cut(both)
    lab = cut(
        nodes.join(both.groupBy(*keys, F.col("i").alias("node")).agg(F.min("j").alias("m")), [*keys, "node"], "left")
        .select(*keys, "node", F.least("node", F.coalesce("m", "node")).alias("root"))
    )
    for _ in range(max_rounds):
        near = (
            both.join(lab.withColumnRenamed("node", "j"), [*keys, "j"])
            .groupBy(*keys, F.col("i").alias("node"))
            .agg(F.min("root").alias("m"))
        )
        step = lab.join(near, [*keys, "node"], "left").select(
            *keys, "node", F.col("root").alias("old"), F.least("root", F.coalesce("m", "root")).alias("root")
        )
        jump = lab.select(*keys, F.col("node").alias("root"), F.col("root").alias("up"))
        nxt = cut(
            step.join(jump, [*keys, "root"], "left").select(
                *keys, "node", "old", F.least("root", F.coalesce("up", "root")).alias("root")
            )
        )
        lab = nxt.select(*keys, "node", "root")
        if nxt.filter("old <> root").limit(1).count() == 0:
            return lab
    raise RuntimeError("component labels did not settle")
