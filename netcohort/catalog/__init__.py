"""All registered queries, the oracle SQL and the flagship."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graphs as G
from . import embedding_queries, geometry_queries, graph_queries, inference_queries, source_queries, spatial_queries, study_queries  # noqa: F401
from .fixtures import Tables
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "flagship"]


def flagship(spark, sf_dir):
    """Line items to nation graphs, fixed-cost threshold, node change visit 1 to 2."""
    t = Tables(spark, sf_dir)
    keys = ["subject", "visit"]
    kept = G.fixed_cost(t.nation_edges(), keys, 25, (0.1,)).drop("cost")
    first, second = kept.filter("visit = 1"), kept.filter("visit = 2")
    nodes = t.nation_nodes()
    d = G.node_change(first, second, ["subject"], G.session_nodes(first, ["subject"], nodes))
    return d.join(F.broadcast(nodes.select(F.col("idx").alias("node"), "name", "network")), "node")
