"""Cohort graph study: every summary of every session and density."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graphs as G
from ..session import cut


def long_metrics(wide: DataFrame, keys: list[str]) -> DataFrame:
    """Turn metric columns into ``keys, metric, value``."""
    names = [c for c in wide.columns if c not in keys]
    return wide.select(*keys, *[F.col(c).cast("double").alias(c) for c in names]).unpivot(keys, names, "metric", "value")


def cost_mean(metrics: DataFrame, keys: list[str]) -> DataFrame:
    return metrics.groupBy(*keys, F.concat("metric", F.lit("_cost_mean")).alias("metric")).agg(F.avg("value").alias("value"))


def session_measures(edges: DataFrame, nodes: DataFrame, n: int, keys: list[str], costs=G.COSTS, extended: bool = True,
                     modularity: bool = True) -> DataFrame:
    """``keys, metric, value``: raw totals, each density, and the density mean."""
    ck = [*keys, "cost"]
    kept = cut(G.rank_weights(G.fixed_cost(edges, keys, n, costs), ck))
    base = cut(G.session_nodes(kept, ck, nodes))
    hops = G.distance_blocks(kept, ck, base, F.lit(1.0))
    dist = G.distance_blocks(kept, ck, base)
    lcc = cut(G.largest_component(kept, ck, base))
    tri = cut(G.triangles(kept, ck))
    parts = [
        G.global_efficiency(hops, ck, n, "binary_global_efficiency"),
        G.clustering(kept, ck, n, tri),
        G.characteristic_path(hops, lcc, ck, "binary_characteristic_path_lcc"),
        G.assortativity(kept, ck),
        G.global_efficiency(dist, ck, n, "rank_global_efficiency"),
        G.characteristic_path(dist, lcc, ck, "rank_characteristic_path_lcc"),
        lcc.groupBy(*ck).agg((F.max("size") / F.max("n")).alias("largest_component_fraction")),
    ]
    if modularity:
        # both kinds of weights are searched in one plan
        kinds = F.explode(F.array(F.struct(F.lit("binary").alias("kind"), F.lit(1.0).alias("v")), F.struct(F.lit("rank").alias("kind"), F.col("w").alias("v")))).alias("_k")
        e = cut(kept.select(*ck, "i", "j", kinds).select(*ck, "_k.kind", "i", "j", F.col("_k.v").alias("w")))
        each = cut(base.select(*ck, "node", F.explode(F.array(F.lit("binary"), F.lit("rank"))).alias("kind")))
        kk = [*ck, "kind"]
        q = cut(G.modularity(e, G.communities(e, kk, each), kk))
        of = lambda c, kind: F.max(F.when(F.col("kind") == kind, F.col(c)))
        parts.append(q.groupBy(*ck).agg(*[of(c, k).alias(f"{k}_{c}") for k in ("binary", "rank") for c in ("modularity", "n_communities")]))
    if extended:
        parts += [
            G.local_efficiency(kept, ck, n, tri),
            G.betweenness(kept, hops, ck, n, F.lit(1.0), "binary", base),
            G.betweenness(kept, dist, ck, n, 1 / F.col("w"), "rank", base),
        ]
    rows = None
    for p in parts:
        m = long_metrics(p, ck)
        rows = m if rows is None else rows.unionByName(m)
    rows = cut(rows)
    named = rows.select(
        *keys, F.concat("metric", F.lit("_cost"), F.lpad(F.round(F.col("cost") * 100).cast("int").cast("string"), 2, "0")).alias("metric"), "value"
    )
    raw = long_metrics(G.raw_totals(edges, keys, n), keys)
    return raw.unionByName(named).unionByName(cost_mean(rows, keys))
