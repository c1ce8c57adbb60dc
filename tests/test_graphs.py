"""Hand-computed graphs and brute-force comparison."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from netcohort.operators import graphs as G
from netcohort.operators.iterate import connected_components
from netcohort.session import cut

K = ["session"]


@pytest.fixture(scope="module")
def small(spark):
    rng = np.random.default_rng(5)
    n = 9
    w = np.triu(np.round(rng.uniform(0.1, 3, (n, n)), 3), 1) * (np.triu(rng.random((n, n)), 1) > 0.62)
    rows = [("a", int(i), int(j), float(w[i, j])) for i, j in zip(*np.nonzero(w))]
    e = cut(spark.createDataFrame(rows, "session string, i int, j int, w double"))
    nodes = cut(spark.range(n).select(F.lit("a").alias("session"), F.col("id").cast("int").alias("node")))
    return n, w + w.T, e, nodes


def paths(a, lengths):
    n = len(a)
    d = np.where(a > 0, lengths, np.inf)
    np.fill_diagonal(d, 0)
    for k in range(n):
        d = np.minimum(d, d[:, k:k + 1] + d[k:k + 1])
    return d


def test_distances_and_betweenness(small):
    n, a, e, nodes = small
    with np.errstate(divide="ignore"):
        d = paths(a, 1 / a)
    dist = G.weighted_distances(e, K, nodes)
    got = np.full((n, n), np.inf)
    for r in dist.collect():
        got[r.src, r.dst] = r.d
    assert np.allclose(got, d)
    bc = np.zeros(n)
    for s, t in itertools.permutations(range(n), 2):
        if not np.isfinite(d[s, t]):
            continue
        short = []

        def walk(u, seen, left):
            if u == t:
                if abs(left) < 1e-9:
                    short.append(seen)
                return
            for v in np.nonzero(a[u])[0]:
                if v not in seen and left - 1 / a[u, v] > -1e-9:
                    walk(v, [*seen, v], left - 1 / a[u, v])

        walk(s, [s], d[s, t])
        for p in short:
            for v in p[1:-1]:
                bc[v] += 1 / len(short)
    r = G.betweenness(e, G.distance_blocks(e, K, nodes), K, n, 1 / F.col("w"), "rank", nodes).first()
    assert np.isclose(r.rank_mean_betweenness_normalized, bc.mean() / ((n - 1) * (n - 2)))
    assert np.isclose(r.rank_max_betweenness_normalized, bc.max() / ((n - 1) * (n - 2)))


def test_clustering_and_local_efficiency(small):
    n, a, e, _ = small
    b = (a > 0).astype(float)
    k = b.sum(0)
    room = np.where(k > 1, k * (k - 1), 1)
    c3, cw = np.diag(b @ b @ b), np.diag(np.cbrt(a) @ np.cbrt(a) @ np.cbrt(a))
    r = G.clustering(e, K, n).first()
    assert np.isclose(r.binary_mean_clustering, np.where(k > 1, c3 / room, 0).mean())
    assert np.isclose(r.rank_mean_clustering, np.where(k > 1, cw / room, 0).mean())
    assert np.isclose(r.binary_transitivity, c3.sum() / (k * (k - 1)).sum())
    loc = []
    for u in range(n):
        v = np.nonzero(b[u])[0]
        if len(v) < 2:
            loc.append(0)
            continue
        d = paths(b[np.ix_(v, v)], np.ones((len(v), len(v))))
        inv = np.where(np.isfinite(d) & (d > 0), 1 / np.where(d > 0, d, 1), 0)
        loc.append(inv.sum() / (len(v) * (len(v) - 1)))
    assert np.isclose(G.local_efficiency(e, K, n).first().binary_mean_local_efficiency, np.mean(loc))


def test_five_node_two_edge_graph(spark):
    e = spark.createDataFrame([("a", 0, 1, 1.0), ("a", 1, 2, 1.0)], "session string, i int, j int, w double")
    nodes = spark.range(5).select(F.lit("a").alias("session"), F.col("id").cast("int").alias("node"))
    hops = G.distance_blocks(e, K, nodes, F.lit(1.0))
    assert G.hop_distances(e, K, nodes).count() == 11
    assert np.isclose(G.hop_efficiency(G.hop_counts(e, K, nodes), K, 5, "e").first().e, 0.25)
    assert np.isclose(G.global_efficiency(hops, K, 5, "e").first().e, 0.25)
    lcc = cut(G.largest_component(e, K, nodes))
    assert lcc.count() == 3 and lcc.first().size == 3
    assert np.isclose(G.characteristic_path(hops, lcc, K, "c").first().c, 4 / 3)


def test_zero_baseline_percent_is_null(spark):
    none = spark.createDataFrame([], "session string, i int, j int, w double")
    e = spark.createDataFrame([("a", 0, 1, 2.0)], "session string, i int, j int, w double")
    r = G.edge_change(none, e, K).first()
    assert r.percent is None and r.delta == 2.0


def test_components_of_a_long_chain(spark):
    e = spark.range(40).select(F.lit("a").alias("session"), F.col("id").alias("i"), (F.col("id") + 1).alias("j"))
    nodes = spark.range(43).select(F.lit("a").alias("session"), F.col("id").alias("node"))
    c = connected_components(nodes, e, K)
    assert c.filter("root = 0").count() == 41 and c.filter("node > 40 and root = node").count() == 2


def test_modularity_search_separates_two_cliques(spark):
    rows = [("a", i + o, j + o, 1.0) for o in (0, 5) for i in range(5) for j in range(i + 1, 5)] + [("a", 4, 5, 1.0)]
    e = spark.createDataFrame(rows, "session string, i int, j int, w double")
    nodes = spark.range(10).select(F.lit("a").alias("session"), F.col("id").cast("int").alias("node"))
    q = G.modularity(e, G.communities(e, K, nodes), K).first()
    assert q.n_communities == 2 and np.isclose(q.modularity, 20 / 21 - 0.5)


def test_blocks_of_sources_beyond_one_row(spark):
    """A ring of 130 nodes with chords lies in three blocks; all its nodes are alike."""
    n = 130
    e = cut(spark.range(n).select(F.lit("a").alias("session"), F.col("id").alias("u"), F.explode(F.array(F.lit(1), F.lit(11), F.lit(27))).alias("s"))
            .select("session", F.least("u", (F.col("u") + F.col("s")) % n).cast("int").alias("i"), F.greatest("u", (F.col("u") + F.col("s")) % n).cast("int").alias("j"), F.lit(0.5).alias("w")))
    nodes = cut(spark.range(n).select(F.lit("a").alias("session"), F.col("id").cast("int").alias("node")))
    a = np.zeros((n, n))
    for r in e.collect():
        a[r.i, r.j] = a[r.j, r.i] = 1
    d = paths(a, np.ones((n, n)))[0, 1:]
    hops = G.distance_blocks(e, K, nodes, F.lit(1.0))
    assert hops.count() == 3 * n
    assert np.isclose(G.characteristic_path(hops, nodes, K, "c").first().c, d.mean())
    assert np.isclose(G.global_efficiency(hops, K, n, "e").first().e, (1 / d).mean())
    assert np.isclose(G.hop_efficiency(G.hop_counts(e, K, nodes), K, n, "e").first().e, (1 / d).mean())
    r = G.betweenness(e, hops, K, n, F.lit(1.0), "binary", nodes).first()
    inner = (d - 1).sum() / ((n - 1) * (n - 2))
    assert np.isclose(r.binary_mean_betweenness_normalized, inner) and np.isclose(r.binary_max_betweenness_normalized, inner)


def test_search_settles_and_keeps_ties_apart(spark):
    rng = np.random.default_rng(3)
    rows = [("a", int(i), int(j), float(rng.uniform(0.5, 2) + 4 * (i // 6 == j // 6))) for i in range(30) for j in range(i + 1, 30) if i // 6 == j // 6 or rng.random() < 0.15]
    rows += [("b", 0, 1, 1.0), ("b", 1, 2, 1.0), ("b", 2, 3, 1.0), ("b", 0, 3, 1.0)]
    e = cut(spark.createDataFrame(rows, "session string, i int, j int, w double"))
    nodes = cut(spark.range(31).selectExpr("'a' AS session", "int(id) AS node").union(spark.range(4).selectExpr("'b' AS session", "int(id) AS node")))
    got = cut(G.communities(e, K, nodes, seeds=6))
    assert G.gaining_moves(e, got, K).count() == 0
    of = {(r.session, r.node): r.community for r in got.collect()}
    assert all(of["a", i] == i // 6 * 6 for i in range(30)) and of["a", 30] == 30
    # the square has two best partitions; the one whose labels come first counts
    assert [of["b", i] for i in range(4)] == [0, 0, 2, 2]


def test_small_tables_are_read_from_their_sources_once(spark):
    from netcohort.catalog.fixtures import Tables
    from netcohort.catalog.graph_queries import Base

    t = Tables(spark, "/root/testdata/sf0.01")
    for table in (t.nodes(), t.outcomes(), t.sides(), Base(t).nodes):
        assert table.inputFiles() and not any("testdata" in f for f in table.inputFiles())
    assert t.nodes().count() == 50
