"""Weighted graphs as long edge tables ``keys, i, j, w`` with ``i < j``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import order as O
from ..functions.expr import checked
from ..session import cut
from .iterate import connected_components, union_all

# The connection densities every threshold summary is averaged over.
COSTS = (0.03, 0.05, 0.07)


def kept_count(cost: Column, n: int) -> Column:
    """Half-even rounding of cost * n(n-1)/2."""
    return F.bround(cost * F.lit(n * (n - 1) // 2), 0).cast("long")


def with_costs(sessions: DataFrame, keys: list[str], n: int, costs=COSTS) -> DataFrame:
    """``keys, cost, k`` for every session and requested density."""
    return sessions.select(*keys).distinct().select(
        *keys, F.explode(F.array(*[F.lit(c) for c in costs])).alias("cost")
    ).withColumn("k", kept_count(F.col("cost"), n))


def fixed_cost(edges: DataFrame, keys: list[str], n: int, costs=COSTS) -> DataFrame:
    """``keys, cost, i, j, w``: exactly k heaviest pairs, ties in row order.

    A session without enough positive pairs for a density is refused;
    ``cost_violations`` lists such sessions.
    """
    pos = edges.filter("w > 0").withColumn("_pair", F.col("i").cast("long") * n + F.col("j"))
    have = edges.groupBy(*keys).agg(F.count_if(F.col("w") > 0).alias("_have"))
    wanted = with_costs(edges, keys, n, costs).join(have, keys)
    k = checked(F.col("k"), (F.col("k") >= 1) & (F.col("_have") >= F.col("k")), "a session has too few positive pairs for the requested density")
    return O.top_k(pos, keys, "w", "_pair", wanted.select(*keys, "cost", k.alias("k")), ["cost"]).drop("_pair")


def cost_violations(edges: DataFrame, keys: list[str], n: int, costs=COSTS) -> DataFrame:
    """Sessions without enough positive pairs for a density."""
    have = edges.groupBy(*keys).agg(F.count_if(F.col("w") > 0).alias("positive"))
    return with_costs(edges, keys, n, costs).join(have, keys).filter("k < 1 or positive < k")


def rank_weights(kept: DataFrame, keys: list[str]) -> DataFrame:
    """Replace ``w`` by its ascending average rank over the kept count."""
    r = O.avg_rank(kept, keys, "w", "_r", size="_n")
    return r.withColumn("w", F.col("_r") / F.col("_n")).drop("_r", "_n")


def raw_totals(edges: DataFrame, keys: list[str], n: int) -> DataFrame:
    pairs = n * (n - 1) // 2
    return edges.groupBy(*keys).agg(
        F.sum("w").alias("total_edge_weight"),
        (F.count_if(F.col("w") > 0) / F.lit(pairs)).alias("raw_positive_edge_density"),
    )


def edge_density(edges: DataFrame, n: int, visit: str = "visit", sessions: DataFrame | None = None) -> DataFrame:
    """Percent of positive pairs over all sessions and over the first visit."""
    pairs = n * (n - 1) // 2
    s = sessions if sessions is not None else edges.select("subject", visit).distinct()
    counts = s.agg(F.count(F.lit(1)).alias("s_all"), F.count_if(F.col(visit) == 0).alias("s_pre"))
    pos = edges.filter("w > 0").agg(F.count(F.lit(1)).alias("p_all"), F.count_if(F.col(visit) == 0).alias("p_pre"))
    one = F.lit(1).alias("_one")
    return counts.select("*", one).join(pos.select("*", one), "_one").select(
        (100.0 * F.col("p_all") / (F.col("s_all") * pairs)).alias("density_all"),
        (100.0 * F.col("p_pre") / (F.col("s_pre") * pairs)).alias("density_pre"),
    )


def adjacency(edges: DataFrame, keys: list[str], cols: list[str] | None = None) -> DataFrame:
    """Both directions of every pair."""
    cols = ["w"] if cols is None else cols
    return edges.select(*keys, "i", "j", *cols).unionByName(
        edges.select(*keys, F.col("j").alias("i"), F.col("i").alias("j"), *cols)
    )


def session_nodes(edges: DataFrame, keys: list[str], nodes: DataFrame) -> DataFrame:
    """Every node of the frozen basis in every session: ``keys, node``.

    The basis is exploded per session from one array that holds n indices.
    """
    basis = nodes.agg(F.array_sort(F.collect_set("idx")).alias("_b")).withColumn("_one", F.lit(1))
    s = edges.select(*keys).distinct().withColumn("_one", F.lit(1))
    return s.join(F.broadcast(basis), "_one").select(*keys, F.explode("_b").alias("node"))


def degrees(edges: DataFrame, keys: list[str]) -> DataFrame:
    return adjacency(edges, keys).groupBy(*keys, F.col("i").alias("node")).agg(
        F.count(F.lit(1)).alias("k"), F.sum("w").alias("s")
    )


# -- components and distances ------------------------------------------------

def largest_component(edges: DataFrame, keys: list[str], node_table: DataFrame) -> DataFrame:
    """``keys, node`` of the largest component; a tie takes the smallest root."""
    comp = connected_components(node_table, edges, keys)
    size = comp.groupBy(*keys, "root").agg(F.count(F.lit(1)).alias("size"))
    best = size.groupBy(*keys).agg(
        F.min(F.struct((-F.col("size")).alias("neg"), "root")).alias("b"), F.sum("size").alias("n")
    ).select(*keys, F.col("b.root").alias("root"), (-F.col("b.neg")).alias("size"), "n")
    return comp.join(best, [*keys, "root"])


#: Sources whose distances lie in one row.
LANES = 64


def lane_blocks(node: Column) -> tuple[Column, Column]:
    """Block and place in it of a source."""
    return F.floor(node / LANES).cast("int"), F.pmod(node, F.lit(LANES)).cast("int")


def _unit_lane(lane: Column, one: Column, other: Column) -> Column:
    """An array of ``LANES`` values, ``one`` at ``lane`` and ``other`` elsewhere."""
    return F.transform(F.sequence(F.lit(0), F.lit(LANES - 1)), lambda k: F.when(k == lane, one).otherwise(other))


def distance_blocks(edges: DataFrame, keys: list[str], node_table: DataFrame, length: Column | None = None, max_rounds: int = 1000) -> DataFrame:
    """``keys, node, block, d``: distances of ``node`` from the sources ``64*block`` to ``64*block+63``.

    Lengths are 1/w (or ``length``); a source that does not reach the node is at
    infinity.  A round sends only blocks that came nearer along the pairs of their node
    and keeps lane-wise minima, so rows grow with nodes times blocks, never with pairs.
    """
    length = 1 / F.col("w") if length is None else length
    far = F.lit(float("inf"))
    adj = cut(adjacency(edges.withColumn("len", length), keys, ["len"]))
    block, lane = lane_blocks(F.col("node"))
    best = cut(node_table.select(*keys, "node", block.alias("block"), _unit_lane(lane, F.lit(0.0), far).alias("d"), F.lit(True).alias("fresh")))
    at = [*keys, "node", "block"]
    for _ in range(max_rounds):
        sent = best.filter("fresh").withColumnRenamed("node", "j").join(adj, [*keys, "j"])
        near = sent.groupBy(*keys, F.col("i").alias("node"), "block").agg(F.array(*[F.min(F.get("d", F.lit(k)) + F.col("len")) for k in range(LANES)]).alias("c"))
        both = best.join(near, at, "full")
        nearer = F.exists(F.zip_with("c", "d", lambda c, d: c < d), lambda x: x)
        best = cut(both.select(
            *at, F.when(F.col("c").isNull(), F.col("d")).when(F.col("d").isNull(), F.col("c")).otherwise(F.zip_with("c", "d", lambda c, d: F.least(c, d))).alias("d"),
            (F.col("c").isNotNull() & (F.col("d").isNull() | nearer)).alias("fresh"),
        ))
        if best.filter("fresh").isEmpty():
            return best.drop("fresh")
    raise RuntimeError("distances did not settle")


def _sum(values: Column, part) -> Column:
    return F.aggregate(F.transform(values, part), F.lit(0.0), lambda s, x: s + x)


def _reached(d: Column) -> Column:
    return (d > 0) & (d < float("inf"))


def block_pairs(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, src, dst, d`` for all reachable ordered pairs."""
    each = blocks.select(*keys, F.col("node").alias("dst"), "block", F.posexplode("d").alias("lane", "d")).filter(F.col("d") < float("inf"))
    return each.select(*keys, (F.col("block") * LANES + F.col("lane")).alias("src"), "dst", "d")


def hop_distances(edges: DataFrame, keys: list[str], node_table: DataFrame) -> DataFrame:
    """``keys, src, dst, d`` for all reachable ordered pairs, which are the result."""
    return block_pairs(distance_blocks(edges, keys, node_table, F.lit(1.0)), keys).withColumn("d", F.col("d").cast("int"))


def weighted_distances(edges: DataFrame, keys: list[str], node_table: DataFrame, length: Column | None = None) -> DataFrame:
    """``keys, src, dst, d`` with lengths 1/w (or ``length``) for all reachable ordered pairs."""
    return block_pairs(distance_blocks(edges, keys, node_table, length), keys)


def hop_counts(edges: DataFrame, keys: list[str], node_table: DataFrame, max_rounds: int = 500) -> DataFrame:
    """``keys, node, d, pairs``: how many nodes lie at each distance from a node.

    Every node keeps the set it has reached as bits, 64 nodes to a row; a round sends
    the words that gained bits along the pairs and counts the bits that are new.  Rows
    grow with nodes and pairs, never with pairs of nodes.
    """
    adj = cut(edges.select(*keys, "i", "j").unionByName(edges.select(*keys, F.col("j").alias("i"), F.col("i").alias("j"))))
    word, bit = F.floor(F.col("node") / 64).cast("int"), F.expr("shiftleft(1L, int(node % 64))")
    at = [*keys, "node", "word"]
    ball = cut(node_table.select(*keys, "node", word.alias("word"), bit.alias("bits"), bit.alias("new")))
    levels = []
    for depth in range(1, max_rounds):
        sent = adj.join(ball.filter("new <> 0").withColumnRenamed("node", "j"), [*keys, "j"])
        got = sent.groupBy(*keys, F.col("i").alias("node"), "word").agg(F.bit_or("new").alias("got"))
        have, got_bits = F.coalesce("bits", F.lit(0)), F.coalesce("got", F.lit(0))
        ball = cut(ball.drop("new").join(got, at, "full").select(*at, have.bitwiseOR(got_bits).alias("bits"), got_bits.bitwiseAND(F.bitwise_not(have)).alias("new")))
        gained = ball.filter("new <> 0")
        if gained.isEmpty():
            none = node_table.limit(0).select(*keys, "node", F.lit(0).alias("d"), F.lit(0).cast("long").alias("pairs"))
            return union_all(levels) if levels else none
        levels.append(gained.groupBy(*keys, "node").agg(F.sum(F.bit_count("new")).alias("pairs")).select(*keys, "node", F.lit(depth).alias("d"), "pairs"))
    raise RuntimeError("graph deeper than the round limit")


def hop_efficiency(counts: DataFrame, keys: list[str], n: int, out: str) -> DataFrame:
    """Mean inverse distance over all ordered pairs, from the counts by distance."""
    return counts.groupBy(*keys).agg((F.sum(F.col("pairs") / F.col("d")) / F.lit(n * (n - 1))).alias(out))


def global_efficiency(blocks: DataFrame, keys: list[str], n: int, out: str) -> DataFrame:
    """Mean inverse distance over all ordered pairs, from distance blocks."""
    inverse = _sum(F.col("d"), lambda d: F.when(_reached(d), 1 / d).otherwise(0.0))
    return blocks.groupBy(*keys).agg((F.sum(inverse) / F.lit(n * (n - 1))).alias(out))


def characteristic_path(blocks: DataFrame, lcc: DataFrame, keys: list[str], out: str) -> DataFrame:
    """Mean distance between distinct members of the largest component, from distance blocks."""
    own = blocks.join(lcc.select(*keys, "node"), [*keys, "node"], "left_semi")
    total, pairs = _sum(F.col("d"), lambda d: F.when(_reached(d), d).otherwise(0.0)), _sum(F.col("d"), lambda d: F.when(_reached(d), 1.0).otherwise(0.0))
    return own.groupBy(*keys).agg((F.sum(total) / F.nullif(F.sum(pairs), F.lit(0.0))).alias(out))


# -- triangles ---------------------------------------------------------------

def triangles(edges: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, a, b, c, wab, wac, wbc`` once per triangle.

    Each pair points from its lower- to its higher-degree end, so even a hub
    has few outgoing pairs and the wedge join stays near m^1.5.
    """
    deg = degrees(edges, keys).select(*keys, "node", "k")
    e = (
        edges.select(*keys, "i", "j", "w")
        .join(deg.select(*keys, F.col("node").alias("i"), F.col("k").alias("ki")), [*keys, "i"])
        .join(deg.select(*keys, F.col("node").alias("j"), F.col("k").alias("kj")), [*keys, "j"])
    )
    low_first = F.struct("ki", "i") < F.struct(F.col("kj").alias("ki"), F.col("j").alias("i"))
    o = cut(e.select(
        *keys, F.when(low_first, F.col("i")).otherwise(F.col("j")).alias("a"),
        F.when(low_first, F.col("j")).otherwise(F.col("i")).alias("b"),
        F.when(low_first, F.struct("kj", "j")).otherwise(F.struct(F.col("ki").alias("kj"), F.col("i").alias("j"))).alias("ob"),
        "w",
    ))
    first = o.select(*keys, "a", "b", "ob", F.col("w").alias("wab"))
    second = o.select(*keys, "a", F.col("b").alias("c"), F.col("ob").alias("oc"), F.col("w").alias("wac"))
    wedge = first.join(second, [*keys, "a"]).filter("ob < oc").drop("ob", "oc")
    third = o.select(*keys, F.col("a").alias("b"), F.col("b").alias("c"), F.col("w").alias("wbc"))
    return wedge.join(third, [*keys, "b", "c"])


def node_triangles(tri: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, node, t, tw``: triangle count and cube-root weight sum per node."""
    strength = F.cbrt(F.col("wab") * F.col("wac") * F.col("wbc"))
    each = tri.select(*keys, F.explode(F.array("a", "b", "c")).alias("node"), strength.alias("g"))
    return each.groupBy(*keys, "node").agg(F.count(F.lit(1)).alias("t"), F.sum("g").alias("tw"))


def clustering(edges: DataFrame, keys: list[str], n: int, tri: DataFrame | None = None) -> DataFrame:
    """Mean clustering over all n nodes and transitivity, unweighted and weighted."""
    tri = triangles(edges, keys) if tri is None else tri
    d = degrees(edges, keys).select(*keys, "node", "k")
    t = d.join(node_triangles(tri, keys), [*keys, "node"], "left").fillna(0, ["t"]).fillna(0.0, ["tw"])
    room = F.col("k") * (F.col("k") - 1)
    part = lambda c: F.sum(F.when(room > 0, 2 * F.col(c) / room).otherwise(0.0)) / F.lit(n)
    ratio = lambda c: F.when(F.sum(room) > 0, F.sum(2 * F.col(c)) / F.sum(room))
    return t.groupBy(*keys).agg(
        part("t").alias("binary_mean_clustering"), part("tw").alias("rank_mean_clustering"),
        ratio("t").alias("binary_transitivity"), ratio("tw").alias("rank_transitivity"),
    )


def assortativity(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Newman correlation of endpoint degree and of endpoint strength."""
    d = degrees(edges, keys)
    e = (
        edges.join(d.select(*keys, F.col("node").alias("i"), F.col("k").alias("ki"), F.col("s").alias("si")), [*keys, "i"])
        .join(d.select(*keys, F.col("node").alias("j"), F.col("k").alias("kj"), F.col("s").alias("sj")), [*keys, "j"])
    )

    def coef(a: str, b: str) -> Column:
        x, y = F.col(a).cast("double"), F.col(b).cast("double")
        t1, t2, t3 = F.avg(x * y), F.avg((x + y) / 2), F.avg((x * x + y * y) / 2)
        return F.when(F.abs(t3 - t2 * t2) > 1e-12, (t1 - t2 * t2) / (t3 - t2 * t2))

    return e.groupBy(*keys).agg(
        coef("ki", "kj").alias("binary_assortativity"), coef("si", "sj").alias("rank_assortativity")
    )


# -- local efficiency --------------------------------------------------------

def ego_edges(tri: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs inside each node's neighbourhood: ``keys, ego, i, j, w``."""
    one = lambda e, p, q, w: F.struct(
        F.col(e).alias("ego"), F.least(p, q).alias("i"), F.greatest(p, q).alias("j"), F.col(w).alias("w")
    )
    return tri.select(
        *keys, F.inline(F.array(one("a", "b", "c", "wbc"), one("b", "a", "c", "wac"), one("c", "a", "b", "wab")))
    )


def local_efficiency(edges: DataFrame, keys: list[str], n: int, tri: DataFrame | None = None) -> DataFrame:
    """Mean efficiency of neighbour subgraphs, by hops and by cube-root lengths.

    Hops are counted by bit sets and lengths kept in distance blocks inside each
    neighbourhood, so no table of pairs is made for any ego.
    """
    tri = triangles(edges, keys) if tri is None else tri
    ego = cut(ego_edges(tri, keys))
    ek = [*keys, "ego"]
    touched = adjacency(ego, ek).select(*ek, F.col("i").alias("node")).distinct()
    d = degrees(edges, keys).select(*keys, F.col("node").alias("ego"), "k")
    room = F.col("k") * (F.col("k") - 1)
    hops = hop_counts(ego, ek, touched).groupBy(*ek).agg(F.sum(F.col("pairs") / F.col("d")).alias("e"))
    spokes = adjacency(edges, keys).select(*keys, F.col("i").alias("ego"), F.col("j").alias("node"), F.cbrt("w").alias("c"))
    block, lane = lane_blocks(F.col("node"))
    sources = spokes.select(*ek, block.alias("block"), lane.alias("lane"), "c").groupBy(*ek, "block").agg(
        F.array(*[F.coalesce(F.max(F.when(F.col("lane") == k, F.col("c"))), F.lit(0.0)) for k in range(LANES)]).alias("cs")
    )
    far = distance_blocks(ego, ek, touched, F.cbrt(1 / F.col("w"))).join(spokes, [*ek, "node"]).join(sources, [*ek, "block"])
    shares = F.zip_with("cs", "d", lambda c, d: F.when(_reached(d), c / d).otherwise(0.0))
    far = far.groupBy(*ek).agg(F.sum(F.col("c") * _sum(shares, lambda x: x)).alias("we"))
    per = d.join(hops, ek, "left").join(far, ek, "left")
    mean = lambda c: F.sum(F.when(room > 0, F.coalesce(F.col(c), F.lit(0.0)) / room).otherwise(0.0)) / F.lit(n)
    return per.groupBy(*keys).agg(
        mean("e").alias("binary_mean_local_efficiency"), mean("we").alias("rank_mean_local_efficiency")
    )


# -- betweenness -------------------------------------------------------------

def betweenness(edges: DataFrame, blocks: DataFrame, keys: list[str], n: int, length: Column, prefix: str,
                node_table: DataFrame, rtol: float = 1e-12) -> DataFrame:
    """Mean and maximum normalised betweenness from distance blocks.

    The pairs on shortest paths form a directed acyclic graph for each source; a bit of
    a mask tells for each lane of a block whether a pair is on it.  Path counts flow
    forward along it and shares 1/count flow back, one step a round, a block of sources
    a row; rows grow with pairs times blocks.
    """
    bk = [*keys, "block"]
    adj = adjacency(edges.withColumn("len", length), keys, ["len"])
    step = blocks.select(*bk, F.col("node").alias("i"), F.col("d").alias("di")).join(adj, [*keys, "i"]).join(
        blocks.select(*bk, F.col("node").alias("j"), F.col("d").alias("dj")), [*bk, "j"]
    )
    on = F.transform(
        F.arrays_zip("di", "dj"),
        lambda x, k: F.when((x["dj"] < float("inf")) & (F.abs(x["di"] + F.col("len") - x["dj"]) <= rtol * F.greatest(x["dj"], F.lit(1.0))), F.call_function("shiftleft", F.lit(1).cast("long"), k)).otherwise(F.lit(0).cast("long")),
    )
    dag = cut(step.select(*bk, "i", "j", F.aggregate(on, F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x)).alias("mask")).filter("mask <> 0"))

    def flow(seed: DataFrame, frm: str, to: str) -> DataFrame:
        """Sum over all walks along the steps, one extra step per round."""
        parts, cur = [], cut(seed)
        while not cur.isEmpty():
            parts.append(cur)
            moved = cur.withColumnRenamed("node", frm).join(dag, [*bk, frm])
            lanes = [F.sum(F.when(F.getbit("mask", F.lit(k)) == 1, F.get("v", F.lit(k))).otherwise(0.0)) for k in range(LANES)]
            cur = cut(moved.groupBy(*bk, F.col(to).alias("node")).agg(F.array(*lanes).alias("v")).filter(F.exists("v", lambda x: x > 0)))
        total = [F.sum(F.get("v", F.lit(k))) for k in range(LANES)]
        return union_all(parts).groupBy(*bk, "node").agg(F.array(*total).alias("v"))

    block, lane = lane_blocks(F.col("node"))
    source = node_table.select(*keys, block.alias("block"), "node", _unit_lane(lane, F.lit(1.0), F.lit(0.0)).alias("v"))
    sigma = cut(flow(source, "i", "j"))
    own = F.when(F.col("block") == block, lane).otherwise(-1)
    share = sigma.select(*bk, "node", F.transform("v", lambda x, k: F.when((x > 0) & (k != own), 1 / x).otherwise(0.0)).alias("v"))
    back = flow(share, "j", "i").join(share.withColumnRenamed("v", "mine"), [*bk, "node"]).join(sigma.withColumnRenamed("v", "paths"), [*bk, "node"])
    through = F.transform(F.arrays_zip("v", "mine", "paths"), lambda x, k: F.when(k != own, (x["v"] - x["mine"]) * x["paths"]).otherwise(0.0))
    delta = back.groupBy(*keys, "node").agg(F.sum(_sum(through, lambda x: x)).alias("bc"))
    full = node_table.join(delta, [*keys, "node"], "left").fillna(0.0, ["bc"])
    unit = F.lit(float((n - 1) * (n - 2)))
    return full.groupBy(*keys).agg(
        (F.avg("bc") / unit).alias(f"{prefix}_mean_betweenness_normalized"),
        (F.max("bc") / unit).alias(f"{prefix}_max_betweenness_normalized"),
    )


# -- communities -------------------------------------------------------------

def modularity(edges: DataFrame, membership: DataFrame, keys: list[str]) -> DataFrame:
    """Newman modularity of a given partition ``keys, node, community``."""
    m = lambda c, o: membership.select(*keys, F.col("node").alias(c), F.col("community").alias(o))
    e = edges.join(m("i", "ci"), [*keys, "i"]).join(m("j", "cj"), [*keys, "j"])
    inside = e.filter("ci = cj").groupBy(*keys, F.col("ci").alias("community")).agg(F.sum("w").alias("win"))
    total = degrees(edges, keys).join(membership, [*keys, "node"]).groupBy(*keys, "community").agg(F.sum("s").alias("tot"))
    mass = edges.groupBy(*keys).agg(F.sum("w").alias("m"))
    c = total.join(inside, [*keys, "community"], "left").fillna(0.0, ["win"]).join(mass, keys)
    return c.groupBy(*keys).agg(
        F.sum(F.col("win") / F.col("m") - (F.col("tot") / (2 * F.col("m"))) ** 2).alias("modularity"),
        F.count(F.lit(1)).alias("n_communities"),
    )


#: Searches of which the best one counts.
SEEDS = 32


def _best_moves(adj: DataFrame, strength: DataFrame, mass: DataFrame, cur: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, node, own, to, gain``: where each node's modularity gain is largest, if it is positive."""
    owned = cur.join(strength, [*keys, "node"])
    tot = owned.groupBy(*keys, "community").agg(F.sum("s").alias("tot"))
    link = adj.join(cur.select(*keys, F.col("node").alias("j"), "community"), [*keys, "j"]).groupBy(*keys, F.col("i").alias("node"), "community").agg(F.sum("w").alias("into"))
    # staying is always a candidate, also without a neighbour inside
    stay = owned.select(*keys, "node", "community", F.lit(0.0).alias("into"))
    cand = link.unionByName(stay).groupBy(*keys, "node", "community").agg(F.sum("into").alias("into"))
    home = owned.select(*keys, "node", F.col("community").alias("own"), "s")
    scored = cand.join(home, [*keys, "node"]).join(tot, [*keys, "community"]).join(mass, [k for k in keys if k in mass.columns])
    rest = F.col("tot") - F.when(F.col("community") == F.col("own"), F.col("s")).otherwise(0.0)
    scored = scored.withColumn("score", (F.col("into") - F.col("s") * rest / F.col("m2")) / F.col("m2"))
    pick = scored.groupBy(*keys, "node").agg(
        F.max(F.struct("score", (-F.col("community")).alias("c"))).alias("b"), F.max("own").alias("own"), F.max(F.when(F.col("community") == F.col("own"), F.col("score"))).alias("at_home")
    )
    moves = pick.select(*keys, "node", "own", (-F.col("b.c")).alias("to"), (F.col("b.score") - F.col("at_home")).alias("gain"))
    return moves.filter((F.col("gain") > 1e-12) & (F.col("to") != F.col("own")))


def _moved(adj: DataFrame, strength: DataFrame, mass: DataFrame, cur: DataFrame, keys: list[str], turn: int) -> tuple[DataFrame, bool]:
    """One round of moves and whether there were any.

    Of the moves that touch a community only the one of largest drawn priority is made,
    so gains add up and modularity grows in every round that moves a node.
    """
    moves = cut(_best_moves(adj, strength, mass, cur, keys).withColumn("p", F.struct(F.xxhash64("node", "seed", F.lit(turn)).alias("h"), "node")))
    if moves.isEmpty():
        return cur, False
    touch = moves.select(*keys, "p", F.explode(F.array("own", "to")).alias("community")).groupBy(*keys, "community").agg(F.max("p").alias("top"))
    first = moves.join(touch.select(*keys, F.col("community").alias("own"), F.col("top").alias("p")), [*keys, "own", "p"], "left_semi")
    made = first.join(touch.select(*keys, F.col("community").alias("to"), F.col("top").alias("p")), [*keys, "to", "p"], "left_semi")
    now = cur.join(made.select(*keys, "node", "to"), [*keys, "node"], "left")
    return cut(now.select(*keys, "node", F.coalesce("to", "community").alias("community"))), True


def communities(edges: DataFrame, keys: list[str], node_table: DataFrame, seeds: int = SEEDS, coarse_rounds: int = 3, max_rounds: int = 1000) -> DataFrame:
    """Best of ``seeds`` multilevel modularity searches: ``keys, node, community, seed``.

    All searches run in one plan with the seed as a key.  A search moves nodes for a few
    rounds, contracts communities to nodes and goes on with the contracted graph while
    anything moves there; then single nodes move on the graph itself until no move
    gains.  That is repeated until neither a node nor a whole community can move.
    Modularity never falls.  Of equal results (1e-12) the one whose labels, numbered in
    order of the nodes, come first counts, then the smallest seed.  Isolated nodes stay
    alone.
    """
    sk = [*keys, "seed"]
    draw = F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))).alias("seed")
    flat = cut(adjacency(edges, keys))
    strength = degrees(edges, keys).select(*keys, "node", "s")
    mass = cut(edges.groupBy(*keys).agg((2 * F.sum("w")).alias("m2")))
    adj0, strength0 = cut(flat.select(*keys, draw, "i", "j", "w")), cut(strength.select(*keys, draw, "node", "s"))
    member = cut(node_table.select(*keys, draw, "node", F.col("node").alias("community")))
    turn = 0

    def contracted(adj: DataFrame, strength: DataFrame, cur: DataFrame) -> tuple[DataFrame, DataFrame]:
        name = lambda c, o: cur.select(*sk, F.col("node").alias(c), F.col("community").alias(o))
        ends = adj.join(name("i", "a"), [*sk, "i"]).join(name("j", "b"), [*sk, "j"]).filter("a <> b")
        small = ends.groupBy(*sk, F.col("a").alias("i"), F.col("b").alias("j")).agg(F.sum("w").alias("w"))
        return cut(small), cut(strength.join(cur, [*sk, "node"]).groupBy(*sk, F.col("community").alias("node")).agg(F.sum("s").alias("s")))

    adj, own = adj0, strength0
    for _ in range(max_rounds):
        while True:  # levels
            cur, any_moved = own.select(*sk, "node", F.col("node").alias("community")), False
            for _ in range(coarse_rounds):
                turn += 1
                cur, moved = _moved(adj, own, mass, cur, sk, turn)
                any_moved |= moved
                if not moved:
                    break
            if not any_moved:
                break
            up = cur.select(*sk, F.col("node").alias("community"), F.col("community").alias("_up"))
            member = cut(member.join(up, [*sk, "community"], "left").select(*sk, "node", F.coalesce("_up", "community").alias("community")))
            adj, own = contracted(adj, own, cur)
        refined, linked = False, member.join(strength0.select(*sk, "node"), [*sk, "node"], "left_semi")
        while True:
            turn += 1
            linked, moved = _moved(adj0, strength0, mass, linked, sk, turn)
            if not moved:
                break
            refined = True
        if not refined:
            break
        fresh = linked.withColumnRenamed("community", "_now")
        member = cut(member.join(fresh, [*sk, "node"], "left").select(*sk, "node", F.coalesce("_now", "community").alias("community")))
        adj, own = contracted(adj0, strength0, linked)
    else:
        raise RuntimeError("the community search did not settle")
    first = F.min("node").over(W.partitionBy(*sk, "community"))
    named = cut(member.withColumn("community", first))
    q = modularity(edges.join(named.select(*sk).distinct(), keys), named, sk)
    q = q.select(*sk, "modularity", F.max("modularity").over(W.partitionBy(*keys)).alias("top")).filter("modularity >= top - 1e-12")
    labels = named.join(q.select(*sk), sk, "left_semi").groupBy(*sk).agg(F.array_sort(F.collect_list(F.struct("node", "community"))).alias("v"))
    best = labels.groupBy(*keys).agg(F.min(F.struct(F.transform("v", lambda x: x["community"]).alias("l"), "seed")).alias("b")).select(*keys, F.col("b.seed").alias("seed"))
    return named.join(best, sk, "left_semi").select(*keys, "node", "community", "seed")


def gaining_moves(edges: DataFrame, membership: DataFrame, keys: list[str]) -> DataFrame:
    """Single moves ``keys, node, own, to, gain`` that would raise a partition's modularity."""
    mass = edges.groupBy(*keys).agg((2 * F.sum("w")).alias("m2"))
    strength = degrees(edges, keys).select(*keys, "node", "s")
    return _best_moves(adjacency(edges, keys), strength, mass, membership.select(*keys, "node", "community"), keys)


# -- changes between visits --------------------------------------------------

def edge_change(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Every pair present at either visit; undefined percentages stay null."""
    k = [*keys, "i", "j"]
    j = first.select(*k, F.col("w").alias("a")).join(second.select(*k, F.col("w").alias("b")), k, "full")
    a, b = F.coalesce("a", F.lit(0.0)), F.coalesce("b", F.lit(0.0))
    return j.filter((a != 0) | (b != 0)).select(
        *k, a.alias("post1"), b.alias("post2"), (b - a).alias("delta"),
        F.when(a > 0, 100 * (b - a) / a).alias("percent"),
    )


def node_change(first: DataFrame, second: DataFrame, keys: list[str], node_table: DataFrame) -> DataFrame:
    """Strength and degree of every node of the basis at two visits."""
    ends = lambda e, v: adjacency(e, keys).select(*keys, F.col("i").alias("node"), F.col("w"), F.lit(v).alias("v"))
    both = ends(first, 1).unionByName(ends(second, 2)).groupBy(*keys, "node").agg(
        F.sum(F.when(F.col("v") == 1, F.col("w")).otherwise(0.0)).alias("strength_post1"),
        F.sum(F.when(F.col("v") == 2, F.col("w")).otherwise(0.0)).alias("strength_post2"),
        F.count_if((F.col("v") == 1) & (F.col("w") != 0)).alias("degree_post1"),
        F.count_if((F.col("v") == 2) & (F.col("w") != 0)).alias("degree_post2"),
    )
    full = node_table.join(both, [*keys, "node"], "left").fillna(0)
    a, b = F.col("strength_post1"), F.col("strength_post2")
    return full.withColumn("strength_change", b - a).withColumn("strength_percent", F.when(a > 0, 100 * (b - a) / a))
