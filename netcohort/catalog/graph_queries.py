"""Registered graph queries: thresholds, distances, triangles, centrality, change."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import r6
from ..operators import graphs as G
from ..session import cut
from .fixtures import N_GRAPH, Tables
from .registry import query

KEYS = ["subject", "visit"]
CK = ["subject", "visit", "cost"]
N = N_GRAPH

# thresholded graph (all sessions and densities) shared by the oracles
KEPT = """ks AS (SELECT *, CAST(round_even(cost*1225,0) AS BIGINT) AS k FROM (VALUES (0.03::DOUBLE),(0.05::DOUBLE),(0.07::DOUBLE)) c(cost)),
kr AS (SELECT *, row_number() OVER (PARTITION BY subject,visit ORDER BY w DESC,i,j) AS rn FROM edges WHERE w>0),
kept AS (SELECT subject,visit,cost,i,j,w FROM kr JOIN ks ON rn<=k),
kw AS (SELECT subject,visit,cost,i,j,(rank() OVER p + (count(*) OVER (PARTITION BY subject,visit,cost,w)-1)/2.0)/count(*) OVER (PARTITION BY subject,visit,cost) AS w
  FROM kept WINDOW p AS (PARTITION BY subject,visit,cost ORDER BY w)),
adj AS (SELECT subject,visit,cost,i,j,w FROM kw UNION ALL SELECT subject,visit,cost,j,i,w FROM kw),
sess AS (SELECT DISTINCT subject,visit,cost FROM kept),
nd AS (SELECT subject,visit,cost,node FROM sess, (SELECT unnest(range(50)) AS node)),
deg AS (SELECT subject,visit,cost,i AS node,count(*) AS k,sum(w) AS s FROM adj GROUP BY ALL),"""
HOPS = """bfs AS (SELECT subject,visit,cost,node AS src,node AS dst,0 AS d FROM nd
  UNION SELECT b.subject,b.visit,b.cost,src,j,d+1 FROM bfs b JOIN adj a ON a.subject=b.subject AND a.visit=b.visit AND a.cost=b.cost AND a.i=b.dst WHERE d<16),
hop AS (SELECT subject,visit,cost,src,dst,min(d) AS d FROM bfs GROUP BY ALL),"""
# reachability through hop gives components: the root is the smallest reachable node
COMP = """comp AS (SELECT subject,visit,cost,src AS node,min(dst) AS root FROM hop GROUP BY ALL),
csz AS (SELECT subject,visit,cost,root,count(*) AS size FROM comp GROUP BY ALL),
cb AS (SELECT *, row_number() OVER (PARTITION BY subject,visit,cost ORDER BY size DESC, root) AS o FROM csz),
lcc AS (SELECT c.subject,c.visit,c.cost,c.node,size FROM comp c JOIN cb USING (subject,visit,cost,root) WHERE o=1),"""
# Bellman-Ford keyed on the hop bound; 50 nodes settle long before 18 hops
WDIST = """wd AS (SELECT subject,visit,cost,node AS src,node AS dst,0.0::DOUBLE AS d,0 AS h FROM nd
  UNION ALL (SELECT subject,visit,cost,src,dst,min(d) AS d,max(h) AS h FROM (
    SELECT b.subject,b.visit,b.cost,b.src,a.j AS dst,b.d+1/a.w AS d,b.h+1 AS h FROM wd b JOIN adj a ON a.subject=b.subject AND a.visit=b.visit AND a.cost=b.cost AND a.i=b.dst WHERE h<18
    ) GROUP BY subject,visit,cost,src,dst)),
wdist AS (SELECT subject,visit,cost,src,dst,min(d) AS d FROM wd GROUP BY ALL),"""
TRI = """tri AS (SELECT x.subject,x.visit,x.cost,x.i AS a,x.j AS b,y.j AS c,x.w AS wab,y.w AS wac,z.w AS wbc FROM kw x
  JOIN kw y ON x.subject=y.subject AND x.visit=y.visit AND x.cost=y.cost AND x.i=y.i AND x.j<y.j
  JOIN kw z ON x.subject=z.subject AND x.visit=z.visit AND x.cost=z.cost AND z.i=x.j AND z.j=y.j),
tn AS (SELECT subject,visit,cost,node,count(*) AS t,sum(cbrt(wab*wac*wbc)) AS tw FROM (
  SELECT *,a AS node FROM tri UNION ALL SELECT *,b FROM tri UNION ALL SELECT *,c FROM tri) GROUP BY ALL),"""


def kept(t: Tables, weighted: bool = True):
    k = G.fixed_cost(cut(t.edges()), KEYS, N)
    return G.rank_weights(k, CK) if weighted else k


class Base:
    """Written threshold graph and basis of one query, with what it asks for beside them."""

    def __init__(self, t: Tables):
        self.w = cut(kept(t))
        self.nodes = cut(G.session_nodes(self.w, CK, t.nodes()))
        self._hop = self._dist = self._tri = self._lcc = None

    def hop(self):
        if self._hop is None:
            self._hop = G.distance_blocks(self.w, CK, self.nodes, F.lit(1.0))
        return self._hop

    def dist(self):
        if self._dist is None:
            self._dist = G.distance_blocks(self.w, CK, self.nodes)
        return self._dist

    def tri(self):
        if self._tri is None:
            self._tri = cut(G.triangles(self.w, CK))
        return self._tri

    def lcc(self):
        if self._lcc is None:
            self._lcc = cut(G.largest_component(self.w, CK, self.nodes))
        return self._lcc


def with_triangles(t: Tables, measure):
    b = Base(t)
    return measure(b.w, CK, N, b.tri())


def rounded(df, keys, digits=6):
    return df.select(*keys, *[r6(c, digits).alias(c) if df.schema[c].dataType.simpleString() == "double" else F.col(c)
                              for c in df.columns if c not in keys])


@query("G1_fixed_cost", "edges", "WITH " + KEPT + " z AS (SELECT 1) SELECT subject,visit,cost,i,j,w FROM kept")
def g1(t):
    return kept(t, False)


@query("G2_rank_weights", "edges", "WITH " + KEPT + " z AS (SELECT 1) SELECT subject,visit,cost,i,j,round(w,6) AS w FROM kw")
def g2(t):
    return rounded(kept(t), CK)


@query("G3_raw_totals", "edges", """SELECT subject,visit,round(sum(w),2) AS total_edge_weight,
 round(count(*) FILTER (w>0)/1225.0,6) AS raw_positive_edge_density FROM edges GROUP BY 1,2""")
def g3(t):
    d = G.raw_totals(t.edges(), KEYS, N)
    return d.select(*KEYS, F.round("total_edge_weight", 2).alias("total_edge_weight"), r6("raw_positive_edge_density").alias("raw_positive_edge_density"))


@query("P40_edge_density", "edges", """SELECT round(100.0*count(*)/(count(DISTINCT subject||visit)*1225),6) AS density_all,
 round(100.0*count(*) FILTER (visit=0)/(count(DISTINCT subject||visit) FILTER (visit=0)*1225),6) AS density_pre FROM edges WHERE w>0""")
def p40(t):
    d = G.edge_density(t.edges(), N)
    return d.select(*[r6(c).alias(c) for c in d.columns])


@query("G4_largest_component", "edges", "WITH " + KEPT + HOPS + COMP + """ z AS (SELECT 1)
 SELECT subject,visit,cost,node,round(size/50.0,6) AS fraction FROM lcc""")
def g4(t):
    b = Base(t)
    return b.lcc().select(*CK, "node", r6(F.col("size") / F.col("n")).alias("fraction"))


@query("G5_hop_distances", "edges", "WITH " + KEPT + HOPS + " z AS (SELECT 1) SELECT subject,visit,cost,src,dst,d FROM hop")
def g5(t):
    b = Base(t)
    d = G.hop_distances(b.w, CK, b.nodes)
    return d.withColumn("src", F.col("src").cast("long")).withColumn("dst", F.col("dst").cast("long"))


@query("G6_weighted_distances", "edges", "WITH " + KEPT + WDIST + " z AS (SELECT 1) SELECT subject,visit,cost,src,dst,round(d,6) AS d FROM wdist")
def g6(t):
    b = Base(t)
    d = G.weighted_distances(b.w, CK, b.nodes)
    return d.select(*CK, F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), r6("d").alias("d"))


@query("G7_binary_global_efficiency", "edges", "WITH " + KEPT + HOPS + """ z AS (SELECT 1)
 SELECT subject,visit,cost,round(sum(CASE WHEN d>0 THEN 1.0/d ELSE 0 END)/2450,6) AS binary_global_efficiency FROM hop GROUP BY 1,2,3""")
def g7(t):
    b = Base(t)
    return rounded(G.hop_efficiency(G.hop_counts(b.w, CK, b.nodes), CK, N, "binary_global_efficiency"), CK)


@query("G8_rank_global_efficiency", "edges", "WITH " + KEPT + WDIST + """ z AS (SELECT 1)
 SELECT subject,visit,cost,round(sum(CASE WHEN d>0 THEN 1.0/d ELSE 0 END)/2450,6) AS rank_global_efficiency FROM wdist GROUP BY 1,2,3""")
def g8(t):
    b = Base(t)
    return rounded(G.global_efficiency(b.dist(), CK, N, "rank_global_efficiency"), CK)


@query("G9_characteristic_path_lcc", "edges", "WITH " + KEPT + HOPS + COMP + WDIST + """ z AS (SELECT 1)
 SELECT subject,visit,cost,round(b,6) AS binary_characteristic_path_lcc,round(r,6) AS rank_characteristic_path_lcc FROM
 (SELECT h.subject,h.visit,h.cost,avg(d) AS b FROM hop h JOIN lcc l ON l.subject=h.subject AND l.visit=h.visit AND l.cost=h.cost AND l.node=h.src WHERE src<>dst GROUP BY 1,2,3)
 JOIN (SELECT h.subject,h.visit,h.cost,avg(d) AS r FROM wdist h JOIN lcc l ON l.subject=h.subject AND l.visit=h.visit AND l.cost=h.cost AND l.node=h.src WHERE src<>dst GROUP BY 1,2,3) USING (subject,visit,cost)""")
def g9(t):
    b = Base(t)
    lcc = b.lcc()
    x = G.characteristic_path(b.hop(), lcc, CK, "binary_characteristic_path_lcc")
    y = G.characteristic_path(b.dist(), lcc, CK, "rank_characteristic_path_lcc")
    return rounded(x.join(y, CK), CK)


CLUST = "WITH " + KEPT + TRI + """ cl AS (SELECT subject,visit,cost,
  sum(CASE WHEN k>1 THEN 2.0*coalesce(t,0)/(k*(k-1)) ELSE 0 END)/50 AS bc, sum(CASE WHEN k>1 THEN 2.0*coalesce(tw,0)/(k*(k-1)) ELSE 0 END)/50 AS rc,
  sum(2.0*coalesce(t,0))/sum(k*(k-1)) AS bt, sum(2.0*coalesce(tw,0))/sum(k*(k-1)) AS rt
  FROM deg LEFT JOIN tn USING (subject,visit,cost,node) GROUP BY 1,2,3) SELECT subject,visit,cost,"""


@query("G10_binary_mean_clustering", "edges", CLUST + "round(bc,6) AS binary_mean_clustering FROM cl")
def g10(t):
    return rounded(with_triangles(t, G.clustering).select(*CK, "binary_mean_clustering"), CK)


@query("G11_rank_mean_clustering", "edges", CLUST + "round(rc,6) AS rank_mean_clustering FROM cl")
def g11(t):
    return rounded(with_triangles(t, G.clustering).select(*CK, "rank_mean_clustering"), CK)


@query("G12_transitivity", "edges", CLUST + "round(bt,6) AS binary_transitivity, round(rt,6) AS rank_transitivity FROM cl")
def g12(t):
    return rounded(with_triangles(t, G.clustering).select(*CK, "binary_transitivity", "rank_transitivity"), CK)


@query("G13_assortativity", "edges", "WITH " + KEPT + """ m AS (SELECT e.subject,e.visit,e.cost,
  avg(a.k*b.k) AS t1, avg((a.k+b.k)/2.0) AS t2, avg((a.k*a.k+b.k*b.k)/2.0) AS t3, avg(a.s*b.s) AS u1, avg((a.s+b.s)/2.0) AS u2, avg((a.s*a.s+b.s*b.s)/2.0) AS u3
  FROM kw e JOIN deg a ON a.subject=e.subject AND a.visit=e.visit AND a.cost=e.cost AND a.node=e.i JOIN deg b ON b.subject=e.subject AND b.visit=e.visit AND b.cost=e.cost AND b.node=e.j GROUP BY 1,2,3)
  SELECT subject,visit,cost, round((t1-t2*t2)/(t3-t2*t2),6)+0.0 AS binary_assortativity, round((u1-u2*u2)/(u3-u2*u2),6)+0.0 AS rank_assortativity FROM m""")
def g13(t):
    return rounded(G.assortativity(Base(t).w, CK), CK)


EGO = """ego AS (SELECT subject,visit,cost,a AS ego,b AS i,c AS j,wbc AS w FROM tri UNION ALL SELECT subject,visit,cost,b,a,c,wac FROM tri UNION ALL SELECT subject,visit,cost,c,a,b,wab FROM tri),
ea AS (SELECT * FROM ego UNION ALL SELECT subject,visit,cost,ego,j,i,w FROM ego),
en AS (SELECT DISTINCT subject,visit,cost,ego,i AS node FROM ea),"""


@query("G14_binary_mean_local_efficiency", "edges", "WITH " + KEPT + TRI + EGO + """ eb AS (SELECT subject,visit,cost,ego,node AS src,node AS dst,0 AS d FROM en
  UNION SELECT b.subject,b.visit,b.cost,b.ego,src,a.j,d+1 FROM eb b JOIN ea a ON a.subject=b.subject AND a.visit=b.visit AND a.cost=b.cost AND a.ego=b.ego AND a.i=b.dst WHERE d<12),
  eh AS (SELECT subject,visit,cost,ego,src,dst,min(d) AS d FROM eb GROUP BY ALL),
  es AS (SELECT subject,visit,cost,ego AS node,sum(1.0/d) AS e FROM eh WHERE d>0 GROUP BY ALL)
  SELECT subject,visit,cost,round(sum(CASE WHEN k>1 THEN coalesce(e,0)/(k*(k-1)) ELSE 0 END)/50,6) AS binary_mean_local_efficiency
  FROM deg LEFT JOIN es USING (subject,visit,cost,node) GROUP BY 1,2,3""")
def g14(t):
    return rounded(with_triangles(t, G.local_efficiency).select(*CK, "binary_mean_local_efficiency"), CK)


@query("G15_rank_mean_local_efficiency", "edges", "WITH " + KEPT + TRI + EGO + """ ew AS (SELECT subject,visit,cost,ego,node AS src,node AS dst,0.0::DOUBLE AS d,0 AS h FROM en
  UNION ALL (SELECT subject,visit,cost,ego,src,dst,min(d),max(h) FROM (SELECT b.subject,b.visit,b.cost,b.ego,b.src,a.j AS dst,b.d+cbrt(1/a.w) AS d,b.h+1 AS h
   FROM ew b JOIN ea a ON a.subject=b.subject AND a.visit=b.visit AND a.cost=b.cost AND a.ego=b.ego AND a.i=b.dst WHERE h<12) GROUP BY 1,2,3,4,5,6)),
  eh AS (SELECT subject,visit,cost,ego,src,dst,min(d) AS d FROM ew GROUP BY ALL),
  es AS (SELECT e.subject,e.visit,e.cost,e.ego AS node,sum(cbrt(p.w)*cbrt(q.w)/d) AS e FROM eh e
   JOIN adj p ON p.subject=e.subject AND p.visit=e.visit AND p.cost=e.cost AND p.i=e.ego AND p.j=e.src
   JOIN adj q ON q.subject=e.subject AND q.visit=e.visit AND q.cost=e.cost AND q.i=e.ego AND q.j=e.dst WHERE d>0 GROUP BY ALL)
  SELECT subject,visit,cost,round(sum(CASE WHEN k>1 THEN coalesce(e,0)/(k*(k-1)) ELSE 0 END)/50,6) AS rank_mean_local_efficiency
  FROM deg LEFT JOIN es USING (subject,visit,cost,node) GROUP BY 1,2,3""")
def g15(t):
    return rounded(with_triangles(t, G.local_efficiency).select(*CK, "rank_mean_local_efficiency"), CK)


def bsql(dist: str, length: str, prefix: str, rounds: int) -> str:
    return f""" dag AS (SELECT a.subject,a.visit,a.cost,a.src,e.i,e.j FROM {dist} a JOIN adj e ON e.subject=a.subject AND e.visit=a.visit AND e.cost=a.cost AND e.i=a.dst
   JOIN {dist} b ON b.subject=a.subject AND b.visit=a.visit AND b.cost=a.cost AND b.src=a.src AND b.dst=e.j WHERE abs(a.d+{length}-b.d)<=1e-12*greatest(b.d,1)),
 fw AS (SELECT subject,visit,cost,node AS src,node,1.0::DOUBLE AS v,0 AS h FROM nd UNION ALL
   (SELECT subject,visit,cost,src,node,sum(v),max(h) FROM (SELECT f.subject,f.visit,f.cost,f.src,g.j AS node,f.v,f.h+1 AS h FROM fw f JOIN dag g ON g.subject=f.subject AND g.visit=f.visit AND g.cost=f.cost AND g.src=f.src AND g.i=f.node) GROUP BY 1,2,3,4,5)),
 sg AS (SELECT subject,visit,cost,src,node,sum(v) AS s FROM fw GROUP BY ALL),
 bw AS (SELECT subject,visit,cost,src,node,1/s AS v,0 AS h FROM sg WHERE src<>node UNION ALL
   (SELECT subject,visit,cost,src,node,sum(v),max(h) FROM (SELECT f.subject,f.visit,f.cost,f.src,g.i AS node,f.v,f.h+1 AS h FROM bw f JOIN dag g ON g.subject=f.subject AND g.visit=f.visit AND g.cost=f.cost AND g.src=f.src AND g.j=f.node) GROUP BY 1,2,3,4,5)),
 dl AS (SELECT b.subject,b.visit,b.cost,b.node,sum(b.x*s) AS bc FROM (SELECT subject,visit,cost,src,node,sum(v) AS x FROM bw WHERE h>0 AND src<>node GROUP BY ALL) b JOIN sg USING (subject,visit,cost,src,node) GROUP BY 1,2,3,4)
 SELECT subject,visit,cost,round(avg(coalesce(bc,0))/2352,6)+0.0 AS {prefix}_mean_betweenness_normalized, round(max(coalesce(bc,0))/2352,6)+0.0 AS {prefix}_max_betweenness_normalized
 FROM nd LEFT JOIN dl USING (subject,visit,cost,node) GROUP BY 1,2,3"""


@query("G16_binary_betweenness", "edges", "WITH " + KEPT + HOPS + bsql("hop", "1", "binary", 12))
def g16(t):
    b = Base(t)
    return rounded(G.betweenness(b.w, b.hop(), CK, N, F.lit(1.0), "binary", b.nodes), CK)


@query("G17_rank_betweenness", "edges", "WITH " + KEPT + WDIST + bsql("wdist", "1/e.w", "rank", 18))
def g17(t):
    b = Base(t)
    return rounded(G.betweenness(b.w, b.dist(), CK, N, 1 / F.col("w"), "rank", b.nodes), CK)


NETWORK_Q = """ mem AS (SELECT subject,visit,cost,node,network AS c FROM nd JOIN nodes ON idx=node),
 ms AS (SELECT subject,visit,cost,sum(w) AS m FROM kw GROUP BY ALL),
 tt AS (SELECT subject,visit,cost,c,sum(s) AS tot FROM deg JOIN mem USING (subject,visit,cost,node) GROUP BY ALL),
 wi AS (SELECT e.subject,e.visit,e.cost,a.c,sum(e.w) AS win FROM kw e JOIN mem a ON a.subject=e.subject AND a.visit=e.visit AND a.cost=e.cost AND a.node=e.i
   JOIN mem b ON b.subject=e.subject AND b.visit=e.visit AND b.cost=e.cost AND b.node=e.j WHERE a.c=b.c GROUP BY ALL), z AS (SELECT 1)"""


def networks(b: Base, t: Tables):
    return b.nodes.join(F.broadcast(t.nodes().select(F.col("idx").alias("node"), F.col("network").alias("community"))), "node")


@query("G18_modularity_of_networks", "edges nodes", "WITH " + KEPT + NETWORK_Q + """
 SELECT subject,visit,cost,round(sum(coalesce(win,0)/m-(tot/(2*m))**2),6)+0.0 AS modularity, count(*) AS n_communities
 FROM tt LEFT JOIN wi USING (subject,visit,cost,c) JOIN ms USING (subject,visit,cost) GROUP BY 1,2,3""")
def g18(t):
    b = Base(t)
    return rounded(G.modularity(b.w, networks(b, t), CK), CK)


@query("G18_community_search", "edges nodes", "WITH " + KEPT + NETWORK_Q + """
 SELECT subject,visit,cost,50::BIGINT AS nodes,true AS least_label,true AS at_least_networks,true AS beats_one_community,0::BIGINT AS gaining_moves FROM sess""")
def g18s(t):
    """Invariants of the best of 32 searches: no node can move, and it beats the given partition."""
    b = Base(t)
    mem = cut(G.communities(b.w, CK, b.nodes))
    given = G.modularity(b.w, networks(b, t), CK).select(*CK, F.col("modularity").alias("given"))
    moves = G.gaining_moves(b.w, mem, CK).groupBy(*CK).agg(F.count(F.lit(1)).alias("gaining_moves"))
    found = G.modularity(b.w, mem, CK).join(given, CK).join(moves, CK, "left")
    least = mem.groupBy(*CK, "community").agg(F.min("node").alias("m"), F.count(F.lit(1)).alias("c"))
    shape = least.groupBy(*CK).agg(F.sum("c").alias("nodes"), F.bool_and(F.col("m") == F.col("community")).alias("least_label"))
    return found.join(shape, CK).select(
        *CK, "nodes", "least_label", (F.col("modularity") >= F.col("given")).alias("at_least_networks"), (F.col("modularity") > 0).alias("beats_one_community"), F.coalesce("gaining_moves", F.lit(0)).alias("gaining_moves")
    )


@query("G19_cost_mean", "edges", "WITH " + KEPT + TRI + """ cl AS (SELECT subject,visit,cost, sum(CASE WHEN k>1 THEN 2.0*coalesce(t,0)/(k*(k-1)) ELSE 0 END)/50 AS bc,
  sum(CASE WHEN k>1 THEN 2.0*coalesce(tw,0)/(k*(k-1)) ELSE 0 END)/50 AS rc, sum(2.0*coalesce(t,0))/sum(k*(k-1)) AS bt, sum(2.0*coalesce(tw,0))/sum(k*(k-1)) AS rt
  FROM deg LEFT JOIN tn USING (subject,visit,cost,node) GROUP BY 1,2,3),
  lg AS (UNPIVOT (SELECT subject,visit,cost,bc AS binary_mean_clustering,rc AS rank_mean_clustering,bt AS binary_transitivity,rt AS rank_transitivity FROM cl) ON binary_mean_clustering,rank_mean_clustering,binary_transitivity,rank_transitivity INTO NAME metric VALUE value)
  SELECT subject,visit,metric||'_cost_mean' AS metric,round(avg(value),6) AS value FROM lg GROUP BY 1,2,3""")
def g19(t):
    from ..plans.graph_study import cost_mean, long_metrics

    return rounded(cost_mean(long_metrics(with_triangles(t, G.clustering), CK), KEYS), [*KEYS, "metric"])


@query("G20_node_change", "edges nodes", """WITH v AS (SELECT subject,visit,i AS node,w FROM edges UNION ALL SELECT subject,visit,j,w FROM edges),
 s AS (SELECT DISTINCT subject FROM edges WHERE visit=1),
 a AS (SELECT s.subject, idx AS node, name, network, hemi, coalesce(sum(w) FILTER (visit=1),0) AS s1, coalesce(sum(w) FILTER (visit=2),0) AS s2,
  count(*) FILTER (visit=1 AND w<>0) AS degree_post1, count(*) FILTER (visit=2 AND w<>0) AS degree_post2 FROM s CROSS JOIN nodes n LEFT JOIN v ON v.subject=s.subject AND v.node=n.idx GROUP BY ALL)
 SELECT subject,node,name,network,hemi,round(s1,2) AS strength_post1,round(s2,2) AS strength_post2,round(s2-s1,2) AS strength_change,
  CASE WHEN s1>0 THEN round(100*(s2-s1)/s1,6) END AS strength_percent,degree_post1,degree_post2 FROM a""")
def g20(t):
    e = t.edges()
    first, second = e.filter("visit = 1"), e.filter("visit = 2")
    nt = G.session_nodes(first, ["subject"], t.nodes())
    d = G.node_change(first, second, ["subject"], nt)
    d = d.join(F.broadcast(t.nodes().select(F.col("idx").alias("node"), "name", "network", "hemi")), "node")
    return d.select(
        "subject", "node", "name", "network", "hemi", *[F.round(c, 2).alias(c) for c in ("strength_post1", "strength_post2", "strength_change")],
        r6("strength_percent").alias("strength_percent"), "degree_post1", "degree_post2",
    )


@query("G21_edge_change", "edges", """SELECT coalesce(a.subject,b.subject) AS subject,coalesce(a.i,b.i) AS i,coalesce(a.j,b.j) AS j,coalesce(a.w,0) AS post1,coalesce(b.w,0) AS post2,
 round(coalesce(b.w,0)-coalesce(a.w,0),2) AS delta, CASE WHEN a.w>0 THEN round(100*(coalesce(b.w,0)-a.w)/a.w,6) END AS percent
 FROM (SELECT * FROM edges WHERE visit=1) a FULL JOIN (SELECT * FROM edges WHERE visit=2) b ON a.subject=b.subject AND a.i=b.i AND a.j=b.j
 WHERE coalesce(a.w,0)<>0 OR coalesce(b.w,0)<>0""")
def g21(t):
    e = t.edges()
    d = G.edge_change(e.filter("visit = 1"), e.filter("visit = 2"), ["subject"])
    return d.select("subject", "i", "j", "post1", "post2", F.round("delta", 2).alias("delta"), r6("percent").alias("percent"))
