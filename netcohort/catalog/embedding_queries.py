"""Registered embedding queries over the fifty-node session graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import AXES, r6
from ..operators import embedding as E
from ..operators import geometry as M
from ..session import cut
from .fixtures import Tables
from .geometry_queries import END, coords, out
from .registry import query

S = ["subject", "visit"]
SH = ["subject", "visit", "hemi"]
SLICE = """hx AS (SELECT e.subject,e.visit,a.hemi,e.i,e.j,e.w FROM edges e JOIN nodes a ON a.idx=e.i JOIN nodes b ON b.idx=e.j WHERE a.tissue='cortex' AND b.tissue='cortex' AND a.hemi=b.hemi),"""


def sliced(t: Tables):
    return cut(E.hemisphere_slice(t.edges(), t.nodes()))


@query("E1_hemisphere_slice", "edges nodes", "WITH " + SLICE + END + "SELECT subject,visit,hemi,i,j,w FROM hx")
def e1(t):
    return E.hemisphere_slice(t.edges(), t.nodes())


@query("E2_log1p_weights", "edges", "SELECT subject,visit,i,j,round(ln(1+w),6) AS w FROM edges")
def e2(t):
    return t.edges().withColumn("w", r6(F.log1p("w")))


KEEP = SLICE + """hd AS (SELECT subject,visit,hemi,i,j,ln(1+w) AS w FROM hx UNION ALL SELECT subject,visit,hemi,j,i,ln(1+w) FROM hx),
 sp AS (SELECT * FROM hd QUALIFY row_number() OVER (PARTITION BY subject,visit,hemi,i ORDER BY w DESC,j)<=5),"""
ANGLE = KEEP + """ ln2 AS (SELECT subject,visit,hemi,i,sqrt(sum(w*w)) AS l FROM sp GROUP BY ALL),
 un AS (SELECT subject,visit,hemi,i,j,w/l AS u FROM sp JOIN ln2 USING (subject,visit,hemi,i)),
 dt AS (SELECT a.subject,a.visit,a.hemi,a.i,b.i AS j,sum(a.u*b.u) AS d FROM un a JOIN un b ON a.subject=b.subject AND a.visit=b.visit AND a.hemi=b.hemi AND a.j=b.j AND a.i<>b.i GROUP BY ALL),
 kx AS (SELECT subject,visit,hemi,i,j,.5-acos(greatest(-1,least(1,d)))/3.141592653589793 AS e FROM dt UNION ALL SELECT subject,visit,hemi,i,i,.5 FROM ln2),"""


def rows(t: Tables):
    e = sliced(t).withColumn("w", F.log1p("w")).join(F.broadcast(E.hemisphere_sizes(t.nodes())), "hemi")
    return E.row_sparsify(e, SH, E.kept_per_row(F.col("nodes"), F.lit(0.75))).drop("nodes")


@query("E3_row_sparsify", "edges nodes", "WITH " + KEEP + END + "SELECT subject,visit,hemi,i,j,round(w,6) AS w FROM sp")
def e3(t):
    return out(rows(t), [*SH, "i", "j"])


@query("E4_normalized_angle", "edges nodes", "WITH " + ANGLE + END + "SELECT subject,visit,hemi,i,j,round(.5+e,6) AS affinity FROM kx")
def e4(t):
    k = E.normalized_angle(rows(t), SH)
    return k.select(*SH, "i", "j", r6(F.col("e") + 0.5).alias("affinity"))


@query("E5_diffusion_operator", "edges nodes", "WITH " + ANGLE + """ dg AS (SELECT subject,visit,hemi,i,pow(.5*count(*) OVER (PARTITION BY subject,visit,hemi)+es,-.05) AS a FROM (SELECT subject,visit,hemi,i,sum(e) AS es FROM kx GROUP BY ALL)),
 dr AS (SELECT k.subject,k.visit,k.hemi,k.i,sum(e*g.a) AS ea FROM kx k JOIN dg g ON g.subject=k.subject AND g.visit=k.visit AND g.hemi=k.hemi AND g.i=k.j GROUP BY ALL),
 tt AS (SELECT subject,visit,hemi,sum(a) AS t FROM dg GROUP BY ALL)
 SELECT subject,visit,hemi,g.i AS node,round(a/sqrt(a*(.5*t+ea)),6) AS s FROM dg g JOIN dr USING (subject,visit,hemi,i) JOIN tt USING (subject,visit,hemi)""")
def e5(t):
    k = cut(E.normalized_angle(rows(t), SH))
    return out(E.diffusion_scale(k, SH, F.lit(0.05)), [*SH, "node"])


@query("E6_top_eigen", "edges nodes", """SELECT subject,visit,hemi,count(*) AS nodes,true AS settled,true AS orthonormal,true AS ordered,true AS trivial_first
 FROM (SELECT DISTINCT subject,visit FROM edges), nodes WHERE tissue='cortex' AND hemi IN ('L','R') GROUP BY ALL""")
def e6(t):
    """Invariants of the leading eigenpairs of every session and hemisphere."""
    k = cut(E.normalized_angle(rows(t), SH))
    s = cut(E.diffusion_scale(k, SH, F.lit(0.05)))
    eig = E.top_eigen(k, s, SH)
    falls = F.forall(F.sequence(F.lit(1), F.size("l") - 1), lambda i: F.get("l", i - 1) >= F.get("l", i))
    values = eig.groupBy(*SH).agg(F.first("l").alias("l")).select(*SH, falls.alias("ordered"), (F.abs(F.get("l", F.lit(0)) - 1) < 1e-9).alias("trivial_first"))
    r = E.residual(eig, k, s, SH).join(values, SH)
    return r.select(*SH, "nodes", (F.col("residual") < 1e-9).alias("settled"), (F.col("overlap") < 1e-9).alias("orthonormal"), "ordered", "trivial_first")


@query("E7_procrustes")
def e7(t):
    c = coords(t).select(*SH, F.col("parcel").alias("node"), F.array(*AXES).alias("g"))
    ref = c.filter("visit = 0")
    return E.procrustes(c, ref, SH, ["subject", "hemi"], 4)


@query("E8_isolated_profiles", "edges nodes", "WITH " + SLICE.replace("FROM edges e", "FROM (SELECT * FROM edges WHERE w>450000) e") + """ en AS (SELECT DISTINCT subject,visit,hemi,i AS node FROM hx UNION SELECT DISTINCT subject,visit,hemi,j FROM hx)
 SELECT s.subject,s.visit,n.hemi,n.idx AS node FROM (SELECT DISTINCT subject,visit FROM edges WHERE w>450000) s CROSS JOIN (SELECT * FROM nodes WHERE tissue='cortex') n LEFT JOIN en ON en.subject=s.subject AND en.visit=s.visit AND en.node=n.idx WHERE en.node IS NULL""")
def e8(t):
    return E.isolated_profiles(cut(t.edges().filter("w > 450000")), t.nodes(), S)


@query("E9_common_reference", "edges", "SELECT i,j,round(sum(w)/6,4) AS w FROM edges WHERE visit=0 GROUP BY 1,2")
def e9(t):
    d = E.mean_network(t.edges().filter("visit = 0"), 6)
    return d.select("i", "j", F.round("w", 4).alias("w"))


@query("E10_loso_reference", "edges", "WITH b AS (SELECT * FROM edges WHERE visit=0),s AS (SELECT DISTINCT subject FROM b) SELECT s.subject AS held,i,j,round(sum(w)/5,4) AS w FROM b JOIN s ON s.subject<>b.subject GROUP BY 1,2,3")
def e10(t):
    e = cut(t.edges().filter("visit = 0"))
    d = E.loso_mean(e, e.select("subject").distinct())
    return d.select("held", "i", "j", F.round("w", 4).alias("w"))


def subjects(t: Tables):
    return t.sides().select("subject")


@query("E11_cohort_embeddings")
def e11(t):
    g, lam = E.cohort_embeddings(cut(t.edges()), t.nodes(), subjects(t), "common")
    return E.as_coords(g, t.nodes())


@query("E12_member_mean", "edges", "SELECT i,j,round(sum(w)/18,4) AS w,18::BIGINT AS m FROM edges GROUP BY 1,2")
def e12(t):
    d = E.member_mean(t.edges().withColumn("member", F.concat_ws("-", "subject", "visit")))
    return d.select("i", "j", F.round("w", 4).alias("w"), "m")


def axis_long(c, order):
    return c.select("subject", "visit", "parcel", F.posexplode(F.array(*order)).alias("axis", "value"))


AXC = "WITH a AS (SELECT subject,visit,parcel,unnest([0,1,2,3]) AS source,unnest([g3+.1*g1,g1,g4,g2-.2*g4]) AS x FROM coords),b AS (SELECT subject,visit,parcel,unnest([0,1,2,3]) AS target,unnest([g1,g2,g3,g4]) AS y FROM coords),c AS (SELECT source,target,corr(x,y) AS r FROM a JOIN b USING (subject,visit,parcel) GROUP BY 1,2),"


@query("E14_match_axes", "coords", AXC + """ pl AS (SELECT a.source AS s0,b.source AS s1,c2.source AS s2,d.source AS s3,abs(a.r)+abs(b.r)+abs(c2.r)+abs(d.r) AS v FROM c a JOIN c b ON a.target=0 AND b.target=1 AND a.source<>b.source JOIN c c2 ON c2.target=2 AND c2.source NOT IN (a.source,b.source) JOIN c d ON d.target=3 AND d.source NOT IN (a.source,b.source,c2.source)),
 bs AS (SELECT * FROM pl ORDER BY v DESC LIMIT 1), pk AS (SELECT unnest([0,1,2,3]) AS target,unnest([s0,s1,s2,s3]) AS source FROM bs) SELECT target,source,round(r,6)+0.0 AS r FROM pk JOIN c USING (target,source)""")
def e14(t):
    c = coords(t)
    v = axis_long(c, [F.col("g3") + 0.1 * F.col("g1"), F.col("g1"), F.col("g4"), F.col("g2") - 0.2 * F.col("g4")])
    corr = cut(E.axis_correlations(v, axis_long(c, AXES), ["subject", "visit", "parcel"]))
    return out(E.match_axes(corr, 4), ["target", "source"])


@query("E15_gradient_export", "coords nodes", "SELECT subject,visit,c.hemi,c.network,name,round(g1,6) AS g1,round(g2,6) AS g2,round(g3,6) AS g3,round(g4,6) AS g4 FROM coords c JOIN nodes ON idx=parcel")
def e15(t):
    n = F.broadcast(t.nodes().select(F.col("idx").alias("parcel"), "name"))
    return out(coords(t).join(n, "parcel").drop("parcel"), [*SH, "network", "name"])
