"""Registered cross-cohort, control, multiplicity and whole-study queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import order as O
from ..functions.expr import r6
from ..operators import embedding as E
from ..operators import geometry as M
from ..operators import graphs as G
from ..operators import inference as P
from ..operators import similarity as Y
from ..plans import cohorts as H
from ..plans import screens, studies as ST
from ..plans.graph_study import long_metrics
from ..session import cut
from .embedding_queries import SLICE, axis_long, subjects
from .fixtures import N_CORTEX, N_GRAPH, Tables
from .geometry_queries import END, PV, S, SD, SM, _d, coords, out
from .inference_queries import EK, FAM, FT, K, RF, all_features, deltas, maxt_sql, near_sql, sim_sql, tests, tests_sql
from .registry import query

CL = """cl AS (SELECT e.subject,e.visit,a.network AS ni,b.network AS nj,ln(1+w) AS lw FROM (SELECT subject,visit,i,j,w FROM edges UNION ALL SELECT subject,visit,j,i,w FROM edges) e JOIN nodes a ON a.idx=e.i JOIN nodes b ON b.idx=e.j WHERE a.tissue='cortex' AND b.tissue='cortex'),
 sz AS (SELECT network,count(*) AS n FROM nodes WHERE tissue='cortex' GROUP BY 1),"""


@query("M12_matched_node", "edges nodes", "WITH " + CL + """ d AS (SELECT subject,visit,ni AS network,sum(lw)/any_value(n) AS s,count(*) FILTER (lw>0)/any_value(n) AS k FROM cl JOIN sz ON ni=network GROUP BY 1,2,3)
 SELECT a.subject,a.network,round(b.s-a.s,6)+0.0 AS strength,round(b.k-a.k,6)+0.0 AS degree,round((b.s-a.s)/a.s,6)+0.0 AS str_rel,round((b.k-a.k)/a.k,6)+0.0 AS deg_rel FROM d a JOIN d b ON a.subject=b.subject AND a.network=b.network WHERE a.visit=1 AND b.visit=2""")
def m12n(t):
    return out(H.matched_node(t.edges(), t.nodes()), ["subject", "network"])


@query("M12_matched_edge", "edges nodes", "WITH " + CL + """ d AS (SELECT subject,ni,nj,coalesce(sum(lw) FILTER (visit=2),0)-coalesce(sum(lw) FILTER (visit=1),0) AS d FROM cl WHERE nj IN ('Vis','SomMot','DorsAttn','Default') GROUP BY ALL)
 SELECT subject,ni||'-'||nj AS block,round(d/(a.n*b.n),6)+0.0 AS change FROM d JOIN sz a ON a.network=ni JOIN sz b ON b.network=nj""")
def m12e(t):
    return out(H.matched_edge(t.edges(), t.nodes()), ["subject", "block"])


@query("M17_structure_network_strength", "edges nodes", """WITH st AS (SELECT idx,CASE WHEN contains(lower(name),'thalam') THEN 'thalamus' WHEN contains(lower(name),'putamen') THEN 'putamen' WHEN contains(lower(name),'caudate') THEN 'caudate' END AS s FROM nodes WHERE tissue<>'cortex'),
 e AS (SELECT subject,visit,s,network,w FROM (SELECT subject,visit,i,j,w FROM edges UNION ALL SELECT subject,visit,j,i,w FROM edges) x JOIN st ON st.idx=i JOIN nodes n ON n.idx=j WHERE n.tissue='cortex' AND visit>0),
 f AS (SELECT * FROM e UNION ALL SELECT subject,0,s,network,w FROM e WHERE visit=1), g AS (SELECT subject,visit,s||'_'||network||'_absolute' AS metric,w FROM f UNION ALL SELECT subject,visit,s||'_cortex_absolute',w FROM f)
 SELECT subject,visit,metric,round(sum(w),2) AS value FROM g GROUP BY 1,2,3""")
def m17(t):
    d = H.structure_network_strength(t.edges(), t.nodes())
    return d.select(*S, "metric", F.round("value", 2).alias("value"))


RHO2 = SM + """ fa AS (SELECT subject,network,metric,max(value) FILTER (visit=2)-max(value) FILTER (visit=1) AS a,max(value) FILTER (visit=1)-max(value) FILTER (visit=0) AS b FROM sm GROUP BY ALL),
 fr AS (SELECT network,metric,rank() OVER (PARTITION BY network,metric ORDER BY a) AS ra,rank() OVER (PARTITION BY network,metric ORDER BY b) AS rb,o.y AS y1,p.y AS y2 FROM fa JOIN outcomes o ON o.subject=fa.subject AND o.endpoint='balance' JOIN outcomes p ON p.subject=fa.subject AND p.endpoint='top'),
 fk AS (SELECT *,rank() OVER (PARTITION BY network,metric ORDER BY y1) AS r1,rank() OVER (PARTITION BY network,metric ORDER BY y2) AS r2 FROM fr),
 rh AS (SELECT network,metric,corr(ra,r1) AS a,corr(rb,r2) AS b FROM fk GROUP BY ALL), """


def two_cohorts(t: Tables):
    m = cut(M.session_metrics(coords(t), S))
    o = t.outcomes()
    chg = lambda a, b: ST.visit_change(m, ["subject", *K], ["value"], a, b).withColumnRenamed("value", "x")
    first = H.rank_rhos(chg(1, 2), o.filter("endpoint = 'balance'"), K).withColumnRenamed("rho", "first_rho")
    second = H.rank_rhos(chg(0, 1), o.filter("endpoint = 'top'"), K).withColumnRenamed("rho", "second_rho")
    return first.join(second, K)


@query("P20_replication_summary", "coords outcomes", "WITH " + RHO2 + """ tp AS (SELECT *,row_number() OVER (PARTITION BY network ORDER BY round(abs(a),9) DESC,metric) AS o FROM rh)
 SELECT network,count(*) AS n,round(avg((sign(round(a,9))=sign(round(b,9)))::INT),6) AS sign_agree,round(corr(a,b),6)+0.0 AS rho_corr,round(avg((sign(round(a,9))=sign(round(b,9)))::INT) FILTER (o<=5),6) AS top5_sign,0::BIGINT AS excluded FROM tp GROUP BY 1""")
def p20(t):
    r = two_cohorts(t).select(*K, F.round("first_rho", 9).alias("first_rho"), F.round("second_rho", 9).alias("second_rho"))
    return out(H.replication_summary(r, ["network"]), ["network"])


@query("P21_calibre_summary", "coords outcomes", "WITH " + SM + """ ic AS (SELECT network,metric,value AS x,avg(value) OVER (PARTITION BY network,metric) AS g,avg(value) OVER (PARTITION BY network,metric,subject) AS r,avg(value) OVER (PARTITION BY network,metric,visit) AS c FROM sm),
 ia AS (SELECT network,metric,sum((r-g)**2)/5 AS msr,sum((c-g)**2)/2 AS msc,sum((x-r-c+g)**2)/10 AS mse FROM ic GROUP BY ALL), icc AS (SELECT network,metric,(msr-mse)/(msr+2*mse+3*(msc-mse)/6) AS icc FROM ia),
 rr AS (SELECT network,metric,visit,rank() OVER (PARTITION BY network,metric,visit ORDER BY value) AS rx,rank() OVER (PARTITION BY network,metric,visit ORDER BY y) AS ry FROM sm JOIN outcomes USING (subject) WHERE endpoint='balance'),
 rc AS (SELECT network,metric,visit,corr(rx,ry) AS rho FROM rr GROUP BY ALL), sp AS (SELECT network,metric,max(rho)-min(rho) AS span FROM rc GROUP BY ALL)
 SELECT network,count(*) AS n,round(quantile_cont(icc,.5),6)+0.0 AS icc_med,round(quantile_cont(span,.5),6) AS span_med FROM icc JOIN sp USING (network,metric) GROUP BY 1""")
def p21(t):
    m = cut(M.session_metrics(coords(t), S).select("subject", F.col("visit").alias("calibre"), *K, F.col("value").alias("x")))
    return out(H.calibre_summary(m, t.outcomes().filter("endpoint = 'balance'"), K, ["network"]), ["network"])


@query("P22_parcel_mapping", "nodes", "SELECT name,hemi,network,idx AS first_idx,49-idx AS second_idx FROM nodes WHERE tissue='cortex'")
def p22(t):
    n = t.nodes()
    return H.parcel_mapping(n, n.withColumn("idx", 49 - F.col("idx")))


GC = """g AS (SELECT a.idx AS i,b.idx AS j FROM nodes a CROSS JOIN nodes b WHERE a.tissue='cortex' AND b.tissue='cortex'),
 me AS (SELECT i,j,round(sum(w) FILTER (visit=0)/6,6) AS x,round(sum(w) FILTER (visit=2)/6,6) AS y FROM (SELECT visit,i,j,w FROM edges UNION ALL SELECT visit,j,i,w FROM edges) GROUP BY ALL),
 f AS (SELECT g.i,g.j,coalesce(x,0) AS x,coalesce(y,0) AS y FROM g LEFT JOIN me USING (i,j)),
 s AS (SELECT 'raw' AS scale,i,j,x,y FROM f UNION ALL SELECT 'log1p',i,j,ln(1+x),ln(1+y) FROM f UNION ALL SELECT 'rank',i,j,rank() OVER (ORDER BY x)+(count(*) OVER (PARTITION BY x)-1)/2.0,rank() OVER (ORDER BY y)+(count(*) OVER (PARTITION BY y)-1)/2.0 FROM f),
 nd AS (SELECT scale,abs(corr(x,y)) AS node FROM (SELECT scale,i,sum(x) AS x,sum(y) AS y FROM s GROUP BY ALL) GROUP BY 1), ed AS (SELECT scale,abs(corr(x,y)) AS edge FROM s WHERE i<j GROUP BY 1)"""


@query("P23_group_correspondence", "edges nodes", "WITH " + GC + " SELECT scale,round(node,6) AS node,round(edge,6) AS edge FROM nd JOIN ed USING (scale)")
def p23(t):
    e = cut(t.edges())
    n = t.nodes()
    second = n.withColumn("idx", 49 - F.col("idx"))
    a = E.mean_network(e.filter("visit = 0"), 6)
    b = E.mean_network(e.filter("visit = 2"), 6).select((49 - F.col("j")).alias("i"), (49 - F.col("i")).alias("j"), "w")
    return out(H.group_correspondence(cut(a), cut(b), cut(H.parcel_mapping(n, second)), N_CORTEX), ["scale"])


@query("P23_gradient_correspondence", "", "SELECT unnest([1,2,3,4]) AS axis,true AS same_network_is_one,true AS within_one")
def p23g(t):
    """Axes of two cohort means; a renumbered copy of the first one must agree with it, signs included."""
    e, n = cut(t.edges()), t.nodes()
    # the numbers of the copy keep the order of the nodes, by which signs of tied axes are fixed
    moved = n.withColumn("idx", F.col("idx") + 7)
    a, b = (cut(E.mean_network(e.filter(F.col("visit") == v), subjects(t).count())) for v in (0, 2))
    copy = a.select((F.col("i") + 7).alias("i"), (F.col("j") + 7).alias("j"), "w")
    same, other = H.gradient_correspondence(a, copy, n, moved), H.gradient_correspondence(a, b, n, n)
    j = same.select("axis", (F.abs(F.col("signed") - 1) < 1e-6).alias("same_network_is_one")).join(other, "axis")
    return j.select("axis", "same_network_is_one", F.col("r").between(0, 1 + 1e-12).alias("within_one"))


@query("P24_reference_transfer")
def p24(t):
    e = cut(t.edges())
    return H.reference_transfer(e.filter("visit < 3"), t.nodes(), E.mean_network(e.filter("visit = 0"), 6), E.mean_network(e.filter("visit = 2"), 6))


PM = f"ft AS ({FT})," + sim_sql() + """pm AS (SELECT CAST(substr(a.subject,2) AS INT) AS i,CAST(substr(a.subject2,2) AS INT) AS j,a.r AS a,b.r AS b FROM sim a JOIN sim b ON a.subject=b.subject AND a.subject2=b.subject2 WHERE a.visit=1 AND a.visit2=1 AND b.visit=2 AND b.visit2=2 AND a.subject<a.subject2),
"""
MANTEL = """rk AS (SELECT i,j,rank() OVER (ORDER BY a) AS ra,rank() OVER (ORDER BY b) AS rb FROM pm),
 pr AS (SELECT perm,p[i+1] AS pi,p[j+1] AS pj,rb FROM rk,perms WHERE n=6), nu AS (SELECT perm,corr(rk.ra,pr.rb) AS nul FROM pr JOIN rk ON rk.i=least(pi,pj) AND rk.j=greatest(pi,pj) GROUP BY 1), ob AS (SELECT corr(ra,rb) AS rho FROM rk)
 SELECT round(rho,6)+0.0 AS rho,round(avg((nul>=rho-1e-12)::INT),6) AS p_one_sided,round(avg((abs(nul)>=abs(rho)-1e-12)::INT),6) AS p_two_sided,count(*) AS n_permutations FROM nu,ob GROUP BY rho"""


def pair_table(t: Tables):
    s = cut(Y.similarity(Y.coordinate_features(coords(t)))).filter("visit = visit2 and subject < subject2")
    i, j = F.substring("subject", 2, 1).cast("int"), F.substring("subject2", 2, 1).cast("int")
    at = lambda v: F.max(F.when(F.col("visit") == v, F.col("r")))
    return cut(s.groupBy(i.alias("i"), j.alias("j")).agg(at(1).alias("a"), at(2).alias("b")).withColumn("k", F.lit(1)))


@query("P25_mantel", "coords perms", "WITH " + PM + MANTEL)
def p25(t):
    return out(P.mantel(pair_table(t), ["k"], "a", "b").drop("k"), ["n_permutations"])


@query("P26_partial_mantel", "coords perms", "WITH " + PM.replace("pm AS (", "pm0 AS (") + """ rz AS (SELECT i,j,a,rank() OVER (ORDER BY a) AS x,rank() OVER (ORDER BY b) AS y FROM pm0), fit AS (SELECT regr_slope(y,x) AS s,regr_intercept(y,x) AS c FROM rz),
 pm AS (SELECT i,j,a,round(y-s*x-c,9) AS b FROM rz,fit),""" + MANTEL.replace("rank() OVER (ORDER BY b)", "rank() OVER (ORDER BY b)+(count(*) OVER (PARTITION BY b)-1)/2.0"))
def p26(t):
    p = pair_table(t)
    res = P.rank_residual(p, ["k"], "b", "a")
    # unit-length residuals are the same ranking; rounding keeps equal ones equal
    j = p.join(res.select("k", "i", "j", F.round("residual", 9).alias("residual")), ["k", "i", "j"])
    return out(P.mantel(j, ["k"], "a", "residual").drop("k"), ["n_permutations"])


DON = f"ft AS ({FT})," + sim_sql() + """ dl AS (SELECT CAST(substr(a.subject,2) AS INT) AS i,CAST(substr(a.subject2,2) AS INT) AS d,avg(b.r-a.r) AS delta FROM sim a JOIN sim b ON a.subject=b.subject AND a.subject2=b.subject2 AND a.visit2=b.visit2 WHERE a.visit=1 AND b.visit=2 AND a.subject<>a.subject2 GROUP BY 1,2),
 sc AS (SELECT x.i,x.d,any_value(x.delta)-avg(y.delta) AS score FROM dl x JOIN dl y ON x.i=y.i AND x.d<>y.d GROUP BY 1,2),"""


def donor_delta(t: Tables):
    s = cut(Y.similarity(Y.coordinate_features(coords(t)))).filter("subject <> subject2 and visit in (1, 2)")
    i, d = F.substring("subject", 2, 1).cast("int"), F.substring("subject2", 2, 1).cast("int")
    sign = F.when(F.col("visit") == 2, F.col("r")).otherwise(-F.col("r"))
    return s.groupBy(i.alias("i"), d.alias("d")).agg((F.sum(sign) / 3).alias("delta"))


@query("P27_donor_pull", "coords", "WITH " + DON + END + "SELECT i,d,round(score,6)+0.0 AS score FROM sc")
def p27(t):
    return out(P.donor_pull(cut(donor_delta(t))), ["i", "d"])


@query("P27_donor_null", "coords", "WITH " + DON + """ nu AS (SELECT (a.score+b.score+c.score+d.score+e.score+f.score)/6 AS v FROM sc a,sc b,sc c,sc d,sc e,sc f WHERE a.i=0 AND b.i=1 AND c.i=2 AND d.i=3 AND e.i=4 AND f.i=5), ob AS (SELECT avg(score) AS o FROM sc WHERE d=(i+1)%6)
 SELECT round(o,6)+0.0 AS obs_pull_toward_donor,round(avg((v>=o-1e-15)::INT),6) AS p_one_sided,count(*) AS n_relabelings,round(quantile_cont(v,.95),6)+0.0 AS null_q95 FROM nu,ob GROUP BY o""")
def p27n(t):
    s = cut(P.donor_pull(cut(donor_delta(t))))
    donors = s.select("i").distinct().withColumn("d", (F.col("i") + 1) % 6)
    return out(P.donor_null(s, donors, 6), ["n_relabelings"])


def mm(t: Tables):
    return t.raw("supplier").select(F.col("s_suppkey").alias("parcel"), (F.col("s_suppkey") * 1.0).alias("distance"))


@query("P28_zone_hits", "coords", f"""WITH z AS (SELECT s_suppkey AS parcel,CASE WHEN s_suppkey<30 THEN 'near' WHEN s_suppkey<60 THEN 'mid' ELSE 'far' END AS zone FROM supplier),
 ft AS (SELECT zone,subject,visit,feature,x FROM ({FT}) JOIN z ON CAST(z.parcel AS VARCHAR)=split_part(feature,':',1)),""" + sim_sql(k="zone") + near_sql(k="zone") + END
       + """SELECT zone,(SELECT count(*) FROM z WHERE z.zone=nr.zone) AS n_parcels,count(*) FILTER (subject=near_subject) AS correct FROM nr GROUP BY zone""")
def p28_hits(t):
    return H.zone_hits(coords(t), mm(t))


@query("P28_distance_bins_identification")
def p28(t):
    return H.distance_bins_identification(coords(t), mm(t), 200, 20261015)


ERR = f"""c0 AS (SELECT *,{','.join(f'avg(g{i}) OVER (PARTITION BY parcel) AS c{i}' for i in range(1, 5))} FROM coords WHERE visit=0), sc AS (SELECT parcel,stddev_pop({_d('g', 'c')})+1e-12 AS s FROM c0 GROUP BY 1), {PV}
 ez AS (SELECT subject,pv.parcel,CAST(pv.parcel AS DOUBLE) AS distance,{_d('a', 'b')} AS error,{_d('a', 'b')}/s AS z FROM pv JOIN sc ON sc.parcel=pv.parcel),"""


def errors(t: Tables, a: int = 1, b: int = 2, c=None):
    c = coords(t) if c is None else c
    e = Y.scaled_error(c.filter(F.col("visit") == a), c.filter(F.col("visit") == b), c.filter("visit = 0"))
    return cut(e.join(mm(t), "parcel"))


@query("P29_distance_error_profile", "coords", "WITH " + ERR + END + "SELECT CASE WHEN distance<15 THEN 0 WHEN distance<30 THEN 15 WHEN distance<45 THEN 30 WHEN distance<60 THEN 45 WHEN distance<75 THEN 60 ELSE 75 END AS bin_from,count(*) AS n,round(quantile_cont(z,.5),6) AS median_err_sd FROM ez WHERE distance<200 GROUP BY 1")
def p29(t):
    return out(H.distance_error_profile(errors(t)), ["bin_from"])


@query("P29_error_distance_spearman", "coords", "WITH " + ERR + " r AS (SELECT rank() OVER (ORDER BY distance)+(count(*) OVER (PARTITION BY distance)-1)/2.0 AS a,rank() OVER (ORDER BY z)+(count(*) OVER (PARTITION BY z)-1)/2.0 AS b FROM ez) SELECT round(corr(a,b),6)+0.0 AS rho FROM r")
def p29s(t):
    e = errors(t).withColumn("k", F.lit(1))
    return out(ST.rank_correlation(e, ["k"], "distance", "z").drop("k"), [])


@query("P30_perturbation_to_signal", "coords edges nodes", "WITH " + RF + """ d AS (SELECT a.representation,a.feature,a.x,b.x AS y FROM gf a JOIN gf b ON a.representation=b.representation AND a.feature=b.feature AND a.subject=b.subject WHERE a.visit=1 AND b.visit=2),
 w AS (SELECT representation,avg(abs(x-y)) AS within FROM d GROUP BY 1), b AS (SELECT representation,avg(s) AS between FROM (SELECT representation,feature,stddev_pop(x) AS s FROM gf WHERE visit=1 GROUP BY 1,2) GROUP BY 1)
 SELECT representation,round(within,6) AS "within",round("between",6) AS "between",round(within/greatest("between",1e-12),6) AS ratio FROM w JOIN b USING (representation)""".replace("AS between", 'AS "between"'))
def p30(t):
    f = all_features(t)
    return out(Y.perturbation_to_signal(f.filter("visit = 1"), f.filter("visit = 2"), ["representation"]), ["representation"])


@query("P31_structure_preservation", "coords", f"WITH f0 AS ({FT}), ft AS (SELECT subject,visit,feature,(x-avg(x) OVER w)/(stddev_pop(x) OVER w+1e-12) AS x FROM f0 WINDOW w AS (PARTITION BY feature,visit)),"
       + sim_sql() + """ p AS (SELECT subject,subject2,max(r) FILTER (visit=1) AS a,max(r) FILTER (visit=2) AS b FROM sim WHERE visit=visit2 AND visit>0 AND subject<subject2 GROUP BY 1,2), q AS (SELECT *,rank() OVER (ORDER BY a) AS ra,rank() OVER (ORDER BY b) AS rb FROM p)
 SELECT round(corr(a,b),6)+0.0 AS r,round(corr(ra,rb),6)+0.0 AS rho,round(avg(abs(a-b)),6) AS disp FROM q""")
def p31(t):
    f = cut(Y.coordinate_features(coords(t)))
    return out(Y.structure_preservation(f.filter("visit = 1"), f.filter("visit = 2")), [])


@query("P32_spatial_error_profile", "coords", "WITH " + ERR + """ m AS (SELECT subject,CASE WHEN distance<30 THEN 'near' WHEN distance<60 THEN 'mid' ELSE 'far' END AS zn,quantile_cont(z,.5) AS v FROM ez GROUP BY 1,2),
 a AS (SELECT avg(v) FILTER (zn='near') AS n,avg(v) FILTER (zn='mid') AS m,avg(v) FILTER (zn='far') AS f FROM m) SELECT round(n,6) AS near,round(m,6) AS mid,round(f,6) AS far,round(n/greatest(f,1e-12),6) AS ratio FROM a""")
def p32(t):
    return out(H.spatial_error_profile(errors(t)), [])


@query("P34_retest_identification", "coords", f"WITH ft AS ({FT})," + """ rt AS (SELECT a.subject,a.feature,.6*a.x+.4*b.x AS x FROM ft a JOIN ft b ON a.subject=b.subject AND a.feature=b.feature WHERE a.visit=2 AND b.visit=1),
 s AS (SELECT rt.subject,g.subject AS s2,g.visit,corr(rt.x,g.x) AS r FROM rt JOIN ft g ON g.feature=rt.feature GROUP BY 1,2,3),
 p AS (SELECT subject,arg_max(s2,r)=subject AS hit,max(r) FILTER (s2=subject)-max(r) FILTER (s2<>subject) AS m,max(r) FILTER (s2=subject AND visit=2) AS q FROM s GROUP BY 1)
 SELECT count(*) FILTER (hit) AS correct,count(*) AS of,round(quantile_cont(m,.5),6)+0.0 AS margin_median,round(quantile_cont(q,.5),6) AS r_same_session_median FROM p""".replace("AS of", 'AS "of"'))
def p34(t):
    f = cut(Y.coordinate_features(coords(t)))
    a = f.filter("visit = 2").select("subject", "feature", "x").join(f.filter("visit = 1").select("subject", "feature", F.col("x").alias("y")), ["subject", "feature"])
    return out(Y.retest_identification(a.withColumn("x", 0.6 * F.col("x") + 0.4 * F.col("y")), f, 2), ["correct", "of"])


def vis_move(c, a: int, b: int):
    d = M.displacement(M.pair_visits(c, "subject", a, b)).filter("network = 'Vis'")
    return cut(d.groupBy("subject").agg(F.avg("displacement").alias("x")))


_mv = lambda a, b: f"SELECT p.subject,avg(sqrt({'+'.join(f'(p.g{i}-q.g{i})**2' for i in range(1, 5))})) AS x FROM coords p JOIN coords q ON p.subject=q.subject AND p.parcel=q.parcel WHERE p.visit={a} AND q.visit={b} AND p.network='Vis' GROUP BY 1"


@query("P35_noise_outcome_screen", "coords outcomes perms", f"WITH ob AS ({_mv(1, 2)}),nz AS ({_mv(0, 1)}),nf AS (SELECT subject,'observed_displacement' AS metric,x AS delta FROM ob UNION ALL SELECT subject,'same_day_displacement',x FROM nz UNION ALL SELECT subject,'observed_minus_same_day',ob.x-nz.x FROM ob JOIN nz USING (subject)),"
       + tests_sql("nf", "metric", "delta") + maxt_sql("endpoint", "endpoint,metric", "mt") + END + "SELECT endpoint,metric,n,round(rho,6)+0.0 AS rho,round(p_exact,6) AS p_exact,round(p_greater,6) AS p_greater,round(p_less,6) AS p_less,round(p_maxt,6) AS p_maxt FROM pv1 JOIN mt USING (endpoint,metric)")
def p35(t):
    c = coords(t.of_network("Vis"))
    d = H.noise_outcome_screen(vis_move(c, 1, 2), vis_move(c, 0, 1), t.outcomes())
    return out(d.select("endpoint", "metric", "n", "rho", "p_exact", "p_greater", "p_less", F.col("p_maxT").alias("p_maxt")), ["endpoint", "metric"])


@query("P35_noise_ratio", "coords", f"WITH ob AS ({_mv(1, 2)}),nz AS ({_mv(0, 1)}) SELECT round(quantile_cont(ob.x/nz.x,.5),6) AS ratio_median,round(corr(ob.x,nz.x),6)+0.0 AS corr FROM ob JOIN nz USING (subject)")
def p35r(t):
    c = coords(t.of_network("Vis"))
    return out(H.noise_ratio(vis_move(c, 1, 2), vis_move(c, 0, 1)), [])


@query("P35_noise_signflip", "coords", f"""WITH ob AS ({_mv(1, 2)}),nz AS ({_mv(0, 1)}),d AS (SELECT list(ob.x-nz.x ORDER BY subject) AS d,avg(ob.x-nz.x) AS m,count(*)::INT AS n FROM ob JOIN nz USING (subject)),
 fl AS (SELECT n,m,list_sum([CASE WHEN (b>>(k-1))&1=1 THEN -d[k] ELSE d[k] END for k in range(1,n+1)])/n AS nul FROM d,range(64) r(b))
 SELECT n,round(m,6)+0.0 AS mean_difference,round(avg((nul>=m-1e-15)::INT),6) AS p_greater,round(avg((abs(nul)>=abs(m)-1e-15)::INT),6) AS p_two,count(*) AS n_signflips FROM fl GROUP BY n,m""")
def p35s(t):
    c = coords(t.of_network("Vis"))
    return out(H.noise_signflip(vis_move(c, 1, 2), vis_move(c, 0, 1)), ["n", "n_signflips"])


_er = lambda a, b: f"SELECT a.subject,a.parcel,sqrt({'+'.join(f'(a.g{i}-b.g{i})**2' for i in range(1, 5))}) AS error FROM coords a JOIN coords b ON a.subject=b.subject AND a.parcel=b.parcel WHERE a.visit={a} AND b.visit={b}"


@query("P36_simulation_error", "coords", "WITH " + ERR + f"fl AS ({_er(1, 0)}),rm AS ({_er(0, 2)}),"
       + "v AS (SELECT quantile_cont(z,.5) AS z,quantile_cont(error,.5) AS e FROM ez), f AS (SELECT quantile_cont(error/s,.5) AS z,quantile_cont(error,.5) AS e FROM fl JOIN sc USING (parcel)), r AS (SELECT quantile_cont(error/s,.5) AS z,quantile_cont(error,.5) AS e FROM rm JOIN sc USING (parcel))"
       + " SELECT round(v.z,6) AS void_median_sd,round(f.z,6) AS floor_median_sd,round(v.e/f.e,6) AS ratio,round(r.z,6) AS rim_median_sd,round(r.e/f.e,6) AS rim_ratio FROM v,f,r")
def p36(t):
    c = coords(t)
    return out(H.simulation_error(errors(t, 1, 2, c), errors(t, 1, 0, c), errors(t, 0, 2, c)), [])


@query("P36_ratio_per_subject", "coords", f"WITH v AS (SELECT subject,quantile_cont(error,.5) AS e FROM ({_er(1, 2)}) GROUP BY 1),f AS (SELECT subject,quantile_cont(error,.5) AS e FROM ({_er(1, 0)}) GROUP BY 1) SELECT subject,round(v.e/f.e,6) AS ratio FROM v JOIN f USING (subject)")
def p36s(t):
    c = coords(t)
    return out(H.simulation_ratio_per_subject(errors(t, 1, 2, c), errors(t, 1, 0, c)), ["subject"])


@query("P36_false_displacement", "coords", f"""WITH ob AS ({_mv(1, 2)}),sm AS (SELECT 'floor' AS label,x FROM ({_mv(0, 1)}) UNION ALL SELECT 'void',x FROM ({_mv(0, 2)})),o AS (SELECT avg(x) AS m,stddev_samp(x) AS s FROM ob)
 SELECT label,round(avg(x),6) AS mean,round(avg(x)/s,6) AS over_observed_sd,round(avg(x)/m,6) AS over_observed_mean FROM sm,o GROUP BY label,s,m""")
def p36f(t):
    c = coords(t.of_network("Vis"))
    sim = vis_move(c, 0, 1).withColumn("label", F.lit("floor")).unionByName(vis_move(c, 0, 2).withColumn("label", F.lit("void")))
    return out(H.false_displacement(sim, vis_move(c, 1, 2)), ["label"])


@query("P37_loso_gallery")
def p37(t):
    return H.loso_gallery(cut(t.edges()), t.nodes(), subjects(t)).select("held", "visit", "near_subject", "near_visit", "hit", "tied")


@query("P39_axis_vs_external_map", "coords", """WITH a AS (SELECT parcel,network,avg(g1) AS x FROM coords WHERE visit=0 GROUP BY ALL),b AS (SELECT parcel,avg(g2)+.3*avg(g1) AS y FROM coords WHERE visit=2 GROUP BY ALL),j AS (SELECT * FROM a JOIN b USING (parcel)),
 k AS (SELECT corr(x,y) AS r,count(*) AS n FROM j), rk AS (SELECT rank() OVER (ORDER BY x) AS rx,rank() OVER (ORDER BY y) AS ry FROM j), nm AS (SELECT rank() OVER (ORDER BY avg(x)) AS rx,rank() OVER (ORDER BY avg(y)) AS ry FROM j GROUP BY network)
 SELECT round(abs(r),6) AS r,round(abs((SELECT corr(rx,ry) FROM rk)),6) AS rho,round(CASE WHEN r<0 THEN -1 ELSE 1 END*(SELECT corr(rx,ry) FROM nm),6)+0.0 AS network_rho,CASE WHEN r<0 THEN -1 ELSE 1 END AS display_sign,n AS n_compared FROM k""")
def p39(t):
    c = coords(t)
    a = c.filter("visit = 0").groupBy("parcel", "network").agg(F.avg("g1").alias("x"))
    b = c.filter("visit = 2").groupBy("parcel").agg((F.avg("g2") + 0.3 * F.avg("g1")).alias("y"))
    return out(H.axis_vs_external_map(a, b), ["display_sign", "n_compared"])


HIT = FAM + """ hp AS (SELECT endpoint,network,metric,perm,count(*) OVER (PARTITION BY endpoint,network,metric ORDER BY abs(nul) RANGE BETWEEN 1e-12 PRECEDING AND UNBOUNDED FOLLOWING)/count(*) OVER (PARTITION BY endpoint,network,metric) AS p FROM nl),
 hh AS (SELECT endpoint,perm,count(*) FILTER (p<.05) AS hits FROM hp GROUP BY 1,2), ho AS (SELECT endpoint,count(*) FILTER (p_exact<.05) AS o FROM pv1 GROUP BY 1),"""


@query("P41_family_hit_null", "coords outcomes perms", "WITH " + HIT + END + "SELECT endpoint,o AS observed_hits,round(avg(hits),6) AS expected_hits,round(stddev_pop(hits),6) AS null_sd,round(avg((hits>=o)::INT),6) AS p_null_ge_observed,round(avg((hits<o)::INT),6) AS percentile_strictly_below,count(*) AS n_shared_permutations FROM hh JOIN ho USING (endpoint) GROUP BY endpoint,o")
def p41(t):
    ts = cut(tests(t))
    nulls = P.shared_nulls(ts).select(*EK, "n", "rho", "perm", "null")
    seen = P.exact_p(nulls, K).groupBy("endpoint").agg(F.count_if(F.col("p_exact") < 0.05).alias("observed_hits"))
    return out(P.family_hit_null(nulls, EK, seen), ["endpoint", "observed_hits", "n_shared_permutations"])


def critical_sql(sizes: str) -> str:
    """``cv (n, m, crit, den, tail)``: the critical numerator of each size."""
    return f"""sz AS (SELECT DISTINCT n::INT AS n FROM {sizes}), v AS (SELECT n,abs(n*(n*n-1)-6*list_sum([(p[k]-(k-1))**2 for k in range(1,n+1)])) AS v FROM perms JOIN sz USING (n)),
 c AS (SELECT n,v,count(*) AS c FROM v GROUP BY ALL), t AS (SELECT n,v,sum(c) OVER (PARTITION BY n ORDER BY v DESC)/sum(c) OVER (PARTITION BY n) AS tail,sum(c) OVER (PARTITION BY n) AS m FROM c),
 cv AS (SELECT n,max(m) AS m,coalesce(min(v) FILTER (tail<=.05),any_value(n*(n*n-1))+1) AS crit,any_value(n*(n*n-1)) AS den,coalesce(max(tail) FILTER (tail<=.05),0) AS tail FROM t GROUP BY n)"""


@query("P42_rank_critical_value", "outcomes perms", "WITH " + critical_sql("(SELECT count(y) AS n FROM outcomes GROUP BY endpoint)") + """
 SELECT n,CAST(m AS BIGINT) AS null_draws,CAST(crit AS BIGINT) AS critical_absolute_numerator,CAST(den AS BIGINT) AS denominator,round(crit/den,6) AS critical_absolute_spearman,round(tail,6) AS achieved_null_probability FROM cv""")
def p42(t):
    """The critical value of every complete-case size of the outcome table."""
    sizes = t.outcomes().groupBy("endpoint").agg(F.count("y").alias("n"))
    return out(P.size_critical_values(sizes), ["n", "null_draws", "critical_absolute_numerator", "denominator"])


@query("P42_beyond_critical", "coords outcomes perms", "WITH " + SD + tests_sql("sd", "network,metric", "delta") + critical_sql("ts") + """
 SELECT endpoint,network,metric,n,abs(rho)>=crit/den-1e-9 AS beyond FROM ts JOIN cv USING (n)""")
def p42b(t):
    """Every endpoint's and feature's test beside the critical value of its size."""
    return P.beyond_critical(tests(t).select(*EK, "n", "rho")).select(*EK, "n", "beyond")


POOL = """ pw AS (SELECT endpoint,metric,CASE WHEN max(abs(rho))>=1-1e-9 THEN 'perfect correlation' WHEN min(n)<=3 THEN 'three subjects or fewer' WHEN count(*)<2 THEN 'a single cohort' END AS reason FROM pv1 GROUP BY 1,2),
 fz AS (SELECT endpoint,metric,sum((n-3)*atanh(rho))/sum(n-3) AS z,1/sqrt(sum(n-3)) AS se FROM pv1 JOIN pw USING (endpoint,metric) WHERE reason IS NULL GROUP BY 1,2)"""


def pooled_rows(t: Tables):
    return cut(tests(t).select("endpoint", "metric", "n", F.col("rho").alias("r")))


@query("P46_fisher_pool", "coords outcomes perms", "WITH " + FAM + POOL + """
 SELECT endpoint,metric,round(tanh(z),6)+0.0 AS r,round(tanh(z-1.959963984540054*se),6)+0.0 AS ci_low,round(tanh(z+1.959963984540054*se),6)+0.0 AS ci_high FROM fz""")
def p46(t):
    """Every endpoint and metric over the networks; groups with a refused row are listed by the next query."""
    rows, k = pooled_rows(t), ["endpoint", "metric"]
    usable = rows.join(P.pool_violations(rows, k), k, "left_anti")
    return out(P.fisher_pool(usable, k, 24).select(*k, "r", "ci_low", "ci_high"), k)


@query("P46_pool_violations", "coords outcomes perms", "WITH " + FAM + POOL + " SELECT endpoint,metric,reason FROM pw WHERE reason IS NOT NULL")
def p46v(t):
    return P.pool_violations(pooled_rows(t), ["endpoint", "metric"])


@query("P47_dual_family", "coords outcomes perms", "WITH " + SD + tests_sql("sd", "network,metric", "delta", "AND endpoint IN ('balance','top')") + maxt_sql("endpoint", "endpoint,network,metric", "mt")
       + " ml AS (SELECT perm,max(abs(nul)) AS mx FROM nl GROUP BY 1), fa AS (SELECT endpoint,network,metric,avg((mx>=abs(rho)-1e-12)::INT) AS p_fwe FROM ts,ml GROUP BY ALL), sg AS (SELECT endpoint,network,metric,greatest(count(*) FILTER (x>0),count(*) FILTER (x<0)) AS same_sign FROM pt GROUP BY ALL),"
       + END + "SELECT endpoint,network,metric,round(rho,6)+0.0 AS rho,round(p_exact,6) AS p,round(p_fwe,6) AS p_fwe,round(p_maxt,6) AS p_fwe_endpoint,same_sign::INT AS same_sign FROM pv1 JOIN mt USING (endpoint,network,metric) JOIN fa USING (endpoint,network,metric) JOIN sg USING (endpoint,network,metric)")
def p47(t):
    d = screens.dual_family(deltas(t), t.outcomes().filter("endpoint in ('balance', 'top')"), K)
    return out(d, [*EK, "same_sign"])


@query("E13_setting_grid")
def e13(t):
    """Every named setting beside the number of pairs it keeps per hemisphere row."""
    e = cut(E.hemisphere_slice(t.edges(), t.nodes()))
    grid = F.broadcast(E.setting_grid(t.spark).withColumn("_1", F.lit(1)))
    rows = e.groupBy("hemi").agg(F.count(F.lit(1)).alias("pairs")).join(E.hemisphere_sizes(t.nodes()), "hemi").withColumn("_1", F.lit(1)).join(grid, "_1").drop("_1")
    return rows.withColumn("kept_per_row", F.coalesce(E.kept_per_row(F.col("nodes"), F.col("sparsity")), F.col("nodes") - 1))


def primary_axes(t: Tables, e):
    g, _ = E.cohort_embeddings(e, t.nodes(), subjects(t), "loso")
    return cut(axis_long(E.as_coords(g, t.nodes()), ["g1", "g2", "g3", "g4"]))


@query("P48_sensitivity_study")
def p48(t):
    e = cut(t.edges())
    return H.sensitivity_study(e, t.nodes(), subjects(t), t.outcomes(), primary_axes(t, e))


@query("P48_settings_table", "edges", """SELECT setting,sparsity,alpha,components,true AS distinct_sources,true AS within_components,setting='primary_top25_align10' AS is_primary,
 CASE WHEN setting='primary_top25_align10' THEN true END AS primary_matches_itself FROM (VALUES ('primary_top25_align10',.75::DOUBLE,.05::DOUBLE,10),('primary_top25_align4',.75,.05,4),
 ('primary_top25_align6',.75,.05,6),('log_no_threshold',NULL,.05,10),('raw_no_threshold_alpha05',NULL,.05,10),('zarkali_like',NULL,.5,10),('log_top10',.9,.05,10),('log_top50',.5,.05,10)) s(setting,sparsity,alpha,components)""")
def p48t(t):
    """Parameters of every setting with invariants of the axes that were matched in it."""
    e = cut(t.edges())
    g, _ = E.cohort_embeddings(e, t.nodes(), subjects(t), "loso", list(E.SETTINGS), retain=E.COMPONENTS)
    table = H.settings_table(t.spark, H.matched_settings(g, primary_axes(t, e)))
    source = [F.col(f"matched_G{i}_source_index") for i in range(1, 5)]
    own = F.lit(True)
    for i in range(1, 5):
        own = own & (source[i - 1] == i) & (F.col(f"matched_G{i}_abs_correlation") > 1 - 1e-6)
    first = F.col("setting") == "primary_top25_align10"
    return table.select(
        "setting", "sparsity", "alpha", "components", (F.size(F.array_distinct(F.array(*source))) == 4).alias("distinct_sources"),
        (F.greatest(*source) <= F.col("components")).alias("within_components"), first.alias("is_primary"), F.when(first, own).alias("primary_matches_itself"),
    )


@query("G22_graph_study")
def g22(t):
    return H.graph_study(cut(t.edges()), t.nodes(), t.outcomes(), N_GRAPH)


@query("G23_preoperative_graph")
def g23(t):
    return H.preoperative_graph(cut(t.edges().filter("visit = 0")), t.nodes(), t.outcomes(), N_CORTEX)


@query("G22_graph_exclusions", "edges outcomes", """WITH m AS (SELECT subject,visit,'total_edge_weight' AS metric,sum(w) AS v FROM edges GROUP BY 1,2 UNION ALL SELECT subject,visit,'raw_positive_edge_density',count(*) FILTER (w>0)/1225.0 FROM edges GROUP BY 1,2),
 d AS (SELECT subject,metric,round(max(v) FILTER (visit=2)-max(v) FILTER (visit=1),9) AS x FROM m GROUP BY 1,2),
 o AS (SELECT endpoint,count(y) AS n,max(y)-min(y) AS span FROM outcomes GROUP BY 1),
 j AS (SELECT endpoint,metric,count(*) AS c,count(x) AS f,max(x)-min(x) AS s FROM d JOIN outcomes USING (subject) WHERE y IS NOT NULL GROUP BY 1,2)
 SELECT endpoint,NULL::VARCHAR AS metric,'insufficient or constant outcome' AS reason FROM o WHERE n<3 OR span=0
 UNION ALL SELECT endpoint,metric,'undefined or constant graph change' FROM j JOIN o USING (endpoint) WHERE n>=3 AND span>0 AND (f<n OR s=0)""")
def g22x(t):
    """What the screen of raw totals leaves out, judged per outcome."""
    m = G.raw_totals(t.edges(), ["subject", "visit"], N_GRAPH)
    return H.graph_exclusions(cut(long_metrics(m, ["subject", "visit"])), t.outcomes())


@query("G22_edge_identification", "edges", """WITH s AS (SELECT DISTINCT subject,visit FROM edges),p AS (SELECT i,j FROM (SELECT unnest(range(50)) AS i),(SELECT unnest(range(50)) AS j) WHERE i<j),
 f AS (SELECT s.subject,s.visit,p.i,p.j,coalesce(w,0) AS x FROM s CROSS JOIN p LEFT JOIN edges e ON e.subject=s.subject AND e.visit=s.visit AND e.i=p.i AND e.j=p.j),
 r AS (SELECT a.subject,a.visit,b.subject AS s2,b.visit AS v2,corr(a.x,b.x) AS r FROM f a JOIN f b USING (i,j) WHERE a.subject<>b.subject OR a.visit<>b.visit GROUP BY ALL)
 SELECT subject,visit,arg_max(s2,r) AS near_subject,arg_max(v2,r) AS near_visit,arg_max(s2,r)=subject AS hit,round(max(r),6) AS best FROM r GROUP BY 1,2""")
def g22e(t):
    d = H.edge_identification(t.edges(), t.nodes())
    return d.select("subject", "visit", "near_subject", "near_visit", "hit", r6("best").alias("best"))


@query("G22_graph_identification")
def g22i(t):
    """Nearest sessions by the four identifying measures of the threshold graphs."""
    return H.graph_identification(H.graph_measures(cut(t.edges()), t.nodes(), N_GRAPH, extended=False, modularity=False))
