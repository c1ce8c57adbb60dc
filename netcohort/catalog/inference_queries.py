"""Registered inference, identification and reliability queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import order as O
from ..functions.expr import AXES, r6
from ..operators import geometry as M
from ..operators import inference as P
from ..operators import similarity as Y
from ..plans import studies as ST
from ..session import cut
from .fixtures import Tables
from .geometry_queries import END, LV, PV, S, SD, SM, _d, contra, coords, out
from .registry import query

K = ["network", "metric"]
EK = ["endpoint", "network", "metric"]


def tests_sql(source: str, keys: str, x: str, where: str = "") -> str:
    """Complete cases, unit ranks, rho and shared nulls for ``source``."""
    g = f"endpoint,{keys}"
    return f"""pt AS (SELECT endpoint,{keys},s.subject,{x} AS x,y FROM {source} s JOIN outcomes o ON s.subject=o.subject WHERE y IS NOT NULL AND {x} IS NOT NULL {where}),
rk AS (SELECT *,rank() OVER (PARTITION BY {g} ORDER BY x)+(count(*) OVER (PARTITION BY {g},x)-1)/2.0 AS rx,rank() OVER (PARTITION BY {g} ORDER BY y)+(count(*) OVER (PARTITION BY {g},y)-1)/2.0 AS ry,
 CAST(count(*) OVER (PARTITION BY {g}) AS INT) AS n FROM pt),
us AS (SELECT *,rx-(n+1)/2.0 AS cx,ry-(n+1)/2.0 AS cy,sqrt(sum((rx-(n+1)/2.0)**2) OVER (PARTITION BY {g})) AS lx,sqrt(sum((ry-(n+1)/2.0)**2) OVER (PARTITION BY {g})) AS ly FROM rk),
ts AS (SELECT *,list_dot_product(ux,uy) AS rho FROM (SELECT {g},n,list(CAST(cx/lx AS DOUBLE) ORDER BY subject) AS ux,list(CAST(cy/ly AS DOUBLE) ORDER BY subject) AS uy FROM us WHERE lx>0 AND ly>0 AND n>=3 GROUP BY {g},n)),
nl AS (SELECT {g},n,rho,perm,list_dot_product(ux,[uy[k+1] for k in p]) AS nul FROM ts JOIN perms USING (n)),
pv1 AS (SELECT {g},n,rho,avg((abs(nul)>=abs(rho)-1e-12)::INT) AS p_exact,avg((nul>=rho-1e-12)::INT) AS p_greater,avg((nul<=rho+1e-12)::INT) AS p_less FROM nl GROUP BY ALL),
"""


def adjust_sql(src: str, p: str, fam: str, name: str) -> str:
    return f"""{name} AS (SELECT *,least(1.0,min({p}*m/r) OVER (PARTITION BY {fam} ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q_bh FROM
 (SELECT *,row_number() OVER (PARTITION BY {fam} ORDER BY {p}) AS r,count(*) OVER (PARTITION BY {fam}) AS m FROM {src})),
"""


def maxt_sql(fam: str, keys: str, name: str) -> str:
    return f"""{name}m AS (SELECT {fam},perm,max(abs(nul)) AS mx FROM nl GROUP BY ALL),
{name} AS (SELECT {keys},avg((mx>=abs(rho)-1e-12)::INT) AS p_maxt FROM ts JOIN {name}m USING ({fam}) GROUP BY {keys}),
"""


FAM = SD + tests_sql("sd", "network,metric", "delta") + adjust_sql("pv1", "p_exact", "endpoint", "bh") + maxt_sql("endpoint", "endpoint,network,metric", "mt")


def deltas(t: Tables):
    c = coords(t)
    d = M.study_deltas(M.session_metrics(c, S), M.interval_metrics(c, geomedian=False))
    return cut(d.select("subject", "network", "metric", F.col("delta").alias("x")))


def tests(t: Tables):
    return P.valid_tests(P.complete_cases(deltas(t), t.outcomes(), K))


@query("P1_unit_ranks", "coords outcomes perms", "WITH " + SD + tests_sql("sd", "network,metric", "delta") + END
       + "SELECT endpoint,network,metric,subject,round(cx/lx,6)+0.0 AS rx,round(cy/ly,6)+0.0 AS ry FROM us WHERE lx>0 AND ly>0")
def p1(t):
    d = tests(t).select("endpoint", *K, F.inline(F.arrays_zip("subjects", "rx", "ry")))
    return out(d.withColumnRenamed("subjects", "subject"), [*EK, "subject"])


@query("P2_exact_family", "coords outcomes perms", "WITH " + FAM + END
       + "SELECT endpoint,network,metric,n,round(rho,6)+0.0 AS rho,round(p_exact,6) AS p_exact,round(p_greater,6) AS p_greater,round(p_less,6) AS p_less FROM pv1")
def p2(t):
    ts = tests(t)
    return out(P.exact_p(P.shared_nulls(ts), K), EK)


@query("P3_bh_adjust", "coords outcomes perms", "WITH " + FAM + END + "SELECT endpoint,network,metric,round(p_exact,6) AS p_exact,round(q_bh,6) AS q_bh FROM bh")
def p3(t):
    p = P.exact_p(P.shared_nulls(tests(t)), K)
    return out(P.bh_adjust(cut(p), ["endpoint"], "p_exact").select(*EK, "p_exact", "q_bh"), EK)


@query("P4_max_t", "coords outcomes perms", "WITH " + FAM + END + "SELECT endpoint,network,metric,round(p_maxt,6) AS p_maxt FROM mt")
def p4(t):
    ts = tests(t)
    return out(P.max_t(P.shared_nulls(ts), ts.select(*EK, "rho"), ["endpoint"], out="p_maxt").drop("rho"), EK)


LOO = """ho AS (SELECT a.endpoint,a.network,a.metric,b.subject AS held,a.subject,a.x,a.y FROM pt a JOIN pt b ON a.endpoint=b.endpoint AND a.network=b.network AND a.metric=b.metric AND a.subject<>b.subject),
 hr AS (SELECT *,rank() OVER (PARTITION BY endpoint,network,metric,held ORDER BY x)+(count(*) OVER (PARTITION BY endpoint,network,metric,held,x)-1)/2.0 AS rx,
  rank() OVER (PARTITION BY endpoint,network,metric,held ORDER BY y)+(count(*) OVER (PARTITION BY endpoint,network,metric,held,y)-1)/2.0 AS ry FROM ho),
 hc AS (SELECT endpoint,network,metric,held,CASE WHEN var_pop(rx)>0 AND var_pop(ry)>0 THEN corr(rx,ry) END AS loo_rho FROM hr GROUP BY ALL), """


@query("P5_leave_one_out", "coords outcomes perms", "WITH " + FAM + LOO + END + "SELECT endpoint,network,metric,held,round(loo_rho,6)+0.0 AS loo_rho FROM hc WHERE endpoint<>'constant'")
def p5(t):
    c = P.complete_cases(deltas(t), t.outcomes().filter("endpoint <> 'constant'"), K)
    return out(P.leave_one_out(c, K), [*EK, "held"])


@query("P6_clinical_screen", "coords outcomes perms", "WITH " + FAM + LOO + END
       + """SELECT endpoint,network,metric,n,count(*) OVER (PARTITION BY endpoint) AS family_size,round(rho,6)+0.0 AS rho,round(p_exact,6) AS p_exact,round(q_bh,6) AS q_bh,round(p_maxt,6) AS p_maxt,
 round(lmin,6)+0.0 AS loo_min,round(lmax,6)+0.0 AS loo_max FROM bh JOIN mt USING (endpoint,network,metric) JOIN (SELECT endpoint,network,metric,min(loo_rho) AS lmin,max(loo_rho) AS lmax FROM hc GROUP BY ALL) USING (endpoint,network,metric)""")
def p6(t):
    from ..plans.screens import clinical_screen

    return out(clinical_screen(deltas(t), t.outcomes(), K).drop("p_greater", "p_less").withColumnRenamed("p_maxT", "p_maxt"), EK)


@query("P6_exclusions", "coords outcomes", "WITH " + SD + """ c AS (SELECT endpoint,network,metric,count(*) AS n,max(y)-min(y) AS sy,max(delta)-min(delta) AS sx FROM sd JOIN outcomes USING (subject) WHERE y IS NOT NULL GROUP BY ALL)
 SELECT endpoint,network,metric,CASE WHEN n<3 OR sy=0 THEN 'fewer than three observations or constant outcome' ELSE 'constant variable' END AS reason FROM c WHERE n<3 OR sy=0 OR sx=0""")
def p6x(t):
    return P.exclusions(P.complete_cases(deltas(t), t.outcomes(), K), K)


@query("P7_grouped_adjust", "coords outcomes perms", "WITH " + SD + tests_sql("sd", "network,metric", "delta") + adjust_sql("pv1", "p_exact", "endpoint,network", "bh")
       + maxt_sql("endpoint,network", "endpoint,network,metric", "mt") + END
       + "SELECT endpoint,network,metric,round(q_bh,6) AS q_bh,round(p_maxt,6) AS p_maxt FROM bh JOIN mt USING (endpoint,network,metric)")
def p7(t):
    d = P.exact_family(deltas(t), t.outcomes(), K, ["endpoint", "network"])
    return out(d.select(*EK, "q_bh", F.col("p_maxT").alias("p_maxt")), EK)


def lateral(t: Tables):
    return cut(M.lateral_values(coords(t), geomedian=False))


@query("P8_lateral_contrast", "coords outcomes perms", "WITH " + LV + tests_sql("lv", "definition,network,metric", "delta", "AND definition IN ('left_only','right_only')")
       + """ ct AS (SELECT a.endpoint,a.network,a.metric,a.perm,a.rho AS rl,b.rho AS rr,a.rho-b.rho AS d,a.nul-b.nul AS nd FROM nl a JOIN nl b ON a.endpoint=b.endpoint AND a.network=b.network AND a.metric=b.metric AND a.perm=b.perm
  WHERE a.definition='left_only' AND b.definition='right_only'),
 cp AS (SELECT endpoint,network,metric,rl,rr,d,avg((abs(nd)>=abs(d)-1e-12)::INT) AS p FROM ct GROUP BY ALL),""" + adjust_sql("cp", "p", "endpoint", "cb")
       + " cm AS (SELECT endpoint,perm,max(abs(nd)) AS mx FROM ct GROUP BY ALL), " + END
       + """SELECT endpoint,network,metric,round(rl,6)+0.0 AS rho_left,round(rr,6)+0.0 AS rho_right,round(p,6) AS p_difference,round(q_bh,6) AS q_bh,
 round(avg((mx>=abs(d)-1e-12)::INT),6) AS p_maxt FROM cb JOIN cm USING (endpoint) GROUP BY ALL""")
def p8(t):
    v = lateral(t).filter("definition in ('left_only', 'right_only')").select("subject", *K, "definition", F.col("delta").alias("x"))
    ts = cut(P.valid_tests(P.complete_cases(v, t.outcomes(), [*K, "definition"])))
    d = P.lateral_contrast(ts.filter("definition = 'left_only'"), ts.filter("definition = 'right_only'"), K)
    return out(d.drop("rho").withColumnRenamed("p_maxT", "p_maxt"), EK)


SYM = LV + """ sw AS (SELECT l.subject,l.network,l.metric,l.post1 AS l1,l.post2 AS l2,l.delta AS ld,r.post1 AS r1,r.post2 AS r2,r.delta AS rd,
  l.metric IN ('parcel_displacement_mean','parcel_displacement_median','centroid_shift') AS iv,(s.side='L') AS rc FROM lv l JOIN lv r USING (subject,network,metric) JOIN sides s USING (subject) WHERE l.definition='left_only' AND r.definition='right_only'),
 sb AS (SELECT *,b,CASE b WHEN 1 THEN rd ELSE ld END AS cd,CASE b WHEN 1 THEN ld ELSE rd END AS id,CASE b WHEN 1 THEN r1 ELSE l1 END AS c1,CASE b WHEN 1 THEN r2 ELSE l2 END AS c2,CASE b WHEN 1 THEN l1 ELSE r1 END AS i1,CASE b WHEN 1 THEN l2 ELSE r2 END AS i2 FROM sw,(VALUES (0),(1)) v(b)),
 sx AS (SELECT subject,network,metric,rc,b,d AS definition,CASE d WHEN 'symptom_contralateral' THEN cd WHEN 'symptom_ipsilateral' THEN id WHEN 'contralateral_minus_ipsilateral' THEN cd-id
   ELSE CASE WHEN iv THEN CASE WHEN id>0 THEN cd/id END WHEN contains(metric,'_position_') THEN NULL WHEN c1>0 AND c2>0 AND i1>0 AND i2>0 THEN (c2/c1)/(i2/i1) END END AS value
  FROM sb,(VALUES ('symptom_contralateral'),('symptom_ipsilateral'),('contralateral_minus_ipsilateral'),('contralateral_to_ipsilateral_change_ratio')) v(d)),
"""


@query("M11_symptom_value", "coords outcomes sides", "WITH " + SYM + END + "SELECT subject,network,metric,definition,round(value,6)+0.0 AS value FROM sx WHERE b=rc::INT")
def m11(t):
    d = ST.symptom_values(lateral(t), t.sides())
    return out(d.select("subject", *K, "definition", F.when(F.col("right"), F.col("if_right")).otherwise(F.col("if_left")).alias("value")), ["subject", *K, "definition"])


@query("P9_side_label_null", "coords outcomes sides", "WITH " + SYM + """ sa AS (SELECT bits FROM range(64) r(bits) WHERE bit_count(bits)=2),
 ob AS (SELECT network,metric,definition FROM sx WHERE b=rc::INT GROUP BY ALL HAVING count(value)=6),
 sv2 AS (SELECT bits,x.network,x.metric,x.definition,x.subject,x.value FROM sx x JOIN sa ON x.b=((bits>>CAST(substr(x.subject,2) AS INT))&1) JOIN ob USING (network,metric,definition)
   UNION ALL SELECT -1,x.network,x.metric,x.definition,x.subject,x.value FROM sx x JOIN ob USING (network,metric,definition) WHERE b=rc::INT),
 sk AS (SELECT endpoint,bits,network,metric,definition,rank() OVER (PARTITION BY endpoint,bits,network,metric,definition ORDER BY value)+(count(*) OVER (PARTITION BY endpoint,bits,network,metric,definition,value)-1)/2.0 AS rx,
   rank() OVER (PARTITION BY endpoint,bits,network,metric,definition ORDER BY y) AS ry,count(value) OVER (PARTITION BY endpoint,bits,network,metric,definition) AS nn FROM sv2 JOIN outcomes USING (subject) WHERE endpoint IN ('balance','top')),
 sr AS (SELECT endpoint,bits,network,metric,definition,corr(rx,ry) AS rho FROM sk WHERE nn=6 GROUP BY ALL)
 SELECT n.endpoint,n.network,n.metric,n.definition,round(any_value(o.rho),6)+0.0 AS rho,round(avg((abs(n.rho)>=abs(o.rho)-1e-12)::INT),6) AS p_side_label_exact,count(*) AS valid_assignments
 FROM sr n JOIN sr o ON n.endpoint=o.endpoint AND n.network=o.network AND n.metric=o.metric AND n.definition=o.definition WHERE n.bits>=0 AND o.bits=-1 AND n.rho IS NOT NULL AND NOT isnan(n.rho) GROUP BY ALL""")
def p9(t):
    k = [*K, "definition"]
    d = ST.symptom_values(lateral(t), t.sides()).join(t.outcomes().filter("endpoint in ('balance', 'top')"), "subject")
    ts = cut(ST.side_tests(d, k))
    nulls = P.side_label_null(ts, k, t.spark).filter(F.col("null").isNotNull())
    p = nulls.groupBy("endpoint", *k).agg(
        F.first("rho").alias("rho"), P.share(P.ge(F.abs("null"), F.abs("rho"))).alias("p_side_label_exact"), F.count(F.lit(1)).alias("valid_assignments")
    )
    return out(p, ["endpoint", *k])


@query("P10_paired_signflip", "coords", "WITH " + SM + """ pr AS (SELECT network,metric,subject,max(value) FILTER (visit=2)-max(value) FILTER (visit=1) AS d FROM sm WHERE visit>0 GROUP BY ALL),
 pl AS (SELECT network,metric,list(d ORDER BY subject) AS d,avg(d) AS mean FROM pr GROUP BY ALL),
 fl AS (SELECT network,metric,mean,list_sum([CASE WHEN (b>>(k-1))&1=1 THEN -d[k] ELSE d[k] END for k in range(1,7)])/6 AS nul FROM pl,range(64) r(b))
 SELECT network,metric,6 AS n,round(mean,6)+0.0 AS mean_difference,round(avg((nul>=mean-1e-15)::INT),6) AS p_greater,round(avg((abs(nul)>=abs(mean)-1e-15)::INT),6) AS p_two,count(*) AS n_signflips FROM fl GROUP BY ALL""")
def p10(t):
    m = M.session_metrics(coords(t), S).filter("visit > 0")
    at = lambda v: F.max(F.when(F.col("visit") == v, F.col("value")))
    return out(P.paired_signflip(m.groupBy(*K, "subject").agg((at(2) - at(1)).alias("d")), K), K)


ICC = """ ic AS (SELECT network,metric,subject,visit,value AS x,avg(value) OVER (PARTITION BY network,metric) AS g,avg(value) OVER (PARTITION BY network,metric,subject) AS r,avg(value) OVER (PARTITION BY network,metric,visit) AS c FROM sm WHERE visit>0),
 ia AS (SELECT network,metric,2*sum((r-g)**2)/2/5 AS msr,6*sum((c-g)**2)/6/1 AS msc,sum((x-r-c+g)**2)/5 AS mse FROM ic GROUP BY ALL),
 icc AS (SELECT network,metric,(msr-mse)/(msr+mse+2*(msc-mse)/6) AS icc21 FROM ia), """


@query("P11_icc21", "coords", "WITH " + SM + ICC + END + "SELECT network,metric,round(icc21,6)+0.0 AS icc21 FROM icc")
def p11(t):
    m = cut(M.session_metrics(coords(t), S).filter("visit > 0").withColumnRenamed("value", "x"))
    return out(P.icc21(m, K), K)


@query("P33_retest_reliability", "coords", "WITH " + SM + ICC + END + "SELECT count(*) AS n_metrics,round(quantile_cont(icc21,.5),6)+0.0 AS median,round(avg((icc21>=.6)::INT),6) AS frac_ge_0_6,round(avg((icc21<.4)::INT),6) AS frac_lt_0_4 FROM icc")
def p33(t):
    m = cut(M.session_metrics(coords(t), S).filter("visit > 0").withColumnRenamed("value", "x"))
    return out(ST.reliability_summary(P.icc21(m, K)), ["n_metrics"])


FT = " UNION ALL ".join(f"SELECT subject,visit,parcel||':g{i}' AS feature,g{i} AS x FROM coords" for i in range(1, 5))


def sim_sql(ft: str = "ft", name: str = "sim", k: str = "") -> str:
    kk = f"{k}," if k else ""
    on = f" AND a.{k}=b.{k}" if k else ""
    return f"""{name} AS (SELECT {'a.' + k + ',' if k else ''}a.subject,a.visit,b.subject AS subject2,b.visit AS visit2,corr(a.x,b.x) AS r FROM {ft} a JOIN {ft} b ON a.feature=b.feature{on} AND (a.subject<>b.subject OR a.visit<>b.visit) GROUP BY ALL),
"""


def near_sql(sim: str = "sim", name: str = "nr", k: str = "", where: str = "TRUE") -> str:
    kk = f"{k}," if k else ""
    return f"""{name} AS (SELECT {kk}subject,visit,arg_max(subject2,r) AS near_subject,arg_max(visit2,r) AS near_visit,max(r) AS best,max(r) FILTER (subject=subject2) AS own_max,max(r) FILTER (subject<>subject2) AS other_max,
 avg(r) FILTER (subject=subject2) AS own_mean,avg(r) FILTER (subject<>subject2) AS other_mean FROM {sim} WHERE {where} GROUP BY ALL),
"""


@query("P12_session_similarity", "coords", f"WITH ft AS ({FT})," + sim_sql() + END + "SELECT subject,visit,subject2,visit2,round(r,6)+0.0 AS r FROM sim")
def p12(t):
    return out(Y.similarity(Y.coordinate_features(coords(t))), ["subject", "visit", "subject2", "visit2"])


IDENT = f"WITH ft AS ({FT})," + sim_sql() + near_sql()


@query("P13_identification", "coords", IDENT + END + """SELECT subject,visit,near_subject,near_visit,round(own_max-other_max,6)+0.0 AS margin,subject=near_subject AS hit FROM nr""")
def p13(t):
    n = cut(Y.nearest(cut(Y.similarity(Y.coordinate_features(coords(t))))))
    Y.require_untied(n)
    return n.select(*S, "near_subject", "near_visit", r6(F.col("own_max") - F.col("other_max")).alias("margin"), "hit")


@query("P13_identification_summary", "coords", IDENT + """ pr AS (SELECT *,subject=subject2 AS same FROM sim WHERE subject||visit<subject2||visit2) SELECT
 (SELECT count(*) FILTER (subject=near_subject) FROM nr) AS correct,(SELECT count(*) FROM nr) AS n_sessions,(SELECT round(avg(own_max-other_max),6)+0.0 FROM nr) AS margin_mean,(SELECT round(min(own_max-other_max),6)+0.0 FROM nr) AS margin_min,
 round(avg(r) FILTER (same),6)+0.0 AS within_mean,round(min(r) FILTER (same),6)+0.0 AS within_min,round(avg(r) FILTER (NOT same),6)+0.0 AS between_mean,round(max(r) FILTER (NOT same),6)+0.0 AS between_max FROM pr""")
def p13s(t):
    sim = cut(Y.similarity(Y.coordinate_features(coords(t))))
    return out(Y.identification_summary(sim, Y.nearest(sim)).drop("ties"), ["correct", "n_sessions"])


NULLH = """ ix AS (SELECT CAST(substr(subject,2) AS INT) AS s,visit AS v,CAST(substr(near_subject,2) AS INT) AS s2,near_visit AS v2 FROM nr),
 p6 AS (SELECT perm,p FROM perms WHERE n=6), pp AS (SELECT a.p AS a,b.p AS b FROM p6 a CROSS JOIN p6 b), cfg AS (SELECT list(s ORDER BY s,v) AS s,list(v ORDER BY s,v) AS v,list(s2 ORDER BY s,v) AS s2,list(v2 ORDER BY s,v) AS v2 FROM ix),
 sc AS (SELECT list_sum([(CASE v[k] WHEN 0 THEN s[k] WHEN 1 THEN a[s[k]+1] ELSE b[s[k]+1] END = CASE v2[k] WHEN 0 THEN s2[k] WHEN 1 THEN a[s2[k]+1] ELSE b[s2[k]+1] END)::INT for k in range(1,19)]) AS score FROM pp,cfg),
 hs AS (SELECT CAST(score AS INT) AS score,count(*) AS "count" FROM sc GROUP BY 1), """


@query("P14_identification_null_exact", "coords perms", IDENT + NULLH + END + 'SELECT score,"count" FROM hs')
def p14(t):
    n = cut(Y.nearest(Y.similarity(Y.coordinate_features(coords(t)))))
    return Y.identification_null(n)


@query("P14_identification_null_sampled")
def p14s(t):
    n = cut(Y.nearest(Y.similarity(Y.coordinate_features(coords(t)))))
    return Y.null_summary(Y.identification_null(n, draws=20_000, limit=0), n, sampled=True)


@query("P14_identification_p", "coords perms", IDENT + NULLH + ' cr AS (SELECT count(*) FILTER (subject=near_subject) AS correct FROM nr) SELECT correct,round(sum("count") FILTER (score>=correct)/sum("count"),6) AS p,CAST(sum("count") AS BIGINT) AS null_count,round(sum(score*"count")/sum("count"),6) AS null_mean,max(score) AS null_max FROM hs,cr GROUP BY correct')
def p14p(t):
    n = cut(Y.nearest(Y.similarity(Y.coordinate_features(coords(t)))))
    return out(Y.null_summary(Y.identification_null(n), n).na.fill(0.0, ["p"]), ["correct", "null_count", "null_max"])


def xv_sql(k: str = "") -> str:
    kk = f"{k}," if k else ""
    return near_sql("sim", "nx", k, "visit<>visit2") + f" xv AS (SELECT {kk}avg((subject=near_subject)::INT) AS acc,avg(own_mean)-avg(other_mean) AS margin FROM nx GROUP BY ALL), "


ZN = {
    "z": "(x-avg(x) OVER f)/(stddev_pop(x) OVER f+1e-12)",
    "rank": "rank() OVER (PARTITION BY representation,feature ORDER BY x)+(count(*) OVER (PARTITION BY representation,feature,x)-1)/2.0",
    "center": "x-avg(x) OVER f",
}


@query("P15_visit_excluded_identification", "coords", f"WITH ft AS ({FT})," + sim_sql() + xv_sql() + END + "SELECT round(acc,6) AS acc,round(margin,6)+0.0 AS margin FROM xv")
def p15(t):
    return out(Y.cross_visit_identification(Y.coordinate_features(coords(t))).drop("ties"), [])


RF = f"""rf AS (SELECT 'G1' AS representation,subject,visit,parcel||':g1' AS feature,g1 AS x FROM coords UNION ALL SELECT 'G1-G4',subject,visit,feature,x FROM ({FT})),
 ce AS (SELECT subject,visit,i,j,ln(1+w) AS w FROM edges WHERE i<44 AND j<44), ss AS (SELECT DISTINCT subject,visit FROM edges), cn AS (SELECT idx FROM nodes WHERE tissue='cortex'),
 nw AS (SELECT subject,visit,i AS node,w FROM ce UNION ALL SELECT subject,visit,j,w FROM ce), ns AS (SELECT subject,visit,idx AS node,coalesce(sum(w),0) AS s,count(w) AS k FROM ss CROSS JOIN cn LEFT JOIN nw USING (subject,visit) WHERE node=idx GROUP BY ALL),
 pe AS (SELECT ss.subject,ss.visit,p.i,p.j,coalesce(w,0) AS w FROM ss CROSS JOIN (SELECT a.idx AS i,b.idx AS j FROM cn a JOIN cn b ON a.idx<b.idx) p LEFT JOIN ce ON ce.subject=ss.subject AND ce.visit=ss.visit AND ce.i=p.i AND ce.j=p.j),
 gf AS (SELECT * FROM rf UNION ALL SELECT 'node_strength',subject,visit,node::VARCHAR,s FROM ns UNION ALL SELECT 'node_degree',subject,visit,node::VARCHAR,k FROM ns UNION ALL SELECT 'edges_log1p',subject,visit,i||'-'||j,w FROM pe),
"""


def all_features(t: Tables):
    c = coords(t)
    g = Y.coordinate_features(c, ("g1",)).withColumn("representation", F.lit("G1")).unionByName(
        Y.coordinate_features(c).withColumn("representation", F.lit("G1-G4")))
    return cut(g.unionByName(Y.graph_features(cut(t.edges()), t.nodes())))


R = ["representation"]


@query("P16_representations", "coords edges nodes", "WITH " + RF + f"""mf AS (SELECT 'raw:'||representation AS m,subject,visit,feature,x FROM gf UNION ALL SELECT 'z:'||representation,subject,visit,feature,{ZN['z']} FROM gf WINDOW f AS (PARTITION BY representation,feature)), """
       + sim_sql("mf", "sim", "m") + xv_sql("m") + END + "SELECT m AS representation,round(acc,6) AS acc,round(margin,6)+0.0 AS margin FROM xv")
def p16(t):
    f = all_features(t)
    both = f.withColumn("representation", F.concat(F.lit("raw:"), "representation")).unionByName(
        Y.standardise(f, R).withColumn("representation", F.concat(F.lit("z:"), "representation")))
    return out(Y.cross_visit_identification(both, R).drop("ties"), R)


@query("P17_normalization_margins", "coords edges nodes", "WITH " + RF + "mf AS (" + " UNION ALL ".join(
    f"SELECT '{m}:'||representation AS m,subject,visit,feature,{e} AS x FROM gf WHERE representation<>'node_degree' WINDOW f AS (PARTITION BY representation,feature)" for m, e in ZN.items())
       + "), " + sim_sql("mf", "sim", "m") + xv_sql("m") + END + "SELECT m AS representation,round(margin,6)+0.0 AS margin FROM xv")
def p17(t):
    f = all_features(t).filter("representation <> 'node_degree'")
    parts = [Y.standardise(f, R, m).withColumn("representation", F.concat(F.lit(m + ":"), "representation")) for m in ("z", "rank", "center")]
    allm = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out(Y.cross_visit_identification(allm, R).select("representation", "margin"), R)


CM = f"""ec AS (SELECT *,{','.join(f'avg(g{i}) OVER (PARTITION BY subject,visit,hemi) AS h{i}' for i in range(1, 5))} FROM coords WHERE visit>0),
 ed AS (SELECT subject,hemi,parcel,max(e) FILTER (visit=2)-max(e) FILTER (visit=1) AS d FROM (SELECT *,{_d('g', 'h')} AS e FROM ec) GROUP BY ALL),
 er AS (SELECT *,rank() OVER (PARTITION BY subject,hemi ORDER BY d)+(count(*) OVER (PARTITION BY subject,hemi,d)-1)/2.0 AS r,count(*) OVER (PARTITION BY subject,hemi) AS n FROM ed),
 eh AS (SELECT a.subject AS subject_1,b.subject AS subject_2,a.hemi,corr(a.r,b.r) AS rho,max(a.n) AS n FROM er a JOIN er b ON a.hemi=b.hemi AND a.parcel=b.parcel AND a.subject<b.subject GROUP BY ALL), """


@query("P18_change_concordance", "coords", "WITH " + CM + END + """SELECT subject_1,subject_2,round(max(rho) FILTER (hemi='L'),6)+0.0 AS left_rho,round(max(rho) FILTER (hemi='R'),6)+0.0 AS right_rho,round(sum(rho*n)/sum(n),6)+0.0 AS node_weighted_rho FROM eh GROUP BY 1,2""")
def p18(t):
    return out(Y.concordance_pairs(cut(Y.change_maps(coords(t)))), ["subject_1", "subject_2"])


@query("P18_concordance_null")
def p18n(t):
    m = cut(Y.change_maps(coords(t)))
    return Y.concordance_summary(Y.concordance_pairs(m), Y.concordance_null(m, 20_000, 20260731))


@query("P19_rank_correlation", "coords", """WITH p AS (SELECT a.subject,a.parcel,a.g1 AS a,b.g1 AS b FROM coords a JOIN coords b ON a.subject=b.subject AND a.parcel=b.parcel WHERE a.visit=1 AND b.visit=2),
 r AS (SELECT subject,rank() OVER (PARTITION BY subject ORDER BY a)+(count(*) OVER (PARTITION BY subject,a)-1)/2.0 AS ra,rank() OVER (PARTITION BY subject ORDER BY b)+(count(*) OVER (PARTITION BY subject,b)-1)/2.0 AS rb FROM p)
 SELECT subject,round(corr(ra,rb),6)+0.0 AS rho FROM r GROUP BY 1""")
def p19(t):
    p = cut(M.pair_visits(coords(t), "subject", 1, 2).select("subject", "parcel", "a_g1", "b_g1"))
    return out(ST.rank_correlation(p, ["subject"], "a_g1", "b_g1"), ["subject"])


@query("P38_theil_sen", "outcomes", """WITH q AS (SELECT a.subject,a.y AS x,b.y AS y FROM outcomes a JOIN outcomes b ON a.subject=b.subject WHERE a.endpoint='balance' AND b.endpoint='top'),
 s AS (SELECT quantile_cont((b.y-a.y)/(b.x-a.x),.5) AS slope FROM q a JOIN q b ON a.subject<b.subject AND a.x<>b.x)
 SELECT 'top' AS endpoint,round(slope,6)+0.0 AS slope,round(quantile_cont(y-slope*x,.5),6)+0.0 AS intercept FROM q,s GROUP BY slope""")
def p38(t):
    o = cut(t.outcomes())
    q = o.filter("endpoint = 'balance'").select("subject", F.col("y").alias("x")).join(o.filter("endpoint = 'top'"), "subject")
    return out(P.theil_sen(q, ["endpoint"]), ["endpoint"])
