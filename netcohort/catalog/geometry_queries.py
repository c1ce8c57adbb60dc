"""Registered geometry queries over parcel coordinates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import AXES, r6
from ..operators import geometry as M
from ..session import cut
from .fixtures import NETWORKS, Tables
from .registry import query

S = ["subject", "visit"]
SN = ["subject", "visit", "network"]


def coords(t: Tables):
    return cut(t.coords())


def out(df, keys, digits=6):
    return df.select(*keys, *[r6(c, digits).alias(c) if df.schema[c].dataType.simpleString() == "double" else F.col(c)
                              for c in df.columns if c not in keys])


def _d(a: str, b: str) -> str:
    return "sqrt(" + "+".join(f"({a}{i}-{b}{i})**2" for i in range(1, 5)) + ")"


def _over(prefix: str, part: str) -> str:
    return ",".join(f"avg(g{i}) OVER (PARTITION BY {part}) AS {prefix}{i}" for i in range(1, 5))


CC = f"cc AS (SELECT *,{_over('h', 'subject,visit,hemi')},{_over('c', 'subject,visit,hemi,network')} FROM coords),\n"
_long = " UNION ALL ".join(
    [f"SELECT subject,visit,network,'eccentricity' AS m,{_d('g', 'h')} AS v FROM cc", f"SELECT subject,visit,network,'dispersion_4d',{_d('g', 'c')} FROM cc"]
    + [f"SELECT subject,visit,network,'G{i}_position',g{i}-h{i} FROM cc" for i in range(1, 5)]
)
_res = " UNION ALL ".join(f"SELECT subject,visit,network,'G{i}_dispersion' AS m,g{i}-c{i} AS v FROM cc" for i in range(1, 5))
SM = CC + f"""lg AS ({_long}), rs AS ({_res}),
sm AS (SELECT subject,visit,network,m||'_mean' AS metric,avg(v) AS value FROM lg GROUP BY ALL
 UNION ALL SELECT subject,visit,network,m||'_median',quantile_cont(v,.5) FROM lg GROUP BY ALL
 UNION ALL SELECT subject,visit,network,m||'_sd',sqrt(sum(v*v)/(count(*)-2)) FROM rs GROUP BY ALL
 UNION ALL SELECT subject,visit,network,m||'_mad',quantile_cont(abs(v),.5) FROM rs GROUP BY ALL),
"""
PV = "pv AS (SELECT a.subject,a.parcel,a.hemi,a.network," + ",".join(f"a.g{i} AS a{i},b.g{i} AS b{i}" for i in range(1, 5)) + """
 FROM coords a JOIN coords b ON a.subject=b.subject AND a.parcel=b.parcel WHERE a.visit=1 AND b.visit=2),
"""
_cs = ",".join(f"avg(a{i}) AS a{i},avg(b{i}) AS b{i}" for i in range(1, 5))
IM = PV + f"""cs AS (SELECT subject,network,hemi,{_d('b', 'a')} AS s FROM (SELECT subject,network,hemi,{_cs} FROM pv GROUP BY ALL)),
im AS (SELECT subject,network,'parcel_displacement_mean' AS metric,avg({_d('b', 'a')}) AS value FROM pv GROUP BY ALL
 UNION ALL SELECT subject,network,'parcel_displacement_median',quantile_cont({_d('b', 'a')},.5) FROM pv GROUP BY ALL
 UNION ALL SELECT subject,network,'centroid_shift_mean_hemispheres',avg(s) FROM cs GROUP BY ALL
 UNION ALL SELECT subject,network,'centroid_shift_rms_hemispheres',sqrt(avg(s*s)) FROM cs GROUP BY ALL),
"""
SD = SM + IM + """sd AS (SELECT subject,network,metric,max(value) FILTER (visit=1) AS post1,max(value) FILTER (visit=2) AS post2,
  max(value) FILTER (visit=2)-max(value) FILTER (visit=1) AS delta FROM sm WHERE visit IN (1,2) GROUP BY ALL
 UNION ALL SELECT subject,network,metric,NULL,NULL,value FROM im),
"""
END = " zz AS (SELECT 1) "


@query("M1_session_metrics", "coords", "WITH " + SM + END + "SELECT subject,visit,network,metric,round(value,6)+0.0 AS value FROM sm")
def m1(t):
    return out(M.session_metrics(coords(t), S), [*SN, "metric"])


@query("M2_interval_metrics", "coords", "WITH " + IM + END + "SELECT subject,network,metric,round(value,6)+0.0 AS value FROM im")
def m2(t):
    return out(M.interval_metrics(coords(t), geomedian=False), ["subject", "network", "metric"])


@query("M2_geomedian_shift")
def m2g(t):
    d = M.interval_metrics(coords(t)).filter("metric = 'geomedian_shift_mean_hemispheres'")
    return out(d, ["subject", "network", "metric"])


# an independent search: the reweighted mean repeated 300 times, then compared with every data point
@query("M3_geometric_median", "coords", "WITH p AS (SELECT subject,visit,network,hemi,parcel,g1,g2,g3,g4 FROM coords), gm AS (SELECT subject,visit,network,hemi,0 AS it,avg(g1) AS m1,avg(g2) AS m2,avg(g3) AS m3,avg(g4) AS m4 FROM p GROUP BY ALL "
       "UNION ALL (SELECT subject,visit,network,hemi,max(it)+1,sum(g1/r)/sum(1/r),sum(g2/r)/sum(1/r),sum(g3/r)/sum(1/r),sum(g4/r)/sum(1/r) FROM "
       "(SELECT p.*,it,greatest(sqrt((g1-m1)**2+(g2-m2)**2+(g3-m3)**2+(g4-m4)**2),1e-300) AS r FROM p JOIN gm USING (subject,visit,network,hemi) WHERE it<300) GROUP BY subject,visit,network,hemi)), "
       "cd AS (SELECT subject,visit,network,hemi,-1 AS id,m1,m2,m3,m4 FROM gm WHERE it=300 UNION ALL SELECT subject,visit,network,hemi,parcel,g1,g2,g3,g4 FROM p), "
       "fs AS (SELECT c.*,(SELECT sum(sqrt((g1-m1)**2+(g2-m2)**2+(g3-m3)**2+(g4-m4)**2)) FROM p WHERE p.subject=c.subject AND p.visit=c.visit AND p.network=c.network AND p.hemi=c.hemi) AS f FROM cd c) "
       "SELECT subject,visit,network,hemi,round(arg_min(m1,f),4)+0.0 AS m_g1,round(arg_min(m2,f),4)+0.0 AS m_g2,round(arg_min(m3,f),4)+0.0 AS m_g3,round(arg_min(m4,f),4)+0.0 AS m_g4 FROM fs GROUP BY ALL")
def m3(t):
    return out(M.geometric_median(coords(t), [*SN, "hemi"]), [*SN, "hemi"], 4)


@query("M4_reference_eccentricity", "coords", f"""WITH rf AS (SELECT hemi,{','.join(f'avg(g{i}) AS h{i}' for i in range(1, 5))} FROM coords WHERE visit=0 GROUP BY 1)
 SELECT subject,visit,parcel,c.hemi,round({_d('g', 'h')},6) AS eccentricity FROM coords c JOIN rf ON c.hemi=rf.hemi""")
def m4(t):
    c = coords(t)
    ref = M.centre(c.filter("visit = 0"), ["hemi"], "h_")
    return out(M.reference_eccentricity(c, F.broadcast(ref), ["hemi"]).select("subject", "visit", "parcel", "hemi", "eccentricity"), ["subject", "visit", "parcel", "hemi"])


@query("M4_axis_range", "coords", "SELECT subject,visit,hemi," + ",".join(f"round(max(g{i})-min(g{i}),6) AS range_g{i}" for i in range(1, 5)) + " FROM coords GROUP BY 1,2,3")
def m4r(t):
    return out(M.axis_range(t.coords(), [*S, "hemi"]), [*S, "hemi"])


@query("M5_displacement", "coords", "WITH " + PV + END + f"SELECT subject,parcel,hemi,network,round({_d('b', 'a')},6) AS displacement FROM pv")
def m5(t):
    d = M.displacement(M.pair_visits(coords(t), "subject", 1, 2))
    return out(d.select("subject", "parcel", "hemi", "network", "displacement"), ["subject", "parcel", "hemi", "network"])


@query("M6_paired_change", "coords", "WITH " + PV + f"rf AS (SELECT hemi,{','.join(f'avg(g{i}) AS h{i}' for i in range(1, 5))} FROM coords WHERE visit=0 GROUP BY 1) "
       + f"SELECT subject,parcel,pv.hemi,network,round({_d('b', 'a')},6) AS displacement,round({_d('b', 'h')}-{_d('a', 'h')},6)+0.0 AS eccentricity_change,"
       + ",".join(f"round(b{i}-a{i},6)+0.0 AS delta_g{i}" for i in range(1, 5)) + " FROM pv JOIN rf ON pv.hemi=rf.hemi")
def m6(t):
    c = coords(t)
    ref = F.broadcast(M.centre(c.filter("visit = 0"), ["hemi"], "h_"))
    return out(M.paired_change(c, ref, 1, 2), ["subject", "parcel", "hemi", "network"])


@query("M7_study_deltas", "coords", "WITH " + SD + END + "SELECT subject,network,metric,round(post1,6)+0.0 AS post1,round(post2,6)+0.0 AS post2,round(delta,6)+0.0 AS delta FROM sd")
def m7(t):
    c = coords(t)
    return out(M.study_deltas(M.session_metrics(c, S), M.interval_metrics(c, geomedian=False)), ["subject", "network", "metric"])


def hemi_sql(pooled: bool, name: str) -> str:
    """Lateral (or historical pooled) measures without the geometric median."""
    side = "" if pooled else "hemi,"
    k = f"subject,visit,{side}network"
    pos = (lambda i: f"g{i}") if pooled else (lambda i: f"g{i}-o{i}")
    rows = " UNION ALL ".join(
        [f"SELECT {k},'eccentricity' AS m,{_d('g', 'o')} AS v FROM {name}c", f"SELECT {k},'dispersion_4d',{_d('g', 'n')} FROM {name}c"]
        + [f"SELECT {k},'G{i}_position',{pos(i)} FROM {name}c" for i in range(1, 5)]
    )
    mad = " UNION ALL ".join(
        f"SELECT {k},'G{i}_dispersion_mad' AS metric,quantile_cont(abs(g{i}-{'q' if pooled else 'n'}{i}),.5) AS value FROM {name}c GROUP BY ALL" for i in range(1, 5)
    )
    sd = " UNION ALL ".join(f"SELECT {k},'G{i}_dispersion_sd',stddev_samp(g{i}) FROM {name}c GROUP BY ALL" for i in range(1, 5))
    med = ",".join(f"quantile_cont(g{i},.5) OVER (PARTITION BY {k}) AS q{i}" for i in range(1, 5))
    return f"""{name}c AS (SELECT *,{_over('o', 'subject,visit' + ('' if pooled else ',hemi'))},{_over('n', k)},{med} FROM coords WHERE visit IN (1,2)),
{name}l AS ({rows}),
{name} AS (SELECT {k},m||'_mean' AS metric,avg(v) AS value FROM {name}l GROUP BY ALL
 UNION ALL SELECT {k},m||'_median',quantile_cont(v,.5) FROM {name}l WHERE m<>'dispersion_4d' GROUP BY ALL
 UNION ALL SELECT {k},'centroid_eccentricity',max({_d('n', 'o')}) FROM {name}c GROUP BY ALL UNION ALL {sd} UNION ALL {mad}),
"""


def int_sql(pooled: bool, name: str) -> str:
    k = "subject,network" if pooled else "subject,hemi,network"
    return f"""{name} AS (SELECT {k},'parcel_displacement_mean' AS metric,avg({_d('b', 'a')}) AS value FROM pv GROUP BY ALL
 UNION ALL SELECT {k},'parcel_displacement_median',quantile_cont({_d('b', 'a')},.5) FROM pv GROUP BY ALL
 UNION ALL SELECT {k},'centroid_shift',{_d('b', 'a')} FROM (SELECT {k},{_cs} FROM pv GROUP BY ALL)),
"""


_piv = "max(value) FILTER (visit=1) AS post1,max(value) FILTER (visit=2) AS post2,max(value) FILTER (visit=2)-max(value) FILTER (visit=1) AS delta"
LV = PV + hemi_sql(False, "hs") + int_sql(False, "hi") + hemi_sql(True, "ps") + int_sql(True, "pi") + f"""
sv AS (SELECT subject,hemi,network,metric,{_piv} FROM hs GROUP BY ALL UNION ALL SELECT subject,hemi,network,metric,NULL,NULL,value FROM hi),
wl AS (SELECT subject,network,count(*) FILTER (hemi='L')/count(*) AS w FROM coords WHERE visit=1 GROUP BY ALL),
lr AS (SELECT l.subject,l.network,l.metric,w,l.post1 AS l1,l.post2 AS l2,l.delta AS ld,r.post1 AS r1,r.post2 AS r2,r.delta AS rd FROM sv l JOIN sv r USING (subject,network,metric) JOIN wl USING (subject,network) WHERE l.hemi='L' AND r.hemi='R'),
lv AS (SELECT subject,network,metric,CASE hemi WHEN 'L' THEN 'left_only' ELSE 'right_only' END AS definition,post1,post2,delta FROM sv
 UNION ALL SELECT subject,network,metric,'hemisphere_parcel_weighted',w*l1+(1-w)*r1,w*l2+(1-w)*r2,w*ld+(1-w)*rd FROM lr
 UNION ALL SELECT subject,network,metric,'hemisphere_equal_weighted',.5*l1+.5*r1,.5*l2+.5*r2,.5*ld+.5*rd FROM lr
 UNION ALL SELECT subject,network,metric,'historical_bilateral_pooled',{_piv} FROM ps GROUP BY ALL
 UNION ALL SELECT subject,network,metric,'historical_bilateral_pooled',NULL,NULL,value FROM pi),
"""
SAFE = """CASE WHEN definition='historical_bilateral_pooled' THEN CASE WHEN starts_with(metric,'parcel_displacement_') THEN 'interpretable_parcelwise_rotation_invariant' ELSE 'not_interpretable_independent_coordinate_pooling' END
 WHEN contains(metric,'_position_') THEN 'signed_axis_reference_dependent' WHEN contains(metric,'_dispersion_s') OR contains(metric,'_dispersion_mad') THEN 'axis_identity_dependent'
 ELSE 'interpretable_rotation_invariant_within_hemisphere' END"""


@query("M8_hemisphere_metrics", "coords", "WITH " + hemi_sql(False, "hs") + END + "SELECT subject,visit,hemi,network,metric,round(value,6)+0.0 AS value FROM hs")
def m8(t):
    c = coords(t).filter("visit in (1, 2)")
    return out(M.hemisphere_metrics(c, S, geomedian=False), [*S, "hemi", "network", "metric"])


@query("M8_historical_pooled", "coords", "WITH " + hemi_sql(True, "ps") + END + "SELECT subject,visit,network,metric,round(value,6)+0.0 AS value FROM ps")
def m8p(t):
    c = coords(t).filter("visit in (1, 2)")
    return out(M.hemisphere_metrics(c, S, pooled=True, geomedian=False), [*SN, "metric"])


LKEY = ["subject", "network", "metric", "definition"]


@query("M9_lateral_values", "coords", "WITH " + LV + END + "SELECT subject,network,metric,definition,round(post1,6)+0.0 AS post1,round(post2,6)+0.0 AS post2,round(delta,6)+0.0 AS delta FROM lv")
def m9(t):
    return out(M.lateral_values(coords(t), geomedian=False).drop("safety_class"), LKEY)


@query("M10_safety_class", "coords", "WITH " + LV + END + f"SELECT definition,metric,{SAFE} AS safety_class,count(*) AS n FROM lv GROUP BY ALL")
def m10(t):
    return M.lateral_values(coords(t), geomedian=False).groupBy("definition", "metric", "safety_class").agg(F.count(F.lit(1)).alias("n"))


@query("M12_matched_gradient", "coords", f"""WITH pc AS (SELECT *,{_over('h', 'subject,visit')},{_over('c', 'subject,visit,network')} FROM coords),
 v AS (SELECT subject,network,visit,quantile_cont({_d('g', 'h')},.5) AS ecc,quantile_cont({_d('g', 'c')},.5) AS disp,avg(g1) AS g1pos FROM pc WHERE visit>0 GROUP BY ALL), {PV}
 mv AS (SELECT subject,network,avg({_d('b', 'a')}) AS move FROM pv GROUP BY ALL)
 SELECT a.subject,a.network,round(b.ecc-a.ecc,6)+0.0 AS ecc,round(b.disp-a.disp,6)+0.0 AS disp,round(b.g1pos-a.g1pos,6)+0.0 AS g1pos,round(move,6) AS move
 FROM v a JOIN v b ON a.subject=b.subject AND a.network=b.network JOIN mv ON mv.subject=a.subject AND mv.network=a.network WHERE a.visit=1 AND b.visit=2""")
def m12g(t):
    from ..plans.studies import matched_gradient

    return out(matched_gradient(coords(t)), ["subject", "network"])


LAB = """sid AS (SELECT subject, CASE side WHEN 'L' THEN 'R' ELSE 'L' END AS contra FROM sides),
 pf AS (SELECT c.*,{o},CASE WHEN hemi=contra THEN 'contra' ELSE 'ipsi' END AS side FROM coords c JOIN sid USING (subject)),
 pe AS (SELECT *,{e} AS ecc FROM pf),""".format(o=_over("h", "subject,visit"), e=_d("g", "h"))


def contra(t: Tables):
    return t.sides().select("subject", F.when(F.col("side") == "L", "R").otherwise("L").alias("contra"))


def _regions(pairs: str) -> str:
    return f"""rg AS (SELECT *, network||'_'||side AS region FROM pe UNION ALL SELECT *,'motor3' FROM pe WHERE network IN ('SomMot','DorsAttn','Cont') {pairs}),"""


@query("M13_region_eccentricity", "coords outcomes sides", "WITH " + LAB + _regions("""UNION ALL SELECT *,'cortex_'||side FROM pe UNION ALL SELECT *,'motor3_'||side FROM pe WHERE network IN ('SomMot','DorsAttn','Cont')
 UNION ALL SELECT *,'motor2' FROM pe WHERE network IN ('SomMot','DorsAttn')""") + END + "SELECT subject,visit,region||'_ecc' AS metric,round(avg(ecc),6) AS value FROM rg GROUP BY ALL")
def m13e(t):
    d = M.pooled_frame(coords(t), S, contra(t))
    ecc, _ = M.lateral_regions(NETWORKS)
    r = M.region_rows(d, ecc).groupBy(*S, F.concat("region", F.lit("_ecc")).alias("metric")).agg(F.avg("ecc").alias("value"))
    return out(r, [*S, "metric"])


@query("M13_region_dispersion", "coords outcomes sides", "WITH " + LAB + _regions("") + f"rc AS (SELECT *,{_over('c', 'subject,visit,region')} FROM rg), " + END
       + f"SELECT subject,visit,region||'_disp' AS metric,round(avg({_d('g', 'c')}),6) AS value FROM rc GROUP BY ALL")
def m13d(t):
    d = M.pooled_frame(coords(t), S, contra(t))
    _, both = M.lateral_regions(NETWORKS)
    return out(M.region_spread(d, S, both), [*S, "metric"])


@query("M13_signed_medians", "coords", "SELECT subject,visit,metric,round(value,6)+0.0 AS value FROM (" + " UNION ALL ".join(
    f"SELECT subject,visit,network||'_G{i}_median' AS metric,quantile_cont(g{i},.5) AS value FROM coords GROUP BY ALL UNION ALL SELECT subject,visit,'cortex_G{i}_median',quantile_cont(g{i},.5) FROM coords GROUP BY ALL"
    for i in range(1, 5)) + ")")
def m13s(t):
    from ..plans.studies import signed_medians

    return out(signed_medians(coords(t), S), [*S, "metric"])


def _netdist(center: str) -> str:
    names = "[" + ",".join(f"'{n}'" for n in NETWORKS) + "]"
    return f"""WITH nc AS (SELECT subject,visit,network,list_position({names},network) AS o,{','.join(f'{center.format(i)} AS m{i}' for i in range(1, 5))} FROM coords GROUP BY subject,visit,network)
 SELECT a.subject,a.visit,a.network||'_'||b.network||'_distance' AS metric,round(sqrt({'+'.join(f'(a.m{i}-b.m{i})**2' for i in range(1, 5))}),6) AS value
 FROM nc a JOIN nc b ON a.subject=b.subject AND a.visit=b.visit AND a.o<b.o"""


@query("M13_network_distances", "coords", _netdist("quantile_cont(g{0},.5)"))
def m13n(t):
    return out(M.named_pairs(M.network_distances(coords(t), S, True), S, NETWORKS), [*S, "metric"])


@query("M13_displacement", "coords", "WITH pd AS (SELECT a.subject,b.visit,a.network,sqrt(" + "+".join(f"(a.g{i}-b.g{i})**2" for i in range(1, 5)) + """) AS d FROM coords a JOIN coords b ON a.subject=b.subject AND a.parcel=b.parcel WHERE a.visit=1)
 SELECT subject,visit,'cortex_displacement' AS metric,round(avg(d),6)+0.0 AS value FROM pd GROUP BY ALL UNION ALL SELECT subject,visit,network||'_displacement',round(avg(d),6)+0.0 FROM pd GROUP BY ALL""")
def m13m(t):
    from ..plans.studies import displacement_from_first

    return out(displacement_from_first(coords(t), 1), [*S, "metric"])


@query("M14_pooled_inventory", "coords", f"""WITH pf AS (SELECT *,{_over('h', 'subject,visit')},{_over('c', 'subject,visit,network')} FROM coords), pe AS (SELECT *,{_d('g', 'h')} AS ecc,{_d('g', 'c')} AS dsp FROM pf),
 nd AS ({_netdist('avg(g{0})').replace('WITH nc', 'WITH ncx').replace('FROM nc a JOIN nc b', 'FROM ncx a JOIN ncx b')})
 SELECT subject,visit,metric,round(value,6)+0.0 AS value FROM (
 SELECT subject,visit,'spectral_energy' AS metric,avg(ecc*ecc) AS value FROM pe GROUP BY ALL UNION ALL SELECT subject,visit,'cortex_ecc',avg(ecc) FROM pe GROUP BY ALL
 UNION ALL SELECT subject,visit,network||'_ecc',avg(ecc) FROM pe GROUP BY ALL UNION ALL SELECT subject,visit,network||'_disp',avg(dsp) FROM pe GROUP BY ALL
 UNION ALL SELECT subject,visit,metric,value FROM nd
 UNION ALL SELECT subject,visit,network||'_G1_median',quantile_cont(g1,.5) FROM coords GROUP BY ALL UNION ALL SELECT subject,visit,network||'_G2_median',quantile_cont(g2,.5) FROM coords GROUP BY ALL
 {' '.join(f"UNION ALL SELECT subject,visit,'G{i}_range',max(g{i})-min(g{i}) FROM coords GROUP BY ALL" for i in range(1, 5))})""")
def m14(t):
    from ..plans.studies import pooled_inventory

    return out(pooled_inventory(coords(t), S, NETWORKS, positions=True), [*S, "metric"])


@query("M14_median_centres", "coords", f"""WITH pf AS (SELECT *,{_over('h', 'subject,visit')},{_over('c', 'subject,visit,network')} FROM coords), pe AS (SELECT *,{_d('g', 'h')} AS ecc,{_d('g', 'c')} AS dsp FROM pf),
 nd AS ({_netdist('quantile_cont(g{0},.5)').replace('WITH nc', 'WITH ncx').replace('FROM nc a JOIN nc b', 'FROM ncx a JOIN ncx b')})
 SELECT subject,visit,metric,round(value,6)+0.0 AS value FROM (
 SELECT subject,visit,'spectral_energy' AS metric,avg(ecc*ecc) AS value FROM pe GROUP BY ALL UNION ALL SELECT subject,visit,'cortex_ecc',avg(ecc) FROM pe GROUP BY ALL
 UNION ALL SELECT subject,visit,network||'_ecc',avg(ecc) FROM pe GROUP BY ALL UNION ALL SELECT subject,visit,network||'_disp',avg(dsp) FROM pe GROUP BY ALL
 UNION ALL SELECT subject,visit,metric,value FROM nd
 {' '.join(f"UNION ALL SELECT subject,visit,'G{i}_range',max(g{i})-min(g{i}) FROM coords GROUP BY ALL" for i in range(1, 5))})""")
def m14m(t):
    from ..plans.studies import pooled_inventory

    return out(pooled_inventory(coords(t), S, NETWORKS, positions=False), [*S, "metric"])


@query("M15_kendall_tau", "coords", "WITH " + " , ".join(
    f"b{i} AS (SELECT a.subject,b.visit,a.parcel,a.g{i} AS x,b.g{i} AS y FROM coords a JOIN coords b ON a.subject=b.subject AND a.parcel=b.parcel WHERE a.visit=1), "
    f"k{i} AS (SELECT p.subject,p.visit,'g{i}' AS axis,sum(sign(p.x-q.x)*sign(p.y-q.y)) AS s,sum((p.x<>q.x)::INT) AS nx,sum((p.y<>q.y)::INT) AS ny FROM b{i} p JOIN b{i} q ON p.subject=q.subject AND p.visit=q.visit AND p.parcel<q.parcel GROUP BY ALL)"
    for i in range(1, 5)) + " SELECT subject,visit,axis,round(s/sqrt(CAST(nx AS DOUBLE)*ny),6)+0.0 AS tau FROM (" + " UNION ALL ".join(f"SELECT * FROM k{i}" for i in range(1, 5)) + ")")
def m15(t):
    from ..plans.studies import axis_ordering

    return out(axis_ordering(coords(t), 1), [*S, "axis"])


@query("M16_eigenvalue_share", "coords", """WITH e AS (SELECT subject,visit,hemi,unnest([1,2,3,4]) AS k,unnest([var_pop(g1),var_pop(g2),var_pop(g3),var_pop(g4)]) AS l FROM coords GROUP BY subject,visit,hemi),
 m AS (SELECT subject,visit,k,avg(l) AS l FROM e GROUP BY ALL) SELECT subject,visit,k,round(100*l/sum(l) OVER (PARTITION BY subject,visit),6) AS share FROM m""")
def m16(t):
    e = t.coords().groupBy(*S, "hemi").agg(*[F.var_pop(a).alias(a) for a in AXES])
    e = e.select(*S, "hemi", F.posexplode(F.array(*AXES)).alias("p", "lambda")).select(*S, "hemi", (F.col("p") + 1).alias("k"), "lambda")
    return out(M.eigenvalue_share(e, S), [*S, "k"])


@query("M18_variance_ratio", "coords", "WITH " + SM + """ vt AS (SELECT network,metric,var_samp(value) AS vt FROM sm GROUP BY ALL), ms AS (SELECT network,metric,subject,avg(value) AS m FROM sm GROUP BY ALL),
 vm AS (SELECT network,metric,var_samp(m) AS vm FROM ms GROUP BY ALL) SELECT network,metric,round(CASE WHEN vt>0 THEN least(1,greatest(0,vm/vt)) ELSE 0 END,6) AS variance_ratio FROM vt JOIN vm USING (network,metric)""")
def m18(t):
    return out(M.variance_ratio(cut(M.session_metrics(coords(t), S)), ["network", "metric"]), ["network", "metric"])


CAND = f"""WITH cv AS (SELECT *,{_over('h', 'subject,visit,hemi')},{_over('c', 'subject,visit,hemi,network')} FROM coords), {PV}
 v AS (SELECT subject,visit,quantile_cont({_d('g', 'h')},.5) FILTER (network='SomMot') AS e,quantile_cont(g1-h1,.5) FILTER (network='Cont') AS p,
  sqrt(sum((g3-c3)**2) FILTER (network='Vis')/(count(*) FILTER (network='Vis')-2)) AS s FROM cv WHERE visit>0 GROUP BY ALL),
 d AS (SELECT subject,avg({_d('b', 'a')}) AS x FROM pv WHERE network='Vis' GROUP BY 1)
 SELECT d.subject,round(x,6) AS vis_displacement_mean,round(b.e-a.e,6)+0.0 AS sommot_eccentricity_median,round(b.p-a.p,6)+0.0 AS cont_g2_position_median,round(b.s-a.s,6)+0.0 AS vis_g1_dispersion_sd
 FROM d JOIN v a ON a.subject=d.subject AND a.visit=1 JOIN v b ON b.subject=d.subject AND b.visit=2"""


@query("M19_candidate_values", "coords", CAND)
def m19(t):
    from ..plans.studies import candidate_values

    return out(candidate_values(coords(t), {0: "g3", 1: "g1"}), ["subject"])


@query("M20_network_mean_profile", "coords", "SELECT subject,visit,network," + ",".join(f"round(avg(g{i}),6) AS mean_g{i}" for i in range(1, 5)) + " FROM coords GROUP BY 1,2,3")
def m20(t):
    return out(t.coords().groupBy(*SN).agg(*[F.avg(a).alias("mean_" + a) for a in AXES]), SN)


@query("M21_direction_consistency", "coords", "WITH " + SD + END + """SELECT network,metric,greatest(count(*) FILTER (delta>0),count(*) FILTER (delta<0)) AS direction_consistency,round(avg(delta),6)+0.0 AS mean_delta,round(quantile_cont(delta,.5),6)+0.0 AS median_delta FROM sd GROUP BY ALL""")
def m21(t):
    c = coords(t)
    d = M.study_deltas(M.session_metrics(c, S), M.interval_metrics(c, geomedian=False))
    return out(M.direction_consistency(d, ["network", "metric"], "delta"), ["network", "metric"])
