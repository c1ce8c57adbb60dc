"""Registered voxel and streamline queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import order as O
from ..functions.expr import r6
from ..operators import tracks as T
from ..operators import voxels as V
from ..session import cut
from .fixtures import Tables
from .geometry_queries import END, out
from .registry import query

SHAPE = (16, 16, 16)
AFF = [2.0, 0, 0, 0, 0, 2.0, 0, 0, 0, 0, 2.0, 0, 0, 0, 0, 1.0]
XYZ = V.XYZ
IMG = V.IMG
GRID = "cell AS (SELECT a AS x,b AS y,c AS z FROM range(16) r(a),range(16) s(b),range(16) u(c)),"
DIL = "off AS (SELECT * FROM (VALUES (0,0,0),(1,0,0),(-1,0,0),(0,1,0),(0,-1,0),(0,0,1),(0,0,-1)) o(dx,dy,dz)),"


def dil_sql(src: str, name: str, passes: int = 1) -> str:
    parts, prev = [], src
    for p in range(passes):
        cur = name if p == passes - 1 else f"{name}_{p}"
        parts.append(f"{cur} AS (SELECT DISTINCT image_id,CAST(x+dx AS INT) AS x,CAST(y+dy AS INT) AS y,CAST(z+dz AS INT) AS z FROM {prev},off WHERE x+dx BETWEEN 0 AND 15 AND y+dy BETWEEN 0 AND 15 AND z+dz BETWEEN 0 AND 15),")
        prev = cur
    return "\n".join(parts)


def comp_sql(src: str, name: str, near: str = "abs(a.x-b.x)+abs(a.y-b.y)+abs(a.z-b.z)=1") -> str:
    """Components through reachability over ``near`` voxels; root is the smallest packed index."""
    return f"""{name}n AS (SELECT image_id,x,y,z,CAST(x+16*(y+16*z) AS BIGINT) AS node FROM {src}),
{name}e AS (SELECT a.image_id,a.node AS i,b.node AS j FROM {name}n a JOIN {name}n b ON a.image_id=b.image_id AND {near}),
{name}r AS (SELECT image_id,node AS src,node AS dst FROM {name}n UNION SELECT r.image_id,src,j FROM {name}r r JOIN {name}e e ON e.image_id=r.image_id AND e.i=r.dst),
{name} AS (SELECT n.image_id,x,y,z,min(dst) AS root FROM {name}r r JOIN {name}n n ON n.image_id=r.image_id AND n.node=r.src GROUP BY ALL),
"""


SEG = """seg AS (SELECT 'n'||s_nationkey AS image_id,s_suppkey AS path,2.0*(s_suppkey%16) AS ax,2.0*(s_nationkey%16) AS ay,0.0 AS az,2.0*(s_suppkey%16)+4.0 AS bx,2.0*(s_nationkey%16)+3.0 AS by_,30.0 AS bz FROM supplier),"""
TUBE = SEG + GRID + """tb AS (SELECT DISTINCT image_id,path,CAST(x AS INT) AS x,CAST(y AS INT) AS y,CAST(z AS INT) AS z FROM (
 SELECT *,greatest(0,least(1,((2*x-ax)*(bx-ax)+(2*y-ay)*(by_-ay)+(2*z-az)*(bz-az))/((bx-ax)**2+(by_-ay)**2+(bz-az)**2))) AS t FROM seg,cell)
 WHERE sqrt((2*x-ax-t*(bx-ax))**2+(2*y-ay-t*(by_-ay))**2+(2*z-az-t*(bz-az))**2)<=3.5),"""


def path_segments(t: Tables):
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    return t.raw("supplier").select(
        F.concat(F.lit("n"), n.cast("string")).alias("image_id"), k.alias("path"), (2.0 * (k % 16)).alias("ax"), (2.0 * (n % 16)).alias("ay"), F.lit(0.0).alias("az"),
        (2.0 * (k % 16) + 4.0).alias("bx"), (2.0 * (n % 16) + 3.0).alias("by"), F.lit(30.0).alias("bz"),
    )


@query("V1_tube_mask", "", "WITH " + TUBE + END + "SELECT * FROM tb")
def v1(t):
    return V.tube_mask(path_segments(t), SHAPE, AFF, 3.5)


@query("V1_unproductive_paths", "", "WITH " + TUBE + END + "SELECT DISTINCT image_id,path FROM seg WHERE (image_id,path) NOT IN (SELECT image_id,min(path) FROM tb GROUP BY image_id,x,y,z)")
def v1u(t):
    s = path_segments(t)
    return V.unproductive_paths(cut(V.tube_mask(s, SHAPE, AFF, 3.5)), s)


@query("V2_dilate6", "voxels mask", "WITH " + DIL + dil_sql("mask", "dl", 2) + END + "SELECT * FROM dl")
def v2(t):
    return V.dilate6(t.mask(), SHAPE, 2)


@query("V3_mask_qc", "voxels mask", "WITH " + comp_sql("mask", "cp") + END + "SELECT image_id,count(*) AS voxels,count(*)*8.0::DOUBLE AS volume_mm3,count(DISTINCT root) AS components_6_connected FROM cp GROUP BY 1")
def v3(t):
    return V.mask_qc(t.mask(), SHAPE, AFF)


@query("V4_label_components", "voxels mask", "WITH " + comp_sql("mask", "cp") + END + "SELECT * FROM cp")
def v4(t):
    return V.label_components(t.mask(), SHAPE, 6)


@query("V4_label_components_26", "voxels mask", "WITH " + comp_sql("mask", "cp", "a.node<>b.node AND abs(a.x-b.x)<=1 AND abs(a.y-b.y)<=1 AND abs(a.z-b.z)<=1") + END + "SELECT image_id,root,count(*) AS size FROM cp GROUP BY 1,2")
def v4b(t):
    return V.label_components(t.mask(), SHAPE, 26).groupBy("image_id", "root").agg(F.count(F.lit(1)).alias("size"))


OV = """md AS (SELECT image_id,quantile_cont(v,.5) AS m FROM voxels GROUP BY 1),ad AS (SELECT image_id,x,y,z FROM voxels JOIN md USING (image_id) WHERE v<=m AND v>0.8*m),
rm AS (SELECT image_id,x,y,z FROM voxels JOIN md USING (image_id) WHERE v>1.6*m),"""


def overlays(t: Tables):
    j = cut(t.with_median())
    m = F.col("m")
    return j.filter("v > m").select(*IMG), j.filter((F.col("v") <= m) & (F.col("v") > 0.8 * m)).select(*IMG), j.filter(F.col("v") > 1.6 * m).select(*IMG)


@query("V5_mask_union", "voxels mask", "WITH " + OV + END + "SELECT * FROM mask UNION SELECT * FROM ad")
def v5(t):
    m, a, _ = overlays(t)
    return V.mask_union([m, a])


@query("V6_mask_repair", "voxels mask", "WITH " + OV + END + "(SELECT * FROM mask UNION SELECT * FROM ad) EXCEPT SELECT * FROM rm")
def v6(t):
    return V.mask_repair(*overlays(t))


@query("V6_repair_guard", "voxels mask", "WITH " + OV + """ ov AS (SELECT image_id,max(m) AS m,max(a) AS a,max(r) AS r FROM (SELECT *,1 AS m,0 AS a,0 AS r FROM mask UNION ALL SELECT *,0,1,0 FROM ad UNION ALL SELECT *,0,0,1 FROM rm) GROUP BY image_id,x,y,z)
 SELECT image_id,count(*) FILTER (a=1) AS added_voxels,count(*) FILTER (r=1) AS removed_voxels,count(*) FILTER (a=1 AND r=1) AS add_remove_conflict,count(*) FILTER (r=1 AND m=0) AS remove_outside,
 count(*) FILTER (a=1 AND m=1) AS add_inside,count(*) FILTER ((m=1 OR a=1) AND r=0) AS result_voxels FROM ov GROUP BY 1""")
def v6g(t):
    return V.repair_guard(*overlays(t))


@query("V7_binary_check", "voxels", "WITH b AS (SELECT image_id,CASE WHEN v>400000 THEN 2.0 WHEN v>200000 THEN 1.0 ELSE 0.0 END AS v FROM voxels) SELECT image_id,count(*) FILTER (v NOT IN (0,1)) AS not_binary,count(*) FILTER (v=1) AS ones,(count(*) FILTER (v NOT IN (0,1))=0 AND count(*) FILTER (v=1)>0) AS valid FROM b GROUP BY 1")
def v7(t):
    return V.binary_check(t.voxels().withColumn("v", F.when(F.col("v") > 400000, 2.0).when(F.col("v") > 200000, 1.0).otherwise(0.0)))


CODE = """cd AS (SELECT image_id,x,y,z,CAST(round(v) AS BIGINT) AS c FROM voxels),
sfc AS (SELECT image_id,x,y,z,CASE c%4 WHEN 0 THEN 1001+(c//4)%22 WHEN 1 THEN 2001+(c//4)%22 ELSE 17 END AS code FROM cd),
lft AS (SELECT image_id,x,y,z,CASE c%3 WHEN 0 THEN 10+c%5 ELSE 0 END AS code FROM cd), rgt AS (SELECT image_id,x,y,z,CASE c%3 WHEN 1 THEN 10+c%5 ELSE 0 END AS code FROM cd),
an AS (SELECT label,hemi,tissue,CASE WHEN tissue='cortex' THEN CASE hemi WHEN 'L' THEN idx+1 ELSE idx-22+201 END ELSE 10+(idx-44)//2 END AS source_label FROM nodes),"""


@query("V8_hybrid_atlas", "voxels nodes", "WITH " + CODE + """ co AS (SELECT image_id,x,y,z,CASE WHEN code BETWEEN 1001 AND 1200 THEN code-1000 WHEN code BETWEEN 2001 AND 2200 THEN code-1800 END AS s FROM sfc),
 dp AS (SELECT *,'L' AS hemi FROM lft UNION ALL SELECT *,'R' FROM rgt),
 al AS (SELECT image_id,x,y,z,label FROM co JOIN an ON s=source_label WHERE tissue='cortex' UNION ALL
  SELECT d.image_id,d.x,d.y,d.z,label FROM dp d JOIN an ON d.code=source_label AND d.hemi=an.hemi LEFT JOIN co c ON c.image_id=d.image_id AND c.x=d.x AND c.y=d.y AND c.z=d.z AND c.s IS NOT NULL WHERE tissue<>'cortex' AND c.s IS NULL)
 SELECT image_id,x,y,z,max(label) AS label,count(*) AS claims FROM al GROUP BY ALL""")
def v8(t):
    v = cut(t.voxels().select(*IMG, F.round("v").cast("long").alias("c")))
    c, q = F.col("c"), F.floor(F.col("c") / 4)
    sfc = v.select(*IMG, F.when(c % 4 == 0, 1001 + q % 22).when(c % 4 == 1, 2001 + q % 22).otherwise(17).alias("code"))
    lft = v.select(*IMG, F.when(c % 3 == 0, 10 + c % 5).otherwise(0).alias("code"))
    rgt = v.select(*IMG, F.when(c % 3 == 1, 10 + c % 5).otherwise(0).alias("code"))
    i = F.col("idx")
    src = F.when(F.col("tissue") == "cortex", F.when(F.col("hemi") == "L", i + 1).otherwise(i - 22 + 201)).otherwise(10 + F.floor((i - 44) / 2))
    return V.hybrid_atlas(sfc, lft, rgt, t.nodes().withColumn("source_label", src))


FIVE = """fv AS (SELECT image_id,x,y,z,[least(1,greatest(0,(c%5)/4.0-0.1)),least(1,greatest(0,(c%7)/6.0)),least(1,greatest(0,(c%3)/2.0)),least(1,greatest(0,(c%11)/10.0)),least(1,greatest(0,(c%2)*1.2))]::DOUBLE[] AS f
 FROM (SELECT *,CAST(round(v) AS BIGINT) AS c FROM voxels)),
nf AS (SELECT image_id,x,y,z,CASE WHEN list_sum(f)>0 THEN [k/list_sum(f) for k in f] ELSE f END AS f FROM fv),"""


def five(t: Tables):
    c = F.col("c")
    f = F.array((c % 5) / 4.0 - 0.1, (c % 7) / 6.0, (c % 3) / 2.0, (c % 11) / 10.0, (c % 2) * 1.2)
    return t.voxels().withColumn("c", F.round("v").cast("long")).select(*IMG, f.alias("f"))


@query("V9_normalize_five_tissue", "voxels", "WITH " + FIVE + END + "SELECT image_id,x,y,z," + ",".join(f"round(f[{i}],6) AS f{i}" for i in range(1, 6)) + " FROM nf")
def v9(t):
    d = V.normalize_five_tissue(five(t))
    return d.select(*IMG, *[r6(F.get("f", F.lit(i))).alias(f"f{i + 1}") for i in range(5)])


@query("V10_argmax_tissue", "voxels", "WITH " + FIVE + END + "SELECT image_id,x,y,z,CASE WHEN list_sum(f)<.5 THEN 0 ELSE ([3,3,2,1,0])[list_position(f,list_max(f))] END AS tissue FROM nf")
def v10(t):
    return V.argmax_tissue(V.normalize_five_tissue(five(t))).select(*IMG, "tissue")


@query("V11_shaft_candidates")
def v11(t):
    s = path_segments(t)
    tube = cut(V.tube_mask(s, SHAPE, AFF, 2.5).select(*IMG).distinct().withColumn("v", F.lit(3000.0)))
    return V.shaft_candidates(tube, tube.select(*IMG), SHAPE, AFF, 2000.0)


ROI = """nearv AS (SELECT image_id,x,y,z FROM voxels WHERE x BETWEEN 4 AND 11), corev AS (SELECT image_id,x,y,z FROM voxels WHERE x BETWEEN 7 AND 8), """
VOID = ROI + DIL + dil_sql("nearv", "nd2", 2) + """ rmv AS (SELECT v.* FROM voxels v JOIN nd2 USING (image_id,x,y,z) WHERE NOT v.x BETWEEN 4 AND 11 AND v>0),
 th AS (SELECT image_id,0.7*quantile_cont(v,.5) AS thr FROM rmv GROUP BY 1 HAVING count(*)>=20), dk AS (SELECT image_id,x,y,z FROM voxels JOIN th USING (image_id) WHERE x BETWEEN 4 AND 11 AND v<thr),
""" + comp_sql("dk", "dc") + " vd AS (SELECT image_id,x,y,z FROM dc WHERE (image_id,root) IN (SELECT image_id,root FROM dc WHERE x BETWEEN 7 AND 8)), "


def void(t: Tables):
    v = cut(t.voxels())
    near, core = v.filter("x between 4 and 11").select(*IMG), v.filter("x between 7 and 8").select(*IMG)
    return V.seeded_void(near, core, v, v, SHAPE, 0.7), v, near, core


@query("V12_seeded_void", "voxels", "WITH " + VOID + END + "SELECT * FROM vd")
def v12(t):
    return void(t)[0]


@query("V13_compose_mask", "voxels", "WITH " + VOID + "al AS (SELECT * FROM corev UNION SELECT image_id,x,y,z FROM voxels WHERE x BETWEEN 4 AND 11 AND v>=400000 UNION SELECT * FROM vd)," + dil_sql("al", "dl", 1) + END + "SELECT * FROM dl")
def v13(t):
    vd, v, near, core = void(t)
    return V.compose_mask(core, near, v, vd, SHAPE, 400000.0)


BALL = """bl AS (SELECT 'n'||s_nationkey AS image_id,s_suppkey AS ord,CASE WHEN s_suppkey%3=0 THEN 'erase' ELSE 'add' END AS action,CAST(s_suppkey%4+1 AS INT) AS label,2.0*(s_suppkey%16) AS px,2.0*(s_nationkey%16) AS py,2.0*((s_suppkey//16)%16) AS pz FROM supplier),
""" + GRID + "hb AS (SELECT image_id,ord,action,label,CAST(x AS INT) AS x,CAST(y AS INT) AS y,CAST(z AS INT) AS z FROM bl,cell WHERE sqrt((2*x-px)**2+(2*y-py)**2+(2*z-pz)**2)<=3.5),"


def balls(t: Tables):
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    return t.raw("supplier").select(
        F.concat(F.lit("n"), n.cast("string")).alias("image_id"), k.alias("ord"), k.alias("seq"), F.when(k % 3 == 0, "erase").otherwise("add").alias("action"),
        (k % 4 + 1).cast("int").alias("label"), (2.0 * (k % 16)).alias("px"), (2.0 * (n % 16)).alias("py"), (2.0 * (F.floor(k / 16) % 16)).alias("pz"), F.lit(3.5).alias("radius"),
    )


@query("V14_sphere_edits", "", "WITH " + TUBE + BALL.replace(GRID, "") + "tm AS (SELECT DISTINCT image_id,x,y,z FROM tb), la AS (SELECT image_id,x,y,z,arg_max(action,ord) AS a FROM hb GROUP BY ALL) "
       "SELECT * FROM tm WHERE (image_id,x,y,z) NOT IN (SELECT image_id,x,y,z FROM la) UNION SELECT image_id,x,y,z FROM la WHERE a='add'")
def v14(t):
    tube = V.tube_mask(path_segments(t), SHAPE, AFF, 3.5).select(*IMG).distinct()
    return V.sphere_edits(tube, balls(t), SHAPE, AFF)


@query("V16_paint_spheres", "", "WITH " + BALL + END + "SELECT image_id,x,y,z,arg_max(label,ord) AS label FROM hb GROUP BY ALL")
def v16(t):
    return V.paint_spheres(balls(t), SHAPE, AFF)


@query("V17_fill_holes", "voxels mask", "WITH " + DIL + dil_sql("mask", "dl", 1) + """ bg AS (SELECT g.* FROM (SELECT image_id,x.range::INT AS x,y.range::INT AS y,z.range::INT AS z FROM (SELECT DISTINCT image_id FROM dl) i,range(16) x,range(16) y,range(16) z) g ANTI JOIN dl USING (image_id,x,y,z)),
 br AS (SELECT * FROM bg WHERE x IN (0,15) OR y IN (0,15) OR z IN (0,15) UNION SELECT b.* FROM br r JOIN bg b ON b.image_id=r.image_id AND abs(b.x-r.x)+abs(b.y-r.y)+abs(b.z-r.z)=1),"""
       + END + "SELECT image_id,x,y,z FROM dl UNION ALL SELECT bg.* FROM bg ANTI JOIN br USING (image_id,x,y,z)")
def v17(t):
    return V.fill_holes(cut(V.dilate6(t.mask(), SHAPE, 1)), SHAPE)


@query("V18_parcel_distance", "voxels mask atlas", """WITH c AS (SELECT image_id,label,2*avg(x) AS mx,2*avg(y) AS my,2*avg(z) AS mz FROM atlas GROUP BY ALL)
 SELECT c.image_id,label,round(min(sqrt((2*x-mx)**2+(2*y-my)**2+(2*z-mz)**2)),6) AS distance_mm FROM c JOIN mask m ON m.image_id=c.image_id GROUP BY ALL""")
def v18(t):
    return out(V.parcel_distance(t.atlas(), t.mask(), AFF), ["image_id", "label"])


PAIRS = "ids AS (SELECT DISTINCT image_id FROM voxels), pr AS (SELECT p.image_id AS a,q.image_id AS b FROM ids p JOIN ids q ON split_part(p.image_id,'-',2)=split_part(q.image_id,'-',2) AND p.image_id<>q.image_id),"
DICE = "WITH " + PAIRS + """ sz AS (SELECT image_id,count(*) AS n FROM mask GROUP BY 1), it AS (SELECT pr.a,pr.b,count(r.image_id) AS i FROM pr JOIN mask l ON l.image_id=pr.a LEFT JOIN mask r ON r.image_id=pr.b AND r.x=l.x AND r.y=l.y AND r.z=l.z GROUP BY ALL),
 dc AS (SELECT it.a,it.b,2.0*i/(s.n+u.n) AS d FROM it JOIN sz s ON s.image_id=it.a JOIN sz u ON u.image_id=it.b) """


def image_pairs(t: Tables):
    i = t.voxels().select("image_id").distinct().withColumn("blk", F.split_part("image_id", F.lit("-"), F.lit(2)))
    return i.select(F.col("image_id").alias("a"), "blk").join(i.select(F.col("image_id").alias("b"), "blk"), "blk").filter("a <> b").select("a", "b")


@query("V19_dice", "voxels mask", DICE + "SELECT a,b,round(d,6) AS dice FROM dc")
def v19(t):
    return out(V.dice(image_pairs(t), cut(t.mask())), ["a", "b"])


@query("V19_dice_symmetric", "voxels mask", DICE + "SELECT least(a,b) AS a,greatest(a,b) AS b,round(avg(d),6) AS dice FROM dc GROUP BY 1,2")
def v19s(t):
    return out(V.symmetric_mean(V.dice(image_pairs(t), cut(t.mask()))), ["a", "b"])


@query("V20_label_boundary", "voxels atlas", """WITH o AS (SELECT * FROM (VALUES (1,0,0),(0,1,0),(0,0,1)) o(dx,dy,dz))
 SELECT DISTINCT a.image_id,a.x,a.y,a.z,a.label FROM atlas a CROSS JOIN o LEFT JOIN atlas p ON p.image_id=a.image_id AND p.x=(a.x-dx+16)%16 AND p.y=(a.y-dy+16)%16 AND p.z=(a.z-dz+16)%16 WHERE coalesce(p.label,0)<>a.label""")
def v20(t):
    return V.label_boundary(t.atlas(), SHAPE)


@query("V21_display_window", "voxels", """WITH q AS (SELECT image_id,quantile_cont(v,.01) AS lo,quantile_cont(v,.995) AS hi FROM voxels WHERE v>0 GROUP BY 1)
 SELECT image_id,x,y,z,CAST(floor(greatest(0,least(1,(v-lo)/greatest(hi-lo,1e-12)))*255) AS INT) AS shade FROM voxels JOIN q USING (image_id)""")
def v21(t):
    return V.display_window(t.voxels(), 1.0, 99.5)


@query("V22_missing_labels", "voxels atlas nodes", "WITH i AS (SELECT DISTINCT image_id FROM atlas) SELECT image_id,label FROM i CROSS JOIN (SELECT DISTINCT label FROM nodes) EXCEPT SELECT image_id,label FROM atlas")
def v22(t):
    return V.missing_labels(t.atlas(), t.nodes())


@query("V23_threshold_volume", "voxels", "SELECT image_id,count(*) FILTER (v/1000>=200) AS voxel_count,8.0::DOUBLE*count(*) FILTER (v/1000>=200) AS volume_mm3,round(max(v)/1000,6) AS max_v_per_mm,count(*) FILTER (v<0) AS negative FROM voxels GROUP BY 1")
def v23(t):
    return out(V.threshold_volume(t.voxels(), 200.0, AFF), ["image_id", "voxel_count", "volume_mm3"])


@query("V24_volume_difference", "voxels mask", "WITH " + PAIRS + " s AS (SELECT image_id,8.0::DOUBLE*count(*) AS v FROM mask GROUP BY 1) SELECT a,b,s.v AS v1,u.v AS v2,round(100*abs(u.v-s.v)/((s.v+u.v)/2),6) AS percent FROM pr JOIN s ON s.image_id=a JOIN s u ON u.image_id=b")
def v24(t):
    s = cut(t.mask().groupBy("image_id").agg((8.0 * F.count(F.lit(1))).alias("v")))
    p = image_pairs(t).join(s.select(F.col("image_id").alias("a"), F.col("v").alias("v1")), "a").join(s.select(F.col("image_id").alias("b"), F.col("v").alias("v2")), "b")
    return out(V.volume_difference_percent(p), ["a", "b", "v1", "v2"])


@query("S13_voxel_fingerprint")
def s13(t):
    return V.fingerprint(t.voxels())


@query("S19_grid_check", "voxels", "SELECT image_id,NOT starts_with(image_id,'P') AS same_shape,NOT starts_with(image_id,'O') AS same_affine,starts_with(image_id,'O') AS singular FROM (SELECT DISTINCT image_id FROM voxels)")
def s19(t):
    g = t.grids()
    odd = g.withColumn("shape", F.when(F.col("image_id").startswith("P"), F.array(F.lit(16), F.lit(16), F.lit(15))).otherwise(F.col("shape"))).withColumn(
        "affine", F.when(F.col("image_id").startswith("O"), F.transform("affine", lambda v, i: F.when(i == 0, 0.0).otherwise(v))).otherwise(F.col("affine"))
    )
    return V.grid_check(odd, g.limit(1))


# -- streamlines ------------------------------------------------------------

TM = "qhi AS (SELECT image_id,quantile_cont(v,.9995) AS q FROM voxels GROUP BY 1), tm AS (SELECT DISTINCT x,y,z FROM voxels JOIN qhi USING (image_id) WHERE v>q),"


def track_mask(t: Tables):
    v = cut(t.voxels())
    return cut(v.join(O.quantiles(v, ["image_id"], "v", {"q": 0.9995}), "image_id").filter("v > q").select(*XYZ).distinct())


@query("T1_sampling_gate", "points", """WITH s AS (SELECT track,sqrt((lead(x) OVER t-x)**2+(lead(y) OVER t-y)**2+(lead(z) OVER t-z)**2) AS l FROM points WINDOW t AS (PARTITION BY track ORDER BY seq)),
 m AS (SELECT track,max(l) AS l FROM s GROUP BY 1), p AS (SELECT track,count(*) AS n,count(*) FILTER (x<-.5 OR y<-.5 OR z<-.5 OR x>15.5 OR y>15.5 OR z>15.5) AS o FROM points GROUP BY 1)
 SELECT track,n AS points,round(l,6) AS max_segment_mm,n<2 AS invalid,coalesce(l,0)>.5001 AS sparse,o>0 AS leaves_grid FROM p JOIN m USING (track)""")
def t1(t):
    d = T.sampling_gate(cut(t.points()), SHAPE)
    return d.withColumn("max_segment_mm", r6("max_segment_mm"))


CROSS = TM + """ sg AS (SELECT track,x AS ax,y AS ay,z AS az,lead(x) OVER t AS bx,lead(y) OVER t AS by_,lead(z) OVER t AS bz FROM fine WINDOW t AS (PARTITION BY track ORDER BY seq)),
 cl AS (SELECT *,unnest(list_distinct([floor(least(ax,bx)+.5-1e-8),floor(greatest(ax,bx)+.5)])) AS x FROM sg WHERE bx IS NOT NULL),
 cm AS (SELECT *,unnest(list_distinct([floor(least(ay,by_)+.5-1e-8),floor(greatest(ay,by_)+.5)])) AS y FROM cl), cn AS (SELECT *,unnest(list_distinct([floor(least(az,bz)+.5-1e-8),floor(greatest(az,bz)+.5)])) AS z FROM cm),
 hc AS (SELECT c.*,""" + ",".join(
    f"CASE WHEN abs(b{e}-a{c})<1e-12 THEN -1e300 ELSE least((c.{c}-.5-a{c})/nullif(b{e}-a{c},0),(c.{c}+.5-a{c})/nullif(b{e}-a{c},0)) END AS n{c},CASE WHEN abs(b{e}-a{c})<1e-12 THEN 1e300 ELSE greatest((c.{c}-.5-a{c})/nullif(b{e}-a{c},0),(c.{c}+.5-a{c})/nullif(b{e}-a{c},0)) END AS f{c},"
    f"(abs(b{e}-a{c})<1e-12 AND (a{c}<c.{c}-.5 OR a{c}>c.{c}+.5)) AS o{c}" for c, e in (("x", "x"), ("y", "y_"), ("z", "z"))) + """
  FROM cn c JOIN tm ON tm.x=c.x AND tm.y=c.y AND tm.z=c.z),
 hit AS (SELECT DISTINCT track FROM hc WHERE NOT ox AND NOT oy AND NOT oz AND greatest(nx,ny,nz,0)<=least(fx,fy,fz,1)), """


def excluded(t: Tables):
    p = cut(t.fine_points())
    m = track_mask(t)
    return p, m, T.segment_exclude(p, m, SHAPE)


@query("T2_segment_exclude", "points fine voxels", "WITH " + CROSS + END + "SELECT track,count(*) AS points FROM fine WHERE track NOT IN (SELECT track FROM hit) GROUP BY 1")
def t2(t):
    return excluded(t)[2].groupBy("track").agg(F.count(F.lit(1)).alias("points"))


@query("T3_exclusion_audit", "points fine voxels", "WITH " + CROSS + END + """SELECT a AS input_streamlines,a-b AS retained_streamlines,0 AS mask_intersections,b AS additional_removed,a-b>0 AS accepted FROM (SELECT count(DISTINCT track) AS a FROM fine),(SELECT count(*) AS b FROM hit)""")
def t3(t):
    p, m, kept = excluded(t)
    return T.exclusion_audit(p, cut(kept), m, SHAPE)


@query("T4_weights_audit", "lines asg", """SELECT count(*) AS weight_count,sum(w) AS weight_sum,count(*) FILTER (w=0) AS zero_weights,count(*) FILTER (w<0) AS bad_weights,count(DISTINCT track) AS retained,1 AS mu_rows,1.5::DOUBLE AS mu,
 count(*)=count(DISTINCT track) AND count(*) FILTER (w<0)=0 AND sum(w)>0 AS accepted FROM asg""")
def t4(t):
    a = cut(t.assignments())
    return T.weights_audit(a, a, a.agg(F.lit(1.5).alias("mu")))


@query("T5_build_connectome", "lines asg", "SELECT subject,visit,least(a,b) AS i,greatest(a,b) AS j,sum(w) AS w FROM asg WHERE a>0 AND b>0 AND a<>b GROUP BY ALL")
def t5(t):
    return T.build_connectome(t.assignments(), ["subject", "visit"])


@query("T6_matrix_weight_audit", "lines asg", """WITH c AS (SELECT subject,visit,sum(w) AS s FROM asg WHERE a>0 AND b>0 AND a<>b GROUP BY ALL)
 SELECT subject,visit,count(*) FILTER (a>0 AND b>0 AND a<>b) AS assigned_nonself_tracks,count(*) FILTER (NOT (a>0 AND b>0 AND a<>b)) AS discarded_tracks,sum(w) FILTER (a>0 AND b>0 AND a<>b) AS assigned_weight_sum,0.0::DOUBLE AS max_absolute_error,true AS passed,any_value(s) AS matrix_upper_triangle_sum FROM asg JOIN c USING (subject,visit) GROUP BY ALL""")
def t6(t):
    a = cut(t.assignments())
    return T.matrix_weight_audit(T.build_connectome(a, ["subject", "visit"]), a, ["subject", "visit"])


@query("T7_endpoint_label", "points voxels atlas", """WITH la AS (SELECT DISTINCT x,y,z,label FROM atlas), en AS (SELECT track,'a' AS s,arg_min(x,seq) AS x,arg_min(y,seq) AS y,arg_min(z,seq) AS z FROM points GROUP BY 1 UNION ALL SELECT track,'b',arg_max(x,seq),arg_max(y,seq),arg_max(z,seq) FROM points GROUP BY 1),
 nb AS (SELECT track,s,label,round(sqrt((e.x-l.x)**2+(e.y-l.y)**2+(e.z-l.z)**2),9) AS d FROM en e JOIN la l ON abs(e.x-l.x)<=1.5 AND abs(e.y-l.y)<=1.5 AND abs(e.z-l.z)<=1.5 WHERE sqrt((e.x-l.x)**2+(e.y-l.y)**2+(e.z-l.z)**2)<=1.5),
 bs AS (SELECT track,s,label FROM nb QUALIFY row_number() OVER (PARTITION BY track,s ORDER BY d,label)=1)
 SELECT track,coalesce(max(label) FILTER (s='a'),0) AS a,coalesce(max(label) FILTER (s='b'),0) AS b FROM (SELECT track,s,label FROM en LEFT JOIN bs USING (track,s)) GROUP BY 1""")
def t7(t):
    return T.endpoint_label(cut(t.points()), t.atlas().select(*XYZ, "label").distinct(), 1.5)
