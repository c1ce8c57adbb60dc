"""Registered source, contract, replay and intake queries."""

from __future__ import annotations

import os
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from ..functions.expr import r6
from ..operators.graphs import adjacency
from ..session import cut, scratch_root
from ..sources import contracts as C
from ..sources import intake as I
from .fixtures import Tables
from .registry import query

S = ["subject", "visit"]


def scratch(t: Tables, name: str) -> str:
    return os.path.join(scratch_root(t.spark), f"{name}-{uuid.uuid4().hex}")


@query("S1_load_nodes", "nodes", "SELECT CAST(idx AS INT) AS idx,CAST(label AS INT) AS label,name,hemi,tissue,network FROM nodes")
def s1(t):
    path = scratch(t, "nodes")
    n = t.nodes().select(F.col("idx").alias("index"), "label", "name", F.col("hemi").alias("hemisphere"), "tissue", "network")
    n.write.option("sep", "\t").option("header", True).csv(path)
    return C.load_nodes(t.spark, path)


@query("S1_node_violations", "nodes", "SELECT count(*) AS nodes,0::BIGINT AS index_gaps,0::BIGINT AS label_repeats,0::BIGINT AS label_below_one,0::BIGINT AS bad_hemisphere,0::BIGINT AS bad_tissue,0::BIGINT AS name_clash FROM nodes")
def s1v(t):
    return C.node_violations(t.nodes())


@query("S2_matrix_to_edges", "edges", "SELECT subject,visit,i,j,w FROM edges WHERE w<>0")
def s2(t):
    a = adjacency(t.edges(), S).groupBy(*S, "i").agg(F.map_from_entries(F.collect_list(F.struct("j", "w"))).alias("m"))
    rows = a.select(*S, "i", F.transform(F.sequence(F.lit(0), F.lit(49)), lambda k: F.coalesce(F.element_at("m", k), F.lit(0.0))).alias("row"))
    return C.matrix_to_edges(rows, S)


@query("S3_validate_edges", "edges", """WITH c AS (SELECT subject,visit,i,j,w FROM edges UNION ALL SELECT subject,visit,j,i,CASE WHEN w>200000 THEN w*1.001 ELSE w END FROM edges UNION ALL SELECT subject,visit,i,i,1.0 FROM edges WHERE j=i+1 AND i<3)
 SELECT subject,visit,0::BIGINT AS nonfinite,0::BIGINT AS negative,count(*) FILTER (i=j) AS diagonal,2*count(*) FILTER (i<j AND w>200000) AS asymmetric FROM c GROUP BY 1,2""")
def s3(t):
    e = cut(t.edges())
    low = e.select(*S, F.col("j").alias("i"), F.col("i").alias("j"), F.when(F.col("w") > 200000, F.col("w") * 1.001).otherwise(F.col("w")).alias("w"))
    diag = e.filter("j = i + 1 and i < 3").select(*S, "i", F.col("i").alias("j"), F.lit(1.0).alias("w"))
    return C.edge_violations(e.select(*S, "i", "j", "w").unionByName(low).unionByName(diag), S)


@query("S4_reindex", "edges", "SELECT subject,visit,least((i*7)%50,(j*7)%50) AS i,greatest((i*7)%50,(j*7)%50) AS j,w FROM edges")
def s4(t):
    m = t.nodes().select(F.col("idx").alias("old"), ((F.col("idx") * 7) % 50).alias("new"))
    C.enforce(C.mapping_violations(m, 50).filter("repeated_old + repeated_new + out_of_range > 0"), "node mapping")
    return C.reindex(t.edges(), m)


def manifest_path(t: Tables) -> str:
    e = t.edges().select(*S).distinct()
    visit = F.when(F.col("visit") == 0, "pre").when(F.col("visit") == 1, "post1").otherwise("post2")
    sha = F.sha2(F.concat("subject", visit), 256)
    scheme = F.when(F.col("visit") == 0, "virtual").when(F.col("subject") == "S4", "session_postoperative").otherwise("shared_postoperative")
    v = F.struct(
        visit.alias("timepoint"), F.concat("subject", F.lit("/"), visit, F.lit(".csv")).alias("matrix"), sha.alias("sha256"), scheme.alias("mask_scheme"),
        F.concat(F.lit("ev/"), "subject").alias("exclusion_evidence"), F.sha2("subject", 256).alias("exclusion_evidence_sha256"),
    )
    s = e.groupBy("subject").agg(F.transform(F.array_sort(F.collect_list(F.struct("visit", v.alias("v")))), lambda x: x["v"]).alias("visits"))
    subs = s.agg(F.array_sort(F.collect_list(F.struct(F.col("subject").alias("id"), "visits"))).alias("subjects")).withColumn("_1", F.lit(1))
    o = t.outcomes().groupBy("endpoint").agg(F.map_from_entries(F.collect_list(F.struct("subject", "y"))).alias("values"))
    clin = o.agg(F.map_from_entries(F.collect_list(F.struct("endpoint", F.struct(F.lit("derived").alias("definition"), "values")))).alias("clinical")).withColumn("_1", F.lit(1))
    doc = subs.join(clin, "_1").select(
        F.to_json(F.struct(F.lit(1).alias("schema_version"), F.lit(True).alias("pairing_reviewed"), F.lit("nodes.tsv").alias("nodes"), "subjects", "clinical"), {"ignoreNullFields": "false"}).alias("value")
    )
    path = scratch(t, "manifest")
    doc.write.text(path)
    return path


VIS = """vs AS (SELECT subject,visit AS ord,CASE visit WHEN 0 THEN 'pre' WHEN 1 THEN 'post1' ELSE 'post2' END AS timepoint,CASE WHEN visit=0 THEN 'virtual' WHEN subject='S4' THEN 'session_postoperative' ELSE 'shared_postoperative' END AS mask_scheme FROM (SELECT DISTINCT subject,visit FROM edges))"""


@query("S5_read_manifest", "edges", "WITH " + VIS + " SELECT subject,CAST(ord AS INT) AS ord,timepoint,subject||'/'||timepoint||'.csv' AS matrix,sha256(subject||timepoint) AS sha256,mask_scheme,'ev/'||subject AS exclusion_evidence,sha256(subject) AS exclusion_evidence_sha256 FROM vs")
def s5(t):
    return C.manifest_visits(C.read_manifest(t.spark, manifest_path(t)))


@query("S5_manifest_outcomes", "outcomes", "SELECT endpoint,subject,y FROM outcomes")
def s5o(t):
    return C.manifest_outcomes(C.read_manifest(t.spark, manifest_path(t)))


@query("S6_mask_scheme_gate", "edges", "WITH " + VIS + """ SELECT subject,timepoint,CASE WHEN mask_scheme='session_postoperative' THEN 'unknown mask scheme' ELSE 'exclusion evidence missing or changed' END AS reason FROM vs WHERE mask_scheme='session_postoperative' OR subject IN ('S1','S2')""")
def s6(t):
    v = C.manifest_visits(C.read_manifest(t.spark, manifest_path(t)))
    ev = v.select(F.col("exclusion_evidence").alias("path"), "subject").distinct().filter("subject <> 'S1'").select(
        "path", F.when(F.col("subject") == "S2", "0").otherwise(F.sha2("subject", 256)).alias("sha256"))
    return C.mask_scheme_gate(v, ev)


@query("S7_write_results", "outcomes", "SELECT endpoint,subject,y FROM outcomes")
def s7(t):
    path = scratch(t, "results")
    C.write_results(t.outcomes(), path)
    return t.spark.read.parquet(path)


@query("S8_clean", "coords", "SELECT subject,visit,parcel,CASE WHEN parcel%5 IN (0,1) THEN NULL ELSE round(g1,6) END AS x FROM coords")
def s8(t):
    p = F.col("parcel") % 5
    d = t.coords().select(*S, "parcel", F.when(p == 0, F.lit(float("nan"))).when(p == 1, F.lit(float("-inf"))).otherwise(r6("g1")).alias("x"))
    return C.clean(d)


@query("S9_content_hash")
def s9(t):
    return C.content_hash(t.spark, t.dir).select(F.element_at(F.split("path", "/"), -1).alias("file"), "size", "sha256")


SNAP = """h AS (SELECT path,sop_uid,size,patient_id FROM headers), af AS (SELECT path,CASE WHEN size%2=0 THEN sop_uid ELSE 'x'||sop_uid END AS sha FROM h WHERE size>200 UNION ALL SELECT path||'-new',sop_uid FROM h WHERE size>3000)"""


def snapshots(t: Tables):
    h = t.headers()
    before = h.select("path", F.col("sop_uid").alias("sha256"))
    after = h.filter("size > 200").select("path", F.when(F.col("size") % 2 == 0, F.col("sop_uid")).otherwise(F.concat(F.lit("x"), "sop_uid")).alias("sha256")).unionByName(
        h.filter("size > 3000").select(F.concat("path", F.lit("-new")).alias("path"), F.col("sop_uid").alias("sha256")))
    return before, after


@query("S10_verify_snapshot", "headers", "WITH " + SNAP + " SELECT coalesce(h.path,af.path) AS path,CASE WHEN h.path IS NULL THEN 'added' WHEN af.path IS NULL THEN 'missing' WHEN sha<>sop_uid THEN 'changed' ELSE 'same' END AS status FROM h FULL JOIN af ON h.path=af.path")
def s10(t):
    return C.verify_snapshot(*snapshots(t))


@query("S11_lineage", "headers", "WITH " + SNAP + """, r AS (SELECT 'input' AS role,path,sop_uid AS sha256 FROM h UNION ALL SELECT 'output',path,sha FROM af)
 SELECT run,'study' AS stage,role,path,sha256,'completed' AS status,alpha FROM r,(VALUES ('run-1','0.05'),('run-2','0.5')) v(run,alpha)""")
def s11(t):
    """Two runs appended to one table, a third attempt at the first one refused."""
    before, after = snapshots(t)
    path = scratch(t, "lineage")
    runs = {run: C.lineage(run, "study", before, after, {"alpha": alpha}, "completed") for run, alpha in (("run-1", "0.05"), ("run-2", "0.5"))}
    for run, rows in runs.items():
        C.append_lineage(rows, path, run)
    try:
        C.append_lineage(runs["run-1"], path, "run-1")
    except AnalysisException:
        return C.read_lineage(t.spark, path).select("run", "stage", "role", "path", "sha256", "status", F.col("params")["alpha"].alias("alpha"))
    raise RuntimeError("a second write of a run was accepted")


@query("S12_duplicate_payloads", "headers", "SELECT sop_uid AS sha256,count(*) AS uses,min(path) AS first_path,max(path) AS last_path FROM headers GROUP BY 1 HAVING count(*)>1")
def s12(t):
    return C.duplicate_payloads(t.headers().select("path", F.col("sop_uid").alias("sha256")))


@query("S14_replay_diff_table", "coords", """WITH a AS (SELECT *,CASE WHEN parcel%9=0 THEN NULL ELSE g1 END AS a1 FROM coords WHERE NOT (subject='S1' AND visit=2)), j AS (SELECT a.a1,a.g2 AS a2,e.g1 AS e1,CASE WHEN e.parcel%10=0 THEN e.g2+1e-3 ELSE e.g2 END AS e2,a.subject AS s,e.subject AS t FROM a FULL JOIN coords e ON a.subject=e.subject AND a.visit=e.visit AND a.parcel=e.parcel)
 SELECT count(*) FILTER (a1 IS NOT NULL AND s IS NOT NULL)+count(*) FILTER (s IS NOT NULL) AS compared_values,round(max(abs(a2-e2)) FILTER (s IS NOT NULL),6) AS max_absolute_error,count(*) FILTER (s IS NOT NULL AND a1 IS NULL) AS one_sided,count(*) FILTER (s IS NOT NULL AND abs(a2-e2)>1e-4) AS outside_tolerance,
 2*count(*) FILTER (s IS NULL OR t IS NULL) AS unpaired,0::BIGINT AS duplicate_keys,false AS passed FROM j""")
def s14(t):
    c = cut(t.coords())
    a = c.filter("not (subject = 'S1' and visit = 2)").withColumn("g1", F.when(F.col("parcel") % 9 != 0, F.col("g1")))
    e = c.withColumn("g2", F.when(F.col("parcel") % 10 == 0, F.col("g2") + 1e-3).otherwise(F.col("g2"))).withColumnRenamed("g2", "second")
    d = C.replay_diff_table(a, e, [*S, "parcel"], ["g1", "g2"], column_map={"g2": "second"})
    return d.withColumn("max_absolute_error", r6("max_absolute_error"))


@query("S15_replay_diff_array", "edges", "SELECT count(*) AS compared_values,0.0::DOUBLE AS max_absolute_error,0::BIGINT AS one_sided,0::BIGINT AS outside_tolerance,0::BIGINT AS unpaired,0::BIGINT AS duplicate_keys,0::BIGINT AS null_cells,true AS passed FROM edges")
def s15(t):
    e = cut(t.edges())
    return C.replay_diff_array(e, e, [*S, "i", "j"], "w")


@query("S16_replay_diff_values", "", """WITH k AS (SELECT event_id,CAST(props->>'$.k' AS DOUBLE) AS k FROM events)
 SELECT event_id AS doc,'direct' AS pair,1::BIGINT AS compared_values,0.0::DOUBLE AS max_absolute_error,0::BIGINT AS unpaired,0::BIGINT AS not_numbers,0::BIGINT AS outside_tolerance,0::BIGINT AS empty,true AS passed FROM k
 UNION ALL SELECT event_id,'nested',3,CASE WHEN event_id%5=0 THEN 0.5 ELSE 0.0 END,(event_id%7=0)::BIGINT,0,(event_id%5=0)::BIGINT,1,event_id%5<>0 AND event_id%7<>0 FROM k
 UNION ALL SELECT event_id,'moved',0,NULL,0,1,0,0,false FROM k""")
def s16(t):
    """Declared path pairs of two JSON documents for every event: a number, nested arrays, a path that leads nowhere."""
    e = t.raw("events").select(F.col("event_id").alias("doc"), F.get_json_object("props", "$.k").cast("double").alias("k"))
    one = F.struct(F.col("k").alias("a"), F.array(F.array("k", 2 * F.col("k")), F.array(F.lit(1.0)), F.array().cast("array<double>")).alias("b"), F.lit(1.0).alias("c"))
    more = F.when(F.col("doc") % 7 == 0, F.array(F.lit(1.0), F.lit(2.0))).otherwise(F.array(F.lit(1.0)))
    two = F.struct(F.struct(F.col("k").alias("value")).alias("a"), F.array(F.array(F.col("k"), 2 * F.col("k") + F.when(F.col("doc") % 5 == 0, 0.5).otherwise(0.0)), more, F.array().cast("array<double>")).alias("b"))
    paths = t.spark.createDataFrame([("direct", "$.a", "$.a.value"), ("nested", "$.b", "$.b"), ("moved", "$.c", "$.d")], "pair string, actual string, expected string")
    d = C.replay_diff_values(cut(e.select("doc", F.to_json(one).alias("json"))), cut(e.select("doc", F.to_json(two).alias("json"))), paths)
    return d.withColumn("max_absolute_error", r6("max_absolute_error"))


@query("S17_suite_status", "", """WITH c AS (SELECT source||'/'||lang AS task,n_chars<15000 AS completed,CASE WHEN lang<>'en' THEN n_chars<>13 END AS passed FROM documents)
 SELECT task,CASE WHEN NOT bool_and(completed) OR NOT coalesce(bool_and(passed),true) THEN 'failed' WHEN count(passed)>0 THEN 'verified' ELSE 'computed_not_verified' END AS status,count(passed) AS checks FROM c GROUP BY 1""")
def s17(t):
    d = t.raw("documents").select(
        F.concat_ws("/", "source", "lang").alias("task"), (F.col("n_chars") < 15000).alias("completed"), F.when(F.col("lang") != "en", F.col("n_chars") != 13).alias("passed"))
    return C.suite_status(d)


@query("S18_review_gate", "", """WITH o AS (SELECT sha256(text) AS m,sha256(lang) AS r,sha256(source) AS a FROM documents JOIN labels USING (doc_id) WHERE quality=1 AND toxic=0)
 SELECT 'f'||doc_id AS artifact,(sha256(text),sha256(lang),sha256(source)) IN (SELECT (m,r,a) FROM o) AS approved FROM documents""")
def s18(t):
    d = t.raw("documents").select("doc_id", F.sha2("text", 256).alias("mask_sha256"), F.sha2("lang", 256).alias("reference_sha256"), F.sha2("source", 256).alias("atlas_sha256"))
    items = [F.lit(i) for i in C.REVIEW_ITEMS]
    a = d.join(t.raw("labels"), "doc_id").select(
        "mask_sha256", "reference_sha256", "atlas_sha256", F.when(F.col("toxic") == 0, F.array(*items)).otherwise(F.array(*items[:4])).alias("checks"),
        F.when(F.col("quality") == 1, "r1").otherwise(" ").alias("reviewer"))
    return C.review_gate(d.withColumn("artifact", F.concat(F.lit("f"), F.col("doc_id").cast("string"))), a)


# -- acquisition catalogue ---------------------------------------------------

@query("I1_series_rollup", "headers", "SELECT series_uid,count(*) AS files,count(*) AS frames,CAST(sum(size) AS BIGINT) AS bytes,arg_min(study_uid,path) AS study_uid,arg_min(patient_id,path) AS patient_id,arg_min(sop_uid,path) AS sop_uid FROM headers GROUP BY 1")
def i1(t):
    return I.series_rollup(t.headers().withColumn("frames", F.lit(1)), ["study_uid", "patient_id", "sop_uid"])


@query("I2_reject_rows", "headers", "SELECT path,'missing image or identifier fields' AS reason FROM headers WHERE size<300")
def i2(t):
    h = t.headers().withColumn("rows", F.when(F.col("size") < 300, 0).otherwise(64)).withColumn("columns", F.lit(64))
    return I.reject_rows(h)[1].select("path", "reason")


@query("I3_duplicate_instances", "headers", "WITH d AS (SELECT sop_uid FROM headers GROUP BY 1 HAVING count(*)>1) SELECT series_uid,count(*) AS duplicate_rows,count(DISTINCT sop_uid) AS duplicate_instances FROM headers WHERE sop_uid IN (SELECT sop_uid FROM d) GROUP BY 1")
def i3(t):
    return I.duplicate_instances(t.headers())


@query("I4_uid_conflicts", "headers", "SELECT study_uid AS series_uid,count(DISTINCT patient_id) AS patients,count(DISTINCT study_uid) AS studies FROM headers GROUP BY 1 HAVING count(DISTINCT patient_id)>1")
def i4(t):
    return I.uid_conflicts(t.headers().withColumn("series_uid", F.col("study_uid")))


SALT = b"a fixed salt of the test catalogue"


def keyed_sql(value: str) -> str:
    """The keyed digest from two nested ones, as the published construction defines it."""
    inner, outer = (bytes(b ^ m for b in SALT.ljust(64, b"\0")).hex() for m in (0x36, 0x5C))
    return f"substr(sha256(unhex('{outer}')||unhex(sha256(unhex('{inner}')||encode({value})))),1,20)"


@query("I5_pseudonymize", "headers", f"SELECT path,{keyed_sql('series_uid')} AS series_key,{keyed_sql('study_uid')} AS study_key,CASE WHEN length(trim(patient_id))>0 THEN {keyed_sql("'site|'||patient_id||'|'")} END AS patient_key FROM headers")
def i5(t):
    h = t.headers().withColumn("issuer", F.lit("site")).withColumn("birth_date", F.lit(None).cast("string"))
    return I.pseudonymize(h, SALT)


def _any(terms) -> str:
    return "(" + " OR ".join(f"contains(t,'{x}')" for x in terms) + ")"


@query("I6_role_hints", "headers", "WITH l AS (SELECT path,CASE WHEN study_uid='en' THEN 'MR' WHEN study_uid='de' THEN 'CT' WHEN study_uid='fr' THEN 'MR' ELSE 'PT' END AS m,lower(text) AS t FROM headers) SELECT path,CASE WHEN m='CT' THEN 'ct' WHEN m<>'MR' THEN '' WHEN "
       + _any(I.DERIVED) + " THEN 'derived_image_not_raw_dwi' ELSE concat_ws(','," + ",".join(f"CASE WHEN {_any(v)} THEN '{k}' END" for k, v in I.ROLE_TERMS.items()) + ") END AS hints FROM l")
def i6(t):
    m = F.when(F.col("study_uid") == "en", "MR").when(F.col("study_uid") == "de", "CT").when(F.col("study_uid") == "fr", "MR").otherwise("PT")
    return t.headers().select("path", F.concat_ws(",", I.role_hints(m, F.col("text"))).alias("hints"))


@query("I7_validate_selection", "headers", """WITH s AS (SELECT series_uid,any_value(study_uid) AS st,any_value(patient_id) AS p FROM headers GROUP BY 1), x AS (SELECT min(series_uid) AS a,max(series_uid) AS b FROM s),
 q AS (SELECT role,s.* FROM (SELECT 't1' AS role,a AS u FROM x UNION ALL SELECT 'ct',b FROM x) z JOIN s ON s.series_uid=u)
 SELECT reason,n FROM (SELECT 'missing_role' AS reason,1::BIGINT AS n UNION ALL SELECT 'wrong_modality',1 UNION ALL SELECT 'extra_patients',count(DISTINCT p)-1 FROM q UNION ALL SELECT 'extra_studies',count(DISTINCT st)-1 FROM q) WHERE n>0""")
def i7(t):
    s = t.headers().groupBy("series_uid").agg(F.first("study_uid").alias("study_uid"), F.first("patient_id").alias("patient_id")).withColumn("modality", F.lit("MR")).withColumn("derived", F.lit(False))
    x = s.agg(F.min("series_uid").alias("a"), F.max("series_uid").alias("b"))
    sel = x.select(F.inline(F.array(F.struct(F.lit("t1").alias("role"), F.col("a").alias("series_uid")), F.struct(F.lit("ct").alias("role"), F.col("b").alias("series_uid")))))
    return I.validate_selection(sel, s, ["t1", "dwi"])


@query("I8_stat_drift", "headers", "SELECT path,size>4000 AS gone FROM headers WHERE size>4000 OR size%7=0")
def i8(t):
    h = t.headers().select("path", "size").withColumn("mtime", F.lit(1))
    now = h.filter("size <= 4000").withColumn("mtime", F.when(F.col("size") % 7 == 0, 2).otherwise(1))
    return I.stat_drift(h, now)


@query("I9_shell_cluster", "bvals", "WITH s AS (SELECT acquisition,floor(b/1000) AS k,avg(b) AS m,count(*) AS n FROM bvals WHERE b>50 GROUP BY ALL) SELECT acquisition,CAST(row_number() OVER (PARTITION BY acquisition ORDER BY k)-1 AS INT) AS shell,round(m,1) AS b,n AS directions FROM s")
def i9(t):
    return I.shell_cluster(t.bvals())


@query("I10_gradient_table_qc", "", """WITH g AS (SELECT user_id%20 AS a,CASE WHEN event_id%9=0 THEN 0.0 ELSE 1000.0 END AS b,event_id%7-3.0 AS x,event_id%5-2.0 AS y,event_id%11-5.0 AS z FROM events), u AS (SELECT *,sqrt(x*x+y*y+z*z) AS l FROM g)
 SELECT a AS acquisition,count(*) AS volumes,count(*) FILTER (b=0) AS baselines,count(*) FILTER (b>0) AS directions,count(*) FILTER (b>0 AND l=0) AS not_unit,6::INT AS design_rank,count(*) FILTER (b=0)>=1 AND count(*) FILTER (b>0)>=6 AND count(*) FILTER (b>0 AND l=0)=0 AS accepted FROM u GROUP BY 1""")
def i10(t):
    e = F.col("event_id")
    g = t.raw("events").select((F.col("user_id") % 20).alias("acquisition"), F.when(e % 9 == 0, 0.0).otherwise(1000.0).alias("b"), (e % 7 - 3.0).alias("x"), (e % 5 - 2.0).alias("y"), (e % 11 - 5.0).alias("z"))
    ln = F.greatest(F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2), F.lit(1e-12))
    return I.gradient_table_qc(g.select("acquisition", "b", *[(F.col(c) / ln).alias("g" + c) for c in "xyz"]))


@query("I11_select_baselines", "bvals", "SELECT acquisition,vol FROM bvals WHERE b<=50")
def i11(t):
    return I.select_baselines(t.bvals())
