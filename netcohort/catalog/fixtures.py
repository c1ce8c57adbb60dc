"""Analysis tables derived from the driver's star schema, in Spark and in SQL.

Every table reads its sources whole; each ``SQL`` entry is the same definition
for the oracle, as a named common table expression.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import order as O
from ..session import cut, dealt

# The seven cortical network names, in their published order.
NETWORKS = ("Vis", "SomMot", "DorsAttn", "SalVentAttn", "Limbic", "Cont", "Default")
STRUCTURES = ("Left-Thalamus", "Right-Thalamus", "Left-Putamen", "Right-Putamen", "Left-Caudate", "Right-Caudate")
N_GRAPH = 50
N_CORTEX = 44


def _pick(names, idx):
    return F.element_at(F.array(*[F.lit(n) for n in names]), (idx + 1).cast("int"))


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str, network: str | None = None):
        self.spark, self.dir, self.network = spark, sf_dir, network
        self._written: dict[str, DataFrame] = {}

    def _once(self, name: str, table: Callable[[], DataFrame]) -> DataFrame:
        """A small table that plans read many times, written once a query: its source is not read again."""
        if name not in self._written:
            self._written[name] = cut(table())
        return self._written[name]

    def of_network(self, network: str) -> Tables:
        """The same tables with the coordinates of one network only: other line items are not moved."""
        return Tables(self.spark, self.dir, network)

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    # -- cohort line items: six subjects, three visits, the whole fact table
    def lines(self) -> DataFrame:
        # orders meet their customer first, so the line items are moved once
        o = self.raw("orders").join(self.raw("customer"), F.col("o_custkey") == F.col("c_custkey"))
        year = F.year("o_orderdate")
        return (
            self.raw("lineitem")
            .join(o, F.col("l_orderkey") == F.col("o_orderkey"))
            .withColumn("subject", F.concat(F.lit("S"), (F.col("c_nationkey") % 6).cast("string")))
            .withColumn("visit", F.when(year <= 1996, 0).when(year <= 1998, 1).otherwise(2))
        )

    def assignments(self) -> DataFrame:
        s = self.raw("supplier")
        return self.lines().join(s, F.col("l_suppkey") == F.col("s_suppkey")).select(
            "subject", "visit",
            (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("track"),
            F.col("c_nationkey").alias("a"), F.col("s_nationkey").alias("b"), F.col("l_quantity").alias("w"),
        )

    def graph_assignments(self) -> DataFrame:
        p = self.raw("part").select("p_partkey", "p_size")
        return self.lines().join(p, F.col("l_partkey") == F.col("p_partkey")).select(
            "subject", "visit",
            F.col("p_size").alias("a"), F.col("l_quantity").cast("int").alias("b"), F.col("l_extendedprice").alias("w"),
        )

    def edges(self) -> DataFrame:
        """Graph edges over node indices 0..49, weights at cent precision."""
        a = self.graph_assignments().filter("a <> b")
        return a.groupBy(
            "subject", "visit", (F.least("a", "b") - 1).alias("i"), (F.greatest("a", "b") - 1).alias("j")
        ).agg(F.round(F.sum("w"), 2).alias("w"))

    def nodes(self) -> DataFrame:
        return self._once("nodes", self._nodes)

    def _nodes(self) -> DataFrame:
        idx = F.col("idx")
        base = self.raw("part").select((F.col("p_size") - 1).alias("idx")).distinct()
        cortex = idx < N_CORTEX
        hemi = F.when(cortex, F.when(idx < N_CORTEX // 2, "L").otherwise("R")).otherwise(
            F.when(idx % 2 == 0, "L").otherwise("R")
        )
        net = F.when(cortex, _pick(NETWORKS, idx % 7)).otherwise("Subcortex")
        name = F.when(
            cortex,
            F.concat(
                F.lit("7Networks_"), hemi, F.lit("H_"), net,
                F.when(idx % 2 == 0, F.lit("_Post_")).otherwise(F.lit("_")), idx.cast("string"),
            ),
        ).otherwise(_pick(STRUCTURES, F.greatest(idx - N_CORTEX, F.lit(0))))
        return base.select(
            "idx", (idx + 1).alias("label"), name.alias("name"), hemi.alias("hemi"),
            F.when(cortex, "cortex").otherwise("subcortex").alias("tissue"), net.alias("network"),
        )

    def nation_nodes(self) -> DataFrame:
        return self.raw("nation").join(self.raw("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(
            F.col("n_nationkey").alias("idx"), (F.col("n_nationkey") + 1).alias("label"), F.col("n_name").alias("name"),
            F.when(F.floor(F.col("n_nationkey") / 5) % 2 == 0, "L").otherwise("R").alias("hemi"),
            F.lit("cortex").alias("tissue"), F.col("r_name").alias("network"),
        )

    def nation_edges(self) -> DataFrame:
        return (
            self.assignments_price().filter("a <> b")
            .groupBy("subject", "visit", F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j"))
            .agg(F.round(F.sum("w"), 2).alias("w"))
        )

    def assignments_price(self) -> DataFrame:
        s = self.raw("supplier")
        return self.lines().join(s, F.col("l_suppkey") == F.col("s_suppkey")).select(
            F.col("c_mktsegment").alias("subject"), "visit",
            F.col("c_nationkey").alias("a"), F.col("s_nationkey").alias("b"), F.col("l_extendedprice").alias("w"),
        )

    def coords(self) -> DataFrame:
        """Four coordinates per subject, visit and parcel (one parcel per supplier)."""
        parcel = F.col("parcel")
        every = (
            self.lines().groupBy("subject", "visit", F.col("l_suppkey").alias("parcel"))
            .agg(
                (F.avg("l_quantity") * F.lit(0.7312345678901e0)).alias("g1"),
                (F.avg("l_extendedprice") * F.lit(0.0003712345678901e0)).alias("g2"),
                (F.avg("l_discount") * F.lit(371.2345678901e0)).alias("g3"),
                (F.avg("l_tax") * F.lit(471.2345678901e0)).alias("g4"),
            )
            .select(
                "subject", "visit", "parcel",
                F.when(parcel % 2 == 0, "L").otherwise("R").alias("hemi"),
                _pick(NETWORKS, F.floor(parcel / 2) % 7).alias("network"),
                "g1", "g2", "g3", "g4",
            )
        )
        return every.filter(F.col("network") == self.network) if self.network else every

    def outcomes(self) -> DataFrame:
        """``endpoint, subject, y``; one endpoint is constant, one has a null."""
        return self._once("outcomes", self._outcomes)

    def _outcomes(self) -> DataFrame:
        c = self.raw("customer").withColumn("subject", F.concat(F.lit("S"), (F.col("c_nationkey") % 6).cast("string")))
        agg = c.groupBy("subject").agg(
            F.round(F.avg("c_acctbal"), 4).alias("balance"), F.count(F.lit(1)).cast("double").alias("count"),
            F.round(F.max("c_acctbal"), 2).alias("top"),
        )
        return agg.select(
            "subject",
            F.explode(
                F.create_map(
                    F.lit("balance"), F.col("balance"), F.lit("top"), F.col("top"), F.lit("constant"), F.lit(0.0),
                    F.lit("partial"), F.when(F.col("subject") != "S5", F.col("balance")),
                )
            ).alias("endpoint", "y"),
        ).select("endpoint", "subject", "y")

    def sides(self) -> DataFrame:
        """Dominant side per subject (two of six on the left)."""
        return self.outcomes().filter("endpoint = 'balance'").select(
            "subject", F.when(F.col("subject").isin("S0", "S3"), "L").otherwise("R").alias("side")
        )

    def voxels(self) -> DataFrame:
        k = F.col("o_orderkey")
        o = self.raw("orders")
        cells = o.select(
            F.concat_ws("-", "o_orderstatus", F.floor(k / 8192).cast("string")).alias("image_id"),
            (k % 16).cast("int").alias("x"), (F.floor(k / 16) % 16).cast("int").alias("y"),
            (F.col("o_custkey") % 16).cast("int").alias("z"), F.col("o_totalprice").alias("v"),
        )
        at = ["image_id", "x", "y", "z"]
        return dealt(cells, o.count(), *at).groupBy(*at).agg(F.max("v").alias("v"))

    def with_median(self) -> DataFrame:
        """Voxels beside the median ``m`` of their image."""
        v = cut(self.voxels())
        rows = v.count()
        m = O.median(dealt(v, rows, "image_id", "v"), ["image_id"], "v", "m")
        return dealt(v, rows, "image_id").join(m, "image_id")

    def mask(self) -> DataFrame:
        return self.with_median().filter("v > m").select("image_id", "x", "y", "z")

    def atlas(self) -> DataFrame:
        return self.voxels().select(
            "image_id", "x", "y", "z",
            (F.floor(F.col("x") / 4) + 4 * F.floor(F.col("y") / 4) + 1).cast("int").alias("label"),
        )

    def grids(self) -> DataFrame:
        return self.voxels().select("image_id").distinct().select(
            "image_id", F.array(*[F.lit(16)] * 3).alias("shape"),
            F.array(*[F.lit(float(x)) for x in (2, 0, 0, 0, 0, 2, 0, 0, 0, 0, 2, 0, 0, 0, 0, 1)]).alias("affine"),
        )

    def points(self) -> DataFrame:
        e = self.raw("events").select(
            F.col("user_id").alias("track"), "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
            (F.col("event_id") % 16).cast("double").alias("x"),
            (F.floor(F.col("event_id") / 16) % 16).cast("double").alias("y"),
            (F.col("user_id") % 16).cast("double").alias("z"),
        )
        return O.position_index(e, ["track"], "us", ["event_id"], "seq").select("track", "seq", "x", "y", "z")

    def fine_points(self) -> DataFrame:
        """Points with every segment cut into pieces no longer than 0.4 voxels."""
        p = self.points()
        q = p.select("track", (F.col("seq") - 1).alias("seq"), *[F.col(c).alias(c + "2") for c in "xyz"])
        ln = F.sqrt(sum(((F.col(c + "2") - F.col(c)) ** 2 for c in "xyz"), F.lit(0.0)))
        seg = p.join(q, ["track", "seq"], "left").withColumn("m", F.coalesce(F.greatest(F.ceil(ln / 0.4), F.lit(1)), F.lit(1)).cast("int"))
        # a piece's place is the number of pieces before its segment, by blocks of the track
        seg = seg.withColumn("_b", F.floor(F.col("seq") / 4096))
        before = F.sum("m").over(W.partitionBy("track").orderBy("_b").rowsBetween(W.unboundedPreceding, -1))
        blocks = seg.groupBy("track", "_b").agg(F.sum("m").alias("m")).select("track", "_b", F.coalesce(before, F.lit(0)).alias("_o"))
        inside = F.sum("m").over(W.partitionBy("track", "_b").orderBy("seq").rowsBetween(W.unboundedPreceding, -1))
        placed = seg.withColumn("_i", F.coalesce(inside, F.lit(0))).join(blocks, ["track", "_b"])
        cut_up = placed.select("*", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("k"))
        f = F.col("k") / F.col("m")
        at = lambda c: F.col(c) + (F.coalesce(F.col(c + "2"), F.col(c)) - F.col(c)) * f
        return cut_up.select("track", (F.col("_o") + F.col("_i") + F.col("k")).cast("long").alias("seq"), *[at(c).alias(c) for c in "xyz"])

    def headers(self) -> DataFrame:
        d = self.raw("documents")
        return d.select(
            F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("path"),
            F.concat_ws("/", "lang", "source").alias("series_uid"), F.col("lang").alias("study_uid"),
            F.sha2("text", 256).alias("sop_uid"), F.col("source").alias("patient_id"),
            F.col("n_chars").alias("size"), F.col("text"),
        )

    def bvals(self) -> DataFrame:
        e = F.col("event_id")
        b = F.when(e % 9 == 0, F.lit(0.0)).otherwise(1000.0 * (1 + e % 3) + F.round("value") % 40)
        return self.raw("events").select((F.col("user_id") % 20).alias("acquisition"), e.alias("vol"), b.alias("b"))


_NET = "[" + ",".join(f"'{n}'" for n in NETWORKS) + "]"
_STR = "[" + ",".join(f"'{n}'" for n in STRUCTURES) + "]"

SQL: dict[str, str] = {
    "lines": """SELECT *, 'S'||(c_nationkey%6) AS subject,
  CASE WHEN year(o_orderdate)<=1996 THEN 0 WHEN year(o_orderdate)<=1998 THEN 1 ELSE 2 END AS visit
  FROM lineitem JOIN orders ON l_orderkey=o_orderkey JOIN customer ON o_custkey=c_custkey""",
    "asg": """SELECT subject, visit, l_orderkey*8+l_linenumber AS track, c_nationkey AS a, s_nationkey AS b, l_quantity AS w
  FROM lines JOIN supplier ON l_suppkey=s_suppkey""",
    "gasg": """SELECT subject, visit, p_size AS a, CAST(l_quantity AS INT) AS b, l_extendedprice AS w
  FROM lines JOIN part ON l_partkey=p_partkey""",
    "edges": """SELECT subject, visit, least(a,b)-1 AS i, greatest(a,b)-1 AS j, round(sum(w),2) AS w
  FROM gasg WHERE a<>b GROUP BY ALL""",
    "nodes": f"""SELECT idx, idx+1 AS label,
  CASE WHEN idx<44 THEN '7Networks_'||hemi||'H_'||network||(CASE WHEN idx%2=0 THEN '_Post_' ELSE '_' END)||idx
       ELSE ({_STR})[idx-43] END AS name, hemi, tissue, network
  FROM (SELECT idx, CASE WHEN idx<22 THEN 'L' WHEN idx<44 THEN 'R' WHEN idx%2=0 THEN 'L' ELSE 'R' END AS hemi,
    CASE WHEN idx<44 THEN 'cortex' ELSE 'subcortex' END AS tissue,
    CASE WHEN idx<44 THEN ({_NET})[idx%7+1] ELSE 'Subcortex' END AS network
    FROM (SELECT DISTINCT p_size-1 AS idx FROM part))""",
    "nnodes": """SELECT n_nationkey AS idx, n_nationkey+1 AS label, n_name AS name,
  CASE WHEN (n_nationkey//5)%2=0 THEN 'L' ELSE 'R' END AS hemi, 'cortex' AS tissue, r_name AS network
  FROM nation JOIN region ON n_regionkey=r_regionkey""",
    "nedges": """SELECT c_mktsegment AS subject, visit, least(c_nationkey,s_nationkey) AS i,
  greatest(c_nationkey,s_nationkey) AS j, round(sum(l_extendedprice),2) AS w
  FROM lines JOIN supplier ON l_suppkey=s_suppkey WHERE c_nationkey<>s_nationkey GROUP BY ALL""",
    "coords": f"""SELECT subject, visit, l_suppkey AS parcel, CASE WHEN l_suppkey%2=0 THEN 'L' ELSE 'R' END AS hemi,
  ({_NET})[(l_suppkey//2)%7+1] AS network, avg(l_quantity)*0.7312345678901e0 AS g1, avg(l_extendedprice)*0.0003712345678901e0 AS g2,
  avg(l_discount)*371.2345678901e0 AS g3, avg(l_tax)*471.2345678901e0 AS g4 FROM lines GROUP BY ALL""",
    "outcomes": """SELECT endpoint, subject, CASE endpoint WHEN 'balance' THEN bal WHEN 'top' THEN top WHEN 'constant' THEN 0.0
    ELSE CASE WHEN subject<>'S5' THEN bal END END AS y
  FROM (SELECT 'S'||(c_nationkey%6) AS subject, round(avg(c_acctbal),4) AS bal, round(max(c_acctbal),2) AS top FROM customer GROUP BY 1),
   (VALUES ('balance'),('top'),('constant'),('partial')) e(endpoint)""",
    "sides": """SELECT subject, CASE WHEN subject IN ('S0','S3') THEN 'L' ELSE 'R' END AS side FROM outcomes WHERE endpoint='balance'""",
    "voxels": """SELECT o_orderstatus||'-'||(o_orderkey//8192) AS image_id, CAST(o_orderkey%16 AS INT) AS x,
  CAST((o_orderkey//16)%16 AS INT) AS y, CAST(o_custkey%16 AS INT) AS z, max(o_totalprice) AS v FROM orders GROUP BY ALL""",
    "mask": """SELECT image_id,x,y,z FROM voxels JOIN (SELECT image_id, quantile_cont(v,.5) AS m FROM voxels GROUP BY 1) USING (image_id) WHERE v>m""",
    "atlas": "SELECT image_id,x,y,z, CAST(x//4+4*(y//4)+1 AS INT) AS label FROM voxels",
    "points": """SELECT user_id AS track, row_number() OVER (PARTITION BY user_id ORDER BY ts,event_id)-1 AS seq,
  CAST(event_id%16 AS DOUBLE) AS x, CAST((event_id//16)%16 AS DOUBLE) AS y, CAST(user_id%16 AS DOUBLE) AS z FROM events""",
    "fine": """SELECT track, row_number() OVER (PARTITION BY track ORDER BY seq,k)-1 AS seq,
   x+(x2-x)*(k/m) AS x, y+(y2-y)*(k/m) AS y, z+(z2-z)*(k/m) AS z FROM (
   SELECT track, seq, x,y,z, coalesce(x2,x) AS x2, coalesce(y2,y) AS y2, coalesce(z2,z) AS z2, m,
     unnest(range(CAST(m AS BIGINT))) AS k FROM (
    SELECT *, CASE WHEN x2 IS NULL THEN 1 ELSE greatest(ceil(sqrt((x2-x)**2+(y2-y)**2+(z2-z)**2)/0.4),1) END AS m FROM (
     SELECT *, lead(x) OVER t AS x2, lead(y) OVER t AS y2, lead(z) OVER t AS z2 FROM points WINDOW t AS (PARTITION BY track ORDER BY seq))))""",
    "headers": """SELECT 'f'||doc_id AS path, lang||'/'||source AS series_uid, lang AS study_uid, sha256(text) AS sop_uid,
  source AS patient_id, n_chars AS size, text FROM documents""",
    "bvals": """SELECT user_id%20 AS acquisition, event_id AS vol,
  CASE WHEN event_id%9=0 THEN 0.0 ELSE 1000.0*(1+event_id%3)+round(value)%40 END AS b FROM events""",
    # all orderings of 0..n-1 for n in 5..6, numbered lexicographically
    "pgrow": """SELECT n, CAST([] AS INT[]) AS p FROM (VALUES (3),(4),(5),(6)) v(n)
  UNION ALL SELECT n, list_append(p, CAST(k AS INT)) FROM pgrow, range(6) r(k) WHERE len(p)<n AND k<n AND NOT list_contains(p, CAST(k AS INT))""",
    "perms": "SELECT n, p, row_number() OVER (PARTITION BY n ORDER BY p)-1 AS perm FROM pgrow WHERE len(p)=n",
}

NEEDS = {
    "asg": ["lines"], "gasg": ["lines"], "edges": ["gasg"], "nedges": ["lines"], "coords": ["lines"], "sides": ["outcomes"],
    "mask": ["voxels"], "atlas": ["voxels"], "fine": ["points"], "perms": ["pgrow"],
}


def with_tables(names: str, body: str) -> str:
    """Prefix ``body`` with the named definitions, each after what it needs."""
    done: list[str] = []

    def add(name: str) -> None:
        for dep in NEEDS.get(name, []):
            add(dep)
        if name not in done:
            done.append(name)

    for name in names.split():
        add(name)
    heads = [f"{n} AS ({SQL[n]})" for n in done]
    body = body.strip()
    if body.upper().startswith("WITH "):
        return "WITH RECURSIVE " + ",\n".join([*heads, body[5:]])
    return ("WITH RECURSIVE " + ",\n".join(heads) + "\n" if heads else "") + body
