"""Compositions of geometry operators used by whole-cohort studies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import order as O
from ..functions.expr import AXES
from ..operators import geometry as M
from ..session import cut


def visit_change(values: DataFrame, keys: list[str], cols: list[str], first: int = 1, second: int = 2) -> DataFrame:
    """Second minus first visit of each column."""
    at = lambda c, v: F.max(F.when(F.col("visit") == v, F.col(c)))
    return values.groupBy(*keys).agg(*[(at(c, second) - at(c, first)).alias(c) for c in cols])


def matched_gradient(coords: DataFrame) -> DataFrame:
    """Pooled-centroid eccentricity, dispersion, first-axis position and move per network."""
    k = ["subject", "visit", "network"]
    d = coords.join(M.centre(coords, ["subject", "visit"], "h_"), ["subject", "visit"]).join(M.centre(coords, k, "c_"), k)
    long = M.melt(d.filter("visit in (1, 2)"), k, {"ecc": M.gap("", "h_"), "disp": M.gap("", "c_")})
    med = O.median(long, [*k, "metric"], "value", "value").groupBy(*k).pivot("metric", ["ecc", "disp"]).agg(F.first("value"))
    pos = coords.groupBy(*k).agg(F.avg("g1").alias("g1pos"))
    change = visit_change(med.join(pos, k), ["subject", "network"], ["ecc", "disp", "g1pos"])
    move = M.displacement(M.pair_visits(coords, "subject", 1, 2)).groupBy("subject", "network").agg(F.avg("displacement").alias("move"))
    return change.join(move, ["subject", "network"])


def signed_medians(coords: DataFrame, session: list[str], axes=AXES) -> DataFrame:
    each = M.melt(coords, [*session, "network"], {a: F.col(a) for a in axes})
    both = each.unionByName(each.withColumn("network", F.lit("cortex")))
    name = F.concat("network", F.lit("_"), F.upper("metric"), F.lit("_median"))
    return O.median(both.select(*session, name.alias("metric"), "value"), [*session, "metric"], "value", "value")


def displacement_from_first(coords: DataFrame, base: int) -> DataFrame:
    """Mean move from the base visit at every visit, whole cortex and per network."""
    a = coords.filter(F.col("visit") == base).select("subject", "parcel", *[F.col(x).alias("a_" + x) for x in AXES])
    d = coords.join(a, ["subject", "parcel"]).withColumn("d", M.gap("", "a_"))
    d = d.select("subject", "visit", "d", F.explode(F.array(F.lit("cortex"), F.col("network"))).alias("r"))
    return d.groupBy("subject", "visit", F.concat("r", F.lit("_displacement")).alias("metric")).agg(F.avg("d").alias("value"))


def pooled_inventory(coords: DataFrame, session: list[str], networks: tuple[str, ...], positions: bool) -> DataFrame:
    """Pooled inventory with mean centres and positions, or with median centres."""
    d = M.pooled_frame(coords, session)
    whole = M.melt(
        d.groupBy(*session).agg(F.avg(F.col("ecc") ** 2).alias("e2"), F.avg("ecc").alias("e")), session,
        {"spectral_energy": F.col("e2"), "cortex_ecc": F.col("e")},
    )
    ecc = d.groupBy(*session, F.concat("network", F.lit("_ecc")).alias("metric")).agg(F.avg("ecc").alias("value"))
    disp = M.region_spread(d, session, {n: F.col("network") == n for n in networks})
    dist = M.named_pairs(M.network_distances(coords, session, not positions), session, networks)
    rng = M.melt(M.axis_range(coords, session), session, {f"G{i}_range": F.col("range_" + a) for i, a in enumerate(AXES, 1)})
    parts = [whole, ecc, disp, dist, rng]
    if positions:
        parts.append(signed_medians(coords, session, AXES[:2]).filter(~F.col("metric").startswith("cortex_")))
    return reduce(DataFrame.unionByName, parts)


def axis_ordering(coords: DataFrame, base: int) -> DataFrame:
    """tau-b of parcel order between the base visit and every visit, per axis."""
    k = ["subject", "parcel"]
    long = M.melt(coords, ["subject", "visit", "parcel"], {a: F.col(a) for a in AXES}).withColumnRenamed("metric", "axis")
    a = long.filter(F.col("visit") == base).select(*k, "axis", F.col("value").alias("x"))
    pairs = cut(long.join(a, [*k, "axis"]).select("subject", "visit", "axis", "x", F.col("value").alias("y")))
    return M.kendall_tau(pairs, ["subject", "visit", "axis"], "x", "y")


def candidate_values(coords: DataFrame, mapping: dict[int, str]) -> DataFrame:
    """The four declared measures; ``mapping`` names the column matched to each primary axis."""
    s = ["subject", "visit"]
    d = M.with_centres(coords.filter("visit in (1, 2)"), s)
    first, second = mapping[0], mapping[1]
    long = d.filter("network in ('SomMot', 'Cont')").select(
        *s, "network", F.when(F.col("network") == "SomMot", M.gap("", "h_")).otherwise(F.col(second) - F.col("h_" + second)).alias("v")
    )
    med = O.median(long, [*s, "network"], "v", "v").groupBy(*s).pivot("network", ["SomMot", "Cont"]).agg(F.first("v"))
    sd = d.filter("network = 'Vis'").groupBy(*s).agg(
        F.sqrt(F.sum((F.col(first) - F.col("c_" + first)) ** 2) / (F.count(F.lit(1)) - 2)).alias("vis_g1_dispersion_sd")
    )
    med = med.withColumnRenamed("SomMot", "sommot_eccentricity_median").withColumnRenamed("Cont", "cont_g2_position_median")
    change = visit_change(med.join(sd, s), ["subject"], ["sommot_eccentricity_median", "cont_g2_position_median", "vis_g1_dispersion_sd"])
    vis = M.displacement(M.pair_visits(coords, "subject", 1, 2)).filter("network = 'Vis'")
    return vis.groupBy("subject").agg(F.avg("displacement").alias("vis_displacement_mean")).join(change, "subject")


def symptom_values(lateral: DataFrame, sides: DataFrame) -> DataFrame:
    """Each side definition's value if the right (or left) side is contralateral.

    ``right`` says which of the two is the observed one.
    """
    from ..operators import inference as P

    k = ["subject", "network", "metric"]
    pick = lambda d, p: lateral.filter(F.col("definition") == d).select(*k, *[F.col(v).alias(p + v) for v in ("post1", "post2", "delta")])
    j = pick("left_only", "l_").join(pick("right_only", "r_"), k).join(F.broadcast(sides), "subject")
    j = j.withColumn("definition", F.explode(F.array(*[F.lit(d) for d in P.SIDE_DEFINITIONS])))
    half = lambda p: {v: F.col(p + v) for v in ("post1", "post2", "delta")}
    interval = F.col("l_post1").isNull()
    value = lambda c, i: P.side_value(half(c), half(i), F.col("metric"), interval, F.col("definition"))
    return j.select(*k, "definition", (F.col("side") == "L").alias("right"), value("r_", "l_").alias("if_right"), value("l_", "r_").alias("if_left"))


def side_tests(values: DataFrame, keys: list[str]) -> DataFrame:
    """Arrays per test over the subjects of one cohort (eight at most)."""
    from ..functions.expr import array_unit_ranks, checked
    from ..operators import inference as P

    c = values.groupBy("endpoint", *keys).agg(
        F.array_sort(F.collect_list(F.struct("subject", "right", "if_right", "if_left", "y"))).alias("c")
    )
    t = c.select(
        "endpoint", *keys, checked(F.size("c"), F.size("c").between(3, 8), "a side-label test needs 3..8 subjects").alias("n"), F.size(F.filter("c", lambda e: e["right"])).alias("k"),
        F.col("c.if_right").alias("if_right"), F.col("c.if_left").alias("if_left"), array_unit_ranks(F.col("c.y")).alias("ry"),
        F.transform("c", lambda e: F.when(e["right"], e["if_right"]).otherwise(e["if_left"])).alias("xs"),
    )
    t = t.filter(~F.exists("xs", lambda v: v.isNull())).withColumn("rho", P.dot(array_unit_ranks(F.col("xs")), F.col("ry")))
    return t.filter("rho is not null")


def rank_correlation(pairs: DataFrame, keys: list[str], a: str, b: str, out: str = "rho") -> DataFrame:
    """Spearman per key over groups of any size; null when a side is constant."""
    r = O.avg_rank(O.avg_rank(pairs, keys, a, "_ra"), keys, b, "_rb")
    return r.groupBy(*keys).agg(F.corr("_ra", "_rb").alias(out))


def reliability_summary(icc: DataFrame) -> DataFrame:
    i = cut(icc.withColumn("_1", F.lit(1)))
    m = O.median(i, ["_1"], "icc21", "median")
    s = i.groupBy("_1").agg(
        F.count(F.lit(1)).alias("n_metrics"), (F.count_if(F.col("icc21") >= 0.6) / F.count(F.lit(1))).alias("frac_ge_0_6"),
        (F.count_if(F.col("icc21") < 0.4) / F.count(F.lit(1))).alias("frac_lt_0_4"),
    )
    return s.join(m, "_1").drop("_1")
