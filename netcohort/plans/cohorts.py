"""Cross-cohort, transfer, sensitivity and control studies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import order as O
from ..functions.expr import AXES, checked, finite
from ..operators import embedding as E
from ..operators import geometry as M
from ..operators import graphs as G
from ..operators import inference as P
from ..operators import similarity as Y
from ..operators.iterate import union_all
from ..session import cut
from . import screens, studies
from .graph_study import session_measures


# -- matched node and edge measures -----------------------------------------

def cortical_log_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Log-weight cortical pairs, both directions, with the two networks."""
    c = F.broadcast(nodes.filter("tissue = 'cortex'").select("idx", "network"))
    a, b = c.select(F.col("idx").alias("i"), F.col("network").alias("ni")), c.select(F.col("idx").alias("j"), F.col("network").alias("nj"))
    return G.adjacency(edges, ["subject", "visit"]).join(a, "i").join(b, "j").withColumn("lw", F.log1p("w"))


def matched_node(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Mean strength and degree change per network, absolute and relative to visit 1."""
    size = nodes.filter("tissue = 'cortex'").groupBy("network").agg(F.count(F.lit(1)).alias("n"))
    d = cortical_log_edges(edges, nodes).groupBy("subject", "visit", F.col("ni").alias("network")).agg(F.sum("lw").alias("s"), F.count_if(F.col("lw") > 0).alias("k"))
    d = d.join(F.broadcast(size), "network").select("subject", "visit", "network", (F.col("s") / F.col("n")).alias("s"), (F.col("k") / F.col("n")).alias("k"))
    at = lambda c, v: F.max(F.when(F.col("visit") == v, F.col(c)))
    w = d.groupBy("subject", "network").agg(at("s", 1).alias("s1"), at("s", 2).alias("s2"), at("k", 1).alias("k1"), at("k", 2).alias("k2"))
    ds, dk = F.col("s2") - F.col("s1"), F.col("k2") - F.col("k1")
    return w.select("subject", "network", ds.alias("strength"), dk.alias("degree"), F.when(F.col("s1") > 0, ds / F.col("s1")).alias("str_rel"), F.when(F.col("k1") > 0, dk / F.col("k1")).alias("deg_rel"))


# The networks an edge block may end in.
BLOCK_TARGETS = ("Vis", "SomMot", "DorsAttn", "Default")


def matched_edge(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Change of mean block weight, the zero diagonal counted as cells."""
    size = nodes.filter("tissue = 'cortex'").groupBy("network").agg(F.count(F.lit(1)).alias("n"))
    e = cortical_log_edges(edges, nodes).filter(F.col("nj").isin(*BLOCK_TARGETS))
    b = e.groupBy("subject", "ni", "nj").agg((F.sum(F.when(F.col("visit") == 2, F.col("lw")).otherwise(0.0)) - F.sum(F.when(F.col("visit") == 1, F.col("lw")).otherwise(0.0))).alias("d"))
    s = lambda a, c: F.broadcast(size.select(F.col("network").alias(a), F.col("n").alias(c)))
    return b.join(s("ni", "na"), "ni").join(s("nj", "nb"), "nj").select("subject", F.concat_ws("-", "ni", "nj").alias("block"), (F.col("d") / (F.col("na") * F.col("nb"))).alias("change"))


# Name fragments of the subcortical structures.
STRUCTURES = {"thalamus": "thalam", "putamen": "putamen", "caudate": "caudate", "pallidum": "pallid", "accumbens": "accumbens"}


def structure_network_strength(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Weight between each structure and each network or the whole cortex; slot 0 repeats visit 1."""
    low = F.lower("name")
    tag = F.coalesce(*[F.when(low.contains(v), F.lit(k)) for k, v in STRUCTURES.items()])
    s = F.broadcast(nodes.filter("tissue <> 'cortex'").select(F.col("idx").alias("i"), tag.alias("structure")).filter("structure is not null"))
    c = F.broadcast(nodes.filter("tissue = 'cortex'").select(F.col("idx").alias("j"), "network"))
    e = G.adjacency(edges.filter("visit > 0"), ["subject", "visit"]).join(s, "i").join(c, "j")
    e = e.select("subject", F.explode(F.when(F.col("visit") == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(2)))).alias("visit"), "structure", F.explode(F.array("network", F.lit("cortex"))).alias("target"), "w")
    return e.groupBy("subject", "visit", F.concat_ws("_", "structure", "target", F.lit("absolute")).alias("metric")).agg(F.sum("w").alias("value"))


# -- replication and calibres ------------------------------------------------

def rank_rhos(features: DataFrame, outcomes: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, rho`` of every feature; null when a side is constant."""
    return P.with_rho(P.complete_cases(features, outcomes, keys)).select(*keys, "rho")


def replication_summary(rhos: DataFrame, keys: list[str]) -> DataFrame:
    """Sign agreement, correlation and top-five sign agreement of two cohorts' coefficients.

    ``rhos`` holds ``keys, metric, first_rho, second_rho``.
    """
    ok = rhos.filter("first_rho is not null and second_rho is not null")
    pos = cut(ok.withColumn("_m", -F.abs("first_rho")))
    idx = O.position_index(pos, keys, "_m", ["metric"], "_p")
    same = F.signum("first_rho") == F.signum("second_rho")
    s = idx.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(same.cast("int")).alias("sign_agree"),
        F.when(F.count(F.lit(1)) > 3, F.corr("first_rho", "second_rho")).alias("rho_corr"), F.avg(F.when(F.col("_p") < 5, same.cast("int"))).alias("top5_sign"),
    )
    out = rhos.groupBy(*keys).agg(F.count_if(F.col("first_rho").isNull() | F.col("second_rho").isNull()).alias("excluded"))
    return s.join(out, keys)


def calibre_summary(values: DataFrame, outcomes: DataFrame, keys: list[str], group: list[str]) -> DataFrame:
    """Median ICC across calibres and median span of rho, per group of metrics.

    ``values`` holds ``subject, calibre, keys, x``.
    """
    icc = P.icc21(values, keys, "subject", "calibre")
    rho = rank_rhos(values, outcomes, [*keys, "calibre"]).groupBy(*keys).agg((F.max("rho") - F.min("rho")).alias("span"))
    j = cut(icc.join(rho, keys))
    med = O.median(j, group, "icc21", "icc_med").join(O.median(j, group, "span", "span_med"), group)
    return j.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).join(med, group)


# -- mapping between bases ---------------------------------------------------

def parcel_mapping(first: DataFrame, second: DataFrame) -> DataFrame:
    """Cortical nodes of two bases paired by their full name; a name without its one equal partner is refused."""
    bad = mapping_guard(first, second).take(1)
    if bad:
        raise ValueError(f"parcel {bad[0]['name']}: {bad[0].reason}")
    pick = lambda d, o: d.filter("tissue = 'cortex'").select("name", "hemi", "network", F.col("idx").alias(o))
    return pick(first, "first_idx").join(pick(second, "second_idx").select("name", "second_idx"), "name")


def mapping_guard(first: DataFrame, second: DataFrame) -> DataFrame:
    """Names that are missing, repeated, or differ in hemisphere or network."""
    a = first.filter("tissue = 'cortex'").groupBy("name").agg(F.count(F.lit(1)).alias("na"), F.max("hemi").alias("ha"), F.max("network").alias("wa"))
    b = second.filter("tissue = 'cortex'").groupBy("name").agg(F.count(F.lit(1)).alias("nb"), F.max("hemi").alias("hb"), F.max("network").alias("wb"))
    j = a.join(b, "name", "left")
    reason = F.when(F.col("nb").isNull(), "missing").when((F.col("na") > 1) | (F.col("nb") > 1), "repeated").when((F.col("ha") != F.col("hb")) | (F.col("wa") != F.col("wb")), "metadata differs")
    return j.select("name", reason.alias("reason")).filter("reason is not null")


def gradient_correspondence(first: DataFrame, second: DataFrame, first_nodes: DataFrame, second_nodes: DataFrame) -> DataFrame:
    """``axis, signed, r``: correlation of each retained axis of two mean networks over the parcels both have.

    Both are embedded by hemisphere with the primary settings and not rotated.
    """
    long = lambda e, n: E.embed(E.hemisphere_slice(e, n), ["hemi"], E.hemisphere_sizes(n))[0].select("node", F.posexplode(F.slice("g", 1, E.RETAINED)).alias("axis", "value"))
    m = parcel_mapping(first_nodes, second_nodes).select("first_idx", "second_idx")
    a = long(first, first_nodes).withColumnRenamed("node", "first_idx")
    b = long(second, second_nodes).select(F.col("node").alias("second_idx"), "axis", F.col("value").alias("other"))
    r = a.join(m, "first_idx").join(b, ["second_idx", "axis"]).groupBy("axis").agg(F.corr("value", "other").alias("signed"))
    return r.select((F.col("axis") + 1).alias("axis"), "signed", F.abs("signed").alias("r"))


def group_correspondence(first: DataFrame, second: DataFrame, mapping: DataFrame, n: int) -> DataFrame:
    """|r| of node strength and of edges between two mean networks, raw, log and ranked.

    Ranks run over all n*n cells; the zero cells share one rank, so they are
    counted, not stored.
    """
    m = F.broadcast(mapping.select("first_idx", "second_idx"))
    b = second.join(m.select(F.col("second_idx").alias("i"), F.col("first_idx").alias("a")), "i").join(m.select(F.col("second_idx").alias("j"), F.col("first_idx").alias("c")), "j")
    b = b.select(F.least("a", "c").alias("i"), F.greatest("a", "c").alias("j"), "w")
    basis = m.select("first_idx")
    inside = lambda d: d.join(basis.withColumnRenamed("first_idx", "i"), "i").join(basis.withColumnRenamed("first_idx", "j"), "j").select("i", "j", "w")

    def scales(d: DataFrame, tag: str) -> DataFrame:
        # means are sums in varying order: rounded, equal means stay equal and tie in the ranks
        even = d.withColumn("w", F.round("w", 6)).filter("w > 0")
        both = cut(G.adjacency(even, []).withColumn("_k", F.lit(1)))
        r = O.avg_rank(both, ["_k"], "w", "_r", size="_n").withColumn("_z", F.lit(n * n) - F.col("_n"))
        zero = (F.col("_z") + 1) / 2.0
        # shift ranks so a zero cell is 0: correlation does not change and absent cells stay absent
        e = r.select("i", "j", F.explode(F.create_map(F.lit("raw"), F.col("w"), F.lit("log1p"), F.log1p("w"), F.lit("rank"), F.col("_z") + F.col("_r") - zero)).alias("scale", tag))
        return cut(e)

    a, c = scales(inside(first), "x"), scales(b, "y")
    pairs = n * (n - 1) // 2

    def corr(d: DataFrame, count: int, out: str) -> DataFrame:
        """Pearson with ``count`` cells per scale, absent cells zero."""
        s = d.groupBy("scale").agg(*[F.sum(e).alias(k) for k, e in {"sx": F.col("x"), "sy": F.col("y"), "xx": F.col("x") ** 2, "yy": F.col("y") ** 2, "xy": F.col("x") * F.col("y")}.items()])
        cov = F.col("xy") - F.col("sx") * F.col("sy") / count
        return s.select("scale", F.abs(cov / F.sqrt((F.col("xx") - F.col("sx") ** 2 / count) * (F.col("yy") - F.col("sy") ** 2 / count))).alias(out))

    edge = a.filter("i < j").join(c.filter("i < j"), ["scale", "i", "j"], "full").fillna(0.0, ["x", "y"])
    strength = lambda d, t: d.groupBy("scale", "i").agg(F.sum(t).alias(t))
    node = strength(a, "x").join(strength(c, "y"), ["scale", "i"], "full").fillna(0.0, ["x", "y"])
    return corr(node, n, "node").join(corr(edge, pairs, "edge"), "scale")


# -- spatial error and controls ----------------------------------------------

# Edges of the distance bins in millimetres.
PROFILE_BINS = (0, 15, 30, 45, 60, 75, 200)


def distance_error_profile(errors: DataFrame) -> DataFrame:
    """Count and median scaled error per distance bin (``distance, z``)."""
    name = F.coalesce(*[F.when((F.col("distance") >= lo) & (F.col("distance") < hi), F.lit(lo)) for lo, hi in zip(PROFILE_BINS, PROFILE_BINS[1:])])
    b = cut(errors.select(name.alias("bin_from"), "z").filter("bin_from is not null"))
    return b.groupBy("bin_from").agg(F.count(F.lit(1)).alias("n")).join(O.median(b, ["bin_from"], "z", "median_err_sd"), "bin_from")


def zone(distance):
    return F.when(distance < 30, "near").when(distance < 60, "mid").otherwise("far")


def spatial_error_profile(errors: DataFrame) -> DataFrame:
    """Mean over subjects of the median scaled error near, mid and far, and near over far."""
    e = cut(errors.select("subject", zone(F.col("distance")).alias("zone"), "z"))
    m = O.median(e, ["subject", "zone"], "z", "m")
    at = lambda z: F.avg(F.when(F.col("zone") == z, F.col("m")))
    w = m.agg(at("near").alias("near"), at("mid").alias("mid"), at("far").alias("far"))
    return w.withColumn("ratio", F.col("near") / F.greatest("far", F.lit(1e-12)))


def zone_hits(coords: DataFrame, distance: DataFrame) -> DataFrame:
    """``zone, n_parcels, correct``: identification on near, mid and far parcels, zones of two parcels or more."""
    d = cut(distance.select("parcel", zone(F.col("distance")).alias("zone")))
    sizes = d.groupBy("zone").agg(F.count(F.lit(1)).alias("n_parcels")).filter("n_parcels >= 2")
    f = Y.coordinate_features(coords.join(d, "parcel"), keys=("zone",))
    seen = Y.nearest(cut(Y.similarity(f, ["zone"])), ["zone"]).groupBy("zone").agg(F.count_if("hit").alias("correct"))
    return sizes.join(seen, "zone")


def distance_bins_identification(coords: DataFrame, distance: DataFrame, draws: int, seed: int) -> DataFrame:
    """Identification on near, mid and far parcels against random sets of the same size."""
    seen = cut(zone_hits(coords, distance))
    null = Y.random_subset_identification(coords, seen.select("zone", F.col("n_parcels").alias("n")), draws, seed).withColumnRenamed("correct", "random")
    return null.join(seen, "zone").groupBy("zone", "n_parcels").agg(
        F.max("correct").alias("correct"), F.median("random").alias("random_median"),
        F.percentile("random", 0.05).alias("random_q05"), F.percentile("random", 0.95).alias("random_q95"), P.share(F.col("random") >= F.col("correct")).alias("frac_random_ge"),
    )


def noise_outcome_screen(observed: DataFrame, noise: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Observed, same-day and difference displacement against every outcome.

    Both inputs hold ``subject, x``.
    """
    j = observed.join(noise.withColumnRenamed("x", "y0"), "subject")
    f = M.melt(j, ["subject"], {"observed_displacement": F.col("x"), "same_day_displacement": F.col("y0"), "observed_minus_same_day": F.col("x") - F.col("y0")})
    return P.exact_family(f.withColumnRenamed("value", "x"), outcomes, ["metric"])


def noise_ratio(observed: DataFrame, noise: DataFrame) -> DataFrame:
    """Median ratio and correlation of observed and repeat displacement (eight subjects at most)."""
    j = observed.join(noise.withColumnRenamed("x", "y0"), "subject")
    return j.agg(F.median(F.col("x") / F.col("y0")).alias("ratio_median"), F.corr("x", "y0").alias("corr"))


def noise_signflip(observed: DataFrame, noise: DataFrame) -> DataFrame:
    """Exact sign-flip test of observed against same-day displacement of the same subjects."""
    j = observed.join(noise.withColumnRenamed("x", "y0"), "subject")
    return P.paired_signflip(j.select(F.lit(1).alias("_1"), "subject", (F.col("x") - F.col("y0")).alias("d")), ["_1"]).drop("_1")


def simulation_error(void: DataFrame, floor: DataFrame, rim: DataFrame | None = None) -> DataFrame:
    """Median scaled errors and their ratio to the floor; inputs ``subject, parcel, error, z``.

    With ``rim``, the error beyond the mask, also its median and ratio.
    """
    cases = {"void": void, "floor": floor, **({"rim": rim} if rim is not None else {})}
    one = cut(union_all([d.select(F.lit(c).alias("case"), "subject", "error", "z") for c, d in cases.items()]))
    e, z = O.median(one, ["case"], "error", "e"), O.median(one, ["case"], "z", "z")
    at = lambda c, v: F.max(F.when(F.col("case") == v, F.col(c)))
    ratio = lambda c: at("e", c) / at("e", "floor")
    out = [at("z", "void").alias("void_median_sd"), at("z", "floor").alias("floor_median_sd"), ratio("void").alias("ratio")]
    if rim is not None:
        out += [at("z", "rim").alias("rim_median_sd"), ratio("rim").alias("rim_ratio")]
    return e.join(z, "case").agg(*out)


def simulation_ratio_per_subject(void: DataFrame, floor: DataFrame) -> DataFrame:
    a, b = O.median(cut(void), ["subject"], "error", "a"), O.median(cut(floor), ["subject"], "error", "b")
    return a.join(b, "subject").select("subject", (F.col("a") / F.col("b")).alias("ratio"))


def false_displacement(simulated: DataFrame, observed: DataFrame) -> DataFrame:
    """``label, mean, over_observed_sd, over_observed_mean``: displacement that a simulation shows without any change.

    ``simulated`` has ``label, subject, x``, ``observed`` ``subject, x``.
    """
    seen = observed.agg(F.avg("x").alias("_mean"), F.stddev_samp("x").alias("_sd"))
    m = simulated.groupBy("label").agg(F.avg("x").alias("mean"))
    return m.join(F.broadcast(seen)).select("label", "mean", (F.col("mean") / F.col("_sd")).alias("over_observed_sd"), (F.col("mean") / F.col("_mean")).alias("over_observed_mean"))  # one row


def axis_vs_external_map(axis: DataFrame, external: DataFrame) -> DataFrame:
    """|r|, |rho|, display sign and network-rank rho on shared parcels.

    Inputs are ``parcel, network, x`` and ``parcel, y``.
    """
    j = cut(axis.join(external, "parcel").withColumn("_k", F.lit(1)))
    r = j.groupBy("_k").agg(F.corr("x", "y").alias("r"), F.count(F.lit(1)).alias("n"))
    rho = studies.rank_correlation(j, ["_k"], "x", "y", "rho")
    net = cut(j.groupBy("_k", "network").agg(F.avg("x").alias("x"), F.avg("y").alias("y")))
    nr = studies.rank_correlation(net, ["_k"], "x", "y", "network_rho")
    sign = F.when(F.col("r") < 0, -1).otherwise(1)
    return r.join(rho, "_k").join(nr, "_k").select(
        F.abs("r").alias("r"), F.abs("rho").alias("rho"), (sign * F.col("network_rho")).alias("network_rho"), sign.alias("display_sign"), F.col("n").alias("n_compared")
    )


# -- studies that embed ------------------------------------------------------

def embedding_identification(edges: DataFrame, nodes: DataFrame, subjects: DataFrame, mode: str) -> DataFrame:
    """Nearest sessions of the aligned cohort embedding."""
    g, _ = E.cohort_embeddings(edges, nodes, subjects, mode)
    return Y.nearest(cut(Y.similarity(Y.coordinate_features(E.as_coords(g, nodes)))))


def loso_gallery(edges: DataFrame, nodes: DataFrame, subjects: DataFrame) -> DataFrame:
    """For each held-out subject, all sessions under its reference; its three queries only."""
    sizes = cut(E.hemisphere_sizes(nodes))
    cort = cut(E.hemisphere_slice(edges, nodes))
    hemi = F.broadcast(nodes.select(F.col("idx").alias("i"), "hemi"))
    ref, _ = E.embed(E.loso_mean(cort.filter("visit = 0"), subjects).join(hemi, "i"), ["held", "hemi"], sizes)
    g, _ = E.embed(cort, ["subject", "visit", "hemi"], sizes)
    each = g.join(ref.select("held", "hemi").distinct(), "hemi")
    al = E.procrustes(each, ref, ["held", "subject", "visit", "hemi"], ["held", "hemi"], E.COMPONENTS)
    f = al.select("held", "subject", "visit", F.col("node"), F.posexplode(F.slice("g", 1, E.RETAINED)).alias("a", "x")).select(
        "held", "subject", "visit", F.concat_ws(":", "node", "a").alias("feature"), "x")
    near = Y.nearest(cut(Y.similarity(cut(f), ["held"])), ["held"])
    return near.filter("held = subject")


def reference_transfer(edges: DataFrame, nodes: DataFrame, own: DataFrame, foreign: DataFrame) -> DataFrame:
    """Cross-visit identification of one cohort under its own and a foreign reference network."""
    sizes = E.hemisphere_sizes(nodes)
    cort = E.hemisphere_slice(edges, nodes)
    refs = E.hemisphere_slice(own.withColumn("reference", F.lit("own")).unionByName(foreign.withColumn("reference", F.lit("external"))), nodes)
    ref, _ = E.embed(refs, ["reference", "hemi"], sizes)
    g, _ = E.embed(cort, ["subject", "visit", "hemi"], sizes)
    each = g.join(ref.select("reference", "hemi").distinct(), "hemi")
    al = E.procrustes(each, ref, ["reference", "subject", "visit", "hemi"], ["reference", "hemi"], E.COMPONENTS)
    f = cut(al.select("reference", "subject", "visit", F.col("node"), F.posexplode(F.slice("g", 1, E.RETAINED)).alias("a", "x")).select(
        "reference", "subject", "visit", F.concat_ws(":", "node", "a").alias("feature"), "x"))
    return Y.cross_visit_identification(Y.standardise(f, ["reference"]), ["reference"])


def matched_settings(embedded: DataFrame, primary: DataFrame) -> DataFrame:
    """``setting, target, source, r``: the axis of each setting that matches each primary axis."""
    long = embedded.select("setting", "subject", "visit", F.col("node").alias("parcel"), F.posexplode("g").alias("axis", "value"))
    own = long.filter(F.col("axis") < E._by_setting(list(E.SETTINGS), 3, "int"))
    return cut(E.match_axes(cut(E.axis_correlations(own, primary, ["subject", "visit", "parcel"], ["setting"])), E.COMPONENTS, ["setting"]))


def settings_table(spark, matched: DataFrame) -> DataFrame:
    """One row a setting: its parameters and, for each primary axis, the matched source and its correlation."""
    of = lambda c, t: F.max(F.when(F.col("target") == t, F.col(c)))
    cells = [x for t in range(4) for x in (
        (of("source", t) + 1).alias(f"matched_G{t + 1}_source_index"), of("r", t).alias(f"matched_G{t + 1}_signed_correlation"), F.abs(of("r", t)).alias(f"matched_G{t + 1}_abs_correlation"),
    )]
    return E.setting_grid(spark).join(matched.groupBy("setting").agg(*cells), "setting")


def sensitivity_values(edges: DataFrame, nodes: DataFrame, subjects: DataFrame, primary: DataFrame, settings: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Candidate measures of every setting, and which axes they were read from.

    All settings run in one plan with the setting as a key.  ``primary`` is ``subject,
    visit, parcel, axis, value``.  Axis signs are never flipped.
    """
    g, _ = E.cohort_embeddings(edges, nodes, subjects, "loso", settings or list(E.SETTINGS), retain=E.COMPONENTS)
    matched = matched_settings(g, primary)
    pick = matched.groupBy("setting").agg(*[F.max(F.when(F.col("target") == t, F.col("source"))).alias(f"_s{t}") for t in (0, 1)])
    whole = checked(F.col("_s0"), F.col("_s0").isNotNull() & F.col("_s1").isNotNull(), "a setting has no match for the first two axes")
    n = nodes.select(F.col("idx").alias("node"), "network")
    c = g.join(n, "node").join(pick, "setting").select(
        "setting", "subject", "visit", F.col("node").alias("parcel"), "hemi", "network", *[F.get("g", F.lit(i)).alias(a) for i, a in enumerate(AXES)],
        F.get("g", whole).alias("m0"), F.get("g", F.col("_s1")).alias("m1"),
    )
    return cut(candidate_long(cut(c), ["setting"])), matched


def sensitivity_study(edges: DataFrame, nodes: DataFrame, subjects: DataFrame, outcomes: DataFrame, primary: DataFrame, settings: list[str] | None = None) -> DataFrame:
    """Each named setting: embed, match axes to the primary, four candidates, exact family."""
    values, _ = sensitivity_values(edges, nodes, subjects, primary, settings)
    return P.exact_family(values, outcomes, ["setting", "metric"], ["endpoint", "setting"])


def candidate_long(c: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Candidate measures, with ``m0``/``m1`` as the matched first and second axis."""
    sub = [*(keys or []), "subject"]
    s = [*sub, "visit"]
    mid = c.groupBy(*s, "hemi").agg(F.avg("m1").alias("h_m1"))
    own = c.groupBy(*s, "hemi", "network").agg(F.avg("m0").alias("c_m0"))
    d = M.with_centres(c.filter("visit in (1, 2)"), s).join(mid, [*s, "hemi"]).join(own, [*s, "hemi", "network"])
    long = cut(d.filter("network in ('SomMot', 'Cont')").select(*s, "network", F.when(F.col("network") == "SomMot", M.gap("", "h_")).otherwise(F.col("m1") - F.col("h_m1")).alias("v")))
    med = O.median(long, [*s, "network"], "v", "v").groupBy(*s).pivot("network", ["SomMot", "Cont"]).agg(F.first("v"))
    sd = d.filter("network = 'Vis'").groupBy(*s).agg(F.sqrt(F.sum((F.col("m0") - F.col("c_m0")) ** 2) / (F.count(F.lit(1)) - 2)).alias("sd"))
    ch = studies.visit_change(med.join(sd, s), sub, ["SomMot", "Cont", "sd"])
    vis = M.displacement(M.pair_visits(c, sub, 1, 2)).filter("network = 'Vis'").groupBy(*sub).agg(F.avg("displacement").alias("move"))
    return M.melt(ch.join(vis, sub), sub, {
        "Vis_parcel_displacement_mean": F.col("move"), "SomMot_eccentricity_median": F.col("SomMot"), "Cont_G2_position_median": F.col("Cont"), "Vis_G1_dispersion_sd": F.col("sd"),
    }).withColumnRenamed("value", "x")


def graph_cases(measures: DataFrame, outcomes: DataFrame) -> DataFrame:
    """``endpoint, metric, subject, x, reason``: each change beside each outcome, judged per outcome.

    A metric counts for an outcome if its change is finite and not constant over the
    subjects that have this outcome; an outcome counts with three values that differ.
    """
    y = outcomes.filter(finite(F.col("y")))
    known = outcomes.select("endpoint").distinct().join(y.groupBy("endpoint").agg(F.count(F.lit(1)).alias("n"), (F.max("y") - F.min("y")).alias("span")), "endpoint", "left")
    d = measures.groupBy("subject", "metric").agg(*[F.max(F.when(F.col("visit") == v, F.round("value", 12))).alias(f"v{v}") for v in (1, 2)]) if "visit" in measures.columns else measures.select("subject", "metric", F.round("value", 12).alias("v2"), F.lit(0.0).alias("v1"))
    x = F.round(F.col("v2") - F.col("v1"), 12)
    rows = d.select("subject", "metric", F.when(finite(x), x).alias("x")).join(y.select("endpoint", "subject"), "subject")
    by = rows.groupBy("endpoint", "metric").agg(F.count(F.lit(1)).alias("c"), F.count("x").alias("f"), (F.max("x") - F.min("x")).alias("s"))
    enough = known.select("endpoint", ((F.coalesce("n", F.lit(0)) >= 3) & (F.coalesce("span", F.lit(0.0)) > 0)).alias("enough"), F.coalesce("n", F.lit(0)).alias("n"))
    why = F.when(~F.col("enough"), "insufficient or constant outcome").when((F.col("f") < F.col("n")) | ~(F.col("s") > 0), "undefined or constant graph change")
    judged = by.join(enough, "endpoint").select("endpoint", "metric", why.alias("reason"))
    return rows.join(judged, ["endpoint", "metric"])


def graph_screen(measures: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Exact family of each measure's change from visit 1 to 2, complete per outcome."""
    usable = graph_cases(measures, outcomes).filter("reason IS NULL").select("endpoint", "subject", "metric", "x")
    return screens.clinical_screen(cut(usable), outcomes, ["metric"])


def graph_exclusions(measures: DataFrame, outcomes: DataFrame) -> DataFrame:
    """``endpoint, metric, reason`` of what :func:`graph_screen` leaves out; one row without metric for a whole outcome."""
    out = graph_cases(measures, outcomes).filter("reason IS NOT NULL")
    whole = F.col("reason") == "insufficient or constant outcome"
    some = out.select("endpoint", F.when(~whole, F.col("metric")).alias("metric"), "reason").distinct()
    y = outcomes.groupBy("endpoint").agg(F.count_if(finite(F.col("y"))).alias("n")).filter("n = 0")
    return some.unionByName(y.select("endpoint", F.lit(None).cast("string").alias("metric"), F.lit("insufficient or constant outcome").alias("reason")))


#: The measures by whose density means sessions are identified.
IDENTIFYING = ("binary_global_efficiency", "binary_characteristic_path_lcc", "binary_transitivity", "binary_assortativity")


def graph_identification(measures: DataFrame) -> DataFrame:
    """Nearest sessions by the four identifying measures, standardised over sessions."""
    f = measures.filter(F.col("metric").isin(*[m + "_cost_mean" for m in IDENTIFYING])).select("subject", "visit", F.col("metric").alias("feature"), F.col("value").alias("x"))
    return Y.nearest(cut(Y.similarity(Y.standardise(cut(f)))))


def edge_identification(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nearest sessions by the weights of all pairs of the basis; an absent pair counts as zero."""
    f = edges.select("subject", "visit", F.concat_ws("-", "i", "j").alias("feature"), F.col("w").alias("x"))
    n = nodes.agg((F.count(F.lit(1)) * (F.count(F.lit(1)) - 1) / 2).alias("features"))
    return Y.nearest(cut(Y.similarity(f, features_in_all=n)))


def graph_measures(edges: DataFrame, nodes: DataFrame, n: int, extended: bool = True, modularity: bool = True) -> DataFrame:
    return cut(session_measures(edges, nodes, n, ["subject", "visit"], extended=extended, modularity=modularity))


def graph_study(edges: DataFrame, nodes: DataFrame, outcomes: DataFrame, n: int, extended: bool = True, modularity: bool = True) -> DataFrame:
    """All session measures, their change, and the exact screen per outcome."""
    return graph_screen(graph_measures(edges, nodes, n, extended, modularity), outcomes)


def preoperative_graph(edges: DataFrame, nodes: DataFrame, outcomes: DataFrame, n: int, extended: bool = True, modularity: bool = True) -> DataFrame:
    """First-visit cortical graphs, density means only, against every outcome."""
    cort = E.cortical_order(nodes).select("idx", F.col("position").alias("p"))
    m = F.broadcast(cort)
    e = edges.join(m.select(F.col("idx").alias("i"), F.col("p").alias("a")), "i").join(m.select(F.col("idx").alias("j"), F.col("p").alias("b")), "j")
    e = cut(e.select("subject", F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j"), "w"))
    basis = cort.select(F.col("p").alias("idx"))
    x = cut(session_measures(e, basis, n, ["subject"], extended=extended, modularity=modularity).filter(F.col("metric").endswith("_cost_mean")))
    return graph_screen(x, outcomes)
