"""Geometry of embedded parcels: long coordinates ``keys, parcel, hemi, network, g1..g4``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import order as O
from ..functions.expr import AXES, norm, sum_expr
from ..session import cut


def centre(df: DataFrame, by: list[str], prefix: str) -> DataFrame:
    return df.groupBy(*by).agg(*[F.avg(a).alias(prefix + a) for a in AXES])


def gap(a: str, b: str) -> Column:
    """Euclidean distance between two sets of axis columns given by prefix."""
    return norm([F.col(a + x) - F.col(b + x) for x in AXES])


def melt(df: DataFrame, by: list[str], cols: dict[str, Column]) -> DataFrame:
    """``by, metric, value`` from named expressions, one row per expression."""
    return df.select(*by, F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), v.cast("double").alias("value")) for k, v in cols.items()])).alias("_e")).select(
        *by, "_e.metric", "_e.value"
    )


def with_centres(coords: DataFrame, session: list[str]) -> DataFrame:
    hemi = centre(coords, [*session, "hemi"], "h_")
    net = centre(coords, [*session, "hemi", "network"], "c_")
    return coords.join(hemi, [*session, "hemi"]).join(net, [*session, "hemi", "network"])


def session_metrics(coords: DataFrame, session: list[str]) -> DataFrame:
    """20 measures per network, hemispheres pooled after their own centring."""
    d = with_centres(coords, session)
    by = [*session, "network"]
    rows = {"eccentricity": gap("", "h_"), "dispersion_4d": gap("", "c_")}
    for i, a in enumerate(AXES, 1):
        rows[f"G{i}_position"] = F.col(a) - F.col("h_" + a)
        rows[f"G{i}_residual"] = F.col(a) - F.col("c_" + a)
    long = cut(melt(d, by, rows))
    residual = F.col("metric").endswith("_residual")
    means = long.filter(~residual).groupBy(*by, F.concat("metric", F.lit("_mean")).alias("metric")).agg(F.avg("value").alias("value"))
    spread = long.filter(residual).groupBy(*by, F.regexp_replace("metric", "residual", "dispersion_sd").alias("metric")).agg(
        F.sqrt(F.sum(F.col("value") ** 2) / (F.count(F.lit(1)) - 2)).alias("value")
    )
    name = F.when(residual, F.regexp_replace("metric", "residual", "dispersion_mad")).otherwise(F.concat("metric", F.lit("_median")))
    middle = O.median(
        long.select(*by, name.alias("metric"), F.when(residual, F.abs("value")).otherwise(F.col("value")).alias("value")),
        [*by, "metric"], "value", "value",
    )
    return means.unionByName(spread).unionByName(middle)


def guard_networks(coords: DataFrame, session: list[str]) -> DataFrame:
    """Network-hemispheres with fewer than two parcels."""
    return coords.groupBy(*session, "network", "hemi").agg(F.count(F.lit(1)).alias("parcels")).filter("parcels < 2")


def pair_visits(coords: DataFrame, subject: str | list[str], first: int, second: int) -> DataFrame:
    own, keep = [subject] if isinstance(subject, str) else subject, ["parcel", "hemi", "network"]
    a = coords.filter(F.col("visit") == first).select(*own, *keep, *[F.col(x).alias("a_" + x) for x in AXES])
    b = coords.filter(F.col("visit") == second).select(*own, "parcel", *[F.col(x).alias("b_" + x) for x in AXES])
    return a.join(b, [*own, "parcel"])


def displacement(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("displacement", gap("b_", "a_"))


def centroid_shifts(coords: DataFrame, by: list[str], first: int, second: int) -> DataFrame:
    c = centre(coords.filter(F.col("visit").isin(first, second)), [*by, "visit"], "m_")
    pick = lambda v, p: c.filter(F.col("visit") == v).select(*by, *[F.col("m_" + a).alias(p + a) for a in AXES])
    return pick(first, "a_").join(pick(second, "b_"), by).select(*by, gap("b_", "a_").alias("shift"))


def interval_metrics(coords: DataFrame, first: int = 1, second: int = 2, geomedian: bool = True) -> DataFrame:
    """Change between two visits per subject and network."""
    by = ["subject", "network"]
    moved = cut(displacement(pair_visits(coords, "subject", first, second)))
    mean = melt(moved.groupBy(*by).agg(F.avg("displacement").alias("v")), by, {"parcel_displacement_mean": F.col("v")})
    med = melt(O.median(moved, by, "displacement", "v"), by, {"parcel_displacement_median": F.col("v")})
    s = centroid_shifts(coords, ["subject", "network", "hemi"], first, second).groupBy(*by).agg(
        F.avg("shift").alias("m"), F.sqrt(F.avg(F.col("shift") ** 2)).alias("q")
    )
    out = mean.unionByName(med).unionByName(
        melt(s, by, {"centroid_shift_mean_hemispheres": F.col("m"), "centroid_shift_rms_hemispheres": F.col("q")})
    )
    if geomedian:
        g = geometric_median(coords.filter(F.col("visit").isin(first, second)), ["subject", "network", "hemi", "visit"])
        pick = lambda v, p: g.filter(F.col("visit") == v).select("subject", "network", "hemi", *[F.col("m_" + a).alias(p + a) for a in AXES])
        j = pick(first, "a_").join(pick(second, "b_"), ["subject", "network", "hemi"]).groupBy(*by).agg(F.avg(gap("b_", "a_")).alias("v"))
        out = out.unionByName(melt(j, by, {"geomedian_shift_mean_hemispheres": F.col("v")}))
    return out


def geometric_median(points: DataFrame, by: list[str], tol: float = 1e-10, max_rounds: int = 1000) -> DataFrame:
    """``by, m_g1..m_g4``: point of least summed distance per group.

    All groups advance together.  A round sums, per group, the gradient and the
    Hessian of the distance sum (14 numbers), proposes the Newton and the
    reweighted-mean step from them, and keeps whichever lowers the sum.  A centre
    that meets a data point stops there, as the classic scheme does.  A group that
    does not settle is refused.
    """
    pts = cut(points.select(*by, *AXES))
    p = lambda pre: [pre + a for a in AXES]
    cur = cut(centre(pts, by, "m_").withColumn("done", F.lit(False)))
    names = [*p("m_"), *p("n_"), *p("w_"), *p("z_")]
    ddl = ", ".join(f"{c} {pts.schema[c].dataType.simpleString()}" for c in by)
    ddl += ", landed boolean, " + ", ".join(f"{c} double" for c in names)

    def propose(batches):
        import numpy as np

        for pdf in batches:
            h = np.empty((len(pdf), 4, 4))
            k = 0
            for i in range(4):
                for j in range(i, 4):
                    h[:, i, j] = h[:, j, i] = pdf[f"h{k}"].to_numpy(float)
                    k += 1
            grad = pdf[[f"d_{a}" for a in AXES]].to_numpy(float)
            step = np.zeros_like(grad)
            landed = pdf["landed"].to_numpy(bool)
            ok = np.isfinite(h).all((1, 2)) & ~landed
            ok[ok] = np.abs(np.linalg.det(h[ok])) > 1e-300
            if ok.any():
                step[ok] = np.linalg.solve(h[ok], grad[ok][:, :, None])[:, :, 0]
            for i, a in enumerate(AXES):
                pdf["n_" + a] = np.where(landed, pdf["z_" + a], pdf["m_" + a] - step[:, i])
                pdf["w_" + a] = np.where(landed, pdf["z_" + a], pdf["w_" + a])
            yield pdf[[*by, "landed", *names]]

    for _ in range(max_rounds):
        live = cur.filter("not done").drop("done")
        j = pts.join(live, by).withColumn("r", gap("", "m_"))
        u = lambda a: (F.col("m_" + a) - F.col(a)) / F.col("r")
        away = F.col("r") >= tol
        aggs = [F.min(F.struct("r", *AXES)).alias("near")]
        k = 0
        for x in range(4):
            a = AXES[x]
            aggs.append(F.sum(F.when(away, u(a))).alias("d_" + a))
            aggs.append((F.sum(F.when(away, F.col(a) / F.col("r"))) / F.sum(F.when(away, 1 / F.col("r")))).alias("w_" + a))
            for y in range(x, 4):
                b = AXES[y]
                aggs.append(F.sum(F.when(away, ((1.0 if x == y else 0.0) - u(a) * u(b)) / F.col("r"))).alias(f"h{k}"))
                k += 1
        s = j.groupBy(*by, *p("m_")).agg(*aggs)
        s = s.select("*", (F.col("near.r") < tol).alias("landed"), *[F.col("near." + a).alias("z_" + a) for a in AXES]).drop("near")
        cand = s.mapInPandas(propose, ddl)
        # the nearest data point is the answer when the other points pull on it with force at most one
        z = gap("", "z_")
        pull = [F.sum(F.when(z > 0, (F.col("z_" + a) - F.col(a)) / z).otherwise(0.0)).alias("p_" + a) for a in AXES]
        f = pts.join(cand, by).groupBy(*by, "landed", *names).agg(
            *[F.sum(gap("", q)).alias("f_" + q) for q in ("n_", "w_")], *pull, F.count_if(z == 0).alias("here")
        )
        held = F.col("landed") | (norm([F.col("p_" + a) for a in AXES]) <= F.col("here"))
        newton = F.col("f_n_") <= F.col("f_w_") * (1 + 1e-9)
        nxt = {a: F.when(held, F.col("z_" + a)).when(newton, F.col("n_" + a)).otherwise(F.col("w_" + a)) for a in AXES}
        moved = f.select(*by, *[nxt[a].alias("m_" + a) for a in AXES],
                         (held | (norm([nxt[a] - F.col("m_" + a) for a in AXES]) < tol)).alias("done"))
        cur = cut(cur.filter("done").unionByName(moved))
        if cur.filter("not done").limit(1).count() == 0:
            return cur.drop("done")
    raise ValueError(f"a geometric median has not settled in {max_rounds} rounds")


def reference_eccentricity(coords: DataFrame, reference: DataFrame, by: list[str]) -> DataFrame:
    """Distance to an explicit centroid ``by, h_g1..h_g4``."""
    return coords.join(reference, by).withColumn("eccentricity", gap("", "h_"))


def axis_range(coords: DataFrame, by: list[str]) -> DataFrame:
    return coords.groupBy(*by).agg(*[(F.max(a) - F.min(a)).alias(f"range_{a}") for a in AXES])


def paired_change(coords: DataFrame, reference: DataFrame, first: int, second: int) -> DataFrame:
    """Per parcel: move, change of reference eccentricity, signed axis deltas."""
    p = pair_visits(coords, "subject", first, second).join(reference, ["hemi"])
    return p.select(
        "subject", "parcel", "hemi", "network", gap("b_", "a_").alias("displacement"),
        (gap("b_", "h_") - gap("a_", "h_")).alias("eccentricity_change"),
        *[(F.col("b_" + a) - F.col("a_" + a)).alias("delta_" + a) for a in AXES],
    )


def study_deltas(session: DataFrame, interval: DataFrame) -> DataFrame:
    """``subject, network, metric, post1, post2, delta``; interval rows carry only delta."""
    k = ["subject", "network", "metric"]
    s = session.filter("visit in (1, 2)").groupBy(*k).agg(
        F.max(F.when(F.col("visit") == 1, F.col("value"))).alias("post1"), F.max(F.when(F.col("visit") == 2, F.col("value"))).alias("post2")
    )
    null = F.lit(None).cast("double")
    return s.withColumn("delta", F.col("post2") - F.col("post1")).unionByName(
        interval.select(*k, null.alias("post1"), null.alias("post2"), F.col("value").alias("delta"))
    )


# -- one hemisphere at a time ------------------------------------------------

# How each lateral definition is named.
DEFINITIONS = ("left_only", "right_only", "hemisphere_parcel_weighted", "hemisphere_equal_weighted", "historical_bilateral_pooled")


def hemisphere_metrics(coords: DataFrame, session: list[str], pooled: bool = False, geomedian: bool = True) -> DataFrame:
    """21 measures per network and side; ``pooled`` is the historical variant."""
    side = [] if pooled else ["hemi"]
    by = [*session, *side, "network"]
    origin = centre(coords, [*session, *side], "h_")
    own = centre(coords, by, "c_")
    d = cut(coords.join(origin, [*session, *side]).join(own, by))
    rows = {"eccentricity": gap("", "h_"), "dispersion_4d": gap("", "c_")}
    for i, a in enumerate(AXES, 1):
        rows[f"G{i}_position"] = F.col(a) if pooled else F.col(a) - F.col("h_" + a)
    long = melt(d, by, rows)
    means = long.groupBy(*by, F.concat("metric", F.lit("_mean")).alias("metric")).agg(F.avg("value").alias("value"))
    middle = O.median(long.filter("metric <> 'dispersion_4d'"), [*by, "metric"], "value", "value").withColumn(
        "metric", F.concat("metric", F.lit("_median"))
    )
    one = d.groupBy(*by).agg(
        norm([F.first("c_" + a) - F.first("h_" + a) for a in AXES]).alias("cd"), *[F.stddev_samp(a).alias("sd_" + a) for a in AXES]
    )
    plain = melt(one, by, {"centroid_eccentricity": F.col("cd"), **{f"G{i}_dispersion_sd": F.col("sd_" + a) for i, a in enumerate(AXES, 1)}})
    if pooled:
        mid = O.median(melt(d, by, {a: F.col(a) for a in AXES}), [*by, "metric"], "value", "mid")
        dev = melt(d, by, {a: F.col(a) for a in AXES}).join(mid, [*by, "metric"]).select(*by, "metric", F.abs(F.col("value") - F.col("mid")).alias("value"))
    else:
        dev = melt(d, by, {a: F.abs(F.col(a) - F.col("c_" + a)) for a in AXES})
    mad = O.median(dev, [*by, "metric"], "value", "value").withColumn("metric", F.concat(F.upper("metric"), F.lit("_dispersion_mad")))
    out = means.unionByName(middle).unionByName(plain).unionByName(mad)
    if geomedian:
        g = geometric_median(coords, by)
        gm = O.median(coords.join(g, by).withColumn("r", gap("", "m_")), by, "r", "value").withColumn("metric", F.lit("dispersion_4d_geomedian"))
        out = out.unionByName(gm.select(*out.columns))
    return out


def hemisphere_interval(coords: DataFrame, pooled: bool = False, geomedian: bool = True, first: int = 1, second: int = 2) -> DataFrame:
    side = [] if pooled else ["hemi"]
    by = ["subject", *side, "network"]
    moved = cut(displacement(pair_visits(coords, "subject", first, second)))
    out = melt(moved.groupBy(*by).agg(F.avg("displacement").alias("v")), by, {"parcel_displacement_mean": F.col("v")})
    out = out.unionByName(melt(O.median(moved, by, "displacement", "v"), by, {"parcel_displacement_median": F.col("v")}))
    out = out.unionByName(melt(centroid_shifts(coords, by, first, second), by, {"centroid_shift": F.col("shift")}))
    if geomedian:
        g = geometric_median(coords.filter(F.col("visit").isin(first, second)), [*by, "visit"])
        pick = lambda v, p: g.filter(F.col("visit") == v).select(*by, *[F.col("m_" + a).alias(p + a) for a in AXES])
        out = out.unionByName(melt(pick(first, "a_").join(pick(second, "b_"), by), by, {"geomedian_shift": gap("b_", "a_")}))
    return out


def safety_class(definition: Column, metric: Column) -> Column:
    # The class labels.
    pooled = F.when(metric.startswith("parcel_displacement_"), "interpretable_parcelwise_rotation_invariant").otherwise(
        "not_interpretable_independent_coordinate_pooling"
    )
    return (
        F.when(definition == DEFINITIONS[4], pooled)
        .when(metric.contains("_position_"), "signed_axis_reference_dependent")
        .when(metric.contains("_dispersion_s") | metric.contains("_dispersion_mad"), "axis_identity_dependent")
        .otherwise("interpretable_rotation_invariant_within_hemisphere")
    )


def lateral_values(coords: DataFrame, geomedian: bool = True) -> DataFrame:
    """Five definitions of every measure: one side, two weightings, pooled."""
    null = F.lit(None).cast("double")
    k = ["subject", "network", "metric"]

    def deltas(session: DataFrame, interval: DataFrame, extra: list[str]) -> DataFrame:
        kk = [*k, *extra]
        s = session.groupBy(*kk).agg(
            F.max(F.when(F.col("visit") == 1, F.col("value"))).alias("post1"), F.max(F.when(F.col("visit") == 2, F.col("value"))).alias("post2")
        ).withColumn("delta", F.col("post2") - F.col("post1"))
        return s.unionByName(interval.select(*kk, null.alias("post1"), null.alias("post2"), F.col("value").alias("delta")))

    late = coords.filter("visit in (1, 2)")
    side = cut(deltas(hemisphere_metrics(late, ["subject", "visit"], False, geomedian), hemisphere_interval(coords, False, geomedian), ["hemi"]))
    vals = ["post1", "post2", "delta"]
    one = side.withColumn("definition", F.when(F.col("hemi") == "L", DEFINITIONS[0]).otherwise(DEFINITIONS[1])).drop("hemi")
    share = late.filter("visit = 1").groupBy("subject", "network").agg((F.count_if(F.col("hemi") == "L") / F.count(F.lit(1))).alias("wl"))
    lr = side.filter("hemi = 'L'").select(*k, *[F.col(v).alias("l_" + v) for v in vals]).join(
        side.filter("hemi = 'R'").select(*k, *[F.col(v).alias("r_" + v) for v in vals]), k
    ).join(share, ["subject", "network"])
    mix = lambda w, name: lr.select(*k, *[(w * F.col("l_" + v) + (1 - w) * F.col("r_" + v)).alias(v) for v in vals], F.lit(name).alias("definition"))
    pooled = deltas(hemisphere_metrics(late, ["subject", "visit"], True, geomedian), hemisphere_interval(coords, True, geomedian), []).withColumn(
        "definition", F.lit(DEFINITIONS[4])
    )
    out = one
    for part in (mix(F.col("wl"), DEFINITIONS[2]), mix(F.lit(0.5), DEFINITIONS[3]), pooled):
        out = out.unionByName(part)
    return out.withColumn("safety_class", safety_class(F.col("definition"), F.col("metric")))


# -- pooled inventories ------------------------------------------------------

def pooled_frame(coords: DataFrame, session: list[str], sides: DataFrame | None = None) -> DataFrame:
    """Coordinates with distance to the pooled session centre and contra/ipsi side."""
    d = coords.join(centre(coords, session, "h_"), session).withColumn("ecc", gap("", "h_"))
    if sides is not None:
        d = d.join(F.broadcast(sides), "subject").withColumn("side", F.when(F.col("hemi") != F.col("contra"), "ipsi").otherwise("contra"))
    return d


def region_rows(d: DataFrame, regions: dict[str, Column]) -> DataFrame:
    """One row per parcel and region it belongs to."""
    tags = F.array(*[F.when(cond, F.lit(name)) for name, cond in regions.items()])
    return d.withColumn("region", F.explode(F.array_compact(tags)))


def lateral_regions(networks: tuple[str, ...]) -> tuple[dict[str, Column], dict[str, Column]]:
    net, side = F.col("network"), F.col("side")
    # The motor-related network groups.
    motor3, motor2 = ("SomMot", "DorsAttn", "Cont"), ("SomMot", "DorsAttn")
    both: dict[str, Column] = {}
    for n in networks:
        for s in ("contra", "ipsi"):
            both[f"{n}_{s}"] = (net == n) & (side == s)
    both["motor3"] = net.isin(*motor3)
    ecc = dict(both)
    for s in ("contra", "ipsi"):
        ecc[f"cortex_{s}"] = side == s
        ecc[f"motor3_{s}"] = net.isin(*motor3) & (side == s)
    ecc["motor2"] = net.isin(*motor2)
    return ecc, both


def region_spread(d: DataFrame, session: list[str], regions: dict[str, Column], suffix: str = "_disp") -> DataFrame:
    r = region_rows(d, regions).select(*session, "region", *AXES)
    c = centre(r, [*session, "region"], "c_")
    return r.join(c, [*session, "region"]).groupBy(*session, F.concat("region", F.lit(suffix)).alias("metric")).agg(F.avg(gap("", "c_")).alias("value"))


def network_distances(coords: DataFrame, session: list[str], use_median: bool) -> DataFrame:
    """Distance between every two network centres (at most 21 pairs per session)."""
    by = [*session, "network"]
    long = melt(coords, by, {a: F.col(a) for a in AXES})
    if use_median:
        c = O.median(long, [*by, "metric"], "value", "value")
    else:
        c = long.groupBy(*by, "metric").agg(F.avg("value").alias("value"))
    c = cut(c)
    a = c.select(*session, "metric", F.col("network").alias("na"), F.col("value").alias("va"))
    b = c.select(*session, "metric", F.col("network").alias("nb"), F.col("value").alias("vb"))
    j = a.join(b, [*session, "metric"]).filter("na <> nb")
    return j.groupBy(*session, "na", "nb").agg(F.sqrt(F.sum((F.col("va") - F.col("vb")) ** 2)).alias("value"))


def named_pairs(dist: DataFrame, session: list[str], networks: tuple[str, ...]) -> DataFrame:
    names = F.array(*[F.lit(n) for n in networks])
    return dist.filter(F.array_position(names, F.col("na")) < F.array_position(names, F.col("nb"))).select(
        *session, F.concat_ws("_", "na", "nb", F.lit("distance")).alias("metric"), "value"
    )


def kendall_tau(pairs: DataFrame, keys: list[str], x: str, y: str, block: int = 65536) -> DataFrame:
    """tau-b without enumerating pairs: O(n log n) rows per group.

    Ranks of y are compared bit by bit.  Two rows first differ at one bit level;
    there, running counts along x tell how many such pairs agree.  Counts run per
    block of x ranks with block offsets, so no group needs a single task.
    """
    px, py = O.value_positions(pairs, keys, x), O.value_positions(pairs, keys, y)
    rank = pairs.join(px.select(*keys, x, F.col("before").alias("rx")), [*keys, x]).join(
        py.select(*keys, y, F.col("before").alias("ry")), [*keys, y]
    ).select(*keys, "rx", "ry")
    top = px.groupBy(*keys).agg(F.max("n").alias("n"))
    bits = F.expr("filter(sequence(0, 40), b -> shiftleft(cast(1 as bigint), b) < n)")
    level = rank.join(top, keys).select(*keys, "rx", "ry", F.explode(bits).alias("b"))
    cell = [*keys, "b", "pre"]
    one = level.select(
        *keys, "b", F.expr("shiftright(ry, b + 1)").alias("pre"), "rx", F.expr("shiftright(ry, b) & 1").alias("bit"),
        F.floor(F.col("rx") / block).alias("blk"),
    )
    c = cut(one.groupBy(*cell, "blk", "rx").agg(F.count_if(F.col("bit") == 0).alias("n0"), F.count_if(F.col("bit") == 1).alias("n1")))
    w = W.partitionBy(*cell, "blk").orderBy("rx").rowsBetween(W.unboundedPreceding, -1)
    wb = W.partitionBy(*cell).orderBy("blk").rowsBetween(W.unboundedPreceding, -1)
    z = lambda e: F.coalesce(e, F.lit(0))
    blk = c.groupBy(*cell, "blk").agg(F.sum("n0").alias("s0"), F.sum("n1").alias("s1"))
    blk = blk.select(*cell, "blk", z(F.sum("s0").over(wb)).alias("o0"), z(F.sum("s1").over(wb)).alias("o1"))
    run = c.select(*cell, "blk", "n0", "n1", z(F.sum("n0").over(w)).alias("c0"), z(F.sum("n1").over(w)).alias("c1")).join(blk, [*cell, "blk"])
    score = run.groupBy(*keys).agg(
        F.sum(F.col("n1") * (F.col("c0") + F.col("o0")) - F.col("n0") * (F.col("c1") + F.col("o1"))).alias("s")
    )
    ties = lambda p, o: p.groupBy(*keys).agg(F.sum(F.col("c") * (F.col("c") - 1) / 2).alias(o))
    j = score.join(top, keys).join(ties(px, "tx"), keys).join(ties(py, "ty"), keys)
    n0 = F.col("n") * (F.col("n") - 1) / 2
    den = F.sqrt((n0 - F.col("tx")) * (n0 - F.col("ty")))
    return j.select(*keys, F.when(den > 0, F.col("s") / den).alias("tau"))


def variance_ratio(values: DataFrame, keys: list[str]) -> DataFrame:
    """Clipped share of variance between subject means; not an ICC."""
    total = values.groupBy(*keys).agg(F.var_samp("value").alias("vt"))
    means = values.groupBy(*keys, "subject").agg(F.avg("value").alias("m")).groupBy(*keys).agg(F.var_samp("m").alias("vm"))
    ratio = F.when(F.col("vt") > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("vm") / F.col("vt")))).otherwise(0.0)
    return total.join(means, keys).select(*keys, ratio.alias("variance_ratio"))


def direction_consistency(values: DataFrame, keys: list[str], x: str) -> DataFrame:
    c = cut(values)
    m = O.median(c, keys, x, "median_delta")
    return c.groupBy(*keys).agg(
        F.greatest(F.count_if(F.col(x) > 0), F.count_if(F.col(x) < 0)).alias("direction_consistency"), F.avg(x).alias("mean_delta")
    ).join(m, keys)


def eigenvalue_share(eig: DataFrame, session: list[str]) -> DataFrame:
    """Percent of each component in the hemisphere-mean spectrum."""
    m = eig.groupBy(*session, "k").agg(F.avg("lambda").alias("l"))
    return m.select(*session, "k", (100 * F.col("l") / F.sum("l").over(W.partitionBy(*session))).alias("share"))
