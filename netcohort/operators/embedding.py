"""Diffusion-map embeddings of many sessions at once.

Tables are keyed by any group columns (subject, visit, hemisphere, setting ...).
The angular kernel of two row profiles that share no column is exactly one half,
so only the excess over one half is stored; every product with the dense kernel
is a sparse join plus one group sum.
"""

from __future__ import annotations

from itertools import permutations as orderings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.expr import checked, sum_expr
from ..session import cut
from .graphs import adjacency
from .iterate import union_all

# The primary embedding settings.
COMPONENTS, RETAINED, SPARSITY, ALPHA = 10, 4, 0.75, 0.05

# The named sensitivity settings (log weights, sparsity, alpha, components).
SETTINGS = {
    "primary_top25_align10": (True, 0.75, 0.05, 10),
    "primary_top25_align4": (True, 0.75, 0.05, 4),
    "primary_top25_align6": (True, 0.75, 0.05, 6),
    "log_no_threshold": (True, None, 0.05, 10),
    "raw_no_threshold_alpha05": (False, None, 0.05, 10),
    "zarkali_like": (False, None, 0.5, 10),
    "log_top10": (True, 0.9, 0.05, 10),
    "log_top50": (True, 0.5, 0.05, 10),
}


def setting_grid(spark) -> DataFrame:
    rows = [(k, *v) for k, v in SETTINGS.items()]
    return spark.createDataFrame(rows, "setting string, log_transform boolean, sparsity double, alpha double, components int")


def hemisphere_slice(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges inside one cortical hemisphere, with the hemisphere as a column."""
    c = F.broadcast(nodes.filter("tissue = 'cortex' and hemi in ('L', 'R')").select("idx", "hemi"))
    a = c.select(F.col("idx").alias("i"), "hemi")
    b = c.select(F.col("idx").alias("j"), "hemi")
    return edges.join(a, "i").join(b, ["j", "hemi"])


def cortical_order(nodes: DataFrame) -> DataFrame:
    """Position of every cortical node, left first."""
    # the node basis of one atlas: a few hundred rows
    return nodes.filter("tissue = 'cortex' and hemi in ('L', 'R')").select(
        "idx", "hemi", "network", "name", (F.row_number().over(W.partitionBy("tissue").orderBy("hemi", "idx")) - 1).alias("position")
    )


def hemisphere_sizes(nodes: DataFrame) -> DataFrame:
    return nodes.filter("tissue = 'cortex' and hemi in ('L', 'R')").groupBy("hemi").agg(F.count(F.lit(1)).alias("nodes"))


def isolated_profiles(edges: DataFrame, nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Cortical nodes without any weight inside their hemisphere, per session."""
    inside = hemisphere_slice(edges, nodes).filter("w > 0")
    ends = inside.select(*keys, "hemi", F.explode(F.array("i", "j")).alias("node")).distinct()
    basis = nodes.filter("tissue = 'cortex'").agg(F.collect_list(F.struct("hemi", F.col("idx").alias("node"))).alias("b")).withColumn("_1", F.lit(1))
    grid = edges.select(*keys).distinct().withColumn("_1", F.lit(1)).join(F.broadcast(basis), "_1").select(*keys, F.inline("b"))
    return grid.join(ends, [*keys, "hemi", "node"], "left_anti")


def mean_network(edges: DataFrame, members: int | Column, keys: list[str] | None = None) -> DataFrame:
    """Mean weight per pair over ``members`` networks; an absent pair counts as zero."""
    n = F.lit(members) if isinstance(members, int) else members
    return edges.groupBy(*(keys or []), "i", "j").agg((F.sum("w") / n).alias("w"))


def loso_mean(edges: DataFrame, subjects: DataFrame) -> DataFrame:
    """``held, i, j, w``: mean over the other subjects, as total minus own."""
    total = edges.groupBy("i", "j").agg(F.sum("w").alias("t"), F.count_if(F.col("w") > 0).alias("givers"))
    n = subjects.agg(F.count(F.lit(1)).alias("n"), F.collect_set("subject").alias("s"))
    each = total.withColumn("_1", F.lit(1)).join(F.broadcast(n.withColumn("_1", F.lit(1))), "_1").select("i", "j", "t", "givers", "n", F.explode("s").alias("held"))
    own = edges.select(F.col("subject").alias("held"), "i", "j", F.col("w").alias("own"))
    d = each.join(own, ["held", "i", "j"], "left").select(
        "held", "i", "j", ((F.col("t") - F.coalesce("own", F.lit(0.0))) / (F.col("n") - 1)).alias("w"),
        (F.col("givers") - F.coalesce((F.col("own") > 0).cast("int"), F.lit(0))).alias("others"),
    )
    # a pair stays if another subject has it, however small its mean
    return d.filter("others > 0").drop("others")


def member_mean(members: DataFrame, hashes: DataFrame | None = None) -> DataFrame:
    """Mean of 2..500 member networks ``member, i, j, w``; repeated bytes are refused by S12."""
    count = members.agg(F.countDistinct("member").alias("m")).withColumn("_1", F.lit(1))
    s = members.groupBy("i", "j").agg(F.sum("w").alias("s")).withColumn("_1", F.lit(1)).join(F.broadcast(count), "_1")
    m = checked(F.col("m"), F.col("m").between(2, 500), "a mean needs 2..500 member networks")
    return s.select("i", "j", (F.col("s") / m).alias("w"), m.alias("m"))


# -- kernel ------------------------------------------------------------------

def row_sparsify(edges: DataFrame, keys: list[str], keep: Column | None) -> DataFrame:
    """``keys, i, j, w`` in both directions, the ``keep`` largest of every row.

    A row has one entry per node of the basis; ties go to the smaller column.
    """
    carry = [c for c in edges.columns if c not in (*keys, "i", "j", "w")]
    rows = adjacency(edges.filter("w > 0"), keys, ["w", *carry])
    if keep is None:
        return rows
    r = F.row_number().over(W.partitionBy(*keys, "i").orderBy(F.col("w").desc(), "j"))
    return rows.withColumn("_r", r).filter(F.col("_r") <= keep).drop("_r")


def kept_per_row(n: Column, sparsity: Column) -> Column:
    return F.floor(n * (1 - sparsity) + 1e-9)


def normalized_angle(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, i, j, e``: excess of 1 - acos(cosine)/pi over one half, both directions and diagonal."""
    sq = rows.groupBy(*keys, "i").agg(F.sqrt(F.sum(F.col("w") ** 2)).alias("len"))
    u = cut(rows.join(sq, [*keys, "i"]).select(*keys, "i", "j", (F.col("w") / F.col("len")).alias("u")))
    v = u.select(*keys, F.col("i").alias("i2"), "j", F.col("u").alias("u2"))
    dots = u.join(v, [*keys, "j"]).filter("i < i2").groupBy(*keys, "i", "i2").agg(F.sum(F.col("u") * F.col("u2")).alias("d"))
    pi = 3.141592653589793
    ang = dots.select(*keys, "i", F.col("i2").alias("j"), (0.5 - F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("d")))) / pi).alias("e"))
    both = ang.unionByName(ang.select(*keys, F.col("j").alias("i"), F.col("i").alias("j"), "e"))
    return both.unionByName(sq.select(*keys, "i", F.col("i").alias("j"), F.lit(0.5).alias("e")))


def diffusion_scale(kernel: DataFrame, keys: list[str], alpha: Column) -> DataFrame:
    """``keys, node, s``: M = s (1/2 + E) s is the symmetric diffusion operator."""
    d = kernel.groupBy(*keys, F.col("i").alias("node")).agg(F.sum("e").alias("es"))
    n = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    d = cut(d.join(n, keys).select(*keys, "node", F.pow(0.5 * F.col("n") + F.col("es"), -alpha).alias("a")))
    tot = d.groupBy(*keys).agg(F.sum("a").alias("t"))
    inner = kernel.join(d.select(*keys, F.col("node").alias("j"), "a"), [*keys, "j"]).groupBy(*keys, F.col("i").alias("node")).agg(
        F.sum(F.col("e") * F.col("a")).alias("ea")
    )
    j = d.join(tot, keys).join(inner, [*keys, "node"])
    own = F.col("a") * (0.5 * F.col("t") + F.col("ea"))
    return j.select(*keys, "node", (F.col("a") / F.sqrt(own)).alias("s"))


# -- leading eigenvectors ----------------------------------------------------

def _names(b: int, p: str = "v") -> list[str]:
    return [f"{p}{k}" for k in range(b)]


def _multiply(v: DataFrame, kernel: DataFrame, scale: DataFrame, keys: list[str], b: int) -> DataFrame:
    """M v for all groups and columns at once."""
    y = v.join(scale, [*keys, "node"]).select(*keys, "node", *[(F.col(c) * F.col("s")).alias(c) for c in _names(b)])
    tot = y.groupBy(*keys).agg(*[(0.5 * F.sum(c)).alias("t" + c) for c in _names(b)])
    z = kernel.join(y.withColumnRenamed("node", "j"), [*keys, "j"]).groupBy(*keys, F.col("i").alias("node")).agg(
        *[F.sum(F.col("e") * F.col(c)).alias(c) for c in _names(b)]
    )
    return z.join(tot, keys).join(scale, [*keys, "node"]).select(
        *keys, "node", *[((F.col(c) + F.col("t" + c)) * F.col("s")).alias(c) for c in _names(b)]
    )


def _inner(b: int, second: str) -> tuple[list, Column]:
    """Sums of the upper triangle of a symmetric b x b matrix, and the flat matrix of them."""
    upper = [F.sum(F.col(f"v{i}") * F.col(f"{second}{j}")).alias(f"{second}_{i}_{j}") for i in range(b) for j in range(i, b)]
    return upper, F.array(*[F.col(f"{second}_{min(i, j)}_{max(i, j)}") for i in range(b) for j in range(b)])


def _projected(both: DataFrame, keys: list[str], b: int) -> DataFrame:
    """``keys, r, l``: eigenpairs of M on the span of each group's block ``v`` (``mv`` is M v).

    ``r`` (b x b, flat) turns the block into orthonormal vectors, largest value first.
    Directions that a small group does not have become columns of zeros.
    """
    (g, flat_g), (m, flat_m) = _inner(b, "v"), _inner(b, "mv")
    gram = both.groupBy(*keys).agg(*g, *m).select(*keys, flat_g.alias("g"), flat_m.alias("m"))
    types = ", ".join(f"{c} {gram.schema[c].dataType.simpleString()}" for c in keys)

    def solve(batches):
        import numpy as np

        for pdf in batches:
            g, m = (np.stack([np.asarray(x, float).reshape(b, b) for x in pdf[c]]) if len(pdf) else np.empty((0, b, b)) for c in "gm")
            val, vec = np.linalg.eigh(g)
            floor = np.maximum(val[:, -1:] * 1e-13, 1e-300)
            t = vec * np.where(val > floor, 1 / np.sqrt(np.maximum(val, floor)), 0.0)[:, None, :]
            small = t.transpose(0, 2, 1) @ m @ t
            lam, y = np.linalg.eigh((small + small.transpose(0, 2, 1)) / 2)
            out = pdf[keys].copy()
            out["r"], out["l"] = list((t @ y)[:, :, ::-1].reshape(len(pdf), -1)), list(lam[:, ::-1])
            yield out

    return gram.mapInPandas(solve, types + ", r array<double>, l array<double>")


def _turn(v: DataFrame, r: DataFrame, keys: list[str], b: int, wide: int | None = None) -> DataFrame:
    """Rows times each group's small matrix ``r`` (b x wide, flat)."""
    wide = wide or b
    j = v.join(r.select(*keys, "r"), keys).withColumn("_v", F.array(*_names(b)))
    out = F.transform(
        F.sequence(F.lit(0), F.lit(wide - 1)),
        lambda c: F.aggregate(F.transform("_v", lambda x, k: x * F.get("r", k * wide + c)), F.lit(0.0), lambda s, x: s + x),
    )
    return j.select(*keys, "node", out.alias("_w")).select(*keys, "node", *[F.get("_w", F.lit(c)).alias(f"v{c}") for c in range(wide)])


#: Largest |M u - l u| of a settled group (l is at most 1), multiplications a round and rounds.
TOLERANCE, POWERS, ROUNDS = 1e-10, 4, 60


def top_eigen(kernel: DataFrame, scale: DataFrame, keys: list[str], components: int = COMPONENTS, tolerance: float = TOLERANCE,
              powers: int = POWERS, rounds: int = ROUNDS) -> DataFrame:
    """``keys, node, u, l``: leading eigenvectors (trivial one first) and values.

    One block subspace iteration over all groups, whatever their size: a round
    multiplies and solves the problem projected on the block, from two small matrices of
    inner products a group.  Groups whose residuals are within ``tolerance`` are
    settled and leave; the others go on from their multiplied vectors.  A group that
    does not settle in ``rounds`` raises.
    """
    kernel, scale = cut(kernel), cut(scale)
    k1 = components + 1
    b = 2 * k1 + 6
    size = scale.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    enough = checked(F.col("_n"), F.col("_n") > k1, "too few nodes for the requested eigensystem")
    seed = [F.sin(F.col("node") * (k + 1.3) + k * k * 0.7) for k in range(b)]
    seed[0] = F.when(enough > 0, 1 / F.col("s"))
    v = scale.join(size, keys).select(*keys, "node", *[e.alias(f"v{k}") for k, e in enumerate(seed)])
    settled = []
    for _ in range(rounds):
        w = cut(v)
        mv = _multiply(w, kernel, scale, keys, b).select(*keys, "node", *[F.col(c).alias("m" + c) for c in _names(b)])
        both = cut(w.join(mv, [*keys, "node"]))
        ritz = cut(_projected(both, keys, b))
        u = _turn(both.select(*keys, "node", *_names(b)), ritz, keys, b).select(*keys, "node", F.array(*_names(b)).alias("u"))
        mu = _turn(both.select(*keys, "node", *[F.col("m" + c).alias(c) for c in _names(b)]), ritz, keys, b).select(*keys, "node", F.array(*_names(b)).alias("mu"))
        now = u.join(mu, [*keys, "node"]).join(ritz.select(*keys, "l"), keys)
        off = F.array_max(F.transform(F.sequence(F.lit(0), F.lit(k1 - 1)), lambda k: F.abs(F.get("mu", k) - F.get("l", k) * F.get("u", k))))
        worst = now.groupBy(*keys).agg((F.max(off) <= tolerance).alias("_done"))
        now = cut(now.join(worst, keys))
        settled.append(now.filter("_done").select(*keys, "node", F.slice("u", 1, k1).alias("u"), F.slice("l", 1, k1).alias("l")))
        open_ = now.filter("NOT _done")
        if open_.isEmpty():
            return cut(union_all(settled))
        # scaled so that the multiplied vectors are about as long as each other
        v = open_.select(*keys, "node", *[(F.get("mu", F.lit(k)) / F.pow(F.greatest(F.get("l", F.lit(k)), F.lit(1e-3)), powers)).alias(f"v{k}") for k in range(b)])
        for _ in range(powers - 1):
            v = _multiply(v, kernel, scale, keys, b)
    raise RuntimeError("eigenvectors did not settle")


def residual(eig: DataFrame, kernel: DataFrame, scale: DataFrame, keys: list[str], components: int = COMPONENTS) -> DataFrame:
    """Largest |M u - l u| per group and the worst off-diagonal inner product."""
    b = components + 1
    v = cut(eig.select(*keys, "node", *[F.get("u", F.lit(k)).alias(f"v{k}") for k in range(b)]))
    mv = _multiply(v, kernel, scale, keys, b).select(*keys, "node", *[F.col(c).alias("m" + c) for c in _names(b)])
    j = v.join(mv, [*keys, "node"]).join(eig.select(*keys, "l").dropDuplicates(keys), keys)
    gaps = [F.abs(F.col(f"mv{k}") - F.get("l", F.lit(k)) * F.col(f"v{k}")) for k in range(b)]
    off = [F.abs(F.sum(F.col(f"v{i}") * F.col(f"v{k}"))) for i in range(b) for k in range(i)]
    return j.groupBy(*keys).agg(F.max(F.greatest(*gaps)).alias("residual"), F.greatest(*off).alias("overlap"), F.count(F.lit(1)).alias("nodes"))


def coordinates(eig: DataFrame, keys: list[str], components: int = COMPONENTS) -> DataFrame:
    """``keys, node, g`` with g_k = l_k/(1-l_k) u_k/u_0; largest |entry| of each axis positive."""
    raw = [F.get("u", F.lit(k)) / F.get("u", F.lit(0)) * F.get("l", F.lit(k)) / (1 - F.get("l", F.lit(k))) for k in range(1, components + 1)]
    c = cut(eig.select(*keys, "node", *[e.alias(f"v{k}") for k, e in enumerate(raw)]))
    sign = c.groupBy(*keys).agg(F.array(*[F.signum(F.max_by(x, F.struct(F.round(F.abs(x), 9), -F.col("node")))) for x in _names(components)]).alias("sg"))
    return c.join(sign, keys).select(*keys, "node", F.array(*[F.col(f"v{k}") * F.get("sg", F.lit(k)) for k in range(components)]).alias("g"))


def spectrum(eig: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, k, lambda``: scaled values l/(1-l) of the non-trivial components."""
    one = eig.groupBy(*keys).agg(F.first("l").alias("l"))
    return one.select(*keys, F.posexplode("l").alias("k", "l")).filter("k > 0").select(*keys, "k", (F.col("l") / (1 - F.col("l"))).alias("lambda"))


def procrustes(source: DataFrame, reference: DataFrame, keys: list[str], on: list[str], k: int) -> DataFrame:
    """Rotate ``keys, node, g`` onto ``on, node, g`` (no centring, no scaling)."""
    r = reference.select(*on, "node", F.col("g").alias("h"))
    j = source.join(r, [*on, "node"])
    cross = j.groupBy(*keys).agg(F.array(*[F.sum(F.get("g", F.lit(a)) * F.get("h", F.lit(c))) for a in range(k) for c in range(k)]).alias("g"))
    types = ", ".join(f"{c} {cross.schema[c].dataType.simpleString()}" for c in keys)

    def rotate(batches):
        import numpy as np

        for pdf in batches:
            m = np.stack([np.asarray(g, float).reshape(k, k) for g in pdf["g"]]) if len(pdf) else np.empty((0, k, k))
            u, _, vt = np.linalg.svd(m)
            out = pdf[keys].copy()
            out["r"] = list((u @ vt).reshape(len(pdf), -1))
            yield out

    rot = cross.mapInPandas(rotate, types + ", r array<double>")
    flat = source.select(*keys, "node", *[F.get("g", F.lit(c)).alias(f"v{c}") for c in range(k)])
    return _turn(flat, rot, keys, k).select(*keys, "node", F.array(*_names(k)).alias("g"))


def _column(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def embed(edges: DataFrame, keys: list[str], sizes: DataFrame, components: int = COMPONENTS, sparsity: float | Column | None = SPARSITY,
          alpha: float | Column = ALPHA, log: bool | Column = True, expected: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Coordinates and spectra of every group; ``keys`` must include ``hemi``.

    The settings may be columns over ``keys``; a null sparsity keeps whole rows.
    ``expected`` lists the groups that must be there, also those without any pair.
    """
    e = edges.withColumn("w", F.when(_column(log), F.log1p("w")).otherwise(F.col("w"))).join(sizes, "hemi")
    part = _column(sparsity).cast("double")
    rows = row_sparsify(e, keys, F.coalesce(kept_per_row(F.col("nodes"), part), F.col("nodes"))).drop("nodes")
    kernel = cut(normalized_angle(rows, keys))
    groups = edges.select(*keys).distinct() if expected is None else expected.select(*keys).distinct()
    have = kernel.groupBy(*keys).agg(F.countDistinct("i").alias("have"))
    have = groups.join(have, keys, "left").fillna(0, ["have"]).join(sizes, "hemi")
    short = have.filter("have < nodes").take(1)
    if short:
        raise ValueError(f"{short[0].nodes - short[0].have} isolated nodes in {[short[0][k] for k in keys]}")
    eig = top_eigen(kernel, diffusion_scale(kernel, keys, _column(alpha)), keys, components)
    return coordinates(eig, keys, components), spectrum(eig, keys)


def _by_setting(settings: list[str], place: int, kind: str) -> Column:
    pairs = [x for name in settings for x in (F.lit(name), F.lit(SETTINGS[name][place]).cast(kind))]
    return F.element_at(F.create_map(*pairs), F.col("setting"))


def cohort_embeddings(edges: DataFrame, nodes: DataFrame, subjects: DataFrame, mode: str, settings: list[str] | None = None,
                      retain: int = RETAINED) -> tuple[DataFrame, DataFrame]:
    """Every session aligned to the common or its held-out reference.

    ``edges`` are ``subject, visit, i, j, w`` with visit 0 the reference visit.  With
    ``settings`` their name is a key of the result, and all of them run in one plan.
    """
    sk = ["setting"] if settings else []
    sizes = cut(hemisphere_sizes(nodes))
    cort = hemisphere_slice(edges, nodes)
    hemi_of = nodes.select(F.col("idx").alias("i"), "hemi")
    if settings:
        cort = cort.select("*", F.explode(F.array(*[F.lit(x) for x in settings])).alias("setting"))
        args = (sizes, COMPONENTS, _by_setting(settings, 1, "double"), _by_setting(settings, 2, "double"), _by_setting(settings, 0, "boolean"))
        k = _by_setting(settings, 3, "int")
    else:
        args, k = (sizes,), F.lit(COMPONENTS)
    cort = cut(cort)
    base = cort.filter("visit = 0")
    if mode == "common":
        ref_edges = mean_network(base, subjects.count(), [*sk, "hemi"])
        on = [*sk, "hemi"]
    elif mode == "loso":
        plain = base.filter(F.col("setting") == settings[0]) if settings else base
        ref_edges = loso_mean(plain, subjects).join(hemi_of, "i").withColumnRenamed("held", "subject")
        if settings:
            ref_edges = ref_edges.select("*", F.explode(F.array(*[F.lit(x) for x in settings])).alias("setting"))
        on = [*sk, "subject", "hemi"]
    else:
        raise ValueError("mode is common or loso")
    ref, _ = embed(ref_edges, on, *args)
    key = [*sk, "subject", "visit", "hemi"]
    both = F.explode(F.array(F.lit("L"), F.lit("R"))).alias("hemi")
    grid = edges.select("subject", "visit").distinct().select("*", both).join(sizes, "hemi", "left_semi")
    if settings:
        grid = grid.select("*", F.explode(F.array(*[F.lit(x) for x in settings])).alias("setting"))
    g, lam = embed(cort, key, *args, expected=grid)
    # axes beyond a setting's own are zeros, which no rotation moves into the others
    own = F.transform("g", lambda x, at: F.when(at < k, x).otherwise(0.0))
    aligned = procrustes(g.withColumn("g", own), ref.withColumn("g", own), key, on, COMPONENTS)
    return cut(aligned.select(*key, "node", F.slice("g", 1, max(retain, 1)).alias("g"))), lam


def as_coords(embedding: DataFrame, nodes: DataFrame) -> DataFrame:
    """Embedding as the coordinate table the geometry operators read."""
    n = F.broadcast(nodes.select(F.col("idx").alias("node"), "network", "name"))
    return embedding.join(n, "node").select(
        "subject", "visit", F.col("node").alias("parcel"), "hemi", "network", "name", *[F.get("g", F.lit(i)).alias(f"g{i + 1}") for i in range(4)]
    )


# -- matching axes -----------------------------------------------------------

def axis_correlations(values: DataFrame, primary: DataFrame, cells: list[str], keys: list[str] | None = None) -> DataFrame:
    """``keys, source, target, r`` over all shared cells; both tables are long by ``axis``."""
    k = keys or []
    a = values.select(*k, *cells, F.col("axis").alias("source"), F.col("value").alias("x"))
    b = primary.select(*cells, F.col("axis").alias("target"), F.col("value").alias("y"))
    return a.join(b, cells).groupBy(*k, "source", "target").agg(F.corr("x", "y").alias("r"))


def match_axes(corr: DataFrame, k: int, keys: list[str] | None = None, targets: int = 4) -> DataFrame:
    """One-to-one source per target with the largest summed |r|, by full enumeration.

    At most 10!/6! = 5040 assignments of a k x 4 table; signs stay as they are.
    """
    g = keys or ["_1"]
    c = corr if keys else corr.withColumn("_1", F.lit(1))
    table = c.groupBy(*g).agg(F.map_from_entries(F.collect_list(F.struct((F.col("source") * targets + F.col("target")).alias("p"), F.abs("r").alias("r")))).alias("m"))
    plans = corr.sparkSession.createDataFrame([(list(p), k) for p in orderings(range(k), targets)], "pick array<int>, k int")
    each = table.withColumn("k", F.lit(k)).join(F.broadcast(plans), "k")
    score = sum_expr([F.element_at("m", (F.get("pick", F.lit(t)) * targets + t).cast("int")) for t in range(targets)])
    best = each.groupBy(*g).agg(F.max_by("pick", F.struct(F.round(score, 12), F.transform("pick", lambda v: -v))).alias("pick"))
    rows = best.select(*g, F.posexplode("pick").alias("target", "source"))
    return rows.join(c, [*g, "target", "source"]).drop("_1")
