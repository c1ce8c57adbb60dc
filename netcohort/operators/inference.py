"""Exact small-cohort inference over long ``feature`` and ``outcome`` tables.

A test is one feature against one endpoint.  Its at most eight subjects live in
two arrays on one row, so millions of tests spread over the cluster and share
one broadcast permutation table (8! rows at most).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.expr import MAX_SUBJECTS, array_unit_ranks, checked, finite, permuted_dot
from ..functions.permutations import label_subsets, permutations
from ..session import cut

SLACK = 1e-12
SIZES = list(range(3, MAX_SUBJECTS + 1))


def complete_cases(features: DataFrame, outcomes: DataFrame, keys: list[str], x: str = "x") -> DataFrame:
    """``endpoint, keys, n, subjects, xs, ys`` over subjects with both values.

    Features that name an endpoint are held against this one only.
    """
    on = ["subject", *(c for c in ["endpoint"] if c in features.columns)]
    rows = features.join(outcomes.filter(finite(F.col("y"))), on).filter(finite(F.col(x)))
    packed = rows.groupBy("endpoint", *keys).agg(
        F.array_sort(F.collect_list(F.struct("subject", F.col(x).alias("x"), "y"))).alias("c"), F.count(F.lit(1)).alias("n")
    )
    checked = packed.withColumn(
        "c", F.when(F.col("n") <= MAX_SUBJECTS, F.col("c")).otherwise(F.raise_error(F.lit("more than 8 subjects in an exact test")))
    )
    return checked.select(
        "endpoint", *keys, F.col("n").cast("int").alias("n"),
        F.col("c.subject").alias("subjects"), F.col("c.x").alias("xs"), F.col("c.y").alias("ys"),
    )


def with_rho(cases: DataFrame) -> DataFrame:
    ranked = cases.withColumn("rx", array_unit_ranks(F.col("xs"))).withColumn("ry", array_unit_ranks(F.col("ys")))
    return ranked.withColumn("rho", dot(F.col("rx"), F.col("ry")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)


def valid_tests(cases: DataFrame) -> DataFrame:
    """Tests with at least three subjects and no constant side."""
    return with_rho(cases.filter("n >= 3")).filter(F.col("rx").isNotNull() & F.col("ry").isNotNull())


def exclusions(cases: DataFrame, keys: list[str]) -> DataFrame:
    """Tests left out, with the reason as data."""
    c = with_rho(cases)
    reason = (
        F.when((F.col("n") < 3) | F.col("ry").isNull(), "fewer than three observations or constant outcome")
        .when(F.col("rx").isNull(), "constant variable")
    )
    return c.select("endpoint", *keys, reason.alias("reason")).filter("reason is not null")


def shared_nulls(tests: DataFrame) -> DataFrame:
    """One row per test and ordering; the orderings are shared by all tests."""
    perms = F.broadcast(permutations(tests.sparkSession, SIZES))
    return tests.join(perms, "n").withColumn("null", permuted_dot(F.col("rx"), F.col("ry"), F.col("p")))


def ge(a: Column, b: Column, slack: float = SLACK) -> Column:
    return a >= b - F.lit(slack)


def share(cond: Column) -> Column:
    return F.count_if(cond) / F.count(F.lit(1))


def exact_p(nulls: DataFrame, keys: list[str]) -> DataFrame:
    r, v = F.col("rho"), F.col("null")
    return nulls.groupBy("endpoint", *keys).agg(
        F.first("n").alias("n"), F.first("rho").alias("rho"),
        share(ge(F.abs(v), F.abs(r))).alias("p_exact"),
        share(ge(v, r)).alias("p_greater"), share(v <= r + F.lit(SLACK)).alias("p_less"),
    )


def bh_adjust(df: DataFrame, family: list[str], p: str, out: str = "q_bh") -> DataFrame:
    """Benjamini-Hochberg over a family of any size.

    Equal p values collapse first: an exact p takes at most n! values, so the
    ordered windows stay small however many tests a family holds.
    """
    c = df.groupBy(*family, p).agg(F.count(F.lit(1)).alias("_c"))
    w = W.partitionBy(*family).orderBy(p)
    c = c.withColumn("_cum", F.sum("_c").over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn(
        "_m", F.sum("_c").over(W.partitionBy(*family))
    )
    raw = F.col(p) * F.col("_m") / F.col("_cum")
    q = F.least(F.lit(1.0), F.min(raw).over(w.rowsBetween(0, W.unboundedFollowing)))
    return df.join(c.select(*family, p, q.alias(out)), [*family, p])


#: Value ranges in which a family's peaks are counted.
PEAK_RANGES = 1024


def max_t(nulls: DataFrame, tests: DataFrame, family: list[str], stat: str = "rho", null: str = "null",
          order: str = "perm", out: str = "p_maxT") -> DataFrame:
    """Familywise p from the largest |null| of each shared ordering.

    An ordering counts only where every test of the family has a finite value.
    Peaks are counted by narrow value ranges: a test adds the ranges above its own
    and meets single peaks in that range only.
    """
    value = F.when(finite(F.col(null)), F.abs(null))
    peak = nulls.groupBy(*family, order).agg(
        F.max(value).alias("_mx"), F.count_if(value.isNull()).alias("_bad")
    ).filter("_bad = 0")
    dist = peak.groupBy(*family, "_mx").agg(F.count(F.lit(1)).alias("_c")).withColumn("_b", F.floor(F.col("_mx") * PEAK_RANGES))
    levels = dist.groupBy(*family, "_b").agg(F.sum("_c").alias("_s"))
    levels = levels.groupBy(*family).agg(F.collect_list(F.struct("_b", "_s")).alias("_levels"), F.sum("_s").alias("_total"))
    keys = tests.columns
    own = tests.join(levels, family).withColumn("_b", F.floor((F.abs(F.col(stat)) - SLACK) * PEAK_RANGES))
    over = F.aggregate(F.filter("_levels", lambda x: x["_b"] > F.col("_b")), F.lit(0).cast("long"), lambda a, x: a + x["_s"])
    own = own.withColumn("_over", over).drop("_levels")
    hit = F.max("_over") + F.sum(F.when(ge(F.col("_mx"), F.abs(F.col(stat))), F.col("_c")).otherwise(0))
    return own.join(dist, [*family, "_b"], "left").groupBy(*keys).agg((hit / F.max("_total")).alias(out))


def exact_family(features: DataFrame, outcomes: DataFrame, keys: list[str], family: list[str] | None = None, x: str = "x") -> DataFrame:
    """rho, exact p (both sides), BH q and maxT p for every endpoint and feature."""
    family = ["endpoint"] if family is None else family
    tests = valid_tests(complete_cases(features, outcomes, keys, x))
    nulls = shared_nulls(tests)
    p = exact_p(nulls, keys)
    q = bh_adjust(p, family, "p_exact")
    small = tests.select(*dict.fromkeys(["endpoint", *keys, *family]), "rho")
    t = max_t(nulls, small, family)
    sizes = small.groupBy(*family).agg(F.count(F.lit(1)).alias("family_size"))
    return q.join(t.drop("rho", *[f for f in family if f not in ("endpoint", *keys)]), ["endpoint", *keys]).join(sizes, family)


def leave_one_out(cases: DataFrame, keys: list[str]) -> DataFrame:
    """rho with each subject dropped and both sides re-ranked; null if constant."""
    held = cases.select("*", F.posexplode("subjects").alias("_h", "held"))
    drop = lambda c: F.filter(c, lambda v, i: i != F.col("_h"))
    held = held.withColumn("xs", drop(F.col("xs"))).withColumn("ys", drop(F.col("ys")))
    return with_rho(held).select("endpoint", *keys, "held", F.col("rho").alias("loo_rho"))


def lateral_contrast(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """rho_left - rho_right with the difference null of shared orderings, BH and maxT per endpoint."""
    k = ["endpoint", *keys]
    both = left.select(*k, "n", "ry", F.col("rx").alias("lx"), F.col("rho").alias("rho_left")).join(
        right.select(*k, F.col("rx").alias("qx"), F.col("rho").alias("rho_right")), k
    ).withColumn("rho", F.col("rho_left") - F.col("rho_right"))
    perms = F.broadcast(permutations(left.sparkSession, SIZES))
    nulls = both.join(perms, "n").withColumn(
        "null", permuted_dot(F.col("lx"), F.col("ry"), F.col("p")) - permuted_dot(F.col("qx"), F.col("ry"), F.col("p"))
    )
    p = nulls.groupBy(*k, "rho_left", "rho_right", "rho").agg(share(ge(F.abs("null"), F.abs("rho"))).alias("p_difference"))
    q = bh_adjust(p, ["endpoint"], "p_difference")
    return q.join(max_t(nulls, both.select(*k, "rho"), ["endpoint"]).drop("rho"), k)


# -- symptom side ------------------------------------------------------------

# Names of the four side definitions.
SIDE_DEFINITIONS = ("symptom_contralateral", "symptom_ipsilateral", "contralateral_minus_ipsilateral",
                    "contralateral_to_ipsilateral_change_ratio")


def side_value(c: dict[str, Column], i: dict[str, Column], metric: Column, interval: Column, definition: Column) -> Column:
    """Value of one side definition; undefined ratios are null."""
    ok = (c["post1"] > 0) & (c["post2"] > 0) & (i["post1"] > 0) & (i["post2"] > 0)
    ratio = (
        F.when(interval, F.when(i["delta"] > 0, c["delta"] / i["delta"]))
        .when(metric.contains("_position_"), F.lit(None).cast("double"))
        .when(ok, (c["post2"] / c["post1"]) / (i["post2"] / i["post1"]))
    )
    return (
        F.when(definition == SIDE_DEFINITIONS[0], c["delta"])
        .when(definition == SIDE_DEFINITIONS[1], i["delta"])
        .when(definition == SIDE_DEFINITIONS[2], c["delta"] - i["delta"])
        .otherwise(ratio)
    )


def side_label_null(tests: DataFrame, keys: list[str], spark) -> DataFrame:
    """p over every side assignment with the observed number of right-sided subjects.

    ``tests`` holds ``endpoint, keys, n, k, if_right, if_left, ry, rho`` where the
    arrays give each subject's value under either assignment.
    """
    picks = label_subsets(spark, SIZES)
    j = tests.join(F.broadcast(picks), ["n", "k"])
    right = lambda s: F.shiftright(F.col("bits"), s).bitwiseAND(F.lit(1)) == 1
    sel = F.array(*[F.when(right(s), F.get("if_right", F.lit(s))).otherwise(F.get("if_left", F.lit(s))) for s in range(MAX_SUBJECTS)])
    xs = F.slice(sel, F.lit(1), F.col("n"))
    whole = ~F.exists(xs, lambda v: v.isNull())
    # written first, so the ranking reads plain arrays instead of repeating the selection
    j = cut(j.withColumn("_x", F.when(whole, xs)))
    return j.withColumn("null", dot(array_unit_ranks(F.col("_x")), F.col("ry"))).drop("_x")


# -- paired and matrix tests -------------------------------------------------

def paired_signflip(pairs: DataFrame, keys: list[str], diff: str = "d") -> DataFrame:
    """All 2^n sign patterns of 3..16 paired differences per key."""
    packed = pairs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("subject", F.col(diff).alias("d")))).alias("c"))
    size = F.size("c")
    packed = packed.select(*keys, F.col("c.d").alias("d"), checked(size, size.between(3, 16), "a sign-flip test needs 3..16 pairs").alias("n"))
    packed = packed.withColumn("mean", F.aggregate("d", F.lit(0.0), lambda a, v: a + v) / F.col("n"))
    signs = packed.withColumn("id", F.explode(F.expr("sequence(0, shiftleft(1, n) - 1)")))
    flipped = F.aggregate(
        F.transform("d", lambda v, s: F.when(F.getbit(F.col("id"), s) == 1, -v).otherwise(v)),
        F.lit(0.0), lambda a, v: a + v,
    ) / F.col("n")
    s = signs.withColumn("null", flipped)
    return s.groupBy(*keys, "n").agg(
        F.first("mean").alias("mean_difference"), share(ge(F.col("null"), F.col("mean"), 1e-15)).alias("p_greater"),
        share(ge(F.abs("null"), F.abs("mean"), 1e-15)).alias("p_two"), F.count(F.lit(1)).alias("n_signflips"),
    )


def _pair_arrays(pairs: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Unit ranks of two pair vectors; ``i < j`` are subject positions 0..n-1."""
    p = pairs.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("i", "j", F.col(a).alias("a"), F.col(b).alias("b")))).alias("c"),
        (F.max("j") + 1).cast("int").alias("n"),
    )
    p = p.withColumn("n", checked(F.col("n"), F.col("n").between(3, MAX_SUBJECTS), f"an exact matrix test needs 3..{MAX_SUBJECTS} subjects"))
    return p.withColumn("ra", array_unit_ranks(F.col("c.a"))).withColumn("rb", array_unit_ranks(F.col("c.b")))


def mantel(pairs: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Spearman of two pair tables under all simultaneous relabelings of ``a``.

    Relabeling permutes the pairs, so ranks are taken once and looked up.
    """
    p = _pair_arrays(pairs, keys, a, b).withColumn("rho", dot(F.col("ra"), F.col("rb")))
    # place of pair (i, j), i<j, in row order of the upper triangle
    n = F.col("n")
    place = lambda i, j: (i * n - i * (i + 1) / 2 + (j - i - 1)).cast("int")
    j = p.join(F.broadcast(permutations(pairs.sparkSession, SIZES)), "n")
    moved = F.transform(
        "c", lambda e: F.get("ra", place(F.least(F.get("p", e["i"].cast("int")), F.get("p", e["j"].cast("int"))),
                                         F.greatest(F.get("p", e["i"].cast("int")), F.get("p", e["j"].cast("int")))))
    )
    s = j.withColumn("null", dot(moved, F.col("rb")))
    return s.groupBy(*keys).agg(
        F.first("rho").alias("rho"), share(ge(F.col("null"), F.col("rho"))).alias("p_one_sided"),
        share(ge(F.abs("null"), F.abs("rho"))).alias("p_two_sided"), F.count(F.lit(1)).alias("n_permutations"),
    )


def rank_residual(pairs: DataFrame, keys: list[str], on: str, given: str, out: str = "residual") -> DataFrame:
    """Residual of rank(on) after a straight-line fit on rank(given)."""
    p = pairs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", "j", F.col(on).alias("a"), F.col(given).alias("b")))).alias("c"))
    p = p.withColumn("y", array_unit_ranks(F.col("c.a"))).withColumn("x", array_unit_ranks(F.col("c.b")))
    # both vectors are centred with unit length, so the slope is their product
    p = p.withColumn("s", dot(F.col("x"), F.col("y"))).withColumn(
        "e", F.transform(F.arrays_zip("c", "x", "y"), lambda z: F.struct(z["c"]["i"].alias("i"), z["c"]["j"].alias("j"), (z["y"] - F.col("s") * z["x"]).alias(out)))
    )
    return p.select(*keys, F.inline("e"))


def donor_pull(delta: DataFrame) -> DataFrame:
    """``i, d, score``: change toward d minus the mean change toward the other non-self subjects."""
    tot = delta.groupBy("i").agg(F.sum("delta").alias("_t"), F.count(F.lit(1)).alias("_m"))
    return delta.join(tot, "i").select(
        "i", "d", (F.col("delta") - (F.col("_t") - F.col("delta")) / (F.col("_m") - 1)).alias("score")
    )


def donor_null(scores: DataFrame, donors: DataFrame, n: int) -> DataFrame:
    """All (n-1)^n non-self donor assignments, decoded from one id range."""
    if not 3 <= n <= 7:
        raise ValueError("exact donor enumeration supports 3..7 subjects")
    spark = scores.sparkSession
    table = scores.select((F.col("i") * n + F.col("d")).alias("k"), "score").agg(
        F.map_from_entries(F.collect_list(F.struct("k", "score"))).alias("m")
    ).withColumn("one", F.lit(1))
    seen = scores.join(donors, ["i", "d"]).agg(F.avg("score").alias("observed")).withColumn("one", F.lit(1))
    terms = []
    for i in range(n):
        digit = F.floor(F.col("id") / ((n - 1) ** (n - 1 - i))) % (n - 1)
        pick = digit + F.when(digit >= i, 1).otherwise(0)
        terms.append(F.element_at("m", (F.lit(i * n) + pick).cast("int")))
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    ids = spark.range((n - 1) ** n).withColumn("one", F.lit(1))
    null = ids.join(F.broadcast(table), "one").select("one", (total / n).alias("null"))
    return null.join(F.broadcast(seen), "one").agg(
        F.first("observed").alias("obs_pull_toward_donor"), share(ge(F.col("null"), F.col("observed"), 1e-15)).alias("p_one_sided"),
        F.count(F.lit(1)).alias("n_relabelings"), F.percentile("null", 0.95).alias("null_q95"),
    )


# -- families of tests -------------------------------------------------------

def family_hit_counts(nulls: DataFrame, test: list[str], alpha: float, family: list[str]) -> DataFrame:
    """``family, perm, hits``: tests whose row-conditional exact p falls below alpha.

    A test keeps its nulls as one sorted array (8! values at most).  Its p falls below
    alpha where fewer than alpha of them reach a value, that is above one element of the
    array; each ordering is held against this element.
    """
    v = F.abs("null")
    most = F.ceil(F.lit(alpha) * F.size("_v") - 1e-9).cast("int")
    edge = nulls.groupBy(*test).agg(F.sort_array(F.collect_list(v), asc=False).alias("_v")).select(*test, F.get("_v", most - 1).alias("_edge"))
    hit = v - F.lit(SLACK) > F.col("_edge")
    return nulls.join(edge, test).groupBy(*family, "perm").agg(F.count_if(hit).alias("hits"))


def family_hit_null(nulls: DataFrame, test: list[str], observed_hits: DataFrame, alpha: float = 0.05, family: list[str] | None = None) -> DataFrame:
    """Observed against expected number of nominal hits under shared relabeling, for each family.

    Tests of one family share their subjects and so their orderings.
    """
    family = ["endpoint"] if family is None else family
    return family_hit_counts(nulls, test, alpha, family).join(observed_hits, family).groupBy(*family).agg(
        F.first("observed_hits").alias("observed_hits"), F.avg("hits").alias("expected_hits"),
        F.stddev_pop("hits").alias("null_sd"), share(F.col("hits") >= F.col("observed_hits")).alias("p_null_ge_observed"),
        share(F.col("hits") < F.col("observed_hits")).alias("percentile_strictly_below"),
        F.count(F.lit(1)).alias("n_shared_permutations"),
    )


def icc21(table: DataFrame, keys: list[str], row: str = "subject", col: str = "visit", x: str = "x") -> DataFrame:
    """Two-way random, single measure, absolute agreement; null if undefined."""
    k = keys or []
    cells = table.groupBy(*k).agg(F.avg(x).alias("g"), F.countDistinct(row).alias("n"), F.countDistinct(col).alias("k"))
    if not k:
        cells, table, k = cells.withColumn("_1", F.lit(1)), table.withColumn("_1", F.lit(1)), ["_1"]
    rows = table.groupBy(*k, row).agg(F.avg(x).alias("r"))
    cols = table.groupBy(*k, col).agg(F.avg(x).alias("c"))
    ssr = rows.join(cells, k).groupBy(*k).agg(F.sum((F.col("r") - F.col("g")) ** 2).alias("ssr"))
    ssc = cols.join(cells, k).groupBy(*k).agg(F.sum((F.col("c") - F.col("g")) ** 2).alias("ssc"))
    sse = (
        table.join(rows, [*k, row]).join(cols, [*k, col]).join(cells, k).groupBy(*k)
        .agg(F.sum((F.col(x) - F.col("r") - F.col("c") + F.col("g")) ** 2).alias("sse"))
    )
    j = cells.join(ssr, k).join(ssc, k).join(sse, k)
    n, m = F.col("n"), F.col("k")
    msr, msc, mse = m * F.col("ssr") / (n - 1), n * F.col("ssc") / (m - 1), F.col("sse") / ((n - 1) * (m - 1))
    den = msr + (m - 1) * mse + m * (msc - mse) / n
    out = j.select(*k, F.when(den != 0, (msr - mse) / den).alias("icc21"))
    return out.drop("_1")


def pool_violations(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, reason`` of the groups that :func:`fisher_pool` refuses."""
    g = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("m"), F.min("n").alias("n"), F.max(F.abs("r")).alias("r"))
    why = F.when(F.col("r") >= 1 - 1e-9, "perfect correlation").when(F.col("n") <= 3, "three subjects or fewer").when(F.col("m") < 2, "a single cohort")
    return g.select(*keys, why.alias("reason")).filter("reason IS NOT NULL")


def fisher_pool(rows: DataFrame, keys: list[str], family_size: int) -> DataFrame:
    """(n-3)-weighted Fisher z with normal tail, Bonferroni and 95 % interval."""
    @F.pandas_udf("double")
    def upper_tail(z: pd.Series) -> pd.Series:
        from math import erfc, sqrt

        return z.map(lambda v: 0.5 * erfc(v / sqrt(2.0)))

    quantile = 1.959963984540054  # standard normal 0.975
    ok = (F.abs("r") < 1) & (F.col("n") > 3)
    w = checked(F.col("n") - 3, ok, "pooling needs |r| < 1 and n > 3 in every cohort")
    g = rows.groupBy(*keys).agg(
        (F.sum(w * F.atanh("r")) / F.sum(w)).alias("z"), (1 / F.sqrt(F.sum(w))).alias("se"), F.count(F.lit(1)).alias("m")
    )
    g = g.withColumn("se", checked(F.col("se"), F.col("m") >= 2, "pooling needs two cohorts or more"))
    p = g.withColumn("p_two", 2 * upper_tail(F.abs(F.col("z") / F.col("se"))))
    return p.select(
        *keys, F.tanh("z").alias("r"), "p_two", F.least(F.lit(1.0), F.col("p_two") * family_size).alias("p_bonferroni"),
        F.tanh(F.col("z") - quantile * F.col("se")).alias("ci_low"), F.tanh(F.col("z") + quantile * F.col("se")).alias("ci_high"),
    )


def theil_sen(points: DataFrame, keys: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """Median pairwise slope and median intercept of one small cohort per key.

    A key holds the subjects of one cohort, eight at most.
    """
    packed = points.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("subject", F.col(x).alias("x"), F.col(y).alias("y")))).alias("c"))
    packed = packed.withColumn("c", F.when(F.size("c") <= MAX_SUBJECTS, F.col("c")).otherwise(F.raise_error(F.lit("more than 8 subjects"))))
    pairs = packed.select(*keys, "c", F.explode("c").alias("a")).select(*keys, "c", "a", F.explode("c").alias("b"))
    s = pairs.filter("a.subject < b.subject and a.x <> b.x").groupBy(*keys).agg(
        F.median((F.col("b.y") - F.col("a.y")) / (F.col("b.x") - F.col("a.x"))).alias("slope")
    )
    res = packed.join(s, keys).select(*keys, "slope", F.explode("c").alias("a"))
    return res.groupBy(*keys, "slope").agg(F.median(F.col("a.y") - F.col("slope") * F.col("a.x")).alias("intercept"))


# -- rank thresholds and power -----------------------------------------------

def _tail(values: DataFrame, keys: list[str], alpha: float, denominator: Column) -> DataFrame:
    c = values.groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("c"))
    w = W.partitionBy(*keys).orderBy(F.col("v").desc())
    t = c.withColumn("tail", F.sum("c").over(w.rowsBetween(W.unboundedPreceding, 0)) / F.sum("c").over(W.partitionBy(*keys)))
    good = t.groupBy(*keys).agg(
        F.sum("c").alias("null_draws"), F.min(F.when(F.col("tail") <= alpha, F.col("v"))).alias("_v"),
        F.max(F.when(F.col("tail") <= alpha, F.col("tail"))).alias("_t"),
    )
    crit = F.coalesce("_v", denominator + 1)
    return good.select(
        *keys, "null_draws", crit.cast("long").alias("critical_absolute_numerator"), denominator.cast("long").alias("denominator"),
        (crit / denominator).alias("critical_absolute_spearman"), F.coalesce("_t", F.lit(0.0)).alias("achieved_null_probability"),
    )


def _numerator(order: Column, n: Column) -> Column:
    d2 = F.aggregate(F.transform(order, lambda v, i: (v - i) * (v - i)), F.lit(0).cast("long"), lambda a, v: a + v)
    return n * (n * n - 1) - 6 * d2


def hashed_order(seed: int, draw: Column, n: Column) -> Column:
    """Random ordering of 0..n-1 fixed by (seed, draw), so a retried task repeats it."""
    tagged = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.xxhash64(F.lit(seed), draw, i).alias("h"), i.cast("long").alias("i")))
    return F.transform(F.array_sort(tagged), lambda t: t["i"])


def size_critical_values(sizes: DataFrame, alpha: float = 0.05, draws: int = 400_000, seed: int = 0) -> DataFrame:
    """Smallest |Spearman numerator| with null tail at most alpha, for each ``n`` (2 or more) of ``sizes``.

    Enumerated for n <= 8, hash-sampled above.  A repeated size counts once.
    """
    each = sizes.select(F.col("n").cast("int").alias("n")).filter("n >= 2").distinct()
    n = F.col("n").cast("long")
    p = permutations(sizes.sparkSession, list(range(2, MAX_SUBJECTS + 1))).join(each, "n", "left_semi")
    exact = p.select("n", F.abs(_numerator(F.transform("p", lambda v: v.cast("long")), n)).alias("v"))
    grid = each.filter(F.col("n") > MAX_SUBJECTS).select("n", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(draws - 1).cast("long"))).alias("draw"))
    sampled = grid.select("n", F.abs(_numerator(hashed_order(seed, F.col("draw"), F.col("n")), n)).alias("v"))
    return _tail(exact.unionByName(sampled), ["n"], alpha, n * (n * n - 1))


def rank_critical_values(spark, sizes: list[int], alpha: float = 0.05, draws: int = 400_000, seed: int = 0) -> DataFrame:
    """:func:`size_critical_values` of named sizes."""
    return size_critical_values(spark.createDataFrame([(x,) for x in sizes], "n int"), alpha, draws, seed)


def beyond_critical(tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    """``tests`` (with ``n, rho``) and whether |rho| reaches the critical value of their size."""
    crit = size_critical_values(tests.select("n"), alpha).select("n", "critical_absolute_spearman")
    return tests.join(crit, "n").withColumn("beyond", F.abs("rho") >= F.col("critical_absolute_spearman") - 1e-9)


def _normal(seed: int, *ids: Column) -> Column:
    """Standard normal from two hashes (Box-Muller)."""
    u = lambda s: (F.pmod(F.xxhash64(F.lit(seed), F.lit(s), *ids), F.lit(1 << 52)) + 1) / float((1 << 52) + 1)
    return F.sqrt(-2 * F.log(u(1))) * F.cos(2 * 3.141592653589793 * u(2))


def monte_carlo_power(spark, sizes: list[int], correlations: list[float], draws: int, seed: int = 0, alpha: float = 0.05,
                      null_draws: int = 400_000) -> DataFrame:
    """Share of bivariate-normal samples beyond the rank threshold, per (n, r)."""
    crit = rank_critical_values(spark, sizes, alpha, null_draws, seed).select("n", "critical_absolute_numerator")
    n, r = F.col("n"), F.col("r")
    grid = spark.range(draws).select(
        F.col("id").alias("draw"), F.explode(F.array(*[F.lit(x) for x in sizes])).alias("n")
    ).select("draw", "n", F.explode(F.array(*[F.lit(float(x)) for x in correlations])).alias("r"))
    idx = F.sequence(F.lit(0), n - 1)
    e = grid.withColumn("x", F.transform(idx, lambda i: _normal(seed, F.col("draw"), n, i))).withColumn(
        "z", F.transform(idx, lambda i: _normal(seed + 1, F.col("draw"), n, r, i))
    )
    e = e.withColumn("y", F.zip_with("x", "z", lambda a, b: r * a + F.sqrt(F.greatest(F.lit(0.0), 1 - r * r)) * b))
    rank = lambda c: F.transform(c, lambda v: F.size(F.filter(c, lambda o: o < v)).cast("long"))
    d2 = F.aggregate(F.zip_with(rank(F.col("x")), rank(F.col("y")), lambda a, b: (a - b) * (a - b)), F.lit(0).cast("long"), lambda a, v: a + v)
    nl = n.cast("long")
    stat = F.abs(nl * (nl * nl - 1) - 6 * d2)
    hit = e.select("n", "r", stat.alias("s")).join(F.broadcast(crit), "n")
    p = hit.groupBy("n", "r").agg(F.count(F.lit(1)).alias("replicates"), share(F.col("s") >= F.col("critical_absolute_numerator")).alias("power"))
    se = F.sqrt(F.col("power") * (1 - F.col("power")) / F.col("replicates"))
    return p.withColumn("monte_carlo_se", se).withColumn("ci_low", F.greatest(F.lit(0.0), F.col("power") - 1.96 * se)).withColumn(
        "ci_high", F.least(F.lit(1.0), F.col("power") + 1.96 * se)
    )


def sample_size_search(power: DataFrame, target: float) -> DataFrame:
    """First n whose power reaches the target, per generating correlation."""
    return power.groupBy("r").agg(F.min(F.when(F.col("power") >= target, F.col("n"))).alias("first_n"))
