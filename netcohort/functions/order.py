"""Exact ranks, quantiles and top-k that survive one huge group.

A plain window over a group sorts that group in one task.  Here a group is
first reduced to its distinct values with counts, then cut into value ranges by
mergeable approximate splitters; each range is ordered on its own and range
offsets are added.  The splitters only balance the work: results are exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import cut, dealt

RANGES = 256
SMALL_GROUP = 1_000_000


def value_positions(df: DataFrame, keys: list[str], value: str, ranges: int = RANGES, small: int = SMALL_GROUP) -> DataFrame:
    """``keys, value, c, before, n``: distinct values, their count, rows before.

    The distinct values are written once.  Where no group holds more than
    ``small`` of them one window per group orders them; otherwise every group is
    split into value ranges.
    """
    counts = cut(df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("c")))
    largest, total = counts.groupBy(*keys).agg(F.count(F.lit(1)).alias("m")).agg(F.max("m"), F.sum("m")).first()
    largest, total = largest or 0, total or 0
    if largest <= small:
        w = W.partitionBy(*keys).orderBy(value)
        upto = F.sum("c").over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
        size = F.sum("c").over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
        return dealt(counts, total, *keys).select(*keys, value, "c", (upto - F.col("c")).alias("before"), size.alias("n"))
    cuts = [i / ranges for i in range(1, ranges)]
    splits = counts.groupBy(*keys).agg(F.percentile_approx(value, cuts, 1000).alias("_s"), F.sum("c").alias("n"))
    slot = F.size(F.filter("_s", lambda s: s < F.col(value)))
    ranged = cut(counts.join(splits, keys).select(*keys, value, "c", "n", slot.alias("_b")))
    totals = ranged.groupBy(*keys, "_b").agg(F.sum("c").alias("_t"))
    offsets = totals.select(
        *keys,
        "_b",
        F.coalesce(
            F.sum("_t").over(W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
        ).alias("_o"),
    )
    inner = F.coalesce(
        F.sum("c").over(W.partitionBy(*keys, "_b").orderBy(value).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
    )
    return (
        ranged.withColumn("_i", inner)
        .join(offsets, [*keys, "_b"])
        .select(*keys, value, "c", (F.col("_o") + F.col("_i")).alias("before"), "n")
    )


def avg_rank(df: DataFrame, keys: list[str], value: str, out: str, size: str | None = None, **kw) -> DataFrame:
    """Append the ascending average rank of ``value`` inside ``keys``."""
    pos = value_positions(df, keys, value, **kw)
    cols = [(F.col("before") + (F.col("c") + 1) / 2.0).alias(out)]
    if size:
        cols.append(F.col("n").alias(size))
    return df.join(pos.select(*keys, value, *cols), [*keys, value])


def quantiles(df: DataFrame, keys: list[str], value: str, qs: dict[str, float], **kw) -> DataFrame:
    """Exact linear-interpolation quantiles per group (median: ``{"m": .5}``)."""
    pos = value_positions(df.filter(F.col(value).isNotNull()), keys, value, **kw)
    inside = lambda k: (F.col("before") <= k) & (k < F.col("before") + F.col("c"))
    aggs, outs = [], []
    for name, q in qs.items():
        h = (F.col("n") - 1) * F.lit(float(q))
        aggs.append(F.max(F.when(inside(F.floor(h)), F.col(value))).alias(f"_l_{name}"))
        aggs.append(F.max(F.when(inside(F.ceil(h)), F.col(value))).alias(f"_u_{name}"))
        aggs.append(F.max(h - F.floor(h)).alias(f"_f_{name}"))
        lo, up = F.col(f"_l_{name}"), F.col(f"_u_{name}")
        outs.append((lo + (up - lo) * F.col(f"_f_{name}")).alias(name))
    return pos.groupBy(*keys).agg(*aggs).select(*keys, *outs)


def median(df: DataFrame, keys: list[str], value: str, out: str = "median", **kw) -> DataFrame:
    return quantiles(df, keys, value, {out: 0.5}, **kw)


def position_index(df: DataFrame, keys: list[str], first: str, then: list[str], out: str, **kw) -> DataFrame:
    """Append the zero-based position by ``first`` (numeric) then ``then``."""
    pos = value_positions(df, keys, first, **kw).select(*keys, first, "before")
    tied = F.row_number().over(W.partitionBy(*keys, first).orderBy(*then)) - 1
    return df.withColumn("_tie", tied).join(pos, [*keys, first]).withColumn(
        out, F.col("before") + F.col("_tie")
    ).drop("_tie", "before")


def top_k(df: DataFrame, keys: list[str], value: str, tie: str, k: DataFrame, k_keys: list[str]) -> DataFrame:
    """Keep the ``k`` largest ``value`` rows of each group, ties by smallest ``tie``.

    ``k`` holds ``keys + k_keys`` and the wanted number of rows; a group with
    fewer rows than wanted yields nothing (callers report it as a violation).
    ``tie`` must be unique inside a group.
    """
    ranked = cut(df.withColumn("_neg", -F.col(value)))
    pos = value_positions(ranked, keys, "_neg")
    edge = pos.join(k, keys).filter((F.col("before") < F.col("k")) & (F.col("k") <= F.col("before") + F.col("c")))
    edge = edge.select(*keys, *k_keys, F.col("_neg").alias("_cut"), (F.col("k") - F.col("before")).alias("_room"))
    edge = cut(edge)
    joined = ranked.join(edge, keys)
    above = joined.filter(F.col("_neg") < F.col("_cut"))
    tied = joined.filter(F.col("_neg") == F.col("_cut"))
    order = value_positions(tied, [*keys, *k_keys], tie).select(*keys, *k_keys, tie, "before")
    tied = tied.join(order, [*keys, *k_keys, tie]).filter(F.col("before") < F.col("_room"))
    cols = [c for c in df.columns if c not in k_keys] + list(k_keys)
    return above.select(*cols).unionByName(tied.select(*cols))
