"""Permutation, sign and subset tables decoded from ``spark.range`` ids."""

from __future__ import annotations

from math import factorial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .expr import MAX_SUBJECTS


def permutations(spark: SparkSession, sizes: list[int]) -> DataFrame:
    """``n, perm, p``: all orderings of 0..n-1 in lexicographic order.

    At most 8! = 40 320 rows per size, so the table is always safe to broadcast.
    """
    out = None
    for n in sizes:
        if not 1 <= n <= MAX_SUBJECTS:
            raise ValueError("exact enumeration supports 1..8 labels")
        df = spark.range(factorial(n)).select(
            F.lit(n).alias("n"),
            F.col("id").alias("perm"),
            F.col("id").alias("_r"),
            F.array(*[F.lit(i) for i in range(n)]).alias("_left"),
            F.expr("cast(array() as array<int>)").alias("p"),
        )
        for k in range(n):
            f = factorial(n - 1 - k)
            df = df.withColumn("_pick", F.get("_left", F.floor(F.col("_r") / f).cast("int"))).select(
                "n",
                "perm",
                (F.col("_r") % f).alias("_r"),
                F.array_remove("_left", F.col("_pick")).alias("_left"),
                F.concat("p", F.array("_pick")).alias("p"),
            )
        df = df.select("n", "perm", "p")
        out = df if out is None else out.unionByName(df)
    return out


def label_subsets(spark: SparkSession, sizes: list[int]) -> DataFrame:
    """``n, k, bits``: every subset of n labels as a bit mask with k bits set."""
    if max(sizes) > 16:
        raise ValueError("subset enumeration supports at most 16 labels")
    ids = spark.range(2 ** max(sizes)).select(F.col("id").alias("bits"), F.explode(F.array(*[F.lit(n) for n in sizes])).alias("n"))
    return ids.filter(F.expr("bits < shiftleft(cast(1 as bigint), n)")).select("n", F.bit_count("bits").alias("k"), "bits")


def digits(col, base: int, n: int):
    """Array of ``n`` base-``base`` digits of an id, most significant first."""
    return F.array(*[(F.floor(col / (base ** (n - 1 - s))) % base).cast("int") for s in range(n)])
