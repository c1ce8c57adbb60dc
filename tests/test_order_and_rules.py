"""Ordering primitives, registry rules and package rules."""

import re
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from netcohort.functions import order as O
from netcohort.functions.permutations import label_subsets, permutations

ROOT = Path(__file__).resolve().parents[1]


def sample(spark):
    rng = np.random.default_rng(3)
    rows = [(k, float(v), i) for k in "ab" for i, v in enumerate(rng.integers(0, 60, 300))] + [("c", 5.0, i) for i in range(200)]
    return rows, spark.createDataFrame(rows, "k string, v double, id int")


def test_ranks_and_quantiles_agree_when_groups_are_split(spark):
    rows, df = sample(spark)
    for small in (10**6, 5):
        med = {r.k: (r.m, r.q) for r in O.quantiles(df, ["k"], "v", {"m": 0.5, "q": 0.95}, small=small, ranges=8).collect()}
        for k in "abc":
            v = np.array([x[1] for x in rows if x[0] == k])
            assert np.allclose(med[k], (np.median(v), np.percentile(v, 95)))
        got = {(r.k, r.id): r.r for r in O.avg_rank(df, ["k"], "v", "r", small=small, ranges=8).collect()}
        for k in "abc":
            v = np.array([x[1] for x in rows if x[0] == k])
            want = [(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v]
            assert np.allclose([got[k, i] for i in range(len(v))], want)


def test_top_k_breaks_ties_by_row_order(spark):
    rows, df = sample(spark)
    k = spark.createDataFrame([("a", 1, 7), ("a", 2, 40), ("b", 1, 300), ("c", 1, 3)], "k string, cost int, k2 int").withColumnRenamed("k2", "kk")
    want = {("a", 1): 7, ("a", 2): 40, ("b", 1): 300, ("c", 1): 3}
    got = O.top_k(df.withColumnRenamed("k", "g"), ["g"], "v", "id", k.select(F.col("k").alias("g"), "cost", F.col("kk").alias("k")), ["cost"]).collect()
    for (g, c), n in want.items():
        best = sorted([(-x[1], x[2]) for x in rows if x[0] == g])[:n]
        assert {(-r.v, r.id) for r in got if r.g == g and r.cost == c} == set(best)


def test_permutation_tables(spark):
    import itertools

    p = [tuple(r.p) for r in permutations(spark, [4]).orderBy("perm").collect()]
    assert p == list(itertools.permutations(range(4)))
    assert label_subsets(spark, [5]).filter("k = 2").count() == 10


def test_package_keeps_data_off_the_driver():
    bad = re.compile(r"toPandas|localCheckpoint|crossJoin|\.collect\(\)|\.rdd\b")
    hits = [f"{p}:{i}" for p in (ROOT / "netcohort").rglob("*.py") for i, line in enumerate(p.read_text().splitlines(), 1) if bad.search(line)]
    assert not hits


def test_every_oracle_has_a_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert len(e.queries()) > 150
