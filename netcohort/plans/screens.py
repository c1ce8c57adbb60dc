"""Clinical screens built from the exact-inference operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import inference as P
from ..session import cut


def clinical_screen(features: DataFrame, outcomes: DataFrame, keys: list[str], x: str = "x") -> DataFrame:
    """Per endpoint: exact family, BH, maxT and the leave-one-out range."""
    ek = ["endpoint", *keys]
    cases = P.complete_cases(features, outcomes, keys, x)
    loo = P.leave_one_out(P.valid_tests(cases).select(*cases.columns), keys).groupBy(*ek).agg(
        F.min("loo_rho").alias("loo_min"), F.max("loo_rho").alias("loo_max")
    )
    return cut(P.exact_family(features, outcomes, keys, None, x)).join(loo, ek)


def dual_family(features: DataFrame, outcomes: DataFrame, keys: list[str], x: str = "x") -> DataFrame:
    """Familywise p over every test and per endpoint, with same-sign counts."""
    ek = ["endpoint", *keys]
    tests = cut(P.valid_tests(P.complete_cases(features, outcomes, keys, x)).withColumn("every", F.lit("all")))
    nulls = P.shared_nulls(tests)
    p = nulls.groupBy(*ek).agg(F.first("rho").alias("rho"), P.share(P.ge(F.abs("null"), F.abs("rho"))).alias("p"))
    small = tests.select("every", *ek, "rho")
    both = P.max_t(nulls, small, ["every"], out="p_fwe").drop("rho", "every")
    each = P.max_t(nulls, small.drop("every"), ["endpoint"], out="p_fwe_endpoint").drop("rho")
    sign = tests.select(*ek, F.greatest(F.size(F.filter("xs", lambda v: v > 0)), F.size(F.filter("xs", lambda v: v < 0))).alias("same_sign"))
    return p.join(both, ek).join(each, ek).join(sign, ek)
