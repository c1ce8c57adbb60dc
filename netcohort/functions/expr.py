"""Column expressions shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

AXES = ("g1", "g2", "g3", "g4")


def r6(col: Column | str, digits: int = 6) -> Column:
    """Round and fold the negative zero away, so results compare as values."""
    col = F.col(col) if isinstance(col, str) else col
    return F.round(col, digits) + F.lit(0.0)


def checked(value: Column, ok: Column, message: str) -> Column:
    """``value`` where ``ok`` holds; otherwise the query that reads it fails with the message."""
    return F.when(F.coalesce(ok, F.lit(False)), value).otherwise(F.raise_error(F.lit(message)))


def norm(parts: list[Column]) -> Column:
    return F.sqrt(reduce(lambda a, b: a + b, [p * p for p in parts]))


def finite(col: Column) -> Column:
    return col.isNotNull() & ~F.isnan(col) & (F.abs(col) != F.lit(float("inf")))


def sum_expr(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def det3(m: list[Column]) -> Column:
    """Determinant of a row-major 3x3 given as nine columns."""
    a, b, c, d, e, f, g, h, i = m
    return a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)


# Bounded arrays: one entry per subject of a cohort, 8 at most by contract.
MAX_SUBJECTS = 8


def array_avg_ranks(x: Column) -> Column:
    """Average ranks of a small array (one value per subject)."""
    return F.transform(
        x,
        lambda v: F.size(F.filter(x, lambda o: o < v)) + (F.size(F.filter(x, lambda o: o == v)) + 1) / 2.0,
    )


def array_unit_ranks(x: Column) -> Column:
    """Centred average ranks with unit length; null when all values agree."""
    n = F.size(x)
    centred = F.transform(array_avg_ranks(x), lambda r: r - (n + 1) / 2.0)
    return unit_length(centred)


def unit_length(x: Column) -> Column:
    length = F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v))
    return F.when(length > 0, F.transform(x, lambda v: v / length))


def permuted_dot(fixed: Column, moved: Column, order: Column) -> Column:
    """sum_s moved[order[s]] * fixed[s], unrolled so it stays inside codegen."""
    terms = [
        F.coalesce(F.get(moved, F.get(order, F.lit(s))) * F.get(fixed, F.lit(s)), F.lit(0.0))
        for s in range(MAX_SUBJECTS)
    ]
    return sum_expr(terms)
