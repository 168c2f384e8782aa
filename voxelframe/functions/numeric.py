"""Small Column helpers shared by the feature formulas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 2.220446049250313e-16  # spacing of doubles at 1.0; added inside every log2


def r6(col: Column, digits: int = 6) -> Column:
    """Rounded for comparison: nudged off exact ties, fewer decimals for large values."""
    a = F.abs(col)
    return (F.when(a < 1e4, F.round(col + F.lit(10.0 ** -(digits + 4)), digits))
            .when(a < 1e8, F.round(col + F.lit(1e-5), 2)).otherwise(F.round(col + F.lit(0.01), 0)))


def plogp(p: Column) -> Column:
    """p * log2(p + eps)."""
    return p * F.log2(p + F.lit(EPS))


def ratio(a: Column, b: Column) -> Column:
    """a / b with 0 where b is 0."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def over(a: Column, b: Column) -> Column:
    """a / b of a positive a, infinite where b is 0 (as doubles divide)."""
    return F.when(b == 0, F.lit(float("inf"))).otherwise(a / b)


def clamp(col: Column, lo, hi) -> Column:
    return F.least(F.greatest(col, F.lit(lo)), F.lit(hi))
