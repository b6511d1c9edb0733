"""Column helpers that stay inside Catalyst."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: Column | str) -> Column:
    """The value when it is a finite number, else NULL (NaN compares above infinity, so one test does)."""
    c = as_col(c)
    return F.when(F.abs(c) < float("inf"), c)


def finite_or_zero(c: Column | str) -> Column:
    return F.coalesce(finite(c), F.lit(0.0))


def clip(c: Column | str, lo: float, hi: float) -> Column:
    """Saturate to [lo, hi]; NULL stays NULL (greatest/least skip NULLs)."""
    c = as_col(c)
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(float(lo))), F.lit(float(hi))))


def ratio(a: Column | str, b: Column | str) -> Column:
    """Division giving NULL on a zero denominator (ANSI `/` raises)."""
    return F.try_divide(as_col(a), as_col(b))


def sigmoid(c: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-c))


def equi(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Equi-join that also matches NULL keys, keeping the left key columns once."""
    renamed = right.select(
        *[F.col(k).alias(f"__r_{k}") for k in on],
        *[F.col(c) for c in right.columns if c not in on],
    )
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in on])
    joined = left.join(renamed, cond, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"__r_{k}" for k in on])
