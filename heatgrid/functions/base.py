"""Null-safe column helpers shared by the function modules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def no_nan(c: Column | str) -> Column:
    """Turn NaN into NULL; Spark sorts NaN above every number otherwise."""
    c = col(c)
    return F.when(~F.isnan(c), c)


def at_least(c: Column | str, low) -> Column:
    """max(c, low) that stays NULL when either side is NULL."""
    c, low = col(c), _lift(low)
    return F.when(c.isNotNull() & low.isNotNull(), F.greatest(c, low))


def at_most(c: Column | str, high) -> Column:
    """min(c, high) that stays NULL when either side is NULL."""
    c, high = col(c), _lift(high)
    return F.when(c.isNotNull() & high.isNotNull(), F.least(c, high))


def clip(c: Column | str, low: float, high: float) -> Column:
    c = col(c)
    return F.when(c < F.lit(float(low)), F.lit(float(low))).when(c > F.lit(float(high)), F.lit(float(high))).otherwise(c)


def band(c: Column | str, edges: list[tuple[float, str]], default: str) -> Column:
    """Highest label whose lower edge the value reaches; NULL gets the default."""
    c = col(c)
    ordered = sorted(edges, key=lambda e: -e[0])
    chain = F
    for edge, label in ordered:
        chain = chain.when(c >= F.lit(float(edge)), F.lit(label))
    return chain.otherwise(F.lit(default))


def polynomial(x: Column, coefficients: list[float]) -> Column:
    """Horner evaluation, constant term first."""
    return reduce(lambda acc, k: acc * x + F.lit(float(k)), reversed(coefficients[:-1]), F.lit(float(coefficients[-1])))


def _lift(v) -> Column:
    return v if isinstance(v, Column) else F.lit(float(v))
