"""Column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-9


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / (b + 1e-9): never divides by zero for b >= 0."""
    return col(a) / (col(b) + F.lit(EPS))


def over(a: Column | str, b: Column | str) -> Column:
    """a / b, null where b is 0."""
    return col(a) / F.nullif(col(b).cast("double"), F.lit(0.0))


def whole_days(earlier: Column | str, later: Column | str) -> Column:
    """Elapsed whole days, rounded down also below zero (18 hours early is -1)."""
    micros = F.timestamp_diff("MICROSECOND", col(earlier), col(later))
    return F.floor(micros / F.lit(86_400_000_000)).cast("long")


def percentile(x: Column | str, p: float, exact: bool = True) -> Column:
    """Linear interpolation between order statistics; exact=False bounds the state of very large groups."""
    return F.percentile(col(x), F.lit(p)) if exact else F.percentile_approx(col(x), p, 10_000)
