"""Finite-only arithmetic: a missing or non-finite input gives null, never an error or an infinity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def is_finite(x: Column | str) -> Column:
    x = col(x)
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def finite(x: Column | str) -> Column:
    """The value, or null where it is NaN or infinite."""
    return F.when(is_finite(x), col(x))


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b; null where b is zero or either is missing."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def simple_return(last: Column | str, before: Column | str) -> Column:
    return ratio(col(last) - col(before), before)


def percent_change(last: Column | str, before: Column | str) -> Column:
    """Change in per cent of the magnitude of the earlier value."""
    return 100 * ratio(col(last) - col(before), F.abs(col(before)))


def metric(value: Column, *reasons: tuple[Column, str]) -> Column:
    """``{value, reason}``: the first reason whose condition holds explains a null; else the value without a reason."""
    why = F.lit(None).cast("string")
    for condition, name in reversed(reasons):
        why = F.when(condition, name).otherwise(why)
    return F.struct(F.when(why.isNull(), value).alias("value"), why.alias("reason"))


def return_metric(last: Column | str, before: Column | str) -> Column:
    """Simple return with the reason why it is missing."""
    a, b = col(last), col(before)
    return metric(simple_return(a, b), (a.isNull() | b.isNull(), "missing_data"), (~is_finite(a) | ~is_finite(b), "non_finite"), (b == 0, "zero_denominator"))


def pearson(x: Column | str, y: Column | str, least: int = 2) -> Column:
    """Correlation from sums over rows where both are finite; null for fewer than ``least`` pairs or a constant side.

    ``corr`` raises on a constant column in ANSI mode.
    """
    both = is_finite(x) & is_finite(y)
    a, b = F.when(both, col(x)), F.when(both, col(y))
    n = F.count(a)
    covariance = F.sum(a * b) - F.sum(a) * F.sum(b) / n
    spread = (F.sum(a * a) - F.sum(a) * F.sum(a) / n) * (F.sum(b * b) - F.sum(b) * F.sum(b) / n)
    return F.when((n >= least) & (spread > 1e-24), F.try_divide(covariance, F.sqrt(F.greatest(spread, F.lit(0.0)))))


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def band(x: Column | str, *cuts: tuple[float, str], otherwise: str) -> Column:
    """Name of the first cut that the value reaches, from the highest down; null stays null."""
    out = F.lit(otherwise)
    for least, name in sorted(cuts):
        out = F.when(col(x) >= least, name).otherwise(out)
    return F.when(col(x).isNotNull(), out)


def sign_state(change: Column | str, tolerance: float | Column, names: tuple[str, str, str] = ("rising", "falling", "stable")) -> Column:
    """Direction of a change outside a dead band."""
    c = col(change)
    return F.when(c.isNull(), None).when(c > tolerance, names[0]).when(c < -(tolerance if isinstance(tolerance, Column) else F.lit(tolerance)), names[1]).otherwise(names[2])
