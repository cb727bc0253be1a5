"""Guarded ratios and growth rates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spacelens.config import EPS

GROWTH_LOW, GROWTH_HIGH = -1.0, 3.0


def _d(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def clip(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def safe_ratio(numerator, denominator) -> Column:
    """numerator / denominator, 0 where the denominator is (almost) zero or either is null."""
    n, d = _d(numerator), _d(denominator)
    return F.coalesce(F.when(F.abs(d) > EPS, n / d), F.lit(0.0))


def growth(later, earlier) -> Column:
    """later/earlier - 1 clipped to [-1, 3]; 0 where there is no earlier value."""
    raw = F.when(F.abs(_d(earlier)) > EPS, safe_ratio(later, earlier) - 1.0).otherwise(0.0)
    return clip(raw, GROWTH_LOW, GROWTH_HIGH)


def cagr(later, earlier, years: float) -> Column:
    """Compound annual rate; 0 (not -1) where the ratio is not positive."""
    ratio = safe_ratio(later, earlier)
    raw = F.when(ratio > EPS, F.pow(ratio, F.lit(1.0 / years)) - 1.0).otherwise(0.0)
    return clip(raw, GROWTH_LOW, GROWTH_HIGH)


def plain_growth(later, earlier) -> Column:
    """later/earlier - 1 without a clip; 0 where there is no earlier value."""
    return F.coalesce(F.when(F.abs(_d(earlier)) > EPS, _d(later) / _d(earlier) - 1.0), F.lit(0.0))
