"""Ranks and order statistics within groups, exact at any group size and by one path.

A group is spread over value bands. A band is a monotone function of the value: rows are counted
per distinct value (ties collapse in the map-side combine), then per band; only the short band
table is accumulated per group, and values are ordered inside one band at a time. Nulls are the
smallest value and a group of their own as keys; NaN is the largest.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BANDS_PER_UNIT = 1000
_LAST = (1 << 63) - 1


def value_band(value: Column) -> Column:
    """floor(sign * ln(1+|v|) * 1000): never decreases with v, at most 1.42 million bands."""
    v = value.cast("double")
    band = F.floor(F.signum(v) * F.log1p(F.abs(v)) * BANDS_PER_UNIT)
    return F.when(F.isnan(v), F.lit(_LAST)).otherwise(band)


def _met(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal or both null columns; the right side's columns of these names go."""
    names = {c: f"_on_{i}" for i, c in enumerate(on)}
    right = right.withColumnsRenamed(names)
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()])
    return left.join(right, same, how).drop(*names.values())


def _counts_below(freq: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``freq`` (keys, value, n) with ``below`` and ``total``."""
    group, start = Window.partitionBy(*keys), Window.unboundedPreceding
    banded = freq.withColumn("_band", value_band(F.col(value)))
    bands = banded.groupBy(*keys, "_band").agg(F.sum("n").alias("_in_band"))
    before = group.orderBy("_band").rowsBetween(start, -1)
    offsets = bands.select(
        *keys,
        "_band",
        F.coalesce(F.sum("_in_band").over(before), F.lit(0)).alias("_offset"),
        F.sum("_in_band").over(group).alias("total"),
    )
    inside = Window.partitionBy(*keys, "_band").orderBy(value).rowsBetween(start, -1)
    return (
        _met(banded, offsets, [*keys, "_band"])
        .withColumn("below", F.col("_offset") + F.coalesce(F.sum("n").over(inside), F.lit(0)))
        .drop("_band", "_offset")
    )


def counts_below(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """One row per (keys, value): ``n`` rows, ``below`` with a smaller value, ``total`` in the group."""
    return _counts_below(df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n")), keys, value)


def rank_desc(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Min-tie rank by ``value`` descending within ``keys``, nulls last."""
    rank = (F.col("total") - F.col("below") - F.col("n") + 1).cast("int")
    ranks = counts_below(df, keys, value).select(*keys, value, rank.alias(name))
    return _met(df, ranks, [*keys, value])


def percentile_rank(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Average-tie rank / rows of the group x 100; 50 and ``constant`` where all values are equal."""
    average = (F.col("below") + (F.col("n") + 1) / 2) / F.col("total") * 100
    constant = F.col("n") == F.col("total")
    ranks = counts_below(df, keys, value).select(
        *keys, value, F.when(constant, 50.0).otherwise(average).alias(name), constant.alias("constant")
    )
    return _met(df, ranks, [*keys, value])


def order_statistics(df: DataFrame, keys: Sequence[str], value: str, positions: dict[str, Column]) -> DataFrame:
    """Values at zero-based positions of the sorted group; positions may use column ``total``."""
    here = [
        F.max(F.when((F.col("below") <= p) & (p < F.col("below") + F.col("n")), F.col(value))).alias(name)
        for name, p in positions.items()
    ]
    return counts_below(df, keys, value).groupBy(*keys, "total").agg(*here)


def interpolated_percentiles(
    df: DataFrame, keys: Sequence[str], value: str, fractions: dict[str, float]
) -> DataFrame:
    """Linearly interpolated percentiles, exact; nulls count as smallest, so leave them out."""
    last = F.col("total") - 1
    positions = {}
    for name, p in fractions.items():
        positions[name + "_lo"] = F.floor(last * p)
        positions[name + "_hi"] = F.ceil(last * p)
    out = []
    for name, p in fractions.items():
        low, high = F.col(name + "_lo").cast("double"), F.col(name + "_hi").cast("double")
        weight = last * p - F.floor(last * p)
        out.append((low + (high - low) * weight).alias(name))
    return order_statistics(df, keys, value, positions).select(*keys, *out)
