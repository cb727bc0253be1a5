"""Positions in sorted groups of any size: ranges, counts, prefix sums."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spacelens.sources.stage import stage

#: monotonically_increasing_id has the partition above this many bits, the row in it below.
_ROW_BITS = 33


def with_positions(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """``df`` with each row's position, from 1, in the sort by ``order`` within its ``keys``.

    The rows are dealt into ranges of (keys, order), whatever the size of a group, and written
    sorted. A row's place in its range is then its row number there; what lies before the range
    comes from one count for each (range, group) that meet. Only that short table is accumulated.
    End ``order`` with columns that tell rows apart: rows equal in all of it share one range, and
    their order among each other is arbitrary. Null keys are groups of their own.
    """
    keys = list(keys)
    ranged = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    rows = stage(ranged.withColumn("_at", F.monotonically_increasing_id()), "positions")
    rows = rows.withColumn("_range", F.shiftright("_at", _ROW_BITS))
    ranges = rows.groupBy(*keys, "_range").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_n").over(earlier), F.lit(0))
    names = {c: f"_on_{i}" for i, c in enumerate([*keys, "_range"])}
    shifts = ranges.select(*[F.col(c).alias(n) for c, n in names.items()], (before - F.col("_first")).alias("_shift"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()])
    place = F.col("_at") + F.col("_shift") + 1
    return rows.join(shifts, same).withColumn(name, place).drop(*names.values(), "_range", "_at", "_shift")
