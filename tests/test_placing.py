from __future__ import annotations

import random

from pyspark.sql import functions as F

from spacelens.operators.placing import with_positions


def brute(rows):
    """Positions by (value descending, nulls last; id) within each key, nulls being one."""
    out = []
    for key in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is None, -(r[1] or 0), r[2]))
        out += [(*r, k) for k, r in enumerate(own, 1)]
    return sorted(out, key=str)


def test_positions_with_null_keys_and_ties(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, 1.0, 2.0, 2.0, -3.5]), i) for i in range(800)]
    df = spark.createDataFrame(rows, "k string, v double, id long").repartition(5)
    out = with_positions(df, ["k"], [F.desc_nulls_last("v"), F.col("id")], "place")
    assert out.columns == ["k", "v", "id", "place"]
    assert sorted(map(tuple, out.collect()), key=str) == brute(rows)


def test_one_value_in_most_rows_is_split(spark):
    df = spark.range(40_000).select((F.col("id") % 2).alias("k"), F.when(F.col("id") % 9 == 0, F.col("id")).otherwise(7).alias("v"), "id")
    order = [F.desc("v"), F.col("id")]
    ranges = df.repartitionByRange(8, "k", *order).groupBy(F.spark_partition_id()).count().collect()
    sizes = [r["count"] for r in ranges]
    assert max(sizes) <= 2 * sum(sizes) / len(sizes)
    out = with_positions(df, ["k"], order, "place")
    spans = out.groupBy("k").agg(F.min("place"), F.max("place"), F.count_distinct("place")).collect()
    assert sorted(tuple(r) for r in spans) == [(0, 1, 20_000, 20_000), (1, 1, 20_000, 20_000)]


def test_no_keys_and_no_rows(spark):
    df = spark.range(100)
    out = with_positions(df, [], [F.desc("id")], "place")
    assert sorted(map(tuple, out.collect())) == [(i, 100 - i) for i in range(100)]
    assert with_positions(df.limit(0), ["id"], [F.col("id")], "place").collect() == []
