from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spacelens.llm import nn_descent as nd

SMALL = nd.GraphConfig(neighbours=12, reverse=12, leaf=24, rounds=3, beam=64, opened=32, hops=4)


def usable(i, v):
    return i is not None and bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)


def cosine(a, b):
    a, b = np.asarray(a, float), np.asarray(b, float)
    a, b = a / np.abs(a).max(), b / np.abs(b).max()
    return float(a @ b / np.sqrt((a @ a) * (b @ b)))


def brute(rows, k=5, every=50):
    rows = [(i, tuple(v)) for i, v in rows if usable(i, v)]
    out = {}
    for q, a in {r for r in rows if r[0] % every == 0}:
        near = sorted((-round(cosine(a, b), 9), i) for i, b in rows if i != q and len(a) == len(b))
        out[q] = [(i, -s) for s, i in near[:k]]
    return out


def found(spark, rows, config=SMALL, every=50):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, node int, score string").repartition(3)
    out = {}
    for q, rank, i, s in nd.nearest(df, F.col("vec_id") % every == 0, config).collect():
        out.setdefault(q, {})[rank] = (i, s)
    assert all(sorted(own) == list(range(1, len(own) + 1)) for own in out.values())
    return {q: [own[r] for r in sorted(own)] for q, own in out.items()}


def same(got, want):
    assert got.keys() == want.keys()
    for q in got:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]], abs=1e-8)


def test_small_tables_are_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=5).tolist()) for i in range(20)]
    same(found(spark, rows, every=3), brute(rows, every=3))
    same(found(spark, rows[:3], every=1), brute(rows[:3], every=1))


@pytest.mark.parametrize("kind", ["even", "clusters"])
def test_recall_and_scores(spark, kind):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 16)) * (kind == "clusters")
    rows = [(i, (3 * centres[i % 30] + rng.normal(size=16)).tolist()) for i in range(3000)]
    got, want = found(spark, rows), brute(rows)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    vectors = dict(rows)
    for q, own in got.items():
        assert [s for _, s in own] == pytest.approx([cosine(vectors[q], vectors[i]) for i, _ in own], abs=1e-12)
        assert own == sorted(own, key=lambda r: (-r[1], r[0])) and len(own) == 5


def test_one_very_common_vector(spark):
    rng = np.random.default_rng(3)
    common = rng.normal(size=8).tolist()
    rows = [(i, common) for i in range(600)] + [(i, rng.normal(size=8).tolist()) for i in range(600, 660)]
    got, want = found(spark, rows), brute(rows)
    for q in range(0, 600, 50):
        assert got[q] == [(i, pytest.approx(1.0)) for i in ([1, 2, 3, 4, 5] if q == 0 else [0, 1, 2, 3, 4])]
    same(got, want)


def test_rows_that_take_no_part_and_repeats(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0]), (50, [1.0, nan]), (100, None), (150, [inf, 1.0]), (200, [None, 1.0]), (250, [0.0, 0.0]),
        (300, []), (None, [1.0, 2.0]), (350, [3.0]), (1, [2.0, 2.0]), (1, [2.0, 2.0]), (0, [1.0, 2.0]),
        (2, [2.0]), (3, [-1.0, 0.5]), (400, [2.0, 4.0]), (5, [-0.0, 1.0]), (6, [0.0, 1.0]),
    ]
    same(found(spark, rows), brute(rows))
    assert found(spark, []) == {}


def test_extreme_numbers(spark):
    rows = [(0, [1e300, 2e300]), (1, [1e-300, 2.1e-300]), (2, [1.0, -1.0]), (50, [3e-310, 1e-310])]
    same(found(spark, rows), brute(rows))
