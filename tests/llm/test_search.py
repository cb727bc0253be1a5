from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from spacelens.llm import cover_search as cs


def brute(rows, k=5, every=50):
    clean = [
        (i, [int(np.floor(256 * float(x))) for x in v])
        for i, v in rows
        if v is not None and all(x is not None and np.isfinite(x) for x in v)
    ]
    out = set()
    for q, a in clean:
        if q is None or q % every:
            continue
        scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in clean if i != q and len(a) == len(b))
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])}
    return out


def found(spark, rows, config=cs.SearchConfig(), every=50):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    return {tuple(r) for r in cs.top_k(df, F.col("vec_id") % every == 0, config).collect()}


def test_equals_brute_force_on_clusters(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(0, 1, (6, 8))
    rows = [(i, (centres[i % 6] + rng.normal(0, 0.1, 8)).tolist()) for i in range(900)]
    config = cs.SearchConfig(pivots=8, sample=100, block=100, leaf=8)
    assert found(spark, rows, config) == brute(rows)


def test_ties_and_one_very_common_vector(spark):
    rows = [(i, [0.5, 0.25, -1.0]) for i in range(400)] + [(400 + i, [0.5, 0.25 + i % 3, -1.0]) for i in range(60)]
    config = cs.SearchConfig(pivots=4, sample=50, block=64, leaf=4)
    assert found(spark, rows, config) == brute(rows)


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (50, [1.0, nan]), (100, None), (150, [inf, 1.0]), (200, [None, 1.0]), (250, [3.0]), (1, [2.0, 2.0]), (2, [2.0]), (300, []), (3, [])]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == set()


def test_few_candidates_and_large_numbers(spark):
    rows = [(0, [1e6, -1e6]), (1, [2e6, 1.0]), (50, [-1e7, 3.0])]
    assert found(spark, rows) == brute(rows)


def test_nodes_cover_their_rows():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 1, (300, 5)), np.zeros((50, 5))])

    def walk(node):
        away = np.sqrt(((x[node.rows] - node.centre) ** 2).sum(axis=1))
        assert away.max() <= node.radius
        if node.children:
            assert sorted(np.concatenate([c.rows for c in node.children])) == sorted(node.rows)
            for c in node.children:
                walk(c)

    walk(cs.cover_tree(x, 10))


def test_pruning_skips_work():
    rng = np.random.default_rng(2)
    x = (np.repeat(rng.normal(0, 50, (20, 6)), 50, axis=0) + rng.normal(0, 1, (1000, 6))).astype(np.int64)
    met = []
    real = cs.products
    cs.products = lambda a, b: met.append(len(a) * len(b)) or real(a, b)
    try:
        ids = np.arange(1000)
        best = cs.dual_search(ids[:100], x[:100], np.full(100, -np.inf), ids, x, 5, 16)
    finally:
        cs.products = real
    assert sum(met) < 60_000
    scores = x[:100] @ x.T
    for i, own in enumerate(best):
        want = sorted(((-s, j) for j, s in enumerate(scores[i]) if j != i))[:5]
        assert sorted((-s, -j) for s, j in own) == [(s, j) for s, j in want]


def test_rows_without_an_id_take_no_part(spark):
    rows = [(0, [1.0, 2.0]), (None, [9.0, 9.0]), (1, [2.0, 2.0]), (50, [0.5, 0.5]), (None, None)]
    assert found(spark, rows) == brute([r for r in rows if r[0] is not None])


def test_products_that_leave_64_bits_are_refused():
    big = np.full((1, 2), 3 * 10**9, np.int64)
    with pytest.raises(OverflowError):
        cs.products(big, big)
    assert cs.products(big // 2, big // 2).tolist() == [[2 * (15 * 10**8) ** 2]]
