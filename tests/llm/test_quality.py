from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from spacelens.llm import ftrl_quality as fq
from .conftest import sentence


def corpus(spark, n=300):
    rng = random.Random(5)
    docs, labels = [], []
    for i in range(n):
        text = sentence(rng, "en", rng.randint(20, 80))
        good = i % 3 > 0
        if not good:
            text = [text.upper().replace(" ", "!! "), " ".join([text.split()[0]] * 40), text.replace(" ", "%%% ")][i % 9 // 3]
        docs.append((i, text))
        labels.append((i, int(good)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, label int")


def test_held_out_accuracy(spark):
    docs, labels = corpus(spark)
    model = fq.fit(docs, labels, F.col("doc_id") % 4 != 2)
    out = fq.score(docs, model).join(labels, "doc_id").where("doc_id % 4 = 2").collect()
    assert all(0 <= r["quality_score"] <= 1 for r in out)
    assert np.mean([(r["quality_score"] >= 0.7) == r["label"] for r in out]) > 0.95


def test_scores_are_sparse_dot_products():
    config = fq.FtrlConfig(bits=12)
    column = pa.array(["one two two THREE!!", None, "", "a  b\nc", "x"])
    rng = np.random.default_rng(0)
    weights = rng.normal(size=1 << 12)
    got = fq.score_texts(column, weights, 0.3, 12)
    want = [1 / (1 + np.exp(-(weights[i] @ v + 0.3))) for i, v in fq.sparse_rows(column, config.bits)]
    np.testing.assert_allclose(got, want)


def test_features_do_not_cross_rows():
    a = [set(i) for i, _ in fq.sparse_rows(pa.array(["one two", "three four"]), 18)]
    b = [set(i) for i, _ in fq.sparse_rows(pa.array(["one two"]), 18)]
    assert a[0] == b[0] and len(a[0] & a[1]) == 2  # the shapes "a" and "a a" alone


def test_ftrl_is_the_published_update():
    """One coordinate, one example at a time, against the textbook recurrence."""
    config = fq.FtrlConfig(bits=2, epochs=1, l1=0.0, l2=0.5, alpha=0.2, beta=1.0, seed=1)
    rows = [(np.array([0]), np.array([1.0])), (np.array([1]), np.array([2.0]))]
    labels = np.array([1, 0])
    w, bias = fq.fit_ftrl(rows, labels, config)
    z, n = np.zeros(3), np.zeros(3)
    weight = lambda i: -z[i] / ((1 + np.sqrt(n[i])) / 0.2 + 0.5)
    for r in np.random.default_rng(1).permutation(2):
        x = {r: 1.0 + r, 2: 1.0}
        p = 1 / (1 + np.exp(-sum(weight(i) * v for i, v in x.items())))
        steps = {i: (p - labels[r]) * v for i, v in x.items()}
        for i, g in steps.items():
            old = weight(i)
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / 0.2 * old
            n[i] += g * g
    np.testing.assert_allclose([w[0], w[1], bias], [weight(0), weight(1), weight(2)])


def test_labels_that_contradict_or_miss(spark, messy, no_docs):
    labels = spark.createDataFrame(
        [(0, 1), (0, 0), (1, 1), (2, None), (None, 1), (3, 0), (3, 0), (999, 1)], "doc_id long, label int"
    )
    config = fq.FtrlConfig(docs_per_label=10)
    sample = fq.labelled_sample(messy.select("doc_id", "text"), labels, F.lit(True), config).collect()
    assert {r["label"] for r in sample} == {0, 1} and len(sample) == 2
    model = fq.fit(messy, labels, F.lit(True), config)
    out = fq.score(messy, model)
    assert out.columns == [*messy.columns, "quality_score"] and out.count() == messy.count()
    assert fq.score(no_docs, model).count() == 0
    none = fq.fit(no_docs, labels, F.lit(True), config)
    assert {r["quality_score"] for r in fq.score(messy, none).collect()} == {0.5}
