from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from spacelens.llm import curriculum as cu


def brute_targets(sizes, config):
    """Share by weight, stop at the cap, share the excess again until nothing is above."""
    names = sorted((s for s in sizes if s is not None), key=str.encode) + ([None] if None in sizes else [])
    weight = {s: config.weights[i % len(config.weights)] for i, s in enumerate(names)}
    left, target, open_ = config.share * sum(sizes.values()), {}, set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if config.most * sizes[s] <= level * weight[s]}
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        for s in full:
            target[s] = float(config.most * sizes[s])
            left -= target[s]
        open_ -= full
    return target


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_targets_and_taken_words(messy, messy_rows):
    sizes = {}
    for r in messy_rows:
        sizes[r[3]] = sizes.get(r[3], 0) + words(r[1])
    want = brute_targets(sizes, cu.MixConfig())
    out = cu.mix_plan(messy).collect()
    assert len(out) == len(messy_rows)
    taken = dict.fromkeys(sizes, 0)
    for r in out:
        assert r["target"] == pytest.approx(want[r["source"]])
        assert r["source_size"] == sizes[r["source"]]
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[r["source"]] += r["taken"]
    for s, n in taken.items():
        # Half of the document at which the demand ends: a long one only where nothing else is left.
        assert abs(n - want[s]) <= 0.5 + max(r["size"] for r in out if r["source"] == s) / 2


def test_long_documents_stay_away_from_the_end_of_the_demand(spark):
    rows = [(i, "w " * (3000 if i % 20 == 0 else 300), f"s{i % 3}") for i in range(900)]
    out = cu.mix_plan(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for s in ("s0", "s1", "s2"):
        own = [r for r in out if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 151


def test_reruns_agree(messy):
    key = lambda r: (str(r["doc_id"]), r["size"], r["taken"], str(r["position"]))
    a, b = (sorted(map(key, cu.mix_plan(df).collect())) for df in (messy, messy.repartition(7)))
    assert a == b


def test_positions_invert_the_demand(spark):
    rows = [(u / 50, s) for u in range(1, 50) for s in (-0.9, -0.6, 0.0, 0.6, 1.0)]
    df = spark.createDataFrame(rows, "u double, slope double")
    for r in df.select("*", cu.inverse_demand(F.col("u"), F.col("slope")).alias("t")).collect():
        assert r["t"] + r["slope"] * (r["t"] ** 2 - r["t"]) == pytest.approx(r["u"])


def test_early_sources_come_early(spark):
    rows = [(i, "a b c d", s) for i in range(300) for s in ("a", "c")] + [(i, "w x", "b") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mean = dict(cu.mix_plan(df).groupBy("source").agg(F.avg("position")).collect())
    assert mean["a"] < 0.5 < mean["c"]


def test_stream_has_each_reading_in_order(messy):
    plan = {(str(r["doc_id"]), r["source"]): 0 for r in cu.mix_plan(messy).collect()}
    for r in cu.mix_plan(messy).collect():
        plan[(str(r["doc_id"]), r["source"])] += r["taken"]
    stream = cu.mixed_documents(messy)
    texts = {r["text"] for r in messy.collect()}
    assert stream.columns == messy.columns
    got = dict.fromkeys(plan, 0)
    for r in stream.collect():
        assert r["n_chars"] == len(r["text"]) and r["text"] in texts
        got[(str(r["doc_id"]), r["source"])] += words(r["text"])
    assert got == plan


def test_sources_without_words_and_empty_tables(spark, no_docs):
    df = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert [(r["taken"], r["target"]) for r in cu.mix_plan(df).collect()] == [(0, 0.0)] * 2
    assert cu.mix_plan(no_docs).count() == 0 and cu.mixed_documents(no_docs).count() == 0
