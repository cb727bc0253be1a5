from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spacelens.llm import dart_dedup as dd


def shingle_set(text):
    w = (text or "").split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def true_classes(rows):
    """Least id of each component over equal texts and Jaccard similarity of at least 0.8."""
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    sets = [shingle_set(t) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            if rows[i][1] is None or rows[j][1] is None:
                continue
            a, b = sets[i], sets[j]
            if rows[i][1] == rows[j][1] or (a and b and len(a & b) >= 0.8 * len(a | b)):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return [least.get(find(i)) for i in range(len(rows))]


def edited(rng, words, changes):
    out = list(words)
    for i in rng.sample(range(len(out)), changes):
        out[i] = f"new{rng.randrange(10**6)}"
    return " ".join(out)


def families(seed=2):
    rng = random.Random(seed)
    rows, doc = [], 0
    for f in range(12):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([40, 120, 300]))]
        for c in range(rng.choice([1, 3, 40])):
            text = " ".join(base) if c % 5 == 0 else edited(rng, base, rng.randint(1, max(2, len(base) // 30)))
            rows.append((doc, text))
            doc += 1
    rng.shuffle(rows)
    return rows


def classes(spark, rows, config=dd.DartConfig()):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return {(r["doc_id"], r["class_id"]) for r in dd.classes(df, config).collect()}


def test_classes_equal_brute_force(spark):
    rows = families()
    want = true_classes(rows)
    assert classes(spark, rows) == {(d, c) for (d, _), c in zip(rows, want)}


def test_links_beyond_the_hub_are_found(spark):
    """A chain: each text is near its neighbours only, so no single hub reaches all."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(12):
        rows.append((i, " ".join(words)))
        for k in rng.sample(range(400), 5):
            words[k] = f"x{rng.randrange(10**6)}"
    assert len(set(true_classes(rows))) == 1
    assert {c for _, c in classes(spark, rows, dd.DartConfig(block=4))} == {0}


def test_short_empty_null_and_repeated(spark):
    rows = [(5, "one two"), (6, "one two"), (7, "one two three"), (8, ""), (9, ""), (10, None), (11, None), (None, None), (5, "one two"), (12, " \n")]
    assert classes(spark, rows) == {(5, 5), (6, 5), (7, 7), (8, 8), (9, 8), (10, 10), (11, 11), (None, None), (12, 12)}


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(0)
    e = rng.integers(0, 2**63, 200).astype(np.uint64)
    a = rng.uniform(0.2, 4, 200)
    b = np.where(rng.random(200) < 0.3, rng.uniform(0, 4, 200), a)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    got = []
    for seed in range(30):
        t = dd.dart_times(np.concatenate([e, e]), np.concatenate([a, b]), np.repeat([0, 1], 200), 2, 128, seed)
        assert np.isfinite(t).all()
        got.append((t[0] == t[1]).mean())
    assert abs(np.mean(got) - want) < 0.03


def test_signatures_do_not_depend_on_company():
    rng = np.random.default_rng(1)
    e = rng.integers(0, 2**63, 50).astype(np.uint64)
    alone = dd.dart_times(e[:3], np.ones(3), np.zeros(3, int), 1, 64, 0)
    both = dd.dart_times(e, np.ones(50), np.repeat([0, 1], [3, 47]), 2, 64, 0)
    assert (alone[0] == both[0]).all()


def test_sketches_count_differing_coordinates(spark):
    config = dd.DartConfig()
    rng = np.random.default_rng(2)
    t = rng.random((2, config.coordinates))
    for same, want in ((192, True), (150, True), (110, False), (0, False)):
        pair = t.copy()
        pair[1, :same] = pair[0, :same]
        a, b = (s.view(np.int64).tolist() for s in dd.sketches(pair, config.rows))
        df = spark.createDataFrame([(a, b)], "a array<long>, b array<long>")
        assert df.select(dd.alike("a", "b", config).alias("x")).first()["x"] == want


def test_one_document_of_each_class_stays(spark, messy, no_docs):
    kept = dd.deduplicated(messy)
    assert kept.columns == messy.columns
    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    texts = [t for _, t in rows if t is not None]
    assert len(texts) == len(set(texts))
    assert sum(t is None for _, t in rows) == messy.where("text is null").count()
    assert (107, None) not in [(d, None) for d, _ in rows] and any(d == 1 for d, _ in rows)
    everything = dd.classes(messy)
    assert everything.count() == messy.count()
    assert {t for t in texts} == {
        min((r for r in messy.collect() if r["doc_id"] == c), key=lambda r: r["text"] is None)["text"]
        for c in {r["class_id"] for r in everything.where("node is not null and class_id is not null").collect()}
    } | {r["text"] for r in messy.where("doc_id is null and text is not null").collect()}
    assert dd.deduplicated(no_docs).count() == 0 and dd.classes(no_docs).count() == 0


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["comp"] for r in dd.components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    more = spark.createDataFrame([(40, 101), (7, 200), (300, 301)], "a long, b long")
    got = {r["node"]: r["comp"] for r in dd.merged(dd.components(links), more).collect()}
    assert {got[i] for i in (0, 40, 100, 101, 200)} == {0} and got[300] == got[301] == 300


def test_texts_without_an_id_and_texts_that_share_one_all_stay(spark):
    rng = random.Random(7)
    bases = [[f"q{rng.randrange(5000)}" for _ in range(60)] for _ in range(7)]
    texts = [" ".join(b) for b in bases]
    # 0 and 1 without ids, 2 and 3 under one id; 4 without an id has a copy with one; 5 and its near
    # copy have none; 6 shares the id of 2 and 3 and is near a text with a smaller one.
    rows = [(None, texts[0]), (None, texts[1]), (9, texts[2]), (9, texts[3]), (None, texts[4]), (3, texts[4])]
    rows += [(None, texts[5]), (None, texts[5] + " more"), (9, texts[6]), (4, texts[6] + " more"), (None, texts[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r["doc_id"], r["text"]) for r in dd.deduplicated(df).collect()), key=str)
    lone = [r for r in got if r[1].startswith(texts[5])]
    want = [(None, texts[0]), (None, texts[1]), (9, texts[2]), (9, texts[3]), (3, texts[4]), (4, texts[6] + " more")]
    assert len(lone) == 1 and lone[0][0] is None
    assert [r for r in got if r not in lone] == sorted(want, key=str)


def by_node(spark, texts):
    """(node, text) of the texts, smallest node first."""
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    return sorted((r["node"], r["text"]) for r in df.select(F.xxhash64("text").alias("node"), "text").collect())


def unlike(count):
    return [" ".join(f"u{i}x{k}" for k in range(60)) for i in range(count)]


def linked(spark, texts, bands, config):
    """The components of signatures made by hand: all sketches are equal, ``bands`` gives the keys."""
    sketch = [0] * -(-config.bands // (16 // config.rows))
    n = [len(shingle_set(t)) for _, t in texts]
    rows = [(i, node, n[i], bands[i], sketch) for i, (node, _) in enumerate(texts)]
    signed = spark.createDataFrame(rows, "doc_id long, node long, n int, bands array<long>, sketch array<long>")
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")
    return {frozenset((r["node"], r["comp"])) for r in dd.node_components(docs, signed, config).collect()}


def test_a_pair_is_made_where_keys_agree_not_where_sketches_do(spark):
    config, (*_, second, hub) = dd.DartConfig(), by_node(spark, unlike(40))
    tries = [by_node(spark, [t, t + " more"]) for t in (" ".join(f"p{i}x{k}" for k in range(60)) for i in range(20))]
    x, y = next(p for p in tries if p[1][0] < second[0])
    # x and y share the key of band 5 with the hub; the keys of band 0, which they lead too, differ.
    keys = [[10 * config.bands * i + b for b in range(config.bands)] for i in range(4)]
    keys[3][5] = keys[1][5] = keys[0][5]
    keys[3][0], keys[2][0] = keys[0][0], keys[1][0]
    for b in (8, 9, 10):
        keys[3][b] = keys[2][b]
    assert frozenset((x[0], y[0])) in linked(spark, [x, y, second, hub], keys, config)


@pytest.mark.parametrize("block, shingles", [(1024, 2_000_000), (5, 2_000_000), (1024, 300)])
def test_a_pair_among_many_unlike_texts_of_one_key(spark, block, shingles):
    config, pair = dd.DartConfig(block=block, block_shingles=shingles), " ".join(f"p{k}" for k in range(60))
    texts = by_node(spark, [*unlike(30), pair, pair + " more"])
    near = [i for i, (_, t) in enumerate(texts) if t.startswith(pair)]
    assert near[1] < len(texts) - 1  # the hub, the last node, is neither
    keys = [[7] + [config.bands * (i + 1) + b for b in range(1, config.bands)] for i in range(len(texts))]
    assert frozenset(texts[i][0] for i in near) in linked(spark, texts, keys, config)


def test_shared_counts_and_joining_links():
    rng = np.random.default_rng(5)
    rows = [np.unique(rng.integers(0, 40, 30)) for _ in range(9)]
    owner = np.repeat(np.arange(9), [len(r) for r in rows])
    got = dd._shared(np.concatenate(rows), owner, 9)
    for i in range(9):
        for j in range(i):
            assert got[i, j] == got[j, i] == len(np.intersect1d(rows[i], rows[j]))
    comp = np.array([1, 1, 2, 3, 3, 4, 5, 6, 7])
    links = dd._joining(np.arange(9), comp, np.ones((9, 9), bool))
    assert len(links) == len(set(comp.tolist())) - 1
    assert dd._joining(np.arange(9), comp, np.zeros((9, 9), bool)) == []


def test_the_bit_map_misses_no_node(spark):
    nodes = spark.range(2000).select(F.xxhash64("id").alias("node"))
    bits = dd.node_map(nodes, 10)
    assert len(bits) == 16
    for r in nodes.collect():
        at = r["node"] % 1024
        assert bits[at >> 6] >> (at & 63) & 1
