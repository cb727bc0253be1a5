from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from spacelens.llm import importance as im
from spacelens.llm.queries import importance_draw

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, longest=1):
    text = "" if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = WORDS.findall(text)
    runs = [" ".join(words[i : i + r]) for r in range(1, longest + 1) for i in range(len(words) - r + 1)]
    return words, [zlib.crc32(f.encode()) % 10000 for f in runs]


def brute(docs, target, percent=10, least=20, longest=1):
    """Multiset of (doc_id, n_features, weight, score, rank) by the definition."""
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(features(text, longest)[1])
    for text in target:
        t.update(features(text, longest)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000))))
    rows = []
    for doc_id, text in docs:
        words, own = features(text, longest)
        weight = sum(map(gain, own)) // len(own) if own else 0
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((doc_id, len(own), weight, score, len(words) >= least))
    rows.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    k = percent * sum(r[4] for r in rows) // 100
    out, rank = Counter(), 0
    for r in rows:
        wins = r[4] and rank < k
        rank += wins
        out[(*r[:4], rank if wins else None)] += 1
    return out


def found(df):
    return Counter(tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect())


TARGET = ["The river and the stone market", "winter PAPER morning 42", None, "", "Größe garden"]


@pytest.fixture
def target(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TARGET)], "item_id long, text string")


@pytest.mark.parametrize("percent, least, longest, pivots", [(10, 20, 1, 64), (50, 1, 1, 3), (100, 0, 3, 2), (1, 20, 1, 64)])
def test_equals_brute_force(spark, messy, messy_rows, target, percent, least, longest, pivots):
    config = im.ResampleConfig(percent=percent, least_words=least, longest=longest, pivots=pivots)
    got = found(im.resampled(messy, target, config))
    assert got == brute([r[:2] for r in messy_rows], TARGET, percent, least, longest)


def test_one_key_in_most_rows(spark, target):
    rows = [(7, "river stone " * 15)] * 300 + [(None, "market river " * 12)] * 200 + [(i, f"w{i} garden " * 11) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = found(im.resampled(docs, target, im.ResampleConfig(percent=60, pivots=4)))
    assert got == brute(rows, TARGET, 60)


def test_whole_documents_can_be_carried(spark, messy, target):
    out = im.resampled(messy, target, im.ResampleConfig(percent=30), carry=["key", "text", "n_chars"])
    assert out.columns == ["key", "text", "n_chars", "n_features", "weight", "score", "rank"]
    ranks = sorted(r.rank for r in out.where("rank is not null").collect())
    assert ranks == list(range(1, len(ranks) + 1)) and ranks
    assert out.count() == messy.count()


def test_empty_tables(spark, no_docs, target, messy, messy_rows):
    assert im.resampled(no_docs, target).collect() == []
    empty = target.limit(0)
    assert found(im.resampled(messy, empty)) == brute([r[:2] for r in messy_rows], [])


def test_kth_key_is_exact(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 101).alias("a"), "id")
    want = sorted((r.a, r.id) for r in rows.collect())
    key = F.struct("a", "id")
    for k in (1, 2, 499, 500, 999, 1000):
        assert tuple(im.kth_key(rows, key, k, 8)) == want[k - 1]


def test_query_over_given_tables(spark, messy, messy_rows, target, tmp_path):
    messy.write.parquet(f"{tmp_path}/documents.parquet")
    target.write.parquet(f"{tmp_path}/benchmark.parquet")
    out = importance_draw(spark, str(tmp_path))
    assert out.dtypes == [("doc_id", "bigint"), ("n_features", "bigint"), ("weight", "bigint"), ("score", "bigint"), ("rank", "bigint")]
    assert found(out) == brute([r[:2] for r in messy_rows], TARGET)
