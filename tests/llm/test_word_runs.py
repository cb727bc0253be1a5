from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spacelens.llm import word_runs as wr
from spacelens.llm.queries import run_digests


def brute(words, min_length=6, exponent=4):
    """Every maximal stretch of every period; the smallest period of a stretch counts."""
    n, found = len(words), {}
    for q in range(1, n // exponent + 1):
        start = 0
        for i in range(q, n + 1):
            if i == n or words[i] != words[i - q]:
                if i - start >= max(min_length, exponent * q):
                    found.setdefault((start, i), q)
                start = i - q + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def coded(words):
    number = {}
    return np.array([number.setdefault(w, len(number)) for w in words], np.int64)


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def thue_morse(n):
    return ["ab"[bin(i).count("1") % 2] for i in range(n)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("abc", max_size=70), max_size=5))
def test_equals_brute_force(texts):
    assert wr.runs_of([coded(t) for t in texts]) == [brute(t) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.text("ab", min_size=1, max_size=6), st.integers(1, 9)), max_size=8))
def test_repeated_pieces(parts):
    text = "".join(p * n for p, n in parts)
    for config in (wr.RunConfig(), wr.RunConfig(2, 2), wr.RunConfig(7, 3)):
        got = wr.runs_of([coded(text)], config)[0]
        assert got == brute(text, config.min_length, config.min_exponent)


def test_structured_texts():
    texts = [fibonacci(300), thue_morse(512), "a" * 400, ["x", "y"] * 200 + ["x", "x"] * 90, list("abcd") * 4 + list("abc")]
    assert wr.runs_of([coded(t) for t in texts]) == [brute(t) for t in texts]
    assert wr.runs_of([]) == []


def test_arrays_are_as_defined():
    rng = random.Random(3)
    text = [rng.choice("ab") for _ in range(200)]
    words = np.append(coded(text) + 1, 0)
    sa, isa = wr.suffix_array(words)
    suffixes = sorted(range(201), key=lambda i: words[i:].tolist())
    assert sa.tolist() == suffixes and [isa[i] for i in sa] == list(range(201))
    lcp = wr.lcp_table(words, sa, isa, shallow=2)
    for r in range(1, 201):
        a, b = words[sa[r - 1] :].tolist(), words[sa[r] :].tolist()
        assert lcp[r] == next(k for k in range(201) if a[k : k + 1] != b[k : k + 1])


def test_a_long_run_takes_linear_time():
    same = np.zeros(200_000, np.int64)
    assert wr.runs_of([same])[0] == [(0, 200_000, 1)]
    pairs = np.tile(np.arange(1000), 200)
    assert wr.runs_of([pairs])[0] == [(0, 200_000, 1000)]


def expected(doc_id, text):
    words = [w for w in wr_split(text)]
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words) if n < 3000 else wr.runs_of([coded(words)])[0]
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    dropped = {i for s, m, q in runs for i in range(s + q, s + m)}
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    exponent = None if best[1] is None else 1000 * best[1] // best[2]
    return (doc_id, len(runs), *best, exponent, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(kept))


def wr_split(text):
    return [] if text is None else [w for w in __import__("re").split("[ \t-\r]+", text) if w]


def test_query_equals_brute_force(spark, messy, messy_rows, tmp_path):
    extra = [(1000 + i, "so it goes " * (i % 7) + "and on " * i, "en", "s", 1) + messy_rows[0][5:] for i in range(40)]
    docs = messy.unionAll(spark.createDataFrame(extra, messy.schema))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in run_digests(spark, str(tmp_path)).collect()]
    want = [expected(r[0], r[1]) for r in [*messy_rows, *extra]]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert any(r[1] for r in got)


def test_empty_table_and_types(spark, no_docs, tmp_path):
    no_docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = run_digests(spark, str(tmp_path))
    assert out.dtypes == [
        ("doc_id", "bigint"), ("n_runs", "bigint"), ("start", "bigint"), ("length", "bigint"),
        ("period", "bigint"), ("exponent_milli", "bigint"), ("runs_sha256", "string"), ("collapsed_sha256", "string"),
    ]
    assert out.collect() == []


def test_carried_columns_and_whole_output(spark):
    rows = [("k", "a b " * 6 + "c", 5), ("k", None, None)]
    docs = spark.createDataFrame(rows, "runs string, text string, collapsed int")
    out = wr.periodic_runs(docs, carry=("runs", "collapsed"))
    got = {tuple(r) for r in out.toDF("r", "c", "n", "found", "kept").selectExpr("r", "c", "n", "to_json(found)", "kept").collect()}
    assert got == {("k", 5, 13, '[{"start":0,"length":12,"period":2}]', "a b c"), ("k", None, 0, "[]", "")}


@pytest.mark.parametrize("n, g", [(1, 0), (7, 3), (20, 19), (100, 8)])
def test_loops(n, g):
    at = wr.looped(n, g).tolist()
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    assert at == [i if i < a else a + (i - a) % p for i in range(n)]
