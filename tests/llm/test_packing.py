from __future__ import annotations

import zlib

import numpy as np

from spacelens.llm import vector_pack as vp


def check(out, rows, shards=16):
    assert len(out) == len(rows)
    for r in out:
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < shards
    for s in range(shards):
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sum(r["shard"] == s for r in out)))


def test_messy_documents(messy, messy_rows, no_docs):
    out = vp.shard_table(messy).collect()
    check(out, messy_rows)
    want = sorted(
        (str(i), len((t or "").encode()) + 1, None if t is None else zlib.crc32(t.encode())) for i, t, *_ in messy_rows
    )
    key = lambda x: (x[0], x[1], str(x[2]))
    assert sorted(((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in out), key=key) == sorted(want, key=key)
    assert vp.shard_table(no_docs).count() == 0


def test_a_hot_group_is_cut_and_balance_holds(spark):
    rows = [(i, "the same text for many rows") for i in range(700)]
    rows += [(1000 + i, f"another text {i} " * (1 + i % 9)) for i in range(1400)]
    out = vp.shard_table(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    check(out, rows)
    total = np.bincount([r["shard"] for r in out], [r["size"] for r in out], 16)
    assert total.max() / total.mean() < 1.03 and total.min() / total.mean() > 0.97


def test_copies_without_an_id_and_with_one_id_are_cut_too(spark):
    rows = [(None, "the same text for many rows, " * 7)] * 2000 + [(7, "one id for all of these rows, " * 5)] * 1000
    rows += [(1000 + i, f"another text {i} " * (1 + i % 9)) for i in range(2000)]
    out = vp.shard_table(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    check(out, rows)
    total = np.bincount([r["shard"] for r in out], [r["size"] for r in out], 16)
    assert total.max() / total.mean() < 1.05 and total.min() / total.mean() > 0.95


def test_small_groups_stay_together(spark):
    rows = [(i, f"text {i // 3}") for i in range(12000)]
    out = vp.shard_table(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    shards = {}
    for r in out:
        shards.setdefault(r["text_crc32"], set()).add(r["shard"])
    assert all(len(s) == 1 for s in shards.values())


def test_placing_follows_the_dot_product():
    items = np.array([[6.0, 1, 1], [5, 1, 1], [4, 1, 1], [3, 1, 1], [2, 1, 1], [1, 1, 1]])
    shard = vp.pack(items, 3, (1.0, 0.0, 0.0))
    assert sorted(np.bincount(shard, items[:, 0], 3)) == [7, 7, 7]


def test_written_shards_hold_every_row(spark, messy, messy_rows, tmp_path):
    vp.write_shards(messy, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(messy_rows)
