from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from spacelens.llm import byte_cnn as bc
from .conftest import sentence


def labelled(spark, n=240):
    rng = random.Random(3)
    rows = [(i, sentence(rng, "en" if i % 2 else "de", rng.randint(5, 60)), "en" if i % 2 else "de") for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_held_out_accuracy(spark):
    df = labelled(spark)
    model = bc.fit(df, F.col("doc_id") % 4 != 0)
    out = bc.predict(df, model).where("doc_id % 4 = 0").collect()
    assert all(0 <= r["lang_score"] <= 1 for r in out)
    assert np.mean([r["lang"] == r["lang_pred"] for r in out]) > 0.97


def test_prediction_reads_the_text_alone(spark):
    df = labelled(spark)
    model = bc.fit(df, F.col("doc_id") % 4 != 0)
    other = df.withColumns({"lang": F.lit("xx"), "doc_id": F.lit(0)})
    a, b = (sorted((r["text"], r["lang_pred"], r["lang_score"]) for r in bc.predict(d, model).collect()) for d in (df, other))
    assert a == b


def test_tables_equal_the_convolution(spark):
    rng = np.random.default_rng(0)
    config = bc.CnnConfig(window=32, epochs=1, filters=4)
    windows = rng.integers(1, 255, (200, 32)).astype(np.uint8)
    model = bc.train(windows, rng.integers(0, 2, 200), ["a", "b"], config)
    got = model.responses(windows[:5], model.pair_tables())
    for row, w in zip(got, windows[:5]):
        want = []
        for width, table in zip(config.widths, model.tables):
            sums = [sum(table[k][w[i + k]] for k in range(width)) for i in range(32 - width + 1)]
            want.append(np.max(sums, axis=0))
        np.testing.assert_allclose(row, np.maximum(np.concatenate(want) + model.bias, 0), atol=1e-5)


def test_every_byte_lies_in_one_window():
    texts = ["abc", "", "x" * 300, "é" * 100]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0] + [len(t.encode()) for t in texts])
    windows, first = bc.cut_windows(data, offsets, 128)
    for i, t in enumerate(texts):
        own = windows[first[i] : first[i + 1]].reshape(-1)
        assert own[: len(t.encode())].tobytes() == t.encode() and not own[len(t.encode()) :].any()


def test_texts_without_letters_are_unknown(spark):
    model = bc.fit(labelled(spark), F.lit(True))
    names, scores = bc.classify(model, pa.array([None, "", "12 !!", "— €", "der und nicht"]), model.pair_tables())
    assert names[:4] == ["und"] * 4 and names[4] == "de" and not scores[:4].any()


def test_messy_documents(messy, messy_rows, no_docs):
    model = bc.fit(messy, F.lit(True))
    out = bc.predict(messy, model)
    assert out.columns == [*messy.columns, "lang_pred", "lang_score"] and out.count() == len(messy_rows)
    assert bc.identified(messy, F.lit(True)).columns == messy.columns
    empty = bc.fit(no_docs, F.lit(True))
    assert empty.languages == [] and bc.predict(no_docs, empty).count() == 0
    assert {r["lang_pred"] for r in bc.predict(messy, empty).collect()} == {"und"}


def test_rare_labels_are_learned_too(spark):
    rows = [(i, f"word{i % 70} of label {i % 70}, said {i} times", f"l{i % 70:02d}") for i in range(210)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = bc.fit(df, F.lit(True), bc.CnnConfig(epochs=1))
    assert model.languages == [f"l{i:02d}" for i in range(70)]
