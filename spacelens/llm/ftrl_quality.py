"""Quality classifier: hashed word n-grams, logistic regression, follow-the-regularised-leader.

Features of a text, hashed into 2 ** bits buckets: its words and pairs of words, and the shapes
of its words (runs of capitals, small letters and digits count once, other characters stand for
themselves), alone, in pairs and in threes; a word that equals the word before has a shape of
its own. A feature's value is its count divided by the square root of the number of words.

The weights are learned by per-coordinate FTRL-proximal steps (L1 and L2) over a bounded sample:
about ``docs_per_label`` labelled documents of either label, picked by hash. Texts are scored
whole, as sparse dot products, in Arrow batches; the weights are one array of fixed size.

Defined cases: null and empty texts have no feature and get the score of the bias; documents
without a label, or with contradicting ones, are not learned from; without two labels to learn
from the score is 0.5; repeated rows are scored alike; an empty table gives an empty result;
``quality_score`` replaces an input column of that name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spacelens.llm.words import byte_codes, mixed, span_hashes, text_chunks, word_spans


@dataclass(frozen=True)
class FtrlConfig:
    """alpha, beta: learning rate; l1, l2: regularisation of FTRL-proximal."""

    bits: int = 18
    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 0.5
    l2: float = 1.0
    epochs: int = 3
    docs_per_label: int = 4000
    seed: int = 11


def shape_classes() -> np.ndarray:
    """Byte to class: capitals, small letters and bytes of other alphabets, digits, or itself."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] = 65
    table[97:123] = 97
    table[128:] = 97
    table[48:58] = 48
    return table


def _features(data: np.ndarray, offsets: np.ndarray, bits: int):
    """Feature buckets of a piece's rows, one array for each kind, with the rows' bounds in it."""
    starts, ends, bounds = word_spans(data, offsets)
    mask = np.uint64((1 << bits) - 1)
    words = span_hashes(byte_codes(1)[data], starts, ends)
    classes = shape_classes()[data]
    new = np.ones(len(data), bool)
    new[1:] = classes[1:] != classes[:-1]
    new[starts] = True
    upto = np.concatenate(([0], np.cumsum(new)))
    shapes = span_hashes(byte_codes(2)[classes[new]], upto[starts], upto[ends])
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    echo = np.zeros(len(words), bool)
    echo[1:] = (words[1:] == words[:-1]) & (row[1:] == row[:-1])
    shapes[echo] ^= np.uint64(0x5BF03635)

    def grams(items, n, kind):
        if len(items) < n:
            return np.zeros(0, np.uint64), np.zeros_like(bounds)
        h = np.full(len(items) - n + 1, kind, np.uint64)
        for k in range(n):
            h = mixed(h * np.uint64(0x100000001B3) + items[k : len(items) - n + 1 + k])
        inside = row[n - 1 :] == row[: len(row) - n + 1]
        return h[inside], np.concatenate(([0], np.cumsum(inside)))[np.minimum(bounds, len(inside))]

    kinds = [grams(words, 1, 1), grams(words, 2, 2), grams(shapes, 1, 3), grams(shapes, 2, 4), grams(shapes, 3, 5)]
    return [((h & mask).astype(np.int64), b) for h, b in kinds], np.diff(bounds)


def sparse_rows(column: pa.Array, bits: int):
    """(buckets, values) of each text: distinct buckets with their counts over sqrt(words)."""
    for _, data, offsets in text_chunks(column):
        kinds, n_words = _features(data, offsets, bits)
        for i, n in enumerate(n_words):
            if not n:
                yield np.zeros(0, np.int64), np.zeros(0)
                continue
            own = np.concatenate([h[b[i] : b[i + 1]] for h, b in kinds])
            index, count = np.unique(own, return_counts=True)
            yield index, count / np.sqrt(n)


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, config: FtrlConfig):
    """(weights, bias) after a few passes in a fixed random order, both labels weighing the same."""
    z, n = np.zeros((1 << config.bits) + 1), np.zeros((1 << config.bits) + 1)
    bias_at = 1 << config.bits
    if len(set(labels.tolist())) < 2:
        return np.zeros(1 << config.bits), 0.0
    share = labels.mean()
    importance = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    rng = np.random.default_rng(config.seed)

    def weights(at):
        zi, ni = z[at], n[at]
        w = -(zi - np.sign(zi) * config.l1) / ((config.beta + np.sqrt(ni)) / config.alpha + config.l2)
        return np.where(np.abs(zi) <= config.l1, 0.0, w)

    for _ in range(config.epochs):
        for r in rng.permutation(len(rows)):
            at = np.append(rows[r][0], bias_at)
            x = np.append(rows[r][1], 1.0)
            w = weights(at)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - labels[r]) * x * importance[r]
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / config.alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(np.arange(len(z)))
    return w[:-1], float(w[-1])


def score_texts(column: pa.Array, weights: np.ndarray, bias: float, bits: int) -> np.ndarray:
    """The probability of label 1 of each text."""
    out = []
    for _, data, offsets in text_chunks(column):
        kinds, n_words = _features(data, offsets, bits)
        total = np.zeros(len(offsets) - 1)
        for h, bounds in kinds:
            sums = np.concatenate(([0.0], np.cumsum(weights[h])))
            total += sums[bounds[1:]] - sums[bounds[:-1]]
        margin = total / np.sqrt(np.maximum(n_words, 1)) + bias
        out.append(1 / (1 + np.exp(-np.clip(margin, -35, 35))))
    return np.concatenate(out) if out else np.zeros(0)


def labelled_sample(docs: DataFrame, labels: DataFrame, trained_on: Column, config: FtrlConfig) -> DataFrame:
    """(text, label) of a bounded hashed sample of either label."""
    agreed = (
        labels.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"), F.max("label").alias("other"))
        .where(F.col("label") == F.col("other"))
        .where(trained_on)
        .select("doc_id", "label")
    )
    counts = {r["label"]: r["n"] for r in agreed.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(config.seed)), F.lit(1_000_003)) / 1_000_003
    chance = F.lit(0.0)
    for label, n in counts.items():
        chance = F.when(F.col("label") == label, F.lit(min(1.0, config.docs_per_label / n))).otherwise(chance)
    most = 4 * config.docs_per_label
    # At most ``most`` ids and labels, so the broadcast is bounded.
    picked = agreed.where(draw < chance).limit(most).withColumnRenamed("doc_id", "_id")
    return docs.join(F.broadcast(picked), F.col("doc_id") == F.col("_id")).select("text", "label").limit(2 * most)


def fit(docs: DataFrame, labels: DataFrame, trained_on: Column, config: FtrlConfig = FtrlConfig()):
    """Learns from documents (doc_id, text) and labels (doc_id, label); ``trained_on`` is over doc_id."""
    sample = labelled_sample(docs.select("doc_id", "text"), labels, trained_on, config)

    def featured(batches):
        for batch in batches:
            found = list(sparse_rows(batch.column(0), config.bits))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([i.astype(np.int32) for i, _ in found], pa.list_(pa.int32())),
                    pa.array([v.astype(np.float32) for _, v in found], pa.list_(pa.float32())),
                    batch.column(1).cast(pa.int32()),
                ],
                ["buckets", "values", "label"],
            )

    got = sample.mapInArrow(featured, "buckets array<int>, values array<float>, label int").toArrow()
    rows = [
        (np.asarray(b.values, np.int64), np.asarray(v.values, np.float64))
        for b, v in zip(got["buckets"], got["values"])
    ]
    y = np.asarray(got["label"], np.int64)
    # The order of a distributed result may change; the order of learning must not.
    order = sorted(range(len(rows)), key=lambda i: (y[i], len(rows[i][0]), rows[i][0].tobytes()))
    return fit_ftrl([rows[i] for i in order], y[order], config)


def score(docs: DataFrame, model, config: FtrlConfig = FtrlConfig(), carry: list[str] | None = None) -> DataFrame:
    """``carry`` (all columns by default) with quality_score, from the text alone."""
    carry = [c for c in (carry or docs.columns) if c != "quality_score"]
    schema = T.StructType([docs.schema[c] for c in carry]).add("quality_score", "double")
    given = docs.select(*[f"`{c}`" for c in carry], F.col("text").alias("__text"))
    weights, bias = np.asarray(model[0], np.float32), model[1]

    def scored(batches):
        for batch in batches:
            p = score_texts(batch.column(batch.num_columns - 1), weights, bias, config.bits)
            arrays = [*batch.columns[:-1], pa.array(p, pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, [*carry, "quality_score"])

    return given.mapInArrow(scored, schema)
