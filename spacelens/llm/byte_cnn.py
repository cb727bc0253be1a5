"""Language identification by a byte convolutional network.

A text's UTF-8 bytes are cut into windows of fixed length, all of them, the last one padded.
Filters of several widths slide over byte embeddings; each filter's highest response in a window
(max pooling, then a rectifier) goes to a softmax over the learned languages. A document's
distribution is the mean of its windows' distributions, weighted by the letters in them.

Training is numpy on the driver over a bounded sample: at most about ``docs_per_language``
documents of every language that has a label, ``windows_per_doc`` windows cut at hashed places all
over the text. The trained network is a few kilobytes and travels to the
tasks, which score whole Arrow batches of texts at once.

Defined cases: null texts and texts without a letter are ``und`` with score 0; without labelled
texts to learn from every text is; null languages are not learned; a text of any length is scored
whole; an empty table gives an empty result; ``lang_pred`` and ``lang_score`` replace input
columns of these names.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spacelens.llm.words import giving_back, text_chunks

UNKNOWN = "und"


@dataclass(frozen=True)
class CnnConfig:
    window: int = 128
    widths: tuple[int, ...] = (2, 3, 4)
    filters: int = 16
    embedding: int = 8
    epochs: int = 6
    batch: int = 128
    rate: float = 0.004
    docs_per_language: int = 800
    windows_per_doc: int = 6
    seed: int = 7


@dataclass
class ByteCnn:
    """``tables``: for each width, one (256, filters) response table for each place in a filter."""

    languages: list[str]
    config: CnnConfig
    tables: list[np.ndarray] = field(default_factory=list)
    bias: np.ndarray | None = None
    out: np.ndarray | None = None
    out_bias: np.ndarray | None = None

    def pair_tables(self) -> list[list[np.ndarray]]:
        """Responses to two neighbouring bytes at once, so that a filter of width 4 needs two look-ups."""
        found = []
        for table in self.tables:
            parts = []
            for k in range(0, len(table) - 1, 2):
                parts.append((table[k][:, None, :] + table[k + 1][None, :, :]).reshape(1 << 16, -1))
            if len(table) % 2:
                parts.append(table[-1])
            found.append([np.ascontiguousarray(p, np.float32) for p in parts])
        return found

    def responses(self, windows: np.ndarray, tables) -> np.ndarray:
        """(n, window) bytes to the (n, widths * filters) pooled responses."""
        pairs = windows[:, :-1].astype(np.intp) * 256 + windows[:, 1:]
        pooled = []
        for width, parts in zip(self.config.widths, tables):
            n = windows.shape[1] - width + 1
            total = None
            for k, part in enumerate(parts):
                at = 2 * k
                index = pairs[:, at : at + n] if len(part) > 256 else windows[:, at : at + n].astype(np.intp)
                got = part.take(index, axis=0)
                total = got if total is None else np.add(total, got, out=total)
            pooled.append(total.max(axis=1))
        return np.maximum(np.concatenate(pooled, axis=1) + self.bias, 0)

    def probabilities(self, windows: np.ndarray, tables, block: int = 256) -> np.ndarray:
        out = np.empty((len(windows), len(self.languages)))
        for i in range(0, len(windows), block):
            z = self.responses(windows[i : i + block], tables) @ self.out + self.out_bias
            z = np.exp(z - z.max(axis=1, keepdims=True))
            out[i : i + block] = z / z.sum(axis=1, keepdims=True)
        return out


def _adam(params, grads, state, step, rate):
    for i, (p, g) in enumerate(zip(params, grads)):
        m, v = state.setdefault(i, (np.zeros_like(p), np.zeros_like(p)))
        m *= 0.9
        m += 0.1 * g
        v *= 0.999
        v += 0.001 * g * g
        p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], config: CnnConfig) -> ByteCnn:
    """Cross-entropy with Adam; each language weighs the same in the loss."""
    rng = np.random.default_rng(config.seed)
    model = ByteCnn(languages, config)
    if not len(windows):
        return ByteCnn([], config)
    classes, d, f = len(languages), config.embedding, config.filters
    embed = rng.normal(0, 0.5, (256, d))
    embed[0] = 0
    convs = [rng.normal(0, 1 / np.sqrt(w * d), (w, d, f)) for w in config.widths]
    bias = np.zeros(f * len(convs))
    out = rng.normal(0, 0.1, (f * len(convs), classes))
    out_bias = np.zeros(classes)
    params, state, step = [embed, *convs, bias, out, out_bias], {}, 0
    weight = len(labels) / (classes * np.bincount(labels, minlength=classes).clip(1))
    for _ in range(config.epochs):
        order = rng.permutation(len(windows))
        for i in range(0, len(order), config.batch):
            pick = order[i : i + config.batch]
            x, y = windows[pick].astype(np.intp), labels[pick]
            e = embed[x]
            pooled, places = [], []
            for conv, w in zip(convs, config.widths):
                n = x.shape[1] - w + 1
                r = sum(e[:, k : k + n] @ conv[k] for k in range(w))
                at = r.argmax(axis=1)
                places.append(at)
                pooled.append(np.take_along_axis(r, at[:, None, :], 1)[:, 0])
            before = np.concatenate(pooled, axis=1) + bias
            h = np.maximum(before, 0)
            z = h @ out + out_bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            g = p
            g[np.arange(len(y)), y] -= 1
            g *= (weight[y] / len(y))[:, None]
            grad_h = (g @ out.T) * (before > 0)
            grad_embed, grad_convs = np.zeros_like(embed), []
            for j, (conv, w) in enumerate(zip(convs, config.widths)):
                gh = grad_h[:, j * f : (j + 1) * f]
                grad = np.zeros_like(conv)
                for k in range(w):
                    # The maximum of filter c in sample b lies at places[b, c]: only that byte learns.
                    seen = np.take_along_axis(x, places[j] + k, 1)
                    grad[k] = np.einsum("bcd,bc->dc", embed[seen], gh)
                    np.add.at(grad_embed, seen, gh[:, :, None] * conv[k].T[None])
                grad_convs.append(grad)
            grad_embed[0] = 0
            step += 1
            grads = [grad_embed, *grad_convs, grad_h.sum(0), h.T @ g + 1e-4 * out, g.sum(0)]
            _adam(params, grads, state, step, config.rate)
    model.tables = [np.stack([embed @ c[k] for k in range(len(c))]).astype(np.float32) for c in convs]
    model.bias, model.out, model.out_bias = bias.astype(np.float32), out, out_bias
    return model


def sample_windows(docs: DataFrame, trained_on: Column, config: CnnConfig) -> DataFrame:
    """(lang, piece) of a bounded hashed sample; ``docs`` has doc_id, text and lang."""
    usable = docs.where(trained_on & F.col("lang").isNotNull() & (F.length("text") > 0))
    counts = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    found = counts.collect()
    # One row per label, as in the network itself.
    chances = docs.sparkSession.createDataFrame(found, counts.schema).select(
        F.col("lang").alias("_lang"), F.least(F.lit(1.0), F.lit(config.docs_per_language) / F.col("n")).alias("chance")
    )
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(config.seed)), F.lit(1_000_003)) / 1_000_003
    room = F.greatest(F.length("text") - config.window, F.lit(0)) + 1
    pieces = F.array(
        *[
            F.substring("text", F.pmod(F.xxhash64("doc_id", F.lit(k)), room).cast("int") + 1, F.lit(config.window))
            for k in range(config.windows_per_doc)
        ]
    )
    most = 2 * len(found) * config.docs_per_language * config.windows_per_doc + 1
    drawn = usable.join(F.broadcast(chances), F.col("lang") == F.col("_lang")).where(draw < F.col("chance"))
    return drawn.select("lang", F.explode(pieces).alias("piece")).limit(most)


def fit(docs: DataFrame, trained_on: Column, config: CnnConfig = CnnConfig()) -> ByteCnn:
    """Learns from ``text`` and ``lang`` of the documents that ``trained_on`` selects."""
    sample = sample_windows(docs.select("doc_id", "text", "lang"), trained_on, config).toPandas()
    sample = sample.sort_values(["lang", "piece"], kind="stable")
    languages = sorted(sample["lang"].unique(), key=lambda s: s.encode())
    windows = np.zeros((len(sample), config.window), np.uint8)
    for i, piece in enumerate(sample["piece"]):
        b = piece.encode()[: config.window]
        windows[i, : len(b)] = np.frombuffer(b, np.uint8)
    labels = np.array([languages.index(x) for x in sample["lang"]], np.int64)
    return train(windows, labels, languages, config)


def _letters(data: np.ndarray) -> np.ndarray:
    low = data | 0x20
    return ((low >= 97) & (low <= 122)) | (data >= 0x80)


def cut_windows(data: np.ndarray, offsets: np.ndarray, size: int):
    """All windows of the rows of a piece, zero-padded, and the first window of each row (n + 1)."""
    lengths = np.diff(offsets)
    first = np.concatenate(([0], np.cumsum(-(-lengths // size))))
    windows = np.zeros(int(first[-1]) * size, np.uint8)
    if len(data):
        windows[np.repeat(first[:-1] * size - offsets[:-1], lengths) + np.arange(len(data))] = data
    return windows.reshape(-1, size), first


def classify(model: ByteCnn, column: pa.Array, tables) -> tuple[list[str], np.ndarray]:
    """Language and score of each text of a string column."""
    names, scores = [], []
    for _, data, offsets in text_chunks(column):
        windows, first = cut_windows(data, offsets, model.config.window)
        weight = _letters(windows).sum(axis=1).astype(float)
        n = len(offsets) - 1
        best, score = np.zeros(n, np.int64), np.zeros(n)
        some = np.flatnonzero(np.diff(first) > 0)
        if model.languages and len(some):
            p = model.probabilities(windows, tables)
            # Weighted sums per row; reduceat needs non-empty rows.
            total = np.add.reduceat(p * weight[:, None], first[some], axis=0)
            mass = np.add.reduceat(weight, first[some])
            mean = total / np.where(mass > 0, mass, 1)[:, None]
            best[some], score[some] = mean.argmax(axis=1), mean.max(axis=1)
        lettered = np.zeros(n, bool)
        if len(some):
            lettered[some] = np.add.reduceat(weight, first[some]) > 0
            ascii_letters = np.add.reduceat(((windows | 0x20) >= 97) & ((windows | 0x20) <= 122) & (windows < 0x80), first[some], axis=0).any(axis=1)
            for i in some[lettered[some] & ~ascii_letters]:
                text = data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")
                lettered[i] = any(c.isalpha() for c in text)
        known = lettered & bool(model.languages)
        names += [model.languages[b] if k else UNKNOWN for b, k in zip(best, known)]
        scores.append(np.where(known, score, 0.0))
    return names, np.concatenate(scores) if scores else np.zeros(0)


def predict(docs: DataFrame, model: ByteCnn, carry: list[str] | None = None) -> DataFrame:
    """``carry`` (all columns by default) with lang_pred and lang_score, from the text alone."""
    made = ("lang_pred", "lang_score")
    carry = [c for c in (carry or docs.columns) if c not in made]
    schema = T.StructType([docs.schema[c] for c in carry])
    schema = schema.add("lang_pred", "string").add("lang_score", "double")
    given = docs.select(*[f"`{c}`" for c in carry], F.col("text").alias("__text"))

    def scored(batches):
        tables = model.pair_tables()
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            names, scores = classify(model, column, tables)
            arrays = [*batch.columns[:-1], pa.array(names, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, [*carry, *made])

    return given.mapInArrow(giving_back(scored), schema)


def identified(docs: DataFrame, trained_on: Column, config: CnnConfig = CnnConfig(), least: float = 0.5) -> DataFrame:
    """The documents whose language the network can tell with a score of ``least`` or more."""
    out = predict(docs, fit(docs, trained_on, config))
    sure = (F.col("lang_pred") != UNKNOWN) & (F.col("lang_score") >= least)
    return out.where(sure).drop("lang_pred", "lang_score")
