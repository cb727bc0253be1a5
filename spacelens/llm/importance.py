"""Importance resampling towards a target text collection, drawn by distributed quickselect.

A document's features are its runs of consecutive words, hashed into buckets. Both collections are
counted per bucket (10,000 numbers each, summed on the map side); a bucket's gain is the floored
log ratio of its smoothed shares. A document's weight is the floored mean gain of its features: one
lookup in the array of gains per feature. Gumbel noise from a hash of the id makes the highest
scores a weighted draw without replacement.

The k-th highest composite key (score, id, features, row) is found by quickselect on the cluster:
a bounded number of random rows of the open interval become pivots, one pass counts exactly how
many rows lie below, at and between them, and the interval that holds the k-th row is the next
one. Keys are unique, so this ends with the k-th key itself. Only the winners are sorted, into
ranges, and numbered.

Defined cases: null, empty and wordless texts have no features and weight 0; they are never drawn
with ``least_words`` above 0; a null id is hashed as an empty text and comes last among ties;
repeated rows have equal keys and are drawn one by one; an empty target leaves the gains to the
corpus's own shares; empty corpora give empty results; input columns other than ``carry`` go,
``carry`` may hold any names but those of the result.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spacelens.llm.words import text_chunks
from spacelens.operators.placing import with_positions
from spacelens.sources.stage import stage


@dataclass(frozen=True)
class ResampleConfig:
    """longest: words of the longest run; pivots: random keys of a round of the selection."""

    buckets: int = 10_000
    longest: int = 1
    percent: int = 10
    least_words: int = 20
    seed: int = 2024
    pivots: int = 64


def _word_bytes() -> bytes:
    """Capitals A-Z as small letters; bytes outside words as spaces."""
    table = bytearray(range(256))
    for b in range(128):
        if 65 <= b <= 90:
            table[b] = b + 32
        elif not (48 <= b <= 57 or 97 <= b <= 122):
            table[b] = 32
    return bytes(table)


WORD_BYTES = _word_bytes()


def feature_buckets(column: pa.Array, config: ResampleConfig):
    """(buckets of all features of a piece, bounds of its rows in them, words of each row)."""
    for _, data, offsets in text_chunks(column):
        raw, edges = data.tobytes().translate(WORD_BYTES), offsets.tolist()
        texts = [raw[a:b].split() for a, b in zip(edges, edges[1:])]
        if config.longest > 1:
            features = [
                [b" ".join(t[i : i + r]) for r in range(1, config.longest + 1) for i in range(len(t) - r + 1)]
                for t in texts
            ]
        else:
            features = texts
        sizes = [len(f) for f in features]
        codes = np.fromiter(map(crc32, chain.from_iterable(features)), np.int64, sum(sizes))
        yield codes % config.buckets, np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))), [len(t) for t in texts]


def bucket_counts(docs: DataFrame, config: ResampleConfig) -> np.ndarray:
    """Features of all texts by bucket."""

    def counted(batches):
        total = np.zeros(config.buckets, np.int64)
        for batch in batches:
            for codes, _, _ in feature_buckets(batch.column("text"), config):
                total += np.bincount(codes, minlength=config.buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    rows = docs.select("text").mapInArrow(counted, "bucket long, n long")
    out = np.zeros(config.buckets, np.int64)
    # At most one row a bucket.
    for bucket, n in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[bucket] = n
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the target's smoothed share over the corpus's, by bucket."""
    s, t, b = corpus.astype(float), target.astype(float), float(len(corpus))
    ratio = ((t + 1) * (s.sum() + b)) / ((s + 1) * (t.sum() + b))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def gumbel(doc_id: Column, seed: int) -> Column:
    """floor(1000 times a Gumbel variate) from the first 32 bits of a hash of the id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def weighed(docs: DataFrame, gains: np.ndarray, config: ResampleConfig, carry: Sequence[str]) -> DataFrame:
    """(``carry`` as one struct ``row``, n_words, n_features, weight)."""
    rows = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"))

    def work(batches):
        for batch in batches:
            first = 0
            for codes, bounds, words in feature_buckets(batch.column("text"), config):
                sums = np.concatenate(([0], np.cumsum(gains[codes])))[bounds]
                sizes = np.diff(bounds)
                weight = np.where(sizes > 0, np.diff(sums) // np.maximum(sizes, 1), 0)
                own = batch.column("row").slice(first, len(sizes))
                first += len(sizes)
                yield pa.RecordBatch.from_arrays(
                    [own, pa.array(words, pa.int64()), pa.array(sizes), pa.array(weight)],
                    names=["row", "n_words", "n_features", "weight"],
                )

    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(work, f"row {kind}, n_words long, n_features long, weight long")


def kth_key(rows: DataFrame, key: Column, k: int, pivots: int, seed: int = 0):
    """The k-th smallest (from 1) of the unique struct ``key``, as a Row; ``rows`` are read in passes."""
    rows = rows.select(key.alias("key"))
    kind = rows.schema["key"].dataType

    def constant(value) -> Column:
        return F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(value, kind.fields)])

    low = high = None
    while True:
        inside = rows
        # The first field bounds the scan; the struct decides.
        if low is not None:
            inside = inside.where((F.col(f"key.{kind.names[0]}") >= low[0]) & (F.col("key") > constant(low)))
        if high is not None:
            inside = inside.where((F.col(f"key.{kind.names[0]}") <= high[0]) & (F.col("key") < constant(high)))
        # The rows of smallest hash, another hash each round: a bounded random sample.
        chance = F.xxhash64("key", F.lit(seed))
        drawn = sorted(r["key"] for r in inside.orderBy(chance, "key").limit(pivots).collect())
        ladder = F.array(*[constant(p) for p in drawn])
        # 2i: between pivots i - 1 and i; 2i + 1: pivot i itself.
        slot = 2 * F.size(F.filter(ladder, lambda p: p < F.col("key"))) + F.array_contains(ladder, F.col("key")).cast("int")
        counts = {r["slot"]: r["count"] for r in inside.groupBy(slot.alias("slot")).count().collect()}
        at = 0
        while k > counts.get(at, 0):
            k -= counts.get(at, 0)
            at += 1
        if at % 2:
            return drawn[at // 2]
        low = drawn[at // 2 - 1] if at else low
        high = drawn[at // 2] if at // 2 < len(drawn) else high
        seed += 1


def resampled(
    docs: DataFrame,
    target: DataFrame,
    config: ResampleConfig = ResampleConfig(),
    carry: Sequence[str] = ("doc_id",),
) -> DataFrame:
    """(``carry``, n_features, weight, score, rank) of every document; rank 1, 2, 3... of those drawn."""
    spark = docs.sparkSession
    gains = bucket_gains(bucket_counts(docs, config), bucket_counts(target, config))
    carried = list(carry) if "doc_id" in carry else [*carry, "doc_id"]
    scored = weighed(docs, gains, config, carried).withColumn("score", F.col("weight") + gumbel(F.col("row.doc_id"), config.seed))
    rows = stage(scored.withColumn("turn", F.monotonically_increasing_id()), "resample-scores")
    fit = rows.where(F.col("n_words") >= config.least_words)
    k = config.percent * fit.count() // 100
    doc_id = F.col("row.doc_id")
    key = F.struct(
        (-F.col("score")).alias("down"),
        doc_id.isNull().alias("no_id"),
        F.coalesce(doc_id, F.lit(0).cast(rows.schema["row"].dataType["doc_id"].dataType)).alias("id"),
        F.col("n_features"),
        F.col("turn"),
    )
    out = [*[F.col(f"row.`{c}`").alias(c) for c in carry], "n_features", "weight", "score"]
    drawn = F.lit(False)
    if k:
        last = kth_key(fit, key, k, config.pivots, config.seed)
        bound = F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(last, fit.select(key.alias("key")).schema["key"].dataType.fields)])
        drawn = (F.col("n_words") >= config.least_words) & (key <= bound)
    rest = rows.where(~drawn).select(*out, F.lit(None).cast("long").alias("rank"))
    if not k:
        return rest
    winners = rows.where(drawn).withColumn("_key", key)
    ranked = with_positions(winners, [], [F.col("_key")], "rank").select(*out, F.col("rank").cast("long").alias("rank"))
    return ranked.unionByName(rest)
