"""BM25, trigram cosine, dense ranking and reciprocal rank fusion for a table of queries."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spacelens.config import RetrievalConfig
from spacelens.functions.text import tokens
from spacelens.operators.index import CHUNK, TextIndex, gram_counts, gram_norms, gram_weight
from spacelens.sources.stage import stage

HIT = ["query_id", *CHUNK]


def _query_terms(queries: DataFrame) -> DataFrame:
    """A repeated query term counts again, as a factor."""
    each = queries.select("query_id", F.explode(tokens("text")).alias("term"))
    return each.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qf"))


def _query_blocks(weights: DataFrame, size: int, parts: int) -> DataFrame:
    """(query_id, item, weight) as rows of up to ``size`` queries, written, with a part number."""
    kind = dict(weights.dtypes)["query_id"]
    lists = weights.groupBy("query_id").agg(
        # The items of one query.
        F.collect_list(F.struct("item", "weight")).alias("pairs")
    )

    def packed(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                ids, pairs = part.column(0), part.column(1)
                of = np.repeat(np.arange(part.num_rows), pc.list_value_length(pairs).to_numpy(zero_copy_only=False))
                flat = pairs.flatten()
                cells = [of, flat.field("item").to_numpy(zero_copy_only=False), flat.field("weight").to_numpy(zero_copy_only=False)]
                types = (np.int32, np.int64, np.float64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids.to_pylist()], pa.list_(ids.type)),
                     *[pa.array([c.astype(t).tobytes()], pa.binary()) for c, t in zip(cells, types)]],
                    names=["query_id", "q_of", "q_item", "q_weight"],
                )

    blocks = lists.mapInArrow(packed, f"query_id array<{kind}>, q_of binary, q_item binary, q_weight binary")
    part = F.pmod(F.xxhash64("q_item", "q_of"), F.lit(parts)).cast("int")
    return stage(blocks.withColumn("part", part), "query_blocks")


def _passage_blocks(passages: DataFrame, weigh: Callable, size: int) -> DataFrame:
    """(CHUNK, scale, counts) as rows of up to ``size`` passages, packed in the tasks that read them.

    ``counts`` lists (item, tf); ``weigh(tf, scale)`` gives the weights of a passage's items.
    """
    types = dict(passages.dtypes)

    def packed(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                docs, numbers, scale, counts = (part.column(c) for c in range(4))
                of = np.repeat(np.arange(part.num_rows), pc.list_value_length(counts).to_numpy(zero_copy_only=False))
                flat = counts.flatten()
                item = flat.field(0).to_numpy(zero_copy_only=False)
                tf = flat.field(1).to_numpy(zero_copy_only=False).astype(float)
                weight = weigh(tf, scale.to_numpy(zero_copy_only=False)[of])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([docs.to_pylist()], pa.list_(docs.type)),
                     pa.array([numbers.to_pylist()], pa.list_(numbers.type)),
                     pa.array([of.astype(np.int32).tobytes()], pa.binary()),
                     pa.array([item.astype(np.int64).tobytes()], pa.binary()),
                     pa.array([weight.tobytes()], pa.binary())],
                    names=[*CHUNK, "p_of", "p_item", "p_weight"],
                )

    return passages.select(*CHUNK, "scale", "counts").mapInArrow(
        packed,
        f"doc_id array<{types['doc_id']}>, chunk_no array<{types['chunk_no']}>, p_of binary, p_item binary, p_weight binary",
    )


def block_scores(
    passages: DataFrame,
    weights: DataFrame,
    weigh: Callable,
    k: int | None = None,
    digits: int = 9,
    passage_block: int = 512,
    query_block: int = 1_000,
    query_parts: int = 8,
) -> DataFrame:
    """(query_id, doc_id, chunk_no, score): sums of products of the items that both sides share.

    Passages are packed where they lie and meet the written query blocks as in ``dense_scores``;
    a pair of blocks is one matrix product over the items met in both. No row per shared item is
    made. With ``k`` each pair hands on its k best passages per query, by rounded score and key.
    """
    left = _passage_blocks(passages, weigh, passage_block)
    right = _query_blocks(weights, query_block, query_parts)
    each = left.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(query_parts - 1))))
    types = {**dict(passages.dtypes), **dict(weights.dtypes)}

    def product(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                value = {n: batch.column(n)[i] for n in batch.schema.names}
                docs, numbers, queries = (value[n].values for n in (*CHUNK, "query_id"))

                def numbers_of(name, kind):
                    return np.frombuffer(value[name].as_buffer(), dtype=kind)

                asked, at = np.unique(numbers_of("q_item", np.int64), return_inverse=True)
                item = numbers_of("p_item", np.int64)
                if not len(asked) or not len(item):
                    continue
                place = np.minimum(np.searchsorted(asked, item), len(asked) - 1)
                met = asked[place] == item
                used, column = np.unique(place[met], return_inverse=True)
                x = np.zeros((len(docs), len(used)))
                x[numbers_of("p_of", np.int32)[met], column] = numbers_of("p_weight", float)[met]
                w = np.zeros((len(asked), len(queries)))
                w[at, numbers_of("q_of", np.int32)] = numbers_of("q_weight", float)
                scores = w[used].T @ x.T
                if k is None:
                    q, p = np.nonzero(scores > 0)
                else:
                    keys = pa.table({"d": docs, "c": numbers})
                    order = pc.sort_indices(
                        keys, sort_keys=[("d", "ascending"), ("c", "ascending")], null_placement="at_start"
                    ).to_numpy()
                    rounded = np.round(scores[:, order], digits)
                    best = np.argsort(-rounded, axis=1, kind="stable")[:, :k]
                    q, b = np.nonzero(np.take_along_axis(rounded, best, axis=1) > 0)
                    p = order[best[q, b]]
                yield pa.RecordBatch.from_arrays(
                    [queries.take(pa.array(q)), docs.take(pa.array(p)), numbers.take(pa.array(p)), pa.array(scores[q, p])],
                    names=[*HIT, "score"],
                )

    return each.join(right, "part").drop("part").mapInArrow(
        product,
        f"query_id {types['query_id']}, doc_id {types['doc_id']}, chunk_no {types['chunk_no']}, score double",
    )


def bm25_scores(
    index: TextIndex, queries: DataFrame, config: RetrievalConfig, k: int | None = None
) -> DataFrame:
    """(query_id, doc_id, chunk_no, score) of every passage that shares a term, or the best ones."""
    passages = index.stats.select("passages").scalar()
    average = index.stats.select("avg_length").scalar()
    asked = _query_terms(queries).join(index.terms, "term")
    df = F.col("df").cast("double")
    # Written first, so that its known size decides how the postings are met.
    terms = stage(
        asked.groupBy("term").agg(
            F.max(F.log(1.0 + (passages - df + 0.5) / (df + 0.5))).alias("idf")
        ).select(
            F.monotonically_increasing_id().alias("item"), "term", "idf", average.alias("avg_length")
        ),
        "query_terms",
    )
    weights = _query_terms(queries).join(terms, "term").select(
        "query_id", "item", (F.col("idf") * F.col("qf")).alias("weight")
    )
    # The asked terms of one passage.
    met = index.postings.join(terms, "term").groupBy(*CHUNK).agg(
        F.max(1.0 - config.b + config.b * (F.col("length") / F.col("avg_length"))).alias("scale"),
        F.collect_list(F.struct("item", "tf")).alias("counts"),
    )
    k1 = config.k1

    def weigh(tf, scale):
        return tf * (k1 + 1.0) / (tf + k1 * scale)

    return block_scores(met, weights, weigh, k)


def cosine_scores(index: TextIndex, queries: DataFrame, k: int | None = None) -> DataFrame:
    """Trigram cosine of every passage that shares a gram with the query, or of the best ones."""
    counts = gram_counts(queries, ["query_id"])
    weights = (
        counts.join(index.idf, "gram")
        .join(gram_norms(counts, index.idf, ["query_id"]), "query_id")
        .select("query_id", F.col("gram").alias("item"), (gram_weight() * F.col("idf") / F.col("norm")).alias("weight"))
    )
    # Both tables lie in blocks by passage: no side is moved, and vectors are not sorted.
    met = index.grams.join(index.norms.hint("shuffle_hash"), CHUNK)

    def weigh(tf, scale):
        return (1.0 + np.log(tf)) / scale

    return block_scores(met.withColumnRenamed("norm", "scale"), weights, weigh, k)


def top_passages(scores: DataFrame, k: int, digits: int = 9, positive: bool = True) -> DataFrame:
    """The k best per query with their position; the filter prunes before the shuffle.

    Lexical scores of 0 mean no match and are no hits; cosines of vectors (``positive`` False)
    rank whatever their sign.
    """
    key = F.round("score", digits)
    order = Window.partitionBy("query_id").orderBy(F.desc(key), *CHUNK)
    hits = scores.where(key > 0) if positive else scores
    return hits.withColumn("position", F.row_number().over(order)).where(F.col("position") <= k)


def bm25(index, queries, k: int, config: RetrievalConfig = RetrievalConfig()) -> DataFrame:
    return top_passages(bm25_scores(index, queries, config, k), k)


def trigram_cosine(index, queries, k: int) -> DataFrame:
    return top_passages(cosine_scores(index, queries, k), k)


def _unit(matrix: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norm == 0.0, 1.0, norm)


def _blocks(frame: DataFrame, ids: list[str], size: int) -> DataFrame:
    """Rows of up to ``size`` vectors: their ids as arrays and the unit vectors as one value.

    Made where the rows lie, from one Arrow batch at a time.
    """
    types = dict(frame.dtypes)
    fields = ", ".join(f"{c} array<{types[c]}>" for c in ids)

    def packed(batches):
        for batch in batches:
            for at in range(0, len(batch), size):
                part = batch.iloc[at : at + size]
                unit = _unit(np.stack(part["vector"].to_numpy()).astype(float))
                yield pd.DataFrame(
                    {**{c: [part[c].tolist()] for c in ids}, "width": [unit.shape[1]], "matrix": [unit.tobytes()]}
                )

    return frame.select(*ids, "vector").mapInPandas(packed, f"{fields}, width int, matrix binary")


def dense_scores(
    vectors: DataFrame,
    queries: DataFrame,
    k: int,
    vector_block: int = 2_000,
    query_block: int = 1_000,
    query_parts: int = 8,
) -> DataFrame:
    """Exact cosine top k of (doc_id, chunk_no, vector) for (query_id, vector).

    Both sides are packed into blocks in the tasks that scan them. The query blocks are written,
    so their known size decides how they come to the vector blocks: broadcast where they are
    small, and the vectors then stay in their tasks; by ``query_parts`` parts otherwise. Each
    pair of blocks is one matrix product and hands on only its k best rows per query.
    """
    left = _blocks(vectors, CHUNK, vector_block)
    asked = _blocks(queries, ["query_id"], query_block)
    part = F.pmod(F.xxhash64("query_id", "matrix"), F.lit(query_parts)).cast("int")
    right = stage(
        asked.select("query_id", F.col("matrix").alias("asked"), F.col("width").alias("q_width"), part.alias("part")),
        "query_blocks",
    )
    each = left.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(query_parts - 1))))
    types = {**dict(vectors.dtypes), **dict(queries.dtypes)}

    def product(batches):
        for pairs in batches:
            for row in pairs.itertuples(index=False):
                v = np.frombuffer(row.matrix).reshape(-1, row.width)
                q = np.frombuffer(row.asked).reshape(-1, row.q_width)
                order = np.lexsort((row.chunk_no, row.doc_id))
                sims = np.round(q @ v[order].T, 9)
                best = np.argsort(-sims, axis=1, kind="stable")[:, :k]
                take = order[best.ravel()]
                yield pd.DataFrame(
                    {
                        "query_id": np.repeat(np.asarray(row.query_id), best.shape[1]),
                        "doc_id": np.asarray(row.doc_id)[take],
                        "chunk_no": np.asarray(row.chunk_no)[take],
                        "score": np.take_along_axis(sims, best, axis=1).ravel(),
                    }
                )

    return each.join(right, "part").drop("part").mapInPandas(
        product,
        f"query_id {types['query_id']}, doc_id {types['doc_id']}, chunk_no int, score double",
    )


def dense_rank(vectors: DataFrame, queries: DataFrame, k: int, **blocks) -> DataFrame:
    return top_passages(dense_scores(vectors, queries, k, **blocks), k, positive=False)


def fuse(rankings: list[DataFrame], k: int, rrf_k: int = 60) -> DataFrame:
    """Reciprocal rank fusion, one passage per document, the k best documents per query."""
    listed = [r.select(*HIT, "position") for r in rankings]
    union = listed[0]
    for r in listed[1:]:
        union = union.unionByName(r)
    fused = union.groupBy(*HIT).agg(F.round(F.sum(1.0 / (rrf_k + F.col("position"))), 12).alias("score"))
    best = fused.groupBy("query_id", "doc_id").agg(
        F.min(F.struct((-F.col("score")).alias("s"), "chunk_no")).alias("b")
    )
    passages = best.select(
        "query_id", "doc_id", F.col("b.chunk_no").alias("chunk_no"), (-F.col("b.s")).alias("score")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return passages.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(
    index: TextIndex,
    queries: DataFrame,
    config: RetrievalConfig = RetrievalConfig(),
    extra_rankings: list[DataFrame] | None = None,
) -> DataFrame:
    """Hybrid search; a dense ranking (same columns) can be passed as a further list."""
    pool = config.pool()
    lists = [bm25(index, queries, pool, config), trigram_cosine(index, queries, pool)]
    hits = fuse(lists + list(extra_rankings or []), config.top_k, config.rrf_k)
    return hits.join(index.chunks, CHUNK)


def term_relevance(
    index: TextIndex, queries: DataFrame, config: RetrievalConfig = RetrievalConfig()
) -> DataFrame:
    """Best BM25 score of each document, relative to the best document of the query."""
    best = bm25_scores(index, queries, config).groupBy("query_id", "doc_id").agg(
        F.max("score").alias("score")
    )
    best = stage(best, "best_scores")
    peak = best.groupBy("query_id").agg(F.max("score").alias("peak"))
    return best.where("score > 0").join(peak, "query_id").select(
        "query_id", "doc_id", (F.col("score") / F.col("peak")).alias("relevance")
    )


