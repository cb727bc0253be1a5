"""Exact top-k by inner product: dual-tree search over cover trees.

Rows are first dealt to groups around pivots (a bounded hashed sample, spread by farthest-first
choice: the top level of a cover tree), queries and data by the same pivots. Every group knows its
covering radius, so a pair of groups whose inner products can't reach the worst kth score of the
query group is never brought together. Groups are cut into blocks of bounded size; each surviving
(query group, data block) pair meets in one task, where a cover tree over the queries and one over
the data are walked together: a pair of nodes is dropped when

    <cq, cx> + rq |cx| + rx |cq| + rq rx  <  the worst kth score among the node's queries,

c being centres and r covering radii. Each block hands on the best k of each query, and the best
k of those are the result. Scores are integers and exact, ties go to the smaller id.

Defined cases: rows without an id and vectors that are null, or hold null or non-finite components,
take no part; vectors with inner products beyond 64 bits are refused with an error; vectors
of different lengths are never compared; repeated rows are candidates of their own, except that a
row never answers a query of its own id; a query with fewer than k candidates gets all; empty
vectors have inner product 0; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spacelens.sources.stage import stage

EXACT = 2.0**52


@dataclass(frozen=True)
class SearchConfig:
    """pivots, sample: size of the top level and of the rows it is chosen from; block: rows of a
    block; leaf: rows of a tree's leaf.
    """

    k: int = 5
    scale: int = 256
    pivots: int = 48
    sample: int = 2048
    block: int = 16384
    leaf: int = 64


def usable(vectors: DataFrame, column: str) -> DataFrame:
    """(vec_id, v): rows with an id and without null or non-finite components."""
    odd = F.exists(
        column,
        lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")),
    )
    return vectors.where(F.col("vec_id").isNotNull() & F.col(column).isNotNull() & ~odd).select("vec_id", F.col(column).alias("v"))


def integral(v: Column, scale: int) -> Column:
    return F.transform(v, lambda x: F.floor(x.cast("double") * scale))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products; in floating point where no sum can round.

    Sums that wrap on the way are exact in the end; vectors with a product beyond 64 bits are refused.
    """
    most = float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] if a.size and b.size else 0.0
    if most < EXACT:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    if most >= 2.0**63 and np.abs(a.astype(float) @ b.astype(float).T).max() >= 2.0**63 * (1 - 1e-9):
        raise OverflowError("components are too large for inner products of 64 bits")
    return a @ b.T


def matrix(rows: pd.Series, dim: int) -> np.ndarray:
    """Rows of equal length as one integer matrix."""
    return np.concatenate([np.asarray(r, np.int64) for r in rows]).reshape(len(rows), dim)


@dataclass
class Node:
    rows: np.ndarray
    centre: np.ndarray
    norm: float
    radius: float
    children: list[Node]


def cover_tree(points: np.ndarray, leaf: int) -> Node:
    """Nested balls: a node's children are balls of about half its radius around farthest-first
    centres, each row going to its nearest centre. Equal rows end in one leaf of radius 0.
    """
    def make(rows: np.ndarray) -> Node:
        x = points[rows]
        centre = x.mean(axis=0)
        away = np.sqrt(((x - centre) ** 2).sum(axis=1))
        # Rounded up, so that the bound holds in floating point too.
        radius = float(away.max()) * (1 + 1e-9) + 1e-9
        node = Node(rows, centre, float(np.sqrt(centre @ centre)), radius, [])
        if len(rows) > leaf and away.max() > 0:
            first = x[int(away.argmax())]
            near = ((x - first) ** 2).sum(axis=1)
            owner = np.zeros(len(rows), np.int64)
            for c in range(1, 8):
                far = int(near.argmax())
                if near[far] <= (radius / 2) ** 2 and c > 1 or near[far] == 0:
                    break
                d = ((x - x[far]) ** 2).sum(axis=1)
                owner[d < near] = c
                near = np.minimum(near, d)
            parts = [rows[owner == c] for c in range(owner.max() + 1)]
            node.children = [make(part) for part in parts if len(part)]
        return node

    root = make(np.arange(len(points)))
    return root


def dual_search(qids, queries, worst, ids, data, k: int, leaf: int) -> list[list[tuple[int, int]]]:
    """The best k (score, -id) of each query in the data, below ``worst`` nothing need be found.

    ``worst`` is a score that each query is known to reach k times. Pairs of nodes are taken best
    bound first, so that good scores come early and prune the rest.
    """
    best: list[list[tuple[int, int]]] = [[] for _ in qids]
    bar = np.array(worst, float)
    if not len(qids) or not len(ids):
        return best
    qf, xf = queries.astype(float), data.astype(float)

    def bound(q: Node, x: Node) -> float:
        b = float(q.centre @ x.centre) + q.radius * x.norm + x.radius * q.norm + q.radius * x.radius
        return b + abs(b) * 1e-9 + 1e-6

    def meet(q: Node, x: Node) -> None:
        scores = products(queries[q.rows], data[x.rows])
        for i, row in zip(q.rows, scores):
            hit = np.flatnonzero((row >= bar[i]) & (ids[x.rows] != qids[i]))
            if len(hit) > k:
                hit = hit[np.lexsort((ids[x.rows[hit]], -row[hit]))][:k]
            for j in hit:
                entry = (int(row[j]), -int(ids[x.rows[j]]))
                if len(best[i]) < k:
                    heapq.heappush(best[i], entry)
                elif entry > best[i][0]:
                    heapq.heapreplace(best[i], entry)
            if len(best[i]) == k:
                bar[i] = max(bar[i], best[i][0][0])

    q_root, x_root = cover_tree(qf, leaf), cover_tree(xf, leaf)
    turn = 0
    heap = [(-bound(q_root, x_root), turn, q_root, x_root)]
    while heap:
        reach, _, q, x = heapq.heappop(heap)
        if -reach < bar[q.rows].min():
            continue
        if not q.children and not x.children:
            meet(q, x)
            continue
        split_q = q.children and (not x.children or q.radius >= x.radius)
        for a, b in [(c, x) for c in q.children] if split_q else [(q, c) for c in x.children]:
            reach = bound(a, b)
            if reach >= bar[a.rows].min():
                turn += 1
                heapq.heappush(heap, (-reach, turn, a, b))
    return best


def spread_pivots(points: np.ndarray, count: int) -> np.ndarray:
    """Farthest-first choice of up to ``count`` different rows."""
    chosen, near = [0], ((points - points[0]) ** 2).sum(axis=1)
    while len(chosen) < min(count, len(points)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
    return points[chosen]


def top_k(vectors: DataFrame, is_query: Column, config: SearchConfig = SearchConfig(), column: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that ``is_query`` (over vec_id) selects."""
    spark = vectors.sparkSession
    rows = usable(vectors, column).select(
        "vec_id", integral(F.col("v"), config.scale).alias("v"), F.size("v").alias("dim"), is_query.alias("is_query")
    )
    # A bounded sample by hash: the pivots, and a first kth score for every query.
    draw = rows.select("vec_id", "v", "dim").orderBy(F.xxhash64("vec_id"), "vec_id").limit(config.sample).collect()
    sample: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for dim in sorted({r["dim"] for r in draw}):
        own = [r for r in draw if r["dim"] == dim]
        sample[dim] = (
            np.array([r["vec_id"] for r in own], np.int64),
            np.array([r["v"] for r in own], np.int64).reshape(len(own), dim),
        )
    pivots = {dim: spread_pivots(v.astype(float), config.pivots) for dim, (_, v) in sample.items()}

    def dealt(batches):
        for pdf in batches:
            out = []
            for dim, part in pdf.groupby("dim"):
                x = matrix(part["v"], dim)
                ids = part["vec_id"].to_numpy()
                if dim in pivots:
                    p = pivots[dim]
                    d2 = (x.astype(float) ** 2).sum(1)[:, None] - 2 * x.astype(float) @ p.T + (p**2).sum(1)
                    group = d2.argmin(axis=1)
                    away = np.sqrt(((x - p[group]) ** 2).sum(axis=1))
                else:
                    group, away = np.zeros(len(part), np.int64), np.full(len(part), np.inf)
                first = np.full(len(part), -np.inf)
                asks = np.flatnonzero(part["is_query"].fillna(False).to_numpy(bool))
                if dim in sample and len(asks):
                    scores = products(x[asks], sample[dim][1]).astype(float)
                    scores[ids[asks][:, None] == sample[dim][0][None, :]] = -np.inf
                    if scores.shape[1] >= config.k:
                        first[asks] = np.partition(scores, -config.k, axis=1)[:, -config.k]
                out.append(part.assign(grp=group, away=away, first=first))
            if out:
                yield pd.concat(out)[["vec_id", "v", "dim", "is_query", "grp", "away", "first"]]

    schema = "vec_id long, v array<long>, dim int, is_query boolean, grp long, away double, first double"
    placed = stage(rows.mapInPandas(dealt, schema), "search-groups")
    # One row per group: at most ``pivots`` for each length of vectors in the sample.
    facts = placed.groupBy("dim", "grp").agg(
        F.count(F.lit(1)).alias("n"),
        F.max("away").alias("radius"),
        F.max(F.when(F.col("is_query"), F.col("away"))).alias("q_radius"),
        F.min(F.when(F.col("is_query"), F.col("first"))).alias("worst"),
    )
    groups = facts.collect()
    meetings = []
    for q in groups:
        for g in groups:
            if q["dim"] != g["dim"] or q["q_radius"] is None:
                continue
            if g["dim"] in pivots:
                a, b = pivots[g["dim"]][q["grp"]], pivots[g["dim"]][g["grp"]]
                ra, rb = q["q_radius"], g["radius"]
                reach = a @ b + ra * np.sqrt(b @ b) + rb * np.sqrt(a @ a) + ra * rb
                if reach + abs(reach) * 1e-9 + 1 < q["worst"]:
                    continue
            meetings.append((g["dim"], q["grp"], g["grp"], -(-g["n"] // config.block)))
    blocks = [(g["dim"], g["grp"], -(-g["n"] // config.block)) for g in groups]
    blocks = spark.createDataFrame(blocks, "dim int, grp long, blocks long")
    meetings = spark.createDataFrame(meetings, "dim int, grp long, to long, blocks long")
    meetings = meetings.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)))
    data = placed.select("dim", "grp", "vec_id", "v").join(blocks, ["dim", "grp"])
    part = F.pmod(F.xxhash64("vec_id", F.lit(5)), F.col("blocks")).cast("int")
    data = data.select("dim", F.col("grp").alias("to"), part.alias("part"), "vec_id", "v")
    asked = (
        placed.where("is_query").select("dim", "grp", "vec_id", "v", "first").join(meetings, ["dim", "grp"])
    ).select(
        F.col("dim").alias("q_dim"), F.col("to").alias("q_to"), F.col("part").alias("q_part"),
        F.col("vec_id").alias("query_id"), F.col("v").alias("q"), "first",
    )

    def answered(asks: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        names = ["query_id", "vec_id", "score"]
        if not len(asks) or not len(block):
            return pd.DataFrame({n: pd.Series([], dtype="int64") for n in names})
        dim = int(asks["q_dim"].iloc[0])
        q, x = matrix(asks["q"], dim), matrix(block["v"], dim)
        ids, qids = block["vec_id"].to_numpy(np.int64), asks["query_id"].to_numpy(np.int64)
        best = dual_search(qids, q, asks["first"].to_numpy(float), ids, x, config.k, config.leaf)
        found = [(int(qid), -neg, score) for qid, own in zip(qids, best) for score, neg in own]
        return pd.DataFrame(found, columns=names).astype("int64")

    partial = (
        asked.groupBy("q_dim", "q_to", "q_part")
        .cogroup(data.groupBy("dim", "to", "part"))
        .applyInPandas(answered, "query_id long, vec_id long, score long")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        partial.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= config.k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )
