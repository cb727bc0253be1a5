"""Approximate nearest neighbours by cosine: NN-descent builds a graph, queries walk it greedily.

Index. Rows of one and the same vector are one node, so a very common vector weighs no more than
any other. Nodes first meet in leaves of random hyperplane trees and in one random dealing (parts
of bounded size, by hash). Then rounds of NN-descent, as Spark joins: each node gathers its
neighbours and a hashed choice of the nodes whose neighbour it is, scores those pairs of which one
side is new, and proposes each side to the other where it beats that side's worst neighbour; the
best ``neighbours`` proposals stay. Rounds end when few edges change. Inside the graph vectors
are one byte a component; edges, not vectors, are what grows.

Search. A query starts at its own node. Each round it opens its best nodes not yet opened, meets
their neighbours by a join with the graph (dealt by node once, and kept), and keeps the best
``beam`` nodes; it ends when all of these are opened. What a beam holds is then scored in
double precision on the original vectors.

All groups are bounded: leaves by their parts, lists by ``neighbours`` and ``reverse``, beams by
``beam``; of a node's ids the smallest k + 1 can answer. Every row is indexed. The result is
approximate: some true neighbours may be missed, never misplaced or misscored.

Defined cases: rows without an id and vectors that are null, empty, zero, or hold null or
non-finite components take no part; vectors of different lengths are never compared; repeated rows
are candidates of their own, except that a row never answers a query of its own id; equal
queries (same id and vector) are answered once; a query with fewer than k candidates found gets
those; ties go to the smaller id; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spacelens.sources.stage import stage


@dataclass(frozen=True)
class GraphConfig:
    """neighbours, reverse: kept forward and considered backward edges of a node; trees, leaf: of
    the first meeting; rounds, settled: most rounds, and the share of edges changed that ends
    them; beam, opened: nodes a query keeps, and opens a round; hops: most rounds of the search.
    """

    k: int = 5
    neighbours: int = 32
    reverse: int = 32
    trees: int = 3
    leaf: int = 192
    rounds: int = 5
    settled: float = 0.02
    beam: int = 320
    opened: int = 64
    hops: int = 12
    seed: int = 17


#: Below any cosine.
NONE = -2.0
SALTS = 64


def _coded(v: np.ndarray) -> tuple[np.ndarray, bytes]:
    """The vector, scaled by a power of two if its squares could leave the range, and its bytes."""
    top = float(np.abs(v).max())
    e = int(math.frexp(top)[1])
    if abs(e) > 400:
        v = np.ldexp(v, -e)
        top = float(np.abs(v).max())
    return v, np.rint(v * (127.0 / top)).astype(np.int8).tobytes()


def index_nodes(vectors: DataFrame, config: GraphConfig, column: str) -> DataFrame:
    """(node, dim, code, scaled, h, v, ids): one row for each different vector; ids: its k + 1 smallest, with copies."""
    x = F.transform(column, lambda c: c.cast("double"))
    rows = vectors.select("vec_id", x.alias("v")).where(_usable("v"))
    # The hash goes first, so that sorting rarely compares whole vectors; the vector decides.
    rows = rows.withColumn("h", F.xxhash64("v"))
    copies = rows.groupBy("h", "v", "vec_id").agg(F.least(F.count(F.lit(1)), F.lit(config.k)).alias("copies"))
    place = F.row_number().over(Window.partitionBy("h", "v").orderBy("vec_id"))
    few = copies.withColumn("place", place).where(F.col("place") <= config.k + 1)
    kinds = few.groupBy("h", "v").agg(F.array_sort(F.collect_list(F.struct("vec_id", "copies"))).alias("ids"))

    def work(batches):
        for batch in batches:
            column = batch.column("v")
            offsets, values = column.offsets.to_numpy(), column.flatten().to_numpy(zero_copy_only=False)
            done = [_coded(values[a:b]) for a, b in zip(offsets - offsets[0], offsets[1:] - offsets[0])]
            scaled = pa.ListArray.from_arrays(pa.array(offsets - offsets[0], pa.int32()), np.concatenate([v for v, _ in done] or [values]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.diff(offsets), pa.int32()), pa.array([c for _, c in done], pa.binary()), scaled, *batch.select(["h", "v", "ids"]).columns],
                names=["dim", "code", "scaled", "h", "v", "ids"],
            )

    ids = kinds.schema["ids"].dataType.simpleString()
    coded = kinds.mapInArrow(work, f"dim int, code binary, scaled array<double>, h long, v array<double>, ids {ids}")
    return stage(coded.withColumn("node", F.monotonically_increasing_id()), "ann-nodes")


def _usable(column: str) -> Column:
    fine = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col("vec_id").isNotNull() & F.col(column).isNotNull() & fine & F.exists(column, lambda x: x != 0)


def _lists(column: pa.Array):
    """(bounds, struct fields) of a list<struct> column."""
    values = column.flatten()
    offsets = column.offsets.to_numpy()
    return (offsets - offsets[0]).tolist(), {f.name: values.field(f.name) for f in values.type}


def _bytes_of(codes: pa.Array) -> tuple[np.ndarray, list[int]]:
    codes = codes.cast(pa.large_binary())
    offsets = np.frombuffer(codes.buffers()[1], np.int64)[codes.offset : codes.offset + len(codes) + 1]
    return np.frombuffer(codes.buffers()[2] or b"", np.int8), offsets.tolist()


def _unit(data: np.ndarray, rows: int) -> np.ndarray:
    x = data.reshape(rows, -1).astype(np.float32)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _edge_batch(v: list, u: list, score: list) -> pa.RecordBatch:
    joined = [np.concatenate(x) if x else np.zeros(0, t) for x, t in ((v, np.int64), (u, np.int64), (score, np.float32))]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in joined], names=["v", "u", "score"])


EDGES = "v long, u long, score float"


def _best(edges: DataFrame, keep: int) -> DataFrame:
    """The best ``keep`` edges of each v; an edge met more than once counts once."""
    once = edges.groupBy("v", "u").agg(F.max("score").alias("score"), F.min("fresh").alias("fresh"))
    place = F.row_number().over(Window.partitionBy("v").orderBy(F.desc("score"), "u"))
    return once.withColumn("place", place).where(F.col("place") <= keep).drop("place")


def first_edges(nodes: DataFrame, config: GraphConfig) -> DataFrame:
    """Edges among the nodes of each leaf of random trees, and of one random dealing."""
    count = nodes.count()
    bits = min(48, max(0, math.ceil(math.log2(max(count, 1) / config.leaf))))

    def leaves(batches):
        for batch in batches:
            data, offsets = _bytes_of(batch.column("code"))
            dims = batch.column("dim").to_numpy()
            out = np.zeros((len(dims), config.trees + 1), np.int64)
            for dim in np.unique(dims).tolist() if bits else []:
                own = np.flatnonzero(dims == dim)
                x = np.stack([data[offsets[i] : offsets[i + 1]] for i in own.tolist()]).astype(np.float32)
                planes = np.random.default_rng([config.seed, dim]).normal(size=(config.trees, bits, dim)).astype(np.float32)
                for t in range(config.trees):
                    out[own, t] = (x @ planes[t].T > 0) @ (np.int64(1) << np.arange(bits, dtype=np.int64))
            columns = [batch.column("node"), batch.column("dim"), batch.column("code")]
            leaf = pa.ListArray.from_arrays(np.arange(0, out.size + 1, config.trees + 1, dtype=np.int32), out.ravel())
            yield pa.RecordBatch.from_arrays([*columns, leaf], names=["node", "dim", "code", "leaf"])

    placed = nodes.select("node", "dim", "code").mapInArrow(leaves, "node long, dim int, code binary, leaf array<long>")
    placed = placed.select("node", "dim", "code", F.posexplode("leaf").alias("tree", "leaf"))
    # The last tree deals at random; the rows of a hot leaf meet its size under several salts.
    chance = F.xxhash64("node", "tree")
    dealt = F.pmod(chance, F.lit(max(1, count // config.leaf)))
    placed = placed.withColumn("leaf", F.when(F.col("tree") == config.trees, dealt).otherwise(F.col("leaf")))
    placed = placed.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    key = ["tree", "dim", "leaf"]
    parts = placed.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / (2 * config.leaf)).alias("parts"))
    parts = parts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    part = F.pmod(F.xxhash64(chance), F.col("parts"))
    groups = (
        placed.join(parts, [*key, "salt"])
        .groupBy(*key, part.alias("part"))
        .agg(F.collect_list(F.struct("node", "code")).alias("members"))
        .select("members")
    )

    def met(batches):
        for batch in batches:
            bounds, fields = _lists(batch.column("members"))
            data, offsets = _bytes_of(fields["code"])
            node = fields["node"].to_numpy()
            vs, us, scores = [], [], []
            for a, b in zip(bounds, bounds[1:]):
                if b - a < 2:
                    continue
                x = _unit(data[offsets[a] : offsets[b]], b - a)
                s = x @ x.T
                np.fill_diagonal(s, NONE)
                keep = min(config.neighbours, b - a - 1)
                top = np.argpartition(-s, keep - 1, axis=1)[:, :keep]
                vs.append(np.repeat(node[a:b], keep))
                us.append(node[a:b][top].ravel())
                scores.append(np.take_along_axis(s, top, 1).ravel())
            yield _edge_batch(vs, us, scores)

    return _best(groups.mapInArrow(met, EDGES).withColumn("fresh", F.lit(True)), config.neighbours)


def _backward(edges: DataFrame, keep: int, *order: Column) -> DataFrame:
    """For each node up to ``keep`` of the nodes whose neighbour it is, the first by ``order``."""
    back = edges.select(F.col("u").alias("v"), F.col("v").alias("u"), "fresh", "score")
    place = F.row_number().over(Window.partitionBy("v").orderBy(*order))
    return back.withColumn("place", place).where(F.col("place") <= keep).drop("place")


def _local_join(batches):
    """Scores the pairs of each list of which one is fresh; gives those above the bar of a side."""
    for batch in batches:
        bounds, fields = _lists(batch.column("members"))
        data, offsets = _bytes_of(fields["code"])
        u, bar = fields["u"].to_numpy(), fields["bar"].to_numpy()
        fresh = fields["fresh"].to_numpy(zero_copy_only=False)
        vs, us, scores = [], [], []
        for a, b in zip(bounds, bounds[1:]):
            new = fresh[a:b]
            if not new.any():
                continue
            x = _unit(data[offsets[a] : offsets[b]], b - a)
            s = x @ x.T
            wins = (s > bar[a:b, None]) & (new[:, None] | new[None, :])
            np.fill_diagonal(wins, False)
            i, j = np.nonzero(wins)
            vs.append(u[a:b][i])
            us.append(u[a:b][j])
            scores.append(s[i, j])
        yield _edge_batch(vs, us, scores)


def neighbour_graph(nodes: DataFrame, config: GraphConfig) -> DataFrame:
    """Edges (v, u, score, fresh) after NN-descent."""
    codes = nodes.select("node", "code")
    edges = stage(first_edges(nodes, config), "ann-edges")
    total = edges.count()
    for r in range(config.rounds):
        chance = F.xxhash64("v", "u", F.lit(config.seed + r))
        back = _backward(edges, config.reverse, F.desc("fresh"), chance).drop("score")
        itself = codes.select(F.col("node").alias("v"), F.col("node").alias("u"), F.lit(False).alias("fresh"))
        members = edges.drop("score").union(back.select("v", "u", "fresh")).union(itself)
        members = members.groupBy("v", "u").agg(F.max("fresh").alias("fresh"))
        worst = F.when(F.count(F.lit(1)) >= config.neighbours, F.min("score")).otherwise(NONE).cast("float")
        bars = edges.groupBy(F.col("v").alias("node")).agg(worst.alias("bar"))
        known = codes.join(bars, "node", "left").select(
            F.col("node").alias("u"), "code", F.coalesce("bar", F.lit(NONE).cast("float")).alias("bar")
        )
        lists = members.join(known, "u").groupBy("v").agg(F.collect_list(F.struct("u", "code", "bar", "fresh")).alias("members"))
        proposed = lists.select("members").mapInArrow(_local_join, EDGES).withColumn("fresh", F.lit(True))
        kept = edges.withColumn("fresh", F.lit(False)).unionByName(proposed)
        edges = stage(_best(kept, config.neighbours), "ann-edges")
        if edges.where("fresh").count() <= config.settled * total:
            break
    return edges


def _opened(batches):
    """Scores of the neighbours of opened nodes against the query, above the query's bar."""
    for batch in batches:
        bounds, fields = _lists(batch.column("members"))
        data, offsets = _bytes_of(fields["code"])
        asked, starts = _bytes_of(batch.column("asks"))
        u, q, bar = fields["u"].to_numpy(), batch.column("q").to_numpy(), batch.column("bar").to_numpy()
        qs, us, scores = [], [], []
        for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
            s = _unit(data[offsets[a] : offsets[b]], b - a) @ _unit(asked[starts[k] : starts[k + 1]], 1)[0]
            hit = np.flatnonzero(s > bar[k])
            qs.append(np.full(len(hit), q[k]))
            us.append(u[a:b][hit])
            scores.append(s[hit])
        yield _edge_batch(qs, us, scores)


def walk(nodes: DataFrame, edges: DataFrame, starts: DataFrame, config: GraphConfig) -> DataFrame:
    """(q, node): the beam of each start node ``q`` after a greedy walk of the graph."""
    spark = nodes.sparkSession
    codes = nodes.select("node", "code")
    back = _backward(edges, config.reverse, F.desc("score"), F.col("u"))
    both = edges.select("v", "u").union(back.select("v", "u")).distinct()
    lists = both.join(codes.withColumnRenamed("node", "u"), "u").groupBy(F.col("v").alias("node"))
    graph = stage(lists.agg(F.collect_list(F.struct("u", "code")).alias("members")), "ann-graph")
    # Dealt by node once; each round brings the opened nodes to it.
    graph = graph.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "node").persist(StorageLevel.MEMORY_AND_DISK)
    asks = stage(starts.select("q").distinct().join(codes, F.col("q") == F.col("node")).select("q", F.col("code").alias("asks")), "ann-asks")
    beam = asks.select("q", F.col("q").alias("u"), F.lit(1.0).cast("float").alias("score"), F.lit(False).alias("done"), F.lit(True).alias("next"), F.lit(NONE).cast("float").alias("bar"))
    own = Window.partitionBy("q")
    for _ in range(config.hops):
        front = beam.where("next").select("q", F.col("u").alias("node"), "bar").join(asks, "q")
        hits = front.join(graph, "node").select("q", "asks", "bar", "members").mapInArrow(_opened, EDGES)
        hits = hits.select(F.col("v").alias("q"), "u", "score", F.lit(False).alias("done"))
        seen = beam.select("q", "u", "score", (F.col("done") | F.col("next")).alias("done")).union(hits)
        once = seen.repartition("q").groupBy("q", "u").agg(F.max("score").alias("score"), F.max("done").alias("done"))
        place = F.row_number().over(own.orderBy(F.desc("score"), "u"))
        kept = once.withColumn("place", place).where(F.col("place") <= config.beam).drop("place")
        turn = F.row_number().over(Window.partitionBy("q", "done").orderBy(F.desc("score"), "u"))
        full = F.when(F.count(F.lit(1)).over(own) >= config.beam, F.min("score").over(own)).otherwise(NONE).cast("float")
        beam = stage(
            kept.select("q", "u", "score", "done", (~F.col("done") & (turn <= config.opened)).alias("next"), full.alias("bar")),
            "ann-beam",
        )
        if beam.where("next").isEmpty():
            break
    graph.unpersist()
    return beam.select("q", F.col("u").alias("node"))


def nearest(vectors: DataFrame, is_query: Column, config: GraphConfig = GraphConfig(), column: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that ``is_query`` (over vec_id) selects."""
    nodes = index_nodes(vectors, config, column)
    x = F.transform(column, lambda c: c.cast("double"))
    queries = vectors.where(is_query).select(F.col("vec_id").alias("query_id"), "vec_id", x.alias("v")).where(_usable("v")).drop("vec_id")
    queries = queries.distinct().withColumn("h", F.xxhash64("v"))
    queries = queries.join(nodes.select("node", "h", "v"), ["h", "v"]).select("query_id", F.col("node").alias("q"))
    queries = stage(queries, "ann-queries")
    found = walk(nodes, neighbour_graph(nodes, config), queries, config)

    def vectors_as(node: str, name: str, *more: str) -> DataFrame:
        norm = F.sqrt(F.aggregate("scaled", F.lit(0.0), lambda s, y: s + y * y))
        return nodes.select(F.col("node").alias(node), F.col("scaled").alias(name), norm.alias(f"{name}_norm"), *more)

    pairs = found.join(vectors_as("q", "a"), "q").join(vectors_as("node", "b", "ids"), "node")
    dot = F.aggregate(F.zip_with("a", "b", lambda p, r: p * r), F.lit(0.0), lambda s, y: s + y)
    scored = pairs.select("q", "ids", (dot / (F.col("a_norm") * F.col("b_norm"))).alias("score"))
    answers = scored.join(queries, "q").select("query_id", "q", "score", F.explode("ids").alias("id"))
    answers = answers.where(F.col("id.vec_id") != F.col("query_id"))
    answers = answers.select("query_id", "q", "score", F.col("id.vec_id").alias("vec_id"), F.explode(F.sequence(F.lit(1), F.col("id.copies").cast("int"))))
    order = Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id")
    ranked = answers.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= config.k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
