"""Near-duplicate classes by DartMinHash signatures and banded joining.

A document is the weighted set of its word shingles. Over every element lies a region, weight
high, in which hashed darts fall at rate ``coordinates`` per unit of weight and time; a dart has a
coordinate, a height and a time, all from the element's hash alone, and counts if its height is
under the weight. Each coordinate keeps its earliest dart. Two sets share the dart at a coordinate
with probability equal to their weighted Jaccard similarity, and only about t ln t darts are
thrown per document, whatever its length.

Runs of ``rows`` coordinates are band keys. Documents that share a key are candidates; texts that
are equal are one node from the start, so a key's members are different texts. First all members
meet the key's hub, the one whose keys are shared most: pairs whose sketches, four bits of every
coordinate, agree about as often as they must are verified exactly on the shingle sets. Most copies
are then in one component. The keys that still hold several are compared completely, as arrays
inside tasks: a key's members, cut into blocks of bounded size and their pairs of blocks, are held
against each other by their sketches, members without a possible partner in another component go,
and the exact sets of the others give the links. Of these a block hands on only those that join
components, fewer than it has members. So no pair is ever a row: a group of copies costs a few rows
per member, and a key whose texts stay apart costs array work on the pairs of them. A key of m
members beyond the block has (m / block) ** 2 / 2 pairs of blocks.

Defined cases: a text of one to four words is one shingle; texts without a word are near nothing
but equal texts; null texts are classes of their own; repeated rows and equal texts share a class;
a null id never names a class unless all its members have none; an empty table gives an empty
result. Two different texts whose 64-bit hashes agree would count as one: about one pair in ten
billion texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spacelens.llm.words import byte_codes, giving_back, mixed, packed, span_hashes, text_chunks, word_spans
from spacelens.sources.stage import stage


@dataclass(frozen=True)
class DartConfig:
    """bands * rows coordinates: a pair of similarity s shares a key with probability
    ``1 - (1 - s ** rows) ** bands``, 0.9999 at 0.8.
    """

    shingle: int = 5
    similarity: float = 0.8
    bands: int = 32
    rows: int = 6  # at most 16; bands at most 60
    seed: int = 3
    #: Most texts, and most shingles, of a block in the complete comparison of a key.
    block: int = 1024
    block_shingles: int = 2_000_000
    #: Positions of the bit map that spares splitting texts without a partner.
    map_bits: int = 26
    #: How far below ``similarity`` the estimate from the sketch may lie: 3.7 standard deviations.
    slack: float = 0.11

    @property
    def coordinates(self) -> int:
        return self.bands * self.rows


#: Upper ends of the counts 0, 1, 2, ... of a Poisson variable of mean 1.
_POISSON = np.cumsum(np.exp(-1.0) / np.cumprod(np.concatenate(([1.0], np.arange(1.0, 20.0)))))


def _unit(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(np.float64) * 2.0**-53


def dart_times(elements, weights, owner, count: int, t: int, seed: int) -> np.ndarray:
    """(count, t) earliest dart times of ``count`` weighted sets given as parallel arrays.

    ``owner`` is the set of each element; a set's elements are distinct. Times are the signature:
    equal times are equal darts. Sets without elements keep infinite times.

    A cell is one unit of weight by 1 / t of time and gets a Poisson number of darts of mean 1.
    A set of weight w is read up to time (ln t + 3) / w, and further while a coordinate is empty.
    """
    total = np.bincount(owner, weights, count)
    out = np.full((count, t), np.inf)
    reach = np.where(total > 0, (np.log(t) + 3) * t / np.where(total > 0, total, 1), 0)
    todo = np.flatnonzero(total > 0)
    while len(todo):
        mine = np.zeros(count, bool)
        mine[todo] = True
        pick = np.flatnonzero(mine[owner])
        o, w = owner[pick], weights[pick]
        slots = np.ceil(reach).astype(np.int64)[o]
        cells = np.ceil(w).astype(np.int64) * slots
        start = np.cumsum(cells) - cells
        e = np.repeat(np.arange(len(pick)), cells)
        place = np.arange(len(e)) - start[e]
        high, late = np.divmod(place, slots[e])
        h = mixed(elements[pick][e] ^ mixed((high << 32 | late).astype(np.uint64) + np.uint64(seed << 8)))
        darts = np.searchsorted(_POISSON, _unit(h))
        d = np.repeat(np.arange(len(e)), darts)
        nth = np.arange(len(d)) - (np.cumsum(darts) - darts)[d]
        h = mixed(h[d] + (nth + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        coordinate = (h % np.uint64(t)).astype(np.int64)
        h = mixed(h)
        height = high[d] + _unit(h)
        time = late[d] + _unit(mixed(h + np.uint64(1)))
        set_of = o[e[d]]
        good = (height < w[e[d]]) & (time < reach[set_of])
        np.minimum.at(out.reshape(-1), set_of[good] * t + coordinate[good], time[good])
        todo = todo[~np.isfinite(out[todo]).all(axis=1)]
        reach[todo] *= 2
    return out


def band_keys(times: np.ndarray, rows: int) -> np.ndarray:
    """(sets, bands) 64-bit keys; a key also holds its band's number."""
    bits = times.view(np.uint64).reshape(len(times), -1, rows)
    h = np.repeat(np.arange(bits.shape[1], dtype=np.uint64)[None], len(times), axis=0)
    for k in range(rows):
        h = mixed(h * np.uint64(0x100000001B3) + bits[:, :, k])
    return h


def sketches(times: np.ndarray, rows: int) -> np.ndarray:
    """(sets, words) 64-bit words with four bits of each coordinate; bands are not cut by words."""
    per = 16 // rows
    bits = (mixed(times.view(np.uint64)) >> np.uint64(60)).reshape(len(times), -1, rows)
    bits = np.pad(bits, ((0, 0), (0, -bits.shape[1] % per), (0, 0))).reshape(len(times), -1, per * rows)
    return (bits << (np.arange(per * rows, dtype=np.uint64) * np.uint64(4))).sum(axis=2, dtype=np.uint64)


def alike(a: str, b: str, config: DartConfig) -> Column:
    """Whether two sketch columns agree in enough coordinates for the similarity sought."""

    def differing(x, y):
        x = x.bitwiseXOR(y)
        for shift in (2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
        return F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))

    differ = F.aggregate(F.zip_with(a, b, differing), F.lit(0), lambda n, x: n + x)
    # Coordinates that differ still agree in their four bits one time in sixteen.
    most = config.coordinates * (1 - (config.similarity - config.slack)) * 15 / 16
    return differ <= F.lit(int(most))


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row of a piece."""
    starts, ends, bounds = word_spans(data, offsets)
    words = span_hashes(byte_codes(1)[data], starts, ends)
    n = len(words)
    grams = np.zeros(max(n - size + 1, 0), np.uint64)
    for k in range(size):
        grams = mixed(grams * np.uint64(0x100000001B3) + words[k : n - size + 1 + k]) if len(grams) else grams
    out = []
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a >= size:
            out.append(np.unique(grams[a : b - size + 1]))
        elif b > a:
            out.append(span_hashes(words[a:b], np.array([0]), np.array([b - a])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(docs: DataFrame, config: DartConfig) -> DataFrame:
    """(doc_id, node, n, bands, sketch): node is the text's hash (null for null texts), n the
    number of its shingles.
    """
    given = docs.select("doc_id", F.when(F.col("text").isNotNull(), F.xxhash64("text")).alias("node"), "text")
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def signed(batches):
        for batch in batches:
            sizes, keys, bits = [], [], []
            for _, data, offsets in text_chunks(batch.column(2), 1_000_000):
                sets = shingles(data, offsets, config.shingle)
                n = np.array([len(s) for s in sets], np.int64)
                elements = np.concatenate(sets)
                owner = np.repeat(np.arange(len(sets)), n)
                times = dart_times(elements, np.ones(len(elements)), owner, len(sets), config.coordinates, config.seed)
                sizes.append(n)
                keys.append(band_keys(times, config.rows).view(np.int64))
                bits.append(sketches(times, config.rows).view(np.int64))
            sizes = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
            keys = np.concatenate(keys) if keys else np.zeros((0, config.bands), np.int64)
            bits = np.concatenate(bits) if bits else np.zeros((0, 1), np.int64)
            arrays = [batch.column(0), batch.column(1), pa.array(sizes.astype(np.int32))]
            for values in (keys, bits):
                # Sets without a shingle have no keys.
                per = np.where(sizes > 0, values.shape[1], 0)
                offsets = np.concatenate(([0], np.cumsum(per))).astype(np.int32)
                arrays.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(values[sizes > 0].reshape(-1))))
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "node", "n", "bands", "sketch"])

    schema = f"doc_id {id_type}, node long, n int, bands array<long>, sketch array<long>"
    return given.mapInArrow(giving_back(signed), schema)


def node_map(nodes: DataFrame, bits: int) -> np.ndarray:
    """A bit for each node's hash modulo 2 ** bits: a table of fixed size, whatever the corpus."""
    place = F.pmod("node", F.lit(1 << bits))
    words = nodes.groupBy(F.shiftright(place, 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(pmod(node, 64) as int))")).alias("bits")
    )
    out = np.zeros(1 << (bits - 6), np.int64)
    for word, value in words.collect():
        out[word] = value
    return out


def candidate_sets(docs: DataFrame, wanted: DataFrame, config: DartConfig) -> DataFrame:
    """(node, elements): the shingle sets of the wanted (node, ident), one row each.

    ``ident`` names one document of the node, so equal texts do not meet in the join. Texts are
    split where they lie, but for those whose bit says that no wanted node has their hash.
    """
    node = F.xxhash64("text")
    ident = F.coalesce(F.col("doc_id").cast("string"), node.cast("string"))
    given = docs.where(F.col("text").isNotNull()).select(node.alias("node"), ident.alias("ident"), "text")
    bits, size = node_map(wanted, config.map_bits), 1 << config.map_bits

    def split(batches):
        for batch in batches:
            place = batch.column(0).to_numpy() % size
            maybe = pa.array((bits[place >> 6] >> (place & 63)) & 1 == 1)
            batch = batch.filter(maybe)
            sets = []
            for _, data, offsets in text_chunks(batch.column(2), 1_000_000):
                sets += shingles(data, offsets, config.shingle)
            values = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), values], ["node", "ident", "elements"])

    sets = given.mapInArrow(giving_back(split), "node long, ident string, elements array<long>")
    return sets.join(wanted, ["node", "ident"]).select("node", "elements").dropDuplicates(["node"])


def verified(pairs: DataFrame, sets: DataFrame, config: DartConfig) -> DataFrame:
    """The (a, b) pairs whose Jaccard similarity is high enough."""
    left = sets.select(F.col("node").alias("a"), F.col("elements").alias("ea"))
    right = sets.select(F.col("node").alias("b"), F.col("elements").alias("eb"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "ea", "eb")

    def checked(batches):
        for batch in batches:
            a, b = batch.column(2), batch.column(3)
            fa, fb = a.values.to_numpy(), b.values.to_numpy()
            oa, ob = a.offsets.to_numpy(), b.offsets.to_numpy()
            close = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = fa[oa[i] : oa[i + 1]], fb[ob[i] : ob[i + 1]]
                both = np.sort(np.concatenate((x, y)), kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                close[i] = shared >= config.similarity * (len(both) - shared) - 1e-9
            mask = pa.array(close)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    return joined.mapInArrow(giving_back(checked), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, comp) of every node in the links; comp is the component's smallest node.

    Smallest labels spread along links; then every node takes its label's label, which halves
    the way left each time.
    """
    both = links.union(links.select("b", "a")).toDF("a", "b").distinct()
    both = stage(both, "dedup-links")
    labels = stage(both.groupBy("a").agg(F.min("b").alias("least")).select(
        F.col("a").alias("node"), F.least("a", "least").alias("comp")
    ), "dedup-labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("comp").alias("near"))
        spread = labels.join(near.withColumnRenamed("a", "node"), "node").select(
            "node", "comp", F.least("comp", "near").alias("to")
        )
        spread = stage(spread, "dedup-spread")
        jump = spread.select(F.col("node").alias("_n"), F.col("to").alias("_to"))
        after = spread.join(jump, F.col("to") == F.col("_n"), "left").select(
            "node", "comp", F.coalesce(F.least("to", "_to"), F.col("to")).alias("to")
        )
        after = stage(after, "dedup-labels")
        if after.where("to <> comp").isEmpty():
            return labels
        labels = after.select("node", F.col("to").alias("comp"))


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels after further links: only the components these join are worked on."""
    ends = links
    for end in ("a", "b"):
        known = labels.select(F.col("node").alias(end), F.col("comp").alias(f"c{end}"))
        ends = ends.join(known, end, "left")
    pairs = ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a <> b")
    joined = components(pairs)
    moved = joined.select(F.col("node").alias("_comp"), F.col("comp").alias("_to"))
    old = labels.join(moved, F.col("comp") == F.col("_comp"), "left").select(
        "node", F.coalesce("_to", "comp").alias("comp")
    )
    return stage(old.union(joined.join(labels, "node", "left_anti").select("node", "comp")), "dedup-labels")


def _groups(column: pa.Array):
    """(bounds, struct fields) of a list<struct> column."""
    values, offsets = column.flatten(), column.offsets.to_numpy()
    return (offsets - offsets[0]).tolist(), {f.name: values.field(f.name) for f in values.type}


def _across(comp: np.ndarray, part: np.ndarray, other: bool) -> np.ndarray:
    """The pairs of a cell that may count: different components, and of two blocks one of each."""
    pairs = comp[:, None] != comp[None, :]
    return pairs & (part[:, None] != part[None, :]) if other else pairs


def _agreeing(sketch: np.ndarray, pairs: np.ndarray, most: int) -> np.ndarray:
    """Whether each row has a partner in ``pairs`` that differs in at most ``most`` coordinates."""
    ones = np.uint64(0x1111111111111111)
    live = np.zeros(len(sketch), bool)
    for i in np.flatnonzero(pairs.any(axis=1)).tolist():
        at = np.flatnonzero(pairs[i])
        x = sketch[at] ^ sketch[i]
        x |= x >> np.uint64(2)
        x |= x >> np.uint64(1)
        live[i] = (np.bitwise_count(x & ones).sum(axis=1, dtype=np.int64) <= most).any()
    return live


def _shared(elements: np.ndarray, owner: np.ndarray, rows: int) -> np.ndarray:
    """(rows, rows) counts of shared elements; the elements of a row are distinct."""
    out = np.zeros((rows, rows), np.float32)
    order = np.argsort(elements, kind="stable")
    e, o = elements[order], owner[order]
    start = np.flatnonzero(np.concatenate(([True], e[1:] != e[:-1])))
    size = np.diff(np.append(start, len(e)))
    keep = np.repeat(size > 1, size)
    number = np.repeat(np.cumsum(size > 1) - 1, size)[keep]
    o = o[keep]
    step = max(1, 4_000_000 // rows)
    for first in range(0, int(number[-1]) + 1 if len(number) else 0, step):
        a, b = np.searchsorted(number, [first, first + step])
        table = np.zeros((rows, step), np.float32)
        table[o[a:b], number[a:b] - first] = 1
        out += table @ table.T
    return out


def _joining(node: np.ndarray, comp: np.ndarray, close: np.ndarray) -> list[tuple[int, int]]:
    """Links, among the ``close`` pairs, that join components: fewer than there are rows."""
    root = {c: c for c in comp.tolist()}

    def top(c):
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    out = []
    for i, j in zip(*(x.tolist() for x in np.nonzero(np.triu(close, 1)))):
        a, b = top(int(comp[i])), top(int(comp[j]))
        if a != b:
            root[a] = b
            out.append((int(min(node[i], node[j])), int(max(node[i], node[j]))))
    return out


def open_links(met: DataFrame, labels: DataFrame, facts: DataFrame, sets: DataFrame, config: DartConfig) -> DataFrame:
    """(a, b): links between the components that share a key, found by comparing it completely.

    ``met`` has (key, node), ``facts`` (node, n, sketch).
    """
    known = facts.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    now = met.select("key", "node").join(known.select("node", "n", "comp"), "node")
    keys = now.groupBy("key").agg(
        F.count(F.lit(1)).alias("m"), F.sum("n").alias("size"), F.min("comp").alias("low"), F.max("comp").alias("high")
    )
    blocks = F.greatest(F.ceil(F.col("m") / config.block), F.ceil(F.col("size") / config.block_shingles))
    keys = keys.where("low <> high").select("key", blocks.cast("int").alias("blocks"))
    rows = stage(now.select("key", "node").join(keys, "key"), "dedup-open")
    part = F.pmod(F.xxhash64("node", F.lit(config.seed)), F.col("blocks")).cast("int")
    rows = rows.withColumn("part", part).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cell = ["key", "ca", "cb"]
    rows = rows.select("key", F.least("part", "with").alias("ca"), F.greatest("part", "with").alias("cb"), "node", "part")
    held = F.collect_list(F.struct("node", "part", "comp", "n", "sketch")).alias("members")
    groups = rows.join(known.select("node", "comp", "n", "sketch"), "node").groupBy(*cell).agg(held)
    most = int(config.coordinates * (1 - (config.similarity - config.slack)) * 15 / 16)

    def possible(batches):
        for batch in batches:
            bounds, f = _groups(batch.column("members"))
            words = f["sketch"].flatten().to_numpy().view(np.uint64).reshape(len(f["node"]), -1)
            node, part, comp, n = (f[c].to_numpy() for c in ("node", "part", "comp", "n"))
            live = np.zeros(len(node), bool)
            other = (batch.column("ca").to_numpy() != batch.column("cb").to_numpy()).tolist()
            for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
                pairs = _across(comp[a:b], part[a:b], other[k])
                m = n[a:b]
                pairs &= np.minimum(m[:, None], m) >= config.similarity * np.maximum(m[:, None], m)
                live[a:b] = _agreeing(words[a:b], pairs, most)
            at = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[live]
            columns = [batch.column(c).take(pa.array(at)) for c in cell]
            columns += [pa.array(x[live]) for x in (node, part, comp)]
            yield pa.RecordBatch.from_arrays(columns, names=[*cell, "node", "part", "comp"])

    live = groups.mapInArrow(giving_back(possible), "key long, ca int, cb int, node long, part int, comp long")
    live = stage(live, "dedup-live")
    held = F.collect_list(F.struct("node", "part", "comp", "elements")).alias("members")
    groups = live.join(sets, "node").groupBy(*cell).agg(held)

    def linked(batches):
        for batch in batches:
            bounds, f = _groups(batch.column("members"))
            node, part, comp = (f[c].to_numpy() for c in ("node", "part", "comp"))
            values, offsets = f["elements"].flatten().to_numpy(), f["elements"].offsets.to_numpy()
            offsets = offsets - offsets[0]
            other = (batch.column("ca").to_numpy() != batch.column("cb").to_numpy()).tolist()
            found = []
            for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
                size = np.diff(offsets[a : b + 1])
                owner = np.repeat(np.arange(b - a), size)
                shared = _shared(values[offsets[a] : offsets[b]], owner, b - a)
                close = shared >= config.similarity * (size[:, None] + size[None, :] - shared) - 1e-9
                found += _joining(node[a:b], comp[a:b], close & _across(comp[a:b], part[a:b], other[k]))
            a, b = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return groups.mapInArrow(giving_back(linked), "a long, b long").distinct()


def node_components(docs: DataFrame, signed: DataFrame, config: DartConfig) -> DataFrame | None:
    """(node, comp) of the nodes with a verified link; None if no key is shared."""
    nodes = (
        signed.where("n > 0")
        .groupBy("node")
        .agg(
            F.min(F.coalesce(F.col("doc_id").cast("string"), F.col("node").cast("string"))).alias("ident"),
            F.first("n").alias("n"),
            F.first("bands").alias("bands"),
            F.first("sketch").alias("sketch"),
        )
    )
    nodes = stage(nodes, "dedup-nodes")
    keyed = nodes.select("node", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    met = stage(keyed.join(shared, "key"), "dedup-met")
    support = met.groupBy("node").agg(F.sum("members").alias("support"))
    facts = nodes.select("node", "ident", "n", "sketch").join(support, "node")
    facts = stage(facts, "dedup-facts")
    if facts.isEmpty():
        return None
    sets = stage(candidate_sets(docs, facts.select("node", "ident"), config), "dedup-sets")

    best = F.struct("support", "node")
    hubs = met.join(facts.select("node", "support"), "node").groupBy("key").agg(F.max_by("node", best).alias("hub"))
    pair = [F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")]
    pairs = met.join(hubs, "key").where("node <> hub").select(*pair).distinct()
    left = facts.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    right = facts.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    fits = (F.least("na", "nb") >= config.similarity * F.greatest("na", "nb")) & alike("sa", "sb", config)
    pairs = stage(pairs.join(left, "a").join(right, "b").where(fits).select("a", "b"), "dedup-pairs")
    labels = components(stage(verified(pairs, sets, config), "dedup-verified"))
    found = stage(open_links(met, labels, facts, sets, config), "dedup-verified")
    return labels if found.isEmpty() else merged(labels, found)


def classes(docs: DataFrame, config: DartConfig = DartConfig()) -> DataFrame:
    """One row per row of ``docs``: doc_id, node, class_id (the smallest id of its class)."""
    docs = docs.select("doc_id", "text")
    signed = stage(signatures(docs, config), "dedup-signed")
    labels = node_components(docs, signed, config)
    # Equal texts first: one row per text, however many copies it has.
    texts = signed.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"))
    if labels is None:
        named = texts.select(F.col("node").alias("_node"), F.col("least").alias("_class"))
    else:
        labelled = texts.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        names = labelled.groupBy("comp").agg(F.min("least").alias("_class"))
        named = labelled.select("node", "comp").join(names, "comp").select(F.col("node").alias("_node"), "_class")
    return signed.join(named, F.col("node") == F.col("_node"), "left").select(
        "doc_id", "node", F.coalesce("_class", "doc_id").alias("class_id")
    )


def deduplicated(docs: DataFrame, config: DartConfig = DartConfig()) -> DataFrame:
    """The documents with their own columns, one of each class: the one of smallest id.

    A class is a component of texts, not a value of the id: texts without an id and different texts
    that share one are classes of their own. A null id comes after all others. Rows with null texts
    all stay. Of repeated rows of the chosen document one stays.
    """
    slim = docs.select("doc_id", "text")
    signed = stage(signatures(slim, config), "dedup-signed")
    labels = node_components(slim, signed, config)
    # Equal texts first: one row per text, however many copies it has.
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")
    least = signed.where("node is not null").groupBy("node").agg(F.min(order).alias("least"))
    if labels is not None:
        comp = F.coalesce("comp", "node").alias("comp")
        least = least.join(labels, "node", "left").select(comp, "least").groupBy("comp").agg(F.min("least").alias("least"))
    chosen = least.select(F.col("least.doc_id").alias("_chosen"), F.col("least.node").alias("_node"))
    text = F.col("row.text")
    given = packed(docs).select(
        "row", F.col("row.doc_id").alias("_id"), F.when(text.isNotNull(), F.xxhash64(text)).alias("_hash")
    )
    same = F.col("_id").eqNullSafe(F.col("_chosen")) & (F.col("_hash") == F.col("_node"))
    kept = given.join(chosen, same, "left_semi").dropDuplicates(["_id", "_hash"])
    return kept.union(given.where("_hash is null")).select("row.*")
