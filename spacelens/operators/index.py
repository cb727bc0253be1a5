"""Inverted text index: word postings and character-trigram counts."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spacelens.functions.text import STOP_WORDS
from spacelens.sources.stage import stage, stage_by

CHUNK = ["doc_id", "chunk_no"]


#: A gram as one number: its code points plus one, 21 bits each, the first one highest.
POINT_BITS = 21
#: Characters counted at once in a task.
SLICE = 1 << 17
#: Grams whose weights are sent whole, about 50 bytes each.
SENT_GRAMS = 1 << 20
#: Bytes whose terms are counted at once in a task.
TERM_SLICE = 1 << 20
#: True at the bytes that terms consist of.
_TERM = np.isin(np.arange(256), np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789", np.uint8))


def _term_runs(texts: pa.Array, lists: np.ndarray):
    """(list, number in the dictionary, tf, length) and the dictionary of the terms of lower-case
    texts, the ``lists`` of which ascend. ``length`` counts the terms of a text; of texts in one list
    that hold a term, the longest one's is taken.
    """
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    inside = _TERM[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first = inside & (edge[:-1] | ~np.concatenate([[False], inside[:-1]])[: len(data)])
    starts = np.flatnonzero(first)
    # Bytes inside terms follow each other; a term ends where the next one starts.
    bounds = np.append(np.cumsum(inside)[starts] - 1, inside.sum()).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(data[inside]))
    coded = words.dictionary_encode()
    stop = pc.is_in(coded.dictionary, pa.array(STOP_WORDS, pa.large_string())).to_numpy(zero_copy_only=False)
    code = coded.indices.to_numpy().astype(np.int64)
    kept = ~stop[code]
    code = code[kept]
    text = np.searchsorted(offsets, starts[kept], "right") - 1
    length = np.bincount(text, minlength=len(texts))
    size, many = max(len(stop), 1), max(len(texts), 1)
    keys = np.sort((lists[text] * size + code) * many + text)
    term = keys // many
    new = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])[: len(keys)])
    tf = np.diff(np.append(new, len(keys)))
    longest = np.maximum.reduceat(length[keys % many], new) if len(new) else new
    return term[new] // size, term[new] % size, tf, longest, coded.dictionary


def _term_lists(texts: pa.Array) -> pa.Array:
    """Lists of lower-case texts to lists of (term, tf, length), counted over all texts of a list."""
    kind = pa.list_(pa.struct([("term", pa.string()), ("tf", pa.int64()), ("length", pa.int32())]))
    parts, at = [], 0
    bounds = texts.offsets.to_numpy() - texts.offsets[0].as_py()
    flat = texts.flatten().cast(pa.large_string())
    sizes = np.concatenate([[0], np.cumsum(pc.binary_length(flat).to_numpy(zero_copy_only=False))])
    while at < len(texts):
        # Whole lists, up to TERM_SLICE bytes at once, one list at least.
        to = max(at + 1, int(np.searchsorted(sizes[bounds], sizes[bounds[at]] + TERM_SLICE, "right")) - 1)
        own = flat.slice(bounds[at], bounds[to] - bounds[at])
        rows = np.repeat(np.arange(to - at), np.diff(bounds[at : to + 1]))
        row, code, tf, length, terms = _term_runs(own, rows)
        offsets = np.searchsorted(row, np.arange(to - at + 1)).astype(np.int32)
        values = [terms.take(pa.array(code)).cast(pa.string()), pa.array(tf, pa.int64()), pa.array(length, pa.int32())]
        found = pa.StructArray.from_arrays(values, fields=list(kind.value_type))
        parts.append(pa.ListArray.from_arrays(pa.array(offsets), found))
        at = to
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def word_postings(chunks: DataFrame) -> DataFrame:
    """(doc_id, chunk_no, term, tf, length): one row per distinct term of a passage.

    The terms are those of ``tokens``. Texts that lie in blocks by their keys stay where they are, and
    a passage is counted in the task that reads it: only distinct terms become rows.
    """
    counted = F.arrow_udf(_term_lists, "array<struct<term: string, tf: bigint, length: int>>")
    # The texts of one key, mostly one.
    each = chunks.groupBy(*CHUNK).agg(F.collect_list(F.lower("text")).alias("_t"))
    return each.select(*CHUNK, F.inline(counted("_t")))


def _gram_runs(rows: np.ndarray, points: np.ndarray, lengths: np.ndarray):
    """(row, gram, count) of texts given as one run of code points; ``rows`` may repeat.

    A text shorter than three characters is its own gram; an empty one has none.
    """
    text = np.repeat(np.arange(len(lengths)), lengths)
    # Small numbers for the characters met, so that a row and a gram sort as one number.
    place = np.zeros(int(points.max(initial=0)) + 1, dtype=np.int64)
    place[points] = 1
    alphabet = np.flatnonzero(place)
    size = len(alphabet) + 1
    place[alphabet] = np.arange(1, size)
    small = place[points]
    ends = np.cumsum(lengths)
    full = np.flatnonzero(text[:-2] == text[2:]) if len(points) > 2 else np.zeros(0, int)
    short = np.flatnonzero((lengths > 0) & (lengths < 3))
    head = ends[short] - lengths[short]
    second = np.where(lengths[short] == 2, small[np.minimum(head + 1, len(points) - 1)], 0) if len(short) else head
    row = np.concatenate([rows[text[full]], rows[short]])
    gram = np.concatenate(
        [(small[full] * size + small[full + 1]) * size + small[full + 2], (small[head] * size + second) * size]
    ).astype(np.int64)
    cube = size**3
    if len(rows) and (int(rows.max()) + 1) * cube < 2**63:
        keys = np.sort(row * cube + gram)
        new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
        counts = np.diff(np.concatenate([new, [len(keys)]]))
        keys = keys[new]
        row, gram = keys // cube, keys % cube
    else:  # an alphabet too large for one number
        order = np.lexsort((gram, row))
        row, gram = row[order], gram[order]
        same = (row[1:] == row[:-1]) & (gram[1:] == gram[:-1])
        new = np.flatnonzero(np.concatenate([[True], ~same])[: len(row)])
        counts = np.diff(np.concatenate([new, [len(row)]]))
        row, gram = row[new], gram[new]
    value = np.concatenate([[0], alphabet + 1])
    first, rest = gram // (size * size), gram % (size * size)
    code = (value[first] << (2 * POINT_BITS)) | (value[rest // size] << POINT_BITS) | value[rest % size]
    return row, code, counts


def _gram_lists(texts: pa.Array) -> pa.Array:
    """Lists of lower-case texts to lists of (gram, tf), counted over all texts of a list, squashed."""
    kind = pa.list_(pa.struct([("gram", pa.int64()), ("tf", pa.int64())]))
    parts, at = [], 0
    bounds = texts.offsets.to_numpy() - texts.offsets[0].as_py()
    # Splits at the blanks of ``squash``.
    flat = [b" ".join(t.split()).decode("utf-8", "surrogatepass") for t in texts.flatten().cast(pa.binary()).to_pylist()]
    sizes = np.cumsum([0] + [len(t) for t in flat])
    while at < len(texts):
        # Whole lists, up to SLICE characters at once, one list at least.
        to = max(at + 1, int(np.searchsorted(sizes[bounds], sizes[bounds[at]] + SLICE, "right")) - 1)
        own = flat[bounds[at] : bounds[to]]
        rows = np.repeat(np.arange(to - at), np.diff(bounds[at : to + 1]))
        points = np.frombuffer("".join(own).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        row, gram, tf = _gram_runs(rows, points, np.array([len(t) for t in own], dtype=np.int64))
        offsets = np.searchsorted(row, np.arange(to - at + 1)).astype(np.int32)
        pairs = pa.StructArray.from_arrays(
            [pa.array(gram, pa.int64()), pa.array(tf, pa.int64())], fields=list(kind.value_type)
        )
        parts.append(pa.ListArray.from_arrays(pa.array(offsets), pairs))
        at = to
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def gram_vectors(texts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, counts): the distinct grams of each key's texts as one list of (gram, tf).

    Texts in blocks by ``keys`` stay where they are. A passage is counted by one sort of numbers
    in the task that reads it, so no table of grams grows with a block.
    """
    counted = F.arrow_udf(_gram_lists, "array<struct<gram: bigint, tf: bigint>>")
    # The texts of one key, mostly one.
    each = texts.groupBy(*keys).agg(F.collect_list(F.lower("text")).alias("_t"))
    return each.select(*keys, counted("_t").alias("counts"))


def gram_counts(texts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, gram, tf): one row per distinct gram of a key's texts."""
    return gram_vectors(texts, keys).select(*keys, F.inline("counts"))


def word_stats(chunks: DataFrame, postings: DataFrame) -> DataFrame:
    """One row: number of passages and their average length in tokens."""
    total = postings.agg(F.coalesce(F.sum("tf"), F.lit(0))).scalar()
    return chunks.agg(F.count(F.lit(1)).alias("passages")).select(
        "passages", F.coalesce(F.try_divide(total, F.col("passages")), F.lit(0.0)).alias("avg_length")
    )


def document_frequency(postings: DataFrame, key: str) -> DataFrame:
    return postings.groupBy(key).agg(F.count(F.lit(1)).alias("df"))


def gram_idf(counts: DataFrame, chunks: DataFrame) -> DataFrame:
    total = chunks.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("n")).scalar()
    return document_frequency(counts, "gram").select(
        "gram", F.log(1.0 + total / (1.0 + F.col("df"))).alias("idf")
    )


def gram_weight() -> Column:
    return (1.0 + F.log(F.col("tf").cast("double"))) * F.col("idf")


def gram_norms(counts: DataFrame, idf: DataFrame, keys: list[str]) -> DataFrame:
    """Euclidean length of each text's weighted grams; unknown grams weigh nothing."""
    w = gram_weight()
    sums = counts.join(idf, "gram").groupBy(*keys).agg(F.sqrt(F.sum(w * w)).alias("norm"))
    return sums.withColumn("norm", F.when(F.col("norm") > 0, F.col("norm")).otherwise(1.0))


def beside(idf: DataFrame) -> DataFrame:
    """A written table of grams, sent whole to the rows it meets if it has few; those stay in place."""
    return F.broadcast(idf) if idf.count() <= SENT_GRAMS else idf


@dataclass
class TextIndex:
    """Written index tables. Queries join to them by term or gram, never scan passages.

    Passages, postings and grams lie in blocks by passage, so sums over a passage, and the best
    passages of a block, come out of the task that reads the block.
    """

    chunks: DataFrame
    postings: DataFrame
    terms: DataFrame
    stats: DataFrame
    grams: DataFrame  # one row per passage: gram_vectors
    idf: DataFrame
    norms: DataFrame

    @classmethod
    def build(cls, chunks: DataFrame, blocks: int | None = None) -> "TextIndex":
        """``blocks``: how many; the session's shuffle partitions if not given."""
        blocks = blocks or int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        # The one shuffle of texts; the tables made from them are written where they lie.
        chunks = stage_by(chunks.repartition(blocks, *CHUNK), "chunks", CHUNK, blocks)
        postings = stage_by(word_postings(chunks), "postings", CHUNK, blocks)
        terms = stage(document_frequency(postings, "term"), "terms")
        grams = stage_by(gram_vectors(chunks, CHUNK), "gram_vectors", CHUNK, blocks)
        counts = grams.select(*CHUNK, F.inline("counts"))
        idf = stage(gram_idf(counts, chunks), "gram_idf")
        norms = stage_by(gram_norms(counts, beside(idf), CHUNK), "gram_norms", CHUNK, blocks)
        stats = stage(word_stats(chunks, postings), "text_stats")
        return cls(chunks, postings, terms, stats, grams, idf, norms)
