"""Overlapping passages of a document, cut at paragraph ends."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spacelens.config import RetrievalConfig


#: White space as ``strip`` has it, and line ends before which it stops too.
_BLANKS = b" \t\n\x0b\f\r"
_LINE_ENDS = tuple(c.encode() for c in "\u0085\u2028\u2029")


def _stripped(paragraph: bytes) -> bytes:
    """As ``strip``, whose pattern also ends before a last line end."""
    for end in _LINE_ENDS:
        if paragraph.endswith(end):
            return paragraph[: -len(end)].strip(_BLANKS) + end
    return paragraph.strip(_BLANKS)


def _passages(paragraphs: list[bytes], target: int, overlap: int) -> list[bytes]:
    """Whole paragraphs up to ``target`` words, led by the last ``overlap`` words before them."""
    out: list[bytes] = []
    words: list[bytes] = []
    own: list[bytes] = []
    held = 0
    for paragraph in map(_stripped, paragraphs):
        if not paragraph:
            continue
        # Splits at the blanks of ``squash``, so this counts as ``word_count`` does.
        more = paragraph.split()
        if own and held + len(more) > target:
            out.append(b"\n\n".join(own))
            held = min(held, overlap)
            tail = b" ".join(words[len(words) - held :])
            own = [tail] if tail else []
            words = words[len(words) - held :]
        own.append(paragraph)
        words += more
        held += len(more)
    if own:
        out.append(b"\n\n".join(own))
    return out


def _cut(config: RetrievalConfig):
    """The function from lists of paragraphs to lists of (chunk_no, text)."""
    target, overlap = config.chunk_words, config.overlap_words
    kind = pa.list_(pa.struct([("chunk_no", pa.int32()), ("text", pa.string())]))

    def cut(paragraphs: pa.Array) -> pa.Array:
        bounds = paragraphs.offsets.to_numpy() - paragraphs.offsets[0].as_py()
        flat = paragraphs.flatten().cast(pa.binary())
        found: list[list[bytes]] = []
        for start, end in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            found.append(_passages(flat.slice(start, end - start).to_pylist(), target, overlap))
        sizes = np.array([len(x) for x in found], dtype=np.int64)
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        number = np.arange(int(offsets[-1])) - np.repeat(offsets[:-1], sizes)
        texts = pa.array([t for x in found for t in x], pa.binary()).view(pa.string())
        pairs = pa.StructArray.from_arrays([pa.array(number, pa.int32()), texts], fields=list(kind.value_type))
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs)

    return F.arrow_udf(cut, "array<struct<chunk_no: int, text: string>>")


def chunk_documents(
    documents: DataFrame,
    config: RetrievalConfig = RetrievalConfig(),
    paragraph: str = "\n\n",
) -> DataFrame:
    """(doc_id, title, body) to (doc_id, chunk_no, title, text).

    A passage holds whole paragraphs up to the target number of words, led by the last words
    of the passage before it; the title goes in front. A document without a body gives its
    title.
    """
    # Passages are put together again inside the row, so no shuffle happens.
    pieces = F.split(F.coalesce("body", F.lit("")), paragraph)
    cut = documents.select("doc_id", "title", _cut(config)(pieces).alias("_passages"))
    out = cut.select("doc_id", "title", F.inline_outer("_passages"))
    return out.select(
        "doc_id",
        F.coalesce("chunk_no", F.lit(0)).alias("chunk_no"),
        "title",
        F.when(F.coalesce("text", F.lit("")) == "", F.col("title"))
        .otherwise(F.concat("title", F.lit("\n\n"), "text"))
        .alias("text"),
    )
