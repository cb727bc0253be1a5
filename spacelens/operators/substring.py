"""Substring join: which terms occur in which texts, as an equi-join.

Each text offers all its distinct pieces of seed length and shorter. A term is met by one piece
of its own, the one that the fewest texts offer (a term shorter than a seed: by itself), so a
beginning or ending that most texts share opens no candidates. A term with a piece that no text
offers occurs nowhere. Pairs that share the seed are checked in full: the result is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spacelens.sources.stage import stage

SEED = 3


def _of_size(text: Column, size: int) -> Column:
    n = F.length(text)
    starts = F.sequence(F.lit(1), n - size + 1)
    return F.when(
        n >= size, F.transform(starts, lambda i: F.substring(text, i, F.lit(size)))
    ).otherwise(F.array().cast("array<string>"))


def _pieces(text: Column) -> Column:
    return F.array_distinct(F.flatten(F.array(*[_of_size(text, k) for k in range(1, SEED + 1)])))


def _own_pieces(term: Column) -> Column:
    """The pieces of seed length; a shorter term is its own piece."""
    return F.when(F.length(term) < SEED, F.array(term)).otherwise(
        F.array_distinct(_of_size(term, SEED))
    )


def rarest_seeds(words: DataFrame, term: str, frequency: DataFrame) -> DataFrame:
    """(term, _seed): the piece of each term that the fewest texts offer (_n of ``frequency``).

    Terms with a piece that ``frequency`` lacks are left out.
    """
    own = words.select(term, F.explode(_own_pieces(F.col(term))).alias("_piece"))
    met = own.join(frequency, "_piece", "left")
    # At most the pieces of one term.
    return (
        met.groupBy(term)
        .agg(
            F.min_by("_piece", F.struct("_n", "_piece")).alias("_seed"),
            F.bool_or(F.col("_n").isNull()).alias("_absent"),
        )
        .where(~F.col("_absent"))
        .select(term, "_seed")
    )


def substring_join(
    texts: DataFrame, text: str, terms: DataFrame, term: str
) -> DataFrame:
    """Distinct (text, term) pairs where the non-empty term occurs in the text."""
    words = stage(terms.select(term).where(F.length(term) > 0).distinct(), "terms_asked")
    asked = words.select(F.explode(_own_pieces(F.col(term))).alias("_piece")).distinct()
    # Only pieces that some term holds are written; everything below starts from those.
    offered = stage(
        texts.select(text).where(F.length(text) > 0).distinct()
        .withColumn("_piece", F.explode(_pieces(F.col(text))))
        .join(asked, "_piece", "left_semi"),
        "pieces_offered",
    )
    frequency = offered.groupBy("_piece").agg(F.count(F.lit(1)).alias("_n"))
    seeds = rarest_seeds(words, term, frequency)
    return (
        offered.join(seeds, F.col("_piece") == F.col("_seed"))
        .where(F.contains(F.col(text), F.col(term)))
        .select(text, term)
    )
