"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight and a linear schedule over training time t in [0, 1]: its rate at t is
``weight * (1 + slope * (2 t - 1))``. The integral over all of training is the weight, which
fixes how many words the source gives in total (its target); the integral up to t, its
cumulative demand, says how many it has given by then. A source's documents stand in a fixed
random order on one line of words that is read again from the start when it ends. The middle of
each reading of a document is a demand; the inverse of the cumulative demand is the training
position of that reading. Documents are range-sorted by position.

Defined cases: null texts have size 0 and are never taken; a null source is a source of its own,
last in order; texts are taken whole: the reading at which the demand ends is taken or left,
whichever lies nearer, and a source's long documents stand where the demand does not end among
them, if there is such a place; repeated rows are documents of their own, ties in order are broken
by size; an empty table or one without
words gives targets of 0. Reruns agree: the order is md5 of the id. Input columns of any name are
kept in the struct ``row``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spacelens.llm.words import packed, word_count


@dataclass(frozen=True)
class MixConfig:
    """weights and slopes repeat over the sources in order of their names. share: words taken
    for each word there is. most: how often a source may be read.
    """

    #: Words from which a document is long: such are kept away from the end of a source's demand.
    long: int = 2000
    weights: tuple[float, ...] = (5.0, 2.0, 1.0)
    slopes: tuple[float, ...] = (-0.6, 0.0, 0.6)
    share: float = 1.5
    most: int = 2


def targets(sizes: DataFrame, config: MixConfig = MixConfig()) -> DataFrame:
    """(source, size) rows to one row per source: its words, weight, slope and target.

    Shares above ``most`` readings stop there and the excess is shared out by weight again until
    none is above: sources are full from the lowest size per weight upwards, so the level at
    which the rest share is found by one running sum over the table of sources.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    cycle = lambda values: F.get(F.array(*map(F.lit, values)), place % len(values))
    per = per.withColumns({"weight": cycle(config.weights), "slope": cycle(config.slopes)})
    cap = (config.most * F.col("source_size")).cast("double")
    everything = Window.orderBy(cap / F.col("weight"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    before = everything.rowsBetween(Window.unboundedPreceding, -1)
    after = everything.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    per = per.withColumns({"cap": cap, "all": F.sum("source_size").over(whole) * config.share})
    level = (F.col("all") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    per = per.withColumn("full", F.col("cap") <= level * F.col("weight"))
    rest = F.col("all") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(whole)
    open_weight = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(whole)
    target = F.when(F.col("full"), F.col("cap")).otherwise(rest * F.col("weight") / open_weight)
    return per.select("source", "source_size", "weight", "slope", target.alias("target"))


def inverse_demand(u: Column, slope: Column) -> Column:
    """The t at which the cumulative demand ``t + slope * (t * t - t)`` is ``u``."""
    b = 1 - slope
    return F.when(u <= 0, F.lit(0.0)).otherwise(2 * u / (b + F.sqrt(b * b + 4 * slope * u)))


def placed(docs: DataFrame, config: MixConfig = MixConfig(), payload: bool = True) -> DataFrame:
    """Every document with its source's numbers and its ``readings``: structs (words, position).

    The words before a document in its source come from two short running sums: inside one of
    256 slices of the random order (and as many of the long documents), and over the slices'
    totals, so a source that holds a third of all rows is worked on by 256 tasks. Without ``payload`` only ids and sizes are shuffled.
    """
    size = word_count(F.col("row.text"))
    turn = F.md5(F.coalesce(F.col("row.doc_id").cast("string"), F.lit("")))
    cell = [(F.col("size") >= config.long).alias("is_long"), F.substring("turn", 1, 2).alias("slice")]
    kept = F.col("row") if payload else F.struct("row.doc_id", "row.source").alias("row")
    sized = packed(docs).select(
        kept,
        F.col("row.doc_id").alias("doc_id"),
        F.col("row.source").alias("source"),
        size.alias("size"),
        turn.alias("turn"),
    ).select("*", *cell)
    slim = packed(docs.select("doc_id", "source", "text")).select(
        F.col("row.source").alias("source"), size.alias("size"), turn.alias("turn")
    ).select("source", "size", *cell)
    slices = slim.groupBy("source", "is_long", "slice").agg(F.sum("size").alias("size"))
    per = targets(slices, config).withColumn("demand", F.round("target").cast("long"))
    slices = slices.join(per.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
    long_words = F.sum(F.when(F.col("is_long"), F.col("size")).otherwise(0)).over(Window.partitionBy("source"))
    # Long documents first if the last pass holds them all, else last.
    first = F.try_mod(F.col("demand"), F.col("source_size")) >= F.col("long_words")
    in_source = Window.partitionBy("source").orderBy(F.col("is_long") != F.coalesce("first", F.lit(False)), "slice")
    starts = slices.withColumn("long_words", long_words).withColumn("first", first)
    starts = starts.withColumn("slice_start", F.sum("size").over(in_source) - F.col("size"))
    starts = starts.withColumnsRenamed({"is_long": "_long", "slice": "_slice"}).drop("source", "size", "first", "long_words")
    in_slice = Window.partitionBy("source", "is_long", "slice").orderBy("turn", "size")
    running = F.sum("size").over(in_slice.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ordered = sized.withColumn("_before", running - F.col("size"))
    met = ordered.join(
        starts,
        F.col("source").eqNullSafe(F.col("_source"))
        & (F.col("is_long") == F.col("_long"))
        & (F.col("slice") == F.col("_slice")),
    )
    demand = F.col("demand")

    def reading(k):
        start = k * F.col("source_size") + F.col("slice_start") + F.col("_before")
        # The document at which the demand ends is read whole or left, whichever lies nearer.
        words = F.when(2 * (demand - start) >= F.col("size"), F.col("size")).otherwise(F.lit(0).cast("long"))
        middle = F.when(words > 0, (start + words / 2) / demand)
        return F.struct(words.alias("words"), inverse_demand(middle, F.col("slope")).alias("position"))

    readings = F.filter(F.array(*[reading(k) for k in range(config.most)]), lambda r: r["words"] > 0)
    return met.select("row", "doc_id", "source", "turn", "size", "source_size", "target", readings.alias("readings"))


def mix_plan(docs: DataFrame, config: MixConfig = MixConfig()) -> DataFrame:
    """One row per document: words taken and training positions, in order of first position."""
    plan = placed(docs.select("doc_id", "source", "text"), config, payload=False)
    first = F.get("readings", 0)["position"]
    taken = F.aggregate("readings", F.lit(0).cast("long"), lambda a, r: a + r["words"])
    plan = plan.select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        taken.alias("taken"),
        first.alias("position"),
        F.get("readings", 1)["position"].alias("position_again"),
        "turn",
    )
    # The random order splits rows that share a position, such as all those never taken.
    return plan.repartitionByRange("position", "turn").sortWithinPartitions("position", "turn").drop("turn")


def mixed_documents(docs: DataFrame, config: MixConfig = MixConfig()) -> DataFrame:
    """The training stream: a row with the document's columns for each reading, range-sorted.

    Texts are whole: the document at which a source's demand ends is read or left.
    """
    plan = placed(docs, config).select("row", "turn", F.explode("readings").alias("r"))
    plan = plan.select("row", "turn", F.col("r.position").alias("position"))
    return (
        plan.repartitionByRange("position", "turn")
        .sortWithinPartitions("position", "turn")
        .select("row.*")
    )
