"""Signals to spaces: match cascade, diminishing contributions, centred trend multiplier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spacelens.config import LinkConfig
from spacelens.functions.ratios import clip
from spacelens.operators.ranking import interpolated_percentiles
from spacelens.operators.substring import substring_join
from spacelens.sources.signals import signed_magnitude

SPACE_KEYS = ["level", "space_id"]
SHOWN = 3


def _targets(signals: DataFrame) -> DataFrame:
    """(id, kind, folded): 1 molecule, 2 sub-segment, 3 segment, 4 keyword; lower case."""
    lists = [(1, "molecules"), (2, "sub_segments"), (3, "segments"), (4, "keywords")]

    def tagged(kind: int):
        return lambda t: F.struct(F.lit(kind).alias("kind"), F.lower(F.trim(t)).alias("folded"))

    items = [F.transform(column, tagged(kind)) for kind, column in lists]
    each = signals.select("id", F.inline(F.concat(*items)))
    return each.where("folded <> ''").distinct()


def match_signals(spaces: DataFrame, signals: DataFrame, space_molecules: DataFrame) -> DataFrame:
    """(level, space_id, id, match_reason): molecule, else sub-segment, else segment, else keyword."""
    targets = _targets(signals)
    label = F.lower("space_label").alias("label")
    exact_keys = F.array(
        F.struct(F.lit(2).alias("kind"), F.lower(F.trim("sub_segment")).alias("folded")),
        F.struct(F.lit(3).alias("kind"), F.lower(F.trim("segment")).alias("folded")),
    )
    owned = space_molecules.select(
        *SPACE_KEYS, F.lit(1).alias("kind"), F.lower("molecule").alias("folded")
    )
    exact = spaces.select(*SPACE_KEYS, F.inline(exact_keys)).unionByName(owned).join(
        targets, ["kind", "folded"]
    )
    # A segment counts only when equal; the other kinds also when the label contains them.
    loose = targets.where("kind <> 3")
    found = substring_join(spaces.select(label), "label", loose, "folded")
    contained = (
        spaces.select(*SPACE_KEYS, label).join(found, "label").join(loose, "folded").drop("label")
    )
    hits = exact.unionByName(contained)
    # The set is at most the target list of one signal.
    per_kind = hits.groupBy(*SPACE_KEYS, "id", "kind").agg(F.collect_set("folded").alias("found"))
    best = per_kind.groupBy(*SPACE_KEYS, "id").agg(
        F.min("kind").alias("kind"), F.min_by("found", "kind").alias("found")
    )
    shown = F.array_join(F.slice(F.array_sort("found"), 1, SHOWN), ", ")
    named = F.coalesce(F.when(F.col("sub_segment") != "", F.col("sub_segment")), F.col("space_label"))
    context = spaces.select(*SPACE_KEYS, "space_label", "segment", "sub_segment")
    return best.join(context, SPACE_KEYS).select(
        *SPACE_KEYS,
        "id",
        F.when(F.col("kind") == 1, F.concat(F.lit("molecule match: "), F.upper(shown)))
        .when(F.col("kind") == 2, F.concat(F.lit("sub-segment match: "), named))
        .when(F.col("kind") == 3, F.concat(F.lit("segment match: "), F.col("segment")))
        .otherwise(F.concat(F.lit("keyword match: "), shown))
        .alias("match_reason"),
    )


def signal_links(
    spaces: DataFrame,
    signals: DataFrame,
    space_molecules: DataFrame,
    config: LinkConfig = LinkConfig(),
) -> DataFrame:
    """Every attachment with its weight: in a category the strongest signal counts fully."""
    moving = signals.withColumn("signed", signed_magnitude()).where(F.abs("signed") >= 1e-9)
    matched = match_signals(spaces, moving, space_molecules).join(
        moving.select("id", "category", "signed"), "id"
    )
    # A mergeable minimum instead of a window: a category may hold most of the signals.
    strongest = matched.groupBy(*SPACE_KEYS, "category").agg(
        F.min_by("id", F.struct(-F.abs("signed"), F.col("id"))).alias("_first")
    )
    weight = F.when(F.col("id") == F.col("_first"), 1.0).otherwise(config.secondary_weight)
    return matched.join(strongest, [*SPACE_KEYS, "category"]).select(
        *SPACE_KEYS,
        F.col("id").alias("signal_id"),
        "category",
        F.concat(
            F.col("match_reason"), F.lit(" (category "), F.col("category"), F.lit(", weight "),
            F.format_number(weight, 1), F.lit(")"),
        ).alias("match_reason"),
        (F.col("signed") * weight).alias("contribution"),
    )


def neutral_trend(spaces: DataFrame) -> DataFrame:
    """Without signals every multiplier is 1."""
    return spaces.withColumns(
        {
            "trend_tilt_raw": F.lit(0.0), "trend_signal_ids": F.lit(""),
            "trend_tilt_baseline": F.lit(0.0), "trend_multiplier": F.lit(1.0),
        }
    )


def add_trend_multiplier(
    spaces: DataFrame, links: DataFrame, config: LinkConfig = LinkConfig()
) -> DataFrame:
    """Tilt centred on the level median and clipped; spaces without links tilt by 0."""
    tilts = links.groupBy(*SPACE_KEYS).agg(
        F.round(F.sum("contribution"), 9).alias("trend_tilt_raw"),
        F.array_join(F.array_sort(F.collect_set("signal_id")), ",").alias("trend_signal_ids"),
    )
    out = spaces.join(tilts, SPACE_KEYS, "left").fillna(
        {"trend_tilt_raw": 0.0, "trend_signal_ids": ""}
    )
    # The result has one row per level.
    middle = interpolated_percentiles(out, ["level"], "trend_tilt_raw", {"trend_tilt_baseline": 0.5})
    return out.join(F.broadcast(middle), "level").withColumn(
        "trend_multiplier",
        clip(
            1.0 + (F.col("trend_tilt_raw") - F.col("trend_tilt_baseline")),
            config.multiplier_min,
            config.multiplier_max,
        ),
    )
