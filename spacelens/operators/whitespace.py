"""Attractive spaces where the focal company is underweight and has a way in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spacelens.config import WhitespaceConfig


def find_whitespace(
    scored: DataFrame,
    totals: DataFrame,
    config: WhitespaceConfig = WhitespaceConfig(),
    levels: list[str] | None = None,
    limit: int | None = 12,
) -> DataFrame:
    """Qualifying spaces by value gap; ``totals`` is the one-row market total."""
    frame = scored if not levels else scored.where(F.col("level").isin(*levels))
    overall = totals.select("focal_share").scalar()
    frame = frame.withColumn("_share", overall)
    adjacency, franchise = F.col("rtw_molecule_adjacency"), F.col("rtw_brand_franchise")
    adjacent = adjacency >= config.min_molecule_adjacency
    extendable = franchise >= config.min_brand_franchise
    kept = frame.where(
        (F.col("market_opportunity_index") >= config.min_moi)
        & (F.col("focal_share_t2") < F.col("_share") * config.penetration_ratio)
        & (F.col("value_t2") >= config.min_value)
        & (adjacent | extendable)
    )
    named = (franchise >= 1.0) & (F.col("adjacent_focal_brands") != "")
    route = F.concat_ws(
        "; ",
        F.when(named, F.concat(F.lit("brands: "), F.col("adjacent_focal_brands")))
        .when(extendable, "brands"),
        F.when(
            adjacent,
            F.concat(
                F.lit("molecules: "), F.round(adjacency * 100.0, 0).cast("int").cast("string"), F.lit("%")
            ),
        ),
        F.when(F.col("rtw_detailing_adjacency") > 0.02, "detailing"),
    )
    sized = kept.withColumns(
        {
            "fair_share_value": F.col("value_t2") * F.col("_share"),
            "value_gap": F.col("value_t2") * F.col("_share") - F.col("focal_value_t2"),
            "penetration_index": F.when(
                F.col("_share") != 0, F.col("focal_share_t2") / F.col("_share")
            ).otherwise(0.0),
            "route_to_win": F.when(route == "", "none").otherwise(route),
        }
    ).select(
        "level", "space_id", "space_label", "value_t2", "value_yoy", "real_growth",
        "market_opportunity_index", "right_to_win_score", "priority_score", "focal_value_t2",
        "focal_share_t2", "penetration_index", "fair_share_value", "value_gap", "route_to_win",
        "leader_company", "leader_share", "hhi", "strategic_verdict",
    )
    if limit is None:
        return sized
    return sized.orderBy(F.desc(F.round("value_gap", 6)), "level", "space_id").limit(limit)
