"""Rank stability under redrawn weights: one job over spaces x draws, no loop."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spacelens.config import METRIC_WEIGHTS, ScoreConfig, SensitivityConfig
from spacelens.operators.placing import with_positions
from spacelens.operators.scoring import opportunity_index, pillar_expressions, win_gate


def weight_draws(config: SensitivityConfig, score: ScoreConfig = ScoreConfig()) -> list[dict]:
    """Dirichlet draws around the configured weights; block order: pillar blend, then pillars.

    A parameter table of ``iterations`` rows, so it is drawn once on the driver.
    """
    rng = np.random.default_rng(config.seed)
    blocks = {"moi_weights": score.pillar_weights, **score.metric_weights}
    draws = []
    for i in range(config.iterations):
        row: dict = {"draw": i}
        for block, weights in blocks.items():
            alpha = np.maximum(np.array(list(weights.values()), dtype=float), 1e-6)
            for name, value in zip(weights, rng.dirichlet(alpha * config.concentration), strict=True):
                row[f"{block}__{name}"] = float(value)
        draws.append(row)
    return draws


def _weight_names() -> list[str]:
    pillars = ("market_attractiveness", "future_potential", "competitive_headroom")
    names = ["moi_weights__" + p for p in pillars]
    return names + [f"{p}__{m}" for p, block in METRIC_WEIGHTS.items() for m in block]


def draws_column(draws: list[dict]) -> Column:
    """The parameter table as one constant array, exploded per row instead of joined."""
    fields = ", ".join(f"{n}: double" for n in _weight_names())
    return F.from_json(F.lit(json.dumps(draws)), f"array<struct<draw: int, {fields}>>")


def rescore(percentiles: DataFrame, draws: list[dict], score: ScoreConfig) -> DataFrame:
    """(level, space_id, draw, priority_score, market_opportunity_index) for every draw."""
    spread = percentiles.withColumn("_w", F.explode(draws_column(draws)))

    def weight(block: str, name: str) -> Column:
        return F.col(f"_w.{block}__{name}")

    pillars = pillar_expressions(weight)
    index = opportunity_index(pillars, weight)
    return spread.select(
        "level",
        "space_id",
        F.col("_w.draw").alias("draw"),
        index.alias("market_opportunity_index"),
        (index * win_gate(pillars["right_to_win"], score)).alias("priority_score"),
    )


def sensitivity(
    percentiles: DataFrame,
    baseline: DataFrame,
    draws: list[dict],
    config: SensitivityConfig = SensitivityConfig(),
    score: ScoreConfig = ScoreConfig(),
    score_column: str = "priority_score",
) -> DataFrame:
    """Position statistics per space over all draws, next to its baseline position.

    ``baseline`` is the scored table of the same spaces (space_label and score columns).
    """
    rescored = rescore(percentiles, draws, score).select(
        "level", "space_id", "draw", F.round(score_column, 9).alias("_score")
    )
    # A written table of the levels' spaces times the draws, sorted into ranges of equal size.
    order = [F.desc_nulls_last("_score"), F.col("space_id")]
    placed = with_positions(rescored, ["level", "draw"], order, "position")
    by_space = ["level", "space_id"]
    stats = placed.groupBy(*by_space).agg(
        F.round(F.count_if(F.col("position") <= config.top_k) / len(draws), 4)
        .alias("top_k_frequency"),
        F.round(F.avg("position"), 2).alias("mean_rank"),
        # At most one value per draw, a number the config fixes.
        F.median("position").alias("median_rank"),
        F.max("position").cast("int").alias("worst_rank"),
        F.min("position").cast("int").alias("best_rank"),
    )
    start = baseline.select(*by_space, "space_label", F.round(score_column, 9).alias("_score"))
    ranked = with_positions(start, ["level"], order, "baseline_rank")
    ranked = ranked.withColumn("baseline_rank", F.col("baseline_rank").cast("int"))
    return ranked.drop("_score").join(stats, by_space).withColumns(
        {
            "is_robust": F.col("top_k_frequency") >= config.robust_at,
            "is_fragile": (F.col("baseline_rank") <= config.top_k)
            & (F.col("top_k_frequency") < config.fragile_below),
        }
    )


def summary(stability: DataFrame, limit: int = 12) -> DataFrame:
    return stability.orderBy(F.desc("top_k_frequency"), "mean_rank", "space_id").limit(limit)


