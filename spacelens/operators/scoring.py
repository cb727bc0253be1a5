"""Percentile scores, pillars, opportunity index, right-to-win gate, ranks and verdicts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spacelens.config import INVERTED_METRICS, METRIC_COLUMNS, METRIC_WEIGHTS, ScoreConfig
from spacelens.operators.ranking import (
    interpolated_percentiles,
    percentile_rank,
    rank_desc,
)
from spacelens.sources.stage import stage

PILLARS = tuple(METRIC_WEIGHTS)
METRICS = tuple(m for block in METRIC_WEIGHTS.values() for m in block)
SPACE_KEYS = ["level", "space_id"]


def score_column(metric: str) -> str:
    return "score_" + metric


def split_survivors(spaces: DataFrame, config: ScoreConfig) -> tuple[DataFrame, DataFrame]:
    """(scored input, excluded with a reason); the size reason wins over the player reason."""
    small = F.col("value_t2") < config.min_value
    closed = F.coalesce("n_players", F.lit(0)) < config.min_players
    excluded = spaces.where(small | closed).withColumn(
        "exclusion_reason",
        F.when(small, f"below size floor of {config.min_value:.0f}").otherwise(
            f"fewer than {config.min_players} active players"
        ),
    )
    return spaces.where(~(small | closed)), excluded


def _long_metrics(spaces: DataFrame) -> DataFrame:
    """Metrics at nine decimals: the order in which partial sums met must not split a tie."""
    pairs = [
        F.struct(
            F.lit(m).alias("metric"),
            F.round(F.col(METRIC_COLUMNS[m]).cast("double"), 9).alias("value"),
        )
        for m in METRICS
    ]
    return spaces.select(*SPACE_KEYS, F.inline(F.array(*pairs)))


def winsorise(spaces: DataFrame, config: ScoreConfig) -> DataFrame:
    """(level, space_id, metric, value, clipped): bounds over all surviving rows of all levels."""
    long = _long_metrics(spaces)
    keys = ["level", "metric"] if config.winsor_per_level else ["metric"]
    bounds = interpolated_percentiles(
        long.where("value IS NOT NULL AND NOT isnan(value)"),
        keys,
        "value",
        {"low": config.winsor_low, "high": config.winsor_high},
    )
    filled = F.coalesce(F.nanvl("value", F.lit(None).cast("double")), "low", F.lit(0.0))
    inside = F.least(F.greatest(filled, F.col("low")), F.col("high"))
    # One row per metric (and level): the config fixes this size.
    return long.join(F.broadcast(bounds), keys, "left").select(
        *SPACE_KEYS,
        "metric",
        "value",
        F.when(F.col("high") > F.col("low"), inside).otherwise(filled).alias("clipped"),
    )


def percentile_scores(spaces: DataFrame, config: ScoreConfig) -> DataFrame:
    """(level, space_id, metric, value, clipped, pct): 0-100 within the level, higher is better."""
    clipped = stage(winsorise(spaces, config), "clipped")
    ranked = percentile_rank(clipped, ["level", "metric"], "clipped", "pct")
    flipped = F.col("metric").isin(*sorted(INVERTED_METRICS)) & ~F.col("constant")
    better = F.when(flipped, 100.0 - F.col("pct")).otherwise(F.col("pct"))
    return ranked.withColumn("pct", better).drop("constant")


def metric_percentiles(spaces: DataFrame, config: ScoreConfig) -> DataFrame:
    """One row per space with one score column per metric."""
    return percentile_scores(spaces, config).groupBy(*SPACE_KEYS).agg(
        *[
            F.max(F.when(F.col("metric") == m, F.col("pct"))).alias(score_column(m))
            for m in METRICS
        ]
    )


def _add(columns) -> Column:
    return reduce(lambda a, b: a + b, columns)


def pillar_expressions(weight) -> dict[str, Column]:
    """Pillar scores; ``weight(block, name)`` gives a number or a column."""
    return {
        p: _add(F.col(score_column(m)) * weight(p, m) for m in block)
        for p, block in METRIC_WEIGHTS.items()
    }


def opportunity_index(pillars: dict[str, Column], weight) -> Column:
    return _add(
        pillars[p] * weight("moi_weights", p)
        for p in ("market_attractiveness", "future_potential", "competitive_headroom")
    )


def win_gate(right_to_win: Column, config: ScoreConfig) -> Column:
    share = F.least(F.greatest(right_to_win, F.lit(0.0)), F.lit(100.0)) / 100.0
    return config.gate_floor + (config.gate_ceiling - config.gate_floor) * F.pow(
        share, F.lit(config.gate_curve)
    )


def config_weight(config: ScoreConfig):
    def weight(block: str, name: str) -> Column:
        source = config.pillar_weights if block == "moi_weights" else config.metric_weights[block]
        return F.lit(float(source.get(name, 0.0)))

    return weight


def pillar_scores(percentiles: DataFrame, config: ScoreConfig) -> DataFrame:
    columns = pillar_expressions(config_weight(config))
    return percentiles.withColumns({"pillar_" + p: c for p, c in columns.items()})


def headline_scores(pillars: DataFrame, config: ScoreConfig) -> DataFrame:
    index = opportunity_index({p: F.col("pillar_" + p) for p in PILLARS}, config_weight(config))
    return (
        pillars.withColumn("market_opportunity_index", index)
        .withColumn("right_to_win_score", F.col("pillar_right_to_win"))
        .withColumn("rtw_gate", win_gate(F.col("right_to_win_score"), config))
        .withColumn("priority_score", F.col("market_opportunity_index") * F.col("rtw_gate"))
    )


def verdicts(scored: DataFrame, config: ScoreConfig) -> DataFrame:
    def band(column, high, medium, low):
        return (
            F.when(F.col(column) >= config.band_high, high)
            .when(F.col(column) >= config.band_medium, medium)
            .otherwise(low)
        )

    moi, rtw = F.col("moi_band"), F.col("rtw_band")
    return scored.withColumns(
        {
            "moi_band": band("market_opportunity_index", "High", "Medium", "Low"),
            "rtw_band": band("right_to_win_score", "Strong", "Moderate", "Weak"),
        }
    ).withColumn(
        "strategic_verdict",
        F.when((moi == "High") & (rtw == "Strong"), "Double down")
        .when((moi == "High") & (rtw == "Moderate"), "Build capability")
        .when((moi == "High") & (rtw == "Weak"), "Avoid or partner")
        .when((moi == "Medium") & rtw.isin("Strong", "Moderate"), "Selective participation")
        .otherwise("Harvest or exit"),
    )


def score_percentiles(
    percentiles: DataFrame, config: ScoreConfig
) -> DataFrame:
    """Percentiles to ranked and judged scores; what-if weights re-enter here.

    Ranks compare scores at nine decimals, so equal spaces tie whatever the order of sums.
    """
    scored = headline_scores(pillar_scores(percentiles, config), config)
    scored = stage(scored, "headline")
    for column, name in (("market_opportunity_index", "moi_rank"), ("priority_score", "cps_rank")):
        keyed = scored.withColumn("_key", F.round(column, 9))
        scored = rank_desc(keyed, ["level"], "_key", name).drop("_key")
    return verdicts(scored, config)


def build_scorecard(
    spaces: DataFrame, config: ScoreConfig, levels: list[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """(scored, excluded). ``spaces`` is a written table with every metric; the multiplier reads
    as 1 where no signals were linked."""
    if levels:
        spaces = spaces.where(F.col("level").isin(*levels))
    if "trend_multiplier" not in spaces.columns:
        spaces = spaces.withColumn("trend_multiplier", F.lit(1.0))
    kept, excluded = split_survivors(spaces, config)
    scores = score_percentiles(metric_percentiles(kept, config), config)
    return kept.join(scores, SPACE_KEYS), excluded


def top_spaces(scored: DataFrame, level: str, by: str = "priority_score", limit: int = 5) -> DataFrame:
    return (
        scored.where(F.col("level") == level)
        .orderBy(F.desc(F.round(by, 9)), "space_id")
        .limit(limit)
    )


def explain_score(scored: DataFrame) -> DataFrame:
    """Long form: one row per space and component (pillar or metric percentile)."""
    items = []
    for p, block in METRIC_WEIGHTS.items():
        items.append(
            F.struct(
                F.lit(p).alias("pillar"), F.lit("").alias("metric"),
                F.round("pillar_" + p, 1).alias("score"),
            )
        )
        items += [
            F.struct(
                F.lit(p).alias("pillar"), F.lit(m).alias("metric"),
                F.round(score_column(m), 1).alias("score"),
            )
            for m in block
        ]
    return scored.select(
        *SPACE_KEYS,
        F.round("market_opportunity_index", 1).alias("market_opportunity_index"),
        F.round("right_to_win_score", 1).alias("right_to_win_score"),
        F.round("rtw_gate", 3).alias("rtw_gate"),
        F.round("priority_score", 1).alias("priority_score"),
        "strategic_verdict",
        F.inline(F.array(*items)),
    )
