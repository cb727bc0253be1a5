"""Projection with mean reversion and a scenario band, one expression per row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spacelens.config import EPS, FORECAST_BLEND, ForecastConfig
from spacelens.functions.ratios import clip


def compound(value: Column, start: Column, market: Column, years: int, decay: float) -> Column:
    """Grow by market rate plus an excess over it that decays every year."""
    factors = [1.0 + market + (start - market) * (decay**k) for k in range(years)]
    return reduce(lambda a, b: a * b, factors, value)


def forecast_spaces(
    spaces: DataFrame, totals: DataFrame, config: ForecastConfig = ForecastConfig()
) -> DataFrame:
    """Project every space; ``totals`` is the one-row market total."""
    if not 1 <= config.horizon_years <= 10:
        raise ValueError("horizon_years must be between 1 and 10")
    years, decay = config.horizon_years, config.decay
    blended = reduce(
        lambda a, b: a + b,
        [F.coalesce(F.col(m), F.lit(0.0)) * w for m, w in FORECAST_BLEND.items()],
    )
    tilt = F.col("trend_multiplier") if "trend_multiplier" in spaces.columns else F.lit(1.0)
    tilt = F.coalesce(F.when(tilt != 0, tilt), F.lit(1.0))
    # A scalar subquery: one number reaches every task, no join.
    market = totals.select("market_cagr_2y").scalar()
    rated = spaces.select(
        "level", "space_id", "space_label",
        F.col("value_t2").alias("base_value"),
        tilt.alias("trend_multiplier"),
        market.alias("market_cagr"),
        clip(blended * tilt, config.floor, config.cap).alias("start_rate"),
    )
    base, start, cagr = F.col("base_value"), F.col("start_rate"), F.col("market_cagr")
    up = F.least(F.lit(config.cap), start + config.spread)
    down = F.greatest(F.lit(config.floor), start - config.spread)
    projected = rated.withColumns(
        {
            "projected_value": compound(base, start, cagr, years, decay),
            "bull_value": compound(base, up, cagr, years, decay),
            "bear_value": compound(base, down, cagr, years, decay),
            "horizon_years": F.lit(years),
        }
    )
    grown = (base > EPS) & (F.col("projected_value") > EPS)
    return (
        projected.withColumn(
            "base_cagr",
            F.when(grown, F.pow(F.col("projected_value") / base, F.lit(1.0 / years)) - 1.0)
            .otherwise(0.0),
        )
        .withColumn("outperformance_pp", (F.col("base_cagr") - cagr) * 100.0)
        .withColumn("outperforms_market", F.col("outperformance_pp") > 0.0)
        .withColumn(
            "verdict",
            F.when(F.col("outperformance_pp") > 0, "Projected to outperform the market")
            .otherwise("Projected to lag the market"),
        )
    )
