"""Growth, demand, momentum and focal-position metrics per space, and market totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spacelens.config import EPS
from spacelens.functions.ratios import cagr, clip, growth, plain_growth, safe_ratio


def add_growth_metrics(spaces: DataFrame, months_per_period: int = 12) -> DataFrame:
    base = spaces.withColumns(
        {
            "value_yoy": growth("value_t2", "value_t1"),
            "value_cagr_2y": cagr("value_t2", "value_t0", 2.0),
            "absolute_growth": F.col("value_t2") - F.col("value_t1"),
            # Latest constant-price value against last year's reported value: demand only.
            "real_growth": growth("cp_t2", "value_t1"),
            "real_growth_prior": growth("cp_t1", "value_t0"),
            "volume_growth": growth("qty_t2", "qty_t1"),
            "volume_cagr_2y": cagr("qty_t2", "qty_t0", 2.0),
            "run_rate_annualised": F.col("recent_3m_sales") * (months_per_period / 3.0),
            "price_per_unit_t2": safe_ratio("value_t2", "qty_t2"),
            "price_per_unit_t1": safe_ratio("value_t1", "qty_t1"),
            "focal_share_t2": safe_ratio("focal_value_t2", "value_t2"),
            "focal_share_t1": safe_ratio("focal_value_t1", "value_t1"),
            "focal_yoy": growth("focal_value_t2", "focal_value_t1"),
            "focal_present": F.col("focal_value_t2") > EPS,
        }
    )
    total = spaces.where("level = 'segment'").agg(F.sum("value_t2").alias("v")).scalar()
    return base.withColumns(
        {
            "price_effect": F.col("value_yoy") - F.col("real_growth"),
            "momentum": clip(
                F.when(
                    F.abs("value_t2") > EPS,
                    safe_ratio("run_rate_annualised", "value_t2") - 1.0,
                ).otherwise(0.0),
                -0.9,
                1.5,
            ),
            "price_per_unit_change": growth("price_per_unit_t2", "price_per_unit_t1"),
            "focal_share_delta_pp": (F.col("focal_share_t2") - F.col("focal_share_t1")) * 100.0,
            "focal_growth_gap": F.when(
                F.abs("focal_value_t1") > EPS, F.col("focal_yoy") - F.col("value_yoy")
            ).otherwise(0.0),
            "share_of_market_pct": safe_ratio(F.col("value_t2"), total) * 100.0,
        }
    )


def market_totals(spaces: DataFrame) -> DataFrame:
    """One row of totals. Only the segment level is additive, so only it is summed."""
    sums = spaces.where("level = 'segment'").agg(
        *[
            F.coalesce(F.sum(c), F.lit(0.0)).alias(c)
            for c in ("value_t0", "value_t1", "value_t2", "cp_t2", "qty_t1", "qty_t2",
                      "focal_value_t1", "focal_value_t2")
        ]
    )
    return sums.select(
        F.col("value_t0").alias("market_value_t0"),
        F.col("value_t1").alias("market_value_t1"),
        F.col("value_t2").alias("market_value_t2"),
        plain_growth("value_t2", "value_t1").alias("market_yoy"),
        F.when(F.col("value_t0") > EPS, F.sqrt(F.col("value_t2") / F.col("value_t0")) - 1.0)
        .otherwise(0.0).alias("market_cagr_2y"),
        plain_growth("cp_t2", "value_t1").alias("market_real_growth"),
        plain_growth("qty_t2", "qty_t1").alias("market_volume_growth"),
        (plain_growth("value_t2", "value_t1") - plain_growth("cp_t2", "value_t1"))
        .alias("market_price_effect"),
        "focal_value_t2",
        F.when(F.col("value_t2") > EPS, F.col("focal_value_t2") / F.col("value_t2"))
        .otherwise(0.0).alias("focal_share"),
        plain_growth("focal_value_t2", "focal_value_t1").alias("focal_yoy"),
    )
