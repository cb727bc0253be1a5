"""Competitive structure per space from company facts: plain grouped aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spacelens.config import EPS
from spacelens.functions.ratios import plain_growth

HHI_CONCENTRATED = 2500.0
HHI_MODERATE = 1500.0
SPACE_KEYS = ["level", "space_id"]


def _largest(company_facts: DataFrame, k: int) -> DataFrame:
    """The k largest companies of each space; the filter prunes before the shuffle."""
    order = Window.partitionBy(*SPACE_KEYS).orderBy(F.desc("value_t2"), "company_clean")
    return company_facts.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k)


def competition(company_facts: DataFrame) -> DataFrame:
    v1, v2 = F.col("value_t1"), F.col("value_t2")
    t1, t2 = F.col("space_value_t1"), F.col("space_value_t2")
    active = v2 > EPS
    sums = company_facts.groupBy(*SPACE_KEYS).agg(
        F.count_if(active).cast("int").alias("n_players"),
        F.max("space_value_t2").alias("_t2"),
        F.sum(F.when(active, F.pow(F.try_divide(v2, t2) * 100.0, F.lit(2.0)))).alias("_hhi"),
        F.sum(F.when(t1 > EPS, F.abs(F.try_divide(v2, t2) - v1 / t1)).otherwise(0.0)).alias("_moved"),
        F.count_if((v1 <= EPS) & active).cast("int").alias("_entrants"),
        F.sum(F.when(F.col("is_mnc"), v2).otherwise(0.0)).alias("_mnc"),
    )
    top = _largest(company_facts, 5).groupBy(*SPACE_KEYS).agg(
        F.max(F.when(F.col("_n") == 1, v2)).alias("_top1"),
        F.sum(F.when((F.col("_n") <= 3) & active, v2)).alias("_top3"),
        F.sum(F.when(active, v2)).alias("_top5"),
        F.max(F.when(F.col("_n") == 1, F.col("company_clean"))).alias("_leader"),
    )
    live = (F.col("_t2") > EPS) & (F.col("n_players") > 0)

    def known(value, empty):
        return F.when(live, value).otherwise(F.lit(empty))

    joined = sums.join(top, SPACE_KEYS)
    return joined.select(
        *SPACE_KEYS,
        "n_players",
        known(F.col("_hhi"), 10000.0).alias("hhi"),
        known(F.col("_top1") / F.col("_t2"), 1.0).alias("leader_share"),
        known(F.col("_top3") / F.col("_t2"), 1.0).alias("top3_share"),
        known(F.col("_top5") / F.col("_t2"), 1.0).alias("top5_share"),
        known(10000.0 / F.col("_hhi"), 0.0).alias("effective_competitors"),
        known(F.col("_leader"), "").alias("leader_company"),
        known(F.col("_moved") / 2.0, 0.0).alias("share_churn"),
        known(F.col("_entrants"), 0).alias("new_entrant_count"),
        known(F.col("_mnc") / F.col("_t2"), 0.0).alias("mnc_share"),
    )


def add_competition_metrics(spaces: DataFrame, company_facts: DataFrame) -> DataFrame:
    """Join the profile; a space without companies reads as an empty monopoly."""
    joined = spaces.join(competition(company_facts), SPACE_KEYS, "left").fillna(
        {
            "n_players": 0, "hhi": 10000.0, "leader_share": 1.0, "top3_share": 1.0,
            "top5_share": 1.0, "effective_competitors": 0.0, "leader_company": "",
            "share_churn": 0.0, "new_entrant_count": 0, "mnc_share": 0.0,
        }
    )
    return joined.withColumns(
        {
            # Players per hundred units of value.
            "crowding": F.when(
                F.col("value_t2") > EPS, F.col("n_players") / (F.col("value_t2") / 100.0)
            ).otherwise(0.0),
            "price_erosion": F.greatest(-F.col("price_effect"), F.lit(0.0)),
            "concentration_label": F.when(F.col("hhi") >= HHI_CONCENTRATED, "Concentrated")
            .when(F.col("hhi") >= HHI_MODERATE, "Moderately concentrated")
            .otherwise("Fragmented"),
            "is_structurally_closed": (F.col("n_players") < 3) | (F.col("leader_share") >= 0.80),
        }
    )


def top_competitors(company_facts: DataFrame, limit: int = 8) -> DataFrame:
    """The largest companies of every space with their unclipped growth."""
    return _largest(company_facts, limit).select(
        *SPACE_KEYS, "space_label", "company_clean", "value_t2", "share_t2",
        plain_growth("value_t2", "value_t1").alias("yoy"), "rank_in_space",
        F.col("_n").alias("position"),
    )
