"""Registered analyst views and warehouse reports."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks.binding import FOCAL, facts, market, signals, table, text_queries
from checks.market_queries import KEYS, rounded
from spacelens.functions.text import slug
from spacelens.plans import views, warehouse


def market_overview(spark, sf):
    return rounded(views.market_overview(market(spark, sf)))


def segment_overview(spark, sf):
    return rounded(views.segment_overview(market(spark, sf)))


def _lookups(spark, sf):
    """Ids, labels and label parts to look up: made from the parts and some nonsense."""
    part = table(spark, sf, "part").select("p_name", "p_type", "p_brand").distinct()
    kinds = F.array(
        F.concat(F.lit("cls_"), slug(F.col("p_brand"))),
        F.col("p_type"),
        F.upper("p_name"),
        F.substring_index("p_name", " ", -1),
        F.concat("p_type", F.lit(" nowhere")),
    )
    return part.select(F.explode(kinds).alias("text")).distinct().select(
        F.col("text").alias("lookup"), "text"
    )


def find_space(spark, sf):
    return views.find_spaces(market(spark, sf).scored, _lookups(spark, sf))


def deep_dive(spark, sf):
    card = views.deep_dive(market(spark, sf))

    def listed(column, *fields):
        def item(x):
            parts = [
                F.format_string("%.4f", x[f]) if f.startswith("value") or f == "contribution" else x[f].cast("string")
                for f in fields
            ]
            return F.concat_ws("/", *parts)

        return F.coalesce(F.array_join(F.transform(column, item), "; "), F.lit("")).alias(column)

    return rounded(
        card.select(
            *KEYS, "space_label", "segment", "sub_segment", "value_t2", "value_yoy", "hhi",
            "n_players", "focal_share_t2", "trend_multiplier", "trend_signal_ids",
            "priority_score", "strategic_verdict",
            listed("top_companies", "position", "company_clean", "value_t2", "rank_in_space"),
            listed("top_brands", "position", "brand", "company_clean", "value_t2"),
            listed("focal_brands", "position", "brand", "value_t2"),
            listed("signals", "signal_id", "match_reason", "contribution"),
        )
    )


def space_signals(spark, sf):
    return rounded(views.space_signals(market(spark, sf)))


def compare_spaces(spark, sf):
    """The trade-offs between all segments."""
    scored = market(spark, sf).scored
    return views.trade_offs(scored.where("level = 'segment'"))


#: Two labels, an id, parts of labels and a name that no space has.
COMPARED = ["SEG_ECONOMY", "large", " Medium L", "widget", "no such space"]


def compare_named(spark, sf):
    """Spaces looked up by id, label or part of one: side by side, their trade-offs, what is missing."""
    chosen, tensions, missing = views.compare_spaces(market(spark, sf).scored, COMPARED)
    none = F.lit(None).cast("string").alias("none")
    spaces = chosen.select(
        F.lit("space").alias("kind"), "level", F.col("space_id").alias("item"), F.col("space_label").alias("text"),
        "value_t2", "priority_score",
    )
    number = none.cast("double")
    lines = F.array(*[F.struct(F.lit(c).alias("item"), F.col(c).alias("text")) for c in tensions.columns])
    rest = tensions.select(F.inline(lines)).select(F.lit("trade-off").alias("kind"), none, "item", "text", number, number)
    unknown = missing.select(F.lit("missing").alias("kind"), none, "lookup", none, number, number)
    return rounded(spaces.union(rest).union(unknown))


def competitor_profile(spark, sf):
    return rounded(views.competitor_profile(market(spark, sf), "nation_1"))


def competitor_strongholds(spark, sf):
    return rounded(views.competitor_strongholds(market(spark, sf), "nation_1"))


def competitor_brands(spark, sf):
    return rounded(views.competitor_brands(market(spark, sf), "nation_1"))


def focal_portfolio(spark, sf):
    return rounded(views.focal_portfolio(market(spark, sf)))


def focal_brands(spark, sf):
    return rounded(views.focal_brands(market(spark, sf)))


def focal_franchises(spark, sf):
    return rounded(views.focal_franchises(market(spark, sf)))


def focal_positions(spark, sf):
    return rounded(views.focal_positions(market(spark, sf)))


def focal_molecules(spark, sf):
    return views.focal_molecules(market(spark, sf))


def competitive_standing(spark, sf):
    return rounded(views.competitive_standing(market(spark, sf), "NATION_0"))


def growth_decomposition(spark, sf):
    return rounded(views.growth_decomposition(market(spark, sf)))


def focal_gap(spark, sf):
    return rounded(views.focal_gap(market(spark, sf)))


FORECAST = ["base_value", "base_cagr", "projected_value", "bull_value", "bear_value",
            "outperformance_pp"]


def forecast_top(spark, sf):
    return rounded(views.forecast_top(market(spark, sf)).select(*KEYS, *FORECAST), 3)


def forecast_three_years(spark, sf):
    return rounded(views.forecast_horizon(market(spark, sf), 3).select(*KEYS, *FORECAST), 3)


ADHOC = (
    "SELECT level, count(*) AS spaces, sum(sku_count) AS packs, round(sum(value_t2), 2) AS value "
    "FROM space_facts GROUP BY level HAVING count(*) > 1"
)


def adhoc_sql(spark, sf):
    views.register_views(market(spark, sf))
    return views.adhoc_sql(spark, ADHOC)


def build_metadata(spark, sf):
    return rounded(
        warehouse.build_metadata(market(spark, sf)).select("key", "value"), 4
    )


def warehouse_counts(spark, sf):
    """Write the whole warehouse, read it back, count every table."""
    from spacelens.sources.stage import stage_root

    path = f"{stage_root(spark)}/warehouse-{uuid.uuid4().hex}"
    warehouse.build_warehouse(facts(spark, sf), FOCAL, path)
    tables = warehouse.read_warehouse(spark, path)
    names = ("sku_facts", "space_membership", "space_facts", "company_facts", "brand_facts")
    counts = [
        tables[n].agg(F.lit(n).alias("table"), F.count(F.lit(1)).alias("rows")) for n in names
    ]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def signal_search(spark, sf):
    """Every benchmark text asked of the signal documents."""
    found = signals(spark, sf)
    return views.search_signals(views.signal_index(found), found, text_queries(spark, sf))


def level_reconciliation(spark, sf):
    """Every level's total next to the pack total: hierarchy levels add up, anchors overlap."""
    m = market(spark, sf)
    per_level = m.space_facts.groupBy("level").agg(
        F.sum("value_t2").alias("value_t2"), F.sum("sku_count").alias("pairs")
    )
    total = m.cells.agg(F.sum("value_t2").cast("double")).scalar()
    return per_level.select(
        "level", F.round("value_t2", 4).alias("value_t2"), "pairs",
        F.round(F.col("value_t2") / total, 6).alias("of_packs"),
    )


QUERIES = {
    "market_overview": market_overview,
    "segment_overview": segment_overview,
    "find_space": find_space,
    "deep_dive": deep_dive,
    "space_signals": space_signals,
    "compare_spaces": compare_spaces,
    "compare_named": compare_named,
    "signal_search": signal_search,
    "competitor_profile": competitor_profile,
    "competitor_strongholds": competitor_strongholds,
    "competitor_brands": competitor_brands,
    "focal_portfolio": focal_portfolio,
    "focal_brands": focal_brands,
    "focal_franchises": focal_franchises,
    "focal_positions": focal_positions,
    "focal_molecules": focal_molecules,
    "competitive_standing": competitive_standing,
    "growth_decomposition": growth_decomposition,
    "focal_gap": focal_gap,
    "forecast_top": forecast_top,
    "forecast_three_years": forecast_three_years,
    "adhoc_sql": adhoc_sql,
    "build_metadata": build_metadata,
    "warehouse_counts": warehouse_counts,
    "level_reconciliation": level_reconciliation,
}
