"""Registered queries over the market built from the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks.binding import FOCAL, SCORE, WHITESPACE, facts, market, signals, table
from spacelens.config import SensitivityConfig
from spacelens.functions import text
from spacelens.operators import rightowin, scoring, sensitivity
from spacelens.operators.competition import top_competitors
from spacelens.operators.derive import derive
from spacelens.operators.forecast import forecast_spaces
from spacelens.operators.spaces import membership
from spacelens.operators.whitespace import find_whitespace
from spacelens.plans import views
from spacelens.sources.facts import coerce_numeric, coercion_report, trim_text
from spacelens.sources.signals import citations, parse_signals, signed_magnitude

WHAT_IF = {"moi_weights": {"market_attractiveness": 0.2, "future_potential": 0.2,
                           "competitive_headroom": 0.6}}


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Doubles at a fixed number of decimals, so both engines compare equal."""
    return df.select(
        *[
            # Adding zero turns -0.0 into 0.0.
            (F.round(f.name, special.get(f.name, digits)) + F.lit(0.0)).alias(f.name)
            if isinstance(f.dataType, T.DoubleType)
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


# ---- derived fields ------------------------------------------------------------------------

#: Texts that a lenient cast would take for numbers, and numbers in less common notation.
ODD_CELLS = ["1d", "5f", "0x1p3", "NaN", "1_000", "2e3", "-.5", "+7.", "1e", "--1", "12 34"]


def _raw_cells(spark, sf):
    """Untrimmed text cells, some of them not numbers, made from orders."""
    price = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    odd = F.array(*map(F.lit, ODD_CELLS))
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("row_id"),
        F.concat(F.lit("  "), "o_orderpriority", F.lit(" ")).alias("label"),
        F.when(F.col("o_orderkey") % 7 == 0, F.lit("n/a"))
        .when(F.col("o_orderkey") % 11 == 0, F.lit(None))
        .when(F.col("o_orderkey") % 13 == 0, F.get(odd, (F.col("o_orderkey") % len(ODD_CELLS)).cast("int")))
        .otherwise(F.concat(F.lit(" "), price)).alias("price"),
    )


def coerce_numeric_query(spark, sf):
    return trim_text(coerce_numeric(_raw_cells(spark, sf), ["price"]))


def coercion_counts(spark, sf):
    return coercion_report(_raw_cells(spark, sf), ["price"])


def _descriptions(spark, sf):
    """Ingredient strings with salt words, repeats and blanks, one per part."""
    p = table(spark, sf, "part")
    salts = F.array(*[F.lit(s) for s in text.SALT_WORDS])
    first, second = F.substring_index("p_name", " ", 1), F.substring_index("p_name", " ", -1)
    salt = F.element_at(salts, (F.col("p_partkey") % len(text.SALT_WORDS) + 1).cast("int"))
    return p.select(
        F.col("p_partkey").alias("row_id"),
        F.when(F.col("p_size") == 1, F.lit(None))
        .when(F.col("p_size") == 2, "   ")
        .when(F.col("p_size") == 3, salt)
        .when(F.col("p_size") < 15, F.concat(first, F.lit("  "), salt))
        .when(F.col("p_size") < 30, F.concat(first, F.lit(" + "), second, F.lit(" "), salt, F.lit(" salt")))
        .when(F.col("p_size") < 40, F.concat(first, F.lit("+"), first, F.lit(" "), salt, F.lit("+ +"), second))
        .otherwise(F.concat(second, F.lit(" "), salt, F.lit(" "), first, F.lit(" + "), F.lower("p_type")))
        .alias("description"),
    )


def split_ingredients(spark, sf):
    d = _descriptions(spark, sf)
    parts = d.withColumn("parts", text.split_ingredients("description"))
    return parts.select(
        "row_id", F.array_join("parts", "|").alias("ingredients"),
        F.size("parts").cast("int").alias("ingredient_count"),
    )


def ingredient_signature(spark, sf):
    parts = _descriptions(spark, sf).withColumn("parts", text.split_ingredients("description"))
    return parts.groupBy(F.array_join(F.array_sort("parts"), " + ").alias("molecule_signature")).agg(
        F.count(F.lit(1)).alias("packs"),
        F.max(F.array_join("parts", " + ")).alias("last_canonical"),
    )


def archetype(spark, sf):
    sku = derive(facts(spark, sf), FOCAL)
    return sku.groupBy("treatment_archetype", "molecule_count").agg(F.count(F.lit(1)).alias("packs"))


def _brands(spark, sf):
    mods = F.array(*[F.lit(m) for m in text.BRAND_MODIFIERS])
    mod = F.element_at(mods, (F.col("p_partkey") % len(text.BRAND_MODIFIERS) + 1).cast("int"))
    first, second = F.substring_index("p_name", " ", 1), F.substring_index("p_name", " ", -1)
    size = F.col("p_size")
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("row_id"),
        F.when(size == 1, F.lit(None)).when(size == 2, "5-MONO")
        .when(size < 10, F.concat(first, F.lit("-"), mod))
        .when(size < 20, F.concat(first, F.lit(" "), F.lower(mod)))
        .when(size < 30, F.concat(first, F.lit(" "), mod, F.lit(" "), second))
        .when(size < 35, F.concat(F.lit("AB "), mod))
        .when(size < 40, F.concat(F.lit("ab-"), second, F.lit(" "), mod))
        .otherwise(F.concat(F.lit(" "), F.col("p_name"), F.lit(" "))).alias("brand"),
    )


def brand_root(spark, sf):
    return _brands(spark, sf).select("row_id", text.brand_root("brand").alias("brand_root"))


def focal_flags(spark, sf):
    sku = derive(facts(spark, sf), FOCAL)
    return sku.groupBy("company", "company_clean", "is_focal", "is_mnc", "is_oral_solid").agg(
        F.count(F.lit(1)).alias("packs")
    )


def realised_price(spark, sf):
    sku = derive(facts(spark, sf), FOCAL)
    return rounded(sku.select("row_id", "realised_price_per_unit"), 10)


def slug(spark, sf):
    c = table(spark, sf, "customer")
    raw = F.concat(F.lit(" "), F.col("c_name"), F.lit(" / "), F.col("c_mktsegment"), F.lit("--"))
    return c.select("c_custkey", text.slug(raw).alias("slug"))


# ---- spaces --------------------------------------------------------------------------------

def space_membership(spark, sf):
    return membership(derive(facts(spark, sf), FOCAL))


def space_facts(spark, sf):
    return rounded(market(spark, sf).space_facts.drop("segment", "sub_segment"))


def space_context(spark, sf):
    return market(spark, sf).space_facts.select("level", "space_id", "segment", "sub_segment")


def company_facts(spark, sf):
    return rounded(market(spark, sf).company_facts)


def brand_facts(spark, sf):
    return rounded(market(spark, sf).brand_facts)


# ---- metrics -------------------------------------------------------------------------------

KEYS = ["level", "space_id"]
GROWTH = ["value_yoy", "value_cagr_2y", "absolute_growth", "real_growth", "real_growth_prior",
          "volume_growth", "volume_cagr_2y", "price_effect", "price_per_unit_t2",
          "price_per_unit_t1", "price_per_unit_change"]


def growth_metrics(spark, sf):
    return rounded(market(spark, sf).grown.select(*KEYS, *GROWTH))


def momentum(spark, sf):
    return rounded(market(spark, sf).grown.select(*KEYS, "run_rate_annualised", "momentum"))


def focal_position(spark, sf):
    return rounded(
        market(spark, sf).grown.select(
            *KEYS, "focal_share_t2", "focal_share_t1", "focal_share_delta_pp", "focal_yoy",
            "focal_growth_gap", "focal_present", "share_of_market_pct",
        )
    )


def market_totals(spark, sf):
    return rounded(market(spark, sf).totals)


def competition(spark, sf):
    return rounded(
        market(spark, sf).enriched.select(
            *KEYS, "n_players", "hhi", "leader_share", "top3_share", "top5_share",
            "effective_competitors", "leader_company", "share_churn", "new_entrant_count",
            "mnc_share",
        )
    )


def structure_flags(spark, sf):
    return rounded(
        market(spark, sf).enriched.select(
            *KEYS, "crowding", "price_erosion", "concentration_label", "is_structurally_closed"
        )
    )


def top_competitors_query(spark, sf):
    return rounded(top_competitors(market(spark, sf).company_facts, 8))


def focal_estate(spark, sf):
    return rightowin.focal_estate(market(spark, sf).named_cells)


def space_composition(spark, sf):
    m = market(spark, sf)
    return rounded(rightowin.space_composition(m.molecules, m.space_facts))


def right_to_win(spark, sf):
    return rounded(
        market(spark, sf).enriched.select(
            *KEYS, "space_solids_share", "rtw_molecule_adjacency", "rtw_brand_franchise",
            "rtw_detailing_adjacency", "rtw_formulation_fit", "rtw_current_share",
            "rtw_share_momentum", "adjacent_focal_brands",
        )
    )


# ---- scoring -------------------------------------------------------------------------------

def excluded_spaces(spark, sf):
    excluded = market(spark, sf).scorecard()[1]
    return excluded.select(*KEYS, "exclusion_reason")


def _kept(spark, sf):
    kept, _ = scoring.split_survivors(market(spark, sf).enriched, SCORE)
    return kept


def winsorised(spark, sf):
    kept = _kept(spark, sf)
    return rounded(scoring.winsorise(kept, SCORE).select(*KEYS, "metric", "clipped"))


def metric_percentiles(spark, sf):
    kept = _kept(spark, sf)
    return rounded(scoring.percentile_scores(kept, SCORE).select(*KEYS, "metric", "pct"))


def pillar_scores(spark, sf):
    return rounded(
        market(spark, sf).scored.select(*KEYS, *["pillar_" + p for p in scoring.PILLARS]), 9
    )


SCORES = ["market_opportunity_index", "right_to_win_score", "rtw_gate", "priority_score",
          "moi_rank", "cps_rank"]


def scorecard(spark, sf):
    scored, _ = market(spark, sf).scorecard()
    return rounded(scored.select(*KEYS, "space_label", "value_t2", *SCORES), 9, value_t2=6)


def verdicts(spark, sf):
    return market(spark, sf).scored.select(*KEYS, "moi_band", "rtw_band", "strategic_verdict")


def scorecard_whatif(spark, sf):
    scored, _ = market(spark, sf).scorecard(SCORE.with_weights(WHAT_IF))
    return rounded(scored.select(*KEYS, *SCORES), 9)


def explain_score(spark, sf):
    return scoring.explain_score(market(spark, sf).scored)


def rank_spaces(spark, sf):
    return rounded(
        views.rank_opportunity_spaces(market(spark, sf), "molecule_combination", 10).select(
            *KEYS, "space_label", "value_t2", "market_opportunity_index", "priority_score",
            "cps_rank", "strategic_verdict",
        ),
        9,
        value_t2=6,
    )


# ---- forecast, sensitivity, whitespace -----------------------------------------------------

def forecast(spark, sf):
    m = market(spark, sf)
    return rounded(
        forecast_spaces(m.scored, m.totals).select(
            *KEYS, "base_value", "horizon_years", "base_cagr", "projected_value", "bull_value",
            "bear_value", "market_cagr", "outperformance_pp", "trend_multiplier",
            "outperforms_market", "verdict",
        ),
        3,
        base_cagr=6,
        market_cagr=6,
        trend_multiplier=6,
    )


SENSITIVITY = SensitivityConfig()


def weight_draws(spark, sf):
    """The draws next to the spaces they will be applied to."""
    kept = market(spark, sf).scored.select(*KEYS)
    draws = sensitivity.weight_draws(SENSITIVITY, SCORE)
    spread = kept.select(*KEYS, F.inline(sensitivity.draws_column(draws)))
    return rounded(
        spread.groupBy("draw").agg(
            F.count(F.lit(1)).alias("spaces"),
            F.max("moi_weights__future_potential").alias("future_potential"),
            F.max("right_to_win__formulation_fit").alias("formulation_fit"),
        )
    )


def sensitivity_query(spark, sf):
    scored = market(spark, sf).scored
    draws = sensitivity.weight_draws(SENSITIVITY, SCORE)
    out = sensitivity.sensitivity(
        scored, scored, draws, SENSITIVITY, SCORE
    )
    return out


LEVEL = "sub_segment"


def sensitivity_level(spark, sf):
    """One level scored on its own: its own outliers are clipped, not those of all levels."""
    return views.sensitivity_analysis(market(spark, sf), LEVEL, SENSITIVITY)


def sensitivity_top(spark, sf):
    return sensitivity.summary(sensitivity_query(spark, sf), 12)


def whitespace(spark, sf):
    m = market(spark, sf)
    return rounded(find_whitespace(m.scored, m.totals, WHITESPACE, limit=None), 3)


# ---- signals -------------------------------------------------------------------------------

def signal_corpus(spark, sf):
    """Signal files written as text rows from the part brands, parsed back."""
    s = signals(spark, sf)

    def listed(column):
        return F.concat(F.lit("["), F.array_join(column, ", "), F.lit("]"))

    header = F.concat_ws(
        "\n",
        F.lit("---"),
        *[F.concat(F.lit(c + ": "), F.col(c).cast("string")) for c in
          ("id", "title", "category", "publisher", "url", "confidence", "direction", "magnitude")],
        F.lit("applies_to:"),
        *[F.concat(F.lit(f"  {c}: "), listed(c)) for c in
          ("molecules", "segments", "sub_segments", "keywords")],
        F.lit("---"),
    )
    files = s.select(
        F.concat(F.lit("/signals/"), "id", F.lit(".md")).alias("path"),
        F.concat(header, F.lit("\n\n"), F.col("body"), F.lit("\n")).alias("value"),
    )
    copies = files.select(F.regexp_replace("path", "signals", "signals_copy").alias("path"),
                          F.regexp_replace("value", "Body", "Copy").alias("value"))
    broken = files.select(F.concat("path", F.lit("x")).alias("path"),
                          F.regexp_replace("value", "id: ", "name: ").alias("value"))
    parsed = parse_signals(files.unionByName(copies).unionByName(broken))
    return parsed.select(
        "path", "id", "title", "category", "publisher", "url", "confidence", "direction",
        "magnitude", "body",
        *[F.array_join(c, "|").alias(c) for c in ("molecules", "segments", "sub_segments", "keywords")],
    )


def signal_magnitude(spark, sf):
    return rounded(signals(spark, sf).select("id", signed_magnitude().alias("signed_magnitude")))


def citations_query(spark, sf):
    return citations(signals(spark, sf))


def signal_links(spark, sf):
    return rounded(market(spark, sf).links)


def trend_multiplier(spark, sf):
    return rounded(
        market(spark, sf).enriched.select(
            *KEYS, "trend_tilt_raw", "trend_tilt_baseline", "trend_multiplier", "trend_signal_ids"
        )
    )


QUERIES = {
    "coerce_numeric": coerce_numeric_query,
    "coercion_counts": coercion_counts,
    "split_ingredients": split_ingredients,
    "ingredient_signature": ingredient_signature,
    "archetype": archetype,
    "brand_root": brand_root,
    "focal_flags": focal_flags,
    "realised_price": realised_price,
    "slug": slug,
    "space_membership": space_membership,
    "space_facts": space_facts,
    "space_context": space_context,
    "company_facts": company_facts,
    "brand_facts": brand_facts,
    "growth_metrics": growth_metrics,
    "momentum": momentum,
    "focal_position": focal_position,
    "market_totals": market_totals,
    "competition": competition,
    "structure_flags": structure_flags,
    "top_competitors": top_competitors_query,
    "focal_estate": focal_estate,
    "space_composition": space_composition,
    "right_to_win": right_to_win,
    "excluded_spaces": excluded_spaces,
    "winsorised": winsorised,
    "metric_percentiles": metric_percentiles,
    "pillar_scores": pillar_scores,
    "scorecard": scorecard,
    "verdicts": verdicts,
    "scorecard_whatif": scorecard_whatif,
    "explain_score": explain_score,
    "rank_spaces": rank_spaces,
    "forecast": forecast,
    "weight_draws": weight_draws,
    "sensitivity": sensitivity_query,
    "sensitivity_level": sensitivity_level,
    "sensitivity_top": sensitivity_top,
    "whitespace": whitespace,
    "signal_corpus": signal_corpus,
    "signal_magnitude": signal_magnitude,
    "citations": citations_query,
    "signal_links": signal_links,
    "trend_multiplier": trend_multiplier,
}
