import math

import pytest
from pyspark.sql import functions as F

from spacelens.config import ScoreConfig
from spacelens.operators import rightowin
from spacelens.operators.competition import top_competitors
from spacelens.operators.derive import derive
from spacelens.operators.growth import add_growth_metrics, market_totals
from spacelens.operators.spaces import membership
from spacelens.plans.market import Market


def by_id(df, level):
    return {r["space_id"]: r for r in df.where(F.col("level") == level).collect()}


def test_membership_counts(packs):
    pairs = membership(derive(packs, "ORBIS*")).collect()
    assert len(pairs) == 44
    spaces = {(r["level"], r["space_id"]) for r in pairs}
    counts = {}
    for level, _ in spaces:
        counts[level] = counts.get(level, 0) + 1
    assert counts == {"segment": 2, "sub_segment": 4, "molecule_class": 3,
                      "molecule_combination": 5, "treatment_archetype": 4, "anchor_molecule": 4}


def test_levels_reconcile(seven_packs):
    segments = by_id(seven_packs.space_facts, "segment")
    assert segments["SEG_PAIN_RELIEF"]["value_t2"] == 530
    assert segments["SEG_ALLERGY"]["value_t2"] == 375
    anchors = by_id(seven_packs.space_facts, "anchor_molecule")
    assert {k: v["value_t2"] for k, v in anchors.items()} == {
        "ANC_IBUPROFEN": 480, "ANC_PARACETAMOL": 230, "ANC_CETIRIZINE": 375, "ANC_LORATADINE": 75
    }
    totals = seven_packs.totals.first()
    assert totals["market_value_t2"] == 905 and totals["focal_value_t2"] == 150
    assert sum(v["value_t2"] for v in anchors.values()) == 1160


def test_growth_by_hand(seven_packs):
    plain = by_id(seven_packs.grown, "sub_segment")["SUB_PAIN_RELIEF_PLAIN_PAIN"]
    assert plain["value_yoy"] == pytest.approx(350 / 240 - 1)
    assert plain["real_growth"] == pytest.approx(329 / 240 - 1)
    assert plain["price_effect"] == pytest.approx(21 / 240)
    rows = seven_packs.grown.collect()
    assert all(abs(r["momentum"]) < 1e-9 for r in rows)
    dual = by_id(seven_packs.grown, "sub_segment")["SUB_ALLERGY_DUAL_ALLERGY"]
    assert dual["value_yoy"] == pytest.approx(1.5)


def test_competition_by_hand(seven_packs):
    subs = by_id(seven_packs.enriched, "sub_segment")
    plain = subs["SUB_PAIN_RELIEF_PLAIN_PAIN"]
    assert (plain["n_players"], plain["leader_company"]) == (2, "NORDA")
    assert plain["leader_share"] == pytest.approx(260 / 350)
    assert plain["hhi"] == pytest.approx((260**2 + 90**2) / 350**2 * 10000)
    assert plain["share_churn"] == pytest.approx(abs(90 / 350 - 60 / 240))
    dual = subs["SUB_ALLERGY_DUAL_ALLERGY"]
    assert dual["n_players"] == 1 and dual["hhi"] == pytest.approx(10000)
    assert dual["is_structurally_closed"]


def test_company_facts_share_and_rank(seven_packs):
    rows = [r for r in seven_packs.company_facts.collect() if r["space_id"] == "SEG_ALLERGY"]
    assert sum(r["share_t2"] for r in rows) == pytest.approx(1.0)
    ranks = {r["company_clean"]: r["rank_in_space"] for r in rows}
    assert ranks == {"MERIDIAN": 1, "QUILL": 2, "ORBIS": 3}
    top = top_competitors(seven_packs.company_facts, 1).where("space_id = 'SEG_ALLERGY'")
    assert [r["company_clean"] for r in top.collect()] == ["MERIDIAN"]


def test_right_to_win_by_hand(seven_packs):
    subs = by_id(seven_packs.enriched, "sub_segment")
    dual = subs["SUB_ALLERGY_DUAL_ALLERGY"]
    # Half of the one dual pack is cetirizine, which the focal company sells as DELTA.
    assert dual["rtw_molecule_adjacency"] == pytest.approx(0.5)
    assert dual["adjacent_focal_brands"] == "DELTA"
    assert dual["rtw_detailing_adjacency"] == 0.0
    plain = subs["SUB_PAIN_RELIEF_PLAIN_PAIN"]
    assert plain["rtw_detailing_adjacency"] == pytest.approx(90 / 350)
    assert plain["rtw_formulation_fit"] == pytest.approx(1.0)
    segment = by_id(seven_packs.enriched, "segment")["SEG_ALLERGY"]
    assert segment["rtw_detailing_adjacency"] == pytest.approx(60 / 300)


def test_composition_sums_to_one(seven_packs):
    weights = rightowin.space_composition(seven_packs.molecules, seven_packs.space_facts)
    sums = weights.groupBy("level", "space_id").agg(F.sum("weight").alias("w")).collect()
    assert all(r["w"] == pytest.approx(1.0) for r in sums)


ONE_SPACE = dict(
    level="segment", space_id="S", space_label="S", value_t0=100.0, value_t1=120.0, value_t2=150.0,
    cp_t0=100.0, cp_t1=118.0, cp_t2=132.0, qty_t0=1000.0, qty_t1=1150.0, qty_t2=1280.0,
    recent_3m_sales=40.0, focal_value_t0=5.0, focal_value_t1=6.0, focal_value_t2=9.0,
    focal_qty_t2=80.0, sku_count=10,
)


def one_space(spark, **changes):
    row = {**ONE_SPACE, **changes}
    return add_growth_metrics(spark.createDataFrame([row])).first()


def test_one_space_metrics(spark):
    base = one_space(spark)
    assert base["value_yoy"] == pytest.approx(0.25)
    assert base["value_cagr_2y"] == pytest.approx(math.sqrt(1.5) - 1)
    assert base["real_growth"] == pytest.approx(132 / 120 - 1)
    assert base["focal_share_delta_pp"] == pytest.approx(1.0)
    assert base["share_of_market_pct"] == pytest.approx(100.0)
    flat = one_space(spark, cp_t2=120.0, qty_t2=1150.0)
    assert flat["real_growth"] == 0 and flat["price_effect"] == flat["value_yoy"]
    assert one_space(spark, recent_3m_sales=45.0)["momentum"] == pytest.approx(180 / 150 - 1)
    assert one_space(spark, value_t1=0.001, value_t2=100.0)["value_yoy"] == 3.0
    gone = one_space(spark, value_t2=0.0)
    assert gone["value_yoy"] == -1.0 and gone["value_cagr_2y"] == 0.0 and gone["momentum"] == 0.0


def test_zero_denominators_stay_finite(spark):
    zeros = {k: 0.0 for k, v in ONE_SPACE.items() if isinstance(v, float)}
    row = one_space(spark, **zeros)
    assert all(math.isfinite(v) for v in row.asDict().values() if isinstance(v, float))


def test_totals_of_no_rows(spark):
    empty = spark.createDataFrame([ONE_SPACE]).where("level = 'none'")
    row = market_totals(empty).first()
    assert row["market_value_t2"] == 0 and row["focal_share"] == 0


def test_unclassified_rows_keep_their_spaces(spark, packs):
    odd = packs.withColumn(
        "sub_segment", F.when(F.col("brand") == "FOXTROT", "-").otherwise(F.col("sub_segment"))
    ).withColumn("segment", F.when(F.col("brand") == "FOXTROT", None).otherwise(F.col("segment")))
    rows = membership(derive(odd, "ORBIS*")).collect()
    # The placeholder loses its sub-segment and combination space.
    assert len(rows) == 42
    assert any(r["space_id"] == "SEG_NAN" for r in rows)


def test_a_high_floor_excludes_with_the_size_reason_first(seven_packs):
    _, excluded = seven_packs.scorecard(ScoreConfig(min_value=500.0, min_players=3))
    reasons = {(r["level"], r["space_id"]): r["exclusion_reason"] for r in excluded.collect()}
    assert reasons["sub_segment", "SUB_PAIN_RELIEF_PLAIN_PAIN"] == "below size floor of 500"
    assert reasons["molecule_class", "CLS_N02_PLAIN"] == "below size floor of 500"
    _, closed = seven_packs.scorecard(ScoreConfig(min_value=500.0, min_players=4))
    reasons = {(r["level"], r["space_id"]): r["exclusion_reason"] for r in closed.collect()}
    assert reasons["segment", "SEG_PAIN_RELIEF"] == "fewer than 4 active players"


def test_spellings_that_share_an_id_are_one_space(packs):
    odd = packs.withColumn(
        "ingredient_desc",
        F.when(F.col("brand") == "CHARLIE", "PARA-CET + PARA CET + X")
        .otherwise(F.col("ingredient_desc")),
    ).withColumn(
        "molecule_class",
        F.when(F.col("brand") == "ECHO", "r06-antihistamines").otherwise(F.col("molecule_class")),
    )
    market = Market.build(odd, "ORBIS*", score=ScoreConfig(min_value=0.0, min_players=1))
    anchors = by_id(market.space_facts, "anchor_molecule")
    assert anchors["ANC_PARA_CET"]["sku_count"] == 1
    assert anchors["ANC_PARA_CET"]["value_t2"] == 180
    classes = by_id(market.space_facts, "molecule_class")
    assert classes["CLS_R06_ANTIHISTAMINES"]["value_t2"] == 375
    assert classes["CLS_R06_ANTIHISTAMINES"]["space_label"] == "R06 ANTIHISTAMINES"
    keys = [(r["level"], r["space_id"]) for r in market.scored.collect()]
    assert len(keys) == len(set(keys)) == market.space_facts.count()
    labels = {r["space_label"] for r in market.brand_facts.where("space_id = 'CLS_R06_ANTIHISTAMINES'").collect()}
    assert labels == {"R06 ANTIHISTAMINES"}
