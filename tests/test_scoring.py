import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from spacelens.config import ForecastConfig, ScoreConfig, SensitivityConfig, WhitespaceConfig
from spacelens.operators.placing import with_positions
from spacelens.operators import ranking, scoring, sensitivity
from spacelens.operators.forecast import forecast_spaces
from spacelens.operators.whitespace import find_whitespace


def test_weights_must_sum_to_one():
    with pytest.raises(ValueError, match="pillar_weights"):
        ScoreConfig(pillar_weights={"market_attractiveness": 0.5})


def test_invariants(seven_packs):
    rows = seven_packs.scored.collect()
    assert rows
    for r in rows:
        assert 0 <= r["market_opportunity_index"] <= 100
        assert 0 <= r["right_to_win_score"] <= 100
        assert r["priority_score"] <= r["market_opportunity_index"] + 1e-9
        assert 0.35 <= r["rtw_gate"] <= 1.0
    for level in {r["level"] for r in rows}:
        assert min(r["cps_rank"] for r in rows if r["level"] == level) == 1


def test_gate_is_convex(spark):
    df = spark.createDataFrame([(0.0,), (25.0,), (50.0,), (75.0,), (100.0,)], "r double")
    gate = [x[0] for x in df.select(scoring.win_gate(F.col("r"), ScoreConfig())).collect()]
    assert gate[0] == pytest.approx(0.35) and gate[-1] == pytest.approx(1.0)
    steps = [b - a for a, b in zip(gate, gate[1:])]
    assert steps == sorted(steps)


def test_what_if_changes_only_the_blend(seven_packs):
    even = {"moi_weights": {"market_attractiveness": 1.0, "future_potential": 0.0,
                            "competitive_headroom": 0.0}}
    base = ScoreConfig(min_value=0.0, min_players=1)
    scored, _ = seven_packs.scorecard(base.with_weights(even))
    for r in scored.collect():
        assert r["market_opportunity_index"] == pytest.approx(r["pillar_market_attractiveness"])


@pytest.fixture(scope="module")
def numbers(spark):
    rng = random.Random(5)
    rows = []
    for g in ("a", "b", "hot"):
        for i in range(30 if g != "hot" else 600):
            v = rng.choice([0.0, -1.5, 1e9, rng.uniform(-3, 3), float(rng.randint(0, 5))])
            rows.append((g, i, v))
    return spark.createDataFrame(rows, "g string, i int, v double"), rows


def test_ranks_against_brute_force(numbers):
    df, rows = numbers
    groups = {}
    for g, i, v in rows:
        groups.setdefault(g, []).append((i, v))
    desc = {(r["g"], r["i"]): r["r"] for r in ranking.rank_desc(df, ["g"], "v", "r").collect()}
    pct = {
        (r["g"], r["i"]): r["p"] for r in ranking.percentile_rank(df, ["g"], "v", "p").collect()
    }
    pos = {
        (r["g"], r["i"]): r["n"]
        for r in with_positions(df, ["g"], [F.desc_nulls_last("v"), F.col("i")], "n").collect()
    }
    for g, items in groups.items():
        vs = [v for _, v in items]
        order = {i: n for n, (i, _) in enumerate(sorted(items, key=lambda x: (-x[1], x[0])), 1)}
        for i, v in items:
            below, ties = sum(x < v for x in vs), sum(x == v for x in vs)
            assert desc[g, i] == sum(x > v for x in vs) + 1
            assert pct[g, i] == pytest.approx((below + (ties + 1) / 2) / len(vs) * 100)
            assert pos[g, i] == order[i]


def test_percentiles_against_brute_force(numbers):
    df, rows = numbers
    got = {
        r["g"]: (r["lo"], r["hi"])
        for r in ranking.interpolated_percentiles(df, ["g"], "v", {"lo": 0.02, "hi": 0.98}).collect()
    }
    for g in got:
        vs = sorted(v for k, _, v in rows if k == g)

        def at(p):
            h = (len(vs) - 1) * p
            k = int(h)
            return vs[k] + (vs[min(k + 1, len(vs) - 1)] - vs[k]) * (h - k)

        assert got[g] == pytest.approx((at(0.02), at(0.98)))


def test_a_constant_metric_scores_fifty(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0)], "g string, v double")
    rows = ranking.percentile_rank(df, ["g"], "v", "p").collect()
    assert [r["p"] for r in rows] == [50.0, 50.0]


def test_null_values_and_keys_keep_their_rows(spark):
    """Nulls rank last, NaN first; one value holds most rows and its ties go by name."""
    rows = [("a", f"n{i:03}", 0.0) for i in range(200)]
    rows += [("a", "x", None), ("a", "y", 2.0), ("a", "z", -1.0), ("a", "w", float("nan"))]
    rows += [(None, "p", 1.0), (None, "q", None)]
    df = spark.createDataFrame(rows, "g string, name string, v double")
    rank = {r["name"]: r["r"] for r in ranking.rank_desc(df, ["g"], "v", "r").collect()}
    assert len(rank) == len(rows)
    assert [rank[n] for n in ("w", "y", "n000", "n199", "z", "x", "p", "q")] == [1, 2, 3, 3, 203, 204, 1, 2]
    placed = with_positions(df, ["g"], [F.desc_nulls_last("v"), F.col("name")], "n")
    place = {r["name"]: r["n"] for r in placed.collect()}
    assert [place[n] for n in ("w", "y", "n000", "n199", "z", "x", "p", "q")] == [1, 2, 3, 202, 203, 204, 1, 2]
    pct = {r["name"]: r["p"] for r in ranking.percentile_rank(df, ["g"], "v", "p").collect()}
    assert len(pct) == len(rows)
    assert pct["x"] == pytest.approx(100 / 204) and pct["n000"] == pytest.approx((2 + 201 / 2) / 204 * 100)


def test_forecast_band_and_reversion(seven_packs):
    rows = forecast_spaces(seven_packs.scored, seven_packs.totals).collect()
    for r in rows:
        assert r["bear_value"] <= r["projected_value"] + 1e-9 <= r["bull_value"] + 1e-6
        assert r["base_cagr"] <= 0.45 + 1e-9
    one = ForecastConfig(horizon_years=1)
    by_year = {y: forecast_spaces(seven_packs.scored, seven_packs.totals, replace(one, horizon_years=y))
               .where("space_id = 'SUB_ALLERGY_DUAL_ALLERGY'").first()["base_cagr"]
               for y in (1, 5)}
    assert by_year[5] < by_year[1]
    with pytest.raises(ValueError):
        forecast_spaces(seven_packs.scored, seven_packs.totals, ForecastConfig(horizon_years=11))


def test_draws_repeat_and_sum_to_one():
    a, b = (sensitivity.weight_draws(SensitivityConfig(iterations=20)) for _ in range(2))
    assert a == b
    for row in a:
        for block in ("moi_weights", "right_to_win"):
            assert sum(v for k, v in row.items() if k.startswith(block + "__")) == pytest.approx(1.0)


def test_rescoring_with_the_configured_weights_gives_the_scorecard(seven_packs):
    score = ScoreConfig(min_value=0.0, min_players=1)
    blocks = {"moi_weights": score.pillar_weights, **score.metric_weights}
    draw = {f"{b}__{n}": w for b, block in blocks.items() for n, w in block.items()}
    again = sensitivity.rescore(seven_packs.scored, [{"draw": 0, **draw}], score)
    want = {(r["level"], r["space_id"]): r["priority_score"] for r in seven_packs.scored.collect()}
    got = {(r["level"], r["space_id"]): r["priority_score"] for r in again.collect()}
    assert got == pytest.approx(want, rel=1e-12)


def test_sensitivity_against_a_loop(seven_packs):
    config = SensitivityConfig(iterations=25, top_k=2)
    score = ScoreConfig(min_value=0.0, min_players=1)
    draws = sensitivity.weight_draws(config, score)
    got = sensitivity.sensitivity(
        seven_packs.scored, seven_packs.scored, draws, config, score
    ).where("level = 'sub_segment'").collect()
    rows = [r for r in seven_packs.scored.collect() if r["level"] == "sub_segment"]
    places = {r["space_id"]: [] for r in rows}
    for d in draws:
        scores = {}
        for r in rows:
            pillar = {
                p: sum(r["score_" + m] * d[f"{p}__{m}"] for m in block)
                for p, block in score.metric_weights.items()
            }
            moi = sum(pillar[p] * d["moi_weights__" + p] for p in score.pillar_weights)
            gate = 0.35 + 0.65 * (min(max(pillar["right_to_win"], 0), 100) / 100) ** 1.35
            scores[r["space_id"]] = round(moi * gate, 9)
        for n, s in enumerate(sorted(scores, key=lambda s: (-scores[s], s)), start=1):
            places[s].append(n)
    assert len(got) == len(rows)
    for r in got:
        p = places[r["space_id"]]
        assert r["best_rank"] == min(p) and r["worst_rank"] == max(p)
        assert r["mean_rank"] == pytest.approx(sum(p) / len(p), abs=0.006)
        assert r["top_k_frequency"] == pytest.approx(sum(x <= 2 for x in p) / len(p), abs=1e-4)


def test_whitespace_has_a_route_and_a_gap(seven_packs):
    loose = WhitespaceConfig(min_moi=0.0, penetration_ratio=10.0, min_value=0.0)
    rows = find_whitespace(seven_packs.scored, seven_packs.totals, loose, limit=None).collect()
    share = seven_packs.totals.first()["focal_share"]
    assert rows
    for r in rows:
        assert r["route_to_win"]
        assert r["value_gap"] == pytest.approx(r["value_t2"] * share - r["focal_value_t2"])


def test_levels_can_be_restricted(seven_packs):
    scored, _ = scoring.build_scorecard(
        seven_packs.enriched, ScoreConfig(min_value=0.0, min_players=1), ["segment"]
    )
    assert {r["level"] for r in scored.collect()} == {"segment"}
