"""All thresholds and weights in one place; every operator takes them as arguments."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

#: Below this a denominator or a value counts as zero.
EPS = 1e-9

LEVELS = (
    "segment",
    "sub_segment",
    "molecule_class",
    "molecule_combination",
    "treatment_archetype",
    "anchor_molecule",
)

LEVEL_DESCRIPTIONS = {
    "segment": "Therapy segment as reported in the source.",
    "sub_segment": "Reported sub-segment within a segment.",
    "molecule_class": "Class of molecules that share a mechanism.",
    "molecule_combination": "Single molecule or fixed combination within a sub-segment.",
    "treatment_archetype": "Monotherapy, dual or triple-plus combination within a segment.",
    "anchor_molecule": "Every pack holding an ingredient, alone or combined; overlaps other levels.",
}

# Pillar and metric weights, metric source columns, inverted metrics.
PILLAR_WEIGHTS = {
    "market_attractiveness": 0.34,
    "future_potential": 0.40,
    "competitive_headroom": 0.26,
}
METRIC_WEIGHTS = {
    "market_attractiveness": {"size": 0.45, "absolute_growth": 0.35, "value_cagr": 0.20},
    "future_potential": {
        "real_growth": 0.30,
        "volume_growth": 0.25,
        "momentum": 0.20,
        "external_trend": 0.25,
    },
    "competitive_headroom": {
        "hhi": 0.35,
        "leader_share": 0.25,
        "crowding": 0.15,
        "price_erosion": 0.25,
    },
    "right_to_win": {
        "current_share": 0.22,
        "share_momentum": 0.22,
        "molecule_adjacency": 0.20,
        "brand_franchise": 0.18,
        "detailing_adjacency": 0.10,
        "formulation_fit": 0.08,
    },
}
METRIC_COLUMNS = {
    "size": "value_t2",
    "absolute_growth": "absolute_growth",
    "value_cagr": "value_cagr_2y",
    "real_growth": "real_growth",
    "volume_growth": "volume_growth",
    "momentum": "momentum",
    "external_trend": "trend_multiplier",
    "hhi": "hhi",
    "leader_share": "leader_share",
    "crowding": "crowding",
    "price_erosion": "price_erosion",
    "current_share": "rtw_current_share",
    "share_momentum": "rtw_share_momentum",
    "molecule_adjacency": "rtw_molecule_adjacency",
    "brand_franchise": "rtw_brand_franchise",
    "detailing_adjacency": "rtw_detailing_adjacency",
    "formulation_fit": "rtw_formulation_fit",
}
INVERTED_METRICS = frozenset({"hhi", "leader_share", "crowding", "price_erosion"})
FORECAST_BLEND = {
    "real_growth": 0.40,
    "volume_growth": 0.30,
    "value_cagr_2y": 0.20,
    "momentum": 0.10,
}
CONFIDENCE_WEIGHTS = {"high": 1.0, "medium": 0.6, "low": 0.3}
DIRECTION_SIGNS = {"tailwind": 1.0, "headwind": -1.0, "neutral": 0.0}
# End of fixed values.


@dataclass(frozen=True)
class ScoreConfig:
    min_value: float = 100.0
    min_players: int = 3
    pillar_weights: dict = field(default_factory=lambda: dict(PILLAR_WEIGHTS))
    metric_weights: dict = field(
        default_factory=lambda: {p: dict(block) for p, block in METRIC_WEIGHTS.items()}
    )
    winsor_low: float = 0.02
    winsor_high: float = 0.98
    winsor_per_level: bool = False
    gate_floor: float = 0.35
    gate_ceiling: float = 1.0
    gate_curve: float = 1.35
    band_high: float = 70.0
    band_medium: float = 45.0

    def __post_init__(self):
        for name, block in {"pillar_weights": self.pillar_weights, **self.metric_weights}.items():
            if abs(sum(block.values()) - 1.0) > 1e-6:
                raise ValueError(f"weights of {name} sum to {sum(block.values()):.4f}, expected 1.0")

    def with_weights(self, overrides: dict) -> "ScoreConfig":
        """Replace whole weight blocks; key ``moi_weights`` addresses the pillar blend."""
        blocks = {**self.metric_weights, **{k: v for k, v in overrides.items() if k != "moi_weights"}}
        return replace(
            self,
            pillar_weights=overrides.get("moi_weights", self.pillar_weights),
            metric_weights=blocks,
        )


@dataclass(frozen=True)
class ForecastConfig:
    horizon_years: int = 5
    decay: float = 0.72
    cap: float = 0.45
    floor: float = -0.15
    spread: float = 0.04


@dataclass(frozen=True)
class SensitivityConfig:
    iterations: int = 500
    concentration: float = 40.0
    seed: int = 20260808
    top_k: int = 5
    robust_at: float = 0.80
    fragile_below: float = 0.60


@dataclass(frozen=True)
class WhitespaceConfig:
    min_moi: float = 55.0
    penetration_ratio: float = 0.75
    min_molecule_adjacency: float = 0.30
    min_brand_franchise: float = 0.60
    min_value: float = 150.0


@dataclass(frozen=True)
class LinkConfig:
    secondary_weight: float = 0.5
    multiplier_min: float = 0.80
    multiplier_max: float = 1.25


@dataclass(frozen=True)
class RetrievalConfig:
    chunk_words: int = 240
    overlap_words: int = 45
    top_k: int = 6
    rrf_k: int = 60
    k1: float = 1.5
    b: float = 0.75

    def pool(self, top_k: int | None = None) -> int:
        return max(4 * (top_k or self.top_k), 20)


@dataclass(frozen=True)
class VerifyConfig:
    tolerance: float = 0.02
    ignore_below: float = 3.0
    absolute_window: float = 0.005
