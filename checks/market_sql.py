"""The same market queries as plain SQL for an independent engine."""

from __future__ import annotations

import json

from checks.binding import FOCAL, SCORE, WHITESPACE
from checks.market_queries import GROWTH, LEVEL, SENSITIVITY, WHAT_IF
from spacelens.config import (
    FORECAST_BLEND,
    INVERTED_METRICS,
    LEVEL_DESCRIPTIONS,
    METRIC_COLUMNS,
    METRIC_WEIGHTS,
    ScoreConfig,
)
from spacelens.functions.text import BRAND_MODIFIERS, PLACEHOLDERS, SALT_WORDS
from spacelens.operators.sensitivity import weight_draws

METRICS = [m for block in METRIC_WEIGHTS.values() for m in block]


def quoted(words) -> str:
    return ", ".join("'" + w + "'" for w in words)


def slug(x: str) -> str:
    return f"trim(regexp_replace(upper(trim({x})), '[^A-Z0-9]+', '_', 'g'), '_')"


def canonical(x: str) -> str:
    words = "|".join(SALT_WORDS)
    return (
        f"regexp_replace(upper(trim(regexp_replace({x}, '\\s+', ' ', 'g'))), "
        f"'^(\\S+(?: \\S+)*?)(?: (?:{words}))+$', '\\1')"
    )


def ingredients(x: str) -> str:
    raw = f"list_transform(string_split(coalesce({x}, ''), '+'), lambda p: {canonical('p')})"
    return f"list_filter({raw}, lambda p, i: p <> '' AND list_position({raw}, p) = i)"


def root(x: str) -> str:
    t = f"upper(trim(coalesce({x}, '')))"
    head = f"trim(split_part({t}, '-', 1))"
    tok = f"string_split(trim(regexp_replace({t}, '\\s+', ' ', 'g')), ' ')"
    return (
        f"CASE WHEN contains({t}, '-') AND length({head}) >= 3 THEN {head} "
        f"WHEN len({tok}) > 1 AND length({tok}[1]) >= 3 AND len(list_filter({tok}[2:], "
        f"lambda w: NOT (w IN ({quoted(BRAND_MODIFIERS)}) OR length(w) <= 3))) = 0 THEN {tok}[1] "
        f"ELSE {t} END"
    )


def placeholder(x: str) -> str:
    return f"coalesce(upper(trim({x})), '') IN ({quoted(PLACEHOLDERS)})"


def clip(x: str, low, high) -> str:
    return f"least(greatest({x}, {low}), {high})"


def ratio(n: str, d: str) -> str:
    return f"(CASE WHEN abs({d}) > 1e-9 THEN ({n}) / ({d}) ELSE 0.0 END)"


def growth(n: str, d: str) -> str:
    return clip(f"(CASE WHEN abs({d}) > 1e-9 THEN ({n}) / ({d}) - 1.0 ELSE 0.0 END)", -1.0, 3.0)


def cagr(n: str, d: str) -> str:
    r = ratio(n, d)
    return clip(f"(CASE WHEN {r} > 1e-9 THEN pow({r}, 0.5) - 1.0 ELSE 0.0 END)", -1.0, 3.0)


def r(x: str, name: str | None = None, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0.0 AS {name or x}"


def rounded(names, digits: int = 6) -> str:
    return ", ".join(r(n, digits=digits) for n in names)


MEASURES = ["value_t0", "value_t1", "value_t2", "cp_t0", "cp_t1", "cp_t2", "qty_t0", "qty_t1",
            "qty_t2", "recent_3m_sales"]
FOCAL_MEASURES = ["value_t0", "value_t1", "value_t2", "qty_t2"]
DIRECT = "coalesce(p_brand, '')"

YEAR_SUMS = ", ".join(
    f"CAST(sum(CASE WHEN y = {y} THEN {c} ELSE 0 END) AS DECIMAL(18,4)) AS {n}_t{i}"
    for n, c in (("value", "v"), ("qty", "q"))
    for i, y in enumerate((1998, 1999, 2000))
)
MONTH_SUMS = ", ".join(
    f"CAST(sum(CASE WHEN y = 2000 AND m = {m} THEN v ELSE 0 END) AS DECIMAL(18,4)) AS month_{i}"
    for i, m in enumerate((10, 11, 12), start=1)
)
PRICES = ", ".join(
    f"CAST(sum(value_t{i}) OVER (PARTITION BY l_partkey) AS DOUBLE) / "
    f"nullif(CAST(sum(qty_t{i}) OVER (PARTITION BY l_partkey) AS DOUBLE), 0) AS p{i}"
    for i in range(3)
)
ING = (
    "CASE WHEN p_size <= 10 THEN w1 WHEN p_size <= 40 THEN w1 || ' + ' || w2s "
    "ELSE w1 || ' + ' || w2s || ' + ' || p_type END"
)
SUB = (
    "CASE WHEN p_size = 50 THEN '-' ELSE p_type || ' ' || CASE WHEN p_size <= 10 THEN 'S' "
    "WHEN p_size <= 25 THEN 'M' WHEN p_size <= 40 THEN 'L' ELSE 'XL' END END"
)

FACTS = f"""
lines AS (
  SELECT l_partkey, s_nationkey, year(l_shipdate) AS y, month(l_shipdate) AS m,
    CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4)) AS v,
    CAST(l_quantity AS DECIMAL(18,4)) AS q
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
  WHERE l_shipdate >= TIMESTAMP '1998-01-01' AND l_shipdate < TIMESTAMP '2001-01-01'),
sold AS (SELECT l_partkey, s_nationkey, {YEAR_SUMS}, {MONTH_SUMS} FROM lines GROUP BY 1, 2),
priced AS (SELECT *, {PRICES} FROM sold),
named AS (
  SELECT *, split_part(p_name, ' ', 1) AS w1,
    split_part(p_name, ' ', 2) || CASE WHEN p_size % 2 = 0 THEN ' calcium' ELSE '' END AS w2s
  FROM part),
sku AS MATERIALIZED (
  SELECT p_partkey * 100 + n_nationkey AS row_id, p_name AS brand,
    n_name || CASE WHEN n_nationkey % 2 = 0 THEN '*' ELSE '' END AS company,
    n_name AS company_clean, n_nationkey = 0 AS is_focal, n_regionkey <> 0 AS is_mnc,
    p_size <= 40 AS is_oral_solid, p_type AS segment, {SUB} AS sub_segment,
    p_brand AS molecule_class, p_type || ' ' || p_name AS subgroup,
    {ingredients(ING)} AS molecules, {root("p_name")} AS brand_root,
    CASE WHEN p_size <= 10 OR len({ingredients(ING)}) <= 1 THEN 'Monotherapy'
      WHEN len({ingredients(ING)}) = 2 THEN 'Dual FDC' ELSE 'Triple / Poly FDC' END AS archetype,
    value_t0, value_t1, value_t2, value_t0 AS cp_t0,
    CAST(CAST(floor(CAST(qty_t1 AS DOUBLE) * coalesce(p0, p1, 0.0) * 10000 + 0.5) AS DECIMAL(18,0)) * 0.0001 AS DECIMAL(18,4)) AS cp_t1,
    CAST(CAST(floor(CAST(qty_t2 AS DOUBLE) * coalesce(p1, p2, 0.0) * 10000 + 0.5) AS DECIMAL(18,0)) * 0.0001 AS DECIMAL(18,4)) AS cp_t2,
    qty_t0, qty_t1, qty_t2, month_1 + month_2 + month_3 AS recent_3m_sales
  FROM priced JOIN named ON l_partkey = p_partkey JOIN nation ON s_nationkey = n_nationkey),
"""


def _level(level, prefix, key, label, where="true"):
    return (
        f"SELECT '{level}' AS level, '{prefix}_' || {slug(key)} AS space_id, {label} AS space_label,"
        f" * FROM sku WHERE {where}"
    )


_valid = f"NOT ({placeholder('sub_segment')})"
MEMBER = "member AS MATERIALIZED (" + " UNION ALL ".join(
    [
        _level("segment", "SEG", "segment", "segment"),
        _level("sub_segment", "SUB", "segment || ' | ' || sub_segment",
               "segment || ' | ' || sub_segment", _valid),
        _level("molecule_class", "CLS", "molecule_class", "molecule_class"),
        _level("molecule_combination", "MOL", "sub_segment || ' | ' || subgroup",
               "sub_segment || ' | ' || subgroup", _valid),
        _level("treatment_archetype", "ARC", "segment || ' | ' || archetype",
               "segment || ' | ' || archetype"),
        f"SELECT 'anchor_molecule', 'ANC_' || {slug('mol')}, mol || ' (all forms)', "
        "sku.* FROM sku, unnest(molecules) AS u(mol)",
    ]
) + "),"

SPACES = f"""
space_f AS MATERIALIZED (
  SELECT level, space_id, space_label,
    {", ".join(f"CAST(sum({m}) AS DOUBLE) AS {m}" for m in MEASURES)},
    {", ".join(f"CAST(sum(CASE WHEN is_focal THEN {m} ELSE 0 END) AS DOUBLE) AS focal_{m}" for m in FOCAL_MEASURES)},
    count(DISTINCT row_id) AS sku_count
  FROM member GROUP BY 1, 2, 3),
context AS MATERIALIZED (
  SELECT level, space_id, segment, sub_segment FROM (
    SELECT level, space_id, segment, sub_segment,
      row_number() OVER (PARTITION BY level, space_id
                         ORDER BY sum(value_t2) DESC, segment, sub_segment) AS n
    FROM member GROUP BY 1, 2, 3, 4) WHERE n = 1),
company_f AS MATERIALIZED (
  SELECT *, CASE WHEN space_value_t2 <> 0 THEN value_t2 / space_value_t2 ELSE 0.0 END AS share_t2
  FROM (
    SELECT level, space_id, space_label, company_clean, bool_or(is_mnc) AS is_mnc,
      CAST(sum(value_t1) AS DOUBLE) AS value_t1, CAST(sum(value_t2) AS DOUBLE) AS value_t2,
      CAST(sum(sum(value_t1)) OVER (PARTITION BY level, space_id) AS DOUBLE) AS space_value_t1,
      CAST(sum(sum(value_t2)) OVER (PARTITION BY level, space_id) AS DOUBLE) AS space_value_t2,
      CAST(rank() OVER (PARTITION BY level, space_id ORDER BY sum(value_t2) DESC) AS INTEGER)
        AS rank_in_space
    FROM member GROUP BY 1, 2, 3, 4)),
brand_f AS MATERIALIZED (
  SELECT level, space_id, space_label, brand, brand_root, company_clean,
    CAST(sum(value_t1) AS DOUBLE) AS value_t1, CAST(sum(value_t2) AS DOUBLE) AS value_t2,
    bool_or(is_focal) AS is_focal,
    CAST(rank() OVER (PARTITION BY level, space_id ORDER BY sum(value_t2) DESC) AS INTEGER)
      AS rank_in_space
  FROM member GROUP BY 1, 2, 3, 4, 5, 6),
"""

GROWN = f"""
totals AS (
  SELECT t0 AS market_value_t0, t1 AS market_value_t1, t2 AS market_value_t2,
    t2 / t1 - 1 AS market_yoy, sqrt(t2 / t0) - 1 AS market_cagr_2y,
    c2 / t1 - 1 AS market_real_growth, q2 / q1 - 1 AS market_volume_growth,
    (t2 / t1 - 1) - (c2 / t1 - 1) AS market_price_effect,
    f2 AS focal_value_t2, f2 / t2 AS focal_share, coalesce(f2 / nullif(f1, 0) - 1, 0.0) AS focal_yoy
  FROM (SELECT sum(value_t0) t0, sum(value_t1) t1, sum(value_t2) t2, sum(cp_t2) c2, sum(qty_t1) q1,
          sum(qty_t2) q2, sum(focal_value_t1) f1, sum(focal_value_t2) f2
        FROM space_f WHERE level = 'segment')),
grown0 AS (
  SELECT *, {growth("value_t2", "value_t1")} AS value_yoy, {cagr("value_t2", "value_t0")} AS value_cagr_2y,
    value_t2 - value_t1 AS absolute_growth, {growth("cp_t2", "value_t1")} AS real_growth,
    {growth("cp_t1", "value_t0")} AS real_growth_prior, {growth("qty_t2", "qty_t1")} AS volume_growth,
    {cagr("qty_t2", "qty_t0")} AS volume_cagr_2y, recent_3m_sales * 4.0 AS run_rate_annualised,
    {ratio("value_t2", "qty_t2")} AS price_per_unit_t2, {ratio("value_t1", "qty_t1")} AS price_per_unit_t1,
    {ratio("focal_value_t2", "value_t2")} AS focal_share_t2,
    {ratio("focal_value_t1", "value_t1")} AS focal_share_t1,
    {growth("focal_value_t2", "focal_value_t1")} AS focal_yoy, focal_value_t2 > 1e-9 AS focal_present
  FROM space_f),
grown AS MATERIALIZED (
  SELECT *, value_yoy - real_growth AS price_effect,
    {clip("(CASE WHEN abs(value_t2) > 1e-9 THEN run_rate_annualised / value_t2 - 1.0 ELSE 0.0 END)", -0.9, 1.5)} AS momentum,
    {growth("price_per_unit_t2", "price_per_unit_t1")} AS price_per_unit_change,
    (focal_share_t2 - focal_share_t1) * 100.0 AS focal_share_delta_pp,
    CASE WHEN abs(focal_value_t1) > 1e-9 THEN focal_yoy - value_yoy ELSE 0.0 END AS focal_growth_gap,
    value_t2 / (SELECT market_value_t2 FROM totals) * 100.0 AS share_of_market_pct
  FROM grown0),
"""

COMPETITION = """
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY level, space_id ORDER BY value_t2 DESC, company_clean) AS n
  FROM company_f),
comp0 AS (
  SELECT level, space_id, CAST(count(*) FILTER (value_t2 > 1e-9) AS INTEGER) AS n_players,
    max(space_value_t2) AS tv,
    sum(pow(value_t2 / nullif(space_value_t2, 0) * 100.0, 2)) FILTER (value_t2 > 1e-9) AS h,
    max(value_t2) AS v1, sum(value_t2) FILTER (n <= 3) AS v3, sum(value_t2) FILTER (n <= 5) AS v5,
    max(company_clean) FILTER (n = 1) AS leader,
    CASE WHEN max(space_value_t1) > 1e-9 THEN
      sum(abs(value_t2 / nullif(space_value_t2, 0) - value_t1 / nullif(space_value_t1, 0))) / 2
      ELSE 0.0 END AS churn,
    CAST(count(*) FILTER (value_t1 <= 1e-9 AND value_t2 > 1e-9) AS INTEGER) AS entrants,
    sum(CASE WHEN is_mnc THEN value_t2 ELSE 0.0 END) AS mnc
  FROM ordered GROUP BY 1, 2),
comp AS MATERIALIZED (
  SELECT level, space_id, n_players,
    CASE WHEN live THEN h ELSE 10000.0 END AS hhi,
    CASE WHEN live THEN v1 / tv ELSE 1.0 END AS leader_share,
    CASE WHEN live THEN v3 / tv ELSE 1.0 END AS top3_share,
    CASE WHEN live THEN v5 / tv ELSE 1.0 END AS top5_share,
    CASE WHEN live THEN 10000.0 / h ELSE 0.0 END AS effective_competitors,
    CASE WHEN live THEN leader ELSE '' END AS leader_company,
    CASE WHEN live THEN churn ELSE 0.0 END AS share_churn,
    CASE WHEN live THEN entrants ELSE 0 END AS new_entrant_count,
    CASE WHEN live THEN mnc / tv ELSE 0.0 END AS mnc_share
  FROM (SELECT *, tv > 1e-9 AND n_players > 0 AS live FROM comp0)),
"""

RTW = """
own AS (SELECT * FROM sku WHERE is_focal AND value_t2 > 1e-9),
own_molecule AS (SELECT DISTINCT mol, brand_root FROM own, unnest(molecules) AS u(mol)),
lists AS MATERIALIZED (
  SELECT level, space_id, molecules, sum(value_t2) AS v, bool_or(is_oral_solid) FROM member GROUP BY 1, 2, 3),
space_mol AS MATERIALIZED (
  SELECT level, space_id, mol, sum(CAST(v AS DOUBLE) / len(molecules)) AS value
  FROM lists, unnest(molecules) AS u(mol) GROUP BY 1, 2, 3),
composition AS (
  SELECT level, space_id, mol AS molecule, value / value_t2 AS weight
  FROM space_mol JOIN space_f USING (level, space_id) WHERE value_t2 > 1e-9),
adjacency AS (
  SELECT level, space_id, sum(weight) AS a FROM composition
  WHERE molecule IN (SELECT mol FROM own_molecule) GROUP BY 1, 2),
shown AS (
  SELECT level, space_id, string_agg(brand_root, ', ' ORDER BY brand_root) AS brands FROM (
    SELECT level, space_id, brand_root,
      row_number() OVER (PARTITION BY level, space_id ORDER BY brand_root) AS n
    FROM (SELECT DISTINCT level, space_id, o.brand_root FROM composition JOIN own_molecule o
          ON molecule = mol WHERE o.brand_root <> '')) WHERE n <= 4 GROUP BY 1, 2),
detail AS (
  SELECT segment, sub_segment, sum(CASE WHEN is_focal THEN value_t2 ELSE 0 END) * 1.0 AS f, sum(value_t2) AS t
  FROM sku WHERE NOT (PLACEHOLDER) GROUP BY 1, 2 HAVING sum(value_t2) > 1e-9),
flags AS (
  SELECT level, space_id, sum(CASE WHEN is_oral_solid THEN value_t2 ELSE 0 END) AS solid,
    sum(value_t2) AS t,
    bool_or(subgroup IN (SELECT subgroup FROM own)) AS f1,
    bool_or(m.sub_segment IN (SELECT sub_segment FROM own)) AS f2,
    bool_or(m.segment IN (SELECT segment FROM own)) AS f3,
    max(CAST(d.f AS DOUBLE) / CAST(d.t AS DOUBLE)) AS det
  FROM member m LEFT JOIN detail d ON m.segment = d.segment AND m.sub_segment = d.sub_segment
  GROUP BY 1, 2),
mix AS (
  SELECT coalesce(CAST(sum(CASE WHEN is_oral_solid THEN value_t2 ELSE 0 END) AS DOUBLE)
    / nullif(CAST(sum(value_t2) AS DOUBLE), 0), 1.0) AS s FROM own),
rtw AS MATERIALIZED (
  SELECT g.level, g.space_id,
    CASE WHEN value_t2 > 1e-9 THEN CAST(solid AS DOUBLE) / CAST(t AS DOUBLE) ELSE 1.0 END AS space_solids_share,
    coalesce(a, 0.0) AS rtw_molecule_adjacency,
    CAST(CASE WHEN value_t2 <= 1e-9 THEN 0.0 WHEN brands IS NOT NULL THEN 1.0 WHEN f1 THEN 0.75
      WHEN f2 THEN 0.6 WHEN f3 THEN 0.3 ELSE 0.0 END AS DOUBLE) AS rtw_brand_franchise,
    CASE WHEN value_t2 > 1e-9 THEN coalesce(det, 0.0) ELSE 0.0 END AS rtw_detailing_adjacency,
    focal_share_t2 AS rtw_current_share,
    least(greatest(focal_growth_gap, -0.5), 0.5) AS rtw_share_momentum,
    coalesce(brands, '') AS adjacent_focal_brands
  FROM grown g JOIN flags USING (level, space_id) LEFT JOIN adjacency USING (level, space_id)
    LEFT JOIN shown USING (level, space_id)),
""".replace("PLACEHOLDER", placeholder("sub_segment"))


def _pick(values, by):
    out = " ".join(f"WHEN {by} = {i} THEN '{v}'" for i, v in enumerate(values[:-1]))
    return f"CASE {out} ELSE '{values[-1]}' END"


SIGNALS = f"""
brands AS (
  SELECT p_brand, CAST(regexp_replace(p_brand, '[^0-9]', '', 'g') AS INTEGER) AS n, count(*) AS parts,
    min(p_name) AS name, min(p_type) AS low_type, max(p_type) AS high_type FROM part GROUP BY 1, 2),
signals AS MATERIALIZED (
  SELECT printf('S-%02d', n) AS id, 'Note on ' || p_brand AS title,
    {_pick(["guidelines", "regulation", "launch", "burden"], "n % 4")} AS category,
    'Publisher ' || (n % 3) AS publisher, 'part table' AS source,
    CASE WHEN n % 5 = 0 THEN 'internal://' ELSE 'https://example.org/' END || p_brand AS url,
    '2000' AS published, '2001' AS accessed,
    {_pick(["high", "medium", "low", "unsure"], "n % 4")} AS confidence,
    {_pick(["tailwind", "headwind", "Tailwind", "neutral", "headwind"], "n % 5")} AS direction,
    CAST(parts % 13 + 1 AS DOUBLE) / 100 AS magnitude, 'Body of ' || p_brand AS body,
    CASE WHEN n % 3 = 0 THEN [upper(split_part(name, ' ', 1))] ELSE []::VARCHAR[] END AS molecules,
    CASE WHEN n % 6 = 1 THEN [low_type] ELSE []::VARCHAR[] END AS segments,
    CASE WHEN n % 6 = 2 THEN [high_type || ' M'] ELSE []::VARCHAR[] END AS sub_segments,
    CASE WHEN n % 2 = 0 THEN [lower(split_part(name, ' ', 2)), lower(p_brand)]
      ELSE []::VARCHAR[] END AS keywords
  FROM brands),
signed AS (
  SELECT *, CASE lower(direction) WHEN 'tailwind' THEN 1.0 WHEN 'headwind' THEN -1.0 ELSE 0.0 END * magnitude
    * CASE lower(confidence) WHEN 'high' THEN 1.0 WHEN 'medium' THEN 0.6 WHEN 'low' THEN 0.3 ELSE 0.5 END
    AS signed_magnitude FROM signals),
"""

LINKS = """
space_set AS (SELECT level, space_id, list(mol) AS mols FROM space_mol GROUP BY 1, 2),
matched AS MATERIALIZED (
  SELECT f.level, f.space_id, id, category, signed_magnitude AS s,
    list_sort(list_distinct(list_filter(g.molecules, lambda t: list_contains(mols, t) OR contains(upper(space_label), t)))) AS k1,
    len(list_filter(g.sub_segments, lambda t: lower(trim(t)) = lower(trim(c.sub_segment))
      OR contains(lower(space_label), lower(trim(t))))) > 0 AS k2,
    len(list_filter(g.segments, lambda t: lower(trim(t)) = lower(trim(c.segment)))) > 0 AS k3,
    list_sort(list_distinct(list_filter(g.keywords, lambda t: contains(lower(space_label), t)))) AS k4,
    space_label, c.segment, c.sub_segment
  FROM space_f f JOIN context c USING (level, space_id) LEFT JOIN space_set USING (level, space_id)
    CROSS JOIN signed g WHERE abs(signed_magnitude) >= 1e-9),
reasoned AS (
  SELECT *, CASE WHEN len(k1) > 0 THEN 'molecule match: ' || array_to_string(k1[1:3], ', ')
    WHEN k2 THEN 'sub-segment match: ' || CASE WHEN sub_segment <> '' THEN sub_segment ELSE space_label END
    WHEN k3 THEN 'segment match: ' || segment
    WHEN len(k4) > 0 THEN 'keyword match: ' || array_to_string(k4[1:3], ', ') END AS why
  FROM matched),
weighted AS (
  SELECT *, CASE WHEN row_number() OVER (PARTITION BY level, space_id, category ORDER BY abs(s) DESC, id) = 1
    THEN 1.0 ELSE 0.5 END AS w FROM reasoned WHERE why IS NOT NULL),
links AS MATERIALIZED (
  SELECT level, space_id, id AS signal_id, category,
    why || ' (category ' || category || ', weight ' || CASE WHEN w = 1.0 THEN '1.0' ELSE '0.5' END || ')' AS match_reason,
    s * w AS contribution FROM weighted),
tilt AS (
  SELECT f.level, f.space_id, coalesce(round(sum(contribution), 9), 0.0) AS trend_tilt_raw,
    coalesce(string_agg(signal_id, ',' ORDER BY signal_id), '') AS trend_signal_ids
  FROM space_f f LEFT JOIN links USING (level, space_id) GROUP BY 1, 2),
trend AS MATERIALIZED (
  SELECT *, least(greatest(1.0 + (trend_tilt_raw - trend_tilt_baseline), 0.80), 1.25) AS trend_multiplier
  FROM (SELECT *, median(trend_tilt_raw) OVER (PARTITION BY level) AS trend_tilt_baseline FROM tilt)),
enriched AS MATERIALIZED (
  SELECT g.*, c.* EXCLUDE (level, space_id), w.* EXCLUDE (level, space_id),
    space_solids_share * (SELECT s FROM mix) + (1 - space_solids_share) * (1 - (SELECT s FROM mix)) AS rtw_formulation_fit,
    CASE WHEN value_t2 > 1e-9 THEN n_players / (value_t2 / 100.0) ELSE 0.0 END AS crowding,
    greatest(-price_effect, 0.0) AS price_erosion,
    CASE WHEN hhi >= 2500 THEN 'Concentrated' WHEN hhi >= 1500 THEN 'Moderately concentrated'
      ELSE 'Fragmented' END AS concentration_label,
    n_players < 3 OR leader_share >= 0.80 AS is_structurally_closed,
    t.* EXCLUDE (level, space_id), x.segment, x.sub_segment
  FROM grown g JOIN comp c USING (level, space_id) JOIN rtw w USING (level, space_id)
    JOIN trend t USING (level, space_id) JOIN context x USING (level, space_id)),
"""


def scoring(config: ScoreConfig, level: str | None = None) -> str:
    low, high = config.winsor_low, config.winsor_high
    alone = f" AND level = '{level}'" if level else ""
    unpivot = " UNION ALL ".join(
        f"SELECT level, space_id, '{m}' AS metric, round({METRIC_COLUMNS[m]}, 9) AS v FROM kept" for m in METRICS
    )
    wide = ", ".join(f"max(pct) FILTER (metric = '{m}') AS score_{m}" for m in METRICS)
    pillars = ", ".join(
        "(" + " + ".join(f"score_{m} * {w!r}" for m, w in block.items()) + f") AS pillar_{p}"
        for p, block in config.metric_weights.items()
    )
    index = " + ".join(f"pillar_{p} * {w!r}" for p, w in config.pillar_weights.items())
    return f"""
kept AS MATERIALIZED (SELECT * FROM enriched WHERE value_t2 >= {config.min_value} AND n_players >= {config.min_players}{alone}),
long AS MATERIALIZED ({unpivot}),
bounds AS (SELECT metric, quantile_cont(v, {low}) AS lo, quantile_cont(v, {high}) AS hi FROM long GROUP BY 1),
clipped AS MATERIALIZED (
  SELECT level, space_id, metric, CASE WHEN hi > lo THEN least(greatest(v, lo), hi) ELSE v END AS clipped
  FROM long JOIN bounds USING (metric)),
pcts AS MATERIALIZED (
  SELECT level, space_id, metric,
    CASE WHEN ties = n THEN 50.0 WHEN metric IN ({quoted(sorted(INVERTED_METRICS))}) THEN 100.0 - p ELSE p END AS pct
  FROM (SELECT *, (rk + (ties - 1) / 2.0) / n * 100.0 AS p FROM (
    SELECT *, rank() OVER (PARTITION BY level, metric ORDER BY clipped) AS rk,
      count(*) OVER (PARTITION BY level, metric, clipped) AS ties,
      count(*) OVER (PARTITION BY level, metric) AS n FROM clipped))),
wide AS MATERIALIZED (SELECT level, space_id, {wide} FROM pcts GROUP BY 1, 2),
pillars AS (SELECT *, {pillars} FROM wide),
heads AS (
  SELECT *, {config.gate_floor} + {config.gate_ceiling - config.gate_floor!r} * pow(least(greatest(right_to_win_score, 0.0), 100.0) / 100.0, {config.gate_curve}) AS rtw_gate
  FROM (SELECT *, {index} AS market_opportunity_index, pillar_right_to_win AS right_to_win_score FROM pillars)),
ranked AS (
  SELECT *, CAST(rank() OVER (PARTITION BY level ORDER BY round(market_opportunity_index, 9) DESC) AS INTEGER) AS moi_rank,
    CAST(rank() OVER (PARTITION BY level ORDER BY round(priority_score, 9) DESC) AS INTEGER) AS cps_rank,
    CASE WHEN market_opportunity_index >= 70 THEN 'High' WHEN market_opportunity_index >= 45 THEN 'Medium' ELSE 'Low' END AS moi_band,
    CASE WHEN right_to_win_score >= 70 THEN 'Strong' WHEN right_to_win_score >= 45 THEN 'Moderate' ELSE 'Weak' END AS rtw_band
  FROM (SELECT *, market_opportunity_index * rtw_gate AS priority_score FROM heads)),
scored AS MATERIALIZED (
  SELECT k.*, s.* EXCLUDE (level, space_id),
    CASE WHEN moi_band = 'High' THEN CASE rtw_band WHEN 'Strong' THEN 'Double down'
        WHEN 'Moderate' THEN 'Build capability' ELSE 'Avoid or partner' END
      WHEN moi_band = 'Medium' AND rtw_band <> 'Weak' THEN 'Selective participation'
      ELSE 'Harvest or exit' END AS strategic_verdict
  FROM ranked s JOIN kept k USING (level, space_id))
"""


def _sql(ctes: str, select: str) -> str:
    return "WITH " + ctes.strip().rstrip(",") + "\n" + select


SPACE_CTES = FACTS + MEMBER + SPACES
GROWN_CTES = SPACE_CTES + GROWN
ENRICHED_CTES = GROWN_CTES + COMPETITION + RTW + SIGNALS + LINKS
SCORED_CTES = ENRICHED_CTES + scoring(SCORE)

SALT_LIST = "[" + quoted(SALT_WORDS) + "]"
MOD_LIST = "[" + quoted(BRAND_MODIFIERS) + "]"
DESCRIPTIONS = f"""
d AS (SELECT p_partkey AS row_id, CASE WHEN p_size = 1 THEN NULL WHEN p_size = 2 THEN '   '
    WHEN p_size = 3 THEN salt WHEN p_size < 15 THEN w1 || '  ' || salt
    WHEN p_size < 30 THEN w1 || ' + ' || w2 || ' ' || salt || ' salt'
    WHEN p_size < 40 THEN w1 || '+' || w1 || ' ' || salt || '+ +' || w2
    ELSE w2 || ' ' || salt || ' ' || w1 || ' + ' || lower(p_type) END AS description
  FROM (SELECT *, split_part(p_name, ' ', 1) AS w1, split_part(p_name, ' ', 2) AS w2,
          {SALT_LIST}[(p_partkey % {len(SALT_WORDS)} + 1)::INTEGER] AS salt FROM part)),
i AS (SELECT row_id, {ingredients("description")} AS parts FROM d)
"""

SCORE_COLUMNS = ["market_opportunity_index", "right_to_win_score", "rtw_gate", "priority_score"]


def forecast_sql(years: int = 5) -> str:
    blend = " + ".join(f"{m} * {w!r}" for m, w in FORECAST_BLEND.items())

    def grow(rate):
        return "value_t2 * " + " * ".join(
            f"(1.0 + market_cagr_2y + ({rate} - market_cagr_2y) * {0.72 ** k!r})" for k in range(years)
        )

    return f"""
start AS (
  SELECT s.*, market_cagr_2y, least(greatest(({blend}) * trend_multiplier, -0.15), 0.45) AS start_rate
  FROM scored s CROSS JOIN totals),
proj AS (
  SELECT *, {grow("start_rate")} AS projected_value, {grow("least(0.45, start_rate + 0.04)")} AS bull_value,
    {grow("greatest(-0.15, start_rate - 0.04)")} AS bear_value FROM start),
fore AS (
  SELECT *, (base_cagr - market_cagr_2y) * 100.0 AS outperformance_pp FROM (
    SELECT *, CASE WHEN value_t2 > 1e-9 AND projected_value > 1e-9
      THEN pow(projected_value / value_t2, {1.0 / years!r}) - 1.0 ELSE 0.0 END AS base_cagr FROM proj))
"""


FORECAST_COLUMNS = (
    "level, space_id, round(value_t2, 3) + 0.0 AS base_value, 5 AS horizon_years, "
    + rounded(["projected_value", "bull_value", "bear_value", "outperformance_pp"], 3)
    + ", round(market_cagr_2y, 6) + 0.0 AS market_cagr, "
    + rounded(["base_cagr", "trend_multiplier"])
    + ", outperformance_pp > 0 AS outperforms_market, CASE WHEN outperformance_pp > 0 THEN "
    "'Projected to outperform the market' ELSE 'Projected to lag the market' END AS verdict"
)


def sensitivity_sql(level: str | None = None) -> str:
    draws = json.dumps(weight_draws(SENSITIVITY, SCORE))
    names = list(json.loads(draws)[0])
    shape = json.dumps([{n: ("INTEGER" if n == "draw" else "DOUBLE") for n in names}])
    pillars = ", ".join(
        "(" + " + ".join(f"score_{m} * w.{p}__{m}" for m in block) + f") AS d_{p}"
        for p, block in METRIC_WEIGHTS.items()
    )
    index = " + ".join(f"d_{p} * w.moi_weights__{p}" for p in SCORE.pillar_weights)
    return ENRICHED_CTES + scoring(SCORE, level) + f""",
draws AS MATERIALIZED (SELECT unnest(from_json('{draws}', '{shape}')) AS w),
rescored AS (SELECT level, space_id, w, {pillars} FROM scored CROSS JOIN draws),
drawn AS (SELECT level, space_id, w.draw AS draw, round(({index}) * (0.35 + {SCORE.gate_ceiling - SCORE.gate_floor!r}
   * pow(least(greatest(d_right_to_win, 0.0), 100.0) / 100.0, 1.35)), 9) AS s FROM rescored),
placed AS (SELECT *, row_number() OVER (PARTITION BY level, draw ORDER BY s DESC, space_id) AS pos FROM drawn),
stats AS (SELECT level, space_id, round(count(*) FILTER (pos <= 5) / {SENSITIVITY.iterations}.0, 4) AS top_k_frequency,
    round(avg(pos), 2) AS mean_rank, CAST(median(pos) AS DOUBLE) AS median_rank, CAST(max(pos) AS INTEGER) AS worst_rank,
    CAST(min(pos) AS INTEGER) AS best_rank FROM placed GROUP BY 1, 2),
stability AS (
  SELECT level, space_id, space_label, CAST(row_number() OVER (PARTITION BY level
      ORDER BY round(priority_score, 9) DESC, space_id) AS INTEGER) AS baseline_rank,
    top_k_frequency, mean_rank, median_rank, worst_rank, best_rank
  FROM scored JOIN stats USING (level, space_id))
"""


STABILITY = (
    "SELECT *, top_k_frequency >= 0.8 AS is_robust, baseline_rank <= 5 AND top_k_frequency < 0.6 "
    "AS is_fragile FROM stability"
)

WHITESPACE_CTE = f""",
gap AS (
  SELECT s.*, focal_share, value_t2 * focal_share AS fair_share_value,
    value_t2 * focal_share - focal_value_t2 AS value_gap, focal_share_t2 / focal_share AS penetration_index
  FROM scored s CROSS JOIN (SELECT focal_share FROM totals)
  WHERE market_opportunity_index >= 55 AND focal_share_t2 < focal_share * 0.75
    AND value_t2 >= {WHITESPACE.min_value} AND (rtw_molecule_adjacency >= 0.3 OR rtw_brand_franchise >= 0.6))
"""
ROUTE = (
    "concat_ws('; ', CASE WHEN rtw_brand_franchise >= 1.0 AND adjacent_focal_brands <> '' THEN 'brands: ' || "
    "adjacent_focal_brands WHEN rtw_brand_franchise >= 0.6 THEN 'brands' END, "
    "CASE WHEN rtw_molecule_adjacency >= 0.3 THEN 'molecules: ' || "
    "CAST(CAST(round(rtw_molecule_adjacency * 100.0, 0) AS INTEGER) AS VARCHAR) || '%' END, "
    "CASE WHEN rtw_detailing_adjacency > 0.02 THEN 'detailing' END)"
)


def explain_sql() -> str:
    parts = []
    for p, block in METRIC_WEIGHTS.items():
        parts.append((p, "", f"pillar_{p}"))
        parts += [(p, m, f"score_{m}") for m in block]
    head = (
        "level, space_id, round(market_opportunity_index, 1) AS market_opportunity_index, "
        "round(right_to_win_score, 1) AS right_to_win_score, round(rtw_gate, 3) AS rtw_gate, "
        "round(priority_score, 1) AS priority_score, strategic_verdict"
    )
    return " UNION ALL ".join(
        f"SELECT {head}, '{p}' AS pillar, '{m}' AS metric, round({c}, 1) AS score FROM scored"
        for p, m, c in parts
    )


def _descr() -> str:
    return "CASE level " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LEVEL_DESCRIPTIONS.items()) + " END"


PLAIN_NUMBER = r"regexp_full_match(trim(price), '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?')"

RAW_CELLS = """
raw AS (SELECT o_orderkey AS row_id, '  ' || o_orderpriority || ' ' AS label,
  CASE WHEN o_orderkey % 7 = 0 THEN 'n/a' WHEN o_orderkey % 11 = 0 THEN NULL
  WHEN o_orderkey % 13 = 0 THEN ['1d', '5f', '0x1p3', 'NaN', '1_000', '2e3', '-.5', '+7.', '1e', '--1', '12 34'][(o_orderkey % 11 + 1)::INTEGER]
  ELSE ' ' || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) END AS price FROM orders)
"""

ORACLE = {
    "coerce_numeric": _sql(RAW_CELLS, "SELECT row_id, trim(label) AS label, "
                           f"coalesce(CASE WHEN {PLAIN_NUMBER} THEN try_cast(trim(price) AS DOUBLE) END, 0.0) AS price FROM raw"),
    "coercion_counts": _sql(RAW_CELLS, "SELECT 'price' AS \"column\", count(*) AS unparseable FROM raw "
                            f"WHERE price IS NOT NULL AND NOT ({PLAIN_NUMBER})"),
    "split_ingredients": _sql(DESCRIPTIONS, "SELECT row_id, array_to_string(parts, '|') AS ingredients, "
                              "CAST(len(parts) AS INTEGER) AS ingredient_count FROM i"),
    "ingredient_signature": _sql(
        DESCRIPTIONS,
        "SELECT array_to_string(list_sort(parts), ' + ') AS molecule_signature, count(*) AS packs, "
        "max(array_to_string(parts, ' + ')) AS last_canonical FROM i GROUP BY 1"),
    "archetype": _sql(FACTS, "SELECT archetype AS treatment_archetype, CAST(len(molecules) AS INTEGER) "
                      "AS molecule_count, count(*) AS packs FROM sku GROUP BY 1, 2"),
    "brand_root": f"""WITH b AS (SELECT p_partkey AS row_id, CASE WHEN p_size = 1 THEN NULL WHEN p_size = 2 THEN '5-MONO'
    WHEN p_size < 10 THEN w1 || '-' || md WHEN p_size < 20 THEN w1 || ' ' || lower(md)
    WHEN p_size < 30 THEN w1 || ' ' || md || ' ' || w2 WHEN p_size < 35 THEN 'AB ' || md
    WHEN p_size < 40 THEN 'ab-' || w2 || ' ' || md ELSE ' ' || p_name || ' ' END AS brand
  FROM (SELECT *, split_part(p_name, ' ', 1) AS w1, split_part(p_name, ' ', 2) AS w2,
      {MOD_LIST}[(p_partkey % {len(BRAND_MODIFIERS)} + 1)::INTEGER] AS md FROM part))
  SELECT row_id, {root("brand")} AS brand_root FROM b""",
    "focal_flags": _sql(FACTS, "SELECT company, company_clean, company = '" + FOCAL + "' AS is_focal, is_mnc, "
                        "is_oral_solid, count(*) AS packs FROM sku GROUP BY 1, 2, 3, 4, 5"),
    "realised_price": _sql(FACTS, "SELECT row_id, round(coalesce(CAST(value_t2 AS DOUBLE) / "
                           "nullif(CAST(qty_t2 AS DOUBLE), 0), 0.0), 10) AS realised_price_per_unit FROM sku"),
    "slug": "SELECT c_custkey, " + slug("' ' || c_name || ' / ' || c_mktsegment || '--'") + " AS slug FROM customer",
    "space_membership": _sql(FACTS + MEMBER, "SELECT row_id, level, space_id, space_label, segment, sub_segment FROM member"),
    "space_facts": _sql(SPACE_CTES, "SELECT level, space_id, space_label, "
                        + rounded(MEASURES + ["focal_" + m for m in FOCAL_MEASURES])
                        + f", sku_count, {_descr()} AS level_description FROM space_f"),
    "space_context": _sql(SPACE_CTES, "SELECT * FROM context"),
    "company_facts": _sql(SPACE_CTES, "SELECT level, space_id, space_label, company_clean, is_mnc, rank_in_space, "
                          + rounded(["value_t1", "value_t2", "space_value_t1", "space_value_t2", "share_t2"]) + " FROM company_f"),
    "brand_facts": _sql(SPACE_CTES, "SELECT level, space_id, space_label, brand, brand_root, company_clean, is_focal, rank_in_space, "
                        + rounded(["value_t1", "value_t2"]) + " FROM brand_f"),
    "growth_metrics": _sql(GROWN_CTES, "SELECT level, space_id, " + rounded(GROWTH) + " FROM grown"),
    "momentum": _sql(GROWN_CTES, "SELECT level, space_id, " + rounded(["run_rate_annualised", "momentum"]) + " FROM grown"),
    "focal_position": _sql(GROWN_CTES, "SELECT level, space_id, focal_present, " + rounded(
        ["focal_share_t2", "focal_share_t1", "focal_share_delta_pp", "focal_yoy", "focal_growth_gap",
         "share_of_market_pct"]) + " FROM grown"),
    "market_totals": _sql(GROWN_CTES, "SELECT " + rounded(
        ["market_value_t0", "market_value_t1", "market_value_t2", "market_yoy", "market_cagr_2y",
         "market_real_growth", "market_volume_growth", "market_price_effect", "focal_value_t2",
         "focal_share", "focal_yoy"]) + " FROM totals"),
    "competition": _sql(GROWN_CTES + COMPETITION, "SELECT level, space_id, n_players, leader_company, new_entrant_count, "
                        + rounded(["hhi", "leader_share", "top3_share", "top5_share", "effective_competitors",
                                   "share_churn", "mnc_share"]) + " FROM comp"),
    "structure_flags": _sql(ENRICHED_CTES, "SELECT level, space_id, concentration_label, is_structurally_closed, "
                            + rounded(["crowding", "price_erosion"]) + " FROM enriched"),
    "top_competitors": _sql(GROWN_CTES + COMPETITION, "SELECT level, space_id, space_label, company_clean, rank_in_space, "
                            "CAST(n AS INTEGER) AS position, " + rounded(["value_t2", "share_t2"]) + ", "
                            + "round(CASE WHEN abs(value_t1) > 1e-9 THEN value_t2 / value_t1 - 1 ELSE 0.0 END, 6) + 0.0 AS yoy"
                            " FROM ordered WHERE n <= 8"),
    "focal_estate": _sql(GROWN_CTES + RTW, """SELECT DISTINCT * FROM (
      SELECT 'subgroup' AS kind, subgroup AS value, CAST(NULL AS VARCHAR) AS brand_root FROM own UNION ALL
      SELECT 'sub_segment', sub_segment, NULL FROM own UNION ALL SELECT 'segment', segment, NULL FROM own UNION ALL
      SELECT 'brand', brand_root, NULL FROM own UNION ALL SELECT 'molecule', mol, brand_root FROM own_molecule)"""),
    "space_composition": _sql(GROWN_CTES + RTW, "SELECT level, space_id, molecule, " + r("weight") + " FROM composition"),
    "right_to_win": _sql(ENRICHED_CTES, "SELECT level, space_id, adjacent_focal_brands, " + rounded(
        ["space_solids_share", "rtw_molecule_adjacency", "rtw_brand_franchise", "rtw_detailing_adjacency",
         "rtw_formulation_fit", "rtw_current_share", "rtw_share_momentum"]) + " FROM enriched"),
    "excluded_spaces": _sql(ENRICHED_CTES, f"SELECT level, space_id, CASE WHEN value_t2 < {SCORE.min_value} THEN "
                            f"'below size floor of {SCORE.min_value:.0f}' ELSE 'fewer than {SCORE.min_players} active players' END "
                            f"AS exclusion_reason FROM enriched WHERE value_t2 < {SCORE.min_value} OR n_players < {SCORE.min_players}"),
    "winsorised": _sql(SCORED_CTES, "SELECT level, space_id, metric, " + r("clipped") + " FROM clipped"),
    "metric_percentiles": _sql(SCORED_CTES, "SELECT level, space_id, metric, " + r("pct") + " FROM pcts"),
    "pillar_scores": _sql(SCORED_CTES, "SELECT level, space_id, " + rounded(["pillar_" + p for p in METRIC_WEIGHTS], 9) + " FROM scored"),
    "scorecard": _sql(SCORED_CTES, "SELECT level, space_id, space_label, moi_rank, cps_rank, "
                      + r("value_t2") + ", " + rounded(SCORE_COLUMNS, 9) + " FROM scored"),
    "verdicts": _sql(SCORED_CTES, "SELECT level, space_id, moi_band, rtw_band, strategic_verdict FROM scored"),
    "scorecard_whatif": _sql(ENRICHED_CTES + scoring(SCORE.with_weights(WHAT_IF)),
                             "SELECT level, space_id, moi_rank, cps_rank, " + rounded(SCORE_COLUMNS, 9) + " FROM scored"),
    "explain_score": _sql(SCORED_CTES, explain_sql()),
    "rank_spaces": _sql(SCORED_CTES, "SELECT level, space_id, space_label, cps_rank, strategic_verdict, "
                        + r("scored.value_t2", "value_t2") + ", " + rounded(["market_opportunity_index", "priority_score"], 9)
                        + " FROM scored WHERE level = 'molecule_combination' ORDER BY round(scored.priority_score, 9) DESC, space_id LIMIT 10"),
    "forecast": _sql(SCORED_CTES + "," + forecast_sql(), "SELECT " + FORECAST_COLUMNS + " FROM fore"),
    "weight_draws": _sql(sensitivity_sql(), "SELECT w.draw AS draw, (SELECT count(*) FROM scored) AS spaces, "
                         "round(w.moi_weights__future_potential, 6) AS future_potential, "
                         "round(w.right_to_win__formulation_fit, 6) AS formulation_fit FROM draws"),
    "sensitivity": _sql(sensitivity_sql(), STABILITY),
    "sensitivity_level": _sql(sensitivity_sql(LEVEL), STABILITY),
    "sensitivity_top": _sql(sensitivity_sql(), STABILITY + " ORDER BY top_k_frequency DESC, mean_rank, space_id LIMIT 12"),
    "whitespace": _sql(SCORED_CTES + WHITESPACE_CTE, "SELECT level, space_id, space_label, leader_company, strategic_verdict, "
                       + ROUTE + " AS route_to_win, " + rounded(
                           ["value_t2", "value_yoy", "real_growth", "market_opportunity_index", "right_to_win_score",
                            "priority_score", "focal_value_t2", "focal_share_t2", "penetration_index",
                            "fair_share_value", "value_gap", "leader_share", "hhi"], 3) + " FROM gap"),
    "signal_corpus": _sql(SIGNALS, "SELECT '/signals/' || id || '.md' AS path, id, title, category, publisher, url, confidence, "
                          "direction, magnitude, body, " + ", ".join(
                              f"array_to_string({c}, '|') AS {c}" for c in ("molecules", "segments", "sub_segments", "keywords"))
                          + " FROM signals"),
    "signal_magnitude": _sql(SIGNALS, "SELECT id, " + r("signed_magnitude") + " FROM signed"),
    "citations": _sql(SIGNALS, "SELECT id, title, publisher, source, url, published, accessed, confidence, "
                      "CASE WHEN starts_with(url, 'internal://') THEN 'Derived from supplied data' ELSE 'External source' END AS type FROM signals"),
    "signal_links": _sql(ENRICHED_CTES, "SELECT level, space_id, signal_id, category, match_reason, " + r("contribution") + " FROM links"),
    "trend_multiplier": _sql(ENRICHED_CTES, "SELECT level, space_id, trend_signal_ids, "
                             + rounded(["trend_tilt_raw", "trend_tilt_baseline", "trend_multiplier"]) + " FROM trend"),
}
