"""The same views as plain SQL."""

from __future__ import annotations

from checks.market_sql import (
    ENRICHED_CTES,
    GROWN_CTES,
    SCORED_CTES,
    SPACE_CTES,
    _sql,
    forecast_sql,
    r,
    rounded,
    slug,
)
from checks.market_sql import SIGNALS
from checks.text_sql import GRAMS, RRF, WORDS, rec
from checks.view_queries import ADHOC, COMPARED, FORECAST


def pct(x: str, name: str, digits: int = 2) -> str:
    return f"round(({x}) * 100.0, {digits}) + 0.0 AS {name}"


LOOKUPS = f""",
lookups AS (SELECT DISTINCT unnest(['cls_' || {slug("p_brand")}, p_type, upper(p_name), split_part(p_name, ' ', 2),
  p_type || ' nowhere']) AS lookup FROM part),
found AS (
  SELECT lookup, CASE WHEN lower(space_id) = lower(trim(lookup)) THEN 1 WHEN lower(space_label) = lower(trim(lookup)) THEN 2
    WHEN contains(lower(space_label), lower(trim(lookup))) THEN 3 END AS how, level, space_id, value_t2
  FROM lookups CROSS JOIN scored)
"""
CARDS = """,
rivals AS (SELECT level, space_id, string_agg(n || '/' || company_clean || '/' || printf('%.4f', value_t2) || '/' || rank_in_space, '; ' ORDER BY n) AS t
  FROM ordered WHERE n <= 8 GROUP BY 1, 2),
bo AS (SELECT *, row_number() OVER (PARTITION BY level, space_id ORDER BY value_t2 DESC, brand, brand_root, company_clean) AS n FROM brand_f),
tb AS (SELECT level, space_id, string_agg(n || '/' || brand || '/' || company_clean || '/' || printf('%.4f', value_t2), '; ' ORDER BY n) AS t
  FROM bo WHERE n <= 6 GROUP BY 1, 2),
fo AS (SELECT *, row_number() OVER (PARTITION BY level, space_id ORDER BY value_t2 DESC, brand, brand_root, company_clean) AS n
  FROM brand_f WHERE is_focal AND value_t2 > 0),
fb AS (SELECT level, space_id, string_agg(n || '/' || brand || '/' || printf('%.4f', value_t2), '; ' ORDER BY n) AS t FROM fo WHERE n <= 6 GROUP BY 1, 2)
"""


def num(x: str, digits: int) -> str:
    return f"printf('%.{digits}f', round({x}, {digits}))"


TRADE = f""",
a AS (SELECT * FROM seg ORDER BY value_t2 DESC, level, space_id LIMIT 1),
b AS (SELECT * FROM seg ORDER BY real_growth DESC, level, space_id LIMIT 1),
c AS (SELECT * FROM seg ORDER BY hhi, level, space_id LIMIT 1),
d AS (SELECT * FROM seg ORDER BY market_opportunity_index DESC, level, space_id LIMIT 1),
e AS (SELECT * FROM seg ORDER BY priority_score DESC, level, space_id LIMIT 1),
tensions AS (SELECT CASE WHEN a.space_id <> b.space_id THEN 'largest: ' || a.space_label || ' (' || {num("a.value_t2", 0)} || ', '
    || {num("a.real_growth * 100", 1)} || '%); fastest: ' || b.space_label || ' (' || {num("b.real_growth * 100", 1)} || '%)' END AS size_growth,
  CASE WHEN c.space_id <> b.space_id THEN 'fastest: ' || b.space_label || ' (HHI ' || {num("b.hhi", 0)}
    || '); least concentrated: ' || c.space_label || ' (HHI ' || {num("c.hhi", 0)} || ')' END AS growth_competition,
  CASE WHEN d.space_id <> e.space_id THEN 'best market: ' || d.space_label || ' (' || {num("d.market_opportunity_index", 1)} || ', fit '
    || {num("d.right_to_win_score", 1)} || '); first choice: ' || e.space_label || ' (' || {num("e.priority_score", 1)} || ', fit '
    || {num("e.right_to_win_score", 1)} || ')' END AS moi_cps
FROM a, b, c, d, e)
"""
SEGMENTS = ", seg AS (SELECT * FROM scored WHERE level = 'segment')"
NAMED = f""",
asked AS (SELECT unnest([{", ".join(f"'{x}'" for x in COMPARED)}]) AS lookup),
met AS (
  SELECT lookup, level, space_id, row_number() OVER (PARTITION BY lookup ORDER BY how, value_t2 DESC, space_id, level) AS n
  FROM (SELECT lookup, CASE WHEN lower(space_id) = lower(trim(lookup)) THEN 1 WHEN lower(space_label) = lower(trim(lookup)) THEN 2
    WHEN contains(lower(space_label), lower(trim(lookup))) THEN 3 END AS how, level, space_id, value_t2 FROM asked CROSS JOIN scored)
  WHERE how IS NOT NULL),
seg AS (SELECT * FROM scored SEMI JOIN (SELECT * FROM met WHERE n = 1) USING (level, space_id))"""

RESOLVED = """,
chosen AS (SELECT company_clean FROM company_f WHERE contains(upper(company_clean), 'NATION_1') GROUP BY 1
  ORDER BY round(sum(value_t2), 6) DESC, company_clean LIMIT 1)
"""
OWN = "(SELECT * FROM sku WHERE is_focal)"
FOCAL_GROWN = (
    "CAST(sum(value_t2) AS DOUBLE) AS v2, CAST(sum(value_t1) AS DOUBLE) AS v1"
)
GROWTH = "CASE WHEN v1 > 0 THEN round((v2 / v1 - 1.0) * 100.0, 2) ELSE 0.0 END AS growth_pct"
FORE = "SELECT level, space_id, round({t}.value_t2, 3) + 0.0 AS base_value, " + rounded(
    [c for c in FORECAST if c != "base_value"], 3
)

ORACLE = {
    "market_overview": _sql(SCORED_CTES, "SELECT round(market_value_t2, 1) AS market_value, round(market_value_t1, 1) AS market_value_prior, "
        + ", ".join(pct(c, c + "_pct") for c in ("market_yoy", "market_cagr_2y", "market_real_growth", "market_volume_growth",
                                                 "market_price_effect", "focal_share", "focal_yoy"))
        + ", round(focal_value_t2, 1) AS focal_value, round((focal_yoy - market_yoy) * 100.0, 2) AS focal_growth_gap_pp, "
        "(SELECT count(*) FROM scored) AS spaces_scored, (SELECT count(*) FROM sku) AS sku_count FROM totals"),
    "segment_overview": _sql(ENRICHED_CTES, "SELECT space_label, round(value_t2, 4) AS value_t2, "
        + ", ".join(pct(c, c + "_pct") for c in ("value_yoy", "real_growth", "volume_growth", "focal_share_t2"))
        + ", round(hhi, 4) AS hhi, n_players FROM enriched WHERE level = 'segment'"),
    "find_space": _sql(SCORED_CTES + LOOKUPS, """SELECT lookup, how, level, space_id FROM (SELECT *, row_number() OVER (PARTITION BY lookup
        ORDER BY how, value_t2 DESC, space_id, level) AS n FROM found WHERE how IS NOT NULL) WHERE n = 1"""),
    "deep_dive": _sql(SCORED_CTES + CARDS, "SELECT s.level, s.space_id, s.space_label, segment, sub_segment, n_players, trend_signal_ids, "
        "strategic_verdict, coalesce(r.t, '') AS top_companies, coalesce(tb.t, '') AS top_brands, coalesce(fb.t, '') AS focal_brands, coalesce(sg.t, '') AS signals, "
        + rounded(["value_t2", "value_yoy", "hhi", "focal_share_t2", "trend_multiplier", "priority_score"])
        + " FROM scored s LEFT JOIN rivals r USING (level, space_id) LEFT JOIN tb USING (level, space_id) LEFT JOIN fb USING (level, space_id) "
        "LEFT JOIN (SELECT level, space_id, string_agg(signal_id || '/' || match_reason || '/' || printf('%.4f', contribution), '; ' ORDER BY signal_id) AS t "
        "FROM links GROUP BY 1, 2) sg USING (level, space_id)"),
    "space_signals": _sql(ENRICHED_CTES, "SELECT level, space_id, signal_id, match_reason, " + r("contribution") + " FROM links"),
    "compare_spaces": _sql(SCORED_CTES + SEGMENTS + TRADE, "SELECT * FROM tensions"),
    "compare_named": _sql(SCORED_CTES + NAMED + TRADE, "SELECT 'space' AS kind, level, space_id AS item, space_label AS text, "
        + rounded(["value_t2", "priority_score"]) + " FROM seg UNION ALL SELECT 'trade-off', NULL, i.item, i.text, NULL, NULL FROM ("
        "SELECT unnest([{'item': 'size_growth', 'text': size_growth}, {'item': 'growth_competition', 'text': growth_competition}, "
        "{'item': 'moi_cps', 'text': moi_cps}]) AS i FROM tensions) UNION ALL SELECT 'missing', NULL, lookup, NULL, NULL, NULL "
        "FROM asked ANTI JOIN met USING (lookup)"),
    "signal_search": rec(SIGNALS.strip() + " documents AS (SELECT id AS doc_id, 'Note on' AS lang, substring(title, 9) AS source, "
        "body AS text FROM signals)," + WORDS + GRAMS + RRF, "SELECT query_id, CAST(rank AS INTEGER) AS rank, '[' || id || ']' AS citation, "
        "id AS signal_id, chunks.title, publisher, url, text AS excerpt, " + r("score", digits=4)
        + " FROM hits JOIN chunks USING (doc_id, chunk_no) JOIN signals ON id = doc_id"),
    "competitor_profile": _sql(GROWN_CTES.rstrip().rstrip(",") + RESOLVED, """SELECT company_clean AS company, round(v2, 1) AS value,
        round(v2 / (SELECT market_value_t2 FROM totals) * 100.0, 2) AS share_pct, round((v2 / v1 - 1.0) * 100.0, 2) AS growth_pct, leads_in_spaces
        FROM (SELECT company_clean, sum(value_t2) FILTER (level = 'segment') AS v2, sum(value_t1) FILTER (level = 'segment') AS v1,
          count(*) FILTER (rank_in_space = 1) AS leads_in_spaces FROM company_f JOIN chosen USING (company_clean) GROUP BY 1)"""),
    "competitor_strongholds": _sql(SPACE_CTES.rstrip().rstrip(",") + RESOLVED, "SELECT space_label, rank_in_space, " + rounded(["value_t2", "share_t2"])
        + " FROM company_f JOIN chosen USING (company_clean) WHERE level = 'sub_segment' ORDER BY company_f.value_t2 DESC, space_id LIMIT 8"),
    "competitor_brands": _sql(SPACE_CTES.rstrip().rstrip(",") + RESOLVED, "SELECT space_id, brand, " + rounded(["value_t2", "value_t1"])
        + " FROM brand_f JOIN chosen USING (company_clean) WHERE level = 'segment' ORDER BY brand_f.value_t2 DESC, space_id, brand LIMIT 8"),
    "focal_portfolio": _sql(GROWN_CTES, f"""SELECT round(coalesce(CAST(sum(value_t2) AS DOUBLE), 0.0), 1) AS value, count(*) AS sku_count,
        count(DISTINCT brand) AS brand_count, (SELECT count(DISTINCT m) FROM (SELECT unnest(molecules) AS m FROM {OWN})) AS molecule_count,
        (SELECT round(focal_share * 100.0, 2) FROM totals) AS share_pct, (SELECT round(focal_yoy * 100.0, 2) FROM totals) AS growth_pct,
        (SELECT round(market_yoy * 100.0, 2) FROM totals) AS market_growth_pct FROM {OWN}"""),
    "focal_brands": _sql(GROWN_CTES, f"SELECT brand_root, sub_segment, round(v2, 6) AS value_t2, round(v1, 6) AS value_t1, brands, {GROWTH} FROM ("
        f"SELECT brand_root, sub_segment, {FOCAL_GROWN}, count(DISTINCT brand) AS brands FROM {OWN} GROUP BY 1, 2) ORDER BY v2 DESC, brand_root, sub_segment LIMIT 15"),
    "focal_franchises": _sql(GROWN_CTES, f"SELECT brand_root, round(v2, 6) AS value_t2, {GROWTH} FROM (SELECT brand_root, {FOCAL_GROWN} FROM {OWN} "
        "GROUP BY 1) ORDER BY v2 DESC, brand_root LIMIT 12"),
    "focal_positions": _sql(SCORED_CTES, "SELECT space_label, strategic_verdict, " + rounded(
        ["focal_value_t2", "focal_share_t2", "focal_yoy", "value_yoy", "real_growth"])
        + " FROM scored WHERE level = 'sub_segment' ORDER BY scored.focal_value_t2 DESC, space_id LIMIT 10"),
    "focal_molecules": _sql(GROWN_CTES, f"SELECT DISTINCT unnest(molecules) AS molecule FROM {OWN}"),
    "competitive_standing": _sql(SPACE_CTES, """SELECT company_clean, value_t2, value_t1, CAST(market_rank AS INTEGER) AS market_rank,
        round((value_t2 / value_t1 - 1.0) * 100.0, 4) AS growth_pct FROM (SELECT *, rank() OVER (ORDER BY value_t2 DESC) AS market_rank FROM (
        SELECT company_clean, round(sum(value_t2), 6) AS value_t2, round(sum(value_t1), 6) AS value_t1 FROM company_f WHERE level = 'segment' GROUP BY 1))
        WHERE market_rank <= 10 OR upper(company_clean) = 'NATION_0'"""),
    "growth_decomposition": _sql(GROWN_CTES, "SELECT space_label, " + ", ".join(
        pct(c, n, 4) for c, n in (("value_yoy", "reported_pct"), ("real_growth", "real_pct"), ("volume_growth", "volume_pct"),
                                  ("price_effect", "price_pct"))) + " FROM grown WHERE level = 'segment'"),
    "focal_gap": _sql(SCORED_CTES, "SELECT space_label, round(scored.focal_value_t2, 4) AS focal_value_t2, " + pct("focal_share_t2", "focal_share_pct", 4)
        + ", " + pct("focal_yoy - value_yoy", "growth_gap_pp", 4)
        + " FROM scored WHERE level = 'sub_segment' ORDER BY scored.focal_value_t2 DESC, space_id LIMIT 8"),
    "forecast_top": _sql(SCORED_CTES + "," + forecast_sql(), FORE.format(t="fore") + " FROM fore WHERE cps_rank <= 10"),
    "forecast_three_years": _sql(SCORED_CTES + "," + forecast_sql(3), FORE.format(t="fore") + " FROM fore"),
    "adhoc_sql": _sql(SPACE_CTES, ADHOC.replace("FROM space_facts", "FROM space_f").replace("sum(sku_count)", "CAST(sum(sku_count) AS BIGINT)")),
    "build_metadata": _sql(SPACE_CTES, f"""SELECT 'sku_rows' AS key, count(*)::DOUBLE AS value FROM sku
        UNION ALL SELECT 'space_rows', count(*) FROM space_f UNION ALL SELECT 'membership_rows', count(*) FROM member
        UNION ALL SELECT 'market_value_latest', round(CAST(sum(value_t2) AS DOUBLE), 2) FROM sku
        UNION ALL SELECT 'focal_value_latest', round(coalesce(CAST(sum(value_t2) AS DOUBLE), 0.0), 2) FROM {OWN}
        UNION ALL SELECT 'focal_share_pct', round(100.0 * CAST(sum(CASE WHEN is_focal THEN value_t2 ELSE 0 END) AS DOUBLE) / CAST(sum(value_t2) AS DOUBLE), 4) FROM sku"""),
    "warehouse_counts": _sql(SPACE_CTES, """SELECT 'sku_facts' AS "table", count(*) AS rows FROM sku UNION ALL SELECT 'space_membership', count(*) FROM member
        UNION ALL SELECT 'space_facts', count(*) FROM space_f UNION ALL SELECT 'company_facts', count(*) FROM company_f
        UNION ALL SELECT 'brand_facts', count(*) FROM brand_f"""),
    "level_reconciliation": _sql(SPACE_CTES, """SELECT level, round(sum(value_t2), 4) AS value_t2, CAST(sum(sku_count) AS BIGINT) AS pairs,
        round(sum(value_t2) / (SELECT CAST(sum(value_t2) AS DOUBLE) FROM sku), 6) AS of_packs FROM space_f GROUP BY 1"""),
}
