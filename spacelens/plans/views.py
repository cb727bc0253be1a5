"""Analyst views over a scored market. Every view is a DataFrame."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spacelens.config import LEVELS, ForecastConfig, RetrievalConfig, SensitivityConfig, WhitespaceConfig
from spacelens.functions.ratios import plain_growth
from spacelens.operators.chunks import chunk_documents
from spacelens.operators.competition import top_competitors
from spacelens.operators.forecast import forecast_spaces
from spacelens.operators.index import TextIndex
from spacelens.operators.ranking import rank_desc
from spacelens.operators.retrieval import search
from spacelens.operators.scoring import top_spaces
from spacelens.operators.sensitivity import sensitivity, weight_draws
from spacelens.operators.substring import substring_join
from spacelens.operators.whitespace import find_whitespace
from spacelens.plans.market import Market
from spacelens.sources.stage import stage

SPACE_KEYS = ["level", "space_id"]
RANK_BY = ("priority_score", "market_opportunity_index", "value_t2", "value_yoy")


def _pct(c, digits: int = 2):
    return F.round((F.col(c) if isinstance(c, str) else c) * 100.0, digits)


def market_overview(m: Market) -> DataFrame:
    """One row of market totals in percent, with the number of scored spaces and of packs."""
    scored = m.scored.agg(F.count(F.lit(1)).alias("n")).scalar()
    packs = m.cells.agg(F.coalesce(F.sum("sku_count"), F.lit(0)).cast("long").alias("n")).scalar()
    return m.totals.select(
        F.round("market_value_t2", 1).alias("market_value"),
        F.round("market_value_t1", 1).alias("market_value_prior"),
        *[
            _pct(c).alias(c + "_pct")
            for c in ("market_yoy", "market_cagr_2y", "market_real_growth", "market_volume_growth",
                      "market_price_effect", "focal_share", "focal_yoy")
        ],
        F.round("focal_value_t2", 1).alias("focal_value"),
        F.round((F.col("focal_yoy") - F.col("market_yoy")) * 100.0, 2).alias("focal_growth_gap_pp"),
        scored.alias("spaces_scored"),
        packs.alias("sku_count"),
    )


def segment_overview(m: Market) -> DataFrame:
    return (
        m.enriched.where("level = 'segment'")
        .select(
            "space_label", F.round("value_t2", 4).alias("value_t2"),
            *[_pct(c).alias(c + "_pct") for c in
              ("value_yoy", "real_growth", "volume_growth", "focal_share_t2")],
            F.round("hhi", 4).alias("hhi"), "n_players",
        )
        .orderBy(F.desc("value_t2"), "space_label")
    )


def rank_opportunity_spaces(
    m: Market,
    level: str = "molecule_combination",
    top_n: int = 10,
    rank_by: str = "priority_score",
    min_value: float | None = None,
    strict: bool = False,
) -> DataFrame:
    """The best spaces of a level; ``strict``: ``NotFound`` instead of an empty ranking."""
    if level not in LEVELS:
        raise ValueError(f"level must be one of {', '.join(LEVELS)}")
    if rank_by not in RANK_BY:
        raise ValueError(f"rank_by must be one of {', '.join(RANK_BY)}")
    scored = m.scored if min_value is None else m.scored.where(F.col("value_t2") >= min_value)
    top = top_spaces(scored, level, rank_by, top_n)
    return require_rows(top, f"space of level {level} passes the filters") if strict else top


def find_spaces(scored: DataFrame, lookups: DataFrame) -> DataFrame:
    """Resolve (lookup, text) rows: exact id, else exact label, else the largest label that
    contains the text; all case-blind."""
    asked = lookups.select("lookup", F.lower(F.trim("text")).alias("needle"))
    names = scored.select(
        *SPACE_KEYS, "value_t2", F.lower("space_id").alias("id_low"),
        F.lower("space_label").alias("label_low"),
    )
    contained = substring_join(names, "label_low", asked, "needle")
    by_id = asked.join(names, F.col("needle") == F.col("id_low")).withColumn("how", F.lit(1))
    by_label = asked.join(names, F.col("needle") == F.col("label_low")).withColumn("how", F.lit(2))
    # Spaces that share a label differ in the answer's order only: one of them stands for all.
    first = names.groupBy("label_low").agg(
        F.min_by(
            F.struct(*SPACE_KEYS, "value_t2"), F.struct(-F.col("value_t2"), "space_id", "level")
        ).alias("f")
    )
    largest = contained.join(first, "label_low").groupBy("needle").agg(
        F.min_by("f", F.struct(-F.col("f.value_t2"), F.col("f.space_id"), F.col("f.level"))).alias("f")
    )
    by_part = asked.join(largest, "needle").select("lookup", "f.*").withColumn("how", F.lit(3))
    columns = ["lookup", "how", *SPACE_KEYS, "value_t2"]
    hits = by_id.select(columns).unionByName(by_label.select(columns)).unionByName(
        by_part.select(columns)
    )
    # A mergeable minimum: a common word may hit most of the spaces.
    best = hits.groupBy("lookup").agg(
        F.min(F.struct("how", (-F.col("value_t2")).alias("v"), "space_id", "level")).alias("b")
    )
    return best.select("lookup", "b.how", "b.level", "b.space_id")


def deep_dive(m: Market, companies: int = 8, brands: int = 6) -> DataFrame:
    """Evidence card of every scored space: metrics, short lists of structs and its signals."""
    rivals = top_competitors(m.company_facts, companies).groupBy(*SPACE_KEYS).agg(
        F.array_sort(
            F.collect_list(
                F.struct("position", "company_clean", "value_t2", "share_t2", "yoy", "rank_in_space")
            )
        ).alias("top_companies")
    )
    order = Window.partitionBy(*SPACE_KEYS).orderBy(
        F.desc("value_t2"), "brand", "brand_root", "company_clean"
    )

    def shown(frame: DataFrame, name: str) -> DataFrame:
        kept = frame.withColumn("position", F.row_number().over(order)).where(
            F.col("position") <= brands
        )
        item = F.struct("position", "brand", "company_clean", "value_t2", "value_t1")
        return kept.groupBy(*SPACE_KEYS).agg(F.array_sort(F.collect_list(item)).alias(name))

    top = shown(m.brand_facts, "top_brands")
    # Focal brands come from all brands of the space, not from the largest few.
    own = shown(m.brand_facts.where("is_focal AND value_t2 > 0"), "focal_brands")
    out = m.scored.join(rivals, SPACE_KEYS, "left").join(top, SPACE_KEYS, "left").join(own, SPACE_KEYS, "left")
    if m.signals is None:
        return out.withColumn("signals", F.lit(None).cast("array<struct<signal_id: string, match_reason: string, contribution: double>>"))
    # Why each signal speaks for or against the space, and by how much.
    listed = F.array_sort(F.collect_list(F.struct("signal_id", "match_reason", "contribution")))
    return out.join(space_signals(m).groupBy(*SPACE_KEYS).agg(listed.alias("signals")), SPACE_KEYS, "left")


def space_signals(m: Market) -> DataFrame:
    return m.links.select(*SPACE_KEYS, "signal_id", "match_reason", "contribution")


def trade_offs(spaces: DataFrame) -> DataFrame:
    """One row: the three tensions between the compared spaces, null where there is none."""
    card = F.struct(
        "level", "space_id", "space_label", "value_t2", "real_growth", "hhi",
        "market_opportunity_index", "priority_score", "right_to_win_score",
    )

    def best(column, largest=True):
        score = F.col(column)
        return F.min_by(card, F.struct(-score if largest else score, F.col("level"), F.col("space_id")))

    picks = spaces.agg(
        best("value_t2").alias("largest"),
        best("real_growth").alias("fastest"),
        best("hhi", largest=False).alias("open"),
        best("market_opportunity_index").alias("moi"),
        best("priority_score").alias("cps"),
    )

    def differ(a, b):
        return (F.col(a + ".space_id") != F.col(b + ".space_id")) | (
            F.col(a + ".level") != F.col(b + ".level")
        )

    def number(c, digits):
        return F.format_string(f"%.{digits}f", F.round(c, digits))

    return picks.select(
        F.when(
            differ("largest", "fastest"),
            F.concat(
                F.lit("largest: "), "largest.space_label", F.lit(" ("),
                number(F.col("largest.value_t2"), 0), F.lit(", "),
                number(F.col("largest.real_growth") * 100, 1), F.lit("%); fastest: "),
                "fastest.space_label", F.lit(" ("),
                number(F.col("fastest.real_growth") * 100, 1), F.lit("%)"),
            ),
        ).alias("size_growth"),
        F.when(
            differ("open", "fastest"),
            F.concat(
                F.lit("fastest: "), "fastest.space_label", F.lit(" (HHI "),
                number(F.col("fastest.hhi"), 0), F.lit("); least concentrated: "),
                "open.space_label", F.lit(" (HHI "), number(F.col("open.hhi"), 0), F.lit(")"),
            ),
        ).alias("growth_competition"),
        F.when(
            differ("moi", "cps"),
            F.concat(
                F.lit("best market: "), "moi.space_label", F.lit(" ("),
                number(F.col("moi.market_opportunity_index"), 1), F.lit(", fit "),
                number(F.col("moi.right_to_win_score"), 1), F.lit("); first choice: "),
                "cps.space_label", F.lit(" ("), number(F.col("cps.priority_score"), 1),
                F.lit(", fit "), number(F.col("cps.right_to_win_score"), 1), F.lit(")"),
            ),
        ).alias("moi_cps"),
    )


def compare_spaces(
    scored: DataFrame, texts: list[str], level: str | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(side-by-side rows, trade-offs, texts without a space) for ids, labels or label parts."""
    frame = scored.where(F.col("level") == level) if level else scored
    asked = scored.sparkSession.createDataFrame([(t, t) for t in texts], "lookup string, text string")
    found = find_spaces(frame, asked)
    chosen = frame.join(found.select(*SPACE_KEYS).distinct(), SPACE_KEYS)
    missing = asked.join(found, "lookup", "left_anti").select("lookup")
    return chosen, trade_offs(chosen), missing


class NotFound(LookupError):
    """A name or a filter that nothing in the market answers to."""


def require_company(m: Market, text: str) -> str:
    """The name of the company that ``text`` resolves to; ``NotFound`` if there is none."""
    rows = resolve_company(m, text).collect()  # at most one
    if not rows:
        raise NotFound(f"no company matches {text!r}")
    return rows[0]["company_clean"]


def require_focal(m: Market) -> None:
    """``NotFound`` unless the focal company sells something in this market."""
    if _focal(m).isEmpty():
        raise NotFound("the focal company has no pack in this market")


def require_rows(frame: DataFrame, what: str) -> DataFrame:
    """The frame itself; ``NotFound`` if it is empty."""
    if frame.isEmpty():
        raise NotFound(f"no {what}")
    return frame


def resolve_company(m: Market, text: str) -> DataFrame:
    """One row: the largest company (over all its spaces) whose name contains the text."""
    hits = m.company_facts.where(
        F.contains(F.upper("company_clean"), F.lit(text.strip().upper()))
    )
    return (
        hits.groupBy("company_clean")
        .agg(F.sum("value_t2").alias("v"))
        .orderBy(F.desc(F.round("v", 6)), "company_clean")
        .limit(1)
        .select("company_clean")
    )


def competitor_profile(m: Market, text: str) -> DataFrame:
    """One row of totals for the resolved company; ``NotFound`` if no name holds the text."""
    rows = m.company_facts.where(F.col("company_clean") == require_company(m, text))
    segment = F.col("level") == "segment"
    market = m.totals.select("market_value_t2").scalar()
    sums = rows.groupBy("company_clean").agg(
        F.sum(F.when(segment, F.col("value_t2"))).alias("v2"),
        F.sum(F.when(segment, F.col("value_t1"))).alias("v1"),
        F.count_if(F.col("rank_in_space") == 1).alias("leads_in_spaces"),
    )
    return sums.select(
        F.col("company_clean").alias("company"),
        F.round("v2", 1).alias("value"),
        F.round(F.col("v2") / market * 100.0, 2).alias("share_pct"),
        F.round(F.coalesce(F.try_divide("v2", "v1") - 1.0, F.lit(0.0)) * 100.0, 2).alias("growth_pct"),
        "leads_in_spaces",
    )


def competitor_strongholds(m: Market, text: str, limit: int = 8) -> DataFrame:
    own = F.col("company_clean") == require_company(m, text)
    rows = m.company_facts.where("level = 'sub_segment'").where(own)
    return (
        rows.orderBy(F.desc("value_t2"), "space_id").limit(limit)
        .select("space_label", "value_t2", "share_t2", "rank_in_space")
    )


def competitor_brands(m: Market, text: str, limit: int = 8) -> DataFrame:
    own = F.col("company_clean") == require_company(m, text)
    rows = m.brand_facts.where("level = 'segment'").where(own)
    return (
        rows.orderBy(F.desc("value_t2"), "space_id", "brand").limit(limit)
        .select("space_id", "brand", "value_t2", "value_t1")
    )


def _focal(m: Market) -> DataFrame:
    return m.named_cells.where("is_focal")


def _grown(frame: DataFrame) -> DataFrame:
    v2, v1 = F.col("value_t2").cast("double"), F.col("value_t1").cast("double")
    rate = F.when(v1 > 0, (v2 / v1 - 1.0) * 100.0).otherwise(0.0)
    return frame.withColumns({"value_t2": v2, "value_t1": v1, "growth_pct": F.round(rate, 2)})


def focal_brands(m: Market, limit: int | None = 15) -> DataFrame:
    """Brand roots by sub-segment with distinct brand names, largest first."""
    sums = _focal(m).groupBy("brand_root", "sub_segment").agg(
        F.sum("value_t2").alias("value_t2"),
        F.sum("value_t1").alias("value_t1"),
        F.count_distinct("brand").alias("brands"),
    )
    out = _grown(sums).orderBy(F.desc("value_t2"), "brand_root", "sub_segment")
    return out if limit is None else out.limit(limit)


def focal_franchises(m: Market, limit: int = 12) -> DataFrame:
    sums = _focal(m).groupBy("brand_root").agg(
        F.sum("value_t2").alias("value_t2"), F.sum("value_t1").alias("value_t1")
    )
    return (
        _grown(sums).orderBy(F.desc("value_t2"), "brand_root").limit(limit)
        .select("brand_root", "value_t2", "growth_pct")
    )


def focal_positions(m: Market, limit: int = 10) -> DataFrame:
    return (
        m.scored.where("level = 'sub_segment'")
        .orderBy(F.desc("focal_value_t2"), "space_id")
        .limit(limit)
        .select("space_label", "focal_value_t2", "focal_share_t2", "focal_yoy", "value_yoy",
                "real_growth", "strategic_verdict")
    )


def focal_portfolio(m: Market) -> DataFrame:
    """One row of portfolio totals."""
    own = _focal(m)
    sums = own.agg(
        F.coalesce(F.sum("value_t2").cast("double"), F.lit(0.0)).alias("value"),
        F.coalesce(F.sum("sku_count"), F.lit(0)).alias("sku_count"),
        F.count_distinct("brand").alias("brand_count"),
    )
    molecules = own.select(F.explode("molecules").alias("x")).agg(F.count_distinct("x")).scalar()
    total = m.totals
    return sums.select(
        F.round("value", 1).alias("value"),
        "sku_count", "brand_count",
        molecules.alias("molecule_count"),
        _pct(total.select("focal_share").scalar()).alias("share_pct"),
        _pct(total.select("focal_yoy").scalar()).alias("growth_pct"),
        _pct(total.select("market_yoy").scalar()).alias("market_growth_pct"),
    )


def focal_molecules(m: Market) -> DataFrame:
    return _focal(m).select(F.explode("molecules").alias("molecule")).distinct()


def competitive_standing(m: Market, focal_company: str, top: int = 10) -> DataFrame:
    """The largest companies over all segments, and the focal one at its true rank."""
    sums = m.company_facts.where("level = 'segment'").groupBy("company_clean").agg(
        F.round(F.sum("value_t2"), 6).alias("value_t2"),
        F.round(F.sum("value_t1"), 6).alias("value_t1"),
    )
    named = sums.withColumn("market", F.lit(1))
    ranked = rank_desc(named, ["market"], "value_t2", "market_rank")
    return ranked.where(
        (F.col("market_rank") <= top) | (F.upper("company_clean") == focal_company.upper())
    ).select(
        "company_clean", "value_t2", "value_t1", "market_rank",
        F.round(plain_growth("value_t2", "value_t1") * 100.0, 4).alias("growth_pct"),
    )


def growth_decomposition(m: Market) -> DataFrame:
    return m.enriched.where("level = 'segment'").select(
        "space_label",
        *[_pct(c, 4).alias(n) for c, n in
          (("value_yoy", "reported_pct"), ("real_growth", "real_pct"),
           ("volume_growth", "volume_pct"), ("price_effect", "price_pct"))],
    )


def focal_gap(m: Market, limit: int = 8) -> DataFrame:
    return (
        m.scored.where("level = 'sub_segment'")
        .orderBy(F.desc("focal_value_t2"), "space_id")
        .limit(limit)
        .select(
            "space_label", F.round("focal_value_t2", 4).alias("focal_value_t2"),
            _pct("focal_share_t2", 4).alias("focal_share_pct"),
            _pct(F.col("focal_yoy") - F.col("value_yoy"), 4).alias("growth_gap_pp"),
        )
    )


def forecast_top(
    m: Market, config: ForecastConfig = ForecastConfig(), limit: int = 10
) -> DataFrame:
    """Forecasts of the first spaces of every level by priority score."""
    best = m.scored.where(F.col("cps_rank") <= limit)
    return forecast_spaces(best, m.totals, config)


def forecast_horizon(m: Market, years: int) -> DataFrame:
    return forecast_spaces(m.scored, m.totals, replace(ForecastConfig(), horizon_years=years))


WHITESPACE_LEVELS = ["sub_segment", "molecule_combination", "anchor_molecule"]


def whitespace_scan(
    m: Market,
    levels: list[str] | None = None,
    limit: int = 8,
    config: WhitespaceConfig = WhitespaceConfig(),
) -> DataFrame:
    return find_whitespace(m.scored, m.totals, config, levels or WHITESPACE_LEVELS, limit)


def sensitivity_analysis(
    m: Market, level: str = "molecule_combination", config: SensitivityConfig = SensitivityConfig()
) -> DataFrame:
    """Position stability of one level's spaces, scored on their own, best first."""
    if level not in LEVELS:
        raise ValueError(f"level must be one of {', '.join(LEVELS)}")
    scored, _ = m.scorecard(levels=[level])
    scored = stage(scored, "level_scores")
    draws = weight_draws(config, m.score)
    stability = sensitivity(scored, scored, draws, config, m.score)
    return stability.orderBy(F.desc("top_k_frequency"), "mean_rank", "space_id")


def signal_index(signals: DataFrame, config: RetrievalConfig = RetrievalConfig()) -> TextIndex:
    """A passage index over the bodies of signal documents."""
    return TextIndex.build(
        chunk_documents(signals.select(F.col("id").alias("doc_id"), "title", "body"), config)
    )


def search_signals(
    index: TextIndex, signals: DataFrame, queries: DataFrame, config: RetrievalConfig = RetrievalConfig()
) -> DataFrame:
    """Citable passages per query: one per signal, best first."""
    hits = search(index, queries, config).withColumnRenamed("doc_id", "id")
    return hits.join(signals.select("id", "publisher", "url"), "id").select(
        "query_id", "rank", F.concat(F.lit("["), "id", F.lit("]")).alias("citation"),
        F.col("id").alias("signal_id"), "title", "publisher", "url",
        F.col("text").alias("excerpt"), F.round("score", 4).alias("score"),
    )


def register_views(m: Market) -> None:
    """Expose the market's tables to SQL."""
    m.named_cells.createOrReplaceTempView("cells")
    for name in ("space_facts", "company_facts", "brand_facts", "enriched", "scored"):
        getattr(m, name).createOrReplaceTempView(name)


#: What an ad hoc query may stand on: registered views, values, ranges and its own named queries.
OWN_LEAVES = {"View", "LocalRelation", "OneRowRelation", "Range", "CTERelationRef", "ResolvedInlineTable"}
#: Leaves of a query that is parsed only.
PARSED_LEAVES = {"UnresolvedRelation", "OneRowRelation", "LocalRelation", "UnresolvedInlineTable", "UnresolvedTableValuedFunction"}
#: Functions that call any static method of the virtual machine.
REFLECTING = {"reflect", "java_method", "try_reflect"}
BUILT_IN = "org.apache.spark.sql.catalyst."
USER_CODE = {"CallMethodViaReflection", "ScalaUDF", "PythonUDF", "PythonUDAF", "PythonUDTF", "ScalaUDAF", "ScalaAggregator"}


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _nodes(plan) -> list:
    """A plan's node and all below it, subqueries and named queries too; views are not opened."""
    if plan.getClass().getSimpleName() == "View":
        return [plan]
    return [plan, *(n for part in (plan.children(), plan.innerChildren()) for c in _items(part) for n in _nodes(c))]


def _expressions(node) -> list:
    """All expressions of one node, nested ones too."""
    found = _items(node.expressions())
    for e in found:
        found.extend(_items(e.children()))
    return found


def _check_parsed(spark: SparkSession, plan) -> None:
    """Refuses what must not even be analysed: values and arguments are computed there."""
    find = spark._jvm.java.lang.Class.forName
    refused = [find(BUILT_IN + "plans.logical." + name) for name in ("Command", "ParsedStatement")]
    for node in _nodes(plan):
        kind = node.getClass().getSimpleName()
        if any(c.isInstance(node) for c in refused):
            raise ValueError(f"only queries are permitted, not {node.nodeName()}")
        leaf = node.children().isEmpty() and node.innerChildren().isEmpty()
        if leaf and kind not in PARSED_LEAVES:
            raise ValueError(f"not permitted in a query: {kind}")
        if kind == "UnresolvedRelation" and node.multipartIdentifier().size() > 1:
            raise ValueError(f"only registered tables can be read, not {node.tableName()}")
        for e in _expressions(node):
            kind = e.getClass().getSimpleName()
            named = kind == "UnresolvedFunction" and e.nameParts().last().lower() in REFLECTING
            if named or "UnresolvedIdentifier" in kind:
                raise ValueError(f"not permitted in a query: {e.toString()}")


def _check_analysed(plan) -> None:
    for node in _nodes(plan):
        kind = node.getClass().getSimpleName()
        if node.children().isEmpty() and kind not in OWN_LEAVES:
            raise ValueError(f"only registered tables can be read, not {kind}")
        if kind == "View":
            continue
        for e in _expressions(node):
            kind = e.getClass().getSimpleName()
            if kind in USER_CODE or not e.getClass().getName().startswith(BUILT_IN):
                raise ValueError(f"not permitted in a query: {kind}")


def adhoc_sql(spark: SparkSession, query: str, limit: int | None = None) -> DataFrame:
    """One query over the registered tables, all its rows unless ``limit`` says otherwise.

    The text is parsed before anything runs; several statements, and any that is or holds a
    command (insert, create, drop, set ...), are refused, also behind WITH. So are functions that
    run other code than Spark's own expressions, and tables that are not registered views (files
    by path, catalogue tables), before and after names are resolved. Needs a classic session.
    """
    text = query.strip().removesuffix(";")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except Exception as error:
        raise ValueError(f"not one SQL query: {str(error).splitlines()[0]}") from error
    _check_parsed(spark, plan)
    rows = spark.sql(text)
    _check_analysed(rows._jdf.queryExecution().analyzed())
    return rows if limit is None else rows.limit(limit)


def adhoc_page(spark: SparkSession, query: str, limit: int) -> tuple[DataFrame, bool]:
    """(the first ``limit`` rows, whether the query has more)."""
    rows = adhoc_sql(spark, query)
    return rows.limit(limit), not rows.offset(limit).isEmpty()
