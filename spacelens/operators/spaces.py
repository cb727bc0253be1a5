"""Opportunity spaces: code packs by dictionaries, map articles to spaces, aggregate.

An article is one distinct combination of the text columns that place a pack in spaces; brand,
company, dosage form and ownership are no part of it. Articles, brands and spaces are dictionary
tables with short keys: ingredient splitting, slugs and the roughly seven-fold fan-out run once
per article, not per pack. Packs are summed to cells (article, brand, seller), cells to
(article, company), and those sums meet the (article, space) pairs by key. Space texts come back
last, once per space.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spacelens.config import EPS, LEVEL_DESCRIPTIONS
from spacelens.functions.text import brand_root, is_placeholder, slug
from spacelens.operators.derive import derive_article, derive_seller
from spacelens.operators.ranking import rank_desc
from spacelens.sources.facts import TEXT_ROLES, recent_sales

MEASURES = (
    "value_t0", "value_t1", "value_t2", "cp_t0", "cp_t1", "cp_t2", "qty_t0", "qty_t1", "qty_t2",
    "recent_3m_sales",
)
FOCAL_MEASURES = ("value_t0", "value_t1", "value_t2", "qty_t2")
#: The text columns that decide a pack's spaces.
ARTICLE_ROLES = (
    "ingredient_desc", "plain_combination", "segment", "sub_segment", "molecule_class", "subgroup",
)
SPACE = ("level", "space_id", "space_label")
SPACE_KEYS = ("level", "space_id")


def pack_sums(facts: DataFrame) -> DataFrame:
    """Packs summed per distinct combination of all text columns, with a pack count."""
    keyed = facts.withColumns(
        {"is_active": F.col("value_t2") > EPS, "recent_3m_sales": recent_sales()}
    )
    return keyed.groupBy(*TEXT_ROLES, "is_active").agg(
        *[F.sum(m).alias(m) for m in MEASURES], F.count(F.lit(1)).alias("sku_count")
    )


def articles(sums: DataFrame) -> DataFrame:
    """The article dictionary: key, texts, derived fields and the article's spaces."""
    texts = sums.select(*ARTICLE_ROLES).distinct()
    return derive_article(texts).withColumns(
        {"spaces": space_array(), "article": F.monotonically_increasing_id()}
    )


def brands(sums: DataFrame) -> DataFrame:
    """The brand dictionary: brand and root."""
    return sums.select("brand").distinct().withColumn("brand_root", brand_root("brand"))


def _coded(rows: DataFrame, dictionary: DataFrame, texts: Sequence[str], code: str) -> DataFrame:
    """``rows`` with the dictionary's ``code``; null texts meet null texts."""
    short = dictionary.select(*[F.col(c).alias(f"_{c}") for c in texts], code)
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in texts])
    return rows.join(short, same).drop(*[f"_{c}" for c in texts])


def cells(sums: DataFrame, article_table: DataFrame, brand_table: DataFrame, focal_company: str) -> DataFrame:
    """Pack sums with keys for texts; the dictionaries are written tables of the same sums."""
    coded = _coded(sums, article_table, ARTICLE_ROLES, "article").drop(*ARTICLE_ROLES)
    sold = derive_seller(_coded(coded, brand_table, ["brand"], "brand_root"), focal_company)
    return sold.drop("company", "ownership", "dosage_form")


def space_names(article_table: DataFrame) -> DataFrame:
    """The space dictionary: key, level, id and label.

    Spellings that share an id are one space; the alphabetically first becomes its label.
    """
    named = article_table.select(F.inline("spaces")).groupBy(*SPACE_KEYS).agg(F.min("space_label").alias("space_label"))
    return named.withColumn("space", F.monotonically_increasing_id())


def article_spaces(article_table: DataFrame, names: DataFrame) -> DataFrame:
    """(article, space) keys: the fan-out, once per article."""
    pairs = article_table.select("article", F.inline("spaces")).drop("space_label")
    return pairs.join(names.select(*SPACE_KEYS, "space"), list(SPACE_KEYS)).select("article", "space")


def article_companies(cell_table: DataFrame) -> DataFrame:
    """(article, company) sums of every measure, of the focal company's and of solids."""
    focal = [
        F.sum(F.when(F.col("is_focal"), F.col(m)).otherwise(0)).alias("focal_" + m)
        for m in FOCAL_MEASURES
    ]
    return cell_table.groupBy("article", "company_clean").agg(
        *[F.sum(m).alias(m) for m in MEASURES],
        *focal,
        F.sum(F.when(F.col("is_oral_solid"), F.col("value_t2")).otherwise(0)).alias("solid_value_t2"),
        F.sum("sku_count").alias("sku_count"),
        F.max("is_mnc").alias("is_mnc"),
    )


def article_values(companies: DataFrame, article_table: DataFrame) -> DataFrame:
    """Every article with its latest value: of all, of the focal company and of solids."""
    kinds = ("value_t2", "focal_value_t2", "solid_value_t2")
    sums = companies.groupBy("article").agg(*[F.sum(m).alias(m) for m in kinds])
    texts = article_table.select("article", "segment", "sub_segment", "subgroup", "molecules")
    return texts.join(sums, "article")


def _space(level: str, prefix: str, key: Column, label: Column) -> Column:
    return F.struct(
        F.lit(level).alias("level"),
        F.concat(F.lit(prefix + "_"), slug(key)).alias("space_id"),
        label.alias("space_label"),
    )


def space_array() -> Column:
    """Every space a row belongs to, as one array of (level, space_id, space_label)."""
    def named(column: str) -> Column:  # an unclassified row still belongs to a space
        return F.coalesce(F.col(column), F.lit("nan"))

    segment, sub, group = named("segment"), named("sub_segment"), named("molecule_class")
    bar = F.lit(" | ")
    archetype = F.col("treatment_archetype")
    masked = ~is_placeholder("sub_segment")
    segment_sub = F.concat(segment, bar, sub)
    combination = F.concat(sub, bar, named("subgroup"))
    hierarchy = F.array(
        _space("segment", "SEG", segment, segment),
        F.when(masked, _space("sub_segment", "SUB", segment_sub, segment_sub)),
        _space("molecule_class", "CLS", group, group),
        # The sub-segment is part of the id, so one id always has one label.
        F.when(masked, _space("molecule_combination", "MOL", combination, combination)),
        _space(
            "treatment_archetype",
            "ARC",
            F.concat(segment, bar, archetype),
            F.concat(segment, bar, archetype),
        ),
    )
    anchors = F.transform(
        "molecules",
        lambda m: _space("anchor_molecule", "ANC", m, F.concat(m, F.lit(" (all forms)"))),
    )
    return F.array_compact(F.concat(hierarchy, _one_per_id(anchors)))


def _one_per_id(spaces: Column) -> Column:
    """Names that differ only in punctuation share an id; a pack enters that space once."""

    def first(bound: Column) -> Column:
        ids = F.transform(bound, lambda s: s["space_id"])
        kept = F.filter(bound, lambda s, i: F.array_position(ids, s["space_id"]) == i + 1)
        return F.when(F.size(F.array_distinct(ids)) == F.size(bound), bound).otherwise(kept)

    return F.transform(F.array(spaces), first).getItem(0)


def membership(sku_facts: DataFrame) -> DataFrame:
    """(pack, space) pairs with the pack's own segment and sub-segment."""
    return sku_facts.select(
        "row_id", "segment", "sub_segment", F.inline(space_array())
    ).select("row_id", *SPACE, "segment", "sub_segment")


def company_cells(sums: DataFrame, pairs: DataFrame, names: DataFrame) -> DataFrame:
    """(space, company) sums of every measure: the one table the space level derives from.

    ``sums``, ``pairs`` and ``names`` are article_companies, article_spaces and space_names.
    """
    measures = [*MEASURES, *["focal_" + m for m in FOCAL_MEASURES], "sku_count"]
    keyed = sums.join(pairs, "article").groupBy("space", "company_clean").agg(
        *[F.sum(m).alias(m) for m in measures], F.max("is_mnc").alias("is_mnc")
    )
    return keyed.join(names, "space").drop("space")


def level_description() -> Column:
    out = F.lit(None).cast("string")
    for level, description in LEVEL_DESCRIPTIONS.items():
        out = F.when(F.col("level") == level, description).otherwise(out)
    return out


def space_context(values: DataFrame, pairs: DataFrame, names: DataFrame) -> DataFrame:
    """The (segment, sub_segment) that carries most latest value in each space."""
    sums = values.join(pairs, "article").groupBy("space", "segment", "sub_segment").agg(
        F.sum("value_t2").alias("v")
    )
    pair = F.struct("segment", "sub_segment")
    best = sums.groupBy("space").agg(
        F.min_by(pair, F.struct(-F.col("v"), F.col("segment"), F.col("sub_segment"))).alias("c")
    )
    return best.join(names, "space").select(*SPACE_KEYS, "c.segment", "c.sub_segment")


def space_totals(companies: DataFrame) -> DataFrame:
    """Measures per space as doubles, from the (space, company) sums."""
    measures = [*MEASURES, *["focal_" + m for m in FOCAL_MEASURES]]
    return companies.groupBy(*SPACE_KEYS).agg(
        F.min("space_label").alias("space_label"),
        *[F.sum(m).cast("double").alias(m) for m in measures],
        F.sum("sku_count").cast("long").alias("sku_count"),
    )


def space_facts(companies: DataFrame, context: DataFrame) -> DataFrame:
    totals = space_totals(companies)
    return totals.join(context, ["level", "space_id"], "left").withColumn(
        "level_description", level_description()
    )


def company_facts(companies: DataFrame, spaces: DataFrame) -> DataFrame:
    """Company values, share and min-tie rank in each space; both inputs are written tables.

    The totals come from the space table, whose known size lets the planner broadcast it.
    """
    values = companies.select(*SPACE_KEYS, "company_clean", "is_mnc", "value_t1", "value_t2")
    totals = spaces.select(
        *SPACE,
        F.col("value_t1").alias("space_value_t1"), F.col("value_t2").alias("space_value_t2"),
    )
    shared = values.join(totals, ["level", "space_id"]).withColumn(
        "share_t2",
        F.when(F.col("space_value_t2") != 0, F.col("value_t2").cast("double") / F.col("space_value_t2"))
        .otherwise(0.0),
    )
    ranked = rank_desc(shared, ["level", "space_id"], "value_t2", "rank_in_space")
    return _as_doubles(ranked)


def brand_facts(cell_table: DataFrame, pairs: DataFrame, names: DataFrame) -> DataFrame:
    """Brand values and min-tie rank in each space; the inputs are written tables."""
    sums = cell_table.join(pairs, "article").groupBy("space", "brand", "brand_root", "company_clean").agg(
        F.sum("value_t1").alias("value_t1"),
        F.sum("value_t2").alias("value_t2"),
        F.max("is_focal").alias("is_focal"),
    )
    ranked = rank_desc(sums, ["space"], "value_t2", "rank_in_space")
    return _as_doubles(ranked.join(names, "space").drop("space"))


def _as_doubles(ranked: DataFrame) -> DataFrame:
    return ranked.withColumns(
        {"value_t1": F.col("value_t1").cast("double"), "value_t2": F.col("value_t2").cast("double")}
    )
