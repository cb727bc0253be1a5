"""Right to win: how far the focal company's estate reaches into each space.

Estate membership is resolved per article (and per distinct ingredient list) with equi-joins
before the fan-out to spaces, so the space level needs one grouped aggregate of articles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spacelens.config import EPS
from spacelens.functions.ratios import clip, safe_ratio
from spacelens.functions.text import is_placeholder
from spacelens.sources.stage import stage

SPACE_KEYS = ["level", "space_id"]
BRANDS_SHOWN = 4


def focal_estate(cells: DataFrame) -> DataFrame:
    """(kind, value, brand_root) of everything the focal company actively sells.

    Kinds: molecule, subgroup, sub_segment, segment and brand; only molecule rows that come
    from a branded pack carry a brand_root.
    """
    own = cells.where("is_focal AND is_active")
    none = F.lit(None).cast("string")

    def item(kind, value, root=none):
        return F.struct(
            F.lit(kind).alias("kind"), value.alias("value"), root.alias("brand_root")
        )

    root = F.when(F.col("brand_root") != "", F.col("brand_root"))
    fixed = F.array(
        item("subgroup", F.col("subgroup")),
        item("sub_segment", F.col("sub_segment")),
        item("segment", F.col("segment")),
        item("brand", root),
    )
    molecules = F.transform("molecules", lambda m: item("molecule", m, root))
    return (
        own.select(F.explode(F.concat(fixed, molecules)).alias("i"))
        .select("i.*")
        .where("value IS NOT NULL")
        .distinct()
    )


def _members(estate: DataFrame, kind: str) -> DataFrame:
    return estate.where(F.col("kind") == kind).select("value").distinct()


def _flag(df: DataFrame, estate: DataFrame, kind: str, column: str) -> DataFrame:
    hit = _members(estate, kind).select(F.col("value").alias(column), F.lit(1).alias(f"_has_{kind}"))
    return df.join(hit, column, "left")


def sub_segment_shares(articles: DataFrame) -> DataFrame:
    """Focal share of each (segment, sub-segment); placeholders are no sub-segment."""
    sums = articles.where(~is_placeholder("sub_segment")).groupBy("segment", "sub_segment").agg(
        F.sum("value_t2").cast("double").alias("t"), F.sum("focal_value_t2").cast("double").alias("f")
    )
    return sums.where(F.col("t") > EPS).select(
        "segment", "sub_segment", (F.col("f") / F.col("t")).alias("_detail")
    )


def _ingredient_hits(articles: DataFrame, estate: DataFrame) -> DataFrame:
    """Per distinct ingredient list: how many ingredients are in the estate, and under a brand."""
    lists = articles.select("molecules").where(F.size("molecules") > 0).distinct()
    owned = estate.where("kind = 'molecule'").groupBy("value").agg(
        F.max(F.col("brand_root").isNotNull().cast("int")).alias("branded")
    )
    each = lists.select("molecules", F.explode("molecules").alias("value"))
    return each.join(owned, "value").groupBy("molecules").agg(
        F.count(F.lit(1)).alias("_hits"), F.max("branded").alias("_branded")
    )


def solids_share(cells: DataFrame) -> DataFrame:
    """One row: share of solids in the focal company's active value, 1 if it has none."""
    own = cells.where("is_focal AND is_active").agg(
        F.sum("value_t2").cast("double").alias("t"),
        F.sum(F.when(F.col("is_oral_solid"), F.col("value_t2")).otherwise(0))
        .cast("double").alias("s"),
    )
    return own.select(
        F.coalesce(F.when(F.col("t") > EPS, F.col("s") / F.col("t")), F.lit(1.0)).alias("solids")
    )


def space_molecules(articles: DataFrame, pairs: DataFrame, names: DataFrame) -> DataFrame:
    """Distinct (space, molecule) pairs with the value each molecule carries.

    ``articles`` are article_values, ``pairs`` and ``names`` the spaces of each article.
    """
    lists = articles.select("article", "molecules", "value_t2").join(pairs, "article")
    sums = lists.groupBy("space", "molecules").agg(F.sum("value_t2").cast("double").alias("v"))
    each = sums.select("space", F.explode("molecules").alias("molecule"), (F.col("v") / F.size("molecules")).alias("v"))
    values = each.groupBy("space", "molecule").agg(F.sum("v").alias("value"))
    return values.join(names, "space").select(*SPACE_KEYS, "molecule", "value")


def space_composition(molecules: DataFrame, space_facts: DataFrame) -> DataFrame:
    """Molecule weights per space: each pack's value split evenly over its ingredients."""
    totals = space_facts.where(F.col("value_t2") > EPS).select(
        *SPACE_KEYS, F.col("value_t2").alias("t")
    )
    return molecules.join(totals, SPACE_KEYS).select(
        *SPACE_KEYS, "molecule", (F.col("value") / F.col("t")).alias("weight")
    )


def _adjacent_brands(molecules: DataFrame, estate: DataFrame) -> DataFrame:
    """First brands (alphabetical) whose molecules occur in the space.

    Four per molecule are enough for the first four of a space, so the join never fans out
    further than that.
    """
    first = Window.partitionBy("molecule").orderBy("brand_root")
    brands = (
        estate.where("kind = 'molecule' AND brand_root IS NOT NULL")
        .select(F.col("value").alias("molecule"), "brand_root")
        .withColumn("_n", F.row_number().over(first))
        .where(F.col("_n") <= BRANDS_SHOWN)
        .drop("_n")
    )
    pairs = molecules.join(brands, "molecule").select(*SPACE_KEYS, "brand_root").distinct()
    order = Window.partitionBy(*SPACE_KEYS).orderBy("brand_root")
    shown = pairs.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= BRANDS_SHOWN)
    return shown.groupBy(*SPACE_KEYS).agg(
        F.array_join(F.array_sort(F.collect_list("brand_root")), ", ").alias("adjacent_focal_brands")
    )


def write_reach(cells: DataFrame, articles: DataFrame) -> dict[str, DataFrame]:
    """The lookup tables the articles are marked with; ``cells`` carry their texts.

    They are written first: the planner then knows that they are small (or not) and need not
    shuffle the articles to meet them.
    """
    estate = stage(focal_estate(cells), "focal_estate")
    return {
        "estate": estate,
        "hits": stage(_ingredient_hits(articles, estate), "ingredient_hits"),
        "shares": stage(sub_segment_shares(articles), "sub_segment_shares"),
        "solids": stage(solids_share(cells), "solids_share"),
    }


def add_right_to_win_metrics(
    spaces: DataFrame,
    articles: DataFrame,
    pairs: DataFrame,
    names: DataFrame,
    molecules: DataFrame,
    reach: dict[str, DataFrame],
) -> DataFrame:
    """``articles``, ``pairs`` and ``names`` are article_values, article_spaces and space_names;
    ``molecules`` and ``reach`` are :func:`space_molecules` and :func:`write_reach` of the same."""
    estate = reach["estate"]
    marked = articles.join(reach["hits"], "molecules", "left")
    for kind in ("subgroup", "sub_segment", "segment"):
        marked = _flag(marked, estate, kind, kind)
    marked = marked.join(reach["shares"], ["segment", "sub_segment"], "left")

    value = F.col("value_t2").cast("double")
    per_space = marked.join(pairs, "article").groupBy("space").agg(
        F.sum(value).alias("_t"),
        F.sum(value * F.coalesce("_hits", F.lit(0)) / F.greatest(F.size("molecules"), F.lit(1)))
        .alias("_adjacent"),
        F.sum(F.col("solid_value_t2").cast("double")).alias("_solid"),
        *[F.max(f"_has_{k}").alias(f"_has_{k}") for k in ("subgroup", "sub_segment", "segment")],
        F.max("_branded").alias("_branded"),
        F.max("_detail").alias("_detail"),
    ).join(names, "space")
    live = F.col("_t") > EPS
    ladder = (
        F.when(~live, 0.0)
        .when(F.col("_branded") == 1, 1.0)
        .when(F.col("_has_subgroup") == 1, 0.75)
        .when(F.col("_has_sub_segment") == 1, 0.60)
        .when(F.col("_has_segment") == 1, 0.30)
        .otherwise(0.0)
    )
    own_solids = reach["solids"].scalar()
    profile = per_space.select(
        *SPACE_KEYS,
        F.when(live, F.col("_solid") / F.col("_t")).otherwise(1.0).alias("space_solids_share"),
        safe_ratio("_adjacent", "_t").alias("rtw_molecule_adjacency"),
        ladder.alias("rtw_brand_franchise"),
        F.when(live, F.coalesce("_detail", F.lit(0.0))).otherwise(0.0).alias("rtw_detailing_adjacency"),
    )
    out = spaces.join(profile, SPACE_KEYS, "left").join(
        _adjacent_brands(molecules, estate), SPACE_KEYS, "left"
    )
    s = F.col("space_solids_share")
    return out.withColumns(
        {
            "adjacent_focal_brands": F.when(
                F.col("value_t2") > EPS, F.coalesce("adjacent_focal_brands", F.lit(""))
            ).otherwise(""),
            "rtw_formulation_fit": s * own_solids + (1.0 - s) * (1.0 - own_solids),
            "rtw_current_share": F.col("focal_share_t2"),
            "rtw_share_momentum": clip(F.col("focal_growth_gap"), -0.5, 0.5),
        }
    )
