"""Derived fields of a bound fact row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spacelens.functions import text
from spacelens.sources.facts import recent_sales, strip


def derive_article(rows: DataFrame) -> DataFrame:
    """Add ingredients, their number and the archetype: what the article's own text tells."""
    counted = rows.withColumn("molecules", text.split_ingredients("ingredient_desc")).withColumn(
        "molecule_count", F.size("molecules")
    )
    return counted.withColumn("treatment_archetype", text.archetype("plain_combination", "molecule_count"))


def derive_seller(rows: DataFrame, focal_company: str) -> DataFrame:
    """Add clean company and flags."""
    return rows.withColumns(
        {
            "company_clean": strip(F.regexp_replace("company", r"\*", "")),
            "is_focal": F.coalesce(strip(F.col("company")) == focal_company, F.lit(False)),
            "is_oral_solid": F.coalesce(F.upper("dosage_form") == "SOLIDS", F.lit(False)),
            "is_mnc": F.coalesce(F.upper("ownership") == "MNC", F.lit(False)),
        }
    )


def derive_text(rows: DataFrame, focal_company: str) -> DataFrame:
    """All derivations from text, the brand root included."""
    sold = derive_seller(derive_article(rows), focal_company)
    return sold.withColumn("brand_root", text.brand_root("brand"))


def derive(facts: DataFrame, focal_company: str) -> DataFrame:
    """The pack table: text derivations plus signatures, price, recent sales and slugs."""
    return derive_text(facts, focal_company).withColumns(
        {
            "molecule_canonical": F.array_join("molecules", " + "),
            "molecule_signature": F.array_join(F.array_sort("molecules"), " + "),
            "brand_key": F.concat(F.upper("company_clean"), F.lit(" | "), F.col("brand_root")),
            "realised_price_per_unit": F.coalesce(
                F.try_divide(F.col("value_t2").cast("double"), F.col("qty_t2").cast("double")),
                F.lit(0.0),
            ),
            "recent_3m_sales": recent_sales(),
            "segment_slug": text.slug("segment"),
            "sub_segment_slug": text.slug("sub_segment"),
            "subgroup_slug": text.slug("subgroup"),
        }
    )
