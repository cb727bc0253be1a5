"""Text derivations: ingredients, brand roots, slugs, tokens, trigrams, numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Salt words, brand modifiers, placeholder labels, stop words.
SALT_WORDS = (
    "BESILATE", "BESYLATE", "SUCCINATE", "TARTRATE", "MALEATE", "FUMARATE", "HYDROCHLORIDE",
    "MESYLATE", "MEDOXOMIL", "CILEXETIL", "ARGININE", "HEMIHYDRATE", "DIHYDRATE",
    "MONOHYDRATE", "MAGNESIUM", "POTASSIUM", "CALCIUM", "SODIUM", "HCL", "SALT",
)
BRAND_MODIFIERS = (
    "GOLD", "TRIO", "PLUS", "FORTE", "XL", "SR", "CR", "OD", "CV", "ASP", "AM", "AT", "H", "CT",
    "D", "M", "F", "EZ", "LN", "BS", "3D", "TL", "L", "B", "A", "T", "S", "MF", "AH", "HT", "DS",
)
PLACEHOLDERS = ("", "-", "NA", "N/A", "NONE", "NAN")
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "been", "but", "by", "for", "from", "has", "have",
    "in", "into", "is", "it", "its", "of", "on", "or", "that", "the", "their", "there", "these",
    "this", "to", "was", "were", "which", "will", "with", "why", "matters",
)
# End of fixed values.


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def squash(c) -> Column:
    """Trim and turn every run of white space into one blank."""
    return F.trim(F.regexp_replace(_c(c), r"\s+", " "))


def canonical_ingredient(c) -> Column:
    """Upper-case name without trailing salt words; the first word always stays."""
    # The lazy head keeps at least one word, so "CALCIUM" alone survives.
    tail = r"^(\S+(?: \S+)*?)(?: (?:" + "|".join(SALT_WORDS) + r"))+$"
    return F.regexp_replace(F.upper(squash(c)), tail, "$1")


def split_ingredients(description) -> Column:
    """Distinct canonical ingredients in the order written; [] for null or blank."""
    parts = F.transform(F.split(_c(description), r"\+"), canonical_ingredient)
    return F.coalesce(
        F.array_distinct(F.filter(parts, lambda p: p != "")), F.array().cast("array<string>")
    )


def archetype(label, ingredient_count) -> Column:
    plain = F.lower(F.trim(F.coalesce(_c(label), F.lit("")))).startswith("plain")
    return (
        F.when(plain | (_c(ingredient_count) <= 1), "Monotherapy")
        .when(_c(ingredient_count) == 2, "Dual FDC")
        .otherwise("Triple / Poly FDC")
    )


def brand_root(brand) -> Column:
    """Umbrella brand behind a line extension, e.g. AMLOPRES-AT and CRESAR AMH."""
    text = F.upper(F.trim(F.coalesce(_c(brand), F.lit(""))))
    head = F.trim(F.substring_index(text, "-", 1))
    tokens = F.split(squash(text), " ")
    first = tokens.getItem(0)
    extension = F.forall(
        F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0))),
        lambda t: t.isin(*BRAND_MODIFIERS) | (F.length(t) <= 3),
    )
    return (
        F.when(text.contains("-") & (F.length(head) >= 3), head)
        .when((F.size(tokens) > 1) & (F.length(first) >= 3) & extension, first)
        .otherwise(text)
    )


def slug(c) -> Column:
    """Upper case, every other character run becomes one underscore, none at the ends."""
    runs = F.regexp_replace(F.upper(F.trim(_c(c))), "[^A-Z0-9]+", "_")
    return F.regexp_replace(runs, "^_+|_+$", "")


def is_placeholder(c) -> Column:
    return F.coalesce(F.upper(F.trim(_c(c))), F.lit("")).isin(*PLACEHOLDERS)


def tokens(c) -> Column:
    """Lower-case word tokens without stop words; repeats are kept."""
    words = F.regexp_extract_all(F.lower(_c(c)), F.lit("[a-z0-9]+"), F.lit(0))
    return F.filter(words, lambda t: ~t.isin(*STOP_WORDS))


def trigrams(c) -> Column:
    """Character trigrams of the squashed lower-case text; shorter texts give themselves."""
    clean = squash(F.lower(_c(c)))
    # Looks three characters ahead and moves on by one, so one linear pass finds all of them.
    found = F.regexp_extract_all(clean, F.lit("(?s)(?=(.{3}))."), F.lit(1))
    return F.when(F.length(clean) >= 3, found).otherwise(
        F.filter(F.array(clean), lambda g: g != "")
    )


def word_count(c) -> Column:
    """Number of white-space separated words."""
    return F.when(squash(c) == "", 0).otherwise(F.size(F.split(squash(c), " ")))
