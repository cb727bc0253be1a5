import pytest
from pyspark.sql import functions as F

from spacelens.functions import text


def values(spark, fn, inputs):
    rows = [(i, v) for i, v in enumerate(inputs)]
    df = spark.createDataFrame(rows, "i int, v string").select("i", fn("v").alias("r"))
    return [r["r"] for r in df.orderBy("i").collect()]


def test_ingredients(spark):
    got = values(
        spark,
        text.split_ingredients,
        ["AMLODIPINE BESILATE + ATENOLOL", "METOPROLOL SUCCINATE", "OLMESARTAN MEDOXOMIL",
         "ROSUVASTATIN CALCIUM SALT", "ISOSORBIDE MONONITRATE", "ISOSORBIDE DINITRATE",
         "ATENOLOL + ATENOLOL", "", None, "CALCIUM", " + ", "B + A HCL + B SODIUM"],
    )
    assert got == [
        ["AMLODIPINE", "ATENOLOL"], ["METOPROLOL"], ["OLMESARTAN"], ["ROSUVASTATIN"],
        ["ISOSORBIDE MONONITRATE"], ["ISOSORBIDE DINITRATE"], ["ATENOLOL"], [], [], ["CALCIUM"],
        [], ["B", "A"],
    ]


def test_brand_roots(spark):
    got = values(
        spark,
        text.brand_root,
        ["AMLOPRES-AT", "ROSULIP GOLD", "CRESAR AMH", "AMLIP AT", "TELMA-H", "ECOSPRIN-AV",
         "ACE REVELOL", "5-MONO", "", None],
    )
    assert got == ["AMLOPRES", "ROSULIP", "CRESAR", "AMLIP", "TELMA", "ECOSPRIN", "ACE REVELOL",
                   "5-MONO", "", ""]


def test_archetypes(spark):
    df = spark.createDataFrame(
        [("Plain", 3), ("Combination", 1), ("Combination", 2), ("Combination", 3), (None, 4)],
        "label string, n int",
    )
    got = [r[0] for r in df.select(text.archetype("label", "n")).collect()]
    assert got == ["Monotherapy", "Monotherapy", "Dual FDC", "Triple / Poly FDC",
                   "Triple / Poly FDC"]


def test_slug_and_placeholder(spark):
    assert values(spark, text.slug, [" a/b--C ", "ARBs | x"]) == ["A_B_C", "ARBS_X"]
    got = values(spark, text.is_placeholder, ["", "-", " na ", "n/a", "None", "nan", None, "ARBs"])
    assert got == [True] * 7 + [False]


def test_tokens_keep_repeats_without_stop_words(spark):
    assert values(spark, text.tokens, ["The market the Market, is growing 2x"]) == [
        ["market", "market", "growing", "2x"]
    ]


@pytest.mark.parametrize(
    "raw, grams",
    [
        ("Statin", ["sta", "tat", "ati", "tin"]),
        (" a \n b ", ["a b"]),
        ("ab", ["ab"]),
        ("", []),
        ("a😀b c", ["a😀b", "😀b ", "b c"]),
    ],
)
def test_trigrams(spark, raw, grams):
    assert values(spark, text.trigrams, [raw]) == [grams]


def test_word_count(spark):
    assert values(spark, text.word_count, [" a  b\tc ", ""]) == [3, 0]


def test_trigrams_of_a_long_text_stay_linear(spark):
    df = spark.range(1).select(F.repeat(F.lit("abcdefghij "), 20_000).alias("v"))
    assert df.select(F.size(text.trigrams("v"))).first()[0] == 11 * 20_000 - 1 - 2
