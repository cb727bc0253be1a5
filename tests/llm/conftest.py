from __future__ import annotations

import random

import pytest

WORDS = {
    "en": "the of and river stone market winter harbour letter garden paper bright morning".split(),
    "de": "der und nicht schön über straße haus zeit größe wasser grün mädchen könig".split(),
}

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long,"
    # Names that operators use inside or add to results.
    " size string, key int, node string, block int, quality string, readings int, turn int"
)


def sentence(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "", "", ","]) for _ in range(n))


def rows_of(count=60, seed=1):
    """Documents with null fields, empty and very long texts, repeated rows and odd characters."""
    rng = random.Random(seed)
    rows = []
    for i in range(count):
        lang = "en" if i % 3 else "de"
        text = "\n".join(sentence(rng, lang, rng.randint(8, 40)) for _ in range(rng.randint(1, 4)))
        rows.append((i, text, lang, f"s{i % 4}"))
    rows += [
        (100, None, "en", "s0"),
        (101, "", "en", "s0"),
        (102, " \t\n ", "de", None),
        (103, "12 34 ... !!", None, "s1"),
        (104, sentence(rng, "en", 30_000), "en", "s1"),
        (105, "x" * 200_000, None, None),
        (None, sentence(rng, "de", 50), "de", "s2"),
        (None, None, None, None),
        (106, "日本語のテキスト 🎉 \x00", None, "s2"),
        (106, "日本語のテキスト 🎉 \x00", None, "s2"),
        rows[0],
        rows[0],
        (107, rows[1][1], "en", "s3"),
    ]
    return [(a, b, c, d, None if b is None else len(b), "a", 1, "b", 2, "c", 3, 4) for a, b, c, d in rows]


@pytest.fixture(scope="session")
def messy_rows():
    return rows_of()


@pytest.fixture(scope="session")
def messy(spark, messy_rows):
    return spark.createDataFrame(messy_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
