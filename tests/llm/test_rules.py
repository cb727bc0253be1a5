from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import functions as F

from spacelens.llm import adaptive_rules as ar

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen = Counter(windows)
    covered = {j for i, w in enumerate(windows) if seen[w] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (
        len(words),
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)),
        len(covered),
    )


def judged(df, config=ar.RuleConfig()):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return ar.judged(df, config).select("row.doc_id", "row.text", *[f"quality.{n}" for n in names]).collect()


def test_counts_match_brute_force(messy, messy_rows):
    out = judged(messy)
    assert len(out) == len(messy_rows)
    for r in out:
        n = counts(r["text"])
        assert tuple(r)[2:7] == n
        assert r["base_failed"] == (n[0] < 20 or 100 * n[4] > 30 * n[0])
        assert not (r["kept"] and r["base_failed"])


def test_repeats_overlap_and_touch(spark):
    a = " ".join(f"w{i}" for i in range(8))
    texts = [f"{a} {a}", f"{a} x {a}", "n " * 30, f"{a} y {a} z {a[3:]}", "one\n\none\ntwo\n one", ""]
    df = spark.createDataFrame([(i, t, "l", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    for r in judged(df):
        assert tuple(r)[2:7] == counts(r["text"])


def test_thresholds_follow_the_group(spark):
    """Symbols are usual in one source and odd in the other."""
    words = [f"w{i}" for i in range(30)]
    plain, marked = " ".join(words), " ".join(w + "##" for w in words)
    rows = [(i, plain, "en", "prose") for i in range(40)] + [(100 + i, marked, "en", "code") for i in range(40)]
    rows += [(200, marked, "en", "prose"), (201, marked, "en", "code")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r["doc_id"] for r in judged(df, ar.RuleConfig(min_docs=20)) if r["kept"]}
    assert 200 not in kept and 201 in kept and len(kept) == 81


def test_small_groups_use_larger_sketches(spark):
    words = " ".join(f"w{i}" for i in range(30))
    rows = [(i, words, "en", f"s{i}") for i in range(30)] + [(99, words.replace("w", "*$%"), "en", "rare")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r["doc_id"] for r in judged(df, ar.RuleConfig(min_docs=10)) if r["kept"]}
    assert kept == set(range(30))


def test_sketch_quantiles_are_within_their_error(spark):
    values = [1.5**i for i in range(1, 40)]
    df = spark.createDataFrame([(v, 50) for v in values], "x double, n_words long").select(
        F.struct(F.col("x").alias("length")).alias("measures"), "n_words"
    )
    q = ar.quantiles(ar.sketches(df, F.lit("en"), F.lit("s"), 20)).where("level = 2").first()
    assert abs(q["q50"] / values[19] - 1) <= ar.ALPHA + 1e-9
    assert abs(q["q25"] / values[9] - 1) <= ar.ALPHA + 1e-9


def test_keeps_columns_and_stands_empty_tables(messy, no_docs):
    assert ar.keep_good(messy).columns == messy.columns
    assert ar.keep_good(no_docs).count() == 0


def test_characters_are_counted_by_stretches(spark, messy):
    """No measure looks up every character of a text; the counts are those of ASCII classes."""
    plan = ar.judged(messy)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace(" in plan and "translate(" not in plan
    texts = ["", "AbZz[]`@{ É Äß \U0001f389Q", "#*$%&|<>^-]\\[ # *", "é#é\u00a0A\x00|\u2028$", "\t \n", "ABC abc"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    got = ar._cheap(rows, F.col("text")).select("text", "n_upper", "n_letters", "n_symbols", "word_chars").collect()
    for text, *n in got:
        letters = [c for c in text if c.isascii() and c.isalpha()]
        symbols = sum(c in ar.SYMBOLS for c in text)
        assert n == [sum(c.isupper() for c in letters), len(letters), symbols, counts(text)[1]]
    assert len(got) == len(texts)
