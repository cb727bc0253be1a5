from __future__ import annotations

import random

import corpus_pipeline as cp
from spacelens.llm import queries

from .conftest import rows_of, sentence
from .test_dedup import true_classes
from .test_mixing import words
from .test_rules import counts


def write(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_run_against_brute_force(spark, tmp_path):
    """Clean documents of two languages, a copy, a near copy, short and repetitive junk, no letters."""
    rng = random.Random(9)
    rows = []
    for i in range(80):
        lang = "en" if i % 2 else "de"
        text = sentence(rng, lang, 60) + f" {i} " + sentence(rng, lang, 30)
        rows.append((i, text, lang, f"s{i % 3}", len(text)))
    rows += [
        (200, rows[4][1], "de", "s0", 1),
        (201, rows[7][1] + " extra", "en", "s1", 1),
        (202, "too short", "en", "s1", 1),
        (203, "again and again these eight words come back " * 9, "en", "s2", 1),
        (204, " ".join(map(str, range(500, 560))), None, "s2", 1),
        (205, None, None, None, None),
    ]
    path = write(spark, rows, "doc_id long, text string, lang string, source string, n_chars long", tmp_path)
    out = cp.run(spark, path).collect()
    good = [r for r in rows if r[1] and not (counts(r[1])[0] < 20 or 100 * counts(r[1])[4] > 30 * counts(r[1])[0])]
    lettered = [r for r in good if any(c.isalpha() for c in r[1])]
    chosen = {c for c in true_classes([(r[0], r[1]) for r in lettered])}
    kept = {r[0]: r for r in lettered if r[0] in chosen}
    assert set(kept) == set(range(80))
    taken = {}
    for r in out:
        assert r["round_trip"] and r["doc_id"] in kept
        assert (kept[r["doc_id"]][1], kept[r["doc_id"]][4]) == (r["text"], r["n_chars"])
        taken[r["source"]] = taken.get(r["source"], 0) + words(r["text"])
    total = sum(words(r[1]) for r in kept.values())
    # Of each source's last document at most half is missing or too much.
    assert abs(sum(taken.values()) - 1.5 * total) <= 3 * (1 + max(words(r[1]) for r in kept.values()) / 2)


def test_stages_keep_columns_and_stand_messy_input(spark, tmp_path):
    rows = rows_of(40, seed=3)
    schema = "doc_id long, text string, lang string, source string, n_chars long, row int, bounds int, q int, _hash int, r int, comp int, class_id int"
    docs = spark.createDataFrame(rows_of(40, seed=3), schema.replace("row int, bounds int, q int, _hash int, r int, comp int, class_id int", "row string, bounds int, q string, _x int, r string, comp int, class_id int"))
    for k, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns[: len(docs.columns)] == docs.columns, name
        assert k == len(cp.STAGES) - 1 or out.columns == docs.columns, name
        assert out.count() <= 2 * len(rows), name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name


def test_an_operator_for_each_number():
    numbers = sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES)
    assert numbers == list(range(1, 14))
