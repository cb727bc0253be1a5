import pytest
from pyspark.sql import functions as F

from spacelens.operators.linking import add_trend_multiplier, match_signals, signal_links
from spacelens.operators.substring import _pieces, rarest_seeds, substring_join
from spacelens.sources import signals as sig

SPACES = [
    ("MOL_EZE", "Statins Comb. | ROSUVASTATIN + EZETIMIBE", "Lipid Regulators", "Statins Comb."),
    ("MOL_OTHER", "ACEi | RAMIPRIL", "Anti Hypertensives", "ACEi"),
    ("MOL_THIRD", "Nitrates | GLYCERYL TRINITRATE", "Anti Angina", "Nitrates"),
]
BASE = dict(id="S-TEST", title="t", category="guidelines", publisher="p", source="s", url="https://x",
            published="2025", accessed="2026", confidence="high", direction="tailwind",
            magnitude=0.10, body="b", molecules=["EZETIMIBE"], segments=[],
            sub_segments=["Statins Comb."], keywords=["ezetimibe", "ldl"])


def frame(spark, *changes):
    rows = [{**BASE, "path": f"/{i}.md", **c} for i, c in enumerate(changes)]
    names = [c.split()[0] for c in sig.SIGNAL_SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], sig.SIGNAL_SCHEMA)


@pytest.fixture
def spaces(spark):
    df = spark.createDataFrame(SPACES, "space_id string, space_label string, segment string, sub_segment string")
    return df.withColumn("level", F.lit("molecule_combination"))


@pytest.fixture
def no_molecules(spark):
    return spark.createDataFrame([], "level string, space_id string, molecule string, value double")


def multipliers(spaces, links):
    return {r["space_id"]: r["trend_multiplier"] for r in add_trend_multiplier(spaces, links).collect()}


def test_magnitude_signs(spark):
    df = frame(spark, {}, {"confidence": "medium"}, {"confidence": "LOW"}, {"confidence": "odd"},
               {"direction": "headwind"}, {"direction": "sideways"})
    got = [r[0] for r in df.orderBy("path").select(sig.signed_magnitude()).collect()]
    assert got == pytest.approx([0.10, 0.06, 0.03, 0.05, -0.10, 0.0])


def test_differential_evidence_moves_one_space(spark, spaces, no_molecules):
    links = signal_links(spaces, frame(spark, {}), no_molecules)
    assert multipliers(spaces, links) == pytest.approx(
        {"MOL_EZE": 1.10, "MOL_OTHER": 1.0, "MOL_THIRD": 1.0}
    )
    row = links.first()
    assert row["match_reason"] == "molecule match: EZETIMIBE (category guidelines, weight 1.0)"


def test_universal_evidence_moves_nothing(spark, spaces, no_molecules):
    every = {"molecules": [], "sub_segments": [], "keywords": [],
             "segments": ["Lipid Regulators", "Anti Hypertensives", "Anti Angina"]}
    links = signal_links(spaces, frame(spark, every), no_molecules)
    assert links.count() == 3
    assert set(multipliers(spaces, links).values()) == {1.0}


def test_no_signals(spark, spaces, no_molecules):
    links = signal_links(spaces, frame(spark, {}).where("false"), no_molecules)
    assert links.count() == 0 and set(multipliers(spaces, links).values()) == {1.0}


def test_secondary_signals_count_half_and_the_band_holds(spark, spaces, no_molecules):
    df = frame(spark, {"id": "A", "magnitude": 0.2}, {"id": "B", "magnitude": 0.1},
               {"id": "C", "magnitude": 0.3, "category": "launch"}, {"id": "Z", "magnitude": 0.0})
    links = signal_links(spaces, df, no_molecules)
    got = {r["signal_id"]: r["contribution"] for r in links.collect()}
    assert got == pytest.approx({"A": 0.2, "B": 0.05, "C": 0.3})
    assert multipliers(spaces, links)["MOL_EZE"] == 1.25


def test_cascade_order(spark, spaces, no_molecules):
    df = frame(
        spark,
        {"id": "SUB", "molecules": []},
        {"id": "SEG", "molecules": [], "sub_segments": [], "segments": ["lipid regulators"]},
        {"id": "KEY", "molecules": [], "sub_segments": []},
    )
    got = {r["id"]: r["match_reason"] for r in match_signals(spaces, df, no_molecules).collect()}
    assert got == {
        "SUB": "sub-segment match: Statins Comb.",
        "SEG": "segment match: Lipid Regulators",
        "KEY": "keyword match: ezetimibe",
    }


def test_substring_join_against_brute_force(spark):
    texts = ["abc abd", "xyz", "a", "banana bread", "", "ZZ top"]
    terms = ["a", "an", "ana", "anan", "bread", "abd", "zz", "q", "", "xyzz", "banana bread"]
    a = spark.createDataFrame([(t,) for t in texts], "t string")
    b = spark.createDataFrame([(t,) for t in terms], "w string")
    got = {(r["t"], r["w"]) for r in substring_join(a, "t", b, "w").collect()}
    assert got == {(t, w) for t in texts for w in terms if w and w in t}


def test_a_beginning_that_every_text_shares_is_no_seed(spark):
    """Terms that start with a word of every label are met by what tells them apart."""
    labels = [f"tablet film coated a{i:03d}b" for i in range(300)]
    terms = [f"tablet film coated a{i:03d}" for i in range(0, 300, 3)] + ["tablet z"]
    a = spark.createDataFrame([(t,) for t in labels], "t string")
    b = spark.createDataFrame([(t,) for t in terms], "w string")
    pieces = a.select(F.explode(_pieces(F.col("t"))).alias("_piece"))
    frequency = pieces.groupBy("_piece").agg(F.count(F.lit(1)).alias("_n"))
    seeds = {r["w"]: r["_seed"] for r in rarest_seeds(b, "w", frequency).collect()}
    assert "tablet z" not in seeds and len(seeds) == 100
    # A label offers at most three digits' worth of a seed: 300 labels, at most 30 share one.
    assert all(sum(seed in t for t in labels) <= 30 for seed in seeds.values())
    got = {(r["t"], r["w"]) for r in substring_join(a, "t", b, "w").collect()}
    assert got == {(t, w) for t in labels for w in terms if w in t}


SIGNAL_FILE = """---
id: S-07
title: Price control
category: regulation
confidence: high
direction: headwind
magnitude: 0.07
applies_to:
  segments: ["Anti Hypertensives", 'Lipid Regulators']
  molecules:
    - telmisartan
  keywords: [NLEM, price control]
---

# Heading
Body text.
"""


def test_headers_with_quotes_comments_and_blocks():
    header = """# a comment
id: "S, 1"   # the id
title: 'It''s # not a comment'
url: https://example.org/a#b
empty:
note: |
  first line
    second: line
joined: >
  one
  two
confidence: "high"
applies_to:   # nested
  keywords: ["a, b", 'c', d e]
  segments:
    - "x: y"
    - z # gone
"""
    fields = sig.header_fields(header)
    assert fields["id"] == "S, 1" and fields["title"] == "It's # not a comment"
    assert fields["url"] == "https://example.org/a#b" and fields["empty"] is None
    assert fields["note"] == "first line\nsecond: line" and fields["joined"] == "one two"
    assert fields["applies_to"] == {"keywords": ["a, b", "c", "d e"], "segments": ["x: y", "z"]}


def test_documents_left_out_are_reported(spark):
    texts = {
        "good.md": SIGNAL_FILE,
        "plain.md": "no header",
        "noid.md": SIGNAL_FILE.replace("id: S-07", "name: x"),
        "number.md": SIGNAL_FILE.replace("0.07", "a lot"),
        "line.md": SIGNAL_FILE.replace("category: regulation", "just words"),
        "null.md": None,
    }
    df = spark.createDataFrame(list(texts.items()), "path string, value string")
    assert [r["path"] for r in sig.parse_signals(df).collect()] == ["good.md"]
    errors = {r["path"]: r["reason"] for r in sig.signal_errors(df).collect()}
    assert set(errors) == set(texts) - {"good.md"} and all(errors.values())


def test_corpus_files(spark, tmp_path):
    (tmp_path / "b.md").write_text(SIGNAL_FILE)
    (tmp_path / "c.md").write_text(SIGNAL_FILE.replace("Price control", "Copy"))
    (tmp_path / "d.md").write_text("no header")
    (tmp_path / "e.md").write_text(SIGNAL_FILE.replace("id: S-07", "name: x"))
    (tmp_path / "f.md").write_text("---\n: [bad\n---\nbody")
    (tmp_path / "g.txt").write_text(SIGNAL_FILE)
    rows = sig.read_signals(spark, str(tmp_path)).collect()
    assert [r["title"] for r in rows] == ["Price control"]
    row = rows[0]
    assert row["molecules"] == ["TELMISARTAN"]
    assert row["keywords"] == ["nlem", "price control"]
    assert row["body"] == "# Heading\nBody text."
    assert row["magnitude"] == 0.07


def test_citations_are_typed(spark):
    rows = sig.citations(frame(spark, {"id": "B", "url": "internal://x"}, {"id": "A"})).collect()
    assert [(r["id"], r["type"]) for r in rows] == [
        ("A", "External source"), ("B", "Derived from supplied data")
    ]
