"""Gram vectors and block products of the text index."""

from collections import Counter

from spacelens.config import RetrievalConfig
from spacelens.operators import retrieval
from spacelens.operators.index import CHUNK, POINT_BITS, TextIndex, gram_counts

TEXTS = [
    (1, 0, "Alpha  beta\talpha"), (1, 0, "alpha"), (1, 1, "ab"), (2, 0, ""), (2, 1, None), (3, 0, "a"),
    (4, 0, "Ünï \U0001f600\U0001f600\U0001f600\U0001f600 ünï"), (None, 0, "null key"), (None, 0, "null key"),
]


def letters(gram):
    points = [(gram >> s) & ((1 << POINT_BITS) - 1) for s in (2 * POINT_BITS, POINT_BITS, 0)]
    return "".join(chr(p - 1) for p in points if p)


def test_grams_of_odd_texts_and_repeated_keys(spark):
    df = spark.createDataFrame(TEXTS, "doc_id long, chunk_no int, text string")
    want = Counter()
    for doc, no, text in TEXTS:
        clean = " ".join((text or "").lower().split())
        for g in [clean[i : i + 3] for i in range(len(clean) - 2)] if len(clean) > 2 else [clean] * bool(clean):
            want[doc, no, g] += 1
    got = {(r["doc_id"], r["chunk_no"], letters(r["gram"])): r["tf"] for r in gram_counts(df, CHUNK).collect()}
    assert got == want


def test_a_passage_is_one_row_of_the_gram_table(spark):
    texts = spark.createDataFrame(
        [(i, 0, "t", f"word{i} and some more words") for i in range(20)], "doc_id long, chunk_no int, title string, text string"
    )
    assert TextIndex.build(texts).grams.count() == 20


def test_best_passages_of_copies_come_by_key(spark):
    texts = spark.createDataFrame(
        [(f"d{i:02}", 0, "t", "the same passage here") for i in range(30)],
        "doc_id string, chunk_no int, title string, text string",
    )
    index = TextIndex.build(texts, blocks=3)
    asked = spark.createDataFrame([(7, "same passage"), (8, "zzz")], "query_id long, text string")
    for ranked, scores in (
        (retrieval.bm25(index, asked, 4), retrieval.bm25_scores(index, asked, RetrievalConfig(), 4)),
        (retrieval.trigram_cosine(index, asked, 4), retrieval.cosine_scores(index, asked, 4)),
    ):
        rows = sorted((r["position"], r["query_id"], r["doc_id"]) for r in ranked.collect())
        assert rows == [(i + 1, 7, f"d{i:02}") for i in range(4)]
        # A pair of blocks hands on no more than its best rows.
        assert scores.count() <= 3 * 4
