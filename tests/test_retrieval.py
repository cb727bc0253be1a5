import math
import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spacelens.config import RetrievalConfig
from spacelens.functions.text import squash, tokens
from spacelens.operators import chunks as chunk_module
from spacelens.operators import index as index_module
from spacelens.operators import retrieval
from spacelens.operators.chunks import chunk_documents
from spacelens.operators.index import CHUNK, TextIndex, gram_counts, word_postings
from spacelens.sources.facts import strip


def reference_chunks(title, body, target, overlap, mark):
    """Word-by-word statement of the packing rule."""
    paragraphs = [p.strip() for p in body.split(mark) if p.strip()]
    if not paragraphs:
        return [title]
    out, held = [], []
    for p in paragraphs:
        if held and sum(len(h.split()) for h in held) + len(p.split()) > target:
            text = "\n\n".join(held)
            out.append(text)
            tail = " ".join(text.split()[-overlap:]) if overlap else ""
            held = [tail] if tail else []
        held.append(p)
    out.append("\n\n".join(held))
    return [f"{title}\n\n{t}" for t in out]


def chunked(spark, docs, config, mark):
    df = spark.createDataFrame(docs, "doc_id long, title string, body string")
    rows = chunk_documents(df, config, mark).orderBy("doc_id", "chunk_no").collect()
    out = {}
    for r in rows:
        assert r["chunk_no"] == len(out.setdefault(r["doc_id"], []))
        out[r["doc_id"]].append(r["text"])
    return out


@pytest.mark.parametrize("overlap", [0, 4, 30])
@pytest.mark.parametrize("mark", ["\n\n", "\n"])
def test_chunks_against_brute_force(spark, overlap, mark):
    rng = random.Random(overlap)
    docs = [(0, "empty", ""), (1, "blank", " \n \n\n "), (2, "null", None)]
    for i in range(3, 25):
        paras = [" ".join(f"w{rng.randint(0, 99)}" for _ in range(rng.choice([1, 3, 9, 25, 60])))
                 for _ in range(rng.randint(1, 12))]
        docs.append((i, f"T{i}", (mark + " ").join(paras)))
    got = chunked(spark, docs, RetrievalConfig(chunk_words=40, overlap_words=overlap), mark)
    for i, title, body in docs:
        assert got[i] == reference_chunks(title, body or "", 40, overlap, mark), i


def test_a_document_of_very_many_paragraphs(spark):
    """The work on one document grows with its length, not with the square of its paragraphs."""
    body = "\n".join(f"a{i} b{i} c{i}" for i in range(100_000))
    start = time.monotonic()
    got = chunked(spark, [(1, "T", body)], RetrievalConfig(chunk_words=240, overlap_words=45), "\n")[1]
    assert time.monotonic() - start < 60
    assert got == reference_chunks("T", body, 240, 45, "\n")


@pytest.fixture(scope="module")
def small_index(spark):
    bodies = [
        "Ezetimibe is recommended with a statin when LDL stays high.",
        "Price control by the NLEM caps the price of essential medicines.",
        "Hypertension prevalence grows in cities and hypertension is missed.",
        "Statin and ezetimibe combination guidelines. Statin first.",
        "Air quality and the heart.",
    ]
    docs = [(i, f"doc {i}", b) for i, b in enumerate(bodies)]
    chunks = chunk_documents(spark.createDataFrame(docs, "doc_id long, title string, body string"))
    texts = {r["doc_id"]: r["text"] for r in chunks.collect()}
    return TextIndex.build(chunks), texts


QUERIES = [(1, "ezetimibe statin combination guidelines statin"), (2, "price control NLEM"),
           (3, "hypertensive prevalence"), (4, "the of"), (5, "ezetimib")]


def words(text):
    import re
    from spacelens.functions.text import STOP_WORDS

    return [t for t in re.findall("[a-z0-9]+", text.lower()) if t not in STOP_WORDS]


def grams(text):
    clean = " ".join(text.lower().split())
    return [clean[i : i + 3] for i in range(len(clean) - 2)]


def test_bm25_against_brute_force(spark, small_index):
    index, texts = small_index
    queries = spark.createDataFrame(QUERIES, "query_id long, text string")
    got = {(r["query_id"], r["doc_id"]): r["score"] for r in retrieval.bm25(index, queries, 20).collect()}
    docs = {d: words(t) for d, t in texts.items()}
    average = sum(map(len, docs.values())) / len(docs)
    want = {}
    for q, text in QUERIES:
        for d, ts in docs.items():
            score = 0.0
            for term in words(text):
                df = sum(term in x for x in docs.values())
                tf = ts.count(term)
                if tf:
                    idf = math.log(1 + (len(docs) - df + 0.5) / (df + 0.5))
                    score += idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(ts) / average))
            if score > 0:
                want[q, d] = score
    assert got == pytest.approx(want)


def test_cosine_against_brute_force(spark, small_index):
    index, texts = small_index
    queries = spark.createDataFrame(QUERIES, "query_id long, text string")
    got = {(r["query_id"], r["doc_id"]): r["score"]
           for r in retrieval.trigram_cosine(index, queries, 20).collect()}
    counts = {d: Counter(grams(t)) for d, t in texts.items()}
    df = Counter(g for c in counts.values() for g in c)
    idf = {g: math.log(1 + len(counts) / (1 + n)) for g, n in df.items()}

    def unit(c):
        v = {g: (1 + math.log(n)) * idf.get(g, 0.0) for g, n in c.items()}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
        return {g: x / norm for g, x in v.items()}

    vectors = {d: unit(c) for d, c in counts.items()}
    want = {}
    for q, text in QUERIES:
        v = unit(Counter(grams(text)))
        for d, w in vectors.items():
            s = sum(x * w.get(g, 0.0) for g, x in v.items())
            if s > 0:
                want[q, d] = s
    assert got == pytest.approx(want)


def test_search_gives_one_passage_per_document(spark, small_index):
    index, _ = small_index
    queries = spark.createDataFrame(QUERIES, "query_id long, text string")
    rows = retrieval.search(index, queries, RetrievalConfig(top_k=3)).collect()
    pairs = [(r["query_id"], r["doc_id"]) for r in rows]
    assert len(pairs) == len(set(pairs))
    first = {r["query_id"]: r["doc_id"] for r in rows if r["rank"] == 1}
    assert first[1] == 3 and first[2] == 1 and first[3] == 2
    # A misspelt word still finds its documents through the trigrams.
    assert first[5] in (0, 3)


def test_scores_need_no_shuffle_of_query_and_passage(spark, small_index):
    """Counts and sums of a passage are made where its block is read; only the best rows move."""
    index, _ = small_index
    queries = spark.createDataFrame(QUERIES, "query_id long, text string")
    for scores in (
        word_postings(index.chunks),
        gram_counts(index.chunks, CHUNK),
        retrieval.bm25_scores(index, queries, RetrievalConfig()),
        retrieval.cosine_scores(index, queries),
    ):
        plan = scores._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan
        assert "Bucketed: true" in plan


def test_relevance_peaks_at_one(spark, small_index):
    index, _ = small_index
    queries = spark.createDataFrame(QUERIES[:2], "query_id long, text string")
    rows = retrieval.term_relevance(index, queries).collect()
    for q in (1, 2):
        assert max(r["relevance"] for r in rows if r["query_id"] == q) == pytest.approx(1.0)


def test_empty_corpus_gives_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, title string, body string")
    index = TextIndex.build(chunk_documents(empty))
    queries = spark.createDataFrame(QUERIES, "query_id long, text string")
    assert retrieval.search(index, queries).count() == 0


def test_dense_blocks_against_brute_force(spark):
    rng = np.random.default_rng(3)
    v, q = rng.normal(size=(60, 8)), rng.normal(size=(7, 8))
    vectors = spark.createDataFrame(
        [(i, 0, [float(x) for x in row]) for i, row in enumerate(v)],
        "doc_id long, chunk_no int, vector array<double>",
    )
    queries = spark.createDataFrame(
        [(i, [float(x) for x in row]) for i, row in enumerate(q)],
        "query_id long, vector array<double>",
    )
    rows = retrieval.dense_rank(vectors, queries, 5, vector_block=9, query_block=2).collect()
    sims = (q / np.linalg.norm(q, axis=1, keepdims=True)) @ (
        v / np.linalg.norm(v, axis=1, keepdims=True)
    ).T
    for i in range(7):
        order = [int(d) for d in np.argsort(-sims[i]) if sims[i][d] > 0][:5]
        got = sorted((r["position"], r["doc_id"]) for r in rows if r["query_id"] == i)
        assert [d for _, d in got] == order


def test_dense_ranking_of_nothing_and_of_ties(spark):
    schema = "doc_id string, chunk_no int, vector array<double>"
    same = spark.createDataFrame([(f"d{i}", 0, [1.0, float(i // 8)]) for i in range(32)], schema)
    asked = spark.createDataFrame([("q", [1.0, 0.0]), ("zero", [0.0, 0.0])], "query_id string, vector array<double>")
    rows = retrieval.dense_rank(same, asked, 3, vector_block=5, query_block=1).collect()
    got = {(r["query_id"], r["position"]): r["doc_id"] for r in rows}
    assert [got["q", i] for i in (1, 2, 3)] == ["d0", "d1", "d2"]
    assert [got["zero", i] for i in (1, 2, 3)] == ["d0", "d1", "d10"]
    assert retrieval.dense_rank(same.limit(0), asked, 3).count() == 0
    assert retrieval.dense_rank(same, asked.limit(0), 3).count() == 0


def test_postings_are_counted_where_a_passage_is_read(spark):
    """Against brute force, with repeated and null keys, null texts and terms at the ends of texts."""
    rows = [
        (1, 0, "The apple, the APPLE pie-2"), (1, 0, "apple"), (1, 1, "end"), (2, 0, "start"), (2, 1, None),
        (3, 0, ""), (3, 1, "of the and"), (None, 0, "café İx K9"), (None, 0, "x caf"), (4, None, "z " * 30),
    ]
    chunks = spark.createDataFrame(rows, "doc_id long, chunk_no int, text string").repartition(1)
    counted = word_postings(chunks)
    each = chunks.select("doc_id", "chunk_no", tokens("text").alias("t"))
    plain = each.select("doc_id", "chunk_no", F.size("t").alias("length"), F.explode("t").alias("term"))
    want = plain.groupBy("doc_id", "chunk_no", "term").agg(F.count("term").alias("tf"), F.max("length").alias("length"))
    assert counted.dtypes == want.dtypes
    assert sorted(map(repr, counted.collect())) == sorted(map(repr, want.collect()))
    assert "apple" in {r["term"] for r in counted.collect()}
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract_all" not in plan and "Generate inline" in plan


def test_terms_of_many_slices_are_whole(monkeypatch):
    monkeypatch.setattr(index_module, "TERM_SLICE", 7)
    texts = [["a1 b1", "b1"], [], ["c1"], ["b1 b1 the b1", "", "d1"], [""]]
    sliced = pa.array([["skip"], *texts, ["skip"]]).slice(1, 5)
    got = [{t["term"]: (t["tf"], t["length"]) for t in x} for x in index_module._term_lists(sliced).to_pylist()]
    assert got == [{"a1": (1, 2), "b1": (2, 2)}, {}, {"c1": (1, 1)}, {"b1": (3, 3), "d1": (1, 1)}, {}]


def test_few_gram_weights_are_sent_whatever_the_threshold(spark, monkeypatch):
    """The rows of grams are not moved to meet the weights, unless there are too many of those."""
    grams = spark.createDataFrame([(1, 0, 5, 2), (1, 0, 6, 1), (2, 0, 5, 1)], "doc_id long, chunk_no int, gram long, tf long")
    idf = spark.createDataFrame([(5, 0.5), (6, 1.0)], "gram long, idf double")

    def plan():
        norms = index_module.gram_norms(grams, index_module.beside(idf), CHUNK)
        return norms._jdf.queryExecution().executedPlan().toString()

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" in plan()
        monkeypatch.setattr(index_module, "SENT_GRAMS", 1)
        assert "BroadcastHashJoin" not in plan()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_paragraphs_are_stripped_as_the_pattern_does(spark):
    odd = ["", " ", "a", " \t a b \r\n", "a  ", "a \u0085\n", " ", "   ", "a  ", "\x0ba\x0c",
           "\x1ca ", " a \r\u0085", "a \u0085 ", " \u0085 "]
    rows = spark.createDataFrame(list(enumerate(odd)), "i int, s string").select("i", strip("s").alias("s")).collect()
    assert [chunk_module._stripped(x.encode()).decode() for x in odd] == [r["s"] for r in sorted(rows)]


def test_grams_are_counted_over_squashed_texts(spark):
    rows = [(1, " Ab \t\n cd "), (2, " x  y"), (3, " "), (4, None), (5, "\x1cab\x0bc")]
    texts = spark.createDataFrame(rows, "k long, text string")
    clean = texts.select("k", squash(F.lower("text")).alias("t")).collect()
    want = {}
    for k, t in clean:
        pieces = [t[i : i + 3] for i in range(len(t) - 2)] if t and len(t) > 2 else [t] if t else []
        for g in pieces:
            points = [ord(c) + 1 for c in g] + [0] * (3 - len(g))
            code = (points[0] << 42) | (points[1] << 21) | points[2]
            want[k, code] = want.get((k, code), 0) + 1
    assert {(r["k"], r["gram"]): r["tf"] for r in gram_counts(texts, ["k"]).collect()} == want
