"""Registered queries over documents, pages, conversations and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import binding as b
from checks.market_queries import rounded
from spacelens.config import RetrievalConfig
from spacelens.functions import text
from spacelens.functions import verify_text as vt
from spacelens.operators import evaluate, index, retrieval, verify
from spacelens.operators.chunks import chunk_documents

RETRIEVAL = RetrievalConfig()
POOL = RETRIEVAL.pool()


def chunks(spark, sf):
    return chunk_documents(b.corpus(spark, sf), RETRIEVAL, paragraph="\n")


def tokens(spark, sf):
    """Term frequencies over all documents."""
    words = b.corpus(spark, sf).select(F.explode(text.tokens("body")).alias("term"))
    return words.groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def trigrams(spark, sf):
    grams = b.corpus(spark, sf).select("doc_id", F.explode(text.trigrams("body")).alias("gram"))
    per_doc = grams.groupBy("gram", "doc_id").agg(F.count(F.lit(1)).alias("c"))
    return per_doc.groupBy("gram").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("documents"))


def text_index(spark, sf):
    """Per passage: tokens, distinct terms and grams, and the sum of its gram weights."""
    ix = b.text_index(spark, sf)
    words = ix.postings.groupBy(*index.CHUNK).agg(
        F.sum("tf").alias("length"), F.count(F.lit(1)).alias("terms")
    )
    counts = ix.grams.select(*index.CHUNK, F.inline("counts"))
    grams = counts.join(ix.idf, "gram").groupBy(*index.CHUNK).agg(
        F.count(F.lit(1)).alias("grams"), F.sum(index.gram_weight()).alias("w")
    )
    scaled = grams.join(ix.norms, index.CHUNK).select(
        *index.CHUNK, "grams", (F.col("w") / F.col("norm")).alias("weight_sum")
    )
    return rounded(words.join(scaled, index.CHUNK))


def term_frequency(spark, sf):
    return b.text_index(spark, sf).terms


def bm25(spark, sf):
    hits = retrieval.bm25(b.text_index(spark, sf), b.text_queries(spark, sf), POOL, RETRIEVAL)
    return rounded(hits)


def trigram_cosine(spark, sf):
    return rounded(retrieval.trigram_cosine(b.text_index(spark, sf), b.text_queries(spark, sf), POOL))


def rrf_search(spark, sf):
    hits = retrieval.search(b.text_index(spark, sf), b.text_queries(spark, sf), RETRIEVAL)
    return rounded(hits, 9)


def term_relevance(spark, sf):
    return rounded(retrieval.term_relevance(b.text_index(spark, sf), b.text_queries(spark, sf)))


def _vectors(spark, sf):
    e = b.table(spark, sf, "embeddings")
    vectors = e.select(F.col("vec_id").alias("doc_id"), F.lit(0).alias("chunk_no"),
                       F.col("embedding").cast("array<double>").alias("vector"))
    dims = e.select("label", F.posexplode("embedding").alias("dim", "v"))
    means = dims.groupBy("label", "dim").agg(F.avg(F.col("v").cast("double")).alias("v"))
    # One array of the vector's fixed width per label.
    centres = means.groupBy(F.col("label").alias("query_id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("dim", "v"))), lambda x: x["v"]).alias("vector")
    )
    return vectors, centres


def dense_rank(spark, sf):
    """Vectors closest to the mean vector of each label."""
    vectors, centres = _vectors(spark, sf)
    return rounded(retrieval.dense_rank(vectors, centres, POOL), 5)


# ---- answer verification -------------------------------------------------------------------

def _evidence(spark, sf):
    return verify.evidence_numbers(b.evidence(spark, sf), number="size")


def evidence_numbers(spark, sf):
    return rounded(_evidence(spark, sf))


def numeric_claims(spark, sf):
    return verify.numeric_claims(b.answers(spark, sf), ["answer_id"])


def _grounding(spark, sf):
    return verify.grounding_report(b.answers(spark, sf), _evidence(spark, sf))


def grounding_report(spark, sf):
    listed = F.array_join(F.transform("ungrounded", lambda v: F.format_string("%.4f", v)), ";")
    return _grounding(spark, sf).withColumn("ungrounded", listed)


def _citations(spark, sf):
    return verify.citation_report(b.answers(spark, sf), b.signals(spark, sf))


def citation_report(spark, sf):
    out = _citations(spark, sf)
    for c in ("cited", "unknown", "uncited"):
        out = out.withColumn(c, F.array_join(c, "|"))
    return out


def guard_verdict(spark, sf):
    return verify.guard_verdict(_grounding(spark, sf), _citations(spark, sf))


def injection_scan(spark, sf):
    hits = vt.injection_hits(F.col("text"))
    scanned = b.retrieved_texts(spark, sf).select("text_id", hits.alias("h"))
    return scanned.select(
        "text_id", (F.size("h") == 0).alias("clean"), F.array_join("h", ",").alias("patterns")
    )


def sanitised_text(spark, sf):
    return b.retrieved_texts(spark, sf).select("text_id", vt.sanitise(F.col("text")).alias("text"))


def scope_labels(spark, sf):
    return b.questions(spark, sf).select(
        "question_id", F.inline(F.array(vt.scope_decision(F.col("text"))))
    )


def intent_labels(spark, sf):
    return b.questions(spark, sf).select("question_id", vt.intent(F.col("text")).alias("intent"))


def mentioned_spaces(spark, sf):
    return rounded(
        verify.mentioned_spaces(b.space_questions(spark, sf), b.market(spark, sf).scored)
    )


# ---- evaluation ----------------------------------------------------------------------------

def eval_cases(spark, sf):
    out = evaluate.check_cases(b.cases(spark, sf))
    lists = ("missing_tools", "missing_content", "forbidden_content", "invalid_citations", "failure_reasons")
    for c in lists:
        out = out.withColumn(c, F.array_join(c, "|"))
    return out


def eval_summary(spark, sf):
    return rounded(evaluate.summarise(evaluate.check_cases(b.cases(spark, sf))))


QUERIES = {
    "chunks": chunks,
    "tokens": tokens,
    "trigrams": trigrams,
    "text_index": text_index,
    "term_frequency": term_frequency,
    "bm25": bm25,
    "trigram_cosine": trigram_cosine,
    "dense_rank": dense_rank,
    "rrf_search": rrf_search,
    "term_relevance": term_relevance,
    "evidence_numbers": evidence_numbers,
    "numeric_claims": numeric_claims,
    "grounding_report": grounding_report,
    "citation_report": citation_report,
    "guard_verdict": guard_verdict,
    "injection_scan": injection_scan,
    "sanitised_text": sanitised_text,
    "scope_labels": scope_labels,
    "intent_labels": intent_labels,
    "mentioned_spaces": mentioned_spaces,
    "eval_cases": eval_cases,
    "eval_summary": eval_summary,
}
