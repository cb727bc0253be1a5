"""One registered query for each operator of this folder, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spacelens.llm import (
    adaptive_rules,
    byte_cnn,
    cover_search,
    curriculum,
    dart_dedup,
    ftrl_quality,
    html_paths,
    importance,
    nn_descent,
    piece_viterbi,
    suffix_tree_lm,
    vector_pack,
    word_runs,
)
from spacelens.llm.words import id_fold


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    out = html_paths.extract(pages, carry=["page_id", "url"])
    return out.select(
        "page_id",
        "url",
        F.col("main_text").alias("text"),
        F.length("main_text").cast("long").alias("n_chars"),
    )


def near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dart_dedup.classes(_table(spark, sf_dir, "documents"))
    kept = F.col("doc_id").eqNullSafe(F.col("class_id"))
    return out.select("doc_id", "class_id", kept.alias("kept"))


def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = id_fold(F.col("doc_id"), 5)
    model = byte_cnn.fit(docs, fold != 0)
    out = byte_cnn.predict(docs.select("doc_id", "text"), model, carry=["doc_id"])
    held_out = F.coalesce(fold == 0, F.lit(False))
    return out.select(
        "doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score")
    )


def quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    fold = id_fold(F.col("doc_id"), 4)
    model = ftrl_quality.fit(docs, labels, fold != 2)
    out = ftrl_quality.score(docs, model, carry=["doc_id"])
    score = F.col("quality_score")
    return out.select(
        "doc_id",
        F.coalesce(fold == 2, F.lit(False)).alias("held_out"),
        score.alias("score"),
        F.when(score >= 0.7, 1).otherwise(0).alias("predicted"),
    )


def mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = curriculum.mix_plan(_table(spark, sf_dir, "documents"))
    return plan.select(
        "doc_id", "size", "source_size", "target", "taken", "source", "position", "position_again"
    )


def exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_search.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    vocabulary = piece_viterbi.read_vocabulary(piece_viterbi.MODEL)
    out = piece_viterbi.encode(docs, vocabulary, carry=["doc_id", "n_chars"])
    return out.select(
        "doc_id", "n_chars", F.size("piece_ids").alias("n_ids"), "piece_ids", "round_trip"
    )


def sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_pack.shard_table(_table(spark, sf_dir, "documents"))


def lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = id_fold(F.col("doc_id"), 7)
    out = suffix_tree_lm.scored(docs, fold != 2)
    return out.select(
        "doc_id",
        F.coalesce(fold == 2, F.lit(False)).alias("held_out"),
        "n_tokens",
        "n_known",
        "train_tokens",
        "base_score",
        "score",
    )


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    q = adaptive_rules.judged(docs)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return q.select(
        "row.doc_id", *[f"quality.{c}" for c in counts], "quality.base_failed", "quality.kept"
    )


def run_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    h = F.crc32(F.col("doc_id").cast("string"))
    loop = F.when(h % 10 == 0, F.floor(h / 10))
    return word_runs.digests(word_runs.periodic_runs(docs, loop=loop))


def importance_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return importance.resampled(docs, _table(spark, sf_dir, "benchmark"))


def nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


QUERIES = {
    "op1_html_extraction": html_extraction,
    "op2_near_dedup": near_dedup,
    "op3_language_id": language_id,
    "op4_source_mixing": mixing,
    "op5_quality_classifier": quality_classifier,
    "op6_exact_top_k": exact_top_k,
    "op7_sentencepiece": sentencepiece,
    "op8_sharding": sharding,
    "op9_lm_scoring": lm_scoring,
    "op10_quality_rules": quality_rules,
    "op11_word_runs": run_digests,
    "op12_importance_resampling": importance_draw,
    "op13_nearest_neighbours": nearest_neighbours,
}
