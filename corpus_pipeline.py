"""A training corpus from raw documents: five stages, each one operator of ``spacelens.llm``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again before the next stage. All but the last return the columns they were given.

Rows with nulls anywhere, empty texts and empty tables pass through the stages that do not judge
them: quality rules reject texts with too few words (null ones too), language identification
rejects texts without a letter or whose language is unclear, equal and near-equal texts leave one
document (the smallest id), mixing takes each document as often as its source's target asks, and
the last stage adds the piece ids and whether they decode to the text.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spacelens.llm import adaptive_rules, byte_cnn, curriculum, dart_dedup, piece_viterbi
from spacelens.llm.words import id_fold
from spacelens.sources.stage import stage_root


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that pass the base rules and lie within their group's thresholds."""
    return adaptive_rules.keep_good(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language a network trained on the corpus's own labels can tell."""
    return byte_cnn.identified(docs, id_fold(F.col("doc_id"), 5) != 0)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of equal and near-equal texts."""
    return dart_dedup.deduplicated(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training stream: documents as often as their source's target asks, in training order."""
    return curriculum.mixed_documents(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds piece_ids and round_trip."""
    return piece_viterbi.encode(docs, piece_viterbi.read_vocabulary(piece_viterbi.MODEL))


STAGES = [
    ("quality rules", quality_rules),
    ("language identification", language_id),
    ("near-duplicate removal", near_dedup),
    ("source mixing", source_mixing),
    ("sentencepiece", sentencepiece),
]

#: Trained networks and signatures have no SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = f"{stage_root(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage_of) in enumerate(STAGES):
        path = f"{root}/{k}"
        stage_of(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
