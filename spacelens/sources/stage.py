"""Written intermediates: one parquet table per stage in the shared checkpoint folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
OPEN_FILES = "spark.sql.maxConcurrentOutputFileWriters"
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_local_roots: dict[str, str] = {}


def stage_root(spark: SparkSession) -> str:
    """The folder the cluster names; a private temporary one only in local mode."""
    root = spark.conf.get(SETTING, None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {SETTING} to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="spacelens-stage-")
        atexit.register(shutil.rmtree, _local_roots[app], ignore_errors=True)
    return _local_roots[app]


@contextmanager
def released(spark: SparkSession):
    """What runs inside gives its shuffle files back when it ends: its result is held elsewhere."""
    before = spark.conf.get(SHUFFLES_GO, "false")
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLES_GO, before)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` and read it back.

    Cuts the lineage, so a lost executor costs a re-read and not a recompute, and gives
    the planner true sizes to choose join strategies by.
    """
    spark = df.sparkSession
    path = f"{stage_root(spark)}/{name}-{uuid.uuid4().hex}"
    with released(spark):
        df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def passing(df: DataFrame, name: str):
    """As ``stage``, for what is read inside only: the table is deleted at the end."""
    spark = df.sparkSession
    database = f"{name}_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {database} LOCATION '{stage_root(spark)}/{database}'")
    try:
        with released(spark):
            df.write.format("parquet").saveAsTable(f"{database}.held")
        yield spark.table(f"{database}.held")
    finally:
        spark.sql(f"DROP DATABASE {database} CASCADE")


def stage_by(df: DataFrame, name: str, keys: list[str], blocks: int | None = None) -> DataFrame:
    """As ``stage``, in ``blocks`` files by the hash of ``keys`` (default: the shuffle partitions).

    Spark knows where the rows lie: a later grouping whose keys hold all of ``keys`` runs inside the
    tasks that scan the blocks, without a shuffle. Rows that lie in blocks already are written as
    they come: with a few files open at once the writer does not sort a task's rows first.
    """
    spark = df.sparkSession
    blocks = blocks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{name}_{uuid.uuid4().hex}"
    writer = df.write.format("parquet").bucketBy(blocks, *keys)
    before = spark.conf.get(OPEN_FILES)
    spark.conf.set(OPEN_FILES, "4")
    try:
        with released(spark):
            writer.option("path", f"{stage_root(spark)}/{table}").saveAsTable(table)
    finally:
        spark.conf.set(OPEN_FILES, before)
    return spark.table(table)


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a plain scan out when it has fewer splits than there are cores.

    Only ever touches small inputs: a large one has many splits and is left as it lies. Meant
    for scans; counting the splits of a plan with shuffles would run them.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
