"""Versioned warehouse of the derived tables, read back with a completeness check; exports."""

from __future__ import annotations

import hashlib
import uuid
from urllib.parse import quote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spacelens.operators.derive import derive
from spacelens.operators.spaces import membership
from spacelens.plans.market import Market
from spacelens.sources.signals import citations

TABLES = ("sku_facts", "articles", "cells", "company_cells", "space_facts", "company_facts", "brand_facts",
          "build_metadata")


MANIFEST = "sequence long, version string, tables array<string>"


class WarehouseMissing(RuntimeError):
    """A warehouse table is absent."""


#: Bytes that one task hashes at a time, and that it reads at once.
RANGE_BYTES = 64 << 20
READ_BYTES = 1 << 20


def _opened(path: str):
    """A file of the local or of a remote file system, open for reading bytes."""
    scheme, _, rest = path.partition(":")
    if scheme == "file":
        return open("/" + rest.lstrip("/"), "rb")
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(quote(path, safe="/:@"))
    return system.open_input_file(inner)


def _hashed_ranges(batches):
    for ranges in batches:
        hashes = []
        for path, start, size in zip(ranges["path"], ranges["start"], ranges["size"], strict=True):
            digest = hashlib.sha256()
            with _opened(path) as file:
                file.seek(start)
                left = size
                while left > 0 and (piece := file.read(min(left, READ_BYTES))):
                    digest.update(piece)
                    left -= len(piece)
            if left:
                raise OSError(f"{path} became shorter while it was hashed")
            hashes.append(digest.hexdigest())
        yield ranges.assign(sha256=hashes)


def source_digests(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, bytes, sha256) of every source file.

    Files are cut into byte ranges that tasks hash piece by piece, so no file is one value. A file
    of one range has that range's hash; a longer one the hash of its ranges' hashes, in hexadecimal,
    joined by commas in order. A file that became shorter meanwhile is an
    error. Empty files, which Spark's file sources pass over, have no row.
    """
    # Only names and lengths are asked for: the contents are not read here.
    files = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"))
    last = F.greatest(F.floor((F.col("bytes") - 1) / range_bytes), F.lit(0))
    ranges = files.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("part"))
    ranges = ranges.withColumn("start", F.col("part") * range_bytes)
    ranges = ranges.withColumn("size", F.least(F.lit(range_bytes), F.col("bytes") - F.col("start")))
    # Dealt out first: the listing lies in few tasks, the ranges are to be read by many.
    hashed = ranges.repartition("path", "part").mapInPandas(
        _hashed_ranges, "path string, bytes long, part long, start long, size long, sha256 string"
    )
    # A hash for every range_bytes of one file.
    listed = F.transform(F.array_sort(F.collect_list(F.struct("part", "sha256"))), lambda r: r["sha256"])
    return hashed.groupBy("path", "bytes").agg(listed.alias("_all")).select(
        "path", "bytes",
        F.when(F.size("_all") == 1, F.get("_all", F.lit(0)))
        .otherwise(F.sha2(F.array_join("_all", ","), 256)).alias("sha256"),
    )


def build_metadata(m: Market, source: str | None = None, as_of: str | None = None) -> DataFrame:
    """(key, value, value-as-JSON) rows of counts and totals; the cells know how many packs they hold.

    With ``source`` also one digest over the source files' own, in order of their paths; with
    ``as_of`` that date; with either the time of the build. Those are texts and in the JSON alone.
    """
    pack = m.cells.agg(F.coalesce(F.sum("sku_count"), F.lit(0)).alias("n")).scalar()
    spaces = m.space_facts.agg(F.count(F.lit(1)).alias("n")).scalar()
    # A pack enters each of its spaces once, so the pairs are a sum over articles.
    sizes = m.articles.select("article", F.size("spaces").alias("spaces"))
    pairs = m.article_companies.join(sizes, "article").agg(F.sum(F.col("sku_count") * F.col("spaces")).alias("n")).scalar()
    one = m.cells.agg(
        F.sum("value_t2").cast("double").alias("market"),
        F.sum(F.when(F.col("is_focal"), F.col("value_t2")).otherwise(0)).cast("double").alias("focal"),
    )
    share = F.coalesce(F.try_divide(F.col("focal") * 100.0, F.col("market")), F.lit(0.0))
    pairs_of = [
        ("sku_rows", pack), ("space_rows", spaces), ("membership_rows", pairs),
        ("market_value_latest", F.round("market", 2)), ("focal_value_latest", F.round("focal", 2)),
        ("focal_share_pct", F.round(share, 4)),
    ]
    numbers = one.select(
        F.inline(
            F.array(
                *[F.struct(F.lit(k).alias("key"), v.cast("double").alias("value")) for k, v in pairs_of]
            )
        )
    ).select("key", "value", F.to_json(F.struct("value")).alias("json"))
    texts = [] if source is None and as_of is None else [("built_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss"))]
    if as_of is not None:
        texts.append(("as_of", F.lit(as_of)))
    if source is not None:
        files = source_digests(m.cells.sparkSession, source)
        listed = F.array_sort(F.collect_list(F.struct("path", "sha256")))
        digest = F.sha2(F.array_join(F.transform(listed, lambda f: f["sha256"]), ","), 256)
        texts.append(("source_sha256", files.agg(digest.alias("d")).scalar()))
    if not texts:
        return numbers
    none = F.lit(None).cast("double").alias("value")
    rows = [F.struct(F.lit(k).alias("key"), none, F.to_json(F.struct(v.alias("value"))).alias("json")) for k, v in texts]
    return numbers.union(m.cells.sparkSession.range(1).select(F.inline(F.array(*rows))))


def _manifest(spark: SparkSession, path: str) -> list:
    """The published versions, newest first; a short list, as old versions expire."""
    rows = spark.read.schema(MANIFEST).json(f"{path}/manifest").where("sequence IS NOT NULL")
    return rows.orderBy(F.desc("sequence"), F.desc("version")).collect()


def _published(spark: SparkSession, path: str) -> list:
    try:
        return _manifest(spark, path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return []


def write_warehouse(
    m: Market,
    packs: DataFrame,
    path: str,
    keep: int = 2,
    source: str | None = None,
    as_of: str | None = None,
    version: str | None = None,
) -> str:
    """Write every table as a new version under ``path`` and publish it; returns the version.

    Each version has a folder of its own, and one line of the manifest, written last, makes it the
    one that readers see. A write that fails leaves the last version as it was, and a market read
    from ``path`` can be written back to it. ``packs`` is the derived pack table; membership stays
    a view over it. Versions older than the newest ``keep`` expire, folder and all.
    """
    spark = packs.sparkSession
    version = version or uuid.uuid4().hex
    folder = f"{path}/versions/{version}"
    tables = {
        "sku_facts": packs,
        "articles": m.articles,
        "cells": m.cells,
        "company_cells": m.companies,
        "space_facts": m.space_facts,
        "company_facts": m.company_facts,
        "brand_facts": m.brand_facts,
        "build_metadata": build_metadata(m, source, as_of),
    }
    for name in TABLES:
        if not _written(spark, f"{folder}/{name}"):
            tables[name].write.mode("errorifexists").parquet(f"{folder}/{name}")
    older = _published(spark, path)
    sequence = older[0]["sequence"] + 1 if older else 1
    line = spark.createDataFrame([(sequence, version, list(TABLES))], MANIFEST)
    line.coalesce(1).write.mode("append").json(f"{path}/manifest")
    for row in older[max(keep - 1, 0) :]:
        _delete(spark, f"{path}/versions/{row['version']}")
    return version


def build_warehouse(
    facts: DataFrame,
    focal_company: str,
    path: str,
    signals: DataFrame | None = None,
    keep: int = 2,
    source: str | None = None,
    as_of: str | None = None,
    **config,
) -> Market:
    """Facts to a published warehouse. The facts are scanned once, into the version's pack table;
    the market is built from that."""
    spark, version = facts.sparkSession, uuid.uuid4().hex
    packs_path = f"{path}/versions/{version}/sku_facts"
    derive(facts, focal_company).write.mode("errorifexists").parquet(packs_path)
    packs = spark.read.parquet(packs_path)
    m = Market.build(packs, focal_company, signals, **config)
    write_warehouse(m, packs, path, keep, source, as_of, version)
    return m


def _written(spark: SparkSession, folder: str) -> bool:
    """Whether a table lies there, whole: Spark marks it when its job has ended."""
    path, files = _file_system(spark, f"{folder}/_SUCCESS")
    return files.exists(path)


def _file_system(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _delete(spark: SparkSession, folder: str) -> None:
    path, files = _file_system(spark, folder)
    files.delete(path, True)


def read_warehouse(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Every table of the newest version plus the membership view; raises naming all missing tables."""
    versions = _published(spark, path)
    folder = f"{path}/versions/{versions[0]['version']}" if versions else path
    missing = [name for name in TABLES if not versions or not _written(spark, f"{folder}/{name}")]
    if missing:
        raise WarehouseMissing(f"{path} lacks {', '.join(missing)}; build it again")
    out = {name: spark.read.parquet(f"{folder}/{name}") for name in TABLES}
    out["space_membership"] = membership(out["sku_facts"])
    return out


def market_from_warehouse(spark: SparkSession, path: str, signals=None, **config) -> Market:
    """The newest version as a market; its written tables are used as they are."""
    tables = read_warehouse(spark, path)
    m = Market(tables["cells"], tables["articles"], signals, **config)
    m.companies = tables["company_cells"]
    for name in ("space_facts", "company_facts", "brand_facts"):
        setattr(m, name, tables[name])
    return m


def _flat(df: DataFrame) -> DataFrame:
    """CSV holds no arrays."""
    return df.select(
        *[
            F.to_json(f.name).alias(f.name) if f.dataType.typeName() in ("array", "struct", "map")
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def export(m: Market, facts: DataFrame, path: str) -> None:
    """Scorecard, excluded spaces and company facts as CSV; metadata and citations as JSON."""
    scored, excluded = m.scorecard()
    for name, df in (("scorecard", scored), ("excluded_spaces", excluded),
                     ("company_facts", m.company_facts)):
        _flat(df).write.mode("overwrite").option("header", True).csv(f"{path}/{name}")
    build_metadata(m).write.mode("overwrite").json(f"{path}/metadata")
    m.totals.write.mode("overwrite").json(f"{path}/totals")
    if m.signals is not None:
        citations(m.signals).write.mode("overwrite").json(f"{path}/citations")
