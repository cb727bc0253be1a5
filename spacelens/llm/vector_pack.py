"""Sharding by vector bin packing: bytes, words and rows are balanced together.

Equal texts form a group and stay together as far as the law allows. A group of more than a
``1 / (shards * grain)`` share of all bytes is cut into parts of about that size by a hash of the
id and the row's place in its input split, so rows without an id or with the same one part too; all other groups are gathered by hash into a fixed number of cells. What is packed is
therefore a table of bounded length, whatever the input: at most ``cells`` cells and
``2 * shards * grain`` parts. They are placed largest first, each into the shard where the dot
product of its (bytes, words, rows) with the shard's residual capacity is highest.

Defined cases: a null text has 1 byte, no words and no crc32, and all null texts are one group;
repeated rows have slots of their own; ties go to the smaller cell and shard; an empty table gives
an empty result. Input columns of any name are kept in the struct ``row``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spacelens.llm.words import packed, word_count
from spacelens.sources.stage import stage

MEASURES = ("bytes", "words", "rows")


@dataclass(frozen=True)
class PackConfig:
    """importance: weight of bytes, words and rows in the dot product."""

    shards: int = 16
    grain: int = 64
    cells: int = 4096
    importance: tuple[float, float, float] = (1.0, 0.2, 0.2)


def pack(items: np.ndarray, shards: int, importance) -> np.ndarray:
    """Shard of each item; ``items`` has a row of measures each.

    Measures count as shares of their totals. A shard's residual capacity is its even share less
    what it holds; it may be negative, which only makes the shard less welcome.
    """
    total = items.sum(axis=0)
    share = items / np.where(total > 0, total, 1)
    weight = np.asarray(importance, float)
    residual = np.full((shards, items.shape[1]), 1.0 / shards)
    out = np.zeros(len(items), np.int64)
    for i in np.argsort(-(share @ weight), kind="stable"):
        out[i] = shard = int(np.argmax((residual * weight) @ share[i]))
        residual[shard] -= share[i]
    return out


def sized(docs: DataFrame, payload: bool = True) -> DataFrame:
    """Every row in ``row`` (only its id without ``payload``), its measures and its text's key."""
    text = F.col("row.text")
    return packed(docs).select(
        F.col("row") if payload else F.struct("row.doc_id").alias("row"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("bytes"),
        word_count(text).alias("words"),
        F.lit(1).cast("long").alias("rows"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("key"),
        F.xxhash64(F.col("row.doc_id").cast("string")).alias("salt"),
        # Fixed once the table is written.
        F.xxhash64(F.col("row.doc_id").cast("string"), F.monotonically_increasing_id()).alias("deal"),
    )


def assigned(docs: DataFrame, config: PackConfig = PackConfig(), payload: bool = True) -> DataFrame:
    """Every row with its ``shard`` and its ``slot`` there.

    Ids, sizes and hashes are written once; the group sums, the items and the slots read that
    table. Only the packed items, of bounded number, reach the driver.
    """
    spark = docs.sparkSession
    rows = stage(sized(docs, payload), "pack-rows")
    total = F.sum("bytes").alias("total")
    unit = rows.agg(total).select((F.col("total") / (config.shards * config.grain)).alias("unit")).scalar()
    large = (
        rows.groupBy("key", "text_crc32")
        .agg(F.sum("bytes").alias("group_bytes"))
        .withColumn("unit", unit)
        .where(F.col("group_bytes") > F.col("unit"))
        .select(
            F.col("key").alias("_key"),
            F.col("text_crc32").alias("_crc"),
            F.ceil(F.col("group_bytes") / F.col("unit")).cast("long").alias("parts"),
        )
    )
    # Each large group has over a unit of the bytes, so there are at most shards * grain of them.
    same = (F.col("key") == F.col("_key")) & F.col("text_crc32").eqNullSafe(F.col("_crc"))
    cell = F.when(F.col("parts").isNull(), F.pmod("key", F.lit(config.cells))).otherwise(
        config.cells + F.pmod(F.xxhash64("key", F.pmod(F.col("deal"), F.col("parts"))), F.lit(1 << 40))
    )
    celled = rows.join(F.broadcast(large), same, "left").withColumn("cell", cell)
    items = celled.groupBy("cell").agg(*[F.sum(m).alias(m) for m in MEASURES]).orderBy("cell").toPandas()
    shard = pack(items[list(MEASURES)].to_numpy(float), config.shards, config.importance)
    items["shard"] = shard
    items["start"] = items.groupby("shard")["rows"].cumsum() - items["rows"]
    plan = spark.createDataFrame(
        [(int(c), int(s), int(a)) for c, s, a in zip(items["cell"], shard, items["start"])],
        "cell long, shard int, start long",
    )
    # Cells are bounded parts of the input, so numbering rows inside a cell is a short sort.
    order = Window.partitionBy("cell").orderBy("salt", "bytes", "key", "row.doc_id")
    numbered = celled.withColumn("_nth", F.row_number().over(order) - 1)
    return numbered.join(F.broadcast(plan), "cell").select(
        "row", "bytes", "text_crc32", "shard", (F.col("start") + F.col("_nth")).cast("long").alias("slot")
    )


def shard_table(docs: DataFrame, config: PackConfig = PackConfig()) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard), one row per document.

    The law is ``bytes``; a key law's shard after growth does not apply and is null.
    """
    out = assigned(docs.select("doc_id", "text"), config, payload=False)
    return out.select(
        "row.doc_id",
        F.col("bytes").alias("size"),
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, path: str, config: PackConfig = PackConfig()) -> None:
    """The documents as Parquet, a folder per shard, with their slots."""
    out = assigned(docs, config)
    out.select("row.*", "shard", "slot").write.partitionBy("shard").parquet(path)
