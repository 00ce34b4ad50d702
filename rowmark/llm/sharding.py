"""Shards by weighted rendezvous hashing (DataFrame functions only).

Each (record key, shard) pair gets a pseudo-random number u in (0, 1) from a stable hash; the
record goes to the shard with the largest -weight / ln(u). Adding a shard moves a record only
into that shard, removing one moves only its own records, and shares follow the weights.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

_UNIT = float(1 << 53)


def rendezvous(key: Column | str, weights: Sequence[float], seed: int = 17) -> Column:
    """The shard 0..len(weights)-1 of a record key. A null key is a key like any other.

    Of equal scores, the lower shard wins. With equal weights the hashes are compared as they are.
    """
    if not weights or any(not w > 0 or math.isinf(w) for w in weights):
        raise ValueError("Weights must be positive numbers, at least one.")
    key = F.col(key) if isinstance(key, str) else key
    key = F.struct(key.isNull(), key)
    equal = len(set(weights)) == 1
    scores = []
    for shard, weight in enumerate(weights):
        bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(shard), key), 11)
        if equal:
            score = bits
        else:
            score = F.lit(-float(weight)) / F.log((bits.cast("double") + 0.5) / F.lit(_UNIT))
        scores.append(F.struct(score.alias("score"), F.lit(-shard).alias("shard")))
    best = scores[0] if len(scores) == 1 else F.greatest(*scores)
    return -best["shard"]


def with_slots(df: DataFrame, shard: str, order: Sequence[str], slot: str = "slot", blocks: int | None = None) -> DataFrame:
    """Number the rows of each shard 0, 1, 2, ... without gaps or one task per shard.

    Rows are numbered within (shard, block), a block being a hash bucket of the order columns
    and of the scan's partition; blocks are lined up by a running sum over their counts.
    Equal rows are numbered in any order.
    """
    blocks = blocks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = {"_sh_block", "_sh_rank", "_sh_before"} & set(df.columns)
    if names:
        raise ValueError(f"Reserved column names: {sorted(names)}")
    df = df.withColumn("_sh_block", F.pmod(F.xxhash64(F.spark_partition_id(), *order), F.lit(blocks)).cast("int"))
    rank = F.row_number().over(Window.partitionBy(shard, "_sh_block").orderBy(*order)) - 1
    before = F.sum("count").over(
        Window.partitionBy(shard).orderBy("_sh_block").rowsBetween(Window.unboundedPreceding, -1)
    )
    counts = df.groupBy(shard, "_sh_block").count()
    offsets = counts.select(shard, "_sh_block", F.coalesce(before, F.lit(0)).alias("_sh_before"))
    return (
        df.withColumn("_sh_rank", rank)
        .join(offsets, [shard, "_sh_block"])
        .withColumn(slot, (F.col("_sh_rank") + F.col("_sh_before")).cast("long"))
        .drop("_sh_block", "_sh_rank", "_sh_before")
    )


def shard_documents(documents: DataFrame, weights: Sequence[float], grown: Sequence[float] | None = None, seed: int = 17) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document.

    The law is `key`: doc_id and the weights alone decide, so equal texts with different ids lie
    in different shards, and a third of all rows with one id lies in one shard. Null text: size
    16, checksum 0. Null ids form a key of their own. Empty table: no rows. Other columns are
    ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = documents.select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous("doc_id", weights, seed).cast("int").alias("shard"),
        (rendezvous("doc_id", grown, seed) if grown else F.lit(None)).cast("int").alias("grown_shard"),
    )
    placed = with_slots(rows, "shard", ["doc_id", "text_crc32", "size"])
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op8_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return shard_documents(documents, [1.0] * 40, [1.0] * 41)
