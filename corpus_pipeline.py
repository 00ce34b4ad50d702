"""The corpus pipeline: toxicity, exact and near duplicates, benchmark passages, token ids.

Each stage gets the documents that the stage before it kept, reread from Parquet, and returns
all columns of the documents that stay; the last returns the token digests of what remains.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from rowmark.functions.identity import unused_name
from rowmark.llm._common import written
from rowmark.llm._repeats import row_keys
from rowmark.llm.bpe import token_digests
from rowmark.llm.decontamination import judged
from rowmark.llm.exact_dedup import exact_duplicates
from rowmark.llm.near_dedup import NearDuplicates
from rowmark.llm.toxicity import scored

#: Common shingles of near copies, per cent of all shingles of both; op3_near_dedup has its own figure.
NEAR_PERCENT = 80

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _matched(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Documents by doc_id (null is an id) and text_key, the hash of the text, with all their columns."""
    text, named, keyed = (unused_name(docs, n) for n in ("_text_key", "_matched_id", "_matched_text"))
    keys = keys.select(F.col("doc_id").alias(named), F.col("text_key").alias(keyed))
    by = F.col("doc_id").eqNullSafe(F.col(named)) & (F.col(text) == F.col(keyed))
    return docs.withColumn(text, row_keys()[1]).join(keys, by, how).drop(text)


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the toxicity machine, trained on the labels, rejects go."""
    rows = scored(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _matched(docs, rows.where("predicted = 0"), "left_semi")


def without_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays, also of rows that repeat an id or have none."""
    found = written(exact_duplicates(docs))
    digest, named, text = (unused_name(docs, n) for n in ("_digest", "_matched_id", "_matched_text"))
    normal = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " ")

    def matched(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        keys = keys.select(F.col("doc_id").alias(named), F.col("text_sha256").alias(text))
        return rows.join(keys, F.col("doc_id").eqNullSafe(F.col(named)) & (F.col(digest) == F.col(text)), how)

    kept = matched(docs.withColumn(digest, F.sha2(normal, 256)), found.where("kept"), "left_semi")
    times = found.groupBy("doc_id", "text_sha256").agg(F.count("*").alias("times"))
    repeated = written(times.where("times > 1"))
    again = matched(kept, repeated, "left_semi").dropDuplicates(["doc_id", digest])
    return matched(kept, repeated, "left_anti").unionByName(again).drop(digest)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays, also of rows that repeat an id or have none."""
    stay = written(NearDuplicates(docs, NEAR_PERCENT).representatives())
    copied = F.col("linked") & (F.col("times") > 1)
    again = _matched(docs, stay.where(copied), "left_semi")
    text = unused_name(docs, "_text_key")
    again = again.withColumn(text, row_keys()[1]).dropDuplicates(["doc_id", text]).drop(text)
    return _matched(docs, stay.where(~copied), "left_semi").unionByName(again)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark window go."""
    found = judged(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _matched(docs, found.where("NOT contaminated"), "left_semi")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_digests(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", without_toxic),
    ("exact_dedup", without_exact_copies),
    ("near_dedup", without_near_copies),
    ("benchmark_decontamination", without_benchmark),
    ("bpe", tokens),
]

#: Training a machine and merging bytes are nothing that SQL can express; tests use brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
