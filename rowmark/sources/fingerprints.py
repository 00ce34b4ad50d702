"""Fingerprints of files and of table contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rowmark.functions.identity import canonical_json
from rowmark.sources.files import exists


def _digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def file_fingerprint(spark: SparkSession, path: str) -> DataFrame:
    """One row `fingerprint` from path, size and change time of a file, or of all files below.

    Only the listing is read. One file gives the digest of its own entry; more are summed,
    so neither their order nor their number has to fit one task.
    """
    entries = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(path)
        .select(
            F.to_json(
                F.struct(
                    (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"),
                    F.regexp_replace("path", "^file:/*", "/").alias("path"),
                    F.col("length").alias("size"),
                )
            ).alias("entry")
        )
    )
    return entries.agg(
        F.count(F.lit(1)).alias("files"),
        F.sum(F.xxhash64("entry").cast("decimal(38,0)")).alias("total"),
        F.min("entry").alias("only"),
    ).select(
        F.when(F.col("files") == 1, _digest(F.col("only")))
        .otherwise(_digest(F.concat_ws(":", "files", "total")))
        .alias("fingerprint")
    )


def dataset_fingerprint(
    df: DataFrame, name: str, config: str | None = None, split: str | None = None
) -> DataFrame:
    """One row `fingerprint` from the dataset's name, row count and contents.

    Contents enter as a sum over row hashes (their first 60 bits): the order of rows and
    files does not matter, repeated rows do.
    """
    return summed_fingerprint(content_sums(df), name, config, split)


def content_sums(df: DataFrame, by: Column | None = None) -> DataFrame:
    """row_count and content (sum of row hashes); sums of parts add up to that of the whole.

    With `by` one row for each of its values, in a column `part`.
    """
    row_number = F.conv(F.substr(F.sha2(canonical_json(df), 256), F.lit(1), F.lit(15)), 16, 10)
    sums = [
        F.count(F.lit(1)).alias("row_count"),
        F.coalesce(F.sum(row_number.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("content"),
    ]
    return df.agg(*sums) if by is None else df.groupBy(by.alias("part")).agg(*sums)


def summed_fingerprint(sums: DataFrame, name: str, config: str | None = None, split: str | None = None) -> DataFrame:
    """The fingerprint of a dataset from the sums of its parts."""
    content = sums.agg(F.coalesce(F.sum("row_count"), F.lit(0)).alias("row_count"), F.sum("content").alias("content"))
    identity = F.to_json(
        F.struct(
            F.lit(config).cast("string").alias("config_name"),
            F.coalesce(F.col("content"), F.lit(0)).cast("decimal(38,0)").cast("string").alias("dataset_fingerprint"),
            F.lit(name).alias("dataset_name"),
            F.col("row_count"),
            F.lit(split).cast("string").alias("split"),
        ),
        {"ignoreNullFields": "false"},
    )
    return content.select(_digest(identity).alias("fingerprint"))


def growing_fingerprint(
    spark: SparkSession, folder: str, store: str, name: str, config: str | None = None, split: str | None = None
) -> DataFrame:
    """The fingerprint of a folder of Parquet files that grows: what `dataset_fingerprint` gives.

    The sums of every file are kept under `store`, by path, length and change time, so only files
    that are new or changed are read. The files must have one schema.
    """
    listed = (
        spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(folder)
        .select(F.col("_metadata.file_path").alias("part"), "length", F.unix_micros("modificationTime").alias("changed"), "path")
    )
    schema = "part STRING, length BIGINT, changed BIGINT, row_count BIGINT, content DECIMAL(38,0)"
    kept = spark.read.schema(schema).parquet(store) if exists(spark, store) else spark.createDataFrame([], schema)
    key = ["part", "length", "changed"]
    fresh = {row.part: row.path for row in listed.join(kept, key, "left_anti").select("part", "path").collect()}
    if fresh:
        rows = spark.read.parquet(*fresh.values())
        parts = content_sums(rows, F.col("_metadata.file_path"))
        # A file without rows has no sums.
        found = listed.where(F.col("part").isin(list(fresh))).join(parts, "part", "left")
        zero = F.lit(0).cast("decimal(38,0)")
        found = found.select(*key, F.coalesce("row_count", F.lit(0)).alias("row_count"), F.coalesce("content", zero).alias("content"))
        found.write.mode("append").parquet(store)
        kept = spark.read.schema(schema).parquet(store)
    present = kept.dropDuplicates(key).join(listed, key, "left_semi")
    return summed_fingerprint(present.select("row_count", "content"), name, config, split)
