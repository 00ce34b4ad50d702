"""Merge a continuing feed of annotation files into a bundle."""

from __future__ import annotations

import hashlib
import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from rowmark.functions.identity import POSITION
from rowmark.operators.annotate import ANNOTATION_SCHEMA
from rowmark.sources.bundles import append_new
from rowmark.sources.files import read_small_text


def annotation_feed(
    spark: SparkSession, folder: str, files_per_batch: int | None = None
) -> DataFrame:
    """Annotation files as they arrive in a folder; a bad line stops the stream.

    One micro-batch of `merge_feed` takes all files that have arrived, unless `files_per_batch`
    asks for smaller ones.
    """
    reader = spark.readStream.schema(ANNOTATION_SCHEMA).option("mode", "FAILFAST")
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(folder)


def recent_repeats_dropped(feed: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The feed without ids already seen within `delay`; bounded state, forgets older ids.

    Only for feeds whose records all have an id.
    """
    created = F.to_timestamp("created_at", "yyyy-MM-dd'T'HH:mm:ssX")
    return (
        feed.withColumn("created_ts", created)
        .withWatermark("created_ts", delay)
        .dropDuplicatesWithinWatermark(["annotation_id"])
    )


def merge_feed(feed: DataFrame, bundle_path: str, checkpoint: str) -> StreamingQuery:
    """Append the feed's new records to a bundle, checked against all ids of its log.

    The ids are looked up in the bundle's index, so a micro-batch reads no log line but those of
    batches that were appended without being indexed.

    Runs over what has arrived, then stops. Of equal ids in a micro-batch the first in file order
    stays. A micro-batch is committed under a token of the files it was read from: run again, it
    is found committed and adds nothing; batches of other feeds are never touched. After a lost
    checkpoint the ids decide, and records without an id come again if the files are batched
    differently. Feeds that do not come from files are told apart by query and batch number.
    """
    from_files = _has_file_names(feed)
    placed_feed = feed.select("*", *_file_place()) if from_files else feed

    def merge_batch(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        order = [F.col(c) for c in ("_feed_file", "_feed_start")] if from_files else []
        arrived = F.monotonically_increasing_id()
        # Held for the uses below, so that positions are the same in all of them.
        sorted_batch = batch.withColumn("_feed_row", arrived).orderBy(*order, "_feed_row") if order else batch
        placed = sorted_batch.withColumn(POSITION, F.monotonically_increasing_id()).persist()
        try:
            if from_files:
                sources = placed.select("_feed_file", "_feed_time").distinct()
                known = sources.agg(
                    F.count("*"), F.sum(F.xxhash64("_feed_file", "_feed_time").cast("decimal(38,0)"))
                ).first()
                token = hashlib.sha256(f"files {known[0]} {known[1]}".encode()).hexdigest()
            else:
                query = json.loads(read_small_text(spark, f"{checkpoint}/metadata"))["id"]
                token = hashlib.sha256(f"query {query} {number}".encode()).hexdigest()
            append_new(placed, bundle_path, token)
        finally:
            placed.unpersist()

    return (
        placed_feed.writeStream.foreachBatch(merge_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _file_place() -> tuple[Column, ...]:
    return (
        F.col("_metadata.file_path").alias("_feed_file"),
        F.col("_metadata.file_block_start").alias("_feed_start"),
        F.col("_metadata.file_modification_time").alias("_feed_time"),
    )


def _has_file_names(feed: DataFrame) -> bool:
    try:
        feed.select(*_file_place()).schema  # noqa: B018  resolves the names
    except AnalysisException:
        return False
    return True
