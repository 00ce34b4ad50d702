"""Annotation logs and label tables derived from the given tables.

Each frame has its counterpart in SQL in `expected.py`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# Positions of the second part of a two-part log start here.
SECOND_PART = 10**12

#: Records of a file of a feed, so that sorting one fits a task.
FEED_FILE_RECORDS = 250_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_files(df: DataFrame, least: int) -> DataFrame:
    """Rows dealt out to be written as `least` files, or as many as tasks scan them, if those are more."""
    return df.repartition(max(least, df.rdd.getNumPartitions()))


def in_feed_files(log: DataFrame, least: int) -> DataFrame:
    """A log in its order, to be written as `least` files, or more if those would be large."""
    files = max(least, -(-log.count() // FEED_FILE_RECORDS))
    return log.repartitionByRange(files, "pos").sortWithinPartitions("pos")


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One annotation per event: users label what they met; two event types have no row id."""
    day = F.date_format("ts", "yyyy-MM-dd")
    key_fields = F.to_json(F.struct(day.alias("day"), "user_id"))
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("pos"),
        F.concat(F.lit("e"), "event_id").alias("annotation_id"),
        F.when(F.col("value") < 50, "preference").otherwise("classification").alias("task_type"),
        F.col("event_type").alias("label"),
        F.struct(
            F.col("event_id").alias("row_index"),
            F.when(F.col("event_type") == "view", "")
            .when(F.col("event_type") != "error", F.col("user_id").cast("string"))
            .alias("row_id"),
            F.parse_json(key_fields).alias("key_fields"),
        ).alias("row_ref"),
        day.alias("row_hash"),
        F.concat(F.lit("u"), F.right(F.col("user_id").cast("string"), F.lit(1))).alias("annotator"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"),
    )


def order_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One annotation per order, with repeated ids, missing ids and empty ids."""
    return table(spark, sf_dir, "orders").select(
        (F.col("o_orderkey") + SECOND_PART).alias("pos"),
        F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "")
        .when(F.col("o_orderpriority") != "5-LOW", F.concat(F.lit("c"), "o_custkey"))
        .alias("annotation_id"),
        F.lit("preference").alias("task_type"),
        F.col("o_orderstatus").alias("label"),
        F.struct(
            F.col("o_orderkey").alias("row_index"),
            F.col("o_custkey").cast("string").alias("row_id"),
            F.parse_json(F.lit("{}")).alias("key_fields"),
        ).alias("row_ref"),
        F.date_format("o_orderdate", "yyyy").alias("row_hash"),
        F.concat(F.lit("Clerk "), F.left("o_orderpriority", F.lit(1))).alias("annotator"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"),
    )


def incoming_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log to merge into the event log: all of it again, then the orders."""
    return event_log(spark, sf_dir).unionByName(order_log(spark, sf_dir))


def flat(log: DataFrame) -> DataFrame:
    """A log with its row id in a column of its own, comparable with SQL."""
    return log.select(
        "pos", "annotation_id", "task_type", "label", F.col("row_ref.row_id").alias("row_id"),
        "row_hash", "annotator", "created_at",
    )


def full_records(log: DataFrame) -> DataFrame:
    """A log with all fields of an annotation record."""
    empty = F.parse_json(F.lit("{}"))
    return log.select(
        F.lit("1.0").alias("schema_version"), "annotation_id", F.lit("b1").alias("bundle_id"),
        F.lit("sha256:f1").alias("dataset_fingerprint"), "task_type", "label",
        empty.alias("payload"), "row_ref", "row_hash", empty.alias("row_data"), "annotator",
        F.lit(None).cast("string").alias("note"), "created_at",
        F.lit(None).cast("string").alias("updated_at"), F.lit("create").alias("event_type"),
        "pos",
    )


def spelled_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types as people would type them: other cases, blanks around."""
    spelled = (
        F.when(F.col("value") > 100, F.upper("event_type"))
        .when(F.col("value") > 50, F.concat(F.lit("  "), "event_type", F.lit(" ")))
        .otherwise(F.col("event_type"))
    )
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("pos"),
        F.when(F.col("user_id") < 50, "preference").otherwise("classification").alias("task_type"),
        spelled.alias("label"),
    )


def curated_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vocabulary that already knows two event types, in spellings of its own."""
    return (
        table(spark, sf_dir, "events")
        .filter(F.col("event_type").isin("click", "view"))
        .select(
            F.when(F.col("user_id") < 50, "preference").otherwise("classification").alias("task_type"),
            F.initcap("event_type").alias("label"),
            F.col("event_id").alias("pos"),
        )
        .groupBy("task_type", "label")
        .agg(F.min("pos").alias("pos"))
    )


def brand_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as labels of part types."""
    return (
        table(spark, sf_dir, "part")
        .groupBy(F.col("p_type").alias("task_type"), F.col("p_brand").alias("label"))
        .agg(F.min("p_partkey").alias("pos"))
    )


def segment_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands of small parts and market segments, as labels of the same tasks and of new ones."""
    small = (
        table(spark, sf_dir, "part")
        .filter("p_size <= 10")
        .select(
            F.col("p_type").alias("task_type"),
            F.when(F.col("p_name").contains("ring"), F.upper("p_brand"))
            .otherwise(F.col("p_brand"))
            .alias("label"),
            F.col("p_partkey").alias("pos"),
        )
    )
    segments = table(spark, sf_dir, "customer").select(
        F.lit("segment").alias("task_type"),
        F.col("c_mktsegment").alias("label"),
        F.col("c_custkey").alias("pos"),
    )
    return small.unionByName(segments).groupBy("task_type", "label").agg(F.min("pos").alias("pos"))


def size_codes(spark: SparkSession, sf_dir: str, low: int, high: int, last: bool) -> DataFrame:
    """Codes low..high of each part type: the first or last brand of that size."""
    choose = F.max_by if last else F.min_by
    edge = F.max if last else F.min
    return (
        table(spark, sf_dir, "part")
        .filter(F.col("p_size").between(low, high))
        .groupBy(F.col("p_type").alias("task_type"), F.col("p_size").cast("string").alias("key"))
        .agg(choose("p_brand", "p_partkey").alias("label"), edge("p_partkey").alias("pos"))
        .select("task_type", "key", "pos", "label")
    )


def loose_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a text column that holds numbers, JSON text and nulls."""
    text = F.when(F.col("event_type") == "error", F.col("props")).when(
        F.col("event_type") != "view", F.col("value").cast("string")
    )
    return table(spark, sf_dir, "events").select("event_id", text.alias("loose"))


def balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers, one market segment of which has no balance."""
    known = F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_acctbal"))
    return table(spark, sf_dir, "customer").withColumn("c_acctbal", known)
