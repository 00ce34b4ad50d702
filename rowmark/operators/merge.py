"""Merge annotation sets: new records, repeats, conflicts, report.

Annotation frames here have at least `annotation_id`; `source` also has a position
column that says which of two equal ids came first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rowmark.checkpoints import checkpoint_folder
from rowmark.functions.identity import POSITION


def merge_id(df: DataFrame) -> Column:
    """Ids as compared: records without an id all share one."""
    return F.coalesce(F.col("annotation_id"), F.lit("None"))


def _first_positions(target: DataFrame | None, source: DataFrame, position: str) -> DataFrame:
    """Positions of the source records to keep, for records whose id is not empty.

    The narrow (id, position) pairs are reduced to one row per id before anything meets
    in a join, so an id that fills a third of the log costs one row per task.
    """
    firsts = (
        source.select(merge_id(source).alias("_id"), F.col(position).alias("_first"))
        .filter("_id <> ''")
        .groupBy("_id")
        .agg(F.min("_first").alias("_first"))
    )
    if target is not None:
        present = target.select(merge_id(target).alias("_id")).distinct()
        firsts = firsts.join(present, "_id", "left_anti")
    return firsts.select("_first")


def _kept(target: DataFrame | None, source: DataFrame, position: str) -> DataFrame:
    # Whole records move only in this join, and its key is unique.
    firsts = _first_positions(target, source, position)
    without_id = F.col("annotation_id") == ""
    return (
        source.filter(F.coalesce(~without_id, F.lit(True)))
        .join(firsts, F.col(position) == F.col("_first"), "left_semi")
        .unionByName(source.filter(without_id))
    )


def first_per_id(source: DataFrame, position: str = POSITION) -> DataFrame:
    """The first record of each id; records with an empty id all stay."""
    return _kept(None, source, position)


def import_new(target: DataFrame, source: DataFrame, position: str = POSITION) -> DataFrame:
    """First records of ids that the target lacks; records with an empty id all stay."""
    return _kept(target, source, position)


def log_order(position: str = POSITION) -> list[Column]:
    """Order in which new records are appended to a log."""
    return [
        F.coalesce("created_at", F.lit("")).asc(),
        F.coalesce("annotation_id", F.lit("")).asc(),
        F.col(position).asc(),
    ]


def merge(target: DataFrame, source: DataFrame, position: str = POSITION) -> DataFrame:
    """Target records and the new ones from the source, contents unchanged."""
    return target.unionByName(import_new(target, source, position), allowMissingColumns=True)


def row_key(df: DataFrame) -> Column:
    """What identifies the annotated row: its id, else its key fields as JSON."""
    fields = F.to_json("row_ref.key_fields")
    no_fields = fields.isin("null", "[]", '""', "0", "false")
    return F.coalesce(
        F.nullif(F.col("row_ref.row_id"), F.lit("")),
        F.when(~no_fields, fields),
        F.lit("{}"),
    )


def label_range(annotations: DataFrame, key: Column | None = None) -> DataFrame:
    """Lowest and highest label of each group of task, row and row hash.

    Each task sends on one row per group however often a row was labelled.
    """
    labelled = annotations.filter("task_type <> '' AND label <> ''").select(
        "task_type",
        (row_key(annotations) if key is None else key).alias("row_key"),
        F.coalesce("row_hash", F.lit("")).alias("row_hash"),
        "label",
    )
    return labelled.groupBy("task_type", "row_key", "row_hash").agg(
        F.min("label").alias("lowest_label"), F.max("label").alias("highest_label")
    )


def conflict_groups(annotations: DataFrame, key: Column | None = None) -> DataFrame:
    """Groups of task, row and row hash that carry more than one label, told by their lowest and
    highest label."""
    return label_range(annotations, key).filter("lowest_label <> highest_label")


def conflict_count(annotations: DataFrame, key: Column | None = None) -> DataFrame:
    return conflict_groups(annotations, key).agg(F.count(F.lit(1)).alias("conflict_count"))


def narrow_logs(target: DataFrame, source: DataFrame, position: str = POSITION) -> DataFrame:
    """What counting and choosing need of two logs, in one stored frame; reads each log once, right here."""

    def narrow(df: DataFrame, place: Column, is_source: bool) -> DataFrame:
        created = F.col("created_at") if "created_at" in df.columns else F.lit(None).cast("string")
        named = df.select(
            "annotation_id", "task_type", "label", row_key(df).alias("row_key"), "row_hash", created.alias("created_at"), place.alias("place")
        )
        return named.withColumn("is_source", F.lit(is_source))

    checkpoint_folder(target.sparkSession)
    return narrow(target, F.lit(None).cast("bigint"), False).unionByName(narrow(source, F.col(position), True)).checkpoint()


def new_records(both: DataFrame) -> DataFrame:
    """annotation_id, created_at, place of the source records to import, from `narrow_logs`."""
    kept = import_new(both.filter("NOT is_source"), both.filter("is_source"), "place")
    return kept.select("annotation_id", "created_at", "place")


def import_report(
    target: DataFrame, source: DataFrame, position: str = POSITION
) -> DataFrame:
    """One row of counts for a merge, whether or not it is then written.

    Reads both logs right here, once.
    """
    return report_of(narrow_logs(target, source, position))


def report_of(both: DataFrame) -> DataFrame:
    """The counts of a merge, from `narrow_logs`."""
    target, source, position = both.filter("NOT is_source"), both.filter("is_source"), "place"
    merged = target.unionByName(import_new(target, source, position))

    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")

    # Imported records are the first ones of new ids and those with an empty id.
    of_source = source.agg(
        F.count(F.lit(1)).alias("all"), F.count_if(F.col("annotation_id") == "").alias("without_id")
    ).selectExpr("stack(2, 'source_count', all, 'imported_count', without_id) AS (name, n)")
    counts = (
        of_source.unionAll(counted(target, "existing_count"))
        .unionAll(counted(_first_positions(target, source, position), "imported_count"))
        .unionAll(conflict_count(merged, F.col("row_key")).select(F.lit("conflict_count"), "conflict_count"))
    )

    def value(name: str) -> Column:
        return F.sum(F.when(F.col("name") == name, F.col("n"))).alias(name)

    return counts.agg(
        value("source_count"),
        value("existing_count"),
        value("imported_count"),
        value("conflict_count"),
    ).select(
        "source_count",
        "existing_count",
        "imported_count",
        (F.col("source_count") - F.col("imported_count")).alias("duplicate_count"),
        "conflict_count",
    )
