"""Summaries of annotation sets."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from rowmark.functions.identity import POSITION
from rowmark.functions.text import lowered, trimmed
from rowmark.operators.merge import conflict_count
from rowmark.sources.positions import rows_at

FACETS = ("label", "annotator", "task_type")
SAMPLE_SIZE = 5


def facet_condition(
    label: str | None = None, annotator: str | None = None, task_type: str | None = None
) -> Column:
    """Records whose facets equal the given values, ignoring case and outer blanks."""
    asked = {"label": label, "annotator": annotator, "task_type": task_type}
    tests = [
        lowered(F.coalesce(F.col(name), F.lit(""))) == value.strip().lower()
        for name, value in asked.items()
        if value is not None
    ]
    return reduce(and_, tests) if tests else F.lit(True)


def facet_filter(
    annotations: DataFrame,
    label: str | None = None,
    annotator: str | None = None,
    task_type: str | None = None,
) -> DataFrame:
    if label is None and annotator is None and task_type is None:
        return annotations  # still known as a log just read
    return annotations.filter(facet_condition(label, annotator, task_type))


def facet_counts(annotations: DataFrame) -> DataFrame:
    """Records per label, per annotator and per task; empty values are left out.

    Records collapse to one row per combination before the three groupings.
    """
    combined = annotations.groupBy(*FACETS).agg(F.count(F.lit(1)).alias("n"))
    facet = F.explode(
        F.array(
            *(F.struct(F.lit(f).alias("facet"), F.col(f).alias("value")) for f in FACETS)
        )
    )
    return (
        combined.select(facet.alias("f"), "n")
        .filter("f.value <> ''")
        .groupBy("f.facet", "f.value")
        .agg(F.sum("n").alias("records"))
    )


def time_range(annotations: DataFrame) -> DataFrame:
    """First and last creation time, compared as text; blanks are skipped."""
    created = F.nullif(F.col("created_at"), F.lit(""))
    return annotations.agg(
        F.min(created).alias("first_created_at"), F.max(created).alias("last_created_at")
    )


def duplicate_ids(annotations: DataFrame) -> DataFrame:
    """Ids that occur more than once."""
    return (
        annotations.groupBy(trimmed(F.col("annotation_id")).alias("annotation_id"))
        .agg(F.count(F.lit(1)).alias("records"))
        .filter("annotation_id <> '' AND records > 1")
    )


def record_counts(
    annotations: DataFrame,
    label: str | None = None,
    annotator: str | None = None,
    task_type: str | None = None,
) -> DataFrame:
    kept = facet_condition(label, annotator, task_type)
    return annotations.agg(
        F.count(F.lit(1)).alias("total_records"), F.count_if(kept).alias("filtered_records")
    )


def sample_annotations(
    annotations: DataFrame, n: int = SAMPLE_SIZE, position: str = POSITION
) -> DataFrame:
    """First n records in log order.

    Of a log as it was read only the files that hold them are read.
    """
    if n > 0 and position == POSITION and (held := rows_at(annotations, 0, n)) is not None:
        return held
    return annotations.orderBy(position).limit(max(n, 0))


def summary(
    annotations: DataFrame,
    label: str | None = None,
    annotator: str | None = None,
    task_type: str | None = None,
) -> DataFrame:
    """The whole report as rows (section, name, value), text values throughout.

    Every part reads the same narrow columns; cache the annotations first when they come
    from JSON.
    """
    kept = facet_condition(label, annotator, task_type)
    filtered = annotations.filter(kept)
    created = F.when(kept, F.nullif(F.col("created_at"), F.lit("")))
    totals = annotations.agg(
        F.count(F.lit(1)).cast("string").alias("total_records"),
        F.count_if(kept).cast("string").alias("filtered_records"),
        F.min(created).alias("first_created_at"),
        F.max(created).alias("last_created_at"),
    ).select(
        F.explode(
            F.array(
                *(
                    F.struct(
                        F.lit(section).alias("section"), F.lit(name).alias("name"),
                        F.col(name).alias("value"),
                    )
                    for section, name in (
                        ("counts", "total_records"),
                        ("counts", "filtered_records"),
                        ("stats", "first_created_at"),
                        ("stats", "last_created_at"),
                    )
                )
            )
        ).alias("r")
    ).select("r.*")
    repeats = duplicate_ids(filtered).agg(F.count(F.lit(1)).cast("string").alias("value"))
    clashes = conflict_count(filtered).select(F.col("conflict_count").cast("string").alias("value"))

    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.lit("counts").alias("section"), F.lit(name).alias("name"), "value")

    facets = facet_counts(filtered).select(
        F.concat(F.lit("by_"), "facet").alias("section"),
        F.col("value").alias("name"),
        F.col("records").cast("string").alias("value"),
    )
    return (
        totals.unionByName(counted(repeats, "duplicate_annotation_ids"))
        .unionByName(counted(clashes, "row_label_conflicts"))
        .unionByName(facets)
    )
