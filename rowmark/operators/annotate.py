"""Annotation records for many rows at once."""

from __future__ import annotations

import json
import os
import uuid
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from rowmark.functions.text import label_key, trimmed

SCHEMA_VERSION = "1.0"

# The fields of an annotation record.
ANNOTATION_SCHEMA = (
    "schema_version STRING, annotation_id STRING, bundle_id STRING, dataset_fingerprint STRING, "
    "task_type STRING, label STRING, payload VARIANT, "
    "row_ref STRUCT<row_index: BIGINT, row_id: STRING, key_fields: VARIANT>, "
    "row_hash STRING, row_data VARIANT, annotator STRING, note STRING, created_at STRING, "
    "updated_at STRING, event_type STRING"
)
ANNOTATION_FIELDS = (
    "schema_version", "annotation_id", "bundle_id", "dataset_fingerprint", "task_type", "label",
    "payload", "row_ref", "row_hash", "row_data", "annotator", "note", "created_at", "updated_at",
    "event_type",
)


def utc_now(df: DataFrame) -> Column:
    zone = df.sparkSession.conf.get("spark.sql.session.timeZone")
    moment = F.to_utc_timestamp(F.current_timestamp(), zone)
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def annotator_name(name: str | None = None) -> str:
    """The given name, else that of the account, else `unknown`."""
    named = (n.strip() for n in (name, os.environ.get("USER")) if n)
    return next(named, "") or "unknown"


def known_spelling(vocab: DataFrame, task: str, label: str) -> DataFrame:
    """One value: the spelling the task's vocabulary already has for a label, or null."""
    return vocab.filter(
        (F.col("task_type") == task) & (label_key(F.col("label")) == label_key(F.lit(label)))
    ).agg(F.min_by("label", "pos").alias("label"))


def annotate(
    records: DataFrame,
    label: str | Column,
    bundle_id: str,
    fingerprint: str,
    task: str | Column = "preference",
    annotator: str | Column | None = None,
    note: str | None = None,
    payload: dict[str, Any] | None = None,
    created_at: str | Column | None = None,
    event_type: str = "create",
    run_id: str | None = None,
    vocab: DataFrame | None = None,
) -> DataFrame:
    """One annotation record per row record, holding a snapshot of the row.

    The id is a digest of what is recorded and of the run, so a retried task writes the same id
    and annotating the same rows again makes new ones. A fixed `run_id` makes a run repeatable. With `vocab`
    a fixed label takes the spelling its task already uses.
    """
    run_id = str(uuid.uuid4()) if run_id is None else run_id
    if isinstance(label, str) and not label.strip():
        raise ValueError("Label cannot be empty.")
    task_type = F.lit(task) if isinstance(task, str) else task
    chosen = trimmed(F.lit(label) if isinstance(label, str) else label)
    if vocab is not None:
        if not (isinstance(label, str) and isinstance(task, str)):
            raise ValueError("Use resolve_labels for labels that differ by row.")
        chosen = F.coalesce(known_spelling(vocab, task, label).scalar(), chosen)
    person = annotator if isinstance(annotator, Column) else F.lit(annotator_name(annotator))
    if created_at is None:
        created = utc_now(records)
    else:
        created = F.lit(created_at) if isinstance(created_at, str) else created_at

    identity = F.to_json(
        F.array(
            F.lit(bundle_id), task_type, chosen, person,
            F.col("row_index").cast("string"), F.col("row_hash"), F.lit(run_id),
        )
    )
    return records.select(
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        F.sha2(identity, 256).alias("annotation_id"),
        F.lit(bundle_id).alias("bundle_id"),
        F.lit(fingerprint).alias("dataset_fingerprint"),
        task_type.alias("task_type"),
        chosen.alias("label"),
        F.parse_json(F.lit(json.dumps(payload or {}))).alias("payload"),
        F.struct("row_index", "row_id", "key_fields").alias("row_ref"),
        F.col("row_hash"),
        F.col("row_data"),
        person.alias("annotator"),
        F.lit(note).cast("string").alias("note"),
        created.alias("created_at"),
        F.lit(None).cast("string").alias("updated_at"),
        F.lit(event_type).alias("event_type"),
    )


def annotation_count(annotations: DataFrame) -> DataFrame:
    return annotations.agg(F.count(F.lit(1)).alias("annotation_count"))
