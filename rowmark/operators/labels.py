"""Label vocabularies as tables: normalise, resolve, union, and short label codes 1..9.

labels: task_type, pos, label          (pos orders the labels of a task, gaps are fine)
keys:   task_type, key, pos, label     (short codes of labels)
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from rowmark.functions.identity import column, unused_name
from rowmark.functions.text import label_key, trimmed
from rowmark.operators.sizes import settled

# Codes, first labels and task of a new label set.
CODES = ("1", "2", "3", "4", "5", "6", "7", "8", "9")
DEFAULT_LABELS = ("high-quality", "low-quality", "needs-review", "skip")
DEFAULT_TASK = "preference"
LABEL_SET_VERSION = "1.0"

_PROFILE = "labels ARRAY<STRING>, hotkeys MAP<STRING, STRING>"
_LABEL_SET = (
    f"active_task_type STRING, task_type STRING, {_PROFILE}, "
    f"task_profiles MAP<STRING, STRUCT<{_PROFILE}>>"
)


@dataclass(frozen=True)
class LabelSet:
    """The label tables of one bundle; `tasks` also names tasks without labels."""

    active_task: str
    tasks: DataFrame
    labels: DataFrame
    keys: DataFrame


def new_label_set(
    spark: SparkSession, task: str = DEFAULT_TASK, labels: Sequence[str] = DEFAULT_LABELS
) -> LabelSet:
    """A label set with one task; all labels stay, and its first nine get the codes 1..9."""
    spelt = dict.fromkeys(filter(None, map(str.strip, labels)))
    rows = [(task, pos, label) for pos, label in enumerate(spelt or DEFAULT_LABELS)]
    keyed = [(task, code, pos, label) for code, (_, pos, label) in zip(CODES, rows, strict=False)]
    return LabelSet(
        task,
        spark.createDataFrame([(task,)], "task_type STRING"),
        spark.createDataFrame(rows, "task_type STRING, pos BIGINT, label STRING"),
        spark.createDataFrame(keyed, "task_type STRING, key STRING, pos BIGINT, label STRING"),
    )


def label_set_from_json(spark: SparkSession, text: str, default_task: str = DEFAULT_TASK) -> LabelSet:
    """Label tables from a label-set document, with per-task profiles or the older flat form."""
    if not isinstance(json.loads(text), dict):
        raise ValueError("A label set must be a JSON object.")
    document = spark.createDataFrame([(text,)], "value STRING").select(
        F.from_json("value", _LABEL_SET).alias("d")
    )
    named = [
        F.nullif(trimmed(F.col(f"d.{name}")), F.lit("")) for name in ("active_task_type", "task_type")
    ]
    active = F.coalesce(*named, F.lit(default_task))
    flat = F.create_map(active, F.struct(F.col("d.labels"), F.col("d.hotkeys")))
    tasks_of = F.filter(
        F.map_entries("d.task_profiles"), lambda e: trimmed(e["key"]) != ""
    )
    profiles = document.select(
        active.alias("active"),
        F.explode(F.when(F.size(tasks_of) > 0, tasks_of).otherwise(F.map_entries(flat))).alias("p"),
    ).select("active", trimmed(F.col("p.key")).alias("task_type"), "p.value.labels", "p.value.hotkeys")

    labels = profiles.select("task_type", F.posexplode("labels").alias("pos", "label"))
    keys = profiles.select("task_type", F.posexplode(F.map_entries("hotkeys")).alias("pos", "e"))
    keys = label_keys(keys.select("task_type", "e.key", "pos", F.col("e.value").alias("label")))
    active_task = profiles.select("active").first().active
    active_row = spark.createDataFrame([(active_task,)], "task_type STRING")
    return LabelSet(
        active_task,
        profiles.select("task_type").union(active_row).distinct(),
        label_vocab(labels.withColumn("pos", F.col("pos").cast("bigint")), keys),
        keys,
    )


def label_keys(keys: DataFrame) -> DataFrame:
    """Trim codes and labels, drop empty ones; the last entry of a code wins."""
    return (
        keys.select(
            "task_type",
            trimmed(F.col("key")).alias("key"),
            F.col("pos").cast("bigint").alias("pos"),
            trimmed(F.col("label")).alias("label"),
        )
        .filter("key <> '' AND label <> ''")
        .groupBy("task_type", "key")
        .agg(F.max("pos").alias("pos"), F.max_by("label", "pos").alias("label"))
    )


def _after(extra: DataFrame, labels: DataFrame) -> DataFrame:
    """`extra` with positions moved behind the positions used in `labels`, task by task."""
    used = labels.groupBy("task_type").agg((F.max("pos") + 1).alias("_used"))
    # One row per label before the join: there are only a few tasks to join on.
    extra = extra.groupBy("task_type", "label").agg(F.min("pos").alias("pos"))
    return extra.join(used, "task_type", "left").select(
        "task_type", (F.coalesce("_used", F.lit(0)) + F.col("pos")).alias("pos"), "label"
    )


def label_vocab(labels: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """Trimmed labels without empties and case duplicates; the first spelling wins.

    Labels that only `keys` names follow at the end.
    """
    if keys is not None:
        named = labels.select("task_type", "pos", "label")
        labels = named.unionByName(_after(keys, named))
    # Collapse equal spellings first: a label on a third of all rows is one row after that.
    spellings = (
        labels.groupBy("task_type", trimmed(F.col("label")).alias("label"))
        .agg(F.min("pos").alias("pos"))
        .filter("label <> ''")
    )
    return (
        spellings.groupBy("task_type", label_key(F.col("label")).alias("_key"))
        .agg(F.min_by("label", "pos").alias("label"), F.min("pos").alias("pos"))
        .select("task_type", "pos", "label")
    )


def labels_of_task(labels: DataFrame, task: str) -> DataFrame:
    """The vocabulary of one task, empty for a task not seen before."""
    if not task.strip():
        raise ValueError("Task type cannot be empty.")
    return labels.filter(F.col("task_type") == task.strip())


def _spellings(rows: DataFrame, vocab: DataFrame, position: str) -> DataFrame:
    used = (
        rows.groupBy("task_type", trimmed(F.col("label")).alias("label"))
        .agg(F.min(position).alias("pos"))
        .filter("label <> ''")
        .select("task_type", "label", F.lit(True).alias("is_new"), "pos")
    )
    known = vocab.select("task_type", "label", F.lit(False).alias("is_new"), "pos")
    first = F.struct("is_new", "pos")
    return (
        known.unionByName(used)
        .groupBy("task_type", label_key(F.col("label")).alias("_key"))
        .agg(
            F.min_by("label", first).alias("label"),
            F.min_by("is_new", first).alias("is_new"),
            F.min_by("pos", first).alias("pos"),
        )
    )


def resolve_labels(rows: DataFrame, vocab: DataFrame, position: str) -> DataFrame:
    """Give each row's label the spelling the vocabulary has, whatever its case and blanks.

    An unknown label keeps its first spelling among `rows`, by `position`. An empty label
    is an error.
    """
    key, spelt = unused_name(rows, "_key"), unused_name(rows, "_label")
    spelling = settled(
        _spellings(rows, vocab, position).select("task_type", F.col("_key").alias(key), F.col("label").alias(spelt))
    )
    keyed = rows.withColumn(key, label_key(F.col("label")))
    resolved = F.when(
        F.coalesce(key, F.lit("")) == "", F.raise_error(F.lit("Label cannot be empty."))
    ).otherwise(F.col(spelt))
    return (
        keyed.join(spelling, ["task_type", key], "left")
        .withColumn("label", resolved)
        .select(*(column(name) for name in rows.columns))
    )


def added_labels(rows: DataFrame, vocab: DataFrame, position: str) -> DataFrame:
    """Labels in `rows` that the vocabulary lacks, one per case-insensitive label."""
    return _spellings(rows, vocab, position).filter("is_new").select("task_type", "pos", "label")


def label_codes(labels: DataFrame, keys: DataFrame) -> DataFrame:
    """Codes for labels without one: the lowest free code of the task, in label order.

    Labels left over when the nine codes are used up get none.
    """
    waiting = labels.join(keys.select("task_type", "label"), ["task_type", "label"], "left_anti")
    # Only the first nine per task can get a code; Spark cuts the rest before the shuffle.
    place = F.row_number().over(Window.partitionBy("task_type").orderBy("pos", "label"))
    first = waiting.withColumn("_place", place).filter(F.col("_place") <= len(CODES))
    free = (
        labels.select("task_type")
        .distinct()
        .select("task_type", F.explode(F.array(*map(F.lit, CODES))).alias("key"))
        .join(keys.select("task_type", "key"), ["task_type", "key"], "left_anti")
        .withColumn(
            "_place", F.row_number().over(Window.partitionBy("task_type").orderBy("key"))
        )
    )
    return first.join(free, ["task_type", "_place"]).select("task_type", "key", "pos", "label")


def label_union(target: DataFrame, source: DataFrame) -> DataFrame:
    """Target labels, then source labels not there yet, compared exactly."""
    named = target.select("task_type", "pos", "label")
    return (
        named.unionByName(_after(source, named))
        .filter(trimmed(F.col("label")) != "")
        .groupBy("task_type", "label")
        .agg(F.min("pos").alias("pos"))
        .select("task_type", "pos", "label")
    )


def label_code_merge(
    labels: DataFrame, target_keys: DataFrame, source_keys: DataFrame, both: DataFrame
) -> DataFrame:
    """Target codes win, source codes fill free slots, remaining labels get free codes.

    `labels` are the merged labels; only tasks listed in `both` get new codes.
    """
    ranked = target_keys.withColumn("_rank", F.lit(0)).unionByName(
        source_keys.withColumn("_rank", F.lit(1))
    )
    merged = (
        ranked.filter(trimmed(F.col("label")) != "")
        .groupBy("task_type", "key")
        .agg(F.min_by("pos", "_rank").alias("pos"), F.min_by("label", "_rank").alias("label"))
    )
    shared = labels.join(both.select("task_type"), "task_type", "left_semi")
    return merged.unionByName(label_codes(shared, merged))


def merge_label_sets(target: LabelSet, source: LabelSet) -> LabelSet:
    labels = label_union(target.labels, source.labels)
    both = target.tasks.join(source.tasks, "task_type", "left_semi")
    return LabelSet(
        target.active_task or source.active_task or DEFAULT_TASK,
        target.tasks.union(source.tasks).distinct(),
        labels,
        label_code_merge(labels, target.keys, source.keys, both),
    )


def with_task(label_set: LabelSet, task: str) -> LabelSet:
    """The label set with another active task; a task not seen before starts without labels."""
    if not task.strip():
        raise ValueError("Task type cannot be empty.")
    named = label_set.tasks.sparkSession.createDataFrame([(task.strip(),)], "task_type STRING")
    return replace(
        label_set, active_task=task.strip(), tasks=label_set.tasks.union(named).distinct()
    )


def with_labels(label_set: LabelSet, added: DataFrame) -> LabelSet:
    """The label set with new labels behind its own, each with a free code while there are any.

    `added` has task_type, pos and label, as `added_labels` returns them.
    """
    known = label_set.labels.select("task_type", label_key(F.col("label")).alias("_key"))
    fresh = label_vocab(added).withColumn("_key", label_key(F.col("label")))
    fresh = _after(fresh.join(known, ["task_type", "_key"], "left_anti"), label_set.labels)
    taken = label_set.keys.select("task_type", "key", "pos", "label")
    return LabelSet(
        label_set.active_task,
        label_set.tasks.union(fresh.select("task_type")).distinct(),
        label_set.labels.unionByName(fresh),
        taken.unionByName(label_codes(fresh, taken)),
    )


def label_set_changed(before: LabelSet, after: LabelSet) -> bool:
    """A merge only ever adds, so comparing sizes is enough."""

    def entries(label_set: LabelSet) -> int:
        parts = (label_set.tasks, label_set.labels, label_set.keys)
        tasks, labels, keys = (part.select("task_type") for part in parts)
        return tasks.unionAll(labels).unionAll(keys).count()

    return entries(before) != entries(after)
