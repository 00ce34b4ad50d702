"""Label conflicts of a growing log, kept up to date batch by batch.

Of every group of task, row and row hash the lowest and the highest label are kept. Both can be
merged, so new batches are reduced alone and only the small results of all batches meet.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from rowmark.operators.merge import label_range
from rowmark.sources.segments import SEGMENTS, Segment, Segments, batches_of

FOLDER = "_conflicts"
GROUP = ("task_type", "row_key", "row_hash")
_SCHEMA = "task_type STRING, row_key STRING, row_hash STRING, lowest_label STRING, highest_label STRING"


def _joined(ranges: DataFrame) -> DataFrame:
    return ranges.groupBy(*GROUP).agg(F.min("lowest_label").alias("lowest_label"), F.max("highest_label").alias("highest_label"))


class ConflictTable(Segments):
    parts = ("ranges",)

    def __init__(self, spark: SparkSession, bundle_path: str):
        super().__init__(spark, f"{bundle_path}/{FOLDER}")

    def add(self, records: DataFrame, batches: list[str]) -> None:
        """Reduce the records of some batches."""
        self._write(label_range(records), batches)

    def ranges(self) -> DataFrame:
        """Lowest and highest label of every group of the covered batches."""
        parts = self.spark.createDataFrame([], _SCHEMA)
        for segment in self.segments():
            parts = parts.unionByName(self.spark.read.schema(_SCHEMA).parquet(f"{self.folder}/ranges/{segment.name}"))
        return _joined(parts)

    def merge_segments(self) -> None:
        old = self.segments()
        if len(old) > SEGMENTS:
            self.drop_replaced()
            self._write(self.ranges(), batches_of(old), tuple(old))

    def _write(self, ranges: DataFrame, batches: list[str], replaces: tuple[Segment, ...] = ()) -> None:
        name = uuid.uuid4().hex
        ranges.select(*GROUP, "lowest_label", "highest_label").write.parquet(f"{self.folder}/ranges/{name}")
        self.register(Segment(name), batches, replaces)
