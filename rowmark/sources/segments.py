"""Derived tables beside a log, kept in segments that each cover some of its committed batches.

A segment counts once its manifest exists and until a later one replaces it, so readers see whole
segments only. Batches without a segment are read from the log. Many segments become one.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import SparkSession

from rowmark.sources import files

#: Beyond this number segments are merged.
SEGMENTS = 8


@dataclass(frozen=True)
class Segment:
    name: str
    pages: int = 0
    batches: tuple[str, ...] = ()


def batches_of(segments: Iterable[Segment]) -> list[str]:
    return sorted({b for s in segments for b in s.batches})


class Segments:
    #: Folders that hold the data of a segment under its name.
    parts: tuple[str, ...] = ()

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _manifests(self) -> list[dict]:
        if not files.exists(self.spark, f"{self.folder}/manifests"):
            return []
        texts = self.spark.read.text(f"{self.folder}/manifests", wholetext=True, pathGlobFilter="*.json")
        return [json.loads(row.value) for row in texts.collect()]

    def segments(self) -> list[Segment]:
        """Segments with a manifest, without those that a later one has replaced."""
        told = self._manifests()
        replaced = {name for m in told for name in m["replaces"]}
        return [Segment(m["segment"], m["pages"], tuple(m["batches"])) for m in told if m["segment"] not in replaced]

    def drop_replaced(self) -> None:
        """Delete segments that are replaced by now; called before the next merge, so that readers of
        the merge before have long moved on."""
        told = self._manifests()
        for name in {name for m in told for name in m["replaces"]} & {m["segment"] for m in told}:
            for path in (f"manifests/{name}.json", *(f"{part}/{name}" for part in self.parts)):
                files.delete(self.spark, f"{self.folder}/{path}")

    def register(self, segment: Segment, batches: list[str], replaces: tuple[Segment, ...] = ()) -> None:
        told = {"segment": segment.name, "batches": sorted(batches), "pages": segment.pages, "replaces": [s.name for s in replaces]}
        files.make_directory(self.spark, f"{self.folder}/manifests")
        files.write_small_text(self.spark, f"{self.folder}/manifests/{segment.name}.json", json.dumps(told))
