"""Annotation bundles packed as .tar.gz, many archives at once."""

from __future__ import annotations

import io
import posixpath
import tarfile
from collections.abc import Iterator, Sequence
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from rowmark.functions.identity import POSITION
from rowmark.operators.annotate import ANNOTATION_SCHEMA

BATCH_LINES = 4096

PARTS = ("manifest.json", "label_set.json", "annotations.jsonl")

_LINES = pa.schema(
    [
        ("archive", pa.string()),
        ("bundle_dir", pa.string()),
        ("part", pa.string()),
        ("line_no", pa.int64()),
        ("line", pa.string()),
    ]
)

_Line = tuple[str, str, str, int, str]


def _member_path(name: str) -> str:
    path = posixpath.normpath(name)
    if path.startswith(("/", "../")) or path == "..":
        raise ValueError(f"The archive has a member outside its own folder: {name}")
    return path


def _bundle_folder(names: set[str]) -> str:
    """The shallowest folder that holds a whole bundle, then the first by name."""
    folders = {posixpath.dirname(name) for name in names}
    whole = [f for f in folders if all(posixpath.join(f, part) in names for part in PARTS)]
    if not whole:
        raise ValueError("No folder of the archive holds a whole bundle.")
    return min(whole, key=lambda f: (f.count("/") + bool(f), f))


def _archive_lines(path: str, content: bytes, parts: Sequence[str]) -> Iterator[_Line]:
    with tarfile.open(fileobj=io.BytesIO(content), mode="r:gz") as archive:
        members = {_member_path(m.name): m for m in archive.getmembers()}
        folder = _bundle_folder({name for name, m in members.items() if m.isfile()})
        for part in parts:
            for number, line in enumerate(archive.extractfile(members[posixpath.join(folder, part)])):
                if line.strip():
                    yield path, folder, part, number, line.decode("utf-8").strip()


def _unpack(batches: Iterator[pa.RecordBatch], parts: Sequence[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            lines = _archive_lines(path.as_py(), content.as_py(), parts)
            while rows := list(islice(lines, BATCH_LINES)):
                columns = [pa.array(c, field.type) for c, field in zip(zip(*rows), _LINES)]
                yield pa.RecordBatch.from_arrays(columns, schema=_LINES)


def _lines(spark: SparkSession, path: str, *parts: str) -> DataFrame:
    packed = spark.read.format("binaryFile").option("pathGlobFilter", "*.tar.gz").load(path)
    return packed.select("path", "content").mapInArrow(
        lambda batches: _unpack(batches, parts),
        "archive STRING, bundle_dir STRING, part STRING, line_no BIGINT, line STRING",
    )


def read_bundle_archives(spark: SparkSession, path: str) -> DataFrame:
    """Annotation records of all archives at `path`, with archive, folder and line number.

    Each archive is unpacked by one task and streamed out line by line; a member that
    would leave its archive's folder fails the read.
    """
    record = F.from_json("line", ANNOTATION_SCHEMA, {"mode": "FAILFAST"})
    return (
        _lines(spark, path, PARTS[2])
        .select("archive", "bundle_dir", "line_no", record.alias("r"))
        .select("archive", "bundle_dir", "line_no", "r.*")
    )


def archive_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per archive with the text of its manifest and its label set."""

    def text(part: str):
        lines = F.array_sort(
            F.collect_list(F.when(F.col("part") == part, F.struct("line_no", "line")))
        )
        return F.array_join(F.transform(lines, lambda line: line["line"]), "\n")

    return (
        _lines(spark, path, *PARTS[:2])
        .groupBy("archive")
        .agg(text(PARTS[0]).alias("manifest"), text(PARTS[1]).alias("label_set"))
    )


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Annotation records of one archive, placed by their line in its log."""
    return read_bundle_archives(spark, path).withColumnRenamed("line_no", POSITION).drop(
        "archive", "bundle_dir"
    )


def archive_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of one archive's log as they are (`value`), placed by their number."""
    return _lines(spark, path, PARTS[2]).select(
        F.col("line_no").alias(POSITION), F.col("line").alias("value")
    )
