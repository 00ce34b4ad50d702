"""Exact deduplication by Grace hash partitioning.

1. Each scan task folds its rows in a hash table over complete texts: of equal texts one row
   stands for the others (a local representative), so a text that fills a third of the table
   goes on once per batch of rows. The rows are written once, with a row number each.
2. Representatives are dealt to partitions by a hash of the text. In each partition they go
   through an open-addressing table (a Python dict keyed by the bytes: equal hashes are settled
   by comparing the complete content). Once its texts reach the memory bound, rows of other
   texts are spilled to files by further hash bits, and each file is worked off the same way.
3. Rows learn their class from their local representative, a key that at most one batch of
   rows shares.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import shutil
import tempfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from rowmark.llm._common import shuffle_parts, written

#: Bytes of distinct texts that a task keeps in its table.
TABLE_BYTES = 64 << 20
#: Spill files per level, and levels after which a table may grow.
FAN_OUT, LEVELS = 16, 8

_FOLDED = pa.schema(
    [("doc_id", pa.int64()), ("place", pa.int64()), ("rep", pa.int64()), ("text_sha256", pa.string()),
     ("size", pa.int64()), ("first_id", pa.int64()), ("bucket", pa.int64()), ("content", pa.binary())]
)
_CLASSES = pa.schema(
    [("rep", pa.int64()), ("keep_place", pa.int64()), ("keep_id", pa.int64()), ("group_size", pa.int64())]
)
#: Representative, text, (id is null, id, place) of the first row, rows.
Item = tuple[int, bytes, tuple[bool, int | None, int], int]


def normalised(texts: pa.Array) -> list[bytes]:
    """Texts with white space collapsed to one blank, as UTF-8; null is empty."""
    return pc.replace_substring_regex(pc.fill_null(texts, ""), r"[\x20\x09-\x0D]+", " ").cast(pa.binary()).to_pylist()


def _fold_locally(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    place = TaskContext.get().partitionId() << 36
    for batch in batches:
        ids = batch.column("doc_id").to_pylist()
        table: dict[bytes, list[int]] = {}
        for i, text in enumerate(normalised(batch.column("text"))):
            table.setdefault(text, []).append(i)
        out: dict[str, list] = {name: [None] * len(ids) for name in _FOLDED.names}
        out["doc_id"], out["place"] = ids, list(range(place, place + len(ids)))
        for text, rows in table.items():
            digest = hashlib.sha256(text)
            first = min(rows, key=lambda i: (ids[i] is None, ids[i], i))
            sha = digest.hexdigest()
            for i in rows:
                out["rep"][i], out["text_sha256"][i] = place + first, sha
            out["size"][first], out["first_id"][first], out["content"][first] = len(rows), ids[first], text
            out["bucket"][first] = int.from_bytes(digest.digest()[:7], "big")
        place += len(ids)
        yield pa.RecordBatch.from_pydict(out, schema=_FOLDED)


def fold(items: Iterable[Item], folder: str, bound: int, level: int = 0) -> Iterator[tuple[list[int], tuple, int]]:
    """(representatives, first row, rows) of each distinct text."""
    table: dict[bytes, list] = {}
    held, files = 0, []
    try:
        for item in items:
            rep, content, first, size = item
            entry = table.get(content)
            if entry is not None:
                entry[0].append(rep)
                entry[1] = min(entry[1], first)
                entry[2] += size
            elif held < bound or level >= LEVELS:
                table[content] = [[rep], first, size]
                held += len(content) + 256
            else:
                if not files:
                    below = tempfile.mkdtemp(dir=folder)
                    files = [open(f"{below}/{i}", "wb") for i in range(FAN_OUT)]  # noqa: SIM115
                bits = hashlib.blake2b(content, digest_size=1, salt=bytes([level + 1])).digest()[0]
                pickle.dump(item, files[bits % FAN_OUT])
        for reps, first, size in table.values():
            yield reps, first, size
        table.clear()
        for file in files:
            file.close()
            yield from fold(_spilled(file.name), folder, bound, level + 1)
            os.unlink(file.name)
    finally:
        for file in files:
            file.close()


def _spilled(path: str) -> Iterator[Item]:
    with open(path, "rb") as file:
        while True:
            try:
                yield pickle.load(file)
            except EOFError:
                return


def _classes(bound: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def items() -> Iterator[Item]:
            for batch in batches:
                columns = (batch.column(c).to_pylist() for c in ("rep", "content", "first_id", "size"))
                for rep, content, first, size in zip(*columns, strict=True):
                    yield rep, content, (first is None, first, rep), size

        folder = tempfile.mkdtemp(prefix="grace-")
        rows: list[tuple] = []
        try:
            for reps, (_, keep_id, keep_place), size in fold(items(), folder, bound):
                rows += [(rep, keep_place, keep_id, size) for rep in reps]
                if len(rows) >= 10_000:
                    yield _as_batch(rows)
                    rows = []
            yield _as_batch(rows)
        finally:
            shutil.rmtree(folder, ignore_errors=True)

    return run


def _as_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(_CLASSES)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _CLASSES, strict=True)], schema=_CLASSES)


def _ddl(schema: pa.Schema) -> str:
    kinds = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def exact_duplicates(documents: DataFrame, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row.

    Texts are equal when identical after replacing each run of blanks, tabs and line ends by one
    blank; null equals the empty text. The row with the smallest doc_id stays (null ids last; of
    rows that repeat an id, the first one read): exactly one row of a class has kept = true.
    An empty table gives no rows. Other columns are ignored.
    """
    source = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    folded = written(source.mapInArrow(_fold_locally, _ddl(_FOLDED)))
    dealt = (
        folded.where("content IS NOT NULL")
        .select("rep", "content", "first_id", "size", "bucket")
        .repartition(shuffle_parts(documents.sparkSession), "bucket")
    )
    classes = dealt.select("rep", "content", "first_id", "size").mapInArrow(_classes(table_bytes), _ddl(_CLASSES))
    rows = folded.select("doc_id", "place", "rep", "text_sha256")
    return rows.join(classes, "rep").select(
        "doc_id", "keep_id", "group_size", (F.col("place") == F.col("keep_place")).alias("kept"), "text_sha256"
    )


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH normal AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(body) AS text_sha256
FROM normal WINDOW w AS (PARTITION BY body)
"""
