"""Where windows of symbols (bytes or words) repeat: the part that both substring operators share.

Every window of a text is given the anchor with the smallest hash among its grams. Consecutive
windows with one anchor are a segment. Equal windows have equal anchors at equal offsets, so two
windows can only be equal if their anchors are. Far fewer rows than windows are moved:

- an anchor that occurs once has no repeated window; its segment is dropped;
- an anchor whose segments all have the same content repeats with all its windows;
- an anchor with several contents is branching: contents that occur twice repeat with all their
  windows, and of each content one segment is opened to compare single windows.

Segments of a text with equal content are one row, so that a text of one repeated line is a few
rows. Counts are pre-aggregated, and written before they are joined: then both sides of a join
come straight from their shuffles and Spark can split heavy keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from rowmark.llm._common import pieces, range_hashes, window_minima, written

KEYS = ["doc_key", "text_key"]
#: Places are packed as start, windows and anchor offset; runs as start and length.
_TEN = (1 << 10) - 1
_LISTS = "full array<long>, open array<long>, sample array<long>"


@dataclass(frozen=True)
class Segments:
    """Segments of several texts: owning text, first window, windows, anchor offset, hashes."""

    owner: np.ndarray
    start: np.ndarray
    windows: np.ndarray
    offset: np.ndarray
    anchor: np.ndarray
    content: np.ndarray


def segments(grams: np.ndarray, symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray, window: int, gram: int) -> Segments:
    """Cut texts, which lie one after the other in `symbols`, into segments."""
    minima = window_minima(grams, window - gram + 1)
    step = np.zeros(len(symbols) + 1, np.int32)
    long_enough = ends - starts >= window
    np.add.at(step, starts[long_enough], 1)
    np.add.at(step, ends[long_enough] - window + 1, -1)
    places = np.flatnonzero(np.cumsum(step[:-1]) > 0)
    anchors = minima[places] if len(places) else places
    fresh = np.ones(len(places), bool)
    fresh[1:] = (anchors[1:] != anchors[:-1]) | (places[1:] != places[:-1] + 1)
    first = np.flatnonzero(fresh)
    begin, anchor = places[first], anchors[first]
    filled = np.flatnonzero(long_enough)
    owner = filled[np.searchsorted(starts[filled], begin, side="right") - 1] if len(begin) else begin
    count = np.diff(np.r_[first, len(places)])
    content = range_hashes(symbols, begin, begin + count - 1 + window) if len(begin) else np.zeros(0, np.uint64)
    return Segments(owner, begin - starts[owner], count, anchor - begin, grams[anchor], content)


Cutter = Callable[[pa.Array], Segments]


def row_keys() -> tuple[Column, Column]:
    """What equal rows share, and rows that differ do not: id (null is the least) and hash of the text."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def keyed(documents: DataFrame) -> DataFrame:
    """doc_id, text (null is empty) and a key that equal rows share: id and hash of the text."""
    doc_key, text_key = row_keys()
    return documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        doc_key.alias("doc_key"),
        text_key.alias("text_key"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )


def pack(start: np.ndarray, windows: np.ndarray, offset: np.ndarray) -> np.ndarray:
    return (start << 20) | (windows << 10) | offset


def unpack(place: int) -> tuple[int, int, int]:
    """Start, windows, anchor offset."""
    return place >> 20, (place >> 10) & _TEN, place & _TEN


def run(start: int, length: int) -> int:
    return start << 10 | length


def _cut(cutter: Cutter) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = cutter(batch.column("text"))
            order = np.lexsort((found.content, found.anchor, found.owner))
            owner, anchor, content = found.owner[order], found.anchor[order], found.content[order]
            fresh = np.ones(len(order), bool)
            fresh[1:] = (owner[1:] != owner[:-1]) | (anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1])
            first = np.flatnonzero(fresh)
            times = np.diff(np.r_[first, len(order)])
            places = pack(found.start, found.windows, found.offset)[order]
            rows = pa.array(owner[first])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_key").take(rows),
                    batch.column("text_key").take(rows),
                    pa.ListArray.from_arrays(pa.array(np.r_[first, len(order)].astype(np.int32)), pa.array(places, pa.int64())),
                    pa.array(times, pa.int64()),
                    pa.array(anchor[first].view(np.int64)),
                    pa.array(content[first].view(np.int64)),
                ],
                names=["doc_key", "text_key", "places", "times", "anchor", "content"],
            )

    return work


def located(rows: DataFrame, cutter: Cutter) -> DataFrame:
    """Per key: places whose windows all repeat (full), places to open, and opened samples of full ones."""
    cut = rows.select(*KEYS, "text").mapInArrow(
        _cut(cutter), "doc_key long, text_key long, places array<long>, times long, anchor long, content long"
    )
    anchors = written(
        cut.groupBy("anchor")
        .agg(F.sum("times").alias("total"), F.min("content").alias("low"), F.max("content").alias("high"))
        .where("total > 1")
        .select("anchor", (F.col("low") != F.col("high")).alias("branching"))
    )
    repeated = written(cut.join(anchors, "anchor"))
    place = F.struct(*KEYS, F.col("places")[0].alias("place"))
    contents = written(
        repeated.where("branching")
        .groupBy("anchor", "content")
        .agg(F.sum("times").alias("total"), F.min(place).alias("first"))
    )
    alone, none = F.col("total") == 1, F.lit(False)
    judged = (
        repeated.where("branching")
        .join(contents, ["anchor", "content"])
        .select(*KEYS, "places", (~alone).alias("is_full"), alone.alias("is_open"), (~alone & (place == F.col("first"))).alias("is_sample"))
        .unionByName(
            repeated.where("NOT branching").select(
                *KEYS, "places", F.lit(True).alias("is_full"), none.alias("is_open"), none.alias("is_sample")
            )
        )
    )
    taken = {"full": F.col("places"), "open": F.col("places"), "sample": F.slice("places", 1, 1)}
    chosen = [F.flatten(F.collect_set(F.when(F.col(f"is_{c}"), v))).alias(c) for c, v in taken.items()]
    return judged.groupBy(*KEYS).agg(*chosen)


#: (text, runs of covered symbols as (start, end)) to the values of the result columns.
Finish = Callable[[bytes, list[tuple[int, int]]], tuple]


def merged(runs: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted maximal runs of overlapping or adjoining ones."""
    out: list[tuple[int, int]] = []
    for low, high in sorted(runs):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


def _text_bytes(batch: pa.RecordBatch) -> list[bytes]:
    return [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]


def _first_pass(finish: Finish, window: int, schema: pa.Schema) -> Callable:
    """Results of the texts without opened segments; the others go on with their text."""
    kept = pa.schema(
        [*schema, pa.field("doc_key", pa.int64()), pa.field("text_key", pa.int64()), pa.field("text", pa.string()),
         *(pa.field(c, pa.list_(pa.int64())) for c in ("full", "open", "sample"))]
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            lists = [batch.column(c).to_pylist() for c in ("full", "open", "sample")]
            out: dict[str, list] = {f.name: [] for f in kept}
            texts = batch.column("text")
            ids, doc_keys, text_keys = (batch.column(c).to_pylist() for c in ("doc_id", *KEYS))
            for i, raw in enumerate(_text_bytes(batch)):
                full, opened, sample = (x[i] or [] for x in lists)
                goes_on = bool(opened or sample)
                values = () if goes_on else finish(raw, merged(_spans(full, window)))
                values = (None,) * (len(schema) - 1) if goes_on else values
                rest = (doc_keys[i], text_keys[i], texts[i].as_py(), full, opened, sample) if goes_on else (None,) * 6
                for column, value in zip(out.values(), (ids[i], *values, *rest), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_pydict(out, schema=kept)

    return work


def _spans(places: list[int], window: int) -> Iterator[tuple[int, int]]:
    for place in places:
        start, windows, _ = unpack(place)
        yield start, start + windows - 1 + window


def _last_pass(finish: Finish, window: int, schema: pa.Schema) -> Callable:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            out: dict[str, list] = {f.name: [] for f in schema}
            ids, fulls, runs = (batch.column(c).to_pylist() for c in ("doc_id", "full", "runs"))
            for i, raw in enumerate(_text_bytes(batch)):
                more = ((r >> 10, (r >> 10) + (r & _TEN)) for r in runs[i] or [])
                values = finish(raw, merged([*_spans(fulls[i] or [], window), *more]))
                for column, value in zip(out.values(), (ids[i], *values), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    return work


def without_repeats(
    documents: DataFrame,
    cutter: Cutter,
    window: int,
    compare: Callable[[DataFrame], DataFrame],
    finish: Finish,
    schema: pa.Schema,
    ddl: str,
) -> DataFrame:
    """The results of `finish` for every document.

    compare: from texts with opened segments (doc_key, text_key, text, open, sample) to covered
    runs (doc_key, text_key, covered): what repeats within single windows.
    """
    rows = keyed(documents)
    lists = located(rows, cutter)
    first = written(
        rows.join(lists, KEYS, "left").mapInArrow(
            _first_pass(finish, window, schema), f"{ddl}, doc_key long, text_key long, text string, {_LISTS}"
        )
    )
    rest = first.where("text IS NOT NULL")
    covered = compare(rest.select(*KEYS, "text", "open", "sample")).groupBy(*KEYS).agg(F.collect_set("covered").alias("runs"))
    last = (
        rest.select("doc_id", *KEYS, "text", "full")
        .join(covered, KEYS, "left")
        .mapInArrow(_last_pass(finish, window, schema), ddl)
    )
    return first.where("text IS NULL").select(*schema.names).unionByName(last)
