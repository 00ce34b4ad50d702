"""Removal of repeated byte strings with a sparse suffix array.

Suffixes start at the anchors of `_repeats`, so the array holds about one suffix per hundred
bytes, and only those whose anchor occurs with several contents need sorting:

1. Spark samples splitters and range-partitions the suffixes by their leading bytes.
2. Each bucket sorts its suffixes, and the reversed texts before the anchors, by multikey
   quicksort with eight bytes as a character, and takes the common lengths of neighbours. Two
   windows are equal if they agree from the anchor to the right and to the left: both are read
   off the common lengths, for every distance between window start and anchor.
3. Suffixes whose anchor is the first or last of a bucket may have equals in the next buckets;
   their windows are compared across boundaries by 128 bits of hash, with another shuffle. An
   anchor that fills many buckets is compared in this way as a whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from rowmark.llm._common import joined_bytes, mixed, pieces, range_hashes, shuffle_parts, written
from rowmark.llm._repeats import KEYS, Segments, run, segments, unpack, without_repeats

#: Bytes in a window, and in an anchor (a multiple of eight).
WINDOW, ANCHOR = 200, 32
#: Bytes of suffixes with their left sides that one bucket sorts.
BUCKET_BYTES = 24 << 20

_RESULT = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
     ("kept_sha256", pa.string())]
)
_SUFFIX_DDL = "doc_key long, text_key long, place long, asked boolean, left binary, suffix binary"
#: One row of boundary windows: hashes, and for those in question which document and start.
_BOUNDARY = np.dtype([("h", "u8"), ("g", "u8"), ("doc", "i8"), ("text", "i8"), ("start", "i8"), ("kind", "u1")])
_ASKED, _ONCE, _OFTEN = 0, 1, 2
_OUT = pa.schema(
    [("doc_key", pa.int64()), ("text_key", pa.int64()), ("covered", pa.int64()), ("bucket", pa.int32()), ("edge", pa.binary())]
)
_OUT_DDL = "doc_key long, text_key long, covered long, bucket int, edge binary"


def byte_grams(data: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n bytes from each position on (n a multiple of eight)."""
    count = max(0, len(data) - n + 1)
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    words = np.empty(len(data) + 8, np.uint64)
    for shift in range(8):
        part = words[shift::8]
        whole = (len(padded) - shift) // 8
        values = np.frombuffer(padded[shift : shift + whole * 8].tobytes(), "<u8")
        part[: len(values)] = values[: len(part)]
    h = np.zeros(count, np.uint64)
    for j in range(0, n, 8):
        h += words[j : j + count]
        h *= np.uint64(0x9E3779B97F4A7C15 + 2 * j)
        h ^= h >> np.uint64(31)
    return mixed(h)


def _cutter(window: int, anchor: int):
    def cut(texts: pa.Array) -> Segments:
        data, starts, ends = joined_bytes(texts)
        return segments(byte_grams(data, anchor), data, starts, ends, window, anchor)

    return cut


def _suffixes(window: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            columns: list[list] = [[] for _ in range(6)]
            keys = [batch.column(c).to_pylist() for c in KEYS]
            for name, asked in (("open", True), ("sample", False)):
                for i, places in enumerate(batch.column(name).to_pylist()):
                    for place in places or []:
                        start, count, offset = unpack(place)
                        body = texts[i][start : start + count - 1 + window]
                        row = (keys[0][i], keys[1][i], place, asked, body[:offset][::-1], body[offset:])
                        for column, value in zip(columns, row, strict=True):
                            column.append(value)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                names=[*KEYS, "place", "asked", "left", "suffix"],
            )

    return work


def as_characters(strings: list[bytes]) -> np.ndarray:
    """Byte strings as rows of big-endian eight-byte characters, padded with zeros."""
    width = max(1, -(-max(map(len, strings), default=0) // 8))
    padded = b"".join(s.ljust(width * 8, b"\0") for s in strings)
    return np.frombuffer(padded, ">u8").reshape(len(strings), width).astype(np.uint64)


def multikey_order(rows: np.ndarray) -> np.ndarray:
    """Sort rows by multikey quicksort: by one character, then within equals by the next.

    All runs of equals are split at once by their next character; runs of one are done.
    """
    order = np.arange(len(rows))
    start = np.zeros(len(rows), np.int64)  # where the run of each sorted position begins
    live = order.copy() if len(rows) > 1 else order[:0]
    for depth in range(rows.shape[1]):
        if not len(live):
            break
        keys = rows[order[live], depth]
        by = np.lexsort((keys, start[live]))
        order[live] = order[live][by]
        keys, run_of = keys[by], start[live]
        fresh = np.r_[True, (keys[1:] != keys[:-1]) | (run_of[1:] != run_of[:-1])]
        start[live] = live[np.maximum.accumulate(np.where(fresh, np.arange(len(live)), 0))]
        size = np.diff(np.r_[np.flatnonzero(fresh), len(live)])
        live = live[np.repeat(size > 1, size)]
    return order


def common_lengths(rows: np.ndarray, order: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Bytes that each sorted row shares with the one before it (0 for the first)."""
    out = np.zeros(len(order), np.int64)
    for low in range(1, len(order), 4096):
        a, b = order[low - 1 : low + 4095], order[low : low + 4096]
        a = a[: len(b)]
        x = rows[a].astype(">u8").view(np.uint8)
        y = rows[b].astype(">u8").view(np.uint8)
        differ = x != y
        same = np.where(differ.any(1), differ.argmax(1), x.shape[1])
        out[low : low + 4096] = np.minimum(same, np.minimum(lengths[a], lengths[b]))
    return out


def repeated_windows(lefts: list[bytes], rights: list[bytes], counts: np.ndarray, window: int, anchor: int) -> np.ndarray:
    """For each item and distance from window start to anchor: whether that window has an equal.

    lefts are reversed: both sides are read away from the anchor. Item i has the windows whose
    distances run from len(lefts[i]) down, `counts[i]` of them.
    """
    n, farthest = len(lefts), window - anchor
    sides = []
    for strings in (lefts, rights):
        rows = as_characters(strings)
        lengths = np.fromiter(map(len, strings), np.int64, n)
        order = multikey_order(np.c_[rows, lengths.astype(np.uint64)])  # a text before its own with NULs added
        sides.append((order, common_lengths(rows, order, lengths), lengths))
    (by_left, same_left, left_lengths), (by_right, same_right, _) = sides
    out = np.zeros((n, farthest + 1), bool)
    left_class, right_class = np.empty(n, np.int64), np.empty(n, np.int64)
    for distance in range(farthest + 1):
        live = np.flatnonzero((distance <= left_lengths) & (distance > left_lengths - counts))
        if len(live) < 2:
            continue
        left_class[by_left] = np.cumsum(same_left < distance)
        right_class[by_right] = np.cumsum(same_right < window - distance)
        both = left_class[live] * (n + 1) + right_class[live]
        by = np.argsort(both, kind="stable")
        equal = both[by][1:] == both[by][:-1]
        again = np.zeros(len(live), bool)
        again[by] = np.r_[False, equal] | np.r_[equal, False]
        out[live[again], distance] = True
    return out


def _sort_bucket(window: int, anchor: int, buckets: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if table is None or not table.num_rows:
            return
        lefts, rights = (table.column(c).to_pylist() for c in ("left", "suffix"))
        docs, texts = (table.column(c).to_numpy() for c in KEYS)
        places = table.column("place").to_numpy()
        asked = table.column("asked").to_numpy()
        starts, counts = places >> 20, (places >> 10) & 1023
        again = repeated_windows(lefts, rights, counts, window, anchor)
        left_lengths = np.fromiter(map(len, lefts), np.int64, len(lefts))

        # covered runs of the segments in question
        item, distance = np.nonzero(again & asked[:, None])
        first = left_lengths[item] - distance + starts[item]
        order = np.lexsort((first, item))
        item, first = item[order], first[order]
        fresh = np.ones(len(item), bool)
        fresh[1:] = (item[1:] != item[:-1]) | (first[1:] != first[:-1] + 1)
        begin = np.flatnonzero(fresh)
        length = np.diff(np.r_[begin, len(item)]) + window - 1
        if len(begin):
            yield _covered(docs[item[begin]], texts[item[begin]], run(first[begin], 0) | length)
        if buckets > 1:
            yield from _boundary(lefts, rights, again, asked, docs, texts, starts, counts, left_lengths, window, anchor, buckets)

    return work


def _covered(docs: np.ndarray, texts: np.ndarray, covered: np.ndarray) -> pa.RecordBatch:
    n = len(docs)
    return pa.RecordBatch.from_arrays(
        [pa.array(docs), pa.array(texts), pa.array(covered.astype(np.int64)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())],
        schema=_OUT,
    )


def _boundary(lefts, rights, again, asked, docs, texts, starts, counts, left_lengths, window, anchor, buckets):
    """Windows of the first and the last anchor of a bucket, as packed rows by hash."""
    heads = [r[:anchor] for r in rights]
    ends = {min(heads), max(heads)}
    found = []
    chosen = [i for i, head in enumerate(heads) if head in ends]
    for low in range(0, len(chosen), 2000):
        items = np.array(chosen[low : low + 2000])
        bodies = [lefts[i][::-1] + rights[i] for i in items.tolist()]
        data = np.frombuffer(b"".join(bodies), np.uint8)
        base = np.cumsum([0, *map(len, bodies)])[:-1]
        owner = np.repeat(np.arange(len(items)), counts[items])
        within = np.arange(len(owner)) - np.repeat(np.cumsum(counts[items]) - counts[items], counts[items])
        begin = base[owner] + within
        rows = np.zeros(len(owner), _BOUNDARY)
        rows["h"], rows["g"] = range_hashes(data, begin, begin + window), range_hashes(data, begin, begin + window, 1)
        item = items[owner]
        rows["doc"], rows["text"], rows["start"] = docs[item], texts[item], starts[item] + within
        twice = again[item, left_lengths[item] - within]
        rows["kind"] = np.where(twice, _OFTEN, np.where(asked[item], _ASKED, _ONCE))
        often = rows["kind"] == _OFTEN
        _, first = np.unique(rows[["h", "g"]][often], return_index=True)
        found.append(np.concatenate([rows[~often], rows[often][first]]))
    rows = np.concatenate(found)
    bucket = (rows["h"] % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    rows, bucket = rows[order], bucket[order]
    begin = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    end = np.r_[begin[1:], len(rows)]
    n = len(begin)
    yield pa.RecordBatch.from_arrays(
        [pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(bucket[begin].astype(np.int32)),
         pa.array([rows[a:b].tobytes() for a, b in zip(begin, end, strict=True)], pa.binary())], schema=_OUT,
    )


def _meet(window: int):
    """Boundary windows of one bucket of hashes: those in question that occur more than once."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_bucket: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for bucket, edge in zip(batch.column("bucket").to_pylist(), batch.column("edge").to_pylist(), strict=True):
                by_bucket.setdefault(bucket, []).append(np.frombuffer(edge, _BOUNDARY))
        for parts in by_bucket.values():
            rows = np.concatenate(parts)
            rows = rows[np.lexsort((rows["g"], rows["h"]))]
            fresh = np.r_[True, (rows["h"][1:] != rows["h"][:-1]) | (rows["g"][1:] != rows["g"][:-1])]
            size = np.diff(np.r_[np.flatnonzero(fresh), len(rows)])
            hit = rows[np.repeat(size > 1, size) & (rows["kind"] == _ASKED)]
            if len(hit):
                yield _covered(hit["doc"], hit["text"], run(hit["start"], 0) | window).select(["doc_key", "text_key", "covered"])

    return work


def _compare(window: int, anchor: int, bucket_bytes: int):
    def compare(texts: DataFrame) -> DataFrame:
        spark = texts.sparkSession
        opened = texts.agg(F.sum(F.size("open") + F.size("sample"))).first()[0] or 0
        buckets = max(shuffle_parts(spark), opened * window * 2 // bucket_bytes)
        suffixes = texts.mapInArrow(_suffixes(window), _SUFFIX_DDL)
        # equal leading bytes are told apart by a hash: sampled keys stay short, heavy anchors are split
        dealt = suffixes.repartitionByRange(buckets, F.substring("suffix", 1, anchor), F.xxhash64("suffix", "left"))
        found = written(dealt.mapInArrow(_sort_bucket(window, anchor, min(buckets, 256)), _OUT_DDL))
        edges = found.where("edge IS NOT NULL").select("bucket", "edge").repartition(min(buckets, 256), "bucket")
        met = edges.mapInArrow(_meet(window), "doc_key long, text_key long, covered long")
        return found.where("edge IS NULL").select(*KEYS, "covered").unionByName(met)

    return compare


def _finish(text: bytes, runs: list[tuple[int, int]]) -> tuple[int, int, int, str]:
    kept, last = hashlib.sha256(), 0
    for low, high in runs:
        kept.update(text[last:low])
        last = high
    kept.update(text[last:])
    return len(text), sum(high - low for low, high in runs), len(runs), kept.hexdigest()


def repeated_bytes(documents: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document.

    A byte goes if a string of `window` bytes over it also starts anywhere else, in another or
    the same document, overlaps included, as the documents stand. Null and empty texts have no
    bytes; shorter texts keep all theirs. Repeated rows repeat each other. An empty table gives
    no rows; other columns are ignored. Windows have at most 500 bytes.
    """
    if anchor % 8 or not anchor < window <= 500:
        raise ValueError("The anchor is a multiple of eight, and shorter than the window of at most 500 bytes.")
    return without_repeats(
        documents, _cutter(window, anchor), window, _compare(window, anchor, bucket_bytes), _finish, _RESULT,
        "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string",
    )


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
