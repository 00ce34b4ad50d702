"""Shared helpers: written intermediate tables, batches of bounded bytes, hashed words."""

from __future__ import annotations

import atexit
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from rowmark.checkpoints import checkpoint_folder

#: Bytes of text worked on at a time. Longer single texts are a piece of their own.
PIECE_BYTES = 1 << 20
_written: list[tuple[SparkSession, str]] = []


def _remove_written() -> None:
    for spark, path in _written:
        try:
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001  the session has ended; the folder belongs to the cluster
            return


atexit.register(_remove_written)


def written(df: DataFrame) -> DataFrame:
    """Write a frame as Parquet into the shared folder and read it back.

    Cuts the lineage; the files outlive lost executors and go when the driver ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/table-{uuid.uuid4()}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def few(df: DataFrame, rows: int, each: int = 20_000, at_least: int = 1) -> DataFrame:
    """The frame in no more tasks than `rows` rows are worth; rows of a partition stay together, in order."""
    return df.coalesce(max(at_least, -(-rows // each)))


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut record batches into runs of rows with about PIECE_BYTES of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = byte_lengths(batch.column(column))
        group = (np.cumsum(sizes) - sizes) // PIECE_BYTES
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        for start, end in zip(starts, np.r_[starts[1:], batch.num_rows], strict=True):
            yield batch.slice(int(start), int(end - start))


def byte_lengths(texts: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def joined_bytes(texts: pa.Array, gap: bytes = b"") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts one after the other as uint8, each followed by `gap`; null counts as empty.

    Returns the bytes, and where each text starts and ends.
    """
    values = [b"" if x is None else x for x in texts.cast(pa.binary()).to_pylist()]
    lengths = np.fromiter((len(x) for x in values), np.int64, len(values))
    ends = np.cumsum(lengths + len(gap)) - len(gap)
    data = np.frombuffer(gap.join(values) + gap, np.uint8)
    return data, ends - lengths, ends


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (wrapping arithmetic)."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, at least n of each."""
    if which not in _powers or len(_powers[which][0]) < n:
        size = max(n, PIECE_BYTES + (PIECE_BYTES >> 2))
        base = _BASES[which]
        tables = []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            tables.append(np.multiply.accumulate(steps))
        _powers[which] = (tables[0], tables[1])
    return _powers[which]


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of values[start:end] for each range; equal content, equal hash."""
    up, down = _power_tables(which, len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: len(values)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    return mixed(h + (ends - starts).astype(np.uint64) * np.uint64(0x165667B19E3779F9))


def word_ranges(
    data: np.ndarray, separator: np.ndarray, starts: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words (runs of bytes that are no separators) start and end, and the index of each
    text's first word, with the total at the end. `starts` are the offsets of the texts, which
    are divided by separators. separator: 256 booleans by byte.
    """
    inside = ~separator[data]
    edges = np.diff(np.r_[False, inside, False].astype(np.int8))
    begin, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    first = np.searchsorted(begin, starts)
    return begin, end, np.r_[first, len(begin)].astype(np.int64)


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: White space of the contracts: blank, and tab to carriage return.
WHITE = byte_set((0x20, 0x20), (0x09, 0x0D))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


#: Longer words are hashed by blake2b: sums of powers modulo 2**64 cannot tell long alternating patterns apart.
LONG_WORD = 48


def word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes, computed over about PIECE_BYTES at a time."""
    out, i = np.empty(len(begin), np.uint64), 0
    while i < len(begin):
        j = max(i + 1, int(np.searchsorted(begin, begin[i] + PIECE_BYTES)))
        low, high = begin[i], end[j - 1]
        out[i:j] = range_hashes(data[low:high], begin[i:j] - low, end[i:j] - low, which)
        i = j
    for i in np.flatnonzero(end - begin > LONG_WORD).tolist():
        digest = hashlib.blake2b(data[begin[i] : end[i]], digest_size=8, salt=bytes([which])).digest()
        out[i] = int.from_bytes(digest, "little")
    return out


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n consecutive word hashes; one less than n shorter than `words`."""
    count = max(0, len(words) - n + 1)
    h = np.zeros(count, np.uint64)
    for j in range(n):
        h = (h + words[j : j + count]) * np.uint64(0x9E3779B97F4A7C15 + 2 * j)
        h ^= h >> np.uint64(29)
    return mixed(h)




def window_minima(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each window of `width` hashes, the position of its smallest (the leftmost of equals)."""
    count = len(hashes) - width + 1
    if count <= 0:
        return np.zeros(0, np.int64)
    out = np.empty(count, np.int64)
    block = 1 << 17
    mask = np.uint64((1 << 24) - 1)
    for low in range(0, count, block):
        high = min(count, low + block)
        part = hashes[low : high + width - 1]
        packed = (part & ~mask) | np.arange(len(part), dtype=np.uint64)
        span = 1
        while span < width:  # packed[i] is the least of span values from i on
            step = min(span, width - span)
            packed = np.minimum(packed[:-step], packed[step:])
            span += step
        out[low:high] = (packed[: high - low] & mask).astype(np.int64) + low
    return out
