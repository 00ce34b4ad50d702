"""Benchmark decontamination by winnowing.

From every window of ten words the smallest five-word hash is kept as a fingerprint, on both
sides: texts that share a window share its fingerprint. Fingerprints of documents that meet one
of the benchmark are extended to the windows around them, which are compared word by word.

The benchmark is cut into slices of at most SLICE_BYTES of text. Each slice is indexed and
broadcast; a document passes all slices without being shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from rowmark.llm._common import (
    LOWER, byte_set, gram_hashes, joined_bytes, pieces, window_minima, word_hashes, word_ranges,
)
from rowmark.llm._repeats import row_keys

#: Words in a window, and in a fingerprint.
WINDOW, GRAM = 10, 5
#: Bytes of benchmark text that are indexed and broadcast at a time.
SLICE_BYTES = 8 << 20
#: Everything but digits, letters and non-ASCII bytes; A-Z are lowered before.
_SEPARATOR = byte_set((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))

_HITS = pa.schema(
    [("doc_id", pa.int64()), ("text_key", pa.int64()), ("text", pa.string()), ("spans", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))]
)
_RESULT = pa.schema(
    [("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()),
     ("items_sha256", pa.string()), ("contaminated", pa.bool_())]
)


@dataclass
class Words:
    """The words of several texts: bytes, ranges, hashes, and each text's first word."""

    data: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hashes: np.ndarray

    @classmethod
    def of(cls, texts: pa.Array) -> Words:
        data, starts, _ = joined_bytes(texts, b" ")
        data = LOWER[data]
        begin, end, first = word_ranges(data, _SEPARATOR, starts)
        return cls(data, begin, end, first, word_hashes(data, begin, end))

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def window(self, start: int, n: int) -> bytes:
        return b" ".join(self.data[self.begin[i] : self.end[i]].tobytes() for i in range(start, start + n))

    def starts(self, n: int) -> np.ndarray:
        """Where runs of n words lie within one text, as booleans by first word."""
        owner = self.owner()
        return owner[: max(0, len(owner) - n + 1)] == owner[n - 1 :]

    def fingerprints(self) -> np.ndarray:
        """Positions of the selected five-word hashes."""
        grams = gram_hashes(self.hashes, GRAM)
        chosen = window_minima(grams, WINDOW - GRAM + 1)
        return np.unique(chosen[self.starts(WINDOW)]) if len(chosen) else chosen


@dataclass
class Index:
    """Fingerprints and windows of a slice of the benchmark."""

    fingerprints: np.ndarray
    windows: dict[int, dict[int, list[tuple[bytes, list[str]]]]] = field(default_factory=dict)

    @classmethod
    def of(cls, ids: list[str], texts: pa.Array) -> Index:
        words = Words.of(texts)
        index = cls(np.unique(gram_hashes(words.hashes, GRAM)[words.fingerprints()]))
        for i, item in enumerate(ids):
            low, high = words.first[i], words.first[i + 1]
            n = min(WINDOW, high - low)
            if not n:
                continue
            hashes = gram_hashes(words.hashes[low:high], n)
            table = index.windows.setdefault(int(n), {})
            for j, h in enumerate(hashes.tolist()):
                text = words.window(low + j, n)
                same = next((x for x in table.setdefault(h, []) if x[0] == text), None)
                if same is None:
                    table[h].append((text, [item]))
                elif item not in same[1]:
                    same[1].append(item)
        return index


def find(words: Words, index: Index) -> Iterator[tuple[int, int, list[str]]]:
    """(first word, words, items) of each occurrence of a benchmark window."""
    if not len(words.hashes):
        return
    for n, table in index.windows.items():
        inside = words.starts(n)
        if n == WINDOW:
            chosen = words.fingerprints()
            grams = gram_hashes(words.hashes, GRAM)
            hits = chosen[np.isin(grams[chosen], index.fingerprints)]
            around = hits[:, None] - np.arange(WINDOW - GRAM + 1)
            places = np.unique(around[around >= 0])
            places = places[places < len(inside)]
            places = places[inside[places]]
            keys = np.array([gram_hashes(words.hashes[p : p + n], n)[0] for p in places], np.uint64)
        else:
            places = np.flatnonzero(inside)
            keys = gram_hashes(words.hashes, n)[places]
            found = np.isin(keys, np.fromiter(table, np.uint64, len(table)))
            places, keys = places[found], keys[found]
        for place, key in zip(places.tolist(), keys.tolist(), strict=True):
            for text, items in table.get(key, ()):
                if words.window(place, n) == text:
                    yield place, n, items


def _search(handle, first: bool, last: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts, n = batch.column("text"), batch.num_rows
            words = Words.of(texts)
            spans: list[list[int]] = [[] for _ in range(n)] if first else batch.column("spans").to_pylist()
            items: list[list[str]] = [[] for _ in range(n)] if first else batch.column("items").to_pylist()
            for place, length, found in find(words, handle.value):
                doc = int(np.searchsorted(words.first, place, side="right")) - 1
                spans[doc].append((place - int(words.first[doc])) * 16 + length)
                items[doc] += found
            if not last:
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("text_key"), texts, pa.array(spans, _HITS.field("spans").type),
                     pa.array([sorted(set(x)) for x in items], _HITS.field("items").type)], schema=_HITS,
                )
                continue
            counts = np.diff(words.first)
            rows: list[list] = [batch.column("doc_id").to_pylist(), batch.column("text_key").to_pylist(), counts.tolist(), [], [], [], []]
            for doc in range(n):
                hit = np.zeros(counts[doc], bool)
                for span in spans[doc]:
                    hit[span // 16 : span // 16 + span % 16] = True
                ids = sorted(set(items[doc]))
                for column, value in zip(
                    rows[3:],
                    (int(hit.sum()), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit.any())),
                    strict=True,
                ):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(rows, _RESULT, strict=True)], schema=_RESULT
            )

    return run


def contamination(documents: DataFrame, benchmark: DataFrame, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document.

    A window is ten consecutive words of an item; an item of one to nine words is one window.
    A document's word inside any occurrence of a window counts as hit. Null and empty texts have
    no words; a null item id is the empty id; equal item ids are one item. Repeated documents
    are judged each. An empty benchmark hits nothing; an empty table gives no rows. Other
    columns are ignored.
    """
    return judged(documents, benchmark, slice_bytes).drop("text_key")


def judged(documents: DataFrame, benchmark: DataFrame, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """The same with text_key, the hash of the text that was judged."""
    spark = documents.sparkSession
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")
    )
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = max(1, -(-total * 5 // (slice_bytes * 4)))  # a quarter less than the bound on average
    found = documents.select(F.col("doc_id").cast("long"), row_keys()[1].alias("text_key"), F.col("text").cast("string"))
    for k in range(slices):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == k).toArrow()
        index = Index.of(part.column("item_id").to_pylist(), part.column("text").combine_chunks())
        last = k == slices - 1
        found = found.mapInArrow(
            _search(spark.sparkContext.broadcast(index), k == 0, last),
            "doc_id long, text_key long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
            if last
            else "doc_id long, text_key long, text string, spans array<long>, items array<string>",
        )
    return found


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_WORDS = (
    r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)
SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS words FROM documents),
b AS (SELECT item_id, {_WORDS} AS words FROM benchmark),
b_windows AS (
  SELECT DISTINCT item_id, least(10, len(words)) AS n, array_to_string(words[i : i + least(10, len(words)) - 1], ' ') AS gram
  FROM (SELECT item_id, words, unnest(range(1, len(words) - least(10, len(words)) + 2)) AS i FROM b WHERE len(words) > 0)
),
lengths AS (SELECT DISTINCT n FROM b_windows),
d_windows AS (
  SELECT doc_id, i, n, array_to_string(words[i : i + n - 1], ' ') AS gram
  FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM d, lengths WHERE len(words) >= n)
),
hits AS (SELECT doc_id, i, n, item_id FROM d_windows JOIN b_windows USING (n, gram)),
words_hit AS (SELECT doc_id, count(DISTINCT w) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS w FROM hits) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hits) GROUP BY doc_id
)
SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words_hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""
