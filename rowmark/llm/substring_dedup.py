"""Substring deduplication on a compacted De Bruijn graph of words.

Windows of 35 words are the edges of the graph. Runs of windows around one anchor (see
`_repeats`) are paths: a path that is entered and left in one way wherever it occurs is not
branching, and stays compact: one row for all its edges, joined on its content. Only paths
through anchors with several contents are opened into single edges, which are counted and joined
again. Source coordinates (document, first word) carry the result back, where the covered words
are cut from the text. Contents and edges are compared by 128 bits of hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from rowmark.llm._common import WHITE, gram_hashes, joined_bytes, pieces, range_hashes, word_hashes, word_ranges, written
from rowmark.llm._repeats import KEYS, Segments, segments, unpack, without_repeats

#: Words in a window, and in an anchor.
WINDOW, ANCHOR = 35, 8

_RESULT = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())]
)


def _hashed(texts: pa.Array, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the index of each text's first word."""
    data, starts, _ = joined_bytes(texts, b" ")
    begin, end, first = word_ranges(data, WHITE, starts)
    return word_hashes(data, begin, end, which), first


def _cutter(window: int, anchor: int):
    def cut(texts: pa.Array) -> Segments:
        words, first = _hashed(texts)
        return segments(gram_hashes(words, anchor), words, first[:-1], first[1:], window, anchor)

    return cut


def _edges(window: int):
    """Single edges of the opened paths: two hashes, key, first word, and whether it is in question."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            (words, first), (other, _) = _hashed(batch.column("text")), _hashed(batch.column("text"), 1)
            owners, places, asked = [], [], []
            for column, question in (("open", True), ("sample", False)):
                for i, found in enumerate(batch.column(column).to_pylist()):
                    for place in found or []:
                        start, count, _ = unpack(place)
                        owners.append(np.full(count, i))
                        places.append(np.arange(start, start + count))
                        asked.append(np.full(count, question))
            if not owners:
                continue
            owner, place = np.concatenate(owners), np.concatenate(places)
            begin = first[owner] + place
            rows = pa.array(owner)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(range_hashes(words, begin, begin + window).view(np.int64)),
                    pa.array(range_hashes(other, begin, begin + window, 1).view(np.int64)),
                    batch.column("doc_key").take(rows),
                    batch.column("text_key").take(rows),
                    pa.array(place),
                    pa.array(np.concatenate(asked)),
                ],
                names=["edge", "check", *KEYS, "place", "asked"],
            )

    return work


def _compare(window: int):
    def compare(texts: DataFrame) -> DataFrame:
        edges = texts.mapInArrow(
            _edges(window), "edge long, check long, doc_key long, text_key long, place long, asked boolean"
        )
        counted = edges.groupBy("edge", "check").agg(F.count("*").alias("times"))
        repeated = written(counted.where("times > 1").drop("times"))
        found = edges.where("asked").join(repeated, ["edge", "check"])
        return found.select(*KEYS, (F.shiftleft("place", 10) + window).alias("covered"))

    return compare


def _finish(text: bytes, runs: list[tuple[int, int]]) -> tuple[int, int, str]:
    words = text.split()  # at blanks and tab to carriage return, as bytes
    removed = sum(high - low for low, high in runs)
    total = len(words)
    for low, high in reversed(runs):
        del words[low:high]
    return total, removed, hashlib.sha256(b" ".join(words)).hexdigest()


def repeated_words(documents: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document.

    A word goes if a window of `window` words around it also starts anywhere else, in another or
    the same document, as the documents stand. Null and empty texts have no words; texts shorter
    than a window keep all theirs. Repeated rows repeat each other. An empty table gives no
    rows; other columns are ignored.
    """
    return without_repeats(
        documents, _cutter(window, anchor), window, _compare(window), _finish, _RESULT,
        "doc_id long, n_words long, n_removed long, kept_sha256 string",
    )


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_words(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
SQL = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS words FROM documents),
w AS (SELECT doc_id, i, array_to_string(words[i : i + 34], ' ') AS gram
      FROM (SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS i FROM d WHERE len(words) >= 35)),
again AS (SELECT gram FROM w GROUP BY gram HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM w JOIN again USING (gram)),
every AS (SELECT doc_id, p, words[p] AS word FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS p FROM d)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS body FROM every ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, len(words) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
FROM d LEFT JOIN lost USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
