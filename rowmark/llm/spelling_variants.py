"""Spelling variants: words one edit apart, found through pivotal grams.

1. Words are counted over all documents, after the deletions that the corpus rule asks for.
2. Bigrams are ranked by how many places of the vocabulary hold them, rare ones first. A word's
   prefix is its three rarest bigram places with all places of equally rare bigrams; among them
   dynamic programming chooses the two disjoint places of least total frequency, its pivots.
3. One edit spoils at most one of two disjoint bigrams, so of two words one apart, the one whose
   prefix ends earlier has a pivot in the prefix of the other. The edit lies behind that bigram or
   before it, so the word is intact on the other side of it, which fixes the bigram's position from
   that end. What lies on the side of the edit is intact in its first or its second half. Pivots
   and prefixes meet in a join on the intact part, the length and half of the rest.
4. Candidates are verified by their edit distance. Forms follow the most frequent near word.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rowmark.llm._common import pieces, shuffle_parts, written

#: Distinct words that a task counts before it hands them on.
COUNTED = 200_000
#: Words up to this length are hashed together, longer ones one by one.
TOGETHER = 64
GRAM, PIVOTS = 2, 2
PREFIX = GRAM + 1  # one edit spoils at most GRAM places

_LETTERS = np.zeros(256, bool)
_LETTERS[ord("a") : ord("z") + 1] = True
_LETTERS[0xC0:] = True
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()


def _run_hashes(data: np.ndarray, begin: np.ndarray, length: np.ndarray, state: np.ndarray) -> np.ndarray:
    """crc32 of each run in UTF-8, going on from `state` (the crc32 of what stands before it)."""
    out = np.empty(len(begin), np.uint32)
    order = np.argsort(-length, kind="stable")
    begin, length, state = begin[order], length[order], ~state[order]
    alone = int(np.searchsorted(-length, -TOGETHER, side="left"))
    for i in range(alone):
        run = data[begin[i] : begin[i] + length[i]].tobytes().decode("latin-1").encode()
        state[i] = ~np.uint32(zlib.crc32(run, int(~state[i])))
    live = len(begin)
    for k in range(TOGETHER):
        live = int(np.searchsorted(-length[:live], -k, side="left"))  # runs longer than k
        if live <= alone:
            break
        byte, s = data[begin[alone:live] + k].astype(np.uint32), state[alone:live]
        two = byte >= 0xC0  # U+00C0 to U+00FF: C3 and one more byte
        s = np.where(two, _CRC[(s ^ 0xC3) & 0xFF] ^ (s >> 8), s)
        byte = np.where(two, byte - 0x40, byte)
        state[alone:live] = _CRC[(s ^ byte) & 0xFF] ^ (s >> 8)
    out[order] = ~state
    return out


def _words(ids: list[int | None], texts: list[str | None], least: int, every: int) -> list[bytes]:
    """Words of at least `least` letters in Latin-1, with the deletions made."""
    # One byte per code point: all letters are Latin-1, anything else becomes a separator.
    coded = [(t or "").encode("latin-1", "replace").translate(_LOWER) for t in texts]
    data = np.frombuffer(b" ".join(coded) + b" ", np.uint8)
    edges = np.diff(np.r_[False, _LETTERS[data], False].astype(np.int8))
    begin, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    long = end - begin >= least
    begin, end = begin[long], end[long]
    starts = np.cumsum([0] + [len(c) + 1 for c in coded])[:-1]
    states = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], np.uint32)
    owner = np.searchsorted(starts, begin, side="right") - 1
    h = _run_hashes(data, begin, end - begin, states[owner])
    hit = h % every == 0
    kept = np.zeros(len(data), np.int8)
    stays = ~hit | (end - begin > least)
    np.add.at(kept, begin[stays], 1)
    np.add.at(kept, end[stays], -1)
    kept = np.cumsum(kept, dtype=np.int8)
    out = np.where(kept > 0, data, np.uint8(32))
    spoiled = hit & stays
    gone = begin[spoiled] + h[spoiled].astype(np.int64) % (end - begin)[spoiled]
    return np.delete(out, gone).tobytes().split()


def _count(batches: Iterator[pa.RecordBatch], least: int, every: int) -> Iterator[pa.RecordBatch]:
    counts: Counter[bytes] = Counter()

    def told() -> pa.RecordBatch:
        words = pa.array([w.decode("latin-1") for w in counts], pa.string())
        return pa.RecordBatch.from_arrays([words, pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    for batch in pieces(batches):
        counts.update(_words(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), least, every))
        if len(counts) >= COUNTED:
            yield told()
            counts.clear()
    if counts:
        yield told()


def word_counts(documents: DataFrame, least_letters: int = 6, least_count: int = 5, every: int = 199) -> DataFrame:
    """word, n: words of at least `least_letters` letters that occur at least `least_count` times.

    A run of letters loses one code point if `every` divides the crc32 of its document's id and
    itself (a null id counts as empty text). Null texts hold no words. Other columns are ignored.
    """
    rows = documents.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = rows.mapInArrow(lambda b: _count(b, least_letters, every), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def pivots_of(places: list[int], weights: list[int]) -> list[int]:
    """The PIVOTS disjoint bigram places of least total weight. places: ascending."""
    # best[j]: cheapest choice of j disjoint places so far, as (weight, places).
    ended: list[tuple[int, list[tuple[int, tuple[int, ...]] | None]]] = []
    best: list[tuple[int, tuple[int, ...]] | None] = [(0, ()), *[None] * PIVOTS]
    free, waiting = best, 0  # `free`: choices that end at least GRAM places before the current one
    for place, weight in zip(places, weights, strict=True):
        while waiting < len(ended) and ended[waiting][0] + GRAM <= place:
            free, waiting = ended[waiting][1], waiting + 1
        options = [best[0]]
        for j in range(1, PIVOTS + 1):
            taken = free[j - 1] and (free[j - 1][0] + weight, (*free[j - 1][1], place))
            options.append(min((c for c in (best[j], taken) if c), default=None))
        best = options
        ended.append((place, best))
    return list(best[PIVOTS][1])


def signature(word: str, frequency: dict[str, int]) -> tuple[list[str], list[str]]:
    """Keys of the pivots and keys of the prefix of a word of at least PREFIX + 1 letters.

    Two words one edit apart share a key of one's pivots and the other's prefix.
    """
    n = len(word)
    grams = [word[i : i + GRAM] for i in range(n - 1)]
    ranked = sorted((frequency[g], g) for g in grams)
    prefix = [i for i, g in enumerate(grams) if (frequency[g], g) <= ranked[PREFIX - 1]]
    pivots = pivots_of(prefix, [frequency[grams[i]] for i in prefix])
    of_pivots, of_prefix = [], []
    for i in prefix:
        for side, intact, rest in (("<", word[: i + GRAM], word[i + GRAM :]), (">", word[i:], word[:i])):
            half, other = len(rest) // 2, len(rest)
            of_prefix += [f"{side}{intact} {other} 1{rest[:half]}", f"{side}{intact} {other} 2{rest[half:]}"]
            if i not in pivots:
                continue
            for other in (len(rest) - 1, len(rest), len(rest) + 1):  # length of the rest in the other word
                half = other // 2
                if other >= 0 and half <= len(rest):
                    of_pivots.append(f"{side}{intact} {other} 1{rest[:half]}")
                if other >= 0 and other - half <= len(rest):
                    of_pivots.append(f"{side}{intact} {other} 2{rest[len(rest) - (other - half) :]}")
    return of_pivots, of_prefix


def _signatures(batches: Iterator[pa.RecordBatch], frequency: dict[str, int]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 2000):
            part = batch.slice(start, 2000)
            keys, sizes, pivotal = [], [], []
            for word in part.column("word").to_pylist():
                of_pivots, of_prefix = signature(word, frequency)
                keys += of_pivots
                keys += of_prefix
                sizes.append(len(of_pivots) + len(of_prefix))
                pivotal += [True] * len(of_pivots) + [False] * len(of_prefix)
            take = pa.array(np.repeat(np.arange(part.num_rows), sizes))
            yield pa.RecordBatch.from_arrays(
                [part.column("word").take(take), part.column("n").take(take), pa.array(pivotal, pa.bool_()), pa.array(keys, pa.string())],
                names=["word", "n", "pivotal", "key"],
            )


def near_words(words: DataFrame) -> DataFrame:
    """word, n, near, near_n: all ordered pairs of words that differ by exactly one code point.

    words: distinct words of at least six letters of the 90 that `word_counts` knows, with their
    counts n. There are at most 90 * 90 bigrams, which is what the driver gathers and hands out.
    """
    grams = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substr("word", i, F.lit(GRAM)))).alias("gram"))
    frequency = {r.gram: r["count"] for r in grams.groupBy("gram").count().collect()}
    signed = words.repartition(shuffle_parts(words.sparkSession)).mapInArrow(
        lambda b: _signatures(b, frequency), "word string, n long, pivotal boolean, key string"
    )
    signed = written(signed.select("word", "n", "pivotal", F.xxhash64("key").alias("key")))
    pivots = signed.where("pivotal").select("key", "word", "n")
    prefixes = signed.where("NOT pivotal").select("key", F.col("word").alias("near"), F.col("n").alias("near_n"))
    candidates = pivots.join(prefixes, "key").where("word <> near").where(F.levenshtein("word", "near", 1) == 1)
    # Each pair once, whichever of its words held the pivot and however many keys it shares.
    ahead = F.col("word") < F.col("near")
    counts = F.when(ahead, F.struct(F.col("n").alias("a"), F.col("near_n").alias("b"))).otherwise(F.struct(F.col("near_n").alias("a"), F.col("n").alias("b")))
    once = candidates.select(F.least("word", "near").alias("word"), F.greatest("word", "near").alias("near"), counts.alias("counts"))
    once = once.select("word", F.col("counts.a").alias("n"), "near", F.col("counts.b").alias("near_n"))
    once = written(once.distinct())
    return once.unionByName(once.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) by pointer doubling over (word, form); a form is more frequent than its word.

    Forms at least five times as frequent make chains of at most log5 of the largest count.
    """
    ends = written(forms.select("word", F.col("form").alias("root")))
    while True:
        further = ends.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = written(ends.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        ends = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return ends


def spelling_variants(documents: DataFrame, ratio: int = 5, **rules: int) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word; `rules` are those of `word_counts`.

    A word's form is its near word of largest n, the first in code-point order of equals, if that
    n is at least `ratio` times the word's; else null, as is form_n. The root follows forms to the
    last; it is the word itself without a form. Repeated rows of documents count each. Empty
    tables and tables of nulls: no rows.
    """
    words = written(word_counts(documents, **rules))
    nearest = near_words(words).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best")
    )
    fits: Column = -F.col("best.minus") >= ratio * F.col("n")
    joined = words.join(nearest, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(fits, F.col("best.near")).alias("form"), F.when(fits, -F.col("best.minus")).alias("form_n"),
    )
    joined = written(joined)
    roots = _roots(joined.where("form IS NOT NULL"))
    return joined.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))
