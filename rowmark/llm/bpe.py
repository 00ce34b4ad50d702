"""Byte-level BPE encoding and decoding by forced-boundary splitting.

A pair of adjacent bytes that occurs inside no vocabulary token can never be merged: the text
may be cut there for certain. Texts are first split as the vocabulary's own pre-tokenizer does
(and at special tokens), each part is cut at its forced boundaries, and the fragments are
encoded independently by the ranked merges; the ids of the fragments are concatenated. Parts and
fragments repeat all over a corpus, so their ids are remembered in tables of bounded size.
Decoding concatenates the bytes of the ids.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from rowmark.llm._common import pieces

#: Parts of text whose ids a worker remembers.
REMEMBERED = 400_000
#: Fragments are merged together with others of up to the same length; longer ones alone.
_WIDTHS = (1, 2, 3, 4, 6, 8, 11, 15, 24, 48)
_NONE = 1 << 40
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: How byte-level vocabularies split text (the public pre-tokenizer pattern, white space spelt out).
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+"
    rf"| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
)


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary file, by character."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


class ByteBPE:
    """A byte-level BPE vocabulary read from a tokenizer file (JSON)."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        alphabet, model = byte_alphabet(), content["model"]
        vocabulary = {word: i for word, i in model["vocab"].items()}
        special = {t["content"]: t["id"] for t in content["added_tokens"]}
        size = max([*vocabulary.values(), *special.values()]) + 1
        self.tokens: list[bytes] = [b""] * size
        for word, i in vocabulary.items():
            self.tokens[i] = bytes(alphabet[c] for c in word) if all(c in alphabet for c in word) else word.encode()
        for word, i in special.items():
            self.tokens[i] = word.encode()
        self.special = special
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")")
        self.of_byte = [vocabulary.get(c, -1) for c, _ in sorted(alphabet.items(), key=lambda x: x[1])]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocabulary[left], vocabulary[right]] = (rank, vocabulary[left + right])
        inside = np.zeros((256, 256), bool)
        for token in self.tokens:
            codes = np.frombuffer(token, np.uint8)
            inside[codes[:-1], codes[1:]] = True
        self.inside = inside
        keys = sorted((left * size + right, rank, made) for (left, right), (rank, made) in self.merges.items())
        self.size, self.remembered = size, remembered
        self.pair_keys, self.pair_ranks, self.pair_made = (np.array(c, np.int64) for c in zip(*keys, strict=True))
        self.byte_ids = np.array(self.of_byte, np.int64)
        self.decimal = [str(i) for i in range(size)]
        self.parts: dict[str, str] = {}
        self.pattern = regex.compile(PATTERN)
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(self.tokens), np.uint8)

    def fragments(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Where fragments begin: at the parts' starts, and at forced boundaries."""
        begins = np.zeros(len(data), bool)
        begins[starts] = True
        begins[1:] |= ~self.inside[data[:-1], data[1:]]
        return np.flatnonzero(begins)

    def learn(self, parts: list[str]) -> None:
        """Encode new parts, all fragments of about equal length at once, and remember their ids."""
        raw = [p.encode() for p in parts]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        starts = np.cumsum(sizes) - sizes
        data = np.frombuffer(b"".join(raw), np.uint8)
        begin = self.fragments(data, starts)
        length = np.diff(np.r_[begin, len(data)])
        encoded: list[str] = [""] * len(begin)
        below = 0
        for width in _WIDTHS:
            chosen = np.flatnonzero((length > below) & (length <= width))
            for low in range(0, len(chosen), 20_000):
                some = chosen[low : low + 20_000]
                at = begin[some][:, None] + np.arange(width)
                ids = np.where(np.arange(width) < length[some][:, None], self.byte_ids[data[np.minimum(at, len(data) - 1)]], -1)
                for i, row in zip(some.tolist(), self._merge_rows(ids).tolist(), strict=True):
                    encoded[i] = ",".join([self.decimal[x] for x in row if x >= 0])
            below = width
        for i in np.flatnonzero(length > below).tolist():
            piece = data[begin[i] : begin[i] + length[i]]
            encoded[i] = ",".join(map(str, self._many([self.of_byte[x] for x in piece.tolist()])))
        first = np.searchsorted(begin, np.r_[starts, len(data)])
        for part, low, high in zip(parts, first[:-1].tolist(), first[1:].tolist(), strict=True):
            self.parts[part] = encoded[low] if high == low + 1 else ",".join(encoded[low:high])

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks and merged ids of pairs; the rank is _NONE where a pair does not merge."""
        keys = left * self.size + right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        found = (self.pair_keys[at] == keys) & (left >= 0) & (right >= 0)
        return np.where(found, self.pair_ranks[at], _NONE), self.pair_made[at]

    def _merge_rows(self, ids: np.ndarray) -> np.ndarray:
        """Merge the best pair of every row until none is left; -1 fills the rows up."""
        out, width = ids.copy(), ids.shape[1]
        if width == 1:
            return out
        rows, columns = np.arange(len(ids)), np.arange(width)
        ranks, made = self._pairs(ids[:, :-1], ids[:, 1:])
        while True:
            best = ranks.argmin(1)
            line = np.arange(len(ids))
            live = ranks[line, best] < _NONE
            if not live.all():
                out[rows[~live]] = ids[~live]
                ids, ranks, made, rows, best = ids[live], ranks[live], made[live], rows[live], best[live]
                line = line[: len(ids)]
            if not len(ids):
                return out
            ids[line, best] = made[line, best]
            shift = columns + (columns > best[:, None])
            ids = np.take_along_axis(np.c_[ids, np.full(len(ids), -1)], shift, 1)
            shift = columns[:-1] + (columns[:-1] > best[:, None])
            ranks = np.take_along_axis(np.c_[ranks, np.full(len(ids), _NONE)], shift, 1)
            made = np.take_along_axis(np.c_[made, np.zeros(len(ids), np.int64)], shift, 1)
            right = np.where(best + 1 < width, ids[line, np.minimum(best + 1, width - 1)], -1)
            here = np.minimum(best, width - 2)
            rank, product = self._pairs(ids[line, best], right)
            ranks[line, here], made[line, here] = rank, product
            before = np.flatnonzero(best > 0)
            at = best[before] - 1
            ranks[before, at], made[before, at] = self._pairs(ids[before, at], ids[before, best[before]])

    def _many(self, ids: list[int]) -> list[int]:
        """Merge one long fragment with a heap of pairs and a linked list."""
        n = len(ids)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = []

        def offer(i: int) -> None:
            j = after[i]
            if j >= 0 and (found := self.merges.get((ids[i], ids[j]))):
                heapq.heappush(heap, (found[0], i, ids[i], ids[j], found[1]))

        for i in range(n):
            offer(i)
        while heap:
            _, i, left, right, made = heapq.heappop(heap)
            j = after[i] if ids[i] == left else -1
            if j < 0 or ids[j] != right:
                continue
            ids[i], ids[j] = made, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [x for x in ids if x >= 0]

    def encode(self, texts: list[str]) -> list[str]:
        """Decimal ids of each text, joined by commas."""
        if len(self.parts) > self.remembered:
            self.parts = {}
        cut = []
        for text in texts:
            parts = []
            for i, stretch in enumerate(self.split_special.split(text) if self.special else [text]):
                if i % 2:
                    self.parts[stretch] = self.decimal[self.special[stretch]]
                    parts.append(stretch)
                else:
                    parts += self.pattern.findall(stretch)
            cut.append(parts)
        new = set().union(*cut) - self.parts.keys()
        if new:
            self.learn(sorted(new))
        known = self.parts.__getitem__
        return [",".join(map(known, parts)) for parts in cut]

    def decode(self, ids: np.ndarray) -> str:
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        where = np.repeat(self.offsets[ids] - (ends - lengths), lengths) + np.arange(total)
        return self.bytes[where].tobytes().decode("utf-8", errors="replace")


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> ByteBPE:
    """One vocabulary per worker process."""
    return ByteBPE(path)


_RESULT = pa.schema(
    [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
)


def _digests(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in pieces(batches):
            rows: list[list] = [batch.column("doc_id").to_pylist(), [], [], []]
            for ids in bpe.encode([t or "" for t in batch.column("text").to_pylist()]):
                numbers = np.fromstring(ids, np.int64, sep=",") if ids else np.zeros(0, np.int64)
                rows[1].append(len(numbers))
                rows[2].append(hashlib.sha256(ids.encode()).hexdigest())
                rows[3].append(hashlib.sha256(bpe.decode(numbers).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, _RESULT, strict=True)], schema=_RESULT)

    return run


def token_digests(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document.

    Null and empty texts have no tokens and decode to the empty text. Special tokens of the
    vocabulary are recognised in texts. Repeated rows are encoded each; an empty table gives no
    rows; other columns are ignored. `path` must be readable on every executor.
    """
    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(_digests(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_documents(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array of int) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in pieces(batches):
            encoded = bpe.encode([t or "" for t in batch.column("text").to_pylist()])
            ids = [[int(x) for x in e.split(",") if x] for e in encoded]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"]
            )

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, ids array<int>"
    )


def op5_bpe(spark: SparkSession, sf_dir: str, name: str = "byte_bpe_50k.json") -> DataFrame:
    import public_tokenizers

    return token_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path(name))
