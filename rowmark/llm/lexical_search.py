"""Ranked lexical search: best-first document intervals over range-maximum tables of postings.

1. Documents become postings (term, document, occurrences) of the terms that the items ask for;
   a marker per document carries the counts over all documents.
2. Postings are dealt into shards of about SHARD_POSTINGS, whole documents together, whatever the
   number of documents. A posting's value is the most it can add to a score.
3. In a shard a sparse table over all posting lists answers, for a term and an interval of
   documents, where the largest value lies. The sum of these maxima over the terms of an item
   bounds every score in the interval. The interval with the highest bound is opened first: the
   document with the single largest value is scored, and the intervals left and right of it go
   on with bounds of their own, until no bound can reach the k best of the shard.
4. The best of all shards are ranked.

Rows of a shard reach its task as one sorted stream, postings first, then items one by one, so a
task holds one shard and one batch of items at a time, however large the two tables are.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from rowmark.llm._common import pieces, shuffle_parts, written

#: Postings of a shard, roughly: what a task holds and searches at once.
SHARD_POSTINGS = 1 << 19
#: Intervals opened at a time, those with the highest bounds first.
OPENED = 32

_IN_TERM = [48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)]
_TABLE = bytes((b + 32 if 65 <= b <= 90 else b) if _IN_TERM[b] else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """Runs of ASCII letters, digits and non-ASCII characters, A-Z in lower case."""
    return text.translate(_TABLE).split()


def _counted(batches: Iterator[pa.RecordBatch], marked: bool) -> Iterator[pa.RecordBatch]:
    """(row, id, n, term, tf) per row and term; with `marked`, also the empty term once per row."""
    for batch in pieces(batches):
        counts, lengths = [], []
        for text in batch.column("text").cast(pa.binary()).to_pylist():
            words = terms_of(text) if text else []
            lengths.append(len(words))
            counts.append(Counter(words))
            if marked and words:
                counts[-1][b""] = 0
        sizes = np.fromiter(map(len, counts), np.int64, len(counts))
        take = pa.array(np.repeat(np.arange(len(counts)), sizes))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("row").take(take),
                batch.column("id").take(take),
                pa.array(np.repeat(np.array(lengths, np.int64), sizes)),
                pa.array([w for c in counts for w in c], pa.binary()),
                pa.array([f for c in counts for f in c.values()], pa.int64()),
            ],
            names=["row", "id", "n", "term", "tf"],
        )


def _term_counts(df: DataFrame, id_column: str, marked: bool) -> DataFrame:
    rows = df.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_column).alias("id"), F.col("text").cast("string").alias("text")
    )
    id_type = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(lambda b: _counted(b, marked), f"row long, id {id_type}, n long, term binary, tf long")


class Shard:
    """Posting lists of some documents, with one sparse table of maxima over all of them."""

    def __init__(self, docs: np.ndarray, terms: np.ndarray, values: np.ndarray, size: int):
        """docs: ordinals below `size`; terms: any integers; one posting per (document, term)."""
        self.size = size
        self.terms, local = np.unique(terms, return_inverse=True)
        key = local.astype(np.int64) * size + docs
        order = np.argsort(key, kind="stable")
        self.key, self.values = key[order], values[order]
        self.doc = np.append(docs[order], -1)
        self.value = np.append(self.values, 0)  # the place -1 stands for no posting
        longest = int(np.bincount(local, minlength=1).max()) if len(local) else 0
        # levels[j][i]: place of the largest of 2**j values from place i on, the first of equals.
        self.levels = [np.arange(len(key), dtype=np.int32)]
        while 2 << len(self.levels) - 1 <= longest:
            step, last = 1 << len(self.levels) - 1, self.levels[-1]
            n = max(0, len(key) - 2 * step + 1)
            left, right = last[:n], last[step : step + n]
            level = np.zeros(len(key), np.int32)
            level[:n] = np.where(self.values[right] > self.values[left], right, left)
            self.levels.append(level)
        self.table = np.stack(self.levels) if len(key) else np.zeros((1, 0), np.int32)
        self.log = np.frexp(np.arange(longest + 2))[1] - 1

    def largest(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Place of the largest value in places a to b - 1 of one list; -1 if there are none."""
        level = self.log[b - a]
        end = len(self.key) - 1
        left = self.table[level, np.minimum(a, end)]
        right = self.table[level, np.maximum(b - (1 << np.maximum(level, 0)), 0)]
        return np.where(b > a, np.where(self.values[right] > self.values[left], right, left), -1)

    def best(self, terms: np.ndarray, times: np.ndarray, k: int) -> list[tuple[int, int]]:
        """(score, document) of the k best documents with a score above 0, equal scores by document."""
        at = np.searchsorted(self.terms, terms)
        known = (at < len(self.terms)) & (self.terms[np.minimum(at, max(len(self.terms) - 1, 0))] == terms) if len(self.terms) else np.zeros(len(terms), bool)
        base, times = at[known] * self.size, times[known]
        if not len(base):
            return []
        a, b = np.searchsorted(self.key, base)[None], np.searchsorted(self.key, base + self.size)[None]
        low = np.zeros(1, np.int64)
        bound, split = self._bound(a, b, times)
        found: list[tuple[int, int]] = []
        least = last = None  # score and document of the k-th best so far
        while len(bound):
            opened = np.argpartition(-bound, OPENED)[:OPENED] if len(bound) > OPENED else np.arange(len(bound))
            rest = np.ones(len(bound), bool)
            rest[opened] = False
            a1, b1, low1, doc = a[opened], b[opened], low[opened], split[opened]
            place = np.searchsorted(self.key, base + doc[:, None])
            here = np.minimum(place, len(self.key) - 1)
            hit = (place < b1) & (self.key[here] == base + doc[:, None])
            scores = (np.where(hit, self.values[here], 0) * times).sum(1)
            found = sorted([*found, *zip((-scores).tolist(), doc.tolist(), strict=True)])[:k]
            if len(found) == k:
                least, last = -found[-1][0], found[-1][1]
            a2, b2 = np.concatenate([a1, place + hit]), np.concatenate([place, b1])
            low2 = np.concatenate([low1, doc + 1])
            bound2, split2 = self._bound(a2, b2, times)
            a, b, low = np.concatenate([a[rest], a2]), np.concatenate([b[rest], b2]), np.concatenate([low[rest], low2])
            bound, split = np.concatenate([bound[rest], bound2]), np.concatenate([split[rest], split2])
            # An interval whose bound only equals the k-th best counts if it begins before it.
            keep = bound > 0 if least is None else (bound > least) | ((bound == least) & (low < last))
            a, b, low, bound, split = a[keep], b[keep], low[keep], bound[keep], split[keep]
        return [(-score, doc) for score, doc in found if score < 0]

    def _bound(self, a: np.ndarray, b: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sum of the maxima of each interval, and the document of the largest of them."""
        places = self.largest(a, b)
        most = self.value[places] * times
        return most.sum(1), self.doc[places[np.arange(len(most)), most.argmax(1)]].astype(np.int64)


_FOUND = "row long, doc_row long, doc_id {id}, score long"


def _search(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """A stream sorted by shard with postings before items; results item by item."""
    shard, held, index = None, [], None
    for batch in batches:
        edges = np.flatnonzero(np.diff(batch.column("shard").to_numpy())) + 1
        for start, end in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
            part = batch.slice(start, end - start)
            if (number := part.column("shard")[0].as_py()) != shard:
                shard, held, index = number, [], None
            items_from = int(pc.sum(pc.invert(part.column("is_item"))).as_py() or 0)
            if items_from:
                held.append(part.slice(0, items_from).select(["row", "id", "term", "value"]))
            if items_from == part.num_rows or not held:
                continue
            if index is None:
                index = _index(pa.Table.from_batches(held))
                held = [held[0].slice(0, 0)]
            yield from _answers(part.slice(items_from), k, *index)


def _index(postings: pa.Table) -> tuple[Shard, pa.Array, pa.Array]:
    """The shard, and rows and ids of its documents in the order of their ordinals."""
    rows = postings.column("row").to_numpy()
    first = np.unique(rows, return_index=True)[1]
    docs = postings.select(["row", "id"]).take(pa.array(first)).combine_chunks()
    order = pc.sort_indices(docs, [("id", "ascending"), ("row", "ascending")], null_placement="at_end")
    ordinal = np.empty(len(first), np.int64)
    ordinal[order.to_numpy()] = np.arange(len(first))
    docs_of = ordinal[np.searchsorted(rows[first], rows)]
    shard = Shard(docs_of, postings.column("term").to_numpy(), postings.column("value").to_numpy(), len(first))
    docs = docs.take(order).combine_chunks()
    return shard, docs.column("row").combine_chunks(), docs.column("id").combine_chunks()


def _answers(items: pa.RecordBatch, k: int, shard: Shard, rows: pa.Array, ids: pa.Array) -> Iterator[pa.RecordBatch]:
    for row, terms in zip(items.column("row").to_pylist(), items.column("terms"), strict=True):
        asked = terms.values
        found = shard.best(asked.field("term").to_numpy(), asked.field("times").to_numpy(), k)
        if found:
            at = pa.array([doc for _, doc in found], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array([row] * len(found), pa.int64()), rows.take(at), ids.take(at), pa.array([s for s, _ in found], pa.int64())],
                names=["row", "doc_row", "doc_id", "score"],
            )


def rank_documents(items: DataFrame, documents: DataFrame, k: int = 20, shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """item_id, text of the item, rank, doc_id, score: the k best documents of each item.

    The score is the sum over the item's terms, repeats included, of
    w * ((1000000000 tf) div (1000 tf + 12 m)); w falls with the documents that hold the term, m
    rises with the document's length. Only scores above 0 count, equal ones by ascending doc_id.

    Null and blank texts hold no terms: such documents are not counted, such items find nothing.
    Rows of items that agree in item_id and text are one item; the same id with another text is
    another item. Every row of documents is a document of its own, also when ids repeat or are
    null (null ids come last among equals, equal rows in any order). Empty tables: no rows. Other
    columns are ignored.
    """
    spark = documents.sparkSession
    asked = items.select("item_id", F.col("text").cast("string").alias("text")).distinct()
    asked = written(asked.withColumn("item", F.monotonically_increasing_id()))
    of_items = written(_term_counts(asked, "item", False).select(F.col("id").alias("item"), "term", "tf"))
    terms = of_items.select("term").distinct().select("term", F.monotonically_increasing_id().alias("number"))
    marker = spark.range(1).select(F.lit(b"").alias("term"), F.lit(-1).cast("long").alias("number"))
    terms = written(terms.unionByName(marker))
    postings = written(_term_counts(documents, "doc_id", True).join(terms, "term").drop("term"))

    total = postings.where("number = -1").agg(F.count("*").alias("N"), F.coalesce(F.sum("n"), F.lit(0)).alias("L")).first()
    postings = postings.where("number >= 0")
    held = postings.groupBy("number").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log((F.lit(2 * total.N + 2).cast("double")) / (2 * F.col("df") + 1))).cast("long")
    weighted = written(held.select("number", "df", weight.alias("w")))
    shards = max(1, -(-(weighted.agg(F.sum("df")).first()[0] or 0) // shard_postings))

    m = F.expr(f"75 + (25 * n * {total.N}L) div {max(total.L, 1)}L")
    value = F.expr("w * ((1000000000L * tf) div (1000 * tf + 12 * m))")
    valued = postings.join(weighted, "number").withColumn("m", m).withColumn("value", value).where("value > 0")
    of_docs = valued.select(
        F.pmod(F.xxhash64("row"), F.lit(shards)).alias("shard"), F.lit(False).alias("is_item"), "row", "id",
        F.col("number").alias("term"), "value", F.lit(None).cast("array<struct<term:bigint,times:bigint>>").alias("terms"),
    )
    wanted = of_items.join(terms, "term").groupBy("item").agg(
        F.collect_list(F.struct(F.col("number").alias("term"), F.col("tf").alias("times"))).alias("terms")
    )
    to_shards = wanted.select(
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), F.lit(True).alias("is_item"),
        F.col("item").alias("row"), F.lit(None).cast(of_docs.schema["id"].dataType).alias("id"),
        F.lit(None).cast("long").alias("term"), F.lit(None).cast("long").alias("value"), "terms",
    )
    dealt = of_docs.unionByName(to_shards).repartition(max(shards, shuffle_parts(spark)), "shard")
    found = dealt.sortWithinPartitions("shard", "is_item").mapInArrow(
        lambda batches: _search(batches, k), _FOUND.format(id=of_docs.schema["id"].dataType.simpleString())
    )
    place = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "doc_row"))
    ranked = found.withColumn("rank", place).where(F.col("rank") <= k)
    named = asked.select(F.col("item").alias("row"), "item_id", "text")
    return ranked.join(named, "row").select("item_id", "text", "rank", "doc_id", "score")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, documents = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("benchmark", "documents"))
    return rank_documents(items, documents).drop("text")


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_SPLIT = f"unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}')) AS term"
SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
words AS (SELECT r, doc_id, {_SPLIT} FROM docs),
lengths AS (SELECT r, count(*) AS n FROM words GROUP BY r),
total AS (SELECT count(*) AS all_docs, sum(n)::BIGINT AS all_terms FROM lengths),
postings AS (SELECT r, doc_id, term, count(*) AS tf FROM words GROUP BY r, doc_id, term),
weights AS (
  SELECT term, floor(1000 * ln((2 * all_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM postings GROUP BY term), total
),
asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, {_SPLIT} FROM benchmark) GROUP BY item_id, term),
scores AS (
  SELECT item_id, r, doc_id,
    sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * all_docs) // all_terms))))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN postings USING (term) JOIN lengths USING (r), total
  GROUP BY item_id, r, doc_id
),
ranked AS (
  SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score
  FROM scores WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""
