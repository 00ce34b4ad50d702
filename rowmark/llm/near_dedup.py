"""Near duplicates by SuperMinHash signatures, banding, verification and components.

1. Every document becomes the set of its five-word shingles (64-bit hashes) and a SuperMinHash
   signature: element by element, ranks drawn without repetition fill the places of the
   signature, so a document needs about one round per element and stops as soon as no later
   round can lower any place.
2. Documents with equal sets are one node. Nodes that agree in a band of the signature meet in a
   bucket; each bucket links its members to one hub, a star instead of all pairs.
   Hubs are the nodes that meet most others, the middles of their groups.
3. Stars are verified on the full sets (blocks of members against their hub), and components of
   verified links are found. Members of a bucket that are not connected to its hub (strays) are
   then compared with all members of other components, in blocks: by signature, then by sketches
   that bound the similarity of the full sets from above. Pairs that pass both are verified on
   the full sets. Components over all verified links are the result; pairs that fail a bound
   never become rows.

With independent places a pair at 0.85 misses all bands with a probability of 7e-8 (28 bands of
5; at 0.80 1.5e-5), and is dropped by its signatures with 1.2e-9 (at 0.80 1.7e-8).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from rowmark.llm._common import (
    LOWER, WHITE, few, gram_hashes, joined_bytes, mixed, pieces, shuffle_parts, word_hashes, word_ranges, written,
)
from rowmark.llm._components import components
from rowmark.llm._repeats import KEYS, keyed

SHINGLE = 5
BANDS, ROWS = 28, 5
PLACES = BANDS * ROWS
#: Pairs are left to the exact check unless the signatures put them this far below the threshold.
MARGIN = 0.2
#: Pairs, or rows of blocks, from which on their sets are moved by shuffles, whatever Spark would broadcast: one plan for all sizes.
SHUFFLED_PAIRS = 1000
#: Members of a bucket, and strays, that meet in one block. A larger bucket is a grid of such blocks.
BLOCK = 4000


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; the whole sequence as one if it is shorter."""
    data, starts, _ = joined_bytes(texts, b" ")
    data = LOWER[data]
    begin, end, first = word_ranges(data, WHITE, starts)
    words = word_hashes(data, begin, end)
    grams = gram_hashes(words, SHINGLE)
    out = []
    for low, high in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if high - low >= SHINGLE:
            out.append(np.unique(grams[low : high - SHINGLE + 1]))
        else:
            out.append(gram_hashes(words[low:high], high - low) if high > low else np.zeros(0, np.uint64))
    return out


def super_minhash(sets: list[np.ndarray], places: int = PLACES) -> np.ndarray:
    """Signatures (one row per set) of round << 24 | random 24 bits; empty sets are all ones.

    In round j an element draws a random number and the j-th place of its own permutation. A set
    is done once all its places hold values of rounds so far, as later rounds are larger.
    """
    signatures = np.full((len(sets), places), 0xFFFFFFFF, np.uint32)
    flat = signatures.reshape(-1)
    sizes = np.array([len(s) for s in sets])
    elements = np.concatenate([*sets, np.zeros(0, np.uint64)])
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = None  # permutations of the elements that go beyond the first round
    for j in range(places):
        if not len(elements):
            break
        drawn = mixed(elements + np.uint64((j + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
        value = (np.uint32(j) << np.uint32(24)) | (drawn >> np.uint64(40)).astype(np.uint32)
        pick = (j + (drawn & np.uint64(0xFFFFFFFF)) % np.uint64(places - j)).astype(np.int64)
        if order is None:
            place = pick
        else:
            row = np.arange(len(elements))
            place = order[row, pick].astype(np.int64)
            order[row, pick] = order[:, j]
            order[:, j] = place
        np.minimum.at(flat, owner * places + place, value)
        going = signatures.max(1) >= (j + 1) << 24
        keep = going[owner]
        if order is None:
            elements, owner, place = elements[keep], owner[keep], place[keep]
            order = np.tile(np.arange(places, dtype=np.uint8), (len(elements), 1))
            row = np.arange(len(elements))
            order[row, place] = 0
            order[:, 0] = place
        elif not keep.all():
            elements, owner, order = elements[keep], owner[keep], order[keep]
    return signatures


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        sets = shingle_sets(batch.column("text"))
        signatures = super_minhash(sets)
        bands = band_hashes(signatures)
        nodes = [int(mixed(mixed(s).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(s)))[0]) if len(s) else 0 for s in sets]
        yield pa.RecordBatch.from_arrays(
            [
                *(batch.column(c) for c in ("doc_id", *KEYS)),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array(np.array(nodes, np.uint64).view(np.int64)),
                pa.array(list(bands.view(np.int64)), pa.list_(pa.int64())),
            ],
            names=["doc_id", *KEYS, "n", "node", "bands"],
        )


def band_hashes(signatures: np.ndarray) -> np.ndarray:
    """A hash for each band of each signature; no two bands share one."""
    bands = mixed(gram_hashes_rows(signatures.astype(np.uint64).reshape(-1, BANDS, ROWS)))
    return bands + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def gram_hashes_rows(values: np.ndarray) -> np.ndarray:
    """A hash over the last axis."""
    h = np.zeros(values.shape[:-1], np.uint64)
    for j in range(values.shape[-1]):
        h = mixed(h + (values[..., j] + np.uint64(j + 1)) * np.uint64(0xC2B2AE3D27D4EB4F))
    return h


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sizes, folded signatures, band hashes, full sets, and sketches: the members' upper 16 bits, sorted."""
    for batch in pieces(batches):
        sets = shingle_sets(batch.column("text"))
        signatures = super_minhash(sets)
        small = (signatures ^ (signatures >> np.uint32(16))).astype(np.uint16)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("node"),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([r.tobytes() for r in small], pa.binary()),
                pa.array([r.tobytes() for r in band_hashes(signatures)], pa.binary()),
                pa.array([s.tobytes() for s in sets], pa.binary()),
                pa.array([(s >> np.uint64(48)).astype(np.uint16).tobytes() for s in sets], pa.binary()),
            ],
            names=["node", "n", "signature", "band_keys", "members", "sketch"],
        )


def sketch_keys(sketch: bytes) -> np.ndarray:
    """Distinct numbers for the values of a sketch: equal values are told apart by a count."""
    values = np.frombuffer(sketch, np.uint16).astype(np.int64)
    first = np.searchsorted(values, values)
    return values << 32 | (np.arange(len(values)) - first)


def common_at_most(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Upper bounds of the common shingles of one set and others, by their sketch keys.

    Members in common fall on equal values in both, so they are never counted too low.
    """
    ends = np.cumsum([len(o) for o in others])
    every = np.concatenate(others)
    hit = one[np.minimum(np.searchsorted(one, every), len(one) - 1)] == every
    return np.add.reduceat(hit, np.r_[0, ends[:-1]])


def _groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[dict[str, list]]:
    """Rows with equal keys, from sorted batches."""
    key, held = None, None
    for batch in batches:
        rows = batch.to_pydict()
        names = list(rows)
        for row in zip(*rows.values(), strict=True):
            this = tuple(row[names.index(c)] for c in by)
            if this != key:
                if held:
                    yield held
                key, held = this, {n: [] for n in names}
            for n, value in zip(names, row, strict=True):
                held[n].append(value)
    if held:
        yield held


_LINKS = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _check(percent: int):
    """Links of hubs to their members, on full sets. Rows: hub, salt, node (the hub itself first), members."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub_key, hub = None, None
        for batch in batches:
            links: list[tuple[int, int]] = []
            columns = (batch.column(c).to_pylist() for c in ("hub", "salt", "is_hub", "node", "members"))
            for name, salt, is_hub, node, members in zip(*columns, strict=True):
                values = np.frombuffer(members, np.uint64)
                if is_hub:
                    hub_key, hub = (name, salt), values
                elif hub_key == (name, salt):
                    at = np.minimum(np.searchsorted(hub, values), len(hub) - 1)
                    both = int((hub[at] == values).sum())
                    if 100 * both >= percent * (len(hub) + len(values) - both):
                        links.append((name, node))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], schema=_LINKS
            )

    return work


def _near(floor: float):
    """Pairs (hub, node) whose signatures agree in at least `floor` of the places."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (
                np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, PLACES)
                for c in ("signature", "hub_signature")
            )
            yield batch.select(["hub", "node"]).filter(pa.array((a == b).mean(1) >= floor))

    return work


class _Block:
    """Strays and members of a block of a bucket."""

    def __init__(self, group: dict[str, list]):
        stray = np.array(group["is_stray"], bool)
        self.node, self.root, self.n = (np.array(group[c], np.int64) for c in ("node", "root", "n"))
        self.signature = np.frombuffer(b"".join(group["signature"]), np.uint16).reshape(-1, PLACES)
        self.bands = np.frombuffer(b"".join(group["band_keys"]), np.int64).reshape(-1, BANDS)
        self.strays, self.members = np.flatnonzero(stray), np.flatnonzero(~stray)
        self.band = group["band"][0]

    def close(self, floor: float, ratio: float) -> Iterator[tuple[int, np.ndarray]]:
        """For each stray the members of other components whose signatures are close.

        A pair that meets in several bands is left to the first of them.
        """
        y = self.members
        for x in self.strays.tolist():
            n = self.n[x]
            some = y[(self.root[y] != self.root[x]) & (np.minimum(n, self.n[y]) >= ratio * np.maximum(n, self.n[y]))]
            if len(some):
                same = self.signature[some] == self.signature[x]
                first = (self.bands[some] == self.bands[x]).argmax(1)
                some = some[(same.mean(1) >= floor) & (first == self.band)]
                if len(some):
                    yield x, some


def _needed(floor: float, ratio: float):
    """The rows of blocks that are part of any close pair."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ["bucket", "block"]):
            block, used = _Block(group), set()
            for x, some in block.close(floor, ratio):
                used.add(x)
                used.update(some.tolist())
            rows = pa.array(sorted(used), pa.int64())
            if len(rows):
                names = ["bucket", "block", "band", "is_stray", "node", "root"]
                types = (pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(group[c], t).take(rows) for c, t in zip(names, types, strict=True)], names=names)

    return work


def _settle(floor: float, percent: int, best_only: bool):
    """Close pairs that may be similar enough by the sketches of their full sets.

    On request only the likeliest pair of each stray and component.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ["bucket", "block"]):
            block, keys = _Block(group), {}

            def key(i: int, sketches: list[bytes] = group["sketch"], held: dict = keys) -> np.ndarray:
                if i not in held:
                    held[i] = sketch_keys(sketches[i])
                return held[i]

            pairs = []
            for x, some in block.close(floor, percent / 100):
                both = common_at_most(key(x), [key(i) for i in some.tolist()])
                either = block.n[x] + block.n[some] - both
                may = np.flatnonzero(100 * both >= percent * either)
                if best_only:
                    order = may[np.argsort(-both[may] / either[may], kind="stable")]
                    _, first = np.unique(block.root[some[order]], return_index=True)
                    may = order[first]
                pairs += [(block.node[x], block.node[i]) for i in some[may].tolist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())],
                names=["hub", "node"],
            )

    return work


class NearDuplicates:
    """The steps over one table; intermediate tables are written to the shared folder."""

    def __init__(self, documents: DataFrame, percent: int):
        self.rows, self.percent, self.spark = keyed(documents), percent, documents.sparkSession
        self.floor = percent / 100 - MARGIN
        self.described = written(
            self.rows.mapInArrow(
                _describe,
                "doc_id long, doc_key long, text_key long, n long, node long, bands array<long>",
            )
        )
        first = F.min(F.struct(*KEYS, "n", "bands")).alias("first")
        self.nodes = written(self.described.where("n > 0").groupBy("node").agg(first).select("node", "first.*"))

    def tasks(self, df: DataFrame, rows: int, each: int = 1000) -> DataFrame:
        """The frame in tasks of so many rows for Python to work on, unless that leaves cores idle."""
        return few(df, rows, each, 3 * self.spark.sparkContext.defaultParallelism)

    def buckets(self) -> tuple[DataFrame, DataFrame]:
        """(bucket, band, node, n, hub, hub_n, size) of all nodes that share a bucket with another
        one, and (node, met) of these nodes: how many rows their buckets have in all."""
        members = self.nodes.select("node", F.col("n").cast("int").alias("n"), F.posexplode("bands").alias("band", "bucket"))
        sizes = members.groupBy("bucket").agg(F.count("*").alias("size"))
        shared = written(members.join(written(sizes.where("size > 1")).hint("merge"), "bucket"))
        rows = shared.count()
        # The node that meets most others is in the middle of its group: the best hub.
        central = written(few(shared.groupBy("node").agg(F.sum("size").alias("met")), rows))
        ranked = shared.join(central, "node")
        hubs = written(few(ranked.groupBy("bucket").agg(F.max(F.struct("met", "node", "n")).alias("best")), rows))
        hubs = hubs.select("bucket", F.col("best.node").alias("hub"), F.col("best.n").alias("hub_n"))
        return written(few(shared.join(hubs, "bucket").select("bucket", "band", "node", "n", "hub", "hub_n", "size"), rows)), central

    def sets_of(self, nodes: DataFrame, count: int) -> DataFrame:
        """(node, n, signature, band_keys, members, sketch) of these nodes."""
        wanted = self.nodes.select("node", *KEYS).join(nodes.select("node"), "node")
        texts = self.tasks(wanted.join(self.rows, KEYS).select("node", "text"), self.described.count())
        found = texts.mapInArrow(_sets, "node long, n long, signature binary, band_keys binary, members binary, sketch binary")
        first = [F.first(c).alias(c) for c in ("n", "signature", "band_keys", "members", "sketch")]
        return written(self.tasks(found.groupBy("node").agg(*first), count))

    def verified(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """(u, v) of those (hub, node) pairs that are similar enough on their full sets. pairs: a written table."""
        count = pairs.count()
        sets = sets.select("node", "members")
        if count >= SHUFFLED_PAIRS:
            sets = sets.hint("merge")
        salted = pairs.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(64)))
        spokes = salted.join(sets, "node").select("hub", "salt", F.lit(False).alias("is_hub"), "node", "members")
        hubs = (
            salted.select("hub", "salt").distinct().join(sets.withColumnRenamed("node", "hub"), "hub")
            .select("hub", "salt", F.lit(True).alias("is_hub"), F.col("hub").alias("node"), "members")
        )
        dealt = (
            spokes.unionByName(hubs)
            .repartition(shuffle_parts(self.spark), "hub", "salt")
            .sortWithinPartitions("hub", "salt", F.desc("is_hub"))
        )
        return written(self.tasks(dealt, 2 * count).mapInArrow(_check(self.percent), "u long, v long"))

    def stars(self, buckets: DataFrame, sets: DataFrame) -> DataFrame:
        """Pairs of members and hubs whose signatures are close."""
        fits = F.least("n", "hub_n").cast("long") * 100 >= F.greatest("n", "hub_n").cast("long") * self.percent
        pairs = buckets.where("node <> hub").where(fits).select("hub", "node").distinct()
        mine = sets.select("node", "signature")
        hubs = sets.select(F.col("node").alias("hub"), F.col("signature").alias("hub_signature"))
        both = pairs.join(mine, "node").join(hubs, "hub").select("hub", "node", "signature", "hub_signature")
        return self.tasks(both, buckets.count(), 5000).mapInArrow(_near(self.floor), "hub long, node long")

    def apart(self, pairs: DataFrame, roots: DataFrame) -> DataFrame:
        """Pairs whose nodes lie in different components."""
        mine = roots.select("node", F.col("root").alias("mine"))
        other = roots.select(F.col("node").alias("hub"), F.col("root").alias("other"))
        return pairs.join(mine, "node").join(other, "hub").where("mine <> other").select("hub", "node")

    def linked(self, roots: DataFrame, links: DataFrame, count: int) -> DataFrame:
        """(node, root) of all nodes, `count` in number, once these links join their components. links: a written table."""
        if links.isEmpty():
            return roots
        ends = links.join(roots.select(F.col("node").alias("u"), F.col("root").alias("low")), "u")
        ends = ends.join(roots.select(F.col("node").alias("v"), F.col("root").alias("high")), "v")
        ends = written(few(ends.select(F.col("low").alias("u"), F.col("high").alias("v")), max(count, links.count())))
        least = components(ends).select(F.col("node").alias("root"), F.col("root").alias("least"))
        return written(few(roots.join(least, "root", "left").select("node", F.coalesce("least", "root").alias("root")), count))

    def strays(self, buckets: DataFrame, roots: DataFrame, sets: DataFrame) -> DataFrame | None:
        """Blocks (bucket, block, band, is_stray, node) of the nodes in close pairs of different
        components, in buckets whose members are not all connected; None without such buckets."""
        main = roots.select(F.col("node").alias("hub"), F.col("root").alias("main"))
        rooted = buckets.join(roots, "node").join(main, "hub").select("bucket", "band", "size", "node", "root", "main")
        rooted = written(few(rooted, buckets.count()))
        away = F.sum(F.when(F.col("root") != F.col("main"), 1).otherwise(0)).alias("away")
        blocks, lines = F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"), F.ceil(F.col("away") / BLOCK).cast("int").alias("lines")
        apart = rooted.groupBy("bucket").agg(F.max("size").alias("size"), away).where("away > 0")
        apart = written(few(apart.select("bucket", "size", "away", blocks, lines), buckets.count()))
        rows = apart.agg(F.sum(F.expr("size * lines + away * blocks"))).first()[0]
        if rows is None:
            return None
        members = rooted.join(apart.select("bucket", "blocks", "lines"), "bucket").join(
            sets.select("node", "n", "signature", "band_keys"), "node"
        )
        columns = ["bucket", "block", "band", "is_stray", "node", "root", "n", "signature", "band_keys"]
        # Blocks are numbered line by line: strays of a line meet the members of each of its blocks.
        drawn = F.xxhash64("node")
        in_line, line = F.pmod(drawn, F.col("blocks")).cast("int"), F.pmod(drawn, F.col("lines")).cast("int")
        held = members.withColumn("block", F.explode(F.transform(F.sequence(F.lit(0), F.col("lines") - 1), lambda i: i * F.col("blocks") + in_line)))
        held = held.withColumn("is_stray", F.lit(False))
        asking = (
            members.where("root <> main")
            .withColumn("block", F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: line * F.col("blocks") + i)))
            .withColumn("is_stray", F.lit(True))
        )
        return written(
            self.by_block(held.select(*columns).unionByName(asking.select(*columns)), rows).mapInArrow(
                _needed(self.floor, self.percent / 100),
                "bucket long, block int, band int, is_stray boolean, node long, root long",
            )
        )

    def settled(self, needed: DataFrame, roots: DataFrame, sets: DataFrame, best_only: bool) -> DataFrame:
        """Close pairs (hub, node) of the blocks that lie in different components by now."""
        columns = ["bucket", "block", "band", "is_stray", "node", "root", "n", "signature", "band_keys", "sketch"]
        rows = needed.count()
        sets = sets.select("node", "n", "signature", "band_keys", "sketch")
        if rows >= SHUFFLED_PAIRS:
            sets = sets.hint("merge")
        complete = needed.drop("root").join(roots, "node").join(sets, "node")
        found = self.by_block(complete.select(*columns), rows).mapInArrow(
            _settle(self.floor, self.percent, best_only), "hub long, node long"
        )
        pairs = found.select(F.greatest("hub", "node").alias("node"), F.least("hub", "node").alias("hub")).distinct()
        return written(few(pairs, rows))

    def by_block(self, rows: DataFrame, count: int) -> DataFrame:
        dealt = rows.repartition(shuffle_parts(self.spark), "bucket", "block").sortWithinPartitions("bucket", "block")
        return self.tasks(dealt, count, 2000)

    def rooted(self) -> DataFrame:
        """doc_id, text_key, n, root of every row; rows without shingles have no root."""
        buckets, central = self.buckets()
        count = central.count()
        sets = self.sets_of(central, count)
        roots = central.select("node", F.col("node").alias("root"))
        # First each node with its most central hub; then the hubs it is not connected to by that.
        near = written(self.stars(buckets, sets))
        met = central.withColumnRenamed("node", "hub")
        best = near.join(met, "hub").groupBy("node").agg(F.max(F.struct("met", "hub"))["hub"].alias("hub"))
        first = written(few(best.select("hub", "node"), count))
        roots = self.linked(roots, self.verified(first, sets), count)
        rest = written(few(self.apart(near, roots), max(count, near.count())))
        roots = self.linked(roots, self.verified(rest, sets), count)
        # First the likeliest pairs, which join most components; then all that are left.
        needed = self.strays(buckets, roots, sets)
        for best_only in (True, False) if needed is not None else ():
            pairs = self.settled(needed, roots, sets, best_only)
            if pairs.isEmpty():
                break
            roots = self.linked(roots, self.verified(pairs, sets), count)
        rows = self.described.select("doc_id", "text_key", "n", "node").join(roots, "node", "left")
        return rows.select("doc_id", "text_key", "n", F.when(F.col("n") > 0, F.coalesce("root", "node")).alias("root"))

    def representatives(self) -> DataFrame:
        """doc_id, text_key, times, linked of the rows that stay, with the number of rows that share both.

        Of a component one (doc_id, text_key) stays, that with the smallest id (null ids last); rows
        without shingles are not linked and stay all.
        """
        kind = [F.first("root").alias("root"), F.count("*").alias("times")]
        keys = written(self.rooted().groupBy("doc_id", "text_key").agg(*kind))
        first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key", "times")).alias("first")
        linked = keys.where("root IS NOT NULL").groupBy("root").agg(first).select("first.*").withColumn("linked", F.lit(True))
        alone = keys.where("root IS NULL").withColumn("linked", F.lit(False))
        columns = ["doc_id", "text_key", "times", "linked"]
        return linked.select(*columns).unionByName(alone.select(*columns))

    def result(self) -> DataFrame:
        rows = self.rooted().select("doc_id", "n", "root")
        least = written(rows.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("least")))
        component = F.coalesce("least", "doc_id")
        return rows.join(least, "root", "left").select(
            "doc_id",
            F.col("n").alias("n_shingles"),
            component.alias("component_id"),
            F.col("doc_id").eqNullSafe(component).alias("kept"),
        )


def near_duplicates(documents: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document.

    Words are runs without blanks, tabs and line ends, A-Z lowered. Documents are linked when
    100 * common shingles >= percent * all shingles of both; a component takes the smallest
    doc_id reachable. Texts with fewer than five words have one shingle; null, empty and blank
    texts have none and are linked with nothing. Rows that repeat an id share the verdict of
    their text; null ids come after all others. An empty table gives no rows; other columns are
    ignored.
    """
    return NearDuplicates(documents, percent).result()


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
