"""Approximate nearest neighbours by robust-pruned directed graphs, one per shard.

1. Rows with equal vectors become one node with the smallest of their ids. Nodes are dealt into
   shards of about SHARD_NODES, whatever their number.
2. A task builds the graph of its shard from random edges: nodes are inserted a batch at a time,
   greedy searches from the middle of the shard propose neighbours, and pruning keeps the nearest
   proposal and drops those that lie closer to a kept one by the factor RELAXED. Edges are entered
   in both directions, full lists pruned again; a second pass works on the whole graph, and nodes
   that no path reaches get an edge from a near node. The graphs are written as the index.
3. Queries are searched by beam in every shard of their dimension; the nodes of the beam are
   measured again in double precision on the original vectors, and the best of all shards ranked.

Nodes and queries of a shard reach its task as one sorted stream, nodes first, so a task holds
one shard and one batch of queries at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from rowmark.llm._common import shuffle_parts, written

SHARD_NODES = 8192
DEGREE, SPARE = 32, 8
#: Nodes a search keeps, while the graph is built and when it is queried.
BUILD_BEAM, QUERY_BEAM = 48, 96
RELAXED = 1.2
BATCH = 512
#: Nodes of a beam that are opened at a time.
OPENED = 4


def _squares(points: np.ndarray, norms: np.ndarray, rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Squared distances (less the query's own norm) of each query to its row of nodes; -1: infinite."""
    dots = np.matmul(points[rows], queries[:, :, None])[:, :, 0]
    return np.where(rows < 0, np.float32(np.inf), norms[rows] - 2 * dots)


class Graph:
    """Up to DEGREE + SPARE out-neighbours of each node, -1 where there are fewer."""

    def __init__(self, vectors: np.ndarray, neighbours: np.ndarray | None = None, seed: int = 7):
        vectors = np.asarray(vectors, np.float64)
        self.scale = float(np.abs(vectors).max()) or 1.0
        self.points = (vectors / self.scale).astype(np.float32)
        self.norms = np.einsum("nd,nd->n", self.points, self.points)
        n = len(vectors)
        middle = self.points.mean(0)
        self.entry = int(np.argmin(self.norms - 2 * (self.points @ middle)))
        self.neighbours = neighbours if neighbours is not None else np.full((n, DEGREE + SPARE), -1, np.int32)
        if neighbours is None and n > 1:
            self._build(np.random.default_rng(seed))

    def beam(self, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The `width` nearest nodes met by greedy search, nearest first, and their distances."""
        count, n = len(queries), len(self.points)
        seen = np.zeros((count, n + 1), bool)  # the last column stands for -1
        seen[:, self.entry] = seen[:, n] = True
        nodes = np.full((count, width), -1, np.int32)
        nodes[:, 0] = self.entry
        far = np.full((count, width), np.inf, np.float32)
        far[:, 0] = _squares(self.points, self.norms, nodes[:, :1], queries)[:, 0]
        closed = nodes < 0
        live = np.arange(count)
        while len(live):
            # The first OPENED nodes that have not been opened, by place in the beam.
            turn = np.argsort(closed[live], axis=1, kind="stable")[:, :OPENED]
            at = live[:, None]
            going = ~closed[at, turn]
            closed[at, turn] = True
            fresh = np.where(going[:, :, None], self.neighbours[nodes[at, turn]], -1)
            for j in range(fresh.shape[1]):  # one list at a time, as lists share nodes
                part = fresh[:, j]
                part[seen[at, part]] = -1
                seen[at, part] = True
            fresh = fresh.reshape(len(live), -1)
            full = (fresh >= 0).sum(1).max(initial=0)  # lists are mostly seen: keep what is new
            fresh = np.take_along_axis(fresh, np.argsort(fresh < 0, axis=1, kind="stable")[:, :full], 1)
            away = _squares(self.points, self.norms, fresh, queries[live])
            all_nodes, all_far = np.concatenate([nodes[live], fresh], 1), np.concatenate([far[live], away], 1)
            all_closed = np.concatenate([closed[live], fresh < 0], 1)
            order = np.argsort(all_far, axis=1, kind="stable")[:, :width]
            nodes[live], far[live] = np.take_along_axis(all_nodes, order, 1), np.take_along_axis(all_far, order, 1)
            closed[live] = np.take_along_axis(all_closed, order, 1)
            live = live[~closed[live].all(1)]
        return nodes, far

    def pruned(self, of: np.ndarray, candidates: np.ndarray, relaxed: float) -> np.ndarray:
        """Up to DEGREE neighbours of each node, chosen among its row of candidates (-1: none)."""
        out = np.full((len(of), DEGREE), -1, np.int32)
        candidates = np.sort(candidates, axis=1)
        candidates[:, 1:][candidates[:, 1:] == candidates[:, :-1]] = -1
        candidates[candidates == of[:, None]] = -1
        there = self.points[candidates]
        left = _squares(self.points, self.norms, candidates, self.points[of]) + self.norms[of][:, None]
        own = np.maximum(left, 0)
        between = np.matmul(there, there.transpose(0, 2, 1))
        norms = self.norms[candidates]
        between = (norms[:, :, None] + norms[:, None, :] - 2 * between) * np.float32(relaxed**2)
        row = np.arange(len(of))
        for j in range(DEGREE):
            pick = left.argmin(1)
            open_ = np.isfinite(left[row, pick])
            if not open_.any():
                break
            out[open_, j] = candidates[row, pick][open_]
            left = np.where(between[row, pick] <= own, np.float32(np.inf), left)
            left[row, pick] = np.inf
        return out

    def _build(self, rng: np.random.Generator) -> None:
        n = len(self.points)
        first = min(n - 1, DEGREE)
        self.neighbours[:, :first] = (np.arange(n)[:, None] + rng.integers(1, n, (n, first))) % n
        for relaxed in (1.0, RELAXED):
            order = rng.permutation(n)
            for start in range(0, n, BATCH):
                nodes = order[start : start + BATCH]
                found, _ = self.beam(self.points[nodes], BUILD_BEAM)
                chosen = self.pruned(nodes, np.concatenate([found, self.neighbours[nodes]], 1), relaxed)
                self.neighbours[nodes, :DEGREE] = chosen
                self._enter(np.repeat(nodes, DEGREE), chosen.ravel(), relaxed)
        self._reach_all()

    def _enter(self, sources: np.ndarray, targets: np.ndarray, relaxed: float) -> None:
        """Add the edges target -> source; lists that get too long are pruned."""
        sources, targets = sources[targets >= 0], targets[targets >= 0]
        order = np.argsort(targets, kind="stable")
        sources, targets = sources[order], targets[order]
        nodes, starts, counts = np.unique(targets, return_index=True, return_counts=True)
        rank = np.arange(len(targets)) - np.repeat(starts, counts)
        for low in range(0, len(nodes), BATCH):
            some = nodes[low : low + BATCH]
            edges = slice(starts[low], starts[low] + counts[low : low + BATCH].sum())
            added = np.full((len(some), counts[low : low + BATCH].max()), -1, np.int32)
            added[np.repeat(np.arange(len(some)), counts[low : low + BATCH]), rank[edges]] = sources[edges]
            old = self.neighbours[some, :DEGREE]
            added[(added[:, :, None] == old[:, None, :]).any(2)] = -1
            both = np.concatenate([old, added], 1)
            sizes = (both >= 0).sum(1)
            both = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), 1)
            fits = sizes <= DEGREE
            self.neighbours[some[fits], :DEGREE] = both[fits, :DEGREE]
            if not fits.all():
                self.neighbours[some[~fits], :DEGREE] = self.pruned(some[~fits], both[~fits, : sizes.max()], relaxed)

    def _reached(self) -> np.ndarray:
        reached = np.zeros(len(self.points) + 1, bool)
        edge = np.array([self.entry])
        reached[[self.entry, -1]] = True
        while len(edge):
            edge = np.unique(self.neighbours[edge])
            edge = edge[~reached[edge]]
            reached[edge] = True
        return reached[:-1]

    def _reach_all(self) -> None:
        while len(missing := np.flatnonzero(~self._reached())):
            found, _ = self.beam(self.points[missing[:BATCH]], BUILD_BEAM)
            for node, near in zip(missing[:BATCH].tolist(), found, strict=True):
                for other in near[near >= 0].tolist():
                    free = np.flatnonzero(self.neighbours[other] < 0)
                    if len(free):
                        self.neighbours[other, free[0]] = node
                        break
                else:  # all near lists are full: pass the last spare edge on through the new node
                    other = int(near[0])
                    gap = np.flatnonzero(self.neighbours[node] < 0)
                    if not len(gap):
                        gap = [self.neighbours.shape[1] - 1]
                    self.neighbours[node, gap[0]] = self.neighbours[other, -1]
                    self.neighbours[other, -1] = node


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], pa.RecordBatch]]:
    """Parts of the batches of one (dimension, shard) each, in the order of the stream."""
    for batch in batches:
        keys = np.stack([batch.column("dim").to_numpy(), batch.column("shard").to_numpy()])
        edges = np.flatnonzero((np.diff(keys) != 0).any(0)) + 1
        for start, end in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
            if end > start:
                yield tuple(keys[:, start].tolist()), batch.slice(start, end - start)


def _graphs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of whole shards, each shard in a run of its own, with their out-neighbours."""
    group, held = None, []

    def built() -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        graph = Graph(_matrix(table.column("vector").combine_chunks()))
        width = graph.neighbours.shape[1]
        for batch in table.append_column("place", pa.array(np.arange(table.num_rows))).to_batches(2048):
            rows = graph.neighbours[batch.column("place").to_numpy()]
            edges = pa.ListArray.from_arrays(np.arange(0, len(rows) * width + 1, width, dtype=np.int32), pa.array(rows.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, edges], names=[*batch.schema.names, "neighbours"])

    for key, part in _groups(batches):
        if key != group and held:
            yield from built()
            held = []
        group = key
        held.append(part)
    if held:
        yield from built()


def _search(batches: Iterator[pa.RecordBatch], k: int, width: int) -> Iterator[pa.RecordBatch]:
    """A stream sorted by shard, nodes before queries, nodes by place: (query, node, score)."""
    group, held, index = None, [], None
    for key, part in _groups(batches):
        if key != group:
            group, held, index = key, [], None
        nodes = int(pc.sum(pc.invert(part.column("is_query"))).as_py() or 0)
        if nodes:
            held.append(part.slice(0, nodes))
        if nodes == part.num_rows or not held:
            continue
        if index is None:
            table = pa.Table.from_batches(held).combine_chunks()
            held = held[:1]
            vectors = _matrix(table.column("vector").combine_chunks())
            edges = table.column("neighbours").combine_chunks()
            neighbours = edges.flatten().to_numpy().reshape(len(edges), -1)
            index = Graph(vectors, neighbours), vectors, table.column("node").to_numpy(), table.column("first").to_numpy()
        graph, vectors, ids, firsts = index
        asked = part.slice(nodes)
        for start in range(0, asked.num_rows, BATCH):
            some = asked.slice(start, BATCH)
            queries = _matrix(some.column("vector"))
            with np.errstate(over="ignore"):
                found, _ = graph.beam((queries / graph.scale).astype(np.float32), max(width, k))
            # Exactly the measure, on the original vectors.
            away = np.sqrt(((vectors[found] - queries[:, None, :]) ** 2).sum(2))
            away[found < 0] = np.inf
            order = np.lexsort((firsts[found], away))[:, :k]
            nearest, away = np.take_along_axis(found, order, 1), np.take_along_axis(away, order, 1)
            there = nearest >= 0
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(some.column("node").to_numpy(), there.sum(1))),
                    pa.array(ids[nearest[there]]),
                    pa.array(away[there]),
                ],
                names=["query", "node", "score"],
            )


def vector_nodes(vectors: DataFrame, id_column: str, vector_column: str, copies: int) -> DataFrame:
    """node, dim, vector, ids (the `copies` smallest of equal vectors), first; valid vectors only."""
    number = F.col(vector_column).cast("array<double>")
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    rows = vectors.select(F.col(id_column).alias("id"), number.alias("vector")).where(fine)
    # -0.0 is 0.0: equal distances, one node.
    rows = rows.select("id", F.transform("vector", lambda x: x + F.lit(0.0)).alias("vector")).distinct()
    place = F.row_number().over(Window.partitionBy("vector").orderBy(F.asc_nulls_last("id")))
    kept = rows.withColumn("place", place).where(F.col("place") <= copies)
    nodes = kept.groupBy("vector").agg(F.array_sort(F.collect_list(F.struct("place", "id"))).alias("ids"))
    return written(
        nodes.select(
            F.monotonically_increasing_id().alias("node"),
            F.size("vector").cast("long").alias("dim"),
            "vector",
            F.transform("ids", lambda x: x["id"]).alias("ids"),
            F.coalesce(F.element_at("ids", 1)["id"].cast("long"), F.lit(2**63 - 1)).alias("first"),
        )
    )


def graph_index(nodes: DataFrame, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """The nodes with their shard, place in it and out-neighbours (places; -1 stands for none)."""
    shards = max(1, -(-nodes.count() // shard_nodes))
    dealt = nodes.select("node", "dim", "first", "vector", F.pmod(F.xxhash64("node"), F.lit(shards)).alias("shard"))
    dealt = dealt.repartition(max(shards, shuffle_parts(nodes.sparkSession)), "dim", "shard").sortWithinPartitions("dim", "shard", "node")
    return written(
        dealt.mapInArrow(_graphs, "node long, dim long, first long, vector array<double>, shard long, place long, neighbours array<int>")
    )


def nearest_neighbours(
    vectors: DataFrame, queries: DataFrame, k: int = 10, id_column: str = "vec_id", vector_column: str = "embedding",
    width: int = QUERY_BEAM, shard_nodes: int = SHARD_NODES,
) -> DataFrame:
    """query_id, rank, <id_column>, score: the k nearest vectors found for each query row.

    score is the Euclidean distance in double precision; ties go to the smaller id, null ids last.
    queries are rows of `vectors`: a query's own row (same id and vector) is no candidate. Vectors
    that are null, empty, zero, or hold null or non-finite components take no part. Rows that agree
    in id and vector count once; the same id with another vector is another row. Vectors are
    compared with those of their own dimension. Fewer than k candidates: all of them. Empty
    tables: no rows. Other columns are ignored.

    Of equal vectors the k + 1 smallest ids are kept, which is all that k nearest can show.
    """
    spark = vectors.sparkSession
    nodes = vector_nodes(vectors, id_column, vector_column, k + 1)
    index = graph_index(nodes, shard_nodes)
    asked = queries.select(F.col(id_column).alias("query_id"), F.transform(F.col(vector_column).cast("array<double>"), lambda x: x + F.lit(0.0)).alias("vector"))
    asked = written(asked.distinct().join(nodes.select("vector", "node"), "vector").select("query_id", "node"))
    wanted = nodes.join(asked.select("node").distinct(), "node", "left_semi")
    shards = index.groupBy("dim", "shard").count().select("dim", "shard")
    to_shards = wanted.join(shards, "dim").select(
        "dim", "shard", F.lit(True).alias("is_query"), F.lit(0).cast("long").alias("place"), "node",
        F.lit(0).cast("long").alias("first"), "vector", F.lit(None).cast("array<int>").alias("neighbours"),
    )
    of_nodes = index.select("dim", "shard", F.lit(False).alias("is_query"), "place", "node", "first", "vector", "neighbours")
    parts = max(shards.count(), shuffle_parts(spark))
    dealt = of_nodes.unionByName(to_shards).repartition(parts, "dim", "shard").sortWithinPartitions("dim", "shard", "is_query", "place")
    found = dealt.mapInArrow(lambda b: _search(b, k + 1, width), "query long, node long, score double")
    near = F.row_number().over(Window.partitionBy("query").orderBy("score", "first"))
    found = found.join(nodes.select("node", "ids", "first"), "node").withColumn("place", near).where(F.col("place") <= k + 1)
    listed = asked.withColumnRenamed("node", "query").join(found, "query")
    listed = listed.select("query_id", "query", "node", "score", F.explode("ids").alias(id_column))
    others = listed.where(~((F.col("node") == F.col("query")) & F.col(id_column).eqNullSafe(F.col("query_id"))))
    rank = F.row_number().over(Window.partitionBy("query_id", "query").orderBy("score", F.asc_nulls_last(id_column), "node"))
    return others.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", id_column, "score")


def op12_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest_neighbours(vectors, vectors.where("vec_id % 100 = 0"))
