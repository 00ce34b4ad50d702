"""An index of the ids in a bundle's log, so that new records are checked without reading the log.

The index is a folder `_ids` beside the log. A segment covers some committed batches of the log:
its ids in Parquet, dealt by hash into buckets, and Bloom filters over them, cut into pages of
32,768 bits so that they are built, stored and probed by Spark whatever their number. Ids are
looked up in the filters first; only buckets that may hold one of them are read.

The index never decides alone: a segment counts once its manifest exists, and committed batches
that no segment covers are read from the log and indexed on the way. Losing the folder costs time,
not records. Many segments are merged into one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rowmark.operators.merge import merge_id
from rowmark.sources.segments import SEGMENTS, Segment, Segments, batches_of

FOLDER = "_ids"
BUCKETS = 64
#: Bits of a page, those spent per id, and bits set per id: 6 of 100,000 unknown ids pass.
PAGE_BITS, BITS_PER_ID, BITS_SET = 32768, 20, 8


def _bucket(id_: Column) -> Column:
    return F.pmod(F.xxhash64(id_), F.lit(BUCKETS)).cast("int")


def _page(id_: Column, pages: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(1), id_), pages)


def _bits(id_: Column) -> Column:
    return F.array(*(F.pmod(F.xxhash64(F.lit(2 + i), id_), F.lit(PAGE_BITS)).cast("int") for i in range(BITS_SET)))


def _is_set(bitmap: Column, bit: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, bit % 8) == 1


class IdIndex(Segments):
    parts = ("ids", "filters")

    def __init__(self, spark: SparkSession, bundle_path: str):
        super().__init__(spark, f"{bundle_path}/{FOLDER}")

    def add(self, ids: DataFrame, batches: list[str], replaces: tuple[Segment, ...] = ()) -> None:
        """Index ids (column `id`, repeats allowed) as those of the named batches."""
        self.register(self.build(ids), batches, replaces)

    def build(self, ids: DataFrame) -> Segment:
        """Write the ids and their filters; they count once the segment is registered."""
        name = uuid.uuid4().hex
        rows = ids.where("id <> ''").distinct().withColumn("bucket", _bucket(F.col("id")))
        rows.repartition("bucket").write.partitionBy("bucket").parquet(self._ids(name))
        stored = self._read(self._ids(name))
        pages = max(1, -(-stored.count() * BITS_PER_ID // PAGE_BITS))
        bits = stored.select(_page(F.col("id"), F.lit(pages)).alias("page"), F.explode(_bits(F.col("id"))).alias("bit"))
        bits.groupBy("page").agg(F.bitmap_construct_agg("bit").alias("bitmap")).write.parquet(f"{self.folder}/filters/{name}")
        return Segment(name, pages)

    def known(self, ids: DataFrame) -> DataFrame:
        """Those of the given ids (column `id`) that the index holds."""
        segments = self.segments()
        if not segments:
            return ids.select("id").limit(0)
        asked = ids.select("id").where("id <> ''").distinct()
        possible = self.possible(asked, segments).persist()
        try:
            # At most BUCKETS numbers for each of a few segments.
            met = possible.select("segment", _bucket(F.col("id")).alias("bucket")).distinct().collect()
        finally:
            possible.unpersist()
        buckets: dict[str, list[int]] = {}
        for row in met:
            buckets.setdefault(row.segment, []).append(row.bucket)
        found = ids.select("id").limit(0)
        for name, numbers in sorted(buckets.items()):
            held = self._read(self._ids(name)).where(F.col("bucket").isin(sorted(numbers)))
            found = found.unionByName(held.select("id").join(asked, "id", "left_semi"))
        return found.distinct()

    def possible(self, ids: DataFrame, segments: list[Segment]) -> DataFrame:
        """(id, segment) for which the segment's filter does not rule the id out."""
        probes, filters = None, None
        for s in segments:
            probe = ids.select("id", F.lit(s.name).alias("segment"), _page(F.col("id"), F.lit(s.pages)).alias("page"))
            page = self.spark.read.schema("page BIGINT, bitmap BINARY").parquet(f"{self.folder}/filters/{s.name}")
            page = page.withColumn("segment", F.lit(s.name))
            probes = probe if probes is None else probes.unionByName(probe)
            filters = page if filters is None else filters.unionByName(page)
        met = probes.join(filters, ["segment", "page"])
        return met.where(F.forall(_bits(F.col("id")), lambda bit: _is_set(F.col("bitmap"), bit))).select("id", "segment")

    def merge_segments(self) -> None:
        """Put all segments into one. Readers see the old ones or the new one."""
        old = self.segments()
        if len(old) <= SEGMENTS:
            return
        self.drop_replaced()
        ids = self._read(*(self._ids(s.name) for s in old)).select("id")
        self.add(ids, batches_of(old), tuple(old))

    def _ids(self, name: str) -> str:
        return f"{self.folder}/ids/{name}"

    def _read(self, *paths: str) -> DataFrame:
        parts = None
        for path in paths:
            part = self.spark.read.schema("id STRING, bucket INT").parquet(path)
            parts = part if parts is None else parts.unionByName(part)
        return parts


def merge_ids(records: DataFrame) -> DataFrame:
    """Ids as a merge compares them, in a column `id`."""
    return records.select(merge_id(records).alias("id"))
