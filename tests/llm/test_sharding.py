import random
import zlib
from collections import Counter

import pytest
from conftest_llm import EDGES, documents, package_on_workers  # noqa: F401
from pyspark.sql import functions as F

from rowmark.llm.sharding import rendezvous, shard_documents


def test_sizes_sums_and_slots(documents):
    rows = EDGES + [(100 + i, f"text {i % 7}") for i in range(2000)]
    got = shard_documents(documents(rows).repartition(6), [1.0] * 5, [1.0] * 6).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter(
        (i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows
    )
    slots = {}
    for r in got:
        assert r.law == "key" and (r.grown_shard == r.shard or r.grown_shard == 5)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({(r.doc_id, r.shard) for r in got}) == len({r.doc_id for r in got})


def test_weights_and_removal(spark):
    ids = spark.range(20_000)
    weights = [1.0, 2.0, 0.5, 4.5]
    got = ids.select("id", rendezvous("id", weights).alias("a"), rendezvous("id", weights[:3]).alias("b")).collect()
    share = Counter(r.a for r in got)
    assert all(abs(share[i] / 20_000 - w / 8) < 0.02 for i, w in enumerate(weights))
    assert all(r.a == r.b for r in got if r.a < 3)


def test_equal_weights_rank_like_the_logarithm(spark):
    ids = spark.range(2000)
    equal = rendezvous("id", [1.0] * 8)
    nearly = rendezvous("id", [1.0] * 7 + [1.0 + 1e-12])
    assert ids.where(equal != nearly).count() == 0


def test_native_plan_and_empty_table(documents):
    df = shard_documents(documents([]), [1.0, 1.0])
    assert df.collect() == []
    assert "Python" not in df._jdf.queryExecution().toString()
    with pytest.raises(ValueError):
        rendezvous(F.lit(1), [1.0, 0.0])


def test_stable_across_partitions(spark):
    rng = random.Random(1)
    ids = spark.createDataFrame([(rng.randrange(10**9),) for _ in range(500)], "doc_id long").withColumn("text", F.lit("x"))
    one = {r.doc_id: r.shard for r in shard_documents(ids.coalesce(1), [1.0] * 9).collect()}
    many = {r.doc_id: r.shard for r in shard_documents(ids.repartition(7), [1.0] * 9).collect()}
    assert one == many
