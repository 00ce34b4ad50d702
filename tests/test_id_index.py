import json
import re

from pyspark.sql import functions as F
from test_bundles import annotation, bundle, log_ids  # noqa: F401
from test_streaming import run, write

import rowmark as rm
from rowmark.sources import files
from rowmark.sources.bundles import append_lines
from rowmark.sources.id_index import BUCKETS, SEGMENTS, IdIndex


def ids(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "id string")


def test_later_batches_read_no_log_line(spark, tmp_path, bundle):  # noqa: F811
    target = bundle("t", annotation(1, "x"), annotation(2, "x", annotation_id=None), annotation(3, "x", annotation_id=""))
    feed, progress = tmp_path / "feed", tmp_path / "p"
    write(feed, "1.json", annotation(1, "x"), annotation(4, "x"))
    run(spark, feed, target, progress)
    log = tmp_path / "t" / "annotations.jsonl"
    for part in log.glob("batch-*/*.json*"):
        part.write_text("these lines are no records\n")
    for crc in log.glob("batch-*/.*.crc"):
        crc.unlink()
    write(
        feed, "2.json", annotation(4, "x"), annotation(5, "x"), annotation(1, "x"), annotation(6, "x", annotation_id=None),
        annotation(7, "x", annotation_id=""),
    )
    run(spark, feed, target, progress)
    added = sorted((log / "batch-000000000002").glob("part-*"))
    records = [json.loads(line) for part in added for line in part.read_text().splitlines()]
    assert sorted(r["annotation_id"] for r in records) == ["", "a5-x"]


def test_appends_of_others_are_indexed_on_the_way(spark, tmp_path, bundle):  # noqa: F811
    target = bundle("t", annotation(1, "x"))
    write(tmp_path / "f", "1.json", annotation(2, "x"))
    run(spark, tmp_path / "f", target, tmp_path / "p")
    assert append_lines(spark.createDataFrame([(json.dumps(annotation(3, "x")),)], "value STRING"), target)
    covered = lambda: sorted(b for s in IdIndex(spark, target).segments() for b in s.batches)
    assert covered() == ["batch-000000000000", "batch-000000000001"]
    got = rm.known_ids(spark, target, ids(spark, "a1-x", "a3-x", "a9-x", "", None))
    assert sorted(r.id for r in got.collect()) == ["a1-x", "a3-x"]
    assert covered() == [f"batch-{n:012d}" for n in range(3)]
    files.delete(spark, f"{target}/_ids")  # a lost index costs time, not records
    write(tmp_path / "f", "2.json", annotation(3, "x"), annotation(2, "x"), annotation(4, "x"))
    run(spark, tmp_path / "f", target, tmp_path / "p")
    assert log_ids(spark, target) == ["a1-x", "a2-x", "a3-x", "a4-x"]


def test_only_buckets_that_may_hold_an_id_are_read(spark, tmp_path):
    index = IdIndex(spark, str(tmp_path / "b"))
    held = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("id"))
    index.add(held.unionAll(held), ["batch-0"])
    (segment,) = index.segments()
    assert segment.pages == -(-20_000 * 20 // 32768)
    unknown = spark.range(5_000).select(F.concat(F.lit("u"), "id").alias("id"))
    assert index.possible(unknown, [segment]).count() < 10
    assert index.possible(held, [segment]).count() == 20_000
    found = index.known(ids(spark, "k7", "k7", "u1", "k19999"))
    assert sorted(r.id for r in found.collect()) == ["k19999", "k7"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert len(re.search(r"PartitionFilters: \[bucket#\d+ IN \(([\d,]+)\)\]", plan)[1].split(",")) <= 2
    assert sum(1 for _ in (tmp_path / "b" / "_ids" / "ids").glob("*/bucket=*")) == BUCKETS


def test_many_segments_become_one(spark, tmp_path):
    index, batches = IdIndex(spark, str(tmp_path / "b")), 2 * SEGMENTS + 1
    for n in range(batches):
        index.add(ids(spark, f"k{n}", "common", ""), [f"batch-{n}"])
        index.merge_segments()
    (segment,) = index.segments()
    assert len(segment.batches) == batches
    asked = ids(spark, *(f"k{n}" for n in range(30)), "common", "")
    assert sorted(r.id for r in index.known(asked).collect()) == sorted([*(f"k{n}" for n in range(batches)), "common"])
    # Those that the first merge replaced are gone, those of the last one still there for readers.
    assert len(list((tmp_path / "b" / "_ids" / "manifests").glob("*.json"))) == SEGMENTS + 2


def test_an_unregistered_segment_does_not_count(spark, tmp_path):
    index = IdIndex(spark, str(tmp_path / "b"))
    index.build(ids(spark, "a"))
    assert index.segments() == [] and index.known(ids(spark, "a")).collect() == []


def test_of_two_runs_with_one_token_the_first_counts(spark, bundle):  # noqa: F811
    target = bundle("t", annotation(1, "x"))
    line = lambda n: spark.createDataFrame([(json.dumps(annotation(n, "x")),)], "value STRING")
    assert append_lines(line(2), target, "one") and append_lines(line(2), target, "two")
    commits = f"{target}/annotations.jsonl/_commits"
    files.delete(spark, f"{commits}/000000000002.done-two")
    files.create_new(spark, f"{commits}/000000000002.done-one")  # both were under way at once
    assert log_ids(spark, target) == ["a1-x", "a2-x"]
