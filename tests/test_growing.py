import json

from pyspark.sql import functions as F
from test_bundles import annotation, bundle  # noqa: F401

import rowmark as rm
from rowmark.sources.bundles import append_lines
from rowmark.sources.conflict_table import ConflictTable
from rowmark.sources.segments import SEGMENTS


def appended(spark, target, *records):
    lines = [(json.dumps(r),) for r in records]
    assert append_lines(spark.createDataFrame(lines, "value STRING").coalesce(1), target)


def groups(df):
    return sorted(map(tuple, df.collect()))


def test_conflicts_of_a_growing_log(spark, tmp_path, bundle):  # noqa: F811
    target = bundle("t", annotation(1, "x"), annotation(2, "x"), annotation(3, ""))
    assert groups(rm.bundle_conflicts(spark, target)) == []
    for n in range(SEGMENTS + 2):
        appended(spark, target, annotation(n % 4, "y"), annotation(n % 4, "z", task=""), annotation(9, f"l{n}"))
        got = groups(rm.bundle_conflicts(spark, target))
        assert got == groups(rm.conflict_groups(rm.read_annotations(spark, target)))
    assert got and len(ConflictTable(spark, target).segments()) <= SEGMENTS


def test_later_calls_read_new_batches_alone(spark, tmp_path, bundle):  # noqa: F811
    target = bundle("t", annotation(1, "x"))
    rm.append_new(rm.read_annotations(spark, bundle("s", annotation(2, "x"))), target)
    assert groups(rm.bundle_conflicts(spark, target)) == []
    log = tmp_path / "t" / "annotations.jsonl"
    for part in log.glob("batch-*/*.json*"):
        part.write_text("these lines are no records\n")
    for crc in log.glob("batch-*/.*.crc"):
        crc.unlink()
    appended(spark, target, annotation(1, "y"))
    assert [(r.row_key, r.lowest_label, r.highest_label) for r in rm.bundle_conflicts(spark, target).collect()] == [("r1", "x", "y")]


def test_only_new_files_are_hashed(spark, tmp_path):
    folder, store = str(tmp_path / "my data"), str(tmp_path / "sums")
    whole = spark.range(100).select("id", F.concat(F.lit("t"), "id").alias("t"))

    def prints():
        grown = rm.growing_fingerprint(spark, folder, store, "d").first().fingerprint
        return grown, rm.dataset_fingerprint(spark.read.parquet(folder), "d").first().fingerprint

    whole.where("id < 60").repartition(3).write.parquet(folder)
    first = prints()
    assert first[0] == first[1]
    hashed = spark.read.parquet(store).count()
    whole.where("id >= 60").coalesce(1).write.mode("append").parquet(folder)
    second = prints()
    assert second[0] == second[1] != first[0]
    assert spark.read.parquet(store).count() == hashed + 1
    assert second[0] == rm.dataset_fingerprint(whole, "d").first().fingerprint
    assert prints() == second and spark.read.parquet(store).count() == hashed + 1
    gone = sorted((tmp_path / "my data").glob("*.parquet"))[0]
    gone.unlink()
    third = prints()
    assert third[0] == third[1] != second[0]
