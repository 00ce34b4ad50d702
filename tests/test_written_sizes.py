"""What is written grows in files of bounded size, packed where it can be."""

import pytest
from pyspark.sql import functions as F
from test_bundles import FINGERPRINT

import rowmark as rm
from rowmark.plans import catalogue, tables
from rowmark.sources import bundles

RECORDS = 3000


@pytest.fixture
def many(spark, tmp_path):
    rows = spark.range(RECORDS).select("id", F.concat(F.lit("text of row "), "id").alias("text"))
    rows.coalesce(1).sortWithinPartitions("id").write.parquet(str(tmp_path / "rows"))
    return rm.row_records(rm.with_row_index(spark.read.parquet(str(tmp_path / "rows"))), "id")


def batch_files(path):
    return sorted(p for p in (path / "annotations.jsonl").glob("batch-*/part-*"))


def plain_size(spark, path):
    lines = rm.sources.bundles.read_log_lines(spark, str(path))
    return lines.agg(F.sum(F.octet_length("value") + 1)).first()[0]


def written(path):
    return sum(p.stat().st_size for p in batch_files(path))


def test_batches_are_packed(spark, tmp_path, many):
    for name in ("annotated", "appended", "imported"):
        rm.create_bundle(spark, str(tmp_path / name), FINGERPRINT)
    rm.annotate_bundle(spark, str(tmp_path / "annotated"), many, "good", annotator="alice")
    log = rm.read_annotations(spark, str(tmp_path / "annotated"))
    rm.append_annotations(log.orderBy(rm.POSITION), str(tmp_path / "appended"))
    rm.import_bundle(spark, str(tmp_path / "imported"), str(tmp_path / "appended"))
    for name in ("annotated", "appended", "imported"):
        path = tmp_path / name
        assert rm.read_annotations(spark, str(path)).count() == RECORDS
        assert 3 * written(path) < plain_size(spark, path)


def test_packed_files_are_bounded_and_in_order(spark, tmp_path, many, monkeypatch):
    monkeypatch.setitem(bundles._PACKED, "maxRecordsPerFile", 130)
    target = str(tmp_path / "b")
    rm.create_bundle(spark, target, FINGERPRINT)
    rm.annotate_bundle(spark, target, many, "good", annotator="alice")
    rm.append_annotations(rm.read_annotations(spark, target).orderBy(F.desc(rm.POSITION)), target)
    held = rm.read_annotations(spark, target).orderBy(rm.POSITION).select(rm.POSITION, "row_ref.row_id").collect()
    assert [r[0] for r in held] == list(range(2 * RECORDS))
    ids = [int(r.row_id) for r in held]
    assert ids == [*range(RECORDS), *reversed(range(RECORDS))]
    assert len(batch_files(tmp_path / "b")) >= 2 * (RECORDS // 130)


def test_feed_has_more_files_for_more_records(spark, tmp_path, monkeypatch):
    moment = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id"))
    spark.range(900).select(
        F.col("id").alias("event_id"), moment.alias("ts"), (F.col("id") % 7).alias("user_id"),
        F.when(F.col("id") % 3 == 0, "click").otherwise("view").alias("event_type"), (F.col("id") * 1.0).alias("value"), F.lit("{}").alias("props"),
    ).write.parquet(str(tmp_path / "events.parquet"))
    spark.range(600).select(
        F.col("id").alias("o_orderkey"), (F.col("id") % 50).alias("o_custkey"), F.lit("O").alias("o_orderstatus"),
        F.lit(1.0).alias("o_totalprice"), moment.alias("o_orderdate"),
        F.when(F.col("id") % 4 == 0, "4-NOT SPECIFIED").otherwise("1-URGENT").alias("o_orderpriority"),
    ).write.parquet(str(tmp_path / "orders.parquet"))
    results = []
    for name, most in (("few", 10**6), ("many", 100)):
        monkeypatch.setattr(tables, "FEED_FILE_RECORDS", most)
        monkeypatch.setattr(catalogue, "shared_folder", lambda _, name=name: str(tmp_path / name))
        results.append(sorted(map(str, catalogue.QUERIES["merge_feed"](spark, str(tmp_path)).collect())))
    assert len(list((tmp_path / "few" / "feed").glob("part-*"))) == 4
    assert len(list((tmp_path / "many" / "feed").glob("part-*"))) == 15
    assert results[0] == results[1] and len(results[0]) == 900 + 150 + 50


def test_growing_folder_is_written_by_as_many_tasks_as_read_it(spark, tmp_path, monkeypatch):
    documents = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    documents.repartition(12).write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(catalogue, "shared_folder", lambda _: str(tmp_path / "out"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        made = catalogue.QUERIES["growing_fingerprint"](spark, str(tmp_path)).first()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert made.changed and made.fingerprint == rm.dataset_fingerprint(documents, "documents", split="train").first().fingerprint
    assert len(list((tmp_path / "out" / "d").glob("part-*"))) == 24
