import pytest
from conftest import values
from pyspark.sql import functions as F

import rowmark as rm


@pytest.fixture
def log(make):
    rows = [
        ("a1", "preference", "high-quality", "r1", "alice", "2024-01-02T00:00:00Z"),
        ("a2", "preference", "low-quality", "r2", "alice", "2024-01-01T00:00:00Z"),
        ("a3", "preference", "high-quality", "r2", "alice", ""),
        (" a1 ", "preference", "high-quality", "r1", "alice", None),
        ("", "classification", "entity-person", "r1", " Bob\t", "2024-01-03T00:00:00Z"),
        ("", "", None, "r9", "", "zz"),
    ]
    df = make(rows, "annotation_id STRING, task_type STRING, label STRING, row_id STRING, annotator STRING, created_at STRING")
    return df.select(
        "*", F.struct("row_id", F.parse_json(F.lit("{}")).alias("key_fields")).alias("row_ref"),
        F.lit("h").alias("row_hash"),
    )


def test_facets_ignore_case_and_blanks(log):
    kept = rm.facet_filter(log, label=" ENTITY-PERSON ", annotator="BoB")
    assert values(kept, rm.POSITION) == [4]
    assert rm.facet_filter(log).count() == 6
    assert values(rm.facet_filter(log, label=""), rm.POSITION) == [5]
    assert rm.facet_filter(log, task_type="none").count() == 0


def test_counts(log):
    got = {(r.facet, r.value): r.records for r in rm.facet_counts(log).collect()}
    assert got == {
        ("label", "high-quality"): 3, ("label", "low-quality"): 1, ("label", "entity-person"): 1,
        ("annotator", "alice"): 4, ("annotator", " Bob\t"): 1, ("task_type", "preference"): 4,
        ("task_type", "classification"): 1,
    }
    assert rm.record_counts(log, label="HIGH-quality").first().asDict() == {"total_records": 6, "filtered_records": 3}


def test_times_compare_as_text(log):
    row = rm.time_range(log).first()
    assert (row.first_created_at, row.last_created_at) == ("2024-01-01T00:00:00Z", "zz")
    assert rm.time_range(log.filter("created_at = ''")).first().asDict() == {
        "first_created_at": None, "last_created_at": None,
    }


def test_duplicates_and_conflicts(log):
    assert [(r.annotation_id, r.records) for r in rm.duplicate_ids(log).collect()] == [("a1", 2)]
    assert rm.conflict_count(rm.facet_filter(log, annotator="alice")).first().conflict_count == 1


def test_samples_in_log_order(log):
    shuffled = log.orderBy(F.desc(rm.POSITION))
    assert values(rm.sample_annotations(shuffled, 2), rm.POSITION) == [0, 1]
    assert values(rm.sample_annotations(shuffled), rm.POSITION) == [0, 1, 2, 3, 4]
    assert rm.sample_annotations(shuffled, -1).count() == 0


def test_whole_report(log):
    got = {(r.section, r.name): r.value for r in rm.summary(log, annotator="Alice").collect()}
    assert got == {
        ("counts", "total_records"): "6", ("counts", "filtered_records"): "4",
        ("counts", "duplicate_annotation_ids"): "1", ("counts", "row_label_conflicts"): "1",
        ("stats", "first_created_at"): "2024-01-01T00:00:00Z", ("stats", "last_created_at"): "2024-01-02T00:00:00Z",
        ("by_label", "high-quality"): "3", ("by_label", "low-quality"): "1",
        ("by_annotator", "alice"): "4", ("by_task_type", "preference"): "4",
    }
