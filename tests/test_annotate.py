import json
import re

import pytest
from conftest import values
from pyspark.sql import functions as F

import rowmark as rm
from rowmark.operators.annotate import ANNOTATION_FIELDS, ANNOTATION_SCHEMA, annotator_name


@pytest.fixture
def records(make):
    df = make([("r0", "first entry"), ("r1", "second entry"), ("r1", "second entry")], "id STRING, text STRING")
    return rm.row_records(df, "id", ["id"])


def test_record_fields(spark, records):
    made = rm.annotate(
        records, " high-quality ", "b1", "sha256:f1", annotator=" alice ", note="n", payload={"a": [1]}
    )
    assert tuple(made.columns) == ANNOTATION_FIELDS
    plain = spark.createDataFrame([], ANNOTATION_SCHEMA)
    assert [f.dataType for f in made.schema] == [f.dataType for f in plain.schema]
    row = made.orderBy("row_ref.row_index").first()
    assert (row.label, row.task_type, row.annotator, row.note) == ("high-quality", "preference", "alice", "n")
    assert (row.schema_version, row.event_type, row.updated_at) == ("1.0", "create", None)
    assert json.loads(row.payload.toJson()) == {"a": [1]}
    assert json.loads(row.row_data.toJson()) == {"id": "r0", "text": "first entry"}
    assert json.loads(row.row_ref.key_fields.toJson()) == {"id": "r0"} and row.row_ref.row_index == 0
    assert re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", row.created_at)


def test_ids_are_stable_and_apart(records):
    def ids(**options):
        made = rm.annotate(records, "a", "b1", "f", annotator="alice", **options)
        return values(made.orderBy("row_ref.row_index"), "annotation_id")

    first = ids(run_id="one")
    assert len(set(first)) == 3 and ids(run_id="one") == first
    assert not set(first) & set(ids(run_id="again"))
    assert not set(first) & set(ids(run_id="one", task="other"))


def test_each_run_has_ids_of_its_own(records):
    def ids():
        return set(values(rm.annotate(records, "a", "b1", "f", annotator="alice"), "annotation_id"))

    assert not ids() & ids()


def test_time_is_utc_whatever_the_session_zone(spark, records):
    utc = rm.annotate(records, "a", "b", "f").first().created_at
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        tokyo = rm.annotate(records, "a", "b", "f").first().created_at
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert utc[:13] <= tokyo[:13] <= utc[:11] + "23" and abs(int(utc[11:13]) - int(tokyo[11:13])) <= 1


def test_label_takes_the_known_spelling(spark, records):
    vocab = spark.createDataFrame(
        [("preference", 0, "Good"), ("preference", 1, "GOOD"), ("other", 0, "gOOd")],
        "task_type STRING, pos BIGINT, label STRING",
    )
    assert set(values(rm.annotate(records, " good", "b", "f", vocab=vocab), "label")) == {"Good"}
    assert set(values(rm.annotate(records, "fresh", "b", "f", vocab=vocab), "label")) == {"fresh"}
    by_row = rm.annotate(records, F.concat(F.lit("l"), "row_index"), "b", "f")
    assert sorted(values(by_row, "label")) == ["l0", "l1", "l2"]
    with pytest.raises(ValueError, match="resolve_labels"):
        rm.annotate(records, F.lit("x"), "b", "f", vocab=vocab)
    with pytest.raises(ValueError, match="Label cannot be empty"):
        rm.annotate(records, "  ", "b", "f")


def test_annotator_name(monkeypatch):
    monkeypatch.setenv("USER", "bob")
    assert (annotator_name(" alice "), annotator_name(), annotator_name("  ")) == ("alice", "bob", "unknown")
    monkeypatch.delenv("USER")
    assert annotator_name() == "unknown"
