import io
import json
import tarfile
import time
from concurrent.futures import ThreadPoolExecutor

import pytest
from conftest import values
from pyspark.sql import functions as F

import rowmark as rm
from rowmark.operators.annotate import ANNOTATION_SCHEMA
from rowmark.operators.labels import merge_label_sets, new_label_set
from rowmark.sources import files
from rowmark.sources.bundles import annotate_bundle, read_log_lines

FINGERPRINT = {"source_type": "csv", "source_uri": "x.csv", "fingerprint": "sha256:f1", "key_fields": ["id"]}


def annotation(number, label, task="preference", annotator="alice", **changes):
    return {
        "schema_version": "1.0", "annotation_id": f"a{number}-{label}", "bundle_id": "b",
        "dataset_fingerprint": "sha256:f1", "task_type": task, "label": label, "payload": {},
        "row_ref": {"row_index": number, "row_id": f"r{number}", "key_fields": {"id": f"r{number}"}},
        "row_hash": f"h{number}", "row_data": {"id": f"r{number}", "text": f"line {number} of the ledger"},
        "annotator": annotator, "note": None, "created_at": "2024-01-01T00:00:00Z", "updated_at": None,
        "event_type": "create", **changes,
    }


@pytest.fixture
def bundle(spark, tmp_path):
    def build(name, *records, labels=("high-quality", "low-quality"), fingerprint="sha256:f1"):
        path = str(tmp_path / name)
        rm.create_bundle(spark, path, {**FINGERPRINT, "fingerprint": fingerprint}, labels=labels)
        if records:
            lines = spark.createDataFrame([(json.dumps(r),) for r in records], "line STRING").coalesce(1)
            rm.append_annotations(lines.select(F.from_json("line", ANNOTATION_SCHEMA).alias("r")).select("r.*"), path)
        return path

    return build


def foreign(folder, *records, label_set='{"task_type": "preference", "labels": ["good"], "hotkeys": {"1": "good"}}'):
    """A bundle as other tools write it: three plain files."""
    folder.mkdir(parents=True)
    (folder / "manifest.json").write_text(json.dumps({"bundle_id": "b2", "dataset": {"fingerprint": "sha256:f1"}}))
    (folder / "label_set.json").write_text(label_set)
    (folder / "annotations.jsonl").write_text("\n \n".join(json.dumps(r) for r in records) + "\n")
    return str(folder)


def log_ids(spark, path):
    return values(rm.read_annotations(spark, path).orderBy(rm.POSITION), "annotation_id")


def task_labels(label_set, task):
    return values(label_set.labels.filter(F.col("task_type") == task).orderBy("pos"), "label")


def test_create_and_reopen(spark, bundle):
    path = bundle("b")
    first = rm.open_bundle(spark, path)
    assert first.fingerprint == "sha256:f1" and first.manifest["dataset"]["key_fields"] == ["id"]
    again = rm.create_bundle(spark, path, FINGERPRINT)
    assert again.bundle_id == first.bundle_id
    assert task_labels(rm.read_label_set(spark, path), "preference") == ["high-quality", "low-quality"]
    assert rm.annotation_count(rm.read_annotations(spark, path)).first().annotation_count == 0
    with pytest.raises(ValueError, match="made for sha256:f1.*has sha256:other"):
        rm.create_bundle(spark, path, {"fingerprint": "sha256:other"})


def test_validation(spark, tmp_path):
    with pytest.raises(ValueError, match="No (packed )?bundle"):
        rm.validate_bundle(spark, str(tmp_path / "none"))
    (tmp_path / "manifest.json").write_text("{}")
    with pytest.raises(ValueError, match="no annotations.jsonl and no label_set.json"):
        rm.validate_bundle(spark, str(tmp_path))


def test_appended_batches_keep_log_order(spark, bundle):
    path = bundle("b", annotation(5, "x"), annotation(1, "x"))
    for n in range(12, 0, -1):
        made = spark.createDataFrame([(json.dumps(annotation(n, "y")),)], "line STRING")
        rm.append_annotations(made.select(F.from_json("line", ANNOTATION_SCHEMA).alias("r")).select("r.*"), path)
    assert log_ids(spark, path) == ["a5-x", "a1-x", *(f"a{n}-y" for n in range(12, 0, -1))]
    record = rm.read_annotations(spark, path).orderBy(rm.POSITION).first()
    assert json.loads(record.row_data.toJson())["text"] == "line 5 of the ledger" and record.note is None


def test_written_lines_hold_every_field(spark, bundle):
    path = bundle("b", annotation(1, "x"))
    line = spark.read.option("recursiveFileLookup", True).text(f"{path}/annotations.jsonl").first().value
    assert json.loads(line) == annotation(1, "x")


def test_plain_files_are_read_and_appended_to(spark, tmp_path, bundle):
    path = foreign(tmp_path / "f", annotation(1, "good"), annotation(2, "good"))
    assert log_ids(spark, path) == ["a1-good", "a2-good"]
    report = rm.import_bundle(spark, path, bundle("s", annotation(3, "low-quality"))).first()
    assert report.imported_count == 1 and report.label_set_changed
    assert log_ids(spark, path) == ["a1-good", "a2-good", "a3-low-quality"]
    assert task_labels(rm.read_label_set(spark, path), "preference") == ["good", "high-quality", "low-quality"]


def test_bad_line_is_an_error(spark, tmp_path):
    path = foreign(tmp_path / "f", annotation(1, "good"))
    with open(f"{path}/annotations.jsonl", "a") as log:
        log.write('{"annotation_id": \n')
    with pytest.raises(Exception, match="(?i)malformed|failfast"):
        rm.read_annotations(spark, path).select("annotation_id", "label").collect()


def test_import_drops_repeats_and_joins_labels(spark, bundle):
    target = bundle("t", annotation(1, "high-quality"))
    source = bundle(
        "s", annotation(1, "high-quality"), annotation(2, "needs-review"),
        labels=("high-quality", "low-quality", "needs-review"),
    )
    report = rm.import_bundle(spark, target, source).first()
    assert (report.imported_count, report.duplicate_count, report.conflict_count) == (1, 1, 0)
    assert report.applied and not report.dry_run and report.label_set_changed
    assert task_labels(rm.read_label_set(spark, target), "preference") == ["high-quality", "low-quality", "needs-review"]
    assert log_ids(spark, target) == ["a1-high-quality", "a2-needs-review"]
    again = rm.import_bundle(spark, target, source).first()
    assert (again.imported_count, again.duplicate_count, again.label_set_changed) == (0, 2, False)


def test_import_counts_conflicts(spark, bundle):
    report = rm.import_bundle(
        spark, bundle("t", annotation(3, "high-quality")), bundle("s", annotation(3, "low-quality"))
    ).first()
    assert (report.imported_count, report.conflict_count) == (1, 1)


def test_imported_records_are_ordered_by_time_and_id(spark, bundle):
    target = bundle("t", annotation(1, "x", created_at="2030"))
    source = bundle(
        "s", annotation(4, "x", created_at="2024"), annotation(3, "x", created_at="2024"),
        annotation(2, "x", created_at="2025"), annotation(9, "x", created_at=None),
    )
    rm.import_bundle(spark, target, source)
    assert log_ids(spark, target) == ["a1-x", "a9-x", "a3-x", "a4-x", "a2-x"]


def test_fingerprint_gate(spark, bundle):
    target, source = bundle("t"), bundle("s", annotation(1, "x"), fingerprint="sha256:f2")
    with pytest.raises(ValueError, match="sha256:f1 and sha256:f2"):
        rm.import_bundle(spark, target, source)
    assert rm.import_bundle(spark, target, source, allow_fingerprint_mismatch=True).first().imported_count == 1


def test_dry_run_writes_nothing(spark, bundle):
    target = bundle("t", annotation(1, "x"))
    source = bundle("s", annotation(7, "needs-review"), labels=("needs-review",))
    report = rm.import_bundle(spark, target, source, dry_run=True).first()
    assert (report.imported_count, report.label_set_changed, report.applied) == (1, True, False)
    assert log_ids(spark, target) == ["a1-x"]
    assert task_labels(rm.read_label_set(spark, target), "preference") == ["high-quality", "low-quality"]


def test_bad_source_leaves_the_target_alone(spark, bundle, tmp_path):
    target = bundle("t", annotation(1, "x"))
    source = foreign(tmp_path / "f", annotation(2, "good"))
    with open(f"{source}/annotations.jsonl", "a") as log:
        log.write("not json\n")
    with pytest.raises(Exception):
        rm.import_bundle(spark, target, source)
    assert task_labels(rm.read_label_set(spark, target), "preference") == ["high-quality", "low-quality"]
    assert log_ids(spark, target) == ["a1-x"]


def test_tasks_of_both_sides(spark, bundle, tmp_path):
    target = bundle("t")
    source = foreign(
        tmp_path / "f",
        label_set=json.dumps({"active_task_type": "classification", "task_profiles": {
            "classification": {"labels": ["entity-person"], "hotkeys": {"1": "entity-person"}}, "later": {}}}),
    )
    rm.import_bundle(spark, target, source)
    merged = rm.read_label_set(spark, target)
    assert merged.active_task == "preference"
    assert sorted(values(merged.tasks, "task_type")) == ["classification", "later", "preference"]
    assert task_labels(merged, "classification") == ["entity-person"]


def test_export(spark, bundle, tmp_path):
    source = bundle("s", annotation(2, "x"), annotation(1, "x"))
    files.write_small_text(spark, f"{source}/notes.txt", "not part of the bundle")
    out = str(tmp_path / "out")
    report = rm.export_snapshot(spark, source, out).first()
    assert (report.format, report.annotation_count, report.output) == ("dir", 2, out)
    assert report.files.split(",") == ["manifest.json", "label_set.json", "annotations.jsonl"]
    assert files.child_names(spark, out) == ["annotations.jsonl", "label_set.json", "manifest.json"]
    assert log_ids(spark, out) == ["a2-x", "a1-x"]
    assert rm.open_bundle(spark, out).manifest == rm.open_bundle(spark, source).manifest
    with pytest.raises(ValueError, match="is taken"):
        rm.export_snapshot(spark, source, out)
    with pytest.raises(ValueError, match="into itself"):
        rm.export_snapshot(spark, source, f"{source}/", overwrite=True)
    assert rm.export_snapshot(spark, source, out, overwrite=True).first().annotation_count == 2


def test_export_of_plain_files_skips_blank_lines(spark, tmp_path):
    source = foreign(tmp_path / "f", annotation(1, "good"), annotation(2, "good"))
    out = str(tmp_path / "out")
    assert rm.export_snapshot(spark, source, out).first().annotation_count == 2
    assert log_ids(spark, out) == ["a1-good", "a2-good"]
    assert task_labels(rm.read_label_set(spark, out), "preference") == ["good"]


def test_annotate_into_a_bundle(spark, make, bundle):
    path = bundle("b")
    opened = rm.open_bundle(spark, path)
    df = make([(1, 0.9), (2, 0.1)], "id BIGINT, score DOUBLE")
    vocab = rm.read_label_set(spark, path).labels
    records = rm.row_records(rm.filter_rows(df, "score > 0.5"), "id", ["id"])
    rm.append_annotations(
        rm.annotate(records, "HIGH-quality", opened.bundle_id, opened.fingerprint, vocab=vocab), path
    )
    (row,) = rm.read_annotations(spark, path).collect()
    assert (row.label, row.row_ref.row_id, row.dataset_fingerprint) == ("high-quality", "1", "sha256:f1")
    assert json.loads(row.row_data.toJson()) == {"id": 1, "score": 0.9}


# --- packed bundles --------------------------------------------------------------------


def pack(path, members):
    with tarfile.open(path, "w:gz") as archive:
        for name, text in members.items():
            info = tarfile.TarInfo(name)
            data = text.encode()
            info.size = len(data)
            archive.addfile(info, io.BytesIO(data))


def members(folder, *records):
    lines = "\n\n".join(json.dumps(r) for r in records)
    return {f"{folder}manifest.json": "{}", f"{folder}label_set.json": "{}", f"{folder}annotations.jsonl": lines}


def test_archives(spark, tmp_path):
    pack(tmp_path / "a.tar.gz", {**members("z/deep/", annotation(9, "no")), **members("z/", annotation(1, "x"), annotation(2, "é"))})
    pack(tmp_path / "b.tar.gz", {**members("q/", annotation(3, "x")), **members("p/", *(annotation(n, "y") for n in range(5000)))})
    (tmp_path / "c.tar.gz.txt").write_text("not an archive")
    df = rm.read_bundle_archives(spark, str(tmp_path))
    first = df.filter(F.col("archive").endswith("a.tar.gz")).orderBy("line_no").collect()
    assert [(r.bundle_dir, r.line_no, r.annotation_id) for r in first] == [("z", 0, "a1-x"), ("z", 2, "a2-é")]
    second = df.filter(F.col("archive").endswith("b.tar.gz"))
    assert second.count() == 5000 and values(second.select("bundle_dir").distinct(), "bundle_dir") == ["p"]
    assert json.loads(first[0].row_data.toJson())["text"] == "line 1 of the ledger"


@pytest.mark.parametrize("name", ["../x", "/etc/x", "a/../../x"])
def test_archive_members_stay_inside(spark, tmp_path, name):
    pack(tmp_path / "bad.tar.gz", {**members(""), name: "x"})
    with pytest.raises(Exception, match="outside its own folder"):
        rm.read_bundle_archives(spark, str(tmp_path)).collect()


def test_archive_without_a_bundle(spark, tmp_path):
    pack(tmp_path / "bad.tar.gz", {"manifest.json": "{}"})
    with pytest.raises(Exception, match="holds a whole bundle"):
        rm.read_bundle_archives(spark, str(tmp_path)).collect()


def test_import_of_a_packed_bundle(spark, bundle, tmp_path):
    target = bundle("t", annotation(1, "high-quality"))
    packed = members("b/", annotation(1, "high-quality"), annotation(2, "good"), annotation(2, "good"))
    packed["b/manifest.json"] = json.dumps({"bundle_id": "z", "dataset": {"fingerprint": "sha256:f1"}}, indent=2)
    packed["b/label_set.json"] = json.dumps({"task_type": "preference", "labels": ["good"]}, indent=2)
    pack(tmp_path / "s.tar.gz", packed)
    report = rm.import_bundle(spark, target, str(tmp_path / "s.tar.gz")).first()
    assert (report.source_count, report.imported_count, report.duplicate_count) == (3, 1, 2)
    assert log_ids(spark, target) == ["a1-high-quality", "a2-good"]
    assert task_labels(rm.read_label_set(spark, target), "preference") == ["high-quality", "low-quality", "good"]
    packed["b/manifest.json"] = json.dumps({"dataset": {"fingerprint": "sha256:f2"}})
    pack(tmp_path / "other.tar.gz", packed)
    with pytest.raises(ValueError, match="sha256:f2"):
        rm.import_bundle(spark, target, str(tmp_path / "other.tar.gz"))
    with pytest.raises(ValueError, match="No (packed )?bundle"):
        rm.import_bundle(spark, target, str(tmp_path / "none.tar.gz"))


def test_summary_of_a_bundle(spark, bundle):
    path = bundle(
        "b", annotation(1, "high-quality"), annotation(2, "low-quality"), annotation(2, "high-quality"),
        annotation(1, "high-quality"), annotation(9, "entity-person", "classification", "bob"),
    )
    got = {(r.section, r.name): r.value for r in rm.summarize_bundle(spark, path, annotator="ALICE").collect()}
    assert got[("counts", "total_records")] == "5" and got[("counts", "filtered_records")] == "4"
    assert got[("counts", "duplicate_annotation_ids")] == got[("counts", "row_label_conflicts")] == "1"
    assert got[("by_label", "high-quality")] == "3" and ("by_label", "entity-person") not in got
    assert got[("manifest", "dataset.fingerprint")] == "sha256:f1" and got[("filters", "annotator")] == "ALICE"
    assert got[("labels.preference", "0")] == got[("hotkeys.preference", "1")] == "high-quality"
    assert json.loads(got[("sample_records", "1")]) == annotation(2, "low-quality")
    assert rm.summarize_bundle(spark, path, limit=0).filter("section = 'sample_records'").count() == 0


def test_imported_lines_are_not_touched(spark, tmp_path, bundle):
    target = bundle("t", annotation(1, "x"))
    lines = [
        '{"annotation_id": "n1",  "confidence": 1.0, "task_type": "preference", "label": "good", "row_data": {"x": 1e20, "x": 1.0}}',
        '{"label": "good", "annotation_id": "n2", "created_at": "2020-01-01T00:00:00Z", "row_ref": {"row_id": "r"}}',
    ]
    source = foreign(tmp_path / "s")
    (tmp_path / "s" / "annotations.jsonl").write_text("\n".join([*lines, lines[0]]) + "\n")
    assert rm.import_bundle(spark, target, source).first().imported_count == 2
    stored = [r.value for r in read_log_lines(spark, target).orderBy(rm.POSITION).collect()]
    assert stored[1:] == lines


def test_annotating_into_a_bundle_registers_labels(spark, make, bundle):
    path = bundle("t")
    df = make([("r0", "a"), ("r1", "b"), ("r2", "c")], "id STRING, kind STRING")
    records = rm.row_records(df, "id", ["id"])
    annotate_bundle(spark, path, records, " HIGH-quality ")
    by_row = F.when(F.col("row_index") == 1, " Fresh").otherwise("fresh ")
    annotate_bundle(spark, path, records, by_row, annotator="bo")
    annotate_bundle(spark, path, records, "fresh", task="other")
    assert sorted(values(rm.read_annotations(spark, path), "label")) == ["fresh"] * 6 + ["high-quality"] * 3
    labels = rm.read_label_set(spark, path)
    assert task_labels(labels, "preference") == ["high-quality", "low-quality", "fresh"]
    assert task_labels(labels, "other") == ["fresh"]
    assert {(r.task_type, r.key, r.label) for r in labels.keys.collect()} >= {("preference", "3", "fresh"), ("other", "1", "fresh")}


def test_spellings_collapse_when_a_merged_set_is_read_again(spark, bundle):
    target = bundle("t", labels=("Good", "bad"))
    rm.import_bundle(spark, target, bundle("s", labels=("good", "new")))
    assert task_labels(rm.read_label_set(spark, target), "preference") == ["Good", "bad", "new"]


def _records(spark, tmp_path, n):
    folder = str(tmp_path / "rows")
    if not (tmp_path / "rows").exists():
        spark.range(n).coalesce(1).write.parquet(folder)
    return rm.row_records(rm.with_row_index(spark.read.parquet(folder)), "id")


def test_simultaneous_runs_keep_the_labels_of_both(spark, tmp_path):
    path = str(tmp_path / "b")
    rm.create_bundle(spark, path, {"fingerprint": "f"}, labels=["old"])
    records = _records(spark, tmp_path, 3)
    with ThreadPoolExecutor(3) as pool:
        made = list(pool.map(lambda label: rm.annotate_bundle(spark, path, records, label).count(), ["one", "two", "three"]))
    assert made == [3, 3, 3]
    after = rm.read_label_set(spark, path)
    assert sorted(values(after.labels, "label")) == ["old", "one", "three", "two"]
    assert sorted(values(after.keys, "key")) == ["1", "2", "3", "4"]
    assert rm.read_annotations(spark, path).count() == 9


def test_a_writer_that_was_overtaken_joins_the_later_version(spark, tmp_path):
    path = str(tmp_path / "b")
    rm.create_bundle(spark, path, {"fingerprint": "f"}, labels=["old"])
    tries = []

    def adding(now, label):
        return merge_label_sets(now, new_label_set(spark, "preference", [label]))

    def slow(now):
        if not tries:  # another one commits while this one is at work
            tries.append(rm.update_label_set(spark, path, lambda then: adding(then, "fast")))
        return adding(now, "slow")

    after = rm.update_label_set(spark, path, slow)
    assert sorted(values(after.labels, "label")) == ["fast", "old", "slow"]
    assert sorted(values(rm.read_label_set(spark, path).labels, "label")) == ["fast", "old", "slow"]


@pytest.mark.parametrize("left", ["staged", "claim", "version"])
def test_a_writer_that_died_leaves_a_valid_label_set(spark, tmp_path, left):
    path = str(tmp_path / "b")
    rm.create_bundle(spark, path, {"fingerprint": "f"}, labels=["old"])
    rm.update_label_set(spark, path, lambda now: merge_label_sets(now, new_label_set(spark, "preference", ["new"])))
    folder = tmp_path / "b" / "_label_sets"
    number = "000000000002"
    if left == "staged":
        (folder / "_staged-x").mkdir()
        (folder / "_staged-x" / "part-0.json").write_text("half a li")
    else:
        (folder / "_commits" / f"{number}.claim").write_text("")
    if left == "version":
        (folder / f"version-{number}").mkdir()
        (folder / f"version-{number}" / "part-0.json").write_text("half a li")
    assert sorted(values(rm.read_label_set(spark, path).labels, "label")) == ["new", "old"]
    rm.update_label_set(spark, path, lambda now: merge_label_sets(now, new_label_set(spark, "preference", ["more"])))
    assert sorted(values(rm.read_label_set(spark, path).labels, "label")) == ["more", "new", "old"]
    rm.export_snapshot(spark, path, str(tmp_path / "copy"))
    assert sorted(values(rm.read_label_set(spark, str(tmp_path / "copy")).labels, "label")) == ["more", "new", "old"]


def test_small_files_are_replaced_whole(spark, tmp_path):
    path = str(tmp_path / "f.json")
    assert files.write_small_text(spark, path, "one", replace=False)
    assert not files.write_small_text(spark, path, "two", replace=False)
    assert files.read_small_text(spark, path) == "one"
    assert files.write_small_text(spark, path, "three") and files.read_small_text(spark, path) == "three"
    assert files.child_names(spark, str(tmp_path)) == ["f.json"]


def test_annotate_bundle_returns_what_was_appended(spark, tmp_path):
    path = str(tmp_path / "b")
    rm.create_bundle(spark, path, {"fingerprint": "f"})
    made = rm.annotate_bundle(spark, path, _records(spark, tmp_path, 4), "skip")
    time.sleep(1.1)
    ids = ["annotation_id", "created_at", "label"]
    assert sorted(map(tuple, made.select(*ids).collect())) == sorted(map(tuple, rm.read_annotations(spark, path).select(*ids).collect()))
