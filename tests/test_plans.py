"""Plans that must hold at any size: automatic broadcasts off, as for tables that are too large."""

import re

import pytest

from rowmark.plans.catalogue import QUERIES

SF = "/root/testdata/sf0.001"

# Queries whose only single-partition exchange brings together one row or number per task.
ONE_ROW = {
    "dataset_fingerprint", "dataset_meta", "file_fingerprint", "filtered_count", "annotate_rows",
    "annotation_count", "import_report", "label_conflict_count", "import_bundle", "time_range",
    "conflicts_filtered", "record_counts", "bundle_summary", "inspect_rows",
}
# Written to storage inside the query; their inner plans are covered by the queries they use.
WRITING = {"import_bundle", "import_steps", "growing_conflicts", "growing_fingerprint", "label_versions", "bundle_report", "known_ids", "merge_feed", "export_snapshot", "annotate_bundle"}
PAGES = {"curation_page", "page", "page_after", "page_at_row", "sample_rows", "sample_annotations", "page_working_names", "page_deep", "page_of_parts"}


@pytest.fixture(scope="module")
def plans(spark):
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for key in keys:
        spark.conf.set(key, "-1")
    try:
        return {
            name: run(spark, SF)._jdf.queryExecution().executedPlan().toString()
            for name, run in QUERIES.items()
            if name not in WRITING
        }
    finally:
        for key in keys:
            spark.conf.unset(key)


def test_no_cross_joins(plans):
    for name, plan in plans.items():
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_nothing_whole_goes_through_one_task(plans):
    for name, plan in plans.items():
        if name not in ONE_ROW:
            assert "Exchange SinglePartition" not in plan, name
        for line in plan.splitlines():
            # Windows run over a task's labels or codes.
            if re.search(r"[-+] Window ", line):
                assert "task_type" in line and name in ("label_codes", "label_code_merge"), name


def test_windows_keep_nine_rows_before_the_shuffle(plans):
    assert plans["label_codes"].count("WindowGroupLimit") >= 2


def test_only_checked_broadcasts(plans):
    hinted = {name for name, plan in plans.items() if "BroadcastExchange" in plan}
    assert hinted == PAGES - {"sample_annotations", "sample_rows", "page_of_parts"} | {"resolve_labels"}


def test_no_python_in_registered_queries(plans):
    for name, plan in plans.items():
        assert not re.search("Python|InArrow|InPandas", plan), name


def test_pages_take_the_top(plans):
    for name in PAGES:
        assert "TakeOrderedAndProject" in plans[name] and "Exchange hash" not in plans[name], name


def test_scans_read_only_what_is_needed(plans):
    assert "ReadSchema: struct<c_acctbal:double>" in plans["filtered_count"]
    assert "ReadSchema: struct<user_id:bigint,event_type:string,value:double>" in plans["facet_counts"]
    assert "text" not in re.search(r"ReadSchema: \S+", plans["row_index"]).group()


def test_merge_reduces_ids_before_joining(plans):
    plan = plans["import_new"]
    anti = plan.index("LeftAnti")
    assert "HashAggregate(keys=[_id" in plan[anti : anti + 400]
    assert "Window" not in plan
