import pytest
from conftest import values
from pyspark.sql import functions as F

import rowmark as rm
from rowmark.operators.merge import row_key

SCHEMA = (
    "annotation_id STRING, task_type STRING, label STRING, row_id STRING, key_fields STRING, "
    "row_hash STRING, created_at STRING"
)


@pytest.fixture
def log(make):
    def build(*rows):
        filled = [(*row, *("p", "good", "r1", "{}", "h", "t")[len(row) - 1 :]) for row in rows]
        return make(filled, SCHEMA).select(
            "*",
            F.struct(F.col("row_id"), F.parse_json("key_fields").alias("key_fields")).alias("row_ref"),
        ).drop("row_id", "key_fields")

    return build


def ids(df):
    return values(df.orderBy(rm.POSITION), "annotation_id")


def test_ids_missing_empty_and_repeated(log):
    source = log((None,), (None,), ("",), ("",), ("x",), ("x",), ("t",), ("None",))
    assert ids(rm.import_new(log(("t",)), source)) == [None, "", "", "x"]
    assert ids(rm.first_per_id(source)) == [None, "", "", "x", "t"]
    assert ids(rm.import_new(log((None,)), source)) == ["", "", "x", "t"]
    assert ids(rm.import_new(log(("",)), source)) == [None, "", "", "x", "t"]


def test_first_record_wins_with_its_contents(log):
    source = log(("x", "p", "first"), ("x", "p", "second"))
    assert values(rm.import_new(log(), source), "label") == ["first"]


def test_merge_keeps_target_and_adds(log):
    merged = rm.merge(log(("t",)), log(("t",), ("s",)))
    assert sorted(values(merged, "annotation_id")) == ["s", "t"]


def test_report(log):
    target = log(("a", "p", "high", "r1"), ("b", "p", "high", "r3"))
    source = log(("a", "p", "high", "r1"), ("c", "p", "low", "r3"), ("d", "p", "high", "r1"), ("d", "p", "x", "r1"))
    row = rm.import_report(target, source).first()
    assert row.asDict() == {
        "source_count": 4, "existing_count": 2, "imported_count": 2, "duplicate_count": 2, "conflict_count": 1,
    }
    empty = rm.import_report(log(), log()).first()
    assert set(empty.asDict().values()) == {0}


@pytest.mark.parametrize(
    ("one", "other", "conflicts"),
    [
        (("a", "p", "x", "r", "{}", "h"), ("b", "p", "y", "r", "{}", "h"), 1),
        (("a", "p", "x", "r", "{}", "h"), ("b", "p", "X", "r", "{}", "h"), 1),
        (("a", "p", "x", "r", "{}", "h"), ("b", "p", "x", "r", "{}", "h"), 0),
        (("a", "p", "x", "r", "{}", "h"), ("b", "q", "y", "r", "{}", "h"), 0),
        (("a", "p", "x", "r", "{}", "h"), ("b", "p", "y", "r", "{}", "h2"), 0),
        (("a", "p", "x", "r", "{}", None), ("b", "p", "y", "r", "{}", ""), 1),
        (("a", "p", "x", "", '{"k":1,"j":2}', "h"), ("b", "p", "y", None, '{"j":2,"k":1}', "h"), 1),
        (("a", "p", "x", None, '{"k":1}', "h"), ("b", "p", "y", None, '{"k":2}', "h"), 0),
        (("a", "p", "x", None, None, "h"), ("b", "p", "y", "", "null", "h"), 1),
        (("a", "p", "x", None, "[]", "h"), ("b", "p", "y", None, "{}", "h"), 1),
        (("a", "p", "x", "{}", None, "h"), ("b", "p", "y", None, None, "h"), 1),
        (("a", "", "x", "r", "{}", "h"), ("b", "", "y", "r", "{}", "h"), 0),
        (("a", "p", None, "r", "{}", "h"), ("b", "p", "", "r", "{}", "h"), 0),
    ],
)
def test_conflicts(log, one, other, conflicts):
    both = log(one, other)
    assert rm.conflict_count(both).first().conflict_count == conflicts
    assert rm.conflict_groups(both).count() == conflicts


def test_row_key(log):
    df = log(("a", "p", "x", "", '{"b":[1],"a":null}'))
    assert df.select(row_key(df)).first()[0] == '{"a":null,"b":[1]}'


def test_one_id_on_a_third_of_the_log(spark):
    """No task gets all records of the hot id: what is shuffled by id is one row per task."""
    big = spark.range(0, 30000, 1, 12).select(
        F.col("id").alias(rm.POSITION),
        F.when(F.col("id") % 3 > 0, F.concat(F.lit("i"), F.col("id") % 5000)).alias("annotation_id"),
        F.lit("x" * 50).alias("note"),
    )
    target = big.filter("annotation_id < 'i2'").select("annotation_id", "note", rm.POSITION)
    new = rm.import_new(target, big)
    brute = {}
    present = {row.annotation_id or "None" for row in target.collect()}
    for row in big.orderBy(rm.POSITION).collect():
        brute.setdefault(row.annotation_id or "None", row[rm.POSITION])
    expected = sorted(p for i, p in brute.items() if i not in present)
    assert sorted(values(new, rm.POSITION)) == expected
    plan = new._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
    # Full records are exchanged by position only.
    for line in plan.splitlines():
        if "Exchange hashpartitioning(_id" in line:
            assert "note" not in line
