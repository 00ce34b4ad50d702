import datetime
import hashlib
import json
import random

import pytest
from conftest import values
from pyspark.sql import functions as F

import rowmark as rm
from rowmark.functions.jsontext import double_text, json_text


def one(df, c):
    return df.select(c).first()[0]


def python_hash(row):
    text = json.dumps(row, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return "sha256:" + hashlib.sha256(text.encode()).hexdigest()


def test_hash_does_not_depend_on_key_order(spark):
    schema = "b BIGINT, nested STRUCT<k2: ARRAY<BIGINT>, k1: STRUCT<x: STRING>>, a BIGINT"
    df = spark.createDataFrame([(2, ([1, 2, 3], ("y",)), 1)], schema)
    other = spark.createDataFrame(
        [(1, 2, (("y",), [1, 2, 3]))],
        "a BIGINT, b BIGINT, nested STRUCT<k1: STRUCT<x: STRING>, k2: ARRAY<BIGINT>>",
    )
    expected = python_hash({"a": 1, "b": 2, "nested": {"k1": {"x": "y"}, "k2": [1, 2, 3]}})
    assert one(df, rm.row_hash(df)) == one(other, rm.row_hash(other)) == expected


def test_hash_changes_with_a_value(spark):
    df = spark.createDataFrame([("hello",), ("hello!",), (None,), ("null",)], "text STRING")
    assert df.select(rm.row_hash(df).alias("h")).distinct().count() == 4


def test_hash_equals_plain_python(spark):
    rows = [
        (1, "é \"q\" \\ \n\t \x1f \x0b \\u001F   \x7f", True, 0.5, None),
        (-5, "", False, 12345678.9, "x"),
        (2**62, "\\\\\x1a\x1b", None, 0.0009, "\x00"),
        (0, "a", True, 1e15, "z"),
        (7, "b", True, -0.0, "{}"),
        (7, "b", True, 100.0, "}"),
        (8, "\\" * 200_001 + "\x1f", True, 1e9, "\x1a" * 10),
    ]
    df = spark.createDataFrame(rows, "n BIGINT, s STRING, b BOOLEAN, d DOUBLE, o STRING")
    got = values(df.coalesce(1).select(rm.row_hash(df).alias("h")), "h")
    assert got == [python_hash(dict(zip("nsbdo", row))) for row in rows]


def test_canonical_forms(spark):
    df = spark.sql(
        """select double('NaN') as a, double('-Infinity') as b, float(0.1) as c, cast(null as int) as d,
        timestamp_ntz'2024-01-01 00:00:00.5' as e, timestamp'2024-01-01 00:00:00' as f, date'2024-01-02' as g,
        map('z', 1e20D, 'y', cast(null as double)) as h, array(named_struct('y', 1, 'x', 1e9D)) as i,
        cast(1.5 as decimal(10, 2)) as j, cast(0 as decimal(20, 10)) as k, parse_json('{"q":1,"p":[1]}') as l"""
    )
    assert json.loads(one(df, rm.canonical_json(df))) == {
        "a": "NaN", "b": "-Infinity", "c": 0.10000000149011612, "d": None,
        "e": "2024-01-01T00:00:00.500000", "f": "2024-01-01T00:00:00+00:00", "g": "2024-01-02",
        "h": {"y": None, "z": 1e20}, "i": [{"x": 1e9, "y": 1}], "j": 1.5, "k": 0.0, "l": {"p": [1], "q": 1},
    }
    text = one(df, rm.canonical_json(df))
    assert text.index('"p"') < text.index('"q"') and '"y":null,"z":1e20' in text


def test_both_ways_of_rendering_agree(spark):
    """Rows that need pieces and rows that do not give the same text for the same fields."""
    df = spark.createDataFrame(
        [("a}", [1], 1.5, 2.5), ("a}", [1], 1.5e-9, 2.5)], "s STRING, arr ARRAY<INT>, d DOUBLE, e DOUBLE"
    )
    texts = values(df.coalesce(1).select(rm.canonical_json(df).alias("t")), "t")
    assert texts == ['{"arr":[1],"d":1.5,"e":2.5,"s":"a}"}', '{"arr":[1],"d":1.5e-9,"e":2.5,"s":"a}"}']


def test_number_text(spark):
    random.seed(3)
    numbers = [0.0, -0.0, 1e-5, 1e-4, 1e7, 1e15, 1.5e-7, 1e22, 1e100, 0.1, 123456.0]
    numbers += [
        random.choice((1, -1)) * random.random() * 10 ** random.randint(-12, 15) for _ in range(2000)
    ]
    df = spark.createDataFrame([(v,) for v in numbers], "v DOUBLE").coalesce(1)
    assert values(df.select(double_text(F.col("v"), "python").alias("t")), "t") == [repr(v) for v in numbers]
    shown = values(df.select(double_text(F.col("v")).alias("t")), "t")
    assert [float(t) for t in shown] == numbers
    assert shown[2:8] == ["0.00001", "0.0001", "10000000.0", "1000000000000000.0", "1.5e-7", "1e22"]


def test_json_text_indented(spark):
    df = spark.sql("select named_struct('b', array(1, 2), 'a', map('k', cast(null as int)), 'e', array()) as v")
    text = one(df, json_text(F.col("v"), df.schema["v"].dataType, indent=2))
    assert text == json.dumps({"a": {"k": None}, "b": [1, 2], "e": []}, indent=2)


def test_row_id_falls_through_nulls(make):
    df = make([("a", "x", 1), (None, "y", 2), (None, None, 3)], "sample STRING, id STRING, uuid BIGINT")
    assert values(df.select(rm.row_id(df, "sample").alias("r")), "r") == ["a", "y", "3"]
    assert values(df.select(rm.row_id(df).alias("r")), "r") == ["x", "y", "3"]
    plain = df.select("sample")
    assert values(plain.select(rm.row_id(plain, "absent").alias("r")), "r") == [None] * 3


def test_key_fields_in_request_order(make):
    df = make([("abc", "train", None)], "sample_id STRING, split STRING, text STRING")
    asked = ["split", "text", "absent", "sample_id"]
    assert one(df, rm.key_fields(df, asked)) == '{"split":"train","sample_id":"abc"}'
    assert one(df, rm.key_fields(df, [])) == "{}"


def test_row_records(make):
    df = make([("abc", "train", "hello")], "sample_id STRING, `g.r` STRING, text STRING")
    record = rm.row_records(df, "sample_id", ["sample_id", "g.r"]).select(
        "row_index", "row_id", F.to_json("key_fields").alias("k"), "row_hash", F.to_json("row_data").alias("d")
    ).first()
    row = {"sample_id": "abc", "g.r": "train", "text": "hello"}
    assert (record.row_index, record.row_id) == (0, "abc")
    assert json.loads(record.k) == {"sample_id": "abc", "g.r": "train"} and json.loads(record.d) == row
    assert record.row_hash == python_hash(row)
    narrow = rm.row_records(df, hash_columns=["text"]).first()
    assert narrow.row_hash == python_hash({"text": "hello"})
    with pytest.raises(ValueError, match="position"):
        rm.row_records(df.drop(rm.POSITION))


def test_zoneless_times_do_not_follow_the_session_zone(spark):
    times = ["2024-03-10 02:30:00", "2024-03-10 02:30:00.5", "2024-11-03 01:30:00.000007", "0001-01-01 00:00:00"]
    df = spark.createDataFrame([(t,) for t in times], "t STRING").coalesce(1).select(F.col("t").cast("timestamp_ntz"))
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = values(df.select(rm.canonical_json(df).alias("j")), "j")
        shown = values(df.select(rm.cell_text(df, "t").alias("s")), "s")
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    expected = [str(datetime.datetime.fromisoformat(t)) for t in times]
    assert shown == expected
    assert got == [json.dumps({"t": t.replace(" ", "T")}, separators=(",", ":")) for t in expected]


def test_nothing_depends_on_the_session_zone(spark):
    rows = spark.sql(
        f"SELECT 0L AS {rm.POSITION}, TIMESTAMP'2024-03-31 02:30:00.5Z' AS at, TIMESTAMP'1960-01-01 00:00:00Z' AS old, "
        "array(TIMESTAMP'2024-10-27 00:30:00Z') AS many, 1.5E8D AS big"
    )
    old, seen = spark.conf.get("spark.sql.session.timeZone"), set()
    for zone in ("UTC", "Asia/Tokyo", "Europe/Berlin"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        seen.add(tuple(rows.select(rm.row_hash(rows), rm.canonical_json(rows), rm.key_fields(rows, ["at", "big", "many"])).first()))
    spark.conf.set("spark.sql.session.timeZone", old)
    assert len(seen) == 1
    assert seen.pop()[2] == '{"at":"2024-03-31T02:30:00.500000+00:00","big":150000000.0,"many":["2024-10-27T00:30:00+00:00"]}'
