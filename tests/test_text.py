import json

from pyspark.sql import functions as F

import rowmark as rm
from rowmark.functions.text import BLANKS, trimmed


def test_preview(spark):
    df = spark.createDataFrame(
        [("x" * 120, None, True, 1e16, (2, "b")), ("é" * 121, 5, False, 0.5, None)],
        "s STRING, n BIGINT, b BOOLEAN, d DOUBLE, o STRUCT<z: INT, a: STRING>",
    ).coalesce(1)
    first, second = df.select(*(rm.cell_preview(df, c).alias(c) for c in df.columns)).collect()
    assert tuple(first) == ("x" * 120, "", "True", "1e+16", '{"z":2,"a":"b"}')
    assert tuple(second) == ("é" * 117 + "...", "5", "False", "0.5", "")


def test_full_text(spark):
    df = spark.createDataFrame(
        [("x" * 200, None, True, [1, None], {"k": 1.0})],
        "s STRING, n BIGINT, b BOOLEAN, arr ARRAY<INT>, m MAP<STRING, DOUBLE>",
    )
    row = df.select(*(rm.cell_text(df, c).alias(c) for c in df.columns)).first()
    assert tuple(row) == ("x" * 200, "null", "True", json.dumps([1, None], indent=2), '{\n  "k": 1.0\n}')


def test_slug(spark):
    words = ["Hello, World!", "__A--b__", "!!!", "", "Ünï code 7", None]
    df = spark.createDataFrame([(w,) for w in words], "w STRING").coalesce(1)
    got = [r[0] for r in df.select(rm.slugify(F.col("w"))).collect()]
    assert got == ["hello_world", "a_b", "dataset", "dataset", "n_code_7", "dataset"]


def test_label_key(spark):
    df = spark.createDataFrame([(" \tGood\n",)], "w STRING")
    assert df.select(rm.label_key(F.col("w"))).first()[0] == "good"


def test_trimming_equals_python(spark):
    words = [chr(n) + "x" + chr(n) for n in range(1, 0x3100) if chr(n).isspace()]
    df = spark.createDataFrame([(w,) for w in words], "w STRING")
    assert {r[0] for r in df.select(trimmed(F.col("w"))).collect()} == {"x"}
    assert set(BLANKS) == {w[0] for w in words}
