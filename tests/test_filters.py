import datetime
import itertools
import math

import pytest
from conftest import values
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

import rowmark as rm
from rowmark.functions.filters import BAD_CLAUSE, Clause, filter_clauses

ROWS = [(3.5, "top", "cedar"), (1.25, "top", "maple"), (1.25, "low", "maple"), (1.25, "low", "cedar")]


@pytest.fixture
def scored(make):
    return make(ROWS, "weight DOUBLE, shelf STRING, note STRING")


def kept(df, text, mode="typed"):
    return sorted(values(rm.filter_rows(df, text, mode), rm.POSITION))


@pytest.mark.parametrize("mode", ["typed", "coerce"])
def test_and_binds_tighter_than_or(scored, mode):
    assert kept(scored, "weight >= 2.5 && shelf == 'top' || note contains 'maple'", mode) == [0, 1, 2]
    assert kept(scored, "note contains 'maple' or weight >= 2.5 and shelf == 'top'", mode) == [0, 1, 2]


@pytest.mark.parametrize("mode", ["typed", "coerce"])
def test_brackets(scored, mode):
    assert kept(scored, "(weight > 2.5 and shelf == 'top') || note contains 'maple'", mode) == [0, 1, 2]
    assert kept(scored, "weight > 2.5 and (shelf == 'top' || note contains 'maple')", mode) == [0]
    assert kept(scored, "((weight>1.0)) AND ((note startswith 'ce') Or (shelf=low))", mode) == [0, 2, 3]


def test_clauses_in_order():
    assert filter_clauses("a>=1&&(b contains 'x y' || c = no)") == [
        Clause("a", ">=", 1), "and", "(", Clause("b", "contains", "x y"), "or",
        Clause("c", "==", "no"), ")",
    ]


@pytest.mark.parametrize(
    ("word", "value"),
    [
        ("NULL", None), ("none", None), ("True", True), ("FALSE", False), ("+5", 5), ("-05", -5),
        ("1.50", 1.5), ("1e5", "1e5"), (".5", ".5"), ("2024-01-01", "2024-01-01"), ("or", "or"),
        (")", ")"), ("==", "=="), ("'null'", "null"), (r"'a\nb'", "a\nb"), ('"a""b"', "ab"),
        (r"'it\'s'", "it's"), ("'open and == (", "'open and == ("), ("x'y z'", "x'y z'"),
        ("a&b", "a&b"), ("a!b", "a!b"), ("a|b", "a|b"), ("'a'+'b'", "a'+'b"),
        (r"'\x'", r"\x"), ("''", ""),
    ],
)
def test_values(word, value):
    (clause,) = filter_clauses(f"c == {word}")
    assert clause.value == value and type(clause.value) is type(value)


def test_names_by_place():
    assert filter_clauses("and == 1 and or == 2") == [Clause("and", "==", 1), "and", Clause("or", "==", 2)]


@pytest.mark.parametrize(
    "text",
    ["badclause", "a ==", "a", "a == 1 b == 2", "()", "(a == 1", "a == 1)", "a ~ 1", "1a == 1",
     "a-b == 1", "and", "a == 1 and", "é == 1", "a == 'x','y'", "'a' == 1", "a === 1 2"],
)
def test_bad_clauses(scored, text):
    with pytest.raises(ValueError, match="Invalid filter clause"):
        rm.filter_rows(scored, text)
    assert "column contains value" in BAD_CLAUSE


@pytest.mark.parametrize("text", [None, "", "  \n"])
def test_blank_keeps_all(scored, text):
    assert rm.filter_column(scored, text) is None
    assert kept(scored, text) == [0, 1, 2, 3]


def test_unknown_columns_are_listed_once(scored):
    with pytest.raises(ValueError, match=r"Unknown column\(s\): xyz, Weight$"):
        rm.filter_rows(scored, "xyz == 1 or Weight == 2 or xyz == 3 or weight == 1.0")
    with pytest.raises(ValueError, match="Unknown"):
        rm.filter_rows(scored, f"{rm.POSITION} == 1")


def test_dotted_names(make):
    df = make([(1,), (2,)], "`a.b` BIGINT")
    assert kept(df, "a.b == 2") == [1]


def test_extended_filter(scored):
    text = rm.extended_filter("weight > 2.5 or shelf == low", "note", "ma'ple")
    assert text == 'weight > 2.5 or shelf == low and note contains "ma\'ple"'
    assert kept(scored, rm.extended_filter("weight > 2.5 or shelf == low", "note", "maple")) == [0, 2]
    assert rm.extended_filter(None, "text", "a") == "text contains 'a'"


def test_count(scored):
    assert rm.filtered_count(scored, "shelf == top").first().row_count == 2


# --- typed mode ------------------------------------------------------------------------


@pytest.fixture
def mixed(make):
    when = datetime.datetime(2024, 1, 2, 3, 4, 5)
    return make(
        [
            (1, 1.5, "a", True, when.date(), when, [1]),
            (2, float("nan"), "5", False, None, None, None),
            (None, None, None, None, None, None, None),
        ],
        "n BIGINT, d DOUBLE, s STRING, b BOOLEAN, day DATE, ts TIMESTAMP, arr ARRAY<INT>",
    )


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("n == null", []), ("n != null", []), ("n != 1", [1]), ("n > 0.5", [0, 1]), ("n >= 1.5", [1]),
        ("n < 1.5", [0]), ("n == 1.0", [0]), ("n == 1.5", []), ("n != 1.5", [0, 1]),
        ("n < 99999999999999999999", [0, 1]), ("n > 99999999999999999999", []),
        ("n > -99999999999999999999", [0, 1]), ("d > 1000", [1]), ("d == 1.5", [0]), ("d != 1", [0, 1]),
        ("s == 'a'", [0]), ("s != a", [1]), ("s >= '5'", [0, 1]), ("s == '5'", [1]),
        ("b == true", [0]), ("b != true", [1]), ("b contains True", []), ("b contains 'true'", [0]),
        ("s contains ''", [0, 1, 2]), ("s contains a", [0]), ("n contains 2", [1]), ("d contains .5", [0]),
        ("day >= 2024-01-01", [0]), ("ts < '2024-01-02 03:04:06'", [0]), ("day contains 2024", [0]),
        ("arr contains 1", [0]), ("s contains null", []),
    ],
)
def test_typed(mixed, text, expected):
    assert kept(mixed, text) == expected


@pytest.mark.parametrize(
    "text",
    ["s == 5", "s > 1.5", "s == true", "n == a", "n == '1'", "b == 1", "b == 'true'", "n == true",
     "day == yesterday", "day > 5", "ts == noon", "arr == 1"],
)
def test_typed_refuses_mixed_types(mixed, text):
    with pytest.raises(ValueError, match="typed mode|not an ISO"):
        rm.filter_rows(mixed, text)


def test_mode_name(mixed):
    with pytest.raises(ValueError, match="mode"):
        rm.filter_rows(mixed, "n == 1", mode="loose")


# --- coerce mode -----------------------------------------------------------------------

OPERATORS = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b,
}


def loosely(op, left, right):
    """The coerce rule in plain Python: numbers if both sides read as numbers, else texts."""
    if op in ("==", "!="):
        return OPERATORS[op](left, right)
    pair = (left, right)
    if not all(isinstance(v, (int, float)) for v in pair):
        try:
            pair = tuple(float(v) for v in pair)
        except (TypeError, ValueError):
            if not all(isinstance(v, str) for v in pair):
                return False
    return OPERATORS[op](*pair)


LITERALS = {
    "5": 5, "5.0": 5.0, "2.5": 2.5, "-3": -3, "true": True, "false": False, "null": None,
    "9007199254740993": 9007199254740993, "99999999999999999999": 99999999999999999999,
    "'9'": "9", "'abc'": "abc", "'nan'": "nan", "'inf'": "inf", "''": "", "' 5 '": " 5 ",
}
COLUMNS = {
    "STRING": [None, "", "5", " 5 ", "5\n", "1d", "1_000", "nan", "-NaN", "inf", "-Infinity", "abc", "10",
               "9", "1e5", "0x10", "é", "5.", ".5", "_5", "5_", "1__0", "+7", "True", "1e", "  ",
               "1_.5", "1._5", "1_e5", "1e_5", "1e1_0", "1_000.000_1", "-.5e-3", ".", "+", "1e400", "--1",
               "9" * 400, "5 5", "inf_", "1_000_", "\u00a05", "\x1f5\u2003", "\u3000nan", "-inf\x1c", "5\x00", "5\n\n"],
    "BIGINT": [None, 0, 1, 2, 3, 5, -3, 9007199254740992, 9007199254740993, 2**63 - 1],
    "DOUBLE": [None, 0.0, 1.0, 2.5, 5.0, float("nan"), math.inf, -math.inf, 9007199254740992.0,
               9007199254740994.0, 1e20],
    "BOOLEAN": [None, True, False],
}


@pytest.mark.parametrize("dtype", list(COLUMNS))
def test_coerce_against_plain_python(make, dtype):
    cases = COLUMNS[dtype]
    df = make([(v,) for v in cases], f"c {dtype}")
    grid = list(itertools.product(OPERATORS, LITERALS))
    conditions = [
        F.coalesce(rm.filter_column(df, f"c {op} {word}", "coerce"), F.lit(False)).alias(f"r{i}")
        for i, (op, word) in enumerate(grid)
    ]
    rows = df.select(rm.POSITION, *conditions).collect()
    wrong = [
        (case, op, word)
        for row in rows
        for i, (op, word) in enumerate(grid)
        if (case := cases[row[rm.POSITION]], True)
        and row[f"r{i}"] != loosely(op, case, LITERALS[word])
    ]
    assert wrong == []


def test_coerce_other_types(mixed):
    assert kept(mixed, "day > '2000'", "coerce") == []
    assert kept(mixed, "day != '2000'", "coerce") == [0, 1, 2]
    assert kept(mixed, "day == null", "coerce") == [1, 2]
    assert kept(mixed, "b contains True", "coerce") == [0]
    assert kept(mixed, "b contains 'true'", "coerce") == []
    assert kept(mixed, "ts contains '2024-01-02 03'", "coerce") == [0]


def test_coerce_text_of_numbers(make):
    df = make([(1e16,), (12345678.9,), (0.00001,), (None,)], "d DOUBLE")
    assert kept(df, "d contains '1e+16'", "coerce") == [0]
    assert kept(df, "d startswith '12345678.'", "coerce") == [1]
    assert kept(df, "d endswith 'e-05'", "coerce") == [2]


# --- plans -----------------------------------------------------------------------------


@pytest.fixture
def stored(spark, scored, tmp_path):
    scored.withColumn("n", F.lit(1).cast("bigint")).write.parquet(str(tmp_path / "p"))
    return spark.read.parquet(str(tmp_path / "p"))


@pytest.mark.parametrize(
    ("text", "mode", "pushed"),
    [
        ("weight >= 1.5 and note contains 'cedar'", "typed", ["GreaterThanOrEqual(weight,1.5)", "StringContains(note,cedar)"]),
        ("n > 2.5 or note startswith 'm'", "typed", ["Or(GreaterThanOrEqual(n,3),StringStartsWith(note,m))"]),
        ("note endswith 'r' and shelf == top", "typed", ["StringEndsWith(note,r)", "EqualTo(shelf,top)"]),
        ("n >= 1 and note contains 'cedar'", "coerce", ["GreaterThanOrEqual(n,1)", "StringContains(note,cedar)"]),
        ("shelf == null", "coerce", ["IsNull(shelf)"]),
    ],
)
def test_filters_reach_the_scan(stored, text, mode, pushed):
    plan = rm.filter_rows(stored, text, mode)._jdf.queryExecution().executedPlan().toString()
    line = next(part for part in plan.splitlines() if "PushedFilters" in part)
    for test in pushed:
        assert test in line


def test_long_texts_are_read_in_linear_time(make):
    texts = ["1" * 200_000 + "x", "1_" * 100_000 + "1", "_" * 200_000, "1." * 100_000, "5" * 200_000, "\\" * 200_000]
    df = make([(t,) for t in texts], "c STRING")
    got = rm.filter_rows(df, "c > '7'", "coerce")
    assert sorted(values(got, rm.POSITION)) == [i for i, t in enumerate(texts) if loosely(">", t, "7")]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(
    ["a", "b", "and", "OR", "&&", "||", "(", ")", "==", "=", "!=", ">", "contains", "'x y'", '"', "'", "\\", "5",
     "null", "!", "&", " ", "\n"]), max_size=12))
def test_any_text_is_read_or_refused(words):
    text = " ".join(words)
    try:
        items = filter_clauses(text)
    except ValueError as error:
        assert str(error) == BAD_CLAUSE
        return
    assert items.count("(") == items.count(")")
    clauses = sum(isinstance(i, Clause) for i in items)
    assert items.count("and") + items.count("or") == max(clauses - 1, 0)
    assert bool(items) == bool(text.strip())
