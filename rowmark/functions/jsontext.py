"""JSON and display text of values, as Spark columns.

Row hashes are taken over JSON text, so that text has to be the same for the same
value whatever Spark's own number or timestamp rendering looks like. Spark prints
``1.23456789E7`` where JSON writers in other languages print ``12345678.9``. Values are
brought into a form that ``to_json`` renders canonically, one call for the whole row; only
rows with such numbers are put together piece by piece.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce
from itertools import groupby
from operator import and_

from pyspark.sql import Column, functions as F, types as T

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOATING = (T.FloatType, T.DoubleType)
TIMESTAMPS = (T.TimestampType, T.TimestampNTZType)
NESTED = (T.StructType, T.ArrayType, T.MapType, T.VariantType)

Field = tuple[str, Column, T.DataType]


# --- numbers and times -----------------------------------------------------------------


def _ordinary_double(c: Column) -> Column:
    """Doubles that Spark already prints in plain notation."""
    return (c == 0) | ((F.abs(c) >= 1e-3) & (F.abs(c) < 1e7))


def double_text(c: Column, style: str = "json") -> Column:
    """Shortest decimal text of a double.

    ``json``: plain from 1e-5 up to 1e16, else ``1e16`` / ``1e-6``; non-finite values are
    quoted words. ``python``: plain from 1e-4 up to 1e16, else ``1e+16`` / ``1e-05``.
    """
    d = c.cast("double")
    text = d.cast("string")
    # All digits a double prints in the plain range fit 16 places before and 22 after the point.
    digits = text.try_cast("decimal(38,22)").cast("string")
    plain = F.regexp_replace(digits, r"(\.\d*[1-9]|\.0)0*$", "$1")
    scientific = F.regexp_replace(F.regexp_replace(text, r"\.0E", "E"), "E", "e")
    if style == "python":
        smallest, quote = 1e-4, ""
        scientific = F.regexp_replace(scientific, r"e(-?)(\d)$", "e$10$2")
        scientific = F.regexp_replace(scientific, r"e(\d)", "e+$1")
        words = {"NaN": "nan", "Infinity": "inf", "-Infinity": "-inf"}
    else:
        smallest, quote = 1e-5, '"'
        words = {"NaN": "NaN", "Infinity": "Infinity", "-Infinity": "-Infinity"}
    rendered = F.when(_ordinary_double(d), text)
    for name, word in words.items():
        rendered = rendered.when(text == name, quote + word + quote)
    in_range = (F.abs(d) >= smallest) & (F.abs(d) < 1e16)
    return rendered.when(in_range, plain).otherwise(scientific)


def _timestamp_text(c: Column, dtype: T.DataType, separator: str) -> Column:
    """ISO text with six fraction digits, or none when they are all zero."""
    if isinstance(dtype, T.TimestampType):
        # An instant is shown in UTC, whatever the session's zone is.
        start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
        utc = F.timestamp_add("MICROSECOND", F.unix_micros(c), start)
        return F.concat(_timestamp_text(utc, T.TimestampNTZType(), separator), F.lit("+00:00"))
    # date_format would take the value for a time of the session's zone, which may skip it.
    text = c.cast("string")
    point = F.instr(text, ".")
    text = F.when(point > 0, F.rpad(text, point + 6, "0")).otherwise(text)
    return text if separator == " " else F.replace(text, F.lit(" "), F.lit(separator))


# --- values that to_json renders canonically -------------------------------------------


def _entries(c: Column, sort_keys: bool) -> Column:
    """Entries of a map as (k, v) structs with text keys."""
    keys = F.transform(F.map_keys(c), lambda k: F.struct(k.cast("string").alias("k"), k.alias("key")))
    if sort_keys:
        keys = F.array_sort(keys)
    return F.transform(
        keys, lambda e: F.struct(e["k"].alias("k"), F.element_at(c, e["key"]).alias("v"))
    )


def _renderable(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.StructType):
        return all(_renderable(f.dataType) for f in dtype.fields)
    if isinstance(dtype, T.ArrayType):
        return _renderable(dtype.elementType)
    if isinstance(dtype, T.MapType):
        return _renderable(dtype.valueType)
    # Decimals with more places can come out as 1E-7.
    return not isinstance(dtype, T.DecimalType) or dtype.scale <= 6


def _value(c: Column, dtype: T.DataType, sort_keys: bool) -> Column:
    if isinstance(dtype, T.FloatType):
        return c.cast("double")
    if isinstance(dtype, TIMESTAMPS):
        return _timestamp_text(c, dtype, "T")
    if isinstance(dtype, T.StructType):
        fields = sorted(dtype.fields, key=lambda f: f.name) if sort_keys else dtype.fields
        parts = [_value(c.getField(f.name), f.dataType, sort_keys).alias(f.name) for f in fields]
        return F.when(c.isNotNull(), F.struct(*parts))
    if isinstance(dtype, T.ArrayType):
        return F.transform(c, lambda x: _value(x, dtype.elementType, sort_keys))
    if isinstance(dtype, T.MapType):
        return F.map_from_entries(
            F.transform(
                _entries(c, sort_keys),
                lambda e: F.struct(e["k"], _value(e["v"], dtype.valueType, sort_keys)),
            )
        )
    if isinstance(dtype, (T.StringType, T.BooleanType, T.DoubleType, T.DecimalType, T.BinaryType,
                          T.VariantType, T.NullType, *INTEGRAL)):
        return c
    return c.cast("string")


def _ordinary(c: Column, dtype: T.DataType) -> Column | None:
    """Whether all doubles within a value are ordinary; None if it holds no doubles."""
    inner = None
    if isinstance(dtype, FLOATING):
        inner = _ordinary_double(c)
    elif isinstance(dtype, T.StructType):
        tests = [_ordinary(c.getField(f.name), f.dataType) for f in dtype.fields]
        tests = [test for test in tests if test is not None]
        inner = reduce(and_, tests) if tests else None
    elif isinstance(dtype, T.ArrayType):
        if _ordinary(F.lit(None), dtype.elementType) is not None:
            inner = F.forall(c, lambda x: _ordinary(x, dtype.elementType))
    elif isinstance(dtype, T.MapType):
        if _ordinary(F.lit(None), dtype.valueType) is not None:
            inner = F.forall(F.map_values(c), lambda x: _ordinary(x, dtype.valueType))
    return None if inner is None else c.isNull() | inner


# --- JSON text -------------------------------------------------------------------------


def _lower_hex(text: Column) -> Column:
    # Control characters are written \u001F by Spark and \u001f by most JSON writers.
    # An escape counts only after an even run of backslashes. Such text is rare, so the
    # replacements sit behind a cheap check.
    fixed = text
    for digit in "ABCDEF":
        fixed = F.regexp_replace(
            fixed, rf"(?<!\\)((?:\\\\)*)\\u00([01]){digit}", rf"$1\\u00$2{digit.lower()}"
        )
    return F.when(text.contains("\\u00"), fixed).otherwise(text)


def _quoted(c: Column) -> Column:
    return F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]\z", "")


def _at_once(fields: Sequence[Field], sort_keys: bool) -> Column:
    values = [_value(c, dtype, sort_keys).alias(name) for name, c, dtype in fields]
    return F.to_json(F.struct(*values), {"ignoreNullFields": "false"})


def object_text(fields: Sequence[Field], sort_keys: bool = True) -> Column:
    """A JSON object from (name, column, type) fields."""
    if sort_keys:
        fields = sorted(fields, key=lambda f: f[0])
    if not fields:
        return F.lit("{}")
    if not all(_renderable(dtype) for _, _, dtype in fields):
        return _lower_hex(_pieces(fields, sort_keys))
    tests = [test for _, c, dtype in fields if (test := _ordinary(c, dtype)) is not None]
    text = _at_once(fields, sort_keys)
    if tests:
        text = F.when(reduce(and_, tests), text).otherwise(_pieces(fields, sort_keys))
    return _lower_hex(text)


def _pieces(fields: Sequence[Field], sort_keys: bool) -> Column:
    """The same object with neighbouring fields in one call where their values allow it."""

    def simple(dtype: T.DataType) -> bool:
        return _renderable(dtype) and _ordinary(F.lit(None), dtype) is None

    parts = []
    for at_once, run in groupby(fields, key=lambda f: simple(f[2])):
        if at_once:
            parts.append(F.regexp_replace(_at_once(list(run), sort_keys), r"^\{|\}\z", ""))
        else:
            parts += [
                F.concat(F.lit(json.dumps(name, ensure_ascii=False) + ":"), _text(c, dtype, sort_keys))
                for name, c, dtype in run
            ]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def json_text(c: Column, dtype: T.DataType, sort_keys: bool = True, indent: int = 0) -> Column:
    """JSON text of any value, optionally indented; SQL null is the word ``null``."""
    if indent or not isinstance(dtype, T.StructType):
        return _lower_hex(_text(c, dtype, sort_keys, indent))
    fields = [(f.name, c.getField(f.name), f.dataType) for f in dtype.fields]
    return F.when(c.isNotNull(), object_text(fields, sort_keys)).otherwise("null")


def _text(
    c: Column, dtype: T.DataType, sort_keys: bool = True, indent: int = 0, level: int = 0
) -> Column:
    inner = "\n" + " " * indent * (level + 1) if indent else ""
    outer = "\n" + " " * indent * level if indent else ""
    colon = ": " if indent else ":"

    def within(x: Column, t: T.DataType) -> Column:
        return _text(x, t, sort_keys, indent, level + 1)

    def joined(items: Column, opening: str, closing: str) -> Column:
        return F.when(F.size(items) == 0, opening + closing).otherwise(
            F.concat(
                F.lit(opening + inner), F.array_join(items, "," + inner), F.lit(outer + closing)
            )
        )

    if isinstance(dtype, FLOATING):
        text = double_text(c)
    elif isinstance(dtype, T.StructType):
        fields = sorted(dtype.fields, key=lambda f: f.name) if sort_keys else dtype.fields
        parts = [
            F.concat(
                F.lit(json.dumps(f.name, ensure_ascii=False) + colon),
                within(c.getField(f.name), f.dataType),
            )
            for f in fields
        ]
        text = F.when(c.isNotNull(), joined(F.array(*parts), "{", "}"))
    elif isinstance(dtype, T.ArrayType):
        text = joined(F.transform(c, lambda x: within(x, dtype.elementType)), "[", "]")
    elif isinstance(dtype, T.MapType):
        items = F.transform(
            _entries(c, sort_keys),
            lambda e: F.concat(_quoted(e["k"]), F.lit(colon), within(e["v"], dtype.valueType)),
        )
        text = joined(items, "{", "}")
    elif isinstance(dtype, T.VariantType):
        text = F.to_json(c, {"pretty": "true"} if indent else None)
    elif isinstance(dtype, T.NullType):
        return F.lit("null")
    elif isinstance(dtype, (T.BooleanType, T.DecimalType, *INTEGRAL)):
        text = c.cast("string")
    elif isinstance(dtype, T.BinaryType):
        text = _quoted(F.base64(c))
    else:
        text = F.when(c.isNotNull(), _quoted(_value(c, dtype, sort_keys)))
    return F.coalesce(text, F.lit("null"))


def display_text(c: Column, dtype: T.DataType) -> Column:
    """Text shown for one value; null stays null. Booleans read True / False."""
    if isinstance(dtype, T.StringType):
        return c
    if isinstance(dtype, T.BooleanType):
        return F.when(c, "True").when(~c, "False")
    if isinstance(dtype, FLOATING):
        return double_text(c, "python")
    if isinstance(dtype, TIMESTAMPS):
        return _timestamp_text(c, dtype, " ")
    if isinstance(dtype, NESTED):
        return F.when(c.isNotNull(), json_text(c, dtype, sort_keys=False))
    return c.cast("string")
