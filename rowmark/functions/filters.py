"""Filter text such as ``score >= 0.6 and text contains 'beta'`` as a Spark condition.

Each clause becomes a Column and Catalyst does the rest: pushdown, pruning, folding.
Two modes exist because two kinds of data are read:

* ``typed``: values are compared in the column's own type; a clause that mixes types is
  refused when the filter is built, and nulls never match.
* ``coerce``: values are compared as loosely typed records would be: number-like text is
  compared as a number, ``!=`` keeps nulls, ``== null`` finds them.

There is no ``not``, so a null condition always means "row dropped".
"""

from __future__ import annotations

import ast
import math
import re
import warnings
from datetime import date, datetime
from decimal import Decimal
from functools import reduce
from operator import and_, eq, ge, gt, le, lt, ne, or_
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame, functions as F, types as T

from rowmark.functions.identity import POSITION, column
from rowmark.functions.jsontext import FLOATING, INTEGRAL, NESTED, display_text, double_text, json_text

# The filter language's operators, column names and error text.
COMPARISONS = {"==": eq, "=": eq, "!=": ne, ">": gt, ">=": ge, "<": lt, "<=": le}
TEXT_TESTS = {"contains": "contains", "startswith": "startswith", "endswith": "endswith"}
COLUMN_NAME = re.compile(r"^[A-Za-z_][A-Za-z0-9_\.]*$")
BAD_CLAUSE = (
    "Invalid filter clause. Expected format like `column == value` or `column contains value`."
)

_WORDS = re.compile(
    r"""
    && | \|\| | == | >= | <= | !=            # two-character operators need no blanks
    | [()<>=]
    | (?: '(?:\\.|[^\\'])*(?:'|\\?\Z)        # quotes group, backslash pairs stay whole
        | "(?:\\.|[^\\"])*(?:"|\\?\Z)
        | (?!&&|\|\||!=)[^\s()<>='"]
      )+
    """,
    re.VERBOSE | re.DOTALL,
)

# Text that reads as a number: blanks around, optional sign and exponent, `_` between digits.
# All patterns run in linear time whatever the text.
_BLANKS = r"\s*"
_NUMBER = rf"(?U)^{_BLANKS}([+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?){_BLANKS}\z"
_STRAY_UNDERSCORE = r"(?<![0-9])_|_(?![0-9])"
_INFINITE = rf"(?iU)^{_BLANKS}[+-]?inf(?:inity)?{_BLANKS}\z"
_NOT_A_NUMBER = rf"(?iU)^{_BLANKS}[+-]?nan{_BLANKS}\z"


class Clause(NamedTuple):
    column: str
    operator: str
    value: Any


def filter_clauses(text: str | None) -> list[Clause | str]:
    """Clauses in order, with the words ``and``, ``or``, ``(``, ``)`` between them."""
    words = _WORDS.findall(text or "")
    items: list[Clause | str] = []
    depth = 0
    at = 0
    clause_next = True
    while at < len(words):
        word = words[at]
        if clause_next and word != "(":
            items.append(_clause(words[at : at + 3]))
            at += 3
            clause_next = False
            continue
        at += 1
        joiner = {"and": "and", "&&": "and", "or": "or", "||": "or"}.get(word.lower())
        if clause_next:
            depth += 1
            items.append("(")
        elif joiner:
            items.append(joiner)
            clause_next = True
        elif word == ")" and depth:
            depth -= 1
            items.append(")")
        else:
            raise ValueError(BAD_CLAUSE)
    if items and (clause_next or depth):
        raise ValueError(BAD_CLAUSE)
    return items


def _clause(words: list[str]) -> Clause:
    if len(words) < 3 or not COLUMN_NAME.match(words[0]):
        raise ValueError(BAD_CLAUSE)
    operator = words[1].lower()
    if operator not in COMPARISONS and operator not in TEXT_TESTS:
        raise ValueError(BAD_CLAUSE)
    return Clause(words[0], "==" if operator == "=" else operator, _literal(words[2]))


# Words that stand for a value, and how numbers are written in a filter.
_CONSTANTS = {"none": None, "null": None, "true": True, "false": False}
_WRITTEN_NUMBER = re.compile(r"(?P<whole>[+-]?\d+)(?P<places>\.\d+)?")


def _quoted(word: str) -> str:
    """The text between quotes, with the escapes of a Python string where they are valid."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore", SyntaxWarning)
            text = ast.literal_eval(word)
    except (SyntaxError, ValueError):
        return word[1:-1]
    if isinstance(text, str):
        return text
    raise ValueError(BAD_CLAUSE)


def _literal(word: str) -> Any:
    """A constant, a quoted text, a number, or else the word itself."""
    if len(word) > 1 and word[0] in "'\"" and word.endswith(word[0]):
        return _quoted(word)
    if number := _WRITTEN_NUMBER.fullmatch(word):
        return float(word) if number["places"] else int(word)
    return _CONSTANTS.get(word.lower(), word)


def filter_column(df: DataFrame, text: str | None, mode: str = "typed") -> Column | None:
    """The condition for a filter text, or None when the text is blank."""
    if mode not in ("typed", "coerce"):
        raise ValueError("Filter mode must be 'typed' or 'coerce'.")
    items = filter_clauses(text)
    names = set(df.columns) - {POSITION}
    clauses = [item for item in items if isinstance(item, Clause)]
    unknown = list(dict.fromkeys(c.column for c in clauses if c.column not in names))
    if unknown:
        raise ValueError(f"Unknown column(s): {', '.join(unknown)}")
    if not items:
        return None

    condition = _typed if mode == "typed" else _coerced
    # Open brackets, innermost last; each is a list of or-ed lists of and-ed conditions.
    open_groups: list[list[list[Column]]] = [[[]]]
    for item in items:
        if isinstance(item, Clause):
            dtype = df.schema[item.column].dataType
            open_groups[-1][-1].append(condition(column(item.column), dtype, item))
        elif item == "or":
            open_groups[-1].append([])
        elif item == "(":
            open_groups.append([[]])
        elif item == ")":
            closed = open_groups.pop()
            open_groups[-1][-1].append(_any_of(closed))
    return _any_of(open_groups[0])


def _any_of(groups: list[list[Column]]) -> Column:
    return reduce(or_, (reduce(and_, group) for group in groups))


def filter_rows(df: DataFrame, text: str | None, mode: str = "typed") -> DataFrame:
    """Keep the rows that match a filter text; blank text keeps all rows."""
    condition = filter_column(df, text, mode)
    return df if condition is None else df.filter(condition)


def filtered_count(df: DataFrame, text: str | None, mode: str = "typed") -> DataFrame:
    """One row with the number of matching rows."""
    return filter_rows(df, text, mode).agg(F.count(F.lit(1)).alias("row_count"))


def extended_filter(text: str | None, name: str, needle: str) -> str:
    """The filter text with ``and <name> contains <needle>`` added at its end.

    The text is extended as it stands, so ``a or b`` becomes ``a or (b and ...)``; chain
    `filter_rows` calls to narrow the whole result instead.
    """
    added = f"{name} contains {needle!r}"
    return f"{text.strip()} and {added}" if text and text.strip() else added


# --- comparisons -----------------------------------------------------------------------


def _compare(c: Column, operator: str, value: Any) -> Column:
    return COMPARISONS[operator](c, value if isinstance(value, Column) else F.lit(value))


def _is_number(value: Any) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool)


def _whole_number(c: Column, operator: str, value: int | float) -> Column:
    """Integer column against any number, kept in integers so that it can be pushed down."""
    if isinstance(value, float) and not math.isfinite(value):
        return _compare(c.cast("double"), operator, value)
    if value != int(value):
        if operator in ("==", "!="):
            return F.lit(False) if operator == "==" else c.isNotNull()
        if operator in (">", ">="):
            operator, value = ">=", math.ceil(value)
        else:
            operator, value = "<=", math.floor(value)
    value = int(value)
    if -(2**63) <= value < 2**63:
        return _compare(c, operator, value)
    always = operator == "!=" or operator in (("<", "<=") if value > 0 else (">", ">="))
    return c.isNotNull() if always else F.lit(False)


def _as_float(value: int | float) -> float:
    try:
        return float(value)
    except OverflowError:
        return math.inf if value > 0 else -math.inf


def _typed_number(c: Column, dtype: T.DataType, operator: str, value: int | float) -> Column:
    if isinstance(dtype, INTEGRAL):
        # Within 2**53 whole-number comparison and double comparison agree.
        if isinstance(value, int) or abs(value) < 2**53:
            return _whole_number(c, operator, value)
        return _compare(c.cast("double"), operator, value)
    if isinstance(dtype, T.DecimalType) and isinstance(value, int) and abs(value) < 10**38:
        return _compare(c, operator, Decimal(value))
    return _compare(c, operator, _as_float(value))


def _text_test(text: Column, clause: Clause) -> Column:
    needle = str(clause.value)
    if not needle:
        return F.lit(True)
    # A null text matches no needle, so no coalesce: the plain test reaches the scan.
    return getattr(text, TEXT_TESTS[clause.operator])(needle)


def _typed(c: Column, dtype: T.DataType, clause: Clause) -> Column:
    if clause.operator in TEXT_TESTS:
        if isinstance(dtype, FLOATING):
            text = double_text(c)
        elif isinstance(dtype, NESTED):
            text = F.when(c.isNotNull(), json_text(c, dtype, sort_keys=False))
        else:
            text = c.cast("string")
        return _text_test(text, clause)
    value = clause.value
    if value is None or isinstance(dtype, T.NullType):
        return F.lit(False)
    if isinstance(dtype, T.StringType) and isinstance(value, str):
        return _compare(c, clause.operator, value)
    if isinstance(dtype, T.NumericType) and _is_number(value):
        return _typed_number(c, dtype, clause.operator, value)
    if isinstance(dtype, T.BooleanType) and isinstance(value, bool):
        return _compare(c, clause.operator, value)
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)) and isinstance(value, str):
        return _compare(c, clause.operator, _moment(value, dtype, clause))
    raise ValueError(
        f"Column '{clause.column}' has type {dtype.simpleString()} and cannot be compared with "
        f"{value!r} in typed mode; quote or unquote the value, or use mode='coerce'."
    )


def _moment(value: str, dtype: T.DataType, clause: Clause) -> Column:
    try:
        parsed = (
            date.fromisoformat(value)
            if isinstance(dtype, T.DateType)
            else datetime.fromisoformat(value)
        )
    except ValueError:
        raise ValueError(
            f"Column '{clause.column}' has type {dtype.simpleString()}; {value!r} is not an ISO "
            "date or time."
        ) from None
    return F.lit(str(parsed)).cast(dtype)


# --- coerce mode -----------------------------------------------------------------------


def _coerced(c: Column, dtype: T.DataType, clause: Clause) -> Column:
    if clause.operator in TEXT_TESTS:
        return _text_test(display_text(c, dtype), clause)
    if clause.operator in ("==", "!="):
        return _coerced_equality(c, dtype, clause.operator, clause.value)
    return _coerced_order(c, dtype, clause.operator, clause.value)


def _coerced_equality(c: Column, dtype: T.DataType, operator: str, value: Any) -> Column:
    equal = operator == "=="
    if value is None:
        return c.isNull() if equal else c.isNotNull()
    if isinstance(dtype, T.StringType) and isinstance(value, str):
        return c == value if equal else ~c.eqNullSafe(F.lit(value))
    if isinstance(dtype, (T.NumericType, T.BooleanType)) and not isinstance(value, str):
        same = _exact_number(c, dtype, operator, value)
        return same if equal else c.isNull() | same
    return F.lit(not equal)


def _coerced_order(c: Column, dtype: T.DataType, operator: str, value: Any) -> Column:
    if value is None:
        return F.lit(False)
    if isinstance(dtype, (T.NumericType, T.BooleanType)):
        if not isinstance(value, str):
            return _exact_number(c, dtype, operator, value)
        number = _python_float(value)
        if number is None:
            return F.lit(False)
        return _order_doubles(c.cast("int") if isinstance(dtype, T.BooleanType) else c, operator, number)
    if isinstance(dtype, T.StringType):
        return _order_text(c, operator, value)
    return F.lit(False)


def _exact_number(c: Column, dtype: T.DataType, operator: str, value: int | float | bool) -> Column:
    """Number against number without rounding either side; NaN satisfies only ``!=``."""
    if isinstance(value, bool):
        value = int(value)
    if isinstance(dtype, T.BooleanType):
        return _whole_number(c.cast("int"), operator, value)
    if isinstance(dtype, INTEGRAL):
        return _whole_number(c, operator, value)
    if isinstance(dtype, T.DecimalType):
        return _typed_number(c, dtype, operator, value)
    nearest = _as_float(value)
    if nearest != value:
        # An integer between two doubles: no double equals it.
        if operator in ("==", "!="):
            return F.lit(False) if operator == "==" else c.isNotNull()
        if operator in (">", ">="):
            operator = ">=" if nearest > value else ">"
        else:
            operator = "<" if nearest > value else "<="
    if operator in ("==", "!="):
        return _compare(c, operator, nearest)
    return _order_doubles(c, operator, nearest)


def _order_doubles(c: Column, operator: str, value: float) -> Column:
    if math.isnan(value):
        return F.lit(False)
    compared = _compare(c.cast("double"), operator, value)
    # Spark puts NaN above every number.
    return compared & ~F.isnan(c.cast("double")) if operator in (">", ">=") else compared


def _python_float(value: str) -> float | None:
    try:
        return float(value)
    except ValueError:
        return None


def text_number(c: Column) -> Column:
    """The number a text reads as, else null (also for the text nan)."""
    number = F.regexp_extract(F.replace(c, F.lit("_"), F.lit("")), _NUMBER, 1)
    grouped_well = ~c.contains("_") | ~F.regexp_like(c, F.lit(_STRAY_UNDERSCORE))
    return F.when((number != "") & grouped_well, number.try_cast("double")).when(
        F.regexp_like(c, F.lit(_INFINITE)),
        F.when(F.instr(c, "-") > 0, float("-inf")).otherwise(float("inf")),
    )


def _order_text(c: Column, operator: str, value: Any) -> Column:
    number = _python_float(value) if isinstance(value, str) else _as_float(value)
    as_text = _compare(c, operator, value) if isinstance(value, str) else F.lit(False)
    if number is None:
        return as_text
    own = text_number(c)
    as_number = F.lit(False) if math.isnan(number) else _compare(own, operator, number)
    return (
        F.when(own.isNotNull(), as_number)
        .when(F.regexp_like(c, F.lit(_NOT_A_NUMBER)), False)
        .otherwise(as_text)
    )
