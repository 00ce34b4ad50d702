"""Short text functions: cell preview, full cell text, slug, label key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rowmark.functions.identity import column
from rowmark.functions.jsontext import NESTED, display_text, json_text

PREVIEW_LENGTH = 120

# The white space removed around labels and facet values.
BLANKS = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def lowered(c: Column) -> Column:
    """Text as facets compare it: lower case, without surrounding blanks."""
    return F.lower(trimmed(c))


def label_key(c: Column) -> Column:
    """Labels that differ only in case or surrounding blanks share this key.

    Lower, upper and again lower case bring together what full case folding does (`Straße`,
    `STRASSE`), but for the dotless i, which folds to itself and is kept apart.
    """
    # The replacements stand between the conversions, which would be reduced to the outermost otherwise.
    dotless, mark = F.lit("\u0131"), F.lit("\uffff")
    upper = F.upper(F.replace(F.lower(trimmed(c)), dotless, mark))
    return F.lower(F.replace(upper, mark, dotless))


def cell_preview(df: DataFrame, name: str, length: int = PREVIEW_LENGTH) -> Column:
    """One-line cell: empty for null, JSON for nested values, cut with `...` when long."""
    text = F.coalesce(display_text(column(name), df.schema[name].dataType), F.lit(""))
    cut = F.concat(F.substr(text, F.lit(1), F.lit(length - 3)), F.lit("..."))
    return F.when(F.length(text) > length, cut).otherwise(text)


def cell_text(df: DataFrame, name: str) -> Column:
    """Full cell: the word null for null, indented JSON for nested values, else the text."""
    dtype = df.schema[name].dataType
    if isinstance(dtype, NESTED):
        return json_text(column(name), dtype, indent=2)
    return F.coalesce(display_text(column(name), dtype), F.lit("null"))


def slugify(c: Column) -> Column:
    """Lower-case words joined by underscores; `dataset` when nothing is left."""
    words = F.regexp_replace(c, "[^a-zA-Z0-9]+", "_")
    return F.coalesce(F.nullif(F.lower(F.btrim(words, F.lit("_"))), F.lit("")), F.lit("dataset"))
