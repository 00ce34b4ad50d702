"""Row identity: id, key fields, canonical JSON and content hash of a row."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from rowmark.functions.jsontext import display_text, object_text

POSITION = "_row_index"

#: Types whose JSON text needs no care.
_PLAIN = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType, T.StringType)

# Columns tried for the row id after the preferred one.
ID_COLUMNS = ("id", "row_id", "uuid")


def column(name: str) -> Column:
    """A top-level column by its exact name; dots in it are part of the name."""
    return F.col("`" + name.replace("`", "``") + "`")


def unused_name(df: DataFrame, name: str) -> str:
    """A working column name that differs from all columns of a frame, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def data_columns(df: DataFrame) -> list[str]:
    """The dataset's own columns, without the position column."""
    return [name for name in df.columns if name != POSITION]


def canonical_json(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """The row as JSON with sorted keys at every level and nulls kept."""
    names = data_columns(df) if columns is None else list(columns)
    return object_text([(n, column(n), df.schema[n].dataType) for n in names])


def row_hash(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(canonical_json(df, columns), 256))


def row_id(df: DataFrame, id_field: str | None = None) -> Column:
    """First non-null of the preferred field and the usual id columns, as text."""
    present = set(data_columns(df))
    names = [n for n in ([id_field] if id_field else []) + list(ID_COLUMNS) if n in present]
    if not names:
        return F.lit(None).cast("string")
    return F.coalesce(*(display_text(column(n), df.schema[n].dataType) for n in names))


def key_fields(df: DataFrame, fields: Iterable[str]) -> Column:
    """The requested fields that exist and are not null, as JSON in request order.

    Values are rendered as in the canonical JSON, so the text does not depend on the session.
    """
    present = set(data_columns(df))
    names = [n for n in dict.fromkeys(fields) if n in present]
    if not names:
        return F.lit("{}")
    if all(isinstance(df.schema[n].dataType, _PLAIN) for n in names):
        return F.to_json(F.struct(*(column(n) for n in names)), {"ignoreNullFields": "true"})
    members = []
    for n in names:
        whole = object_text([(n, column(n), df.schema[n].dataType)], sort_keys=False)
        members.append(F.when(column(n).isNotNull(), F.substring(whole, F.lit(2), F.length(whole) - 2)))
    return F.nullif(F.concat(F.lit("{"), F.concat_ws(",", *members), F.lit("}")), F.lit(""))


def row_records(
    df: DataFrame,
    id_field: str | None = None,
    key_columns: Iterable[str] = (),
    hash_columns: Sequence[str] | None = None,
) -> DataFrame:
    """Row records: position, id, key fields, hash and the row itself.

    Id, key fields and hash always come from the full row, so hiding columns later
    does not change them; `hash_columns` narrows the hash on request. Apply this after
    filtering and paging: the hash reads every column.
    """
    if POSITION not in df.columns:
        raise ValueError("Rows have no position yet: call with_row_index first.")
    names = data_columns(df)
    return df.select(
        column(POSITION).alias("row_index"),
        row_id(df, id_field).alias("row_id"),
        F.parse_json(key_fields(df, key_columns)).alias("key_fields"),
        row_hash(df, hash_columns).alias("row_hash"),
        F.to_variant_object(F.struct(*(column(n) for n in names))).alias("row_data"),
    )
