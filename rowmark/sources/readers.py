"""Read CSV, JSON-lines and published dataset splits as DataFrames."""

from __future__ import annotations

import json
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from rowmark.functions.identity import column, data_columns, row_records, unused_name
from rowmark.functions.text import trimmed
from rowmark.operators.view import SAMPLE_SIZE, sample_rows
from rowmark.sources.csv_records import csv_records, inferred_types
from rowmark.sources.files import exists, glob
from rowmark.sources.positions import pin_splits, placed_later

# Accepted source type names.
SOURCE_TYPES = {
    "csv": "csv",
    "jsonl": "jsonl",
    "ndjson": "jsonl",
    "hf": "hf",
    "huggingface": "hf",
    "datasets": "hf",
}
SUFFIXES = {".csv": "csv", ".jsonl": "jsonl", ".ndjson": "jsonl"}

# Stands for "no value" in CSV so that a quoted empty string stays an empty string.
_NO_VALUE = "\u0001no value\u0001"


def source_type(spark: SparkSession, source: str, declared: str | None = None) -> str:
    """Which reader a source goes to.

    A declared type counts; of other sources, files and folders go by their suffix and
    everything that is not found on storage is the name of a published dataset.
    """
    if declared is not None:
        name = declared.strip().lower()
        if name in SOURCE_TYPES:
            return SOURCE_TYPES[name]
        raise ValueError(f"There is no reader called {declared!r}; there are {', '.join(SOURCE_TYPES)}.")
    named = source.startswith("hf:")
    if named or not exists(spark, source):
        return "hf"
    for suffix, kind in SUFFIXES.items():
        if source.lower().endswith(suffix):
            return kind
    raise ValueError(f"The suffix {PurePosixPath(source).suffix!r} does not tell the format of {source}: pass its type.")


def read_dataset(
    spark: SparkSession,
    source: str,
    type: str | None = None,
    config: str | None = None,
    split: str | None = None,
    schema: T.StructType | str | None = None,
    root: str | None = None,
) -> DataFrame:
    """Read a dataset by declared or inferred type; see the three readers below."""
    kind = source_type(spark, source, type)
    if kind == "csv":
        return read_csv(spark, source, schema)
    if kind == "jsonl":
        return read_jsonl(spark, source, schema)
    return read_split(spark, source.removeprefix("hf:"), config, split or "train", root)


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    multiline: bool | None = None,
) -> DataFrame:
    """CSV with a header row.

    Inferred types are text, bigint, double and boolean; dates stay text. Inference is a
    pass of its own over the files, so pass `schema` for large data. Where quoted values span
    lines, the records are found in ranges of the files and stored once (see `csv_records`), so
    that a single file is read by many tasks too; left open, `multiline` is found out by a pass
    over the lines.
    """
    if multiline is None:
        multiline = _values_span_lines(spark, path)
    options = {"escape": '"', "nullValue": _NO_VALUE, "mode": "FAILFAST"}
    if multiline:
        return _read_spanning(spark, path, schema, options)
    reader = spark.read.option("header", True).options(**options)
    if schema is None:
        schema = _narrowed(reader.option("inferSchema", True).option("prefersDate", True).csv(path).schema)
    # A header that differs from the schema is an error, not a silent shift of columns.
    return (
        reader.option("inferSchema", False).option("enforceSchema", False).schema(schema).csv(path)
    )


def _read_spanning(
    spark: SparkSession, path: str, schema: T.StructType | str | None, options: dict[str, str]
) -> DataFrame:
    pin_splits(spark)
    records = csv_records(spark, path)
    if schema is None:
        schema = _narrowed(inferred_types(spark, records, {**options, "prefersDate": "true"}))
    elif isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    if records.names and [n.lower() for n in records.names] != [n.lower() for n in schema.fieldNames()]:
        raise ValueError(f"The header of {path} has {records.names}, the schema {schema.fieldNames()}.")
    rows = records.parsed(schema, options)
    place = unused_name(rows.drop("place"), "_place")
    names = [column(n) for n in schema.fieldNames()]
    return placed_later(rows.select(*names), rows.select(*names, F.col("place").alias(place)), place)


def _narrowed(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, _csv_type(f.dataType)) for f in schema])


def _values_span_lines(spark: SparkSession, path: str) -> bool:
    """Whether a value may go on in the next line: its first line then has an unpaired quote."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return not spark.read.text(path).filter(quotes % 2 == 1).limit(1).isEmpty()


def _csv_type(dtype: T.DataType) -> T.DataType:
    if isinstance(dtype, (T.IntegerType, T.LongType)):
        return T.LongType()
    if isinstance(dtype, (T.DoubleType, T.BooleanType)):
        return dtype
    return T.StringType()


def read_jsonl(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None
) -> DataFrame:
    """JSON lines; nested values keep their structure, a malformed line fails the read.

    Inference reads all lines (pass `schema` for large data). Columns come in the order in
    which the lines of all files, in path order, name them first.
    """
    reader = spark.read.option("mode", "FAILFAST")
    if schema is not None:
        return reader.schema(schema).json(path)
    df = reader.json(path)
    names = _names_in_order(spark, path)
    return df.select(*(column(n) for n in names if n in df.columns))


def _names_in_order(spark: SparkSession, path: str) -> list[str]:
    """All keys of the lines, as the files in path order name them first.

    Lines with the same keys in the same order are one row before anything is compared.
    """
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id())
    layouts = (
        spark.read.text(path)
        .filter(trimmed(F.col("value")) != "")
        .select(F.json_object_keys("value").alias("names"), place.alias("place"))
        .groupBy("names")
        .agg(F.min("place").alias("place"))
    )
    keys = layouts.select("place", F.posexplode("names").alias("pos", "name"))
    first = keys.groupBy("name").agg(F.min(F.struct("place", "pos")).alias("first"))
    return [row["name"] for row in first.orderBy("first").select("name").collect()]


def read_split(
    spark: SparkSession,
    dataset: str,
    config: str | None = None,
    split: str = "train",
    root: str | None = None,
) -> DataFrame:
    """One split of a published dataset kept as Parquet shards under `root`/`dataset`.

    Shards are `split.parquet`, `split-*.parquet` or `split/*.parquet`, in the config's
    folder if one is given, else in the dataset folder or its `data` folder.
    """
    base = f"{root.rstrip('/')}/{dataset}" if root else dataset
    folders = [f"{base}/{config}"] if config else [base, f"{base}/data"]
    for folder in folders:
        shards = [
            path
            for pattern in (f"{split}.parquet", f"{split}-*.parquet", f"{split}/*.parquet")
            for path in glob(spark, f"{folder}/{pattern}")
        ]
        if shards:
            return spark.read.parquet(*shards)
    raise ValueError(f"No Parquet shards for split '{split}' of dataset '{base}'.")


def schema_listing(df: DataFrame) -> DataFrame:
    """One row per column: place, name, type text. The position column is hidden."""
    rows = [
        (place, name, df.schema[name].dataType.simpleString())
        for place, name in enumerate(data_columns(df))
    ]
    return df.sparkSession.createDataFrame(rows, "place INT, name STRING, dtype STRING")


def dataset_meta(
    df: DataFrame,
    source_type: str,
    source_uri: str,
    fingerprint: DataFrame,
    split: str | None = None,
    row_id_field: str | None = None,
    key_fields: tuple[str, ...] = (),
) -> DataFrame:
    """One row that describes the dataset; `fingerprint` is a one-row frame of that name."""
    return df.agg(F.count(F.lit(1)).alias("row_count")).select(
        F.lit(source_type).alias("source_type"),
        F.lit(source_uri).alias("source_uri"),
        F.lit(split).cast("string").alias("split"),
        fingerprint.select("fingerprint").scalar().alias("fingerprint"),
        "row_count",
        F.lit(row_id_field).cast("string").alias("row_id_field"),
        F.lit(json.dumps(list(key_fields))).alias("key_fields"),
    )


def inspect(
    df: DataFrame,
    meta: DataFrame,
    n: int = SAMPLE_SIZE,
    id_field: str | None = None,
    key_fields: tuple[str, ...] = (),
) -> dict[str, DataFrame]:
    """A dataset at a glance: its meta row, its columns, and records of its first rows."""
    return {
        "meta": meta,
        "schema": schema_listing(df),
        "sample_rows": row_records(sample_rows(df, n), id_field, key_fields),
    }
