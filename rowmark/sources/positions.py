"""Stable 0-based row positions in source order, without sorting or numbering in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from rowmark.checkpoints import checkpoint_folder
from rowmark.functions.identity import POSITION, column, unused_name

_PIECES_PIN = "spark.sql.files.minPartitionNum"
#: Kept with frames, so that positions and pages can go back to the files. Frames made from them lack it.
_LATER, _SOURCE = "_rowmark_placed_later", "_rowmark_source"


def with_row_index(df: DataFrame) -> DataFrame:
    """Add the position column to a DataFrame read from files.

    Call it right after reading, before any filter: positions then survive filters and
    sorts. Files count in path order. Only the row count of each file (Parquet) or split
    (CSV, JSON) is brought together, once and right here; the rows are not shuffled while the
    offsets are small enough for a broadcast by Spark's size check.
    """
    later = getattr(df, _LATER, None)
    if later is not None:
        rows, place = later
        piece = {"_file": F.col(place)["file"], "_start": F.col(place)["start"]}
        setattr(rows, _LATER, later)
        return _placed(rows, piece, F.col(place)["record"].cast("long")).drop(place)
    known = df.select("_metadata").schema["_metadata"].dataType.fieldNames()
    if "row_index" not in known:
        return _indexed_splits(df)
    in_file = F.col("_metadata.row_index")
    if len(df.inputFiles()) <= 1:
        placed = df.select("*", in_file.alias(POSITION))
        setattr(placed, _SOURCE, (df, None))
        return placed
    return _placed(df, {"_file": F.col("_metadata.file_path")}, in_file)


def rows_at(placed: DataFrame, first: int, limit: int) -> DataFrame | None:
    """Rows at positions [first, first + limit) in order, read from the files that hold them alone.

    None if the frame is not just what `with_row_index` returned: rows may then be missing. The
    counts of rows per file that positions are made of tell the files, at most one for each row.
    """
    source = getattr(placed, _SOURCE, None)
    if source is None:
        return None
    df, offsets = source
    position = column(POSITION)
    if offsets is None:
        return placed.filter(position.between(first, first + limit - 1)).orderBy(position).limit(limit)
    meets = (F.col("_before") < first + limit) & (F.col("_before") + F.col("_rows") > first)
    names = ("_piece_file", "_before", "_first", "_rows")
    pieces = offsets.filter(meets).select(*names).orderBy("_before").limit(limit).collect()
    if not pieces:
        return placed.limit(0)
    read = df.filter(F.col("_metadata.file_path").isin(sorted({p["_piece_file"] for p in pieces})))
    if "row_index" in df.select("_metadata").schema["_metadata"].dataType.fieldNames():
        shifts = F.create_map(*(F.lit(x) for p in pieces for x in (p["_piece_file"], p["_before"] - p["_first"])))
        found = read.select("*", (F.col("_metadata.row_index") + shifts[F.col("_metadata.file_path")]).alias(POSITION))
    else:
        # Rows are numbered by split: count again, in these files alone, from their first row on.
        files = [p["_piece_file"] for p in pieces]
        base = offsets.filter(F.col("_piece_file") == files[0]).agg(F.min("_before")).first()[0]
        found = with_row_index(read)
        found = found.withColumn(POSITION, position + base)
    return found.select(*placed.columns).filter(position.between(first, first + limit - 1)).orderBy(position).limit(limit)


def placed_later(df: DataFrame, rows: DataFrame, place: str) -> DataFrame:
    """`df` as it is; `with_row_index` takes its positions from `rows`, the same rows with a column
    `place` (struct of file, start, record: the record's number within that range of the file)."""
    setattr(df, _LATER, (rows, place))
    return df


def _indexed_splits(df: DataFrame) -> DataFrame:
    """CSV and JSON know no row number, so rows are numbered within each scan split.

    `monotonically_increasing_id` counts rows of a task in order; the first id of a split
    turns it into a place within the split. Every later read of the files must be cut into
    the same splits, so the cut is pinned for the session, unless it is set already: left alone
    it follows the executor count.
    """
    pin_splits(df.sparkSession)
    split = {"_file": F.col("_metadata.file_path"), "_start": F.col("_metadata.file_block_start")}
    return _placed(df, split, F.monotonically_increasing_id())


def _placed(df: DataFrame, piece: dict[str, Column], number: Column) -> DataFrame:
    """Positions from a row number that counts on within each piece of the source.

    Pieces count in the order of their folder, then of the number in a part file's name, then of
    the name. Spark broadcasts the offsets if they are small enough by its own size check.
    """
    names = {name: unused_name(df, name) for name in piece}
    row, shift = unused_name(df, "_number"), unused_name(df, "_shift")
    placed = df.select("*", *(c.alias(names[n]) for n, c in piece.items()), number.alias(row))
    keys = list(names.values())
    pieces = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), F.min(row).alias("_first"))
    file = F.col(names["_file"])
    part = F.regexp_extract(file, r"/part-(\d+)[^/]*$", 1).try_cast("bigint")
    order = [F.regexp_replace(file, r"[^/]*$", ""), part, *keys]
    rows_before = F.sum("_rows").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    # One short row per piece, counted once and kept.
    checkpoint_folder(df.sparkSession)
    before = F.coalesce(rows_before, F.lit(0)).alias("_before")
    counted = pieces.select(*keys, file.alias("_piece_file"), before, "_first", "_rows").checkpoint()
    offsets = counted.select(*keys, (F.col("_before") - F.col("_first")).alias(shift))
    indexed = placed.join(offsets, keys).withColumn(POSITION, F.col(shift) + F.col(row)).drop(*keys, row, shift)
    if not hasattr(df, _LATER):
        setattr(indexed, _SOURCE, (df, counted))
    return indexed


def pin_splits(spark: SparkSession) -> None:
    if spark.conf.get(_PIECES_PIN, None) is None:
        spark.conf.set(_PIECES_PIN, str(spark.sparkContext.defaultParallelism))
