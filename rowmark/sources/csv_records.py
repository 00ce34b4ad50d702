"""Records of CSV files whose quoted values span lines, read from any range of a file.

A range of a file does not know whether its first line lies inside a quoted value. But each line
maps the state before it (outside or inside a value) to the state behind it, and such maps can be
composed: a narrow pass composes them over each range, a running composition over the ranges of a
file then fixes the state in which each range begins. With that, every range finds its own
records; one that is cut by a border is put together from its pieces.

Records are stored once, as text in Parquet, so that later reads parse them without finding their
borders again. Line breaks within values become `\\n`; blank lines between records are skipped.
"""

from __future__ import annotations

import csv
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from rowmark.checkpoints import checkpoint_folder, shared_folder
from rowmark.functions.identity import column

#: Where a record begins: file, first byte of its range, number within the range (from 1).
PIECE = ("file", "start")
_PLACE = (*PIECE, "record")


def _state_behind(line: Column, inside: bool) -> Column:
    """Whether a line that begins inside (or outside) a quoted value ends inside one.

    Every quote is judged by the text between it and the one before: it closes the value it lies
    in, opens one at the start of a field, or directly behind a closing quote stands for a quote.
    Anywhere else it is an ordinary character.
    """
    outside, within, closed, line_start = 0, 1, 2, 3

    def quote(state: Column, before: Column) -> Column:
        opens = F.endswith(before, F.lit(",")) | ((before == "") & state.isin(closed, line_start))
        return F.when(state == within, F.lit(closed)).when(opens, F.lit(within)).otherwise(F.lit(outside))

    parts = F.split(line, '"', -1)
    before_quotes = F.slice(parts, F.lit(1), F.size(parts) - 1)
    end = F.aggregate(before_quotes, F.lit(within if inside else line_start), quote)
    return F.when(F.contains(line, F.lit('"')), end == within).otherwise(F.lit(inside))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("line"), F.col("value"),
    )
    return lines.withColumn("from_out", _state_behind(F.col("value"), False)).withColumn("from_in", _state_behind(F.col("value"), True))


def _composed(of: Column, begins: Column, window) -> Column:
    """The state behind the rows of a window, each mapping `from_out` / `from_in`, from state `begins`.

    Only the last row that leads to one state from both, and the number of swaps behind it, count.
    """
    swaps = F.count_if(F.col("from_out") & ~F.col("from_in")).over(window)
    settles = F.when(F.col("from_out") == F.col("from_in"), F.struct(F.col("from_out").alias("state"), of.alias("swaps")))
    settled = F.last(settles, ignorenulls=True).over(window)
    swapped = (swaps - F.coalesce(settled["swaps"], F.lit(0))) % 2 == 1
    return F.coalesce(settled["state"], begins) != swapped


def _swaps_until_here(by: list[str], order: str) -> Column:
    until = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return F.count_if(F.col("from_out") & ~F.col("from_in")).over(until)


def range_states(lines: DataFrame) -> DataFrame:
    """file, start, inside: whether a range begins inside a value. Ranges that begin outside because
    no line before them changes the state may be missing."""
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*PIECE).orderBy("line").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    changing = lines.where("from_out OR NOT from_in").select(*PIECE, "line", "from_out", "from_in")
    counted = changing.withColumn("swaps", _swaps_until_here([*PIECE], "line"))
    ends = [_composed(F.col("swaps"), F.lit(inside), whole).alias(name) for inside, name in ((False, "from_out"), (True, "from_in"))]
    maps = counted.select(*PIECE, *ends).distinct()
    all_ranges = lines.select(*PIECE).distinct().join(maps, list(PIECE), "left").select(
        *PIECE, F.coalesce("from_out", F.lit(False)).alias("from_out"), F.coalesce("from_in", F.lit(True)).alias("from_in")
    )
    placed = all_ranges.withColumn("swaps", _swaps_until_here(["file"], "start"))
    return placed.select(*PIECE, _composed(F.col("swaps"), F.lit(False), before).alias("inside"))


def _records(lines: DataFrame, states: DataFrame) -> DataFrame:
    """file, start, record, text, open: pieces of records by range. Record 0 goes on from an earlier
    range, an open one goes on in a later range."""
    before = Window.partitionBy(*PIECE).orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    until = Window.partitionBy(*PIECE).orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = lines.join(states, list(PIECE)).withColumn("swaps", _swaps_until_here([*PIECE], "line"))
    stated = known.withColumn("within", _composed(F.col("swaps"), F.col("inside"), before))
    told = stated.where(F.col("within") | F.col("value").rlike(r"[^\x00-\x20]")).withColumn("record", F.count_if(~F.col("within")).over(until))
    behind = F.when(F.col("within"), F.col("from_in")).otherwise(F.col("from_out"))
    return told.groupBy(*_PLACE).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "value"))), lambda x: x["value"]), "\n").alias("text"),
        F.max_by(behind, "line").alias("open"),
    )


def _stitched(stored: DataFrame) -> DataFrame:
    """Records that cross a border of ranges, placed where they begin.

    Only pieces at borders are read: at most two of each range.
    """
    pieces = stored.where("open OR record = 0")
    # A record begins with a piece that is open and not a continuation; pieces follow in order.
    begins = F.when(F.col("record") > 0, F.struct("start", "record"))
    order = Window.partitionBy("file").orderBy("start", "record").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    owned = pieces.withColumn("owner", F.last(begins, ignorenulls=True).over(order))
    texts = F.array_sort(F.collect_list(F.struct("start", "record", "text")))
    whole = owned.groupBy("file", "owner").agg(F.array_join(F.transform(texts, lambda x: x["text"]), "\n").alias("text"))
    return whole.select("file", "owner.start", "owner.record", "text")


@dataclass(frozen=True)
class CsvRecords:
    """Stored records (file, start, record, text), headers left out, and the names in the headers."""

    table: DataFrame
    names: list[str]

    def parsed(self, schema: T.StructType, options: dict[str, str]) -> DataFrame:
        """The records' values and their places (struct `_place` of file, start, record)."""
        values = F.from_csv("text", F.lit(_ddl(schema)), options)
        rows = self.table.select(F.struct(*_PLACE).alias("place"), values.alias("row"))
        return rows.select(F.col("place"), *(F.col("row")[f.name].alias(f.name) for f in schema))


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema)


def csv_records(spark: SparkSession, path: str) -> CsvRecords:
    """Find and store the records of CSV files with a header line each."""
    lines = _lines(spark, path)
    checkpoint_folder(spark)
    states = range_states(lines).checkpoint()  # one short row per range
    folder = shared_folder(spark)
    _records(lines, states).write.option("compression", "zstd").parquet(folder)
    stored = spark.read.parquet(folder)
    joined = shared_folder(spark)
    _stitched(stored).write.parquet(joined)
    records = stored.where("record > 0 AND NOT open").select(*_PLACE, "text").unionByName(spark.read.parquet(joined))
    header = (F.col("start") == 0) & (F.col("record") == 1)
    headers = [row.text for row in records.where(header).select("text").distinct().limit(2).collect()]
    names = [next(csv.reader([text], doublequote=True)) for text in headers]
    if len(names) > 1 and any(n != names[0] for n in names):
        raise ValueError(f"The CSV files at {path} differ in their header: {names[0]} and {names[1]}.")
    return CsvRecords(records.where(~header), names[0] if names else [])


def inferred_types(spark: SparkSession, records: CsvRecords, options: dict[str, str]) -> T.StructType:
    """Types found in a pass over the stored records, under the names of the header."""
    reader = spark._jsparkSession.read()
    for name, value in {**options, "header": "false", "inferSchema": "true"}.items():
        reader = reader.option(name, value)
    texts = getattr(records.table.select(column("text"))._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
    found = T.StructType.fromJson(json.loads(reader.csv(texts).schema().json()))
    types = [f.dataType for f in found] + [T.StringType()] * len(records.names)
    return T.StructType([T.StructField(n, t) for n, t in zip(records.names, types)])
