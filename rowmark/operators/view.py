"""Projection, sort, paging and samples of a dataset with row positions."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F, types as T

from rowmark.checkpoints import shared_folder
from rowmark.functions.identity import POSITION, column, data_columns, unused_name
from rowmark.functions.jsontext import json_text
from rowmark.operators.sizes import BROADCAST_ROWS
from rowmark.sources.positions import rows_at

# Rows on a page and in a sample.
PAGE_SIZE = 200
SAMPLE_SIZE = 5

VIEW_RANK = "_view_rank"

#: Pages from here on are narrowed by counting; pivots of a round, and rows sampled for them.
DEEP_OFFSET = 10_000
PIVOTS, SAMPLED = 64, 1024


def select_visible(
    df: DataFrame, names: Sequence[str] | None, source_order: bool = False
) -> DataFrame:
    """Keep the listed columns, as listed or in source order; unknown names are ignored.

    If no listed name exists, all columns stay. The position column always stays.
    """
    present = data_columns(df)
    kept = [n for n in dict.fromkeys(names or present) if n in present] or present
    if source_order:
        kept = [n for n in present if n in kept]
    hidden = [POSITION] if POSITION in df.columns else []
    return df.select(*(column(n) for n in hidden + kept))


def hide(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Drop columns one after the other; the last visible column stays."""
    visible = data_columns(df)
    for name in names:
        if name not in data_columns(df):
            raise ValueError(f"Unknown column: {name}")
        if name in visible and len(visible) > 1:
            visible.remove(name)
    return select_visible(df, visible, source_order=True)


def _sort_key(df: DataFrame, name: str) -> Column:
    dtype = df.schema[name].dataType
    if isinstance(dtype, (T.VariantType, T.StructType, T.MapType)):
        return F.when(column(name).isNotNull(), json_text(column(name), dtype))
    return column(name)


def view_order(df: DataFrame, sort: str | None = None, descending: bool = False) -> list[Column]:
    """Sort columns of a view: nulls last either way, ties and unsorted views by position."""
    order = [column(POSITION).asc()] if POSITION in df.columns else []
    if sort is None or sort not in data_columns(df):
        return order
    key = _sort_key(df, sort)
    return [key.desc_nulls_last() if descending else key.asc_nulls_last(), *order]


def sort_rows(df: DataFrame, sort: str | None = None, descending: bool = False) -> DataFrame:
    """Sort by one column; an unknown column leaves source order."""
    order = view_order(df, sort, descending)
    return df.orderBy(*order) if order else df


def page(
    df: DataFrame,
    offset: int = 0,
    limit: int = PAGE_SIZE,
    sort: str | None = None,
    descending: bool = False,
) -> DataFrame:
    """Rows [offset, offset + limit) of the view.

    In source order, a frame just as `with_row_index` returned it gives its page from the files
    that hold those positions. Any other page is found by a top-k over sort column and position
    alone; only its rows are then read whole. From DEEP_OFFSET on the view is first narrowed to
    rows from shortly before the page on, by counting (see `deep_start`), so the top-k does not
    grow with the offset.
    """
    if limit <= 0:
        return df.limit(0)
    first = max(offset, 0)
    if POSITION not in df.columns:
        return sort_rows(df, sort, descending).offset(first).limit(limit)
    if sort not in data_columns(df):
        sort = None
    if sort is None and (held := rows_at(df, first, limit)) is not None:
        return held
    wanted = unused_name(df, "_wanted")
    narrow = df.select(column(POSITION), *([column(sort)] if sort is not None else []))
    if first >= DEEP_OFFSET:
        narrow, first = deep_start(narrow, first, max(limit, PAGE_SIZE), sort, descending)
    places = sort_rows(narrow, sort, descending).offset(first).limit(limit).select(column(POSITION).alias(wanted))
    if limit <= BROADCAST_ROWS:
        places = F.broadcast(places)  # one number per row of the page
    shown = df.join(places, column(POSITION) == F.col(wanted), "left_semi")
    return sort_rows(shown, sort, descending).limit(limit)


def _not_before(df: DataFrame, sort: str | None, descending: bool, value: Any, position: int) -> Column:
    """Whether a row is the one with this sort value and position, or comes after it in the view."""
    later = column(POSITION) >= position
    if sort is None:
        return later
    key = _sort_key(df, sort)
    if value is None:
        return key.isNull() & later
    at = F.lit(value).cast(df.select(key).schema[0].dataType)
    further = key < at if descending else key > at
    return F.coalesce(further | ((key == at) & later), F.lit(True))  # nulls come last


def deep_start(
    narrow: DataFrame, offset: int, near: int, sort: str | None = None, descending: bool = False
) -> tuple[DataFrame, int]:
    """The rows of a view from a row on that lies less than `near` rows before `offset`, if there
    is such a pivot, and how many of them come before `offset`.

    Rank selection without a sort: a sample of the range at hand (the rows with the smallest
    hashes of their positions) gives some pivots, one pass counts the rows before each of them,
    and the range between the two pivots around the offset is the next one. Every round divides
    the range by about PIVOTS; nothing is shuffled but counts and the sample.
    """
    before, start, end, round_ = 0, None, None, 0
    while offset - before >= near:
        here = narrow if start is None else narrow.filter(start)
        here = here if end is None else here.filter(~end)
        drawn = here.orderBy(F.xxhash64(F.lit(round_), column(POSITION))).limit(SAMPLED)
        key = _sort_key(narrow, sort) if sort is not None else F.lit(None)
        sample = sort_rows(drawn, sort, descending).select(key.alias("key"), column(POSITION).alias("place")).collect()
        if start is None and len(sample) < SAMPLED:
            break  # the whole view is hardly more than a page
        values = [(r.key, r.place) for r in sample[:: max(1, len(sample) // PIVOTS)]]
        tests = [_not_before(narrow, sort, descending, *v) for v in values]
        counts = here.agg(*(F.count_if(~test).alias(f"n{i}") for i, test in enumerate(tests))).first() if tests else []
        fitting = [i for i, n in enumerate(counts) if before + n <= offset]
        if not fitting or not counts[fitting[-1]]:
            break  # no pivot lies between the start of the range and the offset
        start, end = tests[fitting[-1]], tests[fitting[-1] + 1] if fitting[-1] + 1 < len(tests) else end
        before, round_ = before + counts[fitting[-1]], round_ + 1
    return (narrow if start is None else narrow.filter(start)), offset - before


def page_after(
    df: DataFrame,
    last_position: int,
    limit: int = PAGE_SIZE,
    sort: str | None = None,
    descending: bool = False,
    last_value: Any = None,
) -> DataFrame:
    """The page that follows the row at `last_position` (with sort value `last_value`)."""
    known = sort if sort is not None and sort in data_columns(df) else None
    behind = _not_before(df, known, descending, last_value, last_position + 1)
    return page(df.filter(behind), 0, limit, sort, descending)


def page_start(position: int, rows: int, size: int = PAGE_SIZE) -> int:
    """First row of the page that holds `position`, after clamping it to the view."""
    return min(max(position, 0), max(rows - 1, 0)) // size * size


def page_at(
    df: DataFrame,
    position: int,
    size: int = PAGE_SIZE,
    sort: str | None = None,
    descending: bool = False,
) -> DataFrame:
    """The page that holds place `position` of the view; counts the rows first."""
    return page(df, page_start(position, df.count(), size), size, sort, descending)


@dataclass(frozen=True)
class RankedView:
    """A view stored in its order, so that a page at any depth is a range filter.

    The column `order` rises along the view; `starts` has, for each stored part, its first
    value, the rows before it and its own rows: one entry per partition of the sort.
    """

    table: DataFrame
    starts: tuple[tuple[int, int, int], ...]
    order: str

    def count(self) -> int:
        return sum(rows for _, _, rows in self.starts)

    def page(self, offset: int = 0, limit: int = PAGE_SIZE) -> DataFrame:
        """Rows [offset, offset + limit); the range of ids is pushed down to the stored parts."""
        first, end = max(offset, 0), max(offset, 0) + limit
        ranges = [
            column(self.order).between(
                start + max(first - before, 0), start + min(end - before, rows) - 1
            )
            for start, before, rows in self.starts
            if before < end and first < before + rows
        ]
        kept = self.table.filter(reduce(or_, ranges) if ranges else F.lit(False))
        return kept.orderBy(column(self.order)).drop(self.order)

    def page_at(self, position: int, size: int = PAGE_SIZE) -> DataFrame:
        """The page that holds place `position`."""
        return self.page(page_start(position, self.count(), size), size)

    def with_rank(self) -> DataFrame:
        """All rows with their place in the view."""
        part, shift = unused_name(self.table, "_part"), unused_name(self.table, "_shift")
        shifts = [(start >> 33, before - start) for start, before, _ in self.starts]
        parts = self.table.sparkSession.createDataFrame(shifts, f"{part} BIGINT, {shift} BIGINT")
        return (
            self.table.withColumn(part, F.shiftright(self.order, 33))
            .join(parts, part)
            .withColumn(VIEW_RANK, column(self.order) + F.col(shift))
            .drop(part, self.order, shift)
        )


def ranked_view(
    df: DataFrame, sort: str | None = None, descending: bool = False, folder: str | None = None
) -> RankedView:
    """Sort a view once and store it as Parquet, in the shared folder unless told otherwise.

    A distributed sort on (column, position) spreads even a value that fills a third of
    the table. Select the columns to show before calling this.
    """
    spark = df.sparkSession
    folder = folder or shared_folder(spark)
    ordered = sort_rows(df, sort, descending)
    place = unused_name(df, "_place_in_view")
    ordered.withColumn(place, F.monotonically_increasing_id()).write.parquet(folder)
    table = spark.read.parquet(folder)
    # Ids count on within a partition of the sort and jump to the next multiple of 2**33.
    counts = table.groupBy(F.shiftright(place, 33).alias("part")).count().collect()
    starts, before = [], 0
    for part, rows in sorted((row["part"], row["count"]) for row in counts):
        starts.append((part << 33, before, rows))
        before += rows
    return RankedView(table, tuple(starts), place)


def sample_rows(df: DataFrame, n: int = SAMPLE_SIZE) -> DataFrame:
    """First n rows in source order."""
    return page(df, 0, n)
