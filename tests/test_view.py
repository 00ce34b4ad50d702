import random
import re

import pytest
from conftest import values
from pyspark.sql import functions as F

import rowmark as rm
from rowmark.operators import view
from rowmark.operators.view import VIEW_RANK, page_start


@pytest.fixture
def rows(make):
    return make([(3, "c"), (None, "a"), (1, "b"), (3, "a"), (None, "c"), (2, "b")], "n BIGINT, s STRING")


def order(df):
    return values(df, rm.POSITION)


def test_visible_columns(rows):
    assert rm.select_visible(rows, ["s", "gone", "n", "s"]).columns == [rm.POSITION, "s", "n"]
    assert rm.select_visible(rows, ["s", "n"], source_order=True).columns == [rm.POSITION, "n", "s"]
    assert rm.select_visible(rows, ["gone"]).columns == rm.select_visible(rows, None).columns == rows.columns


def test_hide(rows):
    assert rm.hide(rows, ["n"]).columns == [rm.POSITION, "s"]
    assert rm.hide(rows, ["n", "n", "s"]).columns == [rm.POSITION, "s"]
    with pytest.raises(ValueError, match="Unknown column: N"):
        rm.hide(rows, ["N"])


def test_nulls_last_both_ways_and_ties_in_source_order(rows):
    assert order(rm.sort_rows(rows, "n")) == [2, 5, 0, 3, 1, 4]
    assert order(rm.sort_rows(rows, "n", descending=True)) == [0, 3, 5, 2, 1, 4]
    assert order(rm.sort_rows(rows, "gone")) == order(rm.sort_rows(rows)) == [0, 1, 2, 3, 4, 5]


def test_sort_by_nested_value_uses_its_text(rows):
    df = rows.select(rm.POSITION, F.to_variant_object(F.struct("s", "n")).alias("v"))
    # {"n":1,..} < {"n":2,..} < {"n":3,"s":"a"} < {"n":3,"s":"c"} < {"n":null,..}
    assert order(rm.sort_rows(df, "v")) == [2, 5, 3, 0, 1, 4]


def test_pages(rows):
    assert order(rm.page(rows, 1, 3, "n")) == [5, 0, 3]
    assert order(rm.page(rows, -5, 2)) == [0, 1]
    assert order(rm.page(rows, 4, 10)) == [4, 5]
    assert order(rm.page(rows, 99, 10)) == order(rm.page(rows, 0, 0)) == order(rm.page(rows, 0, -1)) == []
    assert order(rm.sample_rows(rows)) == [0, 1, 2, 3, 4] and order(rm.sample_rows(rows, -2)) == []


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("sort", ["n", None])
def test_following_pages_cover_the_view_once(rows, sort, descending):
    whole = rm.sort_rows(rows, sort, descending).collect()
    seen = rm.page(rows, 0, 1, sort, descending).collect()
    while step := rm.page_after(
        rows, seen[-1][rm.POSITION], 2, sort, descending, seen[-1][sort] if sort else None
    ).collect():
        seen += step
    assert seen == whole


def test_page_start():
    assert [page_start(p, 450) for p in (-3, 0, 199, 200, 449, 450, 9999)] == [0, 0, 0, 200, 400, 400, 400]
    assert page_start(7, 0) == 0 and page_start(7, 10, 3) == 6


@pytest.mark.parametrize("descending", [False, True])
def test_ranked_view(spark, descending):
    """A third of the rows share one sort value, another part has none."""
    df = spark.range(0, 5000, 1, 7).select(
        F.col("id").alias(rm.POSITION),
        F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 3 == 1, F.col("id") % 100).alias("v"),
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranked = rm.ranked_view(df, "v", descending)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    expected = order(rm.sort_rows(df, "v", descending))
    placed = ranked.with_rank().orderBy(VIEW_RANK)
    assert order(placed) == expected and values(placed, VIEW_RANK) == list(range(5000))
    assert ranked.count() == 5000 and len(ranked.starts) > 1
    assert order(ranked.page_at(1234, 100)) == expected[1200:1300]
    assert order(rm.page_at(df, 1234, 100, "v", descending)) == expected[1200:1300]
    for offset, limit in ((0, 5000), (1000, 3000), (4990, 50), (5000, 10), (10, 0), (0, -3)):
        assert order(ranked.page(offset, limit)) == expected[offset : offset + max(limit, 0)]
    plan = ranked.page_at(4321, 10).select("v")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(_place_in_view" in plan and "Join" not in plan
    nothing = rm.ranked_view(df.filter("v < 0"), "v")
    assert nothing.count() == nothing.page_at(5).count() == nothing.with_rank().count() == 0
    assert order(rm.page_at(df.filter("v < 0"), 5)) == []


@pytest.mark.parametrize("offset", [0, 200, 150_000])
def test_pages_choose_their_rows_by_a_narrow_top(rows, offset):
    plan = rm.page(rows, offset, 200, "n")._jdf.queryExecution().executedPlan().toString()
    top = [line for line in plan.splitlines() if "TakeOrderedAndProject" in line][-1]
    assert f"limit={offset + 200}" in top and ",s#" not in top and "LeftSemi" in plan


def test_hash_is_taken_after_paging(rows):
    plan = rm.row_records(rm.page(rows, 0, 5, "n"))._jdf.queryExecution().executedPlan().toString()
    above, below = plan.split("LeftSemi", 1)
    assert "row_hash" in above and "sha2(" not in below


def test_deep_pages_equal_those_of_a_stored_view(spark):
    df = spark.range(0, 120_000, 1, 5).select(
        F.col("id").alias(rm.POSITION), (F.col("id") % 7).alias("v"), F.col("id").alias("_id"), F.lit("f").alias("_file")
    )
    page = rm.page(df, 101_000, 50, "v", True)
    assert page.columns == df.columns
    assert page.collect() == rm.ranked_view(df, "v", True).page(101_000, 50).collect()


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("sort", ["n", "s", "v", "x", None])
def test_deep_pages(spark, monkeypatch, sort, descending):
    monkeypatch.setattr(view, "DEEP_OFFSET", 10)
    monkeypatch.setattr(view, "PAGE_SIZE", 4)
    monkeypatch.setattr(view, "PIVOTS", 5)
    monkeypatch.setattr(view, "SAMPLED", 40)
    rng = random.Random(5)
    data = [
        (i, rng.choice([None, 1, 1, 1, 2, rng.randrange(50)]), rng.choice(["a", "b", "é", None]), rng.choice([float("nan"), 0.5, -1e9, None]))
        for i in range(700)
    ]
    df = spark.createDataFrame(data, f"{rm.POSITION} BIGINT, n BIGINT, s STRING, x DOUBLE").repartition(3)
    df = df.withColumn("v", F.to_variant_object(F.struct("s", "n")))
    whole = order(rm.sort_rows(df, sort, descending))
    for offset in (11, 690, 5000):
        assert order(rm.page(df, offset, 4, sort, descending)) == whole[offset : offset + 4], offset
    narrow, left = view.deep_start(df, 600, 4, sort, descending)
    assert left < 4 and narrow.count() == 700 - 600 + left


def test_deep_pages_keep_little_in_one_task(spark):
    rows = rm.with_row_index(spark.read.parquet("/root/testdata/sf0.1/lineitem.parquet"))
    page = rm.page(rows, 500_000, 200, "l_extendedprice")
    kept = [int(n) for n in re.findall(r"TakeOrderedAndProject\(limit=(\d+)", page._jdf.queryExecution().executedPlan().toString())]
    assert kept and max(kept) < 400
    assert page.count() == 200


@pytest.mark.parametrize("fmt", ["parquet", "json"])
def test_first_rows_are_read_from_the_files_that_hold_them(spark, tmp_path, fmt):
    folder = str(tmp_path / "d")
    rows = spark.range(0, 4000, 1, 20).select("id", F.concat(F.lit("t"), "id").alias("t"))
    rows.write.format(fmt).save(folder)
    df = spark.read.parquet(folder) if fmt == "parquet" else rm.read_jsonl(spark, folder, "id BIGINT, t STRING")
    placed = rm.with_row_index(df)
    for path in (tmp_path / "d").glob("part-000*"):
        if not path.name.startswith(("part-00000", "part-00003", "part-00004")):
            path.write_text("no rows")  # whoever reads these fails
    for crc in (tmp_path / "d").glob(".*.crc"):
        crc.unlink()
    first = rm.sample_rows(placed)
    assert first.columns == placed.columns and values(first, "id") == [0, 1, 2, 3, 4]
    assert values(rm.page(placed, 790, 20), "id") == list(range(790, 810))
    assert values(rm.page(placed, 790, 20), rm.POSITION) == list(range(790, 810))
    assert rm.page(placed, 5000, 20).collect() == []
    plan = rm.page(placed, 10, 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and (fmt == "json" or "Join" not in plan)
    with pytest.raises(Exception):
        rm.page(placed.filter("id >= 0"), 0, 5).collect()  # filtered: rows may lie anywhere
