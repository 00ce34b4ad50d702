import csv
import json
import random

import pytest
from conftest import values
from pyspark.sql import functions as F

import rowmark as rm
from rowmark.sources.csv_records import _lines, range_states
from rowmark.sources.readers import _values_span_lines, source_type


@pytest.fixture
def sample_csv(tmp_path):
    path = tmp_path / "sample.csv"
    path.write_text("id,river,depth\n11,Elbe,2.5\n12,Oder,4.75\n13,Spree,1.5\n")
    return str(path)


@pytest.fixture
def sample_jsonl(tmp_path):
    path = tmp_path / "sample.jsonl"
    rows = [("k7", "Elbe", 2.5), ("k8", "Oder", 4.75), ("k9", "Spree", 1.5)]
    lines = [json.dumps(dict(zip(("id", "river", "depth"), row))) for row in rows]
    path.write_text("\n\n".join(lines) + "\n")
    return str(path)


def test_csv_records_survive_filter_and_sort(spark, sample_csv):
    df = rm.with_row_index(rm.read_dataset(spark, sample_csv))
    assert dict(df.drop(rm.POSITION).dtypes) == {"id": "bigint", "river": "string", "depth": "double"}
    first = rm.row_records(rm.sample_rows(df, 1), key_columns=["id"]).first()
    assert (first.row_index, first.row_id) == (0, "11") and first.key_fields.toJson() == '{"id":11}'
    best = rm.page(rm.filter_rows(df, "depth >= 2.5"), 0, 10, "depth", descending=True)
    assert [(r.id, r[rm.POSITION]) for r in best.collect()] == [(12, 1), (11, 0)]


def test_jsonl_pages_and_projection(spark, sample_jsonl):
    df = rm.with_row_index(rm.read_dataset(spark, sample_jsonl))
    assert [(r.id, r[rm.POSITION]) for r in rm.page(df, 1, 2).collect()] == [("k8", 1), ("k9", 2)]
    assert rm.select_visible(df, ["id"]).columns == [rm.POSITION, "id"]


def test_csv_values(spark, tmp_path):
    path = tmp_path / "v.csv"
    path.write_text(
        'text,empty,quoted,day,big,flag,n\n"two\nlines, ""q""",,"",2024-01-02,1234567890,true,1\nx,,z,2024-01-03,1,false,\n'
    )
    df = rm.read_csv(spark, str(path))
    assert dict(df.dtypes) == {
        "text": "string", "empty": "string", "quoted": "string", "day": "string", "big": "bigint",
        "flag": "boolean", "n": "bigint",
    }
    first, second = df.collect()
    assert first.text == 'two\nlines, "q"' and first.empty is None and first.quoted == ""
    assert (first.day, first.big, first.flag, first.n, second.n) == ("2024-01-02", 1234567890, True, 1, None)


def test_csv_header_must_match_the_schema(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n1,2\n")
    (tmp_path / "b.csv").write_text("b,a\n1,2\n")
    with pytest.raises(Exception, match="(?i)header"):
        rm.read_csv(spark, str(tmp_path), "a BIGINT, b BIGINT").collect()


def test_csv_bad_value_is_an_error(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a\n1\nx\n")
    with pytest.raises(Exception, match="MALFORMED|FAILFAST"):
        rm.read_csv(spark, str(tmp_path), "a BIGINT").collect()


def test_jsonl_types_order_and_errors(spark, tmp_path):
    path = tmp_path / "v.jsonl"
    path.write_text('{"z":1,"a":{"k":[1,2]},"m":true}\n\n{"z":2.5,"extra":"x"}\n')
    df = rm.read_jsonl(spark, str(path))
    assert df.columns == ["z", "a", "m", "extra"]
    assert df.schema["z"].dataType.simpleString() == "double"
    assert df.schema["a"].dataType.simpleString() == "struct<k:array<bigint>>"
    assert df.count() == 2
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"a":1}\n{"a":\n')
    with pytest.raises(Exception, match="(?i)malformed|failfast"):
        rm.read_jsonl(spark, str(bad)).collect()


def test_splits(spark, tmp_path):
    root = str(tmp_path)
    for n, low in enumerate((0, 10, 20)):
        part = spark.range(low, low + 10).coalesce(1)
        part.write.parquet(f"{root}/w/{n}")
        made = next((tmp_path / "w" / str(n)).glob("*.parquet"))
        target = tmp_path / "org" / "data" / "data" / f"train-0000{n}-of-00003.parquet"
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(made.read_bytes())
    spark.range(5).write.parquet(f"{root}/org/data/en/test")
    df = rm.with_row_index(rm.read_dataset(spark, "hf:org/data", root=root))
    assert [(r.id, r[rm.POSITION]) for r in df.orderBy("id").collect()] == [(i, i) for i in range(30)]
    assert rm.read_dataset(spark, "org/data", "HF", config="en", split="test", root=root).count() == 5
    with pytest.raises(ValueError, match="No Parquet shards for split 'validation'"):
        rm.read_split(spark, "org/data", split="validation", root=root)


def test_source_types(spark, tmp_path, sample_csv):
    assert source_type(spark, sample_csv) == "csv"
    assert source_type(spark, "anything", " NDJSON ") == "jsonl"
    assert source_type(spark, "x", "datasets") == source_type(spark, "org/name") == "hf"
    odd = tmp_path / "data.txt"
    odd.write_text("x")
    with pytest.raises(ValueError, match="'.txt'"):
        source_type(spark, str(odd))
    with pytest.raises(ValueError, match="'xml'"):
        source_type(spark, sample_csv, "xml")


@pytest.fixture
def small_splits(spark):
    settings = ("files.maxPartitionBytes", "files.openCostInBytes", "autoBroadcastJoinThreshold")
    old = {f"spark.sql.{k}": spark.conf.get(f"spark.sql.{k}", None) for k in settings}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1000")
    yield
    for key, value in old.items():
        spark.conf.set(key, value) if value else spark.conf.unset(key)


@pytest.mark.parametrize("fmt", ["csv", "csv-lines", "json", "parquet"])
@pytest.mark.parametrize("threshold", ["10m", "-1"])
def test_positions_over_files_and_splits(spark, tmp_path, small_splits, fmt, threshold):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    folder = str(tmp_path / "d")
    rows = spark.range(0, 20000, 1, 3).select("id", F.repeat(F.lit("x"), (F.col("id") % 40).cast("int")).alias("t"))
    writer = rows.write.option("header", True).option("escape", '"')
    if fmt == "parquet":
        writer.parquet(folder)
        df = spark.read.parquet(folder)
    elif fmt == "json":
        writer.json(folder)
        df = rm.read_jsonl(spark, folder, "id BIGINT, t STRING")
    else:
        writer.csv(folder)
        df = rm.read_csv(spark, folder, "id BIGINT, t STRING", multiline=True if fmt == "csv" else None)
    indexed = rm.with_row_index(df)
    assert indexed.filter(F.col("id") != F.col(rm.POSITION)).count() == 0
    assert indexed.select(rm.POSITION).distinct().count() == 20000
    late = rm.filter_rows(indexed, "id >= 19990").orderBy("id")
    assert values(late, rm.POSITION) == list(range(19990, 20000))
    if threshold != "-1":
        plan = indexed._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan


def test_positions_of_a_single_parquet_file_need_no_join(spark, tmp_path):
    spark.range(10).coalesce(1).write.parquet(str(tmp_path / "p"))
    plan = rm.with_row_index(spark.read.parquet(str(tmp_path / "p")))._jdf.queryExecution().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_schema_listing_hides_positions(spark, sample_csv):
    df = rm.with_row_index(rm.read_dataset(spark, sample_csv))
    assert [(r.name, r.dtype) for r in rm.schema_listing(df).orderBy("place").collect()] == [
        ("id", "bigint"), ("river", "string"), ("depth", "double"),
    ]


def test_meta(spark, sample_csv):
    df = rm.read_dataset(spark, sample_csv)
    fingerprint = rm.file_fingerprint(spark, sample_csv)
    meta = rm.dataset_meta(df, "csv", sample_csv, fingerprint, row_id_field="id", key_fields=("id", "river"))
    row = meta.first()
    assert (row.source_type, row.split, row.row_count, row.row_id_field) == ("csv", None, 3, "id")
    assert json.loads(row.key_fields) == ["id", "river"] and row.fingerprint == fingerprint.first().fingerprint


def test_file_fingerprint_follows_the_listing(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    for name in ("a", "b"):
        (folder / name).write_text("same")
    one = rm.file_fingerprint(spark, str(folder / "a")).first().fingerprint
    many = rm.file_fingerprint(spark, str(folder)).first().fingerprint
    assert one.startswith("sha256:") and len(one) == 71 and one != many
    assert rm.file_fingerprint(spark, str(folder / "a")).first().fingerprint == one
    (folder / "b").write_text("other size")
    assert rm.file_fingerprint(spark, str(folder)).first().fingerprint != many


def test_dataset_fingerprint(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "n BIGINT, s STRING")
    base = rm.dataset_fingerprint(df, "d", split="train").first().fingerprint
    assert rm.dataset_fingerprint(df.repartition(3), "d", split="train").first().fingerprint == base
    changed = [
        rm.dataset_fingerprint(df.distinct(), "d", split="train"),
        rm.dataset_fingerprint(df, "d", split="test"),
        rm.dataset_fingerprint(df, "d", "en", "train"),
        rm.dataset_fingerprint(df.unionAll(df), "d", split="train"),
        rm.dataset_fingerprint(df.select("n", F.coalesce("s", F.lit("")).alias("s")), "d", split="train"),
    ]
    prints = {c.first().fingerprint for c in changed}
    assert len(prints) == 5 and base not in prints


def test_inspect(spark, sample_csv):
    df = rm.with_row_index(rm.read_dataset(spark, sample_csv))
    meta = rm.dataset_meta(df, "csv", sample_csv, rm.file_fingerprint(spark, sample_csv))
    report = rm.inspect(df, meta, 2, key_fields=("river",))
    assert report["meta"].first().row_count == 3 and report["schema"].count() == 3
    assert values(report["sample_rows"], "row_id") == ["11", "12"]


@pytest.mark.parametrize(
    ("text", "spans"),
    [('a,b\n1,"x ""y"" z"\n', False), ('a,b\n1,"x\ny"\n', True), ('a,b\n1,5" pipe\n', True), ("a\n", False)],
)
def test_csv_files_are_split_unless_values_span_lines(spark, tmp_path, text, spans):
    (tmp_path / "a.csv").write_text(text)
    assert _values_span_lines(spark, str(tmp_path / "a.csv")) is spans


def test_json_columns_come_in_the_order_of_the_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"z": 1, "y": 2}\n' * 150 + '{"late": 1, "z": 3}\n')
    (tmp_path / "b.jsonl").write_text('{"y": 1, "z": 2, "pad": "%s"}\n' % ("x" * 50_000))
    assert rm.read_jsonl(spark, str(tmp_path)).columns == ["z", "y", "late", "pad"]


def test_working_names_do_not_meet_columns(spark, tmp_path):
    rows = spark.range(9).selectExpr("id", "id AS _file", "id AS _number", "id AS _start", "id AS _shift", "id AS _wanted")
    rows.write.json(str(tmp_path / "j"))
    rows.write.parquet(str(tmp_path / "p"))
    for df in (rm.read_jsonl(spark, str(tmp_path / "j")), spark.read.parquet(str(tmp_path / "p"))):
        placed = rm.with_row_index(df)
        assert set(placed.columns) == {rm.POSITION, "id", "_file", "_number", "_start", "_shift", "_wanted"}
        assert sorted(values(placed, rm.POSITION)) == list(range(9))
        assert rm.page(placed, 2, 3, "_wanted").columns == placed.columns


def test_part_files_count_by_their_number(spark, tmp_path):
    for n in (99999, 100000, 100001):
        (tmp_path / f"part-{n}.json").write_text('{"n": %d}\n' % n)
    placed = rm.with_row_index(rm.read_jsonl(spark, str(tmp_path), "n BIGINT"))
    assert values(placed.orderBy(rm.POSITION), "n") == [99999, 100000, 100001]


def spanning_csv(folder, files, rows, seed=0):
    """CSV files with quotes, commas and line breaks in values; the rows as they must be read."""
    rng, told = random.Random(seed), []
    folder.mkdir()
    pieces = ["x", "long text ", '"', '""', ",", "\n", "\n\n", "é", " ", '","', '"\n"', "1"]
    for f in range(files):
        with open(folder / f"part-{f:05d}.csv", "w", newline="") as out:
            writer = csv.writer(out, lineterminator="\n")
            writer.writerow(["n", "text", "other"])
            for n in range(rows):
                text = "".join(rng.choices(pieces, k=rng.randrange(1, 12))) + "."
                told.append((f * rows + n, text, rng.choice(["", "plain", "a\nb", '5" pipe'])))
                writer.writerow(told[-1])
                if n % 17 == 0:
                    out.write("\n")
    return [(n, text, other or None) for n, text, other in told]


@pytest.mark.parametrize("size", ["300", "5000", "128m"])
def test_values_span_lines_and_ranges(spark, tmp_path, small_splits, size):
    want = spanning_csv(tmp_path / "d", 2, 400)
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    df = rm.read_csv(spark, str(tmp_path / "d"))
    assert dict(df.dtypes) == {"n": "bigint", "text": "string", "other": "string"}
    placed = rm.with_row_index(df)
    got = sorted((r[rm.POSITION], r.n, r.text, r.other) for r in placed.collect())
    assert got == [(n, *row) for n, row in enumerate(want)]
    assert sorted(map(tuple, df.collect())) == want


def test_one_file_with_spanning_values_is_read_by_many_tasks(spark, tmp_path, small_splits):
    want = spanning_csv(tmp_path / "d", 1, 3000)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    lines = spark.read.text(str(tmp_path / "d"))
    assert lines.rdd.getNumPartitions() > 3
    states = range_states(_lines(spark, str(tmp_path / "d"))).collect()
    assert len(states) == lines.rdd.getNumPartitions() and {s.inside for s in states} == {True, False}
    df = rm.read_csv(spark, str(tmp_path / "d"), "n BIGINT, text STRING, other STRING")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "128m")  # the stored records are several files
    assert df.rdd.getNumPartitions() > 3 and df.count() == len(want)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "csv" not in plan.lower().replace("from_csv", "") and "Python" not in plan
    assert "Join" not in plan


def test_a_value_longer_than_many_ranges(spark, tmp_path, small_splits):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    long = "\n".join(f'line {n} with "quotes", and commas' for n in range(600))
    (tmp_path / "d").mkdir()
    with open(tmp_path / "d" / "a.csv", "w", newline="") as out:
        csv.writer(out, lineterminator="\n").writerows([["n", "text"], [0, "x"], [1, long], [2, "y\nz"], [3, long]])
    placed = rm.with_row_index(rm.read_csv(spark, str(tmp_path / "d")))
    assert sorted(map(tuple, placed.select(rm.POSITION, "n", "text").collect())) == [
        (0, 0, "x"), (1, 1, long), (2, 2, "y\nz"), (3, 3, long),
    ]


def test_spanning_csv_errors_and_edges(spark, tmp_path):
    for name, text in (("a", 'n,t\n1,"x\ny"\n'), ("b", 't,n\n"x\ny",1\n')):
        (tmp_path / f"{name}.csv").write_text(text)
    with pytest.raises(ValueError, match="differ in their header"):
        rm.read_csv(spark, str(tmp_path))
    with pytest.raises(ValueError, match="header"):
        rm.read_csv(spark, str(tmp_path / "a.csv"), "t STRING, n BIGINT")
    (tmp_path / "c.csv").write_text('n,t\nx,"x\ny"\n')
    with pytest.raises(Exception, match="MALFORMED|FAILFAST"):
        rm.read_csv(spark, str(tmp_path / "c.csv"), "n BIGINT, t STRING").collect()
    (tmp_path / "d.csv").write_text('n,"two\nlines"\n')
    df = rm.read_csv(spark, str(tmp_path / "d.csv"))
    assert df.columns == ["n", "two\nlines"] and rm.with_row_index(df).collect() == []
    (tmp_path / "e.csv").write_bytes(b'n,t\r\n1,"x\r\ny"\r\n2,z\r\n')
    df = rm.with_row_index(rm.read_csv(spark, str(tmp_path / "e.csv")))
    assert [(r.n, r.t) for r in df.orderBy(rm.POSITION).collect()] == [(1, "x\ny"), (2, "z")]
