"""The registered queries: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

import rowmark as rm
from rowmark.checkpoints import shared_folder
from rowmark.plans import tables as t

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def indexed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return rm.with_row_index(t.table(spark, sf_dir, name))


# --- flagship --------------------------------------------------------------------------


@query
def curation_page(spark, sf):
    """Filter, sort, page and fingerprint rows: the path a viewer takes."""
    rows = rm.filter_rows(
        indexed(spark, sf, "documents"), "lang == 'en' and text contains 'the'"
    )
    shown = rm.page(rows, 0, 200, sort="n_chars", descending=True)
    records = rm.row_records(shown, "doc_id", ["doc_id", "lang"])
    return records.select(
        "row_index", "row_id", F.to_json("key_fields").alias("key_fields"), "row_hash"
    )


# --- sources ---------------------------------------------------------------------------


@query
def scan_csv(spark, sf):
    """Documents written as CSV and read back: quoted line breaks survive."""
    folder = shared_folder(spark)
    t.table(spark, sf, "documents").write.option("header", True).option("escape", '"').csv(folder)
    return rm.read_dataset(spark, folder, "csv")


@query
def scan_jsonl(spark, sf):
    folder = shared_folder(spark)
    t.table(spark, sf, "conversations").write.json(folder)
    return rm.read_dataset(spark, folder, "ndjson")


@query
def scan_split(spark, sf):
    root = shared_folder(spark)
    customers = t.table(spark, sf, "customer")
    for split, test in (("train", "c_nationkey < 20"), ("validation", "c_nationkey >= 20")):
        customers.filter(test).write.parquet(f"{root}/customers/data/{split}")
    train = rm.read_dataset(spark, "hf:customers", "hf", root=root)
    validation = rm.read_dataset(spark, "customers", "datasets", split="validation", root=root)
    return train.withColumn("split", F.lit("train")).unionByName(
        validation.withColumn("split", F.lit("validation"))
    )


@query
def scan_by_suffix(spark, sf):
    """One table in three formats, each found by the suffix or the name of the source."""
    root = shared_folder(spark)
    customers = t.table(spark, sf, "customer")
    customers.write.option("header", True).option("escape", '"').csv(f"{root}/c.csv")
    customers.write.json(f"{root}/c.jsonl")
    customers.write.parquet(f"{root}/c/train")
    parts = [
        rm.read_dataset(spark, source, root=root).select(F.lit(kind).alias("kind"), "c_custkey", "c_acctbal", "c_name")
        for kind, source in (("csv", f"{root}/c.csv"), ("jsonl", f"{root}/c.jsonl"), ("hf", "hf:c"))
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def row_index(spark, sf):
    return indexed(spark, sf, "documents").select("doc_id", F.col(rm.POSITION).alias("position"))


@query
def row_index_parts(spark, sf):
    """Positions over many Parquet files."""
    folder = shared_folder(spark)
    t.table(spark, sf, "orders").repartitionByRange(6, "o_orderkey").sortWithinPartitions(
        "o_orderkey"
    ).write.parquet(folder)
    return rm.with_row_index(spark.read.parquet(folder)).select(
        "o_orderkey", F.col(rm.POSITION).alias("position")
    )


@query
def row_index_csv(spark, sf):
    """Positions over many CSV files whose values span lines."""
    folder = shared_folder(spark)
    t.table(spark, sf, "documents").repartitionByRange(6, "doc_id").sortWithinPartitions(
        "doc_id"
    ).write.option("header", True).option("escape", '"').csv(folder)
    return rm.with_row_index(rm.read_csv(spark, folder)).select(
        "doc_id", F.col(rm.POSITION).alias("position")
    )


@query
def row_index_jsonl(spark, sf):
    """Positions over JSON-lines files."""
    folder = shared_folder(spark)
    t.table(spark, sf, "events").repartitionByRange(3, "event_id").sortWithinPartitions(
        "event_id"
    ).write.json(folder)
    return rm.with_row_index(rm.read_jsonl(spark, folder)).select(
        "event_id", F.col(rm.POSITION).alias("position")
    )


@query
def schema_listing(spark, sf):
    return rm.schema_listing(indexed(spark, sf, "events"))


@query
def dataset_fingerprint(spark, sf):
    return rm.dataset_fingerprint(t.table(spark, sf, "documents"), "documents", split="train")


@query
def growing_fingerprint(spark, sf):
    """Fingerprint of a folder before and after files are added: of the first half, then of all rows."""
    root = shared_folder(spark)
    documents = t.table(spark, sf, "documents")
    t.in_files(documents.where("doc_id % 2 = 0"), 3).write.parquet(f"{root}/d")
    half = rm.growing_fingerprint(spark, f"{root}/d", f"{root}/sums", "documents", split="train").first().fingerprint
    t.in_files(documents.where("doc_id % 2 <> 0"), 2).write.mode("append").parquet(f"{root}/d")
    whole = rm.growing_fingerprint(spark, f"{root}/d", f"{root}/sums", "documents", split="train")
    return whole.select("fingerprint", (F.col("fingerprint") != half).alias("changed"))


@query
def dataset_meta(spark, sf):
    customers = t.table(spark, sf, "customer")
    return rm.dataset_meta(
        customers, "hf", "customers", rm.dataset_fingerprint(customers, "customers"),
        split="train", row_id_field="c_custkey", key_fields=("c_nationkey", "c_name"),
    )


@query
def file_fingerprint(spark, sf):
    return rm.file_fingerprint(spark, f"{sf}/documents.parquet")


# --- projection and identity -----------------------------------------------------------


@query
def project_visible(spark, sf):
    return rm.select_visible(t.table(spark, sf, "orders"), ["o_totalprice", "nothing", "o_orderkey"])


@query
def hide_columns(spark, sf):
    return rm.hide(t.table(spark, sf, "lineitem"), ["l_tax", "l_shipdate", "l_linestatus"])


@query
def canonical_json(spark, sf):
    customers = t.balances(spark, sf)
    return customers.select("c_custkey", rm.canonical_json(customers).alias("row_json"))


@query
def canonical_json_nested(spark, sf):
    vectors = t.table(spark, sf, "embeddings")
    nested = vectors.select(
        "vec_id",
        F.struct(
            F.array("label", "vec_id").alias("z"), F.struct("label").alias("inner")
        ).alias("meta"),
        F.size("embedding").alias("dims"),
    )
    return nested.select("vec_id", rm.canonical_json(nested).alias("row_json"))


@query
def canonical_json_vectors(spark, sf):
    """Whole embeddings, as doubles, rendered and read back number by number."""
    vectors = t.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    text = vectors.select("vec_id", rm.canonical_json(vectors).alias("row_json"))
    numbers = F.from_json("row_json", "embedding array<double>, vec_id bigint")
    return text.select("vec_id", numbers["embedding"].alias("embedding"), F.substring("row_json", 1, 14).alias("head"))


@query
def row_hash(spark, sf):
    parts = []
    for name, key in (("documents", "doc_id"), ("customer", "c_custkey"), ("pages", "page_id")):
        df = t.table(spark, sf, name)
        parts.append(df.select(F.lit(name).alias("source"), F.col(key).alias("id"), rm.row_hash(df)
                               .alias("row_hash")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def row_id(spark, sf):
    """The preferred field where it is set, else the usual id column."""
    df = t.table(spark, sf, "events").select(
        F.col("event_id").alias("id"),
        F.when(F.col("event_type") != "error", F.concat(F.lit("s"), "user_id")).alias("session"),
    )
    return df.select("id", rm.row_id(df, "session").alias("row_id"))


@query
def key_fields(spark, sf):
    df = t.balances(spark, sf)
    return df.select(
        "c_custkey", rm.key_fields(df, ["c_nationkey", "missing", "c_acctbal", "c_name"]).alias("key_fields")
    )


@query
def row_records(spark, sf):
    records = rm.row_records(indexed(spark, sf, "orders"), "o_orderkey", ["o_custkey", "o_orderstatus"])
    return records.select(
        "row_index", "row_id", F.to_json("key_fields").alias("key_fields"), "row_hash",
        F.to_json("row_data").alias("row_data"),
    )


# --- filters ---------------------------------------------------------------------------


@query
def filter_eq(spark, sf):
    return rm.filter_rows(t.table(spark, sf, "orders"), "o_orderstatus = 'F'")


@query
def filter_ne(spark, sf):
    """A null balance is not unequal to a number in typed mode."""
    return rm.filter_rows(t.balances(spark, sf), "c_acctbal != 1863.84")


@query
def filter_range(spark, sf):
    return rm.filter_rows(
        t.table(spark, sf, "lineitem"),
        "l_quantity>=10&&l_quantity<24.5 and l_discount <= 0.05 and l_orderkey > 1000.5",
    )


@query
def filter_dates(spark, sf):
    return rm.filter_rows(t.table(spark, sf, "orders"), "o_orderdate >= 1997-06-01")


@query
def filter_contains(spark, sf):
    return rm.filter_rows(t.table(spark, sf, "documents"), "text contains 'the'")


@query
def filter_startswith(spark, sf):
    return rm.filter_rows(t.table(spark, sf, "part"), "p_name startswith small")


@query
def filter_endswith(spark, sf):
    return rm.filter_rows(t.table(spark, sf, "part"), "p_name ENDSWITH 'ring'")


@query
def filter_and_or(spark, sf):
    return rm.filter_rows(
        t.table(spark, sf, "orders"),
        "o_totalprice >= 200000 and o_orderpriority == '1-URGENT' or o_orderstatus == F",
    )


@query
def filter_parens(spark, sf):
    return rm.filter_rows(
        t.table(spark, sf, "orders"),
        "o_totalprice >= 200000 AND (o_orderpriority == '1-URGENT' || o_orderstatus == F)",
    )


@query
def filter_chain(spark, sf):
    text = rm.extended_filter("p_size > 40 or p_brand == 'Brand#17'", "p_name", "ring")
    return rm.filter_rows(t.table(spark, sf, "part"), text)


@query
def filtered_count(spark, sf):
    return rm.filtered_count(t.table(spark, sf, "customer"), "c_acctbal > 0")


@query
def coerce_order(spark, sf):
    """Number-like text compares as a number, other text as text."""
    return rm.filter_rows(t.loose_values(spark, sf), "loose >= '50'", mode="coerce")


@query
def coerce_number(spark, sf):
    return rm.filter_rows(t.loose_values(spark, sf), "loose < 50", mode="coerce")


@query
def coerce_ne(spark, sf):
    """Nulls stay."""
    return rm.filter_rows(t.loose_values(spark, sf), "loose != '12.31'", mode="coerce")


@query
def coerce_null(spark, sf):
    return rm.filter_rows(t.loose_values(spark, sf), "loose == null", mode="coerce")


@query
def coerce_lineitem(spark, sf):
    return rm.filter_rows(
        t.table(spark, sf, "lineitem"), "l_quantity >= '10' and l_returnflag != R", mode="coerce"
    )


@query
def filter_blank(spark, sf):
    """A blank filter keeps everything."""
    return rm.filter_rows(indexed(spark, sf, "customer"), " \n").drop(rm.POSITION)


# --- sort and page ---------------------------------------------------------------------


@query
def sort_asc(spark, sf):
    return rm.sort_rows(indexed(spark, sf, "customer"), "c_acctbal").drop(rm.POSITION)


@query
def sort_desc(spark, sf):
    return rm.sort_rows(indexed(spark, sf, "lineitem"), "l_extendedprice", descending=True).drop(
        rm.POSITION
    )


@query
def sort_mixed(spark, sf):
    """Places in a view sorted on nested values, which compare by their text."""
    events = indexed(spark, sf, "events").select(
        rm.POSITION, "event_id", F.to_variant_object(F.struct("user_id", "event_type")).alias("what")
    )
    view = rm.ranked_view(events, "what").with_rank()
    return view.select("event_id", F.col("_view_rank").alias("place"))


@query
def view_rank(spark, sf):
    """Every row's place in a view sorted on a column with nulls and many ties."""
    customers = indexed(spark, sf, "customer")
    known = F.when(F.col("c_mktsegment") != "BUILDING", F.floor(F.col("c_acctbal") / 1000))
    rows = customers.select(rm.POSITION, "c_custkey", known.alias("band"))
    view = rm.ranked_view(rows, "band", descending=True).with_rank()
    return view.select("c_custkey", "band", F.col("_view_rank").alias("place"))


@query
def page_working_names(spark, sf):
    """A page of a table whose columns are called like working columns."""
    named = {"o_orderkey": "_id", "o_custkey": "_file", "o_orderstatus": "_key", "o_totalprice": "_part"}
    return rm.page(indexed(spark, sf, "orders").withColumnsRenamed(named), 1000, 200, "_part", True).drop(rm.POSITION)


@query
def page(spark, sf):
    return rm.page(indexed(spark, sf, "orders"), 400, 200, "o_totalprice").drop(rm.POSITION)


@query
def page_deep(spark, sf):
    """A page behind five sixths of the rows."""
    rows = indexed(spark, sf, "lineitem")
    return rm.page(rows, rows.count() * 5 // 6, 200, "l_extendedprice").drop(rm.POSITION)


@query
def page_of_parts(spark, sf):
    """A page in source order from the middle of 20 files."""
    folder = shared_folder(spark)
    t.table(spark, sf, "orders").repartitionByRange(20, "o_orderkey").sortWithinPartitions("o_orderkey").write.parquet(folder)
    rows = rm.with_row_index(spark.read.parquet(folder))
    return rm.page(rows, 777, 200)


@query
def page_after(spark, sf):
    """The page behind the last row of the first page."""
    orders = indexed(spark, sf, "orders")
    last = rm.page(orders, 199, 1, "o_totalprice", True).first()
    following = rm.page_after(
        orders, last[rm.POSITION], 200, "o_totalprice", True, last["o_totalprice"]
    )
    return following.drop(rm.POSITION)


@query
def page_at_row(spark, sf):
    rows = rm.filter_rows(indexed(spark, sf, "orders"), "o_orderstatus == F")
    return rm.page_at(rows, 777, 200, "o_totalprice").drop(rm.POSITION)


@query
def page_at_rank(spark, sf):
    rows = rm.filter_rows(indexed(spark, sf, "orders"), "o_orderstatus == F")
    return rm.ranked_view(rows, "o_totalprice").page_at(777, 200).drop(rm.POSITION)


@query
def sample_rows(spark, sf):
    return rm.sample_rows(indexed(spark, sf, "documents")).drop(rm.POSITION)


@query
def inspect_rows(spark, sf):
    """A dataset at a glance: its first rows, with the row count of its meta row."""
    rows = indexed(spark, sf, "documents")
    meta = rm.dataset_meta(rows, "hf", "documents", rm.dataset_fingerprint(rows.drop(rm.POSITION), "documents"))
    report = rm.inspect(rows, meta, id_field="doc_id", key_fields=("lang",))
    return report["sample_rows"].select(
        "row_index", "row_id", F.to_json("key_fields").alias("key_fields"), report["meta"].select("row_count").scalar().alias("row_count")
    )


# --- labels and annotations ------------------------------------------------------------


@query
def annotate_rows(spark, sf):
    rows = rm.filter_rows(
        indexed(spark, sf, "orders"),
        "o_totalprice >= 200000 and o_orderpriority = '1-URGENT' or o_orderstatus = 'F'",
    )
    vocab = t.curated_labels(spark, sf)
    made = rm.annotate(
        rm.row_records(rows, "o_orderkey", ["o_custkey"]), " CLICK ", "b1", "sha256:f1",
        annotator="alice", created_at="2024-01-01T00:00:00Z", run_id="r1", vocab=vocab,
    )
    return made.select(
        "annotation_id", "bundle_id", "dataset_fingerprint", "task_type", "label",
        F.to_json("payload").alias("payload"), "row_ref.row_index", "row_ref.row_id",
        F.to_json("row_ref.key_fields").alias("key_fields"), "row_hash",
        F.to_json("row_data").alias("row_data"), "annotator", "note", "created_at", "updated_at",
        "event_type",
    )


@query
def resolve_labels(spark, sf):
    return rm.resolve_labels(
        t.spelled_labels(spark, sf), t.curated_labels(spark, sf), position="pos"
    )


@query
def added_labels(spark, sf):
    return rm.added_labels(t.spelled_labels(spark, sf), t.curated_labels(spark, sf), position="pos")


@query
def label_vocab(spark, sf):
    return rm.label_vocab(t.spelled_labels(spark, sf))


@query
def label_folding(spark, sf):
    """Labels that only full case folding brings together."""
    parts = t.table(spark, sf, "part").select(
        F.col("p_type").alias("task_type"), F.col("p_partkey").alias("pos"),
        F.when(F.col("p_size") % 3 == 0, F.concat(F.lit(" STRASSE "), "p_brand"))
        .when(F.col("p_size") % 3 == 1, F.concat(F.lit("Stra\u00dfe "), "p_brand"))
        .otherwise(F.concat(F.lit("stra\u1e9ee "), "p_brand")).alias("label"),
    )
    return rm.label_vocab(parts)


@query
def label_versions(spark, sf):
    """Label set of a bundle after three annotation runs, each of which brings labels of its own."""
    root = shared_folder(spark)
    rm.create_bundle(spark, f"{root}/b", {"fingerprint": "sha256:f1"}, labels=["keep"])
    records = rm.row_records(indexed(spark, sf, "orders"), "o_orderkey")
    for name in ("o_orderstatus", "o_orderpriority"):
        chosen = F.concat(F.lit(f"{name} "), F.variant_get("row_data", f"$.{name}", "string"))
        rm.annotate_bundle(spark, f"{root}/b", records, chosen, annotator="alice")
    return rm.read_label_set(spark, f"{root}/b").labels.select("task_type", "label")


@query
def labels_by_task(spark, sf):
    return rm.labels_of_task(rm.label_vocab(t.spelled_labels(spark, sf)), " preference ")


@query
def label_codes(spark, sf):
    return rm.label_codes(t.brand_labels(spark, sf), t.size_codes(spark, sf, 1, 4, last=False))


@query
def label_union(spark, sf):
    """Labels in merged order; the order is what counts, not the numbers."""
    return rm.label_union(t.brand_labels(spark, sf), t.segment_labels(spark, sf))


@query
def label_code_merge(spark, sf):
    labels = rm.label_union(t.brand_labels(spark, sf), t.segment_labels(spark, sf))
    target, source = t.size_codes(spark, sf, 1, 3, False), t.size_codes(spark, sf, 2, 6, True)
    tasks = t.brand_labels(spark, sf).select("task_type").distinct()
    return rm.label_code_merge(labels, target, source, tasks).select("task_type", "key", "label")


@query
def annotation_count(spark, sf):
    return rm.annotation_count(t.incoming_log(spark, sf))


# --- merge -----------------------------------------------------------------------------


@query
def import_new(spark, sf):
    return t.flat(rm.import_new(t.event_log(spark, sf), t.incoming_log(spark, sf), "pos"))


@query
def import_dedup_source(spark, sf):
    return t.flat(rm.first_per_id(t.incoming_log(spark, sf), "pos"))


@query
def import_merge(spark, sf):
    return t.flat(rm.merge(t.event_log(spark, sf), t.incoming_log(spark, sf), "pos"))


@query
def import_report(spark, sf):
    return rm.import_report(t.event_log(spark, sf), t.incoming_log(spark, sf), "pos")


@query
def label_conflicts(spark, sf):
    return rm.conflict_groups(t.event_log(spark, sf))


@query
def label_conflict_count(spark, sf):
    return rm.conflict_count(t.incoming_log(spark, sf))


@query
def growing_conflicts(spark, sf):
    """Conflicts of a log after each of three appends."""
    root = shared_folder(spark)
    rm.create_bundle(spark, f"{root}/b", {"fingerprint": "sha256:f1"})
    log, after = t.full_records(t.event_log(spark, sf)), None
    for third in range(3):
        rm.append_annotations(log.where(F.col("pos") % 3 == third).orderBy("pos"), f"{root}/b")
        found = rm.bundle_conflicts(spark, f"{root}/b").withColumn("appends", F.lit(third + 1))
        after = found if after is None else after.unionByName(found)
    return after


@query
def export_snapshot(spark, sf):
    """Log written to a bundle, exported, and read back from the export in log order."""
    root = shared_folder(spark)
    rm.create_bundle(spark, f"{root}/b", {"fingerprint": "sha256:f1"})
    rm.append_annotations(t.full_records(t.event_log(spark, sf)).orderBy("pos"), f"{root}/b")
    rm.export_snapshot(spark, f"{root}/b", f"{root}/copy")
    return rm.read_annotations(spark, f"{root}/copy").select(
        F.col(rm.POSITION).alias("position"), "annotation_id", "task_type", "label",
        F.col("row_ref.row_id").alias("row_id"), "annotator", "created_at",
    )


@query
def import_bundle(spark, sf):
    """Two bundles on storage merged; the report of the merge."""
    root = shared_folder(spark)
    for name, log in (("a", t.event_log(spark, sf)), ("b", t.incoming_log(spark, sf))):
        rm.create_bundle(spark, f"{root}/{name}", {"fingerprint": "sha256:f1"})
        rm.append_annotations(t.full_records(log).orderBy("pos"), f"{root}/{name}")
    report = rm.import_bundle(spark, f"{root}/a", f"{root}/b")
    written = rm.annotation_count(rm.read_annotations(spark, f"{root}/a"))
    return report.select(
        "applied", "source_count", "existing_count", "label_set_changed", "imported_count",
        "duplicate_count", "conflict_count", written.scalar().alias("written_count"),
    )


@query
def import_steps(spark, sf):
    """A bundle of other data: refused, then tried, then imported, with what the log holds after each."""
    root = shared_folder(spark)
    logs = (("a", t.event_log(spark, sf), ["click"]), ("b", t.incoming_log(spark, sf), ["click", "view", "error"]))
    for name, log, labels in logs:
        rm.create_bundle(spark, f"{root}/{name}", {"fingerprint": f"sha256:{name}"}, labels=labels)
        rm.append_annotations(t.full_records(log).orderBy("pos"), f"{root}/{name}")

    def held():
        return rm.annotation_count(rm.read_annotations(spark, f"{root}/a")).first().annotation_count

    steps = []
    try:
        rm.import_bundle(spark, f"{root}/a", f"{root}/b")
    except ValueError:
        steps.append(("refused", False, 0, False, held()))
    for step, dry in (("tried", True), ("imported", False)):
        report = rm.import_bundle(spark, f"{root}/a", f"{root}/b", allow_fingerprint_mismatch=True, dry_run=dry).first()
        steps.append((step, report.applied, report.imported_count, report.label_set_changed, held()))
    steps.append(("labels", True, rm.read_label_set(spark, f"{root}/a").labels.count(), False, held()))
    return spark.createDataFrame(steps, "step STRING, applied BOOLEAN, records BIGINT, label_set_changed BOOLEAN, held BIGINT")


@query
def annotate_bundle(spark, sf):
    """All orders annotated with their status: the label set and the records that come of it."""
    root = shared_folder(spark)
    rm.create_bundle(spark, f"{root}/b", {"fingerprint": "sha256:f1"})
    records = rm.row_records(indexed(spark, sf, "orders"), "o_orderkey")
    status = F.concat(F.lit(" Status-"), F.variant_get("row_data", "$.o_orderstatus", "string"))
    rm.annotate_bundle(spark, f"{root}/b", records, status, annotator="alice")
    keys = rm.read_label_set(spark, f"{root}/b").keys
    made = rm.read_annotations(spark, f"{root}/b").groupBy("label").count()
    return keys.select(F.lit("code").alias("part"), "label", F.col("key").alias("value")).unionByName(
        made.select(F.lit("records").alias("part"), "label", F.col("count").cast("string").alias("value"))
    )


@query
def merge_feed(spark, sf):
    """The order log arriving as files, merged into a bundle that holds the event log."""
    root = shared_folder(spark)
    rm.create_bundle(spark, f"{root}/b", {"fingerprint": "sha256:f1"})
    rm.append_annotations(t.full_records(t.event_log(spark, sf)).orderBy("pos"), f"{root}/b")
    incoming = t.in_feed_files(t.full_records(t.incoming_log(spark, sf)), 4)
    incoming.drop("pos").write.json(f"{root}/feed")
    rm.merge_feed(rm.annotation_feed(spark, f"{root}/feed"), f"{root}/b", f"{root}/progress").awaitTermination()
    return t.flat(rm.read_annotations(spark, f"{root}/b").withColumn("pos", F.lit(0))).drop("pos")


@query
def known_ids(spark, sf):
    """Ids of the incoming log that a bundle with two batches of events already holds."""
    root = shared_folder(spark)
    rm.create_bundle(spark, f"{root}/b", {"fingerprint": "sha256:f1"})
    events = t.full_records(t.event_log(spark, sf)).orderBy("pos")
    rm.append_annotations(events.where("task_type = 'preference'"), f"{root}/b")
    rm.append_new(events.where("task_type <> 'preference'").withColumnRenamed("pos", rm.POSITION), f"{root}/b")
    incoming = t.incoming_log(spark, sf).select(F.coalesce("annotation_id", F.lit("None")).alias("id"))
    return rm.known_ids(spark, f"{root}/b", incoming)


# --- summary ---------------------------------------------------------------------------


@query
def facet_filter(spark, sf):
    return t.flat(rm.facet_filter(t.event_log(spark, sf), annotator=" U3 ", task_type="Preference"))


@query
def facet_counts(spark, sf):
    return rm.facet_counts(t.incoming_log(spark, sf))


@query
def time_range(spark, sf):
    return rm.time_range(t.incoming_log(spark, sf))


@query
def duplicate_ids(spark, sf):
    return rm.duplicate_ids(t.incoming_log(spark, sf))


@query
def conflicts_filtered(spark, sf):
    return rm.conflict_count(rm.facet_filter(t.event_log(spark, sf), annotator="u3"))


@query
def record_counts(spark, sf):
    return rm.record_counts(t.event_log(spark, sf), label="CLICK")


@query
def sample_annotations(spark, sf):
    log = rm.facet_filter(t.event_log(spark, sf), label="Purchase")
    return t.flat(rm.sample_annotations(log, 5, "pos"))


@query
def bundle_summary(spark, sf):
    return rm.summary(t.incoming_log(spark, sf), task_type="PREFERENCE")


@query
def bundle_report(spark, sf):
    """The whole report of a bundle on storage, but for what differs from run to run."""
    root = shared_folder(spark)
    rm.create_bundle(spark, f"{root}/b", {"fingerprint": "sha256:f1", "source_type": "hf"}, labels=["Click", "view"])
    rm.append_annotations(t.full_records(t.incoming_log(spark, sf)).orderBy("pos"), f"{root}/b")
    report = rm.summarize_bundle(spark, f"{root}/b", 3, task_type="PREFERENCE")
    own = F.col("name").isin("bundle_id", "created_at") & (F.col("section") == "manifest")
    sample = F.col("section") == "sample_records"
    return report.where(~own).withColumn("value", F.when(sample, F.get_json_object("value", "$.annotation_id")).otherwise(F.col("value")))


# --- text functions --------------------------------------------------------------------


@query
def cell_preview(spark, sf):
    df = t.table(spark, sf, "documents")
    return df.select(
        "doc_id", rm.cell_preview(df, "text").alias("text"), rm.cell_preview(df, "n_chars").alias("n_chars")
    )


@query
def cell_text(spark, sf):
    df = t.balances(spark, sf).withColumn("place", F.struct("c_nationkey", "c_mktsegment"))
    return df.select(
        "c_custkey", rm.cell_text(df, "c_acctbal").alias("balance"), rm.cell_text(df, "place").alias("place")
    )


@query
def slugify(spark, sf):
    return t.table(spark, sf, "part").select(
        "p_partkey", rm.slugify(F.concat_ws(" / ", "p_name", "p_brand")).alias("slug")
    )
