import json

import pytest
from conftest import values
from pyspark.sql import functions as F

import rowmark as rm


@pytest.fixture
def labels(spark):
    def build(*names, task="preference"):
        rows = [(task, i, name) for i, name in enumerate(names)]
        return spark.createDataFrame(rows, "task_type STRING, pos BIGINT, label STRING")

    return build


@pytest.fixture
def keys(spark):
    def build(task="preference", **codes):
        rows = [(task, k[1:], i, v) for i, (k, v) in enumerate(codes.items())]
        return spark.createDataFrame(rows, "task_type STRING, key STRING, pos BIGINT, label STRING")

    return build


def named(df, task=None):
    df = df if task is None else df.filter(F.col("task_type") == task)
    return values(df.orderBy("task_type", "pos"), "label")


def coded(df):
    return {row.key: row.label for row in df.collect()}


def test_vocabulary(labels, keys):
    assert named(rm.label_vocab(labels(" Good", "bad\n", "", "GOOD ", "new", "Bad", "  "))) == ["Good", "bad", "new"]
    vocab = rm.label_vocab(labels("Good"), keys(_1="good", _2="Other", _3="third"))
    assert named(vocab) == ["Good", "Other", "third"]


def test_vocabularies_of_tasks_are_apart(labels):
    both = labels("a", "b").union(labels("A", "c", task="classification"))
    vocab = rm.label_vocab(both)
    assert named(rm.labels_of_task(vocab, " classification ")) == ["A", "c"]
    assert named(rm.labels_of_task(vocab, "unseen")) == []
    with pytest.raises(ValueError, match="Task type cannot be empty"):
        rm.labels_of_task(vocab, "  ")


def test_resolve(spark, labels):
    rows = spark.createDataFrame(
        [(0, "preference", "  GOOD "), (1, "preference", "Fresh"), (2, "preference", "fresh"), (3, "other", "good")],
        "pos BIGINT, task_type STRING, label STRING",
    )
    vocab = labels("bad", "Good")
    resolved = rm.resolve_labels(rows, vocab, "pos")
    assert resolved.columns == rows.columns
    assert values(resolved.orderBy("pos"), "label") == ["Good", "Fresh", "Fresh", "good"]
    added = rm.added_labels(rows, vocab, "pos")
    assert sorted((r.task_type, r.label) for r in added.collect()) == [("other", "good"), ("preference", "Fresh")]


@pytest.mark.parametrize("empty", ["  ", None])
def test_empty_label_is_an_error(spark, labels, empty):
    rows = spark.createDataFrame([(0, "preference", empty)], "pos BIGINT, task_type STRING, label STRING")
    with pytest.raises(Exception, match="Label cannot be empty"):
        rm.resolve_labels(rows, labels("a"), "pos").collect()


def test_codes_are_the_lowest_free(labels, keys):
    given = rm.label_codes(labels("a", "b", "c", "d"), keys(_1="b", _3="x"))
    assert coded(given) == {"2": "a", "4": "c", "5": "d"}


def test_more_than_nine_labels(labels, keys):
    given = rm.label_codes(labels(*(f"l{i:02}" for i in range(1, 13))), keys(_9="z"))
    assert coded(given) == {str(i): f"l0{i}" for i in range(1, 9)}
    full = keys(**{f"_{i}": f"l{i}" for i in range(1, 10)})
    assert coded(rm.label_codes(labels("extra-label"), full)) == {}


def test_union_compares_exactly(labels):
    merged = rm.label_union(labels("Good", "bad"), labels("good", "bad", "new"))
    assert named(merged) == ["Good", "bad", "good", "new"]
    assert named(rm.label_vocab(merged)) == ["Good", "bad", "new"]


def test_code_merge(spark, labels, keys):
    tasks = spark.createDataFrame([("preference",)], "task_type STRING")
    merged = rm.label_code_merge(
        labels("good", "bad", "x", "y"), keys(_1="good", _3="bad"), keys(_1="x", _5="y"), tasks
    )
    assert coded(merged) == {"1": "good", "2": "x", "3": "bad", "5": "y"}


def test_document_with_profiles(spark):
    text = json.dumps({
        "active_task_type": " classification ", "task_type": "preference", "labels": ["ignored"],
        "task_profiles": {
            " preference ": {"labels": [" Good", "good", "", 5], "hotkeys": {"2": "Extra", " 1 ": "Good", "3": " "}},
            "": {"labels": ["x"]},
            "empty": None,
        },
    })
    label_set = rm.label_set_from_json(spark, text)
    assert label_set.active_task == "classification"
    assert sorted(values(label_set.tasks, "task_type")) == ["classification", "empty", "preference"]
    assert named(label_set.labels) == ["Good", "5", "Extra"]
    assert coded(label_set.keys) == {"1": "Good", "2": "Extra"}


def test_older_document(spark):
    old = rm.label_set_from_json(spark, '{"task_type": "ranking", "labels": ["a"], "hotkeys": {"1": "b"}}')
    assert (old.active_task, named(old.labels, "ranking"), coded(old.keys)) == ("ranking", ["a", "b"], {"1": "b"})
    bare = rm.label_set_from_json(spark, "{}")
    assert bare.active_task == "preference" and values(bare.tasks, "task_type") == ["preference"]
    assert bare.labels.count() == bare.keys.count() == 0
    for bad in ("[]", "{"):
        with pytest.raises(ValueError):
            rm.label_set_from_json(spark, bad)


def test_new_label_set(spark):
    fresh = rm.new_label_set(spark)
    assert named(fresh.labels) == ["high-quality", "low-quality", "needs-review", "skip"]
    assert coded(fresh.keys) == dict(zip("1234", named(fresh.labels)))
    assert named(rm.new_label_set(spark, labels=[" ", ""]).labels) == named(fresh.labels)
    assert len(named(rm.new_label_set(spark, labels=[f" l{i} " for i in range(12)]).labels)) == 12
    assert len(coded(rm.new_label_set(spark, labels=[f"l{i}" for i in range(12)]).keys)) == 9


def test_merge_keeps_tasks_apart(spark):
    one = rm.new_label_set(spark, labels=["a", "b"])
    other = rm.label_set_from_json(
        spark,
        json.dumps({"active_task_type": "classification", "task_profiles": {
            "classification": {"labels": ["p", "q"], "hotkeys": {"7": "p"}},
            "preference": {"labels": ["c"], "hotkeys": {"1": "c"}}}}),
    )
    merged = rm.merge_label_sets(one, other)
    assert merged.active_task == "preference"
    assert named(merged.labels, "preference") == ["a", "b", "c"]
    assert named(merged.labels, "classification") == ["p", "q"]
    assert coded(merged.keys.filter("task_type = 'preference'")) == {"1": "a", "2": "b", "3": "c"}
    # A task only one side knows is taken over as it is.
    assert coded(merged.keys.filter("task_type = 'classification'")) == {"7": "p"}


def test_switching_tasks_and_adding_labels(spark, labels):
    start = rm.new_label_set(spark, labels=["good", "bad"])
    more = rm.with_labels(start, labels(" needs-review ", "GOOD", "Needs-Review"))
    assert named(more.labels, "preference") == ["good", "bad", "needs-review"]
    assert coded(more.keys) == {"1": "good", "2": "bad", "3": "needs-review"}
    other = rm.with_task(more, " classification ")
    assert other.active_task == "classification" and named(other.labels, "classification") == []
    other = rm.with_labels(other, labels("entity-person", task="classification"))
    assert coded(other.keys.filter("task_type = 'classification'")) == {"1": "entity-person"}
    assert named(other.labels, "preference") == named(more.labels)
    with pytest.raises(ValueError, match="Task type cannot be empty"):
        rm.with_task(more, " ")


def test_label_keys_fold_case(spark):
    spelt = ["Straße", "STRASSE", "straẞe", " strasse ", "ΌΔΟΣ", "όδος", "ﬁne", "FINE", "ı", "i", "I", "İ", "ŉ", "ʼN", "K", "k"]
    df = spark.createDataFrame([(s,) for s in spelt], "s string")
    keys = {r.s: r.key for r in df.select("s", rm.label_key(F.col("s")).alias("key")).collect()}
    for a in spelt:
        for b in spelt:
            assert (keys[a] == keys[b]) == (a.strip().casefold() == b.strip().casefold()), (a, b)
