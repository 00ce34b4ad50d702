import itertools
import tracemalloc
import zlib

import numpy as np
from conftest_llm import EDGES, documents, package_on_workers, prose  # noqa: F401

from rowmark.llm.toxicity import Landmarks, Machine, _codes, learn, letters_of, subsequence_kernel, toxicity, words_of


def naive_kernel(s, t, length=3, decay=0.5):
    total = 0.0
    for a in itertools.combinations(range(len(s)), length):
        for b in itertools.combinations(range(len(t)), length):
            if all(s[i] == t[j] for i, j in zip(a, b, strict=True)):
                total += decay ** (a[-1] - a[0] + 1 + b[-1] - b[0] + 1)
    return total


def test_kernel_against_brute_force():
    words = ["idiot", "idxiot", "tiodi", "aaaa", "moron", "id", "abcabc"]
    pairs = list(itertools.product(words, words))
    got = subsequence_kernel(_codes([a for a, _ in pairs], 8), _codes([b for _, b in pairs], 8))
    assert np.allclose(got, [naive_kernel(a, b) for a, b in pairs], rtol=1e-4)


def test_kernel_works_on_the_letters_not_on_the_padding():
    words = ["idiot", "moron", "ab", "", "idxiot"] * 200
    narrow = subsequence_kernel(_codes(words, 6), _codes(words[::-1], 6))
    s, t = _codes(words, 400), _codes(words[::-1], 400)
    tracemalloc.start()
    wide = subsequence_kernel(s, t)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.array_equal(narrow, wide) and peak < 1_000_000
    assert subsequence_kernel(s[:0], t[:0]).shape == (0,) and not subsequence_kernel(s[3:4], t[3:4]).any()


def test_words_of_all_lengths_are_compared_alike_one_by_one_and_together():
    marks = Landmarks(["idiot", "scum", "disgusting"])
    words = ["idiot", "idiots", "scummy", "sc-um", "disgustingly", "d1sgusting", "idio" * 9, "table", "\U0001F600abc", ""]
    together = marks.similar(words)
    for word in words:
        alone = marks.similar([word])
        assert alone.keys() == together.keys() & {word}
        assert all(np.array_equal(alone[w], together[w]) for w in alone)


def test_gapped_and_inserted_letters_resemble():
    marks = Landmarks(["idiot"])
    near = marks.similar(["idxiot", "id1ot", "i-d-i-o-t", "idiots", "table", "of"])
    assert near["idiots"][0] > 0.9 and near["i-d-i-o-t"][0] > 0.9 and near["idxiot"][0] > 0.05
    assert "table" not in near and "of" not in near
    assert "idiot" in {letters_of(w) for w in words_of("you i d i o t !")}


def table(n=400):
    rows, labels = [], []
    for i in range(n):
        toxic = i % 8 == 0
        rows.append((i, prose(i, 40) + (f" {('scumbag', 'moron')[i % 3 % 2]} w1" if toxic else "")))
        labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_accuracy_and_edges(spark, documents):
    rows, labels = table()
    rows += [(1000, "what a mo-ron"), (1001, "what a s c u m b a g he is"), *((i, t) for i, t in EDGES)]
    marks = spark.createDataFrame([*labels, (1, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity(documents(rows), marks).collect()
    assert len(got) == len(rows)
    truth = dict(labels)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    scored = {r.doc_id: r.predicted for r in got if r.doc_id in truth and r.held_out}
    assert np.mean([scored[i] == truth[i] for i in scored]) > 0.98
    assert {r.predicted for r in got if r.doc_id in (1000, 1001)} == {1}
    assert {r.predicted for r in got if r.doc_id is None} == {0}


def test_labels_of_held_out_rows_are_never_used(spark, documents):
    rows, labels = table(200)
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, y in labels]
    scores = []
    for marks in (labels, flipped):
        got = toxicity(documents(rows), spark.createDataFrame(marks, "doc_id long, toxic int"))
        scores.append(sorted((r.doc_id, r.score) for r in got.collect()))
    assert scores[0] == scores[1]


def test_without_both_classes(spark, documents):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert learn(documents(EDGES), none) == 0.5
    clean = spark.createDataFrame([(1, 0), (2, 0), (3, 0)], "doc_id long, toxic int")
    assert {r.predicted for r in toxicity(documents(EDGES), clean).collect()} == {0}
    assert toxicity(documents([]), clean).collect() == []


def test_sample_bound(spark, documents):
    rows, labels = table(300)
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    assert isinstance(learn(documents(rows), marks, sample_rows=120), Machine)
