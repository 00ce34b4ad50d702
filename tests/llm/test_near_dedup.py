import math
import random
import re

import numpy as np
import pyarrow as pa
from conftest_llm import EDGES, documents, package_on_workers, prose  # noqa: F401

from rowmark.llm._common import mixed
from rowmark.llm._components import components
from rowmark.llm.near_dedup import BANDS, MARGIN, PLACES, NearDuplicates, _Block, _near, near_duplicates, super_minhash


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else [])


def brute(rows, percent=85):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    out = []
    for i, (doc_id, _) in enumerate(rows):
        component = least.get(find(i)) if sets[i] else doc_id
        out.append((doc_id, len(sets[i]), component, doc_id == component))
    return sorted(out, key=str)


def edited(text, edits, rng):
    w = text.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return " ".join(w)


def test_against_brute_force(documents):
    rng = random.Random(11)
    bases = [prose(i, 300, 5000) for i in range(4)]
    rows = list(EDGES) + [(100 + i, edited(rng.choice(bases), rng.randrange(9), rng)) for i in range(160)]
    rows += [(400, rows[-1][1].upper().replace(" ", "\n")), (401, "a b c d"), (402, "A  b c D")]
    got = near_duplicates(documents(rows).repartition(4))
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)
    assert near_duplicates(documents([])).collect() == []


def naive_super_minhash(elements, places):
    """One element after the other, without early stopping."""
    out = [0xFFFFFFFF] * places
    for e in elements:
        order = list(range(places))
        for j in range(places):
            drawn = int(mixed(np.array([(int(e) + (j + 1) * 0x9E3779B97F4A7C15) & (2**64 - 1)], np.uint64))[0])
            k = j + (drawn & 0xFFFFFFFF) % (places - j)
            order[j], order[k] = order[k], order[j]
            out[order[j]] = min(out[order[j]], j << 24 | drawn >> 40)
    return out


def test_signature_equals_the_naive_one():
    rng = np.random.default_rng(1)
    sets = [rng.integers(0, 2**63, n).astype(np.uint64) for n in (0, 1, 2, 7, 40, 300)]
    got = super_minhash(sets, 24)
    assert [list(map(int, r)) for r in got] == [naive_super_minhash(s, 24) for s in sets]


def test_signature_estimates_similarity():
    rng = np.random.default_rng(2)
    both = rng.integers(0, 2**63, 700).astype(np.uint64)
    errors = []
    for k in range(20):
        a = mixed(both[:600] + np.uint64(k))
        b = mixed(both[100:] + np.uint64(k))
        x, y = super_minhash([a, b], 140)
        errors.append((x == y).mean() - 500 / 700)
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.06


def test_components(spark):
    chain = [(i, i + 1) for i in range(30)] + [(100, 101), (7, 7), (200, 100)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 101: 100, 200: 100}


def test_small_tables_are_written_in_few_files(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        edges = spark.createDataFrame([(i, i // 2) for i in range(1, 300)], "u long, v long")
        found = components(edges)
        assert len(found.inputFiles()) == 1 and {r.root for r in found.collect()} == {0}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", was)


def test_signatures_move_only_for_documents_that_meet(documents):
    text = prose(1, 60)
    rows = [(1, text), (2, text + " more"), (3, prose(2, 60)), (4, text + " more")]
    found = NearDuplicates(documents(rows), 85)
    assert set(found.nodes.columns) == {"node", "doc_key", "text_key", "n", "bands"} and found.nodes.count() == 3
    _, central = found.buckets()
    sets = found.sets_of(central, central.count())
    assert {r.n for r in sets.collect()} == {56, 57} and {"signature", "band_keys"} < set(sets.columns)


def test_later_links_join_the_components_of_earlier_ones(spark, documents):
    found = NearDuplicates(documents([]), 85)
    roots = spark.createDataFrame([(i, i) for i in range(8)], "node long, root long")
    for links in ([(1, 2), (5, 6)], [], [(6, 2), (7, 5)]):
        roots = found.linked(roots, spark.createDataFrame(links, "u long, v long"), 8)
    assert {r.node: r.root for r in roots.collect()} == {0: 0, 1: 1, 2: 1, 3: 3, 4: 4, 5: 1, 6: 1, 7: 1}


def test_signatures_seldom_drop_a_pair_at_the_threshold():
    for p in (0.80, 0.85):
        least = math.ceil((p - MARGIN) * PLACES - 1e-9)
        assert sum(math.comb(PLACES, k) * p**k * (1 - p) ** (PLACES - k) for k in range(least)) < 1e-7
    one = np.arange(PLACES, dtype=np.uint16)
    other = np.where(np.arange(PLACES) < 98, one, one + 1).astype(np.uint16)  # agree in 0.7 of the places
    columns = {"hub": [1], "node": [2], "signature": [one.tobytes()], "hub_signature": [other.tobytes()]}
    assert [b.num_rows for b in _near(0.85 - MARGIN)([pa.RecordBatch.from_pydict(columns)])] == [1]


def test_first_common_band_is_told_by_band_hashes():
    signature, bands = np.arange(PLACES, dtype=np.uint16).tobytes(), np.arange(BANDS, dtype=np.int64)
    other = np.where(bands == 3, bands, bands + 1000)  # the places of band 0 are equal only once folded
    group = {
        "is_stray": [True, False], "node": [1, 2], "root": [1, 2], "n": [50, 50], "signature": [signature, signature],
        "band_keys": [bands.tobytes(), other.tobytes()], "band": [3, 3],
    }
    assert [(x, some.tolist()) for x, some in _Block(group).close(0.65, 0.85)] == [(0, [1])]
