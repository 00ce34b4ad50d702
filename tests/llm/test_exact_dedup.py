import hashlib
import os
import random
import re

from conftest_llm import EDGES, documents, package_on_workers, prose  # noqa: F401

from rowmark.llm.exact_dedup import exact_duplicates, fold


def brute(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text or ""), []).append(doc_id)
    out = []
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        digest = hashlib.sha256(text.encode()).hexdigest()
        left = 1
        for i in sorted(ids, key=lambda i: (i is None, i)):
            out.append((i, keep, len(ids), bool(left), digest))
            left = 0
    return sorted(out, key=str)


def test_against_brute_force(documents):
    rng = random.Random(3)
    rows = EDGES + [(100 + i, prose(rng.randrange(12), 30).replace(" ", rng.choice([" ", "  ", "\n"]))) for i in range(150)]
    got = exact_duplicates(documents(rows).repartition(5)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_empty_table(documents):
    assert exact_duplicates(documents([])).collect() == []


def test_spills_in_levels_and_leaves_nothing(tmp_path):
    rng = random.Random(5)
    texts = [str(rng.randrange(300)).encode() * 20 for _ in range(2000)]
    items = [(i, t, (False, i, i), 1) for i, t in enumerate(texts)]
    got = sorted((sorted(reps), first[1], size) for reps, first, size in fold(iter(items), str(tmp_path), 2000))
    expected = {}
    for i, t in enumerate(texts):
        expected.setdefault(t, []).append(i)
    assert got == sorted((v, v[0], len(v)) for v in expected.values())
    assert not [f for _, _, files in os.walk(tmp_path) for f in files]
