import hashlib
import random
from collections import Counter

from conftest_llm import EDGES, documents, package_on_workers, prose  # noqa: F401

from rowmark.llm.substring_dedup import repeated_words


def brute(rows, window):
    texts = [(i, (t or "").encode().split()) for i, t in rows]
    seen = Counter(tuple(w[k : k + window]) for _, w in texts for k in range(len(w) - window + 1))
    out = []
    for i, w in texts:
        gone = set()
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone.update(range(k, k + window))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_against_brute_force(documents):
    rng = random.Random(9)
    shared = [prose(i, 60, 5) for i in range(3)] + ["a b c d e f g h i j k l"]
    rows = [(i, t) for i, t in EDGES if i != 6] + [(6, "word " * 3000)]
    rows += [(100 + i, f"{prose(i, rng.randrange(30), 4)} {rng.choice(shared)} {prose(900 + i, 9)}") for i in range(150)]
    got = repeated_words(documents(rows).repartition(3), 9, 3)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, 9)


def test_default_window_and_empty_table(documents):
    rows = [(1, prose(1, 60)), (2, "start " + prose(1, 60)), (3, prose(2, 90)), (4, None), (4, None)]
    assert sorted(map(tuple, repeated_words(documents(rows)).collect()), key=str) == brute(rows, 35)
    assert repeated_words(documents([])).collect() == []
