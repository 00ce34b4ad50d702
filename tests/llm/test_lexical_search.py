import math
import random
import re
from collections import Counter

import numpy as np
from conftest_llm import EDGES, documents, package_on_workers, prose  # noqa: F401

from rowmark.llm.lexical_search import Shard, rank_documents


def terms(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)


def brute(items, rows, k=20):
    docs = [(doc_id, Counter(terms(text))) for doc_id, text in rows]
    docs = [(doc_id, c, c.total()) for doc_id, c in docs if c]
    n_docs, n_terms = len(docs), sum(n for _, _, n in docs)
    out = []
    for item, text in sorted(set(items), key=str):
        scores = []
        for doc_id, counts, n in docs:
            m, score = 75 + 25 * n * n_docs // n_terms, 0
            for term in terms(text):
                if tf := counts[term]:
                    df = sum(term in c for _, c, _ in docs)
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
                    score += w * (1000000000 * tf // (1000 * tf + 12 * m))
            if score:
                scores.append((-score, doc_id is None, doc_id or 0))
        for rank, (score, null, doc_id) in enumerate(sorted(scores)[:k], 1):
            out.append((item, rank, None if null else doc_id, -score))
    return sorted(out, key=str)


def told(df):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect()), key=str)


def items_of(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "item_id string, text string, row int, term int, value int")


def test_against_brute_force(spark, documents):
    rng = random.Random(3)
    rows = [*EDGES, *((100 + i, prose(i, rng.randrange(1, 300), 120)) for i in range(150))]
    rows += [(300 + i, rows[-1][1]) for i in range(60)]  # a group of copies: ties by id
    rows += [(i % 7, "Été ÉTÉ w1 w2-w3 W4_w5") for i in range(30)]
    items = [("a", prose(5, 30, 120)), ("b", rows[-60][1]), ("b", "w1 w1 w2"), ("c", "a B c word été 7"), ("c", "a B c word été 7")]
    items += [("d", None), (None, "x y w4"), ("e", ""), ("f", "unheard of"), ("g", "é" * 3)]
    df = documents(rows).repartition(5)
    want = brute(items, rows)
    assert told(rank_documents(items_of(spark, items), df)) == want
    assert told(rank_documents(items_of(spark, items), df, shard_postings=300)) == want
    assert told(rank_documents(items_of(spark, items), df, k=3, shard_postings=100)) == brute(items, rows, 3)


def test_empty_tables(spark, documents):
    items = items_of(spark, [("a", "x y")])
    assert rank_documents(items, documents([])).collect() == []
    assert rank_documents(items, documents([(1, None), (2, "-")])).collect() == []
    assert rank_documents(items_of(spark, []), documents(EDGES)).collect() == []


def test_intervals_against_all_scores():
    rng = np.random.default_rng(1)
    for size, lists in ((1, 1), (40, 3), (500, 8), (3000, 20)):
        held = rng.random((lists, size)) < rng.uniform(0.02, 0.9, (lists, 1))
        term, doc = np.nonzero(held)
        value = rng.integers(1, 50, len(term))
        order = rng.permutation(len(term))
        shard = Shard(doc[order], 10 + 3 * term[order], value[order], size)
        times = rng.integers(1, 4, lists)
        dense = np.zeros((lists, size), int)
        dense[term, doc] = value
        scores = (dense * times[:, None]).sum(0)
        want = [(int(scores[d]), int(d)) for d in np.lexsort((np.arange(size), -scores))[:20] if scores[d]]
        assert shard.best(10 + 3 * np.arange(lists), times, 20) == want
        assert shard.best(np.array([1, 2]), np.array([1, 1]), 20) == []
