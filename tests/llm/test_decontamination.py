import hashlib
import random
import re

from conftest_llm import EDGES, documents, package_on_workers, prose  # noqa: F401

from rowmark.llm.decontamination import contamination


def words(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def brute(rows, items):
    out = []
    for doc_id, text in rows:
        doc, hit, found = words(text), set(), set()
        for item, body in items:
            w = words(body)
            n = min(10, len(w))
            grams = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
            for i in range(len(doc) - n + 1 if n else 0):
                if tuple(doc[i : i + n]) in grams:
                    hit.update(range(i, i + n))
                    found.add("" if item is None else str(item))
        ids = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc_id, len(doc), len(hit), len(found), ids, bool(hit)))
    return sorted(out, key=str)


def test_against_brute_force(spark, documents):
    rng = random.Random(7)
    items = [(i, prose(500 + i, rng.randrange(8, 60), 50)) for i in range(12)]
    items += [(20, "zeta omega"), (21, ""), (22, None), (None, prose(77, 12)), (3, prose(78, 14)), (23, prose(503, 11, 50))]
    rows = list(EDGES)
    for i in range(60):
        item = items[rng.randrange(12)][1].split()
        low = rng.randrange(max(1, len(item) - 12))
        rows.append((100 + i, " ".join([prose(i, 20, 50), *item[low : low + rng.choice([9, 10, 11, 30])], prose(i + 900, 20, 50), rng.choice(["", "Zeta, OMEGA"])])))
    rows.append((300, items[3][1].upper().replace(" ", " -- ")))
    table = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, doc_id int")
    for slice_bytes in (1 << 23, 700):
        got = contamination(documents(rows), table, slice_bytes).collect()
        assert sorted(map(tuple, got), key=str) == brute(rows, items)


def test_empty_tables(spark, documents):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_words, r.contaminated) for r in contamination(documents([(1, "a b")]), none).collect()] == [(2, False)]
    some = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert contamination(documents([]), some).collect() == []
