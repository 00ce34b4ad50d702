import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from conftest_llm import EDGES, documents, package_on_workers  # noqa: F401
from hypothesis import given, settings, strategies as st

from rowmark.llm.spelling_variants import _run_hashes, near_words, pivots_of, signature, spelling_variants


def words_of(rows, every=199):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += len(run) >= 6
    return {w: n for w, n in counts.items() if n >= 5}


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, every=199, ratio=5):
    n = words_of(rows, every)
    near = defaultdict(list)
    for a in n:
        near[a] = [b for b in n if abs(len(a) - len(b)) < 2 and one_apart(a, b)]
    best = {w: min(near[w], key=lambda x: (-n[x], x)) for w in n if near[w]}
    form = {w: b for w, b in best.items() if n[b] >= ratio * n[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return sorted((w, form.get(w) or "", root(w), n[w], len(near[w]), n[form[w]] if w in form else -1) for w in n)


def told(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in df.collect())


def texts(rng, count):
    syllables = ["th", "er", "on", "an", "ß", "éa", "st", "x", "ING", "a"]
    base = ["".join(rng.choice(syllables) for _ in range(rng.randrange(3, 7))) for _ in range(60)]
    base += ["aaaaaa", "aaaaaaa", "ababab", "bababa", "abababa", "straße", "×÷×÷×÷"]
    for i in range(count):
        picked = rng.choices(base, weights=[1 / (k + 1) for k in range(len(base))], k=40)
        for k in rng.sample(range(40), 12):
            w = list(picked[k])
            p = rng.randrange(len(w))
            w[p : p + rng.randrange(2)] = rng.choice(["", "a", "é", "q"])
            picked[k] = "".join(w)
        yield i, rng.choice([" ", ", ", "1", "中", "_"]).join(picked)


def test_against_brute_force(documents):
    rng = random.Random(8)
    rows = [*EDGES, *texts(rng, 900)]
    rows += [(i, "corrextion correction") for i in range(5)] + [(i, "correction" * 900) for i in range(6)]
    rows += [(500 + i, "correction") for i in range(40)] + [(700 + i, "correctiom") for i in range(6)]
    rows += [(800 + i, f"{w} {w}") for w, n in (("lettering", 70), ("letterino", 14), ("lettterino", 3)) for i in range(n)]  # a chain
    got = spelling_variants(documents(rows).repartition(4))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = brute(rows)
    assert len(want) > 300 and sum(r[1] != "" for r in want) > 50 and any(r[1] not in ("", r[2]) for r in want)
    assert told(got) == want
    rules = brute(rows, every=3, ratio=2)
    assert told(spelling_variants(documents(rows), ratio=2, every=3)) == rules


def test_empty_tables(documents):
    assert spelling_variants(documents([])).collect() == []
    assert spelling_variants(documents([(1, None), (2, ""), (3, "short words only")])).collect() == []
    lone = spelling_variants(documents([(i, "lonesome") for i in range(5)])).collect()
    assert [(r.form, r.root, r.n_near, r.form_n) for r in lone] == [(None, "lonesome", 0, None)]


def test_run_hashes():
    runs = ["a", "é", "aé" * 20, "x" * 63, "é" * 64, "b" * 65, "ÿ" * 300, "×"]
    data = np.frombuffer("".join(runs).encode("latin-1"), np.uint8)
    length = np.array([len(r) for r in runs])
    states = np.array([zlib.crc32(f"{i}:".encode()) for i in range(len(runs))], np.uint32)
    got = _run_hashes(data, np.cumsum(length) - length, length, states)
    assert got.tolist() == [zlib.crc32(f"{i}:{r}".encode()) for i, r in enumerate(runs)]


@given(st.lists(st.integers(0, 30), min_size=3, max_size=12, unique=True), st.data())
def test_pivots_are_the_cheapest_disjoint_places(places, data):
    places = sorted(places)
    weights = data.draw(st.lists(st.integers(1, 50), min_size=len(places), max_size=len(places)))
    cost = dict(zip(places, weights))
    a, b = pivots_of(places, weights)
    assert b - a >= 2
    assert cost[a] + cost[b] == min(cost[x] + cost[y] for x in places for y in places if y - x >= 2)


@settings(max_examples=400)
@given(st.text("abcé", min_size=6, max_size=14), st.data())
def test_words_one_edit_apart_share_a_key(word, data):
    place, letter = data.draw(st.integers(0, len(word))), data.draw(st.sampled_from(["", *"abcéz"]))
    other = word[:place] + letter + word[place + data.draw(st.integers(0, 1)) :]
    if len(other) < 6 or not one_apart(word, other):
        return
    drawn = data.draw(st.randoms(use_true_random=False))
    frequency = {x + y: drawn.randrange(1, 9) for x in "abcéz" for y in "abcéz"}
    (p, q), (r, s) = signature(word, frequency), signature(other, frequency)
    assert set(p) & set(s) or set(r) & set(q)


def test_each_pair_comes_in_both_directions(spark):
    words = spark.createDataFrame([("abcdef", 5), ("abcdeg", 7), ("abcdefg", 9), ("zzzzzz", 5)], "word string, n long")
    got = sorted(tuple(r) for r in near_words(words).collect())
    pairs = {("abcdef", 5, "abcdeg", 7), ("abcdef", 5, "abcdefg", 9), ("abcdeg", 7, "abcdefg", 9)}
    assert got == sorted(pairs | {(c, d, a, b) for a, b, c, d in pairs})
