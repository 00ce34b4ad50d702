"""Texts made to break hashes and scanners."""

import time

import pytest
from conftest_llm import documents, package_on_workers, prose  # noqa: F401
from test_url_filter import pages

from rowmark.llm.decontamination import contamination
from rowmark.llm.html_text import blocks
from rowmark.llm.near_dedup import near_duplicates
from rowmark.llm.substring_dedup import repeated_words
from rowmark.llm.url_filter import host_edges

#: Words of 64 to 4,096 letters in the pattern abba baab..., and with the letters exchanged.
PATTERNS = [("ab", "ba")]
for _ in range(11):
    PATTERNS.append((PATTERNS[-1][0] + PATTERNS[-1][1], PATTERNS[-1][1] + PATTERNS[-1][0]))
PATTERNS = PATTERNS[5:]


def test_alternating_long_words_differ(spark, documents):
    rest = [f"w{i}" for i in range(34)]
    rows = []
    for k, (one, other) in enumerate(PATTERNS):
        rows += [(2 * k, " ".join([one, *(f"{k}{w}" for w in rest)])), (2 * k + 1, " ".join([other, *(f"{k}{w}" for w in rest)]))]
    got = repeated_words(documents(rows)).collect()
    assert [r.n_removed for r in got] == [0] * len(rows)
    near = near_duplicates(documents([(i, w) for i, pair in enumerate(PATTERNS) for w in (f"{pair[0]} a b c d", f"{pair[1]} a b c d")]))
    copies = documents([(2 * k + j, f"{w} a b c d") for k, pair in enumerate(PATTERNS) for j, w in enumerate(pair)])
    assert near.count() == 2 * len(PATTERNS)
    assert all(r.doc_id == r.component_id for r in near_duplicates(copies).collect())
    items = spark.createDataFrame([(str(k), f"{pair[0]} b") for k, pair in enumerate(PATTERNS)], "item_id string, text string")
    hit = contamination(documents([(k, f"{pair[1]} b") for k, pair in enumerate(PATTERNS)]), items).collect()
    assert [r.n_hit for r in hit] == [0] * len(PATTERNS)


BROKEN = ["<a ", '<a "', "<a '", "<", "<!", "<!--", "<![CDATA[", "<p <", "</", "<script", "&", '<a href="//x.y/', "<a href = ", "<a x='\" "]


@pytest.mark.parametrize("part", BROKEN)
@pytest.mark.parametrize("end", ["", ">", '">', "<p>after</p>"])
def test_broken_html_is_read_in_linear_time(part, end):
    start = time.time()
    blocks(part * (1_000_000 // len(part)) + end)
    assert time.time() - start < 6


def test_broken_html_is_searched_for_links_in_linear_time(spark):
    rows = [(i, "http://a.b/", part * (200_000 // len(part))) for i, part in enumerate(BROKEN)]
    start = time.time()
    host_edges(pages(spark, rows)).collect()
    assert time.time() - start < 30


def test_links_between_hosts(spark):
    html = (
        '<a href="//b.c/x">1</a><A HREF = \'http://D.e\'>2</A><!-- <a href="http://no.one/"> --><script>x = "<a href=\'http://no.one/\'>"</script>'
        '<a class="x" href=https://f.g/>3</a><a href="/own">4</a><abbr href="http://no.one/">5</abbr><a\nhref="http://d.e/y">6</a><!-- <a href="http://no.one/">'
    )
    got = host_edges(pages(spark, [(1, "http://a.b/", html)])).collect()
    assert sorted(map(tuple, got)) == [("a.b", "b.c", 1), ("a.b", "d.e", 2), ("a.b", "f.g", 1)]


def test_text_behind_the_last_tag():
    def text(html):
        return " ".join(b.text for b in blocks(html))

    assert text("<p>one</p> two <b three") == text("<p>one</p> two &lt;b three")
    assert text("<p>one</p> two <!-- three") == text("<p>one</p> two ")
    assert text("<p>one</p><!-- a > b") == text("<p>one</p>")
    assert text("no tag at all") == "no tag at all"
