import pytest

from conftest_llm import package_on_workers  # noqa: F401

from rowmark.llm.html_text import Node, Reader, absorb, blocks, from_json, main_text, matching, to_json, tree_of


def read(page):
    return Reader(None).text(page)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<nav>menu</nav><article><h1>Title</h1><p>One <b>two</b>\n three.<p>Four&amp;five</article><footer>f</footer>", "Title One two three. Four&five"),
        ("<article><p><b>Open bold.<br><p>Next</p></article>", "Open bold. Next"),
        ("<article>a<script>var x='</article>';</script><style>p{}</style>b</article>", "ab"),
        ("<article><p>x</p><div class='ad-box'>buy</div><section class=comments><p>nice</p></section><p>y</p></article>", "x y"),
        ("<article><header><p>by me</p><h2>Head</h2></header><p>z</p><footer>tags</footer></article>", "Head z"),
        ("<main><p>m</p><article><p>a</p></article></main>", "a"),
        ("<div role=main>m<form>f</form></div><div>other</div>", "m"),
        ("<body><div class=sidebar>s</div><div>text &lt;b&gt; &#233;</div><!-- no --></body>", "text <b> é"),
        ("<article><ul><li>one<li>two</ul><table><tr><td>c1<td>c2</table></article>", "one two c1 c2"),
        ("<p hidden>no</p><p style='display: none'>no</p><p>yes", "yes"),
        ("a < b and c > d", "a < b and c > d"),
        ("<div class='with-sidebar'><nav>n</nav><p>all of it</p></div>", "all of it"),
        ("<a href='x>y'>link</a> <unclosed", "link <unclosed"),
        ("", ""),
        ("<script>never closed", ""),
        ("<!-- open", ""),
    ],
)
def test_single_pages(page, text):
    assert read(page) == text


def test_simple_tree_matching():
    def tree(spec):
        return Node({k: tree(v) for k, v in spec.items()})

    a = tree({"nav": {}, "div.x": {"p": {}, "ul": {"li": {}}}, "footer": {}})
    b = tree({"header": {}, "div.y": {"p": {}, "ul": {}}, "footer": {}})
    size, pairs = matching(a, b)
    assert pairs == [("div.x", "div.y"), ("footer", "footer")] and size == 3.5
    assert matching(a, a)[0] == a.size()


def pages_of_a_site(n):
    return [
        f"<div class=top>Site name</div><div class=c{i % 2}><p>Story {i} begins here with many words.</p><p>And goes on {i * i}.</p>"
        f"<p class=note>Terms apply to all stories.</p></div><div class=end>All rights</div>"
        for i in range(n)
    ]


def test_constant_nodes_are_template():
    wrapper = Node()
    for page in pages_of_a_site(6):
        absorb(wrapper, tree_of(blocks(page)))
    wrapper = from_json(to_json(wrapper))
    reader = Reader(wrapper)
    assert reader.text(pages_of_a_site(6)[4]) == "Story 4 begins here with many words. And goes on 16."


def test_table(spark):
    rows = [(i, f"http://site.net/{i}", p, None) for i, p in enumerate(pages_of_a_site(9))]
    rows += [(20, None, None, None), (21, "x", "", None), (22, "http://alone.org/", "<article>é <b>x</b></article>", None)]
    rows += [(23, "http://deep.org/", "<div>" * 3000 + "deep", None), (22, "http://alone.org/", "<article>é <b>x</b></article>", None)]
    schema = "page_id long, url string, html string, host string"
    got = sorted(map(tuple, main_text(spark.createDataFrame(rows, schema).repartition(3)).collect()))
    texts = {r[0]: r[2] for r in got}
    assert len(got) == len(rows)
    assert all(texts[i] == f"Story {i} begins here with many words. And goes on {i * i}." for i in range(9))
    assert texts[20] == texts[21] == "" and texts[22] == "é x" and texts[23] == "deep"
    assert all(r[3] == len(r[2]) for r in got)
    assert main_text(spark.createDataFrame([], schema)).collect() == []


LONG = "a story of many words that goes on for a while"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<p>(c) 2026</p><div class='layout sidebar-right'><article>{LONG}</article></div>", LONG),
        (f"<p>(c)</p><article class='post has-related'><p>{LONG}</p><div class=ad>buy</div><div class=comments>nice</div></article>", LONG),
        (f"<p>(c)</p><main class=social-news><article class='post has-related'>{LONG}</article><div class=share>x</div></main>", LONG),
        (f"<p>(c)</p><div class='content with-sidebar'><div class=sidebar>menu</div><p>{LONG}</p></div>", f"(c) {LONG}"),
        (f"<div class=layout-sidebar-right><div class=ad>buy</div><p>{LONG}</p></div>", LONG),
        (f"<main><article>{LONG}</article><div class=comments><article class=comment>nice</article></div></main>", LONG),
        (f"<article><h1>Head</h1><div class='body with-sidebar'>{LONG}<div class=ad>buy</div></div></article>", f"Head {LONG}"),
        (f"<main><p>{LONG}</p><div class=related><article>next</article></div></main>", LONG),
        ("".join(f"<article class='post has-related'>{i} {LONG}</article>" for i in range(2)) + "<p>x</p>", f"0 {LONG} 1 {LONG}"),
        (f"<p>{LONG}</p><div class=comments><div class=comment>{LONG}</div><div class=comment>{LONG}</div></div>", LONG),
    ],
)
def test_class_words_of_the_layout(page, text):
    assert read(page) == text


def wrapper_of(pages):
    wrapper = Node()
    for page in pages:
        absorb(wrapper, tree_of(blocks(page)))
    return from_json(to_json(wrapper))


def test_copies_of_a_page_are_no_template():
    plain = [f"<article><p>Story {i}.</p></article>" for i in range(4)]
    table = "<article><p>Story with a table.</p><table><tr><td>only here</table></article>"
    assert Reader(wrapper_of(plain + [table] * 7)).text(table) == "Story with a table. only here"
    same = [p.replace("</article>", "<ul><li>tags</ul></article>") for p in plain]
    assert Reader(wrapper_of(same * 3)).text(same[0]) == "Story 0. tags"
    five = [*same, "<article><p>Fifth.</p><ul><li>tags</ul></article>"]
    assert Reader(wrapper_of(five)).text(five[4]) == "Fifth."
    bare = [f"<div><p>Story {i}.</p></div>" for i in range(4)]
    listed = "<div><p>Story with a list.</p><ul><li>only here, and of some length</ul></div>"
    assert Reader(wrapper_of(bare + [listed] * 2)).text(listed) == "Story with a list. only here, and of some length"
