from conftest_llm import package_on_workers  # noqa: F401

from rowmark.llm.url_filter import RULES, filter_urls, host_edges, personal_rank

ROWS = [
    (1, "http://A.Example.org/es/1", ""), (2, "https://example.org/en/1?x", ""), (3, "https://example.org/en/2", ""),
    (4, "http://x.com/fr/a#b", ""), (5, "http://x.com/de/", ""), (6, "http://notexample.net", ""), (7, None, None),
    (8, "no scheme", ""), (9, "ftp://org", ""), (10, "http://a.org:80/x", ""), (11, "http://x.com?/fr/", ""), (1, "http://A.Example.org/es/1", ""),
]


def pages(spark, rows):
    return spark.createDataFrame([(*r, None) for r in rows], "page_id long, url string, html string, verdict string")


def expected(url):
    rest = url.split("://", 1)[1] if url and "://" in url else None
    if rest is None:
        return "", "", None, "allow"
    end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, tail = rest[:end].lower(), rest[end:]
    path = tail[: min((tail.find(c) for c in "?#" if c in tail), default=len(tail))]
    fits = [r for r in RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    best = max(fits, key=lambda r: len(r[1] + r[2]), default=None)
    return host, path, best and best[1] + best[2], best[0] if best else "allow"


def test_rules(spark):
    got = filter_urls(pages(spark, ROWS)).select("page_id", "host", "path", "rule", "verdict").collect()
    assert sorted(map(tuple, got), key=str) == sorted(((i, *expected(u)) for i, u, _ in ROWS), key=str)
    assert filter_urls(pages(spark, [])).collect() == []


def brute_rank(edges, seeds, steps, damping=0.85):
    rank = {h: m * (1 - damping) for h, m in seeds.items()}
    total = {}
    for s, _, n in edges:
        total[s] = total.get(s, 0) + n
    for _ in range(steps):
        new = {h: m * (1 - damping) for h, m in seeds.items()}
        for s, d, n in edges:
            if s in rank:
                new[d] = new.get(d, 0) + rank[s] * n / total[s] * damping
        rank = new
    return rank


def test_rank_against_brute_force(spark):
    edges = [("a", "b", 3), ("b", "c", 1), ("c", "a", 1), ("b", "d", 1), ("d", "b", 2), ("e", "a", 1)]
    seeds = {"a": 1.0, "e": 0.5}
    got = personal_rank(
        spark.createDataFrame(edges, "src string, dst string, links long"),
        spark.createDataFrame(list(seeds.items()), "host string, mass double"), 6,
    )
    found = {r.host: r["rank"] for r in got.collect()}
    want = brute_rank(edges, seeds, 6)
    assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-12 for k in want)


def test_distrust_flows_against_links(spark):
    link = '<p><A class=x HREF="http://{}/q">x</a> <a href=/local>y</a>'
    rows = [
        (1, "http://bad.com/de/x", link.format("other.net")), (2, "http://suspect.net/a", link.format("bad.com")),
        (3, "http://fine.org/a", link.format("neutral.net")), (4, "http://neutral.net/a", ""), (5, "http://other.net/a", ""),
    ]
    assert {(r.src, r.dst) for r in host_edges(pages(spark, rows)).collect()} == {
        ("bad.com", "other.net"), ("suspect.net", "bad.com"), ("fine.org", "neutral.net")
    }
    got = {r.page_id: r.verdict for r in filter_urls(pages(spark, rows)).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow"}


def test_native_plan(spark):
    assert "Python" not in filter_urls(pages(spark, ROWS))._jdf.queryExecution().toString()
