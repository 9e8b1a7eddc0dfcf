import random
from html.parser import HTMLParser
from urllib.parse import urljoin

from fixtures import empty
from pyspark.sql import functions as F

from grainsift.llm import redirects as R
from grainsift.llm.components import connected_components


def brute(edges, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        parent[max(a, b)] = min(a, b)
    return {n: min(m for m in nodes if find(m) == find(n)) for n in nodes}


def test_components(spark):
    rng = random.Random(4)
    for n, m in ((30, 20), (60, 70)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
        rows = [*edges, edges[0], (5, None), (None, None), (7, 7)]
        got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(rows, "u long, v long")).collect()}
        nodes = {x for r in rows for x in r if x is not None}
        assert got == brute([e for e in edges], nodes)
    chain = spark.range(200).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert {r["component"] for r in connected_components(chain).collect()} == {0}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_normal_urls(spark):
    urls = ["HTTP://WWW.A.example/x/?utm_source=f&b=1#t", "https://a.example/x?b=1", "http://m.a.example:80/x?b=1&ref=z", "mailto:x", ""]
    got = [r["n"] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(R.normal_url(F.col("u")).alias("n")).collect()]
    assert got == ["https://a.example/x?b=1"] * 3 + ["mailto:x", ""]


def test_decisions(spark):
    bad, ok = "https://spam-farm.example.org/de/1", "https://spam-farm.example.org/en/7"
    html = f'<html><link rel="canonical" href="{bad}"></html>'
    refresh = '<meta http-equiv="refresh" content="0; url=http://chain.example/b">'
    rows = [
        (1, "http://alias.example/a", html), (2, "https://alias.example/a#x", ""), (3, bad, None), (4, ok, ""), (5, "http://other.example/", "<p>"),
        (6, "http://far.example/c", refresh), (7, "https://chain.example/b", html), (8, None, html), (9, "", ""), (1, "http://alias.example/a", html),
        (10, "https://sub.cheap-pills.example.com/", None),
    ]
    pages = spark.createDataFrame([(*r, "n", "d") for r in rows], "page_id long, url string, html string, node string, decision2 string")
    got = [(r["page_id"], r["decision"], r["component"]) for r in R.decide(pages).collect()]
    assert len(got) == len(rows)
    decisions = {i: d for i, d, _ in got}
    assert decisions == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "none", 6: "block", 7: "block", 8: "none", 9: "none", 10: "block"}
    component = {i: c for i, _, c in got}
    assert component[1] == component[2] == component[3] == component[6] == component[7] is not None
    assert component[8] is None and component[9] is None


SPELLINGS = [
    '<link rel="canonical" href="{}">', '<link href="{}" rel="canonical"/>', "<LINK HREF='{}' REL='Canonical' />", "<link rel=canonical href={}>", '<link\n  data-x="a>b rel=x" href = "{}"\n rel = "nofollow canonical">',
    '<meta http-equiv="refresh" content="0; url={}">', '<meta content="5;URL={}" http-equiv="Refresh">', "<meta http-equiv=refresh content='0;url=\"{}\"'>", '<meta content="0; url=\'{}\'" http-equiv=refresh>',
]
LINKS = ["https://spam-farm.example.org/de/1", "//other.example/b?c=1", "/root", "next/page", "../up", "./same", "?q=2", "../../a/./b"]


class Reader(HTMLParser):
    """What the standard parser reads."""

    def __init__(self):
        super().__init__()
        self.found = []

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag == "link" and "canonical" in a.get("rel", "").lower().split():
            self.found.append(a["href"])
        if tag == "meta" and a.get("http-equiv", "").lower() == "refresh":
            self.found.append(a["content"].split("=", 1)[1].strip("'\""))


def test_spellings_of_links(spark):
    base = "https://page.example/dir/sub/index"
    html = [f"<html><head><title>t</title>{s.format(x)}</head><body></body></html>" for s in SPELLINGS for x in LINKS]
    html += [f"<!-- {SPELLINGS[0].format('/no')} --><script>var t = '{SPELLINGS[5].format('/no')}';</script>", '<link rel="stylesheet" href="/s">', '<meta name="refresh" content="0; url=/x">', "canonical"]
    pages = spark.createDataFrame([(f"{base}{i}", h) for i, h in enumerate(html)], "url string, html string")
    want = []
    for i, h in enumerate(html):
        reader = Reader()
        reader.feed(h)
        want += [(f"{base}{i}", urljoin(f"{base}{i}", x)) for x in reader.found]
    assert len(want) == len(SPELLINGS) * len(LINKS)
    normal = spark.createDataFrame(want, "u string, t string").select("u", R.normal_url(F.col("t")).alias("v"))
    assert sorted(map(tuple, R.link_edges(pages).collect())) == sorted(map(tuple, normal.collect()))


def test_empty(spark):
    pages = empty(spark).selectExpr("doc_id page_id", "text url", "text html")
    assert R.decide(pages).count() == 0
    given = R.decide(spark.createDataFrame([("x",)], "url string"), spark.createDataFrame([("x", "https://spam-farm.example.org/"), (None, "x")], "u string, v string"))
    assert given.first()["decision"] == "block"


def test_http_redirects(spark):
    rows = [
        ("http://www.a.example/x", "HTTP/1.1 301 Moved Permanently\r\nLocation: https://b.example/y/\r\nServer: s"), ("https://b.example/y", "HTTP/2 302\r\nlocation: ../z?q=1  "), ("https://c.example/", "HTTP/1.1 200 OK\r\nLocation: /never"),
        ("https://d.example/", "HTTP/1.1 308 Permanent Redirect\r\nX-Location: /no"), ("https://e.example/loop", "HTTP/1.0 307 Temporary\r\nLocation: /loop"), ("https://f.example/", None), (None, "HTTP/1.1 301 M\r\nLocation: /x"), ("", "HTTP/1.1 301 M\r\nLocation: /x"),
        ("https://b.example/y", "HTTP/2 302\r\nlocation: ../z?q=1  "),
    ]
    responses = spark.createDataFrame([(*r, "h") for r in rows], "target_uri string, http_headers string, HTTP_HEADERS string")
    edges = R.response_edges(responses)
    got = {tuple(r) for r in edges.collect()}
    assert {("http://www.a.example/x", "https://a.example/x"), ("https://a.example/x", "https://b.example/y"), ("https://b.example/y", "https://b.example/z?q=1")} <= got
    assert not {u for u, v in got if "never" in v or "no" == v[-2:]}
    assert ("https://e.example/loop", "https://e.example/loop") not in got
    pages = spark.createDataFrame([(u,) for u, _ in rows], "url string")
    found = {r["url"]: r["decision"] for r in R.decide(pages, edges, hosts=("b.example",), prefixes=()).collect()}
    assert found["http://www.a.example/x"] == found["https://b.example/y"] == "block" and found["https://c.example/"] == "none"
    assert R.response_edges(responses.limit(0)).count() == 0


def test_very_long_pages(spark):
    filler = "<p>" + "text &amp; more " * 200_000 + "</p>"
    html = f"<html><head><title>t</title></head><body>{filler}<link rel=canonical href=/far></body></html>"
    pages = spark.createDataFrame([("https://long.example/a", html), ("https://long.example/" + "p/" * 5000, "<b" * 300_000), ("https://long.example/q", "<link " + "a='b' " * 3000 + "rel=canonical href=/near>")], "url string, html string")
    got = {tuple(r) for r in R.link_edges(pages).collect()}
    assert ("https://long.example/a", "https://long.example/far") in got and ("https://long.example/q", "https://long.example/near") in got


def test_a_hub_with_a_third_of_all_pages(spark):
    rows = [(f"https://site{i}.example/", "https://hub.example/") for i in range(3000)] + [("https://hub.example/", "https://spam-farm.example.org/")]
    edges = spark.createDataFrame(rows, "u string, v string")
    pages = edges.select(F.col("u").alias("url"))
    found = R.decide(pages, edges)
    assert found.count() == 3001 and found.where("decision <> 'block'").count() == 0
