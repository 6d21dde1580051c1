from urllib.parse import urljoin, urlparse

import pytest
from pyspark.sql import functions as F

from pagemill.functions.urls import base_domain, sample_domain, url_resolve
from pagemill.operators import links as L


def one(spark, expr, **values):
    names = list(values)
    schema = ", ".join(f"{n} string" for n in names)
    return spark.createDataFrame([tuple(values.values())], schema).select(expr).first()[0]


@pytest.mark.parametrize(
    "url, site",
    [
        ("https://www.garden.test/bulbs/7", "garden.test"),
        ("http://seeds.test?page=3", "seeds.test"),
        ("seeds.test/list", "seeds.test"),
        ("www.de.seeds.test", "de.seeds.test"),
        ("https://www.garden.test:8443/#top", "garden.test:8443"),
        ("https://Garden.Test?x", "Garden.Test"),
    ],
)
def test_base_domain(spark, url, site):
    assert one(spark, base_domain(F.col("u")), u=url) == site


def test_sample_domain_removes_every_www(spark):
    assert one(spark, sample_domain(F.col("u")), u="https://www.a.www.b.com/x") == "a.b.com"


BASES = ["https://example.com", "https://example.com/a/b/c.html?q=1#f", "http://h.example.com/dir/", "https://e.com/a//b"]
HREFS = [
    "/x", "x", "./x", "../x", "../../../x", "a/../b", "a/./b/", "..", ".", "?p=2", "#f", "/a//b", "x?y=1#z", "/..", "x/..",
    "mailto:a@b.c", "javascript:;", "HTTPS:x", "https://other.example.com/y", "a/b/../../c?d", "x y", "é/ü", "", "/", "x/",
]


def test_resolve_matches_the_standard_library(spark):
    cases = [(h, b) for h in HREFS for b in BASES]
    rows = spark.createDataFrame(cases, "h string, b string").select("h", "b", url_resolve(F.col("h"), F.col("b")).alias("u"))
    for r in rows.collect():
        expected = r.h if urlparse(r.h).netloc else urljoin(r.b, r.h)
        assert r.u == expected, (r.h, r.b)


def test_network_path_reference_is_kept(spark):
    assert one(spark, url_resolve(F.col("h"), F.col("b")), h="//host/x", b="https://e.com/") == "//host/x"


def test_prune_keeps_internal_distinct_links_in_order(spark):
    hrefs = [
        "https://garden.test/bulbs", "  /tools ", "#reviews", None, "tel:+4912", "https://www.garden.test/tools", "http://seeds.test/bulbs",
        "/bulbs", "", "mailto:shop@garden.test", "//garden.test/p", "javascript:;", "?p=2", "MAILTO:x",
    ]
    rows = [(1, "https://garden.test", i, h, "<a></a>", "t") for i, h in enumerate(hrefs)]
    df = spark.createDataFrame(rows, "page_id bigint, page_url string, ordinal int, href string, html string, title string")
    kept = [r.url for r in L.prune(df).orderBy("ordinal").collect()]
    assert kept == ["https://garden.test/bulbs", "https://garden.test/tools", "https://www.garden.test/tools", "https://garden.test?p=2"]


def test_anchors(page):
    html = (
        '<a href="/1" class="x" rel=n>One <b>two</b></a><A HREF=/2>two</A><a>none</a><abbr>no</abbr>'
        "<script>'<a href=\"/s\">'</script><footer><a href='/f'>f</a></footer><!-- <a href='/c'> -->"
        "<a href='/open'>open<p>after</p><a title='a class=b' href='/last&amp;x'></a>"
    )
    rows = L.anchors(page(html)).orderBy("ordinal").collect()
    assert [r.href for r in rows] == ["/1", "/2", None, "/open", "/last&x"]
    assert [r.title for r in rows] == ["Onetwo", "two", "none", "open", "No Title"]
    cleaned = [r[0] for r in L.anchors(page(html)).orderBy("ordinal").select(L.clean_anchor(F.col("html"))).collect()]
    assert cleaned[0] == '<a href="/1">Onetwo</a>'
    odd = L.anchors(page('<a class=c href="/x" title="a > b">A &amp; B &lt;i&gt; &#9999999;&#x27;</a>'))
    assert odd.select(L.clean_anchor(F.col("html"))).first()[0] == '<a href="/x" title="a > b">A &amp; B &lt;i&gt; \ufffd\'</a>'
    assert cleaned[4] == "<a title='a class=b' href='/last&amp;x'></a>"


@pytest.mark.parametrize(
    "url, reason",
    [
        ("javascript:void(0)", "javascript"), ("tel:1", "telephone"), ("/my-account", "account"), ("/FAQ", "service"),
        ("/blog/x", "information"), ("/stores", "store"), ("/giftcard", "gift"), ("/bag", "cart"), ("/shoes", None),
    ],
)
def test_reject_reason(spark, url, reason):
    assert one(spark, L.reject_reason(F.col("u")), u=url) == reason
