import random
import time

from pyspark.sql import functions as F

from pagemill.functions import markup as M
from pagemill.functions.page import Page
from pagemill.operators import cleaning as C
from pagemill.operators import elements as E

from conftest import SHELF


def table(pages):
    return E.elements(pages, text=True, fragment=True).orderBy("page_id", "node_id").collect()


def own(pages):
    """Without the body that a page lacks."""
    return [r for r in table(pages) if r.node_id >= 0]


def test_tokens_rejoin_to_the_page():
    odd = "<p>a<b>c<!-- <p> --> 5 < 6 <br/><script>'</p>'</script><STYLE>x{}</STYLE></P><"
    for html in (odd, SHELF, '<div title="a > b" x=\'>\'>y</div>', '<p class="open>x</p>', "", "<" * 50):
        assert "".join(Page(html).tokens) == html


def test_shelf(shelf):
    rows = table(shelf)
    first = next(r for r in rows if r.src.startswith('<li class="offer first"'))
    assert first.text == "Tulip mix £9.50 £7.25 Twenty bulbs — red, white" and first.n_words == 9
    assert first.fragment.endswith("white</p></li>") and first.closed and first.depth == 4
    assert next(r for r in rows if r.start_pos == first.parent_pos).tag == "ul"
    early = next(r for r in rows if r.tag == "h4" and "Crocus" in r.text)
    assert early.text == "Crocus <early>"
    body = next(r for r in rows if r.tag == "body")
    assert body.fragment.endswith("</body>") and "ghost" not in body.text and body.node_id > 0
    assert sum(r.tag == "li" for r in rows) == 3


def test_pages_without_a_body_get_one(page):
    rows = table(page("plain <p>x</p>", "", "<body>y"))
    assert [(r.page_id, r.node_id, r.tag, r.text, r.depth) for r in rows] == [
        (0, -1, "body", "plain x", 0), (0, 1, "p", "x", 1), (2, 0, "body", "y", 0),
    ]


def test_no_input_ends_the_job(page, spark):
    odd = "<p>&#9999999; &#55296; &#x27;&#X41; &pound;9 &bogus; &amp;lt; &#x26;amp; &#99999999999999999999;</p>"
    want = "\ufffd \ufffd 'A £9 &bogus; &lt; &amp; \ufffd"
    pages = page(odd)
    assert next(r for r in table(pages) if r.tag == "p").text == want
    assert pages.select(M.page_text(F.col("html"))).first()[0] == want
    nulls = spark.createDataFrame([(1, None), (2, "<p>k</p>"), (3, "")], "page_id bigint, html string")
    assert {r.page_id for r in E.elements(nulls).collect()} == {2}


def test_quoted_brackets_stay_in_their_tag(page):
    (div, p) = own(page('<div data-x="a > b"><p>hi</p></div>'))
    assert (div.src, div.text, p.text) == ('<div data-x="a > b">', "hi", "hi")


def test_time_grows_with_the_page():
    card = '<div class="card"><h3>Thing</h3><b><span>$ 1.50</span></b><p>some text words here</p><a href="/x">add to cart</a></div>'
    took = []
    for n in (1_000, 8_000):
        start = time.process_time()
        rows = Page(f"<html><body><div>{card * n}</div></body></html>").elements(True, True)
        took.append(time.process_time() - start)
        assert len(rows) == 6 * n + 3
    assert took[1] < 20 * took[0] and took[1] < 10


def test_element_tables_need_no_exchange(shelf):
    plan = E.elements(shelf, text=True)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


def test_closing_rules(page):
    html = "<div><p>one<p>two</p><b>bold<div>in</div><img src=x><i>it</i></div><span>tail"
    rows = [(r.tag, r.fragment) for r in own(page(html))]
    assert rows == [
        ("div", "<div><p>one<p>two</p><b>bold<div>in</div><img src=x><i>it</i></div>"),
        ("p", "<p>one"),
        ("p", "<p>two</p>"),
        ("b", "<b>bold"),
        ("div", "<div>in</div>"),
        ("img", "<img src=x>"),
        ("i", "<i>it</i>"),
        ("span", "<span>tail"),
    ]


def test_unclosed_roots_reach_the_end(page):
    rows = {r.tag: r for r in table(page("<html><body><div>x</div>y"))}
    assert rows["html"].fragment == "<html><body><div>x</div>y" and rows["body"].text == "x y"


def test_images_and_actions(page):
    html = (
        "<div><a>Add</a></div><div><a><span>buy it</span></a></div><div><a><img>Add</a></div>"
        "<div><a>Add<b>x</b></a></div><div><button>CART</button><img></div><div><a>see</a></div>"
    )
    divs = [r for r in table(page(html)) if r.tag == "div"]
    assert [r.n_actions for r in divs] == [1, 1, 0, 0, 1, 0]
    assert [r.n_images for r in divs] == [0, 0, 1, 0, 1, 0]
    (anchor,) = own(page("<a>buy</a>"))
    assert anchor.n_actions == 0


def test_entities_and_attributes(page, spark):
    row = spark.createDataFrame([("<a Href='x&amp;y' data-k=\"1\" data-k=2 disabled title=\"a href='z'\">",)], "t string")
    got = row.select(*(M.attribute(F.col("t"), n).alias(n.replace("-", "_")) for n in ("href", "data-k", "title"))).first()
    assert got.href == "x&y" and got.data_k == "1" and got.title == "a href='z'"
    assert page("<p>a&lt;b &#8364;&nbsp; &quot;x&quot; &amp;lt;</p>").select(M.page_text(F.col("html"))).first()[0] == 'a<b €\xa0 "x" &lt;'


def test_strip_attributes_wildcards(spark):
    row = spark.createDataFrame([('<p aria-label="l" aria-xy=1 data-a="2" class=c id="i">t</p>',)], "h string")
    got = row.select(C.strip_attributes(F.col("h"), ["aria-??", "data-*", "class"])).first()[0]
    assert got == '<p aria-label="l" id="i">t</p>'


def test_strip_elements_and_outline(page):
    html = "<div><nav>n<nav>m</nav></nav><p>x</p><script>s</script></div>"
    assert C.strip_elements(page(html), ["nav", "script"]).first().html == "<div><p>x</p></div>"
    left = C.strip_elements(page("<script>x</script>", "", "<p>k</p><!-- c -->"), ["script"], comments=True)
    assert {r.page_id: r.html for r in left.collect()} == {0: "", 1: "", 2: "<p>k</p>"}
    assert C.outline(page("")).first().html == ""
    assert C.outline(page("<div><p>Test</p><br>end</div>")).first().html == "<div>\n <p>\n  Test\n </p>\n <br>\n end\n</div>\n"


def brute_containing(inner, outer, strict):
    return sorted(
        (i, o) for i in inner for o in outer
        if i[0] == o[0] and o[1] <= i[1] and i[2] <= o[2] and (not strict or o[1] < i[1])
    )


def test_containing_matches_brute_force(spark):
    rng = random.Random(7)
    make = lambda n: [(rng.randrange(3), s := rng.randrange(500), s + rng.choice([0, 3, 70, 300])) for _ in range(n)]
    inner, outer = make(200), make(150)
    schema = "page_id int, start_pos int, end_pos int"
    for strict in (True, False):
        got = E.containing(spark.createDataFrame(inner, schema), spark.createDataFrame(outer, schema), strict)
        rows = sorted(
            ((r.page_id, r.start_pos, r.end_pos), (r.page_id, r.o_start, r.o_end)) for r in got.collect()
        )
        assert rows == brute_containing(inner, outer, strict)
