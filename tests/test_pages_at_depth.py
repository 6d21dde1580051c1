"""Deep pages, elements chosen before they are cut, selectors in one walk, links without a shuffle, long chains."""

import json
import random
import tracemalloc

import pytest
from pyspark.sql import functions as F

from pagemill.functions import selectors as SEL
from pagemill.functions.page import Page
from pagemill.operators import elements as E
from pagemill.operators import extraction as T
from pagemill.operators import links as L
from pagemill.operators import scoring as S
from pagemill.operators import vectors as VEC


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_memory_follows_the_page_not_its_depth():
    html = "<div>" * 20_000 + "x" * 5_000 + "</div>" * 20_000
    page = Page(html)
    tracemalloc.start()
    rows = sum(1 for _ in page.rows((75, 3_500), False))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # All markup would be 4.5 GB, all text 100 MB.
    assert rows == 20_001 and peak < 60 << 20


def test_a_page_of_nested_tags(page):
    depth = 20_000
    html = "<body>" + "<div>" * depth + "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen" + "</div>" * depth
    pages = page(html, "<p>short</p>", None)
    sized = S.size_prefilter(E.elements(pages, text=(75, 3_500)))
    assert sized.where("text like 'one two%'").count() == sized.count() == depth + 1
    inner = sized.orderBy(F.desc("start_pos")).limit(3)
    cut = E.with_markup(inner.select("page_id", "node_id", "off", "outer_len"), pages).collect()
    assert sorted(len(r.fragment) for r in cut) == [len("one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen") + 11 * k for k in (1, 2, 3)]
    fields = T.schema_fields(pages.sparkSession.createDataFrame([("d", json.dumps({"baseSelector": "body", "fields": [{"name": "name", "selector": "div div div", "type": "text"}]}))], "domain string, schema_json string"))
    rows = T.schema_extract(pages.withColumn("domain", F.lit("d")), fields, ["name"]).collect()
    assert [r.name for r in rows if r.page_id == 0] == [html[6 + 5 * depth :].split("<")[0]]


def test_markup_of_chosen_elements_is_that_of_the_element_table(shelf):
    whole = E.elements(shelf, text=True, fragment=True)
    chosen = whole.where("tag in ('li', 'b', 'main')").select("page_id", "node_id", "off", "outer_len")
    want = {r.node_id: r.fragment for r in whole.collect() if r.tag in ("li", "b", "main")}
    assert {r.node_id: r.fragment for r in E.with_markup(chosen, shelf).collect()} == want and len(want) > 6
    bounded = {r.node_id: r.text for r in E.elements(shelf, text=(5, 20)).collect()}
    assert bounded == {r.node_id: r.text if 5 < r.text_len < 20 else None for r in whole.collect()}


def found_by_looking_back(page, selector):
    """Starts of the elements a selector finds: the last step, then ancestor by ancestor."""
    nodes = list(page.opened())
    hits = set()
    for path in SEL._PATH.findall(selector.strip()):
        steps = [SEL.Step(s.strip()) for s in SEL._STEP.findall(path)]
        fits = lambda n, step: step.fits(n[2], SEL.attributes(n[3]), SEL._SPACE.split(SEL.attributes(n[3]).get("class", "")))  # noqa: E731, B023

        def parent(n):
            around = [o for o in nodes if o[0] < n[0] <= o[1]]
            return around[-1] if around else None

        def climbs(n, k):
            if k < 0:
                return True
            outer = [o for o in nodes if o[0] < n[0] and n[1] <= o[1]]
            if steps[k + 1].child:
                outer = [o for o in outer if o == parent(n)]
            return any(fits(o, steps[k]) and climbs(o, k - 1) for o in outer)

        hits |= {n[0] for n in nodes if fits(n, steps[-1]) and climbs(n, len(steps) - 2)}
    return hits, nodes


@pytest.mark.parametrize("seed", range(40))
def test_one_walk_finds_what_looking_back_finds(seed):
    rng = random.Random(seed)
    tags = ["div", "b", "p", "li", "span"]

    def tag():
        name = rng.choice(tags)
        return rng.choice([f"<{name} class='{rng.choice('xy')}'>", f"<{name} id=k data-v={rng.choice('12')}>", f"<{name}>", f"</{name}>", f"</{name}>", "<br>", "t "])

    page = Page("".join(tag() for _ in range(rng.randint(1, 60))))
    simple = lambda: rng.choice([*tags, ".x", ".y", "#k", "div.x", "[data-v]", "[data-v='1']", "*"])
    path = lambda: simple() + "".join(rng.choice([" ", " > "]) + simple() for _ in range(rng.randint(0, 2)))
    base, fields = path(), [rng.choice([path(), f"{path()}, {path()}"]) for _ in range(4)]
    specs = [{"base_selector": base, "field": f"f{i}", "selector": s, "type": "html", "attribute": "", "default_value": None, "place": i} for i, s in enumerate(fields)]
    got = dict(SEL.SelectorIndex(specs).bases(page))
    bases, nodes = found_by_looking_back(page, base)
    assert set(got) == bases
    end = {n[0]: n[1] for n in nodes}
    for b in bases:
        want = {}
        for i, s in enumerate(fields):
            inside = [h for h in found_by_looking_back(page, s)[0] if b < h and end[h] <= end[b]]
            if inside:
                want[f"f{i}"] = page.markup(min(inside), end[min(inside)])
        assert got[b] == want


def test_schemas_beyond_the_broadcast_bound(spark, shelf, monkeypatch):
    schema = {"baseSelector": "li.offer", "baseFields": [{"name": "sku", "type": "attribute", "attribute": "data-sku"}], "fields": [{"name": "name", "selector": "h4", "type": "text"}]}
    fields = T.schema_fields(spark.createDataFrame([("garden.test", json.dumps(schema)), ("other", json.dumps(schema))], "domain string, schema_json string"))
    pages = shelf.withColumn("domain", F.lit("garden.test"))
    one = T.schema_extract(pages, fields)
    assert "Exchange hashpartitioning" not in plan_of(one)
    monkeypatch.setattr(T, "BROADCAST_SCHEMAS", 0)
    assert sorted(map(str, one.collect())) == sorted(map(str, T.schema_extract(pages, fields).collect())) and one.count() == 3


def test_page_links_are_the_pruned_anchors_without_a_shuffle(spark, page):
    rng = random.Random(3)
    hrefs = ["/a", "a?b", "https://www.shop.example.com/a", "http://else.example.com/", "#x", "mailto:q", " /a ", "/b", "", "//shop.example.com/c"]
    body = "".join(f"<a href='{rng.choice(hrefs)}' class=k>{rng.choice('pqr')}</a>" for _ in range(200)) + "<a>none</a><a href='/open'>never closed<p>"
    pages = page(body, "", None, "<a href='/z'>z</a>")
    columns = ["page_id", "page_url", "ordinal", "href", "html", "title", "url", "domain", "page_domain"]
    got, want = L.page_links(pages).select(columns), L.prune(L.anchors(pages)).select(columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() > 4
    assert "Exchange" not in plan_of(got) and "Exchange" not in plan_of(L.category_links(pages))


def test_chains_of_any_length(spark):
    n = 10_000
    edges = [(f"c{i}", f"c{i + 1}") for i in range(n - 1)] + [(f"c{n - 1}", None), ("l0", "l1"), ("l1", "l2"), ("l2", "l1"), ("s", "s")]
    edges = spark.createDataFrame(edges, "page_url string, next_page string")
    starts = spark.createDataFrame([("c0",), ("l0",), ("s",), ("alone",), ("c0",)], "page_url string")
    got = T.pagination_chain(starts, edges, None)
    rows = {(r.start_url, r.page_url): r.depth for r in got.collect()}
    assert rows.pop(("c0", f"c{n - 1}")) == n and sum(s == "c0" for s, _ in rows) == n - 1
    assert {k: d for k, d in rows.items() if k[0] != "c0"} == {("l0", "l0"): 1, ("l0", "l1"): 2, ("l0", "l2"): 3, ("s", "s"): 1, ("alone", "alone"): 1}
    assert T.pagination_chain(starts, edges.limit(0), None).count() == 4


def test_mean_pool_combines_whole_vectors(spark):
    rows = [("a", [1.0, 2.0], 1), ("a", [3.0, 6.0], 1), ("a", [9.0, 9.0], 0), ("b", [5.0, 5.0], 0), ("c", None, 1), ("d", [1.0], None)]
    tokens = spark.createDataFrame(rows, "g string, embedding array<float>, mask int")
    got = VEC.mean_pool(tokens, "g")
    assert sorted(map(tuple, got.collect())) == [("a", 0, 2.0), ("a", 1, 4.0), ("b", 0, 0.0), ("b", 1, 0.0)]
    plan = plan_of(got)
    assert plan.index("Generate") < plan.index("Exchange") and plan.count("Generate") == 1  # above the shuffle
