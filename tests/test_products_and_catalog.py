import json
import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import SHELF
from pagemill.operators import catalog as K
from pagemill.operators import dataset as D
from pagemill.operators import extraction as T
from pagemill.operators import skew

T0 = dt.datetime(2024, 1, 1)
LINKS = "id bigint, url string, domain_id bigint, link_html string, found_at timestamp_ntz, last_crawled_at timestamp_ntz"
DOMAINS = "id bigint, name string"


@pytest.mark.parametrize(
    "name, title, price, valid",
    [
        ("a", None, "29.99", True), ("a", None, "$1,299.00", True), ("a", None, "5.", True), ("a", None, "29.99 ", True),
        ("a", None, "", False), ("a", None, None, False), ("a", None, "from $5", False), ("a", None, "1.2.3", False),
        (" ", "t", "1", True), ("", None, "1", False), (None, None, "1", False), ("a", None, "1\n", True), ("a", None, ",1", False),
    ],
)
def test_validity(spark, name, title, price, valid):
    df = spark.createDataFrame([(name, title, price)], "name string, title string, price string")
    assert (T.product_validate(df).count() == 1) is valid


def extracted(spark, pages, *schemas, **options):
    rows = [(d, json.dumps(s)) for d, s in schemas]
    fields = T.schema_fields(spark.createDataFrame(rows, "domain string, schema_json string"))
    return T.schema_extract(pages, fields, **options).orderBy("page_id", "base_id").collect(), T.rejected_fields(fields).collect()


def field(name, selector, kind="text", **more):
    return {"name": name, "selector": selector, "type": kind, **more}


def test_selectors_by_hand(shelf, spark):
    pages = shelf.withColumn("domain", F.lit("garden.test"))
    schema = {
        "baseSelector": "main#shelf > ul.offers > li.offer",
        "baseFields": [{"name": "sku", "type": "attribute", "attribute": "data-sku"}],
        "fields": [
            field("name", "h4"), field("price", "b.price.now"), field("original_price", "b[class~=old]"), field("discount", "b.now.old"),
            field("description", "ul p", "html"), field("url", "header a", "attribute", attribute="href"),
            field("image_url", "img, h5, i", "attribute", attribute="src", default="none"), field("note", "[data-note]"),
            field("early", "h4[nothing], p"), field("same", "p"), field("same", "h4", default="z"),
        ],
    }
    rows, rejected = extracted(spark, pages, ("garden.test", schema))
    assert [(r.sku, r.name, r.price, r.original_price, r.discount, r.url, r.image_url) for r in rows] == [
        ("tu-1", "Tulip mix", "£7.25", "£9.50", None, None, "none"), ("cr-2", "Crocus <early>", "£3.00", None, None, None, "none"),
        ("sn-3", "Snowdrop", None, None, None, None, "none"),
    ]
    assert rows[1].description == "<p>Flowers in March<br>or sooner</p>" and not rejected
    assert rows[2].other == {"early": "Back in autumn", "same": "Back in autumn"} and SHELF.count("data-sku") == len(rows)


def test_conditions_children_and_refused_selectors(page, spark):
    html = (
        '<div class="card a" lang="en-GB" data-k="n"><i>1</i><p><i>2</i></p></div><div class="card b" data-k="nm"><i>3</i></div>'
        '<section><div class="cardx"><i>4</i></div></section>'
    )
    pages = page(html).withColumn("domain", F.lit("d"))
    want = {
        "div": ["1", "3", "4"], "div.card": ["1", "3"], ".a.card": ["1"], "div[data-k='n']": ["1"], "[data-k^=n]": ["1", "3"], '[data-k$="m"]': ["3"],
        "[lang|=en]": ["1"], "[class*=ardx]": ["4"], "section > div": ["4"], "body > div": ["1", "3"], "section, .b": [], "*.b , .a": ["1", "3"],
    }
    for base, found in want.items():
        rows, rejected = extracted(spark, pages, ("d", {"baseSelector": base, "fields": [field("name", "i")]}))
        assert ([r.name for r in rows] == found or base == "section, .b" and [r.name for r in rows] == ["3", "4"]) and not rejected, base
    rows, _ = extracted(spark, pages, ("d", {"baseSelector": "div.a", "fields": [field("name", "p > i"), field("price", "div > i")]}))
    assert [(r.name, r.price) for r in rows] == [("2", "1")]
    for bad in ("div:first-child", "a + b", "div >", "a ~ b", "p[", "> p"):
        rows, rejected = extracted(spark, pages, ("d", {"baseSelector": "div.a", "fields": [field("name", bad), field("price", "p i")]}))
        assert [r.reason for r in rejected] == ["selector not understood"] and [(r.name, r.price) for r in rows] == [(None, "2")], bad
    rows, rejected = extracted(spark, pages, ("d", {"baseSelector": "div::x", "fields": [field("name", "i")]}))
    assert not rows and rejected[0].reason == "base selector not understood"


def test_titles_are_products(page, spark):
    pages = page("<li><h4>T</h4><b>$5</b></li>").withColumns({"domain": F.lit("d"), "mode": F.lit("schema")})
    fields = T.schema_fields(spark.createDataFrame([("d", json.dumps({"baseSelector": "li", "fields": [field("title", "h4"), field("price", "b")]}))], "domain string, schema_json string"))
    answers = spark.createDataFrame([(9, "d", "{}")], "page_id bigint, domain string, payload string")
    products, _ = T.extract_by_mode(pages, fields, answers)
    assert [(r.title, r.price) for r in products.collect()] == [("T", "$5")]


def test_payloads(spark):
    rows = [
        (1, "d", '{"products":[{"name":"n","price":"1"},{"name":"m","price":"2"}],"next_page":null}'),
        (2, "d", '{"products":['), (3, "e", None), (4, "e", '{"products":[],"next_page":"x"}'),
    ]
    df = spark.createDataFrame(rows, "page_id int, domain string, payload string")
    got = sorted((r.page_id, r.name or "", r.next_page or "") for r in T.payload_products(df).collect())
    assert got == [(1, "m", ""), (1, "n", ""), (4, "", "x")]
    assert sorted(tuple(r) for r in T.payload_rejects(df).collect()) == [("d", 2, 1), ("e", 2, 1)]
    odd = spark.createDataFrame([(i, "d", p) for i, p in enumerate(["[]", "5", '{"products":"oops"}', '"x"', "null", "{}"])], df.schema)
    assert [r.page_id for r in T.payload_products(odd).collect()] == [5]
    assert [tuple(r) for r in T.payload_rejects(odd).collect()] == [("d", 6, 5)]


def test_pagination_stops_at_loops_and_depth(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "d"), ("d", "e"), ("e", "f"), ("f", None)], "page_url string, next_page string")
    starts = spark.createDataFrame([("a",), ("c",)], "page_url string")
    got = sorted((r.start_url, r.depth, r.page_url) for r in T.pagination_chain(starts, edges).collect())
    assert got == [("a", 1, "a"), ("a", 2, "b"), ("c", 1, "c"), ("c", 2, "d"), ("c", 3, "e")]


def domains(spark, *rows):
    return spark.createDataFrame(list(rows), DOMAINS)


def links(spark, *rows):
    return spark.createDataFrame(list(rows), LINKS)


def test_upserts_are_idempotent(spark):
    names = spark.createDataFrame([("a",), ("b",), ("c",), ("b",), (None,)], "name string")
    once = K.domain_upsert(domains(spark, (7, "b")), names)
    twice = K.domain_upsert(once, names)
    rows = sorted((r.id, r.name) for r in once.collect())
    assert rows == sorted((r.id, r.name) for r in twice.collect())
    assert [r[0] for r in rows] == [7, 8, 9] and (7, "b") in rows
    batch = spark.createDataFrame(
        [("a", "u1", "x", T0, 2), ("c", "u1", "y", T0, 1), ("b", "u0", "z", T0, 3)],
        "domain string, url string, link_html string, found_at timestamp_ntz, seq int",
    )
    have = links(spark, (3, "u0", 7, None, T0, None))
    first = K.category_link_upsert(have, once, batch, ["seq"])
    again = K.category_link_upsert(first, once, batch, ["seq"])
    got = sorted((r.id, r.url, r.link_html) for r in first.collect())
    assert got == [(3, "u0", None), (4, "u1", "y")] == sorted((r.id, r.url, r.link_html) for r in again.collect())


def test_product_insert_creates_each_missing_link_once(spark):
    products = spark.createDataFrame(
        [("a", "u1", "n1", "1"), ("a", "u1", "n2", "2"), ("b", "u1", "n3", "3"), ("a", "u0", "n4", "4")],
        "domain string, category_url string, name string, price string",
    )
    stored, table = K.product_insert(products, links(spark, (5, "u0", 1, None, T0, None)), domains(spark, (1, "a"), (2, "b")))
    ids = {r.name: r.category_link_id for r in stored.collect()}
    assert ids["n4"] == 5 and ids["n1"] == ids["n2"] and {ids["n1"], ids["n3"]} == {6, 7}
    assert sorted(r.id for r in table.collect()) == [5, 6, 7]


def test_next_links_and_marks(spark):
    late = T0 + dt.timedelta(days=1)
    table = links(
        spark, (1, "old", 1, None, T0, T0), (2, "never2", 1, None, late, None), (3, "never1", 1, None, T0, None),
        (4, "tie", 1, None, T0, None), (5, "new", 1, None, T0, late), (6, "only", 2, None, T0, late),
    )
    assert {r.domain_id: r.url for r in K.next_to_crawl(table).collect()} == {1: "never1", 2: "only"}
    turns = [r.url for r in K.next_k_to_crawl(table).where("domain_id = 1").orderBy("turn").collect()]
    assert turns == ["never1", "tie", "never2"]
    marks = spark.createDataFrame(
        [("a", "never1", late), ("a", "never1", T0), ("b", "old", late), ("zzz", "tie", late)],
        "domain string, url string, crawled_at timestamp_ntz",
    )
    known = domains(spark, (1, "a"), (2, "b"))
    marked = K.mark_crawled(table, known, marks)
    assert {r.url: r.last_crawled_at for r in marked.collect() if r.id in (1, 3, 4)} == {"old": T0, "never1": late, "tie": None}
    again = K.mark_crawled(marked.select(*table.columns), known, marks)
    assert sorted(map(str, again.select(*table.columns).collect())) == sorted(map(str, marked.select(*table.columns).collect()))


def test_schema_stale(spark):
    as_of = T0 + dt.timedelta(seconds=500)
    at = lambda s: as_of - dt.timedelta(seconds=s)
    schemas = spark.createDataFrame(
        [(1, 1, "{}", at(120)), (2, 2, "{}", at(120.5)), (3, 3, "{}", at(500)), (4, 3, "{}", at(1))],
        "id int, domain_id bigint, schema_json string, generated_at timestamp_ntz",
    )
    sites = domains(spark, (1, "a"), (2, "b"), (3, "c"), (4, "d"))
    now = F.lit(as_of).cast("timestamp_ntz")
    assert {r.name: r.reason for r in K.schema_stale(sites, schemas, now).collect()} == {"b": "old", "d": "missing"}
    forced = K.schema_stale(sites, schemas, now, force=True)
    assert {r.name: r.reason for r in forced.collect()} == {"a": "forced", "b": "forced", "c": "forced", "d": "missing"}


def test_balanced_sample(spark):
    table = links(spark, *[(i, f"u{i}", 1 if i < 8 else 2, None, T0, None) for i in range(10)])
    sites = domains(spark, (1, "a"), (2, "b"))
    take = lambda n: [r.id for r in D.balanced_sample(table, sites, n).collect()]
    assert take(6) == [0, 1, 2, 8, 9] and take(1) == [0] and take(0) == []


def test_samples_and_contents(spark):
    rows = [(1, "https://www.a.com/1", "x", 1, T0, None), (2, "https://a.com/2", "x", 0, T0, "c"), (3, "https://b.com/3", "y", 0, T0, "cy")]
    batch = spark.createDataFrame(rows, "doc_id int, url string, html_content string, is_plp int, ts timestamp_ntz, cleaned_html string")
    none = spark.createDataFrame([], "content_hash string")
    samples, contents = D.save_samples(none, batch, "doc_id")
    assert sorted((r.doc_id, r.domain) for r in samples.collect()) == [(1, "a.com"), (3, "b.com")]
    assert D.save_samples(samples, batch, "doc_id")[0].count() == 0
    found = D.content_lookup(samples.select("doc_id", "content_hash"), contents)
    assert {r.doc_id: r.html for r in found.collect()} == {1: "x", 3: "cy"}
    assert [(r.doc_id, r.first_id) for r in D.duplicate_samples(batch, "doc_id").collect()] == [(2, 1)]


def test_url_sources(spark):
    source = lambda *u: spark.createDataFrame([(x,) for x in u], "url string")
    got = D.by_priority(source().limit(0), source("b", "c"), source("d")).collect()
    assert sorted(r.url for r in got) == ["b", "c"]


def test_balanced_sample_of_a_hot_site(spark):
    table = links(spark, *[(i, f"u{i}", 1 if i % 50 else 2, None, T0, None) for i in range(5000)])
    got = D.balanced_sample(table, domains(spark, (1, "a"), (2, "b")), 4000)
    assert [r.id for r in got.collect()] == [i for i in range(5000) if i % 50][:2000] + list(range(0, 5000, 50))


def test_dense_ids(spark):
    ids = skew.dense_ids(spark.range(5000).select(F.col("id").cast("string").alias("name")), "name", "id", 10)
    assert ids.agg(F.min("id"), F.max("id"), F.countDistinct("id")).first()[:] == (11, 5010, 5000)
