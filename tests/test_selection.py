import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.operators import elements as E
from pagemill.operators import scoring as S
from pagemill.operators import selection as X
from pagemill.operators import vectors as VEC
from pagemill.plans.fragment_queries import fragment_vectors
from pagemill.plans.views import entities
from pagemill.session import settled


def tree(rng, start, depth):
    """Random nested intervals."""
    nodes, pos = [], start + 1
    for _ in range(rng.randrange(1, 4) if depth else 0):
        child, pos = tree(rng, pos, depth - 1)
        nodes += child
    return [(start, pos), *nodes], pos + 1


def candidates(spark, seed):
    rng = random.Random(seed)
    spans, _ = tree(rng, 0, 4)
    rows = [(1, s, s, e, float(rng.randrange(4))) for s, e in spans if rng.random() < 0.7]
    return rows, spark.createDataFrame(rows, "page_id int, node_id int, start_pos int, end_pos int, score double")


@pytest.mark.parametrize("seed", [1, 2])
def test_remove_nested_and_uncovered(spark, seed):
    rows, df = candidates(spark, seed)
    outer = sorted(r[1] for r in rows if not any(o[2] < r[2] and o[3] >= r[3] for o in rows))
    assert sorted(r.node_id for r in X.remove_nested(df).collect()) == outer
    accepted = []
    for r in sorted(rows, key=lambda r: (-r[4], r[1])):
        if not any(a[2] <= r[2] and r[3] <= a[3] for a in accepted):
            accepted.append(r)
    assert sorted(r.node_id for r in X.uncovered(df).collect()) == sorted(a[1] for a in accepted)


def greedy(rows, threshold):
    kept = []
    for page, vec, score, v in sorted(rows, key=lambda r: (-r[2], r[1])):
        unit = np.array(v) / (np.linalg.norm(v) or 1)
        if all(p != page or u @ unit <= threshold for p, _, u in kept):
            kept.append((page, vec, unit))
    return sorted((p, v) for p, v, _ in kept)


@pytest.fixture(scope="module")
def vector_rows():
    rng = np.random.default_rng(3)
    rows = []
    for i in range(300):
        page = 0 if i % 3 == 0 else int(rng.integers(1, 9))
        v = rng.standard_normal(5).round(2) if i % 4 or not rows else np.array(rows[i // 2][3])
        rows.append((page, i, int(rng.integers(0, 20)), [float(x) for x in v]))
    rows.append((0, 900, 5, [0.0] * 5))
    rows.append((0, 901, 5, [0.0] * 5))
    return rows


def vectors(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, vec_id bigint, score int, embedding array<double>")


@pytest.mark.parametrize("threshold", [0.3, 0.9])
def test_semantic_dedup_is_the_greedy_walk(spark, vector_rows, threshold):
    kept = VEC.semantic_dedup(vectors(spark, vector_rows), threshold).collect()
    assert sorted((r.page_id, r.vec_id) for r in kept) == greedy(vector_rows, threshold)


def test_semantic_dedup_in_rounds(spark, vector_rows, monkeypatch):
    monkeypatch.setattr(VEC, "OTHERS", 7)
    kept = VEC.semantic_dedup(vectors(spark, vector_rows), 0.6, block=5).collect()
    assert sorted((r.page_id, r.vec_id) for r in kept) == greedy(vector_rows, 0.6)


def test_many_near_copies_take_few_rounds(spark):
    rng = np.random.default_rng(5)
    rows = [(1, i, i % 7, [float(x) for x in np.ones(4) + rng.normal(0, 1e-3, 4)]) for i in range(5000)]
    kept = VEC.semantic_dedup(vectors(spark, rows), 0.99).collect()
    assert [r.vec_id for r in kept] == [6]


def test_pairs_do_not_depend_on_the_block_size(spark, vector_rows):
    distinct = VEC.collapse_copies(vectors(spark, vector_rows))
    results = [
        sorted((r.page_id, r.better, r.worse, round(r.cosine, 6)) for r in VEC.similar_pairs(distinct, 0.5, block=b).collect())
        for b in (4, 1000)
    ]
    assert results[0] == results[1] and results[0]


def test_lsh_drops_only_similar_vectors(spark, vector_rows):
    rows = [(0, *r[1:]) for r in vector_rows if any(r[3])]
    kept = {r.vec_id for r in VEC.semantic_dedup_lsh(vectors(spark, rows), 0.9).collect()}
    unit = {r[1]: np.array(r[3]) / np.linalg.norm(r[3]) for r in rows}
    for vec in unit.keys() - kept:
        assert max(unit[vec] @ unit[k] for k in kept) > 0.9 - 1e-9
    assert len(kept) < len({tuple(r[3]) for r in rows})


@pytest.mark.parametrize("threshold, bands, bits, block", [(0.25, None, None, 100), (0.9, 4, 6, 50), (0.25, 3, 8, 2000)])
def test_lsh_keeps_what_a_walk_in_rank_order_keeps(spark, threshold, bands, bits, block):
    rng = np.random.default_rng(11)
    x = np.round(rng.normal(size=(900, 8)) + np.repeat(rng.normal(size=(30, 8)), 30, axis=0), 3)
    rows = [(i // 50, i, int(s), v.tolist()) for i, (s, v) in enumerate(zip(rng.integers(0, 40, 900), x))]
    rows += [(0, 5000, 1, None), (1, 5001, 3, None), (0, 6000, 50, x[7].tolist())]
    found = VEC.semantic_dedup_lsh(vectors(spark, rows), threshold, bands, bits, block=block).collect()
    most = VEC.plan_bands(901, threshold)
    bands, bits = bands or most[0], bits or most[1]
    signs = (x @ np.random.default_rng(42).standard_normal((8, bands * bits)) > 0).reshape(900, bands, bits)
    unit, kept = x / np.linalg.norm(x, axis=1, keepdims=True), []
    for score, v in sorted([(-(50 if r[1] == 7 else r[2]), r[1]) for r in rows[:900]]):
        if not any(unit[v] @ unit[k] > threshold and (signs[v] == signs[k]).all(axis=1).any() for k in kept):
            kept.append(v)
    assert sorted(r.vec_id for r in found) == sorted([6000 if v == 7 else v for v in kept] + [5001])
    assert {r.copies for r in found if r.vec_id in (5001, 6000)} == {2} and len(kept) < 900


def test_lsh_stores_no_row_per_band_or_pair_where_many_are_alike(spark, monkeypatch):
    refuse = lambda *a, **b: pytest.fail("vectors repeated by band")
    monkeypatch.setattr(VEC, "band_keys", refuse)
    rng = np.random.default_rng(3)
    rows = [(0, i, i % 101, rng.normal(size=8).tolist()) for i in range(3000)]
    kept = VEC.semantic_dedup_lsh(vectors(spark, rows), 0.25).collect()
    assert 0 < len(kept) < 300


CARD = (
    '<div class="galleryItem" data-item-id="{0}"><h3>item {0}</h3><span class="price">${0}.00</span>'
    "<p>a plain sentence that makes the card long enough to count, number {1}</p>"
    '<div class="promo">Save 5</div><a href="/p/{0}">add to cart</a></div>'
)


def listing(page, n=60):
    cards = "".join(CARD.format(i, "zebra quiz " * (i % 5)) for i in range(n))
    return page(f'<html><body><div class="grid">{cards}</div></body></html>')


def test_product_filter_keeps_best_distinct_cards(page):
    pages = listing(page)
    elems = E.elements(pages, text=True, fragment=True)
    found = X.product_filter(elems, entities(elems), fragment_vectors(elems), keep_top_n=7, similarity=0.99999).collect()
    assert [r["rank"] for r in sorted(found, key=lambda r: r["rank"])] == list(range(1, 8))
    assert all(r.fragment.startswith('<div class="galleryItem"') and r.fragment.endswith("</a></div>") for r in found)
    none = E.elements(page(""), text=True, fragment=True)
    assert X.product_filter(none, entities(none), fragment_vectors(none)).count() == 0


def test_ecommerce_filter_crops_and_strips_promotions(page):
    html = (
        "<html><body><main>"
        + "".join(f'<div class="card"><h3>Thing {i}</h3><b><span>$ {i}.50</span></b><div class="promo">now</div></div>' for i in range(3))
        + "<p>" + "filler words here " * 60 + "</p></main><form>$9</form></body></html>"
    )
    rows = X.ecommerce_filter(page(html)).orderBy("position").collect()
    assert all("promo" not in r.fragment and "<form>" not in r.fragment for r in rows)
    cards = [r.fragment for r in rows if r.fragment.startswith('<div class="card">')]
    assert cards == [f'<div class="card"><h3>Thing {i}</h3><b><span>$ {i}.50</span></b></div>' for i in range(3)]
    starts = [r.card_id for r in rows]
    assert starts == sorted(starts) and len({r.fragment for r in rows}) == len(rows)


def test_clean_for_model(page):
    pages = listing(page)
    elems = E.elements(pages, text=True, fragment=True)
    text = X.clean_for_model(pages, elems, entities(elems), fragment_vectors(elems)).first().html
    whole = X.clean_for_model(pages, elems, entities(elems), fragment_vectors(elems), keep_top_n=None, similarity=1.0).first().html
    assert whole.count("galleryItem") == 60
    empty = page("<p>short</p>")
    none = E.elements(empty, text=True, fragment=True)
    assert [r.html for r in X.clean_for_model(empty, none, entities(none), fragment_vectors(none)).collect()] == [""]
    assert 1 <= text.count("galleryItem") <= 20 and "\n <h3>" in text and "<form" not in text


def written(page):
    """Two listing pages and one without products, written as Parquet: small files, which Spark would broadcast."""
    htmls = [listing(page, n).first().html for n in (60, 50)]
    pages = settled(page(*htmls, "<p>short</p>"))
    return pages, settled(E.elements(pages, text=True))


def test_product_filter_broadcasts_nothing(page, no_broadcasts):
    pages, elems = written(page)
    args = elems, entities(elems), fragment_vectors(elems)
    found = X.product_filter(*args, similarity=1.0, pages=pages).collect()
    assert sorted((r.page_id, r["rank"]) for r in found) == [(p, k) for p in (0, 1) for k in range(1, 21)]
    assert all(r.fragment.startswith('<div class="galleryItem"') and r.fragment.endswith("</a></div>") for r in found)
    assert 0 < X.product_filter(*args, keep_top_n=None, similarity=0.9, pages=pages).count() < 110


def test_clean_for_model_broadcasts_nothing(page, no_broadcasts):
    pages, elems = written(page)
    found = X.clean_for_model(pages, elems, entities(elems), fragment_vectors(elems), similarity=1.0).orderBy("page_id").collect()
    assert [r.page_id for r in found] == [0, 1, 2] and found[2].html == ""
    assert [r.html.count("galleryItem") for r in found] == [20, 20, 0] and "\n <h3>" in found[1].html


@pytest.mark.parametrize(
    "text, priced", [("now $ 5", True), ("USD 12.50!", True), ("abusd 5", False), ("€1,99x", True), ("€1x", False), ("5 $", False), ("£7", True)]
)
def test_price_text(spark, text, priced):
    row = spark.createDataFrame([(text, "<p>")], "t string, s string")
    assert row.select(S.looks_like_price(F.col("t"), F.col("s"))).first()[0] is priced
