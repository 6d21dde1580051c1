"""What a Python worker holds follows its batch and its longest page, never the partition."""

import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagemill.functions.page import Page
from pagemill.operators import elements as E
from pagemill.operators import extraction as T
from pagemill.session import apply_settings

PAGES, SIZE = 300, 100_000
HTML = "<div class='a'><h3>name</h3>" + "x" * SIZE + "</div>"


@pytest.fixture()
def task(monkeypatch, spark):
    """The function that an operator gives to ``mapInArrow``."""
    kind, found = type(spark.range(1)), []
    run_as_it_is = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, fn, *a, **b: found.append(fn) or run_as_it_is(self, fn, *a, **b))

    def make(operator):
        operator()
        return found[-1]

    return make


def peak_and_rows(run, *columns):
    names = [f"c{i}" for i in range(len(columns))]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)
    tracemalloc.start()
    first, sizes = [], []
    for out in run(iter([batch])):
        first += out.column(0).to_pylist()
        sizes.append(out.nbytes)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return peak, max(sizes), first


def test_a_query_s_batches_are_small(spark):
    session = apply_settings(spark)
    wide = session.range(0, 64, 1, 1).select(F.repeat(F.lit("x"), 1 << 18).alias("html"))
    sizes = [r.n for r in wide.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches), "n bigint").collect()]
    assert sum(sizes) >= 64 << 18 and max(sizes) < 6 << 20


def test_rewritten_pages_leave_in_small_batches(page, task):
    run = task(lambda: E.rewritten(page("x"), Page.outline))
    peak, largest, ids = peak_and_rows(run, list(range(PAGES)), [HTML] * (PAGES - 1) + [None])
    assert ids == list(range(PAGES)) and largest < 6 << 20 and peak < PAGES * SIZE / 2


def test_elements_of_a_batch_are_made_page_by_page(page, task):
    peak, _, ids = peak_and_rows(task(lambda: E.elements(page("x"))), list(range(PAGES)), [HTML] * PAGES)
    assert ids == [i for i in range(PAGES) for _ in range(3)] and peak < PAGES * SIZE / 4


def test_products_of_a_batch_are_made_page_by_page(spark, page, task):
    fields = spark.createDataFrame([("d", "div.a", "name", "h3", "text", "", None)], "domain string, base_selector string, field string, selector string, type string, attribute string, default_value string")
    run = task(lambda: T.schema_extract(page("x").withColumn("domain", F.lit("d")), fields))
    spec = [{"base_selector": "div.a", "field": "name", "selector": "h3", "type": "text", "attribute": "", "default_value": None, "place": 0}]
    peak, _, ids = peak_and_rows(run, list(range(PAGES)), ["d"] * PAGES, [HTML] * PAGES, [spec] * PAGES)
    assert ids == list(range(PAGES)) and peak < PAGES * SIZE / 4
