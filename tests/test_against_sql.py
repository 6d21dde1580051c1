"""A few queries of every family against their SQL on the smallest tables; set SQL_ALL=1 for all."""

import os
from pathlib import Path

import pytest

from pagemill.plans import registry
from pagemill.plans.views import TABLES

duckdb = pytest.importorskip("duckdb")
DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
SAMPLE = [
    "link_prune", "url_resolve", "strip_attributes", "element_table", "crop_to_card", "cosine_pairs", "url_list_json",
    "payload_explode", "category_link_upsert", "domain_tree", "sample_save", "pool_summary",
]
NAMES = sorted(registry.oracle_sql()) if os.environ.get("SQL_ALL") else SAMPLE


@pytest.fixture(scope="module")
def sql():
    if not DATA.exists():
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def normal(frame):
    text = lambda v: "null" if v is None or v != v else f"{v:.6f}".rstrip("0").rstrip(".") if isinstance(v, float) else str(v)
    return sorted(tuple(map(text, row)) for row in frame[sorted(frame.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, sql, name):
    ours = registry.queries()[name](spark, str(DATA)).toPandas()
    theirs = sql.execute(registry.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert normal(ours) == normal(theirs) and len(ours)


def test_every_query_but_one_has_sql():
    assert set(registry.queries()) - set(registry.oracle_sql()) == {"semantic_dedup_lsh"}


def test_site_run_stores_every_valid_product_of_the_due_links(spark, sql):
    # Every site has one listing at this size, of five pages.
    queries = registry.queries()
    both = queries["site_run"](spark, str(DATA)).toPandas()
    stored, few = both[both["links_a_site"] > 3], both[both["links_a_site"] == 3]
    assert set(few["category_url"]) < set(stored["category_url"]) and few.groupby("domain")["category_url"].nunique().max() <= 3 and len(few)
    extracted = queries["schema_extract"](spark, str(DATA)).toPandas()
    assert sorted(stored["sku"]) == sorted([*extracted["sku"]] * 5) and len(stored)
    assert stored.groupby("category_url")["category_link_id"].nunique().eq(1).all()
    assert stored.groupby("domain")["domain_id"].nunique().eq(1).all()


def test_listing_coverage_counts_the_items_of_every_listing(spark, sql):
    ours = registry.queries()["listing_coverage"](spark, str(DATA)).toPandas()
    assert normal(ours) == normal(sql.execute(registry.oracle_sql()["listing_coverage"]).df()) and ours["found"].sum()


def test_names_that_queries_use_are_defined():
    import builtins
    import dis

    for name, fn in registry.queries().items():
        used = {i.argval for i in dis.get_instructions(fn) if i.opname == "LOAD_GLOBAL"}
        assert not {u for u in used if u not in fn.__globals__ and not hasattr(builtins, u)}, name
