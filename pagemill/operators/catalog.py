"""The crawl catalog: domains, category links, products and schemas as tables.

Upserts return the complete new table; applying one twice changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions import patterns as P
from pagemill.operators.skew import dense_ids, first_per_key

TREE_CHUNK = 128


def _numbered(rows: DataFrame, key: str, table: DataFrame) -> DataFrame:
    """``rows`` with new ids after the highest of ``table``."""
    top = table.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    numbered = dense_ids(rows, key, "id").join(F.broadcast(top))  # one row
    return numbered.withColumn("id", (F.col("id") + F.col("_top")).cast("bigint")).drop("_top")


def domain_upsert(domains: DataFrame, names: DataFrame) -> DataFrame:
    """Domains plus the absent names (column ``name``) under new ids."""
    absent = names.select("name").where("name is not null").distinct().join(domains, "name", "left_anti")
    return domains.select("id", "name").unionByName(_numbered(absent, "name", domains).select("id", "name"))


def category_link_upsert(links: DataFrame, domains: DataFrame, batch: DataFrame, order: list[str], ids: DataFrame | None = None) -> DataFrame:
    """Links plus the batch rows (``domain, url, link_html, found_at``) whose URL no domain has yet.

    ``domains`` must know the batch's domains already. ``ids``: the table whose highest ``id`` new ones follow, if
    ``links`` is only a part of it (see ``linkstore.py``).
    """
    fresh = first_per_key(batch, ["url"], order).join(links.select("url"), "url", "left_anti")
    numbered = _numbered(fresh, "url", links if ids is None else ids)
    named = domains.select(F.col("id").alias("domain_id"), F.col("name").alias("domain"))
    rows = numbered.join(named, "domain").withColumn("last_crawled_at", F.lit(None).cast("timestamp_ntz"))
    columns = ["id", "url", "domain_id", "link_html", "found_at", "last_crawled_at"]
    return links.select(*columns).unionByName(rows.select(*columns))


def links_of_domain(links: DataFrame, domains: DataFrame, name: str) -> DataFrame:
    wanted = domains.where(F.col("name") == name).select(F.col("id").alias("domain_id"))
    return links.join(wanted, "domain_id", "left_semi").select("url")


def product_insert(products: DataFrame, links: DataFrame, domains: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Products with their link and domain ids, and the link table including missing links.

    ``products`` carry ``domain`` and ``category_url``; ``domains`` must know every domain.
    """
    named = domains.select(F.col("id").alias("domain_id"), F.col("name").alias("domain"))
    known = products.join(named, "domain")
    have = links.select("id", "domain_id", F.col("url").alias("category_url"))
    absent = known.select("domain_id", "category_url").distinct().join(have, ["domain_id", "category_url"], "left_anti")
    keyed = absent.withColumn("_key", F.concat_ws(" ", "domain_id", "category_url"))
    created = _numbered(keyed, "_key", links).drop("_key")
    all_links = have.unionByName(created)
    # A hot link is split by adaptive execution (session.py): the link side is unique.
    stored = known.join(all_links.withColumnRenamed("id", "category_link_id"), ["domain_id", "category_url"])
    return stored, all_links.withColumnRenamed("category_url", "url")


def latest_schema(schemas: DataFrame) -> DataFrame:
    newest = F.max_by(F.struct("id", "schema_json", "generated_at"), F.struct("generated_at", "id")).alias("s")
    return schemas.groupBy("domain_id").agg(newest).select("domain_id", "s.id", "s.schema_json", "s.generated_at")


def schema_stale(
    domains: DataFrame, schemas: DataFrame, as_of: Column, max_age_s: int = P.SCHEMA_MAX_AGE_S, force: bool = False
) -> DataFrame:
    """Domains that need a new schema, with the reason."""
    newest = latest_schema(schemas).select(F.col("domain_id").alias("id"), "generated_at")
    older = F.timestamp_add("SECOND", F.lit(max_age_s), F.col("generated_at")) < as_of
    reason = (
        F.when(F.col("generated_at").isNull(), "missing").when(F.lit(force), "forced").when(older, "old")
    )
    return domains.join(newest, "id", "left").select("id", "name", reason.alias("reason")).where("reason is not null")


def mark_crawled(links: DataFrame, domains: DataFrame, marks: DataFrame) -> DataFrame:
    """Links with ``last_crawled_at`` set from (``domain, url, crawled_at``); unknown pairs are ignored."""
    latest = marks.groupBy("domain", "url").agg(F.max("crawled_at").alias("crawled_at"))
    named = domains.select(F.col("id").alias("domain_id"), F.col("name").alias("domain"))
    updates = latest.join(named, "domain").select("domain_id", "url", "crawled_at")
    return (
        links.join(updates, ["domain_id", "url"], "left")
        .withColumn("last_crawled_at", F.coalesce("crawled_at", "last_crawled_at"))
        .drop("crawled_at")
    )


def next_to_crawl(links: DataFrame) -> DataFrame:
    """Per domain the link never or longest ago crawled; an aggregate, so it combines before the shuffle."""
    age = F.struct("last_crawled_at", "found_at", "id")  # NULL sorts first inside a struct
    return links.groupBy("domain_id").agg(F.min_by(F.struct("id", "url"), age).alias("l")).select("domain_id", "l.id", "l.url")


def next_k_to_crawl(links: DataFrame, k: int | None = P.LINKS_PER_RUN) -> DataFrame:
    """Per domain the ``k`` links (None: all) never or longest ago crawled, with their ``turn``."""
    w = Window.partitionBy("domain_id").orderBy(F.asc_nulls_first("last_crawled_at"), "found_at", "id")
    turns = links.withColumn("turn", F.row_number().over(w))
    return turns if k is None else turns.where(F.col("turn") <= k)


def unique_audit(domains: DataFrame, links: DataFrame) -> DataFrame:
    """Values that must be unique and are not: ``kind, value, n``."""

    def repeated(rows: DataFrame, kind: str, value: Column) -> DataFrame:
        counts = rows.groupBy(value.alias("value")).agg(F.count("*").alias("n"))
        return counts.where("n > 1").select(F.lit(kind).alias("kind"), "value", "n")

    pair = F.concat_ws(" ", "url", "domain_id")
    return (
        repeated(domains, "domain name", F.col("name"))
        .unionByName(repeated(links, "url", F.col("url")))
        .unionByName(repeated(links, "url and domain", pair))
    )


def fk_audit(domains: DataFrame, links: DataFrame, products: DataFrame, schemas: DataFrame) -> DataFrame:
    """Rows without a parent: ``kind, id``."""
    domain_ids = domains.select(F.col("id").alias("domain_id"))
    link_ids = links.select(F.col("id").alias("category_link_id"))

    def orphans(rows: DataFrame, kind: str, parents: DataFrame, key: str) -> DataFrame:
        return rows.join(parents, key, "left_anti").select(F.lit(kind).alias("kind"), "id")

    return (
        orphans(links, "link without domain", domain_ids, "domain_id")
        .unionByName(orphans(products, "product without domain", domain_ids, "domain_id"))
        .unionByName(orphans(products, "product without link", link_ids, "category_link_id"))
        .unionByName(orphans(schemas, "schema without domain", domain_ids, "domain_id"))
    )


def not_null_audit(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``column, n_null`` from one pass."""
    counts = rows.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_null")) for c in columns])
    return counts.select(F.inline(pairs))


def domain_tree(domains: DataFrame, links: DataFrame, products: DataFrame, chunk: int = TREE_CHUNK) -> DataFrame:
    """Domain, link and its products as nested rows.

    A link's products come in chunks of at most ``chunk`` consecutive ids, so no link is gathered
    into one row however many products it has; a link without products has one empty chunk.
    """
    item = F.struct("id", "name", "price")
    chunks = (
        products.withColumn("chunk", F.floor(F.col("id") / chunk))
        .groupBy("category_link_id", "chunk")
        .agg(F.array_sort(F.collect_list(item)).alias("products"))
    )
    named = domains.select(F.col("id").alias("domain_id"), F.col("name").alias("domain"))
    heads = links.select("domain_id", F.col("id").alias("category_link_id"), "url").join(named, "domain_id")
    return heads.join(chunks, "category_link_id", "left").select(
        "domain", F.struct(F.col("category_link_id").alias("id"), "url").alias("link"), "chunk", "products"
    )


def products_by_link(products: DataFrame, links: DataFrame, domains: DataFrame) -> DataFrame:
    named = links.join(domains.select(F.col("id").alias("domain_id"), F.col("name").alias("domain")), "domain_id")
    lookup = named.select(F.col("id").alias("category_link_id"), F.col("url").alias("category_url"), "domain")
    return products.join(lookup, "category_link_id")
