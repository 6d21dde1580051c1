"""Incremental forms, run over the whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.functions.urls import base_domain
from pagemill.operators import catalog as K
from pagemill.operators import links as L
from pagemill.operators import linkstore
from pagemill.plans import views as V
from pagemill.plans.catalog_queries import DUCK_FORMAT, FORMAT, UPSERTED_DOMAINS, new_ids
from pagemill.plans.registry import query
from pagemill.session import scratch_dir, settled
from pagemill.streaming import jobs as J


STORE_BUCKETS = 8  # a small store


def _arriving(spark, rows, parts, make, **run):
    """The parts of ``rows`` arrive one after the other; each is a batch of as many files as its tasks wrote."""
    path, checkpoint = scratch_dir(spark, "arriving"), scratch_dir(spark, "stream")
    for part in parts:
        rows.where(part).write.mode("append").parquet(path)
        J.run_now(make(J.read_files(spark, path, rows.schema)), checkpoint, **run)


@query("stream_content_dedup", "select distinct md5(html) as content_hash, length(html) as n_chars from pages")
def stream_content_dedup(spark, sf_dir):
    pages = V.table(spark, sf_dir, "pages")
    again = pages.withColumn("page_id", F.col("page_id") + 1000000)
    out = scratch_dir(spark, "deduped")
    _arriving(spark, pages.unionByName(again), ["page_id < 1000000", "page_id >= 1000000"], J.content_dedup, each=J.accept_new(out))
    return spark.read.parquet(out).select("content_hash", F.length("html").alias("n_chars"))


@query("stream_label_stats", "select domain, is_plp, count(*) as n_samples from samples group by domain, is_plp")
def stream_label_stats(spark, sf_dir):
    samples = V.view(spark, sf_dir, "samples").select("doc_id", "domain", "is_plp")
    out = scratch_dir(spark, "stats")
    parts = ["doc_id % 3 = 0", "doc_id % 3 = 1", "doc_id % 3 = 2"]
    _arriving(spark, samples, parts, J.label_stats, mode="update", each=J.log_changes(out))
    return J.merged(spark, out, ["domain", "is_plp"])


@query(
    "stream_catalog_upsert",
    f"""select id, url, domain_id, case when last_digit % 2 = 0 then '{V.AS_OF}' else 'never' end as last_crawled_at
        from (select id, url, domain_id, id % 10 as last_digit from (
          select {new_ids("url", "0")} as id, url, d.id as domain_id from (
            select url, arg_min(domain, (page_id, ordinal)) as domain from pruned where page_id % 2 = 0 group by url) b
          join {UPSERTED_DOMAINS} d on d.name = b.domain
          union all
          select {new_ids("url", "select count(distinct url) from pruned where page_id % 2 = 0")} as id, url, d.id from (
            select url, arg_min(domain, (page_id, ordinal)) as domain from pruned where page_id % 2 = 1
              and url not in (select url from pruned where page_id % 2 = 0) group by url) b
          join {UPSERTED_DOMAINS} d on d.name = b.domain))""",
)
def stream_catalog_upsert(spark, sf_dir):
    """Two batches of found links, then crawl marks for the links with an even last id digit."""
    pages = V.table(spark, sf_dir, "pages")
    names = pages.select(base_domain(F.col("url")).alias("name"))
    domains = settled(K.domain_upsert(V.view(spark, sf_dir, "domains"), names))
    found = L.prune(L.anchors(pages)).select(
        F.lit("found").alias("kind"), "domain", "url", F.col("html").alias("link_html"),
        F.lit(V.EPOCH).cast("timestamp_ntz").alias("at"),
        F.struct((F.col("page_id") % 2).alias("part"), "page_id", "ordinal").alias("seq"),
    )
    none = V.view(spark, sf_dir, "category_links").limit(0)
    store = scratch_dir(spark, "catalog")
    linkstore.create(none, store, STORE_BUCKETS)
    _arriving(spark, settled(found), ["seq.part = 0", "seq.part = 1"], lambda s: s, each=J.store_upsert(store, domains, STORE_BUCKETS))
    links = settled(linkstore.read(spark, store).drop("bucket"))
    named = links.join(domains.select(F.col("id").alias("domain_id"), F.col("name").alias("domain")), "domain_id")
    marks = named.where("id % 10 % 2 = 0").select(
        F.lit("crawled").alias("kind"), "domain", "url", "link_html", F.lit(V.AS_OF).cast("timestamp_ntz").alias("at"),
        F.struct(F.lit(2).cast("bigint").alias("part"), F.col("id").alias("page_id"), F.lit(0).alias("ordinal")).alias("seq"),
    )
    later = scratch_dir(spark, "catalog")
    J.start_catalog(spark, later, links)
    _arriving(spark, marks, ["true"], lambda s: s, each=J.catalog_upsert(later, domains))
    return J.catalog_table(spark, later).select(
        "id", "url", "domain_id", F.coalesce(F.date_format("last_crawled_at", FORMAT), F.lit("never")).alias("last_crawled_at")
    )


@query(
    "stream_latest_schema",
    f"""select domain_id, id, schema_json, strftime(generated_at, '{DUCK_FORMAT}') as generated_at from (
        select *, row_number() over (partition by domain_id order by generated_at desc, id desc) as rn from product_schemas) where rn = 1""",
)
def stream_latest_schema(spark, sf_dir):
    schemas = V.view(spark, sf_dir, "product_schemas")
    out = scratch_dir(spark, "schemas")
    parts = ["id % 3 = 1", "id % 3 = 0", "id % 3 = 2"]
    _arriving(spark, schemas, parts, J.latest_schema, mode="update", each=J.log_changes(out))
    return J.merged(spark, out, ["domain_id"]).withColumn("generated_at", F.date_format("generated_at", FORMAT))
