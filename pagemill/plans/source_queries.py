"""Scans and sinks, each written and read back where it is a sink."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.functions import markup as M
from pagemill.functions.urls import base_domain
from pagemill.plans import views as V
from pagemill.plans.registry import query
from pagemill.session import scratch_dir
from pagemill.sources import readers as R
from pagemill.sources import sinks

FETCHED = """select page_id, url, case when page_id % 9 = 0 then '' when page_id % 10 = 0 then null else html end as html,
    page_id % 7 > 0 as success, case when page_id % 7 = 0 and page_id % 2 = 0 then 'timeout' end as error from {pages}"""


@query(
    "page_scan",
    f"""select page_id, url, case when not success then coalesce(error, 'failed') when coalesce(html, '') = '' then 'empty'
        else 'kept' end as outcome, length(coalesce(html, '')) as n_chars from ({FETCHED.format(pages="pages")})""",
)
def page_scan(spark, sf_dir):
    fetched = spark.sql(FETCHED, pages=V.table(spark, sf_dir, "pages"))
    size = F.length(F.coalesce("html", F.lit(""))).alias("n_chars")
    return R.with_outcome(fetched).select("page_id", "url", F.coalesce("reason", F.lit("kept")).alias("outcome"), size)


@query(
    "url_list_text",
    f"""select url from (select {V.stripped("line")} as url from (select unnest(string_split(text, chr(10))) as line from (
        select text from documents union all select line from text_lines))) where url <> '' and url not like '#%'""",
)
def url_list_text(spark, sf_dir):
    documents, lines = V.table(spark, sf_dir, "documents"), V.view(spark, sf_dir, "text_lines")
    path = scratch_dir(spark, "urls")
    documents.select(F.explode(F.split("text", "\n")).alias("line")).unionByName(lines.select("line")).write.text(path)
    return R.urls_from_text(spark, path)


JSON_SHAPES = """select event_id, case event_id % 6 when 0 then props when 1 then '[' || props || ',"' || event_type || '", 5, [1]]'
    when 2 then '{"url": "https://x.example.com/' || cast(event_id as string) || '"}' when 3 then '[{"other": 1}, {"k": "z' || cast(event_id as string) || '"}]'
    when 4 then '"' || event_type || '"' else '{broken' end as doc from events"""


@query(
    "url_list_json",
    f"""select url from (
          select json_extract_string(doc, '$.k') as url from ({JSON_SHAPES}) where json_valid(doc) and json_type(doc) = 'OBJECT'
          union all select case json_type(item) when 'OBJECT' then json_extract_string(item, '$.k')
              when 'VARCHAR' then json_extract_string(item, '$') end as url
            from (select unnest(json_extract(doc, '$[*]')) as item from ({JSON_SHAPES}) where json_valid(doc) and json_type(doc) = 'ARRAY'))
        where url is not null""",
)
def url_list_json(spark, sf_dir):
    events = V.table(spark, sf_dir, "events")
    docs = spark.sql(JSON_SHAPES.replace("{", "{{").replace("}", "}}").replace("from events", "from {events}"), events=events)
    return R.urls_from_json_column(docs, "doc", "k")


LABEL_LINES = """select case doc_id % 6 when 0 then '' when 1 then '  ' when 2 then '{"url": "cut' else
    concat('{"url":"', url, '","is_plp":', cast(is_plp as string), ',"domain":"', domain, '","content_hash":"', content_hash, '"}') end as value from samples"""


@query("labels_jsonl", "select url, is_plp, domain, content_hash from samples where doc_id % 6 > 2")
def labels_jsonl(spark, sf_dir):
    lines = spark.sql(
        LABEL_LINES.replace("{", "{{").replace("}", "}}").replace("from samples", "from {samples}"),
        samples=V.view(spark, sf_dir, "samples"),
    )
    path = scratch_dir(spark, "labels")
    lines.write.text(path)
    return R.labels_jsonl(spark, path).select("url", "is_plp", "domain", "content_hash")


@query(
    "schema_json_roundtrip",
    "select id, domain_id, cast(json_extract_string(schema_json, '$.k') as int) as k, 'x' || cast(id as string) as name from product_schemas",
)
def schema_json_roundtrip(spark, sf_dir):
    schemas = V.view(spark, sf_dir, "product_schemas")
    k = F.from_json("schema_json", "k int")
    path = scratch_dir(spark, "schemas")
    sinks.append_schemas(
        schemas.select(
            "id", "domain_id", F.struct(k["k"].alias("k"), F.concat(F.lit("x"), F.col("id")).alias("name")).alias("schema")
        ),
        path,
    )
    back = spark.read.parquet(path).withColumn("s", F.from_json("schema_json", "k int, name string"))
    return back.select("id", "domain_id", "s.k", "s.name")


@query("products_json_sink", "select product_id, name, price, original_price, url, sku from offers")
def products_json_sink(spark, sf_dir):
    path = scratch_dir(spark, "products")
    sinks.write_products(V.view(spark, sf_dir, "offers"), path)
    schema = "product_id bigint, name string, price string, original_price string, url string, sku string"
    return spark.read.schema(schema).json(path)


@query("labels_append_sink", "select url, is_plp, domain, content_hash from samples")
def labels_append_sink(spark, sf_dir):
    samples = V.view(spark, sf_dir, "samples").select("doc_id", "url", "is_plp", "domain", "content_hash")
    path = scratch_dir(spark, "labels")
    for part in ("doc_id % 2 = 0", "doc_id % 2 = 1"):
        sinks.append_labels(samples.where(part).drop("doc_id"), path)
    return spark.read.schema("url string, is_plp int, content_hash string, domain string").json(path)


@query(
    "page_artifact_sink",
    f"""select case when page_id % 2 = 0 then 'r1' else '' end as run_id, kind, replace(domain, '.', '_')
          || case when page_id % 2 = 0 then '_r1' else '' end || '_' || kind as name, md5(html) as body_md5
        from (select page_id, html, {V.base_domain("url")} as domain, unnest(['raw', 'cleaned']) as kind from pages)""".replace(
        "md5(html)", f"md5(case kind when 'raw' then html else regexp_replace(html, '{V.containers(['script', 'style'])}', '', 'g') end)"
    ),
)
def page_artifact_sink(spark, sf_dir):
    pages = V.table(spark, sf_dir, "pages")
    run_id = F.when(F.col("page_id") % 2 == 0, "r1").otherwise("")
    cleaned = M.remove_containers(F.col("html"), ["script", "style"])
    bodies = F.array(*(F.struct(F.lit(k).alias("kind"), b.alias("body")) for k, b in (("raw", F.col("html")), ("cleaned", cleaned))))
    rows = pages.select(base_domain(F.col("url")).alias("domain"), run_id.alias("run_id"), F.inline(bodies))
    named = rows.withColumn("name", sinks.artifact_name(F.col("domain"), F.col("run_id"), F.col("kind")))
    path = scratch_dir(spark, "artifacts")
    sinks.write_artifacts(named, path)
    back = spark.read.parquet(path)
    return back.select(F.coalesce("run_id", F.lit("")).alias("run_id"), "kind", "name", F.md5("body").alias("body_md5"))


@query(
    "page_cache_scan",
    """with fetched as (select url, html, page_id, 0 as fetched_at from pages
         union all select url, html || '<!-- later -->', page_id + 1000000, 1 from pages where page_id % 3 = 0),
       snapshot as (select url, arg_min(html, page_id) as html from pages where page_id % 2 = 0 group by url)
       select url, source, md5(html) as html_md5, mode from (
         select url, html, 'cache' as source, 'cached' as mode from snapshot
         union all select url, arg_max(html, (fetched_at, page_id)), 'fetch', 'cached' from fetched where url not in (select url from snapshot) group by url
         union all select url, arg_max(html, (fetched_at, page_id)), 'fetch', 'bypass' from fetched group by url)""",
)
def page_cache_scan(spark, sf_dir):
    pages = V.table(spark, sf_dir, "pages")
    first = pages.select("url", "html", F.col("page_id").alias("fetch_id"), F.lit(0).alias("fetched_at"))
    later = pages.where("page_id % 3 = 0").select(
        "url", F.concat("html", F.lit("<!-- later -->")).alias("html"), (F.col("page_id") + 1000000).alias("fetch_id"), F.lit(1).alias("fetched_at")
    )
    fetched = first.unionByName(later)
    snapshot = pages.where("page_id % 2 = 0").groupBy("url").agg(F.min_by("html", "page_id").alias("html"))
    cached = R.cached_or_newest(snapshot, fetched, True).withColumn("mode", F.lit("cached"))
    bypass = R.cached_or_newest(snapshot, fetched, False).withColumn("mode", F.lit("bypass"))
    return cached.unionByName(bypass).select("url", "source", F.md5("html").alias("html_md5"), "mode")
