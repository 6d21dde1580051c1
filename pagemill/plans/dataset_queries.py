"""URL pool, labelled dataset, evaluation, and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.operators import dataset as D
from pagemill.operators import elements as E
from pagemill.operators import scoring as S
from pagemill.operators import selection as X
from pagemill.plans import views as V
from pagemill.plans.catalog_queries import DUCK_FORMAT, FORMAT
from pagemill.plans.fragment_queries import fragment_vectors
from pagemill.plans.registry import query
from pagemill.session import scratch_dir, settled
from pagemill.sources import readers, sinks

NAMED_LINKS = "(select l.id, l.url, d.name as domain from category_links l join domains d on d.id = l.domain_id)"
POOL_LIMIT = 500
SAMPLE_TOTAL = 130


def _load(spark, sf_dir, *names):
    return [V.view(spark, sf_dir, n) for n in names]


def _labelled(spark, sf_dir):
    """Some category links count as labelled: those whose id a sample shares."""
    links, samples = _load(spark, sf_dir, "category_links", "samples")
    return links.join(samples.select(F.col("doc_id").alias("id")), "id", "left_semi").select("url")


LABELLED = "(select url from category_links where id in (select doc_id from samples))"


@query("category_url_pool", f"select id, url, domain from {NAMED_LINKS}")
def category_url_pool(spark, sf_dir):
    return D.url_pool(*_load(spark, sf_dir, "category_links", "domains"))


@query("category_url_pool_first", f"select id, url, domain from {NAMED_LINKS} where domain = 'brand11.example.com' order by id limit {POOL_LIMIT}")
def category_url_pool_first(spark, sf_dir):
    """The first URLs of one domain: both limits are what is asked for."""
    return D.url_pool(*_load(spark, sf_dir, "category_links", "domains"), domain="brand11.example.com", limit=POOL_LIMIT)


@query("domain_stats", f"select domain, count(*) as n_urls from {NAMED_LINKS} group by domain")
def domain_stats(spark, sf_dir):
    return D.domain_stats(*_load(spark, sf_dir, "category_links", "domains"))


@query(
    "pool_summary",
    f"""select null as domain, count(*) as n_urls, count(distinct domain) as n_domains from {NAMED_LINKS}
        union all select domain, count(*), 1 from {NAMED_LINKS} group by domain""",
)
def pool_summary(spark, sf_dir):
    return D.pool_summary(*_load(spark, sf_dir, "category_links", "domains"))


@query("unlabeled_urls", f"select id, url from category_links where url not in {LABELLED}")
def unlabeled_urls(spark, sf_dir):
    links = V.view(spark, sf_dir, "category_links").select("id", "url")
    return D.unlabeled(links, _labelled(spark, sf_dir)).select("id", "url")


@query(
    "continue_labeling",
    f"""select count(*) filter (url in {LABELLED}) as removed, count(*) filter (url not in {LABELLED}) as remaining from category_links""",
)
def continue_labeling(spark, sf_dir):
    return D.continue_counts(V.view(spark, sf_dir, "category_links"), _labelled(spark, sf_dir))


@query(
    "balanced_sample",
    f"""select domain, id, url from (select *, row_number() over (partition by domain order by id) as turn from {NAMED_LINKS})
        where turn <= greatest(1, {SAMPLE_TOTAL} // (select count(distinct domain_id) from category_links)) order by domain, id limit {SAMPLE_TOTAL}""",
)
def balanced_sample(spark, sf_dir):
    return D.balanced_sample(*_load(spark, sf_dir, "category_links", "domains"), SAMPLE_TOTAL)


@query(
    "url_source_priority",
    f"select {V.stripped('line')} as url, 1 as priority from text_lines where {V.stripped('line')} <> '' and {V.stripped('line')} not like '#%'",
)
def url_source_priority(spark, sf_dir):
    lines, links = _load(spark, sf_dir, "text_lines", "category_links")
    from_text = readers.urls_from_lines(lines, "line")
    empty = links.where("id < 0").select("url")
    return D.by_priority(empty, from_text, links)


@query("content_hash", "select md5(text) as content_hash, count(*) as n_rows from documents group by md5(text)")
def content_hash(spark, sf_dir):
    return D.content_groups(V.table(spark, sf_dir, "documents"))


@query("sample_domain", f"select replace({V.netloc('url')}, 'www.', '') as domain, count(*) as n_samples from pages group by 1")
def sample_domain(spark, sf_dir):
    return D.samples_per_domain(V.table(spark, sf_dir, "pages"))


def _batch(spark, sf_dir):
    samples = V.view(spark, sf_dir, "samples").select("doc_id", "url", "html_content", "is_plp", "ts", "cleaned_html")
    return samples, samples.where("doc_id % 11 = 0").select(F.md5("html_content").alias("content_hash"))


ACCEPTED = """(select * from samples where doc_id in (select min(doc_id) from samples group by content_hash)
    and content_hash not in (select content_hash from samples where doc_id % 11 = 0))"""


@query(
    "sample_save",
    f"""select doc_id, url, is_plp, domain, content_hash, 'sample' as part, '' as body from {ACCEPTED}
        union all select -1, '', -1, '', content_hash, 'raw', md5(html_content) from {ACCEPTED}
        union all select -1, '', -1, '', content_hash, 'cleaned', md5(cleaned_html) from {ACCEPTED} where cleaned_html <> ''""",
)
def sample_save(spark, sf_dir):
    batch, stored = _batch(spark, sf_dir)
    samples, contents = D.save_samples(stored, batch, "doc_id")
    rows = samples.select("doc_id", "url", "is_plp", "domain", "content_hash", F.lit("sample").alias("part"), F.lit("").alias("body"))
    bodies = contents.select(
        F.lit(-1).cast("bigint").alias("doc_id"), F.lit("").alias("url"), F.lit(-1).alias("is_plp"), F.lit("").alias("domain"),
        "content_hash", F.col("variant").alias("part"), F.md5("html").alias("body"),
    )
    return rows.unionByName(bodies)


@query(
    "duplicate_samples",
    """select s.doc_id, s.url, s.content_hash, f.first_id, f.first_url from samples s join (
         select content_hash, min(doc_id) as first_id, arg_min(url, doc_id) as first_url from samples group by content_hash) f
       on s.content_hash = f.content_hash and s.doc_id > f.first_id""",
)
def duplicate_samples(spark, sf_dir):
    return D.duplicate_samples(_batch(spark, sf_dir)[0], "doc_id")


@query(
    "content_lookup",
    """select doc_id, md5(coalesce(best, '')) as html_md5, length(coalesce(best, '')) as n_chars from (
         select s.doc_id, coalesce(c.cleaned, c.raw) as best from samples s join (
           select content_hash, max(html_content) as raw, max(cleaned_html) as cleaned from samples group by content_hash) c
         on c.content_hash = s.content_hash
         union all select doc_id + 1000000, null from samples)""",
)
def content_lookup(spark, sf_dir):
    samples = V.view(spark, sf_dir, "samples")
    contents = samples.select("content_hash", F.lit("raw").alias("variant"), F.col("html_content").alias("html")).unionByName(
        samples.where("cleaned_html is not null").select(
            "content_hash", F.lit("cleaned").alias("variant"), F.col("cleaned_html").alias("html")
        )
    )
    unknown = samples.select((F.col("doc_id") + 1000000).alias("doc_id"), F.lit("unknown").alias("content_hash"))
    wanted = samples.select("doc_id", "content_hash").unionByName(unknown)
    found = D.content_lookup(wanted, contents)
    return found.select("doc_id", F.md5("html").alias("html_md5"), F.length("html").alias("n_chars"))


@query(
    "dataset_stats",
    """select count(*) as total_samples, sum(is_plp) as plp_samples, sum(1 - is_plp) as non_plp_samples,
         round(sum(is_plp) / greatest(1, count(*)), 6) as balance_ratio from samples""",
)
def dataset_stats(spark, sf_dir):
    return D.dataset_stats(*_load(spark, sf_dir, "samples")).withColumn("balance_ratio", F.round("balance_ratio", 6))


@query(
    "dataset_domain_stats",
    """select coalesce(domain, 'all') as domain, coalesce(cast(is_plp as string), 'all') as label, count(*) as n_samples
       from samples group by rollup (domain, is_plp)""",
)
def dataset_domain_stats(spark, sf_dir):
    return D.dataset_domain_stats(*_load(spark, sf_dir, "samples")).select(
        F.coalesce("domain", F.lit("all")).alias("domain"),
        F.coalesce(F.col("is_plp").cast("string"), F.lit("all")).alias("label"),
        "n_samples",
    )


@query(
    "dataset_frame",
    f"""select url, is_plp as label, domain, strftime(ts, '{DUCK_FORMAT}') as timestamp,
        length(coalesce(cleaned_html, html_content, '')) as html_length from samples""",
)
def dataset_frame(spark, sf_dir):
    return D.dataset_frame(*_load(spark, sf_dir, "samples")).withColumn("timestamp", F.date_format("timestamp", FORMAT))


@query(
    "training_export",
    f"""select url, md5(coalesce(cleaned_html, html_content, '')) as html_md5, is_plp as label, domain,
        strftime(ts, '{DUCK_FORMAT}') as timestamp from samples""",
)
def training_export(spark, sf_dir):
    path = scratch_dir(spark, "training")
    sinks.write_training(D.training_records(*_load(spark, sf_dir, "samples")), path)
    back = spark.read.parquet(path)
    return back.select(
        "url", F.md5("html_content").alias("html_md5"), "label", "domain", F.date_format("timestamp", FORMAT).alias("timestamp")
    )


PROMPT_SQL = "'" + V.P.LISTING_QUESTION.replace("'", "''") + "' || substr(html, 1, 16000) || chr(10)"


@query("plp_prompt", f"select page_id, {PROMPT_SQL} as prompt from pages")
def plp_prompt(spark, sf_dir):
    return V.table(spark, sf_dir, "pages").select("page_id", D.plp_prompt(F.col("html")).alias("prompt"))


VERDICT_SQL = "error is null and contains(lower(trim(response)), 'true')"


@query("plp_verdict", f"select model, doc_id, {VERDICT_SQL} as is_plp from verdicts")
def plp_verdict(spark, sf_dir):
    return V.view(spark, sf_dir, "verdicts").select(
        "model", "doc_id", D.plp_verdict(F.col("response"), F.col("error")).alias("is_plp")
    )


@query(
    "model_page_grid",
    "select page_id, url, model from pages, (select unnest(" + str(V.MODELS).replace('"', "'") + ") as model)",
)
def model_page_grid(spark, sf_dir):
    return D.model_page_grid(V.table(spark, sf_dir, "pages"), V.MODELS)


@query(
    "verdict_by_model",
    f"select model, count(*) as n_pages, count(*) filter ({VERDICT_SQL}) as n_positive from verdicts group by model",
)
def verdict_by_model(spark, sf_dir):
    return D.verdicts_by_model(plp_verdict(spark, sf_dir))


@query(
    "filter_accuracy",
    """select count(*) as total, sum(p * is_plp) as true_positive, sum(p * (1 - is_plp)) as false_positive,
         sum((1 - p) * is_plp) as false_negative, sum((1 - p) * (1 - is_plp)) as true_negative,
         round(avg(case when p = is_plp then 1.0 else 0.0 end), 6) as accuracy
       from (select case when l.html like '%galleryItem%' then 1 else 0 end as is_plp, case when k.page_id is null then 0 else 1 end as p
         from listing l left join (select distinct page_id from product_kept) k on k.page_id = l.page_id)""",
)
def filter_accuracy(spark, sf_dir):
    """Does the product filter find a fragment on the pages that hold items, and only there?"""
    pages = settled(V.view(spark, sf_dir, "listing"))
    elems = settled(E.elements(pages, text=True, fragment=True))
    found = X.product_filter(elems, V.entities(elems), fragment_vectors(elems), similarity=V.FRAGMENT_SIMILARITY)
    counts = found.groupBy("page_id").agg(F.count("*").alias("n_fragments"))
    labelled = pages.select("page_id", F.col("html").contains("galleryItem").cast("int").alias("is_plp"))
    return D.filter_accuracy(labelled, counts, "page_id").withColumn("accuracy", F.round("accuracy", 6))


@query(
    "fragment_counts",
    """select page_id, count(*) as n_fragments, sum(outer_len) as total_chars,
         string_agg(fragment, ' | ' order by rank) filter (rank <= 3) as first_fragments
       from (select *, row_number() over (partition by page_id order by score desc, node_id) as rank from listing_scored)
       where rank <= 20 group by page_id""",
)
def fragment_counts(spark, sf_dir):
    elems = settled(E.elements(V.view(spark, sf_dir, "listing"), text=True, fragment=True))
    counted = D.fragment_counts(X.top_n(S.product_candidates(elems, V.entities(elems))))
    return counted.withColumn("first_fragments", F.array_join("first_fragments", " | "))


@query(
    "visited_union",
    "select url from pages union select url from category_links",
)
def visited_union(spark, sf_dir):
    """Every page as new; every category link, and the pages once more, as cached."""
    pages, links = V.table(spark, sf_dir, "pages").select("url"), V.view(spark, sf_dir, "category_links").select("url")
    return D.visited_union(pages, links.unionByName(pages))


@query("frontier_except", "select url from category_links except select url from category_links where last_crawled_at is not null")
def frontier_except(spark, sf_dir):
    links = V.view(spark, sf_dir, "category_links")
    return D.frontier(links, links.where("last_crawled_at is not null"))


@query(
    "product_append",
    """select domain, count(*) as n_products, count(sku) as n_sku from (
         select domain, sku from offers where copy_no = 1 union all select domain, null from offers where copy_no = 2) group by domain""",
)
def product_append(spark, sf_dir):
    offers = V.view(spark, sf_dir, "offers")
    bag = D.append_products(
        offers.where("copy_no = 1").select("domain", "name", "sku"), offers.where("copy_no = 2").select("domain", "name")
    )
    return bag.groupBy("domain").agg(F.count("*").alias("n_products"), F.count("sku").alias("n_sku"))
