"""Product extraction, validation and coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.functions import patterns as P
from pagemill.functions.urls import base_domain
from pagemill.operators import catalog as K
from pagemill.operators import elements as E
from pagemill.operators import extraction as T
from pagemill.operators import links as L
from pagemill.operators import scoring as S
from pagemill.operators import selection as X
from pagemill.plans import views as V
from pagemill.plans.catalog_queries import FORMAT, new_ids
from pagemill.plans.registry import query
from pagemill.session import settled

CELLS = ["name", "price", "url", "image_url", "sku", "blurb", "badge"]


def child_sql(columns: str, where: str) -> str:
    """First matching descendant of each item."""
    return f"""(select page_id, base_id, {columns} from (select i.page_id, i.node_id as base_id, e.*,
        row_number() over (partition by i.page_id, i.node_id order by e.start_pos) as rn
        from items i join listing_elements e on e.page_id = i.page_id and e.start_pos > i.start_pos and e.end_pos <= i.end_pos
        where {where}) where rn = 1)"""


EXTRACT_SQL = f"""
select i.page_id, i.node_id as base_id, l.domain, n.text as name, p.text as price, a.href as url, coalesce(g.src, 'none') as image_url,
  {V.attr("i.src", "data-item-id")} as sku, b.fragment as blurb, d.text as badge
from items i join listing l on l.page_id = i.page_id
left join {child_sql("text", "e.tag = 'h3'")} n on n.page_id = i.page_id and n.base_id = i.node_id
left join {child_sql("text", f"e.tag = 'span' and {V.attr('e.src', 'class')} = 'price'")} p on p.page_id = i.page_id and p.base_id = i.node_id
left join {child_sql(V.attr("src", "href") + " as href", "e.tag = 'a'")} a on a.page_id = i.page_id and a.base_id = i.node_id
left join {child_sql(V.attr("src", "src") + " as src", "e.tag = 'img'")} g on g.page_id = i.page_id and g.base_id = i.node_id
left join {child_sql("fragment", "e.tag = 'p'")} b on b.page_id = i.page_id and b.base_id = i.node_id
left join {child_sql("text", f"e.tag = 'div' and {V.attr('e.src', 'class')} = 'promo'")} d on d.page_id = i.page_id and d.base_id = i.node_id"""


@query("schema_extract", EXTRACT_SQL)
def schema_extract(spark, sf_dir):
    return T.schema_extract(V.view(spark, sf_dir, "listing"), settled(V.view(spark, sf_dir, "schema_fields")), CELLS)


def _answers(spark, sf_dir):
    """The model's answers, and for each another that is JSON of a wrong shape."""
    good = V.view(spark, sf_dir, "responses")
    odd = F.element_at(F.array(*map(F.lit, ["[1]", "5", '{"products":"oops"}', '"text"', "null"])), (F.col("page_id") % 5 + 1).cast("int"))
    return good.unionByName(good.withColumn("payload", odd))


@query(
    "payload_explode",
    """select page_id, domain, i - 1 as ordinal, json_extract_string(p, '$.name') as name, json_extract_string(p, '$.price') as price, next_page
       from (select page_id, domain, json_extract_string(payload, '$.next_page') as next_page,
           unnest(range(1, cast(json_array_length(payload, '$.products') as bigint) + 1)) as i, unnest(json_extract(payload, '$.products[*]')) as p
         from responses where json_valid(payload))""",
)
def payload_explode(spark, sf_dir):
    return T.payload_products(_answers(spark, sf_dir)).drop("title")


@query(
    "payload_reject",
    """select domain, count(*) as n_payloads, count(*) filter (not json_valid(payload)) + count(*) as n_rejected
       from responses group by domain""".replace("count(*) as n_payloads", "2 * count(*) as n_payloads"),
)
def payload_reject(spark, sf_dir):
    return T.payload_rejects(_answers(spark, sf_dir))


PRICE_OK = f"coalesce(regexp_full_match({V.stripped(chr(114) + 'eplace(price, ' + chr(39) + '$' + chr(39) + ', ' + chr(39) * 2 + ')')}, '\\d[\\d,]*\\.?\\d*'), false)"
NAME_OK = "(trim(coalesce(name, '')) <> '' or trim(coalesce(title, '')) <> '')"


@query("product_validate", f"select product_id, copy_no, name, title, price from offers where {NAME_OK} and {PRICE_OK}")
def product_validate(spark, sf_dir):
    return T.product_validate(V.view(spark, sf_dir, "offers")).select("product_id", "copy_no", "name", "title", "price")


@query(
    "product_reject_reason",
    f"""select domain, case when not {NAME_OK} then 'blank name' when not {PRICE_OK} then 'bad price' else 'valid' end as reason, count(*) as n
        from offers group by 1, 2""",
)
def product_reject_reason(spark, sf_dir):
    reason = F.coalesce(T.reject_reason(), F.lit("valid")).alias("reason")
    return V.view(spark, sf_dir, "offers").groupBy("domain", reason).agg(F.count("*").alias("n"))


@query(
    "product_dedup",
    """select domain, coalesce(url, sku) as key, name, price, min(product_id) as product_id, min(copy_no) as copy_no
       from offers group by 1, 2, 3, 4""",
)
def product_dedup(spark, sf_dir):
    return T.product_dedup(V.view(spark, sf_dir, "offers"), ["product_id", "copy_no"]).select(
        "domain", F.coalesce("url", "sku").alias("key"), "name", "price", "product_id", "copy_no"
    )


@query(
    "extract_by_mode",
    (
        f"""select page_id, domain, name, price, 'schema' as mode from ({EXTRACT_SQL}) where page_id % 4 < 2
            union all select page_id, domain, json_extract_string(p, '$.name'), json_extract_string(p, '$.price'), 'llm' from (
              select page_id, domain, unnest(json_extract(payload, '$.products[*]')) as p from responses where json_valid(payload) and page_id % 4 = 2)
            union all select page_id, domain, null, null, 'rejected' from listing where page_id % 4 = 3"""
    ),
)
def extract_by_mode(spark, sf_dir):
    pages = settled(V.view(spark, sf_dir, "listing"))
    mode = F.when(F.col("page_id") % 4 < 2, "schema").when(F.col("page_id") % 4 == 2, "llm").otherwise("other")
    products, rejected = T.extract_by_mode(
        pages.withColumn("mode", mode), settled(V.view(spark, sf_dir, "schema_fields")), V.view(spark, sf_dir, "responses")
    )
    null = F.lit(None).cast("string")
    failed = rejected.join(pages.select("page_id", "domain"), "page_id").select(
        "page_id", "domain", null.alias("name"), null.alias("price"), F.lit("rejected").alias("mode")
    )
    return products.drop("title").unionByName(failed)


@query(
    "pagination_chain",
    """select start_url, depth, page_url from (select * from chain)""",
)
def pagination_chain(spark, sf_dir):
    responses = V.view(spark, sf_dir, "responses")
    return T.pagination_chain(responses.select("page_url"), responses)


@query(
    "listing_coverage",
    (
        f"""select l.page_id, max(try_cast({V.attr("l.src", "data-total-products")} as int)) as declared, any_value(coalesce(found, 0)) as found,
              any_value(coalesce(with_name, 0)) as with_name, any_value(coalesce(with_price, 0)) as with_price
            from listing_elements l left join (
              select page_id, count(*) as found, count(*) filter (named) as with_name, count(*) filter (priced) as with_price from (
                select i.page_id, i.node_id, bool_or(e.tag = 'h3') as named,
                  bool_or(e.tag in ('span', 'p') and contains(lower(coalesce({V.attr("e.src", "class")}, '')), 'price')) as priced
                from items i join listing_spans e on e.page_id = i.page_id and e.start_pos > i.start_pos and e.end_pos <= i.end_pos
                group by i.page_id, i.node_id) group by page_id) c on c.page_id = l.page_id group by l.page_id"""
    ),
)
def listing_coverage(spark, sf_dir):
    return T.listing_coverage(settled(E.elements(V.view(spark, sf_dir, "listing"))))


@query(
    "fragment_coverage",
    (
        """select c.page_id, c.node_id, case when bool_or(i.node_id = c.node_id) then 'item' when count(i.node_id) > 0 then 'holds items'
             else 'neither' end as kind, count(i.node_id) as n_items
           from listing_scored c left join items i on i.page_id = c.page_id and i.start_pos >= c.start_pos and i.end_pos <= c.end_pos
           group by c.page_id, c.node_id"""
    ),
)
def fragment_coverage(spark, sf_dir):
    elems = settled(E.elements(V.view(spark, sf_dir, "listing"), text=(P.MIN_CHARS, P.MAX_CHARS)))
    return T.fragment_coverage(S.product_candidates(elems, V.entities(elems)), elems)


@query(
    "extraction_report",
    f"""select 'run-' || cast(product_id % 2 as string) as run_id, domain, category_url, count(*) as n_rows,
          count(*) filter ({NAME_OK} and {PRICE_OK}) as n_valid, count(*) filter (not ({NAME_OK} and {PRICE_OK})) as n_failed
        from offers group by 1, 2, 3""",
)
def extraction_report(spark, sf_dir):
    run = F.concat(F.lit("run-"), F.col("product_id") % 2)
    return T.extraction_report(V.view(spark, sf_dir, "offers").withColumn("run_id", run))


SITE_NAMES = f"(select {V.base_domain('url')} as name from pages union select domain from listing)"
SITE_DOMAINS = f"""(select id, name from domains union all select {new_ids("name", "select max(id) from domains")} as id, name
    from {SITE_NAMES} where name not in (select name from domains))"""
# Each listing goes on for five pages of the same products, more than a run takes from a site.
SITE_PAGES = "(select page_id, url || case when n > 0 then '?page=' || n else '' end as url from listing, range(5) r(n))"
SITE_URLS = f"(select url from pruned where {V.reject_reason('url')} is null union select url from {SITE_PAGES})"


@query(
    "site_run",
    f"""select r.most as links_a_site, e.domain, l.url as category_url, e.name, e.price, e.url, e.sku, d.id as domain_id, k.id as category_link_id,
          '{V.AS_OF}' as crawled_at
        from ({EXTRACT_SQL}) e join {SITE_PAGES} l on l.page_id = e.page_id join {SITE_DOMAINS} d on d.name = e.domain
        join (select id, url, row_number() over (partition by {V.base_domain("url")} order by id) as turn
              from (select {new_ids("url", "0")} as id, url from {SITE_URLS})) k on k.url = l.url
        join (values (3), (1000000)) r(most) on k.turn <= r.most""",
)
def site_run(spark, sf_dir):
    """Category phase, then product phase over the due links of every site, then their crawl marks: once for all due
    links, once for the three that are due first at each site."""
    listed = V.view(spark, sf_dir, "listing").withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(4))))
    further = F.when(F.col("n") > 0, F.concat(F.lit("?page="), "n")).otherwise("")
    sites = settled(listed.withColumns({"page_id": F.col("page_id") * 10 + F.col("n"), "url": F.concat("url", further)}).drop("n"))
    crawled = V.table(spark, sf_dir, "pages")
    domains = settled(
        K.domain_upsert(
            V.view(spark, sf_dir, "domains"),
            crawled.select(base_domain(F.col("url")).alias("name")).unionByName(sites.select(F.col("domain").alias("name"))),
        )
    )
    found = L.category_links(crawled).select("page_id", "ordinal", "domain", F.col("href").alias("url"), F.col("html").alias("link_html"))
    listed = sites.select("page_id", F.lit(0).alias("ordinal"), "domain", "url", F.lit(None).cast("string").alias("link_html"))
    batch = found.unionByName(listed).withColumn("found_at", F.lit(V.EPOCH).cast("timestamp_ntz"))
    none = V.view(spark, sf_dir, "category_links").limit(0)
    links = settled(K.category_link_upsert(none, domains, batch, ["page_id", "ordinal"]))
    fields = settled(V.view(spark, sf_dir, "schema_fields"))

    def run(most):
        due = settled(sites.join(K.next_k_to_crawl(links, most).select("url"), "url", "left_semi"))
        products = T.product_validate(T.schema_extract(due, fields))
        placed = settled(products.join(due.select("page_id", F.col("url").alias("category_url")), "page_id"))
        stored, _ = K.product_insert(placed, links, domains)
        marks = due.select("domain", "url", F.lit(V.AS_OF).cast("timestamp_ntz").alias("crawled_at"))
        marked = K.mark_crawled(links, domains, marks).select(F.col("id").alias("category_link_id"), "last_crawled_at")
        return stored.join(marked, "category_link_id").select(
            F.lit(most or 1_000_000).alias("links_a_site"), "domain", "category_url", "name", "price", "url", "sku", "domain_id",
            "category_link_id", F.date_format("last_crawled_at", FORMAT).alias("crawled_at"),
        )

    return run(None).unionByName(run(P.LINKS_PER_RUN))


@query(
    "strategy_as_data",
    (
        f"""select page_id, base_id, domain, name, price, sku from ({EXTRACT_SQL}) where page_id % 100 % 3 > 0
            union all select page_id, base_id, domain, name, null, sku from ({EXTRACT_SQL}) where page_id % 100 % 3 = 0"""
    ),
)
def strategy_as_data(spark, sf_dir):
    """Schemas stored as JSON versions; every page uses its own domain's latest one."""
    pages = settled(V.view(spark, sf_dir, "listing"))
    fields = '[{"name":"name","selector":"div.grid h3","type":"text"}%s]'
    base = '"baseSelector":"body div.galleryItem","baseFields":[{"name":"sku","type":"attribute","attribute":"data-item-id"}]'
    with_price = '{%s,"fields":%s}' % (base, fields % ',{"name":"price","selector":"div.product-card [class]","type":"text"}')
    without = '{%s,"fields":%s}' % (base, fields % "")
    sites = pages.select("domain", "page_id").groupBy("domain").agg(F.min(F.col("page_id") % 100).alias("no"))
    old = sites.select("domain", F.lit(1).alias("version"), F.lit(without).alias("schema_json"))
    new = sites.where("no % 3 > 0").select("domain", F.lit(2).alias("version"), F.lit(with_price).alias("schema_json"))
    latest = old.unionByName(new).groupBy("domain").agg(F.max_by("schema_json", "version").alias("schema_json"))
    out = T.schema_extract(pages, T.schema_fields(latest))
    return out.select("page_id", "base_id", "domain", "name", "price", "sku")
