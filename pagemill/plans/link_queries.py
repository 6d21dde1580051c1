"""Link discovery over the page corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions.urls import base_domain
from pagemill.operators import links as L
from pagemill.plans import views as V
from pagemill.plans.registry import query

# Href shapes the corpus itself lacks, derived from its anchors.
HREF_SHAPES = """case (page_id + ordinal) % 12
    when 1 then substr(href, 2, 1000) when 2 then '../x/./' || substr(href, 2, 1000) when 3 then '?p=' || cast(ordinal as string)
    when 4 then '#top' when 5 then '//other.example.com' || href when 6 then 'javascript:;'
    when 7 then 'a/../../b//' || substr(href, 2, 1000) || '/..' when 8 then 'mailto:x@example.com' when 9 then 'tel:123'
    when 10 then '  ' || href || ' ' when 11 then 'https://www.other.example.com' || href else href end"""
REJECT_SHAPES = """case (page_id + ordinal) % 10
    when 0 then '/my-account' when 1 then '/help' || href when 2 then '/about-us' when 3 then '/Store-Locator'
    when 4 then '/giftcard' when 5 then '/checkout?x=1' when 6 then '/policies' when 7 then '/Shop' || href
    when 8 then 'javascript:void(0)' else href end"""


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "pages")


def shaped(spark: SparkSession, sf_dir: str, shapes: str = HREF_SHAPES) -> DataFrame:
    return L.anchors(pages(spark, sf_dir)).withColumn("href", F.expr(shapes))


SHAPED_SQL = f"(select page_id, page_url, ordinal, {HREF_SHAPES} as href from anchors)"
SHAPED_RESOLVED_SQL = f"""(select *, {V.base_domain("url")} as domain, {V.base_domain("page_url")} as page_domain
    from (select *, {V.resolve("h", "page_url")} as url from (select *, {V.stripped("href")} as h from {SHAPED_SQL})))"""


@query("anchor_extract", "select page_id, ordinal, href, html, title from anchors")
def anchor_extract(spark, sf_dir):
    return L.anchors(pages(spark, sf_dir)).select("page_id", "ordinal", "href", "html", "title")


STYLED = "replace(replace(replace(html, '<a ', '<a class=\"x\" target=''_blank'' data-k=1 '), 'href=', 'rel=nofollow href='), '</a>', ' <b>more</b>&lt;i> &#x26;amp; &</a>')"


@query(
    "anchor_clean",
    f"""select page_id, ordinal, {V.drop_attrs(V.open_tag("styled"), "^(?:rel|target|style|aria-haspopup|aria-expanded|class)$")}
        || {V.escaped("body")} || 'more' || '&lt;i&gt; &amp;amp; &amp;</a>' as clean_html from (select *, {STYLED} as styled from anchors)""",
)
def anchor_clean(spark, sf_dir):
    styled = L.anchors(pages(spark, sf_dir)).withColumn(
        "html", F.expr(STYLED.replace("''_blank''", "\\'_blank\\'"))
    )
    return styled.select("page_id", "ordinal", L.clean_anchor(F.col("html")).alias("clean_html"))


@query("base_domain", f"select {V.base_domain('url')} as domain, count(*) as n_pages from pages group by 1")
def pages_per_site(spark, sf_dir):
    return pages(spark, sf_dir).groupBy(base_domain(F.col("url")).alias("domain")).agg(F.count("*").alias("n_pages"))


@query("url_resolve", f"select page_id, ordinal, href, url from {SHAPED_RESOLVED_SQL}")
def url_resolve(spark, sf_dir):
    return L.resolved(shaped(spark, sf_dir)).select("page_id", "ordinal", "href", "url")


@query(
    "link_scheme_filter",
    f"""select page_id, ordinal, href from {SHAPED_SQL} where not regexp_matches(href, '^[{V.P.WS}]*($|mailto:|tel:|#)')""",
)
def link_scheme_filter(spark, sf_dir):
    return shaped(spark, sf_dir).where(L.scheme_ok(F.col("href"))).select("page_id", "ordinal", "href")


@query(
    "link_internal_only",
    f"select page_id, ordinal, url, domain from {SHAPED_RESOLVED_SQL} where domain = page_domain",
)
def link_internal_only(spark, sf_dir):
    return L.resolved(shaped(spark, sf_dir)).where("domain = page_domain").select("page_id", "ordinal", "url", "domain")


@query(
    "link_first_seen",
    f"select page_id, url, min(ordinal) as ordinal from {SHAPED_RESOLVED_SQL} group by page_id, url",
)
def link_first_seen(spark, sf_dir):
    return L.first_seen(L.resolved(shaped(spark, sf_dir))).select("page_id", "url", "ordinal")


@query("link_prune", "select page_id, domain, ordinal, url, title from pruned")
def link_prune(spark, sf_dir):
    return L.page_links(pages(spark, sf_dir)).select("page_id", "domain", "ordinal", "url", "title")


@query(
    "link_reject_reason",
    f"""select page_id, ordinal, href, coalesce({V.reject_reason("href")}, 'kept') as reason
        from (select page_id, ordinal, {REJECT_SHAPES} as href from anchors)""",
)
def link_reject_reason(spark, sf_dir):
    return shaped(spark, sf_dir, REJECT_SHAPES).select(
        "page_id", "ordinal", "href", F.coalesce(L.reject_reason(F.col("href")), F.lit("kept")).alias("reason")
    )


@query(
    "category_link_output",
    f"""select p.page_id, p.domain, p.ordinal, p.url as href, c.clean_html as html
        from pruned p join clean_anchors c on p.page_id = c.page_id and p.ordinal = c.ordinal
        where {V.reject_reason("p.url")} is null""",
)
def category_link_output(spark, sf_dir):
    return L.category_links(pages(spark, sf_dir))


@query(
    "classifier_prompt",
    """select p.page_id, string_agg('- ' || p.url || ' - ' || substr(c.clean_html, 1, 150), chr(10) order by p.ordinal) as prompt,
         count(*) filter (length(c.clean_html) > 150) as n_cut from pruned p join clean_anchors c on p.page_id = c.page_id and p.ordinal = c.ordinal group by p.page_id""",
)
def classifier_prompt(spark, sf_dir):
    return L.classifier_prompt(L.page_links(pages(spark, sf_dir)))


@query(
    "classifier_match",
    """select p.page_id, p.ordinal, p.url from pruned p join link_responses r on p.page_id = r.page_id and p.url = r.url
       where r.error is null""",
)
def classifier_match(spark, sf_dir):
    pruned = L.page_links(pages(spark, sf_dir))
    responses = (
        pruned.where("ordinal % 2 = 0")
        .groupBy("page_id")
        .agg(F.collect_list("url").alias("category_urls"))
        .withColumn("error", F.expr("case when page_id % 9 = 0 then 'timeout' end"))
    )
    return L.classifier_match(pruned, responses).select("page_id", "ordinal", "url")


@query(
    "link_funnel",
    f"""select r.domain, raw_links, coalesce(reduced_links, 0) as reduced_links, coalesce(accepted_links, 0) as accepted_links
        from (select page_domain as domain, count(*) as raw_links from resolved group by 1) r
        left join (select domain, count(*) as reduced_links,
            count(*) filter ({V.reject_reason("url")} is null) as accepted_links from pruned group by 1) p
          on r.domain = p.domain""",
)
def link_funnel(spark, sf_dir):
    return L.funnel(pages(spark, sf_dir))


@query(
    "domain_link_report",
    "select d.name as domain, l.id, '- ' || l.url as line from category_links l join domains d on l.domain_id = d.id",
)
def domain_link_report(spark, sf_dir):
    links, domains = (V.view(spark, sf_dir, n) for n in ("category_links", "domains"))
    listed = links.join(domains.select(F.col("id").alias("domain_id"), "name"), "domain_id")
    return listed.select(
        F.col("name").alias("domain"), "id", F.concat(F.lit("- "), F.col("url")).alias("line")
    ).orderBy("domain", "id")
