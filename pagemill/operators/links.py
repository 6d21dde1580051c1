"""Link discovery: anchors of a page corpus, resolved, pruned and classified.

Extraction runs inside each page row; only short link rows are ever shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import markup as M
from pagemill.functions import patterns as P
from pagemill.functions.staged import computed, let
from pagemill.functions.text import escape_markup, strip_ws
from pagemill.functions.urls import base_domain, url_resolve
from pagemill.operators.skew import first_per_key


def _cuts(html: Column) -> Column:
    """A page's anchors as they are written, each with what follows it."""
    visible = M.remove_containers(html, P.ANCHOR_EXCLUDED_TAGS)
    return F.filter(F.split(visible, r"(?i)(?=<a[\s>])"), lambda s: s.rlike(r"(?i)^<a[\s>]"))


def anchors(pages: DataFrame) -> DataFrame:
    """``page_id, page_url, ordinal, href, html, title`` for every anchor of every page.

    Anchors do not nest, so a page is cut before each ``<a``; an anchor that is never closed
    keeps the text up to the next tag.
    """
    return pages.select(
        "page_id",
        F.col("url").alias("page_url"),
        F.posexplode(F.transform(_cuts(F.col("html")), _link)).alias("ordinal", "link"),
    ).select("page_id", "page_url", "ordinal", "link.href", "link.html", "link.title")


def _link(cut: Column) -> Column:
    closed = F.regexp_extract(cut, r"(?is)^(<a.*?</a\s*>)", 1)
    unclosed = F.regexp_extract(cut, rf"(?is)^(<a{P.IN_TAG}>[^<]*|<a[^>]*>[^<]*)", 1)
    return let(
        F.when(cut.rlike(r"(?i)</a\s*>"), closed).otherwise(unclosed),
        lambda html: F.struct(
            M.attribute(html, "href").alias("href"),
            html.alias("html"),
            let(M.inner_text(html), lambda t: F.when(t == "", P.DEFAULT_LINK_TITLE).otherwise(t)).alias("title"),
        ),
    )


def clean_anchor(html: Column) -> Column:
    """The anchor without presentation attributes, its body reduced to its text (written as markup again)."""
    return F.concat(
        M.drop_attributes(F.regexp_extract(html, P.OPEN_TAG, 1), P.ANCHOR_ATTRS_DROPPED),
        escape_markup(M.inner_text(html)),
        F.lit("</a>"),
    )


def scheme_ok(href: Column) -> Column:
    h = strip_ws(href)
    return (
        F.coalesce(h != "", F.lit(False))
        & ~h.startswith("mailto:")
        & ~h.startswith("tel:")
        & ~h.startswith("#")
    )


def resolved(links: DataFrame) -> DataFrame:
    """Add ``url`` (absolute), ``domain`` (of the link) and ``page_domain``."""
    page_domain = base_domain(F.col("page_url"))
    url = url_resolve(strip_ws(F.col("href")), F.col("page_url"))
    link = let(url, lambda u: F.struct(u.alias("url"), base_domain(u).alias("domain")))
    staged = computed(links, link=link, page_domain=page_domain)
    return staged.withColumns({"url": F.col("link.url"), "domain": F.col("link.domain")}).drop("link")


def first_seen(links: DataFrame) -> DataFrame:
    """First occurrence of each resolved URL of a page, in document order."""
    return first_per_key(links, ["page_id", "url"], ["ordinal"])


def prune(links: DataFrame) -> DataFrame:
    """Valid, internal, absolute, distinct links of each page."""
    kept = resolved(links.where(scheme_ok(F.col("href")))).where("domain = page_domain")
    return first_seen(kept)


def page_links(pages: DataFrame) -> DataFrame:
    """``prune(anchors(pages))`` without a shuffle: ``page_id, page_url, ordinal, href, html, title, url, domain, page_domain``.

    All links of a page are in its row. There they are resolved and put in order of URL and place, so that
    repeats lie side by side; the first of each is left.
    """
    staged = computed(pages.select("page_id", F.col("url").alias("page_url"), "html"), cuts=_cuts(F.col("html")), page_domain=base_domain(F.col("page_url")))
    staged = computed(staged.select("page_id", "page_url", "page_domain", "cuts"), links=F.transform("cuts", lambda c, i: F.struct(i.alias("ordinal"), _link(c).alias("link"))))

    def target(x: Column) -> Column:
        url = url_resolve(strip_ws(x["link"]["href"]), F.col("page_url"))
        return let(url, lambda u: F.struct(u.alias("url"), x["ordinal"].alias("ordinal"), base_domain(u).alias("domain"), x["link"].alias("link")))

    found = F.transform(F.filter("links", lambda x: scheme_ok(x["link"]["href"])), target)
    inside = computed(staged.select("page_id", "page_url", "page_domain", "links"), found=F.array_sort(F.filter(found, lambda x: x["domain"] == F.col("page_domain"))))
    repeats = lambda x, i: (i > 0) & (F.get(F.col("found")["url"], i - 1) == x["url"])
    first = inside.select("page_id", "page_url", "page_domain", F.explode(F.filter("found", lambda x, i: ~repeats(x, i))).alias("x"))
    return first.select("page_id", "page_url", "x.ordinal", "x.link.href", "x.link.html", "x.link.title", "x.url", "x.domain", "page_domain")


def reject_reason(url: Column) -> Column:
    """Name of the first non-category pattern that matches, NULL when none does."""
    groups = list(P.NON_CATEGORY_GROUPS.items())
    expr = F.when(url.rlike("(?i)" + groups[0][1]), groups[0][0])
    for name, pattern in groups[1:]:
        expr = expr.when(url.rlike("(?i)" + pattern), name)
    return expr


def category_links(pages: DataFrame) -> DataFrame:
    """Absolute category-link rows ready for the catalog."""
    found = page_links(pages).where(reject_reason(F.col("url")).isNull())
    return found.select(
        "page_id", "domain", "ordinal", F.col("url").alias("href"), clean_anchor(F.col("html")).alias("html")
    )


def classifier_prompt(links: DataFrame, html_chars: int | None = P.PROMPT_HTML_CHARS) -> DataFrame:
    """One prompt text per page over its pruned links, each with at most ``html_chars`` characters of
    its anchor (None: all of it), and how many anchors were cut."""
    prepared = computed(links, anchor=clean_anchor(F.col("html")))
    shown = F.col("anchor") if html_chars is None else F.substring("anchor", 1, html_chars)
    cut = F.lit(False) if html_chars is None else F.length("anchor") > html_chars
    line = F.concat(F.lit("- "), F.col("url"), F.lit(" - "), shown)
    lines = F.sort_array(F.collect_list(F.struct("ordinal", line.alias("line"))))
    return prepared.groupBy("page_id").agg(
        F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("prompt"), F.count_if(cut).alias("n_cut")
    )


def classifier_match(links: DataFrame, responses: DataFrame) -> DataFrame:
    """Pruned links whose URL a usable response names (``page_id, error, category_urls``)."""
    named = responses.where("error is null").select("page_id", F.explode("category_urls").alias("url"))
    return links.join(named, ["page_id", "url"], "left_semi")


def funnel(pages: DataFrame) -> DataFrame:
    """Raw, pruned and accepted link counts per site.

    The first-seen flag is a min over (page, url), so the page rows are scanned once.
    """
    marked = resolved(anchors(pages)).withColumn(
        "internal", scheme_ok(F.col("href")) & F.coalesce(F.col("domain") == F.col("page_domain"), F.lit(False))
    )
    per_url = marked.groupBy("page_id", "page_domain", "url", "internal").agg(F.count("*").alias("n"))
    accepted = F.col("internal") & reject_reason(F.col("url")).isNull()
    return per_url.groupBy(F.col("page_domain").alias("domain")).agg(
        F.sum("n").alias("raw_links"),
        F.count_if("internal").alias("reduced_links"),
        F.count_if(accepted).alias("accepted_links"),
    )
