"""Page cleaning and text reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.functions import markup as M
from pagemill.functions import patterns as P
from pagemill.functions.text import word_count
from pagemill.functions.urls import base_domain
from pagemill.operators import cleaning as C
from pagemill.operators import elements as E
from pagemill.plans import views as V
from pagemill.plans.registry import query

STRIPPED_TAGS = ["nav", "style", "b", "li"]


def cut_sql(tags, extra: str = "true") -> str:
    return f"""select p.page_id, coalesce(k.html, '') as html from pages p left join (
          select t.page_id, string_agg(tok, '' order by pos) as html from page_tokens t
          where {extra} and not exists (select 1 from page_spans s where s.page_id = t.page_id
              and s.tag in {V.in_list(tags)} and t.pos between s.start_pos and s.end_pos) group by t.page_id) k on k.page_id = p.page_id"""


@query("strip_elements", cut_sql(STRIPPED_TAGS))
def strip_elements(spark, sf_dir):
    return C.strip_elements(V.table(spark, sf_dir, "pages"), STRIPPED_TAGS)


@query(
    "strip_attributes",
    f"""select page_id, string_agg(case when regexp_matches(tok, '^<[A-Za-z]') then
          {V.drop_attrs(V.open_tag("tok"), "^(?:class|char.*|hr.f)$")} || substr(tok, length({V.open_tag("tok")}) + 1)
          else tok end, '' order by pos) as html from page_tokens group by page_id
        union all
        select page_id, regexp_replace(regexp_replace(html, ' (class|data-item-id|data-total-products|src)="[^"]*"', '', 'g'), 'zzz', '') from listing""",
)
def strip_attributes(spark, sf_dir):
    raw = V.table(spark, sf_dir, "pages").select(
        "page_id", C.strip_attributes(F.col("html"), ["class", "char*", "hr?f"]).alias("html")
    )
    cards = V.view(spark, sf_dir, "listing").select(
        "page_id", C.strip_attributes(F.col("html"), ["class", "data-*", "sr?"]).alias("html")
    )
    return raw.unionByName(cards)


@query(
    "html_outline",
    f"""select p.page_id, coalesce(o.html, '') as html from pages p left join (
        select page_id, string_agg(repeat(' ', cast(depth as int)) || line || chr(10), '' order by pos) as html
        from (select t.page_id, t.pos, any_value({V.stripped("t.tok")}) as line,
            count(s.node_id) as depth from page_tokens t left join page_spans s on s.page_id = t.page_id
              and t.pos > s.start_pos and t.pos <= case when s.closed then s.end_pos - 1 else s.end_pos end
            group by t.page_id, t.pos) where line <> '' group by page_id) o on o.page_id = p.page_id""",
)
def html_outline(spark, sf_dir):
    return C.outline(V.table(spark, sf_dir, "pages"))


@query("junk_strip", cut_sql(P.JUNK_TAGS, "kind <> 'comment'"))
def junk_strip(spark, sf_dir):
    return C.strip_elements(V.table(spark, sf_dir, "pages"), P.JUNK_TAGS, comments=True)


@query(
    "page_text",
    """select t.page_id, coalesce(string_agg(txt, ' ' order by pos) filter (txt <> '' and pos < b), '') as head_text,
         coalesce(string_agg(txt, ' ' order by pos) filter (txt <> '' and pos >= b), '') as body_text
       from page_tokens t join (select page_id, min(pos) as b from page_tokens where tag = 'body' and kind = 'open' group by page_id) b
         on t.page_id = b.page_id group by t.page_id""",
)
def page_text(spark, sf_dir):
    head, body = C.head_body_text(F.col("html"))
    return V.table(spark, sf_dir, "pages").select("page_id", head.alias("head_text"), body.alias("body_text"))


@query(
    "clean_size_report",
    f"""select domain, count(*) as n_pages, sum(raw) as raw_chars, sum(clean) as clean_chars, round(sum(clean) / sum(raw), 6) as ratio
        from (select {V.base_domain("url")} as domain, length(html) as raw,
            length(regexp_replace(html, '{V.containers(["script", "style", "noscript"])}', '', 'g')) as clean
          from pages) group by domain""",
)
def clean_size_report(spark, sf_dir):
    sizes = V.table(spark, sf_dir, "pages").select(
        base_domain(F.col("url")).alias("domain"),
        F.length("html").alias("raw"),
        F.length(M.remove_containers(F.col("html"), ["script", "style", "noscript"])).alias("clean"),
    )
    return sizes.groupBy("domain").agg(
        F.count("*").alias("n_pages"),
        F.sum("raw").alias("raw_chars"),
        F.sum("clean").alias("clean_chars"),
        F.round(F.sum("clean") / F.sum("raw"), 6).alias("ratio"),
    )


@query(
    "whitespace_token_count",
    f"""select source, count(*) as n_docs, sum({V.n_words("text")}) as n_tokens, max({V.n_words("text")}) as longest
        from documents group by source""",
)
def whitespace_token_count(spark, sf_dir):
    counted = V.table(spark, sf_dir, "documents").select("source", word_count(F.col("text")).alias("n"))
    return counted.groupBy("source").agg(
        F.count("*").alias("n_docs"), F.sum("n").alias("n_tokens"), F.max("n").alias("longest")
    )


@query(
    "truncate_for_model",
    "select doc_id, substr(text, 1, 16000) as content, length(text) > 16000 as was_cut from documents",
)
def truncate_for_model(spark, sf_dir):
    return V.table(spark, sf_dir, "documents").select(
        "doc_id",
        C.truncate(F.col("text")).alias("content"),
        (F.length("text") > P.MODEL_MAX_CHARS).alias("was_cut"),
    )


@query(
    "chunk_for_model",
    f"""select doc_id, cast(floor((i - 1) / 1000) as int) as chunk_no, count(*) as n_words, md5(string_agg(w, ' ' order by i)) as chunk_md5
        from (select doc_id, unnest(range(1, len(ws) + 1)) as i, unnest(ws) as w from (select doc_id,
            list_filter(regexp_split_to_array(text, '[{P.WS}]+'), lambda w: w <> '') as ws from documents))
        group by 1, 2""",
)
def chunk_for_model(spark, sf_dir):
    pieces = C.chunks(V.table(spark, sf_dir, "documents"), "doc_id", "text")
    return pieces.select("doc_id", "chunk_no", "n_words", F.md5("chunk").alias("chunk_md5"))


@query(
    "page_preview",
    f"""select page_id, url, length(html) as html_length, length(cleaned) as cleaned_length,
          {V.stripped("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title\\s*>', 1)")} as title,
          substr(cleaned, 1, 2000) || case when length(cleaned) > 2000 then '...' else '' end as preview
        from (select *, regexp_replace(html, '{V.containers(["script", "style"])}', '', 'g') as cleaned from pages)""",
)
def page_preview(spark, sf_dir):
    return C.preview(V.table(spark, sf_dir, "pages"))
