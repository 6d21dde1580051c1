"""Input views of the queries, derived from the driver tables.

``shared(dialect)`` holds definitions both engines run (one text, two renderings). The SQL
side has further views (tokens, elements, links ...) that the Spark side computes with the
package's operators.
"""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions import patterns as P

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
]
PARTS_PER_BLOCK = 2000  # keeps a listing page near 80 cards at any scale
LINK_BLOCK = 100
EPOCH = "2024-01-01 00:00:00"
AS_OF = "2024-02-01 00:00:00"
FRAGMENT_SIMILARITY = 0.9995
MODELS = [f"model-{x}" for x in "abcd"]  # stand-ins for the models whose answers are compared


class Dialect:
    def __init__(self, name: str):
        self.name = name
        self.spark = name == "spark"

    def agg(self, expr: str, sep: str, order: str) -> str:
        if self.spark:
            return f"listagg({expr}, '{sep}') within group (order by {order})"
        return f"string_agg({expr}, '{sep}' order by {order})"

    def at(self, minutes: str) -> str:
        kind = "timestamp_ntz" if self.spark else "timestamp"
        return f"(cast('{EPOCH}' as {kind}) + cast({minutes} as int) * interval 1 minute)"

    def moment(self, text: str) -> str:
        return f"cast('{text}' as {'timestamp_ntz' if self.spark else 'timestamp'})"


def shared(d: Dialect) -> dict[str, str]:
    money = "cast(cast(p_retailprice as decimal(12,2)) as string)"
    brand = "lower(replace(p_brand, '#', ''))"
    block = f"cast(floor(p_partkey / {PARTS_PER_BLOCK}) as bigint)"
    group = f"cast(floor(p_partkey / {LINK_BLOCK}) as bigint)"
    verdicts = " union all ".join(
        f"""select '{m}' as model, doc_id,
            case when (quality = 1) = (doc_id % {i + 5} > 0) then ' True.' else 'False' end as response,
            case when doc_id % 9 = 0 then 'timeout' end as error from labels"""
        for i, m in enumerate(MODELS)
    )
    fields = [
        ("name", "h3", "text", "", ""),
        ("price", "span.price", "text", "", ""),
        ("url", "a", "attribute", "href", ""),
        ("image_url", "img", "attribute", "src", "none"),
        ("sku", "", "attribute", "data-item-id", ""),
        ("blurb", "p", "html", "", ""),
        ("badge", "div.promo", "text", "", ""),
    ]
    schema_fields = " union all ".join(
        f"""select domain, 'div.galleryItem' as base_selector, '{n}' as field, '{s}' as selector,
            '{t}' as type, '{a}' as attribute, nullif('{v}', '') as default_value
            from (select distinct domain from listing)"""
        for n, s, t, a, v in fields
    )
    return {
        "cards": f"""
            select {block} * 100 + cast(substr(p_brand, 7) as int) as page_id, p_partkey as product_key,
              {brand} || '.example.com' as domain, {block} as block, p_name, p_type, p_brand,
              {money} as price,
              '<div class="galleryItem product-card" data-item-id="' || cast(p_partkey as string) || '"><h3>'
              || p_name || '</h3><span class="price">$' || {money} || '</span><p>' || p_type || ' ' || p_brand
              || ' size ' || cast(p_size as string)
              || ' everyday item for the shop floor, packed one by one &amp; sent from the nearest store with a printed note.</p>'
              || case when p_partkey % 7 = 0 then '<div class="promo">Save 5</div>' else '' end
              || case when p_partkey % 2 = 0 then '<img src="/i/' || cast(p_partkey as string) || '.jpg">' else '' end
              || '<a href="/p/' || cast(p_partkey as string) || '">add to cart</a></div>' as card
            from part""",
        "listing": f"""
            select page_id, domain, 'https://' || domain || '/c/' || cast(block as string) as url,
              '<html><head><title>' || p_brand || '</title></head><body><div class="grid" data-total-products="'
              || cast(count(*) as string) || '">'
              || {d.agg("case when product_key % 11 = 0 then card || card else card end", "", "product_key")}
              || '</div></body></html>' as html
            from cards group by page_id, domain, block, p_brand""",
        "offer_base": f"""
            select p_partkey as product_id, {brand} || '.example.com' as domain,
              'https://' || {brand} || '.example.com/c/' || lower(p_type) || '/' || cast({group} as string) as category_url,
              case when p_partkey % 13 = 0 then '  ' else p_name end as name,
              case when p_partkey % 26 = 0 then p_name end as title,
              case p_partkey % 7 when 0 then {money} when 1 then '$' || {money}
                when 2 then '1,' || substr({money}, 2, 10) when 3 then ''
                when 4 then null when 5 then 'from $' || {money} else {money} || '  ' end as price,
              case when p_partkey % 3 > 0 then cast(p_size * 10 as string) end as original_price,
              case when p_partkey % 3 > 1 then '25% off' end as discount,
              'https://' || {brand} || '.example.com/p/' || cast(p_partkey as string) as url,
              case when p_partkey % 4 > 0 then 'sku-' || cast(p_partkey as string) end as sku,
              case when p_partkey % 2 = 0 then '/i/' || cast(p_partkey as string) || '.jpg' end as image_url
            from part""",
        "offers": """
            select 1 as copy_no, * from offer_base
            union all select 2 as copy_no, * from offer_base where product_id % 5 = 0""",
        "category_links": f"""
            select min(p_partkey) as id,
              'https://' || {brand} || '.example.com/c/' || lower(p_type) || '/' || cast({group} as string) as url,
              cast(substr(p_brand, 7) as int) as domain_id,
              '<a href="/c/' || lower(p_type) || '/' || cast({group} as string) || '">' || p_type || '</a>' as link_html,
              {d.at("floor(min(p_partkey) / 3)")} as found_at,
              case when min(p_partkey) % 3 > 0 then {d.at("min(p_partkey) % 97 + 5000")} end as last_crawled_at
            from part group by p_brand, p_type, {group}""",
        "domains": f"""
            select distinct cast(substr(p_brand, 7) as int) as id, {brand} || '.example.com' as name from part""",
        "product_schemas": """
            select event_id as id, cast(user_id % 25 + 1 as int) as domain_id, props as schema_json,
              ts as generated_at from events""",
        "samples": f"""
            select d.doc_id, 'https://' || case when d.doc_id % 2 = 0 then 'www.' else '' end || source
              || '.example.com/' || cast(d.doc_id as string) as url, text as html_content, quality as is_plp,
              {d.at("d.doc_id")} as ts, source || '.example.com' as domain, md5(text) as content_hash,
              case when d.doc_id % 4 > 0 then replace(text, ',', '') end as cleaned_html
            from documents d join labels l on d.doc_id = l.doc_id""",
        "responses": f"""
            select page_id, domain, 'https://list.example.com/p/' || cast(page_id as string) as page_url,
              'https://list.example.com/p/' || cast(case when (page_id - 1) % 5 < 4 then page_id + 1 else page_id - 2 end as string) as next_page,
              case when page_id % 6 = 0 then '{{"products":[{{"name":' else
              '{{"products":[' || {d.agg('''concat('{"name":"', p_name, '","price":"$', price, '"}')''', ",", "product_key")}
              || '],"next_page":"https://list.example.com/p/'
              || cast(case when (page_id - 1) % 5 < 4 then page_id + 1 else page_id - 2 end as string) || '"}}' end as payload
            from cards group by page_id, domain""",
        "verdicts": verdicts,
        "schema_fields": schema_fields,
        "vectors": """
            select vec_id, cast(floor(vec_id / 50) as bigint) as page_id, (vec_id * 7919) % 101 as score, embedding from embeddings
            union all
            select vec_id + 10000000, cast(floor(vec_id / 50) as bigint), (vec_id * 31) % 101, embedding from embeddings where vec_id % 10 = 0""",
        "text_lines": """
            select doc_id, case when doc_id % 3 = 0 then '# ' else '' end || substr(text, 1, 40) as line from documents
            union all select doc_id, '  https://' || source || '.example.com/' || cast(doc_id as string) || ' ' from documents
            union all select doc_id, '   ' from documents""",
    }


# ---------------------------------------------------------------- views only the SQL side needs


def sql_pattern(p: str) -> str:
    """A pattern of the package as a SQL text."""
    return P.linear(p).replace("'", "''")


def decoded(x: str) -> str:
    digits = "regexp_extract(t, '([0-9A-Fa-f]+);$', 1)"
    n = f"try_cast(case when lower(substr(t, 3, 1)) = 'x' then '0x' || {digits} else {digits} end as bigint)"
    char = f"chr(cast(case when {n} between 1 and 1114111 and not {n} between 55296 and 57343 then {n} else 65533 end as int))"
    named = " ".join("when '&{}' then '{}'".format(f"{k};", v.replace("'", "''")) for k, v in P.ENTITIES.items())
    one = f"case when t like '&#%;' then {char} when t like '&%' then case t {named} else t end else t end"
    parts = f"regexp_extract_all({x}, '{sql_pattern(P.REFERENCE)}', 0)"
    return f"case when contains({x}, '&') then array_to_string(list_transform({parts}, lambda t: {one}), '') else {x} end"


def open_tag(x: str) -> str:
    return f"regexp_extract({x}, '{sql_pattern(P.OPEN_TAG)}', 1)"


def escaped(x: str) -> str:
    return f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def containers(tags) -> str:
    """A pattern for comments and the given non-nesting elements."""
    return "(?is)<!--.*?-->" + "".join(rf"|<{t}\b{sql_pattern(P.IN_TAG)}>.*?</{t}\s*>" for t in tags)


def stripped(x: str) -> str:
    return f"regexp_replace({x}, '^[{P.WS}]+|[{P.WS}]+$', '', 'g')"


def n_words(x: str) -> str:
    return f"len(list_filter(regexp_split_to_array({x}, '[{P.WS}]+'), lambda w: w <> ''))"


def attr(src: str, name: str) -> str:
    """One attribute value of an open tag, NULL when missing or empty."""
    value = """("[^"]*"|''[^'']*''|[^\\s"''>]+)"""
    other = """(?:\\s+[^\\s=>"''/]+(?:\\s*=\\s*(?:"[^"]*"|''[^'']*''|[^\\s"''>]+))?)*?"""
    found = f"regexp_extract({src}, '(?i)^<[^\\s>/]+{other}\\s+{name}\\s*=\\s*{value}', 1)"
    return "nullif(" + decoded(f"""regexp_replace({found}, '^["'']|["'']$', '', 'g')""") + ", '')"


def in_list(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def base_domain(u: str) -> str:
    full = f"case when {u} like 'http://%' or {u} like 'https://%' then {u} else 'https://' || {u} end"
    return f"regexp_replace(regexp_extract({full}, '^https?://([^/?#]*)', 1), '^www\\.', '')"


def netloc(u: str) -> str:
    return f"regexp_extract({u}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)"


def resolve(h: str, b: str) -> str:
    """Absolute form of href ``h`` on page ``b`` (both plain column names)."""
    scheme, bscheme = (f"lower(regexp_extract({x}, '^([A-Za-z][A-Za-z0-9+.-]*):', 1))" for x in (h, b))
    site = f"regexp_extract({b}, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)"
    bpath = f"regexp_extract({b}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
    bquery = f"regexp_extract({b}, '^[^#]*?(\\?[^#]*)', 1)"
    rest = f"regexp_replace({h}, '^[A-Za-z][A-Za-z0-9+.-]*:', '')"
    path = f"regexp_extract({rest}, '^([^?#]*)', 1)"
    query = f"regexp_extract({rest}, '^[^?#]*(\\?[^#]+)', 1)"
    frag = f"regexp_extract({rest}, '(#.+)$', 1)"
    joined = f"case when {path} like '/%' then {path} else regexp_replace({bpath}, '[^/]*$', '') || {path} end"
    segs = f"list_filter(string_split({joined}, '/'), lambda s: s <> '')"
    folded = (
        f"list_reduce({segs}, lambda acc, s: case when s = '..' then regexp_replace(acc, '/[^/]*$', '') "
        "when s = '.' then acc else acc || '/' || s end, '')"
    )
    tail = f"case when regexp_matches({joined}, '(^|/)\\.{{0,2}}$') then '/' else '' end"
    return (
        f"case when {h} = '' then {b} when {netloc(h)} <> '' or ({scheme} <> '' and {scheme} <> {bscheme}) then {h} "
        f"when {path} = '' then {site} || {bpath} || case when {query} = '' then {bquery} else {query} end || {frag} "
        f"else {site} || {folded} || {tail} || {query} || {frag} end"
    )


def drop_attrs(src: str, pattern: str) -> str:
    keep = (
        f"list_filter(regexp_extract_all(regexp_replace({src}, '^<[^\\s>/]+', ''), '{sql_pattern(P.ATTRIBUTE)}', 0), "
        f"lambda a: not regexp_matches(lower(regexp_extract(a, '^\\s+([^\\s=]+)', 1)), '{pattern}'))"
    )
    return (
        f"regexp_extract({src}, '^(<[^\\s>/]+)', 1) || coalesce(array_to_string({keep}, ''), '') "
        f"|| regexp_extract({src}, '(\\s*/?>)$', 1)"
    )


def keywords(x: str) -> str:
    return "(" + " + ".join(f"case when contains(lower({x}), '{k}') then 0.25e0 else 0e0 end" for k in P.PRODUCT_KEYWORDS) + ")"


def navigation(tag: str, src: str, text: str) -> str:
    attrs = f"lower(concat_ws(' ', {attr(src, 'id')}, {attr(src, 'class')}, {attr(src, 'role')}))"
    return (
        f"({tag} in {in_list(P.NAV_TAGS)} or regexp_matches({attrs}, '{P.NAV_ATTR}') "
        f"or regexp_matches(substr({text}, 1, {P.NAV_TEXT_CHARS}), '{P.NAV_TEXT}'))"
    )


def price(text: str, src: str) -> str:
    named = " or ".join(f"coalesce(regexp_matches({attr(src, n)}, '{P.PRICE_ATTR}'), false)" for n in P.PRICE_ATTR_NAMES)
    return f"(regexp_matches({text}, '{P.PRICE_TEXT}') or {named})"


def promo(text: str, src: str) -> str:
    return (
        f"(regexp_matches(concat_ws(' ', {attr(src, 'class')}, {attr(src, 'id')}), '{P.PROMO_ATTR}') "
        f"or regexp_matches(substr({text}, 1, {P.PROMO_TEXT_CHARS}), '{P.PROMO_TEXT}'))"
    )


def overlap(text: str, query: str) -> str:
    wanted = sorted(set(query.split()))
    has = [f"case when list_contains(regexp_split_to_array(lower({text}), '[{P.WS}]+'), '{w}') then 1 else 0 end" for w in wanted]
    return "((" + " + ".join(has) + f") / {len(wanted)}e0)"


def _markup_views(prefix: str, source: str) -> dict[str, str]:
    t, e = f"{prefix}_tokens", f"{prefix}_elements"
    return {
        t: f"""
            select page_id, pos, tok, tag, kind, case when kind = 'text' then {stripped(decoded("tok"))} else '' end as txt
            from (select *, case when tag = '' then case when tok like '<!--%' then 'comment'
                    when tok like '<!%' then 'doctype' else 'text' end
                  when tok like '</%' then 'close'
                  when tag in ('script', 'style') and regexp_matches(tok, '(?is)</(script|style)\\s*>$') then 'raw'
                  when tag in {in_list(P.VOID_TAGS)} or tok like '%/>' then 'void' else 'open' end as kind
                from (select *, lower(regexp_extract(tok, '^</?([A-Za-z][^\\s>/]*)', 1)) as tag
                  from (select page_id, unnest(range(len(toks))) as pos, unnest(toks) as tok
                    from (select page_id, regexp_extract_all(html, '{sql_pattern(P.TOKEN)}', 0) as toks from {source}))))""",
        f"{prefix}_blocks": f"""
            select page_id, pos, tag, kind from {t}
            where tag in {in_list(P.BLOCK_TAGS)} and kind in ('open', 'close', 'void')""",
        f"{prefix}_levels": f"""
            select page_id, pos, tag, kind, sum(case kind when 'open' then 1 else -1 end)
              over (partition by page_id, tag order by pos) + case kind when 'close' then 1 else 0 end as level
            from {t} where kind in ('open', 'close') and tag <> 'p'""",
        f"{prefix}_closes": f"""
            select o.page_id, o.pos, min(c.pos) as close_pos from {prefix}_levels o join {prefix}_levels c
              on o.page_id = c.page_id and o.tag = c.tag and o.level = c.level and c.pos > o.pos and c.kind = 'close'
            where o.kind = 'open' group by o.page_id, o.pos""",
        f"{prefix}_next_block": f"""
            select o.page_id, o.pos, min(b.pos) as block_pos, arg_min(b.tag || ' ' || b.kind, b.pos) as block_what
            from {t} o join {prefix}_blocks b on o.page_id = b.page_id and b.pos > o.pos
            where o.kind = 'open' group by o.page_id, o.pos""",
        f"{prefix}_spans": f"""
            select t.page_id, t.pos as node_id, t.tag, t.kind, regexp_extract(t.tok, '{sql_pattern(P.OPEN_TAG)}', 1) as src,
              t.pos as start_pos,
              case when t.kind <> 'open' then t.pos
                when t.tag = 'p' then case when block_what = 'p close' then block_pos else coalesce(block_pos - 1, last_pos) end
                when close_pos is not null then close_pos
                when t.tag in {in_list(P.ROOT_TAGS)} then last_pos
                else coalesce(block_pos - 1, last_pos) end as end_pos,
              t.kind = 'open' and coalesce(case when t.tag = 'p' then block_what = 'p close' else close_pos is not null end, false) as closed
            from {t} t join (select page_id, max(pos) as last_pos from {t} group by page_id) l on t.page_id = l.page_id
            left join {prefix}_closes c on t.page_id = c.page_id and t.pos = c.pos
            left join {prefix}_next_block b on t.page_id = b.page_id and t.pos = b.pos
            where t.kind in ('open', 'void', 'raw')""",
        e: f"""
            select s.page_id, s.node_id, any_value(s.tag) as tag, any_value(s.src) as src, any_value(s.start_pos) as start_pos,
              any_value(s.end_pos) as end_pos, any_value(s.closed) as closed,
              sum(length(t.tok)) as outer_len, string_agg(t.tok, '' order by t.pos) as fragment,
              case when any_value(s.kind) = 'raw' then 0 else sum(strlen(t.tok)) - any_value(strlen(s.src))
                - coalesce(sum(strlen(t.tok)) filter (any_value_closed and t.pos = s.end_pos), 0) end as inner_bytes,
              coalesce(string_agg(t.txt, ' ' order by t.pos) filter (t.txt <> ''), '') as text,
              coalesce(length(string_agg(t.txt, ' ' order by t.pos) filter (t.txt <> '')), 0) as text_len,
              coalesce(sum({n_words("t.txt")}) filter (t.txt <> ''), 0) as n_words
            from (select *, closed as any_value_closed from {prefix}_spans) s
            join {t} t on s.page_id = t.page_id and t.pos between s.start_pos and s.end_pos
            group by s.page_id, s.node_id""",
    }


@cache
def sql_views() -> dict[str, str]:
    href = "strip_href"
    entity_weight = "case x.label " + " ".join(f"when '{n}' then {w}" for n, w in P.ENTITY_WEIGHTS.items()) + " else 0 end"
    tag_weight = "case tag " + " ".join(f"when '{t}' then {w}e0" for t, w in P.TAG_WEIGHTS.items()) + " else 0.5e0 end"
    letters = ", ".join(f"cast(length(text) - length(replace(text, '{c}', '')) as double)" for c in "aeiourst0123456789")
    alike = f"""(list_max(list_transform(w.kept_vectors, lambda k: list_cosine_similarity(k, d.v))) > {FRAGMENT_SIMILARITY} and list_sum(d.v) > 0)"""
    out = {
        **_markup_views("page", "pages"),
        **_markup_views("listing", "listing"),
        **_markup_views("model", "model_source"),
        "product_ranked": f"""
            select *, row_number() over (partition by page_id order by score desc, node_id) as r, [{letters}] as v
            from listing_scored c where not exists (select 1 from listing_scored o
              where o.page_id = c.page_id and o.start_pos < c.start_pos and o.end_pos >= c.end_pos)""",
        "product_walk": f"""
            select page_id, r, [node_id] as kept, [v] as kept_vectors from product_ranked where r = 1
            union all
            select w.page_id, d.r, case when {alike} then w.kept else list_append(w.kept, d.node_id) end,
              case when {alike} then w.kept_vectors else list_append(w.kept_vectors, d.v) end
            from product_walk w join product_ranked d on d.page_id = w.page_id and d.r = w.r + 1""",
        "product_kept": """
            select p.page_id, p.node_id, p.score, p.fragment from product_ranked p join (
              select page_id, unnest(kept) as node_id from (select page_id, kept, row_number() over (partition by page_id order by r desc) as last
                from product_walk) where last = 1) k on k.page_id = p.page_id and k.node_id = p.node_id""",
        "model_source": """
            select page_id, string_agg(fragment, chr(10) order by rank) as html from (
              select *, row_number() over (partition by page_id order by score desc, node_id) as rank from product_kept) where rank <= 20 group by page_id""",
        "card_ranked": """
            select *, row_number() over (partition by page_id order by score desc, node_id) as rank from (
              select s.page_id, s.node_id, s.score, s.start_pos, s.end_pos, c.card_id, c.card_end from listing_card_scored s
              join listing_cropped c on c.page_id = s.page_id and c.node_id = s.node_id) a
            where not exists (select 1 from listing_card_scored o join listing_cropped b on b.page_id = o.page_id and b.node_id = o.node_id
              where o.page_id = a.page_id and b.card_id <= a.start_pos and b.card_end >= a.end_pos
                and (o.score > a.score or (o.score = a.score and o.node_id < a.node_id)))""",
        "card_best": """
            select c.page_id, c.card_id, string_agg(t.tok, '' order by t.pos) as fragment
            from (select distinct page_id, card_id, card_end from card_ranked where rank <= 20) c
            join listing_tokens t on t.page_id = c.page_id and t.pos between c.card_id and c.card_end
            where not exists (select 1 from listing_flagged p where p.page_id = c.page_id and p.promo
                and p.start_pos > c.card_id and p.end_pos <= c.card_end and t.pos between p.start_pos and p.end_pos)
            group by c.page_id, c.card_id""",
        "anchors": f"""
            select page_id, page_url, ordinal, {attr("html", "href")} as href, html,
              case when body = '' then 'No Title' else body end as title, body
            from (select *, array_to_string(list_filter(list_transform(regexp_extract_all(html, '{sql_pattern(P.TOKEN)}', 0),
                  lambda t: case when t like '<%' and t <> '<' then '' else {stripped(decoded("t"))} end), lambda t: t <> ''), '') as body
              from (select page_id, page_url, row_number() over (partition by page_id order by i) - 1 as ordinal,
                  case when regexp_matches(cut, '(?i)</a\\s*>') then regexp_extract(cut, '(?is)^(<a.*?</a\\s*>)', 1)
                    else regexp_extract(cut, '(?is)^(<a{sql_pattern(P.IN_TAG)}>[^<]*|<a[^>]*>[^<]*)', 1) end as html
                from (select page_id, page_url, unnest(range(len(cuts))) as i, unnest(cuts) as cut
                  from (select page_id, url as page_url, string_split(regexp_replace(regexp_replace(html,
                      '{containers(["script", "style", "noscript", "footer"])}',
                      '', 'g'), '(?i)<a([\\s>])', chr(1) || '<a\\1', 'g'), chr(1)) as cuts from pages))
                where regexp_matches(cut, '(?i)^<a[\\s>]')))""",
        "clean_anchors": f"""
            select page_id, ordinal, {drop_attrs(open_tag("html"), "^(?:" + "|".join(P.ANCHOR_ATTRS_DROPPED) + ")$")} || {escaped("body")} || '</a>' as clean_html from anchors""",
        "resolved": f"""
            select *, {base_domain("url")} as domain, {base_domain("page_url")} as page_domain
            from (select *, {resolve(href, "page_url")} as url from (select *, {stripped("href")} as strip_href from anchors))""",
        "scheme_links": f"""
            select * from resolved where strip_href <> '' and strip_href not like 'mailto:%' and strip_href not like 'tel:%'
              and strip_href not like '#%'""",
        "pruned": """
            select * exclude (rn) from (select *, row_number() over (partition by page_id, url order by ordinal) as rn
              from scheme_links where domain = page_domain) where rn = 1""",
        "link_responses": """
            select page_id, case when page_id % 9 = 0 then 'timeout' end as error, url from pruned where ordinal % 2 = 0""",
        "entities": f"""
            select page_id, node_id, case when tag = 'h3' then 'PRODUCT' when tag = 'p' then 'ORG' else 'MONEY' end as label
            from listing_elements where tag in ('h3', 'p') or (tag = 'span' and {attr("src", "class")} = 'price')""",
        "items": f"select * from listing_elements where contains(coalesce({attr('src', 'class')}, ''), 'galleryItem')",
        "chain": """
            select page_url as start_url, 1 as depth, page_url, [page_url] as seen from responses
            union all
            select c.start_url, c.depth + 1, r.next_page, list_append(c.seen, r.next_page) from chain c
            join responses r on r.page_url = c.page_url where c.depth < 3 and not list_contains(c.seen, r.next_page)""",
        "distinct_vectors": """
            select *, row_number() over (partition by page_id order by score desc, vec_id) as r from (
              select page_id, embedding, arg_min(vec_id, (-score, vec_id)) as vec_id, max(score) as score from vectors group by page_id, embedding)""",
        "walk": """
            select page_id, r, [vec_id] as kept, [cast(embedding as double[])] as kept_vectors from distinct_vectors where r = 1
            union all
            select w.page_id, d.r,
              case when list_max(list_transform(w.kept_vectors, lambda k: list_cosine_similarity(k, cast(d.embedding as double[])))) > 0.25
                then w.kept else list_append(w.kept, d.vec_id) end,
              case when list_max(list_transform(w.kept_vectors, lambda k: list_cosine_similarity(k, cast(d.embedding as double[])))) > 0.25
                then w.kept_vectors else list_append(w.kept_vectors, cast(d.embedding as double[])) end
            from walk w join distinct_vectors d on d.page_id = w.page_id and d.r = w.r + 1""",
        "listing_actions": """
            select s.page_id, s.node_id from listing_spans s
            join listing_tokens t on t.page_id = s.page_id and t.pos > s.start_pos and t.pos < s.end_pos
            where s.tag in ('a', 'button') and s.closed
            group by s.page_id, s.node_id
            having count(*) filter (t.kind = 'text') = 1
              and count(*) filter (t.kind not in ('text', 'open', 'close')) = 0
              and bool_or(t.kind = 'text' and regexp_matches(t.tok, '(?i)add|buy|cart'))
              and coalesce(max(t.pos) filter (t.kind = 'open'), -1) < min(t.pos) filter (t.kind = 'text')
              and coalesce(min(t.pos) filter (t.kind = 'close'), 1000000000) > min(t.pos) filter (t.kind = 'text')""",
        "listing_sized": "select * from listing_elements where text_len > 75 and text_len < 3500 and n_words >= 5",
        "page_sized": "select * from page_elements where text_len > 75 and text_len < 3500 and n_words >= 2",
        "listing_entity_score": f"""
            select s.page_id, s.node_id, coalesce(sum({entity_weight}), 0) as entity_score
            from listing_sized s left join entities x on s.page_id = x.page_id and x.node_id between s.start_pos and s.end_pos
            group by s.page_id, s.node_id""",
        "listing_bonus": """
            select s.page_id, s.node_id,
              case when exists (select 1 from listing_spans i where i.page_id = s.page_id and i.tag = 'img'
                  and i.node_id > s.start_pos and i.node_id <= s.end_pos) then 0.5 else 0.0 end
              + case when exists (select 1 from listing_actions i where i.page_id = s.page_id
                  and i.node_id > s.start_pos and i.node_id <= s.end_pos) then 1.0 else 0.0 end as bonus
            from listing_sized s""",
        "listing_scored": f"""
            select * from (select s.*, cast(entity_score as double) + {keywords("s.text")} + cast(bonus as double) + s.text_len / (s.outer_len + 1e-6) as score
              from listing_sized s join listing_entity_score e on s.page_id = e.page_id and s.node_id = e.node_id
              join listing_bonus b on s.page_id = b.page_id and s.node_id = b.node_id
              where not {navigation("s.tag", "s.src", "s.text")}) where score > 0""",
        "listing_flagged": f"select *, {price('text', 'src')} as has_price, {promo('text', 'src')} as promo from listing_elements",
        "listing_card_candidates": f"""
            select * from listing_flagged where tag in {in_list(P.TAG_WEIGHTS)} and not promo and text <> ''
              and (has_price or n_words >= 2)""",
        "listing_card_scored": f"""
            select *, case when has_price then 2.5e0 else 0e0 end + {overlap("text", "small red zzz Ring")} * 1e0
              + case when inner_bytes > 0 then text_len / inner_bytes else 0e0 end * 0.6e0 + {tag_weight} * 0.3e0 as score
            from listing_card_candidates""",
        "listing_cropped": """
            select c.page_id, c.node_id, coalesce(min(a.start_pos), any_value(c.start_pos)) as card_id,
              coalesce(max(a.end_pos), any_value(c.end_pos)) as card_end
            from listing_card_scored c left join listing_flagged a on a.page_id = c.page_id and a.start_pos < c.start_pos
              and a.end_pos >= c.end_pos and a.tag not in ('html', 'body') and a.has_price and a.text_len <= 800
              and not exists (select 1 from listing_flagged b where b.page_id = c.page_id and b.start_pos > a.start_pos
                and b.start_pos < c.start_pos and b.end_pos >= c.end_pos and not (b.has_price and b.text_len <= 800))
            group by c.page_id, c.node_id""",
    }
    return out


def reject_reason(u: str) -> str:
    return "case " + " ".join(
        f"when regexp_matches({u}, '(?i){p}') then '{n}'" for n, p in P.NON_CATEGORY_GROUPS.items()
    ) + " end"


def _ordered(sql: str, catalog: dict[str, str]) -> list[str]:
    done: list[str] = []

    def visit(text: str, inside: str = "") -> None:
        for name in catalog:
            if name not in done and name != inside and re.search(rf"\b{name}\b", re.sub(r"'(?:[^']|'')*'|`[^`]*`", "''", text)):
                visit(catalog[name], name)
                if name not in done:
                    done.append(name)

    visit(sql)
    return done


def with_views(sql: str) -> str:
    catalog = {**shared(Dialect("duckdb")), **sql_views()}
    names = _ordered(sql, catalog)
    if not names:
        return sql
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS {'' if n in ('walk', 'chain', 'product_walk') else 'MATERIALIZED '}({catalog[n]})" for n in names) + "\n" + sql


# ---------------------------------------------------------------- Spark side


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A shared view as a DataFrame; Catalyst inlines the definitions it needs."""
    catalog = {t: f"select * from parquet.`{sf_dir}/{t}.parquet`" for t in TABLES}
    catalog.update(shared(Dialect("spark")))
    if name == "pages":
        return table(spark, sf_dir, name)
    ctes = ",\n".join(f"{n} AS ({catalog[n]})" for n in _ordered(f"select * from {name}", catalog))
    return spark.sql(f"WITH {ctes}\nselect * from {name}")


def entities(elems: DataFrame) -> DataFrame:
    """Named entities of the listing pages: price, product name and brand mention."""
    from pagemill.functions.markup import attribute

    label = (
        F.when(F.col("tag") == "h3", "PRODUCT")
        .when(F.col("tag") == "p", "ORG")
        .when((F.col("tag") == "span") & (attribute(F.col("src"), "class") == "price"), "MONEY")
    )
    return elems.select("page_id", "node_id", "start_pos", "end_pos", label.alias("label")).where("label is not null")
