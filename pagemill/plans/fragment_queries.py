"""Element table, element scores, fragment selection and fragment vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.functions import markup as M
from pagemill.functions import patterns as P
from pagemill.functions.text import first_words
from pagemill.operators import cleaning as C
from pagemill.operators import elements as E
from pagemill.operators import scoring as S
from pagemill.operators import selection as X
from pagemill.operators import vectors as VEC
from pagemill.operators.skew import first_per_key
from pagemill.plans import views as V
from pagemill.plans.registry import query
from pagemill.session import settled

CARD_QUERY = "small red zzz Ring"
PAIR_THRESHOLD = 0.25


def _pages(spark, sf_dir):
    return V.table(spark, sf_dir, "pages")


def _listing(spark, sf_dir):
    return V.view(spark, sf_dir, "listing")


SIZED = (P.MIN_CHARS, P.MAX_CHARS)


def _parsed(spark, sf_dir):
    """The listing pages and their element table, with the text of elements of product size, written once for the steps
    that share it."""
    pages = _listing(spark, sf_dir)
    return pages, settled(E.elements(pages, text=SIZED))


def _scored(spark, sf_dir):
    _, elems = _parsed(spark, sf_dir)
    return S.product_candidates(elems, V.entities(elems))


def _flagged(spark, sf_dir):
    return S.price_flags(E.elements(_listing(spark, sf_dir), text=True))


def _card_scored(spark, sf_dir):
    return S.card_candidates(_flagged(spark, sf_dir)).withColumn("score", S.card_score(CARD_QUERY))


@query(
    "element_table",
    f"""select e.page_id, e.node_id, e.tag, trim(array_to_string(regexp_extract_all(regexp_replace(e.src, '^<[^\\s>/]+', ''),
            '{V.sql_pattern(V.P.ATTRIBUTE)}', 0), '')) as attrs, e.end_pos, e.closed, e.outer_len, e.inner_bytes,
          e.n_words, md5(e.text) as text_md5, md5(e.fragment) as fragment_md5,
          (select count(*) from page_spans a where a.page_id = e.page_id and a.start_pos < e.start_pos and a.end_pos >= e.start_pos) as depth
        from page_elements e""",
)
def element_table(spark, sf_dir):
    return E.elements(_pages(spark, sf_dir), text=True, fragment=True).select(
        "page_id", "node_id", "tag", F.trim(F.array_join(M.attribute_list(F.col("src")), "")).alias("attrs"),
        "end_pos", "closed", "outer_len", "inner_bytes", "n_words",
        F.md5("text").alias("text_md5"), F.md5("fragment").alias("fragment_md5"), F.col("depth").cast("bigint").alias("depth"),
    )


@query("element_prefilter", "select page_id, node_id, tag, text_len, n_words from page_sized where n_words >= 5")
def element_prefilter(spark, sf_dir):
    return S.size_prefilter(E.elements(_pages(spark, sf_dir))).select("page_id", "node_id", "tag", "text_len", "n_words")


NAV_SQL = "select '{0}' as source, page_id, node_id, tag from {1} where not " + V.navigation("tag", "src", "text")


@query("element_nav_filter", NAV_SQL.format("pages", "page_sized") + " union all " + NAV_SQL.format("listing", "listing_sized"))
def element_nav_filter(spark, sf_dir):
    def kept(pages, source, min_words):
        sized = S.size_prefilter(E.elements(pages, text=SIZED), min_words=min_words)
        return sized.where(~S.is_navigation(F.col("tag"), F.col("src"), F.col("text"))).select(
            F.lit(source).alias("source"), "page_id", "node_id", "tag"
        )

    return kept(_pages(spark, sf_dir), "pages", 2).unionByName(kept(_listing(spark, sf_dir), "listing", 5))


@query("entity_score", "select page_id, node_id, cast(entity_score as double) as entity_score from listing_entity_score")
def entity_score(spark, sf_dir):
    _, elems = _parsed(spark, sf_dir)
    return S.entity_score(S.size_prefilter(elems), V.entities(elems)).select("page_id", "node_id", "entity_score")


@query("keyword_score", f"select doc_id, {V.keywords('text')} as score from (select doc_id, replace(text, 'the', 'brand') as text from documents)")
def keyword_score(spark, sf_dir):
    text = F.replace(F.col("text"), F.lit("the"), F.lit("brand"))
    return V.table(spark, sf_dir, "documents").select("doc_id", S.keyword_score(text).alias("score"))


@query("structure_bonus", "select page_id, node_id, cast(bonus as double) as bonus from listing_bonus")
def structure_bonus(spark, sf_dir):
    return S.size_prefilter(E.elements(_listing(spark, sf_dir))).select(
        "page_id", "node_id", S.structure_bonus(F.col("n_images"), F.col("n_actions")).alias("bonus")
    )


@query("text_density", "select page_id, node_id, round(text_len / (outer_len + 1e-6), 6) as density from page_elements")
def text_density(spark, sf_dir):
    return E.elements(_pages(spark, sf_dir)).select(
        "page_id", "node_id", F.round(S.text_density(F.col("text_len"), F.col("outer_len")), 6).alias("density")
    )


@query("element_score", "select page_id, node_id, tag, round(score, 6) as score from listing_scored")
def element_score(spark, sf_dir):
    return _scored(spark, sf_dir).select("page_id", "node_id", "tag", F.round("score", 6).alias("score"))


@query("price_detect", "select page_id, node_id, has_price from listing_flagged")
def price_detect(spark, sf_dir):
    return _flagged(spark, sf_dir).select("page_id", "node_id", "has_price")


@query("promo_detect", "select page_id, node_id, promo from listing_flagged")
def promo_detect(spark, sf_dir):
    return _flagged(spark, sf_dir).select("page_id", "node_id", "promo")


@query("ecommerce_candidates", "select page_id, node_id, tag, has_price from listing_card_candidates")
def ecommerce_candidates(spark, sf_dir):
    return S.card_candidates(_flagged(spark, sf_dir)).select("page_id", "node_id", "tag", "has_price")


@query("query_overlap", f"select doc_id, round({V.overlap('text', 'the of que und Que zzz')}, 6) as overlap from documents")
def query_overlap(spark, sf_dir):
    return V.table(spark, sf_dir, "documents").select(
        "doc_id", F.round(S.query_overlap(F.col("text"), "the of que und Que zzz the"), 6).alias("overlap")
    )


@query("ecommerce_score", "select page_id, node_id, round(score, 6) as score from listing_card_scored")
def ecommerce_score(spark, sf_dir):
    return _card_scored(spark, sf_dir).select("page_id", "node_id", F.round("score", 6).alias("score"))


@query(
    "remove_nested",
    """select page_id, node_id, tag from listing_scored c where not exists (select 1 from listing_scored o
         where o.page_id = c.page_id and o.start_pos < c.start_pos and o.end_pos >= c.end_pos)""",
)
def remove_nested(spark, sf_dir):
    return X.remove_nested(_scored(spark, sf_dir)).select("page_id", "node_id", "tag")


@query(
    "covered_ranges",
    """select page_id, node_id, tag from listing_card_scored c where not exists (select 1 from listing_card_scored o
         where o.page_id = c.page_id and o.start_pos < c.start_pos and o.end_pos >= c.end_pos and o.score >= c.score)""",
)
def covered_ranges(spark, sf_dir):
    return X.uncovered(settled(_card_scored(spark, sf_dir).drop("text", "src"))).select("page_id", "node_id", "tag")


@query("crop_to_card", "select page_id, node_id, card_id, card_end from listing_cropped")
def crop_to_card(spark, sf_dir):
    flagged = settled(_flagged(spark, sf_dir))
    return X.crop_to_card(S.card_candidates(flagged), flagged).select("page_id", "node_id", "card_id", "card_end")


@query(
    "card_promo_strip",
    """select c.page_id, c.card_id, string_agg(t.tok, '' order by t.pos) as fragment
       from (select distinct page_id, card_id, card_end from listing_cropped) c
       join listing_tokens t on t.page_id = c.page_id and t.pos between c.card_id and c.card_end
       where not exists (select 1 from listing_flagged p where p.page_id = c.page_id and p.promo
           and p.start_pos > c.card_id and p.end_pos <= c.card_end and t.pos between p.start_pos and p.end_pos)
       group by c.page_id, c.card_id""",
)
def card_promo_strip(spark, sf_dir):
    flagged = settled(_flagged(spark, sf_dir).drop("text"))
    cards = X.crop_to_card(S.card_candidates(flagged), flagged)
    return X.card_fragments(cards, flagged, _listing(spark, sf_dir)).select("page_id", "card_id", "fragment")


@query("fragment_exact_dedup", "select page_id, min(node_id) as node_id, md5(fragment) as hash from page_elements group by page_id, fragment")
def fragment_exact_dedup(spark, sf_dir):
    fragments = E.elements(_pages(spark, sf_dir), fragment=True).select("page_id", "node_id", "fragment")
    return X.distinct_fragments(fragments, "node_id").select("page_id", "node_id", F.md5("fragment").alias("hash"))


@query(
    "fragment_source_range",
    """select s.page_id, s.node_id, 1 + coalesce(sum(n) filter (t.pos < s.start_pos), 0) as start_line,
         2 + coalesce(sum(n) filter (t.pos <= s.end_pos), 0) as end_line
       from page_spans s join (select page_id, pos, length(tok) - length(replace(tok, chr(10), '')) as n from page_tokens) t
         on t.page_id = s.page_id group by s.page_id, s.node_id""",
)
def fragment_source_range(spark, sf_dir):
    return E.elements(_pages(spark, sf_dir)).select(
        "page_id", "node_id", "start_line", (F.col("start_line") + F.col("line_count")).alias("end_line")
    )


@query(
    "fragment_topn",
    """select page_id, node_id, rank from (select page_id, node_id, row_number() over (partition by page_id
         order by score desc, node_id) as rank from listing_scored) where rank <= 20""",
)
def fragment_topn(spark, sf_dir):
    return X.top_n(_scored(spark, sf_dir)).select("page_id", "node_id", "rank")


@query(
    "short_description",
    f"""select description, count(*) as n_fragments, min(doc_id) as first_doc from (select doc_id, array_to_string(list_filter(
          regexp_split_to_array(text, '[{V.P.WS}]+'), lambda w: w <> '')[1:30], ' ') as description from documents) group by description""",
)
def short_description(spark, sf_dir):
    shown = V.table(spark, sf_dir, "documents").select("doc_id", first_words(F.col("text"), 30).alias("description"))
    return shown.groupBy("description").agg(F.count("*").alias("n_fragments"), F.min("doc_id").alias("first_doc"))


@query(
    "mean_pool",
    """select label, cast(dim as int) as dim, round(sum(x * m) / greatest(sum(m), 1e-9), 6) as value
       from (select label, case when vec_id % 3 > 0 then 1.0 else 0.0 end as m, unnest(range(len(embedding))) as dim,
           cast(unnest(embedding) as double) as x from embeddings) group by label, dim""",
)
def mean_pool(spark, sf_dir):
    rows = V.table(spark, sf_dir, "embeddings").select("label", "embedding", (F.col("vec_id") % 3 > 0).cast("int").alias("mask"))
    return VEC.mean_pool(rows, "label").withColumn("value", F.round("value", 6))


DISTINCT_VECTORS = """(select page_id, embedding, arg_min(vec_id, (-score, vec_id)) as vec_id, max(score) as score, count(*) as copies
    from vectors group by page_id, embedding)"""
COSINE = "list_cosine_similarity(cast(a.embedding as double[]), cast(b.embedding as double[]))"


@query(
    "cosine_pairs",
    f"""select a.page_id, a.vec_id as left_id, b.vec_id as right_id, round({COSINE}, 6) as cosine, a.copies as left_copies, b.copies as right_copies
        from {DISTINCT_VECTORS} a join {DISTINCT_VECTORS} b on a.page_id = b.page_id and a.vec_id < b.vec_id where {COSINE} > {PAIR_THRESHOLD}""",
)
def cosine_pairs(spark, sf_dir):
    return VEC.cosine_pairs(V.view(spark, sf_dir, "vectors"), PAIR_THRESHOLD).withColumn("cosine", F.round("cosine", 6))


@query(
    "semantic_dedup",
    f"""select page_id, unnest(kept) as vec_id from (
          select page_id, kept, r, row_number() over (partition by page_id order by r desc) as last from walk) where last = 1""",
)
def semantic_dedup(spark, sf_dir):
    return VEC.semantic_dedup(V.view(spark, sf_dir, "vectors"), PAIR_THRESHOLD).select("page_id", "vec_id")


@query("semantic_dedup_lsh")
def semantic_dedup_lsh(spark, sf_dir):
    return VEC.semantic_dedup_lsh(V.view(spark, sf_dir, "vectors"), PAIR_THRESHOLD).select("vec_id", "score", "copies")


VECTOR_CHARS = "aeiourst0123456789"


def fragment_vectors(elems):
    """A small deterministic vector per sized element: counts of a few characters of its text."""
    letters = [F.regexp_count("text", F.lit(c)).cast("float") for c in VECTOR_CHARS]
    return S.size_prefilter(elems, min_words=2).select("page_id", "node_id", F.array(*letters).alias("embedding"))


@query(
    "product_filter",
    """select page_id, rank, node_id, round(score, 6) as score, md5(fragment) as fragment_md5 from (
         select *, row_number() over (partition by page_id order by score desc, node_id) as rank from product_kept) where rank <= 20""",
)
def product_filter(spark, sf_dir):
    pages, elems = _parsed(spark, sf_dir)
    found = X.product_filter(elems, V.entities(elems), fragment_vectors(elems), similarity=V.FRAGMENT_SIMILARITY, pages=pages)
    return found.select("page_id", "rank", "node_id", F.round("score", 6).alias("score"), F.md5("fragment").alias("fragment_md5"))


@query(
    "ecommerce_filter",
    """select page_id, row_number() over (partition by page_id order by card_id) as position, card_id, fragment from (
         select page_id, min(card_id) as card_id, fragment from card_best group by page_id, fragment)""",
)
def ecommerce_filter(spark, sf_dir):
    return X.ecommerce_filter(_listing(spark, sf_dir), query=CARD_QUERY)


@query(
    "clean_for_model",
    f"""select l.page_id, coalesce(o.html, '') as html from listing l left join (
         select page_id, string_agg(repeat(' ', cast(depth as int)) || line || chr(10), '' order by pos) as html from (
           select t.page_id, t.pos, any_value({V.stripped("t.tok")}) as line, count(s.node_id) as depth from model_tokens t
           left join model_spans s on s.page_id = t.page_id and t.pos > s.start_pos and t.pos <= case when s.closed then s.end_pos - 1 else s.end_pos end
           group by t.page_id, t.pos) where line <> '' group by page_id) o on o.page_id = l.page_id""",
)
def clean_for_model(spark, sf_dir):
    pages, elems = _parsed(spark, sf_dir)
    return X.clean_for_model(pages, elems, V.entities(elems), fragment_vectors(elems), similarity=V.FRAGMENT_SIMILARITY)
