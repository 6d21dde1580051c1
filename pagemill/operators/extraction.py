"""Products from pages (by extraction schema) and from model payloads."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from pagemill.functions import markup as M
from pagemill.functions import patterns as P
from pagemill.functions import selectors as SEL
from pagemill.functions.page import Page
from pagemill.functions.staged import computed
from pagemill.functions.text import is_blank, strip_ws
from pagemill.operators import elements as E
from pagemill.operators.skew import first_per_key
from pagemill.session import settled

PAYLOAD = "products array<struct<name string, title string, price string>>, next_page string"
PRODUCT_FIELDS = ["name", "title", "price", "original_price", "discount", "image_url", "url", "sku", "description"]


# ---------------------------------------------------------------- selectors

#: Selectors that are understood: tags, classes, ids, attribute conditions, descendants, children, lists.
SELECTOR = rf"^\s*(?:{SEL.PATH}(?:\s*,\s*{SEL.PATH})*)?\s*$"
#: Schemas (by domain) that go to the pages by a broadcast; more are joined by a shuffle.
BROADCAST_SCHEMAS = 5_000


def understood(selector: Column) -> Column:
    return F.coalesce(selector.rlike(SELECTOR), F.lit(False))


def schema_fields(schemas: DataFrame) -> DataFrame:
    """Stored extraction schemas (``domain, schema_json``) as one row per field, in order of ``place``."""
    field = "struct<name: string, selector: string, type: string, attribute: string, default: string>"
    layout = f"baseSelector string, baseFields array<{field}>, fields array<{field}>"
    parsed = schemas.select("domain", F.from_json("schema_json", layout).alias("s"))
    empty = F.expr(f"cast(array() as array<{field}>)")
    own = F.transform(F.coalesce("s.baseFields", empty), lambda f: f.withField("selector", F.lit("")))
    return parsed.select(
        "domain", F.col("s.baseSelector").alias("base_selector"), F.posexplode(F.concat(own, F.coalesce("s.fields", empty))).alias("place", "f")
    ).select(
        "domain", "base_selector", F.col("f.name").alias("field"), F.coalesce("f.selector", F.lit("")).alias("selector"),
        F.coalesce("f.type", F.lit("text")).alias("type"), F.coalesce("f.attribute", F.lit("")).alias("attribute"),
        F.col("f.default").alias("default_value"), "place",
    )


def rejected_fields(fields: DataFrame) -> DataFrame:
    """Field rows that extraction leaves out, with the ``reason``."""
    blank = F.coalesce(strip_ws("base_selector") == "", F.lit(True))
    reason = (
        F.when(blank, "no base selector")
        .when(~understood(F.col("base_selector")), "base selector not understood")
        .when(~understood(F.col("selector")), "selector not understood")
    )
    return fields.withColumn("reason", reason).where("reason is not null")


def schema_extract(pages: DataFrame, fields: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per base element of each page, with a column per field.

    ``pages``: ``page_id, domain, html``; ``fields``: rows of :func:`schema_fields`, each page using
    those of its own domain; the rows of :func:`rejected_fields` are left out. A field without a match,
    or without the attribute, takes its own default, else NULL; of fields of one name the first with a
    value counts. Without ``columns`` these are PRODUCT_FIELDS, and all others go to the map ``other``.

    A page meets its domain's schema and is walked along once: all selectors are found on the way (see
    :class:`pagemill.functions.selectors.SelectorIndex`), and only what they find is cut out. Nothing is
    shuffled, unless there are too many schemas to broadcast.
    """
    if "place" not in fields.columns:
        fields = fields.withColumn("place", F.lit(0))
    usable = fields.where(understood(F.col("selector")) & understood(F.col("base_selector")) & (strip_ws("base_selector") != ""))
    spec = F.struct("base_selector", "field", "selector", "type", "attribute", "default_value", "place")
    schemas = settled(usable.groupBy("domain").agg(F.collect_list(spec).alias("specs")))
    if schemas.limit(BROADCAST_SCHEMAS + 1).count() <= BROADCAST_SCHEMAS:
        schemas = F.broadcast(schemas)
    shown = columns or PRODUCT_FIELDS
    key = pages.schema["page_id"].dataType.simpleString()
    kinds = to_arrow_schema(pages.select("page_id", "domain").schema)
    kinds = kinds.append(pa.field("base_id", pa.int32())).append(pa.field("found", pa.map_(pa.string(), pa.string())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: dict[str, SEL.SelectorIndex] = {}
        for batch in batches:
            rows, chars = [], 0
            for page_id, domain, html, specs in zip(*batch.columns, strict=True):
                page_id, domain, html = page_id.as_py(), domain.as_py(), html.as_py()
                if domain not in index:
                    if len(index) >= 64:
                        index.clear()
                    index[domain] = SEL.SelectorIndex(specs.as_py())
                for base, values in index[domain].bases(Page(html)):
                    rows.append((page_id, domain, base, sorted(values.items())))
                    chars += sum(map(len, values.values()))
                    if len(rows) >= E.ROWS or chars >= E.CHARS:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)
                        rows, chars = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)
        pa.default_memory_pool().release_unused()

    joined = pages.select("page_id", "domain", "html").join(schemas, "domain").select("page_id", "domain", "html", "specs")
    found = joined.mapInArrow(run, f"page_id {key}, domain string, base_id int, found map<string, string>")
    out = found.select("page_id", "domain", "base_id", *(F.try_element_at("found", F.lit(c)).alias(c) for c in shown), "found")
    if columns:
        return out.drop("found")
    other = F.map_filter("found", lambda k, _: ~k.isin(shown))
    return out.withColumn("other", F.when(F.size(other) > 0, other)).drop("found")


# ---------------------------------------------------------------- payloads


def _well_formed(payload: Column) -> Column:
    """JSON of an object whose ``products``, if it has any, are a list."""
    parsed = F.try_parse_json(payload)
    products = F.try_variant_get(parsed, "$.products", "variant")
    listed = products.isNull() | F.try_variant_get(parsed, "$.products", "array<variant>").isNotNull()
    return F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT") & listed, F.lit(False))


def payload_products(responses: DataFrame) -> DataFrame:
    """Products of well-formed payloads (``page_id, domain, payload``), one row each, with ``next_page``.

    A well-formed payload without products gives one row with a NULL product.
    """
    good = responses.where(_well_formed(F.col("payload")))
    return good.select("page_id", "domain", F.from_json("payload", PAYLOAD).alias("r")).select(
        "page_id", "domain", "r.next_page", F.posexplode_outer("r.products").alias("ordinal", "p")
    ).select("page_id", "domain", "ordinal", "p.name", "p.title", "p.price", "next_page")


def payload_rejects(responses: DataFrame) -> DataFrame:
    return responses.groupBy("domain").agg(
        F.count("*").alias("n_payloads"), F.count_if(~_well_formed(F.col("payload"))).alias("n_rejected")
    )


# ---------------------------------------------------------------- products


def valid_name(name: Column, title: Column | None = None) -> Column:
    return ~is_blank(name) | (~is_blank(title) if title is not None else F.lit(False))


def valid_price(price: Column) -> Column:
    """``$`` removed and stripped, the whole price is a number; NULL is invalid."""
    bare = strip_ws(F.replace(price, F.lit("$"), F.lit("")))
    return F.coalesce(bare.rlike(P.VALID_PRICE), F.lit(False))


def reject_reason(has_title: bool = True) -> Column:
    """NULL for a valid product."""
    title = F.col("title") if has_title else None
    return F.when(~valid_name(F.col("name"), title), "blank name").when(~valid_price(F.col("price")), "bad price")


def product_validate(products: DataFrame) -> DataFrame:
    return products.where(reject_reason("title" in products.columns).isNull())


def product_dedup(products: DataFrame, order: list[str]) -> DataFrame:
    """First product of each (domain, url or sku, name, price)."""
    keyed = products.withColumn("_key", F.coalesce("url", "sku"))
    return first_per_key(keyed, ["domain", "_key", "name", "price"], order).drop("_key")


def extract_by_mode(
    pages: DataFrame, fields: DataFrame, responses: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Products of pages (``page_id, domain, html, mode``) by their mode, and the pages with an unknown mode."""
    known = pages.where(F.col("mode").isin("schema", "llm"))
    by_schema = schema_extract(known.where("mode = 'schema'"), fields).select(
        "page_id", "domain", "name", "title", "price", F.lit("schema").alias("mode")
    )
    asked = responses.join(known.where("mode = 'llm'").select("page_id"), "page_id", "left_semi")
    by_model = payload_products(asked).where("ordinal is not null").select(
        "page_id", "domain", "name", "title", "price", F.lit("llm").alias("mode")
    )
    rejected = pages.where(~F.coalesce(F.col("mode").isin("schema", "llm"), F.lit(False)))
    return product_validate(by_schema.unionByName(by_model)), rejected.select("page_id", "mode")


def pagination_chain(starts: DataFrame, edges: DataFrame, max_depth: int | None = P.MAX_PAGE_DEPTH) -> DataFrame:
    """Pages reached from each start (``page_url``) over ``page_url -> next_page``, each once.

    ``depth`` 1 is the start itself; at most ``max_depth`` pages are followed, so the list of
    seen pages stays that short. None follows chains to their end or to where they close (see ``_whole_chains``).
    """
    if max_depth is None:
        return _whole_chains(starts, edges)
    front = starts.select(
        F.col("page_url").alias("start_url"), "page_url", F.lit(1).alias("depth"), F.array("page_url").alias("seen")
    )
    out = front
    for depth in range(2, max_depth + 1):
        front = (
            front.join(edges.where("next_page is not null").select("page_url", "next_page"), "page_url")
            .where(~F.array_contains("seen", F.col("next_page")))
            .select("start_url", F.col("next_page").alias("page_url"), F.lit(depth).alias("depth"), F.array_append("seen", F.col("next_page")).alias("seen"))
        )
        out = out.unionByName(front)
    return out.select("start_url", "depth", "page_url")


def _whole_chains(starts: DataFrame, edges: DataFrame) -> DataFrame:
    """``pagination_chain`` to any depth, by pointer doubling: each round jumps twice as far as the one before, from all
    pages reached so far, so a chain of n pages takes log2(n) joins. A page reached again stays at its
    least depth; the rounds end when nothing new is reached, also in a loop. Of several next pages of a page the
    smallest counts."""
    jump = settled(edges.where("next_page is not null").groupBy("page_url").agg(F.min("next_page").alias("to")))
    reached = settled(starts.select(F.col("page_url").alias("start_url"), "page_url", F.lit(1).cast("bigint").alias("depth")).distinct())
    length, count = 1, reached.count()
    while True:
        further = reached.join(jump, "page_url").select("start_url", F.col("to").alias("page_url"), (F.col("depth") + length).alias("depth"))
        reached = settled(reached.unionByName(further).groupBy("start_url", "page_url").agg(F.min("depth").alias("depth")))
        before, count = count, reached.count()
        if count == before:
            return reached.select("start_url", "depth", "page_url")
        second = jump.select(F.col("page_url").alias("to"), F.col("to").alias("further"))
        jump = settled(jump.join(second, "to").select("page_url", F.col("further").alias("to")))
        length *= 2


def _items(elems: DataFrame) -> DataFrame:
    """Product items: elements whose class mentions the item marker."""
    return elems.where(F.coalesce(M.attribute(F.col("src"), "class"), F.lit("")).contains(P.ITEM_CLASS))


def listing_coverage(elems: DataFrame) -> DataFrame:
    """Declared and found items of each page, and how many have a name and a price."""
    declared = (
        elems.select("page_id", M.attribute(F.col("src"), "data-total-products").try_cast("int").alias("n"))
        .groupBy("page_id")
        .agg(F.max("n").alias("declared"))
    )
    items = _items(elems).select("page_id", "start_pos", "end_pos")
    named = F.col("tag") == "h3"
    priced = F.col("tag").isin("span", "p") & F.lower(F.coalesce(M.attribute(F.col("src"), "class"), F.lit(""))).contains("price")
    marks = computed(elems, has_name=named, has_price=priced).where("has_name or has_price")
    inside = E.containing(marks.select("page_id", "start_pos", "end_pos", "has_name", "has_price"), items)
    per_item = inside.groupBy("page_id", "o_start").agg(F.bool_or("has_name").alias("named"), F.bool_or("has_price").alias("priced"))
    counts = per_item.groupBy("page_id").agg(F.count_if("named").alias("with_name"), F.count_if("priced").alias("with_price"))
    found = items.groupBy("page_id").agg(F.count("*").alias("found"))
    zero = F.lit(0)
    return (
        declared.join(found, "page_id", "left")
        .join(counts, "page_id", "left")
        .select("page_id", "declared", *[F.coalesce(c, zero).alias(c) for c in ("found", "with_name", "with_price")])
    )


def fragment_coverage(fragments: DataFrame, elems: DataFrame) -> DataFrame:
    """Is each fragment (``page_id, node_id, start_pos, end_pos``) an item, does it hold items, or neither?"""
    items = _items(elems).select("page_id", "start_pos", "end_pos")
    outer = fragments.select("page_id", "start_pos", "end_pos", F.col("node_id").alias("o_node"))
    held = E.containing(items, outer, strict=False).groupBy("page_id", F.col("o_node").alias("node_id")).agg(
        F.count("*").alias("n_inside"), F.bool_or(F.col("start_pos") == F.col("o_start")).alias("is_item")
    )
    kind = F.when(F.col("is_item"), "item").when(F.col("n_inside") > 0, "holds items").otherwise("neither")
    return fragments.join(held, ["page_id", "node_id"], "left").select(
        "page_id", "node_id", kind.alias("kind"), F.coalesce("n_inside", F.lit(0)).alias("n_items")
    )


def extraction_report(products: DataFrame) -> DataFrame:
    """Products and failures per run, domain and link (``run_id, domain, category_url``)."""
    ok = reject_reason("title" in products.columns).isNull()
    return products.groupBy("run_id", "domain", "category_url").agg(
        F.count("*").alias("n_rows"), F.count_if(ok).alias("n_valid"), F.count_if(~ok).alias("n_failed")
    )
