"""Choosing among scored elements: nesting, cover, cropping, duplicates, top-N."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions import markup as M
from pagemill.functions import patterns as P
from pagemill.operators import cleaning as C
from pagemill.operators import elements as E
from pagemill.operators import scoring as S
from pagemill.operators import vectors as V
from pagemill.operators.skew import first_per_key
from pagemill.session import settled, shuffled


def remove_nested(candidates: DataFrame) -> DataFrame:
    """Keep the outermost candidates of each page.

    In start order, a candidate lies inside an earlier one exactly when some earlier one ends
    no sooner than it does; a running maximum answers that without pairing candidates.
    """
    w = (
        Window.partitionBy("page_id")
        .orderBy("start_pos", F.desc("end_pos"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        candidates.withColumn("_reach", F.max("end_pos").over(w))
        .where("_reach is null or _reach < end_pos")
        .drop("_reach")
    )


def uncovered(candidates: DataFrame, block_start: str = "start_pos", block_end: str = "end_pos") -> DataFrame:
    """Drop a candidate that lies inside the block of a better one (higher score, then earlier).

    Walking in rank order and skipping whatever an accepted block covers gives the same rows:
    the block that covers a skipped candidate's block also covers everything inside it.
    """
    blocks = candidates.select(
        "page_id",
        F.col(block_start).alias("start_pos"),
        F.col(block_end).alias("end_pos"),
        F.col("score").alias("o_score"),
        F.col("node_id").alias("o_node"),
    )
    inner = candidates.select("page_id", "node_id", "start_pos", "end_pos", "score")
    pairs = E.containing(inner, blocks, strict=False).where(
        (F.col("o_score") > F.col("score")) | ((F.col("o_score") == F.col("score")) & (F.col("o_node") < F.col("node_id")))
    )
    return candidates.join(pairs.select("page_id", "node_id"), ["page_id", "node_id"], "left_anti")


def crop_to_card(candidates: DataFrame, flagged: DataFrame, max_chars: int = P.CARD_MAX_CHARS) -> DataFrame:
    """Add the card of each candidate: the highest ancestor reached while every step has a price
    and at most ``max_chars`` of text. ``card_id`` is the candidate itself when no step is possible.
    """
    parents = flagged.where(~F.col("tag").isin("html", "body")).select(
        "page_id",
        "start_pos",
        "end_pos",
        (F.col("has_price") & (F.col("text_len") <= max_chars)).alias("fits"),
    )
    steps = E.containing(candidates.select("page_id", "node_id", "start_pos", "end_pos"), parents)
    # One element per nesting level, so both aggregates stay as small as the page is deep.
    climbed = (
        steps.groupBy("page_id", "node_id")
        .agg(
            F.max(F.when(~F.col("fits"), F.col("o_start"))).alias("stop"),
            F.collect_list(F.when(F.col("fits"), F.struct("o_start", "o_end"))).alias("fitting"),
        )
        .select(
            "page_id",
            "node_id",
            F.array_min(
                F.filter("fitting", lambda x: x["o_start"] > F.coalesce(F.col("stop"), F.lit(-1)))
            ).alias("card"),
        )
    )
    return (
        candidates.join(climbed, ["page_id", "node_id"], "left")
        .withColumn("card_id", F.coalesce("card.o_start", "start_pos"))
        .withColumn("card_end", F.coalesce("card.o_end", "end_pos"))
        .drop("card")
    )


def card_fragments(cards: DataFrame, flagged: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Markup of each distinct card without its promotion descendants.

    ``cards``: ``page_id, card_id``. The cards' markup is cut from ``pages`` (``page_id, html``); without them, ``flagged``
    has that of all its elements (``fragment``).
    Output: ``page_id, card_id, card_end, start_line, fragment``.
    """
    distinct = cards.select("page_id", F.col("card_id").alias("node_id")).distinct()
    kept = flagged.join(distinct, ["page_id", "node_id"], "left_semi").select(
        "page_id", "node_id", "start_pos", "end_pos", "start_line", "off", "outer_len", *(["fragment"] if pages is None else [])
    )
    if pages is not None:
        kept = settled(E.with_markup(kept, pages))
    promos = flagged.where("promo").select(
        "page_id", "start_pos", "end_pos", F.col("off").alias("cut_from"), (F.col("off") + F.col("outer_len")).alias("cut_to")
    )
    spans = (
        E.containing(promos, kept.select("page_id", "start_pos", "end_pos", F.col("node_id").alias("card_id")))
        .groupBy("page_id", "card_id")
        .agg(F.array_sort(F.collect_list(F.struct("cut_from", "cut_to"))).alias("cuts"))
        .withColumnRenamed("card_id", "node_id")
    )
    joined = kept.join(spans, ["page_id", "node_id"], "left")

    def piece(start: Column, stop: Column) -> Column:
        own = start - F.col("off")
        return F.substring(F.col("fragment"), (own + 1).cast("int"), F.greatest(stop - start, F.lit(0)).cast("int"))

    card_stop = F.col("off") + F.col("outer_len")
    cut = F.aggregate(
        F.coalesce("cuts", F.expr("cast(array() as array<struct<cut_from: bigint, cut_to: bigint>>)")),
        F.struct(F.lit("").alias("text"), F.col("off").cast("bigint").alias("at")),
        lambda acc, c: F.when(
            c["cut_from"] >= acc["at"],
            F.struct(F.concat(acc["text"], piece(acc["at"], c["cut_from"])).alias("text"), c["cut_to"].alias("at")),
        ).otherwise(acc),
        lambda acc: F.concat(acc["text"], piece(acc["at"], card_stop)),
    )
    return joined.select(
        "page_id", F.col("node_id").alias("card_id"), F.col("end_pos").alias("card_end"), "start_line", cut.alias("fragment")
    )


def distinct_fragments(fragments: DataFrame, order: str) -> DataFrame:
    """First of identical fragment texts of a page."""
    hashed = fragments.withColumn("_h", F.md5("fragment"))
    return first_per_key(hashed, ["page_id", "_h"], [order]).drop("_h")


def top_n(rows: DataFrame, n: int | None = P.KEEP_TOP_N) -> DataFrame:
    """Best ``n`` rows (None: all) of each page by score, document order breaking ties, with their ``rank``."""
    w = Window.partitionBy("page_id").orderBy(F.desc("score"), "node_id")
    ranked = rows.withColumn("rank", F.row_number().over(w))
    return ranked if n is None else ranked.where(F.col("rank") <= n)


def product_filter(
    elems: DataFrame,
    entities: DataFrame,
    vectors: DataFrame,
    keep_top_n: int | None = P.KEEP_TOP_N,
    similarity: float = P.DEFAULT_SIMILARITY,
    min_words: int = P.MIN_WORDS,
    min_chars: int = P.MIN_CHARS,
    max_chars: int = P.MAX_CHARS,
    pages: DataFrame | None = None,
) -> DataFrame:
    """Product fragments of every page: filter, score, de-nest, drop near-duplicates, keep the best.

    ``elems``: elements with the ``text`` of those of product size. The markup of the chosen ones is cut from ``pages``
    (``page_id, html``); without them, ``elems`` has everyone's (``fragment``). ``vectors``: ``page_id, node_id, embedding``
    for those that have one; an element without a vector is never a near-duplicate. ``keep_top_n``
    None keeps all. Output: ``page_id, rank, node_id, score, fragment``.
    """
    scored = S.product_candidates(elems, entities, min_chars, max_chars, min_words)
    outer = settled(remove_nested(scored).select("page_id", "node_id", "start_pos", "end_pos", "score", *(["fragment"] if pages is None else ["off", "outer_len"])))
    ranked = outer.join(shuffled(vectors), ["page_id", "node_id"]).select("page_id", "node_id", "score", "embedding")
    kept = V.semantic_dedup(ranked.withColumnRenamed("node_id", "vec_id"), similarity)
    dropped = ranked.select("page_id", "node_id").join(
        shuffled(kept.select("page_id", F.col("vec_id").alias("node_id"))), ["page_id", "node_id"], "left_anti"
    )
    best = top_n(outer.join(shuffled(dropped), ["page_id", "node_id"], "left_anti"), keep_top_n)
    if pages is not None:
        best = E.with_markup(best.select("page_id", "rank", "node_id", "score", "off", "outer_len"), pages)
    return best.select("page_id", "rank", "node_id", "score", "fragment")


def ecommerce_filter(
    pages: DataFrame, keep_top_n: int | None = P.KEEP_TOP_N, query: str = "", card_chars: int = P.CARD_MAX_CHARS
) -> DataFrame:
    """Price cards of every page, cropped to ``card_chars`` of text, without promotions and exact repeats.

    Output: ``page_id, position, card_id, fragment`` in source order; ``keep_top_n`` None keeps all.
    """
    clean = C.strip_elements(pages, P.JUNK_TAGS, comments=True)
    flagged = settled(S.price_flags(E.elements(clean, text=True)))
    in_body = flagged.where(~F.col("tag").isin("html", "head", "body"))
    scored = S.card_candidates(in_body).withColumn("score", S.card_score(query))
    cropped = settled(
        crop_to_card(scored.select("page_id", "node_id", "start_pos", "end_pos", "score"), flagged, card_chars)
    )
    best = top_n(uncovered(cropped, "card_id", "card_end"), keep_top_n)
    fragments = distinct_fragments(card_fragments(best, flagged, clean), "card_id")
    place = F.row_number().over(Window.partitionBy("page_id").orderBy("card_id"))
    return fragments.select("page_id", place.alias("position"), "card_id", "fragment")


def clean_for_model(
    pages: DataFrame,
    elems: DataFrame,
    entities: DataFrame,
    vectors: DataFrame,
    keep_top_n: int | None = P.KEEP_TOP_N,
    similarity: float = P.PIPELINE_SIMILARITY,
) -> DataFrame:
    """Model input of every page: its product fragments, cleaned and outlined; empty where there is none."""
    found = product_filter(elems, entities, vectors, keep_top_n, similarity, P.PIPELINE_MIN_WORDS, pages=pages)
    ordered = F.array_sort(F.collect_list(F.struct("rank", "fragment")))
    fragments = found.groupBy("page_id").agg(F.array_join(F.transform(ordered, lambda r: r["fragment"]), "\n").alias("html"))
    joined = pages.select("page_id").join(shuffled(fragments), "page_id", "left")
    stripped = C.strip_elements(joined, P.MODEL_TAGS_DROPPED)
    bare = stripped.withColumn("html", C.strip_attributes(F.col("html"), P.MODEL_ATTRS_DROPPED))
    return C.outline(bare)
