"""Scores of page elements.

Two scorers share the element table: one from entities, keywords and structure, one from
prices, a query and tag weights. Limits of characters and words are arguments; their defaults stand
in ``functions/patterns.py``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import markup as M
from pagemill.functions import patterns as P
from pagemill.functions.staged import computed
from pagemill.functions.text import words
from pagemill.operators import elements as E
from pagemill.session import shuffled


def size_prefilter(
    elems: DataFrame, min_chars: int = P.MIN_CHARS, max_chars: int = P.MAX_CHARS, min_words: int = P.MIN_WORDS
) -> DataFrame:
    return elems.where(
        (F.col("text_len") > min_chars) & (F.col("text_len") < max_chars) & (F.col("n_words") >= min_words)
    )


def joined_attributes(src: Column, names: list[str]) -> Column:
    return F.concat_ws(" ", *[M.attribute(src, n) for n in names])


def head_of(text: Column, chars: int | None) -> Column:
    """The first ``chars`` characters; all of it for None."""
    return text if chars is None else F.substring(text, 1, chars)


def is_navigation(tag: Column, src: Column, text: Column, text_chars: int | None = P.NAV_TEXT_CHARS) -> Column:
    """Navigation by tag, by attributes, or by the words its text begins with (``text_chars``; None: anywhere)."""
    return (
        tag.isin(P.NAV_TAGS)
        | F.lower(joined_attributes(src, ["id", "class", "role"])).rlike(P.NAV_ATTR)
        | head_of(text, text_chars).rlike(P.NAV_TEXT)
    )


def entity_score(elems: DataFrame, entities: DataFrame) -> DataFrame:
    """Add the summed weight of the entities inside each element (0 when none).

    ``entities``: ``page_id, start_pos, end_pos, label``. Weights are summed per node first.
    """
    weight = F.coalesce(
        *[F.when(F.col("label") == name, F.lit(w)) for name, w in P.ENTITY_WEIGHTS.items()], F.lit(0.0)
    )
    per_node = entities.groupBy("page_id", "start_pos", "end_pos").agg(F.sum(weight).alias("weight"))
    outer = elems.select("page_id", "start_pos", "end_pos", F.col("node_id").alias("o_node"))
    inside = E.containing(per_node, outer, strict=False)
    total = inside.groupBy("page_id", F.col("o_node").alias("node_id")).agg(F.sum("weight").alias("entity_score"))
    return elems.join(shuffled(total), ["page_id", "node_id"], "left").withColumn(
        "entity_score", F.coalesce("entity_score", F.lit(0.0))
    )


def keyword_score(text: Column) -> Column:
    lowered = F.lower(text)
    found = F.size(F.filter(F.array(*map(F.lit, P.PRODUCT_KEYWORDS)), lambda k: F.contains(lowered, k)))
    return found * P.KEYWORD_WEIGHT


def structure_bonus(n_images: Column, n_actions: Column) -> Column:
    return F.when(n_images > 0, P.IMAGE_BONUS).otherwise(0.0) + F.when(n_actions > 0, P.ACTION_BONUS).otherwise(0.0)


def text_density(text_len: Column, outer_len: Column) -> Column:
    return text_len / (outer_len + 1e-6)


def product_candidates(
    elems: DataFrame,
    entities: DataFrame,
    min_chars: int = P.MIN_CHARS,
    max_chars: int = P.MAX_CHARS,
    min_words: int = P.MIN_WORDS,
    nav_chars: int | None = P.NAV_TEXT_CHARS,
) -> DataFrame:
    """Elements (with their text) of product size outside navigation, with a positive score."""
    sized = size_prefilter(elems, min_chars, max_chars, min_words)
    flagged = computed(sized, nav=is_navigation(F.col("tag"), F.col("src"), F.col("text"), nav_chars))
    scored = entity_score(flagged.where("not nav").drop("nav"), entities)
    score = (
        F.col("entity_score")
        + keyword_score(F.col("text"))
        + structure_bonus(F.col("n_images"), F.col("n_actions"))
        + text_density(F.col("text_len"), F.col("outer_len"))
    )
    return computed(scored, score=score).where("score > 0")


def looks_like_price(text: Column, src: Column) -> Column:
    in_attributes = F.exists(
        F.filter(M.attribute_list(src), lambda a: M.attribute_name(a).isin(P.PRICE_ATTR_NAMES)),
        lambda a: M.attribute_text(a).rlike(P.PRICE_ATTR),
    )
    return text.rlike(P.PRICE_TEXT) | in_attributes


def is_promo(text: Column, src: Column, text_chars: int | None = P.PROMO_TEXT_CHARS) -> Column:
    """A promotion by attributes, or by the words its text begins with (``text_chars``; None: anywhere)."""
    return joined_attributes(src, ["class", "id"]).rlike(P.PROMO_ATTR) | head_of(text, text_chars).rlike(P.PROMO_TEXT)


def price_flags(elems: DataFrame, promo_chars: int | None = P.PROMO_TEXT_CHARS) -> DataFrame:
    """Elements (with their text) with the flags ``has_price`` and ``promo``."""
    return computed(
        elems,
        has_price=looks_like_price(F.col("text"), F.col("src")),
        promo=is_promo(F.col("text"), F.col("src"), promo_chars),
    )


def card_candidates(flagged: DataFrame, min_words: int = P.CARD_MIN_WORDS) -> DataFrame:
    """Weighted tags that are no promotion, have text, and a price or enough words."""
    return flagged.where(
        F.col("tag").isin(list(P.TAG_WEIGHTS))
        & ~F.col("promo")
        & (F.col("text_len") > 0)
        & (F.col("has_price") | (F.col("n_words") >= min_words))
    )


def query_overlap(text: Column, query: str) -> Column:
    """Share of the distinct query words found among the lower-cased words of the text."""
    wanted = sorted(set(query.split()))
    if not wanted:
        return F.lit(0.0)
    shared = F.array_intersect(F.array(*map(F.lit, wanted)), words(F.lower(text)))
    return F.size(shared) / F.lit(float(len(wanted)))


def card_score(query: str = "") -> Column:
    tag_weight = F.coalesce(
        *[F.when(F.col("tag") == t, F.lit(w)) for t, w in P.TAG_WEIGHTS.items()], F.lit(P.TAG_WEIGHT_DEFAULT)
    )
    density = F.when(F.col("inner_bytes") > 0, F.col("text_len") / F.col("inner_bytes")).otherwise(0.0)
    return (
        F.when(F.col("has_price"), P.W_PRICE).otherwise(0.0)
        + query_overlap(F.col("text"), query) * P.W_QUERY
        + density * P.W_DENSITY
        + tag_weight * P.W_TAG
    )
