"""Page cleaning and text reports."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import markup as M
from pagemill.functions import patterns as P
from pagemill.functions.staged import computed
from pagemill.functions.text import strip_ws, word_count, words
from pagemill.operators import elements as E


def strip_elements(pages: DataFrame, tags: Iterable[str], comments: bool = False) -> DataFrame:
    """Each page without the given elements (and their content); nothing left gives an empty text."""
    tags = list(tags)
    return E.rewritten(pages, lambda page: page.without(tags, comments))


def strip_attributes(html: Column, names: Iterable[str]) -> Column:
    """A page without the attributes matching the names; evaluated inside the row."""
    names = list(names)
    has_attributes = lambda t: t.rlike(r"^<[A-Za-z][^\s>]*\s")
    opening = lambda t: F.regexp_extract(t, P.OPEN_TAG, 1)
    return F.array_join(
        F.transform(
            M.split_tokens(html),
            lambda t: F.when(
                has_attributes(t),
                F.concat(M.drop_attributes(opening(t), names), F.substring(t, F.length(opening(t)) + 1, F.length(t))),
            ).otherwise(t),
        ),
        "",
    )


def outline(pages: DataFrame) -> DataFrame:
    """Pretty form of each page: one token per line, indented by one space per open element."""
    return E.rewritten(pages, lambda page: page.outline())


def head_body_text(html: Column) -> tuple[Column, Column]:
    """Text before and after the start of the body."""
    at = r"(?is)^(.*?)<body\b"
    has_body = html.rlike(r"(?i)<body\b")
    head = F.when(has_body, F.regexp_extract(html, at, 1)).otherwise("")
    body = F.when(has_body, F.regexp_replace(html, r"(?is)^.*?<body\b", "<body")).otherwise(html)
    return M.page_text(head), M.page_text(body)


def truncate(text: Column, limit: int | None = P.MODEL_MAX_CHARS) -> Column:
    """The first ``limit`` characters; None cuts nothing."""
    return text if limit is None else F.substring(text, 1, limit)


def chunks(rows: DataFrame, id_col: str, text_col: str, size: int = P.CHUNK_WORDS) -> DataFrame:
    """Model input cut into pieces of ``size`` words."""
    w = computed(rows.select(id_col, text_col), w=words(F.col(text_col))).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.size("w"), F.lit(size))
    return w.select(id_col, F.posexplode(F.transform(starts, lambda s: F.slice("w", s, F.lit(size)))).alias("chunk_no", "part")).select(
        id_col, "chunk_no", F.size("part").alias("n_words"), F.array_join("part", " ").alias("chunk")
    )


def preview(pages: DataFrame, chars: int | None = P.PREVIEW_CHARS) -> DataFrame:
    """Heading facts and the first ``chars`` characters (None: all) of each page without scripts and styles.

    A cut preview ends in "..."; ``cleaned_length`` says how long the whole is.
    """
    cleaned = M.remove_containers(F.col("html"), ["script", "style"])
    more = F.lit("") if chars is None else F.when(F.length("cleaned") > chars, "...").otherwise("")
    shown = F.concat(truncate(F.col("cleaned"), chars), more)
    return pages.select("page_id", "url", "html", cleaned.alias("cleaned")).select(
        "page_id",
        "url",
        F.length("html").alias("html_length"),
        F.length("cleaned").alias("cleaned_length"),
        strip_ws(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title\s*>", 1)).alias("title"),
        shown.alias("preview"),
    )


def token_counts(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return rows.select(id_col, word_count(F.col(text_col)).alias("n_tokens"))
