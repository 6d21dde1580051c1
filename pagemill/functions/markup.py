"""Column expressions over markup, evaluated inside one row (no shuffle)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions import patterns as P
from pagemill.functions.text import decode_entities, strip_ws


def split_tokens(html: Column) -> Column:
    """All tokens of a page in order; they re-concatenate to the page."""
    return F.regexp_extract_all(html, F.lit(P.TOKEN), F.lit(0))


def is_text(token: Column) -> Column:
    return (~token.startswith("<")) | (token == "<")


def token_text(token: Column) -> Column:
    """Decoded, stripped text of a text token, empty for any other token."""
    return F.when(is_text(token), strip_ws(decode_entities(token))).otherwise("")


def page_text(html: Column, separator: str = " ") -> Column:
    """Stripped text pieces of a page joined by the separator."""
    pieces = F.transform(split_tokens(html), token_text)
    return F.array_join(F.filter(pieces, lambda t: t != ""), separator)


def attribute_list(open_tag: Column) -> Column:
    """Attributes of an open tag as ``name`` or ``name=value`` texts, in order."""
    body = F.regexp_replace(F.regexp_extract(open_tag, P.OPEN_TAG, 1), r"^<[^\s>/]+", "")
    return F.regexp_extract_all(body, F.lit(P.ATTRIBUTE), F.lit(0))


def attribute_name(attribute: Column) -> Column:
    return F.lower(F.regexp_extract(attribute, r"^\s+([^\s=]+)", 1))


def attribute_text(attribute: Column) -> Column:
    value = F.regexp_extract(attribute, r"(?s)^\s+[^\s=]+\s*=\s*(.*)$", 1)
    return decode_entities(F.regexp_replace(value, r"""^["']|["']$""", ""))


def attribute(open_tag: Column, name: str) -> Column:
    """Value of one attribute; NULL when the tag does not have it."""
    found = F.filter(attribute_list(open_tag), lambda a: attribute_name(a) == name)
    return attribute_text(F.get(found, F.lit(0)))


def wildcard_regex(names: Iterable[str]) -> str:
    """Shell-style attribute patterns as one anchored expression."""
    escaped = ("".join({"*": ".*", "?": "."}.get(c, f"\\{c}" if c in ".-+[]()" else c) for c in n) for n in names)
    return "^(?:" + "|".join(escaped) + ")$"


def drop_attributes(open_tag: Column, names: Iterable[str]) -> Column:
    """The open tag without the attributes whose name matches one of the patterns."""
    pattern = wildcard_regex(names)
    kept = F.filter(attribute_list(open_tag), lambda a: ~attribute_name(a).rlike(pattern))
    return F.concat(
        F.regexp_extract(open_tag, r"^(<[^\s>/]+)", 1),
        F.array_join(kept, ""),
        F.regexp_extract(open_tag, r"(\s*/?>)$", 1),
    )


def remove_containers(html: Column, tags: Iterable[str]) -> Column:
    """Remove comments and the given non-nesting elements with their content."""
    parts = "".join(rf"|<{t}\b{P.IN_TAG}>.*?</{t}\s*>" for t in tags)
    return F.regexp_replace(html, rf"(?is)<!--.*?-->{parts}", "")


def inner_text(html: Column) -> Column:
    """Stripped text pieces of a fragment joined without a separator."""
    return page_text(html, "")
