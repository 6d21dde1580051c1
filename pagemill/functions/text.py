"""Column expressions over plain text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions.patterns import ENTITIES, REFERENCE, WS_ASCII, WS_CHARS
from pagemill.functions.staged import let

# The same characters as WS: the white-space property plus four separators it lacks.
UNICODE_WS = r"(?U)[\s\x1C\x1D\x1E\x1F]+"


def strip_ws(text: Column | str) -> Column:
    """Remove Unicode white space at both ends."""
    return F.btrim(text, F.lit(WS_CHARS))


def _pieces(text: Column) -> Column:
    """Split at white space; a text without multi-byte characters takes the faster ASCII class."""
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, F.split(text, f"[{WS_ASCII}]+")).otherwise(F.split(text, UNICODE_WS))


def words(text: Column) -> Column:
    """White-space separated words; an empty text has none."""
    return let(strip_ws(text), lambda t: F.when(t == "", F.expr("cast(array() as array<string>)")).otherwise(_pieces(t)))


def stripped_word_count(text: Column) -> Column:
    """Word count of a text already stripped; an empty one has none."""
    return F.when(text == "", 0).otherwise(F.size(_pieces(text)))


def word_count(text: Column) -> Column:
    return let(strip_ws(text), stripped_word_count)


def first_words(text: Column, n: int) -> Column:
    return F.array_join(F.slice(words(text), 1, n), " ")


def _from_number(reference: Column) -> Column:
    """The character of ``&#12;`` or ``&#xC;``; U+FFFD for numbers that are none."""
    hexed = F.lower(F.substring(reference, 3, 1)) == "x"
    number = F.when(hexed, F.conv(F.regexp_extract(reference, "([0-9A-Fa-f]+);$", 1), 16, 10)).otherwise(
        F.regexp_extract(reference, "([0-9]+);$", 1)
    )
    n = number.try_cast("bigint")
    usable = n.between(1, 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
    safe = F.when(usable, n).otherwise(0xFFFD)
    return F.decode(F.unhex(F.lpad(F.hex(safe), 8, "0")), "UTF-32")


def decode_entities(text: Column) -> Column:
    """Replace the named references of ``ENTITIES`` and numeric ones, decimal or hexadecimal, once each.

    A number that is no character gives U+FFFD; anything else stays as it is.
    """
    named = F.create_map(*(F.lit(x) for name, value in ENTITIES.items() for x in (f"&{name};", value)))
    parts = F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0))
    decoded = F.transform(
        parts,
        lambda t: F.when(t.startswith("&#") & t.endswith(";"), _from_number(t))
        .when(t.startswith("&"), F.coalesce(F.try_element_at(named, t), t))
        .otherwise(t),
    )
    return F.when(text.contains("&"), F.array_join(decoded, "")).otherwise(text)


def escape_markup(text: Column) -> Column:
    """Text as it is written between tags."""
    for value, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(value), F.lit(name))
    return text


def is_blank(text: Column) -> Column:
    """NULL and all-white-space count as blank."""
    return F.coalesce(strip_ws(text) == "", F.lit(True))
