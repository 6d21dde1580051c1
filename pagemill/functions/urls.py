"""Column expressions over URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions.staged import let


def base_domain(url: Column) -> Column:
    """Site key: the network location without one leading ``www.``.

    Other subdomains, port, user part and case are kept; a bare host is accepted.
    """
    full = F.when(url.startswith("http://") | url.startswith("https://"), url).otherwise(
        F.concat(F.lit("https://"), url)
    )
    host = F.regexp_extract(full, r"^https?://([^/?#]*)", 1)
    return F.regexp_replace(host, r"^www\.", "")


def netloc(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1)


def sample_domain(url: Column) -> Column:
    """Labelling key: the network location with every ``www.`` removed."""
    return F.replace(netloc(url), F.lit("www."), F.lit(""))


def _remove_dots(path: Column, relative: Column) -> Column:
    """Resolve ``.`` and ``..`` of a rooted path; empty inner segments go if it came from a relative one."""
    parts = F.split(path, "/")
    inner = F.slice(parts, F.lit(2), F.size(parts))
    kept = F.filter(inner, lambda s, i: ~relative | (s != "") | (i == F.size(inner) - 1))
    folded = F.aggregate(
        kept,
        F.lit(""),
        lambda acc, s: F.when(s == "..", F.regexp_replace(acc, r"/[^/]*$", ""))
        .when(s == ".", acc)
        .otherwise(F.concat(acc, F.lit("/"), s)),
    )
    trailing = F.when(path.rlike(r"/\.{1,2}$"), F.lit("/")).otherwise(F.lit(""))
    return F.concat(folded, trailing)


def url_resolve(href: Column, base: Column) -> Column:
    """Absolute form of ``href`` seen on page ``base``.

    An href that names a network location (also ``//host/x``) stays as it is, and so does
    one with another scheme; everything else is joined to the base.
    """
    scheme_pattern = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
    return let(
        F.struct(
            href.alias("href"),
            base.alias("base"),
            F.lower(F.regexp_extract(href, scheme_pattern, 1)).alias("scheme"),
            F.lower(F.regexp_extract(base, scheme_pattern, 1)).alias("base_scheme"),
            F.regexp_replace(F.regexp_replace(href, r"[\t\r\n]", ""), r"^[A-Za-z][A-Za-z0-9+.\-]*:", "").alias("rest"),
        ),
        lambda x: F.when(x["href"] == "", x["base"])
        .when(
            x["href"].rlike(r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//[^/?#]")
            | ((x["scheme"] != "") & (x["scheme"] != x["base_scheme"])),
            x["href"],
        )
        .otherwise(_join(x["rest"], x["base"])),
    )


def _join(rest: Column, base: Column) -> Column:
    """A reference without scheme and network location, joined to the base URL."""
    parts = F.struct(
        F.regexp_extract(rest, r"^([^?#]*)", 1).alias("path"),
        F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1).alias("query"),
        F.regexp_extract(rest, r"^[^#]*#(.*)$", 1).alias("fragment"),
        F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1).alias("base_path"),
        F.regexp_extract(base, r"^[^?#]*\?([^#]*)", 1).alias("base_query"),
        F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1).alias("base_site"),
    )
    return let(
        parts,
        lambda p: F.concat(
            p["base_site"],
            F.when(p["path"] == "", p["base_path"]).otherwise(_full_path(p)),
            _prefixed("?", F.when((p["path"] == "") & (p["query"] == ""), p["base_query"]).otherwise(p["query"])),
            _prefixed("#", p["fragment"]),
        ),
    )


def _full_path(p: Column) -> Column:
    relative = ~p["path"].startswith("/")
    folder = F.regexp_replace(p["base_path"], r"[^/]*$", "")
    rooted = F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), p["path"])
    return let(
        F.when(relative, rooted).otherwise(p["path"]),
        lambda j: F.when(j.rlike(r"/\.{1,2}(/|$)") | (relative & j.contains("//")), _remove_dots(j, relative)).otherwise(j),
    )


def _prefixed(mark: str, value: Column) -> Column:
    return let(value, lambda v: F.when(v != "", F.concat(F.lit(mark), v)).otherwise(F.lit("")))
