"""Reading pages, URL lists, labels and payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions.text import strip_ws

LABEL_SCHEMA = (
    "url string, html_content string, is_plp int, timestamp string, domain string, content_hash string, cleaned_html string"
)


def with_outcome(fetched: DataFrame) -> DataFrame:
    """Add ``reason``: why a fetch gives no page, null if it does."""
    empty = F.coalesce(F.col("html") == "", F.lit(True))
    reason = F.when(~F.coalesce("success", F.lit(False)), F.coalesce("error", F.lit("failed"))).when(empty, "empty")
    return fetched.withColumn("reason", reason)


def usable_pages(fetched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fetched pages (``page_id, url, html, success, error``) and the dropped ones with a reason."""
    marked = with_outcome(fetched)
    return (
        marked.where("reason is null").select("page_id", "url", "html"),
        marked.where("reason is not null").select("page_id", "url", "reason"),
    )


def urls_from_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """One URL per line; blank lines and ``#`` comments are skipped."""
    stripped = lines.select(strip_ws(F.col(column)).alias("url"))
    return stripped.where((F.col("url") != "") & ~F.col("url").startswith("#"))


def urls_from_text(spark: SparkSession, path: str) -> DataFrame:
    return urls_from_lines(spark.read.text(path))


def urls_from_json_column(rows: DataFrame, column: str, url_key: str = "url") -> DataFrame:
    """URLs of JSON documents: a list of objects with the key or bare strings, or one such object.

    Anything else - objects without the key, numbers, nested lists - is skipped.
    """
    doc = F.try_parse_json(column)
    parsed = rows.withColumn("_doc", doc).where("_doc is not null")
    kind = F.schema_of_variant("_doc")
    one = parsed.where(kind.startswith("OBJECT")).select(F.col("_doc").alias("item"), F.lit(True).alias("top"))
    many = parsed.where(kind.startswith("ARRAY")).select(
        F.explode(F.expr("try_variant_get(_doc, '$', 'array<variant>')")).alias("item"), F.lit(False).alias("top")
    )
    items = one.unionByName(many)
    item_kind = F.schema_of_variant("item")
    path = f"$['{url_key}']"
    value = F.when(item_kind.startswith("OBJECT"), F.try_variant_get("item", path, "string")).when(
        (item_kind == "STRING") & ~F.col("top"), F.try_variant_get("item", "$", "string")
    )
    return items.select(value.alias("url")).where("url is not null")


def urls_from_json(spark: SparkSession, path: str, url_key: str = "url") -> DataFrame:
    return urls_from_json_column(spark.read.text(path, wholetext=True), "value", url_key)


def labels_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LABEL_SCHEMA).option("mode", "DROPMALFORMED").json(path)


def cached_or_newest(snapshot: DataFrame, fetched: DataFrame, use_cache: bool) -> DataFrame:
    """One page per URL: the stored snapshot where allowed and present, else the newest fetch.

    ``fetched`` carries ``url, html, fetched_at, fetch_id`` (``fetch_id`` unique); the snapshot
    ``url, html``. The newest fetch is chosen by its id, and its html joined back for the chosen
    ones only.
    """
    newest = fetched.groupBy("url").agg(F.max(F.struct("fetched_at", "fetch_id")).alias("n"))
    if use_cache:
        newest = newest.join(snapshot.select("url"), "url", "left_anti")
    chosen = newest.select(F.col("n.fetch_id").alias("fetch_id"))
    taken = fetched.join(chosen, "fetch_id", "left_semi").select("url", "html", F.lit("fetch").alias("source"))
    return snapshot.select("url", "html", F.lit("cache").alias("source")).unionByName(taken) if use_cache else taken
