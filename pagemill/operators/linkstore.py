"""The link table in buckets by URL: a batch reads and rewrites the buckets it touches, not the table.

A bucket is a partition folder. New and changed rows replace their buckets by dynamic partition overwrite;
other folders stay as they are. Applying a batch again changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.operators import catalog as K
from pagemill.session import settled

BUCKETS = 64
LAYOUT = "id bigint, url string, domain_id bigint, link_html string, found_at timestamp_ntz, last_crawled_at timestamp_ntz, bucket int"
COLUMNS = [x.split()[0] for x in LAYOUT.split(", ")][:-1]


def bucket_of(url: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(buckets)).cast("int")


def _write(links: DataFrame, path: str, buckets: int) -> None:
    placed = links.select(*COLUMNS).withColumn("bucket", bucket_of(F.col("url"), buckets))
    placed.repartition("bucket").write.partitionBy("bucket").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def create(links: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Write a link table as a new store."""
    _write(links, path, buckets)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LAYOUT).parquet(path)


def apply(spark: SparkSession, path: str, domains: DataFrame, found: DataFrame, marks: DataFrame, order: list[str], buckets: int = BUCKETS) -> list[int]:
    """Add the links of ``found`` (``domain, url, link_html, found_at``, first by ``order``) that no domain has, and set
    the crawl times of ``marks`` (``domain, url, crawled_at``). Returns the buckets that were rewritten.

    Only the touched buckets are read whole; of the others the ids alone, for the highest. If a write is cut off,
    the batch is applied again: links that are there stay, and the rest gets further ids.
    """
    urls = found.select("url").union(marks.select("url")).where("url is not null")
    touched = [r.b for r in urls.select(bucket_of(F.col("url"), buckets).alias("b")).distinct().collect()]
    if not touched:
        return []
    store = read(spark, path)
    held = settled(store.where(F.col("bucket").isin(touched)).select(*COLUMNS))
    added = K.category_link_upsert(held, domains, found, order, store)
    known = settled(K.mark_crawled(added, domains, marks).select(*COLUMNS))
    old = held.select(F.col("id").alias("old_id"), F.col("last_crawled_at").alias("old_at"))
    changed = known.join(old, known["id"] == old["old_id"], "left").where(F.col("old_id").isNull() | ~F.col("last_crawled_at").eqNullSafe(F.col("old_at")))
    dirty = [r.b for r in changed.select(bucket_of(F.col("url"), buckets).alias("b")).distinct().collect()]
    if dirty:
        _write(known.where(bucket_of(F.col("url"), buckets).isin(dirty)), path, buckets)
    return sorted(dirty)
