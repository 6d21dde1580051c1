"""Incremental forms: the same results as rows arrive.

Every function takes a streaming DataFrame and returns or runs a stream; state and sinks are
recovered from the checkpoint folder after a restart.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagemill.operators import catalog as K
from pagemill.operators import linkstore


def read_files(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def content_dedup(stream: DataFrame, content: str = "html", within: str = "10 minutes") -> DataFrame:
    """Each distinct content once among those that arrive ``within`` some time of each other.

    State holds one hash per distinct content that arrived lately, not the content, and forgets it when the time
    is over; ``accept_new`` asks the stored table for older ones. The time is that of arrival, so no row is late.
    """
    arrived = stream.withColumns({"content_hash": F.md5(content), "arrived_at": F.current_timestamp()})
    return arrived.withWatermark("arrived_at", within).dropDuplicatesWithinWatermark(["content_hash"])


def accept_new(path: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that stores the rows whose ``content_hash`` no earlier batch has stored.

    Batch ``n`` writes ``path/batch=n`` from the folders before it alone, so repeating it writes the same again. Only
    the stored hashes are read, not the rows.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        batch.limit(0).write.mode("ignore").parquet(f"{path}/batch=-1")
        before = batch.sparkSession.read.parquet(path).where(F.col("batch") < batch_id).select("content_hash")
        fresh = batch.dropDuplicates(["content_hash"]).join(before, "content_hash", "left_anti").select(batch.columns)
        fresh.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return apply


def label_stats(stream: DataFrame) -> DataFrame:
    """Running sample counts per site and label (update mode: the groups that a batch changes)."""
    return stream.groupBy("domain", "is_plp").agg(F.count("*").alias("n_samples"))


def latest_schema(stream: DataFrame) -> DataFrame:
    """Newest schema per domain so far (update mode: the domains that a batch changes)."""
    return K.latest_schema(stream)


def log_changes(path: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function for update mode: a batch writes the groups that it changed, and nothing else."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return apply


def merged(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The table that ``log_changes`` keeps: the newest row of each group."""
    log = spark.read.parquet(path)
    rest = [c for c in log.columns if c not in (*keys, "batch")]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")


def fold(spark: SparkSession, path: str, keys: list[str], to: str) -> None:
    """Write the table as it is now as the first batch of a new log; its stream starts with a new checkpoint."""
    merged(spark, path, keys).write.mode("overwrite").parquet(f"{to}/batch=-1")


def catalog_upsert(store: str, domains: DataFrame) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function keeping a link table up to date by a log of changes.

    Batches carry ``kind`` (``found`` or ``crawled``), ``domain, url, link_html, at, seq``. Batch ``n``
    writes its new links and crawl marks to ``changes/batch=n``, from the folders before it alone, so
    repeating it writes the same again. ``compact`` folds the log into a new base table.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        before = catalog_table(batch.sparkSession, store, before=batch_id)
        found = batch.where("kind = 'found'").select("domain", "url", "link_html", F.col("at").alias("found_at"), "seq")
        marks = batch.where("kind = 'crawled'").select("domain", "url", F.col("at").alias("crawled_at"))
        fresh = K.category_link_upsert(before, domains, found, ["seq"]).join(before.select("id"), "id", "left_anti")
        known = K.mark_crawled(before.unionByName(fresh), domains, marks)
        touched = known.join(before.select("id", F.struct("last_crawled_at").alias("old")), "id", "left")
        changed = touched.where(F.col("old").isNull() | ~F.col("last_crawled_at").eqNullSafe(F.col("old.last_crawled_at")))
        _link_rows(changed).write.mode("overwrite").parquet(f"{store}/changes/batch={batch_id}")

    return apply


def store_upsert(path: str, domains: DataFrame, buckets: int = linkstore.BUCKETS) -> Callable[[DataFrame, int], None]:
    """``catalog_upsert`` on a bucketed store: a batch reads and rewrites the buckets of its links only."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        found = batch.where("kind = 'found'").select("domain", "url", "link_html", F.col("at").alias("found_at"), "seq")
        marks = batch.where("kind = 'crawled'").select("domain", "url", F.col("at").alias("crawled_at"))
        linkstore.apply(batch.sparkSession, path, domains, found, marks, ["seq"], buckets)

    return apply


LINK_COLUMNS = ["id", "url", "domain_id", "link_html", "found_at", "last_crawled_at"]
LINK_TYPES = {"id": "bigint", "domain_id": "bigint"}


def _link_rows(links: DataFrame) -> DataFrame:
    return links.select(*(F.col(c).cast(LINK_TYPES[c]).alias(c) if c in LINK_TYPES else F.col(c) for c in LINK_COLUMNS))


def start_catalog(spark: SparkSession, store: str, links: DataFrame) -> None:
    """Write the table the first batch starts from."""
    _link_rows(links).write.mode("overwrite").parquet(f"{store}/base")
    empty = _link_rows(links).limit(0)
    empty.write.mode("overwrite").parquet(f"{store}/changes/batch=-1")


def catalog_table(spark: SparkSession, store: str, before: int | None = None) -> DataFrame:
    """The base table with the newest change of each link (of the batches ``before`` one, if given)."""
    base = spark.read.parquet(f"{store}/base").withColumn("batch", F.lit(-1))
    changes = spark.read.schema(base.schema).parquet(f"{store}/changes")
    logged = base.unionByName(changes if before is None else changes.where(F.col("batch") < before))
    newest = logged.groupBy("id").agg(F.max_by(F.struct(*LINK_COLUMNS[1:]), "batch").alias("l"))
    return newest.select("id", "l.*")


def compact(spark: SparkSession, store: str, to: str) -> None:
    """Write the table as it is now as the base of a new store; its stream starts with a new checkpoint."""
    start_catalog(spark, to, catalog_table(spark, store))


def run_now(stream: DataFrame, checkpoint: str, path: str | None = None, mode: str = "append", name: str | None = None, each=None) -> StreamingQuery:
    """Process everything available and stop."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if each is not None:
        writer = writer.foreachBatch(each)
    elif name is not None:
        writer = writer.format("memory").queryName(name)
    else:
        writer = writer.format("parquet").option("path", path)
    query = writer.start()
    query.awaitTermination()
    return query
