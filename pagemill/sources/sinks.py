"""Writing products, labels, artifacts and training data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_products(products: DataFrame, path: str) -> None:
    products.write.mode("overwrite").option("ignoreNullFields", "true").json(path)


def append_labels(samples: DataFrame, path: str) -> None:
    """One JSON line per sample, in one folder per site.

    Sites are brought together first, so that an append adds a few files to a site, not one per task;
    a large site still spreads over several tasks (adaptive execution splits it). A site that is null
    or empty is the folder of nulls.
    """
    samples.hint("rebalance", "domain").write.mode("append").partitionBy("domain").json(path)


def append_schemas(schemas: DataFrame, path: str) -> None:
    """Schema structs (or maps) stored as JSON text."""
    schemas.withColumn("schema_json", F.to_json("schema")).drop("schema").write.mode("append").parquet(path)


def artifact_name(domain: Column, run_id: Column, suffix: Column) -> Column:
    """``domain[_run]_suffix`` with dots of the domain as underscores; a missing run id is left out."""
    run = F.when(run_id != "", run_id)
    return F.concat_ws("_", F.replace(domain, F.lit("."), F.lit("_")), run, suffix)


def write_artifacts(artifacts: DataFrame, path: str) -> None:
    """Page artifacts (``domain, run_id, kind, name, body``) as a table partitioned by run and kind.

    Names are clustered inside the files, so one site's artifacts are found by file statistics
    while a site with most of the pages still spreads over many files.
    """
    artifacts.sortWithinPartitions("domain", "name").write.mode("append").partitionBy("run_id", "kind").parquet(path)


def write_training(records: DataFrame, path: str) -> None:
    records.write.mode("overwrite").parquet(path)
