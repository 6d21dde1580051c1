"""Keyed work that stays even when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key.

    ``row_number() = 1`` is planned with a group limit before the shuffle, so every input
    partition sends at most one row per key however many copies it holds.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def dense_ids(rows: DataFrame, key: str, id_col: str, start: Column | int = 0) -> DataFrame:
    """Consecutive ids from ``start + 1`` over distinct keys, ordered by (md5 prefix, key).

    Numbering runs inside 4,096 even hash buckets; only the 4,096 bucket sizes are summed in
    one place.
    """
    bucketed = rows.withColumn("_b", F.substring(F.md5(key), 1, 3))
    sizes = bucketed.groupBy("_b").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy("_b").orderBy(key)
    return (
        bucketed.withColumn("_rn", F.row_number().over(inside))
        .join(F.broadcast(offsets), "_b")  # at most 4,096 rows
        .withColumn(id_col, (F.lit(start) + F.col("_off") + F.col("_rn")).cast("bigint"))
        .drop("_b", "_rn", "_off")
    )
