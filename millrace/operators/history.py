"""Append-only logs: newest first, with retention."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def recent(log: DataFrame, n: int, key: str, operation: str | None = None, column: str = "operation") -> DataFrame:
    d = log if operation is None else log.where(F.col(column) == operation)
    return d.orderBy(F.desc(key)).limit(n)


def retained(log: DataFrame, n: int, key: str, *groups: str) -> DataFrame:
    """The newest n rows (of each group)."""
    if not groups:
        keep = log.select(key).orderBy(F.desc(key)).limit(n)
        return log.join(keep, key, "left_semi")
    w = W.partitionBy(*groups).orderBy(F.desc(key))
    return log.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")


def unique_ids(log: DataFrame, key: str) -> bool:
    return log.groupBy(key).count().where("count > 1").isEmpty()


def counters(log: DataFrame, *keys: str) -> DataFrame:
    return log.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count"))
