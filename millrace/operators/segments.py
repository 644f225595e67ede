"""Gap segmentation and exploratory summaries of one long time series.

The series has no key to partition by. Instead of one window over all rows, rows are
dealt by time bucket (a day, say); what crosses a bucket's border (the last timestamp
before it, the number of segments begun before it) comes from one summary row per bucket.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions.quantiles import quantiles
from millrace.functions.time import seconds_between


def _bucketed(df: DataFrame, ts: str, unit: str) -> DataFrame:
    return df.withColumn("__b", F.date_trunc(unit, F.col(ts)).cast("timestamp_ntz"))


def with_previous(df: DataFrame, ts: str = "timestamp", tie: str | None = None, unit: str = "day") -> DataFrame:
    """Adds ``previous_timestamp``: the row before in time order over the whole series."""
    d = _bucketed(df, ts, unit)
    order = [F.col(ts)] + ([F.col(tie)] if tie else [])
    inside = F.lag(ts).over(W.partitionBy("__b").orderBy(*order))
    ends = d.groupBy("__b").agg(F.max(ts).alias("__end"))
    # a row per bucket: the span of the series in days bounds this window
    ends = ends.select("__b", F.lag("__end").over(W.orderBy("__b")).alias("__before"))
    return d.withColumn("__in", inside).join(F.broadcast(ends), "__b").withColumn("previous_timestamp", F.coalesce("__in", "__before")).drop("__in", "__before")


def numbered(df: DataFrame, state: Column, breaks: Callable[[Column, Column], Column], name: str, ts: str = "timestamp", tie: str | None = None, unit: str = "day") -> DataFrame:
    """Adds ``name``, the number of the run a row belongs to, from 1 in time order, and ``__before``, the state of the row before.

    A run begins at the first row and wherever ``breaks(state before, state)`` holds. One
    ordered pass counts the breaks inside each bucket, without its first row; a summary row per bucket (first and
    last state, breaks inside) tells whether the first row breaks too and how many runs began
    before. So rows are shuffled and sorted once, and read by two jobs: the summaries and the result.
    Rows without a time have no place in the order and are left out.
    """
    order = [F.col(ts)] + ([F.col(tie)] if tie else [])
    w, at = W.partitionBy("__b").orderBy(*order), F.struct(*order)
    d = _bucketed(df.where(F.col(ts).isNotNull()), ts, unit).withColumn("__s", state).withColumn("__p", F.lag("__s").over(w)).withColumn("__row", F.row_number().over(w))
    inside = F.when(F.col("__row") > 1, breaks(F.col("__p"), F.col("__s")).cast("int")).otherwise(0)
    d = d.withColumn("__in", F.sum(inside).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    ends = d.groupBy("__b").agg(F.min_by("__s", at).alias("__first"), F.max_by("__s", at).alias("__last"), F.max("__in").alias("__n"))
    # a row per bucket: the span of the series in days bounds these windows
    days = W.orderBy("__b")
    ends = ends.withColumn("__from", F.lag("__last").over(days)).withColumn("__there", F.row_number().over(days) > 1)
    ends = ends.withColumn("__new", F.when(F.col("__there"), breaks(F.col("__from"), F.col("__first")).cast("int")).otherwise(1))
    base = F.coalesce(F.sum(F.col("__n") + F.col("__new")).over(days.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) + F.col("__new")
    ends = ends.select("__b", "__from", base.alias("__base"))
    out = d.join(F.broadcast(ends), "__b").withColumn("__before", F.when(F.col("__row") > 1, F.col("__p")).otherwise(F.col("__from")))
    return out.withColumn(name, (F.col("__base") + F.col("__in")).cast("long")).drop("__b", "__s", "__p", "__row", "__in", "__from", "__base")


def segment(df: DataFrame, threshold_s: float, ts: str = "timestamp", tie: str | None = None) -> DataFrame:
    """Adds ``previous_timestamp`` and ``segment_id`` (from 1): a new segment begins after a gap of more than ``threshold_s``."""
    gap = lambda before, now: seconds_between(before, now) > F.lit(threshold_s)
    return numbered(df, F.col(ts), gap, "segment_id", ts, tie).withColumnRenamed("__before", "previous_timestamp")


def segment_summary(segmented: DataFrame, ts: str = "timestamp") -> DataFrame:
    return segmented.groupBy("segment_id").agg(
        F.min(ts).alias("start_timestamp"), F.max(ts).alias("end_timestamp"), F.count(F.lit(1)).alias("row_count"), seconds_between(F.min(ts), F.max(ts)).alias("elapsed_seconds")
    )


def gaps(df: DataFrame, threshold_s: float, ts: str = "timestamp", tie: str | None = None) -> DataFrame:
    d = with_previous(df, ts, tie).where("previous_timestamp is not null")
    d = d.select("previous_timestamp", F.col(ts).alias("next_timestamp"), seconds_between(F.col("previous_timestamp"), F.col(ts)).alias("gap_seconds"))
    return d.where(F.col("gap_seconds") > F.lit(threshold_s))


def largest_gaps(df: DataFrame, threshold_s: float, n: int, ts: str = "timestamp", tie: str | None = None) -> DataFrame:
    return gaps(df, threshold_s, ts, tie).orderBy(F.desc("gap_seconds"), "next_timestamp").limit(n)


def coverage(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("row_count"), F.min(ts).alias("first_timestamp"), F.max(ts).alias("last_timestamp"), seconds_between(F.min(ts), F.max(ts)).alias("elapsed_seconds"),
        F.count_distinct(F.to_date(ts)).alias("observed_days"), F.count_distinct(ts).alias("distinct_timestamps"),
    )


QUANTILES = (0.01, 0.25, 0.5, 0.75, 0.99)


def unpivoted(df: DataFrame, columns: list[str], key: str, value: str) -> DataFrame:
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias(key), F.col(f"`{c}`").cast("double").alias(value)) for c in columns])).alias("__p")
    return df.select(pairs).select(f"__p.{key}", f"__p.{value}")


def signal_summary(df: DataFrame, signals: list[str]) -> DataFrame:
    """Exact summaries of all signals; the quantiles enter the plan as numbers."""
    found = quantiles(df, signals, QUANTILES)
    g = unpivoted(df, signals, "signal", "value").groupBy("signal").agg(
        F.count("value").alias("non_null"), F.min("value").alias("minimum"), F.avg("value").alias("mean"), F.max("value").alias("maximum"), F.stddev_pop("value").alias("stddev_pop")
    )
    q = []
    for j, p in enumerate(QUANTILES):
        of = F.lit(None).cast("double")
        for s in signals:
            of = F.when(F.col("signal") == s, F.lit(found[s][j])).otherwise(of)
        q.append(of.alias(f"q{int(p * 100):02d}"))
    return g.select("signal", "non_null", "minimum", *q, "mean", "maximum", "stddev_pop")


def state_frequencies(df: DataFrame, signals: list[str]) -> DataFrame:
    """Rows and share of each state; values are rounded to the nearest integer, halves to even."""
    d = unpivoted(df, signals, "signal", "value").select("signal", F.rint("value").cast("int").alias("state"))
    g = d.groupBy("signal", "state").agg(F.count(F.lit(1)).alias("row_count"))
    return g.withColumn("percentage", F.col("row_count") * 100.0 / F.sum("row_count").over(W.partitionBy("signal")))


def check_segments(rows: int, summary_rows: int, segments: int, gap_count: int) -> None:
    """Segments cover every row, and there is one more of them than gaps."""
    if rows != summary_rows or segments != gap_count + 1:
        raise ValueError(f"segments don't reconcile: {rows} rows, {summary_rows} in segments, {segments} segments, {gap_count} gaps")
