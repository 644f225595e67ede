"""Operational measures of alarms: event coverage, latency, burden, contiguity, drift, selection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions.time import elapsed_seconds
from millrace.operators.robust import score_summary


def event_evidence(scored: DataFrame, ts: str = "timestamp", eligible: str = "eligible_for_known_event_evaluation", *keys: str) -> DataFrame:
    """Per documented event: first scored row, first alarm, latency from the first scored row, counts."""
    d = scored.where(eligible).groupBy(*keys, "source_event").agg(
        F.min(ts).alias("first_scored_timestamp"), F.min(F.when(F.col("alarm"), F.col(ts))).alias("first_alarm_timestamp"), F.count(F.lit(1)).alias("event_rows"), F.count_if("alarm").alias("alarm_rows")
    )
    return d.withColumn("covered", F.col("first_alarm_timestamp").isNotNull()).withColumn("latency_seconds", elapsed_seconds(F.col("first_scored_timestamp"), F.col("first_alarm_timestamp")))


def burden(scored: DataFrame, sampling_s: float, eligible: str = "eligible_for_alarm_burden", *keys: str) -> DataFrame:
    """Alarms on unlabelled rows: count, fraction, and per 24 observed hours; null on nothing observed."""
    d = scored.where(eligible).groupBy(*keys).agg(F.count(F.lit(1)).alias("burden_rows"), F.count_if("alarm").alias("burden_alarms"))
    return d.withColumn("alarm_burden_fraction", F.when(F.col("burden_rows") > 0, F.col("burden_alarms") / F.col("burden_rows"))).withColumn(
        "alarms_per_24_hours", F.when(F.col("burden_rows") > 0, F.col("burden_alarms") * 24.0 / (F.col("burden_rows") * F.lit(sampling_s) / 3600.0))
    )


def longest_run(scored: DataFrame, sampling_s: float, ts: str = "timestamp", key: str = "source_event", eligible: str = "eligible_for_known_event_evaluation", tie: str | None = None) -> DataFrame:
    """Longest run of alarms per event. A run ends at a row without alarm, or when a row follows the one before, alarm or not, by more than 1.5 times the sampling."""
    order = [F.col(ts)] + ([F.col(tie)] if tie else [])
    w = W.partitionBy(key).orderBy(*order)
    gap = elapsed_seconds(F.lag(ts).over(w), F.col(ts)) > F.lit(1.5 * sampling_s)
    d = scored.where(eligible).withColumn("__new", F.when(~F.col("alarm") | F.coalesce(gap, F.lit(True)) | ~F.coalesce(F.lag("alarm").over(w), F.lit(False)), 1).otherwise(0))
    d = d.withColumn("__run", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    runs = d.groupBy(key, "__run").agg(F.count_if("alarm").alias("n"))
    rows = runs.groupBy(key).agg(F.max("n").alias("longest_run_rows"))
    size = d.groupBy(key).agg(F.count(F.lit(1)).alias("event_rows"))
    return rows.join(size, key).select(key, "longest_run_rows", (F.col("longest_run_rows") * F.lit(sampling_s)).alias("longest_run_seconds"), (F.col("longest_run_rows") / F.col("event_rows")).alias("contiguity_fraction"))


def drift(train: DataFrame, validation: DataFrame, column: str) -> DataFrame:
    """Difference of medians, ratio of 95th percentiles (null if training's is 0)."""
    a, b = score_summary(train, column), score_summary(validation, column)
    pick = lambda d, side: d.select(*[F.col(c).alias(f"{side}_{c}") for c in ("median", "p95")])
    d = pick(a, "t").crossJoin(F.broadcast(pick(b, "v")))  # one row each
    return d.select((F.col("v_median") - F.col("t_median")).alias("median_difference"), F.when(F.col("t_p95") != 0, F.col("v_p95") / F.col("t_p95")).alias("p95_ratio"))


def candidate_metrics(scored: DataFrame, sampling_s: float, *keys: str) -> DataFrame:
    """One row per candidate: coverage, mean latency over covered events, burden."""
    e = event_evidence(scored, "timestamp", "eligible_for_known_event_evaluation", *keys).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("event_count"), F.count_if("covered").alias("covered_events"), F.avg(F.when(F.col("covered"), F.col("latency_seconds"))).alias("mean_latency_seconds")
    )
    e = e.withColumn("event_coverage", F.when(F.col("event_count") > 0, F.col("covered_events") / F.col("event_count")))
    b = burden(scored, sampling_s, "eligible_for_alarm_burden", *keys)
    return e.join(b, list(keys), "full_outer") if keys else e.crossJoin(F.broadcast(b))  # one row each


def select_model(metrics: DataFrame) -> DataFrame:
    """The best candidate: coverage down, latency up, burden up (unknown last), complexity up."""
    return metrics.orderBy(F.coalesce("event_coverage", F.lit(-1.0)).desc(), F.col("mean_latency_seconds").asc_nulls_last(), F.col("alarms_per_24_hours").asc_nulls_last(), "complexity_rank").limit(1)


def comparison(a: DataFrame, b: DataFrame, names: tuple[str, str] = ("forest", "robust")) -> DataFrame:
    """Two models' held-out measures side by side, as rows."""
    return a.withColumn("model", F.lit(names[0])).unionByName(b.withColumn("model", F.lit(names[1])))
