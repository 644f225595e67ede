"""Robust-distance anomaly scores: fitted on reference rows, frozen, then applied."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.arrays import any_null, first_largest, greatest_of
from millrace.functions.quantiles import quantiles

#: Columns that describe a row and are never features.
GOVERNANCE = frozenset(
    "event_id timestamp segment_id partition target_state binary_target source_event exclusion_reason history_group_id history_rows_available C0 user_id".split()
)


@dataclass(frozen=True)
class Parameter:
    feature: str
    median: float
    iqr: float


@dataclass(frozen=True)
class Fit:
    retained: tuple[Parameter, ...]
    excluded: tuple[tuple[str, str], ...]
    reference_rows: int
    threshold: float | None = None


def numeric_features(df: DataFrame, exclude: frozenset[str] = GOVERNANCE) -> list[str]:
    """Every numeric column that doesn't describe the row, in column order."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def fit(reference: DataFrame, features: list[str]) -> Fit:
    """Exact median and interquartile range of every feature, all features in the same passes.

    Nulls or a non-finite range are errors; a feature whose range is 0 is left out, with the reason.
    """
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, f in enumerate(features):
        c = F.col(f"`{f}`").cast("double")
        aggs.append(F.count_if(c.isNull()).alias(f"z{i}"))
    r = reference.agg(*aggs).first()
    if not r["n"]:
        raise ValueError("no reference rows")
    for i, f in enumerate(features):
        if r[f"z{i}"]:
            raise ValueError(f"{f} has nulls on reference rows")
    found = quantiles(reference, features, (0.25, 0.5, 0.75))
    kept, left = [], []
    for f in features:
        lo, mid, hi = found[f]
        iqr = hi - lo
        if not math.isfinite(iqr) or not math.isfinite(mid) or iqr < 0:
            raise ValueError(f"{f} has no finite range")
        if iqr == 0:
            left.append((f, "zero_iqr"))
        else:
            kept.append(Parameter(f, mid, iqr))
    if not kept:
        raise ValueError("no feature varies on reference rows")
    return Fit(tuple(kept), tuple(left), r["n"])


def deviation(p: Parameter) -> Column:
    return F.abs((F.col(f"`{p.feature}`") - F.lit(p.median)) / F.lit(p.iqr))


def score(parameters: tuple[Parameter, ...]) -> Column:
    """Largest absolute robust deviation; a null feature is passed over."""
    return greatest_of([deviation(p) for p in parameters])


def threshold(scores: DataFrame, quantile: float, column: str = "robust_distance_score") -> float:
    """The exact, interpolated quantile of training scores."""
    return quantiles(scores, [column], [quantile])[column][0]


def with_alarm(df: DataFrame, score_col: str, limit: float, name: str = "alarm") -> DataFrame:
    """Alarms lie strictly above the threshold."""
    return df.withColumn(name, F.col(score_col) > F.lit(limit))


def check_complete(df: DataFrame, parameters: tuple[Parameter, ...]) -> None:
    """No retained feature may be null on rows to be scored."""
    n = df.where(any_null([p.feature for p in parameters])).count()
    if n:
        raise ValueError(f"{n} rows have null features")


SUMMARY = ((0.5, "median"), (0.95, "p95"), (0.995, "p995"))


def score_summary(df: DataFrame, column: str) -> DataFrame:
    c, found = F.col(column), quantiles(df, [column], [q for q, _ in SUMMARY])[column]
    middle = [F.lit(v).cast("double").alias(n) for v, (_, n) in zip(found, SUMMARY, strict=True)]
    return df.agg(F.count(c).alias("row_count"), F.min(c).alias("minimum"), F.max(c).alias("maximum")).select("row_count", "minimum", *middle, "maximum")


def contributions(parameters: tuple[Parameter, ...]) -> Column:
    return F.array(*[F.struct(F.lit(p.feature).alias("feature"), deviation(p).alias("contribution")) for p in parameters])


def with_dominant(df: DataFrame, parameters: tuple[Parameter, ...]) -> DataFrame:
    """Adds the struct ``dominant``: the feature that deviates most, the first of equals."""
    return df.withColumn("__c", contributions(parameters)).withColumn("dominant", first_largest(F.col("__c"), "contribution")).drop("__c")


def diagnostic_rows(features: DataFrame, eligibility: DataFrame, scores: DataFrame, parameters: tuple[Parameter, ...], key: str = "timestamp") -> DataFrame:
    """Train and validation rows with saved scores where there are any, else recomputed; training rows have no alarm. ``key`` is unique in each table."""
    flags = ("eligible_for_reference_fit", "eligible_for_scoring", "eligible_for_known_event_evaluation", "eligible_for_alarm_burden")
    f = features.where(F.col("partition").isin("train", "validation"))
    d = f.drop(*flags).join(eligibility.select(key, *flags).hint("merge"), key).join(scores.select(key, F.col("robust_distance_score").alias("__s"), "alarm").hint("merge"), key, "left")
    d = with_dominant(d, parameters)
    return d.withColumn("robust_distance_score", F.coalesce("__s", F.col("dominant.contribution"))).drop("__s")


def dominant_counts(rows: DataFrame, n: int) -> DataFrame:
    g = rows.groupBy(F.col("dominant.feature").alias("feature")).agg(F.count(F.lit(1)).alias("dominant_rows"), F.count_if("alarm").alias("alarm_rows"), F.max("dominant.contribution").alias("maximum_contribution"))
    return g.orderBy(F.desc("alarm_rows"), F.desc("dominant_rows"), "feature").limit(n)


def alarms_by_segment(rows: DataFrame, n: int) -> DataFrame:
    g = rows.groupBy("segment_id").agg(F.count(F.lit(1)).alias("scored_rows"), F.count_if("alarm").alias("alarm_rows"), F.count_if("eligible_for_alarm_burden").alias("burden_rows"))
    return g.orderBy(F.desc("alarm_rows"), "segment_id").limit(n)


def alarms_by_hour(rows: DataFrame, ts: str = "timestamp") -> DataFrame:
    return rows.groupBy(F.hour(ts).cast("long").alias("hour_utc")).agg(F.count(F.lit(1)).alias("scored_rows"), F.count_if("alarm").alias("alarm_rows"))


def alarms_by_state(rows: DataFrame, states: list[str], n: int) -> DataFrame:
    burden = F.col("eligible_for_alarm_burden")
    g = rows.groupBy(*states).agg(F.count(F.lit(1)).alias("scored_rows"), F.count_if(burden).alias("burden_rows"), F.count_if(burden & F.col("alarm")).alias("alarm_rows"))
    g = g.withColumn("alarm_burden_fraction", F.when(F.col("burden_rows") > 0, F.col("alarm_rows") / F.col("burden_rows")))
    return g.orderBy(F.desc("alarm_rows"), F.desc("burden_rows"), *[F.col(s).asc_nulls_last() for s in states]).limit(n)


def small_ranges(parameters: tuple[Parameter, ...], ratio: float) -> list[Parameter]:
    """Retained features whose range is tiny beside the largest."""
    most = max(p.iqr for p in parameters)
    return [p for p in parameters if p.iqr <= most * ratio]


def run(features: DataFrame, quantile: float = 0.995, partition: str = "validation", names: list[str] | None = None, key: str = "timestamp") -> tuple[Fit, DataFrame]:
    """Fit and threshold on training reference rows, then scores and alarms of one held-out partition.

    ``features`` carries the eligibility flags. The fitted numbers enter the scoring plan as
    literals, so scoring is one map over the scan. ``key`` names a row where timestamps repeat; scores carry it.
    """
    names = names or [f for f in numeric_features(features) if not f.startswith("eligible")]
    reference = features.where(F.col("eligible_for_reference_fit") & (F.col("partition") == "train"))
    found = fit(reference, names)
    limit = threshold(reference.select(score(found.retained).alias("robust_distance_score")), quantile)
    found = Fit(found.retained, found.excluded, found.reference_rows, limit)
    held = features.where((F.col("partition") == partition) & F.col("eligible_for_scoring")).withColumn("robust_distance_score", score(found.retained))
    cols = [*dict.fromkeys([key, "timestamp"]), "segment_id", "partition", "target_state", "source_event", "eligible_for_known_event_evaluation", "eligible_for_alarm_burden", "robust_distance_score"]
    return found, with_alarm(held.select(*cols), "robust_distance_score", limit)
