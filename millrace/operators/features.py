"""Causal rolling features that cross neither a gap nor a partition border."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.operators.segments import _bucketed, numbered
from millrace.plans.tables import cut

WINDOWS = (6, 30)
#: Rows of one history group that a task takes at once.
RUN = 100_000


def history_groups(df: DataFrame, ts: str = "timestamp", tie: str | None = None) -> DataFrame:
    """Adds ``history_group_id``: a new group at the first row and where segment or partition change (nulls alike)."""
    changes = lambda before, now: ~(before["segment_id"].eqNullSafe(now["segment_id"]) & before["partition"].eqNullSafe(now["partition"]))
    return numbered(df, F.struct("segment_id", "partition"), changes, "history_group_id", ts, tie).drop("__before")


def positions(df: DataFrame, ts: str = "timestamp", tie: str | None = None) -> DataFrame:
    """Adds ``history_rows_available``: the place of a row in its history group, from 1.

    Rows are numbered by group and day; what a group has before a day comes from one row per
    group and day, so a group without a gap, however long, is no single task.
    """
    d = _bucketed(df, ts, "day")
    order = [F.col(ts)] + ([F.col(tie)] if tie else [])
    sizes = d.groupBy("history_group_id", "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(W.partitionBy("history_group_id").orderBy("__b").rowsBetween(W.unboundedPreceding, -1))
    sizes = sizes.select("history_group_id", "__b", F.coalesce(before, F.lit(0)).alias("__base"))
    d = d.withColumn("__in", F.row_number().over(W.partitionBy("history_group_id", "__b").orderBy(*order)))
    # merged, as a long Parquet table packs so well that its rows would be taken for few and broadcast
    return d.join(sizes.hint("merge"), ["history_group_id", "__b"]).withColumn("history_rows_available", F.col("__base") + F.col("__in")).drop("__b", "__in", "__base")


def causal_features(df: DataFrame, continuous: list[str], ts: str = "timestamp", tie: str | None = None, windows: tuple[int, ...] = WINDOWS, run: int = RUN) -> DataFrame:
    """Lag, difference, and mean and population deviation over the last rows, the current one included.

    Partial windows count; ``has_full_n_row_history`` says whether a window was full. All
    windows share one partitioning and order. A history group is cut into runs of ``run``
    rows; the rows before a run that its windows reach back to are dealt to it as well and
    leave again after the windows.
    """
    reach = max(*windows, 2) - 1
    if run <= reach:
        raise ValueError("a run must be longer than the windows")
    placed = positions(df, ts, tie)
    at = F.col("history_rows_available") - 1
    own = F.floor(at / F.lit(run))
    dealt = F.when(at % run >= run - reach, F.array(own, own + 1)).otherwise(F.array(own))
    d = placed.withColumn("__run", F.explode(dealt))
    w = W.partitionBy("history_group_id", "__run").orderBy("history_rows_available")
    made = []
    for c in continuous:
        col = F.col(f"`{c}`")
        made += [F.lag(col, 1).over(w).alias(f"{c}__lag_1"), (col - F.lag(col, 1).over(w)).alias(f"{c}__delta_1")]
        for n in windows:
            frame = w.rowsBetween(-(n - 1), W.currentRow)
            made += [F.avg(col).over(frame).alias(f"{c}__mean_{n}"), F.stddev_pop(col).over(frame).alias(f"{c}__stddev_pop_{n}")]
    d = d.select("*", *made).where(F.col("__run") == own).drop("__run")
    have = F.col("history_rows_available")
    flags = {"has_lag_1_history": have >= 2} | {f"has_full_{n}_row_history": have >= n for n in windows}
    return d.withColumns(flags)


def engineer(sensor: DataFrame, targets: DataFrame, continuous: list[str], ts: str = "timestamp") -> DataFrame:
    """Targets joined to signals one to one on the timestamp, then history groups and features.

    Each step reads its input several times, so steps are cut. The join is a merge at any size: the
    targets pack so well as Parquet that Spark would take them for few, and broadcast them all.
    """
    joined = cut(targets.join(sensor.hint("merge"), ts))
    return causal_features(cut(history_groups(joined, ts)), continuous, ts)


def unmatched(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(left_only, right_only): keys without a partner on the other side."""
    x, y = a.select(F.col(key), F.lit(True).alias("__x")), b.select(F.col(key), F.lit(True).alias("__y"))
    return x.join(y, key, "full_outer").agg(F.count_if(F.col("__y").isNull()).alias("left_only"), F.count_if(F.col("__x").isNull()).alias("right_only"))


def disagreements(a: DataFrame, b: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows that both sides have and in which a column differs, nulls compared as values."""
    x, y = a.select(key, *columns), b.select(F.col(key), *[F.col(c).alias(f"{c}__other") for c in columns])
    differs = F.lit(False)
    for c in columns:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"{c}__other"))
    return x.join(y, key).where(differs)
