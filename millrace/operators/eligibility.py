"""Which rows may be fitted on, scored and counted, in three-valued logic as written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.targets import BUFFER, FAILURE, PARTITIONS, PRE_EVENT, UNVERIFIED

EXCLUDED = (BUFFER, PRE_EVENT)
FLAGS = ("eligible_for_reference_fit", "eligible_for_scoring", "eligible_for_known_event_evaluation", "eligible_for_alarm_burden")


def eligibility(df: DataFrame, excluded: tuple[str, ...] = EXCLUDED, positive: str = FAILURE, unlabeled: str = UNVERIFIED, history: str = "has_full_30_row_history") -> DataFrame:
    state, part, target = F.col("target_state"), F.col("partition"), F.col("binary_target")
    common = part.isin(*PARTITIONS) & ~state.isin(*excluded) & F.col("exclusion_reason").isNull() & (F.col(history) == F.lit(True))
    held_out = part.isin("validation", "test")
    role = (
        F.when(~common, "excluded").when((part == "train") & (state == unlabeled), "unlabeled_reference").when(state == positive, "documented_positive").when(state == unlabeled, "unlabeled_scoring").otherwise("excluded")
    )
    return df.withColumns(
        {
            "eligible_for_reference_fit": common & (part == "train") & (state == unlabeled) & target.isNull(),
            "eligible_for_scoring": common & state.isin(unlabeled, positive),
            "eligible_for_known_event_evaluation": common & held_out & (state == positive) & (target == 1),
            "eligible_for_alarm_burden": common & held_out & (state == unlabeled) & target.isNull(),
            "evaluation_role": role,
        }
    )


def flag_counts(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(f).alias(f) for f in FLAGS])


def role_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("evaluation_role").agg(F.count(F.lit(1)).alias("row_count"))


def partition_coverage(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    return df.where("partition is not null").groupBy("partition").agg(F.min(ts).alias("first_timestamp"), F.max(ts).alias("last_timestamp"), F.count(F.lit(1)).alias("row_count"))


def check_chronology(df: DataFrame, ts: str = "timestamp") -> None:
    """Each partition lies wholly before the next."""
    got = {r["partition"]: r for r in partition_coverage(df, ts).collect()}  # three rows
    there = [got[p] for p in PARTITIONS if p in got]
    if len(there) != len(PARTITIONS):
        raise ValueError("a partition has no rows")
    for a, b in zip(there, there[1:], strict=False):
        if a["last_timestamp"] >= b["first_timestamp"]:
            raise ValueError(f"{a['partition']} is not wholly before {b['partition']}")
