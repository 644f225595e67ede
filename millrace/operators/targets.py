"""Row states from documented event intervals; nothing is called healthy that nobody verified."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.time import hours, strict_timestamp, ts
from millrace.operators.segments import segment

# The states.
BUFFER, FAILURE, PRE_EVENT, WARNING, UNVERIFIED = "excluded_partition_buffer", "documented_failure", "excluded_pre_event", "warning", "unverified"
PARTITIONS = ("train", "validation", "test")


@dataclass(frozen=True)
class Interval:
    """Closed on both sides."""

    name: str
    start: datetime
    end: datetime

    def __post_init__(self):
        if self.end < self.start:
            raise ValueError(f"{self.name} ends before it starts")

    def overlaps(self, other: Interval) -> bool:
        return self.start <= other.end and other.start <= self.end


@dataclass(frozen=True)
class TargetSpec:
    partitions: tuple[Interval, ...]
    events: tuple[Interval, ...]
    gap_seconds: float
    pre_event_hours: float
    warning_hours: float | None = None
    states: dict[str, str] = field(default_factory=dict)

    @classmethod
    def of(cls, partitions: dict, events: dict, **kw) -> TargetSpec:
        """From {name: (start, end)} of strict ISO texts."""
        made = [tuple(Interval(n, strict_timestamp(a), strict_timestamp(b)) for n, (a, b) in x.items()) for x in (partitions, events)]
        return cls(*made, **kw)

    def validate(self) -> None:
        """Chronology without overlap, partitions in order and apart, a horizon beyond the exclusion."""
        if tuple(p.name for p in self.partitions) != PARTITIONS:
            raise ValueError("partitions must be train, validation and test")
        for a, b in zip(self.partitions, self.partitions[1:], strict=False):
            if a.end >= b.start:
                raise ValueError(f"{a.name} and {b.name} overlap or touch")
        ordered = sorted(self.events, key=lambda e: e.start)
        for a, b in zip(ordered, ordered[1:], strict=False):
            if a.overlaps(b):
                raise ValueError(f"events {a.name} and {b.name} overlap")
        if len({e.name for e in self.events}) != len(self.events):
            raise ValueError("event names repeat")
        if self.gap_seconds <= 0 or self.pre_event_hours < 0:
            raise ValueError("the gap threshold must be positive, the exclusion not negative")
        if self.warning_hours is not None and self.warning_hours <= self.pre_event_hours:
            raise ValueError("the warning horizon must reach beyond the exclusion")

    def separated(self) -> list[timedelta]:
        return [b.start - a.end for a, b in zip(self.partitions, self.partitions[1:], strict=False)]


def first_of(cases: list[tuple[Column, str]]) -> Column:
    """The label of the first case that holds, else null: constant intervals stay inside code generation, no join."""
    out = F.lit(None).cast("string")
    for condition, label in reversed(cases):
        out = F.when(condition, F.lit(label)).otherwise(out)
    return out


def partition_label(c: Column, spec: TargetSpec) -> Column:
    return first_of([(c.between(ts(p.start), ts(p.end)), p.name) for p in spec.partitions])


def failure_label(c: Column, spec: TargetSpec) -> Column:
    return first_of([(c.between(ts(e.start), ts(e.end)), e.name) for e in spec.events])


def pre_event_label(c: Column, spec: TargetSpec) -> Column:
    h = hours(spec.pre_event_hours)
    return first_of([((c >= ts(e.start) - h) & (c < ts(e.start)), e.name) for e in spec.events])


def warning_label(c: Column, spec: TargetSpec) -> Column:
    if spec.warning_hours is None:
        return F.lit(None).cast("string")
    w, h = hours(spec.warning_hours), hours(spec.pre_event_hours)
    return first_of([((c >= ts(e.start) - w) & (c < ts(e.start) - h), e.name) for e in spec.events])


def classify(df: DataFrame, spec: TargetSpec, time: str = "timestamp", tie: str | None = None) -> DataFrame:
    """Segment, partition and the three kinds of event membership of each row."""
    c = F.col(time)
    return segment(df, spec.gap_seconds, time, tie).select(
        *[x for x in df.columns if x != time], c.alias("timestamp"), "segment_id",
        partition_label(c, spec).alias("partition"), failure_label(c, spec).alias("failure_event"), pre_event_label(c, spec).alias("exclusion_event"), warning_label(c, spec).alias("warning_event"),
    )


def anchored(classified: DataFrame) -> DataFrame:
    """Adds the earliest segment with a failure row of the event a row belongs to.

    The event of a row is its failure, else its exclusion, else its warning. Events are
    few and rows outside any event many, so the minimum is a small grouped table joined
    back, not a window that would bring all rows without an event together.
    """
    event = F.coalesce("failure_event", "exclusion_event", "warning_event")
    d = classified.withColumn("__e", event)
    first = d.where("__e is not null and failure_event is not null").groupBy("__e").agg(F.min("segment_id").alias("event_segment_id"))
    return d.join(F.broadcast(first), "__e", "left").drop("__e")  # a row per configured event


def states(df: DataFrame, spec: TargetSpec, time: str = "timestamp", tie: str | None = None) -> DataFrame:
    """The seven governed columns, and whatever else the input holds.

    A failure row inside a partition buffer keeps its source event although its state is
    the buffer and its target null.
    """
    d = anchored(classify(df, spec, time, tie))
    same = F.col("segment_id") == F.col("event_segment_id")
    fail, pre, warn, part = (F.col(x).isNotNull() for x in ("failure_event", "exclusion_event", "warning_event", "partition"))
    state = F.when(~part, BUFFER).when(fail, FAILURE).when(pre & same, PRE_EVENT).when(warn & same, WARNING).otherwise(UNVERIFIED)
    event = F.when(fail, F.col("failure_event")).when(pre & same, F.col("exclusion_event")).when(warn & same, F.col("warning_event"))
    reason = F.when(~part, "chronological_partition_buffer").when(pre & same, "pre_event_exclusion_buffer")
    extra = [x for x in df.columns if x != time]
    return d.select(
        *extra, "timestamp", "segment_id", "partition", state.alias("target_state"), F.when(part & fail, F.lit(1)).alias("binary_target"), event.alias("source_event"), reason.alias("exclusion_reason")
    )


def state_counts(governed: DataFrame) -> DataFrame:
    return governed.groupBy(F.coalesce("partition", F.lit("excluded")).alias("partition"), "target_state").agg(F.count(F.lit(1)).alias("row_count"))


def validate_input(df: DataFrame, time: str = "timestamp") -> None:
    """Timestamps are there, and unique."""
    r = df.agg(F.count(F.lit(1)).alias("n"), F.count(time).alias("there"), F.count_distinct(time).alias("distinct")).first()
    if r["n"] == 0:
        raise ValueError("no rows")
    if r["there"] != r["n"]:
        raise ValueError("null timestamps")
    if r["distinct"] != r["n"]:
        raise ValueError("repeated timestamps")


__all__ = ["Interval", "TargetSpec", "states", "classify", "anchored", "state_counts", "validate_input"]
