"""Data-quality profile of raw text rows in file order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions.time import elapsed_seconds

#: A decimal number as the profile accepts it; suffixes that only one parser takes are not numbers.
NUMBER = r"^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+)?$|^[+-]?([iI][nN][fF]([iI][nN][iI][tT][yY])?|[nN][aA][nN])$"
BINARY = (0.0, 1.0)


def number(text: Column) -> Column:
    t = F.trim(text)
    return F.when(t.rlike(NUMBER), F.regexp_replace(t, "_", "").try_cast("double"))


def missing(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, missing): empty or null cells."""
    return _by_column(df, columns, lambda v: F.count_if(F.coalesce(F.trim(v), F.lit("")) == ""), "missing")


def coercion_failures(df: DataFrame, columns: list[str]) -> DataFrame:
    return _by_column(df, columns, lambda v: F.count_if((F.trim(v) != "") & number(v).isNull()), "failures")


def non_finite(df: DataFrame, columns: list[str]) -> DataFrame:
    return _by_column(df, columns, lambda v: F.count_if(F.isnan(number(v)) | (F.abs(number(v)) == F.lit(float("inf")))), "non_finite")


def invalid_binary(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, raw_value, rows) of filled cells that are neither 0 nor 1."""
    d = _cells(df, columns).where((F.trim("value") != "") & ~F.coalesce(number(F.col("value")).isin(*BINARY), F.lit(False)))
    return d.groupBy("column", F.trim("value").alias("raw_value")).agg(F.count(F.lit(1)).alias("rows"))


def _cells(df: DataFrame, columns: list[str]) -> DataFrame:
    cells = F.explode(F.array(*[F.struct(F.lit(c or "__unnamed_column_0__").alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])).alias("c")
    return df.select(cells).select("c.*")


def _by_column(df: DataFrame, columns: list[str], agg, name: str) -> DataFrame:
    return _cells(df, columns).groupBy("column").agg(agg(F.col("value")).alias(name))


def duplicates(df: DataFrame, columns: list[str]) -> DataFrame:
    """(rows, distinct_rows, duplicate_rows): exact repeats, nulls alike. Rows are told apart by a hash of length-marked cells."""
    marked = F.concat_ws("|", *[F.concat(F.length(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))), F.lit(":"), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))) for c in columns])
    d = df.select(F.sha2(marked, 256).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    return d.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("distinct_rows")).withColumn("duplicate_rows", F.col("rows") - F.col("distinct_rows"))


def intervals(df: DataFrame, ts: str, position: str, part: str | None = None) -> DataFrame:
    """(position, previous, current, interval_seconds) between neighbours in file order among rows with a timestamp.

    ``part`` names a column that cuts the order into ranges (files, ranges of positions);
    neighbours across a cut are found from one row per range.
    """
    d = df.where(F.col(ts).isNotNull()).select(F.col(position).alias("position"), F.col(ts).alias("current"), (F.col(part) if part else F.floor(F.col(position) / F.lit(1_000_000))).alias("__r"))
    ends = d.groupBy("__r").agg(F.max_by("current", "position").alias("__last")).select("__r", F.lag("__last").over(W.orderBy("__r")).alias("__before"))
    w = W.partitionBy("__r").orderBy("position")
    d = d.withColumn("__in", F.lag("current").over(w)).join(ends, "__r").withColumn("previous", F.coalesce("__in", "__before"))
    return d.where("previous is not null").select("position", "previous", "current", elapsed_seconds(F.col("previous"), F.col("current")).alias("interval_seconds"))


def interval_classes(iv: DataFrame) -> DataFrame:
    """Out-of-order, repeated and positive intervals; only repeats count as non-positive, as in the profile this follows."""
    s = F.col("interval_seconds")
    return iv.agg(F.count_if(s < 0).alias("out_of_order"), F.count_if(s == 0).alias("duplicate_adjacent"), F.count_if(s == 0).alias("nonpositive"), F.count_if(s > 0).alias("positive"))


def interval_histogram(iv: DataFrame, top: int = 10) -> DataFrame:
    return iv.where("interval_seconds > 0").groupBy("interval_seconds").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "interval_seconds").limit(top)


def cadence(iv: DataFrame, multiplier: float = 1.5) -> DataFrame:
    """(expected_interval_seconds, gap_threshold_seconds, gap_count, largest_gap_seconds): the mode, ties to the smallest."""
    h = iv.where("interval_seconds > 0").groupBy("interval_seconds").agg(F.count(F.lit(1)).alias("c"))
    mode = h.orderBy(F.desc("c"), "interval_seconds").limit(1).select(F.col("interval_seconds").alias("expected_interval_seconds"))
    m = mode.withColumn("gap_threshold_seconds", F.col("expected_interval_seconds") * F.lit(multiplier))
    return h.crossJoin(F.broadcast(m)).groupBy("expected_interval_seconds", "gap_threshold_seconds").agg(  # one row against the histogram
        F.coalesce(F.sum(F.when(F.col("interval_seconds") > F.col("gap_threshold_seconds"), F.col("c"))), F.lit(0)).alias("gap_count"), F.max("interval_seconds").alias("largest_gap_seconds")
    )


def gap_details(iv: DataFrame, threshold: float, n: int) -> DataFrame:
    """The n largest intervals (ties: the later row), of these the ones over the threshold."""
    return iv.where("interval_seconds > 0").orderBy(F.desc("interval_seconds"), F.desc("position")).limit(n).where(F.col("interval_seconds") > F.lit(threshold))


def never_decreases(iv: DataFrame) -> bool:
    """Whether timestamps keep their order through the file."""
    return iv.where("interval_seconds < 0").isEmpty()
