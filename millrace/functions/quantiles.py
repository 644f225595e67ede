"""Exact interpolated quantiles without a task that holds every value."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Inverse of the sketch's rank error; of n values about ``8 n / ACCURACY`` a quantile are looked at one by one.
ACCURACY = 100_000


def _brackets(found: list[float], ends: list[float]) -> list[tuple[float, float]]:
    """Ranges of values around the quantiles, in order, those that touch as one; open at both ends of the values."""
    found = [-math.inf if e == 0.0 else math.nan if e == 1.0 else v for v, e in zip(found, ends, strict=True)]
    order = lambda x: (1, 0.0) if math.isnan(x) else (0, x)  # noqa: E731  NaN is the largest
    pairs = sorted(((found[2 * i], found[2 * i + 1]) for i in range(len(ends) // 2)), key=lambda p: order(p[0]))
    merged = [pairs[0]]
    for lo, hi in pairs[1:]:
        if order(lo) <= order(merged[-1][1]):
            merged[-1] = (merged[-1][0], max(hi, merged[-1][1], key=order))
        else:
            merged.append((lo, hi))
    return merged


def _cell(v: Column, brackets: list[tuple[float, float]]) -> Column:
    """A value inside a bracket as itself, any other as the gap that it lies in."""
    cell = F.struct(F.lit(-math.inf).alias("value"), F.lit(1).alias("gap"))
    for lo, hi in brackets:
        cell = F.when(v > F.lit(hi), F.struct(F.lit(hi).alias("value"), F.lit(1).alias("gap"))).when(v >= F.lit(lo), F.struct(v.alias("value"), F.lit(0).alias("gap"))).otherwise(cell)
    return cell


def quantiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], accuracy: int = ACCURACY) -> dict[str, list[float | None]]:
    """The quantiles of each column, as ``percentile`` gives them; None for a column without values.

    A first pass brackets each quantile by a mergeable sketch of bounded size. A second
    counts the values of the brackets one by one and all others by the gap they lie in, with
    partial sums before the shuffle; what is sorted are the distinct values in the brackets.
    Only the few cells that hold a wanted rank reach the driver. Nulls are passed over, NaN
    is the largest value. Where a sketch missed a rank by more than it promises, the passes
    run again with wider brackets, in the end of all values.
    """
    width = 4.0 / accuracy
    ends = [min(1.0, max(0.0, x)) for p in probabilities for x in (p - width, p + width)]
    value = {i: F.col(f"`{c}`").cast("double") for i, c in enumerate(columns)}
    sketch = [F.percentile_approx(v, F.array(*map(F.lit, ends)), accuracy).alias(f"q{i}") for i, v in value.items()]
    first = df.agg(*sketch, *[F.count(v).alias(f"n{i}") for i, v in value.items()]).first()
    rows = {i: first[f"n{i}"] for i in value if first[f"n{i}"]}
    if not rows:
        return {c: [None] * len(probabilities) for c in columns}
    at = {i: [(n - 1) * p for p in probabilities] for i, n in rows.items()}
    wanted = {i: sorted({int(f(r)) for r in ranks for f in (math.floor, math.ceil)}) for i, ranks in at.items()}
    cells = F.array(*[F.when(value[i].isNotNull(), F.struct(F.lit(i).alias("c"), _cell(value[i], _brackets(first[f"q{i}"], ends)).alias("cell"))) for i in rows])
    counts = df.select(F.explode(cells).alias("x")).where("x is not null").groupBy("x.c", "x.cell").agg(F.count(F.lit(1)).alias("n"))
    upto = counts.withColumn("upto", F.sum("n").over(W.partitionBy("c").orderBy("cell").rowsBetween(W.unboundedPreceding, W.currentRow)))
    ranks = F.lit(None).cast("array<long>")
    for i, w in wanted.items():
        ranks = F.when(F.col("c") == i, F.array(*[F.lit(k).cast("long") for k in w])).otherwise(ranks)
    held = upto.withColumn("k", F.explode(ranks)).where("upto - n <= k and k < upto").collect()  # two rows a quantile and column
    found = {(r["c"], r["k"]): r["cell"] for r in held}
    if any(x["gap"] for x in found.values()):
        return quantiles(df, columns, probabilities, max(1, accuracy // 16))
    out: dict[str, list[float | None]] = {c: [None] * len(probabilities) for c in columns}
    for i, rs in at.items():
        out[columns[i]] = [_between(found[i, math.floor(r)]["value"], found[i, math.ceil(r)]["value"], r) for r in rs]
    return out


def _between(lower: float, higher: float, rank: float) -> float:
    a, b = math.floor(rank), math.ceil(rank)
    return lower if a == b or lower == higher else (b - rank) * lower + (rank - a) * higher
