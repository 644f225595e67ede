"""Mixing sources to target weights by pivotal dependent rounding."""

from __future__ import annotations

import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.common import free_name, written

WORD = r"[^\x20\x09-\x0D]+"
#: Sources up to this many are broadcast with their targets; more are joined by shuffle.
BROADCAST_SOURCES = 20_000
#: Decisions up to this many are broadcast to the documents; more are joined by shuffle.
BROADCAST_DECISIONS = 2_000_000
#: Documents of one source that one task rounds before only a residual goes on.
FAN_IN = 4096


def sized(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source, size): size counts words, a null text has none."""
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source).alias("source"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, n, target) for the distinct sources.

    The total is shared by weight; a source whose share passes ``cap`` times its size
    stops there and the excess is reshared until none is above. That fixed point is a
    water level: target = min(cap * size, weight * level), found by one sort of the
    sources by cap/weight. Windows here run over one row per source.
    """
    src = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    s = src.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(cap))
    order = [(F.col("most") / F.col("weight")).asc(), F.col("source").asc_nulls_last()]
    before = W.orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    after = W.orderBy(*order).rowsBetween(W.currentRow, W.unboundedFollowing)
    whole = W.partitionBy()
    s = s.withColumn("goal", F.sum("source_size").over(whole) * F.lit(share))
    s = s.withColumn("level", (F.col("goal") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    # sharing with one more source capped raises the level until no cap is passed, then lowers it
    s = s.withColumn("level", F.max("level").over(whole))
    target = F.least(F.col("most"), F.coalesce(F.col("level") * F.col("weight"), F.col("most")))
    return s.select("source", "source_size", "n", target.cast("double").alias("target"))


def _round(batches: Iterator[pd.DataFrame], seed: int, level: int) -> Iterator[pd.DataFrame]:
    """Streams (group, doc_id, size, p): one held residual per group, whatever its size."""
    group, held, rng = None, None, random.Random()
    for batch in batches:
        ids, sizes, ps, copies, done, src, blocks = [], [], [], [], [], [], []

        def out(row, p, c, d):
            src.append(row[0]), blocks.append(row[1]), ids.append(row[2]), sizes.append(row[3])  # noqa: B023
            ps.append(p), copies.append(c), done.append(d)  # noqa: B023

        for row in zip(batch["sg"], batch["block"], batch["doc_id"], batch["size"], batch["p"], strict=True):
            if (row[0], row[1]) != group:
                if held is not None:
                    out(held[0], held[1], 0, False)
                group, held = (row[0], row[1]), None
                rng.seed(f"{seed}/{level}/{row[0]}/{row[1]}")
            p, a = row[4], row[3]
            if a == 0 or p <= 0.0:
                out(row, 0.0, 0, True)
                continue
            if held is None:
                held = (row, p)
                continue
            (hrow, q), b = held, held[0][3]
            up, down = min((1 - q) * b, p * a), min(q * b, (1 - p) * a)
            if rng.random() * (up + down) < down:
                # words move to the held document: it fills up, or the new one is emptied
                if (1 - q) * b <= p * a:
                    out(hrow, 1.0, 1, True)
                    p -= (1 - q) * b / a
                    held = (row, p)
                else:
                    out(row, 0.0, 0, True)
                    held = (hrow, q + p * a / b)
            elif q * b <= (1 - p) * a:
                out(hrow, 0.0, 0, True)
                held = (row, p + q * b / a)
            else:
                out(row, 1.0, 1, True)
                held = (hrow, q - (1 - p) * a / b)
            row, p = held
            if p <= 1e-9 or p >= 1 - 1e-9:
                out(row, p, int(p > 0.5), True)
                held = None
        yield pd.DataFrame({"sg": pd.Series(src, dtype=object), "block": blocks, "doc_id": pd.array(ids, dtype="Int64"), "size": sizes, "p": ps, "extra": copies, "done": done})
    if held is not None:
        (sg, block, doc_id, size, _), p = held
        yield pd.DataFrame({"sg": pd.Series([sg], dtype=object), "block": [block], "doc_id": pd.array([doc_id], dtype="Int64"), "size": [size], "p": [p], "extra": [0], "done": [False]})


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 17, fan_in: int = FAN_IN) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) for every row of ``docs``.

    Every document of a source starts with target/size expected copies: a whole part
    that it gets for certain and a fraction. Fractions are rounded by the pivotal
    method in words: two documents trade the same number of words up and down, with
    odds that keep both expectations, until one holds 0 or 1. So a source's words stay
    put but for one residual, which is handed up a tree of fan-in ``fan_in`` and rounded
    by its own odds at the root: the source misses its target by less than one document.

    Nulls: a null text has size 0 and takes nothing; a null source is a source, last in
    order; a null doc_id is kept. Repeated rows are documents of their own. An empty
    table gives no rows. Random numbers come from (seed, level, source, block), blocks
    from doc_id, so reruns agree whatever the partitioning. Extra columns are not read.
    """
    base = written(sized(docs))
    src = written(source_targets(base, weights, share, cap))
    top = src.agg(F.count(F.lit(1)).alias("k"), F.max("n").alias("n")).first()
    if not top["k"]:
        return base.select("doc_id", "source", "size", F.lit(0).cast("long").alias("source_size"), F.lit(0.0).alias("target"), F.lit(0).cast("long").alias("copies"))
    sg = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source").cast("string")))
    few = (lambda d: F.broadcast(d)) if top["k"] <= BROADCAST_SOURCES else (lambda d: d)
    s = src.select(sg.alias("sg"), "source_size", "n", "target").withColumn("f", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    s = s.withColumn("whole", F.floor("f")).withColumn("blocks", F.ceil(F.col("n") / F.lit(fan_in)).cast("long"))
    shape = "sg string, block long, doc_id long, size long, p double, extra int, done boolean"
    level = (
        base.select(sg.alias("sg"), F.col("doc_id").cast("long").alias("doc_id"), "size")
        .join(few(s.select("sg", "blocks", (F.col("f") - F.col("whole")).alias("p"))), "sg")
        .select("sg", F.pmod(F.xxhash64("doc_id", "size"), F.col("blocks")).alias("block"), "doc_id", "size", "p")
    )
    most, depth, decided = (top["n"] + fan_in - 1) // fan_in, 0, []
    while True:
        d = depth
        out = written(level.repartition("sg", "block").sortWithinPartitions("sg", "block", "doc_id", "size").mapInPandas(lambda it, d=d: _round(it, seed, d), shape))
        decided.append(out.where("done").select("sg", "doc_id", "size", "extra"))
        rest = out.where("not done")
        if most <= 1:
            luck = F.pmod(F.xxhash64(F.lit(seed), "sg", "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
            decided.append(rest.select("sg", "doc_id", "size", (luck < F.col("p")).cast("int").alias("extra")))
            break
        level = rest.select("sg", F.floor(F.col("block") / F.lit(fan_in)).cast("long").alias("block"), "doc_id", "size", "p")
        most, depth = (most + fan_in - 1) // fan_in, depth + 1
    all_of = decided[0]
    for x in decided[1:]:
        all_of = all_of.union(x)
    return all_of.join(few(s.select("sg", "whole", "source_size", "target")), "sg").select(
        "doc_id",
        F.when(F.col("sg") != "n", F.expr("substring(sg, 2)")).alias("source"),
        "size",
        "source_size",
        "target",
        F.when(F.col("size") > 0, F.col("whole") + F.col("extra")).otherwise(F.lit(0)).cast("long").alias("copies"),
    )


def mixed_rows(docs: DataFrame, **kw) -> DataFrame:
    """The rows of ``docs``, each as often as ``mix`` takes it; columns unchanged.

    Rows meet their decisions by doc_id. Where ids repeat, rows of one id, size and source
    are alike to the mix: they share out their copies in the order of their texts.
    """
    dec = written(mix(docs, **kw))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    key, times, size, place = (free_name(n, docs) for n in ("key", "times", "words", "place"))
    every = lambda d: d.withColumn(free_name("copy", d), F.explode(F.sequence(F.lit(1), F.col(times)))).select(*columns)
    if dec.groupBy("doc_id").count().where("count > 1").isEmpty():
        take = dec.where("copies > 0").select(F.col("doc_id").alias(key), F.col("copies").cast("int").alias(times))
        take = F.broadcast(take) if take.count() <= BROADCAST_DECISIONS else take
        return every(docs.join(take, F.col("doc_id").eqNullSafe(F.col(key))))
    share = dec.groupBy(F.col("doc_id").alias(key), F.col("size").alias("s"), F.col("source").alias("o")).agg(F.sum("copies").alias("c"), F.count(F.lit(1)).alias("r")).where("c > 0")
    one = docs.withColumn(size, F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long"))
    one = one.withColumn(place, F.row_number().over(W.partitionBy("doc_id", size, "source").orderBy(F.xxhash64("text"), "text")))
    took = one.join(share.select(key, F.struct("s", "o", "c", "r").alias(times)), F.col("doc_id").eqNullSafe(F.col(key)) & (F.col(size) == F.col(times)["s"]) & F.col("source").cast("string").eqNullSafe(F.col(times)["o"]))
    n = F.floor(F.col(times)["c"] / F.col(times)["r"]) + (F.col(place) <= F.col(times)["c"] % F.col(times)["r"]).cast("long")
    return every(took.withColumn(times, n.cast("int")).where(F.col(times) > 0))


def op2_mixing(docs: DataFrame) -> DataFrame:
    """The query's columns: taken counts the words of all copies."""
    return mix(docs).select("doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")
