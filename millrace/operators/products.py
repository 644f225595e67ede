"""Largest inner products, exactly: blocks of near vectors, safe bounds, and only the blocks that the bounds can't rule out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.operators.postings import PLACES, best
from millrace.plans.tables import cut

#: Vectors of a block at most; vectors that the cells are fitted on at most, and cells at most.
BLOCK, FIT_ROWS, MOST_CELLS = 512, 20_000, 1_024
#: Vectors of one cell that meet in one task, about.
TASK_ROWS = 64 * BLOCK
#: Queries that are broadcast at a time.
QUERY_PART = 10_000
#: Vectors that a query's first blocks hold for each wanted one, about.
SEED = 4
_SLACK = 2.0 * 10**-PLACES


def _matrix(col: pd.Series) -> np.ndarray:
    return np.stack(col.to_numpy()).astype(np.float64)


def cells(docs: DataFrame, n: int, seed: int = 42, rounds: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """(centres, share of the sample in each) of about 4 sqrt(n / BLOCK) cells by k-means on a bounded sample, chosen by hash of the id."""
    sample = docs.where(F.pmod(F.xxhash64("id"), F.lit(max(1, -(-n // FIT_ROWS)))) == 0).select("id", "v").limit(2 * FIT_ROWS).toPandas().sort_values("id")
    x = _matrix(sample["v"]) if len(sample) else np.zeros((0, 1))
    k = int(min(MOST_CELLS, max(1, 4 * (n / BLOCK) ** 0.5), len(x)))
    c = x[np.random.default_rng(seed).choice(len(x), k, replace=False)].copy() if k else x
    size = np.zeros(k)
    for _ in range(rounds if k else 0):
        near = np.argmax(x @ c.T - 0.5 * (c * c).sum(axis=1), axis=1)
        size = np.bincount(near, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c[size > 0] = total[size > 0] / size[size > 0, None]
    return c, size / max(1, len(x))


def vector_blocks(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, heads): (block, id, v), and of each block (block, n, centre, radius, norm).

    Vectors of one cell are sorted by norm and cut into blocks where they meet; a cell that
    holds many is dealt by a hash of the id over as many tasks as its share asks for. A block's centre is the mean of its own vectors, ``radius``
    the distance of the farthest and ``norm`` the largest norm, so for every query q and
    vector x of it q x <= min(q centre + |q| radius, |q| norm).
    """
    spark = docs.sparkSession
    n = docs.count()
    centres, share = cells(docs, n)
    shared = spark.sparkContext.broadcast((centres, np.maximum(1, share * n / TASK_ROWS).astype(np.uint64)))
    kind = dict(docs.dtypes)["id"]

    def near(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c, salts = shared.value
        for b in it:
            if len(b):
                x = _matrix(b["v"])
                cell = np.argmax(x @ c.T - 0.5 * (c * c).sum(axis=1), axis=1)
                salt = pd.util.hash_array(b["id"].to_numpy()) % salts[cell]
                yield pd.DataFrame({"cell": cell, "salt": salt.astype(np.int64), "norm": np.sqrt((x * x).sum(axis=1)), "id": b["id"], "v": b["v"]})

    def numbered(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, cell, held = (TaskContext.get().partitionId() << 32) - 1, None, 0
        for b in it:
            out = np.empty(len(b), dtype=np.int64)
            for i, c in enumerate(zip(b["cell"].tolist(), b["salt"].tolist(), strict=True)):
                if c != cell or held == BLOCK:
                    block, cell, held = block + 1, c, 0
                held += 1
                out[i] = block
            yield pd.DataFrame({"block": out, "id": b["id"], "v": b["v"]})

    placed = docs.select("id", F.col("v").cast("array<double>").alias("v")).mapInPandas(near, f"cell int, salt long, norm double, id {kind}, v array<double>")
    dealt = placed.repartition("cell", "salt").sortWithinPartitions("cell", "salt", F.desc("norm"), "id")
    rows = cut(dealt.mapInPandas(numbered, f"block long, id {kind}, v array<double>"))

    def head(b: pd.DataFrame) -> pd.DataFrame:
        x = _matrix(b["v"])
        centre = x.mean(axis=0)
        return pd.DataFrame({"block": [b["block"].iloc[0]], "n": [len(x)], "centre": [centre.tolist()], "radius": [float(np.sqrt(((x - centre) ** 2).sum(axis=1)).max())], "norm": [float(np.sqrt((x * x).sum(axis=1)).max())]})

    return rows, cut(rows.groupBy("block").applyInPandas(head, "block long, n long, centre array<double>, radius double, norm double"))


def _reach(b: pd.DataFrame, m: np.ndarray) -> np.ndarray:
    """Blocks x queries: what no vector of the block exceeds."""
    size = np.sqrt((m * m).sum(axis=1))
    reach = np.minimum(_matrix(b["centre"]) @ m.T + np.outer(b["radius"], size), np.outer(b["norm"], size))
    return reach + 1e-12 * (1 + np.abs(reach))


def _scored(rows: DataFrame, pairs: DataFrame, shared, k: int, kinds: tuple[str, str], most: float) -> DataFrame:
    """(query, id, vector_score): of each pair of a block and a query the k best, in one product per block."""

    def score(pair: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(pair) or not len(b):
            return pd.DataFrame({"query": [], "id": [], "vector_score": []})
        q = pair["query"].to_numpy()
        b = b.sort_values("id", kind="stable")
        s = np.clip(_matrix(b["v"]) @ shared.value[q].T, 0.0, most)
        top = np.argsort(-s.round(PLACES), axis=0, kind="stable")[:k]
        found = np.take_along_axis(s, top, 0)
        i, j = np.nonzero(found > 0)
        return pd.DataFrame({"query": q[j], "id": b["id"].to_numpy()[top[i, j]], "vector_score": found[i, j]})

    met = rows.join(pairs.select("block").distinct(), "block", "left_semi")
    return pairs.groupBy("block").cogroup(met.groupBy("block")).applyInPandas(score, f"query int, id {kinds[0]}, vector_score double")


def read_pairs(rows: DataFrame, heads: DataFrame, shared, k: int, kinds: tuple[str, str], most: float) -> tuple[DataFrame, DataFrame]:
    """(found in the first blocks, pairs of blocks and queries still to read).

    Each query first reads its blocks of largest reach, until they hold ``SEED`` x k vectors; the k-th
    score there is a floor under the k-th of all, and a block whose reach is under it is never read.
    """
    n_queries = len(shared.value)

    def first(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            if len(b):
                reach, n = _reach(b, shared.value), b["n"].to_numpy()
                order = np.argsort(-reach, axis=0, kind="stable")
                before = np.cumsum(n[order], axis=0) - n[order]
                i, j = np.nonzero(before < SEED * k)
                at = order[i, j]
                yield pd.DataFrame({"block": b["block"].to_numpy()[at], "query": j, "n": n[at], "reach": reach[at, j]})

    seeds = heads.mapInPandas(first, "block long, query int, n long, reach double")
    order = W.partitionBy("query").orderBy(F.desc("reach"), "block").rowsBetween(W.unboundedPreceding, -1)
    seeds = cut(seeds.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0))).where(F.col("before") < SEED * k).select("block", "query"))
    found = cut(best(_scored(rows, seeds, shared, k, kinds, most).withColumnRenamed("query", "query_id"), k, "vector_score"))
    floor = np.zeros(n_queries)
    for r in found.groupBy("query_id").agg(F.count(F.lit(1)).alias("c"), F.min("vector_score").alias("s")).collect():  # one number a query of the part
        floor[r["query_id"]] = r["s"] - _SLACK if r["c"] >= k else 0.0
    floors = rows.sparkSession.sparkContext.broadcast(floor)

    def rest(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            if len(b):
                i, j = np.nonzero(np.minimum(_reach(b, shared.value), most) >= np.maximum(floors.value, 1e-300))
                yield pd.DataFrame({"block": b["block"].to_numpy()[i], "query": j})

    pairs = heads.mapInPandas(rest, "block long, query int")
    return found, cut(pairs.join(seeds, ["block", "query"], "left_anti"))


def largest_products(blocks: tuple[DataFrame, DataFrame], queries: DataFrame, k: int, most: float = float("inf")) -> DataFrame:
    """(query_id, id, vector_score): each query's k largest inner products over 0, exactly; values over ``most`` count as ``most``.

    Equal scores (to ``PLACES`` places) go by the smaller id. A part of the queries (by hash,
    about ``QUERY_PART`` each) is broadcast and meets the heads of the blocks; vectors are read
    only for the pairs of a block and a query that the bounds leave. No vectors or no
    queries: no rows. Where neighbours are no nearer than all others, bounds rule out
    little and nearly all pairs are read: the result is exact at any cost.
    """
    rows, heads = blocks
    spark, kinds = rows.sparkSession, (dict(rows.dtypes)["id"], dict(queries.dtypes)["id"])
    parts = max(1, -(-queries.count() // QUERY_PART))
    out = spark.createDataFrame([], f"query_id {kinds[1]}, id {kinds[0]}, vector_score double")
    for i in range(parts):
        q = queries.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == i).select("id", "v").toPandas()
        if not len(q):
            continue
        shared = spark.sparkContext.broadcast(_matrix(q["v"]))
        found, pairs = read_pairs(rows, heads, shared, k, kinds, most)
        more = _scored(rows, pairs, shared, k, kinds, most).withColumnRenamed("query", "query_id")
        names = spark.createDataFrame(pd.DataFrame({"query_id": range(len(q)), "__q": q["id"]}), f"query_id int, __q {kinds[1]}")
        part = best(found.select("query_id", "id", "vector_score").union(more), k, "vector_score")
        out = out.union(part.join(F.broadcast(names), "query_id").select(F.col("__q").alias("query_id"), "id", "vector_score"))
    return out
