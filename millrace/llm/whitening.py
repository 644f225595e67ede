"""Whitening of embeddings by a covariance that is multiplied tile by tile."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import release, written
from millrace.llm.vectors import common_length

#: Whole numbers that an entry becomes: floor(STEPS * entry) + SHIFT.
STEPS, SHIFT = 1024, 100_000
#: Dimensions of a column block, and rows of a row block.
TILE, ROWS = 32, 4096
#: Partial sums of a tile that meet in one task before the last sum.
FAN_IN = 64
#: Components returned, and the share of the largest eigenvalue under which one is no direction of the data.
COMPONENTS, LEAST_SHARE = 8, 1e-12


def sound(v: Column) -> Column:
    """Whether a vector is there, and all its entries are finite."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & (F.size(v) > 0), F.lit(False))


def whole_numbers(col: pd.Series) -> np.ndarray:
    """Rows of x = floor(1024 c) + 100000."""
    c = np.stack(col.to_numpy()).astype(np.float64)
    x = np.floor(c * STEPS) + SHIFT
    if (np.abs(x) >= 2.0**62).any():
        raise ArithmeticError("an entry is too large for a long")
    return x.astype(np.int64)


def _exact_sums(x: np.ndarray) -> list[int]:
    if len(x) and int(np.abs(x).max()) * len(x) >= 1 << 62:
        return [int(s) for s in x.astype(object).sum(axis=0)]
    return x.sum(axis=0).tolist()


@dataclass
class Fit:
    """What the fit list gives: bounded by the square of the dimensions."""

    n: int
    sums: list[int]
    values: np.ndarray  # eigenvalues that are returned, falling
    vectors: np.ndarray  # their unit eigenvectors, as columns
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n: whole numbers are taken off first, so that no digit is lost in the difference."""
        near = [s // self.n for s in self.sums]
        rest = np.array([(s - m * self.n) / self.n for s, m in zip(self.sums, near, strict=True)])
        return (x - np.array(near, dtype=np.int64)).astype(np.float64) - rest

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n x - S)^2, exactly."""
        far = max((abs(s) for s in self.sums), default=0)
        if self.n * int(np.abs(x).max(initial=0)) + far < 1 << 62:
            d = x * self.n - np.array(self.sums, dtype=np.int64)
            if float(np.abs(d).max(initial=0)) ** 2 * max(1, d.shape[1]) < 2.0**62:
                return (d * d).sum(axis=1).tolist()
        d = x.astype(object) * self.n - np.array(self.sums, dtype=object)
        out = [int(v) for v in (d * d).sum(axis=1)]
        if out and max(out) >= 1 << 63:
            raise ArithmeticError("a deviation is too large for a long")
        return out


def _means(vectors: DataFrame, v: str) -> tuple[int, list[int]]:
    """Number of vectors and the exact sum of each dimension: one row for each dimension and task, summed on Spark."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total = 0, None
        for b in batches:
            if len(b):
                part = _exact_sums(whole_numbers(b[v]))
                total = part if total is None else [p + q for p, q in zip(total, part, strict=True)]
                n += len(b)
        if n:
            yield pd.DataFrame({"at": range(len(total)), "n": n, "s": [str(t) for t in total]})

    sums = vectors.select(v).mapInPandas(run, "at int, n long, s string")
    rows = sums.groupBy("at").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()  # one row a dimension
    rows.sort(key=lambda r: r["at"])
    return (rows[0]["n"], [int(r["s"]) for r in rows]) if rows else (0, [])


def covariance(vectors: DataFrame, v: str, n: int, sums: list[int], tile: int = TILE, rows: int = ROWS) -> np.ndarray:
    """V = sum of centred products over n, assembled from tiles.

    Tasks cut their rows into row blocks and these into column blocks of ``tile``
    dimensions. A column block travels to every pair of column blocks that it is part of,
    keyed by row block and pair; where two blocks of a row block meet they are centred and
    multiplied, and each task adds up the products of a tile as they come. Partial tiles are summed
    in two steps, ``FAN_IN`` at most to a key at first. A task holds two blocks and the tiles it
    has met; no row needs more than its own blocks, and a hot vector is rows like any other.
    """
    dims, fit = len(sums), Fit(n, sums, np.zeros(0), np.zeros((0, 0)), 0.0)
    n_blocks = -(-dims // tile)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, held = TaskContext.get().partitionId() << 32, []

        def blocks(x: np.ndarray) -> pd.DataFrame:
            y = fit.centred(x)
            return pd.DataFrame({"rb": block, "cb": range(n_blocks), "held": [np.ascontiguousarray(y[:, k * tile : (k + 1) * tile]).tobytes() for k in range(n_blocks)]})

        for b in batches:
            if not len(b):
                continue
            held.append(whole_numbers(b[v]))
            if sum(map(len, held)) >= rows:
                x = np.concatenate(held)
                for at in range(0, len(x) - rows + 1, rows):
                    yield blocks(x[at : at + rows])
                    block += 1
                held = [x[len(x) // rows * rows :]]
        if held and len(x := np.concatenate(held)):
            yield blocks(x)

    def multiplied(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tiles: dict[tuple[int, int], np.ndarray] = {}
        waiting: tuple | None = None
        for b in batches:
            for rb, i, j, cb, raw in b.itertuples(index=False):
                block = np.frombuffer(raw).reshape(-1, min(tile, dims - cb * tile))
                if i == j:
                    left = right = block
                elif waiting is None or waiting[0] != (rb, i, j):
                    waiting = ((rb, i, j), block)  # sorted: the left block comes first
                    continue
                else:
                    left, right = waiting[1], block
                    waiting = None
                p = left.T @ right
                tiles[i, j] = tiles[i, j] + p if (i, j) in tiles else p
        yield from shipped(tiles)
        release()

    def added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tiles: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for i, j, _, raw in b.itertuples(index=False):
                p = np.frombuffer(raw)
                tiles[i, j] = tiles[i, j] + p if (i, j) in tiles else p
        yield from shipped(tiles)

    def shipped(tiles: dict) -> Iterator[pd.DataFrame]:
        task = TaskContext.get().partitionId() // FAN_IN
        for (i, j), p in tiles.items():
            yield pd.DataFrame({"i": [i], "j": [j], "part": [task], "held": [p.tobytes()]})

    other = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))
    sent = vectors.select(v).mapInPandas(cut, "rb long, cb int, held binary").withColumn("o", other)
    sent = sent.select("rb", F.least("cb", "o").alias("i"), F.greatest("cb", "o").alias("j"), "cb", "held")
    partial = "i int, j int, part int, held binary"
    parts = sent.repartition("rb", "i", "j").sortWithinPartitions("rb", "i", "j", "cb").mapInPandas(multiplied, partial)
    parts = parts.repartition("i", "j", "part").mapInPandas(added, partial)
    v_ = np.zeros((dims, dims))
    for r in parts.repartition("i", "j").mapInPandas(added, partial).collect():  # dims x dims numbers
        i, j = r["i"] * tile, r["j"] * tile
        p = np.frombuffer(r["held"]).reshape(min(tile, dims - i), min(tile, dims - j))
        v_[i : i + p.shape[0], j : j + p.shape[1]] = p
        v_[j : j + p.shape[1], i : i + p.shape[0]] = p.T
    return v_ / n


def fitted(vectors: DataFrame, v: str, components: int = COMPONENTS) -> Fit:
    """Eigenvectors of the covariance of all vectors, by falling eigenvalue; each one's largest entry (the first, in a tie) is positive."""
    n, sums = _means(vectors, v)
    if not n:
        return Fit(0, [], np.zeros(0), np.zeros((0, 0)), 0.0)
    cov = covariance(vectors, v, n, sums)
    values, of = np.linalg.eigh(cov)
    values, of = values[::-1][:components], of[:, ::-1][:, :components]
    keep = values > max(LEAST_SHARE * max(values.max(), 0.0), 0.0)
    values, of = values[keep], of[:, keep]
    if len(values):
        of = of * np.sign(of[np.argmax(np.abs(of).round(12), axis=0), np.arange(of.shape[1])])
    return Fit(n, sums, values, np.ascontiguousarray(of), float(np.trace(cov)))


def identity_error(vectors: DataFrame, v: str, fit: Fit) -> float:
    """Largest absolute entry of the covariance of all whitened rows minus the identity, from sums of products over all rows."""
    k = len(fit.values)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((k + 1, k + 1))
        for b in batches:
            if len(b):
                w = np.pad(fit.whitened(whole_numbers(b[v])), ((0, 0), (0, 1)), constant_values=1.0)
                total += w.T @ w
        yield pd.DataFrame({"at": range(total.size), "s": total.ravel()})

    rows = vectors.select(v).mapInPandas(run, "at int, s double").groupBy("at").agg(F.sum("s").alias("s")).collect()  # 81 rows
    m = np.zeros((k + 1) ** 2)
    for r in rows:
        m[r["at"]] = r["s"]
    m = m.reshape(k + 1, k + 1) / fit.n
    return float(np.abs(m[:k, :k] - np.outer(m[:k, k], m[:k, k]) - np.eye(k)).max())


def whiten(rows: DataFrame, id_col: str = "vec_id", v_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each vector and component.

    Dropped: null vectors, those with null or non-finite entries, and empty ones. Vectors of
    another length than the most frequent have no place in the covariance and are dropped
    too. Repeated rows and null ids are rows like any other. A component whose eigenvalue
    is nothing (under ``LEAST_SHARE`` of the largest: fewer directions than components, one
    vector, all vectors equal) has no scale and isn't returned, so all-equal vectors give no
    rows. Equal eigenvalues: any orthonormal directions of their space. An entry or a
    deviation beyond a long is an error, never a wrapped number. No rows: no rows. Extra
    columns are not read.
    """
    spark = rows.sparkSession
    own = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(v_col).cast("array<double>").alias("v")).where(sound(F.col("v")))
    d = common_length(own, "v")
    own = written(own.where(F.size("v") == d))
    fit = fitted(own, "v", components)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    k = len(fit.values)
    if not k:
        return spark.createDataFrame([], schema)
    error, explained = identity_error(own, "v", fit), fit.values / fit.trace
    table = spark.sparkContext.broadcast(fit)  # dims x components numbers

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = table.value
        for b in batches:
            if len(b):
                x = whole_numbers(b["v"])
                ids = np.repeat(b["vec_id"].astype("Int64").array, k)
                yield pd.DataFrame(
                    {"vec_id": ids, "component": np.tile(np.arange(1, k + 1), len(b)), "n": f.n, "deviation": np.repeat(np.array(f.deviations(x), dtype=np.int64), k),
                     "whitened": f.whitened(x).ravel(), "explained": np.tile(explained, len(b)), "identity_error": error}
                )

    return own.mapInPandas(run, schema)


def op11_whitening(embeddings: DataFrame) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for 8 components. Odd rows: as ``whiten`` says."""
    return whiten(embeddings)
