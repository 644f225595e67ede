"""Isolation forest: trees grown on small samples, scores by Arrow batches."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EULER = 0.5772156649015329


def average_path(n: np.ndarray | float) -> np.ndarray:
    """Expected length of an unsuccessful search among n."""
    n = np.asarray(n, dtype=float)
    with np.errstate(divide="ignore", invalid="ignore"):
        long = 2 * (np.log(np.maximum(n - 1, 1)) + EULER) - 2 * (n - 1) / np.maximum(n, 1)
    return np.where(n > 2, long, np.where(n == 2, 1.0, 0.0))


@dataclass(frozen=True)
class Candidate:
    n_estimators: int
    max_samples: int
    max_features: float
    complexity_rank: int = 1
    random_state: int = 42

    @property
    def candidate_id(self) -> str:
        return f"iforest_ne{self.n_estimators}_ms{self.max_samples}_mf{str(self.max_features).replace('.', 'p')}"


def grid(n_estimators: list[int], max_samples: list[int], max_features: list[float], size: int = 8) -> list[Candidate]:
    """All combinations, simplest first; the grid must have the agreed size."""
    made = [Candidate(a, b, c, i) for i, (a, b, c) in enumerate(itertools.product(sorted(n_estimators), sorted(max_samples), sorted(max_features)), start=1)]
    if len(made) != size:
        raise ValueError(f"the grid has {len(made)} candidates, not {size}")
    return made


@dataclass
class Tree:
    """Flat arrays: a split's feature and value, its children, and at leaves the path length to count."""

    feature: np.ndarray
    value: np.ndarray
    left: np.ndarray
    right: np.ndarray
    depth: np.ndarray

    def paths(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), dtype=np.int64)
        while True:
            inner = np.flatnonzero(self.feature[at] >= 0)
            if not len(inner):
                return self.depth[at]
            n = at[inner]
            at[inner] = np.where(x[inner, self.feature[n]] <= self.value[n], self.left[n], self.right[n])


def grow(x: np.ndarray, rng: np.random.Generator, columns: np.ndarray) -> Tree:
    limit = math.ceil(math.log2(max(2, len(x))))
    feature, value, left, right, depth = [], [], [], [], []

    def node(rows: np.ndarray, level: int) -> int:
        me = len(feature)
        feature.append(-1), value.append(0.0), left.append(-1), right.append(-1)
        depth.append(level + float(average_path(len(rows))))
        if level >= limit or len(rows) < 2:
            return me
        lo, hi = x[rows].min(0), x[rows].max(0)
        open_ = columns[hi[columns] > lo[columns]]
        if not len(open_):
            return me
        f = int(rng.choice(open_))
        v = float(rng.uniform(lo[f], hi[f]))
        if v >= hi[f]:
            v = float(lo[f])
        low = x[rows, f] <= v
        feature[me], value[me] = f, v
        left[me] = node(rows[low], level + 1)
        right[me] = node(rows[~low], level + 1)
        return me

    node(np.arange(len(x)), 0)
    return Tree(*(np.array(v) for v in (feature, value, left, right, depth)))


@dataclass
class Forest:
    features: tuple[str, ...]
    trees: list[Tree]
    samples: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** -(mean path / expected path): near 1 odd, well under 0.5 ordinary."""
        mean = sum(t.paths(x) for t in self.trees) / len(self.trees)
        return 2.0 ** (-mean / max(float(average_path(self.samples)), 1e-12))


def fit(reference: DataFrame, features: list[str], c: Candidate, key: str) -> Forest:
    """Trees on samples without replacement.

    Which rows a tree sees depends on a hash of (seed, tree, key) alone: each row joins
    each tree's draw with the odds that fill it, so samples are chosen and grouped in the
    cluster and a tree is grown where its few rows meet. Trees and their samples
    (n_estimators x max_samples rows) are of fixed size whatever the input.
    """
    n = reference.count()
    if not n:
        raise ValueError("no reference rows")
    size = min(c.max_samples, n)
    x = F.array(*[F.col(f"`{f}`").cast("float") for f in features])
    # draws are made in excess and cut to the sample exactly, in hash order
    odds = min(1.0, (size + 6 * math.sqrt(size) + 16) / n)
    luck = lambda t: F.pmod(F.xxhash64(F.lit(c.random_state), t, F.col(key)), F.lit(1 << 40))
    trees = F.filter(F.sequence(F.lit(0), F.lit(c.n_estimators - 1)), lambda t: luck(t) < F.lit(int(odds * (1 << 40))))
    drawn = reference.select(key, x.alias("x"), F.explode(trees).alias("tree"))
    drawn = drawn.select("tree", luck(F.col("tree")).alias("luck"), "x")
    width = max(1, int(c.max_features * len(features)))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        t = int(pdf["tree"].iloc[0])
        m = np.stack(pdf.sort_values("luck", kind="stable")["x"].to_numpy()[:])[:size].astype(np.float32)
        rng = np.random.default_rng((c.random_state, t))
        g = grow(m.astype(np.float64), rng, np.sort(rng.permutation(len(features))[:width]))
        return pd.DataFrame({"tree": [t], "feature": [g.feature], "value": [g.value], "left": [g.left], "right": [g.right], "depth": [g.depth]})

    rows = drawn.groupBy("tree").applyInPandas(one, "tree int, feature array<int>, value array<double>, left array<int>, right array<int>, depth array<double>").toPandas().sort_values("tree")
    made = [Tree(*(np.asarray(r[k]) for k in ("feature", "value", "left", "right", "depth"))) for r in rows.to_dict("records")]
    return Forest(tuple(features), made, size)


def score(df: DataFrame, forest: Forest, name: str = "anomaly_score") -> DataFrame:
    """Adds the score; features are taken as 32-bit floats in the fitted order."""
    shared = df.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def scored(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in it:
            x = np.stack(s.to_numpy()).astype(np.float32).astype(np.float64) if len(s) else np.zeros((0, len(shared.value.features)))
            if not np.isfinite(x).all():
                raise ValueError("features must be finite")
            yield pd.Series(shared.value.score(x))

    return df.withColumn(name, scored(F.array(*[F.col(f"`{f}`").cast("float") for f in forest.features])))


def predict_one(row: dict[str, float], forest: Forest, threshold: float) -> dict[str, float | bool]:
    """Score of one row given by feature name; the names must be exactly the fitted ones and the values finite."""
    missing, extra = set(forest.features) - set(row), set(row) - set(forest.features)
    if missing or extra:
        raise ValueError(f"missing features {sorted(missing)}, unknown features {sorted(extra)}")
    x = np.array([[row[f] for f in forest.features]], dtype=np.float32).astype(np.float64)
    if not np.isfinite(x).all():
        raise ValueError("features must be finite")
    s = float(forest.score(x)[0])
    return {"anomaly_score": s, "threshold": threshold, "alarm": s > threshold}
