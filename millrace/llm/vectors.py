"""Embedding near-dedup by product quantisation; nearest neighbours by multiprobe p-stable hashing."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.common import components, forest, per_group, release, written

#: Vectors that an index is fitted on, at most, and components of these; chosen by hash of their ids.
FIT_ROWS, FIT_COMPONENTS = 20_000, 4_000_000
#: Inverted lists, at most; each has this many fitted rows at least.
MAX_LISTS, ROWS_A_LIST = 4096, 20
#: Rows of an inverted list that are looked up together, and queries against them.
DATA_BLOCK, QUERY_BLOCK = 2048, 2048
#: Vectors whose neighbours among all rows are looked up to learn how far probing has to reach, and the pairs needed for that.
TRIED_NEAR, LEAST_PAIRS = 2048, 200
_UNNAMED = (1 << 63) - (1 << 41)


def usable(v: Column) -> Column:
    """Whether a vector can be compared: not null or empty, all components finite, not all zero."""
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(sound & F.exists(v, lambda x: x != 0), F.lit(False))


def common_length(df: DataFrame, v: str) -> int:
    """The most frequent length of usable vectors (ties: the shortest); others can't be compared with them."""
    r = df.groupBy(F.size(v).alias("d")).count().orderBy(F.desc("count"), "d").first()
    return r["d"] if r else 0


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _matrix(col: pd.Series) -> np.ndarray:
    return np.stack(col.to_numpy()).astype(np.float64) if len(col) else np.zeros((0, 0))


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows over a power of two, which changes no digit, so that no square overflows."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=1e-300))[1][:, None])


def _nearest_row(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = 0.5 * (c * c).sum(1)
    return np.concatenate([np.argmax(x[a : a + 4096] @ c.T - half, axis=1) for a in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = _nearest_row(x, c)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        n = np.bincount(near, minlength=k)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


# ---------------------------------------------------------------- product quantisation


@dataclass
class Quantiser:
    """Coarse centroids and residual codebooks, one per subspace."""

    coarse: np.ndarray
    books: list[np.ndarray]
    cuts: list[int]

    @classmethod
    def fit(cls, x: np.ndarray, lists: int, parts: int, codes: int, seed: int = 5) -> Quantiser:
        rng = np.random.default_rng(seed)
        coarse = _kmeans(x, min(lists, len(x)), 8, rng)
        r = x - coarse[_nearest_row(x, coarse)]
        cuts = np.linspace(0, x.shape[1], min(parts, x.shape[1]) + 1).astype(int).tolist()
        books = [_kmeans(r[:, a:b], min(codes, len(r)), 8, rng) for a, b in zip(cuts, cuts[1:], strict=False)]
        return cls(coarse, books, cuts)

    def home(self, x: np.ndarray) -> np.ndarray:
        return _nearest_row(x, self.coarse)

    def encode(self, x: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals, and how far the decoded vector lies from the true one."""
        r = x - self.coarse[home]
        codes = np.empty((len(x), len(self.books)), dtype=np.uint8)
        miss = np.zeros(len(x))
        for m, (a, b) in enumerate(zip(self.cuts, self.cuts[1:], strict=False)):
            codes[:, m] = _nearest_row(r[:, a:b], self.books[m])
            d = r[:, a:b] - self.books[m][codes[:, m]]
            miss += (d * d).sum(1)
        return codes, np.sqrt(miss)

    def borders(self, x: np.ndarray, home: np.ndarray) -> np.ndarray:
        """(n, lists): how far each vector lies from the border between its list and another; 0 to its own."""
        half = 0.5 * (self.coarse * self.coarse).sum(1)
        score = x @ self.coarse.T - half
        gap = score[np.arange(len(x)), home][:, None] - score
        apart = np.sqrt(np.maximum(0, 2 * half[home][:, None] + 2 * half[None, :] - 2 * (self.coarse[home] @ self.coarse.T)))
        return np.where(gap <= 1e-12, 0.0, gap / np.maximum(apart, 1e-300))

    def distances(self, q: np.ndarray, one: int, codes: np.ndarray) -> np.ndarray:
        """Squared distances of queries to coded vectors of one list, summed from per-subspace tables."""
        r = q - self.coarse[one]
        out = np.zeros((len(q), len(codes)), dtype=np.float32)
        for m, (a, b) in enumerate(zip(self.cuts, self.cuts[1:], strict=False)):
            s, c = r[:, a:b], self.books[m]
            table = ((s * s).sum(1)[:, None] - 2 * s @ c.T + (c * c).sum(1)[None, :]).astype(np.float32)
            out += np.take(table, codes[:, m], axis=1)
        return out


def _margin(reps: DataFrame, q: Quantiser, threshold: float, tried: int, recall: float) -> float:
    """How far from a list's border its vectors must probe for ``recall`` of the links.

    Tried vectors meet all rows; of each link between them counts how near to the border
    between their lists the nearer of the two lies. Half the neighbour distance is always
    enough, and taken where too few links are met to tell. Counts leave a task in bins.
    """
    most = math.sqrt(2 - 2 * threshold) / 2 + 1e-9
    some = reps.orderBy(F.xxhash64(F.lit(12), "rep"), "rep").limit(tried).select("h1", "rep", "v").toPandas()
    x, bins = _unit(_matrix(some["v"])), 400
    home, h1, rep = q.home(x), some["h1"].to_numpy(), some["rep"].to_numpy()
    far = q.borders(x, home)
    shared = reps.sparkSession.sparkContext.broadcast((x, home, far, h1, rep, q))

    def met(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x, home, far, h1, rep, q = shared.value
        total = np.zeros(bins + 1, dtype=np.int64)
        for b in it:
            for a in range(0, len(b), 2000):
                part = b.iloc[a : a + 2000]
                y = _unit(_matrix(part["v"]))
                i, j = np.nonzero(x @ y.T >= threshold)
                other = (h1[i] != part["h1"].to_numpy()[j]) | (rep[i] != part["rep"].to_numpy()[j])
                i, j = i[other], j[other]
                if len(i):
                    near, at = np.unique(j, return_inverse=True)
                    there = q.home(y[near])
                    back = q.borders(y[near], there)
                    need = np.minimum(far[i, there[at]], back[at, home[i]])
                    total += np.bincount(np.minimum(bins, np.ceil(need / most * bins)).astype(int), minlength=bins + 1)
        yield pd.DataFrame({"bin": np.arange(bins + 1), "n": total})

    got = reps.select("h1", "rep", "v").mapInPandas(met, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).toPandas().sort_values("bin")
    n = got["n"].to_numpy(np.int64)
    if n.sum() < LEAST_PAIRS:
        return most
    last = int(np.searchsorted(np.cumsum(n), recall * n.sum()))
    return most * min(bins, last + 1) / bins


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, parts: int = 8, codes: int = 256, recall: float = 0.9995, fit_rows: int = FIT_ROWS, id_col: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row; links are pairs with cosine at ``threshold`` or above.

    Unit vectors are dealt to inverted lists (about the root of their number, ``MAX_LISTS``
    at most; k-means on a bounded sample) and coded by subspace codebooks of their residuals.
    A vector probes every list whose border with its own lies within a margin; a pair is met
    if either of the two probes the other's list. The margin is learnt from the links of
    tried vectors, so that ``recall`` of these are met, whatever the vectors' distribution;
    up to ``TRIED_NEAR`` rows all are tried. Lists travel as packed codes to the vectors that
    probe them. Table-lookup distances rule out what can't be near: the bound adds the coded
    vector's own error, so it loses no pair. Vectors are fetched only for rows with a pair
    that passes, and the exact cosine in double precision decides.

    Vectors that are null, empty, zero, of another length than most, or hold a null or
    non-finite component link with nothing. Equal vectors are compared once and counted
    each; repeated rows are vectors of their own; rows that share an id bring their
    components together. A null id links, but names no component. Empty: no rows. Lists
    are cut into bounded blocks; links leave a task as counts and a spanning forest.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec).alias("v"))
    ok = rows.where(usable(F.col("v")))
    dim = common_length(ok, "v")
    fit = usable(F.col("v")) & (F.size("v") == F.lit(dim))
    h1, h2 = F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(77), "v").alias("h2")
    rep = F.coalesce(F.min("vec_id"), F.lit(_UNNAMED) + F.pmod(F.first("h1"), F.lit(1 << 40))).alias("rep")
    good = rows.where(fit).select("vec_id", h1, h2, "v")
    reps = written(good.groupBy("h1", "h2").agg(rep, F.count(F.lit(1)).alias("m"), F.first("v").alias("v")))
    n = reps.count()
    single = rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if not n:
        return single
    lists = int(min(MAX_LISTS, max(1, round(math.sqrt(n)))))
    bound = max(256, FIT_COMPONENTS // dim)
    some = reps.orderBy(F.xxhash64(F.lit(4), "rep"), "rep").limit(min(max(fit_rows, ROWS_A_LIST * lists), bound)).select("v").toPandas()
    q = Quantiser.fit(_unit(_matrix(some["v"])), lists, parts, codes)
    margin = _margin(reps, q, threshold, min(TRIED_NEAR, bound), recall)
    shared = vectors.sparkSession.sparkContext.broadcast(q)
    reach = math.sqrt(2 - 2 * threshold)
    kind = dict(reps.dtypes)["v"]

    def coding(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q = shared.value
        for b in it:
            for a in range(0, len(b), 2000):
                part = b.iloc[a : a + 2000]
                x = _unit(_matrix(part["v"]))
                home = q.home(x)
                code, miss = q.encode(x, home)
                probes = [np.flatnonzero(r).astype(np.int32) for r in q.borders(x, home) <= margin]
                yield part.assign(home=home.astype(np.int32), miss=miss, code=[c.tobytes() for c in code], probes=probes)

    coded = written(reps.select("h1", "rep", "m", "v").mapInPandas(coding, f"h1 long, rep long, m long, v {kind}, home int, miss double, code binary, probes array<int>"))
    sizes = coded.groupBy("home").agg(F.ceil(F.count(F.lit(1)) / F.lit(DATA_BLOCK)).cast("int").alias("nd"), F.ceil(F.count(F.lit(1)) / F.lit(QUERY_BLOCK)).cast("int").alias("nq"))
    place = coded.join(F.broadcast(sizes), "home")  # a row per list
    mixed = F.xxhash64("h1", "rep")
    asks = place.withColumn("qb", F.pmod(mixed, "nq").cast("int"))

    def packing(g: pd.DataFrame) -> pd.DataFrame:
        pack = {k: [g[k].to_numpy(t).tobytes()] for k, t in (("h1", np.int64), ("rep", np.int64), ("miss", np.float32))}
        return pd.DataFrame({"one": [g["home"].iloc[0]], "db": [g["db"].iloc[0]], "codes": [b"".join(g["code"])]} | pack)

    packs = written(per_group(place.withColumn("db", F.pmod(mixed, "nd").cast("int")).select("home", "db", "h1", "rep", "miss", "code"), ["home", "db"], [], packing, "one int, db int, codes binary, h1 binary, rep binary, miss binary"))
    wanted = asks.select("home", "qb", F.explode("probes").alias("one")).distinct()
    none = lambda t: F.lit(None).cast(t)
    asking = asks.select("home", "qb", F.lit(-1).alias("one"), F.lit(-1).alias("db"), F.col("h1").alias("id"), "rep", "v", "probes", *[none("binary").alias(c) for c in ("codes", "h1s", "reps", "miss")])
    shipped = wanted.join(packs, "one").select("home", "qb", "one", "db", F.lit(0).cast("long").alias("id"), F.lit(0).cast("long").alias("rep"), none(kind).alias("v"), none("array<int>").alias("probes"), "codes", F.col("h1").alias("h1s"), F.col("rep").alias("reps"), "miss")
    dealt = asking.union(shipped).repartition("home", "qb").sortWithinPartitions("home", "qb", "one", "db")

    def looking(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Streams each query block, then the packs it probes; out come rows of either side that have a pair within the bound."""
        q = shared.value
        block, held, out = None, [], []
        for b in it:
            for r in b.itertuples(index=False):
                if (r.home, r.qb) != block:
                    block, held, x = (r.home, r.qb), [], None
                if r.one < 0:
                    held.append((r.id, r.rep, r.v, r.probes))
                    continue
                if x is None:
                    h, p = (np.array([c[k] for c in held], dtype=np.int64) for k in (0, 1))
                    x = _unit(np.stack([c[2] for c in held]).astype(np.float64))
                    probed = np.zeros((len(held), len(q.coarse)), dtype=bool)
                    for k, c in enumerate(held):
                        probed[k, c[3]] = True
                who = np.flatnonzero(probed[:, r.one])
                dh, dr = np.frombuffer(r.h1s, np.int64), np.frombuffer(r.reps, np.int64)
                far = q.distances(x[who], r.one, np.frombuffer(r.codes, np.uint8).reshape(len(dh), -1))
                near = far <= ((reach + np.frombuffer(r.miss, np.float32) + np.float32(1e-3)) ** 2)[None, :]
                if r.one == r.home:
                    near &= (h[who][:, None] != dh[None, :]) | (p[who][:, None] != dr[None, :])
                i, j = who[near.any(1)], np.flatnonzero(near.any(0))
                if len(i):
                    k = len(i) + len(j)
                    out.append(pd.DataFrame({"home": np.full(k, r.home), "qb": r.qb, "one": r.one, "db": r.db, "query": np.arange(k) < len(i), "h1": np.concatenate([h[i], dh[j]]), "rep": np.concatenate([p[i], dr[j]])}))
                if sum(map(len, out)) > 5000:
                    yield pd.concat(out, ignore_index=True)
                    out = []
        if out:
            yield pd.concat(out, ignore_index=True)
        release()

    need = written(dealt.mapInPandas(looking, "home int, qb int, one int, db int, query boolean, h1 long, rep long"))
    side = need.join(coded.select("h1", "rep", "m", "v", F.col("home").alias("own"), "probes"), ["h1", "rep"])
    # of the other side's probes only whether the asking list is among them matters
    side = side.withColumn("back", F.array_contains("probes", F.col("home"))).drop("probes", "own")

    def compared(g: pd.DataFrame) -> pd.DataFrame | None:
        asks = g["query"].to_numpy(bool)
        d, s = g[~asks], g[asks]
        if not len(d) or not len(s):
            return None
        home, one = int(g["home"].iloc[0]), int(g["one"].iloc[0])
        y, x = _scaled(_matrix(d["v"])), _scaled(_matrix(s["v"]))
        near = x @ y.T >= (threshold - 1e-9) * np.sqrt(np.einsum("ij,ij->i", x, x))[:, None] * np.sqrt(np.einsum("ij,ij->i", y, y))[None, :]
        hi, hj, ri, rj = s["h1"].to_numpy(), d["h1"].to_numpy(), s["rep"].to_numpy(), d["rep"].to_numpy()
        # each pair once: within a list by order, across lists from the side that alone probes, or the smaller list
        if home == one:
            near &= (ri[:, None] < rj[None, :]) | ((ri[:, None] == rj[None, :]) & (hi[:, None] < hj[None, :]))
        elif home > one:
            near &= ~d["back"].to_numpy(bool)[None, :]
        i, j = np.nonzero(near)
        dot = lambda a, b: np.concatenate([np.einsum("ij,ij->i", a[k : k + 65536], b[k : k + 65536]) for k in range(0, max(1, len(a)), 65536)])
        if not len(i):
            return None
        nx, ny = np.sqrt(dot(x, x)), np.sqrt(dot(y, y))
        hit = np.concatenate([dot(x[i[a : a + 65536]], y[j[a : a + 65536]]) for a in range(0, len(i), 65536)]) / (nx[i] * ny[j]) >= threshold
        i, j = i[hit], j[hit]
        if not len(i):
            return None
        md, ms = d["m"].to_numpy(), s["m"].to_numpy()
        k = len(x)
        degree = np.zeros(k + len(y), dtype=np.int64)
        np.add.at(degree, i, md[j])
        np.add.at(degree, k + j, ms[i])
        root = forest(k + len(y), i, k + j)
        at = np.flatnonzero(degree)
        h, r = np.concatenate([hi, hj]), np.concatenate([ri, rj])
        return pd.DataFrame({"h1": h[at], "rep": r[at], "root": r[root[at]], "links": degree[at]})

    names = ["home", "qb", "one", "db", "query", "h1", "rep", "m", "v", "back"]
    found = written(per_group(side.select(*names), ["home", "qb", "one", "db"], [], compared, "h1 long, rep long, root long, links long"))
    more = found.groupBy("h1", "rep").agg(F.sum("links").alias("more"))
    comp = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b"))).withColumnRenamed("id", "rep")
    known = reps.select("h1", "h2", "rep", "m").join(more, ["h1", "rep"], "left").join(comp, "rep", "left")
    known = known.select("h1", "h2", (F.col("m") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("c"))
    named = F.when(F.col("c") < F.lit(_UNNAMED), F.col("c"))
    out = good.select("vec_id", "h1", "h2").join(known, ["h1", "h2"]).select("vec_id", "n_links", named.alias("component_id"), F.coalesce(F.col("vec_id") == named, F.lit(True)).alias("kept"))
    rest = rows.where(~fit).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    return out.union(rest)


# ---------------------------------------------------------------- p-stable hashing

TABLES, WIDTH = 4, 1.5
#: Rows of a filled bucket, about; hash functions of a table, at most.
BUCKET_ROWS, MOST_HASHES = 64, 16
#: Rows of a shelf and queries that meet it in one task.
SHELF, ASKED = 32_768, 4096
#: Queries whose true neighbours are looked up to learn where neighbours lie.
TRIED = 200
#: Buckets of smaller chance are not visited, whatever share is asked for.
LEAST_CHANCE = 1e-9


@dataclass
class Hashes:
    """``TABLES`` tables of functions floor((a.x + b) / w) with a normal; a bucket is the row of its functions' cells.

    Vectors are lengthened by one component to a common norm, which makes the largest
    inner product the smallest distance. The number of functions grows with the logarithm
    of the number of rows, so that buckets stay of about one size.
    """

    a: np.ndarray  # tables x hashes x dim
    b: np.ndarray
    w: np.ndarray
    norm: float  # of vectors over ``scale``, the largest component, so that squares can't overflow
    scale: float
    #: Where a neighbour's projections lie: ``base + slope * (the query's own)``, give or take ``spread``.
    base: np.ndarray | None = None
    slope: np.ndarray | None = None
    spread: np.ndarray | None = None

    @classmethod
    def fit(cls, x: np.ndarray, norm: float, scale: float, rows: int, seed: int = 11) -> Hashes:
        rng = np.random.default_rng(seed)
        # a normal in cells of 1.5 deviations fills about 2.75 of them
        hashes = int(np.clip(round(math.log(max(1, rows / BUCKET_ROWS), 2.75)), 2, MOST_HASHES))
        a = rng.standard_normal((TABLES, hashes, x.shape[1] + 1))
        p = np.einsum("nd,thd->nth", cls._long(x / scale, norm), a)
        w = WIDTH * np.maximum(p.std(0), 1e-12)
        h = cls(a, rng.random((TABLES, hashes)) * w - p.mean(0), w, norm, scale)
        h.base, h.slope, h.spread = p.mean(0), np.zeros_like(w), w / WIDTH  # until neighbours are known
        return h

    @staticmethod
    def _long(x: np.ndarray, norm: float) -> np.ndarray:
        return np.concatenate([x, np.sqrt(np.maximum(0, norm**2 - (x * x).sum(1)))[:, None]], axis=1)

    def cells(self, x: np.ndarray) -> np.ndarray:
        """(n, tables, hashes): each row's cells."""
        return np.floor((np.einsum("nd,thd->nth", self._long(x / self.scale, self.norm), self.a) + self.b) / self.w).astype(np.int64)

    def bucket(self, x: np.ndarray) -> np.ndarray:
        """(n, tables): each row's bucket, a hash of its cells."""
        c = self.cells(x)
        key = np.zeros(c.shape[:2], dtype=np.uint64)
        for h in range(c.shape[2]):
            key = _entered(key, c[:, :, h])
        return key.view(np.int64)

    def asked(self, q: np.ndarray) -> np.ndarray:
        """(n, tables, hashes): projections of queries, at the common norm."""
        return self.norm * np.einsum("nd,thd->nth", np.concatenate([_unit(q), np.zeros((len(q), 1))], axis=1), self.a)

    def learn(self, q: np.ndarray, y: np.ndarray) -> None:
        """Regresses true neighbours' projections on their queries' (rows of q and y are pairs)."""
        x, p = self.asked(q), np.einsum("nd,thd->nth", self._long(y / self.scale, self.norm), self.a)
        mx, mp = x.mean(0), p.mean(0)
        self.slope = ((x - mx) * (p - mp)).sum(0) / np.maximum(((x - mx) ** 2).sum(0), 1e-300)
        self.base = mp - self.slope * mx
        self.spread = np.maximum((p - self.base - self.slope * x).std(0), 1e-3 * self.w)

    def chances(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first cell, chance of each cell from there on) by query, table and hash: where a neighbour lies."""
        at, spread = self.base + self.slope * self.asked(q), np.broadcast_to(self.spread, (len(q), *self.spread.shape))
        low = np.floor((at - 4 * spread + self.b) / self.w).astype(np.int64)
        wide = int((np.floor((at + 4 * spread + self.b) / self.w) - low).max()) + 1
        edge = (low[..., None] + np.arange(wide + 1)) * self.w[None, :, :, None] - self.b[None, :, :, None]
        return low, np.diff(0.5 * (1 + _erf((edge - at[..., None]) / spread[..., None] / math.sqrt(2))), axis=3)

    def mass_needed(self, q: np.ndarray, y: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Of each neighbour y of query ``owner``: the share of chance its query has to visit in every table until one table holds it."""
        bucket, need = self.bucket(y), np.ones((TABLES, len(y)))
        for i in np.unique(owner):
            low, p = self.chances(q[i : i + 1])
            mine = np.flatnonzero(owner == i)
            for t in range(TABLES):
                keys, odds = visits(low[0, t], p[0, t], 1.0)
                total = np.cumsum(odds)
                by = np.argsort(keys)
                at = by[np.minimum(np.searchsorted(keys[by], bucket[mine, t]), len(by) - 1)]
                need[t, mine] = np.where(keys[at] == bucket[mine, t], total[at] - odds[at] * 0.999, 1.0)
        return need.min(0)


def _entered(key: np.ndarray, cell: np.ndarray) -> np.ndarray:
    key = (key ^ (cell + (1 << 20)).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    return key ^ (key >> np.uint64(29))


def visits(low: np.ndarray, p: np.ndarray, share: float, most: int = 200_000) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, their chances), likeliest first, until ``share`` of all chance is visited.

    The likeliest bucket's cells are perturbed hash by hash; a partial row of cells that
    can't reach the least chance still wanted, whatever its other cells, is not followed.
    That least chance is lowered until the share is there, or ``most`` buckets are: the chances
    returned then add up to less than ``share``, which the caller has to look at.
    """
    best = np.append(np.cumprod(p.max(axis=1)[::-1])[::-1], 1.0)  # of the hashes still to come
    least = best[0]
    while True:
        least = max(least / 8, LEAST_CHANCE)
        keys, odds = np.zeros(1, dtype=np.uint64), np.ones(1)
        for h in range(len(low)):
            cells = np.flatnonzero(p[h] > 0)
            odds = (odds[:, None] * p[h][None, cells]).ravel()
            keys = _entered(np.repeat(keys, len(cells)), np.tile(low[h] + cells, len(keys)))
            follow = odds * best[h + 1] >= least
            keys, odds = keys[follow], odds[follow]
        if odds.sum() >= share or least <= LEAST_CHANCE or len(odds) > most:
            order = np.argsort(-odds, kind="stable")
            total = np.cumsum(odds[order])
            order = order[: np.searchsorted(total, share) + 1]
            return keys[order].view(np.int64), odds[order]


def _erf(x: np.ndarray) -> np.ndarray:
    """Rational approximation, off by less than 2e-7."""
    t = 1 / (1 + 0.3275911 * np.abs(x))
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return np.sign(x) * (1 - poly * np.exp(-x * x))


def _exact_products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner product of one vector with rows, summed in one order whatever else is in the task: equal vectors score alike."""
    return np.add.reduce(np.ascontiguousarray(y * x), axis=1)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, recall: float = 0.96, fit_rows: int = FIT_ROWS, id_col: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of largest inner product found for each query, its own id excepted.

    Every row is in a bucket of each table. A query visits buckets in the order of their
    estimated chance to hold a neighbour, up to a share of all chance. A bounded set of
    tried queries, searched against all rows, teaches where neighbours lie and which share
    finds ``recall`` of theirs, so the share follows the data and its size. Candidates of
    all tables are merged and ranked by the inner product in double precision, ties to the
    smaller id. Buckets are dealt to shelves of bounded size, one task per shelf block and
    query block; a shelf with a large bucket is cut into several blocks. A query that finds
    fewer than k, or whose share would take more buckets than a table is visited for,
    looks at all rows.

    Vectors that are null, empty, zero, of another length than most or hold a null or
    non-finite component take no part on either side, nor do null ids. Repeated rows count
    once; an id with several vectors scores by its best. Fewer than k candidates: all.
    """
    spark = vectors.sparkSession

    def clean(df: DataFrame) -> DataFrame:
        d = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec).alias("v"))
        return d.where(F.col("id").isNotNull() & usable(F.col("v")))

    data = clean(vectors)
    dim = common_length(data, "v")
    data = written(data.where(F.size("v") == F.lit(dim)).dropDuplicates(["id", "v"]))
    asked = written(clean(queries).where(F.size("v") == F.lit(dim)).dropDuplicates(["id", "v"]))
    known = data.agg(F.count(F.lit(1)), F.countDistinct("id"), F.max(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double")))))).first()
    n, ids, scale = known
    if not n or asked.isEmpty():
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    part = lambda x: x.cast("double") / F.lit(scale)
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + part(x) * part(x))
    norm = float(np.sqrt(data.agg(F.max(square)).first()[0])) * (1 + 1e-12)
    some = _matrix(data.orderBy(F.xxhash64(F.lit(6), "id"), "id").limit(min(fit_rows, max(256, FIT_COMPONENTS // dim))).select("v").toPandas()["v"])
    h = Hashes.fit(some, norm, scale, n)
    pairs = _true_neighbours(data, asked.orderBy(F.xxhash64(F.lit(8), "id"), "id").limit(TRIED).toPandas(), min(k, ids - 1)) if ids > 1 else None
    share = 1.0
    if pairs is not None:
        h.learn(pairs[0][pairs[2]], pairs[1])
        share = float(np.quantile(h.mass_needed(*pairs), recall))
    shared = spark.sparkContext.broadcast(h)
    kind = dict(data.dtypes)["v"]
    shelf_rows = int(min(SHELF, max(1024, FIT_COMPONENTS // dim)))
    shelves = -(-n // shelf_rows)

    def shelf_of(bucket: np.ndarray) -> np.ndarray:
        return ((bucket.view(np.uint64) >> np.uint64(33)) % np.uint64(shelves)).astype(np.int32)

    def shelved(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            if len(b):
                at = shared.value.bucket(_matrix(b["v"]))
                for t in range(TABLES):
                    one = np.ascontiguousarray(at[:, t])
                    yield pd.DataFrame({"t": np.full(len(b), t, np.int32), "shelf": shelf_of(one), "bucket": one, "id": b["id"], "v": b["v"]})
        release()

    def visiting(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        h = shared.value
        for whole in it:
            for a in range(0, len(whole), 256):
                b = whole.iloc[a : a + 256]
                low, p = h.chances(_matrix(b["v"]))
                rows = []
                for i, (qid, v) in enumerate(zip(b["id"], b["v"], strict=True)):
                    visited = [visits(low[i, t], p[i, t], share) for t in range(TABLES)]
                    if any(odds.sum() < share * (1 - 1e-3) for _, odds in visited):
                        continue  # too many buckets for its share: it finds nothing here, and so looks at all rows
                    for t, (seen, _) in enumerate(visited):
                        on = shelf_of(seen)
                        by = np.argsort(on, kind="stable")
                        first = np.flatnonzero(np.append(True, np.diff(on[by]) > 0))
                        rows += [(t, int(on[by[x]]), qid, v, seen[by[x:z]]) for x, z in zip(first, [*first[1:], len(by)], strict=True)]
                for z in range(0, len(rows), 1000):
                    yield pd.DataFrame(rows[z : z + 1000], columns=["t", "shelf", "id", "v", "seen"])
        release()

    index = written(data.mapInPandas(shelved, f"t int, shelf int, bucket long, id long, v {kind}"))
    cut = index.groupBy("t", "shelf").agg(F.ceil(F.count(F.lit(1)) / F.lit(1.5 * shelf_rows)).cast("int").alias("nb"))  # a row per shelf
    cut = written(cut)
    d = index.join(F.broadcast(cut), ["t", "shelf"]).withColumn("blk", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int")).drop("nb")

    def search(s: DataFrame) -> DataFrame:
        """The best of each query (t, shelf, id, v, seen) among the rows of its buckets on a shelf, or among all where ``seen`` is null."""
        s = written(s.join(F.broadcast(cut), ["t", "shelf"]).withColumn("blk", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).drop("nb"))
        grid = s.groupBy("t", "shelf", "blk").agg(F.ceil(F.count(F.lit(1)) / F.lit(ASKED)).cast("int").alias("nq"))
        both = s.join(grid, ["t", "shelf", "blk"]).withColumn("qb", F.pmod(F.xxhash64("id"), F.col("nq")).cast("int"))
        both = both.select("t", "shelf", "blk", "qb", F.lit(True).alias("query"), F.lit(0).cast("long").alias("bucket"), "id", "v", "seen")
        met = d.join(grid, ["t", "shelf", "blk"]).withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("nq") - 1)))
        both = both.union(met.select("t", "shelf", "blk", "qb", F.lit(False), "bucket", "id", "v", F.lit(None).cast("array<long>")))
        found = per_group(both, ["t", "shelf", "blk", "qb"], [], ranked, "query_id long, vec_id long, score double")
        return found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))

    def ranked(g: pd.DataFrame) -> pd.DataFrame | None:
        is_q = g["query"].to_numpy(bool)
        q, d = g[is_q], g[~is_q]
        if not len(q) or not len(d):
            return None
        y, ids = _matrix(d["v"]), d["id"].to_numpy(np.int64)
        filled, at = np.unique(d["bucket"].to_numpy(np.int64), return_inverse=True)
        longest = np.sqrt(np.einsum("ij,ij->i", y / scale, y / scale).max())
        out = []
        for a in range(0, len(q), 128):
            part = q.iloc[a : a + 128]
            qid, x = part["id"].to_numpy(np.int64), _matrix(part["v"])
            seen = np.zeros((len(part), len(filled)), dtype=bool)
            for i, b in enumerate(part["seen"]):
                if b is None:
                    seen[i] = True
                else:
                    on = np.minimum(np.searchsorted(filled, b), len(filled) - 1)
                    seen[i, on[filled[on] == b]] = True
            with np.errstate(over="ignore", invalid="ignore"):
                score = x @ y.T
                # what may be among the best, were it summed otherwise, is scored again in one fixed order
                slack = 1e-12 * np.sqrt(np.einsum("ij,ij->i", x / scale, x / scale)) * longest * scale * scale
            score[~seen[:, at] | (qid[:, None] == ids[None, :])] = -np.inf
            last = -np.partition(-score, min(k, score.shape[1]) - 1, axis=1)[:, min(k, score.shape[1]) - 1] - slack
            for i in range(len(part)):
                top = np.flatnonzero((score[i] >= last[i]) & (score[i] > -np.inf))
                if len(top):
                    with np.errstate(over="ignore"):
                        exact = _exact_products(x[i], y[top])
                    o = np.lexsort((ids[top], -exact))[:k]
                    out.append((np.full(len(o), qid[i]), ids[top[o]], exact[o]))
        if not out:
            return None
        return pd.DataFrame(dict(zip(["query_id", "vec_id", "score"], map(np.concatenate, zip(*out, strict=True)), strict=True)))

    s = asked.repartition(max(1, spark.sparkContext.defaultParallelism)).mapInPandas(visiting, f"t int, shelf int, id long, v {kind}, seen array<long>")
    best = written(_best(search(s), k))
    enough = best.groupBy(F.col("query_id").alias("id")).count().where(F.col("count") >= min(k, ids - 1)).select("id")
    short = asked.join(enough, "id", "left_anti")
    if ids > 1 and not short.isEmpty():
        everywhere = short.select(F.lit(0).alias("t"), F.explode(F.sequence(F.lit(0), F.lit(int(shelves) - 1))).alias("shelf"), "id", "v", F.lit(None).cast("array<long>").alias("seen"))
        best = best.join(short.select(F.col("id").alias("query_id")).distinct(), "query_id", "left_anti").union(_best(search(everywhere), k).select(best.columns))
    return best.select("query_id", "rank", "vec_id", "score")


def _best(scores: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k)


def _true_neighbours(data: DataFrame, tried: pd.DataFrame, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(queries, neighbours, which query each belongs to): the k best of every tried query among all rows; none if any has fewer."""
    ids, q = tried["id"].to_numpy(np.int64), _matrix(tried["v"])
    kind = dict(data.dtypes)["v"]

    def best(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for b in it:
            if len(b):
                with np.errstate(over="ignore", invalid="ignore"):
                    s = q @ _matrix(b["v"]).T
                s[ids[:, None] == b["id"].to_numpy(np.int64)[None, :]] = -np.inf
                at = np.argpartition(-s, min(k, s.shape[1]) - 1, axis=1)[:, :k]
                i = np.repeat(np.arange(len(q)), at.shape[1])
                new = pd.DataFrame({"i": i, "score": s[i, at.ravel()], "v": b["v"].to_numpy()[at.ravel()]})
                held = new if held is None else pd.concat([held, new], ignore_index=True)
                held = held[np.isfinite(held["score"])].sort_values(["i", "score"], ascending=[True, False], kind="stable").groupby("i").head(k)
        if held is not None:
            yield held

    w = W.partitionBy("i").orderBy(F.desc("score"))
    got = data.mapInPandas(best, f"i long, score double, v {kind}").withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select("i", "v").toPandas()  # TRIED x k rows
    if len(got) < k * len(q):
        return None
    return q, _matrix(got["v"]), got["i"].to_numpy(np.int64)


def op5_near_dedup(vectors: DataFrame) -> DataFrame:
    return near_duplicates(vectors)


def op6_neighbours(vectors: DataFrame) -> DataFrame:
    return nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0))
