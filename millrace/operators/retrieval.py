"""TF-IDF and latent-semantic indexes as tables; hybrid top-k retrieval for many queries at once."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions.arrays import l2_normalize
from millrace.functions.text import terms, word_tokens
from millrace.operators.postings import PLACES, best, keyword_top_k, pair_scores
from millrace.operators.products import largest_products, vector_blocks
from millrace.operators.terms import MOST_TERMS, document_rows, entry_rows, numbered, vocabulary_of  # noqa: F401
from millrace.plans.tables import cut

VECTOR_WEIGHT, KEYWORD_WEIGHT, CANDIDATES = 0.65, 0.35, 30


#: Characters of text that one task counts the terms of, about: some 2 million terms of its own hash table.
TASK_CHARS = 6_000_000


def term_counts(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, term, tf); texts are dealt by id and cut into tokens once, so that a document's terms are counted where they are and no term is shuffled.

    A first pass adds up the lengths of texts: a task gets about ``TASK_CHARS`` of them, whatever the table.
    """
    n = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, -(-n // TASK_CHARS))
    k = docs.select(F.col(id_col).alias("id"), F.col(text).alias("t")).repartition(parts, "id").select("id", word_tokens(F.col("t")).alias("k"))
    # outer, as otherwise a filter on the list's size is put below and cuts the text again
    return k.select("id", F.explode_outer(terms(F.col("k"))).alias("term")).where(F.col("term").isNotNull()).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))


def vocabulary(counts: DataFrame, n_docs: int, max_features: int | None = 16_000, min_df: int = 1) -> DataFrame:
    """(term, df, idf) of the most frequent terms by total count, ties in term order; idf = ln((1+n)/(1+df)) + 1."""
    v = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total")).where(F.col("df") >= min_df)
    if max_features is not None:
        v = v.orderBy(F.desc("total"), "term").limit(max_features)
    return v.select("term", "df", (F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + F.col("df"))) + 1.0).alias("idf"))


#: Terms (of a vocabulary, or of all queries) up to which they are broadcast; more are joined by shuffle.
BROADCAST_TERMS = 500_000


def _few(d: DataFrame) -> DataFrame:
    return F.broadcast(d) if d.count() <= BROADCAST_TERMS else d


def tfidf(counts: DataFrame, vocab: DataFrame) -> DataFrame:
    """(id, term, weight): (1 + ln tf) * idf, each document's weights of unit length."""
    w = counts.join(_few(vocab.select("term", "idf")), "term").select("id", "term", ((F.log("tf") + 1.0) * F.col("idf")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy("id")))  # a document's own terms
    return w.select("id", "term", (F.col("w") / norm).alias("weight"))


def keyword_scores(index: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, id, keyword_score): only documents that share a term meet a query; where the queries' terms are few they come to the documents, so a frequent term is no hot key."""
    q = queries.select(F.col("id").alias("query_id"), "term", F.col("weight").alias("qw"))
    return index.join(_few(q), "term").groupBy("query_id", "id").agg(F.sum(F.col("weight") * F.col("qw")).alias("keyword_score"))


def top_per_query(scores: DataFrame, score: str, k: int) -> DataFrame:
    """The k best documents of each query with a score over 0; equal ones (to nine places, as sums of floats have no order) by the smaller id."""
    return best(scores, k, score)


#: Terms of a vocabulary that latent directions are made for, at most: their table is held in tasks and on the driver.
LSA_TERMS = MOST_TERMS
#: Directions iterated beside the wanted ones.
OVERSAMPLE = 10
#: Terms whose partial sums travel in one row; documents that are multiplied at a time, and entries of their rare terms.
TERM_CHUNK, DOCS, ENTRIES = 16, 512, 2_000
#: Terms that at least one in so many of these documents has are multiplied as a dense matrix.
DENSE = 40


def entries(index: DataFrame, terms: list[str]) -> DataFrame:
    """(id, cols, weights): a document's entries as one row, terms by number."""
    shared = index.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(terms)})

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = shared.value
        for b in it:
            cols = [[number.get(t, -1) for t in x] for x in b["terms"]]
            yield pd.DataFrame({"id": b["id"], "cols": cols, "weights": b["weights"]})

    kind = dict(index.dtypes)["id"]
    both = F.collect_list(F.struct("term", "weight"))
    d = index.groupBy("id").agg(both.alias("e")).select("id", F.col("e.term").alias("terms"), F.col("e.weight").alias("weights"))
    return d.mapInPandas(run, f"id {kind}, cols array<int>, weights array<double>")


def _rows(index: DataFrame, terms: list[str]) -> DataFrame:
    """The index as documents with numbered terms, whether it is a table of these already or of single entries."""
    return index if "cols" in index.columns else entries(index, terms)


class _Block:
    """Entries of some documents: those of terms that many of them have as a dense matrix, the others in lists, row by row and term by term."""

    def __init__(self, rows: int, row: np.ndarray, col: np.ndarray, w: np.ndarray, n_terms: int, dense: int = DENSE):
        self.rows = rows
        count = np.bincount(col, minlength=n_terms)
        self.head = np.flatnonzero(count * dense >= rows)
        place = np.full(n_terms, -1)
        place[self.head] = np.arange(len(self.head))
        at = place[col]
        often, rare = at >= 0, at < 0
        self.dense = np.bincount(row[often] * len(self.head) + at[often], w[often], rows * len(self.head)).reshape(rows, len(self.head))
        self.row, self.col, self.w = row[rare], col[rare], w[rare]

    def _added(self, out: np.ndarray, to: np.ndarray, x: np.ndarray, of: np.ndarray, w: np.ndarray) -> None:
        """Adds x[of] * w to out[to], a part of the entries at a time that stays near the processor; ``to`` rises."""
        for a in range(0, len(to), ENTRIES):
            t, part = to[a : a + ENTRIES], x[of[a : a + ENTRIES]]
            part *= w[a : a + ENTRIES, None]
            first = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
            out[t[first]] += np.add.reduceat(part, first, axis=0)

    def product(self, v: np.ndarray) -> np.ndarray:
        y = self.dense @ v[self.head]
        self._added(y, self.row, v, self.col, self.w)
        return y

    def back(self, y: np.ndarray, out: np.ndarray) -> None:
        out[self.head] += self.dense.T @ y
        order = np.argsort(self.col, kind="stable")
        self._added(out, self.col[order], y, self.row[order], self.w[order])


def _blocks(b: pa.RecordBatch, n_terms: int, dense: int = DENSE) -> Iterator[tuple[slice, _Block]]:
    """The batch's documents, ``DOCS`` at a time; entries of unknown terms are left out."""
    for a in range(0, b.num_rows, DOCS):
        x = b.slice(a, DOCS)
        cols, w = x.column("cols").flatten().to_numpy().astype(np.int64), x.column("weights").flatten().to_numpy()
        row = np.repeat(np.arange(x.num_rows), pc.list_value_length(x.column("cols")).to_numpy(zero_copy_only=False))
        known = cols >= 0
        yield slice(a, a + x.num_rows), _Block(x.num_rows, row[known], cols[known], w[known], n_terms, dense)


@dataclass
class Latent:
    """Latent directions with what certifies them.

    ``values`` are the Rayleigh quotients of A'A, falling. ``residuals[j]`` is the norm of
    A'A v - value v over the largest value: an eigenvalue of A'A lies within that share of the
    largest from ``values[j]``, so small residuals prove the directions, whatever led to them.
    """

    directions: DataFrame  # term, v
    values: np.ndarray
    residuals: np.ndarray
    rounds: int


def latent(index: DataFrame, vocab: DataFrame, dims: int, n_docs: int, rounds: int = 7, seed: int = 42, tolerance: float = 0.0) -> Latent:
    """Right singular directions of the TF-IDF matrix by randomised subspace iteration.

    The matrix stays distributed, a row of entries for each document. One round multiplies
    it by the table of term vectors (terms x dims, bounded by the vocabulary) and back:
    every task adds up its documents' share, the shares are added by term, and the sum is
    orthonormalised; ``OVERSAMPLE`` directions more than wanted go along, so that the last wanted ones
    converge too. The small product of a round turns the basis to singular directions and tells
    their residuals; rounds end once all of these are ``tolerance`` at most, or after ``rounds`` and one.
    """
    terms = [r["term"] for r in vocab.select("term").orderBy("term").limit(LSA_TERMS + 1).collect()]
    if len(terms) > LSA_TERMS:
        raise ValueError(f"latent directions need a vocabulary of {LSA_TERMS} terms at most")
    if not 2 <= dims <= min(n_docs - 1, len(terms) - 1):
        raise ValueError(f"{dims} dimensions don't fit {n_docs} documents and {len(terms)} terms")
    spark = index.sparkSession
    rows = index if "cols" in index.columns else cut(entries(index, terms))
    rows = rows.coalesce(spark.sparkContext.defaultParallelism)  # each task sends a table of term vectors: as many as work at a time
    v = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(terms), min(dims + OVERSAMPLE, len(terms)))))[0]
    for done in range(1, rounds + 2):
        there = _there_and_back(rows, v)
        values, turn = np.linalg.eigh(v.T @ there)
        values, turn = values[::-1][:dims], turn[:, ::-1][:, :dims]
        residuals = np.linalg.norm(there @ turn - (v @ turn) * values, axis=0) / max(values[0], 1e-300)
        if done == rounds + 1 or residuals.max() <= tolerance:
            break
        v = np.linalg.qr(there)[0]
    v = v @ turn
    v *= np.where(v[np.abs(v).argmax(axis=0), np.arange(dims)] < 0, -1.0, 1.0)
    directions = spark.createDataFrame(pd.DataFrame({"term": terms, "v": v.tolist()}), "term string, v array<double>")
    return Latent(directions, values, residuals, done)


def lsa(index: DataFrame, vocab: DataFrame, dims: int, n_docs: int, rounds: int = 7, seed: int = 42) -> DataFrame:
    """(term, v): the directions of ``latent``."""
    return latent(index, vocab, dims, n_docs, rounds, seed).directions


def total_variance(index: DataFrame, n_docs: int) -> DataFrame:
    """(total_variance): the sum over terms of the variance of their weights over all documents, one without any term included. Two sums a term, no matrix."""
    by_term = index.groupBy("term").agg(F.sum("weight").alias("s"), F.sum(F.col("weight") * F.col("weight")).alias("q"))
    return by_term.agg(F.coalesce(F.sum(F.col("q") / n_docs - F.pow(F.col("s") / n_docs, 2)), F.lit(0.0)).alias("total_variance"))


def explained_variance(index: DataFrame, directions: DataFrame, dims: int, n_docs: int, vocab: DataFrame | None = None) -> DataFrame:
    """(component, explained_variance, explained_ratio): the variance of the documents' coordinates along each direction, and its share of ``total_variance``.

    Documents are projected where they are; each task sends two sums a component.
    """
    d = directions.orderBy("term").limit(LSA_TERMS).toPandas()
    shared = index.sparkSession.sparkContext.broadcast(np.array(d["v"].tolist(), dtype=float).reshape(-1, dims))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, q = np.zeros(dims), np.zeros(dims)
        for b in it:
            for _, x in _blocks(b, len(shared.value)):
                y = x.product(shared.value)
                s, q = s + y.sum(axis=0), q + (y * y).sum(axis=0)
        yield pa.RecordBatch.from_pydict({"component": pa.array(range(1, dims + 1), pa.int32()), "s": s, "q": q})

    sums = _rows(index, d["term"].tolist()).mapInArrow(run, "component int, s double, q double").groupBy("component").agg(F.sum("s").alias("s"), F.sum("q").alias("q"))
    variance = (F.col("q") / n_docs - F.pow(F.col("s") / n_docs, 2)).alias("explained_variance")
    total = F.broadcast(total_variance(index if vocab is None else entry_rows(index, vocab), n_docs))  # one row
    return sums.select("component", variance).crossJoin(total).select("component", "explained_variance", F.when(F.col("total_variance") > 0, F.col("explained_variance") / F.col("total_variance")).alias("explained_ratio"))


def _there_and_back(rows: DataFrame, v: np.ndarray) -> np.ndarray:
    """A'A v, the tasks' shares added by blocks of terms."""
    shared = rows.sparkSession.sparkContext.broadcast(v)

    def share(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        out = np.zeros_like(v)
        for b in it:
            for _, x in _blocks(b, len(v)):
                x.back(x.product(v), out)
        used = [a for a in range(0, len(out), TERM_CHUNK) if out[a : a + TERM_CHUNK].any()]
        yield pa.RecordBatch.from_pydict({"at": pa.array(used, pa.int32()), "x": pa.array([out[a : a + TERM_CHUNK].tobytes() for a in used], pa.binary())})

    def added(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for b in it:
            for at, x in zip(b["at"], b["x"], strict=True):
                x = np.frombuffer(x)
                total[at] = total[at] + x if at in total else x
        yield pd.DataFrame({"at": list(total), "x": [x.tobytes() for x in total.values()]})

    sums = rows.mapInArrow(share, "at int, x binary").repartition("at").mapInPandas(added, "at int, x binary").toPandas()  # as large as v
    out = np.zeros_like(v)
    for at, x in zip(sums["at"], sums["x"], strict=True):
        out[at : at + TERM_CHUNK] = np.frombuffer(x).reshape(-1, v.shape[1])
    return out


def embed(index: DataFrame, directions: DataFrame, dims: int) -> DataFrame:
    """(id, v): documents (or queries) in the latent space, of unit length."""
    d = directions.orderBy("term").limit(LSA_TERMS).toPandas()
    terms, m = d["term"].tolist(), np.array(d["v"].tolist(), dtype=float).reshape(-1, dims)
    shared = index.sparkSession.sparkContext.broadcast(m)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for at, x in _blocks(b, len(shared.value)):
                y = x.product(shared.value)
                v = pa.ListArray.from_arrays(np.arange(len(y) + 1, dtype=np.int32) * dims, pa.array(y.reshape(-1)))
                yield pa.RecordBatch.from_arrays([b.column("id").slice(at.start, len(y)), v], names=["id", "v"])

    return _rows(index, terms).mapInArrow(run, f"id {dict(index.dtypes)['id']}, v array<double>").select("id", l2_normalize(F.col("v")).alias("v"))


def dense_scores(docs: DataFrame, queries: DataFrame, k: int, blocks: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(query_id, id, vector_score): each query's k nearest by dot product, over 0 and at most 1; ``blocks``: those of ``docs``, where they are made already."""
    return largest_products(blocks or vector_blocks(docs), queries, k, most=1.0)


def candidate_scores(keyword: DataFrame, docs: DataFrame, queries: DataFrame, candidates: int = CANDIDATES, blocks: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(query_id, id, vector_score): of every pair that either retriever may put forward, exact.

    These are the vector scores that ``hybrid`` reads, without those of all other pairs:
    each query's best by dot product, and its best by keyword whatever their dot product.
    """
    near = dense_scores(docs, queries, candidates, blocks)
    pairs = top_per_query(keyword, "keyword_score", candidates).select("query_id", "id").join(near.select("query_id", "id"), ["query_id", "id"], "left_anti")
    met = pairs.join(docs.select("id", "v"), "id").join(queries.select(F.col("id").alias("query_id"), F.col("v").alias("qv")), "query_id")
    dot = F.aggregate(F.zip_with("v", "qv", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return near.union(met.select("query_id", "id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot)).alias("vector_score")))


def retrieve(index: DataFrame, queries: DataFrame, docs: DataFrame, vectors: DataFrame, top_k: int = 8, candidates: int = CANDIDATES, vocab: DataFrame | None = None) -> DataFrame:
    """``hybrid`` from an index (id, term, weight), or documents with the numbered terms of ``vocab``, and vectors (id, v), for many queries that have both.

    Each retriever finds its best by its own bounds, and only the candidates of either get
    both exact scores: no document meets a query for a shared word alone. A document without a vector has
    the vector score 0, as a query without one.
    """
    words = keyword_top_k(index, queries, candidates, None if vocab is None else numbered(vocab)[0])
    near = dense_scores(docs, vectors, candidates)
    pairs = cut(words.select("query_id", "id").union(near.select("query_id", "id")).distinct())
    met = pairs.join(docs.select("id", "v"), "id").join(vectors.select(F.col("id").alias("query_id"), F.col("v").alias("qv")), "query_id")
    dot = F.aggregate(F.zip_with("v", "qv", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    vector = met.select("query_id", "id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot)).alias("vector_score"))
    if vocab is not None:
        index = entry_rows(index.join(pairs.select("id").distinct(), "id", "left_semi"), vocab)  # of candidates alone
    return hybrid(pair_scores(index, queries, pairs), vector, top_k, candidates)


def hybrid(keyword: DataFrame, vector: DataFrame, top_k: int = 8, candidates: int = CANDIDATES, weights: tuple[float, float] = (VECTOR_WEIGHT, KEYWORD_WEIGHT), maximum: int = 12) -> DataFrame:
    """(query_id, rank, id, hybrid_score, vector_score, keyword_score).

    Candidates are the union of both retrievers' best; each keeps both of its scores, so
    ``keyword`` and ``vector`` are all scores, not only the best.
    """
    if not 1 <= top_k <= maximum:
        raise ValueError(f"top_k must be 1 to {maximum}")
    ids = top_per_query(keyword, "keyword_score", candidates).select("query_id", "id").union(top_per_query(vector, "vector_score", candidates).select("query_id", "id")).distinct()
    d = ids.join(keyword, ["query_id", "id"], "left").join(vector, ["query_id", "id"], "left").fillna(0.0, ["keyword_score", "vector_score"])
    d = d.withColumn("hybrid_score", F.lit(weights[0]) * F.col("vector_score") + F.lit(weights[1]) * F.col("keyword_score")).where("hybrid_score > 0")
    w = W.partitionBy("query_id").orderBy(*[F.desc(F.round(c, PLACES)) for c in ("hybrid_score", "vector_score", "keyword_score")], "id")
    return d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k).select("query_id", "rank", "id", "hybrid_score", "vector_score", "keyword_score")


def table_identity(df: DataFrame) -> DataFrame:
    """(rows, identity): an order-free fingerprint of a table's content, for checks on load. A sum, so that rows that stand twice count twice."""
    h = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(h.cast("decimal(20,0)")), F.lit(0)).cast("string").alias("identity"))


#: Ranges of keys that an identity is kept for: two to this power.
LEAF_BITS = 10


def leaf(key: Column) -> Column:
    """The range of hashed keys that a row belongs to."""
    return F.shiftrightunsigned(F.xxhash64(key), 64 - LEAF_BITS).cast("int")


def identity_leaves(df: DataFrame, key: str) -> DataFrame:
    """(leaf, rows, identity): ``table_identity`` of each range of keys; bounded, whatever the table. Rows of one key share a leaf."""
    h = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    return df.groupBy(leaf(F.col(key)).alias("leaf")).agg(F.count(F.lit(1)).alias("rows"), F.sum(h.cast("decimal(20,0)")).cast("string").alias("identity"))


def changed_leaves(saved: DataFrame, found: DataFrame) -> list[int]:
    """Ranges that hold other rows than when they were saved, fewer or more of them included."""
    a, b = saved.select("leaf", "rows", "identity"), found.select("leaf", F.col("rows").alias("__n"), F.col("identity").alias("__i"))
    d = a.join(b, "leaf", "full_outer").where(~(F.col("rows").eqNullSafe(F.col("__n")) & F.col("identity").eqNullSafe(F.col("__i"))))
    return sorted(r["leaf"] for r in d.select("leaf").collect())  # as many as leaves at most
