"""Keyword retrieval over shards of documents: posting blocks in the order of their impact, with an exact early stop."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Documents, and entries of them, of a shard: what a task holds at once. Postings of a block.
SHARD_DOCS, SHARD_ENTRIES, BLOCK = 20_000, 1_000_000, 64
#: Documents of a batch that are looked through at a time.
STEP = 1_000
#: Postings of largest reach read for each wanted document before the first threshold is taken.
SEED = 8
#: Queries that are broadcast at a time.
QUERY_PART = 10_000
#: Scores that differ by less are equal: sums of floats have no order.
PLACES = 9
_SLACK = 2.0 * 10**-PLACES
#: Rows of a table up to which it is broadcast; more are joined by shuffle.
BROADCAST_ROWS = 200_000


def _few(d: DataFrame) -> DataFrame:
    return F.broadcast(d) if d.count() <= BROADCAST_ROWS else d


def best(scores: DataFrame, k: int, score: str = "keyword_score") -> DataFrame:
    """The k best of each query with a score over 0; equal ones (to ``PLACES`` places) by the smaller id."""
    w = W.partitionBy("query_id").orderBy(F.desc(F.round(score, PLACES)), "id")
    return scores.where(F.col(score) > 0).withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k).drop("__r")


def pair_scores(index: DataFrame, queries: DataFrame, pairs: DataFrame) -> DataFrame:
    """(query_id, id, keyword_score) of the given pairs, exact; a pair without a common term has no row.

    Pairs come to the index by document, then the query's weights by term; only pairs are summed.
    """
    q = queries.select(F.col("id").alias("query_id"), "term", F.col("weight").alias("qw"))
    met = index.join(_few(pairs.select("query_id", "id")), "id").join(_few(q), ["query_id", "term"])
    return met.groupBy("query_id", "id").agg(F.sum(F.col("weight") * F.col("qw")).alias("keyword_score"))


class Shard:
    """Postings of some documents: a term's by falling weight in blocks, whose first weight none of them exceeds."""

    def __init__(self, n_docs: int, doc: np.ndarray, term: np.ndarray, weight: np.ndarray, block: int = BLOCK):
        self.n_docs, self.block = n_docs, block
        order = np.lexsort((doc, -weight, term))
        self.doc, self.weight, term = doc[order], weight[order], term[order]
        self.terms, self.first, self.count = np.unique(term, return_index=True, return_counts=True)
        key = term * n_docs + self.doc
        by_key = np.argsort(key)
        self.key, self.of_key = key[by_key], self.weight[by_key]
        self.read = self.met = 0  # blocks, over all queries

    def exact(self, docs: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Whole scores of the given documents."""
        want = terms[:, None] * self.n_docs + docs[None, :]
        at = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
        return weights @ np.where(self.key[at] == want, self.of_key[at], 0.0)

    def _postings(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        n = stop - start
        end = np.cumsum(n)
        return np.arange(end[-1] if len(end) else 0) - np.repeat(end - n - start, n)

    def top(self, terms: np.ndarray, weights: np.ndarray, k: int, floor: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of those that may be among a query's k best, all of these k with them; ``floor``: scores under it are of no use.

        Blocks are read by falling reach (bound times the query's weight). What an unread block
        can still add to a document is the reach of its term's first unread block; once these
        add up to less than the floor, a document not met yet can't reach it. The floor is the larger of
        the given one and the k-th exact score among the documents of the first blocks.
        """
        slot = np.searchsorted(self.terms, terms)
        there = (slot < len(self.terms)) & (weights > 0)
        there[there] = self.terms[slot[there]] == terms[there]
        slot, terms, weights = slot[there], terms[there], weights[there]
        if not len(slot):
            return np.zeros(0, np.int64), np.zeros(0)
        n_blocks = -(-self.count[slot] // self.block)
        edge = np.cumsum(n_blocks)
        own = np.repeat(np.arange(len(slot)), n_blocks)
        start = self.first[slot][own] + (np.arange(edge[-1]) - np.repeat(edge - n_blocks, n_blocks)) * self.block
        stop = np.minimum(start + self.block, (self.first + self.count)[slot][own])
        reach = self.weight[start] * weights[own]
        after = np.append(reach[1:], 0.0)
        after[edge - 1] = 0.0  # what the term can add once the block is read
        order = np.argsort(-reach, kind="stable")
        self.met += len(order)
        whole = reach[edge - n_blocks].sum()
        if whole < floor:
            return np.zeros(0, np.int64), np.zeros(0)
        seed = order[: int(np.searchsorted(np.cumsum((stop - start)[order]), SEED * k)) + 1]
        tried = np.unique(self.doc[self._postings(start[seed], stop[seed])])
        if len(tried) >= k:
            floor = max(floor, float(np.partition(self.exact(tried, terms, weights), -k)[-k]) - _SLACK)
        rest = whole - np.cumsum((reach - after)[order])
        enough = np.flatnonzero(rest < floor)
        n_read = int(enough[0]) + 1 if len(enough) else len(order)
        some = order[:n_read]
        at = self._postings(start[some], stop[some])
        part = np.bincount(self.doc[at], weights=self.weight[at] * np.repeat(weights[own][some], (stop - start)[some]), minlength=self.n_docs)
        left = max(float(rest[n_read - 1]), 0.0) if n_read < len(order) else 0.0
        docs = np.flatnonzero((part > 0) & (part + left >= floor))
        unread = int((stop - start)[order[n_read:]].sum())
        if n_read == len(order):
            scores = part[docs]
        elif len(docs) * len(terms) <= unread:
            scores = self.exact(docs, terms, weights)
        else:  # cheaper to read on than to look up
            n_read, more = len(order), order[n_read:]
            at = self._postings(start[more], stop[more])
            scores = (part + np.bincount(self.doc[at], weights=self.weight[at] * np.repeat(weights[own][more], (stop - start)[more]), minlength=self.n_docs))[docs]
        self.read += n_read
        good = scores >= floor
        return docs[good], scores[good]


class Running:
    """A task's k best documents of each query so far."""

    def __init__(self, n_queries: int, k: int):
        self.k, self.held = k, [[] for _ in range(n_queries)]

    def floor(self, q: int) -> float:
        return self.held[q][-1][2] - _SLACK if len(self.held[q]) == self.k else 0.0

    def add(self, q: int, ids: list, docs: np.ndarray, scores: np.ndarray) -> None:
        rounded = scores.round(PLACES)
        # document numbers are in the order of ids
        keep = np.lexsort((docs, -rounded))[: self.k]
        self.held[q] = sorted(self.held[q] + [(-r, ids[i], s) for r, i, s in zip(rounded[keep].tolist(), docs[keep].tolist(), scores[keep].tolist(), strict=True)])[: self.k]


def keyword_top_k(index: DataFrame, queries: DataFrame, k: int, names: list[str] | None = None) -> DataFrame:
    """(query_id, id, keyword_score): the k best documents of each query, the same as from the scores of all documents.

    ``index`` and ``queries`` are (id, term, weight), weights over 0; an index may also be the
    documents (id, cols, weights), terms by their number in ``names``, which are read without a shuffle. A document's entries for the
    terms that are asked for come together in one row; tasks hold documents a shard at a time and answer the
    queries (a part of them, by hash, is broadcast at a time) from the shard's posting blocks, carrying
    each query's k best along as the floor for the next shard. Only k rows a query leave a
    task, so no pair of a query and a document is shuffled for a shared word. A query without
    a common term has no rows; no documents or no queries: no rows.
    """
    kinds = dict(index.dtypes)["id"], dict(queries.dtypes)["id"]
    schema = f"query_id {kinds[1]}, id {kinds[0]}, keyword_score double"
    parts = max(1, -(-queries.select("id").distinct().count() // QUERY_PART))
    found = None
    for i in range(parts):
        q = queries.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == i).select("id", "term", "weight").toPandas()
        part = _from_shards(index, q, k, schema, names)
        found = part if found is None else found.union(part)
    return best(found, k)


def _from_shards(index: DataFrame, q, k: int, schema: str, names: list[str] | None) -> DataFrame:
    spark = index.sparkSession
    terms, code = np.unique(q["term"].to_numpy(dtype=object), return_inverse=True) if len(q) else (np.zeros(0, object), np.zeros(0, np.int64))
    asked = [(name, code[at], q["weight"].to_numpy(np.float64)[at]) for name, at in q.groupby("id").indices.items()]
    if names is None:
        wanted = spark.createDataFrame([(t,) for t in terms.tolist()], "term string")
        e = index.join(F.broadcast(wanted), "term", "left_semi").where("weight > 0")  # terms of a part of the queries
        docs = e.groupBy("id").agg(F.collect_list(F.struct("term", "weight")).alias("e")).select("id", F.col("e.term").alias("terms"), F.col("e.weight").alias("weights"))
        known = pa.array(terms.tolist(), pa.string())
    else:
        docs, number = index.select("id", F.col("cols").alias("terms"), "weights"), {t: i for i, t in enumerate(names)}
        known = pa.array([number.get(t) for t in terms.tolist()], pa.int32())
    shared = spark.sparkContext.broadcast((known, asked))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, asked = shared.value
        kept = Running(len(asked), k)
        held: list[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]] = []

        def answer() -> None:
            ids = pa.concat_arrays([h[0] for h in held])
            order = pc.sort_indices(ids).to_numpy()
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))  # documents are numbered in the order of their ids
            first = np.cumsum([0, *[len(h[0]) for h in held]])
            doc = place[np.concatenate([h[1] + f for h, f in zip(held, first, strict=False)])]
            shard, names = Shard(len(order), doc, *(np.concatenate([h[i] for h in held]) for i in (2, 3))), ids.take(pa.array(order)).to_pylist()
            for j, (_, code, w) in enumerate(asked):
                docs, scores = shard.top(code, w, k, kept.floor(j))
                if len(docs):
                    kept.add(j, names, docs, scores)

        entries = 0
        for b in it:
            for at in range(0, b.num_rows, min(STEP, SHARD_DOCS)):
                x = b.slice(at, min(STEP, SHARD_DOCS))
                term = pc.fill_null(pc.index_in(x.column("terms").flatten(), known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                weight = x.column("weights").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                doc = np.repeat(np.arange(x.num_rows), pc.list_value_length(x.column("terms")).to_numpy(zero_copy_only=False))
                there = (term >= 0) & (weight > 0)
                held.append((x.column("id"), doc[there], term[there], weight[there]))
                entries += int(there.sum())
                if sum(len(h[0]) for h in held) >= SHARD_DOCS or entries >= SHARD_ENTRIES:
                    if entries:
                        answer()
                    held.clear()
                    entries = 0
        if entries:
            answer()
        rows = [(asked[j][0], i, s) for j, h in enumerate(kept.held) for _, i, s in h]
        if rows:
            qs, ids, scores = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([x.item() if hasattr(x, "item") else x for x in qs]), pa.array(ids), pa.array(scores, pa.float64())], names=["query_id", "id", "keyword_score"])

    return docs.mapInArrow(run, schema)
