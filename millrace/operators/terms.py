"""Terms counted where the texts are: the vocabulary behind a counting filter, documents as rows of numbered terms. No term of a text is shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import word_tokens
from millrace.plans.tables import cut
from millrace.session import spread

#: Tokens that are counted at a time (a longer document alone).
SLICE = 200_000
#: Buckets of each of the filter's two rows: two to this power. Buckets that travel in one row.
BUCKET_BITS, CHUNK = 20, 4_096
#: Buckets that the first threshold lets through, for each wanted term.
SPARE = 1.5
#: Terms that documents are numbered with, at most: their table is held in tasks and on the driver.
MOST_TERMS = 100_000


def by_id(docs: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame | None]:
    """(rows whose id stands once, rows of ids that stand repeatedly, if there are any); only ids are shuffled."""
    twice = docs.groupBy(F.col(id_col).alias("__id")).count().where("count > 1").select("__id")
    if twice.isEmpty():
        return docs, None
    twice = cut(twice)
    same = F.col(id_col).eqNullSafe(F.col("__id"))
    return docs.join(twice, same, "left_anti"), docs.join(twice, same, "left_semi")


def _tokens(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    return spread(docs.select(F.col(id_col).alias("id"), F.col(text).alias("t"))).select("id", F.coalesce(word_tokens(F.col("t")), F.array().cast("array<string>")).alias("k"))


def _slices(it: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[pa.Array, np.ndarray, pa.Array]]:
    """(ids, row of each token, tokens), ``most`` tokens of whole documents at a time (a longer document alone)."""
    for b in it:
        ids, k = b.column("id"), b.column("k")
        edge, a = k.offsets.to_numpy(), 0
        while a < len(ids):
            z = max(a + 1, int(np.searchsorted(edge, edge[a] + most, side="right")) - 1)
            yield ids.slice(a, z - a), np.repeat(np.arange(z - a), np.diff(edge[a : z + 1])), k.values.slice(edge[a], edge[z] - edge[a])
            a = z


def _coded(row: np.ndarray, tokens: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """(distinct words, code of each token, places of tokens with a neighbour in their document, hash of each term: tokens, then these pairs)."""
    d = tokens.dictionary_encode()
    words, code = d.dictionary.to_pylist(), d.indices.to_numpy()
    pair = np.flatnonzero(row[1:] == row[:-1])
    h = pd.util.hash_array(np.array(words, dtype=object), categorize=False)[code] if words else np.zeros(0, np.uint64)
    both = h[pair] * np.uint64(0x9E3779B97F4A7C15) + (h[pair + 1] ^ np.uint64(0xC2B2AE3D27D4EB4F))
    both = (both ^ (both >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return words, code, pair, np.concatenate([h, both ^ (both >> np.uint64(32))])


def _buckets(h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each hash its bucket in either row, of ``n`` (a power of two)."""
    return (h >> np.uint64(65 - n.bit_length())).astype(np.int64), (h & np.uint64(n - 1)).astype(np.int64)


def bucket_totals(tokens: DataFrame) -> np.ndarray:
    """Two rows of buckets by hash of the term: how many terms of all texts fell into each, so that a term stands no oftener than its bucket says. Bounded, whatever the texts."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 << BUCKET_BITS), np.int64)
        for _, row, t in _slices(it, SLICE):
            for i, x in enumerate(_buckets(_coded(row, t)[-1], total.shape[1])):
                total[i] += np.bincount(x, minlength=total.shape[1])
        flat = total.reshape(-1, CHUNK)
        used = np.flatnonzero(flat.any(axis=1))
        yield pa.RecordBatch.from_pydict({"at": pa.array(used, pa.int32()), "n": pa.array([flat[i].tobytes() for i in used], pa.binary())})

    def added(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for b in it:
            for at, n in zip(b["at"], b["n"], strict=True):
                total[at] = total.get(at, 0) + np.frombuffer(n, np.int64)
        yield pd.DataFrame({"at": list(total), "n": [n.tobytes() for n in total.values()]})

    out = np.zeros(2 << BUCKET_BITS, np.int64).reshape(-1, CHUNK)
    for r in tokens.mapInArrow(run, "at int, n binary").repartition("at").mapInPandas(added, "at int, n binary").toLocalIterator():  # the filter, 16 MB
        out[r["at"]] = np.frombuffer(r["n"], np.int64)
    return out.reshape(2, -1)


def _frequent(tokens: DataFrame, passed: np.ndarray) -> DataFrame:
    """(term, df, total) of the terms whose buckets passed, exact; each row of ``tokens`` is a document."""
    shared = tokens.sparkSession.sparkContext.broadcast(passed)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, row, t in _slices(it, SLICE):
            words, code, pair, h = _coded(row, t)
            a, b = _buckets(h, shared.value.shape[1])
            ok = np.flatnonzero(shared.value[0][a] & shared.value[1][b])
            n, w = len(code), len(words) + 1
            one, two = ok[ok < n], pair[ok[ok >= n] - n]
            # a pair's key holds the second word's code and one, a single word's a nought
            key = np.concatenate([code[one].astype(np.int64) * w, code[two].astype(np.int64) * w + code[two + 1] + 1])
            term, at, total = np.unique(key, return_inverse=True, return_counts=True)
            rows = int(row[-1]) + 1 if len(row) else 1
            df = np.bincount(np.unique(at * rows + np.concatenate([row[one], row[two]])) // rows, minlength=len(term))
            names = [words[x // w] if not x % w else f"{words[x // w]} {words[x % w - 1]}" for x in term.tolist()]
            yield pa.RecordBatch.from_pydict({"term": pa.array(names, pa.string()), "df": pa.array(df, pa.int64()), "total": pa.array(total, pa.int64())})

    return tokens.mapInArrow(run, "term string, df long, total long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))


def vocabulary_of(docs: DataFrame, id_col: str, text: str, n_docs: int, max_features: int | None = 16_000, min_df: int = 1) -> DataFrame:
    """``retrieval.vocabulary`` of the texts, the same terms and counts, without the counts of all documents.

    A first pass adds up terms in a bounded number of buckets, and a second counts only terms whose
    buckets reach a threshold. If ``max_features`` terms reach it, all others are under it and the result
    is exact; else their least is a threshold that so many are known to reach, and decides a last pass.
    Rows of ids that stand repeatedly are one document, as in ``term_counts``.
    """
    from millrace.operators.retrieval import term_counts

    once, again = by_id(docs, id_col)
    whole = None if again is None else cut(term_counts(again, id_col, text).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total")))
    once = _tokens(once, id_col, text)
    n, least = bucket_totals(_tokens(docs, id_col, text)), 1
    if max_features is not None and int(SPARE * max_features) < n.shape[1]:
        least = max(1, int(np.partition(n[0], -int(SPARE * max_features))[-int(SPARE * max_features)]))
    while True:
        v = _frequent(once, n >= least)
        if whole is not None:
            v = v.unionByName(whole).groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))
        v = v.where(F.col("df") >= min_df)
        v = cut(v if max_features is None else v.orderBy(F.desc("total"), "term").limit(max_features))
        found, last = v.agg(F.count(F.lit(1)), F.min("total")).first()
        if least == 1 or found == max_features and last >= least:
            return v.select("term", "df", (F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + F.col("df"))) + 1.0).alias("idf"))
        least = max(1, int(last)) if found == max_features else 1


def numbered(vocab: DataFrame) -> tuple[list[str], np.ndarray]:
    """The vocabulary's terms in their order, by which they are numbered, and their idf."""
    v = vocab.select("term", "idf").orderBy("term").limit(MOST_TERMS + 1).toPandas()
    if len(v) > MOST_TERMS:
        raise ValueError(f"documents are numbered with {MOST_TERMS} terms at most")
    return v["term"].tolist(), v["idf"].to_numpy(np.float64)


def document_rows(docs: DataFrame, id_col: str, text: str, vocab: DataFrame) -> DataFrame:
    """(id, cols, weights): ``retrieval.tfidf`` with a row for each document that has a term of the vocabulary; terms by their number.

    A map over the texts. Rows of ids that stand repeatedly are put together by a shuffle; a document without an id is in no row.
    """
    from millrace.operators.retrieval import entries, term_counts, tfidf

    terms, idf = numbered(vocab)
    split = [t.split(" ") for t in terms]
    words = sorted({w for s in split for w in s})
    code = {w: i for i, w in enumerate(words)}
    single = np.full(len(words), -1, np.int64)
    for i, s in enumerate(split):
        if len(s) == 1:
            single[code[s[0]]] = i
    pairs = sorted((code[s[0]] * len(words) + code[s[1]], i) for i, s in enumerate(split) if len(s) == 2)
    key, col = np.array([p for p, _ in pairs], np.int64), np.array([i for _, i in pairs], np.int64)
    once, again = by_id(docs, id_col)
    once = _tokens(once.where(F.col(id_col).isNotNull()), id_col, text)
    shared = docs.sparkSession.sparkContext.broadcast((words, single, key, col, idf))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, single, key, col, idf = shared.value
        known, m = pa.array(words, pa.string()), max(1, len(idf))
        for ids, row, t in _slices(it, SLICE):
            code = pc.fill_null(pc.index_in(t, known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            one = np.flatnonzero(code >= 0)
            one = one[single[code[one]] >= 0]
            at = np.flatnonzero((row[1:] == row[:-1]) & (code[1:] >= 0) & (code[:-1] >= 0)) if len(key) else np.zeros(0, np.int64)
            want = code[at] * len(words) + code[at + 1] if len(at) else at
            slot = np.minimum(np.searchsorted(key, want), len(key) - 1)
            hit = key[slot] == want if len(at) else np.zeros(0, bool)
            entry, tf = np.unique(np.concatenate([row[one] * m + single[code[one]], row[at[hit]] * m + col[slot[hit]]]), return_counts=True)
            r, c = entry // m, entry % m
            w = (np.log(tf) + 1.0) * idf[c]
            w /= np.sqrt(np.bincount(r, w * w, len(ids)))[r]
            n = np.bincount(r, minlength=len(ids))
            edge = np.append(0, np.cumsum(n[n > 0])).astype(np.int32)
            yield pa.RecordBatch.from_arrays([ids.filter(pa.array(n > 0)), pa.ListArray.from_arrays(edge, pa.array(c, pa.int32())), pa.ListArray.from_arrays(edge, pa.array(w, pa.float64()))], names=["id", "cols", "weights"])

    rows = once.mapInArrow(run, f"id {dict(once.dtypes)['id']}, cols array<int>, weights array<double>")
    if again is None:
        return rows
    return rows.unionByName(entries(tfidf(term_counts(again.where(F.col(id_col).isNotNull()), id_col, text), vocab), terms))


def entry_rows(rows: DataFrame, vocab: DataFrame) -> DataFrame:
    """(id, term, weight) from documents with numbered terms; a map."""
    terms, _ = numbered(vocab)
    shared = rows.sparkSession.sparkContext.broadcast(terms)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(shared.value, pa.string())
        for b in it:
            for at in range(0, b.num_rows, 1_000):
                x = b.slice(at, 1_000)
                ids = x.column("id").take(pa.array(np.repeat(np.arange(x.num_rows), pc.list_value_length(x.column("cols")).to_numpy(zero_copy_only=False))))
                yield pa.RecordBatch.from_arrays([ids, known.take(x.column("cols").flatten()), x.column("weights").flatten()], names=["id", "term", "weight"])

    return rows.select("id", "cols", "weights").mapInArrow(run, f"id {dict(rows.dtypes)['id']}, term string, weight double")
