"""Packing whole documents by vector best fit: tokens, documents and attention cost of a sequence are all bounded."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.common import release, written
from millrace.llm.packing import encoder, tokenizer_path

WINDOW, END_ID = 4096, 1


@dataclass(frozen=True)
class Capacity:
    """What a sequence holds at most: tokens, documents, and the sum over documents of their squared lengths (attention within documents)."""

    tokens: int = WINDOW
    documents: int = WINDOW
    attention: int = WINDOW * WINDOW

    @property
    def longest(self) -> int:
        """The longest piece that fits alone."""
        return min(self.tokens, math.isqrt(self.attention))

    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.documents, self.attention], dtype=np.int64)


@dataclass
class Placement:
    """Where the r-th piece of each length goes, rows in order of (length, first).

    A row covers ``count`` ranks from ``first`` on, ``each`` of them to a sequence: rank
    first+i lies in sequence ``seq + i // each``, ``offset + (i % each) * length`` from its start.
    """

    length: np.ndarray
    first: np.ndarray
    count: np.ndarray
    each: np.ndarray
    seq: np.ndarray
    offset: np.ndarray
    n_seqs: int


def best_fit(hist: np.ndarray, capacity: Capacity = Capacity(), score: str = "norm") -> Placement:
    """Vector best fit of pieces by falling length; ``hist[l]``: how many pieces have length l.

    Sequences in the same state (what is left of tokens, documents and attention) are one
    class, an interval of sequence numbers, and a length is laid into a whole class at once:
    as many pieces to each of its sequences as fit, as one piece after the other would go.
    Among the classes that hold a piece under every capacity, the one is taken whose
    remainder has the smallest weighted norm once the piece is in (``norm``), or whose
    remainder has the largest weighted dot product with the piece (``dot``); ties go to the
    oldest. Weights are the shares of the capacities that all pieces need together, so the
    scarce one counts. None fits: new sequences are opened. A piece of a length is a row of
    the same table however many there are, so the work depends on the lengths, not on the rows.
    """
    cap = capacity.vector()
    lengths = np.flatnonzero(hist)[::-1]
    lengths = lengths[lengths > 0]
    if len(lengths) and lengths[0] > capacity.longest:
        raise ValueError("a piece is longer than a sequence can hold")
    need = lambda l: np.array([l, 1, l * l], dtype=np.int64)
    total = sum((need(int(l)) * float(hist[l]) / cap for l in lengths), np.zeros(3))
    weight = total / max(total.max(), 1e-300) if len(lengths) else np.ones(3)

    left = np.zeros((0, 3), dtype=np.int64)  # of each class: what is left in a sequence of it
    first, many = np.zeros(0, np.int64), np.zeros(0, np.int64)
    rows: list[tuple[int, int, int, int, int, int]] = []
    n_seqs = 0
    for l in map(int, lengths):
        item, todo, rank = need(l), int(hist[l]), 0
        # what can't hold even the shortest piece is done with
        live = (left >= need(int(lengths[-1]))).all(axis=1)
        left, first, many = left[live], first[live], many[live]
        while todo:
            fits = np.flatnonzero((left >= item).all(axis=1))
            if len(fits):
                rest = left[fits] / cap
                value = ((rest - item / cap) ** 2) @ weight if score == "norm" else -(rest * (item / cap)) @ weight
                at = int(fits[np.lexsort((first[fits], value))[0]])
            else:
                # new sequences, as many as the pieces of this length fill
                each = int((cap // item).min())
                left = np.concatenate([left, cap[None]])
                first, many = np.append(first, n_seqs), np.append(many, -(-todo // each))
                n_seqs += int(many[-1])
                at = len(left) - 1
            each = int((left[at] // item).min())
            full, odd = divmod(min(todo, each * int(many[at])), each)
            state, start, offset = left[at].copy(), int(first[at]), int(cap[0] - left[at][0])
            parts = []  # the class falls apart: sequences with all that fits, one with fewer, the rest
            for k, seqs in ((each, full), (odd, 1 if odd else 0), (0, int(many[at]) - full - bool(odd))):
                if seqs:
                    parts.append((state - k * item, start, seqs))
                    if k:
                        rows.append((l, rank, k * seqs, k, start, offset))
                        rank += k * seqs
                        todo -= k * seqs
                    start += seqs
            keep = np.arange(len(left)) != at
            left = np.concatenate([left[keep], np.array([p[0] for p in parts], dtype=np.int64).reshape(-1, 3)])
            first = np.append(first[keep], [p[1] for p in parts])
            many = np.append(many[keep], [p[2] for p in parts])
    rows.sort()
    return Placement(*np.array(rows, dtype=np.int64).reshape(-1, 6).T, n_seqs=n_seqs)


def fewest(hist: np.ndarray, capacity: Capacity = Capacity()) -> Placement:
    """The better of both scores; ties go to the norm."""
    return min((best_fit(hist, capacity, s) for s in ("norm", "dot")), key=lambda p: p.n_seqs)


# ---------------------------------------------------------------- on tables

_HEADS = "doc_id long, n long, tail long, block long, rank long, tail_crc long, crcs array<long>"


def _encoded(docs: DataFrame, path: str, longest: int, end_id: int) -> DataFrame:
    """Lengths and checksums of the pieces of each document, and its tail's rank among those of the same length that this task has met."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, end = encoder(path), np.array([end_id], dtype="<u4").tobytes()
        block, seen = TaskContext.get().partitionId(), np.zeros(longest, dtype=np.int64)
        for batch in batches:
            n, tail, rank, tail_crc, crcs = [], [], [], [], []
            for ids in enc.encode(batch["text"]):
                ids += end
                k = len(ids) // 4
                full = k // longest * longest * 4
                t = k % longest
                n.append(k)
                tail.append(t)
                rank.append(seen[t])
                seen[t] += 1
                crcs.append([zlib.crc32(ids[i : i + 4 * longest]) for i in range(0, full, 4 * longest)])
                tail_crc.append(zlib.crc32(ids[full:]))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n": n, "tail": tail, "block": block, "rank": rank, "tail_crc": tail_crc, "crcs": crcs})
        release()

    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).mapInPandas(run, _HEADS)


def pack_best_fit(docs: DataFrame, tokenizer: str | None = None, capacity: Capacity = Capacity(), end_id: int = END_ID, score: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): one row per piece.

    A document's ids end with ``end_id``. A document longer than the longest piece that fits
    a sequence alone is cut into such pieces and a last one, which may be shorter; all others
    stay whole. Pieces of full length are sequences of their own. The others are laid by
    ``best_fit`` (by ``score``, or by both and the one with fewer sequences is kept), worked
    out from the histogram of their lengths alone: at most as many numbers as a sequence has
    tokens, whatever the input. Tasks number the pieces of each length as they encode them;
    sums of the tasks before give the number in the whole table, and so the place. Ids never move.

    The placement is broadcast. A sequence holds pieces of at most sqrt(2 x tokens) different
    lengths, and a length opens at most two classes and parts at most one other, so it has
    under 4 x tokens x sqrt(2 x tokens) rows (1.5 million at 4096 tokens) whatever the input,
    some tens of thousands as measured.

    Null or empty text: the one id ``end_id``. Repeated rows are packed as often as they
    stand there. A null id stays null. No rows: no pieces. Extra columns are not read.
    """
    spark, longest = docs.sparkSession, capacity.longest
    heads = written(_encoded(docs, tokenizer or tokenizer_path(), longest, end_id))
    tails = heads.where("tail > 0").select("doc_id", "n", "tail", "block", "rank", "tail_crc")
    before = W.partitionBy("tail").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    counts = tails.groupBy("tail", "block").agg(F.count(F.lit(1)).alias("c"))
    starts = written(counts.withColumn("at", F.coalesce(F.sum("c").over(before), F.lit(0))))
    hist = np.zeros(longest + 1, dtype=np.int64)
    for r in starts.groupBy("tail").agg(F.sum("c").alias("c")).collect():  # at most ``longest`` rows
        hist[r["tail"]] = r["c"]
    plan = best_fit(hist, capacity, score) if score else fewest(hist, capacity)
    table = spark.sparkContext.broadcast(plan)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = table.value
        wide = int((p.first + p.count).max(initial=0) + 1)
        keys = p.length * wide + p.first
        for b in batches:
            tail, rank = b["tail"].to_numpy(np.int64), (b["rank"] + b["at"]).to_numpy(np.int64)
            row = np.searchsorted(keys, tail * wide + rank, side="right") - 1
            q, r = np.divmod(rank - p.first[row], p.each[row])
            start = b["n"].to_numpy(np.int64) - tail
            yield pd.DataFrame({"doc_id": b["doc_id"], "piece": start // longest, "start": start, "length": tail, "ids_crc32": b["tail_crc"], "sequence_id": p.seq[row] + q, "offset": p.offset[row] + r * tail})

    placed = tails.join(starts.select("tail", "block", "at"), ["tail", "block"])
    placed = placed.mapInPandas(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    whole = heads.where("size(crcs) > 0").select("doc_id", F.posexplode("crcs").alias("piece", "crc"))
    whole = whole.select(
        "doc_id", "piece", (F.col("piece").cast("long") * longest).alias("start"), F.lit(longest).cast("long").alias("length"), F.col("crc").alias("ids_crc32"),
        (F.monotonically_increasing_id() + plan.n_seqs).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
    )
    return whole.union(placed)


def op12_best_fit(docs: DataFrame) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece.

    Sequences of 4096 tokens, ids of ``word_bpe_49k.json`` and the end id 1; as many
    documents and as much attention as tokens allow, so that no document is kept out of a
    sequence with room. Odd rows: as ``pack_best_fit`` says.
    """
    return pack_best_fit(docs)
