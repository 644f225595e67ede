"""Alignment of two tokenizers over the bytes of every document, by elementary intervals."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import SLICE, release, text_slices, written
from millrace.llm.packing import tokenizer_path

#: Chunks, and links of chunks, that a worker remembers before it forgets all but the most used; the share of both that it keeps.
CACHED_CHUNKS, CACHED_LINKS, KEPT = 400_000, 4_000_000, 0.4
#: Code points of new chunks that are encoded in one call.
JOINED = 1 << 16
#: Links of a block of documents, and different id pairs of one, at which the next block begins (a document is never parted).
BLOCK_LINKS, BLOCK_PAIRS = 4_000_000, 1_000_000


@dataclass
class Links:
    """Alignment of one byte string under two tokenizers."""

    pairs: np.ndarray  # code of the id pair of each elementary interval
    shared: np.ndarray  # whether the interval ends where tokens of both end
    groups: str
    group_chars: np.ndarray  # code points of each group in it, with the sign after it
    ends: np.ndarray  # where each interval ends
    ends_a: np.ndarray
    ends_b: np.ndarray


class Aligner:
    """Both tokenizers, and the alignments of the chunks met so far.

    A chunk is a space and what follows up to the next space that stands behind a sign which
    isn't white space. Neither tokenizer has a token across such a place (A cuts there before
    it merges, B has no piece with a space behind another sign), so both have an end there:
    chunks are aligned on their own, once each, and a document is the run of its chunks.
    """

    _cut = re.compile(r"(?<=\S) ")
    _odd = re.compile(r"  |[^\S ] ")

    def __init__(self, a_path: str, b_path: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=b_path)
        # byte-level letters: printable bytes stand for themselves, the others for code points from 256 on, in order
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(x): x for x in plain} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in plain)}
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.bytes_a[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.len_a, self.len_b = (np.array([len(x) for x in t], dtype=np.int64) for t in (self.bytes_a, self.bytes_b))
        #: A code is a's id times this, and b's id.
        self.wide = len(self.bytes_b)
        self.joins = not any("▁" in p.lstrip("▁") for p in pieces)
        # as they are written inside a group, and at its end
        self.said_a, self.said_b = (np.array([f"{i}{c}" for c in ends for i in range(n)], dtype=object) for ends, n in ((",|", len(self.bytes_a)), (",;", self.wide)))
        self.raw_a, self.raw_b = (np.array([*t, b""], dtype=object)[:-1] for t in (self.bytes_a, self.bytes_b))
        self.row: dict[str, int] = {}
        self.names: list[str] = []
        self.text: list[str] = []
        self.counts, self.pairs, self.uses = np.zeros((0, 4), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.new_counts: list[np.ndarray] = []
        self.new_pairs: list[np.ndarray] = []

    def forget(self) -> None:
        """Keeps the most used chunks, up to their share of both bounds."""
        links = self.counts[:, 3]
        order = np.argsort(-self.uses, kind="stable")[: int(KEPT * CACHED_CHUNKS)]
        keep = np.sort(order[np.cumsum(links[order]) <= KEPT * CACHED_LINKS])
        begin = (np.cumsum(links) - links)[keep]
        n = links[keep]
        end = np.cumsum(n)
        self.pairs = self.pairs[np.arange(end[-1] if len(end) else 0) - np.repeat(end - n - begin, n)]
        self.counts, self.uses = self.counts[keep], self.uses[keep] // 2
        self.names, self.text = [self.names[k] for k in keep.tolist()], [self.text[k] for k in keep.tolist()]
        self.row = {c: k for k, c in enumerate(self.names)}

    # ------------------------------------------------------------ one string

    def links(self, text: str) -> Links | None:
        """The alignment of a space and ``text``, or None if a tokenizer doesn't give its bytes back."""
        whole = (" " + text).encode()
        ia = np.array(self.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids, dtype=np.int64)
        ib = np.array(self.b.encode(text), dtype=np.int64)
        if b"".join(self.raw_a[ia].tolist()) != whole or b"".join(self.raw_b[ib].tolist()) != whole:
            return None
        ends_a, ends_b = np.cumsum(self.len_a[ia]), np.cumsum(self.len_b[ib])
        # between neighbouring ends of either lies one token of each: an elementary interval, one overlap
        ends = np.union1d(ends_a, ends_b)
        own_a, own_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
        shared = (ends_a[own_a] == ends) & (ends_b[own_b] == ends)
        # the text of the groups: A's ids of a group, then B's, each with the sign behind it
        last_a, last_b = np.isin(ends_a, ends[shared]), np.isin(ends_b, ends[shared])
        group = np.concatenate([np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b])
        said = np.concatenate([self.said_a[ia + last_a * len(self.bytes_a)], self.said_b[ib + last_b * self.wide]])[np.argsort(group, kind="stable")].tolist()
        size = np.fromiter(map(len, said), np.int64, len(said))
        per_group = np.bincount(np.sort(group), weights=size, minlength=int(shared.sum())).astype(np.int64)
        return Links(ia[own_a] * self.wide + ib[own_b], shared, "".join(said), per_group, ends, ends_a, ends_b)

    # ------------------------------------------------------------ chunks

    def chunks(self, text: str) -> list[str]:
        """What a space and ``text`` is cut into, each without its first space."""
        line = " " + text
        if not self.joins:
            return [text]
        if not self._odd.search(line):
            return text.split(" ")
        cut = self._cut.split(line)
        cut[0] = cut[0][1:]
        return cut

    def _learn(self, fresh: list[str]) -> None:
        """Aligns new chunks: those that can stand in a row in one call, others one by one."""
        held, n = [], 0
        for c in fresh:
            if "▁" in c:  # B reads it as a space
                self.row[c] = -1
            elif self.joins and c and not c[-1].isspace():
                held.append(c)
                n += len(c)
                if n >= JOINED:
                    self._learn_row(held)
                    held, n = [], 0
            else:
                self._learn_row([c])
        if held:
            self._learn_row(held)

    def _learn_row(self, row: list[str]) -> None:
        found = self.links(" ".join(row))
        size = np.array([len(c.encode()) + 1 for c in row], dtype=np.int64)
        edge = np.cumsum(size)
        if found is None or not np.isin(edge, found.ends[found.shared]).all():
            if len(row) > 1:
                self._learn_row(row[: len(row) // 2])
                self._learn_row(row[len(row) // 2 :])
            else:
                self.row[row[0]] = -1
            return
        per = lambda ends: np.diff(np.searchsorted(ends, edge, side="right"), prepend=0)
        n_groups = per(found.ends[found.shared])
        to = np.cumsum(found.group_chars)[np.cumsum(n_groups) - 1].tolist()
        first = len(self.text)
        self.text += [found.groups[x : y - 1] for x, y in zip([0, *to[:-1]], to, strict=True)]
        self.names += row
        self.row.update(zip(row, range(first, len(self.text)), strict=True))
        self.new_counts.append(np.stack([per(found.ends_a), per(found.ends_b), n_groups, per(found.ends)], axis=1))
        self.new_pairs.append(found.pairs)

    # ------------------------------------------------------------ documents

    def align(self, texts: list[str]) -> list[tuple]:
        """(n_a, n_b, n_groups, n_links, groups_sha256, distinct codes in order, their links) of each text."""
        if len(self.names) > CACHED_CHUNKS or len(self.pairs) > CACHED_LINKS:
            self.forget()
        cut = [self.chunks(t) if t else [] for t in texts]
        self._learn(list({c for x in cut for c in x}.difference(self.row)))
        if self.new_counts:
            self.counts, self.pairs = np.concatenate([self.counts, *self.new_counts]), np.concatenate([self.pairs, *self.new_pairs])
            self.new_counts, self.new_pairs = [], []
        counts, pairs = self.counts, self.pairs
        begin = np.cumsum(counts[:, 3]) - counts[:, 3]
        get, text, out, sound = self.row.__getitem__, self.text.__getitem__, [], []
        rows: list[list[int]] = []
        for t, x in zip(texts, cut, strict=True):
            r = list(map(get, x))
            whole = bool(r) and min(r) >= 0
            sound.append(whole)
            rows.append(r if whole else [])
            out.append(None if whole or not t else self._alone(t))
        flat = np.array([i for r in rows for i in r], dtype=np.int64)
        self.uses = np.concatenate([self.uses, np.zeros(len(counts) - len(self.uses), np.int64)]) + np.bincount(flat, minlength=len(counts))
        edge = np.cumsum([0, *map(len, rows)])
        total = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(counts[flat], axis=0)])[edge]
        sums = np.diff(total, axis=0)
        n = counts[flat, 3]
        end = np.cumsum(n)
        codes = pairs[np.arange(end[-1] if len(end) else 0) - np.repeat(end - n - begin[flat], n)]
        # distinct codes by document: one sort of (document, code)
        doc = np.repeat(np.arange(len(rows)), sums[:, 3])
        key, mult = np.unique((doc.astype(np.int64) << 32) | codes, return_counts=True)
        at = np.searchsorted(key, np.arange(len(rows) + 1, dtype=np.int64) << 32)
        key &= (1 << 32) - 1
        done = []
        for k, r in enumerate(rows):
            if sound[k]:
                sha = hashlib.sha256(";".join(map(text, r)).encode()).hexdigest()
                done.append((*sums[k].tolist(), sha, key[at[k] : at[k + 1]], mult[at[k] : at[k + 1]]))
            else:
                done.append(out[k] or _NONE)
        return done

    def _alone(self, text: str) -> tuple | None:
        """A text with a chunk that doesn't give its bytes back, looked at as a whole."""
        x = self.links(text)
        if x is None:
            return None
        codes, mult = np.unique(x.pairs, return_counts=True)
        sha = hashlib.sha256(x.groups[:-1].encode()).hexdigest()
        return len(x.ends_a), len(x.ends_b), int(x.shared.sum()), len(x.pairs), sha, codes, mult


_NONE = (0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64))

_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    """The worker's aligner of two vocabulary files, made once."""
    if (a_path, b_path) not in _aligners:
        _aligners[a_path, b_path] = Aligner(a_path, b_path)
    return _aligners[a_path, b_path]


# ---------------------------------------------------------------- on tables

_ALIGNED = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, codes binary, mult binary, all_codes binary, all_docs binary"
_CODE, _MULT, _DOCS = "<u4", "<u4", "<u4"


class _Block:
    """Id pairs of the documents of a block, and how many of its documents hold each."""

    def __init__(self):
        self.codes, self.docs, self.links, self.fresh, self.n_fresh = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, [], 0

    def add(self, codes: np.ndarray, links: int) -> None:
        self.fresh.append(codes)
        self.n_fresh += len(codes)
        self.links += links
        if self.n_fresh >= SLICE:
            self.settle()

    def settle(self) -> None:
        if self.n_fresh:
            new, n = np.unique(np.concatenate(self.fresh), return_counts=True)
            both = np.union1d(self.codes, new)
            docs = np.zeros(len(both), np.int64)
            docs[np.searchsorted(both, self.codes)] += self.docs
            docs[np.searchsorted(both, new)] += n
            self.codes, self.docs, self.fresh, self.n_fresh = both, docs, [], 0

    @property
    def full(self) -> bool:
        return self.links >= BLOCK_LINKS or len(self.codes) + self.n_fresh >= 2 * BLOCK_PAIRS


def aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Rows of documents with their distinct id pairs, and for each block one row with its own: a document is encoded once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        both, number = aligner(a_path, b_path), TaskContext.get().partitionId() << 24
        block = _Block()

        def closing() -> pd.DataFrame:
            block.settle()
            row = {c.split()[0]: [None] for c in _ALIGNED.split(", ")}
            return pd.DataFrame(row | {"block": [number], "all_codes": [block.codes.astype(_CODE).tobytes()], "all_docs": [block.docs.astype(_DOCS).tobytes()]})

        open_ = False
        for batch in batches:
            ids, at = batch["doc_id"].to_numpy(dtype=object), 0
            for part in text_slices(batch["text"]):
                rows = []
                for doc_id, (*n, sha, codes, mult) in zip(ids[at : at + len(part)], both.align(part), strict=True):
                    block.add(codes, n[3])
                    rows.append((number, None if pd.isna(doc_id) else int(doc_id), *n, sha, codes.astype(_CODE).tobytes(), mult.astype(_MULT).tobytes(), None, None))
                    open_ = True
                at += len(part)
                frame = pd.DataFrame(rows, columns=[c.split()[0] for c in _ALIGNED.split(", ")])
                frame["doc_id"] = frame["doc_id"].astype("Int64")
                yield frame
                if block.full:
                    yield closing()
                    block, open_ = _Block(), False
                    number += 1
        if open_:
            yield closing()
        release()

    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).mapInPandas(run, _ALIGNED)


def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Alignment counts of each document, and how common its links are in the corpus: columns of ``op13_alignment``.

    Each text is encoded by both tokenizers once. The ends of all tokens of either, united,
    bound elementary intervals; a search for each interval's owners gives the pair of tokens
    that overlaps there, and an end that both share closes a group. Documents are dealt into
    blocks of bounded size in the order in which tasks read them. A block tells each of its
    different id pairs once, with the number of its documents that hold it; sums over all
    blocks are joined back to the blocks that told the pair, so what is shuffled grows with
    blocks times their different pairs, never with links, and nothing is broadcast but one
    number for each id of A.

    Rows are documents: repeated rows count as often as they stand there. A null or empty
    text, and one that a tokenizer doesn't give back byte for byte (a literal U+2581, which
    B reads as a space), has no tokens: zeros and ''. A null id stays null. Texts of any
    length are aligned whole. No rows: no rows. Extra columns are not read.
    """
    table = written(aligned(docs, a_path, b_path))
    wide = aligner(a_path, b_path).wide

    def told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for block, codes, n in zip(b["block"], b["all_codes"], b["all_docs"], strict=True):
                codes = np.frombuffer(codes, _CODE).astype(np.int64)
                yield pd.DataFrame({"block": np.full(len(codes), block), "code": codes, "docs": np.frombuffer(n, _DOCS).astype(np.int64)})

    pairs = table.where("all_codes is not null").select("block", "all_codes", "all_docs").mapInPandas(told, "block long, code long, docs long")
    counts = written(pairs.groupBy("code").agg(F.sum("docs").alias("n")))
    of_a = F.expr(f"code div {wide}")
    best = counts.groupBy(of_a.alias("a")).agg(F.max("n").alias("most"))  # one row for each id of A at most
    counts = counts.withColumn("a", of_a).join(F.broadcast(best), "a").select("code", "n", (F.col("n") == F.col("most")).alias("best"))
    answers = pairs.select("block", "code").join(counts, "code").select("block", "code", "n", "best")
    own = table.where("all_codes is null").drop("all_codes", "all_docs")

    def score(answer: pa.Table, docs: pa.Table) -> pa.Table:
        code, n, best = (answer[c].to_numpy() for c in ("code", "n", "best"))
        order = np.argsort(code)
        code, n, best = code[order], n[order], best[order].astype(np.int64)
        codes = np.frombuffer(b"".join(docs["codes"].to_pylist()), _CODE).astype(np.int64)
        mult = np.frombuffer(b"".join(docs["mult"].to_pylist()), _MULT).astype(np.int64)
        edge = np.concatenate([[0], np.cumsum([len(x) // 4 for x in docs["codes"].to_pylist()], dtype=np.int64)])
        at = np.searchsorted(code, codes)
        by_doc = lambda x: np.diff(np.concatenate([[0], np.cumsum(x, dtype=np.int64)])[edge])
        out = docs.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
        out = out.append_column("n_best", pa.array(by_doc(best[at] * mult), pa.int64())).append_column("count_sum", pa.array(by_doc(n[at] * mult), pa.int64()))
        return out.append_column("groups_sha256", docs["groups_sha256"])

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return answers.groupBy("block").cogroup(own.groupBy("block")).applyInArrow(score, schema)


def op13_alignment(docs: DataFrame) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each document.

    A is the byte-level BPE of 50,257 ids over a space and the text, B the BPE by pieces of
    32,000 ids. Odd rows: as ``align`` says.
    """
    return align(docs, tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
