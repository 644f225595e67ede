"""Packing token sequences by non-negative least squares over length combinations."""

from __future__ import annotations

import itertools
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.common import SLICE, release, text_slices, written

WINDOW = 4096
END_ID = 2
#: Places of a worker's table of pieces, ids it holds, and bytes of a piece that is looked up there.
SLOTS, CACHED_IDS, LONGEST_CACHED = 1 << 20, 3_000_000, 64
#: Chunks of other scripts a worker caches before it starts again.
CACHED_CHUNKS = 60_000
#: Ranks within a length are counted by so many blocks of documents, so that a common length is no hot key.
RANK_BLOCKS = 64
#: Cut documents up to this many are broadcast to find their texts; more are joined by shuffle.
BROADCAST_CUTS = 50_000


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# ---------------------------------------------------------------- tokens


class Encoder:
    """Token ids of whole texts as little-endian 32-bit bytes, cached by the pre-tokenizer's pieces.

    Latin-1 texts are cut into pieces by the classes of their bytes, and pieces are looked up
    by 64-bit hash, all in array operations: a table of ``SLOTS`` places holds where a piece's
    ids lie, a piece that finds its place taken takes it over. Texts of other scripts go by
    white-space chunks, which the pre-tokenizer never joins; control characters that Python
    counts as white space and the tokenizer doesn't, and its special tokens, send a text down
    the plain way.
    """

    _odd = ("<|", "\x1c", "\x1d", "\x1e", "\x1f")
    #: Lower-case Latin-1 by class: white space 0, letters 1, digits 2, marks 3.
    _class = np.array([0 if chr(i).isspace() else 1 if chr(i).isalpha() else 2 if chr(i) in "0123456789²³¹¼½¾" else 3 for i in range(256)], dtype=np.uint8)
    #: Letters that an apostrophe takes with it: one, or these two.
    _one, _two = b"stmd", (b"re", b"ve", b"ll")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        # every piece's last token, and no other, has the end-of-word mark
        self.last = np.zeros(self.tok.get_vocab_size() + 1, dtype=bool)
        mark = self.tok.model.end_of_word_suffix
        self.last[[i for w, i in self.tok.get_vocab().items() if mark and w.endswith(mark)]] = True
        self.value = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)
        self.power, self.inverse = np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)
        self.known: dict[str, bytes] = {}
        self.key, self.used = None, 0

    def plain(self, texts: list[str]) -> list[bytes]:
        return [struct.pack(f"<{len(e)}I", *e.ids) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _fresh(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids in a row, how many of each piece): encoded together, parted at the marks."""
        ids, sizes = [], []
        for at in range(0, len(pieces), 1024):
            part = pieces[at : at + 1024]
            (e,) = self.tok.encode_batch_fast([" ".join(part)], add_special_tokens=False)
            got = np.array(e.ids, dtype="<u4")
            end = np.flatnonzero(self.last[got]) + 1
            if len(end) != len(part) or end[-1] != len(got):
                one = self.plain(part)
                got, end = np.frombuffer(b"".join(one), "<u4"), np.cumsum([len(x) // 4 for x in one])
            ids.append(got)
            sizes.append(np.diff(end, prepend=0))
        return (np.concatenate(ids), np.concatenate(sizes)) if ids else (np.zeros(0, "<u4"), np.zeros(0, np.int64))

    def _cut(self, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each piece of lower-case Latin-1 begins and ends."""
        kind = self._class[buf]
        start = kind > 0
        start[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        # a run of marks that begins with an apostrophe: the letters it takes belong to it, others after them begin anew
        near = np.concatenate([buf, np.zeros(3, np.uint8)])
        p = np.flatnonzero(start & (buf == 39))
        one = np.isin(near[p + 1], np.frombuffer(self._one, np.uint8))
        two = np.zeros(len(p), dtype=bool)
        for x, y in self._two:
            two |= (near[p + 1] == x) & (near[p + 2] == y)
        start = np.append(start, np.zeros(3, dtype=bool))
        kind = np.append(kind, np.zeros(3, dtype=np.uint8))
        for which, wide in ((one, 2), (two, 3)):
            start[p[which] + 1] = False
            start[p[which] + wide] |= kind[p[which] + wide] == 1
        start, kind = start[: len(buf)], kind[: len(buf)]
        bound = np.flatnonzero(start | (kind == 0))
        mine = start[bound]
        return bound[mine], np.append(bound[1:], len(buf))[mine]

    def _hashes(self, buf: np.ndarray, a: np.ndarray, z: np.ndarray) -> np.ndarray:
        """Hash of each buf[a:z]: differences of running sums of byte values times powers, brought to one power."""
        if len(self.power) <= len(buf):
            self.power = np.multiply.accumulate(np.append(np.uint64(1), np.full(len(buf), 0x9E3779B97F4A7C15, dtype=np.uint64)))
            self.inverse = np.multiply.accumulate(np.append(np.uint64(1), np.full(len(buf), pow(0x9E3779B97F4A7C15, -1, 1 << 64), dtype=np.uint64)))
        total = np.append(np.uint64(0), np.cumsum(self.value[buf] * self.power[: len(buf)]))
        h = (total[z] - total[a]) * self.inverse[a]
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(29))

    def _tokens(self, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(where each piece begins, how many ids it has, all ids in order) of lower-case Latin-1."""
        a, z = self._cut(buf)
        if self.key is None or self.used > CACHED_IDS:
            self.key, self.first, self.count = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.int32), np.zeros(SLOTS, np.int32)
            self.flat, self.used = np.zeros(CACHED_IDS + SLICE, dtype="<u4"), 0
        h = self._hashes(buf, a, z)
        slot = (h >> np.uint64(64 - (SLOTS - 1).bit_length())).astype(np.int64)
        first, count = self.first[slot], self.count[slot]
        # hashes stand for short pieces only; long ones are looked at each time
        miss = np.flatnonzero((self.key[slot] != h) | (z - a > LONGEST_CACHED))
        if len(miss):
            _, there, back = np.unique(h[miss], return_index=True, return_inverse=True)
            raw, lone = buf.tobytes(), z[miss] - a[miss] > LONGEST_CACHED
            if lone.any():
                there, back = np.arange(len(miss)), np.arange(len(miss))
            at = miss[there]
            ids, sizes = self._fresh([raw[i:j].decode("latin-1") for i, j in zip(a[at].tolist(), z[at].tolist(), strict=True)])
            if self.used + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat[: self.used], np.zeros(len(ids) + SLICE, dtype="<u4")])
            self.flat[self.used : self.used + len(ids)] = ids
            begin = self.used + np.cumsum(sizes) - sizes
            self.used += len(ids)
            first[miss], count[miss] = begin[back], sizes[back]
            self.key[slot[at]], self.first[slot[at]], self.count[slot[at]] = h[at], begin, sizes
        end = np.cumsum(count, dtype=np.int64)
        return a, count, self.flat[np.arange(end[-1] if len(end) else 0) - np.repeat(end - count - first, count)]

    def _latin(self, texts: list[str]) -> list[bytes]:
        buf = np.frombuffer("\n".join(texts).lower().encode("latin-1"), np.uint8)
        at, starts, counts, tokens = 0, [], [], []
        while at < len(buf):
            end = min(len(buf), at + SLICE)
            if end < len(buf):  # a long text is cut behind white space
                space = np.flatnonzero(self._class[buf[at:end]] == 0)
                if not len(space):
                    space = np.flatnonzero(self._class[buf[end:]] == 0)[:1] + (end - at)
                end = at + int(space[-1]) + 1 if len(space) else len(buf)
            a, n, ids = self._tokens(buf[at:end])
            starts.append(a + at)
            counts.append(n)
            tokens.append(ids)
            at = end
        if not starts:
            return [b""] * len(texts)
        edge = np.cumsum([0, *(len(t) + 1 for t in texts)])
        place = np.concatenate([[0], np.cumsum(np.concatenate(counts), dtype=np.int64)])[np.searchsorted(np.concatenate(starts), edge)]
        every = np.concatenate(tokens)
        return [every[i:j].tobytes() for i, j in zip(place[:-1].tolist(), place[1:].tolist(), strict=True)]

    @staticmethod
    def _is_latin(text: str) -> bool:
        if text.isascii():
            return True
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return False
        return True

    def _by_chunks(self, texts: list[str]) -> list[bytes]:
        cut = [[] if any(x in t for x in self._odd) else t.split() for t in texts]
        missing = list({c for x in cut for c in x}.difference(self.known))
        fresh = dict(zip(missing, self.plain(missing), strict=True))
        get = (self.known | fresh).__getitem__
        out = [b"".join(map(get, x)) if x else self.plain([t])[0] if t else b"" for t, x in zip(texts, cut, strict=True)]
        self.known = self.known if len(self.known) < CACHED_CHUNKS else {}
        self.known.update(itertools.islice(((c, v) for c, v in fresh.items() if len(c) <= LONGEST_CACHED), CACHED_CHUNKS))
        return out

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Each text's ids in turn; what is held at once is a slice of the texts and the cache."""
        for part in text_slices(texts):
            small = [self._is_latin(t) and not any(x in t for x in self._odd) for t in part]
            latin = iter(self._latin([t for t, k in zip(part, small, strict=True) if k]))
            other = iter(self._by_chunks([t for t, k in zip(part, small, strict=True) if not k]))
            for k in small:
                yield next(latin) if k else next(other)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of a vocabulary file, made once."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


# ---------------------------------------------------------------- plan


@dataclass
class Plan:
    """Where the r-th tail of each length goes: a bounded table made from the length histogram.

    ``start[l]`` to ``start[l+1]`` delimit the rows of length l, in rank order; a row covers
    ``count`` ranks from ``first`` on: rank first+i lies in sequence ``seq + i`` at ``offset``.
    Tails that no pattern takes lie end to end on a line that is cut every window.
    """

    length: np.ndarray
    first: np.ndarray
    count: np.ndarray
    seq: np.ndarray
    offset: np.ndarray
    line: np.ndarray  # -1, or where on the line the first rank of the row starts
    n_seqs: int
    line_seq: int
    line_tokens: int
    solved_tokens: int  # placed by solved combinations

    def frame(self) -> pd.DataFrame:
        return pd.DataFrame({k: getattr(self, k) for k in ("length", "first", "count", "seq", "offset", "line")})


#: Combinations drawn in proportion to the histogram, and the lengths of one before it is closed.
DRAWN, DRAWN_DEPTH = 16_000, 9


def combinations(hist: np.ndarray, window: int, slack: int = 0, seed: int = 0) -> np.ndarray:
    """Shallow combinations of lengths that fill the window up to ``slack``: rows of lengths, longest first, then zeros.

    Each length alone, with each of some common second and third lengths, and draws of a
    few lengths by their frequency, all closed by the longest length there is that fits:
    enough to use every length, few enough to stay a fixed-size problem.
    """
    there = np.flatnonzero(hist[: window + 1])
    there = there[there > 0]
    wide = DRAWN_DEPTH + 1
    if not len(there):
        return np.zeros((0, wide), dtype=np.int64)
    have = np.zeros(window + 1, dtype=np.int64)
    have[there] = there
    longest = np.maximum.accumulate(have)  # the longest length there is, up to each room
    found: list[np.ndarray] = []

    def close(taken: np.ndarray) -> None:
        """Adds what fills the window among rows of lengths, each with one more."""
        rest = window - taken.sum(axis=1)
        last = longest[np.maximum(rest, 0)]
        ok = (rest > 0) & (last > 0) & (rest - last <= slack)
        made = np.zeros((ok.sum(), wide), dtype=np.int64)
        made[:, : taken.shape[1]], made[:, -1] = taken[ok], last[ok]
        found.append(made)

    common = there[np.argsort(-hist[there], kind="stable")][:6]
    close(there[:, None])
    for i, x in enumerate(common):
        close(np.stack([there, np.full(len(there), x)], axis=1))
        for y in common[i:]:
            close(np.stack([there, np.full(len(there), x), np.full(len(there), y)], axis=1))
    rng = np.random.default_rng(seed)
    draws = there[np.searchsorted(np.cumsum(hist[there]), rng.integers(0, hist[there].sum(), (DRAWN, DRAWN_DEPTH)), side="right")]
    for k in range(2, DRAWN_DEPTH + 1):
        close(draws[:, :k])
    alone = there[(window - there <= slack)]
    found.append(np.pad(alone[:, None], ((0, 0), (0, wide - 1))))
    rows = -np.sort(-np.concatenate(found), axis=1)
    key = np.zeros(len(rows), dtype=np.uint64)
    for j in range(wide):
        key = key * np.uint64(0x9E3779B97F4A7C15) + rows[:, j].astype(np.uint64)
        key ^= key >> np.uint64(29)
    return rows[np.unique(key, return_index=True)[1]]


def solve(hist: np.ndarray, combos: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Repeat counts x >= 0 that minimise ||A x - hist||, by accelerated projected gradient.

    A (lengths x combinations, how often each length is used) is kept as index lists.
    """
    if not len(combos):
        return np.zeros(0)
    col, at = np.nonzero(combos)
    row = combos[col, at]
    h = hist.astype(float)
    times = lambda x: np.bincount(row, weights=x[col], minlength=len(h))
    back = lambda r: np.bincount(col, weights=r[row], minlength=len(combos))
    # the largest eigenvalue of A'A, by power iteration, bounds the step
    v = np.ones(len(combos)) / np.sqrt(len(combos))
    top = 1.0
    for _ in range(12):
        v = back(times(v))
        top = float(np.linalg.norm(v)) or 1.0
        v /= top
    step = 1 / (1.1 * top)
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(y - step * back(times(y) - h), 0)
        u = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / u * (new - x), new, u
    return x


def rounded(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Whole repeat counts with the same sum: systematic rounding of the fractions in random order, each up or down by less than one."""
    order = rng.permutation(len(x))
    line = np.floor(np.concatenate([[0.0], np.cumsum(x[order])]) + rng.random())
    out = np.empty(len(x), dtype=np.int64)
    out[order] = np.diff(line).astype(np.int64)
    return out


#: Times that repeat counts are solved for what is left, and the share of it below which greedy takes over.
SOLVES, LEAST_GAIN = 8, 0.02


def plan(hist: np.ndarray, window: int = WINDOW) -> Plan:
    """NNLS counts, rounded with their sum kept and solved again for what is left; then greedy; what fits no window whole is laid on the line.

    ``hist[l]``: how many tails have length l. Where few tails have each length, repeat
    counts are fractions of many combinations that want the same tails: those rounded up
    are placed while their lengths last and the rest is solved anew, first for windows
    filled exactly, then up to 1/256. Greedy takes the longest length left, adds the longest
    that still fits until nothing does, and repeats that combination while its lengths
    last; one that wastes more than 1/256 of the window goes on the line instead, where
    cutting leaves no gap.
    """
    left = hist.astype(np.int64).copy()
    uses: list[tuple[tuple[int, ...], int]] = []
    rng = np.random.default_rng(13)

    def use(combo: Iterable[int], times: int) -> int:
        need: dict[int, int] = {}
        for l in map(int, combo):
            if l:
                need[l] = need.get(l, 0) + 1
        times = int(min(times, min(left[l] // k for l, k in need.items())))
        if times > 0:
            for l, k in need.items():
                left[l] -= times * k
            uses.append((tuple(l for l, k in need.items() for _ in range(k)), times))
        return max(0, times)

    worth = np.arange(len(left))
    slack = 0
    for seed in range(SOLVES):
        before = int(left @ worth)
        if not before:
            break
        combos = combinations(left, window, slack, seed)
        x = solve(left, combos)
        times = rounded(x, rng)
        goal, placed = float(x.sum()), 0
        order = np.argsort(-x, kind="stable")
        for i in order[times[order] > 0]:
            placed += use(combos[i], int(times[i]))
        # counts rounded up whose tails were gone make room for those next in weight
        there = (left > 0) | (worth == 0)
        for i in order[there[combos[order]].all(axis=1)]:
            if placed >= goal or not x[i]:
                break
            placed += use(combos[i], 1)
        if before - int(left @ worth) < max(LEAST_GAIN * before, 1):
            if slack:
                break
            slack = window // 256
    solved = int(sum(sum(c) * k for c, k in uses))
    blocked = np.zeros(len(left), dtype=bool)
    while True:
        open_ = np.flatnonzero((left > 0) & ~blocked)
        if not len(open_):
            break
        head = int(open_[-1])
        combo, room, taken = [head], window - head, {head: 1}
        while room > 0:
            fits = [l for l in (int(q) for q in np.flatnonzero(left[: room + 1])[::-1][:4]) if left[l] > taken.get(l, 0)]
            if not fits:
                break
            l = fits[0]
            k = int(min(room // l, left[l] - taken.get(l, 0)))
            combo += [l] * k
            taken[l] = taken.get(l, 0) + k
            room -= l * k
        if room * 256 <= window:
            use(tuple(combo), int(left[head]))
        else:
            blocked[head] = True
    rows: list[tuple[int, int, int, int, int, int]] = []
    next_rank = np.zeros(len(left), dtype=np.int64)
    seq = 0
    for combo, times in uses:
        offset = 0
        for l in combo:
            rows.append((l, int(next_rank[l]), times, seq, offset, -1))
            next_rank[l] += times
            offset += l
        seq += times
    line = 0
    for l in np.flatnonzero(left):
        rows.append((int(l), int(next_rank[l]), int(left[l]), 0, 0, line))
        line += int(l) * int(left[l])
    rows.sort()
    cols = list(np.array(rows, dtype=np.int64).reshape(-1, 6).T)
    return Plan(*cols, n_seqs=seq + -(-line // window), line_seq=seq, line_tokens=line, solved_tokens=solved)


# ---------------------------------------------------------------- on tables

_HEADS = "doc_id long, th long, n long, tail int, block int, tail_crc long, crcs array<long>"


def _encoded(docs: DataFrame, path: str, window: int, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, th, n, tail, block, tail_crc, crcs): lengths and checksums, never ids."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, end = encoder(path), np.array([END_ID], dtype="<u4").tobytes()
        for batch in batches:
            n, tail, tcrc, crcs = [], [], [], []
            for ids in enc.encode(batch["text"]):
                ids += end
                k = len(ids) // 4
                full = k // window * window * 4
                n.append(k)
                tail.append(k % window)
                crcs.append([zlib.crc32(ids[i : i + 4 * window]) for i in range(0, full, 4 * window)])
                tcrc.append(zlib.crc32(ids[full:]))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "th": batch["th"], "n": n, "tail": tail, "block": batch["block"], "tail_crc": tcrc, "crcs": crcs})
        release()

    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    # by text too, as many rows may have no id
    block = F.pmod(F.xxhash64(F.lit(3), "doc_id", "th"), F.lit(RANK_BLOCKS)).cast("int")
    return d.select("doc_id", "th", "text", block.alias("block")).mapInPandas(run, _HEADS)


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): one row per piece.

    A document's ids end with id 2. Whole windows of a document are sequences of their own;
    what is left (its tail, under a window) is packed: combinations of lengths that fill a
    window are enumerated, repeat counts solved against the histogram of tails by
    non-negative least squares, rounded with their sum kept, and residuals packed greedily; tails that fill no
    window well lie end to end and are cut at its bounds. The plan is made from the
    histogram alone, ``window`` numbers whatever the input; a document finds its place by
    its rank among tails of its length. Only the line's last sequence has padding beyond
    1/256, less than one window in all.

    Null or empty text: the one id 2. Repeated rows are packed as often as they stand
    there. No rows: no pieces. Extra columns are not read. Ids are made from whole texts.
    """
    spark = docs.sparkSession
    path = tokenizer or tokenizer_path()
    heads = written(_encoded(docs, path, window))
    counts = heads.where("tail > 0").groupBy("tail", "block").agg(F.count(F.lit(1)).alias("c"))
    before = W.partitionBy("tail").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    starts = written(counts.withColumn("at", F.coalesce(F.sum("c").over(before), F.lit(0))))
    hist = np.zeros(window + 1, dtype=np.int64)
    for r in starts.groupBy("tail").agg(F.sum("c").alias("c")).collect():  # at most ``window`` rows
        hist[r["tail"]] = r["c"]
    p = plan(hist, window)

    # whole windows: one sequence each, numbered by place in the written table, above the packed ones
    whole = heads.where("size(crcs) > 0").select("doc_id", "n", F.posexplode("crcs").alias("k", "crc"), "block", "th")
    per_task = F.monotonically_increasing_id()
    whole = whole.select(
        "doc_id", (F.col("k") * F.lit(window)).cast("long").alias("start"), F.lit(window).cast("long").alias("length"), F.col("crc").alias("ids_crc32"), F.col("n").alias("doc_tokens"),
        (per_task + F.lit(p.n_seqs)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
    )

    rank = F.row_number().over(W.partitionBy("tail", "block").orderBy("doc_id", "th", "n")) - 1
    tails = heads.where("tail > 0").select("doc_id", "th", "n", "tail", "block", "tail_crc").withColumn("rank", rank)
    tails = tails.join(F.broadcast(starts.select("tail", "block", "at")), ["tail", "block"]).withColumn("rank", F.col("rank") + F.col("at"))
    table = spark.sparkContext.broadcast(p)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q = table.value
        # rows are in (length, first) order: one search finds a rank's row
        wide = int(q.first.max(initial=0) + q.count.max(initial=0) + 1)
        keys = q.length * wide + q.first
        for b in batches:
            tail, rank = b["tail"].to_numpy(np.int64), b["rank"].to_numpy(np.int64)
            i = np.searchsorted(keys, tail * wide + rank, side="right") - 1
            k = rank - q.first[i]
            on_line = q.line[i] >= 0
            at = q.line[i] + k * tail
            seq = np.where(on_line, q.line_seq + at // window, q.seq[i] + k)
            offset = np.where(on_line, at % window, q.offset[i])
            keep = np.where(on_line, np.minimum(tail, window - offset), tail)
            yield pd.DataFrame({"doc_id": b["doc_id"], "th": b["th"], "n": b["n"], "tail": tail, "tail_crc": b["tail_crc"], "sequence_id": seq, "offset": offset, "keep": keep})

    placed = tails.mapInPandas(place, "doc_id long, th long, n long, tail long, tail_crc long, sequence_id long, offset long, keep long")
    if p.line_tokens <= window:
        return whole.union(_uncut(placed))
    placed = written(placed)
    cut = placed.where("keep < tail")
    few = cut.count() <= BROADCAST_CUTS
    text = F.coalesce(F.col("text"), F.lit(""))
    # one text per (doc_id, hash): repeated rows have the same ids
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    wanted = cut.select("doc_id", "th").distinct()
    found = found.join(F.broadcast(wanted) if few else wanted, on=[found["doc_id"].eqNullSafe(wanted["doc_id"]), found["th"] == wanted["th"]], how="left_semi")
    found = found.groupBy("doc_id", "th").agg(F.first("text").alias("text"))
    ids = cut.alias("c").join(found.alias("f"), F.expr("c.doc_id <=> f.doc_id and c.th = f.th")).select("c.*", "f.text")

    def halves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, end = encoder(path), np.array([END_ID], dtype="<u4").tobytes()
        for b in batches:
            rows = []
            for r, raw in zip(b.itertuples(index=False), enc.encode(b["text"]), strict=True):
                raw += end
                start = r.n - r.tail
                a, z = 4 * (start + r.keep), 4 * r.n
                rows.append((r.doc_id, start, r.keep, zlib.crc32(raw[4 * start : a]), r.n, r.sequence_id, r.offset))
                rows.append((r.doc_id, start + r.keep, r.tail - r.keep, zlib.crc32(raw[a:z]), r.n, r.sequence_id + 1, 0))
            yield pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
        release()

    pieces = ids.mapInPandas(halves, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return whole.union(_uncut(placed.where("keep = tail"))).union(pieces)


def _uncut(placed: DataFrame) -> DataFrame:
    return placed.select("doc_id", (F.col("n") - F.col("tail")).alias("start"), F.col("tail").alias("length"), F.col("tail_crc").alias("ids_crc32"), F.col("n").alias("doc_tokens"), "sequence_id", "offset")


def op7_packing(docs: DataFrame) -> DataFrame:
    return pack(docs)
