"""Language-model scoring: cross-entropy difference of matched n-gram models."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import release

#: Weight of the shorter context in the smoothed estimates.
SMOOTHING = 20.0
#: Target documents up to this many are broadcast as ids; more are joined by shuffle.
BROADCAST_TARGETS = 1_000_000
#: Code points of one numpy pass; longer texts go in pieces.
PIECE = 1 << 20
#: Bytes of text whose words one task counts and scores at a time.
BLOCK_BYTES = 12_000_000
#: A run of letters and digits; one symbol of scripts written without spaces; any other sign.
_WORD = re.compile("[^\\W\u0e00-\u0eff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]+|\\S")
_START = np.uint64(0x9E3779B97F4A7C14)  # even, as pairs are


def words(text: str) -> Iterator[list[str]]:
    """The words of a text in order, those of about ``PIECE`` code points at a time."""
    at = 0
    while at < len(text):
        end = at + PIECE
        while end < len(text) and (text[end].isalnum() or text[end] == "_"):
            end += 1
        yield _WORD.findall(text, at, end)
        at = end


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _planes(x: np.ndarray) -> bytes:
    """Numbers by bytes of like place: small ones shrink to little where shuffles compress."""
    return x.reshape(len(x), -1).view(np.uint8).T.tobytes()


def _numbers(b: bytes, kind: type, columns: int = 2) -> np.ndarray:
    wide = np.dtype(kind).itemsize * columns
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(wide, -1).T).view(kind).reshape(-1, columns)


@dataclass
class _Block:
    """The grams of some texts: sorted distinct keys (odd: a word, even: a pair of words or the start of a text)."""

    keys: np.ndarray
    n: np.ndarray  # (keys, 2): in target texts, in all
    owner: np.ndarray  # the text of each position
    word: np.ndarray  # and which key its word, its pair and the word before are
    pair: np.ndarray
    before: np.ndarray

    @classmethod
    def of(cls, texts: pd.Series, target: pd.Series) -> _Block:
        number: dict[str, int] = defaultdict()
        number.default_factory = number.__len__
        ids, sizes = [], np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            for w in words(t):
                ids.append(np.fromiter(map(number.__getitem__, w), np.int32, len(w)))
                sizes[i] += len(w)
        at = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        named = pd.util.hash_array(np.array(list(number), dtype=object), categorize=False) if number else np.zeros(0, np.uint64)
        named = np.append(named.astype(np.uint64) | np.uint64(1), _START)
        first = (np.cumsum(sizes) - sizes)[sizes > 0]
        back = np.empty(len(at), np.int32)
        back[1:] = at[:-1]
        back[first] = len(number)
        with np.errstate(over="ignore"):
            pairs = _mixed(_mixed(named[back]) * np.uint64(3) + named[at]) & ~np.uint64(1)
        owner = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
        aim = target.to_numpy(bool)
        pair, pair_keys = pd.factorize(pairs)
        both = np.concatenate([named, pair_keys])
        order = np.argsort(both)
        new = np.append(True, both[order[1:]] != both[order[:-1]])
        keys, rank = both[order][new], np.empty(len(both), np.int32)
        rank[order] = np.cumsum(new) - 1
        of_word, of_pair = rank[: len(named)], rank[len(named) :]
        word, pair, before = of_word[at], of_pair[pair], of_word[back]
        n = np.zeros((len(keys), 2), np.int64)
        for m, chosen in enumerate((aim[owner], slice(None))):
            n[:, m] = np.bincount(word[chosen], minlength=len(keys)) + np.bincount(pair[chosen], minlength=len(keys))
        n[of_word[-1]] += (aim[sizes > 0].sum(), (sizes > 0).sum())
        return cls(keys, n, owner, word, pair, before)

    def cuts(self, parts: int) -> np.ndarray:
        """Where each part's range of keys begins and ends."""
        edge = np.array([(i << 64) // parts for i in range(1, parts)], dtype=np.uint64)
        return np.concatenate([[0], np.searchsorted(self.keys, edge), [len(self.keys)]])


def word_score(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_tokens, target_loss, background_loss, score) of every document.

    Tokens are words (see ``_WORD``), all that occur, none replaced. Two bigram models over
    that one vocabulary are smoothed alike: the target's counts come from the documents
    named in ``targets``, the background's from all. With s = ``SMOOTHING``,
    p(w | v) = (n(v w) + s * p(w)) / (n(v) + s) and p(w) = (n(w) + 1) / (all + words + 1);
    before a text's first word stands its start. ``score`` is the mean over a text's words
    of the target model's loss less the background model's: the lower, the nearer.

    Texts are shuffled once, into blocks of about ``block_bytes``. A block sums up its own
    words and pairs and sends them, by ranges of their 63-bit hashes, to as many parts as
    there are blocks; a part sums over blocks and answers each with what the others add.
    So counts never meet in one place, each key leaves a block once however frequent it
    is, and no part or block grows with the corpus. A block sends one message to every part,
    so that messages shrink as blocks get many: let ``block_bytes`` grow with the root of
    the corpus (at 300 TB of text 1 GB, for messages of some 8 KB). Two grams of equal hash would be
    counted as one.

    Null, empty or blank text: 0 tokens, null losses and score. Repeated rows are documents
    each; repeated or unknown target ids count once or not at all. Without targets the
    target model is the smoothed uniform one.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.col("text"))
    kind = dict(d.dtypes)["doc_id"]
    shape = f"doc_id {kind}, n_tokens long, target_loss double, background_loss double, score double"
    none = [F.lit(None).cast("double").alias(c) for c in ("target_loss", "background_loss", "score")]
    bare = F.coalesce(F.col("text") == "", F.lit(True))
    total = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(-(-total // block_bytes)) or 1
    t = targets.select(F.col(id_col).alias("doc_id")).where("doc_id is not null").distinct().withColumn("target", F.lit(True))
    few = t.count() <= BROADCAST_TARGETS
    marked = d.where(~bare).join(F.broadcast(t) if few else t, "doc_id", "left").withColumn("target", F.coalesce("target", F.lit(False)))
    dealt = marked.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)).cast("int")).repartition(parts, "block")

    def ask(g: pd.DataFrame) -> pd.DataFrame:
        b = _Block.of(g["text"], g["target"])
        at = b.cuts(parts)
        rows = [(b.keys[i:j].tobytes(), _planes(b.n[i:j].astype(np.uint32))) for i, j in zip(at, at[1:], strict=False)]
        del b
        release()
        return pd.DataFrame(rows, columns=["keys", "n"]).assign(block=g["block"].iloc[0], part=np.arange(parts, dtype=np.int32))

    def answer(g: pd.DataFrame) -> pd.DataFrame:
        keys = np.frombuffer(b"".join(g["keys"]), np.uint64)
        n = np.concatenate([_numbers(x, np.uint32) for x in g["n"]]).astype(np.int64)
        at, every = pd.factorize(keys)
        sums = np.stack([np.bincount(at, weights=n[:, m], minlength=len(every)).astype(np.int64) for m in (0, 1)], axis=1)
        word = (every & np.uint64(1)).astype(bool)
        told = np.array([word.sum(), *sums[word].sum(0)], dtype=np.int64).tobytes()
        more = sums[at] - n
        cut = np.cumsum([0, *(len(k) // 8 for k in g["keys"])])
        del keys, n, at, every, sums, word
        release()
        return pd.DataFrame({"block": g["block"], "part": g["part"], "more": [_planes(more[i:j]) for i, j in zip(cut, cut[1:], strict=False)], "told": told})

    def judge(g: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        b = _Block.of(g["text"], g["target"])
        answers = answers.sort_values("part")
        n = b.n + np.concatenate([_numbers(x, np.int64) for x in answers["more"]])
        size, *sums = np.frombuffer(b"".join(answers["told"]), np.int64).reshape(-1, 3).sum(0).tolist()
        tokens = np.bincount(b.owner, minlength=len(g))
        mean = []
        for m in (0, 1):
            c = n[:, m]
            p = (c[b.pair] + SMOOTHING * (c[b.word] + 1) / (sums[m] + size + 1)) / (c[b.before] + SMOOTHING)
            mean.append(np.bincount(b.owner, weights=-np.log(p), minlength=len(g)) / np.maximum(tokens, 1))
        del b, n, c, p
        release()
        cols = {"target_loss": mean[0], "background_loss": mean[1], "score": mean[0] - mean[1]}
        return pd.DataFrame({"doc_id": g["doc_id"], "n_tokens": tokens} | {k: pd.arrays.FloatingArray(v, tokens == 0) for k, v in cols.items()})

    asked = dealt.groupBy("block").applyInPandas(ask, "keys binary, n binary, block int, part int")
    answers = asked.groupBy("part").applyInPandas(answer, "block int, part int, more binary, told binary")
    scored = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(judge, shape)
    return scored.union(d.where(bare).select("doc_id", F.lit(0).cast("long").alias("n_tokens"), *none))


def op1_lm_score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Target: documents labelled good and not toxic."""
    return word_score(docs, labels.where("quality = 1 and coalesce(toxic, 0) = 0"))
