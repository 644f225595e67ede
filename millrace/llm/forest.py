"""N-gram Jaccard join by a MinHash LSH forest, verified on exact shingle sets."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import block_pairs, components, forest, free_name, per_group, release, text_slices, word_codes, written

SHINGLE, THRESHOLD = 5, 0.8
TREES, MAX_DEPTH, TARGET_RECALL = 24, 8, 0.9999
#: Texts of a trie node that one task compares with each other or with another block, and their shingles in all.
BLOCK, BLOCK_SHINGLES = 512, 400_000
#: Ids up to this many are broadcast to find their texts; more are joined by shuffle.
BROADCAST_IDS = 2_000_000
_PRIME = np.uint64(0x100000001B3)
#: Texts without a named row get ids from here on, above all others, so that they never name a class.
_UNNAMED = (1 << 63) - (1 << 41)


def meeting_chance(similarity: np.ndarray | float, depth: int, trees: int = TREES) -> np.ndarray | float:
    """Chance that two texts share a prefix of ``depth`` values in one of the tries."""
    return 1 - (1 - similarity**depth) ** trees


def floor_depth(trees: int = TREES, threshold: float = THRESHOLD, recall: float = TARGET_RECALL, deepest: int = MAX_DEPTH) -> int:
    """The level beyond which no prefix need be shortened: a pair just at the threshold is met there with the target recall."""
    for k in range(deepest, 0, -1):
        if meeting_chance(threshold, k, trees) >= recall:
            return k
    raise ValueError(f"{trees} tries can't reach a recall of {recall} at {threshold}")


class Shingler:
    """Sets of hashed word shingles of whole texts: 64-bit word hashes, combined in order."""

    def __init__(self, width: int = SHINGLE):
        self.width = width

    def all(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """Each text's sorted distinct hashes; a text shorter than the width is one shingle, one without words has none."""
        from xxhash import xxh3_64_intdigest as h

        for part in text_slices(texts):
            codes, at, known = word_codes(part)
            w = np.fromiter(map(h, known), np.uint64, len(known))[codes]
            x = self._rolled(w, self.width)
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                if b - a >= self.width:
                    yield np.unique(x[a : b - self.width + 1])
                else:
                    yield self._rolled(w[a:b], b - a)

    @staticmethod
    def _rolled(w: np.ndarray, k: int) -> np.ndarray:
        """The hash of every k words in turn."""
        x = np.zeros(max(0, len(w) - k + 1) if k else 0, dtype=np.uint64)
        for i in range(k if len(x) else 0):
            x = (x ^ w[i : len(w) - k + 1 + i]) * _PRIME
            x ^= x >> np.uint64(29)
        return x


def _multipliers(trees: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    n = trees * MAX_DEPTH
    return rng.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint32)


def labels(shingles: np.ndarray, trees: int, ab: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """One long per trie: its path, a byte of each of ``MAX_DEPTH`` MinHash values, the first on top. A prefix is a shift."""
    a, b = ab
    low = np.full(trees * MAX_DEPTH, np.iinfo(np.uint32).max, dtype=np.uint32)
    x = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    for at in range(0, len(x), 1024):
        np.minimum(low, (x[at : at + 1024, None] * a[None, :] + b[None, :]).min(axis=0), out=low)
    low = (low * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.uint64).reshape(trees, MAX_DEPTH)
    path = np.zeros(trees, dtype=np.uint64)
    for i in range(MAX_DEPTH):
        path = path << np.uint64(8) | low[:, i]
    return path.view(np.int64)


def signatures(docs: DataFrame, trees: int = TREES, width: int = SHINGLE) -> DataFrame:
    """(doc_id, h, n_sh, paths): h identifies the text, paths are its places in the tries (none without words)."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingle, ab = Shingler(width), _multipliers(trees)
        for b in it:
            n, paths = [], []
            for s in shingle.all(b["text"]):
                n.append(len(s))
                paths.append(labels(s, trees, ab) if len(s) else None)
            yield pd.DataFrame({"doc_id": b["doc_id"], "h": b["h"], "n_sh": n, "paths": paths})
        release()

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("h"), "text")
    return d.withColumn("h", F.unhex("h")).mapInPandas(run, "doc_id long, h binary, n_sh long, paths array<long>")


def _shared_depth(x: np.ndarray) -> np.ndarray:
    """How many leading values two paths share, from their exclusive or."""
    depth = np.zeros(x.shape, dtype=np.int64)
    for k in range(1, MAX_DEPTH + 1):
        depth += x < np.uint64(1 << 8 * (MAX_DEPTH - k))
    return depth


def _pairs(g: pd.DataFrame, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of a block pair that this trie has to verify at this level.

    A pair belongs to the trie in which its common prefix is longest (ties: the first), and
    so to the level of that prefix or, if shortening began above it, never comes twice.
    Sizes alone rule out what can't reach the threshold.
    """
    paths = np.stack(g["paths"].to_numpy()).view(np.uint64)
    tree, level, above = int(g["t"].iloc[0]), int(g["level"].iloc[0]), int(g["above"].iloc[0])
    n = g["n_sh"].to_numpy(np.int64)
    left = np.flatnonzero(g["blk"].to_numpy() == g["bi"].to_numpy())
    right = np.flatnonzero(g["blk"].to_numpy() == g["bj"].to_numpy())
    lo, hi = np.minimum(n[left][:, None], n[right][None, :]), np.maximum(n[left][:, None], n[right][None, :])
    i, j = np.nonzero(lo >= threshold * hi - 1e-9)
    i, j = left[i], right[j]
    if g["bi"].iloc[0] == g["bj"].iloc[0]:
        once = i < j
        i, j = i[once], j[once]
    mine = paths[i, tree] ^ paths[j, tree]
    deep = _shared_depth(mine)
    ok = (deep >= level) & (deep < above)
    i, j, mine = i[ok], j[ok], mine[ok]
    for t in range(paths.shape[1]):
        if t != tree and len(i):
            x = paths[i, t] ^ paths[j, t]
            ok = x > mine if t < tree else x >= mine
            i, j, mine = i[ok], j[ok], mine[ok]
    return i, j


def _common(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """|A and B| of each index pair: by merging where pairs are few, by one incidence product where they are many."""
    if len(i) <= 4 * len(sets):
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j, strict=True)], dtype=np.int64)
    sizes = np.array([len(s) for s in sets])
    vocab, col, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    shared = times[col] > 1  # a shingle of one text alone is in no intersection
    rank = np.cumsum(times > 1) - 1
    row, col, width = row[shared], rank[col[shared]], int((times > 1).sum())
    del vocab
    both = np.zeros((len(sets), len(sets)), dtype=np.float32)
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    for at in range(0, width, 4096):
        a, z = np.searchsorted(col, [at, at + 4096])
        m = np.zeros((len(sets), min(4096, width - at)), dtype=np.float32)
        m[row[a:z], col[a:z] - at] = 1
        both += m @ m.T
    return both[i, j].astype(np.int64)


_NODE = "t int, key long, bi int, bj int, blk int, level int, above int, h binary, rep long, m long, n_sh long, paths array<long>"
_FOUND = "h binary, rep long, root long, links long, met int, pairs long, missed array<double>"


def _level(live: DataFrame, words: DataFrame, docs: DataFrame, level: int, above: int, repeats: bool, threshold: float, trees: int, width: int, block: int) -> DataFrame:
    """Verified links of the pairs whose longest common prefix has ``level`` values or more, and fewer than ``above``."""
    path = live.withColumn("key", _prefix(level))
    below = _prefix(min(above, MAX_DEPTH))
    # where shortening brings nobody new into a node there is nothing to do
    news = F.lit(True) if above > MAX_DEPTH else F.min(below) < F.max(below)
    nodes = path.groupBy("t", "key").agg(F.count(F.lit(1)).alias("c"), F.sum("n_sh").alias("s"), news.alias("news")).where("c > 1 and news")
    nodes = nodes.select("t", "key", F.greatest(F.ceil(F.col("c") / F.lit(block)), F.ceil(F.col("s") / F.lit(BLOCK_SHINGLES))).cast("int").alias("nb"))
    member = path.join(nodes, ["t", "key"]).withColumn("blk", F.pmod(F.xxhash64("h"), F.col("nb")).cast("int"))
    member = member.select("t", "key", "nb", "blk", "h").join(words, "h").withColumn("level", F.lit(level)).withColumn("above", F.lit(above))
    keys = ["t", "key", "bi", "bj"]
    names = [x.split()[0] for x in _NODE.split(", ")]
    dealt = block_pairs(member, "blk", "nb").select(*names)

    def needed(g: pd.DataFrame) -> pd.DataFrame | None:
        i, j = _pairs(g, threshold)
        return g.iloc[np.unique(np.concatenate([i, j]))] if len(i) else None

    need = written(per_group(dealt, keys, ["h"], needed, _NODE))
    text = docs.select(F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))).alias("h"), F.col("doc_id").cast("long").alias("rep"), "text").withColumn("rep", F.coalesce("rep", _unnamed()))
    one = text.join(_small(written(need.select("h", "rep").distinct())), ["h", "rep"])
    one = one.dropDuplicates(["h"]) if repeats else one
    whole = need.join(one.select("h", "text"), "h").select(*names, "text")

    def verified(g: pd.DataFrame) -> pd.DataFrame | None:
        i, j = _pairs(g, threshold)
        sets = list(Shingler(width).all(g["text"]))
        both = _common(sets, i, j)
        n = np.array([len(s) for s in sets])
        # both / (n_i + n_j - both) >= threshold, in a form without rounding at the bound
        hit = both * (1 + threshold) >= threshold * (n[i] + n[j]) - 1e-9
        i, j, both = i[hit], j[hit], both[hit]
        if not len(i):
            return None
        m = g["m"].to_numpy(np.int64)
        degree, met = np.zeros(len(g), dtype=np.int64), np.full(len(g), MAX_DEPTH)
        paths = np.stack(g["paths"].to_numpy()).view(np.uint64)[:, int(g["t"].iloc[0])]
        depth = _shared_depth(paths[i] ^ paths[j])
        for a, b in ((i, j), (j, i)):
            np.add.at(degree, a, m[b])
            np.minimum.at(met, a, depth)
        root = forest(len(g), i, j)
        rep = g["rep"].to_numpy(np.int64)
        at = np.flatnonzero(degree)
        # for each pair met, so many of its similarity are missed at a level
        p = meeting_chance((both / (n[i] + n[j] - both))[:, None], np.arange(1, MAX_DEPTH + 1)[None, :], trees)
        missed = np.zeros((len(g), MAX_DEPTH))
        np.add.at(missed, i, (1 - p) / p)
        pairs = np.bincount(i, minlength=len(g))
        return pd.DataFrame({"h": g["h"].to_numpy()[at], "rep": rep[at], "root": rep[root[at]], "links": degree[at], "met": met[at], "pairs": pairs[at], "missed": list(missed[at])})

    return written(per_group(whole, keys, ["h"], verified, _FOUND))


def _prefix(level: int) -> Column:
    return F.shiftrightunsigned("path", 8 * (MAX_DEPTH - level))


def measured_recall(found: DataFrame, level: int, trees: int, threshold: float) -> float:
    """Share of all links met so far: those missed are estimated from the similarities of those met, and one just at the threshold besides."""
    r = found.agg(F.sum("pairs").alias("n"), F.sum(F.col("missed")[level - 1]).alias("m")).first()
    n = r["n"] or 0
    return n / (n + (r["m"] or 0.0) + 1 - meeting_chance(threshold, level, trees)) if n else 0.0


def links(docs: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, recall: float = TARGET_RECALL, width: int = SHINGLE, block: int = BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sig, degrees, edges) of the join.

    sig: (doc_id, h) of every row. degrees: (h, rep, links, met) of each distinct text: other
    rows with a text at the threshold or above, copies included, and how far its prefixes
    were shortened until its last link was met. edges: (a, b) over the smallest ids of linked
    texts, a spanning forest per compared block, never all pairs.
    """
    floor = floor_depth(trees, threshold, recall)
    sig = written(signatures(docs, trees, width))
    rep = F.coalesce(F.min("doc_id"), _unnamed()).alias("rep")
    reps = written(sig.groupBy("h").agg(rep, F.count(F.lit(1)).alias("m"), F.max("n_sh").alias("n_sh"), F.first("paths").alias("paths")))
    words, repeats = reps.where("n_sh > 0"), _repeats(sig)
    # who shares no prefix at the last level that may be reached shares none above it
    path = words.select("h", "n_sh", F.posexplode("paths").alias("t", "path")).withColumn("key", _prefix(floor))
    met = path.groupBy("t", "key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("t", "key")
    live = written(path.join(met, ["t", "key"], "left_semi").select("h", "n_sh", "t", "path"))
    found, level, above = None, MAX_DEPTH, MAX_DEPTH + 1
    while True:
        more = _level(live, words, docs, level, above, repeats, threshold, trees, width, block)
        found = more if found is None else found.union(more)
        if level <= floor or measured_recall(found, level, trees, threshold) >= recall:
            break
        level, above = level - 1, level
    more = found.groupBy("h").agg(F.sum("links").alias("more"), F.min("met").alias("met"))
    degrees = reps.join(more, "h", "left").select("h", "rep", (F.when(F.col("n_sh") > 0, F.col("m") - 1).otherwise(0) + F.coalesce("more", F.lit(0))).alias("links"), "met", "n_sh")
    return sig, degrees, found.select(F.col("rep").alias("a"), F.col("root").alias("b"))


def _small(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _unnamed() -> Column:
    return F.lit(_UNNAMED) + F.pmod(F.xxhash64("h"), F.lit(1 << 40))


def _repeats(sig: DataFrame) -> bool:
    """Whether a row stands in the table more than once with the same id and text."""
    return not sig.groupBy("doc_id", "h").count().where("count > 1").isEmpty()


def join(docs: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, recall: float = TARGET_RECALL, width: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """(doc_id, class_id, n_links, kept, met) for every row.

    Texts are linked when the Jaccard similarity of their sets of ``width``-word shingles
    (white-space words as they stand; a shorter text is one shingle) is at least
    ``threshold``. A text's path in a trie is made of MinHash values; texts that share a
    prefix meet in a node, at first the longest prefixes. These are then shortened value by
    value until the recall measured on the links met reaches ``recall``, at the latest where
    a pair just at the threshold is met with that chance. Each pair is verified once, in the
    trie of its longest common prefix, on exact sets. ``n_links`` counts the other rows
    linked directly, ``class_id`` is the smallest doc_id reachable by links, ``kept`` marks
    the row of that id, ``met`` is the prefix length at which a text's last link was met.

    A null, empty or wordless text links with nothing, not with its like. Rows that repeat
    an id are counted each; ids with several texts bring their classes together. A null id
    is a document without a name: it links, and its class is null if it has no named
    member. Empty tables give no rows. Extra columns are not read.

    Copies of one text are compared once. A trie node of more than ``block`` texts, or of
    very long ones, is a triangle of block pairs, so a group with a third of all rows is
    many bounded tasks; links leave a task as counts and a spanning forest, never as pairs.
    """
    sig, degrees, edges = links(docs, threshold, trees, recall, width, block)
    # a wordless text has no class but itself; others take the component of their smallest id
    comp = components(edges)
    known = degrees.join(comp.withColumnRenamed("id", "rep"), "rep", "left").select("h", "links", "met", "n_sh", F.coalesce("component", "rep").alias("class"))
    out = sig.select("doc_id", "h").join(known, "h")
    named = F.when(F.col("n_sh") > 0, F.when(F.col("class") < F.lit(_UNNAMED), F.col("class"))).otherwise(F.col("doc_id"))
    return out.select("doc_id", named.alias("class_id"), F.col("links").alias("n_links"), F.coalesce(named == F.col("doc_id"), F.lit(True)).alias("kept"), "met")


def kept_rows(docs: DataFrame, **kw) -> DataFrame:
    """One document of each group of near copies, columns unchanged: that of the smallest id.

    Rows that repeat a kept id stay once for each distinct text (the least by all columns of
    those with the same text); documents without words stay, as does one without an id.
    """
    key, held = free_name("id", docs), free_name("row", docs)
    found = written(join(docs, **kw).groupBy(F.col("doc_id").alias(key)).agg(F.max("kept").alias("kept"), F.count_if("kept").alias("n")))
    gone = written(found.where("not kept").select(key))
    twice = written(found.where("kept and n > 1").select(key).where(F.col(key).isNotNull()))
    same = F.col("doc_id") == F.col(key)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    if twice.isEmpty():
        return docs.join(_small(gone), same, "left_anti").select(*columns)
    once = docs.join(_small(gone.union(twice)), same, "left_anti").select(*columns)
    text = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    least = docs.join(_small(twice), same, "left_semi").groupBy(F.col("doc_id").alias(key), text.alias("h")).agg(F.min(F.struct(*columns)).alias(held))
    return once.union(least.select(F.col(f"{held}.*")))


def op8_jaccard(docs: DataFrame) -> DataFrame:
    return join(docs).drop("met")
