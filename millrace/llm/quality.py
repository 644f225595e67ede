"""Document quality: classifier evidence, shrunk toward site and path by empirical Bayes."""

from __future__ import annotations

import math
import operator
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import free_name, release, text_slices, word_codes, written

#: Labelled rows that the classifier is fitted on, at most; chosen by hash of doc_id.
FIT_ROWS = 20_000
#: Paths up to this many are broadcast with their sums, and rejected rows with their numbers; more are joined by shuffle.
BROADCAST_PATHS, BROADCAST_ROWS = 20_000, 2_000_000
BINS = 10
#: Buckets that words are hashed to, and documents' worth of smoothing of a bucket's odds.
BUCKETS, SMOOTHING = 1 << 16, 2.0

FEATURES = (
    "log_words", "word_length", "upper", "marks", "symbols", "digits", "letters",
    "distinct", "repeated", "line_repeats", "line_length", "pair_repeats", "capital_words",
)


def _kinds() -> np.ndarray:
    """(6, 256): which UTF-8 bytes are capital letters, marks, symbols, digits, letters or begin a character."""
    k = np.zeros((6, 256))
    for b in range(256):
        c = chr(b) if b < 128 else ""
        k[0, b] = c.isupper()
        k[1, b] = c != "" and c in ".,;:!?'\"()-"
        k[2, b] = c != "" and c in "#$%&*@^~_=+<>\\{}[]/"
        k[3, b] = c.isdigit()
        k[4, b] = c.isalpha() or b >= 0xC0
        k[5, b] = b < 0x80 or b >= 0xC0
    return k


_KINDS = _kinds()


def features(text: str | None) -> list[float]:
    """Shape of a whole text, by shares, so that length alone decides little."""
    if not text or not (words := text.split()):
        return [0.0] * len(FEATURES)
    n = len(words)
    seen = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8), minlength=256)
    upper, marks, symbols, digits, letters, chars = (_KINDS @ seen).tolist()
    lines = [x for x in text.split("\n") if x]
    lower = text.lower().split()
    return [
        math.log1p(n),
        chars / n,
        upper / max(1, letters),
        marks / chars,
        symbols / chars,
        digits / chars,
        letters / chars,
        len(set(lower)) / n**0.85,
        sum(map(operator.eq, lower, lower[1:])) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        math.log1p(chars / max(1, len(lines))),
        1 - len(set(zip(lower, lower[1:]))) / (n - 1) if n > 1 else 0.0,
        sum(map(str.isupper, words)) / n,
    ]


def buckets(texts: Iterable[str | None]) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    """(texts, bucket of each word in lower case, where each text's words begin and end), a slice at a time."""
    for part in text_slices(texts):
        codes, at, known = word_codes(part)
        names = np.array([w.lower().strip(".,;:!?\"'()") for w in known], dtype=object)
        hashed = pd.util.hash_array(names, categorize=False) if known else np.zeros(0, np.uint64)
        yield part, (hashed % np.uint64(BUCKETS)).astype(np.int32)[codes], at


def word_odds(seen: np.ndarray) -> np.ndarray:
    """Log odds of each bucket from (2, ``BUCKETS``) counts in bad and good texts: how much more often a word of good texts falls into it."""
    both = (seen.sum(axis=0) + 1) / (seen.sum() + BUCKETS)
    rate = (seen + SMOOTHING * both * BUCKETS) / (seen.sum(axis=1, keepdims=True) + SMOOTHING * BUCKETS)
    return np.log(rate[1] / rate[0])


def word_evidence(odds: np.ndarray, bucket: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Mean log odds of each text's words; 0 without words."""
    total = np.concatenate([[0.0], np.cumsum(odds[bucket])])
    return (total[at[1:]] - total[at[:-1]]) / np.maximum(1, np.diff(at))


@dataclass
class Model:
    """Additive logistic model over quantile bins of the features, the last of which is the evidence of words."""

    edges: np.ndarray
    weights: np.ndarray
    bias: float
    words: np.ndarray | None = None

    def evidence(self, x: np.ndarray) -> np.ndarray:
        """Log likelihood ratio of good against bad."""
        return self._design(x) @ self.weights + self.bias

    def of(self, texts: Iterable[str | None]) -> np.ndarray:
        out = [np.zeros(0)]
        for part, bucket, at in buckets(texts):
            x = np.array([features(t) for t in part], dtype=np.float64).reshape(-1, len(FEATURES))
            odds = self.words if self.words is not None else np.zeros(BUCKETS)
            out.append(self.evidence(np.concatenate([x, word_evidence(odds, bucket, at)[:, None]], axis=1)))
        return np.concatenate(out)

    def _design(self, x: np.ndarray) -> np.ndarray:
        cols = []
        for j in range(x.shape[1]):
            cols.append((x[:, j, None] > self.edges[j][None, :]).astype(np.float64))
        return np.concatenate(cols, axis=1)


def fit(x: np.ndarray, y: np.ndarray, l2: float = 1.0, rounds: int = 25) -> Model:
    """Newton's method on the penalised log likelihood; classes weigh alike whatever their shares."""
    if not len(y) or y.min() == y.max():
        return Model(np.zeros((x.shape[1], 1)), np.zeros(x.shape[1]), 0.0)
    good, bad = x[y == 1], x[y == 0]
    qs = np.linspace(0, 1, BINS + 1)[1:-1]
    # bins by the quantiles of either class, so that a rare class still has its own
    edges = np.array([np.sort(np.concatenate([np.quantile(good[:, j], qs), np.quantile(bad[:, j], qs), [good[:, j].max(), good[:, j].min()]])) for j in range(x.shape[1])])
    m = Model(edges, np.zeros(edges.size), 0.0)
    d = np.concatenate([m._design(x), np.ones((len(x), 1))], axis=1)
    w = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    beta = np.zeros(d.shape[1])
    pen = np.full(d.shape[1], l2)
    pen[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(d @ beta, -30, 30)))
        g = d.T @ (w * (p - y)) + pen * beta
        h = (d * (w * p * (1 - p))[:, None]).T @ d + np.diag(pen)
        step = np.linalg.solve(h, g)
        beta -= step
        if np.abs(step).max() < 1e-6:
            break
    return Model(edges, beta[:-1], float(beta[-1]))  # balanced weights: base odds are one


def evidence_of(m: Model):
    """A column function: the model's evidence of a text column."""

    @F.pandas_udf("double")
    def score(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in it:
            yield pd.Series(m.of(s))
        release()

    return score


def _labels(labels: DataFrame) -> DataFrame:
    """One label a document: repeated ones are averaged, unlabelled rows go."""
    return labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.avg(F.col("quality").cast("double")).alias("y"))


def fit_on(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """The classifier from at most ``rows`` labelled documents (a fixed bound, so broadcast, and collected without their texts).

    Each half of the rows is given the evidence of words learnt from the other half, so that
    the model learns what such evidence is worth on texts it hasn't seen. Of several texts
    with one id that of the smallest hash counts.
    """
    some = _labels(labels).orderBy(F.xxhash64(F.lit(9), "doc_id"), "doc_id").limit(rows)

    def shape(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            x, w = [], []
            for part, bucket, at in buckets(b["text"]):
                x += [features(t) for t in part]
                w += np.split(bucket, at[1:-1])
            yield pd.DataFrame({"doc_id": b["doc_id"], "th": b["th"], "y": b["y"], "x": x, "w": w})
        release()

    d = docs.select("doc_id", F.xxhash64("text").alias("th"), "text").join(F.broadcast(some), "doc_id")
    one = d.mapInPandas(shape, "doc_id long, th long, y double, x array<double>, w array<int>").groupBy("doc_id").agg(F.min_by(F.struct("y", "x", "w"), "th").alias("r"))
    side = F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(2)).cast("int")
    fitted = written(one.select("doc_id", side.alias("side"), (F.col("r.y") >= 0.5).cast("int").alias("y"), "r.x", "r.w"))
    seen = np.zeros((2, 2, BUCKETS))
    for r in fitted.select("side", "y", F.explode("w").alias("bucket")).groupBy("side", "y", "bucket").count().toPandas().itertuples():  # 4 x BUCKETS rows at most
        seen[r.side, r.y, r.bucket] = r.count
    learnt = fitted.sparkSession.sparkContext.broadcast([word_odds(seen[1 - k]) for k in (0, 1)])

    def told(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            e = [float(learnt.value[k][w].mean()) if len(w) else 0.0 for k, w in zip(b["side"], b["w"], strict=True)]
            yield pd.DataFrame({"doc_id": b["doc_id"], "y": b["y"], "x": b["x"], "e": e})

    got = fitted.mapInPandas(told, "doc_id long, y int, x array<double>, e double").toPandas().sort_values("doc_id")
    y = got["y"].to_numpy(dtype=float)
    if not len(y) or y.min() == y.max():
        return fit(np.zeros((0, len(FEATURES) + 1)), np.zeros(0))
    m = fit(np.concatenate([np.array(got["x"].tolist()), got["e"].to_numpy()[:, None]], axis=1), y)
    m.words = word_odds(seen.sum(axis=0))
    return m


def _key(c: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("null"))


@dataclass
class Priors:
    """Sums of each path and site, and how strongly each level is drawn toward the one above."""

    sums: DataFrame  # site, path, k, n, sk, sn
    mean: float
    site_weight: float
    path_weight: float

    def rates(self, own: Column, one: Column) -> tuple[Column, Column]:
        """(site's, path's) share of good documents without ``one`` documents that add ``own`` to it."""
        site = (F.col("sk") - own + F.lit(self.site_weight * self.mean)) / (F.col("sn") - one + F.lit(self.site_weight))
        path = (F.col("k") - own + F.lit(self.path_weight) * site) / (F.col("n") - one + F.lit(self.path_weight))
        # sums of other documents, kept clear of rounding at the ends
        return tuple(F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), r)) for r in (site, path))


def judged(scored: DataFrame, labels: DataFrame) -> DataFrame:
    """``scored`` with ``good``: what a document adds to its path, its label where it has one, else its classifier odds."""
    odds = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col("llr")))))
    return scored.join(_labels(labels), "doc_id", "left").withColumn("good", F.coalesce("y", odds)).drop("y")


def priors(seen: DataFrame) -> Priors:
    """Grouped sums by path and site (map-side partials) and the strength of their priors.

    A site's rate is drawn toward the global rate with as many pseudo-documents as the
    spread between sites calls for (moments of a beta prior), a path's toward its site's
    rate likewise. So a path of few documents stays near its site, a sparse site near the
    global prior.
    """
    paths = written(seen.groupBy("site", "path").agg(F.sum("good").alias("k"), F.count(F.lit(1)).cast("double").alias("n")))
    sites = paths.groupBy("site").agg(F.sum("k").alias("sk"), F.sum("n").alias("sn"))
    g = sites.agg(F.sum("sk").alias("k"), F.sum("sn").alias("n")).first()
    mean = ((g["k"] or 0.0) + 1) / ((g["n"] or 0.0) + 2)

    def strength(d: DataFrame, k: str, n: str, center: Column) -> float:
        """Pseudo-documents of the prior: weighted variance between groups against what sampling alone gives."""
        r = d.agg(
            F.sum(F.col(n) * F.pow(F.col(k) / F.col(n) - center, 2)).alias("ss"),
            F.sum(F.col(n)).alias("n"),
            F.sum(F.col(n) * F.col(n)).alias("nn"),
            F.count(F.lit(1)).alias("g"),
        ).first()
        if not r["n"] or r["g"] < 2 or r["n"] ** 2 <= r["nn"]:
            return 10.0
        within = mean * (1 - mean)
        between = (r["ss"] - (r["g"] - 1) * within) / (r["n"] - r["nn"] / r["n"])
        return float(np.clip(within / between - 1 if between > 0 else 1e4, 2.0, 1e4))

    s1 = strength(sites, "sk", "sn", F.lit(mean))
    both = written(paths.join(sites, "site"))
    s2 = strength(both, "k", "n", (F.col("sk") + F.lit(s1 * mean)) / (F.col("sn") + F.lit(s1)))
    return Priors(both, mean, s1, s2)


def decided(seen: DataFrame, threshold: float) -> DataFrame:
    """``seen`` with site_rate, path_rate, posterior and keep; a document's own part is left out of the rates it is judged by."""
    p = priors(seen)
    d = seen.join(F.broadcast(p.sums) if p.sums.count() <= BROADCAST_PATHS else p.sums, ["site", "path"])
    site, path = p.rates(F.col("good"), F.lit(1.0))
    d = d.withColumns({"site_rate": site, "path_rate": path})
    prior = F.log(F.col("path_rate") / (1 - F.col("path_rate")))
    posterior = 1 / (1 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), F.col("llr") + prior))))
    return d.withColumn("posterior", posterior).withColumn("keep", F.col("posterior") >= F.lit(threshold)).drop("k", "n", "sk", "sn")


def quality(docs: DataFrame, labels: DataFrame, site: str = "source", path: str = "lang", threshold: float = 0.5, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, source, llr, site_rate, path_rate, posterior, keep) of every document.

    ``llr`` is the classifier's log likelihood ratio (shape of the text and its words),
    ``posterior`` that evidence on the path's prior, ``keep`` whether it reaches
    ``threshold``. ``site`` and ``path`` name the two levels, the second within the first.
    Null or empty text: all features 0; null site or path: a group of its own. Repeated rows
    count and come out as often. Without usable labels (none, or one class) the evidence is
    0 and everything is kept. Extra columns are not read.
    """
    m = fit_on(docs, labels, fit_rows)
    scored = docs.select("doc_id", F.col(site).alias("source"), _key(F.col(site)).alias("site"), _key(F.col(path)).alias("path"), evidence_of(m)("text").alias("llr"))
    if not _tells(m):
        scored = scored.withColumn("llr", F.lit(0.0))
    d = decided(written(judged(written(scored), labels)), threshold)
    return d.select("doc_id", "source", "llr", "site_rate", "path_rate", "posterior", (F.col("keep") | F.lit(not _tells(m))).alias("keep"))


def _tells(m: Model) -> bool:
    return m.words is not None


def kept_rows(docs: DataFrame, labels: DataFrame, site: str = "source", path: str = "lang", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that ``quality`` keeps, columns unchanged.

    Texts are scored once, into a table with a number for each row; the numbers of rejected
    rows find them there.
    """
    m = fit_on(docs, labels)
    if not _tells(m):
        return docs
    row, llr = free_name("row", docs), free_name("llr", docs)
    wide = written(docs.withColumns({llr: evidence_of(m)("text"), row: F.monotonically_increasing_id()}))
    slim = wide.select(F.col(row).alias("row"), "doc_id", _key(F.col(site)).alias("site"), _key(F.col(path)).alias("path"), F.col(llr).alias("llr"))
    gone = written(decided(written(judged(slim, labels)), threshold).where("not keep").select(F.col("row").alias(row)))
    few = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    return wide.join(few, row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op9_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return quality(docs, labels)
