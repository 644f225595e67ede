"""Tokenizer alignment, vector best fit and whitening against brute force, and on odd rows."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from millrace.llm import align, bestfit, whitening
from millrace.llm.packing import tokenizer_path

A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")

TEXTS = [
    "The quick brown fox, don't it's we'll  jump.", "a  b", "a   b c\n", "\n x", "foo\n  bar", "x▁y", "  lead", "trail ", " ", "tab\t x y", "<|endoftext|> </s> <s>[INST] <0x41>",
    "é ü ﬁ 漢字 かな 😀 x", "a\x00b c", "a\x1c b\x85 c", "\r\n y );\r z", "1234 5 678", "naïve façade " * 40, "x" * 3000, "", None, "a  b",
]


def documents(spark, texts, extra=False):
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return d.withColumnsRenamed({"source": "block"}).selectExpr("*", "1 AS code", "'z' AS n_links", "0 AS tail", "0 AS rank") if extra else d


# ---------------------------------------------------------------- alignment


def byte_links(x, text):
    """Both tokenizations by the public encoders, overlaps by comparing every byte's owners."""
    a = x.a.encode(" " + text, add_special_tokens=False).ids
    b = x.b.encode(text)
    whole = (" " + text).encode()
    by_a = [i for i, t in enumerate(a) for _ in x.bytes_a[t]]
    by_b = [i for i, t in enumerate(b) for _ in x.bytes_b[t]]
    if b"".join(x.bytes_a[t] for t in a) != whole or b"".join(x.bytes_b[t] for t in b) != whole:
        return None
    links = sorted(set(zip(by_a, by_b, strict=True)))
    end = lambda own: {k for k in range(len(own)) if k + 1 == len(own) or own[k + 1] != own[k]}
    groups, i, j = [], 0, 0
    for k in sorted(end(by_a) & end(by_b)):
        groups.append(",".join(map(str, a[i : by_a[k] + 1])) + "|" + ",".join(map(str, b[j : by_b[k] + 1])))
        i, j = by_a[k] + 1, by_b[k] + 1
    return len(a), len(b), groups, [(a[p], b[q]) for p, q in links]


def expected(texts):
    x = align.Aligner(A, B)
    found = [byte_links(x, t) if t else None for t in texts]
    count = Counter(p for f in found if f for p in set(f[3]))
    best = defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    out = {}
    for i, f in enumerate(found):
        if f is None:
            out[i] = (0, 0, 0, 0, 0, 0, "")
        else:
            na, nb, groups, links = f
            out[i] = (na, nb, len(groups), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest())
    return out


def test_alignment_matches_bytes(spark, monkeypatch):
    monkeypatch.setattr(align, "BLOCK_LINKS", 60)  # many blocks
    monkeypatch.setattr(align, "SLICE", 64)
    want = expected(TEXTS)
    got = {r["doc_id"]: tuple(r)[1:] for r in align.op13_alignment(documents(spark, TEXTS).repartition(3)).collect()}
    assert got == want
    assert want[5] == want[18] == want[19] == (0, 0, 0, 0, 0, 0, "") and want[1][5] >= 2 * want[1][3]  # a row that stands twice counts twice


def test_alignment_of_the_tables(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = d.collect()
    want = expected([r["text"] for r in rows])
    got = {r["doc_id"]: tuple(r)[1:] for r in align.op13_alignment(d).collect()}
    assert got == {r["doc_id"]: want[i] for i, r in enumerate(rows)}


def test_alignment_remembers_and_forgets(monkeypatch):
    monkeypatch.setattr(align, "CACHED_CHUNKS", 40)
    x = align.Aligner(A, B)
    rng = np.random.default_rng(3)
    texts = [" ".join("".join(rng.choice(list("abcdeé,."), 4)) for _ in range(30)) for _ in range(60)]
    for at in range(0, 60, 10):
        for t, got in zip(texts[at : at + 10], x.align(texts[at : at + 10]), strict=True):
            na, nb, groups, links = byte_links(x, t)
            assert got[:5] == (na, nb, len(groups), len(links), hashlib.sha256(";".join(groups).encode()).hexdigest())
            assert dict(zip(got[5].tolist(), got[6].tolist(), strict=True)) == Counter(a * x.wide + b for a, b in links)


def test_alignment_of_odd_tables(spark):
    empty = align.op13_alignment(documents(spark, []).limit(0))
    assert empty.count() == 0 and empty.columns[0] == "doc_id"
    odd = spark.createDataFrame([(None, "a b"), (None, None), (1, "a b"), (1, "a b")], "doc_id long, text string").selectExpr("*", "1 AS block", "2 AS code", "3 AS n")
    got = align.op13_alignment(odd).toPandas()
    assert len(got) == 4 and got["doc_id"].isna().sum() == 2 and sorted(got["count_sum"]) == [0, 6, 6, 6]
    assert align.op13_alignment(documents(spark, [None, "", None])).select("n_a", "groups_sha256").distinct().collect() == [(0, "")]


# ---------------------------------------------------------------- best fit


def loads(p):
    out = defaultdict(list)
    for length, _, count, each, seq, offset in zip(p.length, p.first, p.count, p.each, p.seq, p.offset, strict=True):
        for i in range(count):
            out[int(seq + i // each)].append((int(offset + i % each * length), int(length)))
    return out


def one_by_one(lengths, cap):
    """Best fit of single pieces by falling length: the open sequence with the least room that holds it."""
    open_ = []
    for l in sorted(lengths, reverse=True):
        fits = [x for x in open_ if x[0] >= l and x[1] >= 1 and x[2] >= l * l]
        if not fits:
            fits = [[cap.tokens, cap.documents, cap.attention]]
            open_.append(fits[0])
        x = min(fits, key=lambda x: x[0])
        x[0], x[1], x[2] = x[0] - l, x[1] - 1, x[2] - l * l
    return len(open_)


@pytest.mark.parametrize("cap", [bestfit.Capacity(), bestfit.Capacity(64, 4, 4096), bestfit.Capacity(64, 64, 1500), bestfit.Capacity(100, 3, 6000)])
def test_best_fit_keeps_every_capacity(cap):
    rng = np.random.default_rng(cap.tokens + cap.documents)
    lengths = np.minimum(rng.geometric(0.002 if cap.tokens > 1000 else 0.05, 500), cap.longest)
    hist = np.bincount(lengths, minlength=cap.longest + 1)
    for score in ("norm", "dot"):
        p = bestfit.best_fit(hist, cap, score)
        found = loads(p)
        assert len(found) == p.n_seqs and sum(map(len, found.values())) == 500
        for held in found.values():
            held.sort()
            assert held[0][0] == 0 and all(a + l == b for (a, l), (b, _) in zip(held, held[1:], strict=False))
            assert sum(l for _, l in held) <= cap.tokens and len(held) <= cap.documents and sum(l * l for _, l in held) <= cap.attention
        assert p.n_seqs <= one_by_one(lengths.tolist(), cap) + 1
    least = max(-(-int(lengths.sum()) // cap.tokens), -(-500 // cap.documents), math.ceil(float((lengths.astype(float) ** 2).sum()) / cap.attention))
    assert least <= bestfit.fewest(hist, cap).n_seqs


def test_best_fit_of_few_lengths_is_exact():
    hist = np.zeros(4097, dtype=np.int64)
    hist[[3000, 1096, 1000, 96]] = [7, 10, 3, 3]
    assert bestfit.fewest(hist).n_seqs == 9  # 35,248 tokens; seven pairs fill up
    with pytest.raises(ValueError):
        bestfit.best_fit(np.ones(200, dtype=np.int64), bestfit.Capacity(100))
    assert bestfit.best_fit(np.zeros(10, dtype=np.int64)).n_seqs == 0


def test_pieces_hold_every_id_once(spark, monkeypatch):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    texts = ["alpha beta gamma. " * k for k in (1, 1, 2, 3, 40, 900, 1024, 2047)] + ["", None, "x" * 50, "漢字 é"]
    d = documents(spark, texts, extra=True)
    got = bestfit.op12_best_fit(d.repartition(3)).toPandas()
    ids = {i: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4") for i, t in enumerate(texts)}
    for i, x in ids.items():
        mine = got[got["doc_id"] == i].sort_values("piece")
        assert mine["start"].tolist() == list(range(0, len(x), 4096)) and mine["piece"].tolist() == list(range(len(mine)))
        assert all(zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in mine.itertuples())
        assert mine["length"].sum() == len(x) and (mine["length"].iloc[:-1] == 4096).all()
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s["offset"].tolist() == [0, *s["length"].cumsum().tolist()[:-1]] and s["length"].sum() <= 4096
    tight = bestfit.pack_best_fit(d, capacity=bestfit.Capacity(256, 2, 40_000)).toPandas()
    assert tight["length"].max() == 200 and tight.groupby("sequence_id").size().max() == 2
    assert tight.assign(q=tight["length"] ** 2).groupby("sequence_id")["q"].sum().max() <= 40_000


def test_best_fit_of_odd_tables(spark):
    assert bestfit.op12_best_fit(documents(spark, []).limit(0)).count() == 0
    odd = spark.createDataFrame([(None, None), (None, "a b"), (1, "a b"), (1, "a b")], "doc_id long, text string")
    got = bestfit.op12_best_fit(odd).toPandas()
    assert sorted(got["length"]) == [1, 3, 3, 3] and got["sequence_id"].nunique() == 1 and sorted(got["offset"])[0] == 0


# ---------------------------------------------------------------- whitening


def vectors(spark, x, ids=None):
    rows = [(None if i is None else int(i), None if r is None else [None if c is None else float(c) for c in r]) for i, r in zip(ids if ids is not None else range(len(x)), x, strict=True)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS n", "'a' AS v", "2 AS component")


@pytest.mark.parametrize(("n", "d", "tile", "rows"), [(300, 70, 32, 64), (50, 5, 2, 7), (9, 20, 32, 4096)])
def test_whitening_matches_the_plain_way(spark, monkeypatch, n, d, tile, rows):
    monkeypatch.setattr(whitening.covariance, "__defaults__", (tile, rows))
    rng = np.random.default_rng(n)
    c = rng.normal(size=(n, d)) * rng.uniform(0.1, 3, d)
    got = whitening.op11_whitening(vectors(spark, c).repartition(3)).toPandas()
    x = np.floor(1024 * c) + 100_000
    y = x - x.mean(axis=0)
    values, of = np.linalg.eigh(y.T @ y / n)
    k = min(8, d, n - 1)
    values, of = values[::-1][:k], of[:, ::-1][:, :k]
    assert len(got) == n * k and (got["n"] == n).all() and sorted(got["component"].unique()) == list(range(1, k + 1))
    w = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    want = y @ of / np.sqrt(values)
    assert np.allclose(w * np.sign((w * want).sum(axis=0)), want, atol=1e-8)
    whole = x.astype(np.int64).astype(object)
    deviation = [int(v) for v in ((n * whole - whole.sum(axis=0)) ** 2).sum(axis=1)]
    assert got[got["component"] == 1].sort_values("vec_id")["deviation"].tolist() == deviation
    assert np.allclose(got[got["vec_id"] == 0].sort_values("component")["explained"], values / np.trace(y.T @ y / n), rtol=1e-9)
    assert got["identity_error"].nunique() == 1 and got["identity_error"][0] < 1e-8
    assert np.abs(np.cov(w.T, bias=True) - np.eye(k)).max() <= got["identity_error"][0] + 1e-9


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(1)
    good = [list(r) for r in rng.normal(size=(6, 3))]
    odd = [*good, good[0], None, [], [None, 1.0, 2.0], [float("nan"), 1.0, 2.0], [float("inf"), 0.0, 0.0], [1.0, 2.0], [0.0, 0.0, 0.0]]
    ids = [0, 1, 2, 3, 4, None, 0, 7, 8, 9, 10, 11, 12, 13]
    got = whitening.op11_whitening(vectors(spark, odd, ids)).toPandas()
    assert len(got) == 8 * 3 and (got["n"] == 8).all() and got["vec_id"].isna().sum() == 3  # the repeated, null-id and zero rows are in
    twice = got[got["vec_id"] == 0]
    assert len(twice) == 6 and twice.groupby("component")["whitened"].nunique().max() == 1
    for empty in (vectors(spark, good, range(6)).limit(0), vectors(spark, [None, []]), vectors(spark, [good[0]] * 4)):
        out = whitening.op11_whitening(empty)
        assert out.count() == 0 and out.columns[-1] == "identity_error"
    with pytest.raises(Exception, match="too large"):
        whitening.op11_whitening(vectors(spark, [[1e30, 1.0], [0.0, 1.0]])).collect()


def test_whitened_numbers_stay_exact_far_from_zero(spark):
    """Sums beyond 2^63 and means far larger than the spread lose no digit."""
    rng = np.random.default_rng(5)
    c = 3e12 + rng.integers(0, 5, size=(40, 4)).astype(float)
    got = whitening.op11_whitening(vectors(spark, c)).toPandas()
    x = (np.floor(1024 * c) + 100_000).astype(np.int64).astype(object)
    want = [int(v) for v in ((40 * x - x.sum(axis=0)) ** 2).sum(axis=1)]
    assert got[got["component"] == 1].sort_values("vec_id")["deviation"].tolist() == want and got["identity_error"][0] < 1e-6
