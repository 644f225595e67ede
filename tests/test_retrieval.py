"""Bounds of keyword and vector retrieval against all scores, and certified latent directions against a dense decomposition."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions.arrays import l2_normalize
from millrace.operators import postings, products, retrieval, terms


def sparse(rng, n, m, size):
    doc, term, weight = [], [], []
    for d in range(n):
        t = np.unique(rng.zipf(1.5, size) % m)
        w = rng.pareto(1.5, len(t)) + 0.01
        doc += [d] * len(t)
        term += t.tolist()
        weight += (w / np.sqrt((w * w).sum())).tolist()
    return np.array(doc), np.array(term), np.array(weight)


@pytest.mark.parametrize(("n", "block"), [(3000, 16), (40, 4), (5, 64)])
def test_shards_find_the_best_without_reading_all(n, block):
    rng = np.random.default_rng(n)
    doc, term, weight = sparse(rng, n, 200, 30)
    s, whole = postings.Shard(n, doc, term, weight, block), np.zeros((220, n))
    whole[term, doc] = weight
    for _ in range(100):
        t = rng.choice(220, rng.integers(1, 9), replace=False)
        w = rng.random(len(t))
        scores = w @ whole[t]
        want = [int(i) for i in np.lexsort((np.arange(n), -scores.round(9)))[:10] if scores[i] > 0]
        for floor in (0.0, float(np.sort(scores)[-min(n, 10)]) - 1e-9):
            found, got = s.top(t, w, 10, floor)
            assert np.allclose(got, scores[found])
            assert sorted(found.tolist(), key=lambda i: (-round(scores[i], 9), i))[:10] == [i for i in want if scores[i] >= floor]
    if n == 3000:
        assert s.read < 0.6 * s.met


def test_keyword_top_k_is_that_of_all_scores(spark, monkeypatch):
    monkeypatch.setattr(postings, "SHARD_DOCS", 90)
    monkeypatch.setattr(postings, "QUERY_PART", 7)
    rng = np.random.default_rng(4)
    rows = lambda d, t, w: [(int(a), f"t{b}", float(c)) for a, b, c in zip(d, t, w, strict=True)]
    kind = "id long, term string, weight double"
    base = rows(*sparse(rng, 600, 80, 20))
    index = spark.createDataFrame(base + [(i + 1000, t, w) for i, t, w in base if i < 100], kind)  # copies: ties
    queries = spark.createDataFrame([*rows(*sparse(rng, 20, 100, 6)), (77, "unknown", 1.0)], kind)
    got = {(r["query_id"], r["id"]): r["keyword_score"] for r in postings.keyword_top_k(index, queries, 5).collect()}
    want = {(r["query_id"], r["id"]): r["keyword_score"] for r in retrieval.top_per_query(retrieval.keyword_scores(index, queries), "keyword_score", 5).collect()}
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-9 for p in want)
    assert postings.keyword_top_k(index.limit(0), queries, 5).count() == 0 == postings.keyword_top_k(index, queries.limit(0), 5).count()
    names = index.withColumn("id", F.concat(F.lit("d"), F.lpad(F.col("id").cast("string"), 5, "0")))
    by_name = postings.keyword_top_k(names, queries.withColumn("id", F.concat(F.lit("q"), "id")), 5).collect()
    assert {(int(r["query_id"][1:]), int(r["id"][1:])) for r in by_name} == want.keys()


def clustered(rng, n, d, groups):
    x = rng.normal(size=(groups, d))[rng.integers(0, groups, n)] + 0.05 * rng.normal(size=(n, d))
    return x * rng.uniform(0.5, 2, size=(n, 1)) / np.sqrt(d)


def vectors(spark, x, first=0):
    return spark.createDataFrame([(first + i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")


def test_largest_products_read_few_blocks_of_clustered_vectors(spark, monkeypatch):
    monkeypatch.setattr(products, "BLOCK", 32)
    rng = np.random.default_rng(7)
    x, q = clustered(rng, 4000, 16, 40), clustered(np.random.default_rng(7), 25, 16, 40)
    x[100:110] = x[100]
    q = np.concatenate([q, x[[100]]])
    blocks = products.vector_blocks(vectors(spark, x))
    got = {(r["query_id"], r["id"]): r["vector_score"] for r in products.largest_products(blocks, vectors(spark, q), 10).collect()}
    s = q @ x.T
    want = {(i, int(j)) for i in range(len(q)) for j in np.lexsort((np.arange(len(x)), -s[i].round(9)))[:10] if s[i, j] > 0}
    assert got.keys() == want and all(abs(v - s[p]) < 1e-9 for p, v in got.items())
    _, pairs = products.read_pairs(*blocks, spark.sparkContext.broadcast(q), 10, ("bigint", "bigint"), float("inf"))
    assert pairs.count() < 0.3 * blocks[1].count() * len(q)


def test_largest_products_of_odd_input(spark):
    x = np.array([[1.0, 0.0], [1.0, 0.0], [2.0, 0.0], [-1.0, 0.0], [0.0, 0.0]])
    d, q = vectors(spark, x), vectors(spark, [np.array([1.0, 0.0]), np.array([0.0, 0.0])], 50)
    got = [tuple(r) for r in retrieval.dense_scores(d, q, 3).orderBy("id").collect()]
    assert got == [(50, 0, 1.0), (50, 1, 1.0), (50, 2, 1.0)]  # values over 1 count as 1, ties by id, nothing at 0 or below
    assert retrieval.dense_scores(d.limit(0), q, 3).count() == 0 == retrieval.dense_scores(d, q.limit(0), 3).count()


def test_latent_directions_are_certified(spark):
    rng = np.random.default_rng(2)
    doc, term, weight = sparse(rng, 120, 40, 15)
    index = spark.createDataFrame([(int(a), f"t{b:02}", float(c)) for a, b, c in zip(doc, term, weight, strict=True)], "id long, term string, weight double")
    vocab = index.select("term").distinct()
    n, dims = 125, 6  # five documents without a term
    names = sorted({f"t{b:02}" for b in term})
    a = np.zeros((n, len(names)))
    a[doc, [names.index(f"t{b:02}") for b in term]] = weight
    found = retrieval.latent(index, vocab, dims, n, rounds=60, tolerance=1e-7)
    _, values, directions = np.linalg.svd(a)
    assert found.rounds < 60 and found.residuals.max() <= 1e-7
    assert np.allclose(found.values, values[:dims] ** 2, rtol=1e-6)
    got = retrieval.explained_variance(index, found.directions, dims, n).orderBy("component").toPandas()
    y = a @ directions[:dims].T
    assert np.allclose(got["explained_variance"], y.var(axis=0), rtol=1e-5)
    assert np.allclose(got["explained_ratio"], y.var(axis=0) / a.var(axis=0).sum(), rtol=1e-5)
    loose = retrieval.latent(index, vocab, dims, n, rounds=1)
    assert loose.rounds == 2 and loose.residuals.max() > found.residuals.max()  # too few rounds show


def test_terms_are_counted_in_tasks_of_bounded_text(spark, monkeypatch):
    """Twice the text makes twice the tasks; a document's rows still meet."""
    monkeypatch.setattr(retrieval, "TASK_CHARS", 1_000)
    docs = spark.range(400).selectExpr("id % 200 as id", "repeat('some words and others ', 10) as t")
    counts = retrieval.term_counts(docs, "id", "t")
    assert counts.rdd.getNumPartitions() >= 80
    assert {tuple(r) for r in counts.where("term = 'words'").select("tf").distinct().collect()} == {(20,)} and counts.count() == 200 * 8


ODD = [(1, "Air leaks cost money, air leaks."), (1, "Leaks again and again"), (2, None), (3, ""), (4, "a b c"), (None, "nobody leaks"), (None, "nobody at all"), (5, "money cost leaks air"), (6, "Ärger über größe größe")]


def texts(spark):
    """Odd rows, and many whose words are of very different frequency."""
    rng = np.random.default_rng(5)
    more = [(100 + i, " ".join(f"w{x}" for x in rng.zipf(1.4, 60) % 300)) for i in range(150)]
    return spark.createDataFrame(ODD + more, "id long, t string")


@pytest.mark.parametrize(("bits", "spare", "most", "min_df"), [(20, 1.5, 50, 1), (6, 0.1, 20, 2), (9, 0.02, 400, 1), (20, 1.5, None, 1), (13, 1.5, 30, 3)])
def test_the_vocabulary_behind_a_filter_is_that_of_all_counts(spark, monkeypatch, bits, spare, most, min_df):
    """also with few buckets, where many terms fall together, and a first threshold that is too high."""
    monkeypatch.setattr(terms, "BUCKET_BITS", bits)
    monkeypatch.setattr(terms, "CHUNK", 16)
    monkeypatch.setattr(terms, "SPARE", spare)
    monkeypatch.setattr(terms, "SLICE", 200)
    docs = texts(spark)
    n = docs.count()
    got = retrieval.vocabulary_of(docs, "id", "t", n, most, min_df).collect()
    want = retrieval.vocabulary(retrieval.term_counts(docs, "id", "t"), n, most, min_df).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(want) > 10


def test_documents_of_numbered_terms_are_the_index(spark, monkeypatch):
    """the same weights as from the counts of all documents, and no text or term is shuffled."""
    monkeypatch.setattr(terms, "SLICE", 150)
    docs = texts(spark)
    voc = retrieval.vocabulary_of(docs, "id", "t", 10, 120).cache()
    rows = retrieval.document_rows(docs, "id", "t", voc)
    got = {(r["id"], r["term"]): r["weight"] for r in retrieval.entry_rows(rows, voc).collect()}
    want = {(r["id"], r["term"]): r["weight"] for r in retrieval.tfidf(retrieval.term_counts(docs, "id", "t"), voc).collect() if r["id"] is not None}
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-12 for p in want) and rows.count() == len({i for i, _ in want})
    once = docs.where("id > 1").repartition(8)
    plan = retrieval.document_rows(once, "id", "t", voc)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Join" not in plan and "Window" not in plan


def test_keywords_over_numbered_documents(spark, monkeypatch):
    """documents are answered in shards of few entries, the same as from single entries."""
    monkeypatch.setattr(postings, "SHARD_ENTRIES", 300)
    monkeypatch.setattr(postings, "STEP", 7)
    docs = texts(spark).where("id is not null")
    voc = retrieval.vocabulary_of(docs, "id", "t", docs.count(), 200).cache()
    rows = retrieval.document_rows(docs, "id", "t", voc)
    q = retrieval.tfidf(retrieval.term_counts(docs.where("id < 120"), "id", "t"), voc)
    pick = lambda x: {(r["query_id"], r["id"]): r["keyword_score"] for r in x.collect()}
    got, want = pick(postings.keyword_top_k(rows, q, 5, retrieval.numbered(voc)[0])), pick(postings.keyword_top_k(retrieval.entry_rows(rows, voc), q, 5))
    assert got.keys() == want.keys() and len(got) > 50 and all(abs(got[p] - want[p]) < 1e-9 for p in want)
    none = rows.where("id < 0")
    assert postings.keyword_top_k(none, q, 5, retrieval.numbered(voc)[0]).count() == 0


def test_products_of_blocks_of_documents(spark, monkeypatch):
    """frequent terms as a matrix and rare ones in lists are A'A v; empty documents and unknown terms add nothing."""
    monkeypatch.setattr(retrieval, "ENTRIES", 9)
    rng = np.random.default_rng(11)
    a = rng.random((90, 40)) * (rng.random((90, 40)) < np.linspace(0.01, 0.9, 40))
    a[7] = 0.0
    rows = [(i, [*np.flatnonzero(r).tolist(), -1], [*r[r > 0].tolist(), 5.0]) for i, r in enumerate(a)] + [(90, [], [])]
    index = spark.createDataFrame(rows, "id long, cols array<int>, weights array<double>")
    v = rng.normal(size=(40, 6))
    for dense in (1, 8, 10_000):
        out, y = np.zeros_like(v), []
        for b in index.toArrow().to_batches():
            for _, x in retrieval._blocks(b, 40, dense):
                y.append(x.product(v))
                x.back(y[-1], out)
        assert np.allclose(np.concatenate(y)[:90], a @ v) and np.allclose(out, a.T @ (a @ v))
    assert np.allclose(retrieval._there_and_back(index, v), a.T @ (a @ v))
    directions = spark.createDataFrame([(f"t{i:02}", x.tolist()) for i, x in enumerate(v)], "term string, v array<double>")
    got = {r["id"]: r["v"] for r in retrieval.embed(index, directions, 6).collect()}
    assert len(got) == 91 and all(np.allclose(got[i], (r @ v) / max(np.linalg.norm(r @ v), 1e-300)) for i, r in enumerate(a))


def test_a_vector_is_normalized_with_one_norm(spark):
    """the norm is not summed again for each component."""
    rows = [(0, [3.0, 4.0]), (1, [0.0, 0.0]), (2, []), (3, None), (4, [None, 3.0])]
    v = spark.createDataFrame(rows, "id long, v array<double>").select("id", l2_normalize(F.col("v")).alias("v"))
    got = {r["id"]: r["v"] for r in v.collect()}
    assert np.allclose(got.pop(0), [0.6, 0.8], rtol=1e-15) and got == {1: [0.0, 0.0], 2: [], 3: None, 4: [None, 3.0]}
    plan = v._jdf.queryExecution().optimizedPlan().toString().split(" AS ")[0]
    assert "aggregate(" in plan and "aggregate(" not in plan.split("transform(", 1)[1]
