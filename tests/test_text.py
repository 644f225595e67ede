from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import corpus, evaluation, grounding, history, retrieval
import pytest


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("r")).first()["r"]


def test_chunks_overlap(spark):
    w = lambda n: " ".join(f"w{i}" for i in range(n))
    cut = lambda t: one(spark, t, lambda c: T.chunk_words(T.words(c), 10, 2))
    a = cut(w(25))
    assert a[0].split()[-2:] == a[1].split()[:2] and a[-1].split()[-1] == "w24"
    assert cut("one two three") == ["one two three"]
    assert cut("  ") == [] and cut(w(30)) == cut(w(30))
    with pytest.raises(ValueError):
        T.chunk_words(F.col("t"), 2, 2)


def test_tokens_and_sentences(spark):
    assert one(spark, "The Café_1 a x2, of", T.word_tokens) == ["the", "café_1", "x2", "of"]
    assert one(spark, "What is the High-Pressure valve a", T.content_tokens) == ["high-pressure", "valve"]
    assert one(spark, " One. Two!  Three? ", T.sentences) == ["One.", "Two!", "Three?"]
    assert one(spark, "see [S1] and [S22], not [x]", T.markers) == ["S1", "S22"]


def test_normalize_keeps_paragraphs():
    assert T.normalize("a\r\nb\n\n\n c&amp; d \n") == "a b\n\nc& d"
    assert T.normalize(None) == ""


def test_visible_text_hides_scripts():
    assert T.normalize(corpus.visible("<p>a</p><script>x</script><div>b<br>c</div>")) == "a\n\nb c" or "x" not in corpus.visible("<script>x</script>")


def rows(spark, **extra):
    base = dict(query_id=1, query="compressor pressure", rank=1, hybrid_score=0.5, chunk_id="a", classification="authoritative_general_reference", text="Pressure of the compressor. Other words here.", source_id="s", locator="page:1", text_sha256="x")
    made = [base | e for e in extra["items"]]
    names = list(base)
    kinds = "query_id long, query string, rank int, hybrid_score double, chunk_id string, classification string, text string, source_id string, locator string, text_sha256 string"
    return spark.createDataFrame([tuple(m[n] for n in names) for m in made], kinds)


def test_answer_and_refusals(spark):
    c = rows(spark, items=[{}, {"chunk_id": "b", "text": "Nothing in common", "hybrid_score": 0.9}])
    rr = grounding.rerank(c)
    first = rr.orderBy("rerank_rank").first()
    assert first["chunk_id"] == "a" and abs(first["rerank_score"] - (0.55 * 0.5 + 0.3 + 0.05)) < 1e-12
    a = grounding.answers(c.select("query_id", "query").distinct(), rr).first()
    assert a["status"] == "answered" and a["answer"].startswith("Authoritative general guidance: Pressure of the compressor. [S1]")
    q = rows(spark, items=[{"query": "service manual of this compressor"}])
    b = grounding.answers(q.select("query_id", "query").distinct(), grounding.rerank(q)).first()
    assert (b["status"], b["reason_code"], b["evidence_chunk_count"]) == ("insufficient_evidence", "no_exact_equipment_evidence", 0)
    assert len(b["citations"]) == 1
    low = rows(spark, items=[{"hybrid_score": 0.0, "text": "zz", "classification": "none"}])
    n = grounding.answers(low.select("query_id", "query").distinct(), grounding.rerank(low)).first()
    assert n["reason_code"] == "below_evidence_threshold" and n["citations"] == []


def test_claims_are_checked_against_their_source(spark):
    got = one(spark, "Authoritative general guidance: A b. [S1] C d. [S2]", evaluation.claims)
    assert [(r["claim"], r["citation_id"]) for r in got] == [("A b.", "S1"), ("C d.", "S2")]


def test_tfidf_retrieval(spark):
    docs = spark.createDataFrame([(1, "compressor pressure maintenance leaks"), (2, "dataset provenance source checksums"), (3, "unrelated words entirely")], "doc_id long, text string")
    tc = retrieval.term_counts(docs, "doc_id", "text")
    voc = retrieval.vocabulary(tc, 3)
    index = retrieval.tfidf(tc, voc)
    ask = lambda t: retrieval.tfidf(retrieval.term_counts(spark.createDataFrame([(9, t)], "doc_id long, text string"), "doc_id", "text"), voc)
    best = retrieval.top_per_query(retrieval.keyword_scores(index, ask("compressor leaks")), "keyword_score", 5).collect()
    assert [r["id"] for r in best] == [1]
    assert retrieval.keyword_scores(index, ask("zzzxxyyqqq")).count() == 0
    norms = index.groupBy("id").agg(F.sum(F.col("weight") * F.col("weight")).alias("n")).collect()
    assert all(abs(r["n"] - 1) < 1e-9 for r in norms)
    with pytest.raises(ValueError):
        retrieval.lsa(index, voc, 50, 3)
    with pytest.raises(ValueError):
        retrieval.hybrid(index, index, 13)


def test_history_keeps_the_newest(spark):
    log = spark.createDataFrame([(i, "a" if i % 2 else "b") for i in range(5)], "id long, operation string")
    assert sorted(r["id"] for r in history.retained(log, 2, "id").collect()) == [3, 4]
    assert [r["id"] for r in history.recent(log, 9, "id", "a").collect()] == [3, 1]
    assert history.unique_ids(log, "id")


def test_hybrid_reads_the_vector_score_of_every_candidate(spark):
    """A keyword candidate behind more than 1,000 nearer documents keeps its own vector score."""
    d = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(1200)] + [(5000, [0.8, 0.6]), (5001, [-1.0, 0.0])], "id long, v array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "id long, v array<double>")
    keyword = spark.createDataFrame([(1, 5000, 1.0), (1, 5001, 0.5)], "query_id long, id long, keyword_score double")
    scores = {r["id"]: r["vector_score"] for r in retrieval.candidate_scores(keyword, d, q).collect()}
    assert len(scores) == 32 and abs(scores[5000] - 0.8) < 1e-12 and scores[5001] == 0.0
    first = retrieval.hybrid(keyword, retrieval.candidate_scores(keyword, d, q), 8).where("rank = 1").first()
    assert first["id"] == 5000 and abs(first["hybrid_score"] - (0.65 * 0.8 + 0.35)) < 1e-12


def test_ranks_over_ranges(spark):
    """One question's candidates lie in several ranges; ranks are those of one sort."""
    c = spark.range(3_000).selectExpr("if(id % 3 = 0, null, 1L) as query_id", "lpad(cast(id as string), 9, '0') as chunk_id", "(id * 7 % 11) / 11D as rerank_score", "(id % 5) / 5D as hybrid")
    r = grounding.ranked(c)
    assert "Window" in r._jdf.queryExecution().executedPlan().toString() and "__part" in r._jdf.queryExecution().executedPlan().toString()
    rows = r.collect()
    for q, n in ((None, 1_000), (1, 2_000)):
        own = sorted((x for x in rows if x["query_id"] == q), key=lambda x: (-x["rerank_score"], -x["hybrid"], x["chunk_id"]))
        assert [x["rerank_rank"] for x in own] == list(range(1, n + 1))


def test_sentences_cut_once(spark):
    t = spark.createDataFrame([(1, "Air is free. Air leaks cost money. Nothing here."), (2, "Only this. And that."), (3, None), (4, "")], "i int, t string").select("i", grounding.sentence_tokens(F.col("t")).alias("c"))
    got = dict(t.select("i", grounding.best_of(F.array(F.lit("air"), F.lit("leaks")), F.col("c"), 2)).collect())
    assert got == {1: ["Air leaks cost money.", "Air is free."], 2: ["Only this."], 3: None, 4: []}
