"""Reranking of retrieved evidence and extractive, cited answers, or an explicit refusal."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions.arrays import clip01
from millrace.functions.text import bigrams, content_tokens, coverage_share, normalized, sentences
from millrace.plans.tables import cut


@dataclass(frozen=True)
class Grounding:
    """Weights, bounds and the classes of sources."""

    hybrid_weight: float = 0.55
    coverage_weight: float = 0.30
    phrase_weight: float = 0.10
    classification_weight: float = 0.05
    minimum_score: float = 0.08
    max_chunks: int = 4
    sentences_per_chunk: int = 2
    max_sentences: int = 5
    minimum_chunks: int = 1
    prefix: str = "S"
    equipment_class: str = "exact_equipment_source"
    dataset_class: str = "exact_dataset_source"
    general_class: str = "authoritative_general_reference"
    equipment_markers: tuple[str, ...] = ("this compressor", "this unit", "manufacturer-specified", "manufacturer specified", "service manual", "part number", "model-specific", "model specific", "exact equipment")
    dataset_markers: tuple[str, ...] = ("dataset", "uci", "sensor data", "failure event", "sampling interval")
    refusal: str = "Insufficient governed evidence to answer this request safely."
    no_equipment: str = (
        " The available governed sources may provide dataset context or general "
        "compressed-air guidance, but they are not verified as the exact equipment manual."
    )

    def validate(self) -> None:
        w = (self.hybrid_weight, self.coverage_weight, self.phrase_weight, self.classification_weight)
        if any(not 0 <= x <= 1 for x in w) or abs(sum(w) - 1) > 1e-9:
            raise ValueError("weights must lie in 0 to 1 and add up to 1")
        if not self.equipment_markers or not self.dataset_markers:
            raise ValueError("marker lists must not be empty")
        if min(self.max_chunks, self.sentences_per_chunk, self.max_sentences, self.minimum_chunks) < 1:
            raise ValueError("bounds must be positive")


# What a source's class is worth for a kind of question.
AFFINITY = {
    "equipment_specific": {"equipment_class": 1.0, "dataset_class": 0.20, "general_class": 0.10},
    "dataset_specific": {"dataset_class": 1.0, "equipment_class": 0.60, "general_class": 0.25},
    "general": {"general_class": 1.0, "dataset_class": 0.55, "equipment_class": 0.55},
}
ANSWER_PREFIX = {
    "general": "Authoritative general guidance: ",
    "dataset_specific": "Governed dataset evidence: ",
    "equipment_specific": "Verified equipment evidence: ",
}


def intent(query: Column, g: Grounding) -> Column:
    q = normalized(query)
    has = lambda marks: F.exists(F.array(*map(F.lit, marks)), lambda m: q.contains(m))
    return F.when(has(g.equipment_markers), "equipment_specific").when(has(g.dataset_markers), "dataset_specific").otherwise("general")


def affinity(classification: Column, kind: Column, g: Grounding) -> Column:
    out = F.lit(0.0)
    for k, row in AFFINITY.items():
        for cls, value in row.items():
            out = F.when((kind == k) & (classification == getattr(g, cls)), F.lit(value)).otherwise(out)
    return out


def tokenized(texts: DataFrame) -> DataFrame:
    """Adds the content tokens of ``text`` and their neighbouring pairs, once for each text whatever the number of questions."""
    return texts.withColumn("text_tokens", content_tokens(F.col("text"))).withColumn("text_pairs", bigrams(F.col("text_tokens")))


def scored(candidates: DataFrame, g: Grounding = Grounding()) -> DataFrame:
    """Adds the score, its four parts and the intent: a map.

    Candidates have query_id, query, rank, hybrid_score, chunk_id, classification and text.
    Texts that ``tokenized`` has been over aren't cut again. A query without content tokens
    keeps none.
    """
    g.validate()
    d = candidates if "text_tokens" in candidates.columns else tokenized(candidates)
    d = d.withColumn("__q", content_tokens(F.col("query"))).where(F.size("__q") > 0).withColumn("__p", F.array_distinct(bigrams(F.col("__q"))))
    share = F.when(F.size("__q") >= 2, F.size(F.array_intersect("__p", "text_pairs")) / F.size("__p")).otherwise(F.lit(0.0))
    d = d.withColumns({"intent": intent(F.col("query"), g), "hybrid": clip01(F.col("hybrid_score").cast("double")), "query_coverage": coverage_share(F.col("__q"), F.col("text_tokens")), "phrase": share})
    d = d.withColumn("classification_affinity", affinity(F.col("classification"), F.col("intent"), g))
    total = F.lit(g.hybrid_weight) * F.col("hybrid") + F.lit(g.coverage_weight) * F.col("query_coverage") + F.lit(g.phrase_weight) * F.col("phrase") + F.lit(g.classification_weight) * F.col("classification_affinity")
    return d.withColumn("rerank_score", total).withColumnRenamed("rank", "retrieval_rank").drop("__q", "__p", "text_tokens", "text_pairs")


def order() -> list[Column]:
    """Best first within a query; equal scores by chunk id."""
    return [F.desc("rerank_score"), F.desc("hybrid"), F.asc("chunk_id")]


def ranked(scored: DataFrame) -> DataFrame:
    """Adds ``rerank_rank``, the place of a candidate within its query, from 1.

    Rows are cut into ranges of the order and numbered inside each; what a query has in the ranges
    before comes from one row per query and range. So no task holds a query whole. All columns of
    ``scored`` travel: leave texts out that the rank doesn't need.
    """
    rows = cut(cut(scored).repartitionByRange("query_id", *order()).withColumn("__part", F.spark_partition_id()))
    sizes = rows.groupBy("query_id", "__part").agg(F.count(F.lit(1)).alias("__n"))  # a row per query and range
    before = F.sum("__n").over(W.partitionBy("query_id").orderBy("__part").rowsBetween(W.unboundedPreceding, -1))
    sizes = sizes.select(F.col("query_id").alias("__query"), F.col("__part").alias("__range"), F.coalesce(before, F.lit(0)).alias("__base"))
    inside = F.row_number().over(W.partitionBy("query_id", "__part").orderBy(*order()))
    d = rows.withColumn("__in", inside).join(F.broadcast(sizes), F.col("query_id").eqNullSafe(F.col("__query")) & (F.col("__part") == F.col("__range")))
    return d.withColumn("rerank_rank", (F.col("__base") + F.col("__in")).cast("int")).drop("__part", "__in", "__query", "__range", "__base")


def rerank(candidates: DataFrame, g: Grounding = Grounding()) -> DataFrame:
    """``scored`` candidates with their new rank."""
    return ranked(scored(candidates, g))


CITATION = ("chunk_id", "source_id", "source_title", "publisher", "source_url", "doi", "classification", "equipment_relevance", "scope_note", "locator", "source_sha256", "text_sha256")


def best_sentences(query: Column, text: Column, n: int) -> Column:
    """The n sentences with most of the query's tokens, first of equals first; the first sentence where none has any."""
    return best_of(content_tokens(query), sentence_tokens(text), n)


def sentence_tokens(text: Column) -> Column:
    """array<struct<s, k>>: sentences with their content tokens; where many questions meet a text, a column made before they do."""
    return F.transform(sentences(text), lambda s: F.struct(s.alias("s"), content_tokens(s).alias("k")))


def best_of(query: Column, cut_text: Column, n: int) -> Column:
    """``best_sentences`` of a question's content tokens and the ``sentence_tokens`` of a text."""
    q = F.array_distinct(query)
    order = F.array_sort(F.transform(cut_text, lambda x, i: F.struct((-F.size(F.array_intersect(q, x["k"]))).alias("o"), i.alias("i"), x["s"].alias("s"))))
    # the first has most tokens: where it has none, it is kept alone
    return F.transform(F.slice(F.filter(order, lambda x, i: (x["o"] < 0) | (i == 0)), 1, n), lambda x: x["s"])


def evidence(reranked: DataFrame, g: Grounding = Grounding()) -> DataFrame:
    """Candidates that reach the minimum, at most ``max_chunks`` a query, numbered.

    Needs scores, no ranks. Only ids and scores are compared, and each task keeps its best; the few that are kept then find their texts. Chunk
    ids are unique within a query.
    """
    w = W.partitionBy("query_id").orderBy(*order())
    best = reranked.where(F.col("rerank_score") >= g.minimum_score).select("query_id", "chunk_id", "rerank_score", "hybrid").withColumn("evidence_rank", F.row_number().over(w))
    kept = best.where(F.col("evidence_rank") <= g.max_chunks).select(F.col("query_id").alias("__q"), F.col("chunk_id").alias("__c"), "evidence_rank")
    # max_chunks rows a query
    d = reranked.join(F.broadcast(kept), F.col("query_id").eqNullSafe(F.col("__q")) & (F.col("chunk_id") == F.col("__c"))).drop("__q", "__c")
    return d.withColumn("citation_id", F.concat(F.lit(g.prefix), F.col("evidence_rank").cast("string")))


def answers(queries: DataFrame, reranked: DataFrame, g: Grounding = Grounding()) -> DataFrame:
    """One answer per query: status, reason, intent, text, citations and counts.

    An equipment question without an exact source is refused first, with the evidence as
    context; then one with too little evidence; then one without a sentence.
    """
    e = evidence(reranked, g)
    there = [c for c in CITATION if c in e.columns]
    cite = F.struct("citation_id", *[F.coalesce(F.col(c), F.lit("")).alias(c) if c in there else F.lit("").alias(c) for c in CITATION])
    said = F.transform(best_sentences(F.col("query"), F.col("text"), g.sentences_per_chunk), lambda s: F.concat(s, F.lit(" ["), F.col("citation_id"), F.lit("]")))
    item = F.struct("evidence_rank", cite.alias("citation"), said.alias("said"))
    per = e.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("items"))  # max_chunks items at most
    d = queries.select("query_id", "query").join(per, "query_id", "left").withColumn("items", F.coalesce("items", F.expr("slice(array(null), 1, 0)").cast(dict(per.dtypes)["items"])))
    d = d.withColumn("intent", intent(F.col("query"), g)).withColumn("n", F.size("items"))
    every = F.flatten(F.transform("items", lambda x: x["said"]))
    d = d.withColumn("lines", F.slice(every, 1, g.max_sentences))
    before = F.transform(F.sequence(F.lit(1), F.greatest(F.col("n"), F.lit(1))), lambda i: F.aggregate(F.slice("items", 1, i - 1), F.lit(0), lambda s, x: s + F.size(x["said"])))
    used = F.filter(F.col("items"), lambda x, i: F.element_at(before, i + 1) < F.lit(g.max_sentences))
    classes = F.transform("items", lambda x: x["citation"]["classification"])
    no_exact = (F.col("intent") == "equipment_specific") & ~F.coalesce(F.array_contains(classes, g.equipment_class), F.lit(False))
    reason = F.when(no_exact, "no_exact_equipment_evidence").when(F.col("n") < g.minimum_chunks, "below_evidence_threshold").when(F.size("lines") == 0, "no_supported_sentence").otherwise("grounded")
    d = d.withColumn("reason_code", reason).withColumn("used", used)
    ok, below = F.col("reason_code") == "grounded", F.col("reason_code") == "below_evidence_threshold"
    lead = F.lit("")
    for k, p in ANSWER_PREFIX.items():
        lead = F.when(F.col("intent") == k, F.lit(p)).otherwise(lead)
    text = F.when(ok, F.concat(lead, F.array_join("lines", " "))).when(no_exact, F.lit(g.refusal + g.no_equipment)).otherwise(F.lit(g.refusal))
    cites = F.transform(F.when(ok, F.col("used")).when(below, F.slice("items", 1, 0)).otherwise(F.col("items")), lambda x: x["citation"])
    guidance = F.when(ok, F.array_contains(classes, g.general_class)).when(below, F.lit(False)).otherwise(F.col("n") > 0)
    return d.select(
        "query_id", "query", F.when(ok, "answered").otherwise("insufficient_evidence").alias("status"), "reason_code", "intent", text.alias("answer"), cites.alias("citations"),
        F.when(ok, F.size("used")).otherwise(0).alias("evidence_chunk_count"), guidance.alias("general_guidance_available"),
    )
