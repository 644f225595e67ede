"""Retrieval, citation, faithfulness and usefulness measures of answers, a row per case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import MARKER, markers, normalized
from millrace.operators.grounding import ANSWER_PREFIX

CUTOFFS = (1, 3, 5)
TRACED = ("source_id", "classification", "locator", "text_sha256")


def retrieval_metrics(cases: DataFrame, candidates: DataFrame, cutoffs: tuple[int, ...] = CUTOFFS) -> DataFrame:
    """First relevant rank, reciprocal rank, hits, class of the first candidate, boundary flag."""
    j = cases.select("case_id", "relevant_source_ids", "expected_source_classifications").join(candidates, "case_id")
    per = j.groupBy("case_id").agg(
        F.min(F.when(F.array_contains("relevant_source_ids", F.col("source_id")), F.col("rank"))).alias("first_rank"),
        F.min_by(F.array_contains("expected_source_classifications", F.col("classification")), "rank").alias("__top"),
        F.max((F.col("classification") == "exact_equipment_source").cast("int")).alias("__exact"),
    )
    d = cases.join(per, "case_id", "left")
    labeled = F.size("relevant_source_ids") > 0
    hits = {f"hit_at_{k}": F.when(labeled, F.coalesce(F.col("first_rank") <= k, F.lit(False))) for k in cutoffs}
    return d.withColumns(
        {
            "reciprocal_rank": F.when(labeled, F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0))),
            "top1_class": F.when(F.size("expected_source_classifications") > 0, F.coalesce("__top", F.lit(False))),
            "boundary_clear": F.when(F.col("category") == "equipment_boundary", F.coalesce(F.col("__exact"), F.lit(0)) == 0),
        }
        | hits
    ).drop("__top", "__exact")


def citation_metrics(cases: DataFrame, answers: DataFrame, reranked: DataFrame) -> DataFrame:
    """Citations that match their candidate in five fields, markers that match citations, citations of the expected class."""
    c = answers.select("case_id", "status", "answer", F.explode_outer("citations").alias("c")).select("case_id", "status", "answer", "c.*")
    r = reranked.select("case_id", "chunk_id", *[F.col(x).alias(f"__{x}") for x in TRACED])
    j = c.join(r, ["case_id", "chunk_id"], "left").join(cases.select("case_id", "expected_source_classifications"), "case_id")
    same = F.col("__source_id").isNotNull()
    for x in TRACED:
        same = same & F.col(x).eqNullSafe(F.col(f"__{x}"))
    scoped = (F.size("expected_source_classifications") > 0) & F.col("citation_id").isNotNull()
    per = j.groupBy("case_id").agg(
        F.first("status").alias("status"), F.first("answer").alias("answer"), F.count("citation_id").alias("citation_count"), F.count_if(same).alias("traceable_count"),
        F.count_if(scoped).alias("scoped_count"), F.count_if(scoped & F.array_contains("expected_source_classifications", F.col("classification"))).alias("aligned_count"),
        F.collect_set("citation_id").alias("__ids"),
    )
    marks = F.array_distinct(markers(F.col("answer")))
    agree = (F.size(marks) == F.size("__ids")) & (F.size(F.array_except(marks, F.col("__ids"))) == 0)
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return per.select(
        "case_id", "citation_count", "traceable_count", share("traceable_count", "citation_count").alias("traceability_rate"), F.when(F.col("status") == "answered", agree).alias("marker_coverage"),
        "scoped_count", "aligned_count", share("aligned_count", "scoped_count").alias("scope_alignment_rate"),
    )


def claims(answer: Column) -> Column:
    """array<struct<claim, citation_id>>: the text before each marker, without the answer's lead."""
    parts, ids = F.split(answer, MARKER.replace("(", "(?:")), markers(answer)
    lead = r"^(?:" + "|".join(p.strip() for p in ANSWER_PREFIX.values()) + r")\s*"
    zipped = F.zip_with(F.slice(parts, 1, F.size(ids)), ids, lambda t, i: F.struct(F.trim(F.regexp_replace(F.trim(t), lead, "")).alias("claim"), i.alias("citation_id")))
    return F.filter(zipped, lambda x: x["claim"] != "")


def faithfulness(answers: DataFrame, reranked: DataFrame) -> DataFrame:
    """(case_id, claim_count, supported_count): claims that stand word for word in the text they cite."""
    c = answers.select("case_id", "citations", F.explode_outer(claims(F.col("answer"))).alias("x")).select("case_id", "citations", "x.claim", "x.citation_id")
    of = F.filter("citations", lambda k: k["citation_id"] == F.col("citation_id"))
    c = c.withColumn("chunk_id", F.try_element_at(of, F.lit(-1))["chunk_id"])
    j = c.join(reranked.select("case_id", "chunk_id", F.col("text").alias("__t")), ["case_id", "chunk_id"], "left")
    held = F.coalesce(normalized(F.col("__t")).contains(normalized(F.col("claim"))), F.lit(False))
    return j.groupBy("case_id").agg(F.count("claim").alias("claim_count"), F.count_if(held).alias("supported_count")).withColumn("supported_rate", F.when(F.col("claim_count") > 0, F.col("supported_count") / F.col("claim_count")))


def usefulness(cases: DataFrame, answers: DataFrame, minimum: float = 0.5) -> DataFrame:
    """Expected status, reason and intent; share of concept groups of which the answer names an option."""
    a = answers.select("case_id", "status", "reason_code", "intent", "answer")
    text = normalized(F.col("answer"))
    covered = F.size(F.filter("required_concepts", lambda g: F.exists(g, lambda o: text.contains(normalized(o)))))
    d = cases.join(a, "case_id").withColumns(
        {
            "status_match": F.col("status") == F.col("expected_status"), "reason_match": F.col("reason_code") == F.col("expected_reason_code"), "intent_match": F.col("intent") == F.col("expected_intent"),
            "concept_coverage": F.when(F.size("required_concepts") > 0, covered / F.size("required_concepts")),
        }
    )
    matches = F.col("status_match") & F.col("reason_match") & F.col("intent_match")
    ok = F.when(F.col("category") == "equipment_boundary", matches).otherwise(matches & F.coalesce(F.col("concept_coverage") >= minimum, F.lit(False)))
    refused = (F.col("status") == "insufficient_evidence") & (F.col("reason_code") == "no_exact_equipment_evidence") & (F.col("intent") == "equipment_specific")
    return d.withColumn("useful", ok).withColumn("refusal_boundary", F.when(F.col("category") == "equipment_boundary", refused)).select(
        "case_id", "status", "status_match", "reason_match", "intent_match", "concept_coverage", "useful", "refusal_boundary"
    )


def evaluate(cases: DataFrame, candidates: DataFrame, reranked: DataFrame, answers: DataFrame, minimum: float = 0.5, cutoffs: tuple[int, ...] = CUTOFFS) -> DataFrame:
    """Every measure of every case and its failure flags, in a fixed order."""
    d = retrieval_metrics(cases, candidates, cutoffs).join(citation_metrics(cases, answers, reranked), "case_id").join(faithfulness(answers, reranked), "case_id").join(usefulness(cases, answers, minimum), "case_id")
    labeled, answered, last = F.size("relevant_source_ids") > 0, F.col("status") == "answered", max(cutoffs)
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    cited = F.col("citation_count") > 0
    flags = [
        (labeled & no(f"hit_at_{last}"), f"retrieval_source_miss_at_{last}"),
        (labeled & no("top1_class"), "retrieval_top1_classification_mismatch"),
        (~labeled & no("boundary_clear"), "equipment_boundary_retrieved_exact_equipment_source"),
        (cited & (F.col("traceability_rate") != 1.0), "citation_traceability_failure"),
        (cited & answered & no("marker_coverage"), "citation_marker_coverage_failure"),
        (cited & (F.size("expected_source_classifications") > 0) & F.coalesce(F.col("scope_alignment_rate") != 1.0, F.lit(True)), "citation_source_scope_misalignment"),
        (~cited & (F.col("expected_status") == "answered"), "answered_case_without_citation"),
        ((F.col("claim_count") > 0) & (F.col("supported_rate") != 1.0), "unsupported_cited_claim"),
        ((F.col("category") == "equipment_boundary") & no("refusal_boundary"), "equipment_refusal_boundary_failure"),
        (~F.col("status_match"), "unexpected_answer_status"),
        (~F.col("reason_match"), "unexpected_reason_code"),
        (~F.col("intent_match"), "unexpected_intent"),
        (F.coalesce(F.col("concept_coverage") < minimum, F.lit(False)), "low_usefulness_concept_coverage"),
    ]
    return d.withColumn("failure_flags", F.filter(F.array(*[F.when(c, F.lit(n)) for c, n in flags]), lambda x: x.isNotNull()))


def aggregate(results: DataFrame, cutoffs: tuple[int, ...] = CUTOFFS) -> DataFrame:
    """One row: each measure over the cases that it is defined for."""
    rate = lambda c: F.avg(F.col(c).cast("int")).alias(f"{c}_rate")
    share = lambda a, b, n: F.when(F.sum(b) > 0, F.sum(a) / F.sum(b)).alias(n)
    return results.agg(
        F.count(F.lit(1)).alias("case_count"), F.avg("reciprocal_rank").alias("mean_reciprocal_rank"), *[rate(f"hit_at_{k}") for k in cutoffs],
        F.avg(F.when(F.size("relevant_source_ids") > 0, F.col("top1_class").cast("int"))).alias("top1_class_rate"), rate("boundary_clear"), F.sum("citation_count").alias("citation_count"),
        share("traceable_count", "citation_count", "traceability_rate"), rate("marker_coverage"), share("aligned_count", "scoped_count", "scope_alignment_rate"),
        F.sum("claim_count").alias("claim_count"), share("supported_count", "claim_count", "supported_rate"), rate("refusal_boundary"), rate("status_match"), rate("reason_match"), rate("intent_match"),
        F.avg(F.when(F.col("expected_status") == "answered", F.col("concept_coverage"))).alias("mean_concept_coverage"), rate("useful"), F.count_if(F.size("failure_flags") > 0).alias("failure_case_count"),
    )
