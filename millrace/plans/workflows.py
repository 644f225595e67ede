"""Whole stages: read a governed table, write the next one, return the report.

A stage's table is written before anything reads it twice, so no lazy plan runs again.
Reports are small dictionaries; ``write_report`` puts them beside the tables.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import normalize_text
from millrace.functions.time import lenient_timestamp, seconds_between
from millrace.operators import alarms, corpus, eligibility, evaluation, features, grounding, iforest, profile, robust, segments, targets
from millrace.operators.contracts import check_chain, check_chunks, check_test_lock
from millrace.sources import charts, files


def _rows(df: DataFrame) -> list[dict[str, Any]]:
    """A report table's rows; for tables of a few rows only."""
    return [r.asDict(recursive=True) for r in df.collect()]


def _saved(df: DataFrame, path: str, overwrite: bool, partition_by: tuple[str, ...] = ()) -> DataFrame:
    files.write_parquet(df, path, overwrite, partition_by=partition_by)
    return df.sparkSession.read.parquet(path)


def profile_csv(spark: SparkSession, path: str, header: tuple[str, ...] = files.HEADER, multiplier: float = 1.5, details: int = 20) -> dict[str, Any]:
    """Data quality of one raw CSV: widths, missing cells, coercion failures, states, repeats, order, cadence, gaps."""
    files.check_header(spark, path, header)
    raw = files.raw_csv(spark, path, header)
    names = [h or "C0" for h in header]
    numeric, binary = [n for n in names if n != "timestamp"], [n for n in names if n in files.BINARY]
    raw = raw.withColumn("__ts", lenient_timestamp(F.col("timestamp")))
    iv = profile.intervals(raw, "__ts", "position")
    cadence = _rows(profile.cadence(iv, multiplier))
    limit = cadence[0]["gap_threshold_seconds"] if cadence else None
    head = raw.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("width") != len(header)).alias("row_width_mismatches"), F.count_if(F.col("__ts").isNull()).alias("timestamp_parse_failures"), F.min("__ts").alias("first"), F.max("__ts").alias("last"))
    return _rows(head)[0] | {
        "missing": {r["column"]: r["missing"] for r in _rows(profile.missing(raw, names))},
        "coercion_failures": {r["column"]: r["failures"] for r in _rows(profile.coercion_failures(raw, numeric))},
        "non_finite": {r["column"]: r["non_finite"] for r in _rows(profile.non_finite(raw, numeric))},
        "invalid_binary": _rows(profile.invalid_binary(raw, binary).orderBy(F.desc("rows"), "column", "raw_value").limit(100)) if binary else [],
        "duplicates": _rows(profile.duplicates(raw, names))[0],
        "intervals": _rows(profile.interval_classes(iv))[0],
        "top_intervals": _rows(profile.interval_histogram(iv)),
        "cadence": cadence[0] if cadence else None,
        "gap_details": _rows(profile.gap_details(iv, limit, details)) if limit is not None else [],
    }


def explore(sensor: DataFrame, continuous: list[str], binary: list[str], gap_seconds: float, gap_rows: int = 20, ts: str = "timestamp") -> dict[str, Any]:
    """Coverage, summaries, states, segments and largest gaps, reconciled with each other, and two charts.

    A series without a gap has no largest gaps; its largest interval is told all the same (null for a single row).
    """
    seg = segments.segment_summary(segments.segment(sensor, gap_seconds, ts)).cache()
    n, totals = sensor.count(), seg.agg(F.count(F.lit(1)).alias("s"), F.sum("row_count").alias("r")).first()
    gap_count = segments.gaps(sensor, gap_seconds, ts).count()
    largest = segments.with_previous(sensor, ts).agg(F.max(seconds_between(F.col("previous_timestamp"), F.col(ts))).alias("s")).first()["s"]
    segments.check_segments(n, totals["r"] or 0, totals["s"], gap_count)
    summary = _rows(segments.signal_summary(sensor, continuous).orderBy("signal"))
    states = _rows(segments.state_frequencies(sensor, binary).orderBy("signal", "state"))
    return {
        "coverage": _rows(segments.coverage(sensor, ts))[0], "signals": summary, "states": states, "segment_count": totals["s"], "gap_count": gap_count, "largest_interval_seconds": largest,
        "largest_gaps": _rows(segments.largest_gaps(sensor, gap_seconds, gap_rows, ts)), "charts": {"states": charts.state_bars(states), "signals": charts.quantile_strips(summary)},
    }


def materialize_targets(sensor: DataFrame, spec: targets.TargetSpec, path: str, overwrite: bool = False, ts: str = "timestamp") -> dict[str, Any]:
    spec.validate()
    targets.validate_input(sensor, ts)
    out = _saved(targets.states(sensor.select(ts), spec, ts), path, overwrite)
    return {"rows": out.count(), "counts": _rows(targets.state_counts(out).orderBy("partition", "target_state")), "segments": out.agg(F.count_distinct("segment_id").alias("n")).first()["n"]}


def engineer_features(sensor: DataFrame, governed: DataFrame, continuous: list[str], path: str, overwrite: bool = False, ts: str = "timestamp") -> dict[str, Any]:
    """Both tables must have exactly the same timestamps."""
    lost = features.unmatched(sensor, governed, ts).first()
    if lost["left_only"] or lost["right_only"]:
        raise files.GovernanceError(f"{lost['left_only']} and {lost['right_only']} rows have no partner")
    out = _saved(features.engineer(sensor, governed, continuous, ts), path, overwrite)
    return {"rows": out.count(), "columns": len(out.columns), "history_groups": out.agg(F.count_distinct("history_group_id").alias("n")).first()["n"]}


def validate_eligibility(engineered: DataFrame, path: str, overwrite: bool = False) -> dict[str, Any]:
    eligibility.check_chronology(engineered)
    keep = ["timestamp", "segment_id", "partition", "target_state", "binary_target", "source_event", "exclusion_reason", "has_full_30_row_history"]
    out = _saved(eligibility.eligibility(engineered.select(*keep)), path, overwrite)
    return {"flags": _rows(eligibility.flag_counts(out))[0], "roles": _rows(eligibility.role_counts(out).orderBy("evaluation_role"))}


def _measured(scored: DataFrame, sampling: float) -> dict[str, Any]:
    return {"events": _rows(alarms.event_evidence(scored).orderBy("first_scored_timestamp")), "burden": _rows(alarms.burden(scored, sampling))[0], "runs": _rows(alarms.longest_run(scored, sampling).orderBy("source_event"))}


def robust_distance(engineered: DataFrame, path: str, sampling: float, quantile: float = 0.995, partition: str = "validation", names: list[str] | None = None, frozen: robust.Fit | None = None, overwrite: bool = False) -> tuple[robust.Fit, dict[str, Any]]:
    """Fit on training rows and score one partition; with ``frozen`` parameters nothing is fitted again."""
    if frozen is None:
        fit, scored = robust.run(engineered, quantile, partition, names)
    else:
        fit, held = frozen, engineered.where((F.col("partition") == partition) & F.col("eligible_for_scoring"))
        robust.check_complete(held, fit.retained)
        cols = ["timestamp", "segment_id", "partition", "target_state", "source_event", "eligible_for_known_event_evaluation", "eligible_for_alarm_burden"]
        scored = robust.with_alarm(held.select(*cols, robust.score(fit.retained).alias("robust_distance_score")), "robust_distance_score", fit.threshold)
    out = _saved(scored, path, overwrite)
    n = out.count()
    if not n or out.where(F.col("partition") != partition).count():
        raise files.GovernanceError("the scored population is empty or of another partition")
    return fit, {"rows": n, "threshold": fit.threshold, "retained": len(fit.retained), "excluded": list(fit.excluded), "summary": _rows(robust.score_summary(out, "robust_distance_score"))[0]} | _measured(out, sampling)


def diagnose(engineered: DataFrame, scores: DataFrame, fit: robust.Fit, states: list[str], quantiles: tuple[float, ...], ratio: float = 0.01, top: int = 10) -> dict[str, Any]:
    rows = robust.diagnostic_rows(engineered, engineered, scores, fit.retained)
    held = rows.where("partition = 'validation' and eligible_for_scoring").cache()
    train = rows.where("partition = 'train' and eligible_for_reference_fit").cache()
    found = []
    for q in quantiles:
        limit = robust.threshold(train, q)
        found.append({"quantile": q, "threshold": limit} | _rows(alarms.candidate_metrics(robust.with_alarm(held.drop("alarm"), "robust_distance_score", limit), 1.0))[0])
    return {
        "dominant": _rows(robust.dominant_counts(held, top)), "segments": _rows(robust.alarms_by_segment(held, top)), "hours": _rows(robust.alarms_by_hour(held).orderBy("hour_utc")), "states": _rows(robust.alarms_by_state(held, states, top)),
        "small_ranges": [(p.feature, p.iqr) for p in robust.small_ranges(fit.retained, ratio)], "candidates": found,
    }


def compare_forests(engineered: DataFrame, names: list[str], grid: list[iforest.Candidate], sampling: float, key: str = "timestamp", quantile: float = 0.995) -> tuple[iforest.Forest, dict[str, Any]]:
    """Every candidate on the same rows; thresholds from training scores; the best by the fixed order, on validation rows alone."""
    from millrace.plans.tables import cut

    wanted = [*dict.fromkeys([key, "timestamp", "partition", "source_event", *eligibility.FLAGS, *names])]
    d = cut(engineered.where(F.col("partition").isin("train", "validation")).select(*wanted))
    train, held = d.where("eligible_for_reference_fit"), d.where("partition = 'validation' and eligible_for_scoring")
    made, rows = {}, None
    for c in grid:
        f = iforest.fit(train, names, c, key)
        s = iforest.score(train, f)
        limit = robust.threshold(s, quantile, "anomaly_score")
        scored = robust.with_alarm(iforest.score(held, f), "anomaly_score", limit)
        m = alarms.candidate_metrics(scored, sampling).withColumn("complexity_rank", F.lit(c.complexity_rank)).withColumn("candidate_id", F.lit(c.candidate_id)).withColumn("threshold", F.lit(limit))
        m = cut(m)
        made[c.candidate_id] = f
        rows = m if rows is None else rows.unionByName(m)
    best = alarms.select_model(rows).first().asDict()
    return made[best["candidate_id"]], {"candidates": _rows(rows.orderBy("complexity_rank")), "selected": best}


def forest_held_out(engineered: DataFrame, forest: iforest.Forest, selected: dict[str, Any], sampling: float, state: dict[str, Any]) -> dict[str, Any]:
    """The one evaluation on test rows; ``state`` says that the method is frozen and the test unopened."""
    check_test_lock(state)
    check_chain({"selected_candidate": selected["candidate_id"], "threshold": selected["threshold"]}, state)
    held = engineered.where("partition = 'test' and eligible_for_scoring")
    scored = robust.with_alarm(iforest.score(held, forest), "anomaly_score", selected["threshold"])
    return _measured(scored, sampling) | {"summary": _rows(robust.score_summary(scored, "anomaly_score"))[0]}


def build_corpus(units: DataFrame, path: str, max_words: int = 220, overlap: int = 40, html: bool = False, markers: list[str] | None = None, minimum_words: int = 1, overwrite: bool = False) -> dict[str, Any]:
    """Units (source_id, unit_index, locator, text) to checked chunk files."""
    text = corpus.visible_text("text") if html else F.col("text")
    clean = units.withColumn("text", normalize_text(text))
    checks = corpus.source_checks(clean, markers or [], minimum_words)
    poor = [r["source_id"] for r in checks.where("not enough_words or size(missing_markers) > 0").limit(100).collect()]
    if poor:
        raise files.GovernanceError(f"incomplete sources: {poor}")
    files.write_chunks(corpus.chunks(clean, max_words, overlap), path, overwrite)
    made = files.read_chunks(units.sparkSession, path)
    check_chunks(made)
    return {"chunks": made.count(), "sources": checks.count()}


def evaluate_answers(cases: DataFrame, retrieved: DataFrame, g: grounding.Grounding = grounding.Grounding()) -> dict[str, Any]:
    """Cases (case_id, query, expectations) and their retrieved candidates, through reranking and answers, to measures and failures."""
    rr = grounding.rerank(retrieved.withColumnRenamed("case_id", "query_id"), g)
    answers = grounding.answers(cases.select(F.col("case_id").alias("query_id"), "query"), rr, g).withColumnRenamed("query_id", "case_id")
    results = evaluation.evaluate(cases.drop("query"), retrieved, rr.withColumnRenamed("query_id", "case_id"), answers).cache()
    return {"summary": _rows(evaluation.aggregate(results))[0], "failures": _rows(results.where("size(failure_flags) > 0").select("case_id", "failure_flags").orderBy("case_id"))}


def write_report(report: dict[str, Any], path: str) -> None:
    import json

    files.write_json(json.loads(json.dumps(report, default=str)), path)
