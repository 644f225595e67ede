"""Contracts of settings and evidence, and rules over tables: every rule is broken once."""

import copy

import pytest

from millrace.operators import contracts as C
from millrace.operators import dataset_rules as R

EVENT = {
    "start": "2020-04-18T00:00:00",
    "prediction_window": {"start": "2020-04-17T00:00:00", "end": "2020-04-17T20:00:00"},
    "provenance": {"source_title": "t", "source_type": "paper", "source_identifier": "doi", "source_locator": "p. 3", "interpretation": "i", "accessed_on": "2024-01-31", "confidence": "documented", "dataset_match": "exact", "source_conflicts": ["a"]},
}
POLICY = {
    "timestamp_column": "timestamp", "expected_sampling_seconds": 10, "gap_threshold_seconds": 15, "pre_event_exclusion_hours": 1, "warning_horizon_hours": 24,
    "cross_segment_assignment_allowed": False, "unverified_rows_are_negative": False, "source_conflicts_create_labels": False, "states": {k: k for k in C.STATES.split()},
}
HELD_OUT = {
    "inputs": {}, "outputs": {"compression": "ZSTD"},
    "evaluation": {"partition": "test", "scoring_eligibility_column": "eligible_for_scoring", "known_event_eligibility_column": "eligible_for_known_event_evaluation", "alarm_burden_eligibility_column": "eligible_for_alarm_burden", "selected_threshold_quantile": 0.99, "expected_sampling_seconds": 10.0},
    "governance": {k: t for t, ks in ((True, "parameters_must_be_frozen threshold_must_match_validation_decision validation_must_precede_test one_time_test_evaluation no_refit_or_threshold_revision"), (False, "unverified_rows_are_verified_healthy alarm_burden_is_false_positive_rate advanced_model_comparison_enabled")) for k in ks.split()},
}
PARAMETERS = {"status": "frozen_before_validation", "test_partition_used": False, "threshold_quantile": 0.99, "threshold": 3.5, "retained_features": [{"feature": "a", "median": 1, "iqr": 2.0}, {"feature": "b", "median": 0.0, "iqr": 1.0}]}
VALIDATION = {"status": "valid", "governance": {"test_rows_scored": 0, "test_partition_locked": True}, "fit": {"threshold_quantile": 0.99, "threshold": 3.5}}
DIAGNOSIS = {"status": "valid", "decision": {"decision_status": "frozen_after_validation_diagnosis", "test_partition_remains_locked": True, "selected_threshold_quantile": 0.99}, "frozen_baseline": {"threshold": 3.5, "retained_feature_count": 2}}
FOREST = {
    "schema_version": 1, "inputs": {"features": "f"}, "outputs": {},
    "authorization": {"one_time_test_evaluation_authorized": True, "authorization_scope": "frozen_selected_candidate_only", "authorized_candidate_id": "c", "authorized_threshold": 0.6},
    "evaluation": HELD_OUT["evaluation"] | {"expected_retained_feature_count": 2, "matrix_dtype": "float32", "threshold_comparison": "strictly_greater_than"},
    "governance": {k: t for t, ks in ((True, "model_must_be_loaded_without_refit threshold_must_be_loaded_without_revision"), (False, "candidate_reselection_enabled feature_changes_enabled test_driven_model_change_enabled unverified_rows_are_verified_healthy alarm_burden_is_false_positive_rate unusualness_is_failure_probability unsupported_classification_metrics_enabled")) for k in ks.split()},
}
CASE = {"case_id": "1", "category": "general", "query": "q", "expected_status": "answered", "expected_reason_code": "r", "expected_intent": "general", "relevant_source_ids": ["s"], "expected_source_classifications": ["c"], "required_concepts": [["x"]]}
EVALUATION = {
    "schema_version": 1, "evaluation_id": "e", "report_path": "out/r.json", "frozen_artifacts": {"corpus_id": "c", "retrieval_id": "r", "grounding_id": "g", "expected_chunk_sha256": "0" * 64, "expected_retrieval_index_sha256": "0" * 64},
    "retrieval": {"evaluation_top_k": 8, "metric_cutoffs": [1, 3, 8]}, "usefulness": {"minimum_concept_coverage": 0.5}, "cases": [CASE], "limitations": ["a", "b", "c"],
}


def changed(value, path, new):
    out = copy.deepcopy(value)
    *inner, last = path.split(".")
    at = out
    for k in inner:
        at = at[k]
    at[last] = new
    return out


CHECKS = {
    "provenance": (EVENT, C.check_provenance), "window": (EVENT, lambda e: C.check_prediction_window(e, 4)), "policy": (POLICY, C.check_materialization), "held": (HELD_OUT, C.check_held_out),
    "frozen": ({"p": PARAMETERS, "v": VALIDATION, "d": DIAGNOSIS}, lambda x: C.check_frozen_inputs(x["p"], x["v"], x["d"], 0.99)),
    "forest": (FOREST, lambda x: C.check_forest_test(x, {"authorization.authorized_candidate_id": "c", "authorization.authorized_threshold": 0.6})),
    "evaluation": (EVALUATION, lambda x: C.check_evaluation(x, {"general"})),
}
BROKEN = [
    ("provenance", "provenance.source_locator", " "), ("provenance", "provenance.accessed_on", "31.1.2024"), ("provenance", "provenance.confidence", "sure"), ("provenance", "provenance.dataset_match", "related"),
    ("provenance", "provenance.source_conflicts", [""]), ("provenance", "provenance", None),
    ("window", "prediction_window.end", "2020-04-17T21:00:00"), ("window", "prediction_window.end", "2020-04-18T00:00:00"), ("window", "prediction_window.end", "2020-04-16T00:00:00"), ("window", "prediction_window", 5), ("window", "start", "soon"),
    ("policy", "gap_threshold_seconds", 10), ("policy", "warning_horizon_hours", 1), ("policy", "expected_sampling_seconds", True), ("policy", "unverified_rows_are_negative", True), ("policy", "states.warning", "unverified"), ("policy", "cross_segment_assignment_allowed", 0),
    ("held", "evaluation.partition", "validation"), ("held", "evaluation.selected_threshold_quantile", 1.0), ("held", "governance.one_time_test_evaluation", False), ("held", "governance.alarm_burden_is_false_positive_rate", True), ("held", "outputs.compression", "LZ4"), ("held", "inputs", []),
    ("frozen", "p.threshold", 3.6), ("frozen", "v.fit.threshold_quantile", 0.995), ("frozen", "v.governance.test_rows_scored", 1), ("frozen", "d.frozen_baseline.retained_feature_count", 3), ("frozen", "p.retained_features", []), ("frozen", "p.test_partition_used", True),
    ("frozen", "p.retained_features", [{"feature": "a", "median": 1, "iqr": 0.0}, {"feature": "b", "median": 1, "iqr": 1}]), ("frozen", "d.decision.decision_status", "open"),
    ("forest", "authorization.authorized_threshold", 0.7), ("forest", "governance.candidate_reselection_enabled", True), ("forest", "evaluation.matrix_dtype", "float64"),
    ("evaluation", "report_path", "../r.json"), ("evaluation", "retrieval.metric_cutoffs", [1, 9]), ("evaluation", "retrieval.metric_cutoffs", [3, 1]), ("evaluation", "limitations", ["a"]), ("evaluation", "cases", [CASE, CASE]), ("evaluation", "usefulness.minimum_concept_coverage", 1.5),
]


def test_sound_settings_pass():
    for value, run in CHECKS.values():
        run(value)
    assert C.check_provenance(EVENT) == ("documented", 1)
    assert C.check_prediction_window(changed(EVENT, "prediction_window", None), 4) is None
    assert C.check_frozen_inputs(PARAMETERS, VALIDATION, DIAGNOSIS, 0.99)[1] == 3.5
    C.check_materialization(changed(POLICY, "warning_horizon_hours", None))


@pytest.mark.parametrize(("which", "path", "new"), BROKEN)
def test_a_broken_rule_is_rejected(which, path, new):
    value, run = CHECKS[which]
    with pytest.raises(C.ContractError):
        run(changed(value, path, new))


def test_rules_over_a_table(spark):
    rows = [(1, 1.0, "a", 1, 2, "xy"), (1, float("nan"), "b", 3, 2, "xy"), (2, None, None, None, 2, "xyz"), (None, 2.0, "c", 1, 1, None), (None, 2.0, "a", 1, 1, "xy")]
    d = spark.createDataFrame(rows, "k long, x double, s string, a int, b int, t string")
    other = spark.createDataFrame([(1,), (1,), (3,), (None,)], "key long")
    rules = R.TableRules(
        (*R.present("k", "s"), *R.finite("x"), *R.one_of("s", ["a", "b"]), *R.in_order("a", "b"), *R.frozen("b", "length(t)")), unique=("k",), keys=("k",), names={"k": "key"}, least_rows=6
    )
    found = R.broken_rules(d, rules, other)
    assert {r["rule"]: r["broken"] for r in found.collect()} == {
        "k is missing": 2, "s is missing": 1, "x is not finite": 2, "s is none of the agreed values": 2, "a is after b": 2, "b is not what it was frozen from": 3,
        "k repeats": 2, "k is unknown to the other table": 1, "k of the other table is absent": 1, "fewer than 6 rows": 1,
    }
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 2  # each table once
    with pytest.raises(C.ContractError, match=r"k repeats \(2\)"):
        R.check_table("t", d, rules, other)
    R.check_table("t", d.where("k = 2"), R.TableRules(R.one_of("k", [2]) and (R.RowRule("two", "k = 2"),), unique=("k",)))
    empty = {r["rule"]: r["broken"] for r in R.broken_rules(d.limit(0), R.TableRules((R.RowRule("none", "x > 0"),), keys=("k",), partial=True, names={"k": "key"}), other).collect()}
    assert empty == {"none": 0, "k is unknown to the other table": 0, "fewer than 1 rows": 1}
