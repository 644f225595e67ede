"""Contracts that reject: rules over nested settings, declared as data.

A contract is a list of rules ``(path, test)``; ``check`` reports every broken rule at once.
Tests are plain values (must be equal, booleans strictly) or the predicates below.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from datetime import date, datetime
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    """Settings or evidence that weaken what was agreed."""

    def __init__(self, name: str, broken: list[str]):
        super().__init__(f"{name}: " + "; ".join(broken))
        self.broken = broken


Test = Any
Rule = tuple[str, Test]
_MISSING = object()


def at(value: Any, path: str) -> Any:
    for part in path.split("."):
        value = value.get(part, _MISSING) if isinstance(value, dict) else _MISSING
    return value


def _holds(value: Any, test: Test) -> bool:
    if callable(test):
        return value is not _MISSING and bool(test(value))
    return type(value) is type(test) and value == test


def check(name: str, value: Any, rules: list[Rule], *more: tuple[str, Callable[[dict], bool]]) -> None:
    """Raises with all broken rules. ``more``: named conditions between several settings, tested if the rules hold."""
    if not isinstance(value, dict):
        raise ContractError(name, ["not an object"])
    broken = [p if callable(t) else f"{p} must be {t!r}" for p, t in rules if not _holds(at(value, p), t)]
    broken = broken or [what for what, ok in more if not ok(value)]
    if broken:
        raise ContractError(name, broken)


def text(x: Any) -> bool:
    return isinstance(x, str) and bool(x.strip())


def sha256(x: Any) -> bool:
    return isinstance(x, str) and re.fullmatch(r"[0-9a-f]{64}", x) is not None


def integer(low: int = 1, high: int | None = None) -> Callable[[Any], bool]:
    return lambda x: isinstance(x, int) and not isinstance(x, bool) and x >= low and (high is None or x <= high)


def number(x: Any) -> bool:
    return isinstance(x, int | float) and not isinstance(x, bool) and math.isfinite(x)


def weight(x: Any) -> bool:
    return number(x) and 0 <= x <= 1


def quantile(x: Any) -> bool:
    return number(x) and 0 < x < 1


def flag(x: Any) -> bool:
    return isinstance(x, bool)


def names(x: Any) -> bool:
    """A filled list of different names."""
    return isinstance(x, list) and bool(x) and all(map(text, x)) and len(set(x)) == len(x)


def texts(x: Any) -> bool:
    return isinstance(x, list) and all(map(text, x))


def has(*needed: str) -> Callable[[Any], bool]:
    return lambda x: isinstance(x, list) and set(needed) <= set(x)


def exactly(*needed: str) -> Callable[[Any], bool]:
    return lambda x: isinstance(x, list) and set(needed) == set(x)


def every(prefix: str, keys: str, test: Test) -> list[Rule]:
    return [(f"{prefix}.{k}" if prefix else k, test) for k in keys.split()]


# What each stage's settings have to say.
PARTITIONS = ["train", "validation", "test"]

FEATURES: list[Rule] = [
    ("feature_contract.causal_direction", "current_and_past_only"),
    *every("feature_contract", "history_reset_on_segment_change history_reset_on_partition_change rolling_windows_include_current_row", True),
    *every("governance", "unverified_rows_are_negative model_training_enabled performance_reporting_enabled learned_preprocessing_enabled", False),
    ("governance.learned_preprocessing_fit_scope", "eligible_training_rows_only_if_enabled"),
    ("feature_contract.continuous_signals", names), ("feature_contract.operating_state_signals", names),
    ("feature_contract.lag_rows", [1]), ("feature_contract.difference_lag_rows", 1), ("feature_contract.rolling_windows_rows", [6, 30]), ("feature_contract.rolling_statistics", ["mean", "stddev_population"]),
    *every("dataset", "sensor_parquet_sha256 target_states_parquet_sha256", sha256), ("outputs", lambda x: isinstance(x, dict)),
]

BASELINE: list[Rule] = [
    ("population.partition_order", PARTITIONS), ("population.unverified_rows_are_negative", False),
    ("population.reference_population_interpretation", "unlabeled_operational_reference_not_verified_healthy"), *every("population", "require_no_exclusion_reason require_full_30_row_history", True),
    ("baseline.family", "training_reference_robust_distance"), ("baseline.preprocessing.fit_partition", "train"),
    *every("baseline.preprocessing", "fit_on_eligible_reference_rows_only apply_frozen_parameters_to_later_partitions", True),
    ("baseline.alarm_threshold.fit_partition", "train"), ("baseline.alarm_threshold.quantile", quantile), *every("baseline.alarm_threshold", "freeze_before_validation test_partition_locked_until_method_is_frozen", True),
    *every("evaluation", "chronological_only segment_safe validation_precedes_test", True), ("evaluation.alarm_burden_is_false_positive_rate", False),
    ("evaluation.unsupported_metrics", has("accuracy", "precision", "specificity", "false_positive_rate", "roc_auc")),
    *every("governance", "learned_preprocessing_enabled_for_this_validation model_fitting_enabled_for_this_validation score_generation_enabled_for_this_validation alarm_generation_enabled_for_this_validation performance_reporting_enabled_for_this_validation", False),
]

ROBUST: list[Rule] = [
    ("fit.partition", "train"), ("fit.eligibility_column", "eligible_for_reference_fit"), ("fit.location", "median"), ("fit.scale", "interquartile_range"), ("fit.zero_iqr_policy", "exclude_feature_and_record_reason"),
    ("score.threshold_quantile", quantile), ("score.threshold_fit_population", "eligible_training_reference_scores"), ("score.threshold_frozen_before_validation", True),
    ("validation.partition", "validation"), ("validation.test_partition_locked", True),
]

DIAGNOSIS: list[Rule] = [
    *every("governance", "parameters_must_be_frozen threshold_candidates_training_derived_only validation_only_diagnosis test_partition_locked", True),
    *every("governance", "unverified_rows_are_verified_healthy alarm_burden_is_false_positive_rate", False),
    ("diagnosis.threshold_quantiles", lambda x: isinstance(x, list) and 1 <= len(x) <= 5 and all(map(quantile, x))), ("diagnosis.operating_state_features", names), ("diagnosis.top_operating_state_count", integer()),
]

COMPARISON: list[Rule] = [
    ("schema_version", 1), ("population.partition_order", PARTITIONS), ("population.development_partitions", ["train", "validation"]), ("population.test_partition_access_enabled", False),
    ("population.fit_partition", "train"), ("population.selection_partition", "validation"),
    ("population.fit_eligibility_column", "eligible_for_reference_fit"), ("population.scoring_eligibility_column", "eligible_for_scoring"),
    ("population.known_event_eligibility_column", "eligible_for_known_event_evaluation"), ("population.alarm_burden_eligibility_column", "eligible_for_alarm_burden"),
    ("population.documented_positive_state", "documented_failure"), ("population.unlabeled_state", "unverified"), ("population.unverified_rows_are_verified_healthy", False),
    *every("population", "require_no_exclusion_reason require_full_30_row_history chronological_only segment_safe partition_bounded", True),
    ("candidate_model.family", "isolation_forest"), ("candidate_model.objective", "unsupervised_anomaly_scoring"),
    *every("candidate_model.features", "same_features_for_every_candidate test_data_feature_selection_prohibited", True),
    ("candidate_model.preprocessing.fit_scope", "eligible_training_reference_rows_only"), ("candidate_model.preprocessing.missing_or_nonfinite_policy", "reject_before_fit"), ("candidate_model.preprocessing.scaling", "none"),
    *every("candidate_model.preprocessing", "validation_fit_prohibited test_fit_prohibited", True),
    ("candidate_model.fixed_parameters", {"contamination": "auto", "bootstrap": False, "random_state": 42, "n_jobs": -1}),
    ("candidate_model.bounded_grid", {"n_estimators": [100, 200], "max_samples": [1024, 4096], "max_features": [0.5, 1.0]}), ("candidate_model.candidate_count", 8),
    ("candidate_model.score", {"method": "negative_score_samples", "direction": "higher_is_more_unusual"}),
    ("candidate_model.alarm_threshold.method", "eligible_training_score_quantile"), ("candidate_model.alarm_threshold.quantile", 0.995), ("candidate_model.alarm_threshold.fit_partition", "train"),
    *every("candidate_model.alarm_threshold", "freeze_before_validation validation_threshold_tuning_prohibited test_threshold_tuning_prohibited", True),
    ("validation_selection.partition", "validation"), ("validation_selection.test_evidence_available_to_selection", False), ("validation_selection.rule", "lexicographic"),
    ("validation_selection.complexity_tie_break_order", ["n_estimators", "max_samples", "max_features"]),
    ("validation_selection.supported_metrics", exactly("documented_event_coverage", "first_alarm_latency_seconds", "alarm_contiguity_within_documented_event", "alarm_burden_fraction", "alarms_per_24_observed_hours", "score_distribution_drift")),
    ("validation_selection.unsupported_metrics", exactly("accuracy", "precision", "recall_as_population_sensitivity", "specificity", "false_positive_rate", "roc_auc", "failure_probability")),
    ("validation_selection.alarm_burden_is_false_positive_rate", False),
    *every("test_lock", "locked one_time_future_evaluation baseline_test_evidence_cannot_select_candidate", True),
    *every("governance", "model_fitting_enabled_for_this_validation learned_preprocessing_enabled_for_this_validation candidate_scoring_enabled_for_this_validation candidate_selection_enabled_for_this_validation advanced_test_evaluation_enabled_for_this_validation baseline_revision_enabled performance_claims_enabled_for_this_validation", False),
]

RETRIEVAL: list[Rule] = [
    ("schema_version", 1), *[(k, text) for k in "retrieval_id corpus_id input_chunk_path index_path report_path".split()],
    ("reproducibility.expected_chunk_count", integer()), ("reproducibility.expected_chunk_sha256", sha256),
    *every("keyword", "lowercase sublinear_tf", flag), *every("keyword", "ngram_min ngram_max min_df max_features", integer()),
    ("embedding.method", "lsa_tfidf"), ("embedding.algorithm", "randomized"), ("embedding.dimension", integer(2)), ("embedding.n_iter", integer()), ("embedding.random_state", integer(-(1 << 62))),
    *every("hybrid", "vector_weight keyword_weight", weight), *every("hybrid", "candidate_k default_top_k maximum_top_k", integer()),
]

CORPUS: list[Rule] = [
    ("schema_version", 1), ("corpus_id", text), *every("chunking", "max_words minimum_words", integer()), ("chunking.overlap_words", integer(0)), ("sources", lambda x: isinstance(x, list) and bool(x)),
]

APPLICATION: list[Rule] = [
    ("schema_version", 1), ("application_id", text), *every("api", "title version prefix", text), ("api.query_max_characters", integer(1, 10_000)), ("api.retrieval_default_top_k", integer()),
    ("api.retrieval_max_top_k", integer(1, 100)), ("api.history_default_limit", integer()), ("api.history_max_limit", integer(1, 1000)),
    ("server.host", text), ("server.port", integer(1, 65_535)), ("server.require_loopback_bind", flag),
    ("persistence.max_records", integer(1, 100_000)), ("persistence.max_evaluations", integer(1, 100_000)), ("persistence.max_events", integer(1, 200_000)),
    ("prediction.model_sha256", sha256), ("prediction.candidate_id", text), ("prediction.threshold", number), ("prediction.retained_feature_count", integer(1, 10_000)),
    ("prediction.matrix_dtype", "float32"), ("prediction.threshold_comparison", "strictly_greater_than"), *every("knowledge", "chunk_sha256 retrieval_index_sha256", sha256),
    ("security.allowed_environment_variables", texts), *every("security", "persist_raw_feature_values authentication_enabled", flag), *every("security", "persist_request_headers public_network_exposure_allowed", False),
]


# What documented events have to say of their sources.
CONFIDENCE, DATASET_MATCH = ("documented", "derived", "ambiguous"), ("exact", "related", "unknown")

PROVENANCE: list[Rule] = [
    *every("provenance", "source_title source_type source_identifier source_locator interpretation", text), ("provenance.accessed_on", lambda x: text(x) and _day(x) is not None),
    ("provenance.confidence", lambda x: x in CONFIDENCE), ("provenance.dataset_match", lambda x: x in DATASET_MATCH), ("provenance.source_conflicts", texts),
]

STATES = "documented_failure warning pre_event_exclusion partition_buffer_exclusion unverified"

MATERIALIZATION: list[Rule] = [
    ("timestamp_column", text), *every("", "expected_sampling_seconds gap_threshold_seconds pre_event_exclusion_hours", lambda x: number(x) and x > 0), ("warning_horizon_hours", lambda x: x is None or (number(x) and x > 0)),
    *every("", "cross_segment_assignment_allowed unverified_rows_are_negative source_conflicts_create_labels", False), *every("states", STATES, text),
]

HELD_OUT: list[Rule] = [
    ("inputs", lambda x: isinstance(x, dict)), ("evaluation.partition", "test"), ("evaluation.scoring_eligibility_column", "eligible_for_scoring"), ("evaluation.known_event_eligibility_column", "eligible_for_known_event_evaluation"),
    ("evaluation.alarm_burden_eligibility_column", "eligible_for_alarm_burden"), ("evaluation.selected_threshold_quantile", quantile), ("evaluation.expected_sampling_seconds", lambda x: number(x) and x > 0),
    *every("governance", "parameters_must_be_frozen threshold_must_match_validation_decision validation_must_precede_test one_time_test_evaluation no_refit_or_threshold_revision", True),
    *every("governance", "unverified_rows_are_verified_healthy alarm_burden_is_false_positive_rate advanced_model_comparison_enabled", False), ("outputs.compression", lambda x: x in ("ZSTD", "SNAPPY", "GZIP")),
]


def _moment(x: Any) -> datetime | None:
    try:
        return datetime.fromisoformat(x) if text(x) else None
    except ValueError:
        return None


def _day(x: str) -> date | None:
    try:
        return date.fromisoformat(x)
    except ValueError:
        return None


def check_provenance(event: dict) -> tuple[str, int]:
    """(confidence, number of recorded conflicts) of a documented event: where it stands, when that was read, how sure it is."""
    check("provenance", event, PROVENANCE, ("what is documented must match the dataset exactly", lambda v: at(v, "provenance.confidence") != "documented" or at(v, "provenance.dataset_match") == "exact"))
    return event["provenance"]["confidence"], len(event["provenance"]["source_conflicts"])


def check_prediction_window(event: dict, minimum_warning_hours: float) -> tuple[datetime, datetime] | None:
    """An event's window for predictions, if it has one: before the event, by the agreed hours at least."""
    if event.get("prediction_window") is None:
        return None
    is_time = lambda x: _moment(x) is not None
    gap = lambda v: _moment(v["start"]) - _moment(at(v, "prediction_window.end"))
    check(
        "prediction window", event, [("start", is_time), *every("prediction_window", "start end", is_time)],
        ("the window ends before it starts", lambda v: _moment(at(v, "prediction_window.start")) <= _moment(at(v, "prediction_window.end"))),
        ("the window must end before the event starts", lambda v: gap(v).total_seconds() > 0),
        (f"the window must end {minimum_warning_hours} hours before the event", lambda v: gap(v).total_seconds() >= minimum_warning_hours * 3600),
    )
    return _moment(event["prediction_window"]["start"]), _moment(event["prediction_window"]["end"])


def check_materialization(policy: dict) -> None:
    """How rows get their states: no label across a gap, none from an unsettled source, and nothing unverified counts as healthy."""
    check(
        "materialization policy", policy, MATERIALIZATION,
        ("the gap threshold must exceed the sampling interval", lambda v: v["gap_threshold_seconds"] > v["expected_sampling_seconds"]),
        ("the warning horizon must exceed the exclusion", lambda v: v["warning_horizon_hours"] is None or v["warning_horizon_hours"] > v["pre_event_exclusion_hours"]),
        ("state names repeat", lambda v: len({v["states"][k] for k in STATES.split()}) == len(STATES.split())),
    )


def check_held_out(contract: dict) -> None:
    """One look at the test partition: no refit, no new threshold, no healthy rows made up, no burden called a false positive rate."""
    check("held-out contract", contract, HELD_OUT)


def check_frozen_inputs(parameters: dict, validation: dict, diagnosis: dict, expected_quantile: float) -> tuple[list[dict[str, Any]], float]:
    """(retained features, threshold) if parameters, validation and diagnosis are one unbroken chain that never met the test partition."""

    def features(x: Any) -> bool:
        sound = isinstance(x, list) and bool(x) and all(isinstance(f, dict) and text(f.get("feature")) and number(f.get("median")) and number(f.get("iqr")) and f["iqr"] > 0 for f in x)
        return sound and len({f["feature"] for f in x}) == len(x)

    both = {"parameters": parameters, "validation": validation, "diagnosis": diagnosis}
    same = lambda v, *paths: len({float(at(v, p)) for p in paths}) == 1
    quantiles = ("parameters.threshold_quantile", "validation.fit.threshold_quantile", "diagnosis.decision.selected_threshold_quantile")
    thresholds = ("parameters.threshold", "validation.fit.threshold", "diagnosis.frozen_baseline.threshold")
    check(
        "frozen inputs", both,
        [
            ("parameters.status", "frozen_before_validation"), ("parameters.test_partition_used", False), ("parameters.retained_features", features),
            ("validation.status", "valid"), ("validation.governance.test_rows_scored", 0), ("validation.governance.test_partition_locked", True),
            ("diagnosis.status", "valid"), ("diagnosis.decision.decision_status", "frozen_after_validation_diagnosis"), ("diagnosis.decision.test_partition_remains_locked", True),
            *[(p, number) for p in (*quantiles, *thresholds)], ("diagnosis.frozen_baseline.retained_feature_count", integer()),
        ],
        ("the threshold quantile differs across evidence", lambda v: same(v, *quantiles) and float(at(v, quantiles[0])) == float(expected_quantile)),
        ("the threshold differs across evidence", lambda v: same(v, *thresholds)),
        ("the number of retained features differs from the diagnosis", lambda v: at(v, "diagnosis.frozen_baseline.retained_feature_count") == len(v["parameters"]["retained_features"])),
    )
    kept = [{"feature": f["feature"], "median": float(f["median"]), "iqr": float(f["iqr"])} for f in parameters["retained_features"]]
    return kept, float(parameters["threshold"])


FOREST_TEST: list[Rule] = [
    ("schema_version", 1), ("authorization.one_time_test_evaluation_authorized", True), ("authorization.authorization_scope", "frozen_selected_candidate_only"),
    ("authorization.authorized_candidate_id", text), ("authorization.authorized_threshold", number), ("inputs", lambda x: isinstance(x, dict) and bool(x) and all(map(text, x.values()))),
    ("evaluation.partition", "test"), ("evaluation.scoring_eligibility_column", "eligible_for_scoring"), ("evaluation.known_event_eligibility_column", "eligible_for_known_event_evaluation"),
    ("evaluation.alarm_burden_eligibility_column", "eligible_for_alarm_burden"), ("evaluation.expected_retained_feature_count", integer()), ("evaluation.expected_sampling_seconds", lambda x: number(x) and x > 0),
    ("evaluation.matrix_dtype", "float32"), ("evaluation.threshold_comparison", "strictly_greater_than"), *every("governance", "model_must_be_loaded_without_refit threshold_must_be_loaded_without_revision", True),
    *every("governance", "candidate_reselection_enabled feature_changes_enabled test_driven_model_change_enabled unverified_rows_are_verified_healthy alarm_burden_is_false_positive_rate unusualness_is_failure_probability unsupported_classification_metrics_enabled", False),
    ("outputs", lambda x: isinstance(x, dict)),
]

EVALUATION: list[Rule] = [
    ("schema_version", 1), ("evaluation_id", text), ("report_path", lambda x: text(x) and not x.startswith("/") and ".." not in x.split("/")), *every("frozen_artifacts", "corpus_id retrieval_id grounding_id", text),
    *every("frozen_artifacts", "expected_chunk_sha256 expected_retrieval_index_sha256", sha256), ("retrieval.evaluation_top_k", integer()),
    ("retrieval.metric_cutoffs", lambda x: isinstance(x, list) and bool(x) and all(map(integer(), x)) and x == sorted(set(x))), ("usefulness.minimum_concept_coverage", weight),
    ("cases", lambda x: isinstance(x, list) and bool(x)), ("limitations", lambda x: texts(x) and len(x) >= 3),
]


def check_forest_test(contract: dict, frozen: dict[str, Any]) -> None:
    """The one authorized look of a frozen forest at the test partition. ``frozen``: what was agreed on before, by path: candidate, threshold, inputs."""
    check("forest test contract", contract, [*FOREST_TEST, *[(k, v) for k, v in frozen.items()]])


def check_evaluation(c: dict, categories: set[str]) -> None:
    """Settings of an evaluation run, its cases with them."""
    check("evaluation settings", c, EVALUATION, ("a cutoff exceeds evaluation_top_k", lambda v: max(v["retrieval"]["metric_cutoffs"]) <= v["retrieval"]["evaluation_top_k"]))
    check_cases(c["cases"], categories)


def check_features(c: dict) -> None:
    f = lambda v: at(v, "feature_contract.continuous_signals") + at(v, "feature_contract.operating_state_signals")
    check("feature contract", c, FEATURES, ("signal names repeat", lambda v: len(set(f(v))) == len(f(v))))


def check_baseline(c: dict) -> None:
    check("baseline contract", c, BASELINE, ("fit_state must be the unlabeled state", lambda v: at(v, "baseline.preprocessing.fit_state") == at(v, "population.unlabeled_reference_state")))


def check_robust(c: dict) -> None:
    check("robust contract", c, ROBUST)


def check_diagnosis(c: dict) -> None:
    check("diagnosis contract", c, DIAGNOSIS, ("the selected quantile isn't a candidate", lambda v: v["diagnosis"].get("selected_threshold_quantile") in v["diagnosis"]["threshold_quantiles"]))


def check_comparison(c: dict) -> None:
    check("comparison contract", c, COMPARISON)


def check_retrieval(c: dict) -> None:
    h = lambda v, k: v["hybrid"][k]
    check(
        "retrieval settings", c, RETRIEVAL,
        ("ngram_min exceeds ngram_max", lambda v: v["keyword"]["ngram_min"] <= v["keyword"]["ngram_max"]),
        ("hybrid weights must add up to 1", lambda v: math.isclose(h(v, "vector_weight") + h(v, "keyword_weight"), 1.0, abs_tol=1e-12)),
        ("default_top_k exceeds maximum_top_k", lambda v: h(v, "default_top_k") <= h(v, "maximum_top_k")),
        ("maximum_top_k exceeds candidate_k", lambda v: h(v, "maximum_top_k") <= h(v, "candidate_k")),
    )


def check_corpus(c: dict) -> None:
    check(
        "corpus settings", c, CORPUS,
        ("the overlap must be smaller than the chunk", lambda v: v["chunking"]["overlap_words"] < v["chunking"]["max_words"]),
        ("minimum_words exceeds max_words", lambda v: v["chunking"]["minimum_words"] <= v["chunking"]["max_words"]),
        ("source ids repeat", lambda v: len({s.get("source_id") for s in v["sources"]}) == len(v["sources"])),
    )


def check_application(c: dict) -> None:
    reject_secrets(c)
    check(
        "application settings", c, APPLICATION,
        ("api.prefix must start with / and not end with it", lambda v: v["api"]["prefix"].startswith("/") and not v["api"]["prefix"].endswith("/")),
        ("retrieval_default_top_k exceeds the maximum", lambda v: v["api"]["retrieval_default_top_k"] <= v["api"]["retrieval_max_top_k"]),
        ("history_default_limit exceeds the maximum", lambda v: v["api"]["history_default_limit"] <= v["api"]["history_max_limit"]),
        ("server.host must be loopback", lambda v: not v["server"]["require_loopback_bind"] or v["server"]["host"] in ("127.0.0.1", "localhost", "::1")),
    )


_SECRET = re.compile(r"(^|_)(password|passwd|secret|token|api_?key|private_key|credential)s?($|_)", re.I)


def reject_secrets(value: Any, path: str = "") -> None:
    """Settings may name environment variables, never hold a secret."""
    if isinstance(value, dict):
        for k, v in value.items():
            if _SECRET.search(str(k)) and isinstance(v, str) and v:
                raise ContractError("settings", [f"{path}{k} holds a secret"])
            reject_secrets(v, f"{path}{k}.")
    elif isinstance(value, list):
        for v in value:
            reject_secrets(v, path)


CASE: list[Rule] = [
    *[(k, text) for k in "case_id category query expected_status expected_reason_code expected_intent".split()], *[(k, texts) for k in "relevant_source_ids expected_source_classifications".split()],
    ("expected_status", lambda x: x in ("answered", "insufficient_evidence")), ("required_concepts", lambda x: isinstance(x, list) and all(texts(g) and g for g in x)),
]


def check_cases(cases: list[dict], categories: set[str]) -> None:
    """Boundary cases expect a refusal and assert no source; all others expect an answer and say from where."""
    seen: set[str] = set()
    asserted = ("relevant_source_ids", "expected_source_classifications", "required_concepts")
    for i, c in enumerate(cases):
        check(f"case {i}", c, CASE, ("unknown category", lambda v: v["category"] in categories), ("case_id repeats", lambda v: v["case_id"] not in seen))
        seen.add(c["case_id"])
        boundary = c["category"] == "equipment_boundary"
        wanted = ("insufficient_evidence", "no_exact_equipment_evidence") if boundary else ("answered", c["expected_reason_code"])
        if any(bool(c[k]) == boundary for k in asserted) or (c["expected_status"], c["expected_reason_code"]) != wanted:
            raise ContractError(f"case {i}", ["its expectations contradict its category"])


def check_chunks(chunks: DataFrame) -> None:
    """Ids unique, texts there and true to their checksums and word counts."""
    r = chunks.agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("chunk_id").alias("ids"), F.count_if(F.trim(F.coalesce("text", F.lit(""))) == "").alias("empty"),
        F.count_if(~F.col("text_sha256").eqNullSafe(F.sha2("text", 256))).alias("changed"), F.count_if(F.col("word_count") != F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))).alias("miscounted"),
    ).first()
    broken = [k for k in ("empty", "changed", "miscounted") if r[k]] + (["repeated ids"] if r["ids"] != r["n"] else []) + ([] if r["n"] else ["no chunks"])
    if broken:
        raise ContractError("chunks", broken)


def check_chain(expected: dict[str, Any], found: dict[str, Any]) -> None:
    """Evidence of an earlier stage must be what the next one was frozen on: keys compared one by one."""
    broken = [f"{k} is {found.get(k)!r}, not {v!r}" for k, v in expected.items() if found.get(k, _MISSING) != v]
    if broken:
        raise ContractError("evidence chain", broken)


def check_test_lock(state: dict[str, Any]) -> None:
    """The held-out partition opens once, after the method is frozen."""
    check("test lock", state, [("method_frozen", True), ("selected_candidate", text), ("threshold", number), ("test_evaluated", False)])
