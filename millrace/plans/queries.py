"""Registered queries of the library's own operators, each with the same rows in DuckDB SQL.

The sensor operators run on ``events`` as a stand-in: ``ts`` is the time, ``value`` and the
number in ``props`` are continuous signals, event types are binary states. Documents,
pages, conversations, embeddings and benchmark stand in for the knowledge side. Floats are
rounded to six places on both sides, never before a comparison with a threshold.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions.arrays import l2_norm
from millrace.functions.quantiles import quantiles
from millrace.functions.time import elapsed_seconds, seconds_between
from millrace.operators import alarms, corpus, eligibility, evaluation, features, grounding, history, iforest, profile, retrieval, robust, segments, targets
from millrace.plans.tables import cut
from millrace.session import spread, table

GAP = 600.0
SAMPLING = 260.0
STATES = ["st_error", "st_view"]
CONTINUOUS = ["s1", "s2"]
SPEC = targets.TargetSpec.of(
    {"train": ("2024-01-01T00:00:00", "2024-01-14T23:59:59"), "validation": ("2024-01-15T12:00:00", "2024-01-22T23:59:59"), "test": ("2024-01-23T12:00:00", "2024-01-30T23:59:59")},
    {"f_train": ("2024-01-08T06:00:00", "2024-01-08T14:00:00"), "f_val": ("2024-01-18T10:00:00", "2024-01-18T20:00:00"), "f_test": ("2024-01-26T03:00:00", "2024-01-26T09:00:00")},
    gap_seconds=GAP, pre_event_hours=0.25, warning_hours=1.0,
)
MODEL = ["s1", "s2", "s1__mean_6", "s1__mean_30", "s2__mean_30"]

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def rounded(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*[r6(c).alias(c) if k == "double" and c not in keep else F.col(f"`{c}`") for c, k in df.dtypes])


# ---------------------------------------------------------------- stand-ins


def sensor(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    k = F.regexp_extract("props", r"(\d+)", 1).cast("double")
    return e.select("event_id", F.col("ts").alias("timestamp"), F.col("value").alias("s1"), k.alias("s2"), *[(F.col("event_type") == s[3:]).cast("double").alias(s) for s in STATES])


SENSOR = """sensor AS (SELECT event_id, ts AS timestamp, value AS s1, CAST(regexp_extract(props, '(\\d+)', 1) AS DOUBLE) AS s2,
  CAST(event_type = 'error' AS INTEGER)::DOUBLE AS st_error, CAST(event_type = 'view' AS INTEGER)::DOUBLE AS st_view FROM events)"""
SEGMENTED = SENSOR + f""",
ordered AS (SELECT *, lag(timestamp) OVER (ORDER BY timestamp, event_id) AS previous_timestamp FROM sensor),
segmented AS (SELECT *, CAST(sum(CASE WHEN previous_timestamp IS NULL OR date_diff('second', previous_timestamp, timestamp) > {GAP} THEN 1 ELSE 0 END)
  OVER (ORDER BY timestamp, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment_id FROM ordered)"""


def _sql_case(rows: list[tuple[str, str]]) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN '{n}'" for c, n in rows) + " ELSE NULL END"


def _sql_hours(h: float) -> str:
    return f"to_seconds({h * 3600})"


_P = _sql_case([(f"timestamp BETWEEN TIMESTAMP '{p.start}' AND TIMESTAMP '{p.end}'", p.name) for p in SPEC.partitions])
_F = _sql_case([(f"timestamp BETWEEN TIMESTAMP '{e.start}' AND TIMESTAMP '{e.end}'", e.name) for e in SPEC.events])
_X = _sql_case([(f"timestamp >= TIMESTAMP '{e.start}' - {_sql_hours(SPEC.pre_event_hours)} AND timestamp < TIMESTAMP '{e.start}'", e.name) for e in SPEC.events])
_W = _sql_case([(f"timestamp >= TIMESTAMP '{e.start}' - {_sql_hours(SPEC.warning_hours)} AND timestamp < TIMESTAMP '{e.start}' - {_sql_hours(SPEC.pre_event_hours)}", e.name) for e in SPEC.events])
CLASSIFIED = SEGMENTED + f""",
classified AS (SELECT *, {_P} AS partition, {_F} AS failure_event, {_X} AS exclusion_event, {_W} AS warning_event FROM segmented)"""
STATES_SQL = CLASSIFIED + """,
anchored AS (SELECT *, min(segment_id) FILTER (WHERE failure_event IS NOT NULL) OVER (PARTITION BY coalesce(failure_event, exclusion_event, warning_event)) AS event_segment_id FROM classified),
states AS (SELECT event_id, timestamp, s1, s2, st_error, st_view, segment_id, partition,
  CASE WHEN partition IS NULL THEN 'excluded_partition_buffer' WHEN failure_event IS NOT NULL THEN 'documented_failure'
    WHEN exclusion_event IS NOT NULL AND segment_id = event_segment_id THEN 'excluded_pre_event' WHEN warning_event IS NOT NULL AND segment_id = event_segment_id THEN 'warning' ELSE 'unverified' END AS target_state,
  CASE WHEN partition IS NOT NULL AND failure_event IS NOT NULL THEN 1 END AS binary_target,
  CASE WHEN failure_event IS NOT NULL THEN failure_event WHEN exclusion_event IS NOT NULL AND segment_id = event_segment_id THEN exclusion_event
    WHEN warning_event IS NOT NULL AND segment_id = event_segment_id THEN warning_event END AS source_event,
  CASE WHEN partition IS NULL THEN 'chronological_partition_buffer' WHEN exclusion_event IS NOT NULL AND segment_id = event_segment_id THEN 'pre_event_exclusion_buffer' END AS exclusion_reason
  FROM anchored)"""
_W_SQL = "PARTITION BY history_group_id ORDER BY timestamp, event_id"
FEATURES_SQL = STATES_SQL + f""",
bounded AS (SELECT *, lag(segment_id) OVER o IS DISTINCT FROM segment_id OR lag(partition) OVER o IS DISTINCT FROM partition OR row_number() OVER o = 1 AS starts
  FROM states WINDOW o AS (ORDER BY timestamp, event_id)),
grouped AS (SELECT * EXCLUDE (starts), CAST(sum(CASE WHEN starts THEN 1 ELSE 0 END) OVER (ORDER BY timestamp, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS history_group_id FROM bounded),
features AS (SELECT *, row_number() OVER w AS history_rows_available,
  {", ".join(f"lag({c}) OVER w AS {c}__lag_1, {c} - lag({c}) OVER w AS {c}__delta_1, " + ", ".join(f"avg({c}) OVER ({_W_SQL} ROWS {n - 1} PRECEDING) AS {c}__mean_{n}, stddev_pop({c}) OVER ({_W_SQL} ROWS {n - 1} PRECEDING) AS {c}__stddev_pop_{n}" for n in (6, 30)) for c in CONTINUOUS)},
  row_number() OVER w >= 2 AS has_lag_1_history, row_number() OVER w >= 6 AS has_full_6_row_history, row_number() OVER w >= 30 AS has_full_30_row_history
  FROM grouped WINDOW w AS ({_W_SQL}))"""
ELIGIBLE_SQL = FEATURES_SQL + """,
governed AS (SELECT *, partition IN ('train', 'validation', 'test') AND target_state NOT IN ('excluded_partition_buffer', 'excluded_pre_event') AND exclusion_reason IS NULL AND has_full_6_row_history = true AS common FROM features),
eligible AS (SELECT * EXCLUDE (common),
  common AND partition = 'train' AND target_state = 'unverified' AND binary_target IS NULL AS eligible_for_reference_fit,
  common AND target_state IN ('unverified', 'documented_failure') AS eligible_for_scoring,
  common AND partition IN ('validation', 'test') AND target_state = 'documented_failure' AND binary_target = 1 AS eligible_for_known_event_evaluation,
  common AND partition IN ('validation', 'test') AND target_state = 'unverified' AND binary_target IS NULL AS eligible_for_alarm_burden,
  CASE WHEN NOT common THEN 'excluded' WHEN partition = 'train' AND target_state = 'unverified' THEN 'unlabeled_reference' WHEN target_state = 'documented_failure' THEN 'documented_positive'
    WHEN target_state = 'unverified' THEN 'unlabeled_scoring' ELSE 'excluded' END AS evaluation_role FROM governed)"""
FIT_SQL = ELIGIBLE_SQL + ",\n" + "fit AS (SELECT " + ", ".join(f"quantile_cont({f}, 0.25) AS q1_{f}, quantile_cont({f}, 0.5) AS q2_{f}, quantile_cont({f}, 0.75) AS q3_{f}" for f in MODEL) + ", count(*) AS n FROM eligible WHERE eligible_for_reference_fit AND partition = 'train')"
_DEV = {f: f"abs(({f} - q2_{f}) / (q3_{f} - q1_{f}))" for f in MODEL}
SCORED_SQL = FIT_SQL + f""",
scored AS (SELECT e.*, greatest({", ".join(_DEV.values())}) AS score, {", ".join(f"{x} AS dev_{f}" for f, x in _DEV.items())} FROM eligible e, fit),
lim AS (SELECT quantile_cont(score, 0.95) AS t FROM scored WHERE eligible_for_reference_fit AND partition = 'train'),
val AS (SELECT s.*, score > t AS alarm FROM scored s, lim WHERE partition = 'validation' AND eligible_for_scoring)"""


def segmented(spark, d):
    return segments.segment(sensor(spark, d), GAP, tie="event_id")


def governed(spark, d):
    return targets.states(sensor(spark, d), SPEC, tie="event_id")


def featured(spark, d):
    """Each step reads its input several times (rows, and a summary row per day), so steps are cut: the steps' reads add up and don't multiply."""
    grouped = features.history_groups(cut(governed(spark, d)), tie="event_id")
    return features.causal_features(cut(grouped), CONTINUOUS, tie="event_id")


def eligible(spark, d):
    return eligibility.eligibility(featured(spark, d), history="has_full_6_row_history")


def fitted(spark, d, partition: str = "validation"):
    from millrace.plans.tables import cut

    e = cut(eligible(spark, d))
    found, scored = robust.run(e, 0.95, partition, MODEL, "event_id")
    return e, found, scored


# ---------------------------------------------------------------- exploration


@query("a12_describe", "SELECT column_name, column_type FROM (VALUES ('event_id', 'bigint'), ('ts', 'timestamp_ntz'), ('user_id', 'bigint'), ('event_type', 'string'), ('value', 'double'), ('props', 'string')) t(column_name, column_type)")
def _(spark, d):
    return spark.createDataFrame(table(spark, d, "events").dtypes, "column_name string, column_type string")


@query("d1_coverage", f"""WITH {SENSOR} SELECT count(*) AS row_count, min(timestamp) AS first_timestamp, max(timestamp) AS last_timestamp, date_diff('second', min(timestamp), max(timestamp)) AS elapsed_seconds,
count(DISTINCT CAST(timestamp AS DATE)) AS observed_days, count(DISTINCT timestamp) AS distinct_timestamps FROM sensor""")
def _(spark, d):
    return segments.coverage(sensor(spark, d))


_Q = ", ".join(f"round(quantile_cont(value, {p}), 6) AS q{int(p * 100):02d}" for p in segments.QUANTILES)


@query("d3_signal_summary", f"""WITH {SENSOR}, u AS (SELECT 's1' AS signal, s1 AS value FROM sensor UNION ALL SELECT 's2', s2 FROM sensor)
SELECT signal, count(value) AS non_null, round(min(value), 6) AS minimum, {_Q}, round(avg(value), 6) AS mean, round(max(value), 6) AS maximum, round(stddev_pop(value), 6) AS stddev_pop FROM u GROUP BY signal""")
def _(spark, d):
    return rounded(segments.signal_summary(sensor(spark, d), CONTINUOUS))


@query("d4_state_frequencies", f"""WITH {SENSOR}, u AS (SELECT 'st_error' AS signal, st_error AS value FROM sensor UNION ALL SELECT 'st_view', st_view FROM sensor), g AS (SELECT signal, CAST(value AS INTEGER) AS state, count(*) AS row_count FROM u GROUP BY ALL)
SELECT signal, state, row_count, round(row_count * 100.0 / CAST(sum(row_count) OVER (PARTITION BY signal) AS BIGINT)::DOUBLE, 6) AS percentage FROM g""")
def _(spark, d):
    return rounded(segments.state_frequencies(sensor(spark, d), STATES))


@query("e1_previous_timestamp", f"WITH {SEGMENTED} SELECT event_id, timestamp, previous_timestamp FROM segmented")
def _(spark, d):
    return segments.with_previous(sensor(spark, d), tie="event_id").select("event_id", "timestamp", "previous_timestamp")


@query("e2_segment_ids", f"WITH {SEGMENTED} SELECT event_id, segment_id FROM segmented")
def _(spark, d):
    return segmented(spark, d).select("event_id", "segment_id")


@query("d5_segment_summary", f"WITH {SEGMENTED} SELECT segment_id, min(timestamp) AS start_timestamp, max(timestamp) AS end_timestamp, count(*) AS row_count, date_diff('second', min(timestamp), max(timestamp)) AS elapsed_seconds FROM segmented GROUP BY segment_id")
def _(spark, d):
    return segments.segment_summary(segmented(spark, d))


@query("d6_gap_count", f"WITH {SEGMENTED} SELECT count(*) AS gap_count FROM segmented WHERE date_diff('second', previous_timestamp, timestamp) > {GAP}")
def _(spark, d):
    return segments.gaps(sensor(spark, d), GAP, tie="event_id").agg(F.count(F.lit(1)).alias("gap_count"))


@query("f2_largest_gaps", f"WITH {SEGMENTED} SELECT previous_timestamp, timestamp AS next_timestamp, date_diff('second', previous_timestamp, timestamp) AS gap_seconds FROM segmented WHERE date_diff('second', previous_timestamp, timestamp) > {GAP} ORDER BY 3 DESC, 2 LIMIT 10")
def _(spark, d):
    return segments.largest_gaps(sensor(spark, d), GAP, 10, tie="event_id")


@query("d32_segment_invariants", f"WITH {SEGMENTED} SELECT count(*) AS row_count, count(DISTINCT segment_id) AS segments, count(*) FILTER (WHERE date_diff('second', previous_timestamp, timestamp) > {GAP}) + 1 AS gaps_plus_one FROM segmented")
def _(spark, d):
    s = segmented(spark, d)
    gap = seconds_between(F.col("previous_timestamp"), F.col("timestamp")) > GAP
    return s.agg(F.count(F.lit(1)).alias("row_count"), F.count_distinct("segment_id").alias("segments"), (F.count_if(gap) + 1).alias("gaps_plus_one"))


# ---------------------------------------------------------------- data quality

def raw(spark, d):
    """``events`` as raw text with faults: an empty value in every 97th row, a word in every 101st, the row before repeated in time for every 89th."""
    e = table(spark, d, "events")
    n = F.col("event_id")
    v = F.when(n % 97 == 0, "").when(n % 101 == 0, "bad-value").otherwise(F.col("value").cast("string"))
    b = F.when(n % 113 == 0, "2").when(n % 127 == 0, "").otherwise(F.when(F.col("event_type") == "error", "1").otherwise("0"))
    return e.select(n.alias("position"), F.col("ts"), v.alias("value"), b.alias("flag"), F.col("event_type").alias("kind"))


RAW_SQL = """raw AS (SELECT event_id AS position, ts, CASE WHEN event_id % 97 = 0 THEN '' WHEN event_id % 101 = 0 THEN 'bad-value' ELSE CAST(value AS VARCHAR) END AS value,
  CASE WHEN event_id % 113 = 0 THEN '2' WHEN event_id % 127 = 0 THEN '' WHEN event_type = 'error' THEN '1' ELSE '0' END AS flag, event_type AS kind FROM events)"""
_IV = "iv AS (SELECT position, lag(ts) OVER (ORDER BY position) AS previous, ts AS current, (epoch_us(ts) - lag(epoch_us(ts)) OVER (ORDER BY position)) / 1e6 AS interval_seconds FROM raw QUALIFY previous IS NOT NULL)"


@query("d19_missing", f"WITH {RAW_SQL} SELECT 'value' AS \"column\", count(*) FILTER (WHERE trim(value) = '') AS missing FROM raw UNION ALL SELECT 'flag', count(*) FILTER (WHERE trim(flag) = '') FROM raw")
def _(spark, d):
    return profile.missing(raw(spark, d), ["value", "flag"])


@query("d19_coercion_failures", f"WITH {RAW_SQL} SELECT 'value' AS \"column\", count(*) FILTER (WHERE value <> '' AND TRY_CAST(value AS DOUBLE) IS NULL) AS failures FROM raw UNION ALL SELECT 'flag', count(*) FILTER (WHERE flag <> '' AND TRY_CAST(flag AS DOUBLE) IS NULL) FROM raw")
def _(spark, d):
    return profile.coercion_failures(raw(spark, d), ["value", "flag"])


@query("d19_non_finite", f"WITH {RAW_SQL} SELECT 'value' AS \"column\", count(*) FILTER (WHERE NOT isfinite(TRY_CAST(value AS DOUBLE))) AS non_finite FROM raw")
def _(spark, d):
    return profile.non_finite(raw(spark, d), ["value"])


@query("d19_invalid_binary", f"WITH {RAW_SQL} SELECT 'flag' AS \"column\", trim(flag) AS raw_value, count(*) AS rows FROM raw WHERE trim(flag) <> '' AND coalesce(TRY_CAST(flag AS DOUBLE) NOT IN (0, 1), true) GROUP BY 2")
def _(spark, d):
    return profile.invalid_binary(raw(spark, d), ["flag"])


@query("d20_duplicate_rows", f"WITH {RAW_SQL}, twice AS (SELECT * FROM raw UNION ALL SELECT * FROM raw WHERE position % 10 = 0), g AS (SELECT *, count(*) AS n FROM twice GROUP BY ALL) SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS distinct_rows, CAST(sum(n) - count(*) AS BIGINT) AS duplicate_rows FROM g")
def _(spark, d):
    x = raw(spark, d)
    return profile.duplicates(x.union(x.where("position % 10 = 0")), x.columns)


def _intervals(spark, d):
    return profile.intervals(raw(spark, d), "ts", "position")


@query("e12_interval_classes", f"WITH {RAW_SQL}, {_IV} SELECT count(*) FILTER (WHERE interval_seconds < 0) AS out_of_order, count(*) FILTER (WHERE interval_seconds = 0) AS duplicate_adjacent, count(*) FILTER (WHERE interval_seconds = 0) AS nonpositive, count(*) FILTER (WHERE interval_seconds > 0) AS positive FROM iv")
def _(spark, d):
    return profile.interval_classes(_intervals(spark, d))


_WHOLE = "w AS (SELECT position, previous, current, date_diff('second', previous, current)::DOUBLE AS interval_seconds FROM iv)"


def _whole_intervals(spark, d):
    return _intervals(spark, d).withColumn("interval_seconds", seconds_between(F.col("previous"), F.col("current")).cast("double"))


@query("d21_interval_histogram", f"WITH {RAW_SQL}, {_IV}, {_WHOLE} SELECT interval_seconds, count(*) AS count FROM w WHERE interval_seconds > 0 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def _(spark, d):
    return profile.interval_histogram(_whole_intervals(spark, d))


@query("d21_cadence", f"""WITH {RAW_SQL}, {_IV}, {_WHOLE}, h AS (SELECT interval_seconds, count(*) AS c FROM w WHERE interval_seconds > 0 GROUP BY 1), m AS (SELECT interval_seconds AS expected_interval_seconds, interval_seconds * 1.5 AS gap_threshold_seconds FROM h ORDER BY c DESC, 1 LIMIT 1)
SELECT expected_interval_seconds, CAST(gap_threshold_seconds AS DOUBLE) AS gap_threshold_seconds, CAST(sum(c) FILTER (WHERE interval_seconds > gap_threshold_seconds) AS BIGINT) AS gap_count, max(interval_seconds) AS largest_gap_seconds FROM h, m GROUP BY 1, 2""")
def _(spark, d):
    return profile.cadence(_whole_intervals(spark, d))


@query("f3_gap_details", f"WITH {RAW_SQL}, {_IV}, top AS (SELECT * FROM iv WHERE interval_seconds > 0 ORDER BY interval_seconds DESC, position DESC LIMIT 10) SELECT * REPLACE (round(interval_seconds, 6) AS interval_seconds) FROM top WHERE interval_seconds > 1500")
def _(spark, d):
    return rounded(profile.gap_details(_intervals(spark, d), 1500.0, 10))


# ---------------------------------------------------------------- targets


@query("b2_interval_labels", f"WITH {CLASSIFIED} SELECT event_id, partition, failure_event, exclusion_event, warning_event FROM classified")
def _(spark, d):
    return targets.classify(sensor(spark, d), SPEC, tie="event_id").select("event_id", "partition", "failure_event", "exclusion_event", "warning_event")


@query("e4_anchor_segments", f"WITH {STATES_SQL} SELECT event_id, segment_id, event_segment_id FROM anchored WHERE coalesce(failure_event, exclusion_event, warning_event) IS NOT NULL")
def _(spark, d):
    a = targets.anchored(targets.classify(sensor(spark, d), SPEC, tie="event_id"))
    return a.where("coalesce(failure_event, exclusion_event, warning_event) is not null").select("event_id", "segment_id", "event_segment_id")


@query("b6_target_states", f"WITH {STATES_SQL} SELECT event_id, timestamp, segment_id, partition, target_state, CAST(binary_target AS VARCHAR) AS binary_target, source_event, exclusion_reason FROM states")
def _(spark, d):
    return governed(spark, d).drop("s1", "s2", *STATES).withColumn("binary_target", F.col("binary_target").cast("string"))


@query("d17_state_counts", f"WITH {STATES_SQL} SELECT coalesce(partition, 'excluded') AS partition, target_state, count(*) AS row_count FROM states GROUP BY ALL")
def _(spark, d):
    return targets.state_counts(governed(spark, d))


# ---------------------------------------------------------------- features, eligibility


@query("e6_history_groups", f"WITH {FEATURES_SQL} SELECT event_id, history_group_id, history_rows_available FROM features")
def _(spark, d):
    return featured(spark, d).select("event_id", "history_group_id", "history_rows_available")


_FCOLS = [f"{c}__{x}" for c in CONTINUOUS for x in ("lag_1", "delta_1", "mean_6", "stddev_pop_6", "mean_30", "stddev_pop_30")]


@query("e9_causal_features", f"WITH {FEATURES_SQL} SELECT event_id, {', '.join(f'round({c}, 6) AS {c}' for c in _FCOLS)}, has_lag_1_history, has_full_6_row_history, has_full_30_row_history FROM features")
def _(spark, d):
    f = featured(spark, d)
    return f.select("event_id", *[r6(c).alias(c) for c in _FCOLS], "has_lag_1_history", "has_full_6_row_history", "has_full_30_row_history")


@query("c1_feature_join", f"WITH {STATES_SQL} SELECT timestamp, target_state, s1 FROM states")
def _(spark, d):
    """By the key of the row: times repeat."""
    return governed(spark, d).select("event_id", "timestamp", "target_state").join(sensor(spark, d).select("event_id", "s1"), "event_id").drop("event_id")


@query("c2_unmatched_keys", "SELECT count(*) FILTER (WHERE b.doc_id IS NULL) AS left_only, count(*) FILTER (WHERE a.doc_id IS NULL) AS right_only FROM documents a FULL JOIN labels b ON a.doc_id = b.doc_id")
def _(spark, d):
    return features.unmatched(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id")


@query("b9_null_safe_disagreements", f"WITH {STATES_SQL} SELECT count(*) AS disagreements FROM states WHERE partition IS DISTINCT FROM CASE WHEN event_id % 3 = 0 THEN NULL ELSE partition END")
def _(spark, d):
    g = governed(spark, d).select("event_id", "partition")
    other = g.select("event_id", F.when(F.col("event_id") % 3 != 0, F.col("partition")).alias("partition"))
    return features.disagreements(g, other, "event_id", ["partition"]).agg(F.count(F.lit(1)).alias("disagreements"))


@query("b7_eligibility", f"WITH {ELIGIBLE_SQL} SELECT event_id, {', '.join(eligibility.FLAGS)}, evaluation_role FROM eligible")
def _(spark, d):
    return eligible(spark, d).select("event_id", *eligibility.FLAGS, "evaluation_role")


@query("d7_flag_counts", f"WITH {ELIGIBLE_SQL} SELECT count(*) AS rows, {', '.join(f'count(*) FILTER (WHERE {f}) AS {f}' for f in eligibility.FLAGS)} FROM eligible")
def _(spark, d):
    return eligibility.flag_counts(eligible(spark, d))


@query("d17_role_counts", f"WITH {ELIGIBLE_SQL} SELECT evaluation_role, count(*) AS row_count FROM eligible GROUP BY 1")
def _(spark, d):
    return eligibility.role_counts(eligible(spark, d))


@query("d18_partition_coverage", f"WITH {STATES_SQL} SELECT partition, min(timestamp) AS first_timestamp, max(timestamp) AS last_timestamp, count(*) AS row_count FROM states WHERE partition IS NOT NULL GROUP BY 1")
def _(spark, d):
    return eligibility.partition_coverage(governed(spark, d))


# ---------------------------------------------------------------- robust distance, alarms


@query("d8_robust_fit", f"WITH {FIT_SQL} " + " UNION ALL ".join(f"SELECT '{f}' AS feature, round(q2_{f}, 6) AS median, round(q3_{f} - q1_{f}, 6) AS iqr, n AS reference_rows FROM fit" for f in MODEL))
def _(spark, d):
    e = cut(eligible(spark, d))
    f = robust.fit(e.where("eligible_for_reference_fit and partition = 'train'"), MODEL)
    return rounded(spark.createDataFrame([(p.feature, p.median, p.iqr, f.reference_rows) for p in f.retained], "feature string, median double, iqr double, reference_rows long"))


@query("i1_robust_scores", f"WITH {SCORED_SQL} SELECT timestamp, segment_id, target_state, source_event, round(score, 6) AS robust_distance_score, alarm FROM val")
def _(spark, d):
    return rounded(fitted(spark, d)[2].select("timestamp", "segment_id", "target_state", "source_event", "robust_distance_score", "alarm"))


@query("i5_robust_test_scores", f"WITH {SCORED_SQL} SELECT timestamp, round(score, 6) AS robust_distance_score, score > t AS alarm FROM scored, lim WHERE partition = 'test' AND eligible_for_scoring")
def _(spark, d):
    return rounded(fitted(spark, d, "test")[2].select("timestamp", "robust_distance_score", "alarm"))


@query("d10_score_summary", f"WITH {SCORED_SQL} SELECT count(score) AS row_count, round(min(score), 6) AS minimum, round(quantile_cont(score, 0.5), 6) AS median, round(quantile_cont(score, 0.95), 6) AS p95, round(quantile_cont(score, 0.995), 6) AS p995, round(max(score), 6) AS maximum FROM val")
def _(spark, d):
    return rounded(robust.score_summary(fitted(spark, d)[2], "robust_distance_score"))


@query("d11_event_evidence", f"""WITH {SCORED_SQL} SELECT source_event, min(timestamp) AS first_scored_timestamp, min(timestamp) FILTER (WHERE alarm) AS first_alarm_timestamp, count(*) AS event_rows, count(*) FILTER (WHERE alarm) AS alarm_rows,
min(timestamp) FILTER (WHERE alarm) IS NOT NULL AS covered, round((epoch_us(min(timestamp) FILTER (WHERE alarm)) - epoch_us(min(timestamp))) / 1e6, 6) AS latency_seconds FROM val WHERE eligible_for_known_event_evaluation GROUP BY 1""")
def _(spark, d):
    return rounded(alarms.event_evidence(fitted(spark, d)[2]))


@query("d12_alarm_burden", f"WITH {SCORED_SQL} SELECT count(*) AS burden_rows, count(*) FILTER (WHERE alarm) AS burden_alarms, round(count(*) FILTER (WHERE alarm) / count(*), 6) AS alarm_burden_fraction, round(count(*) FILTER (WHERE alarm) * 24.0::DOUBLE / (count(*) * {SAMPLING}::DOUBLE / 3600.0::DOUBLE), 6) AS alarms_per_24_hours FROM val WHERE eligible_for_alarm_burden")
def _(spark, d):
    return rounded(alarms.burden(fitted(spark, d)[2], SAMPLING))


@query("e11_longest_run", f"""WITH {SCORED_SQL}, x AS (SELECT source_event, timestamp, alarm, lag(timestamp) OVER w AS p, lag(alarm) OVER w AS pa FROM val WHERE eligible_for_known_event_evaluation WINDOW w AS (PARTITION BY source_event ORDER BY timestamp)),
r AS (SELECT *, sum(CASE WHEN NOT alarm OR p IS NULL OR (epoch_us(timestamp) - epoch_us(p)) / 1e6 > {1.5 * SAMPLING} OR NOT coalesce(pa, false) THEN 1 ELSE 0 END) OVER (PARTITION BY source_event ORDER BY timestamp ROWS UNBOUNDED PRECEDING) AS run FROM x),
n AS (SELECT source_event, run, count(*) FILTER (WHERE alarm) AS n, count(*) AS rows FROM r GROUP BY ALL)
SELECT source_event, max(n) AS longest_run_rows, max(n) * {SAMPLING}::DOUBLE AS longest_run_seconds, round(max(n) / CAST(sum(rows) AS BIGINT)::DOUBLE, 6) AS contiguity_fraction FROM n GROUP BY 1""")
def _(spark, d):
    return rounded(alarms.longest_run(fitted(spark, d)[2], SAMPLING))


@query("d23_score_drift", f"""WITH {SCORED_SQL}, t AS (SELECT quantile_cont(score, 0.5) AS m, quantile_cont(score, 0.95) AS p FROM scored WHERE eligible_for_reference_fit), v AS (SELECT quantile_cont(score, 0.5) AS m, quantile_cont(score, 0.95) AS p FROM val)
SELECT round(v.m - t.m, 6) AS median_difference, round(v.p / t.p, 6) AS p95_ratio FROM t, v""")
def _(spark, d):
    e, f, scored = fitted(spark, d)
    train = e.where("eligible_for_reference_fit").select(robust.score(f.retained).alias("robust_distance_score"))
    return rounded(alarms.drift(train, scored, "robust_distance_score"))


_BEST = "CASE " + " ".join(f"WHEN dev_{f} = score THEN '{f}'" for f in MODEL) + " END"


def _diagnosis(spark, d):
    e, f, scored = fitted(spark, d)
    rows = robust.diagnostic_rows(e, e, scored, f.retained, "event_id")
    return rows.where("partition = 'validation' and eligible_for_scoring"), f


@query("d13_dominant_features", f"WITH {SCORED_SQL} SELECT {_BEST} AS feature, count(*) AS dominant_rows, count(*) FILTER (WHERE alarm) AS alarm_rows, round(max(score), 6) AS maximum_contribution FROM val GROUP BY 1 ORDER BY alarm_rows DESC, dominant_rows DESC, feature LIMIT 10")
def _(spark, d):
    return rounded(robust.dominant_counts(_diagnosis(spark, d)[0], 10))


@query("h13_dominant_feature_rows", f"WITH {SCORED_SQL} SELECT event_id, {_BEST} AS feature, round(score, 6) AS contribution FROM val")
def _(spark, d):
    return rounded(_diagnosis(spark, d)[0].select("event_id", "dominant.feature", "dominant.contribution"))


@query("d14_alarms_by_segment", f"WITH {SCORED_SQL} SELECT segment_id, count(*) AS scored_rows, count(*) FILTER (WHERE alarm) AS alarm_rows, count(*) FILTER (WHERE eligible_for_alarm_burden) AS burden_rows FROM val GROUP BY 1 ORDER BY alarm_rows DESC, segment_id LIMIT 10")
def _(spark, d):
    return robust.alarms_by_segment(_diagnosis(spark, d)[0], 10)


@query("d15_alarms_by_hour", f"WITH {SCORED_SQL} SELECT CAST(extract(hour FROM timestamp) AS BIGINT) AS hour_utc, count(*) AS scored_rows, count(*) FILTER (WHERE alarm) AS alarm_rows FROM val GROUP BY 1")
def _(spark, d):
    return robust.alarms_by_hour(_diagnosis(spark, d)[0])


@query("d16_alarms_by_state", f"""WITH {SCORED_SQL} SELECT st_error, st_view, count(*) AS scored_rows, count(*) FILTER (WHERE eligible_for_alarm_burden) AS burden_rows, count(*) FILTER (WHERE eligible_for_alarm_burden AND alarm) AS alarm_rows,
round(count(*) FILTER (WHERE eligible_for_alarm_burden AND alarm) / nullif(count(*) FILTER (WHERE eligible_for_alarm_burden), 0), 6) AS alarm_burden_fraction FROM val GROUP BY 1, 2 ORDER BY alarm_rows DESC, burden_rows DESC, 1, 2 LIMIT 10""")
def _(spark, d):
    return rounded(robust.alarms_by_state(_diagnosis(spark, d)[0], STATES, 10), *STATES)


@query("d24_small_ranges", f"WITH {FIT_SQL}, r AS (" + " UNION ALL ".join(f"SELECT '{f}' AS feature, q3_{f} - q1_{f} AS iqr FROM fit" for f in MODEL) + ") SELECT feature, round(iqr, 6) AS iqr FROM r WHERE iqr <= (SELECT max(iqr) FROM r) * 0.5")
def _(spark, d):
    _, f, _ = fitted(spark, d)
    return rounded(spark.createDataFrame([(p.feature, p.iqr) for p in robust.small_ranges(f.retained, 0.5)], "feature string, iqr double"))


@query("d9_threshold_candidates", f"WITH {SCORED_SQL} " + " UNION ALL ".join(f"SELECT {q}::DOUBLE AS quantile, round(quantile_cont(score, {q}), 6) AS threshold FROM scored WHERE eligible_for_reference_fit" for q in (0.9, 0.95, 0.99, 0.995)))
def _(spark, d):
    e, f, _ = fitted(spark, d)
    s = e.where("eligible_for_reference_fit").select(robust.score(f.retained).alias("s"))
    qs = (0.9, 0.95, 0.99, 0.995)
    found = quantiles(s, ["s"], qs)["s"]
    return rounded(spark.createDataFrame(list(zip(qs, found, strict=True)), "quantile double, threshold double"), "quantile")


_GRID = " UNION ALL ".join(f"SELECT {i} AS complexity_rank, quantile_cont(score, {q}) AS t FROM scored WHERE eligible_for_reference_fit" for i, q in enumerate((0.9, 0.95, 0.99), start=1))


@query("f9_model_selection", f"""WITH {SCORED_SQL}, c AS ({_GRID}),
a AS (SELECT c.complexity_rank, v.*, score > c.t AS hit FROM val v, c),
e AS (SELECT complexity_rank, source_event, min(timestamp) FILTER (WHERE hit) IS NOT NULL AS covered, (epoch_us(min(timestamp) FILTER (WHERE hit)) - epoch_us(min(timestamp))) / 1e6 AS latency FROM a WHERE eligible_for_known_event_evaluation GROUP BY 1, 2),
m AS (SELECT complexity_rank, count(*) FILTER (WHERE covered) / count(*) AS event_coverage, avg(latency) AS mean_latency_seconds FROM e GROUP BY 1),
b AS (SELECT complexity_rank, count(*) FILTER (WHERE hit) * 24.0::DOUBLE / (count(*) * {SAMPLING}::DOUBLE / 3600.0::DOUBLE) AS alarms_per_24_hours FROM a WHERE eligible_for_alarm_burden GROUP BY 1)
SELECT CAST(complexity_rank AS BIGINT) AS complexity_rank, round(event_coverage, 6) AS event_coverage, round(mean_latency_seconds, 6) AS mean_latency_seconds, round(alarms_per_24_hours, 6) AS alarms_per_24_hours FROM m JOIN b USING (complexity_rank)
ORDER BY event_coverage DESC, mean_latency_seconds, alarms_per_24_hours, complexity_rank LIMIT 1""")
def _(spark, d):
    e, f, scored = fitted(spark, d)
    train = e.where("eligible_for_reference_fit").select(robust.score(f.retained).alias("s"))
    qs = (0.9, 0.95, 0.99)
    limits = quantiles(train, ["s"], qs)["s"]
    rows = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("complexity_rank"), F.lit(t).alias("t")) for i, t in enumerate(limits, start=1)])).alias("g")
    every = scored.drop("alarm").select("*", rows).select("*", "g.complexity_rank", (F.col("robust_distance_score") > F.col("g.t")).alias("alarm"))
    m = alarms.candidate_metrics(every, SAMPLING, "complexity_rank")
    return rounded(alarms.select_model(m).select("complexity_rank", "event_coverage", "mean_latency_seconds", "alarms_per_24_hours"))


@query("i2_isolation_forest")
def _(spark, d):
    e = eligible(spark, d)
    from millrace.plans.tables import cut

    e = cut(e)
    f = iforest.fit(e.where("eligible_for_reference_fit"), MODEL, iforest.Candidate(100, 1024, 1.0), "event_id")
    return iforest.score(e.where("eligible_for_scoring").select("event_id", "partition", *MODEL), f).select("event_id", "partition", "anomaly_score")


@query("i3_candidate_grid", f"""WITH {ELIGIBLE_SQL}, fit AS (SELECT count(*) AS n_fit FROM eligible WHERE eligible_for_reference_fit)
SELECT CAST(row_number() OVER (ORDER BY n, m, f) AS BIGINT) AS complexity_rank, 'iforest_ne' || n || '_ms' || m || '_mf' || replace(CAST(f AS VARCHAR), '.', 'p') AS candidate_id, n_fit, least(m, n_fit) AS sample_rows, n * least(m, n_fit) AS sampled
FROM (VALUES (100), (200)) a(n), (VALUES (1024), (4096)) b(m), (VALUES (0.5), (1.0)) c(f), fit""")
def _(spark, d):
    """The candidates, simplest first, with the rows that each would draw from those eligible for the fit."""
    made = [(c.complexity_rank, c.candidate_id, c.n_estimators, c.max_samples) for c in iforest.grid([100, 200], [1024, 4096], [0.5, 1.0])]
    g = spark.createDataFrame(made, "complexity_rank long, candidate_id string, n long, m long")
    n = eligible(spark, d).where("eligible_for_reference_fit").agg(F.count(F.lit(1)).alias("n_fit"))
    rows = F.least("m", "n_fit")
    return g.crossJoin(F.broadcast(n)).select("complexity_rank", "candidate_id", "n_fit", rows.alias("sample_rows"), (F.col("n") * rows).alias("sampled"))  # one row


# ---------------------------------------------------------------- text


def docs(spark, d):
    return spread(table(spark, d, "documents").select("doc_id", "text", "lang", "source"))


_WORDS = "list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')"
_TOKENS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_][\\p{L}\\p{N}_]+')"
_CONTENT = "list_filter(list_transform(regexp_extract_all({0}, '[A-Za-z0-9][A-Za-z0-9_-]*'), lambda x: lower(x)), lambda x: len(x) > 1 AND x NOT IN (" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + "))"


@query("h18_word_counts", f"SELECT doc_id, len({_WORDS}) AS words FROM documents")
def _(spark, d):
    return docs(spark, d).select("doc_id", T.word_count(F.col("text")).cast("long").alias("words"))


@query("h16_chunks", f"""WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents), i AS (SELECT doc_id, w, unnest(range(0, CASE WHEN len(w) = 0 THEN 0 ELSE CAST(ceil(greatest(len(w) - 220, 0) / 180) AS BIGINT) + 1 END)) AS i FROM w)
SELECT doc_id, i + 1 AS unit_chunk_index, sha256(array_to_string(w[i * 180 + 1 : i * 180 + 220], ' ')) AS text_sha256, len(w[i * 180 + 1 : i * 180 + 220]) AS word_count FROM i""")
def _(spark, d):
    u = docs(spark, d).select("doc_id", F.lit(1).alias("unit_index"), "text")
    return corpus.unit_chunks(u, source="doc_id").select("doc_id", "unit_chunk_index", "text_sha256", "word_count")


@query("h17_chunk_ids", f"""WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents), i AS (SELECT doc_id, w, unnest(range(0, CASE WHEN len(w) = 0 THEN 0 ELSE CAST(ceil(greatest(len(w) - 220, 0) / 180) AS BIGINT) + 1 END)) AS i FROM w)
SELECT doc_id || '::u0001::c' || lpad(CAST(i + 1 AS VARCHAR), 4, '0') || '::' || left(sha256(array_to_string(w[i * 180 + 1 : i * 180 + 220], ' ')), 12) AS chunk_id FROM i""")
def _(spark, d):
    u = docs(spark, d).select("doc_id", F.lit(1).alias("unit_index"), "text")
    return corpus.unit_chunks(u, source="doc_id").select("chunk_id")


@query("h19_retrieval_terms", f"WITH t AS (SELECT doc_id, {_TOKENS} AS k FROM documents) SELECT doc_id, len(k) AS tokens, greatest(len(k) - 1, 0) AS bigrams, k[1] AS first_token FROM t")
def _(spark, d):
    k = docs(spark, d).select("doc_id", T.word_tokens(F.col("text")).alias("k"))
    return k.select("doc_id", F.size("k").cast("long").alias("tokens"), F.size(T.bigrams(F.col("k"))).cast("long").alias("bigrams"), F.get("k", F.lit(0)).alias("first_token"))


@query("h20_content_tokens", f"WITH t AS (SELECT doc_id, {_CONTENT.format('text')} AS k FROM documents) SELECT doc_id, len(k) AS tokens, len(list_distinct(k)) AS distinct_tokens FROM t")
def _(spark, d):
    k = docs(spark, d).select("doc_id", T.content_tokens(F.col("text")).alias("k"))
    return k.select("doc_id", F.size("k").cast("long").alias("tokens"), F.size(F.array_distinct("k")).cast("long").alias("distinct_tokens"))


@query("h22_sentences", "WITH s AS (SELECT doc_id, regexp_replace(trim(text), '([.!?])\\s+', '\\1' || chr(1), 'g') AS t FROM documents) SELECT doc_id, len(list_filter(string_split(t, chr(1)), lambda x: trim(x) <> '')) AS sentences FROM s")
def _(spark, d):
    return docs(spark, d).select("doc_id", F.size(T.sentences(F.col("text"))).cast("long").alias("sentences"))


@query("h28_normalized_text", "SELECT doc_id, sha256(regexp_replace(lower(trim(text)), '\\s+', ' ', 'g')) AS sha FROM documents")
def _(spark, d):
    return docs(spark, d).select("doc_id", F.sha2(T.normalized(F.col("text")), 256).alias("sha"))


@query("h26_source_checks", f"WITH w AS (SELECT source, len({_WORDS}) AS n, contains(lower(text), 'license') AS a, contains(lower(text), 'zzzz') AS b FROM documents) SELECT source, CAST(sum(n) AS BIGINT) AS words, sum(n) >= 1000 AS enough_words, list_filter([CASE WHEN NOT bool_or(a) THEN 'license' END, CASE WHEN NOT bool_or(b) THEN 'zzzz' END], lambda x: x IS NOT NULL) AS missing_markers FROM w GROUP BY source")
def _(spark, d):
    return corpus.source_checks(docs(spark, d), ["license", "zzzz"], 1000, "source")


@query("a20_visible_text")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", T.normalize_text(corpus.visible_text("html")).alias("text"))


# ---------------------------------------------------------------- retrieval


def queries_of(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), "text")


_TERMS = "list_concat(k, list_transform(range(1, greatest(len(k), 1)), lambda i: k[i] || ' ' || k[i + 1]))"
TFIDF_SQL = f"""tok AS (SELECT doc_id AS id, {_TOKENS} AS k FROM documents), tc AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest({_TERMS}) AS term FROM tok) GROUP BY ALL),
nd AS (SELECT count(*) AS n FROM documents),
voc AS (SELECT term, df, ln((1.0 + n) / (1.0 + df)) + 1.0 AS idf FROM (SELECT term, count(*) AS df, sum(tf) AS total FROM tc GROUP BY term ORDER BY total DESC, term LIMIT 16000), nd),
wt AS (SELECT id, term, (ln(tf) + 1.0) * idf AS w FROM tc JOIN voc USING (term)), nrm AS (SELECT id, sqrt(sum(w * w)) AS norm FROM wt GROUP BY id), idx AS (SELECT id, term, w / norm AS weight FROM wt JOIN nrm USING (id)),
qtok AS (SELECT item_id AS id, {_TOKENS} AS k FROM benchmark), qtc AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest({_TERMS}) AS term FROM qtok) GROUP BY ALL),
qwt AS (SELECT id, term, (ln(tf) + 1.0) * idf AS w FROM qtc JOIN voc USING (term)), qn AS (SELECT id, sqrt(sum(w * w)) AS norm FROM qwt GROUP BY id), qidx AS (SELECT id, term, w / norm AS weight FROM qwt JOIN qn USING (id)),
ks AS (SELECT q.id AS query_id, i.id, sum(i.weight * q.weight) AS keyword_score FROM idx i JOIN qidx q USING (term) GROUP BY 1, 2)"""


def vocabulary(spark, d):
    x = docs(spark, d)
    return retrieval.vocabulary_of(x, "doc_id", "text", x.count())


def tfidf(spark, d):
    """(vocabulary, documents with numbered terms, the questions' terms)."""
    voc = vocabulary(spark, d)
    qc = retrieval.term_counts(queries_of(spark, d), "doc_id", "text")
    return voc, retrieval.document_rows(docs(spark, d), "doc_id", "text", voc), retrieval.tfidf(qc, voc)


@query("i7_vocabulary", f"WITH {TFIDF_SQL} SELECT term, df, round(idf, 6) AS idf FROM voc")
def _(spark, d):
    return rounded(vocabulary(spark, d))


@query("i7_tfidf_norms", f"WITH {TFIDF_SQL} SELECT id, count(*) AS terms, round(sum(weight), 6) AS weight_sum, round(max(weight), 6) AS weight_max FROM idx GROUP BY id")
def _(spark, d):
    total = F.aggregate("weights", F.lit(0.0), lambda s, w: s + w)
    return rounded(tfidf(spark, d)[1].select("id", F.size("cols").cast("long").alias("terms"), total.alias("weight_sum"), F.array_max("weights").alias("weight_max")))


@query("f5_keyword_top_k", f"WITH {TFIDF_SQL} SELECT query_id, id, round(keyword_score, 6) AS keyword_score FROM ks WHERE keyword_score > 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(keyword_score, 9) DESC, id) <= 10")
def _(spark, d):
    voc, index, q = tfidf(spark, d)
    return rounded(retrieval.keyword_top_k(index, q, 10, retrieval.numbered(voc)[0]))


def _latent(spark, d):
    voc, index, q = tfidf(spark, d)
    index, n = cut(index), table(spark, d, "documents").count()
    dims = min(128, n - 1)
    return voc, index, q, n, dims, retrieval.latent(index, voc, dims, n)


def _lsa(spark, d):
    """(index, questions, their embeddings, the vocabulary)."""
    voc, index, q, _, dims, found = _latent(spark, d)
    q = cut(q)
    return index, q, retrieval.embed(index, found.directions, dims), retrieval.embed(q, found.directions, dims), voc


@query("i8_lsa_embeddings")
def _(spark, d):
    return _lsa(spark, d)[2]


@query("i8_explained_variance")
def _(spark, d):
    voc, index, _, n, dims, found = _latent(spark, d)
    rest = [(j + 1, float(v), float(r)) for j, (v, r) in enumerate(zip(found.values, found.residuals, strict=True))]
    return retrieval.explained_variance(index, found.directions, dims, n, voc).join(F.broadcast(spark.createDataFrame(rest, "component int, value double, residual double")), "component")


@query("i8_total_variance", f"WITH {TFIDF_SQL} SELECT round(sum(q / n - (s / n) * (s / n)), 9) AS total_variance FROM (SELECT sum(weight) AS s, sum(weight * weight) AS q FROM idx GROUP BY term), nd")
def _(spark, d):
    voc, index, _ = tfidf(spark, d)
    return retrieval.total_variance(retrieval.entry_rows(index, voc), table(spark, d, "documents").count()).select(F.round("total_variance", 9).alias("total_variance"))


@query("i9_hybrid_retrieval")
def _(spark, d):
    index, q, x, y, voc = _lsa(spark, d)
    return retrieval.retrieve(index, q, cut(x), cut(y), 8, vocab=voc)


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))


@query("c8_dense_top_k", """WITH v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), s AS (SELECT q.id AS query_id, e.id, list_inner_product(e.v, q.v) AS s FROM v e, v q WHERE q.id % 50 = 0)
SELECT query_id, id, round(least(1.0, s), 6) AS vector_score FROM s WHERE s > 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(least(1.0, s), 9) DESC, id) <= 10""")
def _(spark, d):
    v = _vectors(spark, d)
    return rounded(retrieval.dense_scores(v, v.where("id % 50 = 0"), 10))


@query("h11_l2_norms", "SELECT vec_id AS id, round(sqrt(list_inner_product(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), list_transform(embedding, lambda x: CAST(x AS DOUBLE)))), 6) AS norm FROM embeddings")
def _(spark, d):
    return rounded(_vectors(spark, d).select("id", l2_norm(F.col("v")).alias("norm")))


#: The vector side of a document (or question) is the embedding of its number, where there is one.
HYBRID_SQL = """ev AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
vp AS (SELECT b.item_id AS query_id, e.id, least(1.0, greatest(0.0, list_inner_product(e.v, q.v))) AS vector_score FROM benchmark b JOIN ev q ON q.id = b.item_id, ev e JOIN documents x ON x.doc_id = e.id),
kc AS (SELECT query_id, id FROM ks WHERE keyword_score > 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(keyword_score, 9) DESC, id) <= 30),
vc AS (SELECT query_id, id FROM vp WHERE vector_score > 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(vector_score, 9) DESC, id) <= 30),
cand AS (SELECT * FROM kc UNION SELECT * FROM vc),
hyb AS (SELECT query_id, id, 0.65::DOUBLE * coalesce(vector_score, 0) + 0.35::DOUBLE * coalesce(keyword_score, 0) AS hybrid_score, coalesce(vector_score, 0) AS vector_score, coalesce(keyword_score, 0) AS keyword_score
  FROM cand LEFT JOIN ks USING (query_id, id) LEFT JOIN vp USING (query_id, id))"""


def both_sides(spark, d):
    """(index, queries, document vectors, query vectors, vocabulary): terms of texts, and the embeddings of the same numbers."""
    voc, index, q = tfidf(spark, d)
    v = _vectors(spark, d)
    named = lambda t, c: v.join(table(spark, d, t).select(F.col(c).alias("id")), "id", "left_semi")
    return cut(index), cut(q), cut(named("documents", "doc_id")), named("benchmark", "item_id"), voc


@query("f6_hybrid_fusion", f"WITH {TFIDF_SQL}, {HYBRID_SQL} SELECT query_id, id, round(hybrid_score, 6) AS hybrid_score, round(vector_score, 6) AS vector_score, round(keyword_score, 6) AS keyword_score FROM hyb WHERE hybrid_score > 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(hybrid_score, 9) DESC, round(vector_score, 9) DESC, round(keyword_score, 9) DESC, id) <= 8")
def _(spark, d):
    *sides, voc = both_sides(spark, d)
    return rounded(retrieval.retrieve(*sides, 8, vocab=voc).drop("rank"))


# ---------------------------------------------------------------- grounding, evaluation, history

_CLASS = "CASE WHEN doc_id % 3 = 0 THEN 'exact_equipment_source' WHEN doc_id % 3 = 1 THEN 'exact_dataset_source' ELSE 'authoritative_general_reference' END"
QUESTIONS = ("the tion of this and that", "dataset ersh thing and ent", "service manual of the oner", "und der heit", "que de la")


def candidates(spark, d, only=None):
    """Every document (or those of the chunk ids ``only``), tokenized once, as a candidate for five fixed questions, with a made-up hybrid score."""
    chunk = F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("chunk_id")
    t = table(spark, d, "documents").select("doc_id", "text")
    t = spread(t) if only is None else t.join(F.broadcast(only), chunk == F.col("chunk_id"), "left_semi")
    q = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("query_id"), F.lit(t).alias("query")) for i, t in enumerate(QUESTIONS)])).alias("q")
    x = grounding.tokenized(t).select(q, "*").select("q.query_id", "q.query", "doc_id", "text", "text_tokens", "text_pairs")
    return x.select(
        "text_tokens", "text_pairs",
        "query_id", "query", F.col("doc_id").cast("int").alias("rank"), (1.0 / (1.0 + F.col("doc_id") % 10)).alias("hybrid_score"), chunk,
        F.expr(_CLASS).alias("classification"), F.concat(F.lit("src"), F.col("doc_id").cast("string")).alias("source_id"), F.lit("page:1").alias("locator"), F.sha2("text", 256).alias("text_sha256"), "text",
    )


_QROWS = ", ".join(f"({i}, '{t}')" for i, t in enumerate(QUESTIONS))
RERANK_SQL = f"""q(query_id, query) AS (VALUES {_QROWS}),
cand AS (SELECT query_id::BIGINT AS query_id, query, lpad(CAST(doc_id AS VARCHAR), 9, '0') AS chunk_id, {_CLASS} AS classification, 1.0::DOUBLE / (1.0 + doc_id % 10) AS hybrid, text,
  {_CONTENT.format('query')} AS qt, {_CONTENT.format('text')} AS tt FROM documents, q),
kind AS (SELECT *, CASE WHEN contains(query, 'service manual') THEN 'equipment_specific' WHEN contains(query, 'dataset') THEN 'dataset_specific' ELSE 'general' END AS intent,
  list_distinct(list_transform(range(1, len(qt)), lambda i: qt[i] || ' ' || qt[i + 1])) AS qb, list_transform(range(1, greatest(len(tt), 1)), lambda i: tt[i] || ' ' || tt[i + 1]) AS tb FROM cand WHERE len(qt) > 0),
parts AS (SELECT *, len(list_intersect(list_distinct(qt), tt)) / len(list_distinct(qt)) AS query_coverage, CASE WHEN len(qt) < 2 THEN 0 ELSE len(list_intersect(qb, tb)) / len(qb) END AS phrase,
  CASE intent WHEN 'equipment_specific' THEN CASE classification WHEN 'exact_equipment_source' THEN 1.0 WHEN 'exact_dataset_source' THEN 0.2 ELSE 0.1 END
    WHEN 'dataset_specific' THEN CASE classification WHEN 'exact_dataset_source' THEN 1.0 WHEN 'exact_equipment_source' THEN 0.6 ELSE 0.25 END
    ELSE CASE classification WHEN 'authoritative_general_reference' THEN 1.0 ELSE 0.55 END END::DOUBLE AS affinity FROM kind),
rr AS (SELECT *, 0.55::DOUBLE * hybrid + 0.3::DOUBLE * query_coverage + 0.1::DOUBLE * phrase + 0.05::DOUBLE * affinity AS rerank_score FROM parts)"""


def scored(spark, d):
    """Every candidate with its scores and without its text, worked out once."""
    return cut(grounding.scored(candidates(spark, d)).drop("text"))


@query("i10_rerank", f"WITH {RERANK_SQL} SELECT query_id, chunk_id, intent, round(query_coverage, 6) AS query_coverage, round(phrase, 6) AS phrase, round(affinity, 6) AS classification_affinity, round(rerank_score, 6) AS rerank_score FROM rr")
def _(spark, d):
    return rounded(grounding.scored(candidates(spark, d)).select("query_id", "chunk_id", "intent", "query_coverage", "phrase", "classification_affinity", "rerank_score"))


@query("f11_evidence_cutoff", f"WITH {RERANK_SQL} SELECT query_id, chunk_id, round(rerank_score, 6) AS rerank_score FROM rr WHERE rerank_score >= 0.08 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, hybrid DESC, chunk_id) <= 4")
def _(spark, d):
    return rounded(grounding.evidence(scored(spark, d)).select("query_id", "chunk_id", "rerank_score"))


BEST_SQL = f"""sent AS (SELECT query_id, chunk_id, list_distinct(qt) AS q, list_filter(list_transform(string_split(regexp_replace(trim(text), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '') AS ss FROM cand WHERE len(qt) > 0),
ranked AS (SELECT query_id, chunk_id, list_sort(list_transform(range(1, len(ss) + 1), lambda i: {{'o': -len(list_intersect(q, {_CONTENT.format('ss[i]')})), 'i': i, 's': ss[i]}})) AS o FROM sent),
best AS (SELECT query_id, chunk_id, list_transform(CASE WHEN len(o) > 0 AND o[1].o < 0 THEN list_filter(o, lambda x: x.o < 0)[1:2] ELSE o[1:1] END, lambda x: x.s) AS sentences FROM ranked)"""
_G = grounding.Grounding()
ANSWER_SQL = f"""{RERANK_SQL}, {BEST_SQL},
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, hybrid DESC, chunk_id) AS rerank_rank FROM rr),
ev AS (SELECT query_id, chunk_id, classification, text, row_number() OVER (PARTITION BY query_id ORDER BY rerank_rank) AS n FROM rk WHERE rerank_score >= 0.08 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rerank_rank) <= 4),
said AS (SELECT ev.*, list_transform(sentences, lambda s: s || ' [S' || n || ']') AS said FROM ev JOIN best USING (query_id, chunk_id)),
placed AS (SELECT *, coalesce(sum(len(said)) OVER (PARTITION BY query_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lines_before FROM said),
per AS (SELECT query_id, count(*) AS found, bool_or(classification = 'exact_equipment_source') AS exact, flatten(list(said ORDER BY n))[1:5] AS lines, count(*) FILTER (WHERE lines_before < 5) AS used FROM placed GROUP BY 1),
judged AS (SELECT q.query_id::BIGINT AS query_id, query, CASE WHEN contains(query, 'service manual') THEN 'equipment_specific' WHEN contains(query, 'dataset') THEN 'dataset_specific' ELSE 'general' END AS intent, lines, used,
  CASE WHEN contains(query, 'service manual') AND NOT coalesce(exact, false) THEN 'no_exact_equipment_evidence' WHEN found IS NULL THEN 'below_evidence_threshold' WHEN len(lines) = 0 THEN 'no_supported_sentence' ELSE 'grounded' END AS reason_code FROM q LEFT JOIN per USING (query_id)),
ans AS (SELECT query_id, query, intent, reason_code, CASE WHEN reason_code = 'grounded' THEN 'answered' ELSE 'insufficient_evidence' END AS status, CASE WHEN reason_code = 'grounded' THEN used::INTEGER ELSE 0 END AS evidence_chunk_count,
  CASE reason_code WHEN 'grounded' THEN CASE intent {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in grounding.ANSWER_PREFIX.items())} END || array_to_string(lines, ' ') WHEN 'no_exact_equipment_evidence' THEN '{_G.refusal + _G.no_equipment}' ELSE '{_G.refusal}' END AS answer FROM judged),
cit AS (SELECT query_id, chunk_id, classification, text, 'S' || n AS citation_id FROM placed JOIN ans USING (query_id) WHERE reason_code = 'no_supported_sentence' OR reason_code = 'no_exact_equipment_evidence' OR (reason_code = 'grounded' AND lines_before < 5))"""


def _answers(spark, d):
    """(all candidates with scores, without texts; the evidence of any question with scores and texts; answers): only the texts of evidence are read again."""
    s = scored(spark, d)
    few = cut(grounding.evidence(s).select("chunk_id").distinct())
    e = cut(grounding.scored(candidates(spark, d, few)))
    q = spark.createDataFrame(list(enumerate(QUESTIONS)), "query_id long, query string")
    return s, e, grounding.answers(q, e)


@query("i11_answers", f"WITH {ANSWER_SQL} SELECT query_id, status, reason_code, intent, answer, evidence_chunk_count FROM ans")
def _(spark, d):
    return _answers(spark, d)[2].select("query_id", "status", "reason_code", "intent", "answer", "evidence_chunk_count")


_NORMAL = "regexp_replace(trim(lower({0})), '\\s+', ' ', 'g')"
_LEADS = "|".join(v.strip() for v in grounding.ANSWER_PREFIX.values())
EVALUATION_SQL = f"""{ANSWER_SQL},
cm AS (SELECT query_id AS case_id, any_value(status) AS status, count(citation_id) AS citation_count, count(citation_id) FILTER (WHERE sha256(cit.text) = sha256(rr.text) AND cit.classification = rr.classification) AS traceable_count,
  count(citation_id) AS scoped_count, count(citation_id) FILTER (WHERE cit.classification = 'authoritative_general_reference') AS aligned_count,
  CASE WHEN any_value(status) = 'answered' THEN list_sort(list_distinct(regexp_extract_all(any_value(answer), '\\[([A-Z][A-Z0-9]*)\\]', 1))) = list_sort(list(citation_id)) END AS marker_coverage FROM ans LEFT JOIN cit USING (query_id) LEFT JOIN rr USING (query_id, chunk_id) GROUP BY 1),
cmr AS (SELECT *, CASE WHEN citation_count > 0 THEN traceable_count / citation_count END AS traceability_rate, CASE WHEN scoped_count > 0 THEN aligned_count / scoped_count END AS scope_alignment_rate FROM cm),
mk AS (SELECT query_id, string_split_regex(answer, '\\[[A-Z][A-Z0-9]*\\]') AS parts, regexp_extract_all(answer, '\\[([A-Z][A-Z0-9]*)\\]', 1) AS ids FROM ans),
cl AS (SELECT query_id, trim(regexp_replace(trim(parts[i]), '^(?:{_LEADS})\\s*', '')) AS claim, ids[i] AS citation_id FROM (SELECT *, unnest(range(1, len(ids) + 1)) AS i FROM mk)),
fa AS (SELECT query_id, count(*) AS claim_count, count(*) FILTER (WHERE contains({_NORMAL.format('text')}, {_NORMAL.format('claim')})) AS supported_count FROM cl LEFT JOIN cit USING (query_id, citation_id) WHERE claim <> '' GROUP BY 1),
fr AS (SELECT query_id AS case_id, coalesce(claim_count, 0) AS claim_count, coalesce(supported_count, 0) AS supported_count, supported_count / claim_count AS supported_rate FROM ans LEFT JOIN fa USING (query_id)),
us AS (SELECT query_id AS case_id, status, status = 'answered' AS status_match, reason_code = 'grounded' AS reason_match, intent = 'general' AS intent_match, contains(query, 'manual') AS boundary,
  CASE WHEN contains({_NORMAL.format('answer')}, 'the') OR contains({_NORMAL.format('answer')}, 'und') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS concept_coverage, reason_code = 'no_exact_equipment_evidence' AND intent = 'equipment_specific' AS refused FROM ans),
uu AS (SELECT case_id, status_match, reason_match, intent_match, concept_coverage, boundary, status_match AND reason_match AND intent_match AND (boundary OR concept_coverage >= 0.5) AS useful, CASE WHEN boundary THEN refused END AS refusal_boundary FROM us),
re AS (SELECT query_id AS case_id, min(rerank_rank) FILTER (WHERE chunk_id = '000000001') AS first_rank, bool_or(classification = 'authoritative_general_reference') FILTER (WHERE rerank_rank = 1) AS top1, NOT bool_or(classification = 'exact_equipment_source') AS clear FROM rk GROUP BY 1),
res AS (SELECT *, list_filter([CASE WHEN NOT coalesce(first_rank <= 5, false) THEN 'retrieval_source_miss_at_5' END, CASE WHEN NOT coalesce(top1, false) THEN 'retrieval_top1_classification_mismatch' END, CASE WHEN traceability_rate <> 1 THEN 'citation_traceability_failure' END,
  CASE WHEN citation_count > 0 AND NOT marker_coverage THEN 'citation_marker_coverage_failure' END, CASE WHEN scope_alignment_rate <> 1 THEN 'citation_source_scope_misalignment' END, CASE WHEN citation_count = 0 THEN 'answered_case_without_citation' END,
  CASE WHEN supported_rate <> 1 THEN 'unsupported_cited_claim' END, CASE WHEN boundary AND NOT refusal_boundary THEN 'equipment_refusal_boundary_failure' END, CASE WHEN NOT status_match THEN 'unexpected_answer_status' END,
  CASE WHEN NOT reason_match THEN 'unexpected_reason_code' END, CASE WHEN NOT intent_match THEN 'unexpected_intent' END, CASE WHEN concept_coverage < 0.5 THEN 'low_usefulness_concept_coverage' END], lambda x: x IS NOT NULL) AS failure_flags
  FROM uu JOIN cmr USING (case_id) JOIN fr USING (case_id) LEFT JOIN re USING (case_id))"""


@query("i13_evaluation", f"WITH {EVALUATION_SQL} SELECT case_id, citation_count, round(traceability_rate, 6) AS traceability_rate, marker_coverage, claim_count, round(supported_rate, 6) AS supported_rate, useful, failure_flags FROM res")
def _(spark, d):
    return rounded(evaluation.evaluate(*_cases(spark, d)).select("case_id", "citation_count", "traceability_rate", "marker_coverage", "claim_count", "supported_rate", "useful", "failure_flags"))


def _cases(spark, d):
    """(cases, all candidates by rank, the candidates that answers may cite, answers)."""
    s, e, ans = _answers(spark, d)
    rows = [(i, "equipment_boundary" if "manual" in t else "general", t, "answered", "grounded", "general", ["src1"], ["authoritative_general_reference"], [["the", "und"]]) for i, t in enumerate(QUESTIONS)]
    cases = spark.createDataFrame(rows, "case_id long, category string, query string, expected_status string, expected_reason_code string, expected_intent string, relevant_source_ids array<string>, expected_source_classifications array<string>, required_concepts array<array<string>>")
    ranks = grounding.ranked(s.select("query_id", "chunk_id", "source_id", "classification", "rerank_score", "hybrid")).withColumnsRenamed({"query_id": "case_id", "rerank_rank": "rank"})
    return cases.drop("query"), ranks, e.withColumnRenamed("query_id", "case_id"), ans.withColumnRenamed("query_id", "case_id")


def _sql_rate(c: str, name: str | None = None) -> str:
    return f"round(avg({c}::INTEGER), 6) AS {name or c}_rate"


@query("d25_evaluation_summary", f"""WITH {EVALUATION_SQL} SELECT count(*) AS case_count, round(avg(coalesce(1.0::DOUBLE / first_rank, 0)), 6) AS mean_reciprocal_rank, {", ".join(_sql_rate(f"coalesce(first_rank <= {k}, false)", f"hit_at_{k}") for k in (1, 3, 5))},
{_sql_rate("top1", "top1_class")}, round(avg(clear::INTEGER) FILTER (WHERE boundary), 6) AS boundary_clear_rate, sum(citation_count)::BIGINT AS citation_count, round(sum(traceable_count) / sum(citation_count), 6) AS traceability_rate, {_sql_rate("marker_coverage")},
round(sum(aligned_count) / sum(scoped_count), 6) AS scope_alignment_rate, sum(claim_count)::BIGINT AS claim_count, round(sum(supported_count) / sum(claim_count), 6) AS supported_rate, {", ".join(map(_sql_rate, ("refusal_boundary", "status_match", "reason_match", "intent_match")))},
round(avg(concept_coverage), 6) AS mean_concept_coverage, {_sql_rate("useful")}, count(*) FILTER (WHERE len(failure_flags) > 0) AS failure_case_count FROM res""")
def _(spark, d):
    return rounded(evaluation.aggregate(evaluation.evaluate(*_cases(spark, d))))


@query("f10_recent_history", "SELECT conv_id * 1000 + turn AS id, role FROM conversations WHERE role = 'user' ORDER BY 1 DESC LIMIT 20")
def _(spark, d):
    log = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "role")
    return history.recent(log, 20, "id", "user", "role")


@query("c7_retention", "SELECT conv_id, turn FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 2")
def _(spark, d):
    return history.retained(table(spark, d, "conversations").select("conv_id", "turn"), 2, "turn", "conv_id")


@query("d31_counters", "SELECT role, count(*) AS row_count FROM conversations GROUP BY 1")
def _(spark, d):
    return history.counters(table(spark, d, "conversations"), "role")


@query("g4_key_set_difference", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id").subtract(table(spark, d, "labels").select("doc_id"))


@query("h1_second_boundaries", f"WITH {SEGMENTED} SELECT CAST(sum(date_diff('second', previous_timestamp, timestamp)) AS BIGINT) AS boundaries, round(sum((epoch_us(timestamp) - epoch_us(previous_timestamp)) / 1e6), 3) AS elapsed FROM segmented")
def _(spark, d):
    p, t = F.col("previous_timestamp"), F.col("timestamp")
    return segments.with_previous(sensor(spark, d), tie="event_id").agg(F.sum(seconds_between(p, t)).alias("boundaries"), F.round(F.sum(elapsed_seconds(p, t)), 3).alias("elapsed"))
