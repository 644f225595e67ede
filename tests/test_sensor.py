"""Small hand-made series with known answers."""

import math
from datetime import datetime, timedelta

import numpy as np
import pytest

from millrace.functions.arrays import first_largest
from millrace.operators import alarms, eligibility, features, iforest, profile, robust, segments, targets
from pyspark.sql import Window
from pyspark.sql import functions as F

T0 = datetime(2020, 1, 1)


def at(*seconds):
    return [T0 + timedelta(seconds=s) for s in seconds]


def series(spark, seconds, **cols):
    names = list(cols)
    rows = [(t, *[cols[n][i] for n in names]) for i, t in enumerate(at(*seconds))]
    return spark.createDataFrame(rows, "timestamp timestamp_ntz, " + ", ".join(f"{n} double" for n in names))


def test_one_gap_makes_two_segments(spark):
    s = series(spark, (0, 10, 20, 60, 70, 80), COMP=[0.0, 0.0, 0.0, 1.0, 1.0, 1.0], TP2=[1.0, 2.0, 3.0, 4.0, 5.0, 6.0])
    got = segments.segment_summary(segments.segment(s, 15)).orderBy("segment_id").collect()
    assert [(r["segment_id"], r["row_count"]) for r in got] == [(1, 3), (2, 3)]
    assert segments.gaps(s, 15).count() == 1
    share = {r["state"]: r["percentage"] for r in segments.state_frequencies(s, ["COMP"]).collect()}
    assert share == {0: 50.0, 1: 50.0}
    segments.check_segments(6, 6, 2, 1)
    with pytest.raises(ValueError):
        segments.check_segments(6, 6, 3, 1)


def test_segments_go_on_across_days(spark):
    s = series(spark, (86390, 86400, 86410, 86500, 200000), x=[0.0] * 5)
    ids = [r["segment_id"] for r in segments.segment(s, 15).orderBy("timestamp").collect()]
    assert ids == [1, 1, 1, 2, 3]


def spec(pre=0.01, warning=None):
    return targets.TargetSpec.of(
        {"train": ("2020-01-01T00:00:00", "2020-01-01T00:00:20"), "validation": ("2020-01-01T00:30:00", "2020-01-01T00:30:10"), "test": ("2020-01-01T01:59:40", "2020-01-01T02:00:10")},
        {"e": ("2020-01-01T02:00:00", "2020-01-01T02:00:10")},
        gap_seconds=15, pre_event_hours=pre, warning_hours=warning,
    )


TARGET_TIMES = (0, 10, 20, 900, 1800, 1810, 3600, 7180, 7190, 7200, 7210)


def test_target_states(spark):
    s = series(spark, TARGET_TIMES, x=[0.0] * 11)
    got = targets.states(s, spec()).collect()
    assert len({r["segment_id"] for r in got}) == 5
    states = [r["target_state"] for r in got]
    assert states.count(targets.FAILURE) == 2 and states.count(targets.PRE_EVENT) == 2
    assert all(r["binary_target"] == 1 for r in got if r["target_state"] == targets.FAILURE)
    wide = {r["timestamp"]: r["target_state"] for r in targets.states(s, spec(1.1)).collect()}
    assert wide[T0 + timedelta(seconds=3600)] == targets.BUFFER


def test_spec_rejects_disorder():
    with pytest.raises(ValueError):
        spec(1.0, 0.5).validate()
    with pytest.raises(ValueError):
        targets.Interval("x", T0, T0 - timedelta(seconds=1))
    bad = targets.TargetSpec.of({"train": ("2020-01-01T00:00:00", "2020-01-01T01:00:00"), "validation": ("2020-01-01T00:30:00", "2020-01-01T02:00:00"), "test": ("2020-01-01T03:00:00", "2020-01-01T04:00:00")}, {}, gap_seconds=15, pre_event_hours=1)
    with pytest.raises(ValueError):
        bad.validate()


def test_features_reset_at_gaps_and_partitions(spark):
    times = (0, 10, 20, 30, 3600, 3610)
    rows = list(zip(at(*times), (1, 1, 1, 1, 2, 2), ("train", "train", None, "validation", "validation", "validation"), (1.0, 2.0, 100.0, 4.0, 10.0, 12.0), strict=True))
    d = spark.createDataFrame(rows, "timestamp timestamp_ntz, segment_id long, partition string, v double")
    got = features.causal_features(features.history_groups(d), ["v"]).orderBy("timestamp").collect()
    assert (got[1]["v__lag_1"], got[1]["v__delta_1"], got[1]["v__mean_6"]) == (1.0, 1.0, 1.5)
    assert got[3]["history_rows_available"] == 1 and got[3]["v__lag_1"] is None and got[3]["v__mean_6"] == 4.0
    assert got[4]["history_rows_available"] == 1 and got[4]["v__lag_1"] is None
    assert [r["history_group_id"] for r in got] == [1, 1, 2, 3, 4, 4]


def test_robust_fit_drops_constants(spark):
    rows = [("train", True, v, 5.0) for v in (0.0, 1.0, 2.0, 3.0)]
    d = spark.createDataFrame(rows, "partition string, r boolean, TP2 double, COMP double")
    f = robust.fit(d.where("r"), ["TP2", "COMP"])
    assert [p.feature for p in f.retained] == ["TP2"] and f.excluded == (("COMP", "zero_iqr"),)
    assert (f.retained[0].median, f.retained[0].iqr, f.reference_rows) == (1.5, 1.5, 4)
    assert robust.threshold(d.select(robust.score(f.retained).alias("robust_distance_score")), 0.75) == 1.0
    with pytest.raises(ValueError):
        robust.fit(d.where("false"), ["TP2"])


def test_score_and_dominant_feature(spark):
    P = robust.Parameter
    d = spark.createDataFrame([(2.0, 10.0)], "x double, y double")
    assert d.select(robust.score((P("x", 0, 1), P("y", 2, 2))).alias("s")).first()["s"] == 4.0
    r = robust.with_dominant(d, (P("x", 0, 1), P("y", 0, 2))).first()["dominant"]
    assert (r["feature"], r["contribution"]) == ("y", 5.0)
    tie = spark.range(1).select(first_largest(F.array(*[F.struct(F.lit(n).alias("n"), F.lit(1.0).alias("c")) for n in "bca"]), "c")["n"].alias("n"))
    assert tie.first()["n"] == "b"


def scored(spark, seconds, hits):
    rows = [(t, "e", True, True, h) for t, h in zip(at(*seconds), hits, strict=True)]
    return spark.createDataFrame(rows, "timestamp timestamp_ntz, source_event string, eligible_for_known_event_evaluation boolean, eligible_for_alarm_burden boolean, alarm boolean")


def test_longest_run(spark):
    assert alarms.longest_run(scored(spark, (0, 10, 20, 60), (True, True, False, True)), 10).first()["longest_run_rows"] == 2
    assert alarms.longest_run(scored(spark, (0, 10, 30), (True, True, True)), 10).first()["longest_run_rows"] == 2
    assert alarms.longest_run(scored(spark, (0,), (False,)), 10).first()["longest_run_rows"] == 0


def test_event_evidence_and_burden(spark):
    r = alarms.event_evidence(scored(spark, (0, 10, 20), (False, True, True))).first()
    assert r["covered"] and r["latency_seconds"] == 10.0 and r["alarm_rows"] == 2
    none = alarms.event_evidence(scored(spark, (0, 10), (False, False))).first()
    assert not none["covered"] and none["latency_seconds"] is None
    assert alarms.burden(scored(spark, (0, 10), (True, False)).where("false"), 10).first()["alarm_burden_fraction"] is None
    d = spark.createDataFrame([(0.5,), (0.6,), (0.7,)], "s double")
    assert [r["alarm"] for r in robust.with_alarm(d, "s", 0.6).collect()] == [False, False, True]


def test_model_selection_order(spark):
    rows = [(1, 1.0, None, 1.0), (2, 1.0, 20.0, 9.0), (3, 1.0, 20.0, 2.0), (4, 0.5, 1.0, 0.0)]
    m = spark.createDataFrame(rows, "complexity_rank long, event_coverage double, mean_latency_seconds double, alarms_per_24_hours double")
    assert alarms.select_model(m).first()["complexity_rank"] == 3


def test_profile_counts_faults(spark):
    d = spark.createDataFrame([("1.0",), ("",), (None,), ("bad-value",), ("1_000",), ("1.0d",), ("inf",), ("2",)], "v string")
    assert profile.missing(d, ["v"]).first()["missing"] == 2
    assert profile.coercion_failures(d, ["v"]).first()["failures"] == 2
    assert profile.non_finite(d, ["v"]).first()["non_finite"] == 1
    bad = {r["raw_value"]: r["rows"] for r in profile.invalid_binary(d, ["v"]).collect()}
    assert bad == {"bad-value": 1, "1_000": 1, "1.0d": 1, "inf": 1, "2": 1}


def test_intervals_in_file_order(spark):
    rows = [(i, t) for i, t in enumerate([*at(2, 1), None, *at(1, 2, 12)])]
    iv = profile.intervals(spark.createDataFrame(rows, "position long, ts timestamp_ntz"), "ts", "position")
    r = profile.interval_classes(iv).first()
    assert (r["out_of_order"], r["duplicate_adjacent"], r["positive"]) == (1, 1, 2)
    assert not profile.never_decreases(iv)
    c = profile.cadence(iv).first()
    assert (c["expected_interval_seconds"], c["gap_count"], c["largest_gap_seconds"]) == (1.0, 1, 10.0)


def test_eligibility_roles(spark):
    s = "timestamp timestamp_ntz, partition string, target_state string, binary_target int, exclusion_reason string, has_full_30_row_history boolean"
    rows = [(T0, p, st, 1 if st == targets.FAILURE else None, None, True) for p in targets.PARTITIONS for st in (targets.UNVERIFIED, targets.FAILURE)]
    rows += [(T0, "test", targets.PRE_EVENT, None, "pre", True), (T0, "test", targets.UNVERIFIED, None, None, False), (T0, None, targets.BUFFER, None, "buffer", True)]
    got = eligibility.eligibility(spark.createDataFrame(rows, s)).collect()
    fit = [r for r in got if r["eligible_for_reference_fit"]]
    assert [(r["partition"], r["target_state"]) for r in fit] == [("train", targets.UNVERIFIED)]
    known = {r["partition"] for r in got if r["eligible_for_known_event_evaluation"]}
    assert known == {"validation", "test"}
    assert [r["evaluation_role"] for r in got[-3:]] == ["excluded"] * 3


def test_isolation_forest_ranks_an_outlier_first(spark):
    rng = np.random.default_rng(0)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(400, 2)))] + [(400, 12.0, -12.0)]
    d = spark.createDataFrame(rows, "id long, a double, b double")
    c = iforest.Candidate(40, 128, 1.0)
    f = iforest.fit(d, ["a", "b"], c, "id")
    got = iforest.score(d, f).orderBy(F.desc("anomaly_score")).collect()
    assert got[0]["id"] == 400 and all(0 < r["anomaly_score"] < 1 for r in got)
    again = iforest.score(d, iforest.fit(d.repartition(3), ["a", "b"], c, "id"))
    assert {r["id"]: r["anomaly_score"] for r in again.collect()} == {r["id"]: r["anomaly_score"] for r in got}
    assert iforest.predict_one({"a": 12.0, "b": -12.0}, f, 0.5)["alarm"]
    with pytest.raises(ValueError):
        iforest.predict_one({"a": 1.0}, f, 0.5)
    with pytest.raises(ValueError):
        iforest.grid([1], [1], [1.0])


def test_quantiles_are_those_of_percentile(spark):
    from millrace.functions.quantiles import quantiles

    rows = [(math.sin(i) * 1000 if i % 3 else 5.0, None if i % 7 else float(i), 1.0, None) for i in range(5000)]
    rows += [(float("nan"), -math.inf, 1.0, None)] * 3
    d = spark.createDataFrame(rows, "a double, `b.c` double, c double, z double")
    p = (0.0, 0.01, 0.25, 0.5, 0.75, 0.995, 1.0)
    for accuracy in (100_000, 200):  # brackets of few and of many values
        got = quantiles(d, ["a", "b.c", "c", "z"], p, accuracy)
        want = d.agg(*[F.percentile(f"`{n}`", F.array(*map(F.lit, p))) for n in ("a", "b.c", "c", "z")]).first()
        assert got["z"] == [None] * len(p) and want[3] is None
        for n, w in zip(("a", "b.c", "c"), want, strict=False):
            assert all(x == y or (math.isnan(x) and math.isnan(y)) or abs(x - y) < 1e-9 for x, y in zip(got[n], w, strict=True)), (n, got[n], w)
    assert quantiles(d.limit(0), ["a"], [0.5]) == {"a": [None]}


def test_long_history_groups_are_cut_without_a_trace(spark):
    t0 = datetime(2020, 1, 1)
    rows = [(t0 + timedelta(seconds=5000 * i + (200_000 if i >= 150 else 0)), 1 if i < 150 else 2, math.sin(i)) for i in range(200)]
    d = spark.createDataFrame(rows, "timestamp timestamp_ntz, history_group_id long, x double").cache()
    whole = sorted(map(str, features.causal_features(d, ["x"]).collect()))
    w = Window.partitionBy("history_group_id").orderBy("timestamp").rowsBetween(-29, 0)
    plain = {r["timestamp"]: (r["m"], r["n"]) for r in d.select("timestamp", F.avg("x").over(w).alias("m"), F.count("x").over(w).alias("n")).collect()}
    for run in (30, 37, 1000):
        got = features.causal_features(d, ["x"], run=run)
        assert sorted(map(str, got.collect())) == whole
        for r in got.collect():
            assert abs(r["x__mean_30"] - plain[r["timestamp"]][0]) < 1e-12 and min(r["history_rows_available"], 30) == plain[r["timestamp"]][1]
    with pytest.raises(ValueError):
        features.causal_features(d, ["x"], run=29)


def test_runs_are_numbered_across_buckets(spark):
    """Against one walk over the whole series: days without rows, days that begin inside a run, states that are null, rows without a time."""
    import random

    rng = random.Random(3)
    at, rows = datetime(2024, 1, 1), []
    for i in range(400):
        at += timedelta(seconds=rng.choice((0, 5, 5, 5, 40_000, 200_000)))
        rows.append((i, at, rng.choice((1, 1, 2, None)), rng.choice(("train", None))))
    frame = spark.createDataFrame([*rows, (900, None, 1, "train")], "event_id long, timestamp timestamp_ntz, state int, part string").repartition(5)
    got = {r["event_id"]: (r["segment_id"], r["previous_timestamp"]) for r in segments.segment(frame, 60, tie="event_id").collect()}
    want, number, before = {}, 0, None
    for i, t, _, _ in rows:
        number += before is None or (t - before).total_seconds() > 60
        want[i] = (number, before)
        before = t
    assert got == want
    runs = features.history_groups(frame.withColumnsRenamed({"state": "segment_id", "part": "partition"}), tie="event_id")
    got = {r["event_id"]: r["history_group_id"] for r in runs.collect()}
    want, number, before = {}, 0, ()
    for i, _, s, p in rows:
        number += (s, p) != before
        want[i], before = number, (s, p)
    assert got == want and "__before" not in runs.columns
