"""A small series through every stage."""

import math
from datetime import datetime, timedelta

import pytest

from millrace.operators import iforest, targets
from millrace.plans import workflows
from millrace.sources import files


@pytest.fixture(scope="module")
def sensor(spark):
    t0 = datetime(2020, 1, 1)
    rows = []
    for i in range(900):
        odd = 5.0 if 500 <= i < 510 or 770 <= i < 780 else 0.0
        rows.append((t0 + timedelta(seconds=10 * i + (600 if i >= 450 else 0)), math.sin(i / 7) + odd, math.cos(i / 5), float(i % 3 == 0)))
    return spark.createDataFrame(rows, "timestamp timestamp_ntz, a double, b double, st double")


SPEC = targets.TargetSpec.of(
    {"train": ("2020-01-01T00:00:00", "2020-01-01T01:10:00"), "validation": ("2020-01-01T01:12:00", "2020-01-01T02:00:00"), "test": ("2020-01-01T02:01:00", "2020-01-01T03:00:00")},
    {"v": ("2020-01-01T01:33:20", "2020-01-01T01:34:50"), "t": ("2020-01-01T02:18:20", "2020-01-01T02:19:50")},
    gap_seconds=15, pre_event_hours=0.01,
)


def test_sensor_stages(spark, sensor, tmp_path):
    p = lambda n: str(tmp_path / n)
    r = workflows.explore(sensor, ["a", "b"], ["st"], 15)
    assert (r["segment_count"], r["gap_count"]) == (2, 1) and r["charts"]["states"].startswith("<svg")
    t = workflows.materialize_targets(sensor, SPEC, p("t"))
    assert t["rows"] == 900 and t["segments"] == 2
    with pytest.raises(Exception):
        workflows.materialize_targets(sensor, SPEC, p("t"))
    gov = spark.read.parquet(p("t"))
    f = workflows.engineer_features(sensor, gov, ["a", "b"], p("f"))
    assert f["rows"] == 900
    with pytest.raises(files.GovernanceError):
        workflows.engineer_features(sensor.limit(10), gov, ["a"], p("x"))
    feats = spark.read.parquet(p("f"))
    e = workflows.validate_eligibility(feats, p("e"))
    assert e["flags"]["eligible_for_reference_fit"] > 300
    flags = spark.read.parquet(p("e")).select("timestamp", "eligible_for_reference_fit", "eligible_for_scoring", "eligible_for_known_event_evaluation", "eligible_for_alarm_burden")
    d = feats.join(flags, "timestamp").cache()
    fit, v = workflows.robust_distance(d, p("s"), 10, 0.99, names=["a", "b"])
    assert v["events"][0]["covered"] and v["events"][0]["alarm_rows"] == 10
    _, test = workflows.robust_distance(d, p("s2"), 10, partition="test", frozen=fit)
    assert test["threshold"] == fit.threshold and test["events"][0]["source_event"] == "t"
    g = workflows.diagnose(d, spark.read.parquet(p("s")), fit, ["st"], (0.9, 0.99), 1.0)
    assert g["dominant"][0]["feature"] == "a" and len(g["candidates"]) == 2
    grid = [iforest.Candidate(10, 64, 1.0, 1), iforest.Candidate(20, 64, 1.0, 2)]
    forest, cmp = workflows.compare_forests(d, ["a", "b"], grid, 10, quantile=0.99)
    s = cmp["selected"]
    state = {"method_frozen": True, "selected_candidate": s["candidate_id"], "threshold": s["threshold"], "test_evaluated": False}
    assert workflows.forest_held_out(d, forest, s, 10, state)["events"][0]["source_event"] == "t"
    with pytest.raises(ValueError):
        workflows.forest_held_out(d, forest, s, 10, state | {"test_evaluated": True})
    workflows.write_report({"sensor": v}, p("r.json"))
    assert files.load_json(p("r.json"))["sensor"]["rows"] == v["rows"]


def test_profile_report(spark, tmp_path):
    rows = [",".join(files.HEADER)]
    for i, (t, tp2, comp) in enumerate([("2020-01-01 00:00:00", "1.0", "1"), ("2020-01-01 00:00:01", "", "2"), ("2020-01-01 00:00:11", "bad", "0"), ("not-a-timestamp", "1.0", "0"), ("2020-01-01 00:00:10", "1.0", "0"), ("2020-01-01 00:00:11", "1.0", "0")]):
        rows.append(",".join([str(i), t, tp2, *["1.0"] * 6, comp, *["0"] * 7]))
    p = tmp_path / "raw.csv"
    p.write_text("\n".join(rows) + "\n")
    r = workflows.profile_csv(spark, str(p))
    assert (r["rows"], r["timestamp_parse_failures"], r["missing"]["TP2"], r["coercion_failures"]["TP2"]) == (6, 1, 1, 1)
    assert r["invalid_binary"] == [{"column": "COMP", "raw_value": "2", "rows": 1}]
    assert r["intervals"]["out_of_order"] == 1 and r["cadence"]["expected_interval_seconds"] == 1.0
    assert [g["interval_seconds"] for g in r["gap_details"]] == [10.0]


def test_corpus_and_answers(spark, tmp_path):
    units = spark.createDataFrame([("s1", 1, "page:1", "<p>Air leaks cost money.</p><script>x</script>"), ("s2", 1, "page:1", "<div>Sensor data of pumps.</div>")], "source_id string, unit_index int, locator string, text string")
    assert workflows.build_corpus(units, str(tmp_path / "c"), 10, 2, html=True) == {"chunks": 2, "sources": 2}
    with pytest.raises(files.GovernanceError):
        workflows.build_corpus(units, str(tmp_path / "d"), 10, 2, html=True, markers=["zzz"])
    cases = spark.createDataFrame([(1, "general", "air leaks", "answered", "grounded", "general", ["s1"], ["authoritative_general_reference"], [["leaks"]])], "case_id long, category string, query string, expected_status string, expected_reason_code string, expected_intent string, relevant_source_ids array<string>, expected_source_classifications array<string>, required_concepts array<array<string>>")
    c = spark.createDataFrame([(1, "air leaks", 1, 0.9, "c1", "s1", "authoritative_general_reference", "page:1", "h", "Air leaks cost money.")], "case_id long, query string, rank int, hybrid_score double, chunk_id string, source_id string, classification string, locator string, text_sha256 string, text string")
    r = workflows.evaluate_answers(cases, c)
    assert r["failures"] == [] and r["summary"]["mean_reciprocal_rank"] == 1.0 and r["summary"]["useful_rate"] == 1.0
