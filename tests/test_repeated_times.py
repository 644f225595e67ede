"""Series whose times repeat, or that have no gap: the rows of the SQL all the same."""

import duckdb
import pytest
from pyspark.sql import functions as F

from millrace.plans import details, queries, stages  # noqa: F401

SOURCE = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """``events`` of sf0.01 in which every 50th row has the time of the row before."""
    d = tmp_path_factory.mktemp("repeated")
    time = "case when event_id % 50 = 1 then lag(ts) over (order by event_id) else ts end as ts"
    duckdb.sql(f"copy (select event_id, {time}, user_id, event_type, value, props from '{SOURCE}/events.parquet') to '{d}/events.parquet'")
    return str(d)


def same(spark, name, folder, rows=None):
    df = queries.QUERIES[name](spark, folder)
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{folder}/events.parquet'")
    cur = con.execute(queries.ORACLES[name])
    names = [c[0] for c in cur.description]
    want = sorted(map(str, cur.fetchall()))
    assert sorted(map(str, (tuple(r) for r in df.select(*names).collect()))) == want
    assert rows is None or len(want) == rows


def test_exploration_without_a_gap(spark, tmp_path):
    duckdb.sql(f"copy (select * replace (timestamp '2024-01-01' + to_seconds(event_id * 7) as ts) from '{SOURCE}/events.parquet') to '{tmp_path}/events.parquet'")
    same(spark, "i16_exploration", str(tmp_path), 1)


def test_feature_join_of_repeated_times(spark, folder):
    same(spark, "c1_feature_join", folder, 10_000)


@pytest.mark.parametrize("name", "c3_optional_scores d13_dominant_features d14_alarms_by_segment d15_alarms_by_hour d16_alarms_by_state h12_contributions h13_dominant_feature_rows h14_saved_or_recomputed h29_model_matrix".split())
def test_diagnosis_of_repeated_times(spark, folder, name):
    same(spark, name, folder)


def test_a_long_table_that_packs_well_is_not_broadcast(spark, tmp_path):
    """Targets of equal rows are a few kB as Parquet, whatever their number."""
    from millrace.operators import features

    spark.range(50_000).selectExpr("timestamp_ntz '2024-01-01' + make_dt_interval(0, 0, 0, id) as timestamp", "1L as segment_id", "'train' as partition").write.parquet(f"{tmp_path}/t")
    targets = spark.read.parquet(f"{tmp_path}/t")
    made = features.engineer(targets.select("timestamp", F.rand(1).alias("a")), targets, ["a"])
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and made.where("has_full_30_row_history").count() == 50_000 - 29
