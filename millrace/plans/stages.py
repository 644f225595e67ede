"""Queries of files, saved tables and whole stages, beside the operators of ``queries`` and ``details``."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import service
from millrace.plans import workflows
from millrace.plans.details import _folder
from millrace.plans.queries import CONTINUOUS, FEATURES_SQL, GAP, SCORED_SQL, SEGMENTED, SENSOR, SPEC, STATES, STATES_SQL, TFIDF_SQL, docs, fitted, query, rounded, sensor
from millrace.session import table
from millrace.sources import files
from millrace.sources.store import Store

# ---------------------------------------------------------------- files


@query("a2_file_checksums", "SELECT length(t) AS length, sha256(t) AS sha256 FROM (SELECT string_agg(r_name, chr(10) ORDER BY r_regionkey) || chr(10) AS t FROM region)")
def _(spark, d):
    path = _folder(spark)
    table(spark, d, "region").coalesce(1).sortWithinPartitions("r_regionkey").select("r_name").write.text(path)
    return files.sha256_files(spark, path).select("length", "sha256")


@query("a3_header_check", "SELECT true AS agreed, true AS refused, count(*) AS rows FROM nation")
def _(spark, d):
    path = _folder(spark)
    files.write_csv_report(table(spark, d, "nation").select("n_nationkey", "n_name"), path)

    def passes(header):
        try:
            files.check_header(spark, path, header)
        except files.GovernanceError:
            return False
        return True

    agreed, refused = passes(("n_nationkey", "n_name")), not passes(("n_name", "n_nationkey"))
    return files.raw_csv(spark, path, ("n_nationkey", "n_name")).agg(F.lit(agreed).alias("agreed"), F.lit(refused).alias("refused"), F.count(F.lit(1)).alias("rows"))


@query("a10_written_table_check", "SELECT count(*) AS rows, 6 AS columns, true AS refused FROM events")
def _(spark, d):
    path, e = _folder(spark), table(spark, d, "events")
    files.write_parquet(e, path)
    found = files.check_parquet(spark, path, e.schema, e.count())
    try:
        files.check_parquet(spark, path, e.schema, found["rows"] + 1)
        refused = False
    except files.GovernanceError:
        refused = True
    return spark.createDataFrame([(found["rows"], found["columns"], refused)], "rows long, columns int, refused boolean")


@query("a14_saved_scores", f"WITH {SCORED_SQL} SELECT timestamp, segment_id, round(score, 6) AS robust_distance_score, alarm FROM val")
def _(spark, d):
    path = _folder(spark)
    files.write_parquet(fitted(spark, d)[2].select("timestamp", "segment_id", "robust_distance_score", "alarm"), path)
    return rounded(spark.read.parquet(path))


@query("a17_csv_report", "SELECT n_regionkey, count(*) AS nations, min(n_name) AS first_name FROM nation GROUP BY 1")
def _(spark, d):
    path = _folder(spark)
    report = table(spark, d, "nation").groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("nations"), F.min("n_name").alias("first_name"))
    files.write_csv_report(report, path)
    return files.typed_csv(spark, path, report.schema)


@query("a21_text_units", "SELECT sha256(string_agg(n_name, chr(10) ORDER BY n_name) || chr(10)) AS sha256 FROM nation GROUP BY n_regionkey")
def _(spark, d):
    path = _folder(spark)
    table(spark, d, "nation").select("n_regionkey", "n_name").coalesce(1).sortWithinPartitions("n_regionkey", "n_name").write.partitionBy("n_regionkey").text(path)
    return files.text_units(spark, path).select(F.sha2("text", 256).alias("sha256"))


@query("a24_normalized_sources", "SELECT sha256(regexp_replace(string_agg('===== doc:' || doc_id || ' =====' || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY doc_id), '\\s+$', '') || chr(10)) AS sha256 FROM documents GROUP BY source")
def _(spark, d):
    path = _folder(spark)
    u = docs(spark, d).select(F.col("source").alias("source_id"), F.col("doc_id").alias("unit_index"), F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("locator"), "text")
    files.write_normalized(u, path)
    return files.text_units(spark, path).select(F.sha2("text", 256).alias("sha256"))


# ---------------------------------------------------------------- saved indexes and logs


@query("a25_saved_index", f"WITH {TFIDF_SQL} SELECT term, df, round(idf, 6) AS idf FROM voc")
def _(spark, d):
    path, chunks = _folder(spark), docs(spark, d).select(F.col("doc_id").cast("string").alias("chunk_id"), "text")
    service.Knowledge(spark, chunks, 16).save(path)  # the vocabulary is the same with any number of directions
    return rounded(service.Knowledge.load(spark, path, chunks).vocabulary)


@query("a26_retained_log", "SELECT r_name AS request_id FROM region ORDER BY r_regionkey DESC LIMIT 3")
def _(spark, d):
    log = Store(spark, _folder(spark), {"records": 3, "evaluations": 3, "events": 3})
    for r in table(spark, d, "region").orderBy("r_regionkey").collect():  # five regions
        log.append("records", {"request_id": r["r_name"], "operation": "read", "status": "ok", "created_at": datetime(2024, 1, 1), "request_json": "{}", "response_json": "{}"})
    return log.recent("records", 5).select("request_id")


# ---------------------------------------------------------------- stages

_PROFILED = """twice AS (SELECT event_id, ts, value FROM events UNION ALL SELECT event_id, ts, value FROM events WHERE event_id % 10 = 0), p AS (SELECT ts, lag(ts) OVER (ORDER BY event_id) AS before FROM twice), iv AS (SELECT (epoch_us(ts) - epoch_us(before)) / 1e6 AS s FROM p WHERE before IS NOT NULL)"""


@query("i15_profile", f"WITH {_PROFILED} SELECT (SELECT count(*) FROM twice) AS rows, 0::BIGINT AS row_width_mismatches, (SELECT count(*) FROM twice WHERE value IS NULL) AS missing, (SELECT count(*) FROM events WHERE event_id % 10 = 0) AS duplicates, count(*) FILTER (WHERE s < 0) AS out_of_order FROM iv")
def _(spark, d):
    path, header = _folder(spark), ("event_id", "timestamp", "value")
    e = table(spark, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("timestamp"), "value")
    e.union(e.where("event_id % 10 = 0")).repartitionByRange(4, "event_id").sortWithinPartitions("event_id").write.option("header", True).csv(path)
    r = workflows.profile_csv(spark, path, header)
    found = r["rows"], r["row_width_mismatches"], r["missing"]["value"], r["duplicates"]["duplicate_rows"], r["intervals"]["out_of_order"]
    return spark.createDataFrame([found], "rows long, row_width_mismatches long, missing long, duplicates long, out_of_order long")


@query("i16_exploration", f"WITH {SEGMENTED}, g AS (SELECT date_diff('second', previous_timestamp, timestamp) AS s FROM segmented) SELECT (SELECT count(*) FROM sensor) AS rows, count(*) FILTER (WHERE s > {GAP}) + 1 AS segments, count(*) FILTER (WHERE s > {GAP}) AS gaps, max(s) AS largest_gap, (SELECT round(quantile_cont(s1, 0.5), 6) FROM sensor) AS median FROM g")
def _(spark, d):
    r = workflows.explore(sensor(spark, d), CONTINUOUS, STATES, GAP)
    found = r["coverage"]["row_count"], r["segment_count"], r["gap_count"], r["largest_interval_seconds"], r["signals"][0]["q50"]
    return rounded(spark.createDataFrame([found], "rows long, segments long, gaps long, largest_gap long, median double"))


@query("i14_corpus_build", "SELECT sum(CASE WHEN n = 0 THEN 0 ELSE CAST(ceil(greatest(n - 220, 0) / 180) AS BIGINT) + 1 END)::BIGINT AS chunks, count(DISTINCT source) AS sources FROM (SELECT source, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS n FROM documents)")
def _(spark, d):
    u = docs(spark, d).select(F.col("source").alias("source_id"), F.col("doc_id").cast("int").alias("unit_index"), F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("locator"), "text")
    r = workflows.build_corpus(u, _folder(spark))
    return spark.createDataFrame([(r["chunks"], r["sources"])], "chunks long, sources long")


@query("h15_normalized_paragraphs", f"WITH t AS (SELECT doc_id, regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[ \\t\\f\\v]+', ' ', 'g') AS t FROM documents), b AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(t, ' ?\\n ?', chr(10), 'g'), '\\n\\n+', chr(1), 'g'), chr(1)) AS p FROM t) SELECT doc_id, sha256(array_to_string(list_filter(list_transform(p, lambda x: trim(regexp_replace(x, '[ \\n]+', ' ', 'g'))), lambda x: x <> ''), chr(10) || chr(10))) AS sha256 FROM b")
def _(spark, d):
    return docs(spark, d).select("doc_id", F.sha2(T.normalize_text("text"), 256).alias("sha256"))


def _apart(spark, d):
    """The series with one row a timestamp, as the stages ask for."""
    return sensor(spark, d).groupBy("timestamp").agg(*[F.min_by(c, "event_id").alias(c) for c in ("s1", "s2", *STATES)])


_UNIQUE = SENSOR.replace("FROM events)", "FROM events QUALIFY row_number() OVER (PARTITION BY ts ORDER BY event_id) = 1)")


@query("i17_target_materialization", f"WITH {STATES_SQL.replace(SENSOR, _UNIQUE)} SELECT coalesce(partition, 'excluded') AS partition, target_state, count(*) AS row_count FROM states GROUP BY ALL")
def _(spark, d):
    r = workflows.materialize_targets(_apart(spark, d), SPEC, _folder(spark))
    return spark.createDataFrame([(x["partition"], x["target_state"], x["row_count"]) for x in r["counts"]], "partition string, target_state string, row_count long")


@query("i18_feature_engineering", f"WITH {FEATURES_SQL.replace(SENSOR, _UNIQUE)} SELECT count(*) AS rows, count(DISTINCT history_group_id) AS history_groups, round(sum(s1__mean_30), 3) AS mean_30_sum, count(*) FILTER (WHERE history_rows_available >= 30) AS full_history FROM features")
def _(spark, d):
    path, governed, x = _folder(spark), _folder(spark), _apart(spark, d)
    workflows.materialize_targets(x, SPEC, governed)
    r = workflows.engineer_features(x, spark.read.parquet(governed), CONTINUOUS, path)
    return spark.read.parquet(path).agg(F.lit(r["rows"]).cast("long").alias("rows"), F.lit(r["history_groups"]).cast("long").alias("history_groups"), F.round(F.sum("s1__mean_30"), 3).alias("mean_30_sum"), F.count_if("has_full_30_row_history").alias("full_history"))


@query("i23_conversion", f"WITH {SENSOR} SELECT count(*) AS source_rows, count(*) AS rows, {len(files.HEADER)} AS columns, date_trunc('millisecond', max(timestamp)) AS last_timestamp, round(sum(s1), 3) AS total FROM sensor")
def _(spark, d):
    csv, parquet = _folder(spark), _folder(spark)
    x = sensor(spark, d).withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSS"))
    cells = [F.col("event_id"), F.col("timestamp"), *[F.coalesce(F.col("s1"), F.lit(0.0))] * len(files.CONTINUOUS), *[F.col(STATES[0])] * len(files.BINARY)]
    lines = x.select("event_id", F.concat_ws(",", *[c.cast("string") for c in cells]).alias("value"))
    files.with_headers(lines.repartitionByRange("event_id").sortWithinPartitions("event_id").select("value")).write.text(csv)
    r = files.convert(spark, csv, parquet)
    return files.inspect(spark, parquet).crossJoin(spark.read.parquet(parquet).agg(F.round(F.sum(files.CONTINUOUS[0]), 3).alias("total"))).select(F.lit(r["source_rows"]).cast("long").alias("source_rows"), "rows", "columns", "last_timestamp", "total")
