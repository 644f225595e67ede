"""Queries of single functions and small operators, beside the larger ones of ``queries``."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions.arrays import any_null, clip01, finite
from millrace.functions.time import hours, lenient_timestamp
from millrace.operators import alarms, corpus, dataset_rules, eligibility, evaluation, features, grounding, iforest, profile, retrieval, robust, targets
from millrace.plans.queries import (
    _BEST, ANSWER_SQL, BEST_SQL, CLASSIFIED, ELIGIBLE_SQL, EVALUATION_SQL, FEATURES_SQL, HYBRID_SQL, MODEL, QUESTIONS, RERANK_SQL, SAMPLING, SCORED_SQL, SENSOR, SPEC, TFIDF_SQL, _answers, _diagnosis,
    both_sides, candidates, docs, eligible, featured, fitted, governed, query, r6, rounded, scored, sensor, tfidf,
)
from millrace.plans.tables import cut, shared_folder
from millrace.session import table
from millrace.sources import files


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/millrace-files/{uuid.uuid4().hex}"


# ---------------------------------------------------------------- sources and sinks


@query("a9_parquet_round_trip", "SELECT * FROM events")
def _(spark, d):
    path, e = _folder(spark), table(spark, d, "events")
    files.write_parquet(e, path, expected_rows=e.count())
    return spark.read.schema(e.schema).parquet(path)


@query("a11_parquet_inspection", "SELECT count(*) AS rows, 6 AS columns, min(ts) AS first_timestamp, max(ts) AS last_timestamp FROM events")
def _(spark, d):
    return files.inspect(spark, f"{d}/events.parquet", "ts")


@query("a13_partitioned_sink", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def _(spark, d):
    path = _folder(spark)
    files.write_parquet(table(spark, d, "events"), path, partition_by=("event_type",))
    return spark.read.parquet(path).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("a7_raw_csv_scan", "SELECT event_id, CAST(value AS VARCHAR) AS value, row_number() OVER (ORDER BY event_id) AS place FROM events")
def _(spark, d):
    """A folder of files in the order of event_id; the place of a row is its position without the header lines before it."""
    path = _folder(spark)
    e = table(spark, d, "events").select("event_id", "value")
    e.repartitionByRange(5, "event_id").sortWithinPartitions("event_id").write.option("header", True).csv(path)
    raw = files.raw_csv(spark, path, ("event_id", "value"))
    lines = files.lines_in_order(spark, path).where("line_in_file = 1").select(F.col("position").alias("head"))
    heads = F.size(F.filter(F.col("heads"), lambda h: h < F.col("position")))
    raw = raw.crossJoin(F.broadcast(lines.agg(F.collect_list("head").alias("heads"))))  # one row: a number for each of five files
    return raw.select(F.col("event_id").cast("long").alias("event_id"), "value", (F.col("position") - heads).alias("place"))


@query("a8_typed_csv_scan", "SELECT event_id, value FROM events")
def _(spark, d):
    path = _folder(spark)
    e = table(spark, d, "events").select("event_id", "value")
    files.write_csv_report(e, path)
    return files.typed_csv(spark, path, e.schema)


@query("a23_chunk_files", "SELECT doc_id, count(*) AS chunks FROM (SELECT doc_id, unnest(range(0, CASE WHEN len(w) = 0 THEN 0 ELSE CAST(ceil(greatest(len(w) - 220, 0) / 180) AS BIGINT) + 1 END)) AS i FROM (SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w FROM documents)) GROUP BY 1")
def _(spark, d):
    path = _folder(spark)
    u = docs(spark, d).select(F.col("doc_id").cast("string").alias("source_id"), F.lit(1).alias("unit_index"), "text")
    files.write_chunks(corpus.chunks(u), path)
    return files.read_chunks(spark, path).groupBy(F.col("source_id").cast("long").alias("doc_id")).agg(F.count(F.lit(1)).alias("chunks"))


@query("i21_index_identity")
def _(spark, d):
    voc, index, _ = tfidf(spark, d)
    return retrieval.table_identity(retrieval.entry_rows(index, voc).select("id", "term", r6("weight").alias("weight")))


# ---------------------------------------------------------------- projections and predicates


@query("b1_quoted_projection", "SELECT event_id AS \"event id\", value AS \"a.b\" FROM events")
def _(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("event id"), F.col("value").alias("a.b"))
    return e.select(*[F.col(f"`{n}`") for n in ("event id", "a.b")])


@query("b10_null_features", f"WITH {FEATURES_SQL} SELECT count(*) AS rows_with_nulls FROM features WHERE s1__lag_1 IS NULL OR s2__lag_1 IS NULL")
def _(spark, d):
    return featured(spark, d).where(any_null(["s1__lag_1", "s2__lag_1"])).agg(F.count(F.lit(1)).alias("rows_with_nulls"))


@query("b12_state_lists", f"WITH {ELIGIBLE_SQL} SELECT count(*) FILTER (WHERE partition IN ('train', 'validation')) AS inside, count(*) FILTER (WHERE target_state NOT IN ('unverified', 'warning')) AS outside FROM eligible")
def _(spark, d):
    return eligible(spark, d).agg(F.count_if(F.col("partition").isin("train", "validation")).alias("inside"), F.count_if(~F.col("target_state").isin("unverified", "warning")).alias("outside"))


@query("b13_numeric_features", "SELECT unnest(['s1', 's2', 'st_error', 'st_view']) AS feature")
def _(spark, d):
    return spark.createDataFrame([(n,) for n in robust.numeric_features(sensor(spark, d))], "feature string")


@query("b14_citations", f"WITH {RERANK_SQL}, top AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, hybrid DESC, chunk_id) AS n FROM rr WHERE rerank_score >= 0.08) SELECT query_id, 'S' || n AS citation_id FROM top WHERE n <= 4")
def _(spark, d):
    return grounding.evidence(scored(spark, d)).select("query_id", "citation_id")


@query("b15_report_names", "SELECT '__unnamed_column_0__' AS \"column\", count(*) FILTER (WHERE value IS NULL) AS missing FROM events")
def _(spark, d):
    from millrace.operators import profile

    return profile.missing(table(spark, d, "events").withColumnRenamed("value", "__unnamed_column_0__"), ["__unnamed_column_0__"])


# ---------------------------------------------------------------- joins, sets


@query("c3_optional_scores", f"WITH {SCORED_SQL} SELECT partition, count(*) AS rows, count(*) FILTER (WHERE partition = 'validation' AND eligible_for_scoring AND score > t) AS alarms, count(*) FILTER (WHERE NOT (partition = 'validation' AND coalesce(eligible_for_scoring, false))) AS without_score FROM scored, lim WHERE partition IN ('train', 'validation') GROUP BY 1")
def _(spark, d):
    e, f, scored = fitted(spark, d)
    rows = robust.diagnostic_rows(e, e, scored, f.retained, "event_id")
    return rows.groupBy("partition").agg(F.count(F.lit(1)).alias("rows"), F.count_if("alarm").alias("alarms"), F.count_if(F.col("alarm").isNull()).alias("without_score"))


@query("c5_partition_agreement", "SELECT count(*) AS disagreements FROM documents WHERE doc_id % 7 = 0 AND (lang IS DISTINCT FROM CASE WHEN doc_id % 21 = 0 THEN NULL ELSE 'en' END OR source IS DISTINCT FROM CASE WHEN doc_id % 14 = 0 THEN source ELSE 'elsewhere' END)")
def _(spark, d):
    a = table(spark, d, "documents").select("doc_id", "lang", "source")
    b = a.where("doc_id % 7 = 0").select("doc_id", F.when(F.col("doc_id") % 21 != 0, F.lit("en")).alias("lang"), F.when(F.col("doc_id") % 14 == 0, F.col("source")).otherwise(F.lit("elsewhere")).alias("source"))
    return features.disagreements(a, b, "doc_id", ["lang", "source"]).agg(F.count(F.lit(1)).alias("disagreements"))


@query("c6_citation_lookup", f"WITH {RERANK_SQL}, top AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, hybrid DESC, chunk_id) AS n FROM rr WHERE rerank_score >= 0.08) SELECT query_id, count(*) AS traceable FROM top WHERE n <= 4 GROUP BY 1")
def _(spark, d):
    rr = scored(spark, d)
    cited = grounding.evidence(rr).select("query_id", "chunk_id", *evaluation.TRACED)
    other = rr.select("query_id", "chunk_id", *[F.col(c).alias(f"__{c}") for c in evaluation.TRACED])
    j = cited.join(other, ["query_id", "chunk_id"])
    for c in evaluation.TRACED:
        j = j.where(F.col(c).eqNullSafe(F.col(f"__{c}")))
    return j.groupBy("query_id").agg(F.count(F.lit(1)).alias("traceable"))


@query("g1_candidate_union", f"WITH {TFIDF_SQL}, {HYBRID_SQL} SELECT query_id, id FROM cand")
def _(spark, d):
    index, q, x, y, voc = both_sides(spark, d)
    found = retrieval.keyword_top_k(index, q, 30, retrieval.numbered(voc)[0]).select("query_id", "id").union(retrieval.dense_scores(x, y, 30).select("query_id", "id"))
    return found.distinct()


@query("g2_schema_difference", "SELECT unnest(['n_chars', 'lang', 'source']) AS column_name, 'documents' AS only_in UNION ALL SELECT 'item_id', 'benchmark' UNION ALL SELECT 'doc_id', 'documents'")
def _(spark, d):
    a, b = set(table(spark, d, "documents").columns), set(table(spark, d, "benchmark").columns)
    return spark.createDataFrame([(c, "documents") for c in a - b] + [(c, "benchmark") for c in b - a], "column_name string, only_in string")


@query("g3_token_intersections", f"WITH {RERANK_SQL} SELECT query_id, chunk_id, len(list_intersect(list_distinct(qt), tt)) AS shared FROM kind")
def _(spark, d):
    c = candidates(spark, d)
    q = T.content_tokens(F.col("query"))
    return c.where(F.size(q) > 0).select("query_id", "chunk_id", F.size(F.array_intersect(F.array_distinct(q), F.col("text_tokens"))).cast("long").alias("shared"))


# ---------------------------------------------------------------- aggregates


@query("d2_distinct_counts", f"WITH {FEATURES_SQL} SELECT count(DISTINCT CAST(timestamp AS DATE)) AS days, count(DISTINCT timestamp) AS timestamps, count(DISTINCT segment_id) AS segments, count(DISTINCT history_group_id) AS history_groups FROM features")
def _(spark, d):
    return featured(spark, d).agg(*[F.count_distinct(c).alias(n) for c, n in ((F.to_date("timestamp"), "days"), (F.col("timestamp"), "timestamps"), (F.col("segment_id"), "segments"), (F.col("history_group_id"), "history_groups"))])


@query("d22_candidate_metrics", f"""WITH {SCORED_SQL}, e AS (SELECT source_event, min(timestamp) FILTER (WHERE alarm) IS NOT NULL AS covered, (epoch_us(min(timestamp) FILTER (WHERE alarm)) - epoch_us(min(timestamp))) / 1e6 AS latency FROM val WHERE eligible_for_known_event_evaluation GROUP BY 1),
m AS (SELECT count(*) AS event_count, count(*) FILTER (WHERE covered) AS covered_events, avg(latency) AS mean_latency_seconds FROM e), b AS (SELECT count(*) AS burden_rows, count(*) FILTER (WHERE alarm) AS burden_alarms FROM val WHERE eligible_for_alarm_burden)
SELECT event_count, covered_events, round(mean_latency_seconds, 6) AS mean_latency_seconds, round(covered_events / event_count, 6) AS event_coverage, burden_rows, burden_alarms, round(burden_alarms / burden_rows, 6) AS alarm_burden_fraction,
round(burden_alarms * 24.0::DOUBLE / (burden_rows * {SAMPLING}::DOUBLE / 3600.0::DOUBLE), 6) AS alarms_per_24_hours FROM m, b""")
def _(spark, d):
    return rounded(alarms.candidate_metrics(fitted(spark, d)[2], SAMPLING))


_MEASURES = f"""SELECT '{{0}}' AS model, event_count, covered_events, round(mean_latency_seconds, 6) AS mean_latency_seconds, round(covered_events / event_count, 6) AS event_coverage, burden_rows, burden_alarms, round(burden_alarms / burden_rows, 6) AS alarm_burden_fraction,
round(burden_alarms * 24.0::DOUBLE / (burden_rows * {SAMPLING}::DOUBLE / 3600.0::DOUBLE), 6) AS alarms_per_24_hours
FROM (SELECT count(*) AS event_count, count(*) FILTER (WHERE covered) AS covered_events, avg(latency) AS mean_latency_seconds FROM (SELECT source_event, min(timestamp) FILTER (WHERE alarm) IS NOT NULL AS covered, (epoch_us(min(timestamp) FILTER (WHERE alarm)) - epoch_us(min(timestamp))) / 1e6 AS latency FROM {{1}} WHERE eligible_for_known_event_evaluation GROUP BY 1)),
(SELECT count(*) AS burden_rows, count(*) FILTER (WHERE alarm) AS burden_alarms FROM {{1}} WHERE eligible_for_alarm_burden)"""


@query("d30_comparison", f"WITH {SCORED_SQL}, held AS (SELECT s.*, score > t AS alarm FROM scored s, lim WHERE partition = 'test' AND eligible_for_scoring) {_MEASURES.format('validation', 'val')} UNION ALL {_MEASURES.format('test', 'held')}")
def _(spark, d):
    e = cut(eligible(spark, d))
    measure = lambda part: alarms.candidate_metrics(robust.run(e, 0.95, part, MODEL)[1], SAMPLING)
    return rounded(alarms.comparison(measure("validation"), measure("test"), ("validation", "test")))


@query("d26_citation_metrics", f"WITH {EVALUATION_SQL} SELECT case_id, citation_count, traceable_count, round(traceability_rate, 6) AS traceability_rate, marker_coverage, scoped_count, aligned_count, round(scope_alignment_rate, 6) AS scope_alignment_rate FROM cmr")
def _(spark, d):
    from millrace.plans.queries import _cases

    cases, _, r, ans = _cases(spark, d)
    return rounded(evaluation.citation_metrics(cases, ans, r))


@query("d27_faithfulness", f"WITH {EVALUATION_SQL} SELECT case_id, claim_count, supported_count, round(supported_rate, 6) AS supported_rate FROM fr")
def _(spark, d):
    from millrace.plans.queries import _cases

    _, _, r, ans = _cases(spark, d)
    return rounded(evaluation.faithfulness(ans, r))


@query("d28_usefulness", f"WITH {EVALUATION_SQL} SELECT case_id, status, status_match, reason_match, intent_match, concept_coverage, useful, refusal_boundary FROM uu JOIN cm USING (case_id)")
def _(spark, d):
    from millrace.plans.queries import _cases

    cases, _, _, ans = _cases(spark, d)
    return evaluation.usefulness(cases, ans)


# ---------------------------------------------------------------- windows, sorts


@query("e3_file_order", "SELECT count(*) AS intervals, count(*) FILTER (WHERE s < 0) AS decreases, sum(abs(s))::BIGINT AS milliseconds FROM (SELECT epoch_us(ts) // 1000 - lag(epoch_us(ts) // 1000) OVER (ORDER BY event_id) AS s FROM events) WHERE s IS NOT NULL")
def _(spark, d):
    """Neighbours in the order of a folder of files whose sizes differ, so that Spark doesn't read them by name."""
    path, header = _folder(spark), ("event_id", "timestamp")
    e = table(spark, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS").alias("timestamp"))
    n = e.agg(F.max("event_id")).first()[0] or 0
    part = F.floor(F.sqrt(F.col("event_id") / F.lit(n + 1)) * 6).cast("int")  # later files are smaller
    e.repartitionByRange(6, part).sortWithinPartitions("event_id").write.option("header", True).csv(path)
    iv = profile.intervals(files.raw_csv(spark, path, header).withColumn("ts", lenient_timestamp(F.col("timestamp"))), "ts", "position")
    s = F.col("interval_seconds")
    return iv.agg(F.count(F.lit(1)).alias("intervals"), F.count_if(s < 0).alias("decreases"), F.sum(F.round(F.abs(s) * 1000).cast("long")).alias("milliseconds"))


@query("e5_history_boundaries", f"WITH {FEATURES_SQL} SELECT event_id FROM features WHERE history_rows_available = 1")
def _(spark, d):
    return featured(spark, d).where("history_rows_available = 1").select("event_id")


@query("e8_lag_and_delta", f"WITH {FEATURES_SQL} SELECT event_id, round(s1__lag_1, 6) AS s1__lag_1, round(s1__delta_1, 6) AS s1__delta_1 FROM features")
def _(spark, d):
    return featured(spark, d).select("event_id", r6("s1__lag_1").alias("s1__lag_1"), r6("s1__delta_1").alias("s1__delta_1"))


@query("e13_ranks", "SELECT part.p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part")
def _(spark, d):
    w = W.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    return table(spark, d, "part").select("p_partkey", F.row_number().over(w).cast("long").alias("rank"))


@query("e14_named_window", "SELECT o_orderkey, round(avg(o_totalprice) OVER w, 6) AS mean_6, count(*) OVER w AS rows_6 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)")
def _(spark, d):
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(-5, W.currentRow)
    return table(spark, d, "orders").select("o_orderkey", r6(F.avg("o_totalprice").over(w)).alias("mean_6"), F.count(F.lit(1)).over(w).alias("rows_6"))


@query("f1_ordered_output", f"WITH {SENSOR} SELECT timestamp, s1 FROM sensor ORDER BY timestamp")
def _(spark, d):
    return sensor(spark, d).select("timestamp", "s1").orderBy("timestamp")


@query("f7_rerank_order", f"WITH {RERANK_SQL} SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, hybrid DESC, chunk_id) AS rerank_rank, round(rerank_score, 6) AS rerank_score FROM rr")
def _(spark, d):
    return rounded(grounding.ranked(scored(spark, d).select("query_id", "chunk_id", "rerank_score", "hybrid")).select("query_id", F.col("rerank_rank").cast("long").alias("rerank_rank"), "rerank_score"))


@query("f8_best_sentences", f"WITH {RERANK_SQL}, {BEST_SQL} SELECT query_id, chunk_id, sentences FROM best")
def _(spark, d):
    """A text is cut into sentences and tokens once, then meets the questions."""
    q = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("query_id"), T.content_tokens(F.lit(t)).alias("k")) for i, t in enumerate(QUESTIONS)])).alias("q")
    x = docs(spark, d).select("doc_id", grounding.sentence_tokens(F.col("text")).alias("cut")).select(q, "*")
    return x.select("q.query_id", F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("chunk_id"), grounding.best_of(F.col("q.k"), F.col("cut"), 2).alias("sentences"))


# ---------------------------------------------------------------- scalar functions


@query("h2_fractional_hours", "SELECT event_id, ts - to_seconds(900) AS before, ts + to_seconds(5400) AS after FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", (F.col("ts") - hours(0.25)).alias("before"), (F.col("ts") + hours(1.5)).alias("after"))


@query("h3_hour_of_day", "SELECT CAST(extract(hour FROM ts) AS BIGINT) AS hour, count(*) AS n FROM events GROUP BY 1")
def _(spark, d):
    return table(spark, d, "events").groupBy(F.hour("ts").cast("long").alias("hour")).agg(F.count(F.lit(1)).alias("n"))


@query("h4_dates", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n FROM events GROUP BY 1")
def _(spark, d):
    return table(spark, d, "events").groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query("h6_lenient_timestamps", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN NULL WHEN 1 THEN date_trunc('second', ts) ELSE date_trunc('second', ts) - to_hours(2) END AS parsed FROM events")
def _(spark, d):
    e, n = table(spark, d, "events"), F.col("event_id") % 3
    whole = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    return e.select("event_id", lenient_timestamp(F.when(n == 0, "not-a-timestamp").when(n == 1, F.concat(whole, F.lit("Z"))).otherwise(F.concat(whole, F.lit("+02:00")))).alias("parsed"))


@query("h8_largest_deviation", "SELECT l_orderkey, l_linenumber, round(greatest(abs((l_quantity - 25) / 10), abs((l_discount - 0.05) / 0.02)), 6) AS score FROM lineitem")
def _(spark, d):
    p = (robust.Parameter("l_quantity", 25.0, 10.0), robust.Parameter("l_discount", 0.05, 0.02))
    return rounded(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", robust.score(p).alias("score")))


@query("h9_clip_and_finite", "SELECT vec_id, round(greatest(0.0, least(1.0, embedding[1]::DOUBLE)), 6) AS clipped, isfinite(embedding[1]) AS finite FROM embeddings")
def _(spark, d):
    x = F.col("embedding")[0].cast("double")
    return rounded(table(spark, d, "embeddings").select("vec_id", clip01(x).alias("clipped"), finite(x).alias("finite")))


@query("h10_rounding_casts", "SELECT l_orderkey, l_linenumber, CAST(l_discount * 10 AS INTEGER) AS tenths, CAST(CAST(l_tax AS FLOAT) AS DOUBLE) AS tax FROM lineitem")
def _(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.rint(F.col("l_discount") * 10).cast("int").alias("tenths"), F.col("l_tax").cast("float").cast("double").alias("tax"))


@query("h12_contributions", f"WITH {SCORED_SQL} " + " UNION ALL ".join(f"SELECT event_id, '{f}' AS feature, round(dev_{f}, 6) AS contribution FROM val" for f in MODEL))
def _(spark, d):
    rows, f = _diagnosis(spark, d)
    return rounded(rows.select("event_id", F.explode(robust.contributions(f.retained)).alias("c")).select("event_id", "c.feature", "c.contribution"))


@query("h14_saved_or_recomputed", f"WITH {SCORED_SQL} SELECT event_id, round(score, 6) AS robust_distance_score, {_BEST} AS feature FROM scored WHERE partition IN ('train', 'validation') AND s1__mean_30 IS NOT NULL")
def _(spark, d):
    e, f, scored = fitted(spark, d)
    rows = robust.diagnostic_rows(e, e, scored, f.retained, "event_id")
    return rounded(rows.select("event_id", "robust_distance_score", "dominant.feature"))


@query("h21_phrase_share", f"WITH {RERANK_SQL} SELECT query_id, chunk_id, round(phrase, 6) AS phrase FROM parts")
def _(spark, d):
    c = candidates(spark, d).withColumn("q", T.content_tokens(F.col("query"))).where(F.size("q") > 0)
    return rounded(c.select("query_id", "chunk_id", T.phrase_share(F.col("q"), F.col("text_tokens")).alias("phrase")))


@query("h23_intents", "SELECT doc_id, CASE WHEN contains(t, 'service manual') OR contains(t, 'part number') OR contains(t, 'this unit') OR contains(t, 'exact equipment') OR contains(t, 'this compressor') OR contains(t, 'manufacturer-specified') OR contains(t, 'manufacturer specified') OR contains(t, 'model-specific') OR contains(t, 'model specific') THEN 'equipment_specific' WHEN contains(t, 'dataset') OR contains(t, 'uci') OR contains(t, 'sensor data') OR contains(t, 'failure event') OR contains(t, 'sampling interval') THEN 'dataset_specific' ELSE 'general' END AS intent FROM (SELECT doc_id, lower(text) AS t FROM documents)")
def _(spark, d):
    return docs(spark, d).select("doc_id", grounding.intent(F.col("text"), grounding.Grounding()).alias("intent"))


@query("h24_affinity", f"WITH {RERANK_SQL} SELECT DISTINCT intent, classification, round(affinity, 6) AS affinity FROM parts")
def _(spark, d):
    return rounded(grounding.scored(candidates(spark, d)).select("intent", "classification", F.col("classification_affinity").alias("affinity")).distinct())


@query("h25_citation_markers", "SELECT doc_id, len(regexp_extract_all(text || ' x [S1] y [S2].', '\\[([A-Z][A-Z0-9]*)\\]', 1)) AS markers FROM documents")
def _(spark, d):
    return docs(spark, d).select("doc_id", F.size(T.markers(F.concat("text", F.lit(" x [S1] y [S2].")))).cast("long").alias("markers"))


@query("h29_model_matrix", f"WITH {SCORED_SQL} SELECT event_id, {' + '.join(f'CAST(CAST({f} AS FLOAT) AS DOUBLE) * 0' for f in MODEL)} + {len(MODEL)} AS width, isfinite({' + '.join(MODEL)}) AS finite FROM val")
def _(spark, d):
    rows, _ = _diagnosis(spark, d)
    m = F.array(*[F.col(f).cast("float") for f in MODEL])
    return rows.select("event_id", F.size(m).cast("double").alias("width"), F.forall(m, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))).alias("finite"))


@query("h5_configured_intervals", """WITH c(name, a, z) AS (VALUES ('f_train', TIMESTAMP '2024-01-08 06:00:00', TIMESTAMP '2024-01-08 14:00:00'), ('f_val', TIMESTAMP '2024-01-18 10:00:00', TIMESTAMP '2024-01-18 20:00:00'), ('f_test', TIMESTAMP '2024-01-26 03:00:00', TIMESTAMP '2024-01-26 09:00:00'))
SELECT name, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS rows, count(*) FILTER (WHERE value IS NULL) AS missing FROM events JOIN c ON ts BETWEEN a AND z GROUP BY 1""")
def _(spark, d):
    """Intervals come from strict texts of the settings; what the series holds in each of them."""
    SPEC.validate()
    name = targets.first_of([((F.col("ts") >= F.lit(e.start)) & (F.col("ts") <= F.lit(e.end)), e.name) for e in SPEC.events]).alias("name")
    x = table(spark, d, "events").select(name, "ts", "value").where("name is not null")
    return x.groupBy("name").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("rows"), F.count_if(F.col("value").isNull()).alias("missing"))


@query("b4_event_windows", f"WITH {CLASSIFIED} SELECT coalesce(exclusion_event, 'none') AS exclusion_event, coalesce(warning_event, 'none') AS warning_event, count(*) AS n FROM classified GROUP BY 1, 2")
def _(spark, d):
    c = targets.classify(sensor(spark, d), SPEC, tie="event_id")
    return c.groupBy(F.coalesce("exclusion_event", F.lit("none")).alias("exclusion_event"), F.coalesce("warning_event", F.lit("none")).alias("warning_event")).agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- composites without SQL


@query("i6_forest_held_out")
def _(spark, d):
    e = cut(eligible(spark, d))
    f = iforest.fit(e.where("eligible_for_reference_fit"), MODEL, iforest.Candidate(100, 1024, 1.0), "event_id")
    limit = robust.threshold(iforest.score(e.where("eligible_for_reference_fit"), f), 0.95, "anomaly_score")
    held = robust.with_alarm(iforest.score(e.where("partition = 'test' and eligible_for_scoring"), f), "anomaly_score", limit)
    return alarms.candidate_metrics(held, SAMPLING)


@query("i12_answered_questions", f"WITH {ANSWER_SQL} SELECT query_id, status, reason_code, (SELECT count(*) FROM cit WHERE cit.query_id = ans.query_id)::INTEGER AS citations FROM ans")
def _(spark, d):
    return _answers(spark, d)[2].select("query_id", "status", "reason_code", F.size("citations").alias("citations"))


@query("i20_single_row_prediction")
def _(spark, d):
    e = cut(eligible(spark, d))
    f = iforest.fit(e.where("eligible_for_reference_fit"), MODEL, iforest.Candidate(100, 1024, 1.0), "event_id")
    row = e.where("eligible_for_scoring").orderBy("event_id").first().asDict()
    p = iforest.predict_one({k: row[k] for k in MODEL}, f, 0.5)
    return spark.createDataFrame([(p["anomaly_score"], p["threshold"], p["alarm"])], "anomaly_score double, threshold double, alarm boolean")


@query("i19_eligibility_report", f"WITH {ELIGIBLE_SQL} SELECT coalesce(partition, 'excluded') AS partition, evaluation_role, count(*) AS row_count FROM eligible GROUP BY 1, 2")
def _(spark, d) -> DataFrame:
    e = eligible(spark, d)
    eligibility.check_chronology(e)
    return e.groupBy(F.coalesce("partition", F.lit("excluded")).alias("partition"), "evaluation_role").agg(F.count(F.lit(1)).alias("row_count"))


# ---------------------------------------------------------------- rules over tables


@query("contract_documents", """SELECT unnest(['doc_id is missing', 'text is missing', 'lang is none of the agreed values', 'n_chars is not what it was frozen from', 'doc_id repeats', 'fewer than 1 rows']) AS rule,
  unnest([count(*) FILTER (WHERE doc_id IS NULL), count(*) FILTER (WHERE text IS NULL), count(*) FILTER (WHERE lang IS NULL OR lang NOT IN ('en', 'de')), count(*) FILTER (WHERE n_chars IS DISTINCT FROM len(text)), count(*) - count(DISTINCT doc_id), 0]) AS broken FROM documents""")
def _(spark, d):
    r = dataset_rules
    rules = r.TableRules((*r.present("doc_id", "text"), *r.one_of("lang", ["en", "de"]), *r.frozen("n_chars", "length(text)")), unique=("doc_id",))
    return r.broken_rules(table(spark, d, "documents"), rules)


@query("contract_order_lines", """WITH o AS (SELECT DISTINCT o_orderkey FROM orders WHERE o_orderkey % 7 <> 0), l AS (SELECT DISTINCT l_orderkey FROM lineitem)
SELECT unnest(['l_quantity is not finite', 'l_tax is after l_quantity', 'discounts stay under a tenth', 'l_orderkey is unknown to the other table', 'l_orderkey of the other table is absent', 'fewer than 1 rows']) AS rule,
  unnest([count(*) FILTER (WHERE l_quantity IS NULL), count(*) FILTER (WHERE NOT coalesce(l_tax <= l_quantity, false)), count(*) FILTER (WHERE NOT coalesce(l_discount < 0.1, false)),
  (SELECT count(*) FROM l WHERE l_orderkey NOT IN (SELECT o_orderkey FROM o)), (SELECT count(*) FROM o WHERE o_orderkey NOT IN (SELECT l_orderkey FROM l)), 0]) AS broken FROM lineitem""")
def _(spark, d):
    r = dataset_rules
    rows = (*r.finite("l_quantity"), *r.in_order("l_tax", "l_quantity"), r.RowRule("discounts stay under a tenth", "l_discount < 0.1"))
    rules = r.TableRules(rows, keys=("l_orderkey",), names={"l_orderkey": "o_orderkey"})
    return r.broken_rules(table(spark, d, "lineitem"), rules, table(spark, d, "orders").where("o_orderkey % 7 <> 0"))
