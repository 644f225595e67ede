import zipfile
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import contracts as C
from millrace.operators import corpus, iforest, retrieval, robust
from millrace.operators.contracts import ContractError
from millrace.operators.service import Knowledge, Prediction, Services, smoke
from millrace.sources import archive, charts, files
from millrace.sources.store import Counters, Store, load_forest, save_forest
from millrace.streaming.scoring import score_stream

ROW = [",".join(files.HEADER), "0,2020-01-01 00:00:00," + ",".join(["1.5"] * 7) + ",1,0,1,0,1,0,1,0", "10,2020-01-01 00:00:10," + ",".join(["2.5"] * 7) + ",1,0,1,0,1,0,1,0"]


@pytest.fixture
def csv(tmp_path):
    p = tmp_path / "s.csv"
    p.write_text("\n".join(ROW) + "\n", encoding="utf-8")
    return str(p)


def test_csv_to_parquet(spark, csv, tmp_path):
    out = str(tmp_path / "t.parquet")
    r = files.convert(spark, csv, out)
    assert (r["rows"], r["columns"], r["source_rows"]) == (2, 17, 2)
    d = spark.read.parquet(out).orderBy("C0").collect()
    assert [x["C0"] for x in d] == [0, 10] and d[1]["timestamp"] == datetime(2020, 1, 1, 0, 0, 10)
    with pytest.raises(Exception):
        files.convert(spark, csv, out)
    with pytest.raises(files.GovernanceError):
        files.check_parquet(spark, out, files.SENSOR, 3)
    assert files.inspect(spark, out).first()["rows"] == 2


def test_header_and_typed_cells_are_checked(spark, tmp_path):
    bad = tmp_path / "b.csv"
    bad.write_text("x," + ROW[0].removeprefix(",") + "\n" + ROW[1] + "\n")
    with pytest.raises(files.GovernanceError):
        files.check_header(spark, str(bad))
    broken = tmp_path / "c.csv"
    broken.write_text(ROW[0] + "\n" + ROW[1].replace("1.5", "bad", 1) + "\n")
    with pytest.raises(Exception):
        files.typed_csv(spark, str(broken)).collect()


def test_raw_rows_are_padded_and_cut(spark, tmp_path):
    p = tmp_path / "r.csv"
    p.write_text(ROW[0] + "\n1,2020-01-01 00:00:00,5\n" + ROW[1] + ",9,9\n")
    got = files.raw_csv(spark, str(p)).orderBy("position").collect()
    assert [r["width"] for r in got] == [3, 19] and got[0]["COMP"] == "" and got[0]["TP2"] == "5" and got[0]["C0"] == "1"


def test_files_are_read_in_the_order_of_names(spark, tmp_path):
    """The larger file comes second, and Spark's own order begins with it; a third has one line without a line end."""
    (tmp_path / "d").mkdir()
    for name, ids in (("part-1.csv", range(3)), ("part-2.csv", range(3, 50)), ("part-3.csv", [50])):
        (tmp_path / "d" / name).write_text("id,v\n" + "\n".join(f"{i},{'id' if i == 7 else i}" for i in ids) + ("\n" if name != "part-3.csv" else ""))
    header = ("id", "v")
    files.check_header(spark, str(tmp_path / "d"), header)
    got = files.raw_csv(spark, str(tmp_path / "d"), header).orderBy("position").collect()
    assert [int(r["id"]) for r in got] == list(range(51))
    assert [r["position"] for r in got] == [*range(2, 5), *range(6, 53), 54]
    (tmp_path / "d" / "part-4.csv").write_text("v,id\n")
    with pytest.raises(files.GovernanceError):
        files.check_header(spark, str(tmp_path / "d"), header)
    empty = tmp_path / "none"
    empty.mkdir()
    (empty / "a.csv").write_text("")
    assert files.raw_csv(spark, str(empty), header).count() == 0


def test_a_file_in_many_splits_keeps_its_order(spark, tmp_path):
    import random

    rng = random.Random(1)
    rows = [f"{i},{'x' * rng.choice((0, 3, 400, 3000))}" for i in range(800)]
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "b.csv").write_text("id,v\n" + "\n".join(rows[:700]) + "\n")
    (tmp_path / "s" / "c.csv").write_text("id,v\r\n" + "\r\n".join(rows[700:]) + "\r\n")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
        spark.conf.set("spark.sql.files.openCostInBytes", "10")
        d = files.raw_csv(spark, str(tmp_path / "s"), ("id", "v"))
        assert d.rdd.getNumPartitions() > 40
        got = d.orderBy("position").collect()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert [f"{r['id']},{r['v']}" for r in got] == rows and [r["position"] for r in got] == [*range(2, 702), *range(703, 803)]


def test_archives(tmp_path):
    z = tmp_path / "a.zip"
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("in/x.csv", "1")
        f.writestr("in/y.csv", "2")
        f.writestr("other/y.csv", "3")
    assert archive.validate_zip(z, ["x.csv"]) == {"x.csv": "in/x.csv"}
    with pytest.raises(files.GovernanceError):
        archive.validate_zip(z, ["y.csv"])
    assert archive.extract(z, tmp_path / "o", ["x.csv"])[0].read_text() == "1"
    with pytest.raises(FileExistsError):
        archive.extract(z, tmp_path / "o", ["x.csv"])
    m = tmp_path / "m.json"
    files.write_json({"sources": [{"source_id": "s"}]}, m)
    assert archive.update_manifest(m, "s", sha256="1")["sha256"] == "1"
    with pytest.raises(files.GovernanceError):
        archive.update_manifest(m, "t")
    with pytest.raises(files.GovernanceError):
        archive.materialize(z, None, "0" * 64)
    assert archive.materialize(z, None, files.sha256_file(z))["retrieval"] == "existing"
    with pytest.raises(files.GovernanceError):
        archive.confined(tmp_path, "../x")


def test_chunk_files_and_checks(spark, tmp_path):
    units = spark.createDataFrame([("s", 1, "p1", "alpha beta gamma " * 5), ("s", 2, "p2", "delta")], "source_id string, unit_index int, locator string, text string")
    made = corpus.chunks(units, 6, 2)
    rows = made.orderBy("source_chunk_index").collect()
    assert [r["source_chunk_index"] for r in rows] == [1, 2, 3, 4, 5] and rows[0]["chunk_id"].startswith("s::u0001::c0001::")
    C.check_chunks(made)
    files.write_chunks(made, str(tmp_path / "c"))
    assert files.read_chunks(spark, str(tmp_path / "c"), 5).count() == 5
    with pytest.raises(files.GovernanceError):
        files.read_chunks(spark, str(tmp_path / "c"), 4)
    with pytest.raises(C.ContractError):
        C.check_chunks(made.withColumn("text_sha256", made["chunk_id"]))


RETRIEVAL = {
    "schema_version": 1, "retrieval_id": "r", "corpus_id": "c", "input_chunk_path": "i", "index_path": "x", "report_path": "p", "reproducibility": {"expected_chunk_count": 3, "expected_chunk_sha256": "a" * 64},
    "keyword": {"lowercase": True, "sublinear_tf": True, "ngram_min": 1, "ngram_max": 2, "min_df": 1, "max_features": 10}, "embedding": {"method": "lsa_tfidf", "algorithm": "randomized", "dimension": 2, "n_iter": 7, "random_state": 42},
    "hybrid": {"vector_weight": 0.65, "keyword_weight": 0.35, "candidate_k": 30, "default_top_k": 8, "maximum_top_k": 12},
}


@pytest.mark.parametrize("path, value", [("schema_version", True), ("hybrid.vector_weight", 0.7), ("keyword.ngram_min", 3), ("embedding.dimension", 1), ("hybrid.maximum_top_k", 40), ("reproducibility.expected_chunk_sha256", "A" * 64), ("index_path", " ")])
def test_retrieval_contract(path, value):
    import copy

    C.check_retrieval(RETRIEVAL)
    bad = copy.deepcopy(RETRIEVAL)
    at = bad
    *head, last = path.split(".")
    for h in head:
        at = at[h]
    at[last] = value
    with pytest.raises(C.ContractError):
        C.check_retrieval(bad)


def test_other_contracts_reject_empty_and_secret_settings():
    for f in (C.check_features, C.check_baseline, C.check_robust, C.check_diagnosis, C.check_comparison, C.check_corpus, C.check_application, C.check_test_lock):
        with pytest.raises(C.ContractError):
            f({})
    with pytest.raises(C.ContractError):
        C.reject_secrets({"a": [{"api_key": "x"}]})
    C.reject_secrets({"allowed_environment_variables": ["TOKEN"]})
    with pytest.raises(C.ContractError):
        C.check_chain({"a": 1}, {"a": 2})
    robust_ok = {"fit": {"partition": "train", "eligibility_column": "eligible_for_reference_fit", "location": "median", "scale": "interquartile_range", "zero_iqr_policy": "exclude_feature_and_record_reason"}, "score": {"threshold_quantile": 0.995, "threshold_fit_population": "eligible_training_reference_scores", "threshold_frozen_before_validation": True}, "validation": {"partition": "validation", "test_partition_locked": True}}
    C.check_robust(robust_ok)


def test_case_contract():
    good = {"case_id": "1", "category": "general", "query": "q", "expected_status": "answered", "expected_reason_code": "grounded", "expected_intent": "general", "relevant_source_ids": ["s"], "expected_source_classifications": ["c"], "required_concepts": [["x"]]}
    C.check_cases([good], {"general"})
    for bad in ({"relevant_source_ids": []}, {"category": "other"}, {"expected_status": "maybe"}):
        with pytest.raises(C.ContractError):
            C.check_cases([good | bad], {"general"})
    with pytest.raises(C.ContractError):
        C.check_cases([good, good], {"general"})


def test_store_keeps_the_newest(spark, tmp_path):
    s = Store(spark, str(tmp_path / "st"), {"records": 2, "evaluations": 2, "events": 3})
    row = lambda i: {"request_id": str(i), "operation": "predict", "status": "ok", "created_at": datetime(2024, 1, 1), "request_json": {"b": 1, "a": i}, "response_json": "{}"}
    for i in range(3):
        s.append("records", row(i))
    got = s.recent("records", 5).collect()
    assert [r["request_id"] for r in got] == ["2", "1"] and got[0]["request_json"] == '{"a":2,"b":1}'
    with pytest.raises(files.GovernanceError):
        s.append("records", row(2))
    assert s.counts() == {"records": 2, "evaluations": 0, "events": 0}
    c = Counters()
    c.add("x")
    assert c.read() == {"x": 1}


def test_services(spark, tmp_path):
    rng = np.random.default_rng(1)
    d = spark.createDataFrame([(i, float(a)) for i, a in enumerate(rng.normal(size=100))], "id long, a double")
    f = iforest.fit(d, ["a"], iforest.Candidate(5, 32, 1.0), "id")
    save_forest(spark, f, str(tmp_path / "f"))
    again = load_forest(spark, str(tmp_path / "f"), ("a",))
    x = rng.normal(size=(20, 1))
    assert np.allclose(f.score(x), again.score(x))
    with pytest.raises(files.GovernanceError):
        load_forest(spark, str(tmp_path / "f"), ("b",))
    s = Services(Store(spark, str(tmp_path / "st"), {"records": 9, "evaluations": 9, "events": 9}), Prediction(again, "c", 0.9))
    r = s.predict({"a": 0.0})
    assert r["status"] == "ok" and r["result"]["alarm"] is False
    assert s.predict({"b": 0.0})["status"] == "rejected"
    s.evaluate(r["request_id"], "predict", "useful")
    assert s.history(9, "predict").count() == 2 and s.metrics()["stored"]["evaluations"] == 1
    assert s.ready()["status"] == "not_ready" and s.live()["status"] == "live"
    with pytest.raises(C.ContractError):
        Prediction(again, "c", 0.9, {"threshold": 0.8})


def test_knowledge_answers_and_refuses(spark):
    texts = ["Compressed air leaks can be reduced by regular inspection.", "The dataset contains sensor data of air pressure.", "Pumps need oil changes often.", "Filters are cleaned monthly."]
    kinds = ["authoritative_general_reference", "exact_dataset_source", "authoritative_general_reference", "authoritative_general_reference"]
    rows = [(f"c{i}", f"s{i}", t, k, "p:1", "h") for i, (t, k) in enumerate(zip(texts, kinds, strict=True))]
    chunks = spark.createDataFrame(rows, "chunk_id string, source_id string, text string, classification string, locator string, text_sha256 string")
    k = Knowledge(spark, chunks, 2)
    assert k.retrieve("air leaks").first()["chunk_id"] == "c0"
    assert k.retrieve("zzzxxyyqqq").count() == 0
    assert all(c["passed"] for c in smoke(k))


def test_a_log_is_compacted_and_an_id_has_one_writer(spark, tmp_path):
    kept = {"records": 3, "evaluations": 3, "events": 3}
    a, b = (Store(spark, str(tmp_path / "st"), kept, compact=4) for _ in range(2))
    row = lambda i: {"request_id": f"r{i}", "operation": "read", "status": "ok", "created_at": datetime(2024, 1, 1), "request_json": {"i": i}, "response_json": "{}"}
    for i in range(5):
        a.append("records", row(i))
    with pytest.raises(files.GovernanceError):
        b.append("records", row(4))  # the other writer has it, in an append that isn't compacted
    assert [r["request_id"] for r in b.recent("records", 9).collect()] == ["r4", "r3", "r2"]
    folder = tmp_path / "st" / "records"
    assert len(list((folder / "tail").iterdir())) == 1 and len(list((folder / "base").iterdir())) == 1
    b.append("records", row(0))  # r0 left by retention when the log was compacted
    a.compact("records")
    assert [r["request_id"] for r in a.read("records").orderBy("sequence").collect()] == ["r3", "r4", "r0"]
    assert not list((folder / "tail").iterdir()) and len([p for p in (folder / "ids").iterdir() if not p.name.startswith(".")]) == 3
    a.compact("records")
    assert a.counts() == {"records": 3, "evaluations": 0, "events": 0}


def test_stream_scoring(spark, tmp_path):
    d = spark.createDataFrame([(1.0,), (9.0,)], "x double")
    d.write.parquet(str(tmp_path / "in"))
    fit = robust.Fit((robust.Parameter("x", 0.0, 1.0),), (), 2, 5.0)
    q = score_stream(spark.readStream.schema("x double").parquet(str(tmp_path / "in")), fit).writeStream.format("memory").queryName("scored").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["x"], r["alarm"]) for r in spark.table("scored").collect()) == [(1.0, False), (9.0, True)]


def test_charts_are_svg():
    assert charts.state_bars([{"signal": "a<b", "state": 1, "percentage": 50.0}]).count("<rect") == 1
    assert "a&lt;b" in charts.state_bars([{"signal": "a<b", "state": 1, "percentage": 50.0}])
    assert charts.quantile_strips([{"signal": "x", "minimum": 0, "q25": 1, "q50": 2, "q75": 3, "maximum": 4}]).startswith("<svg")


def test_saved_index_answers_alike_and_refuses_other_chunks(spark, tmp_path):
    rows = [(f"c{i}", f"compressor pressure note {i} about valve {i % 3} and leak {i % 5}") for i in range(12)]
    chunks = spark.createDataFrame(rows, "chunk_id string, text string")
    k = Knowledge(spark, chunks, 3)
    k.save(str(tmp_path / "index"))
    again = Knowledge.load(spark, str(tmp_path / "index"), chunks)
    hits = lambda x: [(r["rank"], r["chunk_id"], round(r["hybrid_score"], 9)) for r in x.retrieve("pressure valve 2", 4).collect()]
    assert hits(k) == hits(again) and len(hits(k)) == 4
    with pytest.raises(ValueError):
        Knowledge.load(spark, str(tmp_path / "index"), spark.createDataFrame([*rows, rows[0]], "chunk_id string, text string"))


def test_a_changed_chunk_is_named_and_only_its_range_rebuilt(spark, tmp_path):
    rows = [(f"c{i}", f"compressor pressure note {i} about valve {i % 3} and leak {i % 5}") for i in range(30)]
    frame = lambda x: spark.createDataFrame(x, "chunk_id string, text string")
    path = str(tmp_path / "index")
    k = Knowledge(spark, frame(rows), 3)
    k.save(path)
    leaf_of = {r["chunk_id"]: r["l"] for r in frame([*rows, ("new", "")]).select("chunk_id", retrieval.leaf(F.col("chunk_id")).alias("l")).collect()}
    now = [r for r in rows if r[0] != "c9"]
    now[4] = ("c4", "leak leak valve")
    now.append(("new", "compressor valve pressure"))
    want = sorted({leaf_of[c] for c in ("c4", "c9", "new")})
    with pytest.raises(ContractError, match=str(want[0])):
        Knowledge.load(spark, path, frame(now))
    again, changed = Knowledge.refresh(spark, path, frame(now))
    assert changed == want
    old, new = ({(r["id"], r["term"]): r["weight"] for r in x.index.collect()} for x in (k, again))
    assert {i for i, _ in new} == {c for c, _ in now} and all(new[p] == v for p, v in old.items() if leaf_of[p[0]] not in want)
    whole = retrieval.tfidf(retrieval.term_counts(frame(now), "chunk_id", "text"), k.vocabulary).collect()
    assert {(r["id"], r["term"]) for r in whole} == new.keys() and all(abs(new[r["id"], r["term"]] - r["weight"]) < 1e-12 for r in whole)
    assert again.embedded.count() == len(now) and again.retrieve("leak valve", 2).first()["chunk_id"] == "c4"
    same, none = Knowledge.refresh(spark, path, frame(rows))
    assert none == [] and same.index.count() == k.index.count()


def test_readiness_follows_the_frozen_files_and_retrieval_is_kept(spark, tmp_path):
    import hashlib

    f = tmp_path / "model.json"
    f.write_text("{}")
    chunks = spark.createDataFrame([(f"c{i}", f"compressor pressure note {i}") for i in range(6)], "chunk_id string, text string")
    s = Services(Store(spark, str(tmp_path / "st"), {"records": 9, "evaluations": 9, "events": 9}), None, Knowledge(spark, chunks, 2), {str(f): hashlib.sha256(b"{}").hexdigest()})
    assert s.ready()["components"][f"file:{f}"]
    got = s.retrieve("compressor note", 3)
    assert got["status"] == "ok" and got["result"]["result_count"] == 3 and s.retrieve(" ")["status"] == "rejected"
    f.write_text("{ }")
    assert not s.ready()["components"][f"file:{f}"] and s.ready()["status"] == "not_ready"
    assert s.metrics()["counters"]["retrieve.requests"] == 2


def test_a_csv_of_several_files_is_converted_with_a_header_in_each(spark, tmp_path):
    row = "2020-01-01 00:00:00.000," + ",".join(["1.0"] * (len(files.HEADER) - 2))
    lines = spark.range(100).selectExpr("id", f"concat(id, ',{row}') as value").repartitionByRange(3, "id").sortWithinPartitions("id")
    files.with_headers(lines).write.text(f"{tmp_path}/csv")
    assert spark.read.text(f"{tmp_path}/csv").count() == 103
    assert files.convert(spark, f"{tmp_path}/csv", f"{tmp_path}/parquet")["source_rows"] == 100
