"""The functions behind the serving surface: prediction, retrieval, answers, readiness, history."""

from __future__ import annotations

import hashlib
import json
import uuid
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import grounding, iforest, retrieval
from millrace.operators.contracts import ContractError, check_chain
from millrace.plans.tables import cut
from millrace.sources.files import canonical
from millrace.sources.store import Counters, Store


class Prediction:
    """One frozen forest behind an identity check that runs once."""

    def __init__(self, forest: iforest.Forest, candidate_id: str, threshold: float, identity: dict[str, Any] | None = None):
        self.forest, self.candidate_id, self.threshold = forest, candidate_id, threshold
        self.features_sha256 = hashlib.sha256(canonical(list(forest.features)).encode()).hexdigest()
        if identity:
            check_chain(identity, {"candidate_id": candidate_id, "threshold": threshold, "feature_names_sha256": self.features_sha256})

    def schema(self) -> dict[str, Any]:
        return {"features": list(self.forest.features), "feature_count": len(self.forest.features), "feature_names_sha256": self.features_sha256, "dtype": "float32"}

    def predict(self, row: dict[str, float]) -> dict[str, Any]:
        return {"status": "scored", "candidate_id": self.candidate_id, "feature_names_sha256": self.features_sha256} | iforest.predict_one(row, self.forest, self.threshold)


#: Tables of a saved index.
INDEX = ("vocabulary", "index", "directions", "embedded")


def _identity(df: DataFrame) -> list[Any]:
    return list(retrieval.table_identity(df).first())


class Knowledge:
    """A TF-IDF and LSA index held as tables, for ad-hoc questions."""

    blocks: tuple[DataFrame, DataFrame] | None = None

    def __init__(self, spark: SparkSession, chunks: DataFrame, dims: int, max_features: int = 16_000, g: grounding.Grounding = grounding.Grounding()):
        self.spark, self.chunks, self.dims, self.g = spark, chunks, dims, g
        n = chunks.count()
        self.vocabulary = cut(retrieval.vocabulary_of(chunks, "chunk_id", "text", n, max_features))
        rows = cut(retrieval.document_rows(chunks, "chunk_id", "text", self.vocabulary))
        self.index = retrieval.entry_rows(rows, self.vocabulary)
        self.directions = cut(retrieval.lsa(rows, self.vocabulary, dims, n, 7))
        self.embedded = cut(retrieval.embed(rows, self.directions, dims))

    def save(self, path: str) -> dict[str, Any]:
        """Writes the index as tables below ``path``, beside what they hold: rows and content of each, and of the chunks they stand for."""
        identity = {"dims": self.dims, "chunks": _identity(self.chunks.select("chunk_id", "text"))}
        retrieval.identity_leaves(self.chunks.select("chunk_id", "text"), "chunk_id").coalesce(1).write.mode("errorifexists").parquet(f"{path}/leaves")
        for name in INDEX:
            getattr(self, name).write.mode("errorifexists").parquet(f"{path}/{name}")
            identity[name] = _identity(self.spark.read.parquet(f"{path}/{name}"))
        self.spark.createDataFrame([(canonical(identity),)], "identity string").coalesce(1).write.mode("errorifexists").text(f"{path}/identity")
        return identity

    @classmethod
    def load(cls, spark: SparkSession, path: str, chunks: DataFrame, g: grounding.Grounding = grounding.Grounding()) -> Knowledge:
        """A saved index; tables or chunks that aren't those it was saved with are an error, which names the ranges of chunk ids that changed."""
        k, changed = cls._saved(spark, path, chunks, g)
        if changed:
            raise ContractError("saved index", [f"chunks changed in {len(changed)} of {1 << retrieval.LEAF_BITS} ranges: {changed[:20]}"])
        return k

    @classmethod
    def refresh(cls, spark: SparkSession, path: str, chunks: DataFrame, g: grounding.Grounding = grounding.Grounding()) -> tuple[Knowledge, list[int]]:
        """(a saved index brought up to date, the ranges rebuilt): documents of changed ranges are weighed and embedded anew, with the saved vocabulary and directions; all others keep their rows."""
        k, changed = cls._saved(spark, path, chunks, g)
        if changed:
            other = ~retrieval.leaf(F.col("id")).isin(changed)
            fresh = chunks.where(retrieval.leaf(F.col("chunk_id")).isin(changed))
            index = cut(retrieval.tfidf(retrieval.term_counts(fresh, "chunk_id", "text"), k.vocabulary))
            k.index = cut(k.index.where(other).unionByName(index))
            k.embedded = cut(k.embedded.where(other).unionByName(retrieval.embed(index, k.directions, k.dims)))
        return k, changed

    @classmethod
    def _saved(cls, spark: SparkSession, path: str, chunks: DataFrame, g: grounding.Grounding) -> tuple[Knowledge, list[int]]:
        """Saved tables that are sound, and the ranges in which the chunks differ from those they were saved with."""
        identity = json.loads(spark.read.text(f"{path}/identity").first()[0])
        tables = {name: spark.read.parquet(f"{path}/{name}") for name in INDEX}
        check_chain({n: identity[n] for n in INDEX}, {n: _identity(t) for n, t in tables.items()})
        changed = retrieval.changed_leaves(spark.read.parquet(f"{path}/leaves"), retrieval.identity_leaves(chunks.select("chunk_id", "text"), "chunk_id"))
        k = cls.__new__(cls)
        k.spark, k.chunks, k.dims, k.g = spark, chunks, identity["dims"], g
        for name, t in tables.items():
            setattr(k, name, t.cache())
        return k, changed

    def retrieve(self, query: str, top_k: int = 8) -> DataFrame:
        """Chunks for one question, best first; none if no word is known."""
        if not query.strip():
            raise ValueError("the question is empty")
        q = retrieval.tfidf(retrieval.term_counts(self.spark.createDataFrame([("q", query)], "id string, text string"), "id", "text"), self.vocabulary)
        keyword = retrieval.keyword_scores(self.index, q)
        if self.blocks is None:  # made once, on the first question
            self.blocks = retrieval.vector_blocks(self.embedded)
        vector = retrieval.candidate_scores(keyword, self.embedded, retrieval.embed(q, self.directions, self.dims), blocks=self.blocks)
        hits = retrieval.hybrid(keyword, vector, top_k)
        return hits.withColumnRenamed("id", "chunk_id").join(self.chunks, "chunk_id").orderBy("rank")

    def answer(self, query: str, candidates: int = 12) -> dict[str, Any]:
        found = self.retrieve(query, candidates).withColumn("query_id", F.lit(1)).withColumn("query", F.lit(query))
        asked = self.spark.createDataFrame([(1, query)], "query_id int, query string")
        return grounding.answers(asked, grounding.rerank(found, self.g), self.g).first().asDict(recursive=True)


#: Questions that every release has to handle, and how.
SMOKE = (
    ("How can compressed air leaks be reduced?", "answered"),
    ("What does the dataset contain about sensor data?", "answered"),
    ("What does the service manual of this compressor specify?", "insufficient_evidence"),
)


def smoke(k: Knowledge, cases: tuple[tuple[str, str], ...] = SMOKE) -> list[dict[str, Any]]:
    return [{"query": q, "expected": want, "status": (got := k.answer(q))["status"], "passed": got["status"] == want} for q, want in cases]


def _sha256(path: str) -> str | None:
    try:
        with open(path, "rb") as f:
            return hashlib.file_digest(f, "sha256").hexdigest()
    except OSError:
        return None


class Services:
    """What an HTTP shell would call; requests are counted and kept without raw inputs."""

    def __init__(self, store: Store, prediction: Prediction | None = None, knowledge: Knowledge | None = None, frozen: dict[str, str] | None = None):
        """``frozen``: SHA-256 by path of the files that the parts were frozen with."""
        self.store, self.prediction, self.knowledge, self.counters, self.frozen = store, prediction, knowledge, Counters(), frozen or {}

    def live(self) -> dict[str, str]:
        return {"status": "live"}

    def ready(self) -> dict[str, Any]:
        """Ready when every part is there and every frozen file still has its SHA-256."""
        parts = {"prediction": self.prediction is not None, "knowledge": self.knowledge is not None}
        parts |= {f"file:{path}": _sha256(path) == digest.lower() for path, digest in sorted(self.frozen.items())}
        return {"status": "ready" if all(parts.values()) else "not_ready", "components": parts}

    def _kept(self, operation: str, request: dict, respond) -> dict[str, Any]:
        rid, now = uuid.uuid4().hex, datetime.now(UTC).replace(tzinfo=None)
        self.counters.add(f"{operation}.requests")
        try:
            answer = respond()
            status = "ok"
        except ValueError as e:
            self.counters.add(f"{operation}.errors")
            answer, status = {"error": str(e)}, "rejected"
        self.store.append("records", {"request_id": rid, "operation": operation, "status": status, "created_at": now, "request_json": request, "response_json": {k: answer[k] for k in ("status", "alarm", "reason_code", "error") if k in answer}})
        return {"request_id": rid, "status": status, "result": answer}

    def predict(self, row: dict[str, float]) -> dict[str, Any]:
        return self._kept("predict", {"feature_count": len(row)}, lambda: self.prediction.predict(row))

    def retrieve(self, query: str, top_k: int = 8) -> dict[str, Any]:
        """The best chunks of one question, counted and kept as a request like the others."""

        def respond() -> dict[str, Any]:
            rows = [r.asDict(recursive=True) for r in self.knowledge.retrieve(query, top_k).collect()]
            return {"status": "retrieved", "result_count": len(rows), "results": rows}

        return self._kept("retrieve", {"query_characters": len(query), "top_k": top_k}, respond)

    def answer(self, query: str) -> dict[str, Any]:
        return self._kept("answer", {"query_characters": len(query)}, lambda: self.knowledge.answer(query))

    def evaluate(self, request_id: str, operation: str, outcome: str, note: str = "") -> str:
        eid = uuid.uuid4().hex
        self.store.append("evaluations", {"evaluation_id": eid, "related_request_id": request_id, "operation": operation, "outcome": outcome, "created_at": datetime.now(UTC).replace(tzinfo=None), "note": note})
        return eid

    def history(self, n: int = 20, operation: str | None = None) -> DataFrame:
        return self.store.recent("records", n, operation)

    def metrics(self) -> dict[str, Any]:
        return {"counters": self.counters.read(), "stored": self.store.counts()}
