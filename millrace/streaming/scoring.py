"""Frozen scoring of a stream of rows: a stateless select, so no watermark and no state."""

from __future__ import annotations

from pyspark.sql import DataFrame

from millrace.operators.robust import Fit, score, with_alarm


def score_stream(rows: DataFrame, fit: Fit) -> DataFrame:
    """Adds score and alarm with parameters that were fitted and frozen on training rows; works on batches and streams alike."""
    if fit.threshold is None:
        raise ValueError("the threshold isn't frozen")
    return with_alarm(rows.withColumn("robust_distance_score", score(fit.retained)), "robust_distance_score", fit.threshold)
