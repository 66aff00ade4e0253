"""Analyst feedback exports: evaluation rows and confirmed cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sonorisk.operators.monitoring import latest_per_key


def export_eval_rows(feedback: DataFrame, evidence: DataFrame) -> DataFrame:
    """Latest decided feedback per bundle with its evidence (NULL fields when the body is gone)."""
    fb = latest_per_key(feedback, "bundle_id", "arrival").filter(F.col("label") != "unsure")
    return fb.select("bundle_id", (F.col("label") == "true_positive").alias("is_fraud")).join(evidence, "bundle_id", "left")


def export_confirmed(rows: DataFrame, path: str) -> None:
    """Confirmed fraud cases as JSON lines."""
    rows.filter("is_fraud").write.mode("overwrite").json(path)
