"""False-positive gaps between groups at one global threshold, and the release gate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from sonorisk.functions.math import wilson


def fpr_by(df: DataFrame, attributes: Sequence[str], threshold: Column) -> DataFrame:
    """Bona fide false-positive rate with a Wilson interval per attribute value (score <= t flags)."""
    bona = df.filter((F.col("label") == "bona_fide") & F.col("score").isNotNull() & ~F.isnan("score"))
    keys = F.array(
        *[F.struct(F.lit(a).alias("attribute"), F.coalesce(F.col(a).cast("string"), F.lit("unknown")).alias("group")) for a in attributes]
    )
    g = (
        bona.select((F.col("score") <= threshold).cast("long").alias("_f"), F.explode(keys).alias("_k"))
        .groupBy("_k.attribute", "_k.group")
        .agg(F.count(F.lit(1)).alias("n_bona"), F.sum("_f").alias("flagged"))
    )
    lo, hi = wilson(F.col("flagged"), F.col("n_bona"))
    return g.withColumns({"fpr": F.col("flagged") / F.col("n_bona"), "ci_low": lo, "ci_high": hi})


def gap_and_ratio(groups: DataFrame) -> DataFrame:
    """Largest minus smallest group rate; the ratio is infinite when only the smallest is 0."""
    g = groups.filter(F.col("n_bona") > 0).groupBy("attribute").agg(
        F.count(F.lit(1)).alias("n_groups"), F.max("fpr").alias("_hi"), F.min("fpr").alias("_lo"), F.min("n_bona").alias("min_group_n")
    )
    inf = F.lit(float("inf"))
    return g.select(
        "attribute",
        "n_groups",
        "min_group_n",
        F.when(F.col("n_groups") > 1, F.col("_hi") - F.col("_lo")).otherwise(0.0).alias("gap"),
        F.when((F.col("n_groups") < 2) | (F.col("_lo") == 0), F.when(F.col("_hi") > 0, inf).otherwise(1.0))
        .otherwise(F.col("_hi") / F.nullif(F.col("_lo"), F.lit(0.0)))
        .alias("ratio"),
    )


def gate(gaps: DataFrame, max_gap: float | None, min_group_n: int = 30) -> DataFrame:
    """One row: not_configured, fail, insufficient_data or pass, in that order."""
    g = gaps.agg(F.max("gap").alias("_gap"), F.min("min_group_n").alias("_n"))
    if max_gap is None:
        return g.select(F.lit("not_configured").alias("status"), F.col("_gap").alias("worst_gap"))
    status = F.when(F.col("_gap") > max_gap, "fail").when(F.col("_n") < min_group_n, "insufficient_data").otherwise("pass")
    return g.select(status.alias("status"), F.col("_gap").alias("worst_gap"))


def per_language_rates(df: DataFrame, language: Column, p: str, is_spoof: Column, threshold: float = 0.5) -> DataFrame:
    """Counts, FPR (p >= t on bona fide) and miss rate per language."""
    flag = (F.col(p) >= threshold).cast("double")
    return df.groupBy(F.coalesce(language, F.lit("unknown")).alias("language")).agg(
        F.sum((~is_spoof).cast("long")).alias("n_bona_fide"),
        F.sum(is_spoof.cast("long")).alias("n_spoof"),
        F.avg(F.when(~is_spoof, flag)).alias("fpr"),
        F.avg(F.when(is_spoof, 1 - flag)).alias("miss_rate"),
    )


def language_gap(rates: DataFrame, max_gap: float = 0.05, min_n: int = 20) -> DataFrame:
    r = rates.filter((F.col("n_bona_fide") >= min_n) & F.col("fpr").isNotNull())
    g = r.agg(F.count(F.lit(1)).alias("n_languages"), (F.max("fpr") - F.min("fpr")).alias("_g"))
    gap = F.when(F.col("n_languages") >= 2, F.col("_g")).otherwise(0.0)
    return g.select("n_languages", gap.alias("max_fpr_gap"), (gap <= max_gap).alias("fairness_ok"))
