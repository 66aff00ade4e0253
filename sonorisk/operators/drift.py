"""Score drift between a reference and a current sample of detector outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sonorisk.functions.math import histogram_bin
from sonorisk.operators.curves import ks_statistic
from sonorisk.scale import null_safe_join, ordered_index, prefix_sums

PSI_BINS = 20  # fixed value


def last_n(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """First ``n`` rows per key in the given order; a large input is ranked over many tasks."""
    return ordered_index(df, keys, order, "_rn").filter(F.col("_rn") <= n).drop("_rn")


def psi(df: DataFrame, keys: list[str], p: str, is_ref: Column, bins: int = PSI_BINS, eps: float = 1e-4) -> DataFrame:
    """Population stability index over equal-width bins, with sample sizes."""
    binned = (
        df.filter(F.col(p).isNotNull() & ~F.isnan(p))
        .groupBy(*keys, histogram_bin(F.least(F.greatest(F.col(p), F.lit(0.0)), F.lit(1.0)), bins).alias("_bin"))
        .agg(F.sum(is_ref.cast("long")).alias("_r"), F.sum((~is_ref).cast("long")).alias("_c"))
    )
    tot = binned.groupBy(*keys).agg(
        F.sum("_r").alias("n_ref"), F.sum("_c").alias("n_current"), F.collect_list(F.struct("_r", "_c")).alias("_b"), F.count(F.lit(1)).alias("_nb")
    )
    nr = F.greatest(F.col("n_ref").cast("double"), F.lit(1e-12))
    nc = F.greatest(F.col("n_current").cast("double"), F.lit(1e-12))
    term = lambda b: ((b["_c"] / nc + eps) - (b["_r"] / nr + eps)) * F.log((b["_c"] / nc + eps) / (b["_r"] / nr + eps))
    # empty bins add (eps - eps) * log(1) = 0; a key has at most ``bins`` entries in _b
    value = F.aggregate(F.col("_b"), F.lit(0.0), lambda a, b: a + term(b))
    return tot.select(*keys, "n_ref", "n_current", value.alias("psi"))


def drift_level(psi_col: Column, n_ref: Column, n_current: Column, min_samples: int = 500, watch: float = 0.1, alert: float = 0.25) -> Column:
    return (
        F.when((n_ref == 0) | (n_current < min_samples), "insufficient_data")
        .when(psi_col > alert, "shifted")
        .when(psi_col > watch, "watch")
        .otherwise("stable")
    )


def drift_report(df: DataFrame, keys: list[str], p: str, is_ref: Column, **levels) -> DataFrame:
    """PSI, KS and level per key; statistics are NULL when there is too little data."""
    r = psi(df, keys, p, is_ref).join(ks_statistic(df, keys, p, is_ref), keys, "left")
    lvl = drift_level(F.col("psi"), F.col("n_ref"), F.col("n_current"), **levels)
    r = r.withColumn("level", lvl)
    for c in ("psi", "ks"):
        r = r.withColumn(c, F.when(F.col("level") != "insufficient_data", F.col(c)))
    return r


def drift_from_counts(counts: DataFrame, keys: list[str], score: str, eps: float = 1e-4, bins: int = PSI_BINS, **levels) -> DataFrame:
    """``drift_report`` from counts: keys, ``score``, ``n_ref``, ``n_current``; counts of one score may come in parts."""
    c = counts.groupBy(*keys, score).agg(F.sum("n_ref").alias("_r"), F.sum("n_current").alias("_c"))
    binned = c.groupBy(*keys, histogram_bin(F.col(score), bins).alias("_bin")).agg(F.sum("_r").alias("_r"), F.sum("_c").alias("_c"))
    tot = binned.groupBy(*keys).agg(F.sum("_r").alias("n_ref"), F.sum("_c").alias("n_current"), F.collect_list(F.struct("_r", "_c")).alias("_b"))  # at most ``bins`` entries
    share = lambda b, n, x: b[x] / F.greatest(n.cast("double"), F.lit(1e-12)) + eps
    term = lambda b: (share(b, F.col("n_current"), "_c") - share(b, F.col("n_ref"), "_r")) * F.log(share(b, F.col("n_current"), "_c") / share(b, F.col("n_ref"), "_r"))
    value = F.aggregate(F.col("_b"), F.lit(0.0), lambda a, b: a + term(b))
    run = null_safe_join(prefix_sums(c, keys, [score], {"_cr": "_r", "_cc": "_c"}), tot.select(*keys, "n_ref", "n_current"), keys)
    gap = F.abs(F.col("_cr") / F.nullif("n_ref", F.lit(0)) - F.col("_cc") / F.nullif("n_current", F.lit(0)))
    r = null_safe_join(tot.select(*keys, "n_ref", "n_current", value.alias("psi")), run.groupBy(*keys).agg(F.max(gap).alias("ks")), keys)
    r = r.withColumn("level", drift_level(F.col("psi"), F.col("n_ref"), F.col("n_current"), **levels))
    return r.withColumns({x: F.when(F.col("level") != "insufficient_data", F.col(x)) for x in ("psi", "ks")})


def bona_fide_proxy(scores: DataFrame, states: DataFrame) -> DataFrame:
    """Finite scores of sessions that stayed LOW throughout, the stand-in for genuine traffic."""
    other = states.filter(F.col("state") != "LOW").select("session_id").distinct()
    s = scores.filter(F.col("p_spoof").isNotNull() & ~F.isnan("p_spoof"))
    return s.join(other, "session_id", "left_anti")
