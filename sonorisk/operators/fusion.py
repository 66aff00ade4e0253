"""Window fusion of head scores: calibrate, drop abstained heads, sum weighted log-odds.

Input is the long head-score table (session_id, window_id, head_id, raw or p_spoof, abstain).  An
abstained head leaves the sum; it is never imputed.  A watermark head (F) counts only when it is a
positive detection at or above the floor, so its absence changes nothing.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from sonorisk.functions.math import calibrate, logit, sigmoid

HEADS = ("A", "B", "C", "D", "E", "F")  # fixed values
WATERMARK_FLOOR = 0.95  # fixed value
NEUTRAL_HEAD = "F"


@dataclass(frozen=True)
class FusionWeights:
    weights: dict[str, float] = field(default_factory=lambda: dict.fromkeys(HEADS, 0.5))
    missing: dict[str, float] = field(default_factory=lambda: dict.fromkeys(HEADS, 0.0))
    bias: float = 0.0
    version: str = "prior"


def _map(values: dict[str, float]) -> Column:
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(float(v)))])


def usable_for_fusion(watermark: Column | None = None) -> Column:
    """Predicate for rows fusion may use."""
    present = F.col("p_spoof") >= WATERMARK_FLOOR
    if watermark is not None:
        present = present & F.coalesce(watermark == "present", F.lit(False))
    return (~F.col("abstain")) & F.col("p_spoof").isNotNull() & ((F.col("head_id") != NEUTRAL_HEAD) | present)


def apply_calibration(scores: DataFrame, calibrators: DataFrame) -> DataFrame:
    """Calibrated probability by (head_id, model_version); a miss passes the head's own value through."""
    from sonorisk.scale import small_or_plain

    c = calibrators.select(
        "head_id", "model_version", F.col("method").alias("_m"), F.col("a").alias("_a"), F.col("b").alias("_b"),
        F.col("temperature").alias("_t"), F.col("version").alias("_v"),
    )
    j = scores.join(small_or_plain(c), ["head_id", "model_version"], "left")
    recal = calibrate(F.col("raw_score"), F.col("_m"), F.col("_a"), F.col("_b"), F.col("_t"))
    return j.withColumns(
        {
            "p_calibrated": F.when(F.col("p_spoof").isNotNull(), F.coalesce(F.when(F.col("_m").isNotNull(), recal), F.col("p_spoof"))),
            "calibration_version": F.coalesce("_v", "calibration_version"),
        }
    ).drop("_m", "_a", "_b", "_t", "_v")


def fuse_windows(
    scores: DataFrame,
    model: FusionWeights | None = None,
    p_col: str = "p_spoof",
    watermark: Column | None = None,
    extra: dict[str, Column] | None = None,
    keys: tuple[str, ...] = ("session_id", "window_id"),
) -> DataFrame:
    """One row per (session, window): fused ``p_fused`` (NULL when every head abstained) and parts.

    A window has at most a handful of heads, so this is one hash aggregate with map-side combine.  On a stream ``keys``
    holds the event time too, and a window comes out once the watermark has passed it.
    """
    m = model or FusionWeights()
    use = usable_for_fusion(watermark)
    signed = F.when(use, F.coalesce(_map(m.weights)[F.col("head_id")], F.lit(0.0)) * logit(p_col))
    g = (
        scores.withColumn("_signed", signed)
        .groupBy(*keys)
        .agg(
            F.sum("_signed").alias("_z"),
            F.count("_signed").alias("n_present"),
            *[F.max(F.when(F.col("_signed").isNotNull() & (F.col("head_id") == h), 1).otherwise(0)).alias(f"_has_{h}") for h in HEADS if h != NEUTRAL_HEAD and m.missing.get(h, 0.0)],
            *[F.sum(F.when(F.col("head_id") == h, F.col("_signed"))).alias(f"signed_{h}") for h in HEADS],
            F.array_sort(F.collect_set(F.when(F.col("_signed").isNull(), F.col("head_id")))).alias("heads_abstained"),
            *[c.alias(n) for n, c in (extra or {}).items()],
        )
    )
    z = F.col("_z") + m.bias
    for h in HEADS:
        if h != NEUTRAL_HEAD and m.missing.get(h, 0.0):
            z = z + F.when(F.col(f"_has_{h}") == 0, F.lit(float(m.missing[h]))).otherwise(0.0)
    out = g.withColumns(
        {"z": F.when(F.col("n_present") > 0, z), "p_fused": F.when(F.col("n_present") > 0, sigmoid(z)), "fusion_version": F.lit(m.version)}
    )
    return out.drop("_z", *[c for c in g.columns if c.startswith("_has_")])


def contribution_shares(fused: DataFrame) -> DataFrame:
    """Absolute share per present head, summing to 1; equal shares when every term is 0."""
    parts = [F.abs(F.col(f"signed_{h}")) for h in HEADS]
    total = sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0))
    share = {
        f"share_{h}": F.when(
            F.col(f"signed_{h}").isNotNull(),
            F.when(F.col("_total") > 0, F.abs(F.col(f"signed_{h}")) / F.nullif(F.col("_total"), F.lit(0.0))).otherwise(
                1.0 / F.col("n_present")
            ),
        )
        for h in HEADS
    }
    entries = F.filter(
        F.array(*[F.struct(F.lit(h).alias("key"), F.col(f"share_{h}").alias("value")) for h in HEADS]),
        lambda e: e["value"].isNotNull(),
    )
    return fused.withColumn("_total", total).withColumns(share).withColumn("contributions", F.map_from_entries(entries)).drop("_total")


def session_stats(fused: DataFrame) -> DataFrame:
    """Per session: windows, scored windows, max and mean fused probability, abstain ratio."""
    g = fused.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("n_windows"),
        F.count("p_fused").alias("n_scored"),
        F.max("p_fused").alias("p_max"),
        F.coalesce(F.avg("p_fused"), F.lit(0.0)).alias("p_mean"),
    )
    return g.withColumn("abstain_ratio", (F.col("n_windows") - F.col("n_scored")) / F.col("n_windows"))


def band(p: Column, elevated: float = 0.40, high: float = 0.70) -> Column:
    """LOW / ELEVATED / HIGH by thresholds, ABSTAIN for NULL."""
    return F.when(p.isNull(), "ABSTAIN").when(p >= high, "HIGH").when(p >= elevated, "ELEVATED").otherwise("LOW")


