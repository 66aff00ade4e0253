"""Evaluation protocols: slices of a score table summarised from one shared curve pass.

Each trial carries the array of its (protocol, slice) keys, trials are reduced to counts per distinct score and array,
and every metric of every slice is read off one pass over the counts in score order.  Rows are repeated per key only in
front of a map-side combined aggregate of few groups.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from sonorisk.functions.math import histogram_bin, snr_bin
from sonorisk.operators.curves import slice_id, sliced_metrics
from sonorisk.scale import small_or_plain, spread

MIN_TRIALS = 30  # fixed value
KEYS = ["protocol", "slice"]
SLICES = "_slices"  # array of a trial's keys


def slice_key(protocol: str, value: Column) -> Column:
    return F.struct(F.lit(protocol).alias("protocol"), value.alias("slice"))


def group_slice(col: str, protocol: str) -> Column:
    """Slice by a column; NULL becomes ``unknown``."""
    return slice_key(protocol, F.coalesce(F.col(col).cast("string"), F.lit("unknown")))


def overall_slice() -> Column:
    return slice_key("overall", F.lit("all"))


def snr_slice(col: str = "snr_db") -> Column:
    return slice_key("snr", snr_bin(F.col(col)))


def with_slices(df: DataFrame, keys: Sequence[Column], more: Sequence[Column] = ()) -> DataFrame:
    """The trials with the array of their slice keys; NULL keys are left out.  ``more``: arrays of keys to add."""
    arr = F.filter(F.array(*keys), lambda k: k.isNotNull()) if keys else None
    arrays = [*([arr] if keys else []), *more]
    return spread(df).withColumn(SLICES, F.concat(*arrays) if len(arrays) > 1 else arrays[0])


def shared_bona_slices(col: str, protocol: str, families: Sequence[str], seen: Sequence[str] | None = None) -> Column:
    """Slice keys for an attribute only spoofs carry: every family against the whole bona fide pool.

    The family list is registry-sized (the generators known to a run), and a trial carries its keys as one array, so the bona
    fide rows are not repeated per family.
    """
    fam = F.col(col)
    spoof = F.col("label") == "spoof"
    bona_keys = [slice_key(protocol, F.lit(f)) for f in families]
    spoof_keys = [F.when(fam.isNotNull(), slice_key(protocol, fam))]
    if seen is not None:
        known = fam.isin(list(seen)) if seen else F.lit(False)
        pool = F.when(F.coalesce(known, F.lit(False)), "ALL_SEEN").otherwise("ALL_UNSEEN")
        spoof_keys.append(slice_key(protocol, pool))
        bona_keys += [slice_key(protocol, F.lit(p)) for p in ("ALL_SEEN", "ALL_UNSEEN")]
    none = F.array().cast("array<struct<protocol:string,slice:string>>")
    return F.when(spoof, F.filter(F.array(*spoof_keys), lambda k: k.isNotNull())).otherwise(F.array(*bona_keys) if bona_keys else none)


def family_list(df: DataFrame, col: str, limit: int = 10_000) -> list[str]:
    """Distinct families, for planning the shared-pool slices; refuses an unbounded attribute."""
    rows = df.filter(F.col(col).isNotNull()).select(col).distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{col} has more than {limit} values; it is not a generator-like attribute")
    return sorted(r[0] for r in rows)


def summarize(trials: DataFrame, keys: Sequence[str] = KEYS, p_col: str | None = "p_spoof", bins: int = 15) -> DataFrame:
    """Counts, coverage and all curve metrics per slice; one-class slices keep NULL metrics.

    Coverage is scored trials over all trials, next to every error rate.  Trials bring their keys as the array of
    ``with_slices`` or as columns.
    """
    keys = list(keys)
    if SLICES not in trials.columns:
        trials = trials.withColumn(SLICES, F.array(F.struct(*keys)))
    scored = F.col("score").isNotNull() & ~F.isnan("score")
    p = F.col(p_col) if p_col is not None else F.lit(None).cast("double")
    p = F.when(~F.isnan(p), p)
    # counts per calibration bin first: one pass over the trials gives counts, coverage and ECE
    each = trials.withColumn("_k", F.explode(SLICES))
    b = each.groupBy(*[F.col("_k")[k].alias(k) for k in keys], histogram_bin(p, bins).alias("_bin")).agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum(scored.cast("long")).alias("_scored"),
        F.sum((scored & (F.col("label") == "bona_fide")).cast("long")).alias("_b"),
        F.sum((scored & (F.col("label") == "spoof")).cast("long")).alias("_s"),
        F.sum(p).alias("_p"),
        F.sum(F.when(p.isNotNull(), (F.col("label") == "spoof").cast("double"))).alias("_y"),
    )
    has_p = F.col("_bin").isNotNull()
    base = b.groupBy(*keys).agg(
        F.sum("_n").alias("n"),
        F.sum("_b").alias("n_bona"),
        F.sum("_s").alias("n_spoof"),
        (F.sum("_scored") / F.sum("_n")).alias("coverage"),
        (F.sum(F.when(has_p, F.abs(F.col("_p") - F.col("_y")))) / F.sum(F.when(has_p, F.col("_n")))).alias("ece"),
    )
    m = sliced_metrics(trials, SLICES).drop("n_bona", "n_spoof")
    out = base.withColumn("_id", slice_id(F.struct(*keys))).join(m, "_id", "left").drop("_id").withColumn("ece", F.when(F.col("eer").isNotNull(), F.col("ece")))
    return out.withColumns(
        {
            "low_n": F.least("n_bona", "n_spoof") < MIN_TRIALS,
            "note": F.when(F.col("eer").isNull(), "needs both classes"),
        }
    )


def cross_dataset(rows: DataFrame, train_datasets: Sequence[str]) -> DataFrame:
    """Add the in-domain flag and each slice's EER minus the mean in-domain EER."""
    flag = F.col("slice").isin(list(train_datasets))
    ref = rows.filter(flag).agg(F.avg("eer").alias("_ref"))
    return (
        rows.join(F.broadcast(ref))  # one row
        .withColumns({"in_domain": flag, "eer_minus_in_domain": F.bround(F.col("eer") - F.col("_ref"), 4)})
        .drop("_ref")
    )


WHITE_BOX = ("pgd_linf", "universal_filter")  # fixed values


def against_clean(rows: DataFrame) -> DataFrame:
    """EER minus the clean reference per condition; white-box rows use the cropped clean one."""
    ref_name = F.when(F.col("slice").startswith("clean"), None).otherwise(
        F.when(F.col("slice").isin(*WHITE_BOX), "clean_3s_crop").otherwise("clean")
    )
    base = rows.filter(F.col("slice").startswith("clean")).select("protocol", F.col("slice").alias("_ref"), F.col("eer").alias("_ref_eer"))
    return (
        rows.withColumn("_ref", ref_name)
        .join(small_or_plain(base), ["protocol", "_ref"], "left")
        .withColumn("eer_minus_clean", F.bround(F.col("eer") - F.col("_ref_eer"), 4))
        .drop("_ref", "_ref_eer")
    )


# ---- per-call window arrays -------------------------------------------------------------------


def scored_windows(ws: Column) -> Column:
    return F.filter(ws, lambda p: p.isNotNull() & ~F.isnan(p))


def time_to_first_alert(ws: Column, threshold: Column, hop_s: float = 1.0, first_s: float = 3.0) -> Column:
    """Seconds until the first window at or above the threshold; NULL = never."""
    hits = F.transform(ws, lambda p: F.coalesce((p >= threshold) & ~F.isnan(p), F.lit(False)))
    pos = F.array_position(hits, F.lit(True))
    return F.when(pos > 0, first_s + (pos - 1) * hop_s)


def score_stability(ws: Column, threshold: Column) -> tuple[Column, Column]:
    """(population std, decision flips per minute) over scored windows; NULL under two of them."""
    p = scored_windows(ws)
    n = F.size(p)
    # one pass: running count, mean and squared deviation
    start = F.struct(F.lit(0.0).alias("k"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

    def add(a: Column, x: Column) -> Column:
        k = a["k"] + 1
        mean = a["mean"] + (x - a["mean"]) / k
        return F.struct(k.alias("k"), mean.alias("mean"), (a["m2"] + (x - a["mean"]) * (x - mean)).alias("m2"))

    acc = F.aggregate(p, start, add)
    var = acc["m2"] / F.nullif(acc["k"], F.lit(0.0))
    flags = F.transform(p, lambda x: x >= threshold)
    pairs = F.zip_with(F.slice(flags, 1, F.greatest(n - 1, F.lit(0))), F.slice(flags, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: a != b)
    flips = F.size(F.filter(pairs, lambda x: x))
    return F.when(n >= 2, F.sqrt(var)), F.when(n >= 2, flips / (n / 60.0))


def operational(calls: DataFrame, threshold: Column) -> DataFrame:
    """Alerted share, time to first alert (median, p90) and stability per label."""
    from sonorisk.scale import exact_quantiles

    std, flips = score_stability(F.col("window_scores"), threshold)
    c = calls.withColumns({"ttfa": time_to_first_alert(F.col("window_scores"), threshold), "_std": std, "_flips": flips})
    base = c.groupBy("label").agg(
        F.count(F.lit(1)).alias("n_calls"),
        F.bround(F.avg(F.col("ttfa").isNotNull().cast("double")), 4).alias("alerted_fraction"),
        F.avg("_std").alias("mean_window_std"),
        F.avg("_flips").alias("mean_flips_per_min"),
    )
    q = exact_quantiles(c, ["label"], "ttfa", {"median_s": 0.5, "p90_s": 0.9}).drop("n")
    return base.join(q, "label", "left")


def held_out_folds(df: DataFrame, family: str) -> DataFrame:
    """(held_out, train_family) for every family against all others, which is what is asked for: the pairs are the result."""
    fams = df.filter(F.col(family).isNotNull()).select(F.col(family).alias("held_out")).distinct()
    others = fams.withColumnRenamed("held_out", "train_family")
    return fams.join(others, F.col("held_out") != F.col("train_family"))


def stack_conditions(parts: dict[str, DataFrame]) -> DataFrame:
    """One table of scored conditions, each tagged with its name."""
    out = None
    for name, df in parts.items():
        tagged = df.withColumn("condition", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged)
    return out
