"""Detection curves and the metrics read off them.

Trials are first reduced to counts per (slice, distinct score), then one running sum per slice gives
every operating point.  No raw trial is ever sorted, each metric is a plain aggregate over the
same curve, and equal scores form a single point, so results do not depend on row order.

Convention: higher ``score`` = bona fide; at threshold t a trial is accepted as bona fide when
score > t.  ``frr`` = bona fide at or under t, ``far`` = spoof above t.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W

from sonorisk.functions.math import histogram_bin
from sonorisk.scale import materialize, prefix_sums, range_parts, small_or_plain


def class_counts(df: DataFrame, slices: Sequence[str], score: str, classes: dict[str, Column]) -> DataFrame:
    """Counts of each class per (slice, distinct score); NULL and NaN scores are left out."""
    s = df.filter(F.col(score).isNotNull() & ~F.isnan(F.col(score)))
    return s.groupBy(*slices, F.col(score).alias("score")).agg(
        *[F.sum(F.when(c, 1).otherwise(0)).cast("long").alias(f"n_{k}") for k, c in classes.items()]
    )


def cumulative(counts: DataFrame, slices: Sequence[str], classes: Sequence[str], limit: int | None = None) -> DataFrame:
    """Running class counts ``c_*`` up to and including each score, with class totals ``t_*``."""
    slices = list(slices)
    cum = prefix_sums(counts, slices, ["score"], {f"c_{k}": f"n_{k}" for k in classes}, limit)
    totals = counts.groupBy(*slices).agg(
        *[F.sum(f"n_{k}").alias(f"t_{k}") for k in classes], F.min("score").alias("min_score"), F.max("score").alias("max_score")
    )
    if not slices:
        return cum.join(F.broadcast(totals))  # one row of totals
    return cum.join(small_or_plain(totals), slices)


BINARY = ("bona", "spoof")


def detection_curve(
    df: DataFrame, slices: Sequence[str], score: str = "score", label: str = "label", limit: int | None = None
) -> DataFrame:
    """Operating points per slice: running counts, totals, ``frr`` and ``far`` (NULL for one-class slices)."""
    counts = class_counts(df, slices, score, {"bona": F.col(label) == "bona_fide", "spoof": F.col(label) == "spoof"})
    c = cumulative(counts, slices, BINARY, limit)
    return with_rates(c)


def with_rates(c: DataFrame) -> DataFrame:
    b = F.nullif(F.col("t_bona"), F.lit(0)).cast("double")
    s = F.nullif(F.col("t_spoof"), F.lit(0)).cast("double")
    return c.withColumns(
        {
            "frr": F.col("c_bona") / b,
            "far": 1 - F.col("c_spoof") / s,
            "frr0": (F.col("c_bona") - F.col("n_bona")) / b,
            "far0": 1 - (F.col("c_spoof") - F.col("n_spoof")) / s,
        }
    )


def _point(gap: Column, thr: Column, value: Column) -> Column:
    return F.struct(F.round(gap, 12).alias("gap"), thr.alias("thr"), value.alias("value"))


def curve_metrics(
    curve: DataFrame,
    slices: Sequence[str],
    dcf: tuple[float, float, float] = (1.0, 10.0, 0.05),
    max_fpr: float = 0.01,
) -> DataFrame:
    """EER and its threshold, min DCF, AUC and partial AUC for every slice, in one aggregate.

    The point before the first score (frr 0, far 1) is a candidate too.  Slices with one class
    give NULL metrics.
    """
    c_miss, c_fa, pi = dcf
    frr, far = F.col("frr"), F.col("far")
    both = frr.isNotNull() & far.isNotNull()
    cost = c_miss * (1 - pi) * frr + c_fa * pi * far
    wins = F.col("n_bona") * ((F.col("c_spoof") - F.col("n_spoof")) + F.col("n_spoof") / 2.0)
    g = curve.groupBy(*slices).agg(
        F.max("t_bona").alias("n_bona"),
        F.max("t_spoof").alias("n_spoof"),
        F.min(F.when(both, _point(F.abs(frr - far), F.col("score"), (frr + far) / 2))).alias("_best"),
        F.min(F.when(both, F.col("min_score"))).alias("_first"),
        F.min(F.when(both, cost)).alias("_dcf"),
        F.sum(wins).alias("_wins"),
        F.sum(F.when(both, _area(max_fpr))).alias("_area"),
    )
    return _read_off(g, slices, dcf, max_fpr)


def _read_off(g: DataFrame, slices: Sequence[str], dcf: tuple[float, float, float], max_fpr: float) -> DataFrame:
    """The metrics from a slice's best point, first score, least cost, wins and area."""
    c_miss, c_fa, pi = dcf
    norm = min(c_miss * (1 - pi), c_fa * pi)
    start = F.when(F.col("_first").isNotNull(), _point(F.lit(1.0), F.col("_first") - 1e-9, F.lit(0.5)))
    best = F.least(F.col("_best"), start)
    return g.select(
        *slices,
        "n_bona",
        "n_spoof",
        best["value"].alias("eer"),
        best["thr"].alias("eer_threshold"),
        (F.least(F.col("_dcf"), F.when(F.col("_dcf").isNotNull(), F.lit(c_fa * pi))) / norm).alias("min_dcf"),
        F.when(F.col("_first").isNotNull(), F.col("_wins") / F.nullif(F.col("n_bona") * F.col("n_spoof"), F.lit(0))).alias("auc"),
        F.when(F.col("_first").isNotNull(), _standardised(F.col("_area"), max_fpr)).alias("pauc"),
    )


MAX_SETS = 1 << 17  # sets of slices that are sent to every executor


def sliced_metrics(df: DataFrame, sets: str, score: str = "score", label: str = "label", dcf: tuple[float, float, float] = (1.0, 10.0, 0.05), max_fpr: float = 0.01) -> DataFrame:
    """``curve_metrics`` of every slice that a trial's array ``sets`` names, by the slice's ``slice_id``; one-class slices are left out.

    No trial is copied per slice on its way: counts per (score, set of slices) are dealt by ranges of scores, and each task
    streams its range in order, adding the counts to all slices at once.  The totals of earlier ranges are where a slice starts.
    """
    ids = F.transform(sets, slice_id)
    s = df.filter(F.col(score).isNotNull() & ~F.isnan(F.col(score)))
    known = materialize(s.select(sets).distinct().select(F.xxhash64(sets).alias("_set"), _packed(ids).alias("_ids")))
    few = known.count() <= MAX_SETS
    tag = F.xxhash64(sets).alias("_set") if few else _packed(ids).alias("_ids")
    n = lambda c: F.sum((F.col(label) == c).cast("long"))
    counts = s.groupBy(F.col(score).cast("double").alias("score"), tag).agg(n("bona_fide").alias("n_bona"), n("spoof").alias("n_spoof"))
    named_none = F.col("_set") == F.xxhash64(F.array()) if few else F.length("_ids") == 0
    ranged = range_parts(counts, ["score"]).filter(~named_none)  # here, for the optimizer would build every trial's array twice for it
    named = lambda d: d.join(F.broadcast(known), "_set") if few else d
    each = F.explode(F.sequence(F.lit(0), (F.length("_ids") / 8).cast("int") - 1)).alias("_at")
    # one row per part and set first where sets are few, so that few rows are repeated per slice
    sums = ranged.groupBy("_part", "_set").agg(F.sum("n_bona").alias("n_bona"), F.sum("n_spoof").alias("n_spoof")) if few else ranged
    parts = named(sums).select("*", each).select("_part", F.conv(F.hex(F.substring("_ids", F.col("_at") * 8 + 1, F.lit(8))), 16, -10).cast("long").alias("_id"), "n_bona", "n_spoof").groupBy("_part", "_id").agg(F.sum("n_bona").alias("b"), F.sum("n_spoof").alias("s"))
    whole, before = W.partitionBy("_id"), W.partitionBy("_id").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = materialize(parts.select(
        "_part", F.col("_id").alias("id"), *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"c_{c}") for c in "bs"], *[F.sum(c).over(whole).alias(f"t_{c}") for c in "bs"],
    ))
    five = F.array_sort(F.collect_list(F.struct("id", "c_b", "c_s", "t_b", "t_s")))
    lists = starts.groupBy("_part").agg(_packed(F.flatten(F.transform(five, lambda x: F.array(*[x[c] for c in ("id", "c_b", "c_s", "t_b", "t_s")])))).alias("_starts")).withColumn("_head", F.lit(True))
    head = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0  # the first row of a part brings the starts
    rows = named(ranged.sortWithinPartitions("score").withColumn("_head", head).join(F.broadcast(lists), ["_part", "_head"], "left")).select("score", "n_bona", "n_spoof", "_ids", "_starts")
    found = rows.mapInArrow(_stream_slices(dcf, max_fpr), "_id long, gap double, thr double, value double, first double, dcf double, wins double, area double")
    totals = starts.groupBy(F.col("id").alias("_id")).agg(F.max("t_b").alias("n_bona"), F.max("t_s").alias("n_spoof"))
    g = found.groupBy("_id").agg(
        F.min(F.struct("gap", "thr", "value")).alias("_best"), F.min("first").alias("_first"), F.min("dcf").alias("_dcf"), F.sum("wins").alias("_wins"), F.sum("area").alias("_area")
    )
    return _read_off(g.join(totals, "_id"), ["_id"], dcf, max_fpr)


def _packed(longs: Column) -> Column:
    """An array of longs as bytes: Spark looks at the size of every nested column of a batch after each row that it sends."""
    return F.unhex(F.array_join(F.transform(longs, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def slice_id(key: Column) -> Column:
    return F.xxhash64(key)


def _stream_slices(dcf: tuple[float, float, float], max_fpr: float):
    c_miss, c_fa, pi = dcf

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices, held = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            c = dict(zip(batch.schema.names, batch.columns, strict=True))
            if slices is None:  # the first row of the part
                at = np.frombuffer(c["_starts"][0].as_py(), ">i8").astype(np.int64).reshape(-1, 5).T
                slices = _Slices(*at, c_miss * (1 - pi), c_fa * pi, max_fpr)
            now = [c[k].to_numpy(zero_copy_only=False) for k in ("score", "n_bona", "n_spoof")]
            ids = c["_ids"].to_pylist()
            now += [np.fromiter(map(len, ids), np.int64, len(ids)) // 8, np.frombuffer(b"".join(ids), ">i8").astype(np.int64)]
            held = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
            k = int(np.searchsorted(held[0], held[0][-1]))  # rows of the last score wait for the rest of it
            if k:
                cut = int(held[3][:k].sum())
                slices.add(*[x[:k] for x in held[:4]], held[4][:cut])
                held = [*[x[k:] for x in held[:4]], held[4][cut:]]
        if slices is not None:
            slices.add(*held)
            yield from slices.rows()

    return run


class _Slices:
    """Running counts and best points of all slices while scores go by in order."""

    def __init__(self, ids, c_b, c_s, t_b, t_s, w_miss: float, w_fa: float, limit: float):
        self.ids, self.c_b, self.c_s, self.t_b, self.t_s = ids, c_b.copy(), c_s.copy(), t_b, t_s
        self.w_miss, self.w_fa, self.limit = w_miss, w_fa, limit
        n = len(ids)
        self.gap, self.thr, self.value, self.first, self.dcf = (np.full(n, np.inf) for _ in range(5))
        self.wins, self.area, self.seen = np.zeros(n), np.zeros(n), np.zeros(n, bool)

    def add(self, score, n_bona, n_spoof, sizes, flat) -> None:
        s, row = np.searchsorted(self.ids, flat), np.repeat(np.arange(len(score)), sizes)
        both = ((self.t_b > 0) & (self.t_s > 0))[s]
        s, row = s[both], row[both]
        if not len(s):
            return
        order = np.argsort(s, kind="stable")
        s, row = s[order], row[order]
        x = score[row]
        at = np.flatnonzero(np.r_[True, (s[1:] != s[:-1]) | (x[1:] != x[:-1])])
        b, q, s, x = np.add.reduceat(n_bona[row], at), np.add.reduceat(n_spoof[row], at), s[at], x[at]
        at = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        here, sizes = s[at], np.diff(np.r_[at, len(s)])

        def running(n, start):
            c = np.cumsum(n)
            return c + np.repeat(start[here] - (c[at] - n[at]), sizes)

        c_b, c_s, t_b, t_s = running(b, self.c_b), running(q, self.c_s), self.t_b[s].astype(float), self.t_s[s].astype(float)
        frr, far, frr0, far0 = c_b / t_b, 1 - c_s / t_s, (c_b - b) / t_b, 1 - (c_s - q) / t_s
        gap = np.floor(np.abs(frr - far) * 1e12 + 0.5) / 1e12
        best = np.minimum.reduceat(gap, at)
        hit = np.flatnonzero(gap == np.repeat(best, sizes))
        hit = hit[np.r_[True, s[hit][1:] != s[hit][:-1]]]  # the least score of a slice's smallest gap
        closer = best < self.gap[here]
        k, h = here[closer], hit[closer]
        self.gap[k], self.thr[k], self.value[k] = best[closer], x[h], (frr[h] + far[h]) / 2
        self.first[here] = np.minimum(self.first[here], x[at])
        self.dcf[here] = np.minimum(self.dcf[here], np.minimum.reduceat(self.w_miss * frr + self.w_fa * far, at))
        self.wins[here] += np.add.reduceat(b * ((c_s - q) + q / 2.0), at)
        m, y0, y1, dx = self.limit, 1 - far0, 1 - far, frr - frr0
        cut = y0 + (y1 - y0) * (m - frr0) / np.where(dx == 0, 1, dx)
        self.area[here] += np.add.reduceat(np.where(frr <= m, dx * (y0 + y1) / 2, np.where(frr0 < m, (m - frr0) * (y0 + cut) / 2, 0.0)), at)
        ends = at + sizes - 1
        self.c_b[here], self.c_s[here], self.seen[here] = c_b[ends], c_s[ends], True

    def rows(self) -> Iterator[pa.RecordBatch]:
        if self.seen.any():
            cols = (self.ids, self.gap, self.thr, self.value, self.first, self.dcf, self.wins, self.area)
            yield pa.RecordBatch.from_arrays([pa.array(c[self.seen]) for c in cols], names=["_id", "gap", "thr", "value", "first", "dcf", "wins", "area"])


def _area(max_fpr: float) -> Column:
    """Trapezoid of one step of the curve up to ``max_fpr``, interpolated where the step crosses it."""
    x0, x1 = F.col("frr0"), F.col("frr")
    y0, y1 = 1 - F.col("far0"), 1 - F.col("far")
    m = F.lit(max_fpr)
    cut = y0 + (y1 - y0) * (m - x0) / F.nullif(x1 - x0, F.lit(0.0))
    return F.when(x1 <= m, (x1 - x0) * (y0 + y1) / 2).when(x0 < m, (m - x0) * (y0 + cut) / 2).otherwise(F.lit(0.0))


def _standardised(area: Column, max_fpr: float) -> Column:
    least = max_fpr**2 / 2
    return 0.5 * (1 + (area - least) / (max_fpr - least))


def partial_areas(curve: DataFrame, slices: Sequence[str], limits: dict[str, float]) -> DataFrame:
    """Standardised partial AUC of every slice for several limits, in one aggregate."""
    both = F.col("frr").isNotNull() & F.col("far").isNotNull()
    g = curve.groupBy(*slices).agg(*[F.sum(F.when(both, _area(m))).alias(name) for name, m in limits.items()])
    return g.select(*slices, *[_standardised(F.col(name), m).alias(name) for name, m in limits.items()])


def min_max_error(curve: DataFrame, slices: Sequence[str]) -> DataFrame:
    """EER as min over thresholds of max(fpr, fnr), flagging p >= t; for p_spoof (higher = spoof).

    ``curve`` has running counts of p; fpr = bona at or above t, fnr = spoof under t.
    """
    fpr = 1 - F.col("frr0")
    fnr = 1 - F.col("far0")
    return curve.groupBy(*slices).agg(F.least(F.lit(1.0), F.min(F.greatest(fpr, fnr))).alias("eer_minmax"))


def left_sided_eer(curve: DataFrame, slices: Sequence[str]) -> DataFrame:
    """Speaker EER: frr = targets under t, far = non-targets at or above t; first smallest gap."""
    frr, far = F.col("frr0"), F.col("far0")
    return curve.groupBy(*slices).agg(
        F.min(F.when(frr.isNotNull() & far.isNotNull(), _point(F.abs(frr - far), F.col("score"), (frr + far) / 2))).alias("_b")
    ).select(*slices, F.col("_b")["value"].alias("eer_left"))


def rates_at(df: DataFrame, slices: Sequence[str], threshold: Column, score: str = "score", label: str = "label") -> DataFrame:
    """False-alarm rate on bona fide and miss rate on spoof when flagging score <= threshold."""
    s = df.filter(F.col(score).isNotNull() & ~F.isnan(F.col(score)))
    return s.groupBy(*slices).agg(
        F.avg(F.when(F.col(label) == "bona_fide", (F.col(score) <= threshold).cast("double"))).alias("fpr"),
        F.avg(F.when(F.col(label) == "spoof", (F.col(score) > threshold).cast("double"))).alias("miss_rate"),
    )


def threshold_low_side(curve: DataFrame, slices: Sequence[str], target_fpr: float) -> DataFrame:
    """Largest threshold whose bona fide false-alarm rate (score <= t) stays within the target.

    With ties at the cut the reference can exceed its target; the largest distinct score that
    keeps the promise is taken instead.
    """
    ok = (F.col("n_bona") > 0) & (F.col("c_bona") <= F.floor(F.lit(target_fpr) * F.col("t_bona")))
    return curve.groupBy(*slices).agg(
        F.coalesce(F.max(F.when(ok, F.col("score"))), F.min(F.when(F.col("n_bona") > 0, F.col("score"))) - 1e-9).alias("threshold")
    )


def threshold_high_side(curve: DataFrame, slices: Sequence[str], target_fpr: float, name: str = "threshold") -> DataFrame:
    """Smallest threshold for p >= t flags with bona fide FPR within target: the rank-k score + 1e-9."""
    k = F.least(F.ceil((1 - F.lit(target_fpr)) * F.col("t_bona")), F.col("t_bona") - 1)
    return curve.groupBy(*slices).agg(
        (F.min(F.when(F.col("c_bona") > k, F.col("score"))) + 1e-9).alias(name)
    )


def cost_optimal(curve: DataFrame, slices: Sequence[str], c_fp: float, c_fn: float, prior: float) -> DataFrame:
    """Threshold with the least expected cost over all scores and 0 and 1 (flag p >= t)."""
    fpr, fnr = 1 - F.col("frr0"), 1 - F.col("far0")
    cost = c_fp * fpr * (1 - prior) + c_fn * fnr * prior
    pt = lambda c, t: F.struct(F.round(c, 12).alias("cost"), t.alias("thr"))
    g = curve.groupBy(*slices).agg(
        F.min(pt(cost, F.col("score"))).alias("_b"),
        F.min("min_score").alias("_min"),
        F.max("max_score").alias("_max"),
        # rates at 1.0 exactly: scores under 1 are not flagged
        F.max(F.when(F.col("score") < 1, F.col("c_bona") / F.col("t_bona"))).alias("_below_b"),
        F.max(F.when(F.col("score") < 1, F.col("c_spoof") / F.col("t_spoof"))).alias("_below_s"),
    )
    at0 = pt(F.lit(c_fp * (1 - prior)), F.lit(0.0))  # scores are probabilities, so all are >= 0
    one_fpr, one_fnr = 1 - F.coalesce("_below_b", F.lit(0.0)), F.coalesce("_below_s", F.lit(0.0))
    at1 = pt(c_fp * one_fpr * (1 - prior) + c_fn * one_fnr * prior, F.lit(1.0))
    best = F.least("_b", at0, at1)
    return g.select(*slices, best["thr"].alias("threshold"), best["cost"].alias("cost"))


def min_tdcf(
    curve: DataFrame, slices: Sequence[str], p_miss: float, p_fa: float, p_miss_spoof: float,
    pi_tar: float = 0.9405, pi_non: float = 0.0095, pi_spoof: float = 0.05,
    c_miss_asv: float = 1.0, c_fa_asv: float = 10.0, c_miss_cm: float = 1.0, c_fa_cm: float = 10.0,
) -> DataFrame:
    """Normalised minimum tandem cost for given speaker-verification error rates."""
    c1 = pi_tar * (c_miss_cm - c_miss_asv * p_miss) - pi_non * c_fa_asv * p_fa
    c2 = c_fa_cm * pi_spoof * (1 - p_miss_spoof)
    if c1 <= 0 or c2 <= 0:
        raise ValueError("tandem cost is undefined for these verification error rates (C1 or C2 <= 0)")
    cost = c1 * F.col("frr") + c2 * F.col("far")
    return curve.groupBy(*slices).agg((F.least(F.lit(c2), F.min(cost)) / min(c1, c2)).alias("min_tdcf"))


def min_adcf(
    df: DataFrame, slices: Sequence[str], cls: str, score: str = "score", c_miss: float = 1.0, c_fa_non: float = 10.0,
    c_fa_spoof: float = 10.0, pi_tar: float = 0.9, pi_non: float = 0.05, pi_spoof: float = 0.05,
) -> DataFrame:
    """Normalised minimum architecture-agnostic cost over target, nontarget and spoof trials."""
    names = ("target", "nontarget", "spoof")
    c = cumulative(class_counts(df, slices, score, {n: F.col(cls) == n for n in names}), slices, names)
    share = {n: F.col(f"c_{n}") / F.nullif(F.col(f"t_{n}"), F.lit(0)) for n in names}
    cost = (
        c_miss * pi_tar * share["target"]
        + c_fa_non * pi_non * (1 - share["nontarget"])
        + c_fa_spoof * pi_spoof * (1 - share["spoof"])
    )
    at_start = c_fa_non * pi_non + c_fa_spoof * pi_spoof  # threshold -inf accepts everything
    norm = min(c_miss * pi_tar, at_start)
    return c.groupBy(*slices).agg((F.least(F.lit(at_start), F.min(cost)) / norm).alias("min_adcf"))


def calibration_error(df: DataFrame, slices: Sequence[str], p: str, truth: Column, bins: int = 15) -> DataFrame:
    """Expected calibration error over equal-width bins; the last bin is closed."""
    b = (
        df.filter(F.col(p).isNotNull() & ~F.isnan(F.col(p)))
        .withColumn("_bin", histogram_bin(F.col(p), bins))
        .groupBy(*slices, "_bin")
        .agg(F.count(F.lit(1)).alias("_n"), F.sum(p).alias("_p"), F.sum(truth.cast("double")).alias("_y"))
    )
    return b.groupBy(*slices).agg(
        (F.sum(F.abs(F.col("_p") - F.col("_y"))) / F.sum("_n")).alias("ece")
    )


def mid_ranks(df: DataFrame, slices: Sequence[str], value: str) -> DataFrame:
    """Average rank per distinct value (ties share the mean rank)."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*slices, value).agg(F.count(F.lit(1)).alias("n_ties"))
    cum = prefix_sums(counts, slices, [value], {"_c": "n_ties"})
    return cum.withColumn("mid_rank", F.col("_c") - F.col("n_ties") + (F.col("n_ties") + 1) / 2.0).drop("_c")


def ks_statistic(df: DataFrame, slices: Sequence[str], value: str, is_ref: Column) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance: largest gap between the two running shares."""
    c = cumulative(class_counts(df, slices, value, {"ref": is_ref, "cur": ~is_ref}), slices, ("ref", "cur"))
    gap = F.abs(F.col("c_ref") / F.nullif(F.col("t_ref"), F.lit(0)) - F.col("c_cur") / F.nullif(F.col("t_cur"), F.lit(0)))
    return c.groupBy(*slices).agg(F.coalesce(F.max(gap), F.lit(0.0)).alias("ks"))
