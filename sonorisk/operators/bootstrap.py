"""Bootstrap intervals on count tables.

Resampling n trials with replacement is a multinomial draw over counts, so the replicates are drawn on the counts of
the distinct scores instead of trials.  A multinomial splits: first over ranges of ``PART`` neighbouring scores, then
within each range, so a slice of any size is spread over tasks and no score is merged with another.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.window import Window as W

from sonorisk.scale import fits_one_task, null_safe_join, ordered_index, range_parts

PART = 1 << 16  # distinct scores of a slice that one group holds
BLOCK = 50  # replicates drawn together
CELLS = 1 << 20  # cells of a matrix of replicates and scores
ONE_TASK = 32 << 20  # counts up to this estimate are ranked in one task a slice


@dataclass(frozen=True)
class ByRange:
    """A metric that is read off at one score, from ranges of neighbouring scores; no task needs a whole slice.

    ``at(frr, far)`` gets [replicate, score] shares, of the bona fide at or under a score and of the spoof above it, and
    returns a rank and a value per replicate.  The value of the least rank counts, of equal ones that at the lowest scores.
    ``inside(frr0, far0, frr, far)`` may tell from the shares before and at the end of a range which replicates can have
    their least rank within it; for the others the end stands for the range.
    """

    at: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
    inside: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray] | None = None


def _least_gap(frr: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    gap = np.round(np.abs(frr - far), 12)
    i, r = np.argmin(gap, axis=1), np.arange(len(gap))
    return gap[r, i], (frr[r, i] + far[r, i]) / 2


# the rates cross once, for one only rises and the other only falls
EER = ByRange(_least_gap, lambda frr0, far0, frr, far: (frr0 < far0) & (frr >= far))


def score_counts(df: DataFrame, slices: Sequence[str], score: str, label: str) -> DataFrame:
    """Class counts per slice and distinct score; one task-sized row per distinct score."""
    s = df.filter(F.col(score).isNotNull() & ~F.isnan(score) & F.col(label).isin("bona_fide", "spoof"))
    return s.groupBy(*slices, F.col(score).alias("score")).agg(
        F.sum((F.col(label) == "bona_fide").cast("long")).alias("n_bona"), F.sum((F.col(label) == "spoof").cast("long")).alias("n_spoof")
    )


def _eer(b: np.ndarray, s: np.ndarray) -> np.ndarray:
    frr = np.cumsum(b, axis=1) / b.sum(axis=1, keepdims=True)
    far = 1 - np.cumsum(s, axis=1) / s.sum(axis=1, keepdims=True)
    i = np.argmin(np.abs(frr - far), axis=1)
    r = np.arange(len(b))
    return (frr[r, i] + far[r, i]) / 2


def _resample(rng: np.random.Generator, counts: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Split ``draws[r]`` of each replicate over the counts, as [replicate, count]."""
    out, on = np.zeros((len(draws), len(counts)), dtype=np.int64), np.flatnonzero(counts)
    if len(on):
        out[:, on] = rng.multinomial(draws, counts[on] / counts[on].sum())
    return out


def _blocks(n: int) -> Column:
    """Blocks of replicates from 0; block -1 stands for the counts themselves."""
    return F.explode(F.sequence(F.lit(-1), F.lit((n - 1) // BLOCK)))


def _part_draws(parts: DataFrame, slices: list[str], n: int, seed: int) -> DataFrame:
    """Per (slice, part, block of replicates): what falls into the part, what falls below it, and the slice's totals."""
    x = parts.withColumn("_block", _blocks(n))
    names = ["_part", "_block", "_b", "_s", "_below_b", "_below_s", "_n_b", "_n_s"]
    kinds = [T.LongType(), T.LongType()] + [T.ArrayType(T.LongType())] * 4 + [T.LongType()] * 2
    schema = T.StructType([f for f in parts.schema.fields if f.name in slices] + [T.StructField(c, k) for c, k in zip(names, kinds, strict=True)])

    def split(pdf: pd.DataFrame) -> pd.DataFrame:  # a row per part
        pdf = pdf.sort_values("_part")
        block = int(pdf["_block"].iloc[0])
        rng, size = np.random.default_rng([seed, block + 1]), min(BLOCK, n - block * BLOCK)
        out = {c: pdf[c].to_numpy() for c in [*slices, "_part", "_block"]}
        for c in "bs":
            counts = pdf[f"_{c}"].to_numpy(np.int64)
            d = _resample(rng, counts, np.full(size, counts.sum())) if block >= 0 else counts[None]
            out |= {f"_{c}": list(d.T), f"_below_{c}": list((np.cumsum(d, axis=1) - d).T), f"_n_{c}": counts.sum()}
        return pd.DataFrame(out)[[f.name for f in schema]]

    return x.groupBy(*slices, "_block").applyInPandas(split, schema)


def _picks(rng: np.random.Generator, counts: np.ndarray, draws: np.ndarray) -> Iterator[np.ndarray]:
    """Per replicate the places of ``draws[r]`` trials drawn with replacement, for counts that are mostly small."""
    where = np.repeat(np.arange(len(counts)), counts)
    for d in draws:
        yield where[rng.integers(0, len(where), d)] if d else where[:0]


def _split(rng: np.random.Generator, counts: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """``_resample``, trial by trial where there are few to a score."""
    if counts.sum() > 4 * len(counts):
        return _resample(rng, counts, draws)
    out = np.empty((len(draws), len(counts)), dtype=np.int64)
    for r, at in enumerate(_picks(rng, counts, draws)):
        out[r] = np.bincount(at, minlength=len(counts))
    return out


def _weighed(rng: np.random.Generator, counts: np.ndarray, draws: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Sum of ``x`` over the trials of each replicate."""
    if counts.sum() > 4 * len(counts):
        step = max(1, CELLS // len(counts))
        return np.concatenate([_resample(rng, counts, draws[i : i + step]) @ x for i in range(0, len(draws), step)])
    return np.array([x[at].sum() for at in _picks(rng, counts, draws)])


def _parted(counts: DataFrame, slices: list[str]) -> DataFrame:
    """Counts with ``_part``, which rises with the score in a slice and has at most PART distinct scores."""
    c = counts.select(*slices, "score", F.col("n_bona").cast("long").alias("n_bona"), F.col("n_spoof").cast("long").alias("n_spoof"))
    part = lambda n: F.floor((F.col(n) - 1) / PART).cast("long")
    if fits_one_task(counts, ONE_TASK):
        return ordered_index(c, slices, ["score"], limit=1 << 62).withColumn("_part", part("rn")).drop("rn")
    ranged = range_parts(c, [*slices, "score"])
    rn = F.row_number().over(W.partitionBy(*slices, "_part").orderBy("score"))
    return ranged.withColumn("rn", rn).withColumn("_part", F.shiftleft(F.col("_part").cast("long"), 32) + part("rn")).drop("rn")


def _replicates(ranked: DataFrame, slices: list[str], metric: str | ByRange, n: int, seed: int) -> DataFrame:
    """(slices, _rep, _stat): the metric of each replicate of each slice with both classes; the counts' own have _rep < 0."""
    draws = _part_draws(ranked.groupBy(*slices, "_part").agg(F.sum("n_bona").alias("_b"), F.sum("n_spoof").alias("_s")), slices, n, seed)
    draws = draws.filter("_n_b > 0 and _n_s > 0")
    by = [f for f in ranked.schema.fields if f.name in slices]
    schema = T.StructType(by + [T.StructField("_rep", T.LongType()), T.StructField("_part", T.LongType()), T.StructField("_rank", T.DoubleType()), T.StructField("_v", T.DoubleType())])

    def read_off(rng, b: np.ndarray, s: np.ndarray, t: dict, draw) -> tuple[np.ndarray, np.ndarray]:
        n_b, n_s, below_b, below_s, all_b, all_s = t["_n_b"], t["_n_s"], *(np.asarray(t[k], dtype=np.int64) for k in ("_below_b", "_below_s", "_b", "_s"))
        end = (below_b + all_b) / n_b, 1 - (below_s + all_s) / n_s
        rank, v = metric.at(end[0][:, None], end[1][:, None])
        inside = np.flatnonzero(metric.inside(below_b / n_b, 1 - below_s / n_s, *end)) if metric.inside else np.arange(len(all_b))
        step = max(1, CELLS // len(b))
        for i in range(0, len(inside), step):
            at = inside[i : i + step]
            cb, cs = (b[None], s[None]) if t["_block"] < 0 else (draw(rng, b, all_b[at]), draw(rng, s, all_s[at]))
            rank[at], v[at] = metric.at((np.cumsum(cb, axis=1) + below_b[at, None]) / n_b, 1 - (np.cumsum(cs, axis=1) + below_s[at, None]) / n_s)
        return rank, v

    def within(pdf: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:  # at most PART scores
        outs = []
        if len(pdf) and len(blocks):
            pdf = pdf.sort_values("score")
            x, part = pdf["score"].to_numpy(float), int(pdf["_part"].iloc[0])
            b, s = (pdf[f"n_{k}"].to_numpy(np.int64) for k in ("bona", "spoof"))
            head = {c: pdf[c].iloc[0] for c in slices}
            for t in blocks.itertuples(index=False):
                t = dict(zip(blocks.columns, t, strict=True))
                whole = t["_n_b"] == b.sum() and t["_n_s"] == s.sum()
                rng = np.random.default_rng([seed, int(t["_block"]) + 1] + ([] if whole else [part + 1]))
                if metric != "gap":
                    rank, v = read_off(rng, b, s, t, _resample if whole else _split)
                else:
                    of = lambda c, k: np.array([c @ x]) if t["_block"] < 0 else _weighed(rng, c, np.asarray(t[k], dtype=np.int64), x)  # noqa: B023, E731
                    v = of(b, "_b") / t["_n_b"] - of(s, "_s") / t["_n_s"]
                    rank = np.zeros(len(v))
                outs.append(pd.DataFrame({**head, "_rep": t["_block"] * BLOCK + np.arange(len(v)), "_part": part, "_rank": rank, "_v": v}, index=range(len(v))))
        names = [f.name for f in schema]
        return pd.concat(outs, ignore_index=True)[names] if outs else pd.DataFrame(columns=names)

    keys = [*slices, "_part"]
    stats = ranked.groupBy(*keys).cogroup(draws.groupBy(*keys)).applyInPandas(within, schema)
    stat = F.sum("_v") if metric == "gap" else F.min(F.struct("_rank", "_part", "_v"))["_v"]
    return stats.groupBy(*slices, "_rep").agg(stat.alias("_stat"))


def _replicates_of(counts: DataFrame, slices: list[str], metric, n: int, seed: int) -> DataFrame:
    """The same for a callable: it sees all distinct scores of a slice, so a task holds one slice's counts."""
    fields = [f for f in counts.schema.fields if f.name in slices]
    schema = T.StructType(fields + [T.StructField("_rep", T.LongType()), T.StructField("_stat", T.DoubleType())])
    x = counts.withColumn("_block", _blocks(n))

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("score")
        block = int(pdf["_block"].iloc[0])
        b, s = pdf["n_bona"].to_numpy(np.int64), pdf["n_spoof"].to_numpy(np.int64)
        size = 1 if block < 0 else min(BLOCK, n - block * BLOCK)
        if b.sum() == 0 or s.sum() == 0:
            stats = [None] * size
        elif block < 0:
            stats = list(metric(b[None].astype(float), s[None].astype(float)))
        else:
            rng, stats, step = np.random.default_rng([seed, block + 1]), [], max(1, (1 << 20) // len(pdf))
            for at in range(0, size, step):
                k = min(step, size - at)
                stats += list(metric(_resample(rng, b, np.full(k, b.sum())).astype(float), _resample(rng, s, np.full(k, s.sum())).astype(float)))
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] * size for c in slices}, "_rep": block * BLOCK + np.arange(size), "_stat": pd.array(stats, "Float64")})

    return x.groupBy(*slices, "_block").applyInPandas(draw, schema)


def bootstrap_interval(
    df: DataFrame,
    slices: Sequence[str],
    metric: str | ByRange | Callable = "eer",
    score: str = "score",
    label: str = "label",
    n: int = 200,
    alpha: float = 0.05,
    seed: int = 0,
) -> DataFrame:
    """Percentile interval of the EER (``eer``) or of mean(bona) - mean(spoof) (``gap``) per slice.

    ``metric`` may also be a ``ByRange``, or a callable on two [replicate, cell] count matrices; a cell is a distinct score,
    and a task holds all cells of a slice for it.
    """
    return interval(score_counts(df, slices, score, label), slices, metric, n, alpha, seed)


def interval(exact: DataFrame, slices: Sequence[str], metric: str | ByRange | Callable = "eer", n: int = 200, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """``bootstrap_interval`` from class counts (slices, score, n_bona, n_spoof)."""
    slices, metric = list(slices), EER if metric == "eer" else metric
    if metric == "gap" or isinstance(metric, ByRange):
        stats = _replicates(_parted(exact, slices), slices, metric, n, seed)
    else:
        stats = _replicates_of(exact, slices, metric, n, seed)
    drawn = F.when(F.col("_rep") >= 0, F.col("_stat"))
    bounds = stats.groupBy(*slices).agg(
        F.max(F.when(F.col("_rep") < 0, F.col("_stat"))).alias("_point"), F.percentile(drawn, F.lit(alpha / 2)).alias("ci_low"), F.percentile(drawn, F.lit(1 - alpha / 2)).alias("ci_high")
    )
    out = null_safe_join(exact.select(*slices).distinct(), bounds, slices) if slices else bounds
    if metric != "gap":
        return out.select(*slices, F.col("_point").alias("point"), "ci_low", "ci_high")
    mean = lambda n: F.sum(F.col("score") * F.col(n)) / F.nullif(F.sum(n), F.lit(0))
    point = exact.groupBy(*slices).agg((mean("n_bona") - mean("n_spoof")).alias("_exact"))
    return null_safe_join(out, point, slices).select(*slices, F.coalesce("_exact", "_point").alias("point"), "ci_low", "ci_high")
