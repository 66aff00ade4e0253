"""Session smoothing: two-state filter, short-segment trigger, and the risk state machine.

One fold serves batch and stream.  In batch every session is cut into chunks of a fixed number of windows, whatever
the size of the input, and the chunks of a long session run in parallel (``chunked``).
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from sonorisk.scale import prefix_sums

STATES = ("ABSTAIN", "LOW", "ELEVATED", "HIGH")


@dataclass(frozen=True)
class SmoothingConfig:
    session_prior: float = 0.02
    window_prior: float = 0.5
    switch_prob: float = 0.02
    llr_clip: float = 6.0
    evidence_scale: float = 0.6
    segment_windows: int = 3
    segment_prior: float = 0.1


@dataclass(frozen=True)
class RiskThresholds:
    elevated: float = 0.40
    high: float = 0.70
    exit_margin: float = 0.05
    min_dwell_windows: int = 3
    min_scored_windows: int = 2
    max_abstain_ratio: float = 0.7


def _logit(p: float) -> float:
    p = min(max(p, 1e-6), 1 - 1e-6)
    return math.log(p / (1 - p))


def _sigmoid(z: float) -> float:
    return 1.0 / (1.0 + math.exp(-min(max(z, -35.0), 35.0)))


class RiskAutomaton:
    """The risk state machine as a table from (position, zone) to position.

    Only the zone of p between the cut points matters, so a zone's lower end decides for all of it; a last zone stands for
    windows at which the session cannot be judged.  A position is a state and, above LOW, the windows spent below its exit.
    Rows of the table compose, so any run of windows is again a map of positions.
    """

    def __init__(self, thr: RiskThresholds) -> None:
        enter = (thr.elevated, thr.high)
        leave = tuple(x - thr.exit_margin for x in enter)
        self.cuts = sorted({*enter, *leave})
        waits = range(max(1, thr.min_dwell_windows))
        self.positions = [(0, 0), (1, 0), *[(level, k) for level in (2, 3) for k in waits]]
        at = {pos: i for i, pos in enumerate(self.positions)}
        self.table = []
        for level, waited in self.positions:
            row = []
            for p in (-math.inf, *self.cuts):
                target = 1 + sum(p >= x for x in enter)
                if target >= level:
                    row.append(at[target, 0])
                elif p >= leave[level - 2]:
                    row.append(at[level, 0])
                elif waited + 1 < len(waits):
                    row.append(at[level, waited + 1])
                else:
                    row.append(at[1 + sum(p >= x for x in leave), 0])
            self.table.append([*row, at[0, 0]])
        self.unusable = len(self.cuts) + 1

    def zone(self, p: float, usable: bool) -> int:
        return bisect_right(self.cuts, p) if usable else self.unusable


@dataclass
class SessionFold:
    """What a session carries from window to window: odds, counts, the last scored windows, the peak, the position."""

    cfg: SmoothingConfig = field(default_factory=SmoothingConfig)
    thr: RiskThresholds = field(default_factory=RiskThresholds)
    odds: float | None = None
    n: int = 0
    scored: int = 0
    p_sum: float = 0.0
    tail: list = field(default_factory=list)  # (evidence, p) of the last scored windows, one fewer than a segment has
    peak: float = 0.0
    peak_window: int | None = None
    mean_peak: float = 0.0
    position: int = 0

    def run(self, window_ids: Iterable[int], ps: Iterable[float | None]) -> list[tuple]:
        """Take windows in order (None: every head abstained); one timeline row each, without the session id."""
        c, t = self.cfg, self.thr
        auto = automaton(t)
        table, names = auto.table, [STATES[level] for level, _ in auto.positions]
        stay, switch, size = 1 - c.switch_prob, c.switch_prob, c.segment_windows
        base, seg_base = _logit(c.window_prior), _logit(c.segment_prior)
        odds = math.exp(_logit(c.session_prior)) if self.odds is None else self.odds
        out = []
        for w, p in zip(window_ids, ps, strict=True):
            odds = min(max((stay * odds + switch) / (switch * odds + stay), LEAST_ODDS), 1 / LEAST_ODDS)
            self.n += 1
            if p is not None:
                llr = min(max(_logit(p) - base, -c.llr_clip), c.llr_clip)
                odds = min(max(odds * math.exp(c.evidence_scale * llr), FLOOR), 1 / FLOOR)
                self.scored += 1
                self.p_sum += p
                last = [*self.tail, (llr, p)]
                self.mean_peak = max(self.mean_peak, sum(x for _, x in last) / len(last))
                if len(last) == size:
                    seg = _sigmoid(seg_base + c.evidence_scale * sum(x for x, _ in last))
                    if seg > self.peak:
                        self.peak, self.peak_window = seg, w
                    last = last[1:]
                self.tail = last
            p_hmm = odds / (1 + odds)
            p_session, abstained = max(p_hmm, self.peak), (self.n - self.scored) / self.n
            usable = self.scored >= t.min_scored_windows and abstained <= t.max_abstain_ratio
            self.position = table[self.position][auto.zone(p_session, usable)]
            mean = self.p_sum / self.scored if self.scored else 0.0
            out.append((w, p, p_hmm, self.peak, self.peak_window, p_session, mean, max(self.mean_peak, mean), self.scored, abstained, names[self.position]))
        self.odds = odds
        return out

    def dump(self) -> list:
        """Plain values for a state store."""
        return [self.odds, self.n, self.scored, self.p_sum, [list(x) for x in self.tail], self.peak, self.peak_window, self.mean_peak, self.position]

    @classmethod
    def restore(cls, v: list, cfg: SmoothingConfig | None = None, thr: RiskThresholds | None = None) -> SessionFold:
        f = cls(cfg or SmoothingConfig(), thr or RiskThresholds())
        f.odds, f.n, f.scored, f.p_sum, tail, f.peak, f.peak_window, f.mean_peak, f.position = v
        f.tail = [tuple(x) for x in tail]
        return f


LEAST_ODDS = 1e-6 / (1 - 1e-6)
FLOOR = math.exp(-30.0)


@lru_cache(maxsize=64)
def automaton(thr: RiskThresholds) -> RiskAutomaton:
    return RiskAutomaton(thr)


TIMELINE = (
    "window_id long, p_window double, p_hmm double, p_segment_max double, segment_window long, p_session double, "
    "p_mean double, p_mean_max double, n_scored long, abstain_ratio double, state string"
)
COLUMNS = ["session_id", *[f.strip().split(" ")[0] for f in TIMELINE.split(",")]]


def timeline_fields(session_type: str = "long") -> str:
    """Schema of timeline rows; session ids keep their type."""
    return f"session_id {session_type}, {TIMELINE}"


TIMELINE_FIELDS = timeline_fields()


def timeline_frame(session_id, rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=COLUMNS[1:])
    out.insert(0, "session_id", session_id)
    out["segment_window"] = out["segment_window"].astype("Int64")
    return out


def session_timeline(fused: DataFrame, cfg: SmoothingConfig | None = None, thr: RiskThresholds | None = None, chunk: int | None = None) -> DataFrame:
    """Every window's smoothed risk and state; a session longer than ``chunk`` windows runs as parallel chunks."""
    from sonorisk.operators.chunked import CHUNK, chunked_timeline

    return chunked_timeline(fused, cfg or SmoothingConfig(), thr or RiskThresholds(), chunk or CHUNK)


def segment_evidence(fused: DataFrame, cfg: SmoothingConfig | None = None, limit: int | None = None) -> DataFrame:
    """Posterior of each run of consecutive *scored* windows, natively.

    The sum over the last k scored windows is a difference of running sums, so a hot session is spread
    over tasks: number the scored windows, then each row joins the row k places before it.
    """
    from sonorisk.functions.math import clip, logit, sigmoid

    c = cfg or SmoothingConfig()
    s = fused.filter(F.col("p_fused").isNotNull()).select(
        "session_id", "window_id", "p_fused", clip(logit("p_fused") - _logit(c.window_prior), -c.llr_clip, c.llr_clip).alias("llr"), F.lit(1).cast("long").alias("_one")
    )
    run = prefix_sums(s, ["session_id"], ["window_id"], {"_n": "_one"}, limit)
    k = c.segment_windows
    # each scored window belongs to the k segments that end at it or at the next k - 1 scored ones
    parts = run.select("session_id", "llr", "p_fused", F.col("window_id"), F.col("_n"), F.explode(F.sequence(F.col("_n"), F.col("_n") + (k - 1))).alias("seg_end"))
    seg = parts.groupBy("session_id", "seg_end").agg(
        F.sum("llr").alias("_s"), F.count(F.lit(1)).alias("_c"), F.max(F.when(F.col("_n") == F.col("seg_end"), F.col("window_id"))).alias("window_id"), F.avg("p_fused").alias("mean_p")
    )
    post = F.when(F.col("_c") == k, sigmoid(F.lit(_logit(c.segment_prior)) + c.evidence_scale * F.col("_s")))
    return seg.filter(F.col("window_id").isNotNull()).select("session_id", "window_id", "mean_p", post.alias("p_segment"))


def segment_peak(segments: DataFrame) -> DataFrame:
    """Largest segment posterior per session and the (first) window that ends it."""
    best = F.max(F.when(F.col("p_segment").isNotNull(), F.struct("p_segment", (-F.col("window_id")).alias("_w"))))
    return segments.groupBy("session_id").agg(best.alias("_b"), F.max("mean_p").alias("segment_mean_max")).select(
        "session_id", F.coalesce(F.col("_b.p_segment"), F.lit(0.0)).alias("segment_max"), (-F.col("_b._w")).alias("segment_window"), "segment_mean_max"
    )


def state_changes_per_minute(timeline: DataFrame, hop_s: float = 1.0) -> DataFrame:
    """Changes between neighbouring windows per minute; window ids are consecutive, so the previous row
    is an equi join on window_id - 1 and a hot session stays spread over tasks."""
    prev = timeline.select("session_id", (F.col("window_id") + 1).alias("window_id"), F.col("state").alias("_prev"))
    j = timeline.join(prev, ["session_id", "window_id"], "left")
    g = j.groupBy("session_id").agg(F.count(F.lit(1)).alias("_n"), F.sum(F.when(F.col("_prev") != F.col("state"), 1).otherwise(0)).alias("changes"))
    return g.select("session_id", "changes", F.when(F.col("_n") < 2, 0.0).otherwise(F.col("changes") / (F.col("_n") * hop_s / 60)).alias("changes_per_min"))


def final_rows(timeline: DataFrame) -> DataFrame:
    """Last timeline row of each session."""
    cols = [c for c in timeline.columns if c != "session_id"]
    g = timeline.groupBy("session_id").agg(F.max_by(F.struct(*cols), "window_id").alias("_l"))
    return g.select("session_id", "_l.*")


# fixed values: readable names of the heads
FACTORS = {
    "A": "synthetic_speech_ssl",
    "B": "dsp_artifacts_and_scene",
    "C": "prosody",
    "D": "speaker_mismatch",
    "E": "liveness_challenge",
    "F": "watermark",
}


def risk_drivers(fused: DataFrame, finals: DataFrame, top: int = 3, elevated: float = 0.40) -> DataFrame:
    """Top heads by accumulated absolute contribution, plus the short-segment driver when it leads."""
    heads = list(FACTORS)
    sums = fused.groupBy("session_id").agg(
        *[F.sum(F.abs(f"signed_{h}")).alias(f"_a_{h}") for h in heads], *[F.sum(f"signed_{h}").alias(f"_s_{h}") for h in heads]
    )
    items = F.filter(
        F.array(*[F.struct(F.col(f"_a_{h}").alias("v"), F.lit(h).alias("head"), F.col(f"_s_{h}").alias("net")) for h in heads]), lambda x: x["v"].isNotNull()
    )
    total = sum((F.coalesce(F.col(f"_a_{h}"), F.lit(0.0)) for h in heads), F.lit(0.0))
    names = F.create_map(*[x for k, v in FACTORS.items() for x in (F.lit(k), F.lit(v))])
    ranked = sums.select("session_id", total.alias("_t"), F.slice(F.sort_array(items, asc=False), 1, top).alias("_i")).filter("_t > 0")
    heads_out = ranked.select("session_id", "_t", F.posexplode("_i").alias("rank", "i")).select(
        "session_id", (F.col("rank") + 1).cast("long").alias("rank"), names[F.col("i.head")].alias("factor"),
        F.bround(F.col("i.v") / F.col("_t"), 3).alias("weight"),
        F.when(F.col("i.net") > 0, "towards synthetic").otherwise("towards genuine").alias("direction"),
    )
    seg = finals.filter((F.col("p_segment_max") > F.col("p_hmm")) & (F.col("p_segment_max") >= elevated) & F.col("segment_window").isNotNull()).select(
        "session_id", F.lit(top + 1).cast("long").alias("rank"), F.lit("any_segment_trigger").alias("factor"), F.bround("p_segment_max", 3).alias("weight"),
        F.concat(F.lit("window "), F.col("segment_window").cast("string")).alias("direction"),
    )
    return heads_out.unionByName(seg)


def previous_window(df: DataFrame, col: str, name: str) -> DataFrame:
    """Value of ``col`` one window earlier, by equi join on consecutive window ids."""
    prev = df.select("session_id", (F.col("window_id") + 1).alias("window_id"), F.col(col).alias(name))
    return df.join(prev, ["session_id", "window_id"], "left")


def decision_events(timeline: DataFrame, labels: Column | None = None) -> DataFrame:
    """Windows at which a decision is due: entering ELEVATED or HIGH, a changed label set, or the close."""
    lab = labels if labels is not None else F.lit("")
    t = previous_window(timeline.withColumn("_lab", lab).withColumn("_cur", F.struct("state", "_lab")), "_cur", "_prev")
    last = timeline.groupBy("session_id").agg(F.max("window_id").alias("_last"))
    t = t.join(last, "session_id")
    changed = F.col("_prev").isNull() | (F.col("_prev.state") != F.col("state"))
    label_changed = F.col("_lab") != F.coalesce(F.col("_prev._lab"), F.lit(""))
    reason = (
        F.when(changed & F.col("state").isin("ELEVATED", "HIGH"), "state")
        .when(label_changed, "labels")
        .when(F.col("window_id") == F.col("_last"), "close")
    )
    return t.withColumn("reason", reason).filter(F.col("reason").isNotNull()).drop("_lab", "_cur", "_prev", "_last")


def version_changes(df: DataFrame) -> DataFrame:
    """Rows whose head reports another model version than one window before."""
    prev = df.select("session_id", "head_id", (F.col("window_id") + 1).alias("window_id"), F.col("model_version").alias("previous_version"))
    return df.join(prev, ["session_id", "head_id", "window_id"]).filter(F.col("previous_version") != F.col("model_version"))
