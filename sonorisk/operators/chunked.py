"""Session smoothing in chunks that run in parallel.

The recursion of a session is sequential, but each step composes:

* the two-state filter is a monotone fractional-linear map of the odds followed by a clamp, and such maps
  compose into one of the same form (2x2 matrix, low, high);
* segments and their means need only the scored windows before a chunk that one segment can reach;
* the state machine is a table over positions, so a chunk is a map of positions.

Only a session that has more than one chunk needs an entry: pass 1 summarises its chunks but the last, a scan over the
summaries gives each later chunk's numbers, pass 2 composes the position maps, a second scan gives the positions, and the
last pass emits the rows of all sessions.  A task holds one chunk's stream at a time, whatever share a session has.
"""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from sonorisk.operators.temporal import FLOOR, LEAST_ODDS, RiskThresholds, SessionFold, SmoothingConfig, _logit, automaton, timeline_fields, timeline_frame
from sonorisk.scale import fold_sorted, materialize

CHUNK = 50_000


class OddsMap:
    """clamp((a*o + b) / (c*o + d), lo, hi) on the odds."""

    def __init__(self, m: tuple = (1.0, 0.0, 0.0, 1.0), lo: float = 0.0, hi: float = 1e300) -> None:
        self.m, self.lo, self.hi = tuple(m), lo, hi

    def __call__(self, o: float) -> float:
        a, b, c, d = self.m
        return min(max((a * o + b) / (c * o + d), self.lo), self.hi)

    def then(self, g: OddsMap) -> OddsMap:
        """This map, then ``g``; all maps here are increasing, so a clamp moves through ``g``."""
        (A, B, C, D), (a, b, c, d) = g.m, self.m
        m = (A * a + B * c, A * b + B * d, C * a + D * c, C * b + D * d)
        k = max(map(abs, m))
        return OddsMap(tuple(x / k for x in m), g(self.lo), g(self.hi))


def windows_of(pdf: pd.DataFrame) -> tuple[list[int], list[float | None]]:
    return pdf["window_id"].astype("int64").tolist(), [None if p is None or p != p else float(p) for p in pdf["p_fused"]]


class ChunkSummary:
    """What a chunk does to the numbers of a session, whatever came before it."""

    def __init__(self, cfg: SmoothingConfig) -> None:
        self.cfg, self.map = cfg, OddsMap()
        self.inside = SessionFold(cfg)  # segments that lie inside the chunk
        self.first: list[list] = []  # the first scored windows, which may end segments begun earlier
        self.full_means = 0.0  # largest mean of whole segments inside

    def push(self, ids: list[int], ps: list[float | None]) -> None:
        c, e = self.cfg, self.cfg.switch_prob
        step = OddsMap((1 - e, e, e, 1 - e), LEAST_ODDS, 1 / LEAST_ODDS)
        for w, p in zip(ids, ps, strict=True):
            self.map = self.map.then(step)
            if p is not None:
                llr = min(max(_logit(p) - _logit(c.window_prior), -c.llr_clip), c.llr_clip)
                self.map = self.map.then(OddsMap((math.exp(c.evidence_scale * llr), 0.0, 0.0, 1.0), FLOOR, 1 / FLOOR))
                if len(self.first) < c.segment_windows - 1:
                    self.first.append([w, p])
                segment = [*(x for _, x in self.inside.tail), p]
                if len(segment) == c.segment_windows:
                    self.full_means = max(self.full_means, sum(segment) / len(segment))
            self.inside.run([w], [p])

    def dump(self) -> str:
        f = self.inside
        return json.dumps([self.map.m, self.map.lo, self.map.hi, f.n, f.scored, f.p_sum, self.first, f.tail, f.peak, f.peak_window, self.full_means])


def advance(f: SessionFold, blob: str) -> None:
    """Move a fold's numbers, but not its position, past a chunk."""
    m, lo, hi, n, scored, p_sum, first, tail, peak, peak_window, means = json.loads(blob)
    odds = OddsMap(m, lo, hi)(math.exp(_logit(f.cfg.session_prior)) if f.odds is None else f.odds)
    after = (f.n + n, f.scored + scored, f.p_sum + p_sum)
    f.run([w for w, _ in first], [p for _, p in first])  # peak and means of segments that reach over the border
    if peak > f.peak:
        f.peak, f.peak_window = peak, peak_window
    f.mean_peak = max(f.mean_peak, means)
    if len(first) == f.cfg.segment_windows - 1:
        f.tail = [tuple(x) for x in tail]
    f.odds, f.position = odds, 0
    f.n, f.scored, f.p_sum = after


def chunked_timeline(fused: DataFrame, cfg: SmoothingConfig, thr: RiskThresholds, chunk: int = CHUNK) -> DataFrame:
    """Timeline rows of all sessions; chunks are ranges of ``window_id``."""
    session_type = fused.schema["session_id"].dataType.simpleString()
    src = fused.select("session_id", F.col("window_id").cast("long").alias("window_id"), "p_fused", F.floor(F.col("window_id") / chunk).cast("long").alias("chunk"))
    keys = ["session_id", "chunk"]
    auto = automaton(thr)

    def emit(pdf, f):
        if f is None:
            entry = pdf["entry"].iloc[0]
            f = SessionFold(cfg, thr) if not isinstance(entry, str) else SessionFold.restore(json.loads(entry), cfg, thr)
        return timeline_frame(pdf["session_id"].iloc[0], f.run(*windows_of(pdf))), f

    long_ = materialize(src.groupBy("session_id").agg(F.min("chunk").alias("_a"), F.max("chunk").alias("_z")).filter("_a < _z"))
    if long_.isEmpty():
        rows = src.withColumn("entry", F.lit(None).cast("string"))
        return fold_sorted(rows, keys, ["window_id"], emit, timeline_fields(session_type))

    running = f"session_id {session_type}, chunk long, n long, blob string"
    cut = materialize(src.join(long_, "session_id"))

    def frame(pdf, **cols):
        return pd.DataFrame({"session_id": [pdf["session_id"].iloc[0]], "chunk": [pdf["chunk"].iloc[0]], **{c: [v] for c, v in cols.items()}})

    def last(df: DataFrame) -> DataFrame:
        return df.groupBy(*keys).agg(F.max_by("blob", "n").alias("blob"))

    def summarise(pdf, s):
        s = s or ChunkSummary(cfg)
        s.push(*windows_of(pdf))
        return frame(pdf, n=s.inside.n, blob=s.dump()), s

    def enter(pdf, f):
        f = f or SessionFold(cfg, thr)
        out = []
        for b in pdf["blob"]:
            advance(f, b)
            out.append(json.dumps(f.dump()))
        return pdf[keys].assign(chunk=pdf["chunk"] + 1, entry=out), f  # the entry of the chunk that follows

    done = last(fold_sorted(cut.filter("chunk < _z").drop("_a", "_z"), keys, ["window_id"], summarise, running))
    order = done.select("session_id", F.col("chunk"), "blob")
    entries = materialize(fold_sorted(order, ["session_id"], ["chunk"], enter, f"session_id {session_type}, chunk long, entry string"))
    # chunks without windows make a gap: the entry goes to the next chunk that has some
    heads = cut.select("session_id", "chunk").distinct()
    following = heads.join(entries.withColumnRenamed("chunk", "_from"), "session_id").filter("chunk >= _from").groupBy("session_id", "chunk").agg(F.max_by("entry", "_from").alias("entry"))
    entered = materialize(cut.join(following, keys, "left"))

    def maps(pdf, st):
        if st is None:
            entry = pdf["entry"].iloc[0]
            st = (SessionFold(cfg, thr) if not isinstance(entry, str) else SessionFold.restore(json.loads(entry), cfg, thr), list(range(len(auto.positions))), 0)
        f, where, n = st
        for row in f.run(*windows_of(pdf)):
            p_session, scored, abstained = row[5], row[8], row[9]
            zone = auto.zone(p_session, scored >= thr.min_scored_windows and abstained <= thr.max_abstain_ratio)
            where = [auto.table[x][zone] for x in where]
        n += len(pdf)
        return frame(pdf, n=n, blob=json.dumps(where)), (f, where, n)

    def position(pdf, pos):
        pos, out = pos or 0, []
        for b in pdf["blob"]:
            out.append(pos)
            pos = json.loads(b)[pos]
        return pdf[keys].assign(pos=out), pos

    starts = fold_sorted(last(fold_sorted(entered.drop("_a", "_z"), keys, ["window_id"], maps, running)), ["session_id"], ["chunk"], position, f"session_id {session_type}, chunk long, pos int")
    placed = entered.join(starts, keys)

    def emit_long(pdf, f):
        if f is None:
            entry = pdf["entry"].iloc[0]
            f = SessionFold(cfg, thr) if not isinstance(entry, str) else SessionFold.restore(json.loads(entry), cfg, thr)
            f.position = int(pdf["pos"].iloc[0])
        return timeline_frame(pdf["session_id"].iloc[0], f.run(*windows_of(pdf))), f

    short = fold_sorted(src.join(long_.select("session_id"), "session_id", "left_anti").withColumn("entry", F.lit(None).cast("string")), keys, ["window_id"], emit, timeline_fields(session_type))
    return short.unionByName(fold_sorted(placed.drop("_a", "_z"), keys, ["window_id"], emit_long, timeline_fields(session_type)))
