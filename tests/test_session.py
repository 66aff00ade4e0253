"""Session smoothing and fusion invariants."""

import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sonorisk.operators import fusion, temporal as TP


def walk(ps, thr=None):
    """States of the automaton alone, over session scores."""
    auto, pos, seen = TP.automaton(thr or TP.RiskThresholds()), 0, []
    for p in ps:
        pos = auto.table[pos][auto.zone(p, p is not None) if p is not None else auto.unusable]
        seen.append(TP.STATES[auto.positions[pos][0]])
    return seen


def test_hysteresis_leaves_a_state_only_after_the_dwell():
    assert walk((0.75, 0.66, 0.64, 0.64, 0.64, 0.50)) == ["HIGH", "HIGH", "HIGH", "HIGH", "ELEVATED", "ELEVATED"]
    assert walk((0.75, *[0.1] * 5), TP.RiskThresholds(min_dwell_windows=5)) == ["HIGH"] * 5 + ["LOW"]
    assert walk((0.5, None, 0.3, 0.34, 0.4)) == ["ELEVATED", "ABSTAIN", "LOW", "LOW", "ELEVATED"]


def test_abstained_windows_never_raise_the_score():
    rows = TP.SessionFold().run(range(15), [0.9] * 5 + [None] * 10)
    assert rows[-1][2] <= rows[4][2] and rows[-1][9] == 10 / 15 and rows[-1][8] == 5


def test_short_segment_is_found_in_a_long_genuine_call():
    last = TP.SessionFold().run(range(60), [0.97 if 30 <= w < 33 else 0.1 for w in range(60)])[-1]
    assert last[4] == 32 and last[3] > 0.7 > last[2]


def test_state_survives_a_round_trip():
    a = TP.SessionFold()
    a.run(range(7), [0.6] * 7)
    b = TP.SessionFold.restore(a.dump())
    assert a.run([7], [0.9]) == b.run([7], [0.9])


def scores(spark, rows):
    return spark.createDataFrame(rows, "session_id long, window_id long, head_id string, p_spoof double, abstain boolean, watermark string")


def test_absent_watermark_changes_nothing_and_shares_sum_to_one(spark):
    base = [(1, 0, "A", 0.8, False, None), (1, 0, "B", 0.3, False, None), (1, 0, "C", None, True, None)]
    wm = lambda p, w: [(1, 0, "F", p, p is None, w)]
    fuse = lambda rows: fusion.contribution_shares(fusion.fuse_windows(scores(spark, rows), watermark=F.col("watermark"))).collect()[0]
    plain, absent, low, present = fuse(base), fuse(base + wm(None, "absent")), fuse(base + wm(0.5, "present")), fuse(base + wm(0.96, "present"))
    assert plain.p_fused == absent.p_fused == low.p_fused < present.p_fused
    assert abs(sum(plain.contributions.values()) - 1) < 1e-12 and plain.heads_abstained == ["C"]


def test_all_heads_abstaining_gives_null(spark):
    r = fusion.fuse_windows(scores(spark, [(1, 0, "A", None, True, None)])).collect()[0]
    assert r.p_fused is None and r.n_present == 0


def test_timeline_and_native_segments_agree(spark):
    rows = [(s, w, None if (w + s) % 7 == 0 else ((w * 37 + s * 11) % 97 + 1) / 98) for s in range(4) for w in range(50)]
    f = spark.createDataFrame(pd.DataFrame(rows, columns=["session_id", "window_id", "p_fused"]).astype({"p_fused": "float64"}))
    f = f.withColumn("p_fused", F.when(~F.isnan("p_fused"), F.col("p_fused")))
    last = {r.session_id: r for r in TP.final_rows(TP.session_timeline(f)).collect()}
    for limit in (None, -1):
        for r in TP.segment_peak(TP.segment_evidence(f, limit=limit)).collect():
            assert abs(r.segment_max - last[r.session_id].p_segment_max) < 1e-9
            assert r.segment_window == last[r.session_id].segment_window


def drifting(seed=5):
    """Sessions (text ids) with wandering scores, abstained runs and one gap of whole chunks."""
    import numpy as np

    r, rows = np.random.default_rng(seed), []
    for s, n in (("call-a", 200), ("b", 6), ("c", 50), ("d", 90)):
        level = 0.3
        for w in range(n):
            if s == "d" and 20 <= w < 60:
                continue
            level = min(max(level + r.normal(0, 0.15), 0.02), 0.98) if w % 40 else r.uniform(0.05, 0.95)
            p = None if r.random() < (0.9 if 60 < w < 90 else 0.2) else float(np.clip(level + r.normal(0, 0.2), 1e-9, 1 - 1e-9))
            rows.append((s, w, p))
    return rows


@pytest.mark.parametrize("dwell", [1, 3, 5])
@pytest.mark.parametrize("chunk", [3, 7])
def test_chunked_sessions_equal_the_single_pass(spark, chunk, dwell):
    rows, thr = drifting(), TP.RiskThresholds(min_dwell_windows=dwell)
    f = spark.createDataFrame(rows, "session_id string, window_id long, p_fused double")
    want = []
    for s in sorted({r[0] for r in rows}):
        mine = [r for r in rows if r[0] == s]
        want += [(s, *r) for r in TP.SessionFold(thr=thr).run([r[1] for r in mine], [r[2] for r in mine])]
    near = lambda t: tuple(round(x, 9) if isinstance(x, float) else x for x in t)
    for size in (chunk, 1_000):
        got = sorted((near(r) for r in TP.session_timeline(f, thr=thr, chunk=size).collect()), key=lambda t: t[:2])
        assert got == sorted(map(near, want), key=lambda t: t[:2])
    assert {x[-1] for x in want} >= {"LOW", "HIGH", "ABSTAIN"}
