"""Metrics against brute force and closed forms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonorisk.operators import bootstrap, curves, fairness, protocols as P


def trials(spark, bona, spoof):
    rows = [("s", "bona_fide", float(x)) for x in bona] + [("s", "spoof", float(x)) for x in spoof]
    return spark.createDataFrame(rows, "g string, label string, score double")


def metrics(spark, bona, spoof, **kw):
    return curves.curve_metrics(curves.detection_curve(trials(spark, bona, spoof), ["g"]), ["g"], **kw).collect()[0]


def test_perfect_and_inverted_detectors(spark):
    m = metrics(spark, [3, 4, 5], [0, 1, 2])
    assert (m.eer, m.min_dcf, m.auc) == (0.0, 0.0, 1.0)
    m = metrics(spark, [0, 1, 2], [3, 4, 5])
    assert m.eer == 1.0 or m.eer == 0.5
    assert m.auc == 0.0


@pytest.mark.parametrize("limit", [1 << 40, -1])
def test_metrics_against_brute_force(spark, limit):
    r = np.random.default_rng(3)
    b, s = np.round(r.normal(1, 1, 400), 2), np.round(r.normal(0, 1, 300), 2)
    m = curves.curve_metrics(curves.detection_curve(trials(spark, b, s), ["g"], limit=limit), ["g"], max_fpr=0.1).collect()[0]
    thr = np.concatenate([[min(b.min(), s.min()) - 1e-9], np.unique(np.concatenate([b, s]))])
    frr = np.array([(b <= t).mean() for t in thr])
    far = np.array([(s > t).mean() for t in thr])
    i = int(np.argmin(np.round(np.abs(frr - far), 12)))
    assert abs(m.eer - (frr[i] + far[i]) / 2) < 1e-9
    assert abs(m.min_dcf - (0.95 * frr + 0.5 * far).min() / 0.5) < 1e-9
    wins = (b[:, None] > s[None, :]).mean() + 0.5 * (b[:, None] == s[None, :]).mean()
    assert abs(m.auc - wins) < 1e-9
    x, y = np.append(frr[frr <= 0.1], 0.1), np.append((1 - far)[frr <= 0.1], np.interp(0.1, frr, 1 - far))
    area = np.sum(np.diff(x) * (y[1:] + y[:-1]) / 2)
    assert abs(m.pauc - 0.5 * (1 + (area - 0.005) / (0.1 - 0.005))) < 1e-6


def test_one_class_slice_has_counts_but_no_metrics(spark):
    r = P.summarize(trials(spark, [1, 2], []).selectExpr("'p' as protocol", "g as slice", "label", "score"), p_col=None).collect()[0]
    assert r.n_bona == 2 and r.eer is None and r.note == "needs both classes" and r.coverage == 1.0


def test_calibration_error_extremes(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(0.95, False)] * 10 + [(1.0, False)] * 2, "p double, y boolean")
    assert abs(curves.calibration_error(df, [], "p", F.col("y")).collect()[0].ece - (9.5 + 2) / 12) < 1e-9


def test_tandem_cost_guard(spark):
    c = curves.detection_curve(trials(spark, [1], [0]), ["g"])
    with pytest.raises(ValueError):
        curves.min_tdcf(c, ["g"], 1.0, 1.0, 0.0)


def test_bootstrap_interval_holds_the_point(spark):
    r = np.random.default_rng(0)
    df = trials(spark, r.normal(1, 1, 500), r.normal(0, 1, 500))
    x = bootstrap.bootstrap_interval(df, ["g"], "eer").collect()[0]
    assert x.ci_low <= x.point <= x.ci_high and x.ci_high - x.ci_low < 0.15
    g = bootstrap.bootstrap_interval(df, ["g"], "gap", n=200).collect()[0]
    assert g.ci_low < 1.0 < g.ci_high or abs(g.point - 1) < 0.2


def test_bootstrap_resolves_a_rare_class(spark):
    """An error rate far below one in 2,048 has an interval of that size, as drawn directly over all distinct scores."""
    bona, spoof = 200_000, 100
    i = F.col("id")
    good = spark.range(bona).select(F.lit("g").alias("g"), (i + 0.0).alias("score"), F.lit("bona_fide").alias("label"))
    bad = spark.range(spoof).select(F.lit("g").alias("g"), (i - 80.5).alias("score"), F.lit("spoof").alias("label"))
    x = bootstrap.bootstrap_interval(good.unionByName(bad), ["g"], "eer").collect()[0]
    r, scores = np.random.default_rng(1), np.r_[np.arange(bona) + 0.0, np.arange(spoof) - 80.5]
    order, kind = np.argsort(scores), np.r_[np.ones(bona, bool), np.zeros(spoof, bool)]
    kind = kind[order]
    eers = []
    for _ in range(200):
        b, s = np.zeros(len(kind)), np.zeros(len(kind))
        b[kind], s[~kind] = r.multinomial(bona, np.full(bona, 1 / bona)), r.multinomial(spoof, np.full(spoof, 1 / spoof))
        eers.append(bootstrap._eer(b[None], s[None])[0])
    lo, hi = np.quantile(eers, [0.025, 0.975])
    assert x.ci_low <= x.point <= x.ci_high
    assert abs(x.ci_low - lo) < 5e-5 and abs(x.ci_high - hi) < 5e-5


def test_bootstrap_parts_cut_nothing(spark, monkeypatch):
    """Ranges of seven scores give an interval like that of one range, with a NULL slice and one of a single class."""
    r = np.random.default_rng(0)
    rows = [(g, float(v), k) for g in ("a", None) for k, m in (("bona_fide", 1), ("spoof", 0)) for v in r.normal(m, 1, 400)]
    df = spark.createDataFrame([*rows, ("one", 0.5, "spoof")], "g string, score double, label string")
    run = lambda m: {x.g: x for x in bootstrap.bootstrap_interval(df, ["g"], m, n=400).collect()}
    whole = {m: run(m) for m in ("eer", "gap", bootstrap._eer)}
    monkeypatch.setattr(bootstrap, "PART", 7)
    for m, w in whole.items():
        got = run(m)
        assert set(got) == {"a", None, "one"} and got["one"].ci_low is None and got["one"].point is None
        for g in ("a", None):
            assert abs(got[g].ci_low - w[g].ci_low) < 0.03 and abs(got[g].ci_high - w[g].ci_high) < 0.03
            assert got[g].ci_low < got[g].point < got[g].ci_high and got[g].point == w[g].point


def test_fairness_gate_has_four_outcomes(spark):
    gaps = spark.createDataFrame([("gender", 2, 40, 0.1, 2.0)], "attribute string, n_groups long, min_group_n long, gap double, ratio double")
    status = lambda *a: fairness.gate(gaps, *a).collect()[0].status
    assert [status(None), status(0.05), status(0.2, 100), status(0.2)] == ["not_configured", "fail", "insufficient_data", "pass"]


def test_ratio_is_infinite_when_one_group_has_no_errors(spark):
    g = spark.createDataFrame([("a", "x", 50, 0.0), ("a", "y", 50, 0.2)], "attribute string, group string, n_bona long, fpr double")
    assert fairness.gap_and_ratio(g).collect()[0].ratio == float("inf")


def _some_trials(spark, n=3000):
    r = np.random.default_rng(5)
    rows = [("spoof" if k else "bona_fide", None if v > 2.5 else float(np.round(v, 2)), float(p), f"g{g}" if g < 3 else None) for k, v, p, g in zip(r.integers(0, 2, n), r.normal(0, 1, n), r.random(n), r.integers(0, 4, n), strict=True)]
    return spark.createDataFrame([*rows, ("spoof", 0.5, 0.5, "one")], "label string, score double, p_spoof double, grp string")


@pytest.mark.parametrize("most", [1 << 17, 0])
def test_sliced_metrics_equal_one_curve_per_slice(spark, monkeypatch, most):
    """Streamed ranges give the metrics of a plain curve; trials without a slice, NULL scores and one-class slices are among them."""
    monkeypatch.setattr(curves, "MAX_SETS", most)
    df = _some_trials(spark)
    keys = [F.when(F.col("grp").isNotNull(), P.slice_key("g", F.col("grp"))), F.when(F.col("score") > 0, P.overall_slice())]
    t = P.with_slices(df, keys)
    got = {r.slice: r for r in P.summarize(t).collect()}
    each = t.select("*", F.inline(P.SLICES))
    want = {r.slice: r for r in curves.curve_metrics(curves.detection_curve(each, P.KEYS), P.KEYS).collect()}
    assert set(got) == {"g0", "g1", "g2", "one", "all"} == set(want) and got["one"].eer is None
    for k, w in want.items():
        assert (got[k].n_bona, got[k].n_spoof) == (w.n_bona, w.n_spoof)
        for m in ("eer", "min_dcf", "auc", "pauc"):
            assert getattr(got[k], m) is None if getattr(w, m) is None else abs(getattr(got[k], m) - getattr(w, m)) < 1e-9


def test_trials_are_not_dealt_per_slice(spark):
    """Ten slices of a trial send no more than one row of it: the rows that are ranged do not grow with the slices."""
    df, sizes = _some_trials(spark), []
    kept = curves.range_parts
    try:
        curves.range_parts = lambda d, by: sizes.append(d.count()) or kept(d, by)
        for k in (1, 10):
            P.summarize(P.with_slices(df, [P.slice_key(f"p{i}", F.lit("all")) for i in range(k)]))
    finally:
        curves.range_parts = kept
    assert sizes[0] == sizes[1]


def test_bootstrap_ranges_hold_bounded_groups_and_draw_where_a_metric_is_read(spark, monkeypatch):
    """a metric by ranges never sees a whole slice, and its interval is that of the callable on whole slices."""
    r = np.random.default_rng(1)
    rows = [(g, float(v), k) for g in ("a", None) for k, m in (("bona_fide", 1), ("spoof", 0)) for v in r.normal(m, 1, 400)]
    df = spark.createDataFrame([*rows, ("one", 0.5, "spoof")], "g string, score double, label string")

    def whole(b, s):
        share = np.cumsum(b, axis=1) / b.sum(axis=1, keepdims=True)
        return 1 - (np.cumsum(s, axis=1) / s.sum(axis=1, keepdims=True))[np.arange(len(b)), np.argmax(share >= 0.5, axis=1)]

    def at(frr, far):
        if frr.shape[1] > 100:
            raise ValueError("more than a range")
        i, n = np.argmax(frr >= 0.5, axis=1), np.arange(len(frr))
        return np.where(frr[n, i] >= 0.5, 0.0, 1.0), far[n, i]

    run = lambda m, n=100: {x.g: x for x in bootstrap.bootstrap_interval(df, ["g"], m, n=n).collect()}
    inside = lambda frr0, far0, frr, far: (frr0 < 0.5) & (frr >= 0.5)
    want = run(whole, 400)
    assert run(bootstrap.ByRange(lambda frr, far: (np.zeros(len(frr)), far[:, -1])))["one"].point is None
    for one_task in (bootstrap.ONE_TASK, -1):
        monkeypatch.setattr(bootstrap, "ONE_TASK", one_task)
        monkeypatch.setattr(bootstrap, "PART", 100)
        for m in (bootstrap.ByRange(at, inside), bootstrap.ByRange(at)):
            got = run(m, 400)
            assert set(got) == {"a", None, "one"}
            for g in ("a", None):
                assert got[g].point == want[g].point
                assert abs(got[g].ci_low - want[g].ci_low) < 0.03 and abs(got[g].ci_high - want[g].ci_high) < 0.03
        e = run("eer")
        assert e["one"].point is None and abs(e["a"].point - bootstrap._eer(*_matrix(rows, "a"))[0]) < 1e-9


def _matrix(rows, g):
    kinds = [k for x, _, k in sorted(rows, key=lambda t: t[1]) if x == g]
    return np.array([[float(k == "bona_fide") for k in kinds]]), np.array([[float(k == "spoof") for k in kinds]])


def test_drawing_trial_by_trial_has_the_law_of_the_counts():
    r, counts = np.random.default_rng(2), np.array([3, 0, 1, 6])
    x = bootstrap._split(r, counts, np.full(4000, 10))
    assert (x.sum(axis=1) == 10).all() and (x[:, 1] == 0).all()
    assert np.abs(x.mean(axis=0) - counts).max() < 0.15 and np.abs(x.var(axis=0) - counts * (1 - counts / 10)).max() < 0.25
    assert abs(bootstrap._weighed(r, counts, np.full(4000, 10), np.arange(4.0)).mean() - 20) < 0.4
