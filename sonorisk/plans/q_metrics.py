"""Queries: detection curves, metrics, protocols, fairness, drift, bootstrap."""

from pyspark.sql import functions as F

from sonorisk.functions.math import r6, wilson
from sonorisk.operators import bootstrap, curves, drift, fairness, protocols as P
from sonorisk.plans.fixtures import cte, events, head_scores, scores, sql, table
from sonorisk.plans.registry import query


def curve_cte(src: str, slices: list[str], score: str = "score", where: str = "true", start: bool = True) -> str:
    """SQL for the distinct-score curve, with the point before the first score when asked."""
    k = "".join(f"{s}, " for s in slices)
    part = f"PARTITION BY {', '.join(slices)}" if slices else ""
    using = f"{', '.join(slices)}" if slices else "1"
    first = f"UNION ALL SELECT {k} min({score}) - 1e-9, 0, 0 FROM {src} WHERE {score} IS NOT NULL AND {where} GROUP BY {using if slices else 'ALL'}" if start else ""
    return f"""SELECT *, c_bona / nullif(t_bona, 0) AS frr, 1 - c_spoof / nullif(t_spoof, 0) AS far,
      (c_bona - n_bona) / nullif(t_bona, 0) AS frr0, 1 - (c_spoof - n_spoof) / nullif(t_spoof, 0) AS far0
      FROM (SELECT *, sum(n_bona) OVER (w) AS c_bona, sum(n_spoof) OVER (w) AS c_spoof,
        sum(n_bona) OVER (p) AS t_bona, sum(n_spoof) OVER (p) AS t_spoof
        FROM (SELECT {k} {score} AS score, count(*) FILTER (label = 'bona_fide') AS n_bona, count(*) FILTER (label = 'spoof') AS n_spoof
              FROM {src} WHERE {score} IS NOT NULL AND {where} GROUP BY {k} {score} {first})
        WINDOW w AS ({part} ORDER BY score), p AS ({part}))"""


EER_SQL = "first((frr + far) / 2 ORDER BY round(abs(frr - far), 12), score) FILTER (frr IS NOT NULL AND far IS NOT NULL)"
THR_SQL = "first(score ORDER BY round(abs(frr - far), 12), score) FILTER (frr IS NOT NULL AND far IS NOT NULL)"
DCF_SQL = "min(0.95 * frr + 0.5 * far) / 0.5"
AUC_SQL = "CASE WHEN max(t_bona) > 0 AND max(t_spoof) > 0 THEN sum(n_bona * (c_spoof - n_spoof + n_spoof / 2.0)) / (max(t_bona) * max(t_spoof)) END"


def _pauc(m: float = 0.01) -> str:
    lo = m * m / 2
    return f"""0.5 * (1 + (sum(CASE WHEN frr <= {m} THEN (frr - frr0) * ((1 - far0) + (1 - far)) / 2
      WHEN frr0 < {m} THEN ({m} - frr0) * ((1 - far0) + (1 - far0) + ((1 - far) - (1 - far0)) * ({m} - frr0) / nullif(frr - frr0, 0)) / 2
      ELSE 0 END) FILTER (frr IS NOT NULL AND far IS NOT NULL) - {lo}) / ({m} - {lo}))"""


def _r(x: str, name: str, d: int = 6) -> str:
    return f"round({x}, {d}) + 0.0 AS {name}"


SLICE = ["dataset", "gender"]
cte("curve_ds", curve_cte("scores", SLICE), "scores")
cte("curve_tied", curve_cte("scores", SLICE, "p_spoof"), "scores")
cte("curve_p", curve_cte("scores", SLICE, "p_spoof", start=False), "scores")


def _curve(spark, sf, score="score"):
    return curves.detection_curve(scores(spark, sf), SLICE, score)


@query(
    "WIN01",
    sql("SELECT dataset, gender, round(score, 6) + 0.0 AS score, c_bona, c_spoof, round(frr, 6) + 0.0 AS frr, round(far, 6) + 0.0 AS far FROM curve_p", "curve_p"),
)
def win01(spark, sf):
    c = _curve(spark, sf, "p_spoof")
    return c.select(*SLICE, r6(F.col("score")).alias("score"), "c_bona", "c_spoof", r6(F.col("frr")).alias("frr"), r6(F.col("far")).alias("far"))


@query(
    "WIN02",
    sql(
        """SELECT dataset, p_spoof, count(*) AS n_ties, any_value(rk) + (count(*) - 1) / 2.0 AS mid_rank
        FROM (SELECT dataset, p_spoof, rank() OVER (PARTITION BY dataset ORDER BY p_spoof) AS rk FROM scores WHERE p_spoof IS NOT NULL) GROUP BY 1, 2""",
        "scores",
    ),
)
def win02(spark, sf):
    return curves.mid_ranks(scores(spark, sf), ["dataset"], "p_spoof")


@query("AGG04", sql(f"SELECT dataset, gender, {_r(EER_SQL, 'eer')}, {_r(THR_SQL, 'eer_threshold')} FROM curve_tied GROUP BY 1, 2", "curve_tied"))
def agg04(spark, sf):
    m = curves.curve_metrics(_curve(spark, sf, "p_spoof"), SLICE)
    return m.select(*SLICE, r6(F.col("eer")).alias("eer"), r6(F.col("eer_threshold")).alias("eer_threshold"))


@query(
    "AGG05",
    sql(
        f"""SELECT dataset, gender, {_r('least(1.0, min(greatest(1 - frr0, 1 - far0)))', 'eer_minmax')},
        {_r("first((frr0 + far0) / 2 ORDER BY round(abs(frr0 - far0), 12), score)", 'eer_left')} FROM curve_p GROUP BY 1, 2""",
        "curve_p",
    ),
)
def agg05(spark, sf):
    c = _curve(spark, sf, "p_spoof")
    a, b = curves.min_max_error(c, SLICE), curves.left_sided_eer(c, SLICE)
    return a.join(b, SLICE).select(*SLICE, r6(F.col("eer_minmax")).alias("eer_minmax"), r6(F.col("eer_left")).alias("eer_left"))


@query(
    "AGG06",
    sql(
        """SELECT dataset, gender, round(avg(CASE WHEN label = 'bona_fide' THEN CAST(score <= 1200 AS INT) END), 6) AS fpr,
        round(avg(CASE WHEN label = 'spoof' THEN CAST(score > 1200 AS INT) END), 6) AS miss_rate FROM scores WHERE score IS NOT NULL GROUP BY 1, 2""",
        "scores",
    ),
)
def agg06(spark, sf):
    r = curves.rates_at(scores(spark, sf), SLICE, F.lit(1200.0))
    return r.select(*SLICE, r6(F.col("fpr")).alias("fpr"), r6(F.col("miss_rate")).alias("miss_rate"))


@query(
    "AGG07",
    sql(
        """SELECT dataset, gender, round(coalesce(max(score) FILTER (n_bona > 0 AND c_bona <= floor(0.01 * t_bona)), min(score) FILTER (n_bona > 0) - 1e-9), 6) + 0.0 AS threshold
        FROM curve_p GROUP BY 1, 2""",
        "curve_p",
    ),
)
def agg07(spark, sf):
    return curves.threshold_low_side(_curve(spark, sf, "p_spoof"), SLICE, 0.01).withColumn("threshold", r6(F.col("threshold")))


_HIGH = "min(score) FILTER (c_bona > least(ceil((1 - {f}) * t_bona), t_bona - 1)) + 1e-9"


@query("AGG08", sql(f"SELECT dataset, gender, {_r(_HIGH.format(f='0.01'), 'threshold')} FROM curve_p GROUP BY 1, 2", "curve_p"))
def agg08(spark, sf):
    return curves.threshold_high_side(_curve(spark, sf, "p_spoof"), SLICE, 0.01).withColumn("threshold", r6(F.col("threshold")))


@query(
    "AGG09",
    sql(
        """SELECT dataset, gender, first(t ORDER BY round(cost, 12), t) + 0.0 AS threshold, round(min(cost), 6) + 0.0 AS cost FROM (
        SELECT dataset, gender, score AS t, 1.0 * (1 - frr0) * 0.98 + 50.0 * (1 - far0) * 0.02 AS cost FROM curve_p
        UNION ALL SELECT dataset, gender, 0.0, 0.98 FROM curve_p GROUP BY 1, 2
        UNION ALL SELECT dataset, gender, 1.0, 0.98 * (count(*) FILTER (label = 'bona_fide' AND p_spoof >= 1) / count(*) FILTER (label = 'bona_fide'))
            + 50.0 * 0.02 * (count(*) FILTER (label = 'spoof' AND p_spoof < 1) / count(*) FILTER (label = 'spoof')) FROM scores WHERE p_spoof IS NOT NULL GROUP BY 1, 2)
        GROUP BY 1, 2""",
        "curve_p",
    ),
)
def agg09(spark, sf):
    c = curves.cost_optimal(_curve(spark, sf, "p_spoof"), SLICE, 1.0, 50.0, 0.02)
    return c.select(*SLICE, (F.col("threshold") + 0.0).alias("threshold"), r6(F.col("cost")).alias("cost"))


@query("AGG10", sql(f"SELECT dataset, gender, {_r(DCF_SQL, 'min_dcf')} FROM curve_ds GROUP BY 1, 2", "curve_ds"))
def agg10(spark, sf):
    return curves.curve_metrics(_curve(spark, sf), SLICE).select(*SLICE, r6(F.col("min_dcf")).alias("min_dcf"))


_C1, _C2 = 0.9405 * (1 - 0.02) - 0.0095 * 10 * 0.03, 10 * 0.05 * (1 - 0.4)


@query("AGG11", sql(f"SELECT dataset, gender, {_r(f'min({_C1!r} * frr + {_C2!r} * far) / {min(_C1, _C2)!r}', 'min_tdcf')} FROM curve_ds GROUP BY 1, 2", "curve_ds"))
def agg11(spark, sf):
    return curves.min_tdcf(_curve(spark, sf), SLICE, 0.02, 0.03, 0.4).withColumn("min_tdcf", r6(F.col("min_tdcf")))


@query(
    "AGG12",
    sql(
        """SELECT dataset, round(least(1.0, min(0.9 * c_t / t_t + 0.5 * (1 - c_n / t_n) + 0.5 * (1 - c_s / t_s))) / 0.9, 6) + 0.0 AS min_adcf FROM (
        SELECT dataset, sum(a) OVER w AS c_t, sum(b) OVER w AS c_n, sum(c) OVER w AS c_s, sum(a) OVER p AS t_t, sum(b) OVER p AS t_n, sum(c) OVER p AS t_s FROM (
          SELECT dataset, score, count(*) FILTER (cls = 'target') AS a, count(*) FILTER (cls = 'nontarget') AS b, count(*) FILTER (cls = 'spoof') AS c
          FROM (SELECT *, CASE WHEN label = 'spoof' THEN 'spoof' WHEN l_orderkey % 4 = 0 THEN 'nontarget' ELSE 'target' END AS cls FROM scores) WHERE score IS NOT NULL GROUP BY 1, 2)
        WINDOW w AS (PARTITION BY dataset ORDER BY score), p AS (PARTITION BY dataset)) GROUP BY 1""",
        "scores",
    ),
)
def agg12(spark, sf):
    s = scores(spark, sf).withColumn("cls", F.when(F.col("label") == "spoof", "spoof").when(F.col("l_orderkey") % 4 == 0, "nontarget").otherwise("target"))
    return curves.min_adcf(s, ["dataset"], "cls").withColumn("min_adcf", r6(F.col("min_adcf")))


@query("AGG13", sql(f"SELECT dataset, gender, {_r(AUC_SQL, 'auc')} FROM curve_tied GROUP BY 1, 2", "curve_tied"))
def agg13(spark, sf):
    return curves.curve_metrics(_curve(spark, sf, "p_spoof"), SLICE).select(*SLICE, r6(F.col("auc")).alias("auc"))


@query("AGG14", sql(f"SELECT dataset, gender, {_r(_pauc(), 'pauc_1')}, {_r(_pauc(0.1), 'pauc_10')} FROM curve_ds GROUP BY 1, 2", "curve_ds"))
def agg14(spark, sf):
    a = curves.partial_areas(_curve(spark, sf), SLICE, {"pauc_1": 0.01, "pauc_10": 0.1})
    return a.select(*SLICE, r6(F.col("pauc_1")).alias("pauc_1"), r6(F.col("pauc_10")).alias("pauc_10"))


@query(
    "AGG15",
    sql(
        """SELECT head_id, round(sum(abs(sp - sy)) / sum(n), 6) + 0.0 AS ece FROM (SELECT head_id, least(CAST(floor(p_spoof * 15) AS INT), 14) AS b, count(*) AS n,
        sum(p_spoof) AS sp, sum(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END) AS sy FROM head_scores WHERE p_spoof IS NOT NULL GROUP BY 1, 2) GROUP BY 1""",
        "head_scores",
    ),
)
def agg15(spark, sf):
    e = curves.calibration_error(head_scores(spark, sf), ["head_id"], "p_spoof", F.col("event_type") == "error")
    return e.withColumn("ece", r6(F.col("ece")))


cte("boot_c", curve_cte("scores", ["dataset"]), "scores")


def _interval(b, keys):
    """The point, and what must hold of its interval: it is ordered and no wider than the sampling error allows."""
    return b.select(*keys, r6(F.col("point")).alias("point"), (F.col("ci_low") <= F.col("ci_high")).alias("ordered"), ((F.col("ci_low") - 0.05 * F.abs("point") <= F.col("point")) & (F.col("point") <= F.col("ci_high") + 0.05 * F.abs("point"))).alias("holds_point"))


@query("AGG16", sql(f"SELECT dataset, {_r(EER_SQL, 'point')}, true AS ordered, true AS holds_point FROM boot_c GROUP BY 1", "boot_c"))
def agg16(spark, sf):
    return _interval(bootstrap.bootstrap_interval(scores(spark, sf), ["dataset"], "eer"), ["dataset"])


@query("AGG17", sql("SELECT codec, round(avg(score) FILTER (label = 'bona_fide') - avg(score) FILTER (label = 'spoof'), 6) AS point, true AS ordered, true AS holds_point FROM scores WHERE score IS NOT NULL GROUP BY 1", "scores"))
def agg17(spark, sf):
    return _interval(bootstrap.bootstrap_interval(scores(spark, sf), ["codec"], "gap", n=1000), ["codec"])


# ---- protocols --------------------------------------------------------------------------------

COLS = ["protocol", "slice", "n_bona", "n_spoof", "coverage", "eer", "min_dcf", "auc", "pauc", "ece", "low_n", "note"]


def summary_cte(prefix: str, trials: str) -> list[str]:
    """Register the fragments that summarise a (protocol, slice) trial table."""
    cte(f"{prefix}_t", trials, "scores")
    cte(f"{prefix}_c", curve_cte(f"{prefix}_t", ["protocol", "slice"]), f"{prefix}_t")
    cte(
        f"{prefix}_e",
        f"""SELECT protocol, slice, sum(abs(sp - sy)) / sum(n) AS ece FROM (SELECT protocol, slice, least(CAST(floor(p_spoof * 15) AS INT), 14) AS b, count(*) AS n,
        sum(p_spoof) AS sp, sum(CASE WHEN label = 'spoof' THEN 1.0 ELSE 0.0 END) AS sy FROM {prefix}_t WHERE p_spoof IS NOT NULL GROUP BY ALL) GROUP BY 1, 2""",
        f"{prefix}_t",
    )
    cte(
        f"{prefix}_s",
        f"""SELECT b.*, least(n_bona, n_spoof) < 30 AS low_n, CASE WHEN eer IS NULL THEN 'needs both classes' END AS note, min_dcf, auc, pauc, eer,
        CASE WHEN eer IS NOT NULL THEN ece END AS ece FROM
        (SELECT protocol, slice, count(*) FILTER (score IS NOT NULL AND label = 'bona_fide') AS n_bona, count(*) FILTER (score IS NOT NULL AND label = 'spoof') AS n_spoof,
         count(score) / count(*) AS coverage FROM {prefix}_t GROUP BY 1, 2) b
        LEFT JOIN (SELECT protocol, slice, {EER_SQL} AS eer, {DCF_SQL} AS min_dcf, {AUC_SQL} AS auc, {_pauc()} AS pauc FROM {prefix}_c GROUP BY 1, 2) USING (protocol, slice)
        LEFT JOIN {prefix}_e USING (protocol, slice)""",
        f"{prefix}_c", f"{prefix}_e",
    )
    return [f"{prefix}_s"]


def _summary_select(extra: str = "") -> str:
    return (
        "SELECT protocol, slice, n_bona, n_spoof, round(coverage, 6) AS coverage, round(eer, 6) + 0.0 AS eer, round(min_dcf, 6) + 0.0 AS min_dcf, "
        f"round(auc, 6) + 0.0 AS auc, round(pauc, 6) + 0.0 AS pauc, round(ece, 6) + 0.0 AS ece, low_n, note {extra} FROM "
    )


def _out(df, *extra):
    num = {"coverage", "eer", "min_dcf", "auc", "pauc", "ece"}
    return df.select(*[r6(F.col(c)).alias(c) if c in num else c for c in COLS], *extra)


BASE = "label, score, p_spoof FROM scores"
summary_cte("ov", f"SELECT 'overall' AS protocol, 'all' AS slice, {BASE} UNION ALL SELECT 'empty', 'one_class', {BASE} WHERE label = 'spoof'")


@query("AGG18", sql(_summary_select() + "ov_s", "ov_s"))
def agg18(spark, sf):
    one = F.when(F.col("label") == "spoof", P.slice_key("empty", F.lit("one_class")))
    return _out(P.summarize(P.with_slices(scores(spark, sf), [P.overall_slice(), one])))


FAM = "SELECT DISTINCT attack_family AS f FROM scores WHERE attack_family IS NOT NULL"
summary_cte(
    "bg",
    f"""SELECT 'language' AS protocol, coalesce(language, 'unknown') AS slice, {BASE}
    UNION ALL SELECT 'family', f, s.label, s.score, s.p_spoof FROM scores s, ({FAM}) WHERE s.label = 'bona_fide'
    UNION ALL SELECT 'family', attack_family, {BASE} WHERE attack_family IS NOT NULL AND label = 'spoof'""",
)


@query("AGG19", sql(_summary_select() + "bg_s", "bg_s"))
def agg19(spark, sf):
    s = scores(spark, sf)
    fams = P.family_list(s, "attack_family")
    return _out(P.summarize(P.with_slices(s, [P.group_slice("language", "language")], [P.shared_bona_slices("attack_family", "family", fams)])))


SEEN = ["fam0", "fam1"]
summary_cte(
    "lg",
    f"""SELECT 'logo' AS protocol, f AS slice, s.label, s.score, s.p_spoof FROM scores s, ({FAM} UNION ALL SELECT unnest(['ALL_SEEN', 'ALL_UNSEEN'])) WHERE s.label = 'bona_fide'
    UNION ALL SELECT 'logo', attack_family, {BASE} WHERE label = 'spoof' AND attack_family IS NOT NULL
    UNION ALL SELECT 'logo', CASE WHEN attack_family IN ('fam0', 'fam1') THEN 'ALL_SEEN' ELSE 'ALL_UNSEEN' END, {BASE} WHERE label = 'spoof'""",
)


@query("AGG20", sql(_summary_select(", slice IN ('fam0', 'fam1') AS seen_in_training") + "lg_s", "lg_s"))
def agg20(spark, sf):
    s = scores(spark, sf)
    t = P.with_slices(s, [], [P.shared_bona_slices("attack_family", "logo", P.family_list(s, "attack_family"), SEEN)])
    return _out(P.summarize(t), F.col("slice").isin(*SEEN).alias("seen_in_training"))


summary_cte("cd", f"SELECT 'cross_dataset' AS protocol, coalesce(dataset, 'unknown') AS slice, {BASE}")


@query(
    "AGG21",
    sql(
        _summary_select(
            ", slice IN ('ds0') AS in_domain, round(round_even(eer - (SELECT avg(eer) FROM cd_s WHERE slice IN ('ds0')), 4), 6) + 0.0 AS eer_minus_in_domain"
        )
        + "cd_s",
        "cd_s",
    ),
)
def agg21(spark, sf):
    rows = P.summarize(P.with_slices(scores(spark, sf), [P.group_slice("dataset", "cross_dataset")]))
    return _out(P.cross_dataset(rows, ["ds0"]), "in_domain", r6(F.col("eer_minus_in_domain")).alias("eer_minus_in_domain"))


SNR_SQL = """CASE WHEN snr_db IS NULL THEN 'clean/unknown' WHEN snr_db < 0 THEN '[-inf,0) dB' WHEN snr_db < 5 THEN '[0,5) dB' WHEN snr_db < 10 THEN '[5,10) dB'
  WHEN snr_db < 15 THEN '[10,15) dB' WHEN snr_db < 20 THEN '[15,20) dB' WHEN snr_db < 30 THEN '[20,30) dB' ELSE '[30,inf) dB' END"""
ATTR = f"""SELECT 'language' AS protocol, coalesce(language, 'unknown') AS slice, {BASE} UNION ALL SELECT 'accent', coalesce(accent, 'unknown'), {BASE}
 UNION ALL SELECT 'codec', coalesce(codec, 'unknown'), {BASE} UNION ALL SELECT 'snr', {SNR_SQL}, {BASE}
 UNION ALL SELECT 'adversarial', coalesce(condition, 'unknown'), {BASE}"""
summary_cte("at", ATTR)


def _attr_keys():
    return [P.group_slice("language", "language"), P.group_slice("accent", "accent"), P.group_slice("codec", "codec"), P.snr_slice(), P.group_slice("condition", "adversarial")]


@query("AGG22", sql(_summary_select() + "at_s", "at_s"))
def agg22(spark, sf):
    return _out(P.summarize(P.with_slices(scores(spark, sf), _attr_keys())))


@query("FN31", sql(f"SELECT {SNR_SQL} AS snr_bin, count(*) AS n FROM scores GROUP BY 1", "scores"))
def fn31(spark, sf):
    from sonorisk.functions.math import snr_bin

    return scores(spark, sf).groupBy(snr_bin(F.col("snr_db")).alias("snr_bin")).agg(F.count(F.lit(1)).alias("n"))


summary_cte("cn", f"SELECT 'adversarial' AS protocol, coalesce(condition, 'unknown') AS slice, {BASE}")


@query(
    "JON20",
    sql(
        """SELECT slice, round(a.eer, 6) AS eer, round(round_even(a.eer - r.eer, 4), 6) + 0.0 AS eer_minus_clean FROM cn_s a LEFT JOIN
        (SELECT slice AS ref, eer FROM cn_s WHERE slice LIKE 'clean%') r ON r.ref = CASE WHEN a.slice LIKE 'clean%' THEN NULL
        WHEN a.slice IN ('pgd_linf', 'universal_filter') THEN 'clean_3s_crop' ELSE 'clean' END""",
        "cn_s",
    ),
)
def jon20(spark, sf):
    rows = P.summarize(P.with_slices(scores(spark, sf), [P.group_slice("condition", "adversarial")]))
    return P.against_clean(rows).select("slice", r6(F.col("eer")).alias("eer"), r6(F.col("eer_minus_clean")).alias("eer_minus_clean"))


summary_cte(
    "run",
    f"""SELECT 'overall' AS protocol, 'all' AS slice, {BASE} UNION ALL {ATTR} UNION ALL SELECT 'cross_dataset', coalesce(dataset, 'unknown'), {BASE}
    UNION ALL SELECT protocol, slice, label, score, p_spoof FROM lg_t""",
)
cte("run_t", f"""SELECT 'overall' AS protocol, 'all' AS slice, {BASE} UNION ALL {ATTR} UNION ALL SELECT 'cross_dataset', coalesce(dataset, 'unknown'), {BASE}
    UNION ALL SELECT protocol, slice, label, score, p_spoof FROM lg_t""", "scores", "lg_t")


def evaluation_rows(spark, sf):
    """All protocols in one curve pass."""
    s = scores(spark, sf)
    keys = [P.overall_slice(), *_attr_keys(), P.group_slice("dataset", "cross_dataset")]
    return P.summarize(P.with_slices(s, keys, [P.shared_bona_slices("attack_family", "logo", P.family_list(s, "attack_family"), SEEN)]))


@query("JOB14", sql(_summary_select() + "run_s", "run_s"))
def job14(spark, sf):
    return _out(evaluation_rows(spark, sf))


# ---- calls with window arrays -----------------------------------------------------------------

cte(
    "calls",
    """SELECT l_orderkey AS utt_id, CASE WHEN l_orderkey % 3 = 0 THEN 'spoof' ELSE 'bona_fide' END AS label,
    list(CASE WHEN l_partkey % 50 <> 0 THEN CAST((l_orderkey * 7919 + l_linenumber * 131 + l_partkey * 17) % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE) END
         ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS ws FROM lineitem GROUP BY 1""",
)


def calls(spark, sf):
    """One call per order with its ordered window probabilities (an order has a few line items)."""
    li = table(spark, sf, "lineitem")
    p = F.when(F.col("l_partkey") % 50 != 0, (F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 131 + F.col("l_partkey") * 17) % 1000 / F.lit(1000.0))
    g = li.groupBy(F.col("l_orderkey").alias("utt_id")).agg(
        F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", p.alias("p")))).alias("_w")
    )
    return g.select("utt_id", F.when(F.col("utt_id") % 3 == 0, "spoof").otherwise("bona_fide").alias("label"), F.col("_w.p").alias("window_scores"))


TTFA = "CASE WHEN len(list_filter(ws, lambda x: x >= 0.8)) > 0 THEN 3.0 + (list_position(list_transform(ws, lambda x: coalesce(x >= 0.8, false)), true) - 1) END"
FIN = "list_filter(ws, lambda x: x IS NOT NULL)"
FLIPS = f"len(list_filter(range(1, len({FIN})), lambda i: ({FIN}[i] >= 0.8) <> ({FIN}[i + 1] >= 0.8)))"
STD = f"CASE WHEN len({FIN}) >= 2 THEN sqrt(list_sum(list_transform({FIN}, lambda x: (x - list_avg({FIN})) * (x - list_avg({FIN})))) / len({FIN})) END"
FPM = f"CASE WHEN len({FIN}) >= 2 THEN {FLIPS} / (len({FIN}) / 60.0) END"


@query("WIN07", sql(f"SELECT utt_id, {TTFA} AS seconds_to_alert FROM calls", "calls"))
def win07(spark, sf):
    return calls(spark, sf).select("utt_id", P.time_to_first_alert(F.col("window_scores"), F.lit(0.8)).alias("seconds_to_alert"))


@query("WIN08", sql(f"SELECT utt_id, {_r(STD, 'std')}, {_r(FPM, 'flips_per_min')} FROM calls", "calls"))
def win08(spark, sf):
    s, f = P.score_stability(F.col("window_scores"), F.lit(0.8))
    return calls(spark, sf).select("utt_id", r6(s).alias("std"), r6(f).alias("flips_per_min"))


@query(
    "AGG23",
    sql(
        f"""SELECT label, count(*) AS n_calls, round(round_even(avg(CASE WHEN t IS NOT NULL THEN 1.0 ELSE 0.0 END), 4), 6) AS alerted_fraction,
        round(quantile_cont(t, 0.5), 6) AS median_s, round(quantile_cont(t, 0.9), 6) AS p90_s, round(avg(sd), 6) AS mean_window_std, round(avg(fl), 6) AS mean_flips_per_min
        FROM (SELECT label, CAST({TTFA} AS DOUBLE) AS t, {STD} AS sd, {FPM} AS fl FROM calls) GROUP BY 1""",
        "calls",
    ),
)
def agg23(spark, sf):
    o = P.operational(calls(spark, sf), F.lit(0.8))
    return o.select("label", "n_calls", *[r6(F.col(c)).alias(c) for c in ("alerted_fraction", "median_s", "p90_s", "mean_window_std", "mean_flips_per_min")])


@query(
    "AGG47",
    sql(f"SELECT utt_id, round(-list_avg({FIN}), 6) + 0.0 AS score FROM calls", "calls"),
)
def agg47(spark, sf):
    p = P.scored_windows(F.col("window_scores"))
    mean = F.aggregate(p, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(p), F.lit(0))
    return calls(spark, sf).select("utt_id", r6(-mean).alias("score"))


cte("win_long", "SELECT utt_id, label, -p AS score FROM (SELECT utt_id, label, unnest(ws) AS p FROM calls) WHERE p IS NOT NULL", "calls")
cte("win_curve", curve_cte("win_long", []).replace("GROUP BY ALL", ""), "win_long")


@query("JOB15", sql(f"SELECT round(-({THR_SQL}), 6) + 0.0 AS alert_threshold, {_r(EER_SQL, 'window_eer')} FROM win_curve", "win_curve"))
def job15(spark, sf):
    w = calls(spark, sf).select("label", F.explode("window_scores").alias("score")).withColumn("score", -F.col("score"))
    m = curves.curve_metrics(curves.detection_curve(w, []), [])
    return m.select(r6(-F.col("eer_threshold")).alias("alert_threshold"), r6(F.col("eer")).alias("window_eer"))


# ---- fairness ---------------------------------------------------------------------------------

FPR_T = 1100.0
cte(
    "fpr_groups",
    f"""SELECT attribute, grp, count(*) AS n_bona, count(*) FILTER (score <= {FPR_T}) AS flagged, count(*) FILTER (score <= {FPR_T}) / count(*) AS fpr FROM (
    SELECT 'gender' AS attribute, coalesce(gender, 'unknown') AS grp, score FROM scores WHERE label = 'bona_fide' AND score IS NOT NULL
    UNION ALL SELECT 'language', coalesce(language, 'unknown'), score FROM scores WHERE label = 'bona_fide' AND score IS NOT NULL) GROUP BY 1, 2""",
    "scores",
)
_WC = "(fpr + 1.96 * 1.96 / (2 * n_bona)) / (1 + 1.96 * 1.96 / n_bona)"
_WH = "1.96 * sqrt(fpr * (1 - fpr) / n_bona + 1.96 * 1.96 / (4.0 * n_bona * n_bona)) / (1 + 1.96 * 1.96 / n_bona)"


@query(
    "AGG24",
    sql(
        f"""SELECT attribute, grp AS "group", n_bona, flagged, round(fpr, 6) AS fpr, round(greatest(0.0, {_WC} - {_WH}), 6) AS ci_low, round(least(1.0, {_WC} + {_WH}), 6) AS ci_high FROM fpr_groups""",
        "fpr_groups",
    ),
)
def agg24(spark, sf):
    g = fairness.fpr_by(scores(spark, sf), ["gender", "language"], F.lit(FPR_T))
    return g.select("attribute", "group", "n_bona", "flagged", *[r6(F.col(c)).alias(c) for c in ("fpr", "ci_low", "ci_high")])


@query(
    "AGG25",
    sql(
        """SELECT cfg, status, round(worst_gap, 6) + 0.0 AS worst_gap FROM (
        SELECT 'unset' AS cfg, 'not_configured' AS status, max(g) AS worst_gap FROM x UNION ALL
        SELECT 'strict', CASE WHEN max(g) > 0.0001 THEN 'fail' WHEN min(n) < 30 THEN 'insufficient_data' ELSE 'pass' END, max(g) FROM x UNION ALL
        SELECT 'small', CASE WHEN max(g) > 0.5 THEN 'fail' WHEN min(n) < 1000000000 THEN 'insufficient_data' ELSE 'pass' END, max(g) FROM x UNION ALL
        SELECT 'loose', CASE WHEN max(g) > 0.5 THEN 'fail' WHEN min(n) < 30 THEN 'insufficient_data' ELSE 'pass' END, max(g) FROM x)""",
        "fpr_groups",
    ).replace("FROM x", "FROM (SELECT attribute, max(fpr) - min(fpr) AS g, min(n_bona) AS n FROM fpr_groups GROUP BY 1)"),
)
def agg25(spark, sf):
    gaps = fairness.gap_and_ratio(fairness.fpr_by(scores(spark, sf), ["gender", "language"], F.lit(FPR_T)))
    runs = [("unset", None, 30), ("strict", 0.0001, 30), ("small", 0.5, 1_000_000_000), ("loose", 0.5, 30)]
    out = None
    for name, gap, n in runs:
        row = fairness.gate(gaps, gap, n).select(F.lit(name).alias("cfg"), "status", r6(F.col("worst_gap")).alias("worst_gap"))
        out = row if out is None else out.unionByName(row)
    return out


@query(
    "AGG26",
    sql(
        """SELECT coalesce(language, 'unknown') AS language, count(*) FILTER (label = 'bona_fide') AS n_bona_fide, count(*) FILTER (label = 'spoof') AS n_spoof,
        round(avg(CASE WHEN label = 'bona_fide' THEN CAST(p_spoof >= 0.5 AS INT) END), 6) AS fpr, round(avg(CASE WHEN label = 'spoof' THEN CAST(p_spoof < 0.5 AS INT) END), 6) AS miss_rate
        FROM scores WHERE p_spoof IS NOT NULL GROUP BY 1""",
        "scores",
    ),
)
def agg26(spark, sf):
    s = scores(spark, sf).filter(F.col("p_spoof").isNotNull())
    r = fairness.per_language_rates(s, F.col("language"), "p_spoof", F.col("label") == "spoof")
    return r.select("language", "n_bona_fide", "n_spoof", r6(F.col("fpr")).alias("fpr"), r6(F.col("miss_rate")).alias("miss_rate"))


@query(
    "FN07",
    sql(
        """SELECT user_id, k, n, round(greatest(0.0, c - h), 6) + 0.0 AS lo, round(least(1.0, c + h), 6) AS hi FROM (
        SELECT *, (p + 3.8416 / (2 * n)) / (1 + 3.8416 / n) AS c, 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4.0 * n * n)) / (1 + 3.8416 / n) AS h FROM (
        SELECT user_id, count(*) FILTER (event_type = 'error') AS k, count(*) AS n, count(*) FILTER (event_type = 'error') / count(*) AS p FROM events GROUP BY 1))"""
    ),
)
def fn07(spark, sf):
    g = events(spark, sf).groupBy("user_id").agg(F.sum((F.col("event_type") == "error").cast("long")).alias("k"), F.count(F.lit(1)).alias("n"))
    lo, hi = wilson(F.col("k"), F.col("n"))
    return g.select("user_id", "k", "n", r6(lo).alias("lo"), r6(hi).alias("hi"))


# ---- drift ------------------------------------------------------------------------------------

REF_DAY = 1_705_276_800_000_000  # 2024-01-15: rows before it are the reference sample
cte(
    "psi_t",
    f"""SELECT head_id, count(*) FILTER (ts_us < {REF_DAY}) AS r, count(*) FILTER (ts_us >= {REF_DAY}) AS c, least(CAST(floor(p_spoof * 20) AS INT), 19) AS b
    FROM head_scores WHERE p_spoof IS NOT NULL GROUP BY head_id, b""",
    "head_scores",
)
cte(
    "psi_r",
    """SELECT head_id, any_value(nr) AS n_ref, any_value(nc) AS n_current, sum((c / nc + 1e-4 - (r / nr + 1e-4)) * ln((c / nc + 1e-4) / (r / nr + 1e-4))) AS psi
    FROM (SELECT *, sum(r) OVER (PARTITION BY head_id) AS nr, sum(c) OVER (PARTITION BY head_id) AS nc FROM psi_t) GROUP BY 1""",
    "psi_t",
)
cte(
    "ks_r",
    f"""SELECT head_id, max(abs(cr / tr - cc / tc)) AS ks FROM (SELECT head_id, sum(r) OVER w AS cr, sum(c) OVER w AS cc, sum(r) OVER p AS tr, sum(c) OVER p AS tc FROM (
    SELECT head_id, p_spoof, count(*) FILTER (ts_us < {REF_DAY}) AS r, count(*) FILTER (ts_us >= {REF_DAY}) AS c FROM head_scores WHERE p_spoof IS NOT NULL GROUP BY 1, 2)
    WINDOW w AS (PARTITION BY head_id ORDER BY p_spoof), p AS (PARTITION BY head_id)) GROUP BY 1""",
    "head_scores",
)
LEVEL = "CASE WHEN n_ref = 0 OR n_current < 500 THEN 'insufficient_data' WHEN psi > 0.25 THEN 'shifted' WHEN psi > 0.1 THEN 'watch' ELSE 'stable' END"


def _is_ref():
    return F.col("ts_us") < REF_DAY


@query("AGG29", sql(f"SELECT head_id, n_ref, n_current, {_r('psi', 'psi')} FROM psi_r", "psi_r"))
def agg29(spark, sf):
    return drift.psi(head_scores(spark, sf), ["head_id"], "p_spoof", _is_ref()).withColumn("psi", r6(F.col("psi")))


@query("AGG30", sql(f"SELECT head_id, {_r('ks', 'ks')} FROM ks_r", "ks_r"))
def agg30(spark, sf):
    return curves.ks_statistic(head_scores(spark, sf), ["head_id"], "p_spoof", _is_ref()).withColumn("ks", r6(F.col("ks")))


@query(
    "AGG31",
    sql(f"SELECT head_id, n_ref, n_current, {LEVEL} AS level, round(CASE WHEN {LEVEL} <> 'insufficient_data' THEN psi END, 6) + 0.0 AS psi, round(CASE WHEN {LEVEL} <> 'insufficient_data' THEN ks END, 6) + 0.0 AS ks FROM psi_r JOIN ks_r USING (head_id)", "psi_r", "ks_r"),
)
def agg31(spark, sf):
    r = drift.drift_report(head_scores(spark, sf), ["head_id"], "p_spoof", _is_ref())
    return r.select("head_id", "n_ref", "n_current", "level", r6(F.col("psi")).alias("psi"), r6(F.col("ks")).alias("ks"))


@query(
    "WIN12",
    sql("SELECT head_id, session_id, window_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY head_id ORDER BY event_id DESC) AS rn FROM head_scores WHERE p_spoof IS NOT NULL) WHERE rn <= 5000", "head_scores"),
)
def win12(spark, sf):
    h = head_scores(spark, sf).filter(F.col("p_spoof").isNotNull())
    return drift.last_n(h, ["head_id"], [F.col("event_id").desc()], 5000).select("head_id", "session_id", "window_id", "event_id")


@query(
    "AGG44",
    sql(
        f"""SELECT dataset, gender, {_r('e', 'elevated')}, {_r('h', 'high')}, round((SELECT count(*) FILTER (p_spoof >= e) / count(*) FROM scores s WHERE s.dataset = t.dataset AND s.gender = t.gender AND label = 'bona_fide' AND p_spoof IS NOT NULL), 6) AS fpr_elevated,
        round((SELECT count(*) FILTER (p_spoof >= e) / count(*) FROM scores s WHERE s.dataset = t.dataset AND s.gender = t.gender AND label = 'spoof' AND p_spoof IS NOT NULL), 6) AS tpr_elevated,
        round(50000 * (SELECT count(*) FILTER (p_spoof >= e) / count(*) FROM scores s WHERE s.dataset = t.dataset AND s.gender = t.gender AND label = 'bona_fide' AND p_spoof IS NOT NULL), 4) AS flagged_per_day
        FROM (SELECT dataset, gender, e, greatest(h0, e + 1e-6) AS h FROM (SELECT dataset, gender, {_HIGH.format(f='0.01')} AS e, {_HIGH.format(f='0.001')} AS h0 FROM curve_p GROUP BY 1, 2)) t""",
        "curve_p",
    ),
)
def agg44(spark, sf):
    c = _curve(spark, sf, "p_spoof")
    e = curves.threshold_high_side(c, SLICE, 0.01, "e")
    h = curves.threshold_high_side(c, SLICE, 0.001, "h0")
    th = e.join(h, SLICE).withColumn("h", F.greatest(F.col("h0"), F.col("e") + 1e-6))
    s = scores(spark, sf).filter(F.col("p_spoof").isNotNull()).join(th, SLICE)
    bona, spoof = F.col("label") == "bona_fide", F.col("label") == "spoof"
    flag = (F.col("p_spoof") >= F.col("e")).cast("double")
    g = s.groupBy(*SLICE).agg(F.max("e").alias("elevated"), F.max("h").alias("high"), F.avg(F.when(bona, flag)).alias("fpr_elevated"), F.avg(F.when(spoof, flag)).alias("tpr_elevated"))
    return g.select(*SLICE, *[r6(F.col(x)).alias(x) for x in ("elevated", "high", "fpr_elevated", "tpr_elevated")], r6(F.col("fpr_elevated") * 50000, 4).alias("flagged_per_day"))
