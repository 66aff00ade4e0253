"""Queries: session smoothing, states, drivers, decision points."""

from pyspark.sql import functions as F

from sonorisk.functions.math import r6
from sonorisk.operators import temporal as TP
from sonorisk.plans.fixtures import cte, head_scores, logit_sql, sigmoid_sql, sql
from sonorisk.plans.q_fusion import fused
from sonorisk.plans.registry import query

_LLR = f"greatest(-6.0, least(6.0, {logit_sql('p')}))"
cte("fw", "SELECT session_id, window_id, event_id, ts_us, event_type, CASE WHEN n_present > 0 THEN p_fused END AS p FROM fused", "fused")
cte(
    "seg",
    f"""SELECT session_id, window_id, CASE WHEN count(*) OVER w = 3 THEN 1 / (1 + exp(-(ln(0.1 / 0.9) + 0.6 * sum({_LLR}) OVER w))) END AS p_segment, avg(p) OVER w AS mean_p
    FROM fw WHERE p IS NOT NULL WINDOW w AS (PARTITION BY session_id ORDER BY window_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""",
    "fw",
)
cte(
    "pre",
    """SELECT fw.session_id, fw.window_id, fw.p, coalesce(max(seg.p_segment) OVER w, 0.0) AS smax, greatest(coalesce(max(seg.mean_p) OVER w, 0.0), coalesce(avg(fw.p) OVER w, 0.0)) AS mmax, count(fw.p) OVER w AS n_scored, (count(*) OVER w - count(fw.p) OVER w) / count(*) OVER w AS ratio
    FROM fw LEFT JOIN seg USING (session_id, window_id) WINDOW w AS (PARTITION BY fw.session_id ORDER BY fw.window_id)""",
    "seg",
)


def _lo(prev: str, p: str) -> str:
    """SQL of the next log-odds: transition, then clipped evidence of a scored window."""
    ph = f"(1 / (1 + exp(-({prev}))))"
    pt = f"({ph} * 0.98 + (1 - {ph}) * 0.02)"
    llr = f"greatest(-6.0, least(6.0, {logit_sql(p)}))"
    return f"CASE WHEN {p} IS NULL THEN ln({pt} / (1 - {pt})) ELSE greatest(-30.0, least(30.0, ln({pt} / (1 - {pt})) + 0.6 * {llr})) END"


_RAW = lambda x: f"CASE WHEN {x} >= 0.7 THEN 2 WHEN {x} >= 0.4 THEN 1 ELSE 0 END"
_STEP = f"""CASE WHEN n_scored < 2 OR ratio > 0.7 THEN [-1, 0] WHEN st = -1 OR ({_RAW('ps')}) > st THEN [{_RAW('ps')}, 0] WHEN ({_RAW('ps')}) = st THEN [st, 0]
  WHEN ps < (CASE st WHEN 2 THEN 0.7 ELSE 0.4 END) - 0.05 THEN CASE WHEN below + 1 >= 3 THEN [{_RAW('ps + 0.05')}, 0] ELSE [st, below + 1] END ELSE [st, 0] END"""
_COLS = "session_id, window_id, p, smax, n_scored, ratio, lo"
_WRAP = f"SELECT {_COLS}, p_hmm, ps, s[1] AS st, s[2] AS below FROM (SELECT *, {_STEP} AS s FROM (SELECT {_COLS}, 1 / (1 + exp(-lo)) AS p_hmm, greatest(1 / (1 + exp(-lo)), smax) AS ps, st, below FROM (@)))"
_FIRST = f"SELECT *, {_lo('ln(0.02 / 0.98)', 'p')} AS lo, -1 AS st, 0 AS below FROM pre WHERE window_id = 0"
_NEXT = f"SELECT pre.*, {_lo('r.lo', 'pre.p')} AS lo, r.st, r.below FROM r JOIN pre ON pre.session_id = r.session_id AND pre.window_id = r.window_id + 1"
REC = f"r AS ({_WRAP.replace('@', _FIRST)} UNION ALL {_WRAP.replace('@', _NEXT)})"


def rec_sql(body: str, *names: str) -> str:
    s = sql("@@", *(names or ("pre",)))
    return s.replace("WITH ", "WITH RECURSIVE ", 1).replace("@@", f", {REC}\n{body}")


STATE = "CASE st WHEN 2 THEN 'HIGH' WHEN 1 THEN 'ELEVATED' WHEN 0 THEN 'LOW' ELSE 'ABSTAIN' END"


def timeline(spark, sf):
    return TP.session_timeline(fused(spark, sf))


@query("WIN03", sql("SELECT session_id, round(coalesce(max(p_segment), 0.0), 6) AS segment_max, first(window_id ORDER BY p_segment DESC, window_id) FILTER (p_segment IS NOT NULL) AS segment_window, round(max(mean_p), 6) AS segment_mean_max FROM seg GROUP BY 1", "seg"))
def win03(spark, sf):
    s = TP.segment_peak(TP.segment_evidence(fused(spark, sf)))
    return s.select("session_id", r6(F.col("segment_max")).alias("segment_max"), "segment_window", r6(F.col("segment_mean_max")).alias("segment_mean_max"))


@query("WIN04", rec_sql("SELECT r.session_id, r.window_id, round(p_hmm, 6) AS p_hmm, round(ps, 6) AS p_session, round(mmax, 6) AS p_mean_max FROM r JOIN pre USING (session_id, window_id)"))
def win04(spark, sf):
    return timeline(spark, sf).select("session_id", "window_id", r6(F.col("p_hmm")).alias("p_hmm"), r6(F.col("p_session")).alias("p_session"), r6(F.col("p_mean_max")).alias("p_mean_max"))


@query("WIN05", rec_sql(f"SELECT session_id, window_id, {STATE} AS state FROM r"))
def win05(spark, sf):
    return timeline(spark, sf).select("session_id", "window_id", "state")


@query("WIN06", rec_sql("SELECT session_id, count(*) FILTER (pst IS NOT NULL AND pst <> st) AS changes, round(CASE WHEN count(*) < 2 THEN 0.0 ELSE count(*) FILTER (pst IS NOT NULL AND pst <> st) / (count(*) / 60.0) END, 6) AS changes_per_min FROM (SELECT *, lag(st) OVER (PARTITION BY session_id ORDER BY window_id) AS pst FROM r) GROUP BY 1"))
def win06(spark, sf):
    s = TP.state_changes_per_minute(timeline(spark, sf))
    return s.select("session_id", "changes", r6(F.col("changes_per_min")).alias("changes_per_min"))


@query(
    "TOP01",
    rec_sql(
        """SELECT session_id, rank, factor, round(round_even(v, 3), 6) AS weight, direction FROM (
        SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY v DESC, factor DESC) AS rank, factor, v / sum(v) OVER (PARTITION BY session_id) AS v, CASE WHEN net > 0 THEN 'towards synthetic' ELSE 'towards genuine' END AS direction FROM (
          SELECT session_id, 'synthetic_speech_ssl' AS factor, sum(abs(s_a)) AS v, sum(s_a) AS net FROM fused GROUP BY 1 UNION ALL SELECT session_id, 'dsp_artifacts_and_scene', sum(abs(s_b)), sum(s_b) FROM fused GROUP BY 1
          UNION ALL SELECT session_id, 'prosody', sum(abs(s_c)), sum(s_c) FROM fused GROUP BY 1) WHERE v IS NOT NULL) WHERE rank <= 3
        UNION ALL SELECT l.session_id, 4, 'any_segment_trigger', round(round_even(l.smax, 3), 6), 'window ' || k.segment_window FROM (SELECT session_id, max(window_id) AS window_id FROM r GROUP BY 1) z JOIN r l USING (session_id, window_id)
        JOIN (SELECT session_id, first(window_id ORDER BY p_segment DESC, window_id) FILTER (p_segment IS NOT NULL) AS segment_window FROM seg GROUP BY 1) k ON k.session_id = l.session_id WHERE l.smax > l.p_hmm AND l.smax >= 0.4""",
        "pre", "fused",
    ),
)
def top01(spark, sf):
    f = fused(spark, sf)
    d = TP.risk_drivers(f, TP.final_rows(TP.session_timeline(f)))
    return d.withColumn("weight", r6(F.col("weight")))


@query(
    "FLT15",
    rec_sql(
        f"""SELECT session_id, window_id, {STATE} AS state, reason FROM (SELECT session_id, window_id, st, CASE WHEN (pst IS NULL OR pst <> st) AND st IN (1, 2) THEN 'state' WHEN window_id // 20 <> coalesce(plab, 0) THEN 'labels'
        WHEN window_id = max(window_id) OVER (PARTITION BY session_id) THEN 'close' END AS reason FROM (SELECT *, lag(st) OVER (PARTITION BY session_id ORDER BY window_id) AS pst, lag(window_id // 20) OVER (PARTITION BY session_id ORDER BY window_id) AS plab FROM r)) WHERE reason IS NOT NULL"""
    ),
)
def flt15(spark, sf):
    t = timeline(spark, sf)
    lab = F.when(F.floor(F.col("window_id") / 20) > 0, F.floor(F.col("window_id") / 20).cast("string")).otherwise("")
    return TP.decision_events(t, lab).select("session_id", "window_id", "state", "reason")


@query(
    "WIN20",
    sql("SELECT session_id, window_id, head_id, previous_version, model_version FROM (SELECT *, lag(model_version) OVER (PARTITION BY session_id, head_id ORDER BY window_id) AS previous_version FROM head_scores) WHERE previous_version <> model_version", "head_scores"),
)
def win20(spark, sf):
    return TP.version_changes(head_scores(spark, sf)).select("session_id", "window_id", "head_id", "previous_version", "model_version")


@query("FN05", sql("SELECT session_id, window_id, CASE WHEN p IS NULL THEN 'ABSTAIN' WHEN p >= 0.7 THEN 'HIGH' WHEN p >= 0.4 THEN 'ELEVATED' ELSE 'LOW' END AS window_state FROM fw", "fw"))
def fn05(spark, sf):
    from sonorisk.operators.fusion import band

    return fused(spark, sf).select("session_id", "window_id", band(F.col("p_fused")).alias("window_state"))


@query("SRC10", rec_sql(f"SELECT session_id, window_id, round(p, 6) AS p_window, round(ps, 6) AS p_session, {STATE} AS state, CAST(round_even(100 * ps, 0) AS BIGINT) AS risk_score FROM r WHERE session_id % 10 = 3"))
def src10(spark, sf):
    from sonorisk.scale import shared_path
    from sonorisk.sources.timeline import append_timeline, read_session

    root = shared_path(spark, "timeline")
    t = timeline(spark, sf).withColumn("ts_us", F.col("window_id") * 1_000_000 + 1_704_067_200_000_000)
    append_timeline(t, root)
    out = read_session(spark, root, F.col("session_id") % 10 == 3)
    return out.select("session_id", "window_id", r6(F.col("p_window")).alias("p_window"), r6(F.col("p_session")).alias("p_session"), "state", "risk_score")
