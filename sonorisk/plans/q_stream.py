"""Queries: streaming operators run to completion over the event table, and their batch forms."""

from pyspark.sql import functions as F

from sonorisk.functions.math import r6
from sonorisk.operators import temporal as TP
from sonorisk.plans.fixtures import cte, events, head_scores, sql, table, windows
from sonorisk.plans.q_fusion import fused
from sonorisk.plans.q_policy import _ROUTE_SQL, SUBS
from sonorisk.plans.q_session import STATE, rec_sql
from sonorisk.plans.q_signal import challenges, responses
from sonorisk.plans.q_text import WIN11_SQL, _seg_sql, segments
from sonorisk.plans.registry import ORACLES, query
from sonorisk.scale import literal_table, shared_path
from sonorisk.streaming import jobs as J, processors as PR



cte("chn", "SELECT *, lead(issued_us) OVER (PARTITION BY session_id ORDER BY issued_us, challenge_id) AS nxt FROM ch2", "ch2")


STR03_SQL = sql(
        """SELECT session_id, window_id, head_id, coalesce(abstain OR latency_ms > 380, true) AS abstain, CASE WHEN abstain IS NULL OR latency_ms > 380 THEN 'timeout' ELSE abstain_reason END AS abstain_reason FROM (SELECT session_id, window_id, h AS head_id FROM windows, (VALUES ('A'), ('B'), ('C'), ('D')) v(h)) w
        LEFT JOIN (SELECT * FROM head_scores WHERE (event_id + latency_ms) % 13 <> 0) s USING (session_id, window_id, head_id)""",
        "head_scores",
    )


def _topic(spark, df, order, parts=3):
    path = shared_path(spark, "topic")
    J.publish(df, path, order, parts)
    return J.subscribe(spark, path, df.schema, files_per_trigger=8)



_FAR_MS = 400 * 86_400_000


def session_stream(spark, sf):
    """Raw head scores in: the windows' heads are fused by a streaming aggregate, its rows go through the session operator."""
    h = head_scores(spark, sf).select(F.col("session_id").cast("long").alias("session_id"), F.col("window_id").cast("long").alias("window_id"), "head_id", "p_spoof", "abstain", "ts_us")
    heads = J.event_topic(h, F.timestamp_micros("ts_us"), "session_id", settle_ms=_FAR_MS + 86_400_000)
    return J.run_available(J.session_risk(heads, idle_ms=_FAR_MS), "risk")


@query("STR04", rec_sql(f"SELECT session_id, window_id, round(ps, 6) AS p_session, {STATE} AS state FROM r"))
def str04(spark, sf):
    t = session_stream(spark, sf).filter("rank is null")
    return t.select("session_id", "window_id", r6(F.col("p_session")).alias("p_session"), "state")


@query("STR04_drivers", ORACLES["TOP01"])
def str04_drivers(spark, sf):
    """What drove each session, from the accumulators in the session operator's state."""
    d = session_stream(spark, sf).filter("rank is not null")
    return d.select("session_id", "rank", "factor", r6(F.bround("weight", 3)).alias("weight"), "direction")


@query(
    "STR06",
    rec_sql(
        f"""SELECT session_id, window_id, {STATE} AS state, reason FROM (SELECT session_id, window_id, st, CASE WHEN (pst IS NULL OR pst <> st) AND st IN (1, 2) THEN 'state' WHEN window_id // 20 <> coalesce(plab, 0) THEN 'labels'
        WHEN window_id = max(window_id) OVER (PARTITION BY session_id) THEN 'close' END AS reason FROM (SELECT *, lag(st) OVER (PARTITION BY session_id ORDER BY window_id) AS pst, lag(window_id // 20) OVER (PARTITION BY session_id ORDER BY window_id) AS plab FROM r)) WHERE reason IS NOT NULL"""
    ),
)
def str06(spark, sf):
    t = TP.session_timeline(fused(spark, sf)).select("session_id", "window_id", "state")
    lab = F.floor(F.col("window_id") / 20)
    t = t.withColumn("labels", F.when(lab > 0, lab.cast("string")).otherwise(""))
    return J.drain_in_order(t, F.timestamp_seconds(F.col("window_id") + 86_400), "session_id", PR.DecisionProcessor(), "session_id long, window_id long, state string, reason string", "decisions")


@query("STR01")
def str01(spark, sf):
    w = windows(spark, sf)
    # packets swap places, some are missing and some arrive twice
    seq = F.col("window_id") + F.when(F.col("window_id") % 5 == 3, -2).otherwise(0)
    p = w.select("session_id", seq.alias("seq"), F.col("window_id").alias("arrival")).filter("arrival % 11 <> 4")
    return J.drain_in_order(p, F.timestamp_seconds(F.col("arrival") + 86_400), "session_id", PR.ReorderProcessor(), "session_id long, seq long, kind string", "frames")


@query("STR07", WIN11_SQL.replace("{segments}", _seg_sql()).replace("last_end - 12000", "last_end - 120000").replace("SELECT a.session_id, a.start_ms, a.end_ms,", "SELECT a.session_id, a.start_ms,"))
def str07(spark, sf):
    g = segments(spark, sf).filter("final").select("session_id", "start_ms", "end_ms", "text")
    return J.drain_in_order(g, F.timestamp_millis(F.col("start_ms") + 86_400_000), "session_id", PR.TranscriptProcessor(), "session_id long, start_ms long, accepted boolean, n_held long", "transcript")


def _walk_sql(first: str, step: str, out: str) -> str:
    """Recursive walk over each session's windows in order."""
    return sql("@@", "windows").replace("WITH ", "WITH RECURSIVE ", 1).replace(
        "@@", f", r AS (SELECT session_id, window_id, event_id, ts_us, {first} FROM windows WHERE window_id = 0 UNION ALL SELECT w.session_id, w.window_id, w.event_id, w.ts_us, {step} FROM r JOIN windows w ON w.session_id = r.session_id AND w.window_id = r.window_id + 1)\n{out}"
    )


@query(
    "STR08",
    _walk_sql("ts_us AS last_us, true AS go", "CASE WHEN w.ts_us - r.last_us >= 10000000 THEN w.ts_us ELSE r.last_us END, w.ts_us - r.last_us >= 10000000", "SELECT session_id, event_id FROM r WHERE go"),
)
def str08(spark, sf):
    e = events(spark, sf).select(F.col("user_id").alias("session_id"), "ts_us", "event_id")
    return J.drain_in_order(e, F.timestamp_micros("ts_us"), "session_id", PR.EnrichmentProcessor(), "session_id long, event_id long", "enrich")


_REFILL = "least(CAST(5 AS DOUBLE), r.tokens - CASE WHEN r.tokens >= 1 THEN 1 ELSE 0 END + (w.ts_us - r.ts_us) / 1e6 / 3600)"


@query("STR13", _walk_sql("CAST(5 AS DOUBLE) AS tokens", _REFILL, "SELECT session_id AS key_id, count(*) FILTER (tokens >= 1) AS allowed, count(*) FILTER (tokens < 1) AS refused FROM r GROUP BY 1"))
def str13(spark, sf):
    e = events(spark, sf).select(F.col("user_id").alias("key_id"), "ts_us", "event_id")
    r = J.drain_in_order(e, F.timestamp_micros("ts_us"), "key_id", PR.TokenBucketProcessor(), "key_id long, event_id long, allowed boolean", "rate")
    return r.groupBy("key_id").agg(F.sum(F.col("allowed").cast("long")).alias("allowed"), F.sum((~F.col("allowed")).cast("long")).alias("refused"))


@query("STR14", "SELECT ref, event_id, coalesce(t - put <= 30000000, false) AS found FROM (SELECT user_id % 20 AS ref, event_id, epoch_us(ts) AS t, max(CASE WHEN event_id % 3 = 0 THEN epoch_us(ts) END) OVER (PARTITION BY user_id % 20 ORDER BY ts, event_id) AS put FROM events) WHERE event_id % 3 <> 0")
def str14(spark, sf):
    e = events(spark, sf).select((F.col("user_id") % 20).alias("ref"), "ts_us", "event_id", F.when(F.col("event_id") % 3 == 0, "put").otherwise("get").alias("op"))
    return J.drain_in_order(e, F.timestamp_micros("ts_us"), "ref", PR.ShortReferenceProcessor(), "ref long, event_id long, found boolean", "refs")


@query(
    "STR15",
    sql(
        """SELECT c.session_id, c.challenge_id, CASE WHEN nxt <= answered_us THEN 'not_active' WHEN answered_us - issued_us <= 30000000 THEN 'answered' ELSE 'late' END AS outcome FROM chn c JOIN re2 r USING (session_id, challenge_id)
        UNION ALL SELECT c.session_id, c.challenge_id, CASE WHEN nxt - issued_us <= 30000000 THEN 'replaced' ELSE 'expired' END FROM chn c LEFT JOIN re2 r USING (session_id, challenge_id) WHERE nxt IS NOT NULL AND NOT coalesce(answered_us < nxt, false)""",
        "chn", "re2",
    ),
)
def str15(spark, sf):
    c = challenges(spark, sf).select("session_id", F.col("issued_us").alias("ts_us"), F.lit("issue").alias("kind"), "challenge_id")
    r = responses(spark, sf).select("session_id", F.col("answered_us").alias("ts_us"), F.lit("answer").alias("kind"), "challenge_id")
    return J.drain_in_order(c.unionByName(r), F.timestamp_micros("ts_us"), "session_id", PR.ChallengeProcessor(), "session_id long, challenge_id long, outcome string", "challenges")


@query(
    "STR09",
    """SELECT event_type, count(*) AS n_all, count(*) FILTER (NOT late) AS n_kept, count(*) FILTER (late) AS n_late FROM (SELECT event_type, coalesce(t < max(t) OVER (ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 3600000000, false) AS late
    FROM (SELECT event_type, epoch_us(ts) AS t, event_id + CASE WHEN event_id % 50 = 0 THEN 5000000 ELSE 0 END AS o FROM events)) GROUP BY 1""",
)
def str09(spark, sf):
    """Rows behind an hour's delay when they arrive; every fiftieth row comes long after the others."""
    e = events(spark, sf).select("event_id", "event_type", "ts_us", F.when(F.col("event_id") % 50 == 0, F.col("event_id") + 5_000_000).otherwise(F.col("event_id")).alias("arrival"))
    e = e.withColumn("run", F.floor(F.col("arrival") / 10_000))
    stream = J.event_topic(e, F.timestamp_seconds(F.col("arrival") + 86_400), "run")  # in order of arrival
    return J.count_late(J.run_available(J.late_rows(stream), "late"), 3_600_000_000)


_WEEK, _SINCE, _QUIET = 604_800_000, 1_705_276_800_000, 21_600_000
_SHARE = "({0} / greatest(n_{1}, 1e-12) + 1e-4)"
_C, _R = _SHARE.format("c", "current"), _SHARE.format("r", "ref")
_DRIFT = "CASE WHEN n_ref = 0 OR n_current < 100 THEN 'insufficient_data' WHEN psi > 0.25 THEN 'shifted' WHEN psi > 0.1 THEN 'watch' ELSE 'stable' END"
cte("quiet_w", f"SELECT *, sum(CASE WHEN ms - before < {_QUIET} THEN 0 ELSE 1 END) OVER (PARTITION BY session_id ORDER BY window_id) AS g FROM (SELECT session_id, window_id, p, ts_us // 1000 AS ms, lag(ts_us // 1000) OVER (PARTITION BY session_id ORDER BY window_id) AS before FROM fw)", "fw")
cte("quiet_s", f"SELECT session_id, g, max(ms) + {_QUIET} AS closed FROM quiet_w GROUP BY ALL HAVING bool_and(coalesce(p < 0.4, true))", "quiet_w")
cte("drift_d", f"SELECT head_id, round(p_spoof, 6) AS p, (closed // {_WEEK} + 1) * {_WEEK} AS as_of, count(*) FILTER (closed < {_SINCE}) AS r, count(*) FILTER (closed >= {_SINCE}) AS c FROM quiet_s JOIN quiet_w USING (session_id, g) JOIN head_scores h USING (session_id, window_id) WHERE p_spoof IS NOT NULL GROUP BY ALL", "quiet_s", "head_scores")
cte("drift_c", "SELECT b.head_id, b.as_of, p, sum(r)::BIGINT AS r, sum(c)::BIGINT AS c FROM (SELECT DISTINCT head_id, as_of FROM drift_d) b JOIN drift_d d ON b.head_id = d.head_id AND d.as_of <= b.as_of GROUP BY ALL", "drift_d")
cte("drift_n", "SELECT head_id, as_of, sum(r)::BIGINT AS n_ref, sum(c)::BIGINT AS n_current FROM drift_c GROUP BY ALL", "drift_c")
cte("drift_p", f"SELECT head_id, as_of, sum(({_C} - {_R}) * ln({_C} / {_R})) AS psi FROM (SELECT head_id, as_of, least(CAST(floor(p * 20) AS INT), 19) AS bin, sum(r) AS r, sum(c) AS c FROM drift_c GROUP BY ALL) JOIN drift_n USING (head_id, as_of) GROUP BY ALL", "drift_n")
cte("drift_k", "SELECT head_id, as_of, max(abs(cr / nullif(n_ref, 0) - cc / nullif(n_current, 0))) AS ks FROM (SELECT head_id, as_of, sum(r) OVER w AS cr, sum(c) OVER w AS cc FROM drift_c WINDOW w AS (PARTITION BY head_id, as_of ORDER BY p)) JOIN drift_n USING (head_id, as_of) GROUP BY ALL", "drift_n")


@query(
    "STR12",
    sql(f"SELECT head_id, as_of AS as_of_ms, n_ref, n_current, level, CASE WHEN level <> 'insufficient_data' THEN round(psi, 6) + 0.0 END AS psi, CASE WHEN level <> 'insufficient_data' THEN round(ks, 6) + 0.0 END AS ks FROM (SELECT *, {_DRIFT} AS level FROM drift_n JOIN drift_p USING (head_id, as_of) JOIN drift_k USING (head_id, as_of))", "drift_p", "drift_k"),
)
def str12(spark, sf):
    """Weekly drift of each head over sessions that closed and never left LOW, against those that closed before the 15th."""
    from sonorisk.operators.drift import drift_from_counts

    h = head_scores(spark, sf).select(F.col("session_id").cast("long").alias("session_id"), F.col("window_id").cast("long").alias("window_id"), "head_id", "p_spoof", "abstain", "ts_us")
    heads = J.event_topic(h, F.timestamp_micros("ts_us"), "session_id", settle_ms=2 * _WEEK)
    d = J.run_available(J.drift_counts(heads, ("A", "B", "C"), _SINCE, _WEEK, _QUIET), "drift")
    ends = d.select(F.col("head_id").alias("h"), F.col("as_of_ms").alias("end_ms")).distinct()  # a row for a head and week
    upto = d.join(ends, (d.head_id == ends.h) & (d.as_of_ms <= ends.end_ms)).select("head_id", F.col("end_ms").alias("as_of_ms"), "score", "n_ref", "n_current")
    r = drift_from_counts(upto, ["head_id", "as_of_ms"], "score", min_samples=100)
    return r.select("head_id", "as_of_ms", "n_ref", "n_current", "level", r6(F.col("psi")).alias("psi"), r6(F.col("ks")).alias("ks"))


@query("STR03_stream", STR03_SQL)
def str03_stream(spark, sf):
    s = head_scores(spark, sf).filter((F.col("event_id") + F.col("latency_ms")) % 13 != 0).select("session_id", "window_id", "head_id", "abstain", "abstain_reason", "ts_us", "latency_ms")
    w = J.event_topic(windows(spark, sf).select("session_id", "window_id", "ts_us"), F.timestamp_micros("ts_us"), "session_id")
    scored = J.event_topic(s, F.timestamp_micros(F.col("ts_us") + F.col("latency_ms") * 1000), "session_id")
    return J.run_available(J.assemble_stream(w, scored, ("A", "B", "C", "D"), 380), "heads")


@query("JON25_stream", ORACLES["JON25"])
def jon25_stream(spark, sf):
    issued = J.event_topic(challenges(spark, sf), F.timestamp_micros("issued_us"), "session_id")
    answered = J.event_topic(responses(spark, sf), F.timestamp_micros("answered_us"), "session_id")
    return J.run_available(J.answers_stream(issued, answered), "answers")


@query(
    "STR11_alerts",
    """SELECT event_type, min(e) AS pending_ms, min(e) + 3600000 AS fired_ms, max(e) AS ended_ms, max(n) AS peak FROM (
    SELECT *, e - 1800000 * row_number() OVER (PARTITION BY event_type ORDER BY e) AS run FROM (SELECT event_type, epoch_ms(s) + 3600000 AS e, count(*) AS n FROM (
      SELECT event_type, unnest([time_bucket(INTERVAL '30 minutes', ts), time_bucket(INTERVAL '30 minutes', ts) - INTERVAL '30 minutes']) AS s FROM events) GROUP BY ALL HAVING count(*) >= 4)) GROUP BY event_type, run HAVING max(e) - min(e) >= 3600000""",
)
def str11_alerts(spark, sf):
    e = events(spark, sf).select("event_type", "event_id", "ts_us")
    return J.run_available(J.alerts(J.event_topic(e, F.timestamp_micros("ts_us"), "event_type"), 4, "1 hour", 1_800_000, 3_600_000), "alerts")


@query("SRC12", "SELECT event_type, count(*) AS n FROM events WHERE user_id % 5 = 2 GROUP BY 1")
def src12(spark, sf):
    e = events(spark, sf).select("event_id", "event_type", "ts_us", (F.col("user_id") % 5).cast("string").alias("tenant_id"))
    path = shared_path(spark, "bus")
    J.publish(e, path, "ts_us")
    s = J.subscribe(spark, path, e.schema, 1, tenant="2")
    return J.run_available(s, "bus").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("SRC16", _ROUTE_SQL)
def src16(spark, sf):
    from sonorisk.operators.policy import route_events

    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("tenant_id"))
    e = table(spark, sf, "orders").join(c, "o_custkey").select("tenant_id", F.col("o_orderkey").alias("event_id"), F.col("o_orderstatus").alias("event_type"))
    subs = literal_table(spark, SUBS, "subscription_id string, tenant_id string, event_types array<string>")
    s = route_events(_topic(spark, e, "event_id"), subs).select("event_id", "subscription_id")
    return J.run_available(s, "routed")


# ---- batch forms with exact SQL ---------------------------------------------------------------


@query("STR02", "SELECT session_id, window_id, window_id * 1000 AS start_ms, window_id * 1000 + 3000 AS end_ms, count(*) AS n FROM (SELECT user_id AS session_id, unnest(range(greatest(ms // 1000 - 2, 0), ms // 1000 + 1)) AS window_id FROM (SELECT user_id, (epoch_us(ts) // 1000) % 600000 AS ms FROM events)) GROUP BY 1, 2")
def str02(spark, sf):
    f = events(spark, sf).select(F.col("user_id").alias("session_id"), (F.floor(F.col("ts_us") / 1000) % 600_000).alias("ms"))
    return J.sliding_windows(f, "ms")


@query("STR03", STR03_SQL)
def str03(spark, sf):
    s = head_scores(spark, sf).filter((F.col("event_id") + F.col("latency_ms")) % 13 != 0)
    return J.assemble_heads(windows(spark, sf), s, ("A", "B", "C", "D"), budget_ms=380).select("session_id", "window_id", "head_id", "abstain", "abstain_reason")


_GAP = "SELECT user_id, t, sum(CASE WHEN p IS NULL OR t - p >= 21600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t, event_id) AS g FROM (SELECT user_id, event_id, epoch_us(ts) AS t, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)"


@query("STR05", f"SELECT user_id, min(t) AS start_us, max(t) + 21600000000 AS end_us, count(*) AS n FROM ({_GAP}) GROUP BY user_id, g")
def str05(spark, sf):
    e = table(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("at"))
    s = J.idle_sessions(e, "at", "user_id", "6 hours")
    return s.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


@query("STR10", "SELECT event_id, CASE WHEN event_id = f THEN 'created' WHEN t = o THEN 'repeat' ELSE 'rejected' END AS outcome FROM (SELECT event_id, user_id % 3 AS t, min(event_id) OVER (PARTITION BY s) AS f, arg_min(user_id % 3, event_id) OVER (PARTITION BY s) AS o FROM (SELECT *, event_id % 700 AS s FROM events))")
def str10(spark, sf):
    c = table(spark, sf, "events").select((F.col("event_id") % 700).alias("sid"), (F.col("user_id") % 3).alias("tenant_id"), "event_id")
    return J.first_sessions(c, "sid", F.col("event_id")).select("event_id", "outcome")


@query("STR11", "SELECT epoch_us(s) AS start_us, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL '30 minutes', ts), time_bucket(INTERVAL '30 minutes', ts) - INTERVAL '30 minutes']) AS s FROM events) GROUP BY 1, 2")
def str11(spark, sf):
    e = table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("at"), "event_type")
    return J.windowed_counts(e, "at", ["event_type"], "1 hour", "30 minutes").select(F.unix_micros("start").alias("start_us"), "event_type", "n")


@query(
    "STR16",
    """SELECT user_id AS session_id, arg_max(event_id, event_id) FILTER (event_type = 'click') AS risk, arg_max(event_id, event_id) FILTER (event_type = 'signup') AS context, arg_max(event_id, event_id) FILTER (event_type = 'error') AS decision,
    count(*) FILTER (event_type = 'error') AS n_decisions, count(*) FILTER (event_type = 'view') AS n_windows, max(event_id) AS last_seq FROM events GROUP BY 1""",
)
def str16(spark, sf):
    names = {"click": "session_risk", "signup": "context_signals", "error": "policy_decision", "view": "window_score"}
    t = F.col("event_type")
    for k, v in names.items():
        t = F.when(F.col("event_type") == k, v).otherwise(t)
    e = table(spark, sf, "events").select(F.col("user_id").alias("session_id"), t.alias("event_type"), F.col("event_id").alias("seq"), F.col("event_id").alias("payload"))
    return J.call_view(e)


@query("STR05_stream", ORACLES["STR05"])
def str05_stream(spark, sf):
    e = events(spark, sf).select("user_id", "ts_us")
    t = J.event_topic(e, F.timestamp_micros("ts_us"), "user_id")
    s = J.run_available(J.idle_sessions(t, "at", "user_id", "6 hours"), "sessions")
    return s.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


_TTL = 172_800_000


@query(
    "STR10_stream",
    f"""WITH RECURSIVE o AS (SELECT event_id, event_id % 700 AS sid, user_id % 3 AS t, epoch_us(ts) // 1000 AS ms, row_number() OVER (PARTITION BY event_id % 700 ORDER BY epoch_us(ts) // 1000, event_id) AS k FROM events),
    r AS (SELECT event_id, sid, k, t AS owner, ms AS since, 'created' AS outcome FROM o WHERE k = 1
    UNION ALL SELECT o.event_id, o.sid, o.k, CASE WHEN o.ms - since >= {_TTL} THEN o.t ELSE owner END, CASE WHEN o.ms - since >= {_TTL} THEN o.ms ELSE since END, CASE WHEN o.ms - since >= {_TTL} THEN 'created' WHEN o.t = owner THEN 'repeat' ELSE 'rejected' END
    FROM r JOIN o ON o.sid = r.sid AND o.k = r.k + 1) SELECT event_id, outcome FROM r""",
)
def str10_stream(spark, sf):
    """Creates of session ids that may be reused two days after they were taken."""
    c = events(spark, sf).select((F.col("event_id") % 700).alias("sid"), (F.col("user_id") % 3).alias("tenant_id"), "event_id", "ts_us")
    return J.drain_in_order(c, F.timestamp_micros("ts_us"), "sid", PR.OwnerProcessor(_TTL), "event_id long, outcome string", "owners")


@query("STR16_stream", ORACLES["STR16"])
def str16_stream(spark, sf):
    names = F.create_map(*[F.lit(x) for kv in (("click", "session_risk"), ("signup", "context_signals"), ("error", "policy_decision"), ("view", "window_score")) for x in kv])
    e = events(spark, sf).select(F.col("user_id").alias("session_id"), F.coalesce(names[F.col("event_type")], F.col("event_type")).alias("event_type"), F.col("event_id").alias("seq"), F.col("event_id").alias("payload"), "ts_us")
    fields = "session_id long, risk long, context long, decision long, n_decisions long, n_windows long, last_seq long"
    return J.drain_in_order(e, F.timestamp_micros("ts_us"), "session_id", PR.CallViewProcessor(_FAR_MS), fields, "views", settle_ms=_FAR_MS + 86_400_000)


@query("SRC11", rec_sql("SELECT window_id // 7 AS week, count(*) AS n, round(max(ps), 6) AS p_max FROM r WHERE window_id BETWEEN 7 AND 20 GROUP BY 1"))
def src11(spark, sf):
    from sonorisk.sources.timeline import append_timeline, read_session

    path = shared_path(spark, "timeline")
    t = TP.session_timeline(fused(spark, sf)).withColumn("ts_us", F.col("window_id") * 86_400_000_000)
    append_timeline(t, path, buckets=1)
    r = read_session(spark, path, F.lit(True), ("1970-01-08", "1970-01-21"))
    return r.groupBy(F.floor(F.col("window_id") / 7).alias("week")).agg(F.count(F.lit(1)).alias("n"), r6(F.max("p_session")).alias("p_max"))
