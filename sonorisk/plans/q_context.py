"""Queries: metadata and transaction risk, as-of context, combined risk."""

from pyspark.sql import functions as F

from sonorisk.functions import text as X
from sonorisk.functions.math import final_risk, half_even, noisy_or, r6
from sonorisk.operators import context as C
from sonorisk.plans.fixtures import cte, events, micros, re4, sql, table
from sonorisk.plans.q_text import WEIGHT_SQL, segments, session_text
from sonorisk.plans.registry import query
from sonorisk.scale import literal_table

REPUTATION = [("t1", 0.7), ("as3", 0.55), ("t4", 0.3)]
ROUTES = [("t2",), ("as4",)]

cte(
    "mcalls",
    """SELECT event_id AS session_id, CASE WHEN event_type = 'signup' THEN 'outbound' ELSE 'inbound' END AS direction,
    CASE WHEN event_id % 29 = 0 THEN '' WHEN event_id % 3 = 0 THEN '98765' ELSE '+9198765' END || CASE WHEN event_id % 29 = 0 THEN '' ELSE lpad(CAST(user_id % 8 AS VARCHAR), 5, '0') END AS caller_number,
    CASE WHEN event_id % 4 <> 0 THEN 'id' || (event_id % 12) END AS claimed_identity_id, 't' || (event_id % 7) AS trunk_id, 'as' || (event_id % 5) AS source_asn,
    CASE WHEN event_id % 6 = 0 THEN '<sip:+4420@x>' WHEN event_id % 6 = 1 THEN '<sip:+9198@x>' END AS pai, epoch_us(ts) // 1000000 AS started_s, ts AS started_at FROM events""",
)
cte("registered", "SELECT DISTINCT 'id' || (user_id % 10) AS identity, '98765' || lpad(CAST(user_id % 8 AS VARCHAR), 5, '0') AS number FROM events WHERE user_id % 3 = 0")
cte("mkey", "SELECT *, right(regexp_replace(caller_number, '\\D', '', 'g'), 10) AS k FROM mcalls", "mcalls")
cte(
    "mprior",
    """SELECT *, k <> '' AND started_s = min(started_s) OVER (PARTITION BY k) AS first_call,
    CASE WHEN k = '' THEN 0 ELSE count(*) OVER (PARTITION BY k ORDER BY started_s RANGE BETWEEN 3600 PRECEDING AND 1 PRECEDING) END AS recent FROM mkey""",
    "mkey",
)
cte(
    "mflags",
    """SELECT p.*, (claimed_identity_id IN (SELECT identity FROM registered)) IS TRUE AND k <> '' AND NOT EXISTS (SELECT 1 FROM registered r WHERE r.identity = p.claimed_identity_id AND r.number = p.k) AS mismatch,
    greatest(CASE trunk_id WHEN 't1' THEN 0.7 WHEN 't4' THEN 0.3 ELSE 0.0 END, CASE source_asn WHEN 'as3' THEN 0.55 ELSE 0.0 END) AS rep,
    trunk_id = 't2' OR source_asn = 'as4' AS intl,
    (isodow(ts_l) - 1 NOT IN (0, 1, 2, 3, 4, 5)) OR hour(ts_l) < 9 OR hour(ts_l) >= 19 AS off_hours
    FROM (SELECT *, started_at + INTERVAL '5 hours 30 minutes' AS ts_l FROM mprior) p""",
    "mprior", "registered",
)
SIGS = {
    "first_time_caller": ("direction = 'inbound' AND first_call", 0.15),
    "cli_mismatch": ("mismatch", 0.45),
    "international_spoofed_cli": ("starts_with(caller_number, '+91') AND (intl OR (coalesce(pai, '') <> '' AND NOT contains(pai, '+91') AND contains(pai, '+')))", 0.6),
    "bad_trunk_reputation": ("rep >= 0.5", 0.4),
    "off_hours": ("off_hours", 0.15),
    "high_velocity": ("recent >= 3", 0.35),
}
_MET = "1 - " + " * ".join(f"(1 - CASE WHEN {c} THEN CAST({w} AS DOUBLE) ELSE CAST(0 AS DOUBLE) END)" for c, w in SIGS.values())
cte(
    "mrisk",
    f"SELECT session_id, array_to_string(list_filter([{', '.join(f'CASE WHEN {c} THEN {chr(39)}{k}{chr(39)} END' for k, (c, _) in SIGS.items())}], lambda x: x IS NOT NULL), ',') AS signals, {re4(_MET)} AS metadata_risk FROM mflags",
    "mflags",
)


def mcalls(spark, sf):
    e = events(spark, sf)
    n = F.lpad((F.col("user_id") % 8).cast("string"), 5, "0")
    i = F.col("event_id")
    s = lambda v: v.cast("string")
    return e.select(
        i.alias("session_id"),
        F.when(F.col("event_type") == "signup", "outbound").otherwise("inbound").alias("direction"),
        F.when(i % 29 == 0, "").when(i % 3 == 0, F.concat(F.lit("98765"), n)).otherwise(F.concat(F.lit("+9198765"), n)).alias("caller_number"),
        F.when(i % 4 != 0, F.concat(F.lit("id"), s(i % 12))).alias("claimed_identity_id"),
        F.concat(F.lit("t"), s(i % 7)).alias("trunk_id"),
        F.concat(F.lit("as"), s(i % 5)).alias("source_asn"),
        F.when(i % 6 == 0, "<sip:+4420@x>").when(i % 6 == 1, "<sip:+9198@x>").alias("pai"),
        F.floor(F.col("ts_us") / 1_000_000).alias("started_s"),
        F.col("ts").alias("started_at"),
    )


def registered(spark, sf):
    e = table(spark, sf, "events").filter("user_id % 3 = 0")
    return e.select(
        F.concat(F.lit("id"), (F.col("user_id") % 10).cast("string")).alias("identity"),
        F.concat(F.lit("98765"), F.lpad((F.col("user_id") % 8).cast("string"), 5, "0")).alias("number"),
    ).distinct()


def meta(spark, sf):
    return C.metadata_risk(
        mcalls(spark, sf), registered(spark, sf), literal_table(spark, REPUTATION, "route string, score double"), literal_table(spark, ROUTES, "route string")
    )


def keyed(spark, sf):
    return mcalls(spark, sf).withColumn("number_key", C.number_key(F.col("caller_number")))


@query("WIN10", sql("SELECT session_id, first_call, recent AS calls_last_hour FROM mprior", "mprior"))
def win10(spark, sf):
    return C.prior_calls(keyed(spark, sf)).select("session_id", "first_call", "calls_last_hour")


@query("JON02", sql("SELECT session_id, mismatch AS cli_mismatch FROM mflags", "mflags"))
def jon02(spark, sf):
    return C.cli_mismatch(keyed(spark, sf), registered(spark, sf)).select("session_id", "cli_mismatch")


@query("JON03", sql("SELECT session_id, CAST(rep AS DOUBLE) AS route_reputation FROM mflags", "mflags"))
def jon03(spark, sf):
    return C.route_reputation(mcalls(spark, sf), literal_table(spark, REPUTATION, "route string, score double")).select("session_id", "route_reputation")


@query("JON04", sql("SELECT session_id, intl AS via_international FROM mflags", "mflags"))
def jon04(spark, sf):
    return C.international_route(mcalls(spark, sf), literal_table(spark, ROUTES, "route string")).select("session_id", "via_international")


@query("FN28", sql("SELECT session_id, off_hours FROM mflags", "mflags"))
def fn28(spark, sf):
    return mcalls(spark, sf).select("session_id", C.off_hours(F.col("started_at")).alias("off_hours"))


@query("JOB11", sql("SELECT session_id, signals, metadata_risk FROM mrisk", "mrisk"))
def job11(spark, sf):
    return meta(spark, sf).select("session_id", F.array_join("signals", ",").alias("signals"), "metadata_risk")


@query("AGG37", "SELECT event_id, " + re4("1 - (1 - CASE WHEN event_id % 2 = 0 THEN CAST(0.15 AS DOUBLE) ELSE 0 END) * (1 - CASE WHEN event_id % 3 = 0 THEN CAST(0.45 AS DOUBLE) ELSE 0 END) * (1 - CASE WHEN user_id % 5 = 0 THEN CAST(0.6 AS DOUBLE) ELSE 0 END)") + " AS risk FROM events")
def agg37(spark, sf):
    w = [F.when(F.col("event_id") % 2 == 0, 0.15), F.when(F.col("event_id") % 3 == 0, 0.45), F.when(F.col("user_id") % 5 == 0, 0.6)]
    return table(spark, sf, "events").select("event_id", half_even(noisy_or(w)).alias("risk"))


# ---- transactions -----------------------------------------------------------------------------

CUT = "1998-01-01"
HIGH_VALUE = 400_000.0
cte("obene", "SELECT o.*, b.bene FROM orders o LEFT JOIN (SELECT l_orderkey, min(l_suppkey) AS bene FROM lineitem GROUP BY 1) b ON b.l_orderkey = o.o_orderkey")
cte("ohist", f"SELECT * FROM obene WHERE o_orderdate < TIMESTAMP '{CUT}'", "obene")
cte(
    "oprof",
    """SELECT h.o_custkey, any_value(n) AS n, any_value(med) AS med, any_value(p95) AS p95, max(o_totalprice) >= 400000 AS big, quantile_cont(abs(o_totalprice - med), 0.5) * 1.4826 AS mad0
    FROM ohist h JOIN (SELECT o_custkey, count(*) AS n, quantile_cont(o_totalprice, 0.5) AS med, quantile_cont(o_totalprice, 0.95) AS p95 FROM ohist GROUP BY 1) q ON q.o_custkey = h.o_custkey GROUP BY 1""",
    "ohist",
)
cte("oprof2", "SELECT o_custkey, n, med, p95, big, CASE WHEN mad0 <> 0 THEN mad0 ELSE greatest(med * 0.1, 1.0) END AS mad FROM oprof", "oprof")
cte(
    "otx",
    f"""SELECT o.o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'limit_increase' WHEN '5-LOW' THEN 'balance_inquiry' ELSE 'transfer' END AS kind,
    CASE WHEN o_orderpriority = '5-LOW' THEN CAST(0 AS DOUBLE) ELSE o_totalprice * CASE WHEN o.o_orderkey % 13 = 0 THEN 5 ELSE 1 END END AS amount,
    CASE WHEN o_orderpriority <> '5-LOW' THEN bene END AS bene, epoch_us(o_orderdate) AS req_us,
    CASE WHEN o.o_orderkey % 50 = 0 THEN epoch_us(o_orderdate) - 3600000000 ELSE added END AS added_us, p.n, p.med, p.mad, p.p95, p.big, p.o_custkey IS NOT NULL AS has_profile
    FROM obene o LEFT JOIN oprof2 p ON p.o_custkey = o.o_custkey
    LEFT JOIN (SELECT o_custkey AS c, bene AS b, min(epoch_us(o_orderdate)) AS added FROM ohist WHERE bene IS NOT NULL GROUP BY 1, 2) f ON f.c = o.o_custkey AND f.b = o.bene WHERE o_orderdate >= TIMESTAMP '{CUT}'""",
    "oprof2",
)
_Z = "(amount - med) / mad"
TSIG = {
    "privileged_request": "CASE WHEN kind = 'limit_increase' THEN CAST(0.5 AS DOUBLE) END",
    "unusual_amount": f"CASE WHEN amount > 0 AND coalesce(n, 0) >= 5 AND ({_Z} > 6 OR amount > 3 * p95) THEN least(CAST(0.6 AS DOUBLE), CAST(0.2 AS DOUBLE) + CAST(0.05 AS DOUBLE) * least({_Z}, CAST(8 AS DOUBLE))) END",
    "no_history": "CASE WHEN amount > 0 AND coalesce(n, 0) < 5 THEN CAST(0.15 AS DOUBLE) END",
    "first_high_value": "CASE WHEN amount > 0 AND has_profile AND amount >= 400000 AND NOT coalesce(big, false) THEN CAST(0.35 AS DOUBLE) END",
    "new_beneficiary": "CASE WHEN bene IS NOT NULL AND added_us IS NULL THEN CAST(0.45 AS DOUBLE) END",
    "recent_beneficiary": "CASE WHEN bene IS NOT NULL AND req_us - added_us < 86400000000 THEN CAST(0.35 AS DOUBLE) END",
}
_TR = re4("1 - " + " * ".join(f"(1 - coalesce({v}, 0))" for v in TSIG.values()))
cte(
    "trisk",
    f"""SELECT *, CASE WHEN (has_profile AND amount >= 400000) OR kind = 'limit_increase' OR transaction_risk >= 0.5 THEN 'high' WHEN amount > 0 THEN 'medium' ELSE 'low' END AS tier FROM (
    SELECT *, {_TR} AS transaction_risk, array_to_string(list_filter([{', '.join(f'CASE WHEN ({v}) IS NOT NULL THEN {chr(39)}{k}{chr(39)} END' for k, v in TSIG.items())}], lambda x: x IS NOT NULL), ',') AS signals FROM otx)""",
    "otx",
)


def orders_bene(spark, sf):
    o = table(spark, sf, "orders")
    b = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_suppkey").alias("bene"))
    return o.join(b, "o_orderkey", "left").withColumn("req_us", micros("o_orderdate"))


def _history(o):
    return o.filter(F.col("o_orderdate") < F.lit(CUT).cast("timestamp_ntz"))


def profile(spark, sf):
    h = _history(table(spark, sf, "orders")).select(F.col("o_custkey").alias("customer_id"), F.col("o_totalprice").alias("amount"))
    return C.amount_profile(h, HIGH_VALUE)


def tx(spark, sf):
    o = orders_bene(spark, sf)
    added = _history(o).filter("bene is not null").groupBy("o_custkey", "bene").agg(F.min("req_us").alias("added"))
    p = profile(spark, sf).withColumn("has_profile", F.lit(True)).withColumnRenamed("customer_id", "o_custkey")
    pending = o.filter(F.col("o_orderdate") >= F.lit(CUT).cast("timestamp_ntz"))
    j = pending.join(p, "o_custkey", "left").join(added, ["o_custkey", "bene"], "left")
    low = F.col("o_orderpriority") == "5-LOW"
    t = j.select(
        "o_orderkey",
        F.when(F.col("o_orderpriority") == "1-URGENT", "limit_increase").when(low, "balance_inquiry").otherwise("transfer").alias("kind"),
        F.when(low, 0.0).otherwise(F.col("o_totalprice") * F.when(F.col("o_orderkey") % 13 == 0, 5).otherwise(1)).alias("amount"),
        F.when(~low, F.col("bene")).alias("beneficiary_id"),
        F.col("req_us").alias("requested_us"),
        F.when(F.col("o_orderkey") % 50 == 0, F.col("req_us") - 3_600_000_000).otherwise(F.col("added")).alias("added_us"),
        "has_profile", "n", "med", "mad", "p95", "had_high_value",
    )
    return C.transaction_risk(t, HIGH_VALUE)


@query("AGG39", sql("SELECT o_custkey AS customer_id, n, round(med, 6) AS med, round(mad, 6) AS mad, round(p95, 6) AS p95, big AS had_high_value FROM oprof2", "oprof2"))
def agg39(spark, sf):
    return profile(spark, sf).select("customer_id", "n", *[r6(F.col(c)).alias(c) for c in ("med", "mad", "p95")], "had_high_value")


@query("JON05", sql("SELECT o_orderkey, bene IS NOT NULL AND added_us IS NULL AS first_use, coalesce(bene IS NOT NULL AND req_us - added_us < 86400000000, false) AS recent FROM otx", "otx"))
def jon05(spark, sf):
    t = tx(spark, sf)
    return t.select("o_orderkey", F.array_contains("tx_signals", "new_beneficiary").alias("first_use"), F.array_contains("tx_signals", "recent_beneficiary").alias("recent"))


@query("JOB12", sql("SELECT o_orderkey, signals, transaction_risk, tier FROM trisk", "trisk"))
def job12(spark, sf):
    return tx(spark, sf).select("o_orderkey", F.array_join("tx_signals", ",").alias("signals"), "transaction_risk", "tier")


@query("FN06", sql("SELECT tier, count(*) AS n, min(transaction_risk) AS lo, max(transaction_risk) AS hi FROM trisk GROUP BY 1", "trisk"))
def fn06(spark, sf):
    return tx(spark, sf).groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.min("transaction_risk").alias("lo"), F.max("transaction_risk").alias("hi"))


# ---- as-of context ----------------------------------------------------------------------------


@query(
    "JON11",
    """SELECT d.event_id, c.event_id AS context_id, c.value AS intent_risk FROM events d ASOF LEFT JOIN (SELECT * FROM events WHERE event_type IN ('view', 'click')) c
    ON d.user_id = c.user_id AND d.ts >= c.ts WHERE d.event_type = 'error'""",
)
def jon11(spark, sf):
    e = events(spark, sf).select(F.col("user_id").alias("session_id"), "ts_us", F.col("event_id").alias("seq"), "event_id", "value", "event_type")
    ctx = e.filter(F.col("event_type").isin("view", "click")).select("session_id", "ts_us", "seq", F.col("event_id").alias("context_id"), F.col("value").alias("intent_risk"))
    dec = e.filter("event_type = 'error'").select("session_id", "ts_us", "seq", "event_id")
    return C.latest_context(dec, ctx, ["context_id", "intent_risk"]).select("event_id", "context_id", "intent_risk")


FINAL_SQL = """(1 - (1 - least(CAST(1 AS DOUBLE), (1 - (1 - voice) * (1 - mism) * (1 - intent) * (1 - CAST(0.6 AS DOUBLE) * mrisk)) * CASE tier WHEN 'low' THEN CAST(0.8 AS DOUBLE) WHEN 'high' THEN CAST(1.25 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END)) * (1 - CAST(0.5 AS DOUBLE) * trisk))"""


@query(
    "FN04",
    f"""SELECT event_id, round({FINAL_SQL}, 6) AS final_risk FROM (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(event_id * 37 % 101 AS DOUBLE) / 100 END AS voice,
    CASE WHEN event_id % 5 = 0 THEN CAST(event_id * 11 % 100 AS DOUBLE) / 100 ELSE 0 END AS mism, CAST(event_id * 53 % 90 AS DOUBLE) / 100 AS intent, CAST(event_id * 29 % 80 AS DOUBLE) / 100 AS mrisk,
    CAST(event_id * 17 % 70 AS DOUBLE) / 100 AS trisk, ['low', 'medium', 'high'][event_id % 3 + 1] AS tier FROM events)""",
)
def fn04(spark, sf):
    i = F.col("event_id")
    f = final_risk(
        F.when(i % 4 == 0, "ABSTAIN").otherwise("LOW"), i * 37 % 101, F.when(i % 5 == 0, i * 11 % 100 / 100.0), i * 53 % 90 / 100.0, i * 29 % 80 / 100.0, i * 17 % 70 / 100.0,
        F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), (i % 3 + 1).cast("int")),
    )
    return table(spark, sf, "events").select("event_id", r6(f["final"]).alias("final_risk"))


def context_report(spark, sf):
    """One row per session: language, intent, metadata and transaction risk and tier."""
    t = session_text(spark, sf).withColumn("h", X.intent_hits(F.col("text")))
    t = t.withColumns({"intent_risk": X.intent_risk_from_hits(F.col("h")), "labels": F.array_sort(F.col("h.label")), "hint": F.lit(None).cast("string")})
    lang = X.detect_language(t, "text", "hint").select("session_id", "intent_risk", "labels", "language", "code_switched")
    m = meta(spark, sf).select("session_id", "metadata_risk")
    x = tx(spark, sf).select(F.col("o_orderkey").alias("session_id"), "transaction_risk", "tier")
    last = segments(spark, sf).groupBy("session_id").agg(F.max("end_ms").alias("as_of_ms"))
    j = lang.join(m, "session_id", "left").join(x, "session_id", "left").join(last, "session_id")
    return j.withColumns(
        {"metadata_risk": F.coalesce("metadata_risk", F.lit(0.0)), "transaction_risk": F.coalesce("transaction_risk", F.lit(0.0)), "tier": F.coalesce("tier", F.lit("low"))}
    )


@query(
    "JOB13",
    sql(
        f"""SELECT s.session_id, coalesce(i.labels, '') AS labels, coalesce(i.risk, 0.0) AS intent_risk, coalesce(m.metadata_risk, 0.0) AS metadata_risk, coalesce(t.transaction_risk, 0.0) AS transaction_risk, coalesce(t.tier, 'low') AS tier, s.as_of_ms
        FROM (SELECT session_id, max(end_ms) AS as_of_ms FROM segments GROUP BY 1) s LEFT JOIN (SELECT session_id, string_agg(label, ',' ORDER BY label) AS labels, {re4(f'1 - product(1 - CAST({WEIGHT_SQL} AS DOUBLE) * 0.8) * CASE WHEN count(*) >= 3 THEN 0.5 ELSE 1.0 END')} AS risk
        FROM seg_hits WHERE evidence IS NOT NULL GROUP BY 1) i ON i.session_id = s.session_id LEFT JOIN mrisk m ON m.session_id = s.session_id LEFT JOIN trisk t ON t.o_orderkey = s.session_id""",
        "seg_hits", "mrisk", "trisk",
    ),
)
def job13(spark, sf):
    r = context_report(spark, sf)
    return r.select("session_id", F.array_join("labels", ",").alias("labels"), "intent_risk", "metadata_risk", "transaction_risk", "tier", "as_of_ms")
