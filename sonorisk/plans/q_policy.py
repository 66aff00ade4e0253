"""Queries: policy decisions, prompts, routing, promotion, evidence chains."""

from pyspark.sql import functions as F

from sonorisk.functions.math import r6
from sonorisk.operators import evidence as EV, policy as PO
from sonorisk.plans.fixtures import cte, micros, re4, sql, table
from sonorisk.plans.q_context import FINAL_SQL
from sonorisk.plans.registry import query
from sonorisk.scale import literal_table

LABELS = [[], ["credential_request"], ["authority_pressure", "secrecy_demand"], ["payment_request"]]
_LAB_SQL = "[" + ", ".join("[" + ", ".join(f"'{x}'" for x in lab) + "]" for lab in LABELS) + "]"
PROFS = list(PO.PROFILES)

cte(
    "psess",
    f"""SELECT event_id AS session_id, ['{PROFS[0]}', '{PROFS[1]}', '{PROFS[2]}'][event_id % 3 + 1] AS profile, event_id % 2 = 0 AS shadow, CASE WHEN event_id % 4 = 0 THEN 'ABSTAIN' ELSE 'LOW' END AS state,
    event_id * 37 % 101 AS risk_score, CASE WHEN event_id % 4 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(event_id * 37 % 101 AS DOUBLE) / 100 END AS voice,
    CASE WHEN event_id % 5 = 1 THEN CAST(event_id * 11 % 100 AS DOUBLE) / 100 ELSE 0 END AS mism, CASE WHEN event_id % 8 IN (0, 1) THEN 0 ELSE CAST(event_id * 53 % 90 AS DOUBLE) / 100 END AS intent,
    CASE WHEN event_id % 8 IN (0, 2) THEN 0 ELSE CAST(event_id * 29 % 80 AS DOUBLE) / 100 END AS mrisk, CASE WHEN event_id % 8 = 0 THEN 0 ELSE CAST(event_id * 17 % 70 AS DOUBLE) / 100 END AS trisk,
    ['low', 'medium', 'high', 'unrated'][event_id % 4 + 1] AS tier, {_LAB_SQL}[event_id % 4 + 1] AS labels, event_id % 17 = 0 AS wm FROM events""",
)
_PROF_ROWS = ", ".join(
    f"('{p}', '{t}', CAST({e} AS DOUBLE), CAST({h} AS DOUBLE), {list(a)}, {list(b)})" for p, ts in PO.PROFILES.items() for t, (e, h, a, b) in ts.items()
)
cte("profs", f"SELECT * FROM (VALUES {_PROF_ROWS}) p(profile, tier, elevated, high, ae, ah)")
_LA_ROWS = ", ".join(f"('{p}', '{lab}', {list(a)})" for p, m in PO.LABEL_ACTIONS.items() for lab, a in m.items())
cte("lacts", f"SELECT * FROM (VALUES {_LA_ROWS}) p(profile, label, acts)")
cte(
    "pband",
    f"""SELECT s.*, final, elevated, high, ae, ah, CASE WHEN state = 'ABSTAIN' AND intent = 0 AND mrisk = 0 AND trisk = 0 AND mism = 0 THEN 'ABSTAIN' WHEN final >= high THEN 'HIGH' WHEN final >= elevated THEN 'ELEVATED' ELSE 'LOW' END AS band
    FROM (SELECT *, {re4(FINAL_SQL)} AS final FROM psess) s JOIN profs p ON p.profile = s.profile AND p.tier = CASE WHEN s.tier = 'unrated' THEN 'medium' ELSE s.tier END""",
    "psess", "profs",
)
cte(
    "pact",
    """SELECT b.*, list_filter(raw, lambda x, i: list_position(raw, x) = i) AS actions FROM (SELECT b.*, list_concat(list_concat(CASE band WHEN 'HIGH' THEN ah WHEN 'ELEVATED' THEN ae ELSE [] END,
    coalesce(flatten(list_transform(labels, lambda l: coalesce(la[l], []))), [])), CASE WHEN wm THEN ['agent_banner', 'force_callback'] ELSE [] END) AS raw
    FROM pband b JOIN (SELECT profile, map_from_entries(list((label, acts))) AS la FROM lacts GROUP BY 1) USING (profile)) b""",
    "pband", "lacts",
)


def sessions(spark, sf):
    i = F.col("event_id")
    pick = lambda xs, k: F.element_at(F.array(*[F.lit(x) for x in xs]), (k + 1).cast("int"))
    labels = F.element_at(F.array(*[F.array(*[F.lit(x) for x in lab]).cast("array<string>") for lab in LABELS]), (i % 4 + 1).cast("int"))
    return table(spark, sf, "events").select(
        i.alias("session_id"), pick(PROFS, i % 3).alias("profile"), (i % 2 == 0).alias("shadow_mode"), F.when(i % 4 == 0, "ABSTAIN").otherwise("LOW").alias("state"),
        (i * 37 % 101).alias("risk_score"), (i * 37 % 101 / 100.0).alias("p_max"), (i * 37 % 101 / 200.0).alias("p_mean"), (i % 4 / 4.0).alias("abstain_ratio"),
        F.when(i % 5 == 1, i * 11 % 100 / 100.0).alias("speaker_mismatch"), F.when((i % 8).isin(0, 1), 0.0).otherwise(i * 53 % 90 / 100.0).alias("intent_risk"),
        F.when((i % 8).isin(0, 2), 0.0).otherwise(i * 29 % 80 / 100.0).alias("metadata_risk"), F.when(i % 8 == 0, 0.0).otherwise(i * 17 % 70 / 100.0).alias("transaction_risk"),
        pick(["low", "medium", "high", "unrated"], i % 4).alias("tier"), labels.alias("labels"), (i % 17 == 0).alias("watermark_present"), F.array(F.lit("prosody")).alias("drivers"),
    )


def decisions(spark, sf):
    return PO.decide(sessions(spark, sf), PO.profile_table(spark), PO.label_action_table(spark))


@query("JOB10", sql("SELECT session_id, final AS final_risk, band, array_to_string(actions, ',') AS actions, shadow AND len(actions) > 0 AS suppressed FROM pact", "pact"))
def job10(spark, sf):
    d = decisions(spark, sf)
    return d.select("session_id", F.col("f_final").alias("final_risk"), "band", F.array_join("actions", ",").alias("actions"), "suppressed")


@query("JON17", sql("SELECT session_id, band, array_to_string(CASE band WHEN 'HIGH' THEN ah WHEN 'ELEVATED' THEN ae ELSE [] END, ',') AS actions FROM (SELECT *, CASE WHEN risk_score / 100 >= high THEN 'HIGH' WHEN risk_score / 100 >= elevated THEN 'ELEVATED' ELSE 'LOW' END AS band FROM pband0)".replace("pband0", "(SELECT s.*, elevated, high, ae, ah FROM psess s JOIN profs p ON p.profile = s.profile AND p.tier = CASE WHEN s.tier = 'unrated' THEN 'medium' ELSE s.tier END)"), "psess", "profs"))
def jon17(spark, sf):
    s = PO.with_profile(sessions(spark, sf), PO.profile_table(spark))
    r = F.col("risk_score") / 100
    band = F.when(r >= F.col("high"), "HIGH").when(r >= F.col("elevated"), "ELEVATED").otherwise("LOW")
    acts = F.when(band == "HIGH", F.col("actions_high")).when(band == "ELEVATED", F.col("actions_elevated")).otherwise(F.array().cast("array<string>"))
    return s.select("session_id", band.alias("band"), F.array_join(acts, ",").alias("actions"))


@query("JON18", sql("SELECT session_id, string_agg(array_to_string(acts, ','), ',' ORDER BY list_position(labels, label)) AS label_extra FROM psess s JOIN lacts a ON a.profile = s.profile AND list_contains(s.labels, a.label) GROUP BY 1", "psess", "lacts"))
def jon18(spark, sf):
    x = PO.label_minimum_actions(sessions(spark, sf), PO.label_action_table(spark))
    return x.select("session_id", F.array_join("label_extra", ",").alias("label_extra"))


@query("SET04", sql("SELECT session_id, array_to_string(actions, ',') AS actions, len(raw) AS n_raw FROM pact", "pact"))
def set04(spark, sf):
    d = decisions(spark, sf)
    base = F.when(F.col("band") == "HIGH", F.size("actions_high")).when(F.col("band") == "ELEVATED", F.size("actions_elevated")).otherwise(0)
    n = base + F.when(F.col("label_extra").isNotNull(), F.size("label_extra")).otherwise(0) + F.when(F.col("watermark_present"), 2).otherwise(0)
    return d.select("session_id", F.array_join("actions", ",").alias("actions"), n.cast("long").alias("n_raw"))


_HINT_SQL = "coalesce(" + ", ".join(f"CASE WHEN list_contains(labels, '{k}') THEN '{v}' END" for k, v in PO.HINTS.items()) + ")"
_STEP_SQL = "coalesce(" + ", ".join(f"CASE WHEN list_contains(actions, '{a}') THEN '{PO.PROMPT_TEXT[a]}' END" for a in PO.PROMPT_ORDER) + ")"


@query(
    "TOP04",
    sql(
        f"""SELECT session_id, CASE WHEN band = 'ABSTAIN' THEN '{PO.ABSTAIN_PROMPT}' WHEN band = 'LOW' AND len(actions) = 0 THEN '' ELSE concat_ws(' ', CASE band WHEN 'HIGH' THEN '{PO.LEAD['HIGH']}' WHEN 'ELEVATED' THEN '{PO.LEAD['ELEVATED']}' ELSE '{PO.LEAD['LOW']}' END, {_HINT_SQL}, {_STEP_SQL}) END AS agent_prompt FROM pact""",
        "pact",
    ),
)
def top04(spark, sf):
    return decisions(spark, sf).select("session_id", "agent_prompt")


@query(
    "AGG45",
    sql(
        f"""SELECT session_id, concat_ws(chr(10), 'band=' || band || ' tier=' || tier || ' (elevated>=' || printf('%.2f', elevated) || ', high>=' || printf('%.2f', high) || '; profile ' || profile || ')',
        'voice: state=' || state || ' risk_score=' || risk_score || ' abstain_ratio=' || printf('%.2f', session_id % 4 / 4.0), 'voice driver: prosody', CASE WHEN wm THEN 'watermark: synthetic-speech watermark detected (forces call-back)' END,
        CASE WHEN band = 'ABSTAIN' THEN 'insufficient audio quality to assess the voice; this is not an indication of safety' END, 'advisory only: a human decides', CASE WHEN shadow THEN 'shadow mode: actions recorded, not dispatched' END) AS rationale FROM pact""",
        "pact",
    ),
)
def agg45(spark, sf):
    # numbers with half-way decimals are left out: printf rounding differs between engines
    r = decisions(spark, sf)
    t = F.regexp_replace(F.regexp_replace("rationale", r"\nfactors: [^\n]*", ""), r" max=[0-9.]+ mean=[0-9.]+| final_risk=[0-9.]+", "")
    return r.select("session_id", t.alias("rationale"))


@query("SET03", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'reboot,' || event_type WHEN event_id % 3 = 1 THEN '' ELSE 'x' || (event_id % 5) END AS unknown FROM events")
def set03(spark, sf):
    i = F.col("event_id")
    acts = F.when(i % 3 == 0, F.array(F.lit("agent_banner"), F.lit("reboot"), F.col("event_type"))).when(i % 3 == 1, F.array(F.lit("send_sms"), F.lit("soc_ticket"))).otherwise(F.array(F.concat(F.lit("x"), (i % 5).cast("string"))))
    return table(spark, sf, "events").select("event_id", F.array_join(PO.unknown_actions(acts), ",").alias("unknown"))


@query("SET07", sql("SELECT session_id, list_contains(actions, 'agent_banner') AND list_contains(actions, 'force_callback') AS all_present FROM pact", "pact"))
def set07(spark, sf):
    need = F.array(F.lit("agent_banner"), F.lit("force_callback"))
    return decisions(spark, sf).select("session_id", (F.size(F.array_except(need, F.col("actions"))) == 0).alias("all_present"))


@query("FLT10", "SELECT c_custkey, o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
def flt10(spark, sf):
    c = PO.tenant_rows(table(spark, sf, "customer").withColumnRenamed("c_mktsegment", "tenant_id"), "BUILDING")
    o = table(spark, sf, "orders")
    return c.join(o, c.c_custkey == o.o_custkey).select("c_custkey", "o_orderkey")


@query(
    "AGG46",
    """SELECT session_id, window_id, watermark, detector, p_spoof FROM (SELECT user_id AS session_id, event_id AS window_id, CASE WHEN bool_or(present) THEN 'present' ELSE 'absent' END AS watermark,
    first(d ORDER BY p DESC, d) FILTER (present) AS detector, greatest(0.95, least(0.999, max(p) FILTER (present))) AS p0, CASE WHEN bool_or(present) THEN greatest(CAST(0.95 AS DOUBLE), least(CAST(0.999 AS DOUBLE), max(p) FILTER (present))) END AS p_spoof
    FROM (SELECT user_id, event_id, d, event_id % k = 0 AS present, CAST((event_id * k) % 1000 AS DOUBLE) / 1000 AS p FROM events, (VALUES ('det3', 3), ('det4', 4), ('det7', 7)) v(d, k)) GROUP BY 1, 2)""",
)
def agg46(spark, sf):
    dets = F.array(*[F.struct(F.lit(f"det{k}").alias("d"), F.lit(k).alias("k")) for k in (3, 4, 7)])
    r = table(spark, sf, "events").withColumn("x", F.explode(dets)).select(
        F.col("user_id").alias("session_id"), F.col("event_id").alias("window_id"), F.col("x.d").alias("detector"), (F.col("event_id") % F.col("x.k") == 0).alias("present"),
        ((F.col("event_id") * F.col("x.k")) % 1000 / 1000.0).alias("probability"),
    )
    return PO.watermark_verdict(r).select("session_id", "window_id", "watermark", "detector", "p_spoof")


SUBS = [("s1", "BUILDING", ["O", "F"]), ("s2", "BUILDING", ["P"]), ("s3", "MACHINERY", ["F"]), ("s4", "FURNITURE", ["X"])]
_ROUTE_SQL = """SELECT o_orderkey AS event_id, s.sid AS subscription_id FROM orders JOIN customer ON c_custkey = o_custkey
  JOIN (VALUES ('s1', 'BUILDING', ['O', 'F']), ('s2', 'BUILDING', ['P']), ('s3', 'MACHINERY', ['F']), ('s4', 'FURNITURE', ['X'])) s(sid, t, ty) ON s.t = c_mktsegment AND list_contains(ty, o_orderstatus)"""


def routed(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("tenant_id"))
    e = table(spark, sf, "orders").join(c, "o_custkey").select("tenant_id", F.col("o_orderkey").alias("event_id"), F.col("o_orderstatus").alias("event_type"))
    return PO.route_events(e, literal_table(spark, SUBS, "subscription_id string, tenant_id string, event_types array<string>"))


@query("JON24", _ROUTE_SQL)
def jon24(spark, sf):
    return routed(spark, sf).select("event_id", "subscription_id")


# ---- models -----------------------------------------------------------------------------------

cte(
    "models",
    """SELECT p_partkey AS registered_seq, 'v' || p_partkey AS version, p_type AS kind, ['staging', 'previous', 'active', 'retired'][p_partkey % 4 + 1] AS status, CASE WHEN p_partkey % 3 = 0 THEN 'research' ELSE 'commercial' END AS lineage,
    CASE WHEN p_partkey % 5 <> 0 THEN p_partkey % 100 END AS run, p_partkey % 11 = 0 AS bad_sum FROM part""",
)


def models(spark, sf):
    k = F.col("p_partkey")
    return table(spark, sf, "part").select(
        k.alias("registered_seq"), F.concat(F.lit("v"), k.cast("string")).alias("version"), F.col("p_type").alias("kind"),
        F.element_at(F.array(*[F.lit(s) for s in ("staging", "previous", "active", "retired")]), (k % 4 + 1).cast("int")).alias("status"),
        F.when(k % 3 == 0, "research").otherwise("commercial").alias("lineage"), F.when(k % 5 != 0, k % 100).alias("eval_run_id"),
        F.lit("aa").alias("sha256"), F.when(k % 11 == 0, "bb").otherwise("aa").alias("file_sha256"),
    )


@query(
    "FLT16",
    sql(
        """SELECT version, array_to_string(list_filter([CASE WHEN status NOT IN ('staging', 'previous') THEN 'status' END, CASE WHEN s.s_suppkey IS NULL THEN 'no_evaluation' END, CASE WHEN s.s_suppkey % 7 = 0 THEN 'fairness' END,
        CASE WHEN lineage <> 'commercial' THEN 'lineage' END, CASE WHEN bad_sum THEN 'checksum' END], lambda x: x IS NOT NULL), ',') AS blockers FROM models LEFT JOIN supplier s ON s.s_suppkey = run""",
        "models",
    ),
)
def flt16(spark, sf):
    runs = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("run_id"), F.when(F.col("s_suppkey") % 7 == 0, "fail").otherwise("pass").alias("fairness_gate"))
    return PO.promotion_blockers(models(spark, sf), runs, commercial=True).select("version", F.array_join("blockers", ",").alias("blockers"))


@query("FLT18", sql("SELECT kind, 'v' || min(registered_seq) FILTER (status = 'active') AS active, 'v' || min(registered_seq) FILTER (status = 'previous') AS previous FROM models GROUP BY 1", "models"))
def flt18(spark, sf):
    return PO.active_and_previous(models(spark, sf))


# ---- evidence chains --------------------------------------------------------------------------


def evidence_rows(spark, sf):
    """Evidence rows from orders: one chain per tenant, bodies as canonical JSON."""
    o = table(spark, sf, "orders")
    body = EV.canonical_json(bundle=F.col("o_orderkey"), session=F.col("o_custkey"), status=F.col("o_orderstatus"))
    return o.select((F.col("o_custkey") % 50).alias("tenant"), F.col("o_orderkey").alias("seq"), F.concat(F.lit("b"), F.col("o_orderkey").cast("string")).alias("bundle_id"), F.col("o_custkey").alias("session_id"), micros("o_orderdate").alias("created_us"), body.alias("body")).withColumn("body_sha", F.sha2(F.col("body"), 256))


cte(
    "ev",
    """SELECT *, sha256(body) AS body_sha, row_number() OVER (PARTITION BY tenant ORDER BY seq) AS rn FROM (SELECT o_custkey % 50 AS tenant, o_orderkey AS seq, 'b' || o_orderkey AS bundle_id, o_custkey AS session_id, epoch_us(o_orderdate) AS created_us,
    '{"bundle":' || o_orderkey || ',"session":' || o_custkey || ',"status":"' || o_orderstatus || '"}' AS body FROM orders)""",
)
CHAIN_SQL = """ch AS (SELECT tenant, seq, rn, bundle_id, session_id, created_us, body, body_sha, 'genesis' AS prev_hash, sha256('genesis' || body_sha) AS row_hash FROM ev WHERE rn = 1
  UNION ALL SELECT e.tenant, e.seq, e.rn, e.bundle_id, e.session_id, e.created_us, e.body, e.body_sha, ch.row_hash, sha256(ch.row_hash || e.body_sha) FROM ch JOIN ev e ON e.tenant = ch.tenant AND e.rn = ch.rn + 1)"""


def chain_sql(body: str, *names: str) -> str:
    s = sql("@@", "ev", *names)
    return s.replace("WITH ", "WITH RECURSIVE ", 1).replace("@@", f", {CHAIN_SQL}\n{body}")


def chained(spark, sf):
    return EV.append_chain(evidence_rows(spark, sf), "tenant", ["seq"])


def tampered(spark, sf):
    """The chain with edited rows: some bodies' hashes replaced, some rows removed."""
    c = chained(spark, sf)
    return c.filter("seq % 997 <> 5").withColumn("body_sha", F.when(F.col("seq") % 499 == 7, F.sha2(F.lit("x"), 256)).otherwise(F.col("body_sha")))


TAMPER_SQL = "(SELECT * REPLACE (CASE WHEN seq % 499 = 7 THEN sha256('x') ELSE body_sha END AS body_sha) FROM ch WHERE seq % 997 <> 5)"


@query("FN13", sql("SELECT seq, 'sha256:' || sha256('{\"bundle_id\":\"\",\"evidence_bundle_id\":\"\",\"session\":' || session_id || ',\"tenant\":' || tenant || '}') AS bundle_hash, body FROM ev", "ev"))
def fn13(spark, sf):
    e = evidence_rows(spark, sf)
    return e.select("seq", EV.bundle_id(session=F.col("session_id"), tenant=F.col("tenant")).alias("bundle_hash"), "body")


@query("WIN17", chain_sql("SELECT tenant, seq, prev_hash, row_hash FROM ch"))
def win17(spark, sf):
    return chained(spark, sf).select("tenant", "seq", "prev_hash", "row_hash")


@query(
    "WIN16",
    chain_sql(
        f"""SELECT tenant, count(*) AS n_rows, count(*) FILTER (NOT (h AND l)) AS n_bad, count(*) FILTER (NOT (h AND l)) = 0 AND count(*) FILTER (prev_hash = 'genesis') = 1 AS valid FROM (
        SELECT t.tenant, t.prev_hash, sha256(t.prev_hash || t.body_sha) = t.row_hash AS h, t.prev_hash = 'genesis' OR EXISTS (SELECT 1 FROM {TAMPER_SQL} p WHERE p.tenant = t.tenant AND p.row_hash = t.prev_hash) AS l FROM {TAMPER_SQL} t) GROUP BY 1"""
    ),
)
def win16(spark, sf):
    return EV.verify_chains(tampered(spark, sf), "tenant").select("tenant", "n_rows", "n_bad", "valid")


def bodies(spark, sf):
    e = evidence_rows(spark, sf).filter("seq % 10 not in (3, 6)")
    return e.select("bundle_id", "session_id", "tenant", F.when(F.col("seq") % 301 == 1, F.lit("{}")).otherwise(F.col("body")).alias("body"))


def erasures(spark, sf):
    return evidence_rows(spark, sf).filter("seq % 10 = 3").select("bundle_id", F.lit("2026-01-01").alias("erased_at"), F.lit("retention").alias("reason"))


_JB = "CASE WHEN seq % 10 IN (3, 6) THEN NULL WHEN seq % 301 = 1 THEN '{}' ELSE body END"


@query("JON07", sql(f"SELECT bundle_id, {_JB} AS body, CASE WHEN seq % 10 = 3 THEN 'erased' ELSE 'present' END AS status, CASE WHEN seq % 10 = 6 THEN 'body_missing_without_erasure' WHEN seq % 10 <> 3 AND sha256({_JB}) <> body_sha THEN 'body_hash_mismatch' END AS body_failure FROM ev", "ev"))
def jon07(spark, sf):
    return EV.with_bodies(evidence_rows(spark, sf), bodies(spark, sf), erasures(spark, sf)).select("bundle_id", "body", "status", "body_failure")


@query("JON08", sql("SELECT bundle_id, session_id FROM ev WHERE seq % 10 NOT IN (3, 6) AND tenant = 7 AND created_us < epoch_us(TIMESTAMP '1998-01-01')", "ev"))
def jon08(spark, sf):
    e = evidence_rows(spark, sf).filter((F.col("tenant") == 7) & (F.col("created_us") < 883_612_800_000_000))
    return e.join(bodies(spark, sf).select("bundle_id"), "bundle_id").select("bundle_id", "session_id")


@query(
    "JOB07",
    chain_sql(
        f"""SELECT bundle_id, CASE WHEN NOT h THEN 'row_hash_mismatch' WHEN NOT l THEN 'broken_link' WHEN seq % 10 = 6 THEN 'body_missing_without_erasure' WHEN seq % 10 <> 3 AND sha256({_JB}) <> body_sha THEN 'body_hash_mismatch' END AS failure FROM (
        SELECT t.*, sha256(t.prev_hash || t.body_sha) = t.row_hash AS h, t.prev_hash = 'genesis' OR EXISTS (SELECT 1 FROM {TAMPER_SQL} p WHERE p.tenant = t.tenant AND p.row_hash = t.prev_hash) AS l FROM {TAMPER_SQL} t)"""
    ),
)
def job07(spark, sf):
    t = tampered(spark, sf).drop("body")
    return EV.verification_report(t, bodies(spark, sf), erasures(spark, sf), "tenant").select("bundle_id", "failure")


@query("JOB06", sql("SELECT count(*) FILTER (seq % 10 NOT IN (3, 6)) AS n_before, count(*) FILTER (seq % 10 NOT IN (3, 6) AND session_id % 9 = 0) AS n_erased, count(*) FILTER (seq % 10 NOT IN (3, 6) AND session_id % 9 <> 0) AS n_left FROM ev", "ev"))
def job06(spark, sf):
    b = bodies(spark, sf)
    left, gone = EV.erase(b, b.filter("session_id % 9 = 0"), "2026-01-01", "data subject erasure")
    n = lambda df, c: df.agg(F.count(F.lit(1)).alias(c))
    return n(b, "n_before").join(F.broadcast(n(gone, "n_erased"))).join(F.broadcast(n(left, "n_left")))  # single rows


@query("JOB08", sql("SELECT tenant, count(*) AS n_rows, 0 AS n_bad, 1 AS n_start, 0 AS n_forks, true AS valid FROM ev GROUP BY 1", "ev"))
def job08(spark, sf):
    v1 = EV.append_chain(evidence_rows(spark, sf).drop("body_sha"), "tenant", ["seq"], content="body")
    m = EV.migrate_chain(v1, "tenant", ["seq"])
    return EV.verify_chains(m, "tenant")


cte(
    "aud",
    """SELECT *, row_number() OVER (PARTITION BY tenant ORDER BY seq) AS rn, '{"action":"' || action || '","subject":' || user_id || ',"tenant":' || tenant || '}' AS body FROM (
    SELECT user_id % 20 AS tenant, event_id AS seq, user_id, CASE event_type WHEN 'view' THEN 'dsar_export' WHEN 'error' THEN 'consent_refused' ELSE 'retention_run' END AS action FROM events)""",
)
AUD_SQL = """ch AS (SELECT tenant, seq, rn, action, body, 'genesis' AS prev_hash, sha256('genesis' || body) AS row_hash FROM aud WHERE rn = 1
  UNION ALL SELECT e.tenant, e.seq, e.rn, e.action, e.body, ch.row_hash, sha256(ch.row_hash || e.body) FROM ch JOIN aud e ON e.tenant = ch.tenant AND e.rn = ch.rn + 1)"""


@query(
    "JOB09",
    sql("@@", "aud").replace("WITH ", "WITH RECURSIVE ", 1).replace(
        "@@", f", {AUD_SQL}\nSELECT tenant, seq, action, row_hash, true AS hash_ok, true AS link_ok FROM ch WHERE action = 'consent_refused' AND tenant = 4"
    ),
)
def job09(spark, sf):
    a = F.when(F.col("event_type") == "view", "dsar_export").when(F.col("event_type") == "error", "consent_refused").otherwise("retention_run")
    e = table(spark, sf, "events").select((F.col("user_id") % 20).alias("tenant"), F.col("event_id").alias("seq"), a.alias("action"), "user_id")
    e = e.withColumn("body", EV.canonical_json(action=F.col("action"), subject=F.col("user_id"), tenant=F.col("tenant"))).drop("user_id")
    log = EV.append_chain(e, "tenant", ["seq"], content="body")
    v = EV.verify_links(log, "tenant", "body")
    p = F.from_json("body", "action string, subject long, tenant long")
    return v.withColumn("p", p).filter((F.col("p.action") == "consent_refused") & (F.col("p.tenant") == 4)).select("tenant", "seq", "action", "row_hash", "hash_ok", "link_ok")
