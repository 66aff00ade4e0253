"""Queries: governance jobs, monitoring, gates and contract checks."""

from pyspark.sql import functions as F

from sonorisk import contracts
from sonorisk.functions.math import r6
from sonorisk.operators import governance as G, monitoring as MO
from sonorisk.plans.fixtures import cte, events, head_scores, micros, sql, table, windows
from sonorisk.plans.registry import query
from sonorisk.scale import literal_table

NOW = 1_000_000_000_000_000  # 2001-09-09
cte(
    "oev",
    """SELECT o_orderkey, 'b' || o_orderkey AS bundle_id, o_custkey AS session_id, c_mktsegment AS tenant_id, epoch_us(o_orderdate) AS created_us, 'id' || (o_custkey % 300) AS ident, 'n' || (o_orderkey % 777) AS num
    FROM orders JOIN customer ON c_custkey = o_custkey""",
)
DAYS = {"BUILDING": 1200, "MACHINERY": 900}


def evidence(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("tenant_id"))
    o = table(spark, sf, "orders").join(c, "o_custkey")
    s = lambda x: x.cast("string")
    return o.select(
        "o_orderkey", F.concat(F.lit("b"), s(F.col("o_orderkey"))).alias("bundle_id"), F.col("o_custkey").alias("session_id"), "tenant_id", micros("o_orderdate").alias("created_us"),
        F.concat(F.lit("id"), s(F.col("o_custkey") % 300)).alias("claimed_identity_id"), F.concat(F.lit("n"), s(F.col("o_orderkey") % 777)).alias("caller_number"),
    )


def policies(spark):
    return literal_table(spark, [(t, d, 90, 365, 700) for t, d in DAYS.items()], "tenant_id string, evidence_days int, timeline_days int, feedback_days int, voiceprint_inactive_days int")


def holds(spark, sf):
    return evidence(spark, sf).filter("session_id % 97 = 0").select("tenant_id", "session_id")


_DAYS_SQL = "CASE tenant_id WHEN 'BUILDING' THEN 1200 WHEN 'MACHINERY' THEN 900 ELSE 1500 END"


@query("JON22", sql(f"SELECT bundle_id, {_DAYS_SQL} AS evidence_days, CASE WHEN tenant_id IN ('BUILDING', 'MACHINERY') THEN 90 ELSE 30 END AS timeline_days FROM oev", "oev"))
def jon22(spark, sf):
    return G.with_tenant_policy(evidence(spark, sf), policies(spark), {"evidence_days": 1500, "timeline_days": 30}).select("bundle_id", "evidence_days", "timeline_days")


@query("JOB01", sql(f"SELECT tenant_id, count(*) FILTER (session_id % 97 <> 0) AS evidence_erased, count(*) FILTER (session_id % 97 = 0) AS held_sessions_skipped, false AS dry_run FROM oev WHERE created_us < {NOW} - {_DAYS_SQL} * 86400000000 GROUP BY 1", "oev"))
def job01(spark, sf):
    x = G.expired_evidence(evidence(spark, sf), policies(spark), holds(spark, sf), NOW, {"evidence_days": 1500})
    return G.retention_report(x, False)


@query("JOB02", sql(f"SELECT bundle_id FROM oev WHERE created_us < {NOW} - CAST(1200 AS BIGINT) * 86400000000", "oev"))
def job02(spark, sf):
    return G.longest_window(evidence(spark, sf), policies(spark), "evidence_days", NOW).select("bundle_id")


@query(
    "JOB03",
    f"""SELECT c_custkey, reason FROM (SELECT c_custkey, CASE WHEN exp <= {NOW} THEN 'expired' WHEN upd < {NOW} - CAST(CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 700 ELSE 730 END AS BIGINT) * 86400000000 THEN 'inactive' END AS reason FROM (
    SELECT c_custkey, c_mktsegment, CASE WHEN c_custkey % 3 <> 0 THEN {NOW} + (c_custkey % 11 - 4) * 86400000000 END AS exp, {NOW} - c_custkey % 1000 * 86400000000 AS upd FROM customer)) WHERE reason IS NOT NULL""",
)
def job03(spark, sf):
    k = F.col("c_custkey")
    p = table(spark, sf, "customer").select(
        k, F.col("c_mktsegment").alias("tenant_id"), F.when(k % 3 != 0, F.lit(NOW) + (k % 11 - 4) * G.DAY_US).alias("expires_us"),
        F.when(k % 2 == 0, F.lit(NOW) - k % 1000 * G.DAY_US).alias("updated_us"), (F.lit(NOW) - k % 1000 * G.DAY_US).alias("created_us"),
    )
    return G.voiceprint_expiry(p, policies(spark), NOW, {"voiceprint_inactive_days": 730}).select("c_custkey", "reason")


cte("subj", "SELECT c_custkey AS subject_id, c_mktsegment AS tenant_id, CASE WHEN c_custkey % 2 = 0 THEN 'id' || (c_custkey % 300) END AS ident, 'n' || (c_custkey % 777) AS num FROM customer WHERE c_custkey % 50 = 1 OR c_custkey % 64 = 2")
cte("smatch", "SELECT DISTINCT s.subject_id, e.bundle_id, e.session_id, e.tenant_id FROM oev e JOIN subj s ON s.tenant_id = e.tenant_id AND (s.ident = e.ident OR s.num = e.num)", "oev", "subj")


def subjects(spark, sf):
    k = F.col("c_custkey")
    s = lambda x: x.cast("string")
    return table(spark, sf, "customer").filter("c_custkey % 50 = 1 OR c_custkey % 64 = 2").select(
        k.alias("subject_id"), F.col("c_mktsegment").alias("tenant_id"), F.when(k % 2 == 0, F.concat(F.lit("id"), s(k % 300))).alias("identity"), F.concat(F.lit("n"), s(k % 777)).alias("number")
    )


def matches(spark, sf):
    return G.subject_evidence(evidence(spark, sf), subjects(spark, sf))


@query("JON23", sql("SELECT subject_id, bundle_id FROM smatch", "smatch"))
def jon23(spark, sf):
    return matches(spark, sf).select("subject_id", "bundle_id")


@query("JOB04", sql("SELECT subject_id, store, count(*) AS n_items FROM (SELECT subject_id, 'evidence' AS store, bundle_id AS item FROM smatch UNION SELECT m.subject_id, 'timeline', CAST(event_id AS VARCHAR) FROM smatch m JOIN events e ON e.user_id = m.session_id) GROUP BY 1, 2", "smatch"))
def job04(spark, sf):
    t = table(spark, sf, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("item"))
    return G.subject_export(evidence(spark, sf), subjects(spark, sf), {"timeline": t}).groupBy("subject_id", "store").agg(F.count(F.lit(1)).alias("n_items"))


@query("JOB05", sql("SELECT subject_id, count(*) FILTER (session_id % 97 <> 0) AS evidence_erased, count(DISTINCT session_id) FILTER (session_id % 97 = 0) AS held_sessions, CASE WHEN count(*) FILTER (session_id % 97 = 0) > 0 THEN 'partial' ELSE 'ok' END AS outcome FROM smatch GROUP BY 1", "smatch"))
def job05(spark, sf):
    return G.subject_erasure(matches(spark, sf), holds(spark, sf))[1]


MATRIX = [("fraud_detection", ["contract", "legal_obligation"], False, False, True), ("speaker_enrollment", ["explicit_consent"], False, True, False), ("raw_audio_retention", ["explicit_consent", "legal_obligation"], False, False, True), ("marketing", ["explicit_consent"], True, False, True)]


@query(
    "FLT08",
    """SELECT event_id, why, why = 'ok' AS allowed FROM (SELECT event_id, CASE p WHEN 4 THEN 'unknown purpose' WHEN 3 THEN 'purpose is disabled' ELSE CASE WHEN NOT CASE p WHEN 0 THEN b IN (0, 1) WHEN 1 THEN b = 2 ELSE b IN (1, 2) END THEN 'basis not allowed'
    WHEN p = 1 AND event_id % 7 = 0 THEN 'consent reference missing' WHEN p = 1 AND event_id % 11 = 0 THEN 'cannot be bundled' ELSE 'ok' END END AS why FROM (SELECT event_id, event_id % 5 AS p, user_id % 3 AS b FROM events))""",
)
def flt08(spark, sf):
    m = literal_table(spark, MATRIX, "purpose string, allowed_bases array<string>, disabled boolean, requires_consent_record boolean, bundling_allowed boolean")
    i = F.col("event_id")
    pick = lambda xs, k: F.element_at(F.array(*[F.lit(x) for x in xs]), (k + 1).cast("int"))
    r = table(spark, sf, "events").select(
        i, pick(["fraud_detection", "speaker_enrollment", "raw_audio_retention", "marketing", "other"], i % 5).alias("purpose"), pick(["contract", "legal_obligation", "explicit_consent"], F.col("user_id") % 3).alias("basis"),
        F.when(i % 7 != 0, "ref").alias("consent_ref"), (i % 11 == 0).alias("bundled"),
    )
    return G.purpose_check(r, m).select("event_id", "why", "allowed")


@query("FLT09", "SELECT event_id, event_id % 4 IN (1, 2) AND event_id % 3 > 0 AND user_id % 3 IN (1, 2) AS retain FROM events")
def flt09(spark, sf):
    i = F.col("event_id")
    pick = lambda xs, k: F.element_at(F.array(*[F.lit(x) for x in xs]), (k + 1).cast("int"))
    r = G.may_retain_audio(pick(["LOW", "ELEVATED", "HIGH", "ABSTAIN"], i % 4), i % 3, pick(["contract", "legal_obligation", "explicit_consent"], F.col("user_id") % 3), ("explicit_consent", "legal_obligation"))
    return table(spark, sf, "events").select("event_id", r.alias("retain"))


def payloads(spark, sf):
    e = table(spark, sf, "embeddings")
    i = F.col("vec_id")
    return e.select(
        i, F.when(i % 2 == 0, F.col("embedding")).alias("embedding"), F.when(i % 3 == 0, F.concat("embedding", "embedding")).otherwise(F.col("embedding")).alias("features"),
        F.when(i % 5 == 0, F.repeat(F.lit("QUJD"), 1100)).otherwise(F.repeat(F.lit("ab c"), 1100)).alias("note"), F.struct(F.when(i % 7 == 0, "raw").alias("pcm"), F.lit(1).alias("v")).alias("detail"),
    )


_FIND = "[CASE WHEN vec_id % 2 = 0 THEN 'embedding: audio/biometric field' END, CASE WHEN vec_id % 3 = 0 THEN 'features: numeric array' END, CASE WHEN vec_id % 5 = 0 THEN 'note: base64 blob' END, CASE WHEN vec_id % 7 = 0 THEN 'detail.pcm: audio/biometric field' END]"


@query("FLT11", f"SELECT vec_id, array_to_string(list_filter({_FIND}, lambda x: x IS NOT NULL), ',') AS findings FROM embeddings")
def flt11(spark, sf):
    return G.payload_findings(payloads(spark, sf)).select("vec_id", F.array_join("findings", ",").alias("findings"))


@query("FLT12", "SELECT vec_id, vec_id % 2 = 0 AS embedding_hidden, vec_id % 3 = 0 AS features_hidden, vec_id % 5 = 0 AS note_hidden, vec_id % 7 = 0 AS detail_hidden FROM embeddings")
def flt12(spark, sf):
    s = G.scrub(payloads(spark, sf))
    hid = lambda c: F.coalesce(F.col(c) == G.REDACTED, F.lit(False)).alias(f"{c}_hidden")
    return s.select("vec_id", hid("embedding"), hid("features"), hid("note"), hid("detail"))


@query(
    "FLT13",
    """SELECT page_id, CASE WHEN scheme NOT IN ('https', 'wss') THEN 'scheme' WHEN NOT CASE WHEN page_id % 2 = 0 THEN suffix(host, '.example.com') ELSE suffix(host, '.example.org') OR suffix(host, '.example.net') END THEN 'not_allowlisted'
    WHEN page_id % 5 = 0 AND page_id % 3 <> 0 THEN 'residency' ELSE 'ok' END AS decision FROM (SELECT page_id, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) AS scheme, lower(regexp_extract(url, '^[A-Za-z]+://([^/:?#]+)', 1)) AS host FROM pages)""",
)
def flt13(spark, sf):
    i = F.col("page_id")
    p = table(spark, sf, "pages").select(
        i, "url", F.when(i % 2 == 0, F.array(F.lit("*.example.com"))).otherwise(F.array(F.lit("*.example.org"), F.lit("*.example.net"))).alias("egress_allowlist"), (i % 5 == 0).alias("offshore"), (i % 3 == 0).alias("central_processing")
    )
    return G.egress_decision(p).select("page_id", "decision")


# ---- contracts and gates ----------------------------------------------------------------------


def broken_scores(spark, sf):
    i = F.col("event_id")
    h = head_scores(spark, sf)
    return h.withColumns(
        {
            "head_id": F.when(i % 101 == 0, "Z").otherwise(F.col("head_id")), "p_spoof": F.when(i % 103 == 0, 1.5).when(i % 107 == 0, None).otherwise(F.col("p_spoof")),
            "confidence": F.lit(0.5), "latency_ms": F.when(i % 109 == 0, -1).otherwise(F.col("latency_ms")),
        }
    )


@query(
    "FLT01",
    sql(
        """SELECT reasons, count(*) AS n FROM (SELECT array_to_string(list_filter([CASE WHEN event_id % 101 = 0 THEN 'head_id' END, CASE WHEN event_id % 103 = 0 THEN 'p_spoof range' END,
        CASE WHEN event_id % 103 <> 0 AND event_id % 107 = 0 AND NOT abstain THEN 'p_spoof required' END, CASE WHEN event_id % 109 = 0 THEN 'latency_ms' END], lambda x: x IS NOT NULL), ',') AS reasons FROM head_scores) GROUP BY 1""",
        "head_scores",
    ),
)
def flt01(spark, sf):
    ok, bad = contracts.validate(broken_scores(spark, sf), "head_score", ("session_id",))
    n = F.count(F.lit(1)).alias("n")
    return bad.groupBy(F.array_join("reasons", ",").alias("reasons")).agg(n).unionByName(ok.groupBy(F.lit("").alias("reasons")).agg(n))


@query(
    "FLT02",
    """SELECT event_id, array_to_string(list_filter([CASE WHEN event_id * 7 % 3000 < 1500 THEN 'insufficient_voiced_speech' END, CASE WHEN value - 20 < -5 THEN 'low_snr' END, CASE WHEN event_id % 50 > 45 THEN 'clipping' END,
    CASE WHEN event_type = 'signup' THEN 'dtmf_detected' END, CASE WHEN event_type = 'click' THEN 'hold_music_or_tone' END], lambda x: x IS NOT NULL), ',') AS flags FROM events""",
)
def flt02(spark, sf):
    i = F.col("event_id")
    fl = MO.quality_flags({"voiced_ms": i * 7 % 3000, "snr_db": F.col("value") - 20, "clipping_ratio": F.when(i % 50 > 45, 0.02).otherwise(0.0), "is_dtmf": F.col("event_type") == "signup", "is_tone": F.col("event_type") == "click"})
    return table(spark, sf, "events").select("event_id", F.array_join(fl, ",").alias("flags"))


DIMS = range(1, 65)
FEATURES = [f"f{k}" for k in DIMS]
_each = lambda form: ", ".join(form.replace("#", str(k)) for k in DIMS)
_FEATS = ", ".join({1: "CASE WHEN vec_id % 11 = 0 THEN NULL ELSE CAST(embedding[1] AS DOUBLE) END AS f1", 2: "CAST(embedding[2] AS DOUBLE) * 10 AS f2"}.get(k, f"CAST(embedding[{k}] AS DOUBLE) AS f{k}") for k in DIMS)
cte("fv", f"SELECT vec_id, {_FEATS}, CASE WHEN label = 9 AND vec_id % 2 = 0 THEN NULL WHEN vec_id < 20 THEN 'rare' ELSE 'l' || (label % 3) END AS lang, label FROM embeddings")


def features(spark, sf):
    i = F.col("vec_id")
    e = lambda k: F.element_at("embedding", k).cast("double")
    lang = F.when((F.col("label") == 9) & (i % 2 == 0), None).when(i < 20, "rare").otherwise(F.concat(F.lit("l"), (F.col("label") % 3).cast("string")))
    return table(spark, sf, "embeddings").select(i, F.when(i % 11 != 0, e(1)).alias("f1"), (e(2) * 10).alias("f2"), *[e(k).alias(f"f{k}") for k in DIMS[2:]], lang.alias("lang"), "label")


cte("lnorm", f"SELECT lang, {_each('avg(f#) AS m#, greatest(stddev_pop(f#), 1e-6) AS d#')} FROM fv WHERE lang IS NOT NULL GROUP BY 1 HAVING count(*) >= 30", "fv")
cte("gnorm", f"SELECT {_each('avg(f#) AS g#, stddev_pop(f#) AS h#')} FROM fv", "fv")
cte("znorm", f"SELECT vec_id, {_each('(f# - coalesce(m#, g#)) / coalesce(d#, h#) AS z#')}, CASE WHEN n.lang IS NOT NULL THEN f.lang ELSE 'global' END AS norm_source FROM fv f LEFT JOIN lnorm n ON n.lang = f.lang, gnorm", "lnorm", "gnorm")


def normalised(spark, sf):
    f = features(spark, sf)
    per, overall = MO.language_norms(f, "lang", FEATURES)
    return MO.normalise_by_language(f, "lang", FEATURES, per, overall)


@query("AGG40", sql(f"SELECT vec_id, norm_source, {_each('round(z#, 4) + 0.0 AS z_f#')} FROM znorm", "znorm"))
def agg40(spark, sf):
    return normalised(spark, sf).select("vec_id", "norm_source", *[r6(F.col(f"z_{f}"), 4).alias(f"z_{f}") for f in FEATURES])


@query("FN39", sql(f"SELECT vec_id, {_each('round(greatest(-1.5, least(1.5, coalesce(z#, 0))), 4) + 0.0 AS v#')} FROM znorm", "znorm"))
def fn39(spark, sf):
    v = normalised(spark, sf).withColumn("v", MO.model_vector([f"z_{f}" for f in FEATURES], clip=1.5))
    return v.select("vec_id", *[r6(F.col("v")[k - 1], 4).alias(f"v{k}") for k in DIMS])


cte("flong", f"SELECT vec_id, label, feature, x FROM fv UNPIVOT (x FOR feature IN ({', '.join(FEATURES)}))", "fv")


@query(
    "AGG48",
    sql(
        """SELECT vec_id, feature, round(z, 4) AS z FROM (SELECT vec_id, a.feature, abs(x - mu) / (sd + 1e-9) AS z FROM flong a
        JOIN (SELECT feature, avg(x) AS mu, stddev_pop(x) AS sd FROM flong WHERE label < 5 GROUP BY 1) b ON a.feature = b.feature) WHERE z > 2.0""",
        "flong",
    ),
)
def agg48(spark, sf):
    f = features(spark, sf)
    ref = MO.feature_reference(f.filter("label < 5"), FEATURES)
    return MO.feature_deviations(f, "vec_id", FEATURES, ref, 2.0).select("vec_id", "feature", r6(F.col("z"), 4).alias("z"))


@query(
    "TOP13",
    """SELECT event_id, array_to_string(list_concat(list_transform(list_slice(list_reverse_sort(list_filter([CASE WHEN value > 10 THEN {'s': 1.0 + value / 100, 't': 'scene'} END, CASE WHEN event_id % 3 = 0 THEN {'s': 0.8 + (event_id % 7) / 10.0, 't': 'tones'} END,
    CASE WHEN event_id % 4 = 0 THEN {'s': 0.6 + (event_id % 5) / 10.0, 't': 'band edge'} END, CASE WHEN event_id % 5 = 0 THEN {'s': 0.5, 't': 'breath'} END], lambda x: x IS NOT NULL)), 1, 2), lambda x: x.t), ['channel ' || event_type]), '|') AS reasons FROM events""",
)
def top13(spark, sf):
    i = F.col("event_id")
    cand = F.array(
        *[
            F.struct(sal.alias("salience"), F.lit(t).alias("text"))
            for sal, t in [
                (F.when(F.col("value") > 10, 1.0 + F.col("value") / 100), "scene"), (F.when(i % 3 == 0, 0.8 + i % 7 / 10.0), "tones"), (F.when(i % 4 == 0, 0.6 + i % 5 / 10.0), "band edge"), (F.when(i % 5 == 0, F.lit(0.5)), "breath"),
            ]
        ]
    )
    return table(spark, sf, "events").select("event_id", F.array_join(MO.explanations(cand, F.concat(F.lit("channel "), F.col("event_type"))), "|").alias("reasons"))


@query(
    "FN40",
    """SELECT event_id, array_to_string(list_slice(list_filter([CASE WHEN event_id % 9 <> 0 THEN CASE WHEN event_id % 20 < 3 THEN 'flat' WHEN event_id % 20 < 16 THEN 'natural' ELSE 'wide' END END, CASE WHEN event_id % 10 > 7 THEN 'regular' END,
    CASE WHEN event_id % 3 = 0 AND event_id % 4 >= 2 THEN 'breathless' END, CASE WHEN event_id % 2 > 0 THEN 'hesitation' END], lambda x: x IS NOT NULL), 1, 3), ',') AS kinds FROM events""",
)
def fn40(spark, sf):
    i = F.col("event_id")
    r = MO.prosody_remarks({"f0_range_st": F.when(i % 9 != 0, (i % 20).cast("double")), "over_regularity": i % 10 / 10.0, "breath_count": i % 3, "pause_count": i % 4, "filled_pause_count": i % 2})
    kind = lambda t: F.when(t.contains("flat"), "flat").when(t.contains("natural range"), "natural").when(t.contains("very wide"), "wide").when(t.contains("regular"), "regular").when(t.contains("breaths"), "breathless").otherwise("hesitation")
    return table(spark, sf, "events").select("event_id", F.array_join(F.transform(r, kind), ",").alias("kinds"))


# ---- monitoring -------------------------------------------------------------------------------


@query("AGG32", sql("SELECT head_id, CASE WHEN abstain THEN abstain_reason ELSE 'scored' END AS outcome, count(*) AS n FROM head_scores GROUP BY 1, 2", "head_scores"))
def agg32(spark, sf):
    return MO.head_counters(head_scores(spark, sf))


_EDGES = ", ".join(f"({e})" for e in MO.LATENCY_BUCKETS_S)


@query("AGG33", sql(f"SELECT head_id, CAST(le AS DOUBLE) AS le, count(*) FILTER (latency_ms / 1000 <= le) AS n FROM head_scores, (VALUES {_EDGES}, (1000000)) e(le) GROUP BY 1, 2", "head_scores"))
def agg33(spark, sf):
    h = MO.cumulative_histogram(head_scores(spark, sf), ["head_id"], F.col("latency_ms") / 1000, MO.LATENCY_BUCKETS_S)
    return h.withColumn("le", F.when(F.col("le") == float("inf"), 1_000_000.0).otherwise(F.col("le")))


@query("AGG34", sql("SELECT head_id, count(*) AS n, round(quantile_cont(latency_ms, 0.5), 6) AS p50, round(quantile_cont(latency_ms, 0.95), 6) AS p95, round(quantile_cont(latency_ms, 0.99), 6) AS p99 FROM head_scores GROUP BY 1", "head_scores"))
def agg34(spark, sf):
    q = MO.latency_percentiles(head_scores(spark, sf), ["head_id"], "latency_ms")
    return q.select("head_id", "n", *[r6(F.col(c)).alias(c) for c in ("p50", "p95", "p99")])


@query(
    "AGG35",
    sql(
        """SELECT head_id, hour, round(a / n, 6) AS share, round(ba / bn, 6) AS share_before, coalesce(a / n > 2 * ba / bn, false) AS alert FROM (SELECT *, sum(a) OVER w AS ba, nullif(sum(n) OVER w, 0) AS bn FROM (
        SELECT head_id, ts_us // 3600000000 AS hour, count(*) FILTER (abstain) AS a, count(*) AS n FROM head_scores GROUP BY 1, 2) WINDOW w AS (PARTITION BY head_id ORDER BY hour RANGE BETWEEN 48 PRECEDING AND 25 PRECEDING))""",
        "head_scores",
    ),
)
def agg35(spark, sf):
    a = MO.abstain_ratio_alert(head_scores(spark, sf), F.floor(F.col("ts_us") / MO.HOUR_US))
    return a.select("head_id", "hour", r6(F.col("share")).alias("share"), r6(F.col("share_before")).alias("share_before"), "alert")


@query(
    "AGG36",
    """SELECT hour, n, round(b / 24.0, 6) AS mean_before, coalesce(n > 1.2 * b / 24.0 AND n > 3, false) AS alert FROM (SELECT *, sum(n) OVER (ORDER BY hour RANGE BETWEEN 48 PRECEDING AND 25 PRECEDING) AS b FROM (
    SELECT epoch_us(ts) // 3600000000 AS hour, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1))""",
)
def agg36(spark, sf):
    a = MO.alert_rate_tripled(events(spark, sf).filter("event_type = 'error'"), F.floor(F.col("ts_us") / MO.HOUR_US), 1.2, 3)
    return a.select("hour", "n", r6(F.col("mean_before")).alias("mean_before"), "alert")


@query("AGG42", "SELECT user_id AS key_id, epoch_us(ts) // 86400000000 AS day, count(*) AS requests, round(sum(value) / 60, 6) AS audio_minutes, greatest(count(*) - 3, 0) AS requests_over, sum(value) / 60 > 0.8 AS audio_exceeded FROM events GROUP BY 1, 2")
def agg42(spark, sf):
    e = events(spark, sf).select(F.col("user_id").alias("key_id"), "ts_us", F.col("value").alias("audio_s"))
    return MO.usage_by_day(e, 3, 0.8).withColumn("audio_minutes", r6(F.col("audio_minutes")))


cte("wstate", "SELECT *, CASE WHEN value > 20 THEN 'HIGH' ELSE 'LOW' END AS state FROM windows", "windows")


def wstate(spark, sf):
    return windows(spark, sf).withColumns({"state": F.when(F.col("value") > 20, "HIGH").otherwise("LOW"), "p_session": F.col("value")})


@query("AGG43", sql("SELECT session_id, max(window_id) AS window_id, arg_max(state, window_id) AS state FROM wstate WHERE session_id % 4 <> 0 GROUP BY 1", "wstate"))
def agg43(spark, sf):
    closed = table(spark, sf, "customer").filter("c_custkey % 4 = 0").select(F.col("c_custkey").alias("session_id"))
    return MO.latest_open_sessions(wstate(spark, sf), closed).select("session_id", "window_id", "state")


@query("TOP03", sql("SELECT session_id, window_id FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY window_id DESC) AS r FROM windows) WHERE r <= 10", "windows"))
def top03(spark, sf):
    from sonorisk.operators.drift import last_n

    return last_n(windows(spark, sf), ["session_id"], [F.col("window_id").desc()], 10).select("session_id", "window_id")


@query("WIN13", sql("SELECT session_id, min(window_id) AS start, max(window_id) AS \"end\", count(*) AS length FROM (SELECT *, window_id - row_number() OVER (PARTITION BY session_id ORDER BY window_id) AS g FROM windows WHERE value > 8) GROUP BY session_id, g HAVING count(*) BETWEEN 2 AND 5", "windows"))
def win13(spark, sf):
    return MO.flag_runs(windows(spark, sf), "session_id", "window_id", F.col("value") > 8, 2, 5)


@query(
    "WIN14",
    sql("@@", "windows").replace("WITH ", "WITH RECURSIVE ", 1).replace(
        "@@",
        """, o AS (SELECT session_id AS gateway, window_id, ts_us, CAST((event_id * 37) % 600 AS DOUBLE) AS ms FROM windows),
        r AS (SELECT gateway, window_id, ts_us, ms AS ema, ms > 300 AS deg, 0 AS calm, CASE WHEN ms > 300 THEN ts_us ELSE 0 END AS since FROM o WHERE window_id = 0
        UNION ALL SELECT gateway, window_id, ts_us, ema, CASE WHEN NOT deg THEN ema > 300 ELSE NOT (c2 >= 2 AND ts_us - since >= 10000000) END, CASE WHEN NOT deg THEN 0 WHEN c2 >= 2 AND ts_us - since >= 10000000 THEN 0 ELSE c2 END, CASE WHEN NOT deg AND ema > 300 THEN ts_us ELSE since END FROM (
          SELECT *, CASE WHEN deg THEN CASE WHEN ema < 250 THEN calm + 1 ELSE 0 END ELSE 0 END AS c2 FROM (
          SELECT o.gateway, o.window_id, o.ts_us, CASE WHEN r.ema = 0 THEN o.ms ELSE 0.8 * r.ema + 0.2 * o.ms END AS ema, r.deg, r.calm, r.since FROM r JOIN o ON o.gateway = r.gateway AND o.window_id = r.window_id + 1)))
        SELECT gateway, ts_us, round(ema, 6) + 0.0 AS ema_ms, deg AS degraded FROM r""",
    ),
)
def win14(spark, sf):
    o = windows(spark, sf).select(F.col("session_id").alias("gateway"), "ts_us", ((F.col("event_id") * 37) % 600).cast("double").alias("latency_ms"))
    return MO.load_timeline(o, exit_after=2).select("gateway", "ts_us", r6(F.col("ema_ms")).alias("ema_ms"), "degraded")


@query(
    "WIN15",
    sql("@@", "windows").replace("WITH ", "WITH RECURSIVE ", 1).replace(
        "@@",
        """, o AS (SELECT session_id, window_id, CAST(-30 - (event_id * 7) % 20 AS DOUBLE) AS db FROM windows),
        r AS (SELECT session_id, window_id, db >= -35 AS op, 0 AS q FROM o WHERE window_id = 0 UNION ALL
        SELECT session_id, window_id, CASE WHEN op THEN q2 < 3 ELSE db >= -35 END, CASE WHEN op AND q2 < 3 THEN q2 ELSE 0 END FROM (SELECT o.session_id, o.window_id, o.db, r.op, CASE WHEN o.db >= -40 THEN 0 ELSE r.q + 1 END AS q2 FROM r JOIN o ON o.session_id = r.session_id AND o.window_id = r.window_id + 1))
        SELECT session_id, window_id AS frame_id, op AS voiced FROM r""",
    ),
)
def win15(spark, sf):
    f = windows(spark, sf).select("session_id", F.col("window_id").alias("frame_id"), (-30 - (F.col("event_id") * 7) % 20).cast("double").alias("energy_db"))
    return MO.voice_activity(f, hangover=3)


@query("FLT14", sql("SELECT head_id, session_id, window_id FROM head_scores WHERE p_spoof IS NOT NULL AND session_id NOT IN (SELECT session_id FROM windows WHERE event_id % 97 = 3)", "head_scores"))
def flt14(spark, sf):
    from sonorisk.operators.drift import bona_fide_proxy

    states = windows(spark, sf).select("session_id", F.when(F.col("event_id") % 97 == 3, "HIGH").otherwise("LOW").alias("state"))
    return bona_fide_proxy(head_scores(spark, sf), states).select("head_id", "session_id", "window_id")


cte("fb", "SELECT 'b' || (event_id % 3000) AS bundle_id, event_id AS arrival, CASE event_id % 3 WHEN 0 THEN 'true_positive' WHEN 1 THEN 'false_positive' ELSE 'unsure' END AS label FROM events")
cte("fbl", "SELECT bundle_id, arg_max(label, arrival) AS label, max(arrival) AS arrival FROM fb GROUP BY 1", "fb")


def feedback(spark, sf):
    i = F.col("event_id")
    return table(spark, sf, "events").select(F.concat(F.lit("b"), (i % 3000).cast("string")).alias("bundle_id"), i.alias("arrival"), F.when(i % 3 == 0, "true_positive").when(i % 3 == 1, "false_positive").otherwise("unsure").alias("label"))


@query("WIN09", sql("SELECT bundle_id, label, arrival FROM fbl", "fbl"))
def win09(spark, sf):
    return MO.latest_per_key(feedback(spark, sf), "bundle_id", "arrival").select("bundle_id", "label", "arrival")


def eval_rows(spark, sf):
    from sonorisk.sources.feedback import export_eval_rows

    ev = table(spark, sf, "orders").select(F.concat(F.lit("b"), F.col("o_orderkey").cast("string")).alias("bundle_id"), F.col("o_custkey").alias("session_id"), F.col("o_orderstatus").alias("state"), (F.col("o_orderkey") % 101).alias("risk_score"))
    return export_eval_rows(feedback(spark, sf), ev)


_EVAL = "SELECT l.bundle_id, l.label = 'true_positive' AS is_fraud, o_custkey AS session_id, o_orderkey % 101 AS risk_score, o_orderstatus AS state FROM fbl l LEFT JOIN orders ON 'b' || o_orderkey = l.bundle_id WHERE l.label <> 'unsure'"


@query("JON09", sql(_EVAL, "fbl"))
def jon09(spark, sf):
    return eval_rows(spark, sf).select("bundle_id", "is_fraud", "session_id", "risk_score", "state")


@query("SRC15", sql(f"SELECT bundle_id, session_id FROM ({_EVAL}) WHERE is_fraud", "fbl"))
def src15(spark, sf):
    from sonorisk.scale import shared_path
    from sonorisk.sources.feedback import export_confirmed

    path = shared_path(spark, "confirmed")
    export_confirmed(eval_rows(spark, sf), path)
    return spark.read.schema("bundle_id string, session_id long").json(path)




@query(
    "STR17",
    sql("SELECT session_id, window_id, head_id, abstain OR (event_id % 10 < 2 AND head_id = 'A') AS abstain, CASE WHEN event_id % 10 < 2 AND head_id = 'A' THEN 'timeout' ELSE abstain_reason END AS abstain_reason, CASE WHEN event_id % 10 < 2 AND head_id = 'A' THEN 0.0 WHEN event_id % 10 < 2 AND NOT abstain THEN 0.4 ELSE 0.5 END AS confidence FROM head_scores", "head_scores"),
)
def str17(spark, sf):
    h = head_scores(spark, sf).withColumn("confidence", F.lit(0.5))
    return MO.degraded_marks(h, F.col("event_id") % 10 < 2).select("session_id", "window_id", "head_id", "abstain", "abstain_reason", F.round("confidence", 6).alias("confidence"))
