"""Queries: speaker scoring, liveness answers and signal jobs."""

from pyspark.sql import functions as F

from sonorisk.functions import arrays as A
from sonorisk.functions.math import mismatch_probability, r6
from sonorisk.operators import liveness as LV, signal as SG, speakers as SP
from sonorisk.plans.fixtures import cte, events, sql, table, windows
from sonorisk.plans.q_text import docs
from sonorisk.plans.registry import query

cte("vec", "SELECT vec_id AS id, label AS speaker, label % 2 AS grp, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS vec FROM embeddings")
cte("cent", "SELECT speaker, any_value(grp) AS grp, list(m ORDER BY pos) AS c, any_value(n) AS n FROM (SELECT speaker, any_value(grp) AS grp, pos, avg(v) AS m, count(*) AS n FROM (SELECT speaker, grp, unnest(vec) AS v, generate_subscripts(vec, 1) AS pos FROM vec) GROUP BY speaker, pos) GROUP BY 1", "vec")
_N = "sqrt(list_inner_product({0}, {0}))"
cte("coh0", f"SELECT id, list_transform(vec, lambda x: x / (n + 1e-9)) AS u FROM (SELECT *, {_N.format('vec')} AS n FROM vec WHERE id % 10 = 0)", "vec")
cte("cmean", "SELECT list(m ORDER BY pos) AS mean FROM (SELECT pos, avg(v) AS m FROM (SELECT unnest(u) AS v, generate_subscripts(u, 1) AS pos FROM coh0) GROUP BY 1)", "coh0")
cte("coh", f"SELECT id, list_transform(d, lambda x: x / ({_N.format('d')} + 1e-9)) AS u FROM (SELECT id, list_transform(list_zip(u, mean), lambda z: z[1] - z[2]) AS d FROM coh0, cmean)", "coh0", "cmean")
cte("vcen", "SELECT id, speaker, list_transform(list_zip(vec, mean), lambda z: z[1] - z[2]) AS v FROM vec, cmean", "vec", "cmean")
cte("ccen", "SELECT speaker, list_transform(list_zip(c, mean), lambda z: z[1] - z[2]) AS v FROM cent, cmean", "cent", "cmean")


def _stats(src, key):
    return f"SELECT {key}, avg(s) AS mu, greatest(stddev_pop(s), 1e-3) AS sd FROM (SELECT a.{key}, list_inner_product(a.v, u) / ({_N.format('a.v')} + 1e-9) AS s, row_number() OVER (PARTITION BY a.{key} ORDER BY list_inner_product(a.v, u) DESC) AS r FROM {src} a, coh) WHERE r <= 20 GROUP BY 1"


cte("vst", _stats("vcen", "id"), "vcen", "coh")
cte("cst", _stats("ccen", "speaker"), "ccen", "coh")


def vectors(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("speaker"), (F.col("label") % 2).cast("long").alias("grp"), A.as_double(F.col("embedding")).alias("vec"))


def cohort(spark, sf):
    return vectors(spark, sf).filter("id % 10 = 0").select("id", "vec")


@query("AGG41", sql(f"SELECT speaker, round(list_inner_product(u, u), 6) AS sq, round(u[1], 6) + 0.0 AS x1, round(u[64], 6) + 0.0 AS x64 FROM (SELECT speaker, list_transform(c, lambda x: x / ({_N.format('c')} + 1e-9)) AS u FROM cent)", "cent"))
def agg41(spark, sf):
    p = vectors(spark, sf).select("speaker", F.when(F.col("id") % 2 == 0, "wideband").otherwise("narrowband").alias("condition"), F.col("vec").alias("embedding"))
    c = SP.voiceprint_centroids(p, ["speaker"]).filter("condition = 'all'")
    return c.select("speaker", r6(A.dot(F.col("centroid"), F.col("centroid"))).alias("sq"), r6(F.col("centroid")[0]).alias("x1"), r6(F.col("centroid")[63]).alias("x64"))


@query("FN08", sql("SELECT id, round(list_inner_product(vec, c), 6) + 0.0 AS dot, round(list_inner_product(vec, c) / (sqrt(list_inner_product(vec, vec)) * sqrt(list_inner_product(c, c)) + 1e-9), 6) + 0.0 AS cosine FROM vec JOIN cent USING (speaker)", "cent"))
def fn08(spark, sf):
    v = vectors(spark, sf)
    j = v.join(SP.mean_vectors(v, ["speaker"], "vec"), "speaker")
    return j.select("id", r6(A.dot(F.col("vec"), F.col("centroid"))).alias("dot"), r6(A.cosine(F.col("vec"), F.col("centroid"))).alias("cosine"))


@query("TOP02", sql("SELECT id, round(mu, 5) + 0.0 AS mu, round(sd, 5) + 0.0 AS sd FROM vst", "vst"))
def top02(spark, sf):
    c, mean = SP.centred_cohort(cohort(spark, sf))
    v = vectors(spark, sf).join(F.broadcast(mean)).select("id", A.subtract(F.col("vec"), F.col("mean")).alias("vec"))
    s = SP.cohort_statistics(v, c, 20)
    return s.select("id", r6(F.col("mu"), 5).alias("mu"), r6(F.col("sd"), 5).alias("sd"))


@query("JON14", sql(f"SELECT a.id, round(max(list_inner_product(a.v, u) / ({_N.format('a.v')} + 1e-9)), 5) + 0.0 AS best FROM vcen a, coh GROUP BY 1", "vcen", "coh"))
def jon14(spark, sf):
    c, mean = SP.centred_cohort(cohort(spark, sf))
    v = vectors(spark, sf).join(F.broadcast(mean)).select("id", A.subtract(F.col("vec"), F.col("mean")).alias("vec"))
    return SP.cohort_statistics(v, c, 1).select("id", r6(F.col("mu"), 5).alias("best"))


def trial_scores(spark, sf):
    v = vectors(spark, sf)
    enroll = SP.mean_vectors(v, ["speaker"], "vec").select(F.col("speaker").alias("id"), F.col("centroid").alias("vec"))
    trials = v.select(((F.col("speaker") + F.col("id") % 2) % 10).alias("enroll_id"), F.col("id").alias("test_id"))
    return SP.normalised_scores(trials, enroll, v.select("id", "vec"), cohort(spark, sf), 20)


cte("asn", f"SELECT v.id AS test_id, c.speaker AS enroll_id, list_inner_product(v.v, c.v) / ({_N.format('v.v')} * {_N.format('c.v')} + 1e-9) AS cosine FROM vcen v JOIN ccen c ON c.speaker = (v.speaker + v.id % 2) % 10", "vcen", "ccen")


@query("FN09", sql("SELECT enroll_id, test_id, round(cosine, 5) + 0.0 AS cosine, round(0.5 * ((cosine - cst.mu) / cst.sd + (cosine - vst.mu) / vst.sd), 4) + 0.0 AS as_norm FROM asn JOIN cst ON cst.speaker = enroll_id JOIN vst ON vst.id = test_id", "asn", "cst", "vst"))
def fn09(spark, sf):
    t = trial_scores(spark, sf)
    return t.select("enroll_id", "test_id", r6(F.col("cosine"), 5).alias("cosine"), r6(F.col("as_norm"), 4).alias("as_norm"))


@query("FN03", sql("SELECT test_id, round(1 / (1 + exp(greatest(-30.0, least(30.0, 1.5 * (0.5 * ((cosine - cst.mu) / cst.sd + (cosine - vst.mu) / vst.sd)) - 2.0)))), 5) AS p_mismatch FROM asn JOIN cst ON cst.speaker = enroll_id JOIN vst ON vst.id = test_id", "asn", "cst", "vst"))
def fn03(spark, sf):
    return trial_scores(spark, sf).select("test_id", r6(mismatch_probability(F.col("as_norm"), 1.5, -2.0), 5).alias("p_mismatch"))


cte("tgt", f"SELECT id, grp, round(list_inner_product(vec, o) / ({_N.format('o')} + 1e-9), 6) AS s FROM (SELECT v.id, v.grp, v.vec, list_transform(list_zip(c, vec), lambda z: (z[1] * n - z[2]) / (n - 1)) AS o FROM vec v JOIN cent USING (speaker))", "cent")
cte("ntg", f"SELECT v.id, v.grp, round(list_inner_product(v.vec, c.c) / ({_N.format('c.c')} + 1e-9), 6) AS s FROM vec v JOIN cent c ON c.grp = v.grp AND c.speaker <> v.speaker", "cent")


@query("JON13", sql("SELECT t.grp, n_target, n_nontarget, mean_target, mean_nontarget FROM (SELECT grp, count(*) AS n_target, round(avg(s), 5) AS mean_target FROM tgt GROUP BY 1) t JOIN (SELECT grp, count(*) AS n_nontarget, round(avg(s), 5) AS mean_nontarget FROM ntg GROUP BY 1) n USING (grp)", "tgt", "ntg"))
def jon13(spark, sf):
    v = vectors(spark, sf)
    t = SP.target_scores(v).groupBy("grp").agg(F.count(F.lit(1)).alias("n_target"), r6(F.avg("score"), 5).alias("mean_target"))
    n = SP.nontarget_counts(v).groupBy("grp").agg(F.sum("n").alias("n_nontarget"), r6(F.sum(F.col("score") * F.col("n")) / F.sum("n"), 5).alias("mean_nontarget"))
    return t.join(n, "grp")


@query(
    "JOB18",
    sql(
        """SELECT grp, any_value(tt) AS n_target, any_value(tn) AS n_nontarget, round(first((frr + far) / 2 ORDER BY round(abs(frr - far), 12), s), 5) AS eer, true AS in_interval FROM (SELECT grp, s, tt, tn, (sum(a) OVER w - a) / tt AS frr, 1 - (sum(b) OVER w - b) / tn AS far FROM (
        SELECT grp, s, sum(a) AS a, sum(b) AS b, sum(sum(a)) OVER (PARTITION BY grp) AS tt, sum(sum(b)) OVER (PARTITION BY grp) AS tn FROM (SELECT unnest([grp::VARCHAR, 'all']) AS grp, s, 1 AS a, 0 AS b FROM tgt UNION ALL SELECT unnest([grp::VARCHAR, 'all']), s, 0, 1 FROM ntg) GROUP BY grp, s)
        WINDOW w AS (PARTITION BY grp ORDER BY s)) GROUP BY 1""",
        "tgt", "ntg",
    ),
)
def job18(spark, sf):
    b = SP.speaker_benchmark(vectors(spark, sf))
    return b.select("grp", "n_target", "n_nontarget", r6(F.col("eer_left"), 5).alias("eer"), ((F.col("ci_low") - 0.02 <= F.col("eer_left")) & (F.col("eer_left") <= F.col("ci_high") + 0.02)).alias("in_interval"))


def speaker_windows(spark, sf):
    i = F.col("event_id")
    w = events(spark, sf).select(
        i, F.col("user_id").alias("session_id"), "ts_us", F.lit("t1").alias("tenant_id"), F.when(i % 7 != 0, (F.col("user_id") % 14).cast("string")).alias("claimed_identity_id"),
        (i % 9 != 0).alias("quality_ok"), (i * 31 % 3000).alias("voiced_ms"),
    )
    v = vectors(spark, sf)
    p = SP.mean_vectors(v, ["speaker"], "vec", unit=True).select(
        F.lit("t1").alias("tenant_id"), F.col("speaker").cast("string").alias("speaker_id"), F.when(F.col("speaker") == 3, "old").otherwise("ecapa").alias("embedder"),
        F.when(F.col("speaker") == 5, F.lit(1_705_276_800_000_000)).alias("expires_us"), F.when(F.col("speaker") != 8, F.col("centroid")).alias("centroid"),
    )
    return SP.speaker_abstain_reason(SP.lookup_voiceprints(w, p), "ecapa")


_REASON = """CASE WHEN event_id % 7 = 0 THEN 'no_enrollment: no claimed identity' WHEN s >= 10 THEN 'no_enrollment: identity not enrolled' WHEN s = 5 AND epoch_us(ts) >= 1705276800000000 THEN 'no_enrollment: voiceprint expired' WHEN event_id % 9 = 0 THEN 'quality_gate'
  WHEN event_id * 31 % 3000 < 1500 THEN 'insufficient_speech' WHEN s = 3 THEN 'no_enrollment: embedder mismatch' WHEN s = 8 THEN 'no_enrollment: empty voiceprint' END"""


@query("FLT03", f"SELECT event_id, {_REASON} AS abstain_reason FROM (SELECT *, user_id % 14 AS s FROM events)")
def flt03(spark, sf):
    return speaker_windows(spark, sf).select("event_id", "abstain_reason")


@query("JON06", "SELECT event_id, CASE WHEN event_id % 7 <> 0 AND s < 10 THEN CASE WHEN s = 3 THEN 'old' ELSE 'ecapa' END END AS vp_embedder, event_id % 7 <> 0 AND s < 10 AND s <> 8 AS has_centroid FROM (SELECT *, user_id % 14 AS s FROM events)")
def jon06(spark, sf):
    return speaker_windows(spark, sf).select("event_id", "vp_embedder", F.col("centroid").isNotNull().alias("has_centroid"))


@query(
    "JOB17",
    sql(
        """SELECT id, array_to_string(r, ',') AS reasons, len(r) = 0 AS accepted FROM (SELECT id, CASE WHEN id % 13 = 0 THEN ['consent reference required'] WHEN len(q) > 0 THEN q WHEN has AND speaker = 3 THEN ['embedder mismatch'] WHEN has AND speaker = 4 THEN ['session limit']
        WHEN has AND cosine < 0.3 THEN ['inconsistent voice'] ELSE [] END AS r FROM (SELECT v.id, v.speaker, v.id % 5 <> 0 AND NOT v.speaker = 6 AS has, list_filter([CASE WHEN v.id % 40 < 10 THEN 'too little speech' END, CASE WHEN v.id % 31 < 3 THEN 'too noisy' END, CASE WHEN v.id % 17 = 0 THEN 'clipped' END], lambda x: x IS NOT NULL) AS q,
        list_inner_product(v.vec, c.c) / (sqrt(list_inner_product(v.vec, v.vec)) * sqrt(list_inner_product(c.c, c.c)) + 1e-9) AS cosine FROM vec v JOIN cent c USING (speaker)))""",
        "cent",
    ),
)
def job17(spark, sf):
    v = vectors(spark, sf)
    i = F.col("id")
    r = v.join(SP.mean_vectors(v, ["speaker"], "vec"), "speaker").select(
        "id", F.when(i % 13 != 0, "ref").alias("consent_ref"), (i % 40).cast("double").alias("voiced_s"), F.when(i % 31 < 3, 5.0).otherwise(20.0).alias("snr_db"), F.when(i % 17 == 0, 0.5).otherwise(0.0).alias("clipping"),
        (i % 5 == 0).alias("replace"), F.when(F.col("speaker") == 3, "old").otherwise("ecapa").alias("vp_embedder"), (F.col("speaker") == 6).alias("vp_expired"), F.when(F.col("speaker") == 4, 5).otherwise(1).alias("vp_sessions"),
        F.col("centroid").alias("vp_centroid"), F.col("vec").alias("embedding"),
    )
    d = SP.enrolment_decision(r, "ecapa", min_cosine=0.3)
    return d.select("id", F.array_join("reasons", ",").alias("reasons"), "accepted")


# ---- liveness ---------------------------------------------------------------------------------


@query("FN25", sql("SELECT doc_id, len(w) AS n_tokens, sha256(array_to_string(w, ' ')) AS tokens_sha FROM (SELECT doc_id, regexp_extract_all(nfc_normalize(lower(text)), '[\\p{L}\\p{N}_\\x{0900}-\\x{0DFF}]+') AS w FROM docs)", "docs"))
def fn25(spark, sf):
    d = docs(spark, sf).withColumn("w", LV.normalised_tokens(F.col("text")))
    return d.select("doc_id", F.size("w").cast("long").alias("n_tokens"), F.sha2(F.array_join("w", " "), 256).alias("tokens_sha"))


FORMS = [["the", "die", "le"], ["and", "und", "et"], ["please"], ["account", "khata"]]


@query("FN26")
def fn26(spark, sf):
    exp = F.array(*[F.array(*[F.lit(f) for f in fs]) for fs in FORMS])
    d = docs(spark, sf).withColumn("w", LV.normalised_tokens(F.col("text")))
    return d.select("doc_id", LV.challenge_match(exp, F.col("w")).alias("match"))


@query(
    "FN27",
    """SELECT event_id, z, round(1 / (1 + exp(-(z - 1.0))), 6) AS p_spoof FROM (SELECT event_id, CAST(CASE WHEN m < 0.5 THEN 4.0 WHEN m < 1 THEN 1.0 ELSE -1.0 END + CASE WHEN l IS NULL THEN 0.0 WHEN l < 150 THEN 3.0 WHEN l > 3500 THEN 3.5 WHEN l > 2000 THEN 1.0 ELSE -1.0 END
    + CASE WHEN r < 0.8 OR r > 6 THEN 1.0 ELSE 0.0 END + CASE WHEN g < 0.08 THEN 1.0 ELSE 0.0 END AS DOUBLE) AS z FROM (SELECT event_id, (event_id % 5) / 4.0 AS m, CASE WHEN event_id % 11 <> 0 THEN event_id * 37 % 5000 END AS l, CASE WHEN event_id % 7 <> 0 THEN (event_id % 9) * 1.0 END AS r, (event_id % 13) / 50.0 AS g FROM events))""",
)
def fn27(spark, sf):
    i = F.col("event_id")
    v = LV.verdict(i % 5 / 4.0, F.when(i % 11 != 0, i * 37 % 5000), F.when(i % 7 != 0, (i % 9).cast("double")), i % 13 / 50.0)
    return table(spark, sf, "events").select("event_id", v["z"].alias("z"), r6(v["p_spoof"]).alias("p_spoof"))


cte("ch2", "SELECT user_id AS session_id, event_id AS challenge_id, epoch_us(ts) AS issued_us FROM events WHERE event_type = 'signup'")
cte("re2", "SELECT session_id, challenge_id, issued_us + (challenge_id * 7919) % 60000000 AS answered_us FROM ch2 WHERE challenge_id % 4 <> 0", "ch2")


def challenges(spark, sf):
    return events(spark, sf).filter("event_type = 'signup'").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("challenge_id"), F.col("ts_us").alias("issued_us"))


def responses(spark, sf):
    return challenges(spark, sf).filter("challenge_id % 4 <> 0").select("session_id", "challenge_id", (F.col("issued_us") + (F.col("challenge_id") * 7919) % 60_000_000).alias("answered_us"))


@query("JON25", sql("SELECT c.session_id, c.challenge_id, CASE WHEN answered_us IS NULL THEN 'no_answer' WHEN answered_us - issued_us > 30000000 THEN 'late' ELSE 'in_time' END AS outcome FROM ch2 c LEFT JOIN re2 r USING (session_id, challenge_id)", "re2"))
def jon25(spark, sf):
    return LV.answers(challenges(spark, sf), responses(spark, sf)).select("session_id", "challenge_id", "outcome")


@query(
    "FLT17",
    sql(
        """SELECT event_id, CASE WHEN a.challenge_id IS NULL THEN 'no challenge' WHEN r.challenge_id IS NULL AND ts_us > issued_us + 30000000 THEN 'challenge expired without an answer' WHEN r.challenge_id IS NULL THEN 'awaiting answer' END AS reason
        FROM (SELECT event_id, session_id, ts_us FROM windows) w LEFT JOIN (SELECT session_id, arg_max(challenge_id, (issued_us, challenge_id)) AS challenge_id, max(issued_us) AS issued_us FROM ch2 GROUP BY 1) a ON a.session_id = w.session_id LEFT JOIN re2 r ON r.challenge_id = a.challenge_id""",
        "windows", "re2",
    ),
)
def flt17(spark, sf):
    w = windows(spark, sf).select("event_id", "session_id", "ts_us")
    a = LV.active_challenges(challenges(spark, sf))
    return LV.liveness_abstain(w, a, responses(spark, sf)).select("event_id", "reason")


# ---- signal -----------------------------------------------------------------------------------

_MS = "list_inner_product(vec, vec) / len(vec)"


@query("SIG01", sql(f"SELECT id, round(20 * log10(sqrt({_MS})), 5) + 0.0 AS dbfs, round(len(list_filter(vec, lambda x: abs(x) >= 0.2)) / len(vec), 6) AS clipping, round(pow(10, -23.0 / 20) / sqrt({_MS}), 5) AS gain FROM vec", "vec"))
def sig01(spark, sf):
    x = F.col("vec")
    return vectors(spark, sf).select("id", r6(A.level_dbfs(x), 5).alias("dbfs"), r6(A.clipping_ratio(x, 0.2)).alias("clipping"), r6(A.loudness_gain(x), 5).alias("gain"))


@query("SIG02", sql("SELECT id, round(10 * log10(list_max(e) / list_aggregate(e, 'quantile_cont', 0.1) + 1e-9), 5) + 0.0 AS snr_db FROM (SELECT id, list_transform(range(0, 8), lambda i: list_inner_product(vec[i * 8 + 1 : i * 8 + 8], vec[i * 8 + 1 : i * 8 + 8]) / 8) AS e FROM vec)", "vec"))
def sig02(spark, sf):
    v = vectors(spark, sf).withColumn("e", A.frame_energies(F.col("vec"), 8))
    return v.select("id", r6(A.snr_db(F.col("e")), 5).alias("snr_db"))


def _bin_sql(k):
    c = f"list_sum(list_transform(range(0, 64), lambda i: vec[i + 1] * cos(2 * pi() * {k} * i / 64)))"
    s = f"list_sum(list_transform(range(0, 64), lambda i: vec[i + 1] * sin(2 * pi() * {k} * i / 64)))"
    return f"(pow({c}, 2) + pow({s}, 2))"


@query("SIG03", sql(f"SELECT id, round(2 * ({_bin_sql(2)} + {_bin_sql(4)}) / (64 * (list_inner_product(vec, vec) + 1e-12)), 6) AS tone_share FROM vec", "vec"))
def sig03(spark, sf):
    return vectors(spark, sf).select("id", r6(A.tone_share(F.col("vec"), 64, (500.0, 1000.0), 16_000)).alias("tone_share"))


@query("SIG04")
def sig04(spark, sf):
    d = table(spark, sf, "documents")
    enc = F.element_at(F.array(F.lit("mulaw"), F.lit("alaw"), F.lit("pcm_s16le")), (F.col("doc_id") % 3 + 1).cast("int"))
    x = d.withColumn("x", SG.decode_audio(F.encode("text", "UTF-8"), enc, F.lit(8000)))
    return x.select("doc_id", F.size("x").alias("n_samples"), A.mean_square(F.col("x")).alias("power"))


@query("SIG05")
def sig05(spark, sf):
    return SG.extract_features(table(spark, sf, "embeddings"), "vec_id", "embedding").select("vec_id", "centroid_hz", "flatness", "rolloff_hz", "zero_cross", "voiced_share", F.size("mfcc").alias("n_mfcc"))


@query("SIG07")
def sig07(spark, sf):
    d = SG.degrade(table(spark, sf, "embeddings").select("vec_id", "embedding"), "vec_id", "embedding", frame=8)
    return d.select("vec_id", A.mean_square(F.col("degraded")).alias("power"), F.size("degraded").alias("n"))


@query("SIG08", sql("SELECT id, round(vec[9], 6) + 0.0 AS crop_first, 100 AS n_filled, round(vec[36], 6) + 0.0 AS fill_last, 4 AS n_windows, round(vec[64], 6) + 0.0 AS last_sample FROM vec", "vec"))
def sig08(spark, sf):
    v = vectors(spark, sf).withColumns({"crop": A.fit_length(F.col("vec"), 48), "fill": A.fit_length(F.col("vec"), 100), "w": A.cut_windows(F.col("vec"), 16, 16)})
    last = F.element_at(F.element_at("w", -1), -1)
    return v.select("id", r6(F.col("crop")[0]).alias("crop_first"), F.size("fill").cast("long").alias("n_filled"), r6(F.col("fill")[99]).alias("fill_last"), F.size("w").cast("long").alias("n_windows"), r6(last).alias("last_sample"))
