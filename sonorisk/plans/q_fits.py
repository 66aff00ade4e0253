"""Queries: distributed fits, extension points, run records and reports."""

from pyspark.sql import functions as F

from sonorisk.functions import arrays as A, scorers as SC
from sonorisk.functions.math import logit, r6
from sonorisk.operators import bootstrap, fits, protocols as P
from sonorisk.plans.fixtures import head_scores, scores, sql, table, windows
from sonorisk.plans.q_corpus import manifest
from sonorisk.plans.q_fusion import fused
from sonorisk.plans.q_metrics import BASE, evaluation_rows, summary_cte
from sonorisk.plans.q_policy import bodies, erasures, models, tampered
from sonorisk.plans.q_session import rec_sql
from sonorisk.plans.q_signal import trial_scores, vectors
from sonorisk.plans.q_text import docs
from sonorisk.plans.registry import query
from sonorisk.scale import shared_path
from sonorisk.sources import runs as R


def labelled(spark, sf):
    h = head_scores(spark, sf).filter("p_spoof is not null").withColumn("raw", F.round(2 * logit("p_spoof") + 1, 6))
    # labels follow the score, so there is something to calibrate
    return h.withColumn("is_spoof", F.col("p_spoof") > F.pmod(F.xxhash64("event_id"), F.lit(1000)) / 1000.0)


@query("ML01")
def ml01(spark, sf):
    d = labelled(spark, sf)
    p = fits.fit_platt(d, ["head_id", "model_version"], "raw", F.col("is_spoof"))
    t = fits.fit_temperature(d, ["head_id", "model_version"], "raw", F.col("is_spoof"), steps=8).drop("n_fit")
    return p.join(t, ["head_id", "model_version"])


@query("ML06")
def ml06(spark, sf):
    s = trial_scores(spark, sf).withColumn("is_spoof", F.col("test_id") % 2 == 1).withColumn("neg", -F.round("as_norm", 6)).withColumn("set", F.lit("all"))
    f = fits.fit_platt(s, ["set"], "neg", F.col("is_spoof"), l2=0.0)
    return f.select(F.col("a").alias("scale"), (-F.col("b")).alias("bias"), "n_fit")


def head_logits(spark, sf):
    f = fused(spark, sf).select("session_id", "window_id", "event_id", *[(F.col(f"signed_{h}") * 2).alias(f"l_{h}") for h in "ABC"])
    noise = F.pmod(F.xxhash64("event_id"), F.lit(1000)) / 1000.0
    return f.withColumn("y", (1 / (1 + F.exp(-F.coalesce("l_A", F.lit(0.0)) - 0.3 * F.coalesce("l_B", F.lit(0.0))))) > noise)


LOGITS = {h: f"l_{h}" for h in "ABC"}


@query("ML02")
def ml02(spark, sf):
    m = fits.fit_fusion(head_logits(spark, sf), {h: F.col(c) for h, c in LOGITS.items()}, F.col("y"))
    rows = [(h, m.weights[h], m.missing[h], m.bias) for h in m.weights]
    return spark.createDataFrame(rows, "head_id string, weight double, missing double, bias double")


@query("ML03")
def ml03(spark, sf):
    return fits.ablation(head_logits(spark, sf), {h: F.col(c) for h, c in LOGITS.items()}, F.col("y"), F.col("event_id") % 3 != 0)


@query("ML04")
def ml04(spark, sf):
    return fits.symmetry_check(manifest(spark, sf), "codec_chain", "utt_id", F.col("label") == "spoof")


@query("ML05")
def ml05(spark, sf):
    v = vectors(spark, sf).select("id", "speaker", *[F.when(F.col("id") % 11 != i, F.col("vec")[i]).alias(f"f{i}") for i in range(64)])
    _, imp = fits.fit_trees(v, [f"f{i}" for i in range(64)], F.col("speaker") < 5, trees=5)
    return imp


# ---- extension points -------------------------------------------------------------------------


@query("UDF01")
def udf01(spark, sf):
    w = table(spark, sf, "embeddings").select(F.col("vec_id").alias("window_id"), "embedding")
    s = SC.score_windows(w, ["window_id"], "embedding", SC.build_scorers(["flatness", "energy"]))
    return s.select("window_id", "head_id", "p_spoof", "abstain", "abstain_reason")


@query("UDF02", "SELECT 'A' AS head_id, 'A@energy-base-v0.1.0' AS model_version, count(*) AS n FROM embeddings")
def udf02(spark, sf):
    w = table(spark, sf, "embeddings").select(F.col("vec_id").alias("window_id"), "embedding")
    s = SC.score_windows(w, ["window_id"], "embedding", SC.build_scorers(["energy"]))
    return s.groupBy("head_id", "model_version").agg(F.count(F.lit(1)).alias("n"))


@query("UDF03")
def udf03(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("s", SC.utterance_scores(F.col("embedding"), SC.FlatnessScorer, 32, 16))
    return e.select("vec_id", "s.score", "s.p_spoof", F.size("s.window_scores").alias("n_windows"))


@query("UDF04", "SELECT vec_id, len(embedding) // 2 + 1 AS dim, 1.0 AS length FROM embeddings")
def udf04(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("v", SC.embed(F.col("embedding"), SC.spectrum_embedder))
    return e.select("vec_id", F.size("v").alias("dim"), F.round(A.norm(F.col("v")), 6).alias("length"))


@query("UDF05", "SELECT vec_id, len(list_filter(embedding, lambda x: x > 0)) / len(embedding) > 0.6 AS present, round(len(list_filter(embedding, lambda x: x > 0)) / len(embedding), 6) AS probability FROM embeddings")
def udf05(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("w", SC.detect_watermark(F.col("embedding"), SC.sign_detector))
    return e.select("vec_id", "w.present", F.round("w.probability", 6).alias("probability"))


@query("UDF06", sql("SELECT doc_id, array_to_string(list_filter(['otp', 'transfer', 'police'], lambda k: contains(lower(text), k)), ',') AS labels FROM docs", "docs"))
def udf06(spark, sf):
    return docs(spark, sf).select("doc_id", F.array_join(SC.classify_text(F.col("text"), SC.keyword_classifier), ",").alias("labels"))


@query("UDF07")
def udf07(spark, sf):
    steps = [lambda x, r: x * 0.5, lambda x, r: x + 0.01 * r.standard_normal(len(x))]
    e = table(spark, sf, "embeddings").withColumn("y", SC.apply_chain(F.col("embedding"), F.col("vec_id"), steps))
    return e.select("vec_id", F.size("y").alias("n"), A.mean_square(F.col("y")).alias("power"))


@query("UDF08")
def udf08(spark, sf):
    def at_median(frr, far):
        import numpy as np

        i, r = np.argmax(frr >= 0.5, axis=1), np.arange(len(frr))
        return np.where(frr[r, i] >= 0.5, 0.0, 1.0), far[r, i]

    miss_at_median = bootstrap.ByRange(at_median, lambda frr0, far0, frr, far: (frr0 < 0.5) & (frr >= 0.5))
    return bootstrap.bootstrap_interval(scores(spark, sf), ["gender"], miss_at_median, n=100)


@query("UDF09", "SELECT vec_id, unnest(range(0, 4)) AS window_id, 16 AS n FROM embeddings")
def udf09(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.posexplode(A.cut_windows(F.col("embedding"), 16, 16)).alias("window_id", "w"))
    return e.select("vec_id", F.col("window_id").cast("long").alias("window_id"), F.size("w").cast("long").alias("n"))


def _u32(tag):
    return f"CAST(CAST(('0x' || substr(sha256('42:{tag}:' || session_id || ':' || window_id), 1, 8)) AS UBIGINT) AS DOUBLE) / 4294967295.0"


@query("UDF10", sql(f"SELECT session_id, window_id, {_u32('A_abstain')} < 0.1 AS abstain, round(CASE WHEN NOT {_u32('A_abstain')} < 0.1 THEN {_u32('A')} END, 9) AS p_spoof FROM windows", "windows"))
def udf10(spark, sf):
    s = SC.stub_score("A", F.col("session_id"), F.col("window_id"), 42, 0.1)
    return windows(spark, sf).select("session_id", "window_id", s["abstain"].alias("abstain"), F.round(s["p_spoof"], 9).alias("p_spoof"))


# ---- feature tables and run records -----------------------------------------------------------


@query("SRC17", "SELECT vec_id % 3 AS split, count(*) AS n FROM embeddings GROUP BY 1")
def src17(spark, sf):
    from sonorisk.sources.features import materialise_features

    path = shared_path(spark, "features")
    e = table(spark, sf, "embeddings").select("vec_id", (F.col("vec_id") % 3).alias("split"), "embedding")
    materialise_features(e.filter("vec_id % 2 = 0"), path, "vec_id", "embedding")
    materialise_features(e, path, "vec_id", "embedding")  # resumes: only the other half is computed
    return spark.read.parquet(path).groupBy(F.col("split").cast("long").alias("split")).agg(F.count(F.lit(1)).alias("n"))


summary_cte("ra", f"SELECT 'language' AS protocol, coalesce(language, 'unknown') AS slice, {BASE}")
summary_cte("rb", "SELECT 'language' AS protocol, coalesce(language, 'unknown') AS slice, label, -p_spoof AS score, p_spoof FROM scores WHERE language IS DISTINCT FROM 'l3'")


def two_runs(spark, sf):
    s = scores(spark, sf)
    a = P.summarize(P.with_slices(s, [P.group_slice("language", "language")]))
    t = s.filter("language is null or language <> 'l3'").withColumn("score", -F.col("p_spoof"))
    return a, P.summarize(P.with_slices(t, [P.group_slice("language", "language")]))


@query("JON21", sql("SELECT slice, round(a.eer, 6) AS eer_before, round(b.eer, 6) AS eer_after, round(b.eer - a.eer, 6) + 0.0 AS delta, coalesce(b.eer - a.eer > 0.001, false) AS regression FROM ra_s a FULL JOIN rb_s b USING (slice)", "ra_s", "rb_s"))
def jon21(spark, sf):
    c = R.compare_runs(*two_runs(spark, sf), "language", 0.001)
    return c.select("slice", *[r6(F.col(x)).alias(x) for x in ("eer_before", "eer_after", "delta")], "regression")


@query("SRC13", sql("SELECT run_id, slice, n_bona, round(eer, 6) AS eer FROM (SELECT 'r1' AS run_id, slice, n_bona, eer FROM ra_s UNION ALL SELECT 'r2', slice, n_bona, eer FROM rb_s)", "ra_s", "rb_s"))
def src13(spark, sf):
    path = shared_path(spark, "runs")
    a, b = two_runs(spark, sf)
    R.save_run(b, path, "r1")
    R.save_run(a, path, "r1")  # the second save replaces the first
    R.save_run(b, path, "r2")
    return R.load_runs(spark, path, ["r1", "r2"]).select("run_id", "slice", "n_bona", r6(F.col("eer")).alias("eer"))


@query("SRC14", "SELECT 'lt-load_test.' || user_id AS row_id, user_id AS calls, CAST(count(*) AS VARCHAR) AS p50, CAST(max(event_id) AS VARCHAR) AS p95, 'yes' AS keeps_up FROM events GROUP BY user_id")
def src14(spark, sf):
    path = shared_path(spark, "loadtests") + "/load test.md"
    g = table(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("m"))
    row = F.concat(F.lit("| "), F.concat_ws(" | ", F.col("user_id").cast("string"), F.lit("x"), F.col("n").cast("string"), F.col("m").cast("string"), *[F.lit(v) for v in ("p99", "a", "b", "0", "1", "yes")]), F.lit(" |"))
    head = F.array(F.lit("| Calls | Mode | p50 | p95 | p99 | . | . | Degraded | Timeouts | Keeps up |"), row)
    g.select(F.explode(head).alias("value")).write.text(path)
    t = R.read_loadtests(spark, path)
    return t.select(F.regexp_replace("row_id", r"^lt-[^.]*", "lt-load_test").alias("row_id"), "calls", "p50", "p95", "keeps_up")


@query("JOB16")
def job16(spark, sf):
    return R.report_rows(evaluation_rows(spark, sf).withColumn("run_id", F.lit("r1")))


@query(
    "JON26",
    sql(
        """SELECT version, s.s_suppkey IS NOT NULL AS evaluated, CASE WHEN s.s_suppkey IS NULL THEN '' ELSE array_to_string(list_filter(['ds' || (s.s_suppkey % 5), 'ds' || (s.s_suppkey % 7)], lambda x, i: x NOT IN ('ds1', 'ds4') AND (i = 1 OR s.s_suppkey % 5 <> s.s_suppkey % 7)), ',') END AS nc
        FROM models LEFT JOIN supplier s ON s.s_suppkey = run""",
        "models",
    ).replace("SELECT version, s.s_suppkey IS NOT NULL", "SELECT version, s.s_suppkey IS NOT NULL"),
)
def jon26(spark, sf):
    k = F.col("s_suppkey")
    ds = lambda n: F.concat(F.lit("ds"), (k % n).cast("string"))
    runs = table(spark, sf, "supplier").select(k.alias("run_id"), F.lit(0.1).alias("eer"), F.lit("pass").alias("gate"), F.array(ds(5), ds(7)).alias("train_datasets"))
    data = table(spark, sf, "nation").filter("n_nationkey < 6").select(F.concat(F.lit("ds"), F.col("n_nationkey").cast("string")).alias("name"), F.col("n_nationkey").isin(1, 4).alias("commercial_use"))
    c = R.model_cards(models(spark, sf), runs, data)
    # keep the run's order of datasets so both engines list them alike
    ordered = F.array_distinct(F.filter(F.coalesce("train_datasets", F.array().cast("array<string>")), lambda x: F.array_contains("non_commercial", x)))
    return c.select("version", "evaluated", F.array_join(ordered, ",").alias("nc"))


@query(
    "JOB20",
    rec_sql(
        f"""SELECT session_id, section, count(*) AS n, max(position) AS last_position FROM (SELECT session_id, 'timeline' AS section, window_id AS position FROM r UNION ALL
        SELECT o_custkey, 'bundle', o_orderkey FROM orders WHERE o_orderkey % 997 <> 5 UNION ALL SELECT DISTINCT session_id, 'version', 0 FROM (SELECT DISTINCT session_id, head_id, model_version FROM head_scores)) GROUP BY 1, 2""".replace("SELECT DISTINCT session_id, 'version', 0 FROM", "SELECT session_id, 'version', 0 FROM"),
        "pre", "head_scores",
    ),
)
def job20(spark, sf):
    from sonorisk.operators.evidence import verification_report
    from sonorisk.operators.temporal import session_timeline

    v = verification_report(tampered(spark, sf), bodies(spark, sf), erasures(spark, sf), "tenant")
    r = R.call_review(session_timeline(fused(spark, sf)), v, head_scores(spark, sf))
    return r.groupBy("session_id", "section").agg(F.count(F.lit(1)).alias("n"), F.max("position").alias("last_position"))
