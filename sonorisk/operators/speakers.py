"""Speaker scoring: voiceprint centroids, cohort statistics, normalised scores, trials.

All-against-all scoring is a blocked matrix product: a grid of blocks of bounded size is dealt by one
shuffle, each left batch meets each right block once in a bounded task, and only top-k values or score
counts leave the task.  No cross join is planned and no pair list is emitted.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W

from sonorisk.functions.arrays import as_double, cosine, dot, norm, subtract
from sonorisk.scale import materialize, small_or_plain

BLOCK_ROWS = 4096
PRODUCTS = 1 << 20  # scores that a task holds at once


def mean_vectors(df: DataFrame, keys: Sequence[str], vec: str, unit: bool = False) -> DataFrame:
    """Mean vector per key (unit length on request); vectors are summed whole on the map side.

    Vectors that are NULL or hold a NULL are left out.
    """
    p = df.filter(F.col(vec).isNotNull() & ~F.exists(vec, lambda x: x.isNull())).select(*keys, array_to_vector(F.col(vec).cast("array<double>")).alias("_v"))
    c = p.groupBy(*keys).agg(Summarizer.mean(F.col("_v")).alias("_m")).select(*keys, vector_to_array("_m").alias("centroid"))
    if unit:
        c = c.withColumn("_n", norm(F.col("centroid"))).withColumn("centroid", F.transform("centroid", lambda x: x / (F.col("_n") + 1e-9))).drop("_n")
    return c


def voiceprint_centroids(prints: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Centroid per condition, and over all conditions as condition ``all``."""
    every = prints.withColumn("condition", F.explode(F.array("condition", F.lit("all"))))
    return mean_vectors(every, [*keys, "condition"], "embedding", unit=True)


def block_product(left: DataFrame, right: DataFrame, reduce, schema: str, extra: Sequence[str] = ()) -> DataFrame:
    """Apply ``reduce(group, rows, L, rids, R) -> DataFrame`` to left rows and blocks of right ones of a group.

    left: (id, grp, vec, extra); right: (id, grp, vec).  A grid of blocks is dealt by one shuffle: a left row goes to every
    right block of its group, a right row to every left block.  A task keeps the right block (some ``BLOCK_ROWS`` vectors) and
    streams the left rows past it, as many at a time as give ``PRODUCTS`` scores; no vector reaches the driver, however
    many there are.
    """
    spark = left.sparkSession
    across = max(1, -(-right.count() // BLOCK_ROWS))
    down = max(spark.sparkContext.defaultParallelism, -(-left.count() // (8 * BLOCK_ROWS)))
    own = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    vec = F.col("vec").cast("array<double>").alias("vec")
    rows = left.select("grp", own(down).alias("_down"), every(across).alias("_across"), F.lit(1).alias("_side"), "id", F.lit(None).cast(right.schema["id"].dataType).alias("_rid"), vec, *extra)
    none = [F.lit(None).cast(left.schema[c].dataType).alias(c) for c in ("id", *extra)]
    blocks = right.select("grp", every(down).alias("_down"), own(across).alias("_across"), F.lit(0).alias("_side"), F.col("id").alias("_rid"), vec, *none)
    place = ["grp", "_down", "_across"]
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return rows.unionByName(blocks).repartition(n, *place).sortWithinPartitions(*place, "_side").mapInPandas(_products(reduce, place, [*extra]), schema)


def _products(reduce, place: list[str], extra: list[str]):
    def run(batches):
        at, ids, vectors = None, [], []
        for pdf in batches:
            for key, rows in pdf.groupby(place, sort=False, dropna=False):
                key = tuple(None if k != k else k for k in key)
                if key != at:
                    at, ids, vectors = key, [], []
                right = rows[rows["_side"] == 0]
                if len(right):
                    ids.append(right["_rid"].to_numpy(dtype=object))
                    vectors.append(np.stack(right["vec"].to_numpy()).astype(float))
                left = rows[rows["_side"] == 1]
                if len(left) and ids:
                    ids, vectors = [np.concatenate(ids)], [np.concatenate(vectors)]
                    left, step = left[["id", "grp", "vec", *extra]], max(1, PRODUCTS // len(ids[0]))
                    for start in range(0, len(left), step):
                        part = left.iloc[start : start + step]
                        yield reduce(key[0], part, np.stack(part["vec"].to_numpy()).astype(float), ids[0], vectors[0])

    return run


def cohort_statistics(vectors: DataFrame, cohort: DataFrame, k: int = 200, floor: float = 1e-3) -> DataFrame:
    """(id, mu, sd) of the k best cohort cosines of each vector; the sd has a floor.

    vectors: (id, vec); cohort: (id, vec) of unit vectors.
    """
    def top(_, rows, a, __, b):
        s = (a / (np.linalg.norm(a, axis=1, keepdims=True) + 1e-9)) @ b.T
        kk = min(k, s.shape[1])
        best = -np.partition(-s, kk - 1, axis=1)[:, :kk]
        return pd.DataFrame({"id": np.repeat(rows["id"].to_numpy(), kk), "s": best.ravel()})

    one = lambda d: d.withColumn("grp", F.lit(0).cast("long"))
    best = block_product(one(vectors), one(cohort), top, "id long, s double")
    w = W.partitionBy("id").orderBy(F.col("s").desc())
    kept = best.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k)
    return kept.groupBy("id").agg(F.avg("s").alias("mu"), F.greatest(F.stddev_pop("s"), F.lit(floor)).alias("sd"))


def centred_cohort(cohort: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(unit cohort after removing its mean, the mean as one row)."""
    unit = cohort.withColumn("_n", norm(F.col("vec"))).select("id", F.transform("vec", lambda x: x.cast("double") / (F.col("_n") + 1e-9)).alias("vec"))
    mean = mean_vectors(unit, [], "vec").withColumnRenamed("centroid", "mean")
    c = unit.join(F.broadcast(mean)).select("id", subtract(F.col("vec"), F.col("mean")).alias("vec"))
    c = c.withColumn("_n", norm(F.col("vec"))).select("id", F.transform("vec", lambda x: x / (F.col("_n") + 1e-9)).alias("vec"))
    return c, mean


def normalised_scores(trials: DataFrame, enroll: DataFrame, test: DataFrame, cohort: DataFrame, k: int = 200) -> DataFrame:
    """Cosine and symmetric normalised score per trial (enroll_id, test_id).

    With fewer than ten cohort vectors the normalised score is the raw cosine.
    """
    e, t = enroll.select(F.col("id").alias("enroll_id"), F.col("vec").alias("e")), test.select(F.col("id").alias("test_id"), F.col("vec").alias("t"))
    if cohort.limit(10).count() < 10:
        j = trials.join(e, "enroll_id").join(t, "test_id")
        return j.select("enroll_id", "test_id", cosine(F.col("e"), F.col("t")).alias("cosine")).withColumn("as_norm", F.col("cosine"))
    c, mean = centred_cohort(cohort)
    centre = lambda d: d.join(F.broadcast(mean)).select("id", subtract(F.col("vec"), F.col("mean")).alias("vec"))
    ec, tc = centre(enroll), centre(test)
    se, st = cohort_statistics(ec, c, k), cohort_statistics(tc, c, k)
    side = lambda d, s, p, i: d.join(s, "id").select(F.col("id").alias(i), F.col("vec").alias(f"{p}_vec"), F.col("mu").alias(f"{p}_mu"), F.col("sd").alias(f"{p}_sd"))
    j = trials.join(small_or_plain(side(ec, se, "e", "enroll_id")), "enroll_id").join(side(tc, st, "t", "test_id"), "test_id")
    j = j.withColumn("cosine", cosine(F.col("e_vec"), F.col("t_vec")))
    s = F.col("cosine")
    return j.select("enroll_id", "test_id", "cosine", (0.5 * ((s - F.col("e_mu")) / F.col("e_sd") + (s - F.col("t_mu")) / F.col("t_sd"))).alias("as_norm"))


def target_scores(utts: DataFrame) -> DataFrame:
    """Each utterance against the mean of its speaker's other utterances.  utts: (id, speaker, grp, vec)."""
    sums = utts.groupBy("speaker").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").join(mean_vectors(utts, ["speaker"], "vec"), "speaker")
    j = utts.join(small_or_plain(sums), "speaker")
    j = j.withColumn("_n", F.col("_n").cast("double"))
    others = F.zip_with("centroid", "vec", lambda m, v: (m * F.col("_n") - v.cast("double")) / (F.col("_n") - 1))
    j = j.withColumn("_o", others)
    return j.select("id", "speaker", "grp", (dot(F.col("vec"), F.col("_o")) / (norm(F.col("_o")) + 1e-9)).alias("score"))


GRID = 1_000_000  # non-target scores are counted on this grid


def nontarget_counts(utts: DataFrame) -> DataFrame:
    """(grp, score, n): scores against the mean of every other speaker of the same group, as counts."""
    cent = mean_vectors(utts, ["grp", "speaker"], "vec").select(F.col("speaker").alias("id"), "grp", F.col("centroid").alias("vec"))

    def counts(grp, rows, a, rids, b):
        s = np.round(a @ (b / (np.linalg.norm(b, axis=1, keepdims=True) + 1e-9)).T * GRID).astype(np.int64)
        v, n = np.unique(s[rows["speaker"].to_numpy(dtype=object)[:, None] != rids[None, :]], return_counts=True)
        return pd.DataFrame({"grp": grp, "cell": v, "n": n})

    kind = utts.schema["grp"].dataType.simpleString()
    cells = block_product(utts, cent, counts, f"grp {kind}, cell long, n long", ["speaker"])
    return cells.groupBy("grp", "cell").agg(F.sum("n").alias("n")).select("grp", (F.col("cell") / float(GRID)).alias("score"), "n")


def speaker_benchmark(utts: DataFrame) -> DataFrame:
    """EER with its interval per language, and over all of them as ``all``.

    Target scores are leave-one-out; the others go against the means of other speakers.  Scores have six decimals.
    """
    from sonorisk.operators.bootstrap import interval
    from sonorisk.operators.curves import cumulative, left_sided_eer, with_rates

    t = target_scores(utts).select("grp", F.round("score", 6).alias("score")).groupBy("grp", "score").agg(F.count(F.lit(1)).alias("n_bona"))
    n = nontarget_counts(utts).select("grp", F.round("score", 6).alias("score"), F.col("n").alias("n_spoof"))
    c = t.unionByName(n, allowMissingColumns=True).groupBy("grp", "score").agg(
        F.coalesce(F.sum("n_bona"), F.lit(0)).alias("n_bona"), F.coalesce(F.sum("n_spoof"), F.lit(0)).alias("n_spoof")
    )
    every = c.groupBy("score").agg(F.sum("n_bona").alias("n_bona"), F.sum("n_spoof").alias("n_spoof"))
    c = materialize(c.withColumn("grp", F.col("grp").cast("string")).unionByName(every.withColumn("grp", F.lit("all"))))
    curve = with_rates(cumulative(c, ["grp"], ("bona", "spoof")))
    e = left_sided_eer(curve, ["grp"]).join(interval(c, ["grp"]).select("grp", "ci_low", "ci_high"), "grp")
    sizes = c.groupBy("grp").agg(F.sum("n_bona").alias("n_target"), F.sum("n_spoof").alias("n_nontarget"))
    return e.join(sizes, "grp").filter((F.col("n_target") >= 5) & (F.col("n_nontarget") >= 5))


# ---- voiceprint gates -------------------------------------------------------------------------


def speaker_abstain_reason(j: DataFrame, embedder: str, min_voiced_ms: int = 1500, baseline: bool = False) -> DataFrame:
    """Ordered reasons why a window cannot be scored against a voiceprint; NULL = it can.

    ``j``: windows left joined with voiceprints (vp_embedder, vp_expires_us, centroid).
    """
    c = F.col
    reason = (
        F.when(F.coalesce(c("claimed_identity_id"), F.lit("")).isin(""), "no_enrollment: no claimed identity")
        .when(c("vp_embedder").isNull(), "no_enrollment: identity not enrolled")
        .when(c("vp_expires_us") <= c("ts_us"), "no_enrollment: voiceprint expired")
        .when(~c("quality_ok"), "quality_gate")
        .when(c("voiced_ms") < min_voiced_ms, "insufficient_speech")
        .when(c("vp_embedder") != embedder, "no_enrollment: embedder mismatch")
        .when(F.lit(baseline), "untrained")
        .when(c("centroid").isNull(), "no_enrollment: empty voiceprint")
    )
    return j.withColumn("abstain_reason", reason)


def lookup_voiceprints(windows: DataFrame, prints: DataFrame) -> DataFrame:
    """Windows with the claimed speaker's voiceprint of the same tenant, if any."""
    p = prints.select("tenant_id", F.col("speaker_id").alias("claimed_identity_id"), F.col("embedder").alias("vp_embedder"), F.col("expires_us").alias("vp_expires_us"), "centroid")
    return windows.join(small_or_plain(p), ["tenant_id", "claimed_identity_id"], "left")


def enrolment_decision(requests: DataFrame, embedder: str, min_voiced_s: float = 10.0, min_snr_db: float = 10.0, max_clip: float = 0.01, max_sessions: int = 5, min_cosine: float = 0.5) -> DataFrame:
    """accepted and reasons per enrolment request.

    requests: consent_ref, voiced_s, snr_db, clipping, replace, vp_embedder, vp_expired, vp_sessions,
    vp_centroid, embedding (voiceprint fields NULL when there is none).
    """
    c = F.col
    none = F.array().cast("array<string>")
    has = c("vp_embedder").isNotNull() & ~c("replace") & ~F.coalesce("vp_expired", F.lit(False))
    quality = F.filter(
        F.array(F.when(c("voiced_s") < min_voiced_s, "too little speech"), F.when(c("snr_db") < min_snr_db, "too noisy"), F.when(c("clipping") > max_clip, "clipped")), lambda x: x.isNotNull()
    )
    r = requests.withColumns({"_q": quality, "_has": has}).withColumn("consistency_cosine", F.when(F.col("_has"), cosine(c("vp_centroid"), c("embedding"))))
    reasons = (
        F.when(F.coalesce(c("consent_ref"), F.lit("")).isin(""), F.array(F.lit("consent reference required")))
        .when(F.size("_q") > 0, F.col("_q"))
        .when(F.col("_has") & (c("vp_embedder") != embedder), F.array(F.lit("embedder mismatch")))
        .when(F.col("_has") & (c("vp_sessions") >= max_sessions), F.array(F.lit("session limit")))
        .when(F.col("consistency_cosine") < min_cosine, F.array(F.lit("inconsistent voice")))
        .otherwise(none)
    )
    return r.withColumn("reasons", reasons).withColumn("accepted", F.size("reasons") == 0).drop("_q", "_has")
