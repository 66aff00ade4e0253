"""Queries: calibration lookup, window fusion, session statistics."""

from pyspark.sql import functions as F

from sonorisk.functions.math import logit, r6
from sonorisk.operators import fusion
from sonorisk.plans.fixtures import cte, head_scores, logit_sql, sigmoid_sql, sql
from sonorisk.plans.registry import query
from sonorisk.scale import literal_table

cte(
    "fused",
    f"""SELECT session_id, window_id, min(event_id) AS event_id, min(ts_us) AS ts_us, min(event_type) AS event_type,
    count(p_spoof) AS n_present, sum(0.5 * {logit_sql('p_spoof')}) AS z,
    sum(CASE WHEN head_id='A' THEN 0.5 * {logit_sql('p_spoof')} END) AS s_a,
    sum(CASE WHEN head_id='B' THEN 0.5 * {logit_sql('p_spoof')} END) AS s_b,
    sum(CASE WHEN head_id='C' THEN 0.5 * {logit_sql('p_spoof')} END) AS s_c,
    {sigmoid_sql(f"sum(0.5 * {logit_sql('p_spoof')})")} AS p_fused
    FROM head_scores GROUP BY 1, 2""",
    "head_scores",
)


def fused(spark, sf):
    return fusion.fuse_windows(
        head_scores(spark, sf),
        extra={"event_id": F.min("event_id"), "ts_us": F.min("ts_us"), "event_type": F.min("event_type")},
    )


SESSION_SQL = sql(
    """SELECT session_id, n_windows, n_scored, round(p_max, 6) + 0.0 AS p_max, round(p_mean, 6) + 0.0 AS p_mean,
    round(abstain_ratio, 6) + 0.0 AS abstain_ratio,
    CASE WHEN p_max IS NULL THEN 'ABSTAIN' WHEN p_max >= 0.7 THEN 'HIGH' WHEN p_max >= 0.4 THEN 'ELEVATED' ELSE 'LOW' END AS band
    FROM (SELECT session_id, count(*) AS n_windows, count(p_fused) AS n_scored, max(p_fused) AS p_max,
          coalesce(avg(p_fused), 0.0) AS p_mean, (count(*) - count(p_fused)) / count(*) AS abstain_ratio
          FROM fused GROUP BY 1)""",
    "fused",
)


def _session(spark, sf):
    s = fusion.session_stats(fused(spark, sf))
    return s.select(
        "session_id", "n_windows", "n_scored", r6(F.col("p_max")).alias("p_max"), r6(F.col("p_mean")).alias("p_mean"),
        r6(F.col("abstain_ratio")).alias("abstain_ratio"), fusion.band(F.col("p_max")).alias("band"),
    )


@query("ENTRY", SESSION_SQL)
def entry_query(spark, sf):
    return _session(spark, sf)


@query("AGG03", SESSION_SQL)
def agg03(spark, sf):
    return _session(spark, sf)


@query(
    "AGG01",
    sql(
        """SELECT session_id, window_id, n_present, round(z, 6) + 0.0 AS z, round(CASE WHEN n_present > 0 THEN p_fused END, 6) + 0.0 AS p_fused,
        (SELECT coalesce(string_agg(h.head_id, ',' ORDER BY h.head_id), '') FROM head_scores h
         WHERE h.session_id = f.session_id AND h.window_id = f.window_id AND h.abstain) AS heads_abstained
        FROM fused f""",
        "fused",
    ),
)
def agg01(spark, sf):
    f = fused(spark, sf)
    return f.select(
        "session_id", "window_id", "n_present", r6(F.col("z")).alias("z"), r6(F.col("p_fused")).alias("p_fused"),
        F.array_join("heads_abstained", ",").alias("heads_abstained"),
    )


def _share_sql(h):
    return (
        f"CASE WHEN s_{h} IS NULL THEN NULL WHEN coalesce(abs(s_a),0)+coalesce(abs(s_b),0)+coalesce(abs(s_c),0) > 0 "
        f"THEN round(abs(s_{h}) / (coalesce(abs(s_a),0)+coalesce(abs(s_b),0)+coalesce(abs(s_c),0)), 6) ELSE round(1.0 / n_present, 6) END AS share_{h}"
    )


@query("AGG02", sql(f"SELECT session_id, window_id, {_share_sql('a')}, {_share_sql('b')}, {_share_sql('c')} FROM fused", "fused"))
def agg02(spark, sf):
    c = fusion.contribution_shares(fused(spark, sf))
    return c.select("session_id", "window_id", *[r6(F.col("contributions")[h]).alias(f"share_{h.lower()}") for h in "ABC"])


CAL_ROWS = [("A", "A@m-v1", "platt", 0.8, -0.2, 1.0, "cal-1"), ("B", "B@m-v1", "temperature", 1.0, 0.0, 1.5, "cal-2"), ("B", "B@m-v2", "identity", 1.0, 0.0, 1.0, "cal-3")]
cte(
    "calibrators",
    "SELECT * FROM (VALUES "
    + ", ".join(f"('{h}','{m}','{k}',{a},{b},{t},'{v}')" for h, m, k, a, b, t, v in CAL_ROWS)
    + ") c(head_id, model_version, method, a, b, temperature, version)",
)
cte(
    "calibrated",
    f"""SELECT h.*, CASE WHEN p_spoof IS NULL THEN NULL WHEN c.method = 'platt' THEN {sigmoid_sql('a * raw + b')}
      WHEN c.method = 'temperature' THEN {sigmoid_sql('raw / temperature')} WHEN c.method = 'identity' THEN {sigmoid_sql('raw')}
      ELSE p_spoof END AS p_calibrated, coalesce(c.version, 'native') AS calibration_version
      FROM (SELECT *, {logit_sql('p_spoof')} AS raw FROM head_scores) h LEFT JOIN calibrators c USING (head_id, model_version)""",
    "head_scores", "calibrators",
)


def calibrated(spark, sf):
    cal = literal_table(spark, CAL_ROWS, "head_id string, model_version string, method string, a double, b double, temperature double, version string")
    h = head_scores(spark, sf).withColumns({"raw_score": logit("p_spoof"), "calibration_version": F.lit("native")})
    return fusion.apply_calibration(h, cal)


_CAL_SQL = sql(
    "SELECT session_id, window_id, head_id, calibration_version, round(p_calibrated, 6) + 0.0 AS p_calibrated FROM calibrated", "calibrated"
)


@query("JON01", _CAL_SQL)
def jon01(spark, sf):
    return calibrated(spark, sf).select("session_id", "window_id", "head_id", "calibration_version", r6(F.col("p_calibrated")).alias("p_calibrated"))


@query(
    "FN02",
    sql(
        "SELECT calibration_version, count(*) AS n, round(avg(p_calibrated), 6) AS mean_p, round(min(p_calibrated), 6) AS min_p, round(max(p_calibrated), 6) AS max_p FROM calibrated GROUP BY 1",
        "calibrated",
    ),
)
def fn02(spark, sf):
    return calibrated(spark, sf).groupBy("calibration_version").agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg("p_calibrated")).alias("mean_p"), r6(F.min("p_calibrated")).alias("min_p"), r6(F.max("p_calibrated")).alias("max_p")
    )


@query(
    "FN01",
    sql(
        f"SELECT session_id, window_id, head_id, round({logit_sql('p_spoof')}, 6) + 0.0 AS z, round({sigmoid_sql('2 * ' + logit_sql('p_spoof'))}, 6) AS p2 FROM head_scores",
        "head_scores",
    ),
)
def fn01(spark, sf):
    from sonorisk.functions.math import sigmoid

    return head_scores(spark, sf).select("session_id", "window_id", "head_id", r6(logit("p_spoof")).alias("z"), r6(sigmoid(2 * logit("p_spoof"))).alias("p2"))


@query(
    "FLT04",
    sql(
        """SELECT session_id, window_id, head_id FROM (SELECT session_id, window_id, head_id, p_spoof, abstain FROM head_scores
        UNION ALL SELECT session_id, window_id, 'F', CASE WHEN event_id % 3 = 0 THEN CAST((event_id * 17) % 100 AS DOUBLE) / 100 END, event_id % 3 <> 0 FROM windows)
        WHERE NOT abstain AND p_spoof IS NOT NULL AND (head_id <> 'F' OR p_spoof >= 0.95)""",
        "head_scores",
    ),
)
def flt04(spark, sf):
    from sonorisk.plans.fixtures import windows

    h = head_scores(spark, sf).select("session_id", "window_id", "head_id", "p_spoof", "abstain").withColumn("watermark", F.lit(None).cast("string"))
    wm = windows(spark, sf).select(
        "session_id", "window_id", F.lit("F").alias("head_id"),
        F.when(F.col("event_id") % 3 == 0, (F.col("event_id") * 17) % 100 / 100.0).alias("p_spoof"),
        (F.col("event_id") % 3 != 0).alias("abstain"),
        F.when(F.col("event_id") % 3 == 0, "present").otherwise("absent").alias("watermark"),
    )
    return h.unionByName(wm).filter(fusion.usable_for_fusion(F.col("watermark"))).select("session_id", "window_id", "head_id")
