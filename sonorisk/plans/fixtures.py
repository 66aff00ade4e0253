"""Domain tables derived from the driver tables, in Spark and as SQL fragments.

Every derivation is integer arithmetic on keys, so both engines agree bit for bit.  ``sql(...)``
puts the needed fragments in front of a query body.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sonorisk.scale import ordered_index

HEADS = ("A", "B", "C")
HEAD_MULTIPLIER = {"A": 7919, "B": 104729, "C": 1299709}
US_DAY = 86_400_000_000


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def micros(c: str) -> Column:
    """Microseconds since the epoch of a TIMESTAMP_NTZ column, independent of the session zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {c})")


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").withColumn("ts_us", micros("ts"))


def windows(spark: SparkSession, sf: str) -> DataFrame:
    """One analysis window per event; ids from 0 in time order within the session (user)."""
    e = events(spark, sf).select("event_id", F.col("user_id").alias("session_id"), "ts_us", "event_type", "value")
    idx = ordered_index(e, ["session_id"], ["ts_us", "event_id"], "window_id")
    return idx.withColumn("window_id", F.col("window_id") - 1)


def _p(mult: int, sid: str = "session_id") -> Column:
    return ((F.col("event_id") * mult + F.col(sid) * 31) % 997 + 1) / F.lit(999.0)


def head_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Long head-score table, one row per window and head A, B, C; some heads abstain."""
    heads = F.array(
        *[
            F.struct(
                F.lit(h).alias("head_id"),
                _p(HEAD_MULTIPLIER[h]).alias("p"),
                (((F.col("event_id") + i) % 20 == 0) | (F.col("event_id") % 50 == 7)).alias("abstain"),
                F.when((F.col("event_id") + i) % 20 == 0, "quality_gate")
                .when(F.col("event_id") % 50 == 7, "insufficient_speech")
                .alias("abstain_reason"),
                F.concat(F.lit(f"{h}@m-v"), F.when(F.col("event_id") % 7 == 0, "2").otherwise("1")).alias("model_version"),
                ((F.col("event_id") * (13 + i)) % 400 + 5).alias("latency_ms"),
            )
            for i, h in enumerate(HEADS)
        ]
    )
    w = windows(spark, sf).withColumn("h", F.explode(heads))
    return w.select("session_id", "window_id", "event_id", "ts_us", "event_type", "h.*").withColumn(
        "p_spoof", F.when(~F.col("abstain"), F.col("p"))
    ).drop("p")


CTE: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, body: str, *needs: str) -> None:
    CTE[name] = (needs, body)


def sql(body: str, *names: str) -> str:
    """``body`` with the named fragments and everything they need put in front."""
    order: list[str] = []

    def add(n: str) -> None:
        for d in CTE[n][0]:
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    if not order:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({CTE[n][1]})" for n in order) + "\n" + body


cte(
    "windows",
    """SELECT event_id, user_id AS session_id, epoch_us(ts) AS ts_us, event_type, value,
       row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS window_id FROM events""",
)
cte(
    "head_scores",
    " UNION ALL ".join(
        f"""SELECT session_id, window_id, event_id, ts_us, event_type, '{h}' AS head_id,
        ((event_id + {i}) % 20 = 0 OR event_id % 50 = 7) AS abstain,
        CASE WHEN (event_id + {i}) % 20 = 0 THEN 'quality_gate' WHEN event_id % 50 = 7 THEN 'insufficient_speech' END AS abstain_reason,
        '{h}@m-v' || CASE WHEN event_id % 7 = 0 THEN '2' ELSE '1' END AS model_version,
        (event_id * {13 + i}) % 400 + 5 AS latency_ms,
        CASE WHEN NOT ((event_id + {i}) % 20 = 0 OR event_id % 50 = 7)
             THEN CAST((event_id * {HEAD_MULTIPLIER[h]} + session_id * 31) % 997 + 1 AS DOUBLE) / CAST(999 AS DOUBLE) END AS p_spoof
        FROM windows"""
        for i, h in enumerate(HEADS)
    ),
    "windows",
)


def scores(spark: SparkSession, sf: str) -> DataFrame:
    """Evaluation score table: one trial per line item; higher score = bona fide; NULL = abstained."""
    li = table(spark, sf, "lineitem")
    return li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("utt_id"),
        F.when(F.col("l_returnflag") == "R", "spoof").otherwise("bona_fide").alias("label"),
        F.when(F.col("l_partkey") % 50 != 0, F.col("l_extendedprice") / F.col("l_quantity")).alias("score"),
        F.when(F.col("l_partkey") % 50 != 0, (F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 31) % 1000 / F.lit(1000.0)).alias("p_spoof"),
        F.when(F.col("l_returnflag") == "R", F.concat(F.lit("fam"), (F.col("l_partkey") % 5).cast("string"))).alias("attack_family"),
        F.concat(F.lit("ds"), (F.col("l_suppkey") % 3).cast("string")).alias("dataset"),
        F.when(F.col("l_suppkey") % 11 != 0, F.concat(F.lit("l"), (F.col("l_suppkey") % 4).cast("string"))).alias("language"),
        F.col("l_linestatus").alias("gender"),
        F.concat(F.lit("acc"), (F.col("l_partkey") % 3).cast("string")).alias("accent"),
        F.concat(F.lit("codec"), (F.col("l_linenumber") % 3).cast("string")).alias("codec"),
        F.when(F.col("l_linenumber") != 7, F.col("l_quantity") - F.lit(5.0)).alias("snr_db"),
        F.element_at(
            F.array(*[F.lit(c) for c in ("clean", "clean_3s_crop", "pgd_linf", "noise", "speed")]),
            (F.col("l_orderkey") % 5 + 1).cast("int"),
        ).alias("condition"),
        "l_orderkey",
        "l_linenumber",
    )


cte(
    "scores",
    """SELECT l_orderkey * 10 + l_linenumber AS utt_id,
    CASE WHEN l_returnflag = 'R' THEN 'spoof' ELSE 'bona_fide' END AS label,
    CASE WHEN l_partkey % 50 <> 0 THEN l_extendedprice / l_quantity END AS score,
    CASE WHEN l_partkey % 50 <> 0 THEN CAST((l_orderkey * 7919 + l_linenumber * 31) % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE) END AS p_spoof,
    CASE WHEN l_returnflag = 'R' THEN 'fam' || (l_partkey % 5) END AS attack_family,
    'ds' || (l_suppkey % 3) AS dataset,
    CASE WHEN l_suppkey % 11 <> 0 THEN 'l' || (l_suppkey % 4) END AS language,
    l_linestatus AS gender, 'acc' || (l_partkey % 3) AS accent, 'codec' || (l_linenumber % 3) AS codec,
    CASE WHEN l_linenumber <> 7 THEN l_quantity - CAST(5 AS DOUBLE) END AS snr_db,
    CASE l_orderkey % 5 WHEN 0 THEN 'clean' WHEN 1 THEN 'clean_3s_crop' WHEN 2 THEN 'pgd_linf' WHEN 3 THEN 'noise' ELSE 'speed' END AS condition,
    l_orderkey, l_linenumber
    FROM lineitem""",
)

LOGIT_SQL = "CASE WHEN ({0}) IS NOT NULL THEN ln(greatest(1e-6, least(1 - 1e-6, {0})) / (1 - greatest(1e-6, least(1 - 1e-6, {0})))) END"


def logit_sql(x: str) -> str:
    return LOGIT_SQL.format(x)


def sigmoid_sql(z: str) -> str:
    return f"(CASE WHEN ({z}) IS NOT NULL THEN 1 / (1 + exp(-greatest(-35.0, least(35.0, {z})))) END)"


def re4(x: str) -> str:
    """SQL of half-to-even rounding to four decimals after dropping binary noise."""
    return f"(round_even(round(({x}) * 10000, 6), 0) / 10000)"
