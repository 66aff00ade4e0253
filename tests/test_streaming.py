"""Stateful steps outside Spark, and stream equals batch."""

import pytest
from pyspark.sql import functions as F

from sonorisk.operators import temporal as TP
from sonorisk.streaming import jobs as J, processors as PR
from sonorisk.streaming.processors import play_out


def play(seqs, drain=False):
    due, pending, out, late = seqs[0], [], [], 0
    for q in seqs:
        if q < due:
            late += 1
        elif q not in pending:
            frames, pending, due = play_out(sorted([*pending, q]), due, 20, 5)
            out += frames
    if drain:
        frames, pending, due = play_out(pending, due, 20, 5, drain=True)
        out += frames
    return out, pending, due, late


def test_reordering_and_late_packets():
    out, _, _, late = play([0, 2, 1, 3, 1])
    assert [n for n, _ in out] == [0, 1, 2, 3] and late == 1


def test_long_gaps_are_concealed_then_skipped():
    out, _, due, _ = play([0, 40])
    assert [k for _, k in out] == ["frame"] + ["concealed"] * 5 + ["frame"] and due == 41


def test_a_waiting_gap_keeps_packets_until_the_drain():
    out, pending, _, _ = play([0, 3, 4])
    assert out == [(0, "frame")] and pending == [3, 4]
    assert play([0, 3, 4], drain=True)[0] == [(0, "frame"), (1, "concealed"), (2, "concealed"), (3, "frame"), (4, "frame")]


YEAR = 365 * 86_400_000
CASES = {
    "risk": (PR.SessionRiskProcessor, PR.RISK_FIELDS),
    "decisions": (PR.DecisionProcessor, "session_id long, window_id long, state string, reason string"),
    "frames": (PR.ReorderProcessor, "session_id long, seq long, kind string"),
    "transcript": (PR.TranscriptProcessor, "session_id long, start_ms long, accepted boolean, n_held long"),
    "owners": (lambda: PR.OwnerProcessor(7_000), "event_id long, outcome string"),
    "views": (lambda: PR.CallViewProcessor(3 * 86_400_000), "session_id long, risk long, context long, decision long, n_decisions long, n_windows long, last_seq long"),
    "idle": (PR.IdleSessionProcessor, "session_id long, first_ms long, last_ms long, n long"),
}


@pytest.mark.parametrize("name", CASES)
def test_results_do_not_depend_on_files(spark, name):
    """One ordered file, and fifty shuffled ones of which a trigger takes seven, give the same rows."""
    i = F.col("id")
    df = spark.range(600).select(
        (i % 4).alias("session_id"), F.floor(i / 4).alias("window_id"), F.when(i % 11 != 0, (i * 37 % 97 + 1) / 98.0).alias("p_fused"),
        F.element_at(F.array(F.lit("LOW"), F.lit("HIGH"), F.lit("ELEVATED")), (i % 3 + 1).cast("int")).alias("state"), F.floor(i / 80).cast("string").alias("labels"),
        (F.floor(i / 4) + F.when(F.floor(i / 4) % 5 == 3, -2).otherwise(0)).alias("seq"), (F.floor(i / 4) * 900).alias("start_ms"), (F.floor(i / 4) * 900 + 1000).alias("end_ms"),
        F.lit("some words").alias("text"), i.alias("event_id"), (i % 3).alias("tenant_id"), i.alias("payload"), F.when(i % 2 == 0, "session_risk").otherwise("window_score").alias("event_type"), (F.floor(i / 4) * 1_000_000).alias("ts_us"),
    )
    df = df.withColumn("at", F.timestamp_seconds(F.col("window_id") + F.floor(F.col("window_id") / 50) * 90 + 86_400))
    proc, schema = CASES[name]
    got = []
    for files, per in ((1, 1), (50, 7)):
        path = J.shared_path(spark, "topic")
        (df.coalesce(1) if files == 1 else df.repartition(files, F.xxhash64("ts_us", "session_id"))).write.parquet(path)
        J.end_topic(spark, path, df.schema, YEAR)
        stream = J.subscribe(spark, path, df.schema, per).withWatermark("at", f"{YEAR} milliseconds")
        got.append(sorted(map(str, J.run_available(J.stateful(stream, "session_id", proc(), schema, "EventTime"), name).collect())))
    assert got[0] == got[1] and got[0]
    if name == "frames":
        assert sum("late_total" in r for r in got[0]) == 4  # every session drains
    if name == "idle":
        assert len(got[0]) == 12


def test_many_files_over_days_lose_no_row(spark):
    """Fifty input partitions over thirty days, under the default delay of an hour, give every window."""
    i = F.col("id")
    df = spark.range(1200).select((i % 4).alias("session_id"), F.floor(i / 4).alias("window_id"), ((i * 37 % 97 + 1) / 98.0).alias("p_fused"))
    at = F.timestamp_seconds(F.col("window_id") * 8640 + 86_400)
    run = lambda x, name: sorted(map(tuple, J.drain_in_order(x, at, "session_id", PR.SessionRiskProcessor(), PR.RISK_FIELDS, name).collect()))
    many = run(df.repartition(50, F.xxhash64("session_id", "window_id")), "many")
    assert len(many) == 1200 and many == run(df.coalesce(1), "one")


def test_a_topic_is_written_in_narrow_files(spark):
    df = spark.range(5000).withColumn("at", F.timestamp_seconds(F.col("id") * 600)).repartition(50)
    path = J.shared_path(spark, "topic")
    J.publish(df, path, "id")
    wide = spark.read.parquet(path).groupBy("_metadata.file_path").agg((F.max("id") - F.min("id")).alias("w")).agg(F.count("w"), F.max("w")).first()
    assert wide[0] > 24 and wide[1] < 500
    # the delay covers the order in which the files were in fact written
    seen, high = spark.read.parquet(path).groupBy("_metadata.file_modification_time").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).orderBy("file_modification_time").collect(), 0
    for r in seen:
        high = max(high, r.hi)
        assert (high - r.lo) * 600_000 <= J.out_of_order_ms(spark, path, df.schema)


def test_stream_equals_batch(spark, sf):
    from sonorisk.plans import load_all

    q = load_all().QUERIES
    a = sorted(map(tuple, q["STR04"](spark, sf).collect()))
    b = sorted((r.session_id, r.window_id, r.state) for r in q["WIN05"](spark, sf).collect())
    assert [(x[0], x[1], x[3]) for x in a] == b


def in_parts(df):
    return [df.coalesce(1), df.repartition(40, F.xxhash64(*df.columns))]


def rows(df):
    return sorted(map(str, df.collect()))


def test_late_rows_are_counted_by_arrival(spark):
    i = F.col("id")
    e = spark.range(900).select(i.alias("event_id"), F.when(i % 3 == 0, "a").otherwise("b").alias("event_type"), (i * 600_000_000 - F.when(i % 7 == 0, 5_000_000_000).otherwise(0)).alias("ts_us"), i.alias("arrival"), F.floor(i / 100).alias("run"))
    got = [rows(J.count_late(J.run_available(J.late_rows(J.event_topic(df, F.timestamp_seconds(F.col("arrival") + 86_400), "run", files=5), 100), "late"), 3_600_000_000)) for df in in_parts(e)]
    high, want = None, {}
    for r in e.orderBy("arrival").collect():
        n = want.setdefault(r.event_type, [0, 0])
        n[0] += 1
        n[1] += high is not None and r.ts_us < high - 3_600_000_000
        high = r.ts_us if high is None else max(high, r.ts_us)
    assert got[0] == got[1] == sorted(f"Row(event_type='{k}', n_all={a}, n_kept={a - b}, n_late={b})" for k, (a, b) in want.items())


def test_alerts_fire_after_their_duration(spark):
    half = 1_800_000
    counts = {0: 5, 1: 5, 2: 5, 3: 5, 4: 1, 5: 5, 6: 5, 9: 5, 10: 5, 11: 5, 12: 7, 13: 5, 20: 5}  # events in each half hour
    data = [(k * 100 + j, "x", (k * half + 1000 * j) * 1000 + 86_400_000_000) for k, n in counts.items() for j in range(n)]
    e = spark.createDataFrame(data, "event_id long, event_type string, ts_us long")
    want, run = [], []
    for k in range(-1, 30):
        n = counts.get(k, 0) + counts.get(k + 1, 0)  # the hour that begins with half hour k
        if n >= 6:
            run.append((86_400_000 + k * half + 2 * half, n))
        elif run:
            if run[-1][0] - run[0][0] >= 2 * half:
                want.append(str(("x", run[0][0], run[0][0] + 2 * half, run[-1][0], max(n for _, n in run))))
            run = []
    got = [sorted(str(tuple(r)) for r in J.run_available(J.alerts(J.event_topic(df, F.timestamp_micros("ts_us"), "event_type", files=3), 6, "1 hour", half, 2 * half), "alerts").collect()) for df in in_parts(e)]
    assert got[0] == got[1] == sorted(want) and len(want) == 2


def test_drift_and_joins_do_not_depend_on_partitions(spark):
    i = F.col("id")
    heads = spark.range(900).select(
        (F.floor(i / 3) % 6).alias("session_id"), F.floor(i / 18).alias("window_id"), F.element_at(F.array(*map(F.lit, "ABC")), (i % 3 + 1).cast("int")).alias("head_id"),
        ((i * 37) % 97 / 200.0).alias("p_spoof"), (i % 11 == 0).alias("abstain"), (F.floor(i / 18) * 1_000_000 + F.floor(i / 180) * 90_000_000 + 86_400_000_000).alias("ts_us"), F.when(i % 13 == 0, 900).otherwise(i % 400).alias("latency_ms"),
    )
    got = []
    for df in in_parts(heads):
        t = J.event_topic(df, F.timestamp_micros("ts_us"), "session_id", files=5)
        drift = J.run_available(J.drift_counts(t, ("A", "B", "C"), 86_400_000 + 300_000, 100_000, 60_000), "drift")
        w = J.event_topic(df.select("session_id", "window_id", "ts_us").distinct(), F.timestamp_micros("ts_us"), "session_id", files=5)
        s = J.event_topic(df.withColumn("abstain_reason", F.lit("x")), F.timestamp_micros(F.col("ts_us") + F.col("latency_ms") * 1000), "session_id", files=5)
        got.append((rows(drift.groupBy("head_id", "as_of_ms", "score").agg(F.sum("n_ref"), F.sum("n_current"))), rows(J.run_available(J.assemble_stream(w, s, ("A", "B", "C", "D"), 380), "heads"))))
    assert got[0] == got[1] and len(got[0][0]) > 20 and len(got[0][1]) == 1200
    batch = J.assemble_heads(heads.select("session_id", "window_id"), heads.withColumn("abstain_reason", F.lit("x")), ("A", "B", "C", "D"), 380)
    assert got[0][1] == rows(batch.select("session_id", "window_id", "head_id", "abstain", "abstain_reason"))


def test_answers_meet_their_challenge_in_time(spark):
    issued = spark.range(60).select((F.col("id") % 5).alias("session_id"), F.col("id").alias("challenge_id"), (F.col("id") * 20_000_000 + 86_400_000_000).alias("t"))
    answered = issued.filter("challenge_id % 4 <> 0").select("session_id", "challenge_id", (F.col("t") + F.col("challenge_id") * 1_000_000).alias("t"))
    at = F.timestamp_micros("t")
    got = [rows(J.run_available(J.answers_stream(J.event_topic(a, at, "session_id", files=3), J.event_topic(b, at, "session_id", files=3)), "answers")) for a, b in zip(in_parts(issued), in_parts(answered), strict=True)]
    outcome = lambda c: "no_answer" if c % 4 == 0 else "in_time" if c <= 30 else "late"
    assert got[0] == got[1] == sorted(f"Row(session_id={c % 5}, challenge_id={c}, outcome='{outcome(c)}')" for c in range(60))
