"""Streaming jobs: sources, stateful operators, sinks.  The same functions take batch or stream frames."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.window import Window as W

from sonorisk.operators.fusion import HEADS, band, fuse_windows
from sonorisk.scale import materialize, shared_path
from sonorisk.streaming.processors import RISK_FIELDS, AlertProcessor, ArrivalProcessor, HistogramProcessor, QuietSessionProcessor, SessionRiskProcessor

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stateful(df: DataFrame, key: str | list[str], processor: StatefulProcessor, schema: str, mode: str = "None", event_time: str = "") -> DataFrame:
    """One shuffle by key into ``transformWithStateInPandas``; ``event_time`` names the output's column for the next operator."""
    keys = [key] if isinstance(key, str) else key
    return df.groupBy(*keys).transformWithStateInPandas(processor, schema, "Append", mode, eventTimeColumnName=event_time)


def publish(df: DataFrame, path: str, order: str, parts: int = 3, ties: tuple[str, ...] = ()) -> None:
    """Append messages to a topic folder in order, rows without one first (tenant is a column, not part of the key).

    The file source reads by modification time, so later messages are written after earlier ones: ``parts`` writes, one after
    the other, of files that each hold a narrow range of the order.  ``ties`` only cut rows of equal order into files.
    """
    df = materialize(df)  # read once per part below
    cuts = sorted(set(df.approxQuantile(order, [k / parts for k in range(1, parts)], 0.01)))
    place = F.coalesce(sum(((F.col(order) > c).cast("int") for c in cuts), F.lit(0)), F.lit(0))
    files = -(-df.rdd.getNumPartitions() // (len(cuts) + 1))
    for k in range(len(cuts) + 1):
        df.filter(place == k).repartitionByRange(max(1, files), order, *ties).sortWithinPartitions(order, *ties).write.mode("append").parquet(path)


def out_of_order_ms(spark: SparkSession, path: str, schema) -> int:
    """How far any row of a topic is behind a row that may be read before it, whatever files a trigger takes.

    Tasks of one write end in any order, so files are taken as the source takes them, by modification time; files of one
    time are in no order.
    """
    t = spark.read.schema(schema).parquet(path).select("at", F.col("_metadata.file_modification_time").alias("_written"))
    spans = t.groupBy("_written").agg(F.unix_millis(F.min("at")).alias("lo"), F.unix_millis(F.max("at")).alias("hi")).filter("lo is not null").orderBy("_written")
    most, high = 0, None
    for r in spans.collect():  # a row for a file at most, which the source lists on the driver as well
        high = r.hi if high is None else max(high, r.hi)
        most = max(most, high - r.lo)
    return most


def end_topic(spark: SparkSession, path: str, schema, delay_ms: int, settle_ms: int = 10 * 86_400_000) -> None:
    """Append one row of keys of its own (far negative numbers, empty texts) whose event time ends all sessions of a finite topic.

    The processors hold that row for good; it only moves the watermark, ``settle_ms`` and more beyond the last row.
    """
    last = spark.read.schema(schema).parquet(path).agg(F.max("at")).first()[0]
    if last is None:
        return
    far = F.lit(last) + F.make_dt_interval(secs=F.lit((3 * delay_ms + settle_ms) / 1000.0))
    # no NULLs, for which a join filters a row out before the watermark has seen it, and keys that no other topic's end has
    own = {"bigint": F.lit((uuid.uuid4().int >> 88) - (1 << 62)), "int": F.lit(-(1 << 30)), "string": F.lit("")}
    row = [(far if f.name == "at" else own.get(f.dataType.simpleString(), F.lit(None))).cast(f.dataType).alias(f.name) for f in schema]
    spark.range(1, numPartitions=1).select(*row).write.mode("append").parquet(path)


def event_topic(df: DataFrame, at: Column, key: str, parts: int = 3, files: int = 8, delay_ms: int = 3_600_000, settle_ms: int = 10 * 86_400_000) -> DataFrame:
    """Publish a finite table as a topic and subscribe to it, with a watermark on ``at`` that no row comes behind.

    The watermark's delay is ``delay_ms``, or how far the written files are out of order where that is more; ``parts`` and
    ``files`` (per trigger) only cut the batches.
    """
    spark = df.sparkSession
    df = df.withColumn("at", at.cast("timestamp"))
    path = shared_path(spark, "topic")
    publish(df.withColumn("_order", F.unix_micros("at")), path, "_order", parts, (key,))
    delay_ms = max(delay_ms, out_of_order_ms(spark, path, df.schema) + 1)
    end_topic(spark, path, df.schema, delay_ms, settle_ms)
    return subscribe(spark, path, df.schema, files).withWatermark("at", f"{delay_ms} milliseconds")


def drain_in_order(df: DataFrame, at: Column, key: str, processor: StatefulProcessor, schema: str, name: str, parts: int = 3, files: int = 8, delay_ms: int = 3_600_000, settle_ms: int = 10 * 86_400_000) -> DataFrame:
    """Publish a finite table as a topic, run an ordered processor over it to the end, and return what came out."""
    return run_available(stateful(event_topic(df, at, key, parts, files, delay_ms, settle_ms), key, processor, schema, "EventTime"), name)


def session_risk(heads: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """Timeline rows, and driver rows when a session has been idle for ``idle_ms``, from a stream of raw head scores.

    Two stateful operators in one query: an aggregate gathers and fuses the heads of a window, which is complete once the
    watermark has passed it; the session operator smooths the fused windows and adds up the heads' contributions.
    heads: session_id, window_id, head_id, p_spoof, abstain, and the event time ``at`` with a watermark.
    """
    fused = fuse_windows(heads, keys=("session_id", "window_id", "at"))
    windows = fused.select("session_id", "window_id", "at", "p_fused", *[f"signed_{h}" for h in HEADS])
    return stateful(windows, "session_id", SessionRiskProcessor(idle_ms), RISK_FIELDS, "EventTime")


def late_rows(events: DataFrame, run_length: int = 10_000) -> DataFrame:
    """``run, event_id, event_type, ts_us, high_us`` of a stream whose ``at`` is the arrival number in seconds, by runs of arrivals.

    events: arrival, event_id, event_type, ts_us, run (arrival div ``run_length``).  See ``count_late``.
    """
    return stateful(events, "run", ArrivalProcessor(run_length), "run long, event_id long, event_type string, ts_us long, high_us long", "EventTime")


def count_late(rows: DataFrame, delay_us: int) -> DataFrame:
    """Per event type: all rows, those kept, and those late, from what ``late_rows`` has written.

    A row is late if it is more than the delay behind the greatest event time that arrived before it.  Runs hand their
    greatest event time on: one row for a run of arrivals, summed up in arrival order.
    """
    ends = rows.filter("event_id is null").select("run", "high_us")
    before = ends.withColumn("before_us", F.max("high_us").over(W.orderBy("run").rowsBetween(W.unboundedPreceding, -1))).drop("high_us")
    high = F.greatest("high_us", "before_us")
    late = F.coalesce(F.col("ts_us") < high - delay_us, F.lit(False))
    g = rows.filter("event_id is not null").join(before, "run").groupBy("event_type")
    return g.agg(F.count(F.lit(1)).alias("n_all"), F.sum((~late).cast("long")).alias("n_kept"), F.sum(late.cast("long")).alias("n_late"))


def drift_counts(heads: DataFrame, names: tuple[str, ...], reference_ms: int, period_ms: int, idle_ms: int, elevated: float = 0.40, high: float = 0.70) -> DataFrame:
    """Score counts of closed sessions that never left LOW, for each head, bin and period, from a stream of raw head scores.

    Three stateful operators in one query: fusion of a window's heads, sessions that close after ``idle_ms``, and histograms
    dealt by (head, bin), so a head is not one task.  The counts add up (``drift.drift_from_counts``).
    """
    scores = {f"p_{h}": F.max(F.when((F.col("head_id") == h) & ~F.col("abstain"), F.col("p_spoof"))) for h in names}
    windows = fuse_windows(heads, keys=("session_id", "window_id", "at"), extra=scores).select("session_id", "window_id", "at", band(F.col("p_fused"), elevated, high).alias("state"), *scores)
    closed = stateful(windows, "session_id", QuietSessionProcessor(names, idle_ms), "head_id string, bin int, score double, n long, closed_ms long, at timestamp", "EventTime", "at")
    return stateful(closed, ["head_id", "bin"], HistogramProcessor(reference_ms, period_ms), "head_id string, bin int, as_of_ms long, score double, n_ref long, n_current long", "EventTime")


def assemble_stream(windows: DataFrame, scores: DataFrame, expected: tuple[str, ...], budget_ms: int) -> DataFrame:
    """``assemble_heads`` on two streams: a head without a score inside its budget comes out as a timeout.

    A left outer join of the expected heads with the scores of the window's budget; the watermark releases what found none.
    windows: session_id, window_id, at; scores: session_id, window_id, head_id, abstain, abstain_reason, at (both with watermarks).
    """
    want = windows.withColumn("head_id", F.explode(F.array(*[F.lit(h) for h in expected]))).alias("w")
    s = scores.alias("s")
    on = [F.col(f"w.{c}") == F.col(f"s.{c}") for c in ("session_id", "window_id", "head_id")]
    inside = (F.col("s.at") >= F.col("w.at")) & (F.col("s.at") <= F.col("w.at") + F.expr(f"interval {budget_ms} milliseconds"))
    j = want.join(s, [*on, inside], "left")
    return j.select(
        "w.session_id", "w.window_id", "w.head_id", F.coalesce("s.abstain", F.lit(True)).alias("abstain"), F.when(F.col("s.abstain").isNull(), "timeout").otherwise(F.col("s.abstain_reason")).alias("abstain_reason")
    )


def answers_stream(issued: DataFrame, answered: DataFrame, ttl_s: float = 30.0, wait_s: float = 60.0) -> DataFrame:
    """Each challenge with its answer: in time, late (within ``wait_s``), or none, by a join of two streams over an interval.

    issued, answered: session_id, challenge_id, at (both with watermarks).  The watermark releases challenges without an answer.
    """
    i, a = issued.alias("i"), answered.alias("a")
    after = lambda s: F.col("i.at") + F.expr(f"interval {round(1000 * s)} milliseconds")
    on = (F.col("i.session_id") == F.col("a.session_id")) & (F.col("i.challenge_id") == F.col("a.challenge_id")) & (F.col("a.at") >= F.col("i.at")) & (F.col("a.at") <= after(wait_s))
    outcome = F.when(F.col("a.at").isNull(), "no_answer").when(F.col("a.at") > after(ttl_s), "late").otherwise("in_time")
    return i.join(a, on, "left").select("i.session_id", "i.challenge_id", outcome.alias("outcome"))


def alerts(events: DataFrame, limit: int, width: str, slide_ms: int, for_ms: int) -> DataFrame:
    """Alerts with pending, firing and end times from a stream of events: sliding counts, then the rule's state machine."""
    counts = events.groupBy(F.window("at", width, f"{slide_ms} milliseconds").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    rows = counts.select("event_type", F.unix_millis("w.end").alias("end_ms"), "n", F.window_time("w").alias("at"))
    return stateful(rows, "event_type", AlertProcessor(limit, slide_ms, for_ms), "event_type string, pending_ms long, fired_ms long, ended_ms long, peak long", "EventTime")


def subscribe(spark: SparkSession, path: str, schema, files_per_trigger: int = 2, tenant: str | None = None) -> DataFrame:
    """Read a topic folder as a stream; offsets live in the query's checkpoint.  Use ``kafka`` in production."""
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return s.filter(F.col("tenant_id") == tenant) if tenant is not None else s


@contextmanager
def rocksdb_state(spark: SparkSession):
    """A query started inside keeps its state in RocksDB; the session's own setting comes back."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


def run_available(stream: DataFrame, name: str, out: str | None = None) -> DataFrame:
    """Drain what is there into a parquet table and return it (exactly once by checkpoint)."""
    spark = stream.sparkSession
    path = out or shared_path(spark, name)
    with rocksdb_state(spark):
        q = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", path + "-checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return spark.read.schema(stream.schema).parquet(path)


def for_each_table(stream: DataFrame, name: str, handle) -> None:
    """Run ``handle(batch_df, epoch)`` per micro-batch; handlers must be idempotent per epoch."""
    spark = stream.sparkSession
    cp = shared_path(spark, name + "-checkpoint")
    with rocksdb_state(spark):
        q = stream.writeStream.foreachBatch(handle).option("checkpointLocation", cp).trigger(availableNow=True).start()
    q.awaitTermination()


def sliding_windows(frames: DataFrame, ts_ms: str, window_ms: int = 3000, hop_ms: int = 1000) -> DataFrame:
    """(session_id, window_id, start_ms, end_ms, n): each frame counted in every window that covers it.

    Ids count from the session's first hop, by closed form; one aggregate, no self join.
    """
    per = window_ms // hop_ms
    hop = F.floor(F.col(ts_ms) / hop_ms)
    ids = F.sequence(F.greatest(hop - (per - 1), F.lit(0)), hop)
    x = frames.withColumn("window_id", F.explode(ids))
    g = x.groupBy("session_id", "window_id").agg(F.count(F.lit(1)).alias("n"))
    return g.select("session_id", "window_id", (F.col("window_id") * hop_ms).alias("start_ms"), (F.col("window_id") * hop_ms + window_ms).alias("end_ms"), "n")


def assemble_heads(windows: DataFrame, scores: DataFrame, expected: tuple[str, ...], budget_ms: int | None = None) -> DataFrame:
    """Every expected head of every window; absent (or, on request, over-budget) heads become timeouts."""
    want = windows.select("session_id", "window_id").distinct().withColumn("head_id", F.explode(F.array(*[F.lit(h) for h in expected])))
    s = scores.select("session_id", "window_id", "head_id", "p_spoof", "abstain", "abstain_reason", "latency_ms")
    if budget_ms is not None:
        over = F.col("latency_ms") > budget_ms
        s = s.withColumns({"p_spoof": F.when(~over, F.col("p_spoof")), "abstain_reason": F.when(over, "timeout").otherwise(F.col("abstain_reason")), "abstain": F.col("abstain") | over})
    j = want.join(s, ["session_id", "window_id", "head_id"], "left")
    return j.withColumns({"abstain_reason": F.when(F.col("abstain").isNull(), "timeout").otherwise(F.col("abstain_reason")), "abstain": F.coalesce("abstain", F.lit(True))})


def idle_sessions(events: DataFrame, ts: str, key: str, gap: str = "60 seconds") -> DataFrame:
    """Sessions that end after a gap without events."""
    return events.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_sessions(creates: DataFrame, key: str, order: Column) -> DataFrame:
    """First create per session id; later ones are repeats (same owner) or rejected reuse."""
    first = creates.groupBy(key).agg(F.min_by("tenant_id", order).alias("owner"), F.min(order).alias("_first"))
    j = creates.join(first, key)
    out = F.when(order == F.col("_first"), "created").when(F.col("tenant_id") == F.col("owner"), "repeat").otherwise("rejected")
    return j.withColumn("outcome", out).drop("owner", "_first")


def windowed_counts(events: DataFrame, ts: str, keys: list[str], width: str, slide: str | None = None) -> DataFrame:
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return events.groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def call_view(events: DataFrame) -> DataFrame:
    """Latest payload per event type, event counts and last decision per session (a fold as maxima)."""
    last = lambda t: F.max_by("payload", F.when(F.col("event_type") == t, F.col("seq")))
    count = lambda t: F.sum((F.col("event_type") == t).cast("long"))
    return events.groupBy("session_id").agg(
        last("session_risk").alias("risk"), last("context_signals").alias("context"), last("policy_decision").alias("decision"), count("policy_decision").alias("n_decisions"), count("window_score").alias("n_windows"), F.max("seq").alias("last_seq")
    )
