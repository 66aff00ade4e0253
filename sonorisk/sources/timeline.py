"""Risk timeline table: append by date and session bucket, read one session in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

BUCKETS = 64
SALT_WINDOWS = 100_000  # about a day of windows of one session per writer


def with_layout(timeline: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Add the partition columns: UTC date of the window and a session bucket."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("ts_us") / 86_400_000_000).cast("int"))
    return timeline.withColumns({"date": day, "bucket": F.pmod(F.xxhash64("session_id"), F.lit(buckets)).cast("int")})


def append_timeline(timeline: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Append windows; files inside a partition are sorted by session so row-group statistics prune."""
    t = timeline.withColumn("risk_score", F.bround(100 * F.col("p_session")).cast("long"))
    # date, bucket and a salt by window range: one hot session does not become one writer task
    laid = with_layout(t, buckets).repartition("date", "bucket", F.floor(F.col("window_id") / SALT_WINDOWS))
    laid.sortWithinPartitions("session_id", "window_id").write.mode("append").partitionBy("date", "bucket").parquet(path)


def read_session(spark: SparkSession, path: str, condition: Column, dates: tuple[str, str] | None = None) -> DataFrame:
    """Rows of the matching sessions in window order; a date range prunes partitions."""
    t = spark.read.parquet(path)
    if dates is not None:
        t = t.filter(F.col("date").between(*[F.lit(d).cast("date") for d in dates]))
    return t.filter(condition).orderBy("session_id", "window_id")


def session_by_id(spark: SparkSession, path: str, session_id: int, buckets: int = BUCKETS) -> DataFrame:
    """One session: its bucket is computed from the id, so only that bucket's partitions are read."""
    b = F.pmod(F.xxhash64(F.lit(session_id).cast("long")), F.lit(buckets)).cast("int")
    return read_session(spark, path, (F.col("bucket") == b) & (F.col("session_id") == session_id))
