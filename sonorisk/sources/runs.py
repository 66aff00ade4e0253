"""Evaluation run records: metric rows by run, comparison, report tables, load-test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sonorisk.functions.identity import row_id, slug


def save_run(rows: DataFrame, path: str, run_id: str) -> None:
    """Write a run's metric rows; saving a run again replaces only that run."""
    (
        rows.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)
    )


def load_runs(spark: SparkSession, path: str, run_ids: list[str] | None = None) -> DataFrame:
    r = spark.read.parquet(path)
    return r.filter(F.col("run_id").isin(*run_ids)) if run_ids is not None else r


def compare_runs(before: DataFrame, after: DataFrame, protocol: str, max_regression: float) -> DataFrame:
    """EER of two runs by slice with the change and a regression flag (full outer: new and gone slices stay)."""
    b = before.filter(F.col("protocol") == protocol).select("slice", F.col("eer").alias("eer_before"))
    a = after.filter(F.col("protocol") == protocol).select("slice", F.col("eer").alias("eer_after"))
    d = F.col("eer_after") - F.col("eer_before")
    return b.join(a, "slice", "full").withColumns({"delta": d, "regression": F.coalesce(d > max_regression, F.lit(False))})


def percent(c: Column, digits: int = 2) -> Column:
    return F.when(c.isNull(), "—").otherwise(F.concat(F.format_string(f"%.{digits}f", 100 * c), F.lit("%")))


def report_rows(rows: DataFrame) -> DataFrame:
    """Printable rows in report order."""
    return rows.select(
        row_id(F.col("run_id"), F.col("protocol"), F.col("slice")).alias("row_id"), "protocol", "slice", "n_bona", "n_spoof", percent(F.col("eer")).alias("eer"), percent(F.col("coverage"), 1).alias("coverage"),
        F.when(F.col("low_n"), "low n").otherwise(F.coalesce("note", F.lit(""))).alias("flag"),
    ).orderBy("protocol", "slice")


def render_markdown(rows: DataFrame, limit: int = 10_000) -> str:
    """Markdown table of a (small) report; refuses a result that is not report-sized."""
    got = rows.limit(limit + 1).collect()
    if len(got) > limit:
        raise ValueError("not a report-sized table")
    head = rows.columns
    lines = ["| " + " | ".join(head) + " |", "|" + "---|" * len(head)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in got])


def read_loadtests(spark: SparkSession, path: str) -> DataFrame:
    """Result rows of markdown load-test files: (row_id, calls, p50, p95, p99, degraded, timeouts, keeps_up)."""
    lines = spark.read.text(path).select("value", F.regexp_replace(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]*)$", 1), r"\.[^.]*$", "").alias("stem"))
    cells = F.transform(F.split(F.regexp_replace(F.trim("value"), r"^\|+|\|+$", ""), r"\|"), lambda x: F.trim(x))
    t = lines.withColumn("c", cells).filter((F.size("c") >= 10) & F.get("c", F.lit(0)).rlike("^[0-9]+$"))
    at = lambda i: F.get("c", F.lit(i))
    return t.select(
        F.concat(F.lit("lt-"), slug(F.col("stem")), F.lit("."), at(0)).alias("row_id"), at(0).cast("long").alias("calls"), at(2).alias("p50"), at(3).alias("p95"), at(4).alias("p99"), at(7).alias("degraded"), at(8).alias("timeouts"), at(9).alias("keeps_up")
    )


def model_cards(models: DataFrame, runs: DataFrame, datasets: DataFrame) -> DataFrame:
    """Registered model with its evaluation, training datasets and the non-commercial ones among them.

    models: version, lineage, eval_run_id; runs: run_id, eer, gate, train_datasets; datasets: name, commercial_use.
    """
    j = models.join(runs.withColumnRenamed("run_id", "eval_run_id"), "eval_run_id", "left")
    x = j.select("version", F.explode("train_datasets").alias("name")).join(datasets, "name", "left")
    g = x.groupBy("version").agg(F.array_sort(F.collect_set(F.when(~F.coalesce("commercial_use", F.lit(False)), F.col("name")))).alias("non_commercial"))
    return j.join(g, "version", "left").withColumns(
        {"evaluated": F.col("gate").isNotNull(), "non_commercial": F.coalesce("non_commercial", F.array().cast("array<string>"))}
    )


def call_review(timeline: DataFrame, bundles: DataFrame, versions: DataFrame) -> DataFrame:
    """Everything about each call as ordered rows: (session_id, section, position, detail).

    Long form: a call with very many windows stays many rows instead of one huge array.
    """
    t = timeline.select("session_id", F.lit("timeline").alias("section"), F.col("window_id").cast("long").alias("position"), F.concat_ws(" ", "state", F.format_string("%.3f", "p_session")).alias("detail"))
    b = bundles.select("session_id", F.lit("bundle").alias("section"), F.col("seq").cast("long").alias("position"), F.concat_ws(" ", "bundle_id", F.when(F.col("verified"), "verified").otherwise("failed")).alias("detail"))
    v = versions.select("session_id", F.lit("version").alias("section"), F.lit(0).cast("long").alias("position"), F.concat_ws("=", "head_id", "model_version").alias("detail")).distinct()
    return t.unionByName(b).unionByName(v)
