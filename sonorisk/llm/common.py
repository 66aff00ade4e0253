"""Shared helpers of the operators in this subpackage."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, UPPER, LOWER)


def nested(df: DataFrame, keep: Sequence[str] | None = ("doc_id",), **inputs: str) -> DataFrame:
    """``doc``: the kept columns as one struct (None: all); beside it the inputs under internal names.

    A column of the input can then have any name, also one that an operator uses itself.
    """
    cols = df.columns if keep is None else list(keep)
    doc = F.struct(*[F.col(f"`{c}`") for c in cols]).alias("doc")
    return df.select(doc, *[F.col(f"`{c}`").alias(name) for name, c in inputs.items()])


def reliable(df: DataFrame) -> DataFrame:
    """Checkpoint in the shared folder that the cluster names; set one only where none is set."""
    from sonorisk.scale import materialize

    return materialize(df)


def stored(df: DataFrame) -> DataFrame:
    """Write to a table in the shared folder and read it again.

    For loops: a checkpoint keeps the size estimate of its plan, and estimates of joins multiply, round after round.
    """
    from sonorisk.scale import shared_path

    path = shared_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def beta_prior(level: DataFrame, low: float = 1.0, high: float = 1000.0) -> tuple[float, float]:
    """Mean and strength of the beta prior of the groups' bad rates (``n, bad``), by the analysis-of-variance estimate.

    One row of sums reaches the driver.  The strength lies in [low, high]; without counts the mean is one half.
    """
    n, b = F.col("n").cast("double"), F.col("bad").cast("double")
    r = level.filter("n > 0").agg(F.count(F.lit(1)).alias("k"), F.sum(n).alias("N"), F.sum(b).alias("B"), F.sum(n * n).alias("n2"), F.sum(b * b / n).alias("b2n")).first()
    if not r.k:
        return 0.5, high
    p = r.B / r.N
    between = r.b2n - r.N * p * p
    within = r.B - r.b2n
    n0 = (r.N - r.n2 / r.N) / max(1, r.k - 1)
    if r.k < 2 or r.N <= r.k or n0 <= 0:
        return p, high
    msb, msw = between / (r.k - 1), within / (r.N - r.k)
    rho = (msb - msw) / (msb + (n0 - 1) * msw) if msb + (n0 - 1) * msw > 0 else 1.0
    return p, (high if rho <= 0 else min(high, max(low, (1 - rho) / rho)))


def small(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so that a task turns few texts into Python objects at a time."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
