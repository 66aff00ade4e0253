"""Feature tables by split, resumable: rows already written are not computed again."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame

from sonorisk.operators.signal import extract_features


def materialise_features(rows: DataFrame, path: str, key: str, samples: str, split: str = "split") -> None:
    """Append features of rows whose key is not in the table yet, partitioned by split."""
    spark = rows.sparkSession
    try:
        done = spark.read.parquet(path).select(key)
        rows = rows.join(done, key, "left_anti")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":  # that is the first run; anything else is an error
            raise
    f = extract_features(rows.select(key, samples), key, samples)
    f.join(rows.select(key, split), key).write.mode("append").partitionBy(split).parquet(path)
