"""Registry of runnable queries and their reference SQL."""

from __future__ import annotations

import importlib
import os
import shutil
import tempfile
from collections.abc import Callable
from functools import wraps

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package usable by Python workers, once per application (as --py-files would).

    Batch workers import the added zip.  The streaming runner starts its process without added files, so
    the package's functions and classes are also pickled by value.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    base = os.path.join(tempfile.mkdtemp(prefix="run-"), "sonorisk")
    sc.addPyFile(shutil.make_archive(base, "zip", root, "sonorisk"))
    cloudpickle.register_pickle_by_value(importlib.import_module("sonorisk"))
    _shipped.add(sc.applicationId)


def query(key: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its inventory id, with the DuckDB SQL that must agree with it."""

    def add(fn: Query) -> Query:
        if key in QUERIES:
            raise ValueError(f"query {key} registered twice")

        @wraps(fn)
        def run(spark: SparkSession, sf: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf)

        QUERIES[key] = run
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return add
