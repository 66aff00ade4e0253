"""Building blocks that keep ordered and ranked work spread over the cluster.

A plain ``Window.partitionBy(key).orderBy(x)`` sends each key to one task.  That is the
right plan while the whole input is small, and the wrong one when a single key can hold a
third of a 100 TB table.  The helpers here pick by the planner's own size estimate:

* at or under ``SINGLE_TASK_BYTES`` a native window is used, so the group is bounded by a
  checked size;
* above it the rows are range partitioned on (key, order), which cuts one hot key into many
  parts; a window runs inside (key, part), and the totals of the parts (one row per key and
  part) give the offsets.  Both plans return the same rows, NULLs included.

Range boundaries come from sampling, so the partitioned rows are checkpointed before they
are read twice; a lost executor or a pruned second read can then not move a boundary.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.window import Window as W

SINGLE_TASK_BYTES = 256 << 20
PIECE_BYTES = 4 << 20  # of a file, before heavy work per row


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate of ``df``; reads statistics only, runs no job."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def fits_one_task(df: DataFrame, limit: int | None = None) -> bool:
    return estimated_bytes(df) <= (SINGLE_TASK_BYTES if limit is None else limit)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's shared checkpoint folder; make a local one only where none is set."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="run-"))
    return sc._jsc.sc().getCheckpointDir().get()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder for an intermediate table, under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: cuts the lineage and survives executor loss."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def literal_table(spark: SparkSession, rows: Sequence[Sequence], schema: str) -> DataFrame:
    """A table of the program's own rows as one literal array, with a true size estimate.

    ``createDataFrame`` reports the largest size there is, so its tables are never broadcast.
    """
    kind = T._parse_datatype_string(schema)
    names = [f.name for f in kind.fields]

    def lit(v, t):
        if v is None:
            return F.lit(None).cast(t)
        if isinstance(t, T.ArrayType):
            return F.array(*[lit(x, t.elementType) for x in v]).cast(t)
        if isinstance(t, T.MapType):
            return F.create_map(*[lit(x, u) for k in v.items() for x, u in zip(k, (t.keyType, t.valueType), strict=True)]).cast(t)
        return F.lit(v).cast(t)

    structs = [F.struct(*[lit(v, f.dataType).alias(f.name) for v, f in zip(r, kind.fields, strict=True)]) for r in rows]
    one = spark.range(1, numPartitions=1)
    if not structs:
        return one.filter("false").select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in kind.fields])
    return one.select(F.inline(F.array(*structs))).toDF(*names)


def small_or_plain(df: DataFrame, limit: int = 32 << 20) -> DataFrame:
    """Broadcast hint only when the size estimate is under ``limit``; otherwise a shuffle join.

    Estimates count files compressed and know nothing of exploded rows, so files count eightfold and a plan that
    generates rows from a table gets no hint.
    """
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    stored = "Relation [" in plan or "LogicalRDD" in plan
    if stored and "Generate " in plan:
        return df
    return F.broadcast(df) if estimated_bytes(df) * (8 if stored else 1) <= limit else df


def spread(df: DataFrame) -> DataFrame:
    """Repartition a small input before per-row work that is heavy or fans out.

    A file under one split would run in a single task.  An input with enough splits to keep every core
    busy is returned as it is, so nothing large is shuffled.  Parts are of ``PIECE_BYTES``, at least one a core.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    size = estimated_bytes(df)
    return df.repartition(max(cores, size // PIECE_BYTES)) if size < cores * split else df


def small_slices(columns: Sequence[pa.Array], limit: int = 512 << 10) -> Iterator[tuple[pa.Array, ...]]:
    """An Arrow batch as runs of rows under ``limit`` bytes (or one row), for per-row work on Python objects.

    A batch has ten thousand rows, however long they are, and a Python object takes many times the bytes of its Arrow value.
    """
    n = len(columns[0])
    if n <= 1 or sum(c.nbytes for c in columns) <= limit:
        yield tuple(columns)
        return
    for at, size in ((0, n // 2), (n // 2, n - n // 2)):
        yield from small_slices([c.slice(at, size) for c in columns], limit)


def _num_partitions(df: DataFrame) -> int:
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Equi join in which NULL keys match; the right side's keys are dropped.  Without keys, ``right`` is one row."""
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    if not keys:
        return left.join(F.broadcast(renamed))
    on = [left[k].eqNullSafe(renamed[f"_r_{k}"]) for k in keys]
    return left.join(renamed, on, how).drop(*[f"_r_{k}" for k in keys])


def range_parts(df: DataFrame, by: Sequence[Column | str]) -> DataFrame:
    """Rows range partitioned by ``by``, with the number of their part; checkpointed, so that boundaries stay."""
    return materialize(df.repartitionByRange(_num_partitions(df), *by).withColumn("_part", F.spark_partition_id()))


def prefix_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    sums: dict[str, str],
    limit: int | None = None,
) -> DataFrame:
    """Add inclusive running sums ``sums[out] = column`` per key in the given order.

    ``order`` must be a total order inside a key.  A NULL key is a key, and NULL values are passed over, in both plans.
    """
    keys = list(keys)

    def running(by: Sequence[str]) -> list[Column]:
        w = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
        return [F.sum(c).over(w).alias(o) for o, c in sums.items()]

    if fits_one_task(df, limit):
        return df.select("*", *running(keys))
    ranged = range_parts(df, [*keys, *order])
    within = [*keys, "_part"]  # one key's rows of one part: a hot key is as many groups as it has parts
    totals = ranged.groupBy(*within).agg(*[F.sum(c).alias(f"_o_{o}") for o, c in sums.items()])
    before = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(*within, *[F.sum(f"_o_{o}").over(before).alias(f"_o_{o}") for o in sums])
    joined = null_safe_join(ranged.select("*", *running(within)), offsets, within)
    total = lambda o: F.coalesce(F.col(o) + F.col(f"_o_{o}"), F.col(o), F.col(f"_o_{o}"))
    kinds = df.select(*running(keys)).schema
    return joined.select(*df.columns, *[total(o).cast(kinds[o].dataType).alias(o) for o in sums])


def ordered_index(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str = "rn", limit: int | None = None
) -> DataFrame:
    """1-based row number per key in a total order, spread over tasks when the input is large."""
    if fits_one_task(df, limit):
        return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)).cast("long"))
    return prefix_sums(df.withColumn("_one", F.lit(1).cast("long")), keys, order, {name: "_one"}, limit=-1).drop("_one")


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], limit: int | None = None
) -> DataFrame:
    """Exact linear-interpolated quantiles per key, from value counts and running sums.

    ``percentile`` keeps every distinct value of a group in one aggregation buffer; this form
    only ever holds one count row at a time.
    """
    keys = list(keys)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    cum = prefix_sums(counts, keys, [value], {"_cum": "_c"}, limit)
    totals = counts.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    j = null_safe_join(cum, totals, keys)
    aggs = []
    for name, q in probs.items():
        pos = (F.col("_n") - 1) * F.lit(float(q))
        aggs.append(F.min(F.when(F.col("_cum") > F.floor(pos), F.col(value))).alias(f"_lo_{name}"))
        aggs.append(F.min(F.when(F.col("_cum") > F.ceil(pos), F.col(value))).alias(f"_hi_{name}"))
        aggs.append(F.max(pos - F.floor(pos)).alias(f"_f_{name}"))
    g = j.groupBy(*keys).agg(F.max("_n").alias("n"), *aggs)
    return g.select(
        *keys,
        "n",
        *[
            (F.col(f"_lo_{m}") + (F.col(f"_hi_{m}") - F.col(f"_lo_{m}")) * F.col(f"_f_{m}")).alias(m)
            for m in probs
        ],
    )


def running_last(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], cols: Sequence[str], limit: int | None = None
) -> DataFrame:
    """Replace each of ``cols`` by its last non-NULL value so far in the key (an as-of carry)."""
    keys, cols = list(keys), list(cols)
    if fits_one_task(df, limit):
        w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
        return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in cols})
    ranged = range_parts(df, [*keys, *order])
    within = [*keys, "_part"]
    w = W.partitionBy(*within).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    filled = materialize(ranged.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in cols}).withColumn("_pos", F.row_number().over(w)))
    tails = filled.groupBy(*within).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_pos"))).alias(f"_b_{c}") for c in cols])
    before = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    heads = tails.select(*within, *[F.last(f"_b_{c}", ignorenulls=True).over(before).alias(f"_b_{c}") for c in cols])
    j = null_safe_join(filled, heads, within)
    return j.select(*[F.coalesce(F.col(c), F.col(f"_b_{c}")).alias(c) if c in cols else F.col(c) for c in df.columns])


def fold_sorted(df: DataFrame, key: Sequence[str], order: Sequence[str], step, schema: T.StructType | str) -> DataFrame:
    """Sequential fold of each key in order, with constant memory per task.

    ``step(pdf, state) -> (out_pdf, state)`` receives consecutive rows of one key; ``state`` is None at
    the start of a key.  Rows stream through a sorted partition, so a long key is never held whole.
    """
    key = list(key)

    def run(batches):
        last, state = None, None
        for pdf in batches:
            if pdf.empty:
                continue
            k = pdf[key]
            change = (k != k.shift()).any(axis=1)
            starts = [i for i, c in enumerate(change.to_numpy()) if c]
            outs = []
            for a, b in zip(starts, [*starts[1:], len(pdf)], strict=True):
                ident = tuple(k.iloc[a])
                if ident != last:
                    state = None
                out, state = step(pdf.iloc[a:b], state)
                last = ident
                if out is not None and len(out):
                    outs.append(out)
            if outs:
                yield pd.concat(outs, ignore_index=True)

    return df.repartition(*key).sortWithinPartitions(*key, *order).mapInPandas(run, schema)
