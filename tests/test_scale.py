"""The spread-out plans must equal the native windows, with one key holding most rows."""

import numpy as np
from pyspark.sql import functions as F

from sonorisk import scale


def skewed(spark, n=3000):
    i = F.col("id")
    return spark.range(n).select(F.when(i % 3 != 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), (i % 7).cast("string"))).alias("k"), (i * 7919 % 1009).alias("o"), i.alias("i"), (i % 5).alias("v"), (i % 4 / 3.0).alias("d"))


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_ordered_index_matches_window(spark):
    df = skewed(spark)
    a = scale.ordered_index(df, ["k"], ["o", "i"], limit=1 << 40)
    b = scale.ordered_index(df, ["k"], ["o", "i"], limit=-1)
    assert rows(a, "k", "i", "rn") == rows(b, "k", "i", "rn")


def test_prefix_sums_match_window_for_longs_and_doubles(spark):
    df = skewed(spark)
    a = scale.prefix_sums(df, ["k"], ["o", "i"], {"cv": "v", "cd": "d"}, limit=1 << 40).withColumn("cd", F.round("cd", 6))
    b = scale.prefix_sums(df, ["k"], ["o", "i"], {"cv": "v", "cd": "d"}, limit=-1).withColumn("cd", F.round("cd", 6))
    assert rows(a, "k", "i", "cv", "cd") == rows(b, "k", "i", "cv", "cd")


def test_prefix_sums_without_keys(spark):
    b = scale.prefix_sums(skewed(spark), [], ["i"], {"c": "v"}, limit=-1).orderBy("i").select("c").collect()
    assert [r.c for r in b] == list(np.cumsum([i % 5 for i in range(3000)]))


def test_running_last_matches_window(spark):
    df = skewed(spark).withColumn("x", F.when(F.col("i") % 11 == 0, F.col("i")))
    a = scale.running_last(df, ["k"], ["o", "i"], ["x"], limit=1 << 40)
    b = scale.running_last(df, ["k"], ["o", "i"], ["x"], limit=-1)
    assert rows(a.fillna(-1, ["x"]), "k", "i", "x") == rows(b.fillna(-1, ["x"]), "k", "i", "x")


def test_exact_quantiles_match_numpy(spark):
    df = skewed(spark)
    want = {}
    for r in df.collect():
        want.setdefault(r.k, []).append(r.o)
    for limit in (1 << 40, -1):
        got = {r.k: r for r in scale.exact_quantiles(df, ["k"], "o", {"q1": 0.25, "q9": 0.9}, limit).collect()}
        for k, v in want.items():
            assert abs(got[k].q1 - np.quantile(v, 0.25)) < 1e-9
            assert abs(got[k].q9 - np.quantile(v, 0.9)) < 1e-9


def test_fold_sorted_streams_long_keys_across_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        def step(pdf, st):
            out = []
            for v in pdf["v"]:
                st = (st or 0) + int(v)
                out.append(st)
            return pdf[["k", "i"]].assign(c=out), st

        a = scale.fold_sorted(skewed(spark), ["k"], ["o", "i"], step, "k string, i long, c long")
        b = scale.prefix_sums(skewed(spark), ["k"], ["o", "i"], {"c": "v"})
        assert rows(a, "k", "i", "c") == rows(b, "k", "i", "c")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_broadcast_only_below_the_limit(spark):
    df = spark.range(10)
    assert "broadcast" in scale.small_or_plain(df)._jdf.queryExecution().toString().lower()
    assert "broadcast" not in scale.small_or_plain(df, limit=-1)._jdf.queryExecution().toString().lower()


def odd(spark):
    """NULL keys, NULL values, longs past 2**53, decimals; one key holds most rows."""
    big = F.lit(9007199254740993).cast("long")
    i = F.col("id")
    return spark.range(400).select(
        F.when(i % 5 == 0, F.lit(None)).when(i % 5 < 4, F.lit("hot")).otherwise(F.concat(F.lit("k"), i % 3)).alias("k"), i.alias("i"),
        F.when(i % 3 == 0, big + i).alias("v"), F.when(i % 4 > 0, (i / 4).cast("decimal(10,2)")).alias("d"), F.when(i > 390, F.lit(1)).alias("late"),
    )


def both(spark, fn):
    a, b = fn(odd(spark), 1 << 70), fn(odd(spark), -1)
    assert a.schema.simpleString() == b.schema.simpleString() or [f.dataType for f in a.schema] == [f.dataType for f in b.schema]
    x, y = (sorted(map(repr, d.collect())) for d in (a, b))
    assert x == y and x
    return x


def test_running_sums_agree_with_nulls_and_big_values(spark):
    assert len(both(spark, lambda d, n: scale.prefix_sums(d, ["k"], ["i"], {"cv": "late", "cd": "d", "ci": "i"}, n))) == 400
    both(spark, lambda d, n: scale.prefix_sums(d.withColumn("v", F.col("v") % 1000), ["k"], ["i"], {"cv": "v"}, n))
    both(spark, lambda d, n: scale.ordered_index(d, ["k"], ["i"], "rn", n))


def test_carries_agree_with_nulls_and_big_values(spark):
    rows = both(spark, lambda d, n: scale.running_last(d, ["k"], ["i"], ["v", "d", "late"], n))
    assert any("9007199254740993" in r for r in rows)


def test_quantiles_agree_with_null_keys(spark):
    assert any("k=None" in r for r in both(spark, lambda d, n: scale.exact_quantiles(d, ["k"], "i", {"m": 0.5}, n)))


def test_literal_tables_are_broadcast(spark):
    t = scale.literal_table(spark, [("a", 1, ["x"]), ("b", None, [])], "k string, n int, l array<string>")
    assert sorted(map(tuple, t.collect())) == [("a", 1, ["x"]), ("b", None, [])]
    assert scale.literal_table(spark, [], "k string").count() == 0
    assert scale.estimated_bytes(t) < 32 << 20
