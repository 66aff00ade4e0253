"""Distributed fits: calibration per head and version, fusion weights, symmetry check, trees."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from sonorisk.functions.identity import order_hash
from sonorisk.functions.math import sigmoid
from sonorisk.operators.curves import calibration_error, detection_curve, min_max_error
from sonorisk.operators.fusion import HEADS, FusionWeights
from sonorisk.scale import materialize, small_or_plain


def fit_platt(df: DataFrame, keys: Sequence[str], raw: str, is_spoof: Column, l2: float = 1e-4, steps: int = 8) -> DataFrame:
    """(keys, a, b, n_fit) of p = sigmoid(a * raw + b), by Newton steps on grouped sums.

    The data is reduced to counts per distinct raw value once; each step is one aggregate over those
    counts, and only the key table of parameters (registry-sized) is joined back.
    """
    keys = list(keys)
    c = df.filter(F.col(raw).isNotNull()).groupBy(*keys, F.col(raw).alias("_x")).agg(F.count(F.lit(1)).alias("_n"), F.sum(is_spoof.cast("long")).alias("_y"))
    c = materialize(c)
    m = c.groupBy(*keys).agg((F.sum(F.col("_x") * F.col("_n")) / F.sum("_n")).alias("_mu"), (F.sum(F.col("_x") * F.col("_x") * F.col("_n")) / F.sum("_n")).alias("_sq"), F.sum("_n").alias("n_fit"))
    par = m.select(*keys, "n_fit", "_mu", (F.sqrt(F.greatest(F.col("_sq") - F.col("_mu") * F.col("_mu"), F.lit(0.0))) + 1e-9).alias("_sd"), F.lit(0.0).alias("a"), F.lit(0.0).alias("b"))
    for step in range(steps):
        j = c.join(small_or_plain(par), keys)
        z = (F.col("_x") - F.col("_mu")) / F.col("_sd")
        p = sigmoid(F.col("a") * z + F.col("b"))
        err, w = F.col("_n") * p - F.col("_y"), F.col("_n") * p * (1 - p)
        s = j.groupBy(*keys, "n_fit", "_mu", "_sd", "a", "b").agg(
            F.sum(err * z).alias("ga"), F.sum(err).alias("gb"), F.sum(w * z * z).alias("haa"), F.sum(w * z).alias("hab"), F.sum(w).alias("hbb")
        )
        n = F.col("n_fit")
        ga, gb = F.col("ga") / n + l2 * F.col("a"), F.col("gb") / n
        haa, hab, hbb = F.col("haa") / n + l2, F.col("hab") / n, F.col("hbb") / n + 1e-9
        det = haa * hbb - hab * hab
        par = s.select(*keys, "n_fit", "_mu", "_sd", (F.col("a") - (hbb * ga - hab * gb) / det).alias("a"), (F.col("b") - (haa * gb - hab * ga) / det).alias("b"))
        if step % 4 == 3:
            par = materialize(par)  # the loop's plan stays short
    return par.select(*keys, (F.col("a") / F.col("_sd")).alias("a"), (F.col("b") - F.col("a") * F.col("_mu") / F.col("_sd")).alias("b"), "n_fit")


def fit_temperature(df: DataFrame, keys: Sequence[str], raw: str, is_spoof: Column, steps: int = 8) -> DataFrame:
    """(keys, temperature, n_fit) of p = sigmoid(raw / T), by 1-D Newton on log(1/T)."""
    keys = list(keys)
    c = materialize(df.filter(F.col(raw).isNotNull()).groupBy(*keys, F.col(raw).alias("_x")).agg(F.count(F.lit(1)).alias("_n"), F.sum(is_spoof.cast("long")).alias("_y")))
    par = c.groupBy(*keys).agg(F.sum("_n").alias("n_fit")).withColumn("t", F.lit(0.0))
    for step in range(steps):
        j = c.join(small_or_plain(par), keys)
        u = F.exp(F.col("t")) * F.col("_x")
        p = sigmoid(u)
        s = j.groupBy(*keys, "n_fit", "t").agg(F.sum((F.col("_n") * p - F.col("_y")) * u).alias("g"), F.sum(F.col("_n") * p * (1 - p) * u * u + (F.col("_n") * p - F.col("_y")) * u).alias("h"))
        h = F.greatest(F.abs(F.col("h")), F.lit(1e-6))
        par = s.select(*keys, "n_fit", (F.col("t") - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("g") / h))).alias("t"))
        if step % 4 == 3:
            par = materialize(par)
    return par.select(*keys, F.exp(-F.col("t")).alias("temperature"), "n_fit")


def design_columns(logits: dict[str, Column], drop: str | None = None) -> list[Column]:
    """Head logits (0 when absent) then missing indicators (never for the watermark head)."""
    x, miss = [], []
    for h in HEADS:
        c = logits.get(h) if h != drop else None
        c = c if c is not None else F.lit(None).cast("double")
        x.append(F.coalesce(c, F.lit(0.0)).alias(f"x_{h}"))
        miss.append((F.when(c.isNull(), 1.0).otherwise(0.0) if h != "F" else F.lit(0.0)).alias(f"m_{h}"))
    return [*x, *miss]


def fit_fusion(df: DataFrame, logits: dict[str, Column], is_spoof: Column, l2: float = 1e-3, version: str = "fit", drop: str | None = None) -> FusionWeights:
    """Logistic regression on head logits with missing indicators."""
    cols = [f"x_{h}" for h in HEADS] + [f"m_{h}" for h in HEADS]
    d = df.select(is_spoof.cast("double").alias("label"), *design_columns(logits, drop))
    v = VectorAssembler(inputCols=cols, outputCol="features").transform(d).select("label", "features")
    m = LogisticRegression(regParam=l2, elasticNetParam=0.0, standardization=False, maxIter=50).fit(v)
    w = [float(x) for x in m.coefficients]
    n = len(HEADS)
    return FusionWeights(
        weights=dict(zip(HEADS, w[:n], strict=True)), missing={h: 0.0 if h == "F" else w[n + i] for i, h in enumerate(HEADS)}, bias=float(m.intercept), version=version
    )


def fused_probability(model: FusionWeights, logits: dict[str, Column], drop: str | None = None) -> Column:
    z = F.lit(model.bias)
    for h in HEADS:
        c = logits.get(h) if h != drop else None
        if c is None:
            z = z + (0.0 if h == "F" else model.missing[h])
        else:
            z = z + F.when(c.isNotNull(), model.weights[h] * c).otherwise(0.0 if h == "F" else model.missing[h])
    return sigmoid(z)


def ablation(df: DataFrame, logits: dict[str, Column], is_spoof: Column, fit_rows: Column) -> DataFrame:
    """Held-out EER and calibration error with all heads and without each one."""
    rows = None
    base = df.withColumns({"_y": is_spoof, "_fit": fit_rows})
    for removed in [None, *logits]:
        m = fit_fusion(base.filter("_fit"), logits, F.col("_y"), drop=removed)
        t = base.filter(~F.col("_fit")).select(fused_probability(m, logits, removed).alias("score"), F.when(F.col("_y"), "spoof").otherwise("bona_fide").alias("label"))
        e = min_max_error(detection_curve(t, []), [])
        c = calibration_error(t, [], "score", F.col("label") == "spoof")
        r = e.join(F.broadcast(c)).select(F.lit("all" if removed is None else f"without {removed}").alias("heads"), F.col("eer_minmax").alias("eer"), "ece")
        rows = r if rows is None else rows.unionByName(r)
    ref = rows.filter("heads = 'all'").select(F.col("eer").alias("_e"))
    return rows.join(F.broadcast(ref)).withColumn("delta_eer_vs_all", F.col("eer") - F.col("_e")).drop("_e")


def symmetry_check(rows: DataFrame, chain: str, id_col: str, label: Column, folds: int = 5, seed: int = 0, l2: float = 1e-2, max_tokens: int = 1000) -> DataFrame:
    """Can channel tokens alone tell the classes apart?  accuracy, baseline, margin, passed.

    Tokens are a short vocabulary (checked); folds come from a hash of the id.
    """
    vocab = sorted(r[0] for r in rows.select(F.explode(chain)).distinct().limit(max_tokens + 1).collect())
    if len(vocab) > max_tokens:
        raise ValueError("channel vocabulary is unbounded")
    fold = F.pmod(F.xxhash64(order_hash(F.col(id_col), seed)), F.lit(folds))
    d = rows.select(label.cast("double").alias("label"), fold.alias("fold"), *[F.array_contains(chain, t).cast("double").alias(f"t{i}") for i, t in enumerate(vocab)])
    v = materialize(VectorAssembler(inputCols=[f"t{i}" for i in range(len(vocab))], outputCol="features").transform(d).select("label", "fold", "features"))
    parts = None
    for k in range(folds):
        m = LogisticRegression(regParam=l2, standardization=False, maxIter=50).fit(v.filter(F.col("fold") != k))
        p = m.transform(v.filter(F.col("fold") == k)).select((F.col("prediction") == F.col("label")).cast("long").alias("ok"), "label")
        parts = p if parts is None else parts.unionByName(p)
    g = parts.agg(F.avg("ok").alias("accuracy"), F.avg("label").alias("_p"), F.count(F.lit(1)).alias("n"))
    base = F.greatest(F.col("_p"), 1 - F.col("_p"))
    g = g.withColumn("baseline", base)
    g = g.withColumn("margin", F.greatest(F.lit(0.02), 3 * F.sqrt(F.col("baseline") * (1 - F.col("baseline")) / F.col("n"))))
    return g.select("n", "accuracy", "baseline", "margin", (F.col("accuracy") <= F.col("baseline") + F.col("margin")).alias("passed"))


def fit_trees(df: DataFrame, features: Sequence[str], label: Column, trees: int = 20, depth: int = 3, step: float = 0.1, bins: int = 32, min_leaf: int = 5):
    """(scored rows, importances by feature): boosted trees with median imputation."""
    spark = df.sparkSession
    d = df.select("*", label.cast("double").alias("label"))
    imp = Imputer(strategy="median", inputCols=list(features), outputCols=[f"_{f}" for f in features]).fit(d)
    v = VectorAssembler(inputCols=[f"_{f}" for f in features], outputCol="features").transform(imp.transform(d))
    m = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=step, maxBins=bins, minInstancesPerNode=min_leaf, seed=0).fit(v)
    scored = m.transform(v).withColumn("p_spoof", vector_to_array("probability")[1])
    imps = spark.createDataFrame([(f, float(w)) for f, w in zip(features, m.featureImportances.toArray(), strict=True)], "feature string, importance double")
    return scored, imps
