"""Whitening against dense linear algebra, and its exact parts against known polynomials."""

import math

import numpy as np
import pyarrow as pa
import pytest

from sonorisk.llm import whitening as WH


def embeddings(vectors, kind=None):
    kind = kind or pa.float32()
    return pa.table({"vec_id": pa.array(range(len(vectors)), pa.int64()), "embedding": pa.array(vectors, pa.list_(kind)), "vec": ["clash"] * len(vectors), "n": ["clash"] * len(vectors)})


def run(spark, write_tables, vectors, kind=None, **how):
    sf = write_tables(embeddings=embeddings(vectors, kind))
    return WH.whiten(spark.read.parquet(f"{sf}/embeddings.parquet"), **how).select("doc.vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error").toPandas()


def agrees(got, vectors, ids, components=32):
    x = np.floor(64 * np.array(vectors, dtype=np.float64)) + 1_000_000
    n, z = len(x), x - x.mean(axis=0)
    e, v = np.linalg.eigh(z.T @ z / n)
    e, v = e[::-1][:components], v[:, ::-1][:, :components]
    want, have = z @ v / np.sqrt(e), got.pivot(index="vec_id", columns="component", values="whitened").loc[ids].to_numpy()
    assert np.abs(have * np.sign((have * want).sum(axis=0)) - want).max() < 1e-7
    share = got.drop_duplicates("component").sort_values("component")["explained"].to_numpy()
    assert np.abs(share / (e / (z**2).sum() * n) - 1).max() < 1e-9
    assert got["identity_error"].nunique() == 1 and got["identity_error"].max() < 1e-9
    dev = [sum(int(d) ** 2 for d in row) for row in (n * x - x.sum(axis=0))]
    first = got.drop_duplicates("vec_id").set_index("vec_id")["deviation"]
    assert [int(first[i]) for i in ids] == dev and (got["n"] == n).all()


def test_odd_rows_are_dropped(spark, write_tables):
    rng = np.random.default_rng(3)
    good = rng.normal(size=(40, 6)).astype(np.float32).tolist()
    bad = [None, [], [None, 1, 1, 1, 1, 1], [math.nan] * 6, [1, 1, 1, 1, 1, math.inf], [1.0] * 5, [1.0] * 9]
    got = run(spark, write_tables, good + bad + good[:3])
    agrees(got, good + good[:3], [*range(40), 47, 48, 49], 6)
    assert len(got) == 43 * 6


def test_components_are_the_greatest(spark, write_tables):
    rows = (np.random.default_rng(5).normal(size=(300, 40)) * np.linspace(1, 3, 40)).astype(np.float32).tolist()
    agrees(run(spark, write_tables, rows), rows, list(range(300)))


@pytest.mark.parametrize("rows", [[], [[1.0, 2.0]], [[0.5, 0.5]] * 5, [None, []]])
def test_no_variance_gives_no_rows(spark, write_tables, rows):
    assert len(run(spark, write_tables, rows)) == 0


def test_dependent_dimensions_and_equal_roots(spark, write_tables):
    # two equal eigenvalues, one zero: the components of the pair are any orthonormal pair
    rows = [[1.0, 0, 0, 5], [-1, 0, 0, 5], [0, 1, 0, 5], [0, -1, 0, 5], [0, 0, 3, 5], [0, 0, -3, 5]]
    got = run(spark, write_tables, rows, pa.float64())
    assert sorted(got["component"].unique()) == [1, 2, 3] and got["identity_error"].max() < 1e-12
    share = got.drop_duplicates("component").sort_values("component")["explained"].tolist()
    assert share == pytest.approx([9 / 11, 1 / 11, 1 / 11], rel=1e-15)


def test_entries_of_any_size(spark, write_tables):
    rows = [[1e30, 0.0], [-1e30, 1.0], [0.0, 2.0], [5e29, 3.0]]
    got = run(spark, write_tables, rows, pa.float64())
    assert got["deviation"].isna().any() and got["identity_error"].max() < 1e-9 and len(got) == 8


def test_exact_parts(spark):
    rng = np.random.default_rng(1)
    a = rng.integers(-9, 9, (7, 7))
    p = WH.primes_below(1 << 31, 3)
    assert p[0] == 2**31 - 1
    poly = [int(c) for c in np.round(np.poly(a)[::-1])]
    assert [c - p[0] if c > p[0] // 2 else c for c in WH.characteristic_mod(a % p[0], p[0])] == poly
    assert WH.remainders([[v % q for v in (-5, 10**20, 3)] for q in p], p) == [-5, 10**20, 3]
    assert WH.gcd_mod([2, -3, 1], [-1, 1], 101) == [100, 1]
    # roots 1/1, 2, 2 + 1e-9 of an integer polynomial: close, but apart
    big = 10**9
    cubic = [1]
    for r in (big, 2 * big, 2 * big + 1, 2 * big + 1):
        cubic = [(cubic[k - 1] if k else 0) - r * (cubic[k] if k < len(cubic) else 0) for k in range(len(cubic) + 1)]
    simple = WH.divided(cubic, [-(2 * big + 1), 1])
    assert [(num / (1 << s), m) for num, s, m in WH.greatest_roots(cubic, simple, 10 * big, 9)] == [(2e9 + 1, 2), (2e9, 1), (1e9, 1)]
    got = WH.characteristic_polynomial(spark, [[4, 0, 0], [0, 4, 0], [0, 0, 9]])
    assert got == ([-144, 88, -17, 1], [36, -13, 1])


@pytest.mark.parametrize("table", ["embeddings"])
def test_the_given_table(spark, sf, table):
    from sonorisk.llm.queries import QUERIES

    t = spark.read.parquet(f"{sf}/{table}.parquet").toPandas().sort_values("vec_id")
    agrees(QUERIES["op11_whitening"](spark, sf).toPandas(), t["embedding"].tolist(), t["vec_id"].tolist())
