"""Per-row Python work holds few rows' objects at a time and gives the whole batch's values."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sonorisk.operators import liveness as LV, signal as SG, speakers as SP
from sonorisk.scale import small_slices


def test_slices_cover_a_batch_in_order():
    long, short = pa.array(["x" * 900] * 3 + ["y"] * 50 + [None]), pa.array(range(54))
    parts = list(small_slices([long, short], 1000))
    assert [v for _, b in parts for v in b.to_pylist()] == list(range(54))
    assert all(len(a) == 1 or a.nbytes + b.nbytes <= 1000 for a, b in parts) and len(parts) > 3


def test_decoded_samples_leave_in_small_arrays():
    n, size = 400, 8192
    cols = (pa.array([bytes([i % 256]) * size for i in range(n)]), pa.array(["mulaw"] * n), pa.array([8000] * n))
    out = list(SG._decode_batches(iter([cols])))
    assert sum(len(a) for a in out) == n and max(a.nbytes for a in out) < 2 * n * size  # all samples take 8 times that
    assert all(len(x) == 2 * size and np.ptp(np.asarray(x)) == 0 for a in out for x in a.to_pylist()[:1])


def test_answers_match_in_small_arrays():
    n = 300
    text = pa.array([f"The account {i} " * 400 for i in range(n)])
    words = list(LV._normalise_batches(iter([text])))
    assert len(words) > 1 and [w[1] for a in words for w in a.to_pylist()] == ["account"] * n
    expected = pa.array([[["the", "die"], ["account"], ["missing"]]] * n)
    match = list(LV._match_batches(iter([(expected, pa.concat_arrays(words))])))
    assert len(match) > 1 and [round(m, 6) for a in match for m in a.to_pylist()] == [round(2 / 3, 6)] * n


def test_decode_and_match_on_spark(spark):
    d = spark.createDataFrame([(i, "the account is here") for i in range(50)], "id long, text string")
    exp = F.array(F.array(F.lit("the")), F.array(F.lit("here")), F.array(F.lit("no")), F.array(F.lit("is")))
    r = d.select(F.size(SG.decode_audio(F.encode("text", "UTF-8"), F.lit("alaw"), F.lit(8000))).alias("n"), LV.challenge_match(exp, LV.normalised_tokens(F.col("text"))).alias("m")).collect()
    assert {(x.n, x.m) for x in r} == {(38, 0.5)}


def test_block_products_hold_few_scores(monkeypatch):
    import pandas as pd

    monkeypatch.setattr(SP, "PRODUCTS", 100)
    seen = []

    def reduce(_, rows, a, rids, b):
        seen.append(len(a) * len(b))
        return pd.DataFrame({"id": rows["id"], "s": (a @ b.T).sum(axis=1)})

    at = {"grp": 0, "_down": 0, "_across": 0}
    right = pd.DataFrame([{**at, "_side": 0, "id": None, "_rid": i, "vec": [1.0, float(i)]} for i in range(20)])
    left = pd.DataFrame([{**at, "_side": 1, "id": i, "_rid": None, "vec": [float(i), 1.0]} for i in range(33)])
    out = pd.concat(SP._products(reduce, ["grp", "_down", "_across"], [])(iter([right, left])))
    assert max(seen) <= 100 and out["s"].tolist() == [20.0 * i + 190 for i in range(33)]
