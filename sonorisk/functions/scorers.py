"""Extension points: detectors, scorers, embedders and transforms run over Arrow batches.

A scorer never breaks the job: a row it fails on becomes an abstain row.  Filters on native columns stay in
front of these operators, so Catalyst drops rows before Python sees them.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T


class WindowScorer(Protocol):
    """One detector: an id, a model version, a time budget and a per-window score."""

    head_id: str
    model_version: str
    budget_ms: int

    def warmup(self) -> None: ...

    def score(self, samples: np.ndarray) -> float | None: ...


SCORERS: dict[str, Callable[[], WindowScorer]] = {}


def register_scorer(name: str, factory: Callable[[], WindowScorer]) -> None:
    if name in SCORERS:
        raise ValueError(f"scorer {name} is already registered")
    SCORERS[name] = factory


def build_scorers(names: Iterable[str]) -> list[Callable[[], WindowScorer]]:
    missing = [n for n in names if n not in SCORERS]
    if missing:
        raise KeyError(f"unknown scorers {missing}; known: {sorted(SCORERS)}")
    return [SCORERS[n] for n in names]


SCORED = "head_id string, model_version string, p_spoof double, abstain boolean, abstain_reason string, latency_ms long, over_budget boolean"


def score_windows(df: DataFrame, keys: list[str], samples: str, factories: list[Callable[[], WindowScorer]]) -> DataFrame:
    """One row per window and scorer.  Models load once per Python worker task."""
    schema = T.StructType([df.schema[k] for k in keys] + T._parse_datatype_string(SCORED).fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        heads = [f() for f in factories]
        for h in heads:
            h.warmup()
        for pdf in batches:
            out = []
            for row, x in zip(pdf[keys].itertuples(index=False), pdf[samples], strict=True):
                for h in heads:
                    t0 = time.monotonic()
                    try:
                        p, why = h.score(np.asarray(x)), None
                        why = "insufficient_speech" if p is None else None
                    except Exception:  # noqa: BLE001 - a failing detector abstains
                        p, why = None, "timeout"
                    ms = int((time.monotonic() - t0) * 1000)
                    out.append((*row, h.head_id, h.model_version, p, p is None, why, ms, ms > h.budget_ms))
            yield pd.DataFrame(out, columns=[f.name for f in schema.fields])

    return df.select(*keys, samples).mapInPandas(run, schema)


class FlatnessScorer:
    """Spectral-flatness baseline."""

    head_id, model_version, budget_ms = "B", "B@flat-base-v0.1.0", 50

    def warmup(self) -> None:
        self.score(np.zeros(64))

    def score(self, samples: np.ndarray) -> float | None:
        p = np.abs(np.fft.rfft(samples)) ** 2 + 1e-12
        return float(np.clip(np.exp(np.log(p).mean()) / p.mean(), 0, 1))


class EnergyScorer:
    """Refuses quiet windows; used to exercise abstention and failure."""

    head_id, model_version, budget_ms = "A", "A@energy-base-v0.1.0", 50

    def warmup(self) -> None:
        pass

    def score(self, samples: np.ndarray) -> float | None:
        e = float(np.mean(np.square(samples)))
        if e == 0:
            raise ValueError("silent window")
        return None if e < 0.015 else min(1.0, 20 * e)


register_scorer("flatness", FlatnessScorer)
register_scorer("energy", EnergyScorer)


def utterance_scores(samples: Column, scorer: Callable[[], WindowScorer], window: int, hop: int) -> Column:
    """struct<score, p_spoof, window_scores>: windows of each recording scored and averaged."""
    def run(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        s = scorer()
        s.warmup()
        for xs in it:
            rows = []
            for x in xs:
                x = np.asarray(x, float)
                ps = [s.score(x[i : i + window]) for i in range(0, max(len(x) - window, 0) + 1, hop)]
                ok = [p for p in ps if p is not None]
                m = float(np.mean(ok)) if ok else None
                rows.append((None if m is None else -m, m, ps))
            yield pd.DataFrame(rows, columns=["score", "p_spoof", "window_scores"])

    schema = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("p_spoof", T.DoubleType()), T.StructField("window_scores", T.ArrayType(T.DoubleType()))])
    return F.pandas_udf(_iterator(run, pd.Series, pd.DataFrame), schema)(samples)


def _iterator(fn, arg, ret):
    """Give a closure the type hints of an iterator pandas UDF."""
    fn.__annotations__ = {"it": Iterator[arg], "return": Iterator[ret]}
    return fn


def embed(samples: Column, factory: Callable[[], Callable[[np.ndarray], np.ndarray]]) -> Column:
    """Unit-length embedding of each recording."""
    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        f = factory()
        for xs in it:
            vs = [np.asarray(f(np.asarray(x, float)), float) for x in xs]
            yield pd.Series([v / (np.linalg.norm(v) + 1e-9) for v in vs])

    return F.pandas_udf(_iterator(run, pd.Series, pd.Series), T.ArrayType(T.DoubleType()))(samples)


def spectrum_embedder() -> Callable[[np.ndarray], np.ndarray]:
    return lambda x: np.log(np.abs(np.fft.rfft(x)) + 1e-6)


def detect_watermark(samples: Column, factory: Callable[[], Callable[[np.ndarray], tuple[bool, float]]]) -> Column:
    """struct<present, probability> from a watermark detector."""
    def run(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        f = factory()
        for xs in it:
            yield pd.DataFrame([f(np.asarray(x, float)) for x in xs], columns=["present", "probability"])

    schema = T.StructType([T.StructField("present", T.BooleanType()), T.StructField("probability", T.DoubleType())])
    return F.pandas_udf(_iterator(run, pd.Series, pd.DataFrame), schema)(samples)


def sign_detector() -> Callable[[np.ndarray], tuple[bool, float]]:
    def f(x: np.ndarray) -> tuple[bool, float]:
        share = float(np.mean(x > 0))
        return share > 0.6, share

    return f


def classify_text(text: Column, factory: Callable[[], Callable[[str], list[str]]]) -> Column:
    """Labels of a text classifier as an array."""
    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        f = factory()
        for xs in it:
            yield xs.map(f)

    return F.pandas_udf(_iterator(run, pd.Series, pd.Series), T.ArrayType(T.StringType()))(text)


def keyword_classifier() -> Callable[[str], list[str]]:
    return lambda t: [k for k in ("otp", "transfer", "police") if k in t.lower()]


def apply_chain(samples: Column, key: Column, steps: list[Callable[[np.ndarray, np.random.Generator], np.ndarray]]) -> Column:
    """A chain of signal transforms, seeded by the row key."""
    from sonorisk.operators.signal import _rng

    def run(xs: pd.Series, ks: pd.Series) -> pd.Series:
        out = []
        for x, k in zip(xs, ks, strict=True):
            r, y = _rng(k, 0), np.asarray(x, float)
            for s in steps:
                y = s(y, r)
            out.append(y)
        return pd.Series(out)

    return F.pandas_udf(run, T.ArrayType(T.DoubleType()))(samples, key)


def stub_score(head: str, session: Column, window: Column, seed: int, abstain_share: float) -> dict[str, Column]:
    """Deterministic hash score for tests, as native columns."""
    def u(tag: str) -> Column:
        h = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.lit(tag), session.cast("string"), window.cast("string")), 256)
        return F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / float(0xFFFFFFFF)

    abstain = u(head + "_abstain") < abstain_share
    return {"p_spoof": F.when(~abstain, u(head)), "abstain": abstain, "confidence": F.when(~abstain, 0.5 + F.abs(u(head) - 0.5)).otherwise(0.0)}
