"""Challenge answers: text normalisation, ordered matching, and the timing verdict."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from sonorisk.scale import small_slices

_TOKEN = re.compile(r"[\wऀ-෿]+")


def normalise(text: str | None) -> list[str]:
    return _TOKEN.findall(unicodedata.normalize("NFC", (text or "").lower()))


def _normalise_batches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        for (some,) in small_slices([texts]):
            yield pa.array([normalise(t) for t in some.to_pylist()], pa.list_(pa.string()))


def normalised_tokens(text: Column) -> Column:
    """NFC lower-case tokens (Spark has no Unicode normalisation)."""
    return F.arrow_udf(_normalise_batches, T.ArrayType(T.StringType()))(text)


def ordered_match(expected: list[list[str]], words: list[str]) -> float:
    """Share of expected tokens (each a set of forms) found in order in the words."""
    row = [0] * (len(words) + 1)
    for forms in expected:
        ok = {w for f in forms for w in normalise(f)} | {f.lower() for f in forms}
        diag = 0
        for j, w in enumerate(words, 1):
            up = row[j]
            row[j] = max(up, row[j - 1], diag + (w in ok))
            diag = up
    return row[-1] / max(len(expected), 1)


def _match_batches(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for columns in batches:
        for expected, words in small_slices(columns):
            pairs = zip(expected.to_pylist(), words.to_pylist(), strict=True)
            yield pa.array([ordered_match(e, w) if len(w) else 0.0 for e, w in pairs], pa.float64())


def challenge_match(expected: Column, words: Column) -> Column:
    """expected: array<array<string>> of accepted forms in order; words: normalised tokens."""
    return F.arrow_udf(_match_batches, T.DoubleType())(expected, words)


def timing(starts: Column, ends: Column) -> dict[str, Column]:
    """Speaking rate and gap variation of token times (NULL under three tokens)."""
    n = F.size(starts)
    dur = (F.element_at(ends, -1) - F.element_at(starts, 1)) / 1000.0
    rate = F.when((n >= 3) & (dur > 0), n / dur)
    m = F.greatest(n - 1, F.lit(0))
    gaps = F.zip_with(F.slice(starts, 2, m), F.slice(starts, 1, m), lambda a, b: (a - b).cast("double"))
    acc = F.aggregate(
        gaps,
        F.struct(F.lit(0.0).alias("k"), F.lit(0.0).alias("s"), F.lit(0.0).alias("q")),
        lambda a, x: F.struct((a["k"] + 1).alias("k"), (a["s"] + x).alias("s"), (a["q"] + x * x).alias("q")),
    )
    k = F.nullif(acc["k"], F.lit(0.0))
    mean = acc["s"] / k
    var = F.greatest(acc["q"] / k - mean * mean, F.lit(0.0))
    return {"rate": rate, "gap_cv": F.when((n >= 3) & (mean > 0), F.sqrt(var) / mean)}


def verdict(match: Column, latency_ms: Column, rate: Column, gap_cv: Column) -> dict[str, Column]:
    """Log-odds, probability and reasons of an answer (positive = synthetic)."""
    z = F.when(match < 0.5, 4.0).when(match < 1.0, 1.0).otherwise(-1.0)
    z = z + F.when(latency_ms.isNull(), 0.0).when(latency_ms < 150, 3.0).when(latency_ms > 3500, 3.5).when(latency_ms > 2000, 1.0).otherwise(-1.0)
    z = z + F.when((rate < 0.8) | (rate > 6.0), 1.0).otherwise(0.0) + F.when(gap_cv < 0.08, 1.0).otherwise(0.0)
    reasons = F.filter(
        F.array(
            F.when(match < 0.5, "challenge not repeated").when(match < 1.0, "challenge partly repeated"),
            F.when(latency_ms < 150, "answered too fast").when(latency_ms > 3500, "pipeline delay").when(latency_ms > 2000, "slow start"),
            F.when((rate < 0.8) | (rate > 6.0), "implausible rate"),
            F.when(gap_cv < 0.08, "evenly spaced words"),
        ),
        lambda x: x.isNotNull(),
    )
    return {"z": z, "p_spoof": 1 / (1 + F.exp(-(z - 1.0))), "reasons": F.when(F.size(reasons) == 0, F.array(F.lit("natural"))).otherwise(reasons)}


def answers(challenges: DataFrame, responses: DataFrame, ttl_us: int = 30_000_000) -> DataFrame:
    """Responses joined to their challenge; answers after the time limit are flagged, not dropped."""
    j = challenges.join(responses, ["session_id", "challenge_id"], "left")
    waited = F.col("answered_us") - F.col("issued_us")
    return j.withColumn("outcome", F.when(waited.isNull(), "no_answer").when(waited > ttl_us, "late").otherwise("in_time"))


def active_challenges(challenges: DataFrame) -> DataFrame:
    """The newest challenge of each session (issuing a new one replaces the old)."""
    rest = [c for c in challenges.columns if c != "session_id"]
    return challenges.groupBy("session_id").agg(F.max_by(F.struct(*rest), F.struct("issued_us", "challenge_id")).alias("_c")).select("session_id", "_c.*")


def liveness_abstain(windows: DataFrame, active: DataFrame, responses: DataFrame, ttl_us: int = 30_000_000) -> DataFrame:
    """Why the liveness head abstains per window: no challenge, awaiting or expired; NULL = scored."""
    r = responses.select("challenge_id", F.lit(True).alias("_answered")).distinct()
    a = active.select("session_id", "challenge_id", "issued_us").join(r, "challenge_id", "left")
    j = windows.join(a, "session_id", "left")
    reason = (
        F.when(F.col("challenge_id").isNull(), "no challenge")
        .when(F.col("_answered").isNull() & (F.col("ts_us") > F.col("issued_us") + ttl_us), "challenge expired without an answer")
        .when(F.col("_answered").isNull(), "awaiting answer")
    )
    return j.withColumn("reason", reason).drop("_answered")
