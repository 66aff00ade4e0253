"""Quality rules with host verdicts.

Every document gets its rule counts; failures are aggregated by host, the host's rates are shrunk with an
empirical beta prior, and a host whose shrunk rate of some rule exceeds that rule's limit loses its documents.

Scale: one pass reads the texts and leaves a narrow table, checkpointed; hosts are counted with map-side combine;
the verdict table is checkpointed as well, so the join has an exchange on both sides and a host with a third of
the documents can be split.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from sonorisk.llm.common import beta_prior, nested, reliable, small

SPACE, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
#: Rule: (SQL condition of a failing document, limit of a host's shrunk failure rate).
RULES = {
    "short": ("n_words < 50", 0.5),
    "repeated": ("100 * n_repeat_words > 50 * n_words", 0.5),
    "symbols": ("10 * n_symbols > n_words", 0.5),
    "dup_lines": ("n_dup_lines > 20", 0.5),
}
BASE_FAILED = "(n_words < 50 or 100 * n_repeat_words > 50 * n_words)"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: Sequence[bytes], window: int = 3) -> int:
    """Words inside a window of ``window`` words that occurs twice or more."""
    n = len(words)
    if n <= window:
        return 0
    index = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(index.__getitem__, words), dtype=np.int64, count=n)
    code = ids[: n - window + 1]
    for k in range(1, window):
        _, code = np.unique(code * len(index) + ids[k : n - window + 1 + k], return_inverse=True)
    starts = np.flatnonzero(np.bincount(code)[code] > 1)
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + window, -1)
    return int((np.cumsum(change)[:n] > 0).sum())


def text_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """``COUNTS`` of one text; NULL and empty texts have zeros."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode().split()
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.strip(SPACE):
            dup += line in seen
            seen.add(line)
    return len(words), len(text) - sum(map(text.count, SPACE)), sum(map(text.count, SYMBOLS)), dup, repeated_words(words)


def count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in small(batches):
        rows = [text_counts(t) for t in b.column("t").to_pylist()]
        cols = [pa.array([r[k] for r in rows], pa.int64()) for k in range(len(COUNTS))]
        yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("host"), *cols], names=["doc", "host", *COUNTS])


def judge_documents(docs: DataFrame, keep: Sequence[str] | None = ("doc_id",), text: str = "text", host: str = "source") -> DataFrame:
    """``doc`` (kept columns), the counts, ``base_failed``, ``kept`` and ``host_rejected`` for every row.

    A NULL text has no words and fails; a NULL host is a host of its own.  Repeated rows are judged, and count, once a
    row.  An empty table gives no rows.
    """
    rows = nested(docs, keep, t=text, host=host).withColumn("host", F.coalesce(F.concat(F.lit("h"), F.col("host")), F.lit("none")))
    schema = T.StructType([rows.schema["doc"], rows.schema["host"], *[T.StructField(c, T.LongType()) for c in COUNTS]])
    counted = reliable(rows.mapInArrow(count_rows, schema))
    failures = {r: F.sum(F.expr(f"cast({c} as long)")).alias(r) for r, (c, _) in RULES.items()}
    hosts = reliable(counted.groupBy("host").agg(F.count(F.lit(1)).alias("n"), *failures.values()))
    bad = F.lit(False)
    for r, (_, limit) in RULES.items():
        mean, strength = beta_prior(hosts.select("n", F.col(r).alias("bad")))
        bad = bad | ((F.col(r) + F.lit(strength * mean)) / (F.col("n") + F.lit(strength)) > limit)
    verdicts = reliable(hosts.select("host", bad.alias("host_rejected")))
    failed = F.expr(BASE_FAILED)
    return counted.join(verdicts, "host").select("doc", *COUNTS, failed.alias("base_failed"), (~failed & ~F.col("host_rejected")).alias("kept"), "host_rejected")
