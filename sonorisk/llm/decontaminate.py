"""Benchmark decontamination by Wu-Manber search over words.

The benchmark's windows are test strings over the alphabet of words.  A table over blocks of two words gives the
distance by which the search may shift; where it is zero, the block selects the bucket of windows that end in it, and
direct comparison confirms an occurrence.

Scale: documents stay where they lie; no shuffle.  The benchmark is cut into blocks of ``block_bytes`` by a hash of
its rows, each a broadcast of that bound; with several blocks the documents pass them one after another, cut by
checkpoints, so any benchmark size is searched in full.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from sonorisk.llm.common import nested, reliable, small

WINDOW = 10
#: A-Z to a-z; bytes outside the word pattern to a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_FOLD).split() if text else []


class WuManber:
    """Windows of one length: ``shift`` by block, and by final block the windows with their items."""

    def __init__(self, windows: dict[tuple[bytes, ...], set[str]], length: int):
        self.length = length
        self.block = min(2, length)
        self.far = length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.bucket: dict[tuple[bytes, ...], dict[tuple[bytes, ...], set[str]]] = {}
        for w, items in windows.items():
            for end in range(self.block, length + 1):
                key = w[end - self.block : end]
                self.shift[key] = min(self.shift.get(key, self.far), length - end)
            self.bucket.setdefault(w[length - self.block :], {})[w] = items

    def search(self, words: Sequence[bytes]) -> Iterator[tuple[int, set[str]]]:
        """End positions (exclusive) of occurrences, ascending, with the items of the window."""
        shift, far, block, length = self.shift, self.far, self.block, self.length
        end, n = length, len(words)
        while end <= n:
            key = tuple(words[end - block : end])
            step = shift.get(key, far)
            if step:
                end += step
                continue
            items = self.bucket[key].get(tuple(words[end - length : end]))
            if items is not None:
                yield end, items
            end += 1


def build(items: Sequence[tuple[str | None, str | None]]) -> list[WuManber]:
    """One searcher for each window length: ten words, or all of a shorter item."""
    by_length: dict[int, dict[tuple[bytes, ...], set[str]]] = {}
    for item, text in items:
        words = words_of(text)
        length = min(WINDOW, len(words))
        for i in range(len(words) - length + 1 if length else 0):
            found = by_length.setdefault(length, {}).setdefault(tuple(words[i : i + length]), set())
            if item is not None:
                found.add(item)
    return [WuManber(w, k) for k, w in sorted(by_length.items())]


def hit_runs(words: Sequence[bytes], searchers: Sequence[WuManber], runs: Sequence[int] = ()) -> tuple[list[int], set[str]]:
    """Runs of hit words as flat starts and ends, joined with ``runs``, and the items that occur."""
    spans, items = list(zip(runs[::2], runs[1::2], strict=True)), set()
    for s in searchers:
        for end, found in s.search(words):
            spans.append((end - s.length, end))
            items |= found
    out: list[int] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out, items


def _block_search(shared, keep_text: bool):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searchers = build(shared.value)
        for b in small(batches):
            n, runs, items = [], [], []
            for text, r, i in zip(b.column("t").to_pylist(), b.column("runs").to_pylist(), b.column("items").to_pylist(), strict=True):
                words = words_of(text)
                got, found = hit_runs(words, searchers, r or ())
                n.append(len(words))
                runs.append(got)
                items.append(sorted(found | set(i or ())))
            t = b.column("t") if keep_text else pa.nulls(len(n), pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc"), t, pa.array(n, pa.int64()), pa.array(runs, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))], names=["doc", "t", "n_words", "runs", "items"])

    return search


def find_contamination(docs: DataFrame, benchmark: DataFrame, keep: Sequence[str] | None = ("doc_id",), text: str = "text", block_bytes: int = 4 << 20) -> DataFrame:
    """``doc`` (kept columns), ``n_words, n_hit, n_items, items`` (sorted ids) and ``runs`` of hit words for every row.

    ``benchmark``: ``item_id, text``.  NULL and empty texts have no words and no windows.  An item with a NULL id hits
    but is neither counted nor listed; repeated ids count once.  An empty benchmark hits nothing; no documents give no
    rows.
    """
    spark = docs.sparkSession
    bench = benchmark.select(F.col("`item_id`").cast("string").alias("i"), F.col("`text`").alias("b")).filter("b is not null")
    size = bench.agg(F.coalesce(F.sum(F.octet_length("b")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes))
    rows = nested(docs, keep, t=text).select("doc", "t", F.lit(0).cast("long").alias("n_words"), F.array().cast("array<int>").alias("runs"), F.array().cast("array<string>").alias("items"))
    schema = T.StructType([T.StructField("doc", rows.schema["doc"].dataType), T.StructField("t", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(T.IntegerType())), T.StructField("items", T.ArrayType(T.StringType()))])
    for k in range(blocks):
        part = bench.filter(F.pmod(F.xxhash64("i", "b"), F.lit(blocks)) == k) if blocks > 1 else bench
        shared = spark.sparkContext.broadcast([(r.i, r.b) for r in part.collect()])  # block_bytes of text, about
        last = k == blocks - 1
        rows = rows.mapInArrow(_block_search(shared, not last), schema)
        rows = rows if last else reliable(rows)
    pairs = F.transform(F.sequence(F.lit(0), F.size("runs") - 2, F.lit(2)), lambda j: F.get("runs", j + 1) - F.get("runs", j))
    n_hit = F.when(F.size("runs") > 0, F.aggregate(pairs, F.lit(0).cast("long"), lambda a, x: a + x)).otherwise(F.lit(0).cast("long"))
    return rows.select("doc", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", "runs")


