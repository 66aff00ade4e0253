"""Removal of repeated word windows behind a count-min prefilter.

A window of 50 words has an anchor: the least hash of its 10-word grams, which equal windows share.  Chunks of documents fill
a count-min sketch with their anchors; the sketches are cut into ranges of cells and added up, and each chunk learns which of
its cells hold two or more.  The least of an anchor's cells overestimates in how many documents it, and so a window, occurs.
A second pass groups exactly, by a 96-bit hash of the words, only the windows whose anchor is estimated repeated.  An
estimate is never too low, so no repeated window is lost.

Scale: equal texts are first reduced to one (with map-side combine), so copies are neither sketched nor grouped.  The sketch's
width follows the corpus; a range of its cells is added up in one task, no part of it is broadcast, and only cells that are
not zero travel.  A chunk counts an anchor once, however many documents hold it, so a passage found everywhere brings a
range one entry a chunk.  Window groups are reduced to their least id before the rows meet them in a join that can split.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from sonorisk.llm.common import nested, reliable, small, stored
from sonorisk.llm.hashing import Powers, WordHashes, mixed, sliding_min

WINDOW, GRAM = 50, 10
DEPTH = 3
RANGE_BITS = 20
CHUNK_ANCHORS = 300_000


class Hasher:
    def __init__(self) -> None:
        self.words, self.first, self.second = WordHashes(), Powers(0), Powers(2)

    def anchors(self, h: np.ndarray) -> np.ndarray:
        """For each window its anchor."""
        grams = mixed(self.first.runs(h, GRAM))
        return sliding_min(grams, WINDOW - GRAM + 1)

    def windows(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return mixed(self.first.runs(h, WINDOW)), mixed(self.second.runs(mixed(h, 0xA5A5A5A5), WINDOW), 1)


def words_of(text: str | None) -> list[bytes]:
    return text.encode().split() if text else []


class CountMin:
    """``DEPTH`` rows of 2**bits counters that stop at two, kept as the cells that are not zero and their counts."""

    def __init__(self, bits: int):
        self.bits = bits
        self.cells = [np.zeros(0, dtype=np.int64)] * DEPTH
        self.counts = [np.zeros(0, dtype=np.uint8)] * DEPTH

    def cells_of(self, h: np.ndarray) -> list[np.ndarray]:
        return [(mixed(h, r + 1) >> np.uint64(64 - self.bits)).astype(np.int64) for r in range(DEPTH)]

    def add(self, h: np.ndarray, n: np.ndarray) -> None:
        for r, cells in enumerate(self.cells_of(h)):
            every = np.concatenate([self.cells[r], cells])
            self.cells[r], back = np.unique(every, return_inverse=True)
            sums = np.bincount(back, weights=np.concatenate([self.counts[r], n]), minlength=len(self.cells[r]))
            self.counts[r] = np.minimum(sums, 2).astype(np.uint8)

    def parts(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(row, range, places in the range, counts) of the cells that are not zero."""
        for r, (cells, counts) in enumerate(zip(self.cells, self.counts, strict=True)):
            at = np.flatnonzero(np.diff(cells >> RANGE_BITS, prepend=-1))
            for a, b in zip(at.tolist(), np.append(at, len(cells))[1:].tolist(), strict=True):
                yield r, int(cells[a] >> RANGE_BITS), (cells[a:b] & ((1 << RANGE_BITS) - 1)).astype(np.uint32), counts[a:b]

    def least(self, h: np.ndarray) -> np.ndarray:
        """The estimate of each added hash: the least of its cells."""
        return np.min([counts[np.searchsorted(own, cells)] for own, counts, cells in zip(self.cells, self.counts, self.cells_of(h), strict=True)], axis=0)


def sketch_bits(anchors: int) -> int:
    """Eight cells for each anchor in a row, and one range at least."""
    return max(RANGE_BITS, (8 * max(1, anchors) - 1).bit_length())


def _body_words(body: bytes) -> list[bytes]:
    return zlib.decompress(body).split()


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in small(batches):
        rows = []
        for t in b.column("t").to_pylist():
            joined = b" ".join(words_of(t))
            rows.append((joined.count(b" ") + bool(joined), hashlib.blake2b(joined, digest_size=16).digest(), hashlib.sha256(joined).hexdigest()))
        yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("id"), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows])], names=["doc", "id", "n_words", "seq", "sha"])


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in small(batches):
        rows = []
        for i, t in zip(b.column("id").to_pylist(), b.column("t").to_pylist(), strict=True):
            joined = b" ".join(words_of(t))
            if joined.count(b" ") + 1 >= WINDOW:
                rows.append((hashlib.blake2b(joined, digest_size=16).digest(), i, zlib.compress(joined, 7)))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], names=["seq", "id", "body"])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each chunk of documents: its distinct anchors, (document, number of anchors), and the places of each document's."""
    hasher, rns, anchors, size = Hasher(), [], [], 0

    def flush():
        h, back = np.unique(np.concatenate(anchors), return_inverse=True)
        columns = (h.view(np.int64), np.array(rns, dtype=np.int64), back.astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in columns], names=["anchors", "owners", "held"])

    for b in small(batches):
        for rn, body in zip(b.column("rn").to_pylist(), b.column("body").to_pylist(), strict=True):
            found = np.unique(hasher.anchors(hasher.words.of(_body_words(body))))
            rns.append((rn, len(found)))
            anchors.append(found)
            size += len(found)
            if size >= CHUNK_ANCHORS:
                yield flush()
                rns, anchors, size = [], [], 0
    if size:
        yield flush()


def _chunk_sketch(anchors: bytes, held: bytes, bits: int) -> tuple[CountMin, np.ndarray, np.ndarray]:
    """The count-min sketch of a chunk, from how many of its documents hold each anchor."""
    h, at = np.frombuffer(anchors, dtype=np.int64).view(np.uint64), np.frombuffer(held, dtype=np.int32)
    sketch = CountMin(bits)
    sketch.add(h, np.bincount(at, minlength=len(h)))
    return sketch, h, at


def _sketches(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, 1):
            for chunk, anchors, held in zip(*(b.column(c).to_pylist() for c in ("chunk", "anchors", "held")), strict=True):
                parts = list(_chunk_sketch(anchors, held, bits)[0].parts())
                columns = ([chunk] * len(parts), [p[0] for p in parts], [p[1] for p in parts], [p[2].tobytes() for p in parts], [p[3].tobytes() for p in parts])
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["chunk", "line", "range", "cells", "counts"])

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add up a range of the chunks' sketches; tell each chunk which of its cells hold two or more."""
    current, parts = None, []

    def flush():
        total = np.zeros(1 << RANGE_BITS, dtype=np.uint8)
        for _, cells, counts in parts:
            at = np.frombuffer(cells, dtype=np.uint32)  # no cell twice in a part
            total[at] = np.minimum(total[at] + np.frombuffer(counts, dtype=np.uint8), 2)
        bits = [np.packbits(total[np.frombuffer(cells, dtype=np.uint32)] > 1).tobytes() for _, cells, _ in parts]
        n = len(parts)
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in parts], pa.int64()), pa.array([current[0]] * n, pa.int32()), pa.array([current[1]] * n, pa.int64()), pa.array(bits, pa.binary())], names=["chunk", "line", "range", "many"])

    for b in small(batches):
        for place, *part in zip(zip(*(b.column(c).to_pylist() for c in ("line", "range")), strict=True), *(b.column(c).to_pylist() for c in ("chunk", "cells", "counts")), strict=True):
            if place != current:
                if parts:
                    yield flush()
                current, parts = place, []
            parts.append(part)
    if parts:
        yield flush()


def _flags(bits: int):
    """Anchors of a chunk's documents that the added sketches estimate in two documents or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, 1):
            for anchors, owners, held, answers in zip(*(b.column(c).to_pylist() for c in ("anchors", "owners", "held", "answers")), strict=True):
                sketch, h, at = _chunk_sketch(anchors, held, bits)
                known = {(a["line"], a["range"]): a["many"] for a in answers}
                lines = [[] for _ in range(DEPTH)]
                for r, k, cells, _ in sketch.parts():
                    lines[r].append(np.unpackbits(np.frombuffer(known[r, k], dtype=np.uint8), count=len(cells)))
                sketch.counts = [1 + np.concatenate(x) for x in lines]
                many = sketch.least(h) > 1
                rn = np.repeat(*np.frombuffer(owners, dtype=np.int64).reshape(-1, 2).T)
                yield pa.RecordBatch.from_arrays([pa.array(rn[many[at]], pa.int64()), pa.array(h[at[many[at]]].view(np.int64), pa.int64())], names=["rn", "h"])

    return run


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hash, id, number and position of every window whose anchor is flagged."""
    hasher = Hasher()
    for b in small(batches):
        cols = [[], [], [], [], []]
        for rn, i, body, flags in zip(*(b.column(c).to_pylist() for c in ("rn", "id", "body", "flags")), strict=True):
            h = hasher.words.of(_body_words(body))
            pos = np.flatnonzero(np.isin(hasher.anchors(h), np.array(flags, dtype=np.int64).view(np.uint64)))
            one, two = hasher.windows(h)
            for c, v in zip(cols, (one[pos].view(np.int64), (two[pos] >> np.uint64(32)).astype(np.uint32).view(np.int32), np.full(len(pos), i), np.full(len(pos), rn), pos), strict=True):
                c.append(v)
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), kind) for c, kind in zip(cols, kinds, strict=True)], names=["h1", "h2", "id", "rn", "pos"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in small(batches):
        n, sha = [], []
        for body, starts in zip(b.column("body").to_pylist(), b.column("starts").to_pylist(), strict=True):
            words = _body_words(body)
            edge = np.zeros(len(words) + 1, dtype=np.int64)
            np.add.at(edge, np.array(starts), 1)
            np.add.at(edge, np.array(starts) + WINDOW, -1)
            gone = np.cumsum(edge)[:-1] > 0
            n.append(int(gone.sum()))
            sha.append(hashlib.sha256(b" ".join(w for w, g in zip(words, gone, strict=True) if not g)).hexdigest())
        yield pa.RecordBatch.from_arrays([b.column("rn"), pa.array(n, pa.int64()), pa.array(sha, pa.string())], names=["rn", "cut_words", "cut_sha"])


def remove_repeats(docs: DataFrame, keep: Sequence[str] | None = ("doc_id",), text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc`` (kept columns), ``n_words, n_removed, kept_sha256`` for every row.

    A word goes when a window of 50 words covers it whose words also start in a document of smaller id.  Rows of one id
    never remove each other.  A NULL id neither removes nor loses words.  NULL, empty and shorter texts lose nothing.
    Repeated rows get the same result; no rows give none.
    """
    rows = nested(docs, keep, t=text, id=doc_id).withColumn("id", F.col("id").cast("long"))
    spark = docs.sparkSession
    base_type = T.StructType([rows.schema["doc"], rows.schema["id"], T.StructField("n_words", T.LongType()), T.StructField("seq", T.BinaryType()), T.StructField("sha", T.StringType())])
    base = reliable(rows.mapInArrow(_summaries, base_type))
    copies = rows.filter("id is not null").select("id", "t").mapInArrow(_bodies, "seq binary, id long, body binary")
    reps = reliable(copies.groupBy("seq").agg(F.min("id").alias("id"), F.min_by("body", "id").alias("body")).withColumn("rn", F.monotonically_increasing_id()))

    chunks = stored(reps.select("rn", "body").mapInArrow(_chunks, "anchors binary, owners binary, held binary").withColumn("chunk", F.monotonically_increasing_id()))
    total = chunks.agg(F.coalesce(F.sum(F.octet_length("anchors")), F.lit(0))).first()[0] // 8
    bits = sketch_bits(total)
    parts = chunks.select("chunk", "anchors", "held").mapInArrow(_sketches(bits), "chunk long, line int, range long, cells binary, counts binary")
    n = min(DEPTH << bits - RANGE_BITS, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    answers = parts.repartition(n, "line", "range").sortWithinPartitions("line", "range").mapInArrow(_merged, "chunk long, line int, range long, many binary")
    told = answers.groupBy("chunk").agg(F.collect_list(F.struct("line", "range", "many")).alias("answers"))  # a bit for each cell of the chunk
    found = chunks.join(told, "chunk").select("anchors", "owners", "held", "answers").mapInArrow(_flags(bits), "rn long, h long")
    flags = found.groupBy("rn").agg(F.collect_list("h").alias("flags"))
    flagged = reliable(reps.select("rn", "id", "body").join(flags, "rn"))
    windows = flagged.mapInArrow(_windows, "h1 long, h2 int, id long, rn long, pos int")
    owners = reliable(windows.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last").select("h1", "h2", "first"))
    starts = windows.join(owners, ["h1", "h2"]).filter("id > first").groupBy("rn").agg(F.collect_list("pos").alias("starts"))
    cuts = flagged.select("rn", "body").join(starts, "rn").mapInArrow(_cut, "rn long, cut_words long, cut_sha string")
    verdicts = reliable(reps.select("seq", "rn", F.col("id").alias("first")).join(cuts, "rn", "left").select("seq", "first", "cut_words", "cut_sha"))
    copy = F.coalesce(F.col("id") > F.col("first"), F.lit(False))
    first = F.coalesce((F.col("id") == F.col("first")) & F.col("cut_words").isNotNull(), F.lit(False))
    return base.join(verdicts, "seq", "left").select(
        "doc", "n_words", F.when(copy, F.col("n_words")).when(first, F.col("cut_words")).otherwise(F.lit(0)).cast("long").alias("n_removed"),
        F.when(copy, F.sha2(F.lit(""), 256)).when(first, F.col("cut_sha")).otherwise(F.col("sha")).alias("kept_sha256"),
    )
