"""Similarity join of shingle sets by T-occurrence search (DivideSkip).

Two sets link at a Jaccard similarity of 0.9 or more.  A set is asked against inverted lists of shingles: a partner must stand
in at least T of its lists.  The longest lists are put aside and the short ones are merged through a heap that skips members
which cannot reach what is left of T; members that do are looked up in the long lists by bisection, and kept if they reach
the overlap that their own size asks for.

Scale: texts of equal words are one node.  Which nodes meet is settled by rare shingles: a set that links with another misses
at most a tenth of its shingles there, so of its 1 + size / 10 rarest ones (by counts of the nodes in a token's hash cell;
ties by hash) they share at least one.  Sets of 250 shingles or more do so within the sixth of all hashes that a residue picks, those
that have too few there once more within all.  Nodes of a shared rare shingle form a list, and lists with the same least node are one,
since sets that link share many shingles.  A list is never expanded into pairs: first its members meet that node and classes
are contracted, then what is still open in the list, rows outside its largest class against all its rows, meets in blocks of
bounded size.  No list or candidate is dropped.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import zlib
from bisect import bisect_left
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from sonorisk.llm.common import nested, reliable, small, stored
from sonorisk.llm.hashing import Powers, WordHashes, mixed
from sonorisk.llm.near_dups import _components

SHINGLE = 3
PERCENT = 90
LARGE, RESIDUES = 250, 6
BLOCK = 128
CHUNK_TOKENS, RANGE_BITS, MOST = 300_000, 20, 255
MU = 0.0085


def words_of(text: str | None) -> list[bytes]:
    """Words between white space, A-Z lower-cased."""
    return text.encode().lower().split() if text else []


class Shingles:
    def __init__(self) -> None:
        self.words, self.powers = WordHashes(), Powers()

    def of(self, words: list[bytes]) -> np.ndarray:
        """Distinct shingle hashes, ascending; fewer words than a shingle has are one."""
        if not words:
            return np.zeros(0, dtype=np.uint64)
        runs = self.powers.runs(self.words.of(words), min(SHINGLE, len(words)))
        return np.unique(mixed(runs, len(words) if len(words) < SHINGLE else 0))

    def packed(self, body: bytes) -> np.ndarray:
        return self.of(zlib.decompress(body).split())


# ---- T-occurrence search ----------------------------------------------------------------------


def merge_skip(lists: Sequence[Sequence[int]], least: int) -> Iterator[tuple[int, int]]:
    """(member, count) of the members of at least ``least`` ascending lists, through a heap of the lists' heads.

    When the least head occurs too rarely, ``least`` - 1 heads are taken off and their lists jump to the next head left.
    """
    heap = [(x[0], k) for k, x in enumerate(lists) if len(x)]
    heapq.heapify(heap)
    place = [0] * len(lists)
    while len(heap) >= least:
        member, taken = heap[0][0], []
        while heap and heap[0][0] == member:
            taken.append(heapq.heappop(heap)[1])
        if len(taken) >= least:
            yield member, len(taken)
            ahead = member + 1
        else:
            while heap and len(taken) < least - 1:
                taken.append(heapq.heappop(heap)[1])
            if not heap:
                return  # fewer lists than asked for are left
            ahead = max(member + 1, heap[0][0])
        for k in taken:
            at = bisect_left(lists[k], ahead, place[k])
            place[k] = at
            if at < len(lists[k]):
                heapq.heappush(heap, (lists[k][at], k))


def divide_skip(lists: Sequence[Sequence[int]], least: int) -> Iterator[tuple[int, int]]:
    """(member, count) of all members that stand in at least ``least`` of the ascending lists."""
    lists = sorted((x for x in lists if len(x)), key=len, reverse=True)
    if least < 1 or len(lists) < least:
        return
    long = min(least - 1, int(least / (MU * math.log2(len(lists[0]) + 1) + 1)))
    for member, count in merge_skip(lists[long:], least - long):
        for k in range(long):
            if count + long - k < least:
                break
            at = bisect_left(lists[k], member)
            count += at < len(lists[k]) and lists[k][at] == member
        if count >= least:
            yield member, count


class Inverted:
    """Inverted lists of the shingles of a block's sets."""

    def __init__(self, sets: Sequence[np.ndarray]):
        self.sizes = [len(s) for s in sets]
        member = np.repeat(np.arange(len(sets)), self.sizes)
        h = np.concatenate([np.zeros(0, dtype=np.uint64), *sets])
        order = np.argsort(h, kind="stable")  # members ascend inside a list
        self.member, h = member[order].tolist(), h[order]
        self.shingles, self.starts = np.unique(h, return_index=True)
        self.ends = np.append(self.starts, len(h))[1:]

    def linked(self, asked: np.ndarray) -> Iterator[int]:
        """Members whose Jaccard similarity with ``asked`` reaches the limit."""
        size, total = len(asked), 100 + PERCENT
        fewest = -(-PERCENT * size // 100)  # a partner has at least so many shingles, and shares at least so many
        at = np.searchsorted(self.shingles, asked)
        inside = at < len(self.shingles)
        at, asked = at[inside], asked[inside]
        at = at[self.shingles[at] == asked]
        lists = [self.member[a:b] for a, b in zip(self.starts[at].tolist(), self.ends[at].tolist(), strict=True)]
        for member, count in divide_skip(lists, max(1, -(-PERCENT * (size + fewest) // total))):
            if total * count >= PERCENT * (size + self.sizes[member]):
                yield member


def _links(shingles: Shingles, rows: list[tuple[int, int, bytes]]) -> list[tuple[int, int]]:
    """Links between different classes of the two sides of a block, at most one for each two that the task finds apart."""
    left, right = ([r for r in rows if r[0] == side] for side in (0, 1))
    if not left or not right:
        return []
    index = Inverted([shingles.packed(r[2]) for r in right])
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    out = []
    for _, label, body in left:
        for member in index.linked(shingles.packed(body)):
            u, v = find(label), find(right[member][1])
            if u != v:
                parent[max(u, v)] = min(u, v)
                out.append((label, right[member][1]))
    return out


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between classes over rows sorted by block."""
    shingles, current, rows = Shingles(), None, []

    def flush():
        found = _links(shingles, rows)
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["u", "v"])

    for b in small(batches):
        for block, side, label, body in zip(zip(*(b.column(c).to_pylist() for c in ("list", "p", "q")), strict=True), *(b.column(c).to_pylist() for c in ("side", "label", "body")), strict=True):
            if block != current:
                if rows:
                    yield flush()
                current, rows = block, []
            rows.append((side, label, body))
    if rows:
        yield flush()


# ---- which nodes meet -------------------------------------------------------------------------


def tokens_of(shingles: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """(tokens, spare) for each way a set takes part: its ``len - spare`` rarest tokens are to be shared.

    The last two bits name the way: 0 all shingles, for sets under ``LARGE`` and partners of such; 1 a residue, for the
    others; 2 all shingles again, for sets with too few in the residue.
    """
    size, out = len(shingles), []
    missing = size * (100 - PERCENT) // 100
    way = lambda x, k: ((x & ~np.uint64(3)) | np.uint64(k)).view(np.int64)
    if size * PERCENT < LARGE * 100:
        out.append((way(shingles, 0), size - 1 - missing))
    if size >= LARGE:
        part = shingles[(shingles >> np.uint64(2)) % np.uint64(RESIDUES) == 0]
        out.append((way(part, 1), max(0, len(part) - 1 - missing)))
        if len(part) <= missing:
            out.append((way(shingles, 2), size - 1 - missing))
    return out


SIGNED = "seq binary, rn long, body binary, size long, tokens binary, ways binary"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes with their sizes; behind every few of them a chunk row: their tokens, and (node, tokens, spare) of each way."""
    shingles, tokens, ways, held = Shingles(), [], [], 0
    kinds = dict(zip(("seq", "rn", "body", "size", "tokens", "ways"), (pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.binary()), strict=True))

    def batch(n: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(n, kind) for c, kind in kinds.items()], names=list(kinds))

    def chunk() -> pa.RecordBatch:
        return batch(1, tokens=pa.array([np.concatenate(tokens).tobytes()], pa.binary()), ways=pa.array([np.array(ways, dtype=np.int64).tobytes()], pa.binary()))

    for b in small(batches):
        size = []
        for rn, body in zip(b.column("rn").to_pylist(), b.column("body").to_pylist(), strict=True):
            s = shingles.packed(body)
            size.append(len(s))
            for t, spare in tokens_of(s):
                tokens.append(t)
                ways.append((rn, len(t), spare))
                held += len(t)
        yield batch(b.num_rows, seq=b.column("seq"), rn=b.column("rn"), body=b.column("body"), size=pa.array(size, pa.int64()))
        if held >= CHUNK_TOKENS:
            yield chunk()
            tokens, ways, held = [], [], 0
    if ways:
        yield chunk()


def _cells_of(tokens: np.ndarray, bits: int) -> np.ndarray:
    return (mixed(tokens.view(np.uint64), 5) >> np.uint64(64 - bits)).astype(np.int64)


def _ranges(cells: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(range, from, to) over ascending cells."""
    at = np.flatnonzero(np.diff(cells >> RANGE_BITS, prepend=-1))
    for a, b in zip(at.tolist(), np.append(at, len(cells))[1:].tolist(), strict=True):
        yield int(cells[a] >> RANGE_BITS), a, b


def _counted(bits: int):
    """How many nodes of a chunk hold the tokens of each hash cell, by ranges of cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, 1):
            for chunk, tokens in zip(b.column("chunk").to_pylist(), b.column("tokens").to_pylist(), strict=True):
                cells, n = np.unique(_cells_of(np.frombuffer(tokens, dtype=np.int64), bits), return_counts=True)
                n = np.minimum(n, MOST).astype(np.uint8)
                parts = [(chunk, r, (cells[a:b] & ((1 << RANGE_BITS) - 1)).astype(np.uint32).tobytes(), n[a:b].tobytes()) for r, a, b in _ranges(cells)]
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in parts], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["chunk", "range", "cells", "counts"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add up a range's counts and tell each chunk those of its own cells."""
    current, parts = None, []

    def flush():
        total = np.zeros(1 << RANGE_BITS, dtype=np.uint16)
        places = [np.frombuffer(cells, dtype=np.uint32) for _, cells, _ in parts]
        for at, (_, _, counts) in zip(places, parts, strict=True):
            total[at] = np.minimum(total[at] + np.frombuffer(counts, dtype=np.uint8), MOST)
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in parts], pa.int64()), pa.array([current] * len(parts), pa.int64()), pa.array([total[at].astype(np.uint8).tobytes() for at in places], pa.binary())], names=["chunk", "range", "held"])

    for b in small(batches):
        for r, *part in zip(*(b.column(c).to_pylist() for c in ("range", "chunk", "cells", "counts")), strict=True):
            if r != current and parts:
                yield flush()
                parts = []
            current = r
            parts.append(part)
    if parts:
        yield flush()


def _rarest(bits: int):
    """(token, node): the tokens that a node is to share, less those that no other node holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, 1):
            for tokens, ways, told in zip(*(b.column(c).to_pylist() for c in ("tokens", "ways", "told")), strict=True):
                tokens = np.frombuffer(tokens, dtype=np.int64)
                cells, back = np.unique(_cells_of(tokens, bits), return_inverse=True)
                known = {x["range"]: x["held"] for x in told}
                held = np.concatenate([np.frombuffer(known[r], dtype=np.uint8) for r, _, _ in _ranges(cells)])[back]
                out_token, out_rn, at = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)], 0
                for rn, n, spare in np.frombuffer(ways, dtype=np.int64).reshape(-1, 3).tolist():
                    own, count = tokens[at : at + n], held[at : at + n]
                    first = np.lexsort((own, count))[: n - spare]
                    first = first[count[first] > 1]
                    out_token.append(own[first])
                    out_rn.append(np.full(len(first), rn, dtype=np.int64))
                    at += n
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in (out_token, out_rn)], names=["list", "rn"])

    return run


def _lists(chunks: DataFrame) -> DataFrame:
    """``list, rn``: nodes that share one of their rarest tokens; lists with the same least node are one, named by it.

    chunks: chunk, tokens, ways.  How rare a token is, is counted by hash cells, sixteen for each token: a count is the same
    for all holders of a token, so the order is one for all nodes, and a cell with a single holder is no shared token.
    """
    total = chunks.agg(F.coalesce(F.sum(F.octet_length("tokens")), F.lit(0))).first()[0] // 8
    bits = max(RANGE_BITS, (16 * max(1, total) - 1).bit_length())
    parts = chunks.select("chunk", "tokens").mapInArrow(_counted(bits), "chunk long, range long, cells binary, counts binary")
    n = min(1 << bits - RANGE_BITS, 4 * int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    told = parts.repartition(n, "range").sortWithinPartitions("range").mapInArrow(_added, "chunk long, range long, held binary")
    told = told.groupBy("chunk").agg(F.collect_list(F.struct("range", "held")).alias("told"))  # a byte for each cell of the chunk
    rare = stored(chunks.join(told, "chunk").select("tokens", "ways", "told").mapInArrow(_rarest(bits), "list long, rn long"))
    least = rare.groupBy("list").agg(F.min("rn").alias("least"), F.max("rn").alias("most")).filter("least < most")
    return stored(rare.join(least, "list").select(F.col("least").alias("list"), "rn").distinct())


def _bodies_of(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """``rn, body`` of the nodes that stand in a list.  A broadcast of at most 2**20 hash buckets keeps other texts out of the shuffle."""
    bucket = F.pmod(F.xxhash64("rn"), F.lit(1 << 20)).alias("bucket")
    ids = members.select("rn").distinct()
    some = nodes.select("rn", "body", bucket).join(F.broadcast(ids.select(bucket).distinct()), "bucket", "left_semi")
    return stored(some.join(ids, "rn", "left_semi").select("rn", "body"))


def _dealt(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows with their bodies, block by block."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    full = rows.join(nodes.select("rn", "body"), "rn").select("list", "p", "q", "side", "label", "body")
    return full.repartition(n, "list", "p", "q").sortWithinPartitions("list", "p", "q")


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    roots = _components(links).withColumnRenamed("node", "label")
    return stored(labels.join(roots, "label", "left").select("rn", F.coalesce("root", "label").alias("label")))


def _labelled(nodes: DataFrame, chunks: DataFrame, rounds: int, block: int) -> DataFrame:
    """``rn, label`` of the nodes that stand in some list; equal labels are one component."""
    members = _lists(chunks)
    nodes = _bodies_of(nodes, members)
    labels = stored(members.select("rn").distinct().withColumn("label", F.col("rn")))
    whole = lambda c: F.ceil(F.col(c) / block).cast("int")
    for turn in range(rounds):
        # every list's leader against the members of other classes; the leader has then met its list and leaves it
        state = members.join(labels, "rn")
        lead = state.groupBy("list").agg(F.min_by(F.struct("rn", "label"), F.xxhash64("rn", F.lit(turn)) if turn else F.col("rn")).alias("lead"), F.min("label").alias("lo"), F.max("label").alias("hi"))
        lead = stored(lead.filter("lo < hi").select("list", F.col("lead.rn").alias("lead"), F.col("lead.label").alias("lead_label")))
        open_ = stored(members.join(labels, "rn").join(lead, "list"))
        pairs = open_.filter("label <> lead_label").select("lead", "lead_label", "rn", "label").distinct()
        sizes = pairs.groupBy("lead").agg(F.count(F.lit(1)).alias("n"))
        pairs = stored(pairs.join(sizes, "lead").withColumn("q", F.pmod(F.xxhash64("rn"), whole("n")).cast("int")))
        asked = pairs.select("lead", F.col("lead_label").alias("label"), "q").distinct()
        rows = pairs.select(F.col("lead").alias("list"), F.lit(turn).alias("p"), "q", F.lit(1).alias("side"), "rn", "label").unionByName(
            asked.select(F.col("lead").alias("list"), F.lit(turn).alias("p"), "q", F.lit(0).alias("side"), F.col("lead").alias("rn"), "label")
        )
        labels = _merged(labels, stored(_dealt(rows, nodes).mapInArrow(_search, "u long, v long")))
        members = stored(open_.filter("rn <> lead").select("list", "rn"))
        if members.isEmpty():
            return labels

    state = stored(members.join(labels, "rn"))
    classes = state.groupBy("list", "label").agg(F.count(F.lit(1)).alias("n"))
    sizes = classes.groupBy("list").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.sum("n").alias("n"), (F.sum("n") - F.max("n")).alias("out")).filter("out > 0")
    open_ = state.join(stored(sizes.select("list", "main", whole("n").alias("n"), whole("out").alias("out"))), "list")
    own = lambda c: F.pmod(F.xxhash64("rn"), F.col(c)).cast("int")
    every = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    nowhere = F.array().cast("array<struct<p:int,q:int,side:int>>")
    places = F.concat(
        F.transform(every("out"), lambda k: F.struct(k.alias("p"), own("n").alias("q"), F.lit(1).alias("side"))),
        F.when(F.col("label") != F.col("main"), F.transform(every("n"), lambda k: F.struct(own("out").alias("p"), k.alias("q"), F.lit(0).alias("side")))).otherwise(nowhere),
    )
    rows = stored(open_.select("list", "rn", "label", F.inline(places)))
    return _merged(labels, stored(_dealt(rows, nodes).mapInArrow(_search, "u long, v long").distinct()))


# ---- the operator -----------------------------------------------------------------------------


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in small(batches):
        seq = [hashlib.blake2b(b" ".join(w), digest_size=16).digest() if (w := words_of(t)) else None for t in b.column("t").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("id"), pa.array(seq, pa.binary())], names=["doc", "id", "seq"])


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in small(batches):
        joined = [j for t in b.column("t").to_pylist() if (j := b" ".join(words_of(t)))]
        yield pa.RecordBatch.from_arrays([pa.array([hashlib.blake2b(j, digest_size=16).digest() for j in joined], pa.binary()), pa.array([zlib.compress(j, 4) for j in joined], pa.binary())], names=["seq", "body"])


def overlap_components(docs: DataFrame, keep: Sequence[str] | None = ("doc_id",), text: str = "text", doc_id: str = "doc_id", rounds: int = 1, block: int = BLOCK) -> DataFrame:
    """``doc`` (kept columns), ``n_shingles`` and ``component_id`` for every row.

    Words lie between white space, A-Z lower-cased.  A row's set holds its distinct runs of three words; of fewer words the
    whole is one element.  Rows link at a Jaccard similarity of 0.9, and ``component_id`` is the least id that links lead to,
    its own included.  A text without words (NULL, empty) has no shingles and links with nothing.  A row with a NULL id links
    as any other but names no component; it is NULL where all ids of the component are.  Repeated rows are copies; no rows
    give none.
    """
    rows = nested(docs, keep, t=text, id=doc_id).withColumn("id", F.col("id").cast("long"))
    base = reliable(rows.mapInArrow(_described, T.StructType([rows.schema["doc"], rows.schema["id"], T.StructField("seq", T.BinaryType())])))
    first = base.filter("seq is not null").groupBy("seq").agg(F.min("id").alias("id"))
    distinct = rows.select("t").mapInArrow(_bodies, "seq binary, body binary").groupBy("seq").agg(F.first("body").alias("body"))
    signed = distinct.withColumn("rn", F.monotonically_increasing_id()).mapInArrow(_sign, SIGNED)
    signed = stored(signed.withColumn("chunk", F.monotonically_increasing_id()))
    nodes = signed.filter("rn is not null").select("seq", "rn", "body", "size")
    labels = _labelled(nodes, signed.filter("rn is null").select("chunk", "tokens", "ways"), rounds, block)
    known = nodes.select("seq", "rn", "size").join(first, "seq")
    classed = stored(known.join(labels, "rn", "left").select("seq", "size", "id", F.coalesce("label", "rn").alias("label")))
    heads = stored(classed.groupBy("label").agg(F.min("id").alias("component")))
    verdict = stored(classed.join(heads, "label").select("seq", "size", "component"))
    return base.join(verdict, "seq", "left").select("doc", F.coalesce("size", F.lit(0)).cast("long").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
