"""Near-duplicate classes by ProbMinHash.

Documents are multisets of five-word shingles.  Each shingle sends points of a Poisson process, at the rate of its
count, to random registers; it stops as soon as its next point comes later than the document's latest register.  A
register keeps the shingle that came first, so two documents agree in it with their probability Jaccard similarity.
Banded registers give candidates, which are verified by the exact similarity.

Scale: equal texts are first reduced to one.  A bucket never emits its pairs: in rounds its members are compared with a
leader and classes are contracted.  What is still open, different classes that share a bucket, is compared in full, in
bounded blocks of documents, and a block emits only links that join classes, so no candidate is dropped.  Links and labels stay distributed; labels spread by minima and pointer jumping between
reliable checkpoints.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from sonorisk.llm.common import nested, reliable, small, stored
from sonorisk.llm.decontaminate import words_of as folded_words
from sonorisk.llm.hashing import Powers, WordHashes, mixed

SHINGLE = 5
BANDS, ROWS = 26, 5
BATCH_SHINGLES = 500_000
BLOCK = 256


class Shingler:
    def __init__(self) -> None:
        self.words, self.powers = WordHashes(), Powers()

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Distinct shingle hashes, ascending, and their counts; fewer than five words are one shingle."""
        words = folded_words(text)
        if not words:
            return np.zeros(0, dtype=np.uint64), np.zeros(0)
        h = mixed(self.powers.runs(self.words.of(words), min(SHINGLE, len(words))), len(words) if len(words) < SHINGLE else 0)
        values, counts = np.unique(h, return_counts=True)
        return values, counts.astype(float)


def signatures(docs: Sequence[tuple[np.ndarray, np.ndarray]], registers: int = BANDS * ROWS) -> np.ndarray:
    """One row of winning shingles for each document (none may be empty)."""
    doc = np.repeat(np.arange(len(docs)), [len(h) for h, _ in docs])
    h, weight = np.concatenate([h for h, _ in docs]), np.concatenate([c for _, c in docs])
    first = np.full(len(docs) * registers, np.inf)
    winner = np.zeros(len(docs) * registers, dtype=np.uint64)
    time, turn = np.zeros(len(h)), 0
    while len(h):
        unit = ((mixed(h, 2 * turn + 1) >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53
        time = time - np.log(unit) / weight
        running = time < first.reshape(-1, registers).max(axis=1)[doc]
        doc, h, weight, time = doc[running], h[running], weight[running], time[running]
        slot = doc * registers + (mixed(h, 2 * turn + 2) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(first, slot, time)
        won = first[slot] == time
        winner[slot[won]] = h[won]
        turn += 1
    return winner.reshape(-1, registers)


def band_keys(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    parts = signature.reshape(len(signature), bands, rows)
    key = np.broadcast_to(mixed(np.arange(bands, dtype=np.uint64), 77), parts.shape[:2])
    for r in range(rows):
        key = mixed(key ^ parts[:, :, r], r)
    return key.view(np.int64)


def probability_jaccard(ha: np.ndarray, ca: np.ndarray, hb: np.ndarray, cb: np.ndarray) -> float:
    """Sum over shared shingles i of 1 / sum over j of max(x_j / x_i, y_j / y_i), by one sort of the ratios."""
    _, i, j = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    order = np.argsort(ca[i] / cb[j], kind="stable")
    x, y = ca[i][order], cb[j][order]
    r = x / y
    only_a, only_b = ca.sum() - x.sum(), cb.sum() - y.sum()
    from_a = np.cumsum(x[::-1])[::-1]  # j at or after i has the larger ratio
    from_b = np.cumsum(y) - y
    return float((x / (only_a + from_a + r * (only_b + from_b))).sum())


def _components(edges: DataFrame) -> DataFrame:
    """``node, root``: the least node of each component of the edges ``u, v``.

    In a round every node hooks onto its least neighbour, hooks are followed four steps, and edges and roots move along;
    edges inside a merged node vanish.  Each merge at least halves the nodes that have edges, so few rounds are needed.
    """
    both = stored(edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).filter("u <> v").distinct())
    roots = stored(both.select(F.col("u").alias("node")).distinct().withColumn("root", F.col("node")))
    while not both.isEmpty():
        hook = stored(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("u"), F.min("v")).alias("up")))
        for _ in range(2):
            hook = stored(hook.join(hook.select(F.col("node").alias("up"), F.col("up").alias("above")), "up").select("node", F.col("above").alias("up")))
        moved = both.join(hook.select(F.col("node").alias("u"), F.col("up").alias("a")), "u").join(hook.select(F.col("node").alias("v"), F.col("up").alias("b")), "v")
        both = stored(moved.select(F.col("a").alias("u"), F.col("b").alias("v")).filter("u <> v").distinct())
        roots = stored(roots.join(hook.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("up", "root").alias("root")))
    return roots


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in small(batches):
        yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("id"), pa.array([_seq(t) for t in b.column("t").to_pylist()], pa.binary())], names=["doc", "id", "seq"])


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in small(batches):
        texts = b.column("t").to_pylist()
        seq, body = [_seq(t) for t in texts], [zlib.compress((t or "").encode(), 4) for t in texts]
        yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("id"), pa.array(seq, pa.binary()), pa.array(body, pa.binary())], names=["doc", "id", "seq", "body"])


def _seq(text: str | None) -> bytes | None:
    """Digest of the words between white space; none without words."""
    joined = b" ".join((text or "").encode().split())
    return hashlib.blake2b(joined, digest_size=16).digest() if joined else None


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingler, rns, sets, size = Shingler(), [], [], 0

    def flush():
        keys = band_keys(signatures(sets))
        return pa.RecordBatch.from_arrays([pa.array(keys.ravel(), pa.int64()), pa.array(np.repeat(rns, BANDS), pa.int64())], names=["key", "rn"])

    for b in small(batches):
        for rn, body in zip(b.column("rn").to_pylist(), b.column("body").to_pylist(), strict=True):
            s = shingler.of(zlib.decompress(body).decode())
            if len(s[0]):
                rns.append(rn)
                sets.append(s)
                size += len(s[0]) + BANDS * ROWS
            if size >= BATCH_SHINGLES:
                yield flush()
                rns, sets, size = [], [], 0
    if size:
        yield flush()


def _verifier(similarity: float):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, known = Shingler(), {}
        for b in small(batches):
            good = []
            for x, bx, by in zip(*(b.column(c).to_pylist() for c in ("a", "body_a", "body_b")), strict=True):
                if x not in known:
                    known = {x: shingler.of(zlib.decompress(bx).decode())}  # leaders come in runs
                good.append(probability_jaccard(*known[x], *shingler.of(zlib.decompress(by).decode())) >= similarity - 1e-12)
            yield b.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return verify


def _labelled(reps: DataFrame, similarity: float, star_rounds: int) -> DataFrame:
    """``rn, label`` of the distinct texts ``rn, body`` that share a bucket; equal labels are one class."""
    keys = reliable(reps.select("rn", "body").mapInArrow(_sign, "key long, rn long"))
    shared = stored(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key"))
    members = reliable(keys.join(shared, "key"))
    labels = stored(members.select("rn").distinct().withColumn("label", F.col("rn")))
    tried = None
    for turn in range(star_rounds):
        state = stored(members.join(labels, "rn"))
        order = F.xxhash64("rn", F.lit(turn))
        open_ = state.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min_by(F.struct("rn", "label"), order).alias("lead")).filter("lo < hi")
        open_ = stored(open_.select("key", F.col("lead.rn").alias("other"), F.col("lead.label").alias("other_label")))
        pairs = state.join(open_, "key").filter("label <> other_label")
        pairs = pairs.select(F.least("rn", "other").alias("a"), F.greatest("rn", "other").alias("b")).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = stored(pairs)
        if pairs.isEmpty():
            return labels  # every bucket lies in one class, or all its pairs have been compared
        tried = pairs if tried is None else tried.unionByName(pairs)
        with_b = pairs.join(reps.select(F.col("rn").alias("b"), F.col("body").alias("body_b")), "b")
        full = with_b.join(reps.select(F.col("rn").alias("a"), F.col("body").alias("body_a")), "a")
        links = stored(full.select("a", "b", "body_a", "body_b").mapInArrow(_verifier(similarity), "a long, b long"))
        edges = links.join(labels.select(F.col("rn").alias("a"), F.col("label").alias("u")), "a").join(labels.select(F.col("rn").alias("b"), F.col("label").alias("v")), "b").filter("u <> v")
        labels = _relabelled(labels, edges.select("u", "v").distinct())

    # whatever is still open: classes that share a bucket form a group, and a group is compared block by block
    state = stored(members.join(labels, "rn"))
    open_ = stored(state.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("key", "lo"))
    shares = stored(state.join(open_, "key").filter("label <> lo").select(F.col("lo").alias("u"), F.col("label").alias("v")).distinct())
    if shares.isEmpty():
        return labels
    grouped = stored(labels.join(_components(shares).withColumnRenamed("node", "label"), "label"))
    classes = grouped.groupBy("root", "label").agg(F.count(F.lit(1)).alias("n"))
    sizes = classes.groupBy("root").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.sum("n").alias("n"), (F.sum("n") - F.max("n")).alias("out"))
    count = lambda c: F.ceil(F.col(c) / BLOCK).cast("int").alias(c)
    dealt = grouped.join(stored(sizes.select("root", "main", count("n"), count("out"))), "root").join(reps.select("rn", "body"), "rn")
    # the rows outside a group's largest class meet all rows of the group: left blocks by right blocks
    each = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    own = lambda c: F.pmod(F.xxhash64("rn"), F.col(c)).cast("int")
    places = F.concat(
        F.transform(each("out"), lambda k: F.struct(k.alias("p"), own("n").alias("q"), F.lit(1).alias("side"))),
        F.when(F.col("label") != F.col("main"), F.transform(each("n"), lambda k: F.struct(own("out").alias("p"), k.alias("q"), F.lit(0).alias("side")))).otherwise(F.array().cast("array<struct<p:int,q:int,side:int>>")),
    )
    dealt = dealt.select("root", "label", "body", F.inline(places))
    n = int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = dealt.repartition(n, "root", "p", "q").sortWithinPartitions("root", "p", "q")
    return _relabelled(labels, stored(blocks.mapInArrow(_block_links(similarity), "u long, v long").distinct()))


def _relabelled(labels: DataFrame, edges: DataFrame) -> DataFrame:
    roots = _components(edges).withColumnRenamed("node", "label")
    return stored(labels.join(roots, "label", "left").select("rn", F.coalesce("root", "label").alias("label")))


def similarities(left: Sequence[tuple[np.ndarray, np.ndarray]], right: Sequence[tuple[np.ndarray, np.ndarray]], wanted: np.ndarray) -> np.ndarray:
    """Probability Jaccard of the wanted pairs, zero elsewhere.

    Shared shingles are counted by matrix products over slices of the common shingles.  Where both documents count each
    of their shingles equally often, the similarity is the Jaccard similarity of the sets; else it is taken pair by pair.
    """
    common = np.intersect1d(np.concatenate([h for h, _ in left]), np.concatenate([h for h, _ in right]))
    shared = np.zeros(wanted.shape, dtype=np.float32)
    for at in range(0, len(common), 8_192):
        part = common[at : at + 8_192]
        shared += _incidence(left, part) @ _incidence(right, part).T
    sizes = [np.array([len(h) for h, _ in side], dtype=float) for side in (left, right)]
    out = np.where(wanted, shared / np.maximum(sizes[0][:, None] + sizes[1][None, :] - shared, 1), 0.0)
    flat = [np.array([(c == c[0]).all() for _, c in side]) for side in (left, right)]
    for i, j in np.argwhere(wanted & (shared > 0) & ~(flat[0][:, None] & flat[1][None, :])):
        out[i, j] = probability_jaccard(*left[i], *right[j])
    return out


def _incidence(docs: Sequence[tuple[np.ndarray, np.ndarray]], part: np.ndarray) -> np.ndarray:
    m = np.zeros((len(docs), len(part)), dtype=np.float32)
    for k, (h, _) in enumerate(docs):
        at = np.minimum(np.searchsorted(part, h), len(part) - 1)
        m[k, at[part[at] == h]] = 1
    return m


def _block_links(similarity: float):
    """Links between different classes of two blocks, at most one for each two classes that a task finds apart."""

    def links(shingler: Shingler, rows: list[tuple[int, int, bytes]]) -> list[tuple[int, int]]:
        sides = [[r for r in rows if r[0] == side] for side in (0, 1)]
        sets = [[shingler.of(zlib.decompress(r[2]).decode()) for r in side] for side in sides]
        if not sides[0] or not sides[1]:
            return []
        ids = [np.array([r[1] for r in side]) for side in sides]
        near = similarities(*sets, ids[0][:, None] != ids[1][None, :]) >= similarity - 1e-12
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while parent.get(x, x) != x:
                x = parent[x]
            return x

        out = []
        for i, j in np.argwhere(near):
            u, v = find(int(ids[0][i])), find(int(ids[1][j]))
            if u != v:
                parent[max(u, v)] = min(u, v)
                out.append((int(ids[0][i]), int(ids[1][j])))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, current, rows = Shingler(), None, []

        def flush():
            found = links(shingler, rows)
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["u", "v"])

        for b in small(batches):
            for root, p, q, side, label, body in zip(*(b.column(c).to_pylist() for c in ("root", "p", "q", "side", "label", "body")), strict=True):
                if (root, p, q) != current:
                    if rows:
                        yield flush()
                    current, rows = (root, p, q), []
                rows.append((side, label, body))
        if rows:
            yield flush()

    return run


def near_duplicates(docs: DataFrame, keep: Sequence[str] | None = ("doc_id",), text: str = "text", doc_id: str = "doc_id", similarity: float = 0.8, star_rounds: int = 1) -> DataFrame:
    """``doc`` (kept columns), ``class_id`` and ``is_first`` for every row.

    Words are runs of ASCII letters and digits and of other characters, A-Z lower-cased.  Documents are linked when the
    probability Jaccard of their shingle counts reaches ``similarity``, or when their words, split at white space, are
    equal; a class is a component of links.  ``class_id`` is its least id, ``is_first`` marks one row of it, of least id.
    A text without words (NULL, empty) is a class alone, and so is a row with a NULL id, whose ``class_id`` is NULL.
    Repeated rows are copies; no rows give none.
    """
    rows = nested(docs, keep, t=text, id=doc_id).withColumn("id", F.col("id").cast("long"))

    base_type = T.StructType([rows.schema["doc"], rows.schema["id"], T.StructField("seq", T.BinaryType())])
    base = reliable(rows.mapInArrow(_summaries, base_type).withColumn("seq", F.when(F.col("id").isNotNull(), F.col("seq"))).withColumn("rid", F.monotonically_increasing_id()))
    firsts = base.filter("seq is not null").groupBy("seq").agg(F.min(F.struct("id", "rid")).alias("first"))
    bodies = rows.filter("id is not null").select(F.struct().alias("doc"), "id", "t").mapInArrow(_bodies, "doc struct<>, id long, seq binary, body binary")
    reps = reliable(bodies.filter("seq is not null").groupBy("seq").agg(F.first("body").alias("body")).withColumn("rn", F.monotonically_increasing_id()))
    labels = _labelled(reps, similarity, star_rounds)
    classed = reliable(firsts.join(reps.select("seq", "rn"), "seq").join(labels, "rn", "left").select("seq", "first", F.coalesce("label", "rn").alias("label")))
    heads = reliable(classed.groupBy("label").agg(F.min("first").alias("head")))
    verdict = reliable(classed.join(heads, "label").select("seq", "head"))
    own = F.struct("id", "rid")
    return base.join(verdict, "seq", "left").select("doc", F.coalesce(F.col("head.id"), F.col("id")).alias("class_id"), F.coalesce(own == F.col("head"), F.lit(True)).alias("is_first"))


def deduplicate(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", similarity: float = 0.8, star_rounds: int = 1) -> DataFrame:
    """The rows of ``docs`` with one row, of least id, for each class of ``near_duplicates``; rows that are a class alone stay.

    The kept texts come from the table of distinct texts, so texts are not joined again with the input.
    """
    others = [c for c in docs.columns if c != text]
    rows = nested(docs, others, t=text, id=doc_id).withColumn("id", F.col("id").cast("long"))
    alone = F.col("id").isNull() | ~F.coalesce(F.col("t").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    out_type = T.StructType([rows.schema["doc"], T.StructField("t", T.StringType())])
    in_type = T.StructType([rows.schema["doc"], rows.schema["id"], T.StructField("seq", T.BinaryType()), T.StructField("body", T.BinaryType())])
    bodies = rows.filter(~alone).mapInArrow(_bodies, in_type)
    one = bodies.groupBy("seq").agg(F.min_by(F.struct("doc", "body"), "id").alias("x"), F.min("id").alias("id"))
    reps = reliable(one.select("id", "x.doc", "x.body").withColumn("rn", F.monotonically_increasing_id()))
    labels = _labelled(reps, similarity, star_rounds)
    heads = labels.join(reps.select("rn", "id"), "rn").groupBy("label").agg(F.min_by("rn", F.struct("id", "rn")).alias("head"))
    losers = reliable(labels.join(reliable(heads), "label").filter("rn <> head").select("rn"))

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc"), pa.array([zlib.decompress(x).decode() for x in b.column("body").to_pylist()], pa.string())], names=["doc", "t"])

    kept = reps.join(losers, "rn", "left_anti").select("doc", "body").mapInArrow(texts, out_type)
    whole = rows.filter(alone).select("doc", "t").unionByName(kept)
    return whole.select(*[F.col("t").alias(text) if c == text else F.col(f"doc.`{c}`") for c in docs.columns])
