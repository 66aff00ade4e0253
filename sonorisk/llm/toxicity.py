"""Toxicity by nearest labelled examples under exact TF-IDF cosine.

Terms that set toxic examples apart are selected from labelled rows; document frequencies of these terms are counted
over all documents.  Labelled examples are indexed in blocks of postings with the highest weight of each term and
block; a query visits blocks by falling upper bound and stops when no block can beat its k-th neighbour, so the
neighbours are exact.  Their votes, weighted by cosine, are calibrated on the labelled rows, each judged without itself.

Scale: one pass counts the selected terms over all documents, one scores them where they lie; no text is shuffled.  The index
is a broadcast: at most ``max_examples`` labelled rows over ``max_terms`` terms.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from sonorisk.llm.common import nested, reliable, small

TERM = regex.compile(r"[\p{L}\p{M}\p{N}]+")
BLOCK = 64


def terms_of(text: str | None) -> list[str]:
    return TERM.findall(text.lower()) if text else []


def vector_of(text: str | None, number: dict[str, int]) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """Numbers of the selected terms of a text, ascending, and their counts."""
    found = sorted(Counter(number[x] for x in terms_of(text) if x in number).items())
    return tuple(t for t, _ in found), tuple(c for _, c in found)


def select_terms(term_counts: Sequence[tuple[str, int, int]], n_toxic: int, n_clean: int, max_terms: int, min_docs: int) -> list[str]:
    """Terms whose log odds towards toxic rows exceed twice their standard error, by that ratio."""
    scored = []
    for term, a, b in term_counts:
        if a + b < min_docs:
            continue
        odds = math.log((a + 0.5) / (n_toxic - a + 0.5)) - math.log((b + 0.5) / (n_clean - b + 0.5))
        z = odds / math.sqrt(1 / (a + 0.5) + 1 / (n_toxic - a + 0.5) + 1 / (b + 0.5) + 1 / (n_clean - b + 0.5))
        if z > 2 and odds > 1:
            scored.append((-z, term))
    return [t for _, t in sorted(scored)[:max_terms]]


class BlockMaxIndex:
    """Unit TF-IDF vectors in blocks of ``BLOCK`` examples; postings by block, block maxima by term."""

    def __init__(self, vectors: Sequence[tuple[Sequence[int], Sequence[float]]], votes: Sequence[tuple[float, float]], ids: Sequence[Sequence[int]], n_terms: int):
        self.votes, self.ids = np.array(votes, dtype=float).reshape(-1, 2), list(ids)
        self.n = len(vectors)
        blocks = -(-self.n // BLOCK)
        self.maxima = np.zeros((n_terms, blocks), dtype=np.float32)
        #: by block: terms, ascending; where the postings of each begin; rows; weights
        self.postings: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        for b in range(blocks):
            lists: dict[int, list[tuple[int, float]]] = {}
            for row, (terms, weights) in enumerate(vectors[b * BLOCK : (b + 1) * BLOCK]):
                for t, w in zip(terms, weights, strict=True):
                    lists.setdefault(t, []).append((row, w))
            order = sorted(lists)
            starts = np.cumsum([0, *(len(lists[t]) for t in order)])
            flat = [x for t in order for x in lists[t]]
            self.postings.append((np.array(order, dtype=np.int32), starts.astype(np.int32), np.array([r for r, _ in flat], dtype=np.uint8), np.array([w for _, w in flat], dtype=float)))
            for t, p in lists.items():
                # rounded up, so that a bound is never below the cosine
                self.maxima[t, b] = np.nextafter(np.float32(max(w for _, w in p)), np.float32(np.inf))

    def nearest(self, terms: Sequence[int], weights: Sequence[float], k: int, without: int = -1) -> list[tuple[float, int]]:
        """The k highest positive cosines with their example numbers, ties to the lower number."""
        if not len(terms) or not self.n:
            return []
        bound = np.asarray(weights) @ self.maxima[list(terms)] + 1e-9
        best: list[tuple[float, int]] = []
        for b in np.argsort(-bound, kind="stable"):
            if bound[b] <= 1e-9 or (len(best) >= k and bound[b] < -best[-1][0]):
                break
            scores = np.zeros(BLOCK)
            known, starts, rows, values = self.postings[b]
            for t, w, at in zip(terms, weights, np.searchsorted(known, terms), strict=True):
                if at < len(known) and known[at] == t:
                    part = slice(starts[at], starts[at + 1])
                    scores[rows[part]] += w * values[part]
            best += [(-s, int(b) * BLOCK + int(r)) for r in np.flatnonzero(scores) if (s := round(float(scores[r]), 12)) > 0 and int(b) * BLOCK + int(r) != without]
            best = sorted(best)[:k]
        return [(-s, e) for s, e in best]


def weigh(terms: Sequence[int], counts: Sequence[int], idf: np.ndarray) -> list[float]:
    """Unit-length weights (1 + ln tf) * idf."""
    w = [(1 + math.log(c)) * idf[t] for t, c in zip(terms, counts, strict=True)]
    norm = math.sqrt(sum(x * x for x in w)) or 1.0
    return [x / norm for x in w]


def vote(neighbours: Sequence[tuple[float, int]], votes: np.ndarray, prior: float, strength: float = 1.0) -> float:
    """Cosine-weighted share of toxic examples among the neighbours, with the prior rate as a vote of ``strength``."""
    top = sum(s * votes[e, 0] / votes[e].sum() for s, e in neighbours)
    return (top + strength * prior) / (sum(s for s, _ in neighbours) + strength)


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Platt calibration of the votes by Newton steps with a small ridge."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([(weight * (p - y) * x).sum() + 1e-3 * a, (weight * (p - y)).sum() + 1e-3 * b])
        v = weight * p * (1 - p)
        h = np.array([[(v * x * x).sum() + 1e-3, (v * x).sum()], [(v * x).sum(), v.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def _logit(p: float) -> float:
    p = min(1 - 1e-6, max(1e-6, p))
    return math.log(p / (1 - p))


def score_toxicity(
    docs: DataFrame, labels: DataFrame, keep: Sequence[str] | None = ("doc_id",), text: str = "text", doc_id: str = "doc_id",
    k: int = 15, threshold: float = 0.3, max_terms: int = 4_096, min_docs: int = 3, max_examples: int = 20_000, hold_out: bool = True,
) -> DataFrame:
    """``doc`` (kept columns), ``held_out, score, predicted`` and ``evidence`` (ids of the nearest examples) for every row.

    ``labels``: ``doc_id, toxic``; several rows of one id count as toxic if one is; NULLs teach nothing.  Rows whose
    crc32 of the id as text, modulo 4, is 2 are held out and never learned from (``hold_out=False`` learns from all).
    Learning takes the ``max_examples`` labelled rows first in the order of the md5 of their id.  A text without selected terms has no
    neighbours and gets the calibrated prior of such examples; so do NULL and empty texts.  Without any labels every
    score is 0.  Repeated rows are scored once a row; no rows give none.
    """
    spark = docs.sparkSession
    rows = nested(docs, keep, t=text, id=doc_id)
    held = F.coalesce(F.crc32(F.col("id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    known = labels.select(F.col("`doc_id`").alias("id"), F.col("`toxic`").cast("int").alias("y")).filter("id is not null and y is not null").groupBy("id").agg(F.max("y").alias("y"))
    if hold_out:
        known = known.filter(~held)
    first = known.orderBy(F.md5(F.col("id").cast("string").cast("binary")), "id").limit(max_examples)
    learn = reliable(rows.select("id", "t").join(F.broadcast(first), "id"))  # max_examples rows

    def distinct_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            pos, neg = Counter(), Counter()
            for t, y in zip(b.column("t").to_pylist(), b.column("y").to_pylist(), strict=True):
                (pos if y else neg).update(set(terms_of(t)))
            names = list(pos.keys() | neg.keys())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([pos[x] for x in names], pa.int64()), pa.array([neg[x] for x in names], pa.int64())], names=["term", "a", "b"])

    size = {r.y: r.n for r in learn.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_clean = size.get(1, 0), size.get(0, 0)
    counted = learn.mapInArrow(distinct_terms, "term string, a long, b long").groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    odds = F.log((F.col("a") + 0.5) / (n_toxic - F.col("a") + 0.5)) - F.log((F.col("b") + 0.5) / (n_clean - F.col("b") + 0.5))
    strongest = counted.filter(F.col("a") + F.col("b") >= min_docs).filter(odds > 1).orderBy(F.desc(odds * F.sqrt("a")), "term").limit(4 * max_terms)
    terms = select_terms([(r.term, r.a, r.b) for r in strongest.collect()], n_toxic, n_clean, max_terms, min_docs)
    shared_terms = spark.sparkContext.broadcast({t: i for i, t in enumerate(terms)})

    def document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, seen, n = shared_terms.value, Counter(), 0
        for b in small(batches):
            n += b.num_rows
            for t in b.column("t").to_pylist():
                seen.update({number[x] for x in terms_of(t) if x in number})
        yield pa.RecordBatch.from_arrays([pa.array([-1, *seen], pa.int32()), pa.array([n, *seen.values()], pa.int64())], names=["t", "n"])

    freq = {r.t: r.n for r in rows.select("t").mapInArrow(document_counts, "t int, n long").groupBy("t").agg(F.sum("n").alias("n")).collect()}  # max_terms rows
    n_docs = freq.pop(-1, 0)
    idf = np.full(len(terms), math.log(1 + n_docs) + 1)
    for t, n in freq.items():
        idf[t] = math.log((1 + n_docs) / (1 + n)) + 1

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared_terms.value
        for b in small(batches):
            found = [vector_of(t, number) for t in b.column("t").to_pylist()]
            lists = [pa.array([f[k] for f in found], pa.list_(pa.int32())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("y"), *lists], names=["id", "y", "terms", "counts"])

    vec_type = T.StructType([learn.schema["id"], T.StructField("y", T.IntegerType()), T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("counts", T.ArrayType(T.IntegerType()))])
    examples: dict[tuple, list] = {}
    for r in learn.select("id", "y", "t").mapInArrow(vectors, vec_type).collect():  # max_examples rows
        e = examples.setdefault((tuple(r.terms), tuple(r.counts)), [0, 0, []])
        e[0 if r.y else 1] += 1
        e[2].append(r.id)
    ordered = sorted(examples.items())
    vectors_ = [(t, weigh(t, c, idf)) for (t, c), _ in ordered]
    index = BlockMaxIndex(vectors_, [(e[0], e[1]) for _, e in ordered], [sorted(e[2])[:3] for _, e in ordered], len(terms))
    total = index.votes.sum()
    prior = float(index.votes[:, 0].sum() / total) if total else 0.0
    bare = next((index.votes[i] for i, (t, _) in enumerate(vectors_) if not t), np.zeros(2))
    rest = float((bare[0] + prior) / (bare.sum() + 1)) if total else 0.0  # examples without selected terms, and the prior as one vote

    xs, ys, ws = [], [], []
    for i, (t, w) in enumerate(vectors_):
        if t:
            near, own = index.nearest(t, w, k, without=i), index.votes[i]
            for y, n in ((1, own[0]), (0, own[1])):
                if n:
                    others = own - ([1, 0] if y else [0, 1])
                    again = [*near, *([(1.0, -1)] if others.sum() else [])]
                    table = np.vstack([index.votes, others])
                    xs.append(_logit(vote(again, table, prior)))
                    ys.append(y)
                    ws.append(n)
    a, b = fit_logistic(np.array(xs), np.array(ys, dtype=float), np.array(ws, dtype=float)) if len(set(ys)) == 2 else (1.0, 0.0)
    model = spark.sparkContext.broadcast((index, idf, prior, rest, a, b))

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, (index, idf, prior, rest, a, b) = shared_terms.value, model.value
        cache: dict[tuple, tuple[float, list[int]]] = {}
        for batch in small(batches):
            out = []
            for key in (vector_of(t, number) for t in batch.column("t").to_pylist()):
                if key not in cache:
                    if len(cache) > 50_000:
                        cache.clear()
                    near = index.nearest(key[0], weigh(*key, idf), k) if key[0] else []
                    s = 1 / (1 + math.exp(-max(-30.0, min(30.0, a * _logit(vote(near, index.votes, prior)) + b)))) if near else rest
                    cache[key] = s, [i for _, e in near[:3] for i in index.ids[e]][:3]
                out.append(cache[key])
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("id"), pa.array([o[0] for o in out], pa.float64()), pa.array([o[1] for o in out], pa.list_(batch.column("id").type))], names=["doc", "id", "score", "evidence"])

    out_type = T.StructType([rows.schema["doc"], rows.schema["id"], T.StructField("score", T.DoubleType()), T.StructField("evidence", T.ArrayType(rows.schema["id"].dataType))])
    return rows.select("doc", "id", "t").mapInArrow(scores, out_type).select("doc", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence")
