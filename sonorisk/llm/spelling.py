"""Spelling variants by search schemes over a bidirectional FM-index.

Words of one insertion, deletion or replacement apart share their first half or their second half.  A block of the vocabulary
is one text of words between delimiters, with an FM-index of it and one of its mirror; a pattern is a pair of suffix-rank
intervals, one in each, that is extended to either side.  Two schemes find all neighbours: match the first half with its
delimiter exactly and extend to the right across the other half allowing one error, or the mirror of that.  Steps are taken
for all words of a block at once, over wavelet matrices.

Scale: a word goes to the blocks of its halves (as indexed, for the three lengths that a neighbour can have; as asked, for its
own), so a search meets only words that share a half.  Halves with too many letters are dealt over several blocks and asked in
each, so none is dropped and no block is unbounded.  A block returns one row for each word that found something, never pairs.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sonorisk.llm.common import LOWER, UPPER, nested, small, stored

RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = str.maketrans(UPPER, LOWER)
TASK_WORDS = 200_000
BLOCK_LETTERS = 250_000
CELLS = 200_000


# ---- words ------------------------------------------------------------------------------------


def altered(prefix: int, run: str, one_in: int) -> str:
    """The run without one code point, if its checksum behind ``prefix`` says so."""
    h = zlib.crc32(run.encode(), prefix)
    if h % one_in:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _counted(one_in: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, int] = {}

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

        for b in small(batches):
            for i, text in zip(b.column("id").to_pylist(), b.column("t").to_pylist(), strict=True):
                if not text:
                    continue
                own: dict[str, int] = {}
                for w, n in Counter(RUN.findall(text)).items():
                    w = w.lower() if w.isascii() else w.translate(_LOWER)
                    own[w] = own.get(w, 0) + n
                prefix = zlib.crc32(f"{'' if i is None else i}:".encode())
                for w, n in own.items():
                    w = altered(prefix, w, one_in)
                    found[w] = found.get(w, 0) + n
                if len(found) >= TASK_WORDS:
                    yield flush()
                    found = {}
        if found:
            yield flush()

    return run


# ---- index ------------------------------------------------------------------------------------


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Positions of the suffixes in ascending order, by doubling; the end comes before every symbol."""
    rank, width = text.astype(np.int64) + 1, 1
    while True:
        after = np.zeros(len(text), dtype=np.int64)
        after[: max(0, len(text) - width)] = rank[width:]
        key = rank * (int(rank.max()) + 1) + after
        order = np.argsort(key, kind="stable")
        rank = np.empty(len(text), dtype=np.int64)
        rank[order] = np.concatenate([[1], 1 + np.cumsum(np.diff(key[order]) != 0)])
        if rank[order[-1]] == len(text):
            return order
        width *= 2


class RankIndex:
    """FM-index of a text of symbols; symbol 0 delimits.  Intervals are of suffix ranks, as arrays."""

    def __init__(self, text: np.ndarray, symbols: int):
        order = suffix_order(text)
        self.size = len(text)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])[:-1]  # suffixes that begin with a smaller symbol
        delimiters = int((text == 0).sum())
        self.word_at_rank = (np.cumsum(text == 0) - 1)[order[:delimiters]]  # number of the delimiter that a rank begins with
        self.zeros, self.offset = [], []
        bwt = text[order - 1]
        for bit in range(max(1, int(symbols - 1).bit_length()) - 1, -1, -1):
            ones = (bwt >> bit & 1).astype(bool)
            self.zeros.append(np.concatenate([[0], np.cumsum(~ones)]).astype(np.int32))
            self.offset.append(int((~ones).sum()))
            bwt = np.concatenate([bwt[~ones], bwt[ones]])
        self.first = np.zeros(symbols, dtype=np.int64)
        kept, at = np.unique(bwt, return_index=True)
        self.first[kept] = at

    def extended(self, lo: np.ndarray, hi: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The intervals with ``symbol`` put in front, and how many in each had a smaller symbol there."""
        smaller = np.zeros(len(lo), dtype=np.int64)
        for k, (zeros, offset) in enumerate(zip(self.zeros, self.offset, strict=True)):
            one = (symbol >> (len(self.zeros) - 1 - k) & 1).astype(bool)
            lo0, hi0 = zeros[lo], zeros[hi]
            smaller += np.where(one, hi0 - lo0, 0)
            lo, hi = np.where(one, offset + lo - lo0, lo0), np.where(one, offset + hi - hi0, hi0)
        back = self.before[symbol] - self.first[symbol]
        return lo + back, hi + back, smaller

    def children(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(interval, symbol, lo, hi) for every symbol that stands in front of an interval; visits only those."""
        row, symbol = np.arange(len(lo)), np.zeros(len(lo), dtype=np.int64)
        for zeros, offset in zip(self.zeros, self.offset, strict=True):
            lo0, hi0 = zeros[lo], zeros[hi]
            row, symbol = np.concatenate([row, row]), np.concatenate([2 * symbol, 2 * symbol + 1])
            lo, hi = np.concatenate([lo0, offset + lo - lo0]), np.concatenate([hi0, offset + hi - hi0])
            some = hi > lo
            row, symbol, lo, hi = row[some], symbol[some], lo[some], hi[some]
        back = self.before[symbol] - self.first[symbol]
        return row, symbol, lo + back, hi + back


class Vocabulary:
    """Distinct words of a block, ascending, with the two indexes."""

    def __init__(self, words: Sequence[str], asked: Sequence[str] = ()):
        self.words = sorted(words)
        letters = np.unique(np.frombuffer("".join([*self.words, *asked]).encode("utf-32-le"), dtype=np.uint32))
        self.letters = letters
        ends = np.cumsum([len(w) + 1 for w in self.words], dtype=np.int64)
        text = np.zeros(int(ends[-1]) + 1 if len(ends) else 1, dtype=np.int64)
        inner = np.ones(len(text), dtype=bool)
        inner[0] = False
        inner[ends] = False
        text[inner] = self.coded("".join(self.words))
        self.ahead, self.mirror = RankIndex(text, len(letters) + 1), RankIndex(text[::-1], len(letters) + 1)

    def coded(self, s: str) -> np.ndarray:
        return np.searchsorted(self.letters, np.frombuffer(s.encode("utf-32-le"), dtype=np.uint32)).astype(np.int64) + 1

    def neighbours(self, asked: Sequence[str], first_half: bool) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``asked``, place in ``words``) of the words that share the first half, or the second, and are one error away."""
        order = sorted(range(len(asked)), key=lambda k: len(asked[k]))
        found, at = [], 0
        while at < len(order):  # words of like length, so that padding stays bounded
            to = at + 1
            while to < len(order) and (to + 1 - at) * len(asked[order[to]]) <= CELLS:
                to += 1
            part = order[at:to]
            lengths = np.array([len(asked[k]) for k in part])
            codes = np.zeros((len(part), int(lengths.max()) + 1), dtype=np.int64)  # the delimiter behind the word
            for row, k in zip(codes, part, strict=True):
                row[: len(asked[k])] = self.coded(asked[k] if first_half else asked[k][::-1])
            halves = lengths // 2 if first_half else lengths - lengths // 2
            q, rank = _searched(*((self.ahead, self.mirror) if first_half else (self.mirror, self.ahead)), codes, lengths, halves)
            second = self.mirror if first_half else self.ahead
            word = second.word_at_rank[rank]
            found.append((np.array(part)[q], len(self.words) - 1 - word if first_half else word))
            at = to
        q, v = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, dtype=np.int64),) * 2
        pairs = np.unique(q * max(1, len(self.words)) + v)
        return pairs // max(1, len(self.words)), pairs % max(1, len(self.words))


def _searched(one: RankIndex, other: RankIndex, codes: np.ndarray, lengths: np.ndarray, halves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row of ``codes``, rank in ``other`` of the whole word): the first half exactly, then one error in the rest.

    The half is matched from its end to its delimiter in ``one``, with the interval in ``other`` kept beside it; the rest
    extends the other side.
    """
    rows = np.arange(len(codes))
    lo, hi, olo = np.zeros(len(codes), dtype=np.int64), np.full(len(codes), one.size), np.zeros(len(codes), dtype=np.int64)
    for step in range(int(halves.max()) + 1):
        on = rows[(step <= halves) & (hi > lo)]
        symbol = np.where(step < halves[on], codes[on, halves[on] - 1 - step], 0)
        lo[on], hi[on], smaller = one.extended(lo[on], hi[on], symbol)
        olo[on] += smaller
    rows = rows[hi > lo]
    lo, hi = olo[rows], olo[rows] + (hi - lo)[rows]
    at, wrong = halves[rows].copy(), []
    while len(rows):  # the states without an error, all at once; what errs here goes to ``wrong``: row, next place, interval
        own = codes[rows, at]
        last = at == lengths[rows]
        k, symbol, clo, chi = other.children(lo, hi)
        use = (symbol > 0) & (symbol != own[k])
        k, clo, chi = k[use], clo[use], chi[use]
        wrong.append((rows[k], at[k], clo, chi))  # one more letter here
        more = ~last[k]
        wrong.append((rows[k][more], at[k][more] + 1, clo[more], chi[more]))  # another letter
        wrong.append((rows[~last], at[~last] + 1, lo[~last], hi[~last]))  # none
        lo, hi, _ = other.extended(lo, hi, own)
        go = ~last & (hi > lo)
        rows, at, lo, hi = rows[go], at[go] + 1, lo[go], hi[go]
    rows, at, lo, hi = (np.concatenate(x) for x in zip(*wrong, strict=True)) if wrong else (rows,) * 4
    done = []
    while len(rows):
        lo, hi, _ = other.extended(lo, hi, codes[rows, at])
        some = hi > lo
        end = some & (at == lengths[rows])
        done.append((rows[end], lo[end]))
        go = some & ~end
        rows, at, lo, hi = rows[go], at[go] + 1, lo[go], hi[go]
    return tuple(np.concatenate(x) for x in zip(*done, strict=True)) if done else (rows, lo)


def _block(rows: list[tuple]) -> tuple[list, list, list, list]:
    """Of each word asked in a block: how many neighbours, and the count and spelling of the commonest.

    rows: (word, n, side, letters in the half, indexed here, asked here).  A neighbour counts where it is indexed by the half
    that was asked for; other blocks may hold it by another one.
    """
    indexed = {w: n for w, n, _, _, index, _ in rows if index}
    sides = [sorted({w for w, _, side, _, _, ask in rows if ask and side == s}) for s in (0, 1)]
    v = Vocabulary(list(indexed), sides[0] + sides[1])
    place = {w: k for k, w in enumerate(v.words)}
    longest = 1 + max((len(w) for w in v.words), default=0)
    by = np.unique(np.array([(2 * place[w] + side) * longest + cut for w, _, side, cut, index, _ in rows if index], dtype=np.int64))
    counts = np.array([indexed[w] for w in v.words], dtype=np.int64)
    out: tuple[list, list, list, list] = ([], [], [], [])
    for side, asked in enumerate(sides):
        q, found = v.neighbours(asked, side == 0)
        cut = np.array([len(w) - len(w) // 2 if side else len(w) // 2 for w in asked], dtype=np.int64)
        here = np.isin((2 * found + side) * longest + cut[q], by)
        q, found = q[here], found[here]
        if side:  # what shares the first half as well is found by the other scheme
            new = np.array([not v.words[b].startswith(asked[a][: len(asked[a]) // 2]) for a, b in zip(q.tolist(), found.tolist(), strict=True)], dtype=bool)
            q, found = q[new], found[new]
        order = np.lexsort((found, -counts[found], q))
        q, found = q[order], found[order]
        start = np.flatnonzero(np.diff(q, prepend=-1))
        for s, n in zip(start.tolist(), np.diff(start, append=len(q)).tolist(), strict=True):
            for column, value in zip(out, (asked[q[s]], n, int(counts[found[s]]), v.words[found[s]]), strict=True):
                column.append(value)
    return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    current, rows = None, []

    def flush():
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(_block(rows), (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["word", "near", "best_n", "best"])

    for b in batches:
        for block, *row in zip(*(b.column(c).to_pylist() for c in ("block", "word", "n", "side", "cut", "index", "ask")), strict=True):
            if block != current and rows:
                yield flush()
                rows = []
            current = block
            rows.append(tuple(row))
    if rows:
        yield flush()


# ---- the operator -----------------------------------------------------------------------------


def vocabulary(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least_length: int = 6, least_count: int = 5, one_in: int = 199) -> DataFrame:
    """``word, n``: runs of letters of all texts, some short of a code point, that are long and frequent enough."""
    rows = nested(docs, (), t=text, id=doc_id).select("id", "t")
    counted = rows.mapInArrow(_counted(one_in), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.filter((F.col("n") >= least_count) & (F.char_length("word") >= least_length))


def _placed(words: DataFrame, block_letters: int) -> DataFrame:
    """``block, word, n, side, cut, index, ask``: every word at the blocks of its halves."""
    size = F.char_length("word")
    half = lambda n: F.floor(n / 2).cast("int")
    rest = lambda n: (n - F.floor(n / 2)).cast("int")

    def keys(side: int, part, cut) -> Column:
        own = part(size)
        return F.transform(F.array_distinct(F.array(part(size - 1), own, part(size + 1))), lambda k: F.struct(F.lit(side).alias("side"), cut(k).alias("half"), (k == own).alias("ask")))

    halves = F.concat(keys(0, half, lambda k: F.substring("word", F.lit(1), k)), keys(1, rest, lambda k: F.substring("word", size - k + 1, k)))
    rows = words.select("word", "n", F.inline(halves))
    groups = stored(rows.groupBy("side", "half").agg(F.sum(F.char_length("word") + 1).alias("letters"), F.count(F.lit(1)).alias("k")).filter("k > 1").drop("k"))
    total = groups.agg(F.coalesce(F.sum("letters"), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_letters))
    parts = F.ceil(F.col("letters") / block_letters).cast("int")
    own = F.pmod(F.xxhash64("word"), parts).cast("int")
    placed = rows.join(groups, ["side", "half"]).withColumn("own", own)
    placed = placed.withColumn("part", F.explode(F.when(F.col("ask"), F.sequence(F.lit(0), parts - 1)).otherwise(F.array("own"))))
    block = F.pmod(F.xxhash64("side", "half", "part"), F.lit(blocks))
    dealt = placed.select(block.alias("block"), "word", "n", "side", F.char_length("half").alias("cut"), (F.col("part") == F.col("own")).alias("index"), "ask")
    n = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(max(1, min(blocks, 8 * n)), "block").sortWithinPartitions("block")


def _followed(forms: DataFrame) -> DataFrame:
    """``word, root``: the end of each chain of forms, by doubling.  Counts grow fivefold a step, so chains are short."""
    roots = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        up = roots.select(F.col("word").alias("root"), F.col("root").alias("above"))
        onward = roots.join(up, "root", "left")
        if onward.filter("above is not null").isEmpty():
            return roots
        roots = stored(onward.select("word", F.coalesce("above", "root").alias("root")))


def spelling_variants(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least_length: int = 6, least_count: int = 5, one_in: int = 199, factor: int = 5, block_letters: int = BLOCK_LETTERS) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every word of the vocabulary.

    Words are runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased; where ``one_in`` divides the checksum of the id and the
    run, one code point goes.  Two words are near at one insertion, deletion or replacement.  A word's form is its near word of
    largest count (ties: the first in code-point order) if that is ``factor`` times its own at least.  NULL and empty texts
    have no words; a NULL id counts as an empty one.  Repeated rows count each time; no rows give none.
    """
    words = stored(vocabulary(docs, text, doc_id, least_length, least_count, one_in))
    found = _placed(words, block_letters).mapInArrow(_blocks, "word string, near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))).alias("best")
    near = found.groupBy("word").agg(F.sum("near").alias("n_near"), best)
    chosen = F.col("n_near").isNotNull() & (-F.col("best.n") >= factor * F.col("n"))
    formed = words.join(near, "word", "left").select(
        "word", F.when(chosen, F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(chosen, -F.col("best.n")).alias("form_n")
    )
    formed = stored(formed)
    roots = _followed(formed.filter("form is not null").select("word", "form"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
