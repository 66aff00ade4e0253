"""Search schemes against comparison of all words, and the query against its SQL."""

import random

import numpy as np
import pytest
from conftest_llm import documents, odd_rows

from sonorisk.llm import spelling as SP


def near(a, b):
    """Exactly one insertion, deletion or replacement."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def word_set(seed, letters="ab", least=6, most=9, count=120):
    rng = random.Random(seed)
    return sorted({"".join(rng.choice(letters) for _ in range(rng.randint(least, most))) for _ in range(count)})


@pytest.mark.parametrize("words", [word_set(1), word_set(2, "abcé"), word_set(3, "aÿ", 6, 40), ["aaaaaa", "aaaaaaa", "aaaaaaaa"], ["abcdef"], []])
def test_schemes_find_all_neighbours(words):
    rows = []
    for k, w in enumerate(words):
        for side in (0, 1):
            own = len(w) - len(w) // 2 if side else len(w) // 2
            rows += [(w, k + 1, side, cut, True, cut == own) for cut in sorted({(len(w) + d + side) // 2 for d in (-1, 0, 1)})]
    got = {}
    for w, n, best_n, best in zip(*SP._block(rows), strict=True):
        old = got.get(w, (0, (0, "")))
        got[w] = (old[0] + n, min(old[1], (-best_n, best)))
    want = {}
    for k, w in enumerate(words):
        others = [(-(j + 1), v) for j, v in enumerate(words) if near(w, v)]
        if others:
            want[w] = (len(others), min(others))
    assert got == want


def test_suffix_order():
    text = np.array([0, 2, 1, 0, 2, 1, 1, 0])
    assert SP.suffix_order(text).tolist() == sorted(range(8), key=lambda k: text[k:].tolist())


def test_intervals_of_both_indexes():
    v = SP.Vocabulary(["abab", "abba", "baba"])
    lo, hi, smaller = v.ahead.extended(np.array([0]), np.array([v.ahead.size]), v.coded("a"))
    assert (hi - lo).tolist() == [6] and smaller.tolist() == [4]  # six suffixes begin with a, four with the delimiter
    rows, symbols, clo, chi = v.ahead.children(lo, hi)
    assert dict(zip(symbols.tolist(), (chi - clo).tolist(), strict=True)) == {0: 2, 2: 4}


def texts():
    words = word_set(5, "aeé", 5, 9, 160)
    rng = random.Random(9)
    rows = [(k, " ".join(rng.choice(words) + rng.choice(["", "", "'", "-", "1"]) for _ in range(300)), "a") for k in range(30)]
    return rows + [(31, "Colour COLOUR colour " * 40 + "color " * 6 + "coloor " * 5, None), (32, "straße" * 3, "b")] + odd_rows()


def test_query_and_sql(write_tables, agree):
    got = agree("op12_spelling_variants", write_tables(documents=documents(texts())), ["documents"])
    assert sum(r[5] != "~" for r in got) > 10 or len(got) > 50


def test_no_words(write_tables, agree):
    assert agree("op12_spelling_variants", write_tables(documents=documents([])), ["documents"]) == []
    assert agree("op12_spelling_variants", write_tables(documents=documents([(1, None, "a"), (2, "", "a"), (None, "short words only", "a")])), ["documents"]) == []


def test_large_halves_are_dealt_over_blocks(spark, write_tables):
    sf = write_tables(documents=documents(texts()))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    one, many = (sorted(map(str, SP.spelling_variants(docs, one_in=7, block_letters=n).collect())) for n in (1 << 20, 60))
    assert one == many and len(one) > 50


def test_chains_end_at_their_root(spark):
    rows = [("a" * 6 + "b" * k, "a" * 6 + "b" * (k + 1)) for k in range(9)]
    got = SP._followed(spark.createDataFrame(rows, "word string, form string")).collect()
    assert {r.root for r in got} == {"a" * 6 + "b" * 9} and len(got) == 9
