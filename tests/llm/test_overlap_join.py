"""T-occurrence search against counting, components against all pairs."""

import random

import numpy as np
import pytest
from conftest_llm import documents, odd_rows

from sonorisk.llm import overlap_join as OJ


def counted(lists, least):
    return {m: k for m in {m for x in lists for m in x} if (k := sum(m in x for x in lists)) >= least}


@pytest.mark.parametrize("seed", range(6))
def test_divide_skip_equals_counting(seed):
    rng = random.Random(seed)
    lists = [sorted(rng.sample(range(60), rng.choice([0, 1, 2, 5, 40]))) for _ in range(25)]
    for least in (1, 2, 3, 7, 13, 25):
        assert dict(OJ.divide_skip(lists, least)) == counted(lists, least)
        assert dict(OJ.merge_skip(lists, least)) == counted(lists, least)


def test_inverted_lists_keep_the_limit():
    base = np.arange(1, 20, dtype=np.uint64)
    sets = [base, base[:-1], np.append(base, np.uint64(50)), base[:17], np.arange(3, 22, dtype=np.uint64), base[:0]]
    got = sorted(OJ.Inverted(sets).linked(base))
    want = [k for k, s in enumerate(sets) if 100 * len(np.intersect1d(base, s)) >= 90 * len(np.union1d(base, s))]
    assert got == want == [0, 1, 2]
    assert list(OJ.Inverted([base[::2], base[:17]]).linked(base)) == []  # shingles that the block lacks count for no list


def test_linked_sets_share_a_rare_token():
    """The rarest tokens of two linked sets meet under any order of the tokens, whatever way the sets take."""
    rng = np.random.default_rng(2)
    for size in (1, 5, 9, 10, 30, 249, 250, 251, 270, 278, 400, 1200):
        for _ in range(20):
            a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
            gone = size // 20
            b = np.unique(np.concatenate([a[gone:], rng.integers(0, 1 << 63, gone, dtype=np.uint64)]))
            if 100 * len(np.intersect1d(a, b)) < 90 * len(np.union1d(a, b)):
                continue
            order = int(rng.integers(1, 1 << 62))
            rare = [{t for tokens, spare in OJ.tokens_of(s) for t in sorted(tokens.tolist(), key=lambda t: (t * 2654435761) ^ order)[: len(tokens) - spare]} for s in (a, b)]
            assert rare[0] & rare[1]


def near_rows(seed=4):
    rng = random.Random(seed)
    rows, k = [], 1000
    for size in (1, 2, 3, 12, 40, 130, 300, 900):
        for _ in range(4):
            base = [f"w{rng.randrange(3000)}" for _ in range(size)]
            for edits in (0, 0, 1, 1, 2, 3, 5, 8):
                text = base[:]
                for _ in range(edits):
                    text[rng.randrange(size)] = f"x{rng.randrange(10**6)}"
                k += 1
                rows.append((k, " ".join(text), f"s{k % 3}"))
    passage = " ".join(f"p{j}" for j in range(60))
    rows += [(3000 + j, passage + " " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(20 + j)), "a") for j in range(30)]
    rng.shuffle(rows)
    return rows


def test_query_and_sql(write_tables, agree):
    rows = near_rows() + odd_rows()
    got = agree("op13_divide_skip", write_tables(documents=documents(rows)), ["documents"])
    assert len(got) == len(rows) and sum(r[0] != r[2] for r in got) > 50


@pytest.mark.parametrize("large,rounds,block", [(20, 0, 2), (60, 3, 100)])
def test_rounds_and_blocks_change_nothing(spark, write_tables, monkeypatch, large, rounds, block):
    docs = spark.read.parquet(write_tables(documents=documents(near_rows(8))) + "/documents.parquet")
    want = sorted(OJ.overlap_components(docs).select("doc.doc_id", "n_shingles", "component_id").collect())
    monkeypatch.setattr(OJ, "LARGE", large)
    monkeypatch.setattr(OJ, "CHUNK_TOKENS", 500)
    monkeypatch.setattr(OJ, "RANGE_BITS", 10)
    got = sorted(OJ.overlap_components(docs.repartition(7), rounds=rounds, block=block).select("doc.doc_id", "n_shingles", "component_id").collect())
    assert got == want


def test_no_rows(write_tables, agree):
    assert agree("op13_divide_skip", write_tables(documents=documents([])), ["documents"]) == []
    assert len(agree("op13_divide_skip", write_tables(documents=documents([(1, None, "a"), (2, " ", None), (None, None, "b")])), ["documents"])) == 3
