"""Operators that SQL cannot express, against brute force, round trips and held-out labels."""

import hashlib
import random
import zlib
from itertools import combinations

import numpy as np
import pytest
from conftest_llm import WORDS, documents, odd_rows


def read(spark, sf, name="documents"):
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ---- nearest labelled examples


def toxic_rows(n=600):
    rng = random.Random(5)
    bad = ["scumword", "trashword", "idiotword"]
    rows, marks = [], []
    for k in range(n):
        words = [rng.choice(WORDS) for _ in range(rng.randrange(5, 60))]
        toxic = k % 5 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((k, " ".join(words), f"s{k % 3}"))
        marks.append((k, int(toxic)))
    return rows, marks


def test_block_max_index_is_exact():
    from sonorisk.llm.toxicity import BlockMaxIndex

    rng = np.random.default_rng(3)
    vectors = []
    for _ in range(500):
        t = np.sort(rng.choice(40, size=rng.integers(0, 8), replace=False))
        w = rng.random(len(t)) + 0.1
        vectors.append((t.tolist(), (w / (np.linalg.norm(w) or 1)).tolist()))
    dense = np.zeros((500, 40))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    index = BlockMaxIndex(vectors, [(1, 0)] * 500, [[i] for i in range(500)], 40)
    for q in range(0, 500, 7):
        want = sorted((-round(float(s), 9), i) for i, s in enumerate(dense @ dense[q]) if s > 0)[:15]
        got = [(-round(s, 9), i) for s, i in index.nearest(*vectors[q], k=15)]
        assert got == want


def test_toxicity_on_held_out_rows(spark, write_tables):
    from sonorisk.llm.toxicity import score_toxicity

    rows, marks = toxic_rows()
    labels = spark.createDataFrame([*marks, *marks[:50], (None, 1), (3, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in score_toxicity(read(spark, write_tables(documents=documents(rows))), labels).select("doc.doc_id", "held_out", "score", "predicted", "evidence").collect()}
    for k, toxic in marks:
        assert got[k].held_out == (zlib.crc32(str(k).encode()) % 4 == 2)
        assert got[k].predicted == toxic and 0 <= got[k].score <= 1
        assert not toxic or (got[k].evidence and all(zlib.crc32(str(e).encode()) % 4 != 2 for e in got[k].evidence))


def test_held_out_labels_are_never_read(spark, write_tables):
    from sonorisk.llm.toxicity import score_toxicity

    rows, marks = toxic_rows(200)
    docs = read(spark, write_tables(documents=documents(rows)))
    flipped = [(k, 1 - y if zlib.crc32(str(k).encode()) % 4 == 2 else y) for k, y in marks]
    one, two = (sorted(score_toxicity(docs, spark.createDataFrame(m, "doc_id long, toxic int")).select("doc.doc_id", "score").collect()) for m in (marks, flipped))
    assert one == two


def test_toxicity_odd_rows(spark, write_tables):
    from sonorisk.llm.toxicity import score_toxicity

    rows = odd_rows()
    docs = read(spark, write_tables(documents=documents(rows)))
    labels = spark.createDataFrame([(1, 1), (3, 0), (6, 0), (5, 1)], "doc_id long, toxic int")
    assert score_toxicity(docs, labels).count() == len(rows)
    none = score_toxicity(docs, labels.limit(0)).collect()
    assert len(none) == len(rows) and {r.score for r in none} == {0.0}
    assert score_toxicity(docs.limit(0), labels).count() == 0


# ---- main text


@pytest.mark.parametrize(
    "html, want",
    [
        (None, ""), ("", ""), ("   ", ""), ("plain  text\n only", "plain text only"), ("<p>one<p>two &amp; th&eacute;<br>ree", "one two & thé ree"),
        ("<nav><a>Home</a></nav><article><h1>A</h1><p>Some longer text of the article.<p>End.</article><footer>foot</footer>", "A Some longer text of the article. End."),
        ("<body><div class='cookie-notice'>We use cookies on this very long and tedious notice</div><main><p>Body text.</p><aside>x</aside><form><p>Send</p></form></main></body>", "Body text."),
        ("<article><header><h1>T</h1></header><section><p>aa bb cc dd ee</p></section><section><p>x</p></section><div id='comments'><p>nice words from a reader</p></div></article>", "T aa bb cc dd ee x"),
        ("<div id='menu'><a>m</a></div><div><p>fo<b>o</b>bar baz and more of it here</div><script>var a='<p>no</p>'</script><style>p{}</style><!-- no -->", "foobar baz and more of it here"),
        ("<div><ul><li><a>Home</a><li><a>About</a></ul><p>Hello there, this is the text</p></div>", "Hello there, this is the text"),
        ("<article><p>broken <b>bold<p>next</article></b></i><p>out", "broken bold next"),
    ],
)
def test_main_text(html, want):
    from sonorisk.llm.html_text import main_text

    assert main_text(html) == want


INTRO, BODY = "An introduction of some length that stands before the body.", " ".join(["The body of the article goes on and on here."] * 8)


@pytest.mark.parametrize(
    "html, want",
    [
        (f"<div id=content><p>{INTRO}</p><div class=body><p>{BODY}</p></div></div>", f"{INTRO} {BODY}"),
        (f"<div><p>{INTRO}</p><p><a href=x>{INTRO}</a></p><p>{INTRO}</p></div>", f"{INTRO} {INTRO} {INTRO}"),
        (f"<div class='has-sidebar'><article><p>{BODY}</p></article></div>", BODY),
        (f"<div class='post with-comments'><p>{BODY}</p><div id='comments'><p>nice</p></div></div>", BODY),
        (f"<form><div><p>{INTRO}</p><p>{BODY}</p></div></form>", f"{INTRO} {BODY}"),
        (f"<form><nav><a>Home</a></nav><main><p>{BODY}</p></main></form>", BODY),
        (f"<article><p>{INTRO}</p></article><div id=comments><article><p>{BODY}</p></article></div>", INTRO),
        (f"<nav>{BODY}</nav>", ""),
    ],
)
def test_main_text_outside_the_given_layout(html, want):
    from sonorisk.llm.html_text import main_text

    assert main_text(html) == want


def test_main_text_of_long_and_deep_pages():
    from sonorisk.llm.html_text import PIECE, main_text

    body = "<p>" + "</p><p>".join(f"word{k} and text" for k in range(60_000)) + "</p>"
    assert len(body) > PIECE
    assert main_text(f"<nav>x</nav><article>{body}</article>") == " ".join(f"word{k} and text" for k in range(60_000))
    assert main_text("<div>" * 20_000 + "deep text" + "</div>" * 20_000) == "deep text"


def test_pages_odd_rows(spark):
    from sonorisk.llm.html_text import extract_main_text

    pages = spark.createDataFrame([(1, "u", "<p>é\U0001f600</p>", "x"), (1, "u", "<p>é\U0001f600</p>", "x"), (None, None, None, None)], "page_id long, url string, html string, text string")
    got = extract_main_text(pages).collect()
    assert sorted((r.text, r.n_chars) for r in got) == [("", 0), ("é\U0001f600", 2), ("é\U0001f600", 2)]
    assert extract_main_text(pages.limit(0)).count() == 0


def test_article_text_of_all_pages(spark, sf):
    """The pages hold one article each: h1 and paragraphs."""
    import html
    import re

    from sonorisk.llm.html_text import main_text

    for r in read(spark, sf, "pages").collect():
        article = r.html.split("<article>")[1].split("</article>")[0]
        blocks = [" ".join(html.unescape(re.sub("<[^>]+>", " ", x)).split()) for x in re.split("</?(?:h1|p)>", article)]
        assert main_text(r.html) == " ".join(b for b in blocks if b)


# ---- near duplicates


def brute_classes(rows, similarity=0.8):
    """Exact probability Jaccard over all pairs, by its definition, and the components of the links."""
    from collections import Counter

    from sonorisk.llm.decontaminate import words_of

    bags, parent = {}, {}
    for k, (i, t, _) in enumerate(rows):
        w = words_of(t)
        bags[k] = Counter(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else None
        parent[k] = k

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def sim(x, y):
        return sum(1 / sum(max(x[j] / x[i], y[j] / y[i]) for j in x.keys() | y.keys()) for i in x.keys() & y.keys())

    for a, b in combinations(range(len(rows)), 2):
        same = (rows[a][1] or "").encode().split() == (rows[b][1] or "").encode().split() != []
        if rows[a][0] is None or rows[b][0] is None:
            continue
        if same or (bags[a] and bags[b] and bags[a].keys() & bags[b].keys() and sim(bags[a], bags[b]) >= similarity):
            parent[find(a)] = find(b)
    groups = {}
    for k in range(len(rows)):
        groups.setdefault(find(k), []).append(k)
    out = [None] * len(rows)
    for g in groups.values():
        for k in g:
            out[k] = None if rows[k][0] is None else min(rows[j][0] for j in g)
    return out


def near_rows():
    rng = random.Random(11)
    rows = []
    for g in range(12):
        base = [rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(rng.randrange(30, 120))]
        for _ in range(rng.randrange(1, 9)):
            copy = base[:]
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(["New", "other.", "THING"]) + str(rng.randrange(9))
            rows.append((1000 + len(rows), " ".join(copy), f"s{g % 3}"))
    rng.shuffle(rows)
    return rows + [r for r in odd_rows() if r[0] not in (9, 11)]  # one id has one text here


def test_near_duplicates_against_all_pairs(spark, write_tables):
    from sonorisk.llm.near_dups import near_duplicates

    rows = near_rows()
    got = near_duplicates(read(spark, write_tables(documents=documents(rows))), keep=["doc_id", "text"]).select("doc.doc_id", "doc.text", "class_id", "is_first").collect()
    key = lambda r: (str(r[0]), str(r[1]), str(r[2]))
    assert sorted(map(key, got)) == sorted((str(r[0]), str(r[1]), str(c)) for r, c in zip(rows, brute_classes(rows), strict=True))
    for c in {r.class_id for r in got} - {None, 6}:  # 6: two rows without words, each a class alone
        assert sum(r.is_first for r in got if r.class_id == c) == 1


def test_later_rounds_lose_no_link(spark, write_tables):
    """Without any round of leaders, and with several, the classes are the same."""
    from sonorisk.llm.near_dups import near_duplicates

    docs = read(spark, write_tables(documents=documents(near_rows())))
    none, many = (sorted(str(r) for r in near_duplicates(docs, star_rounds=n).collect()) for n in (0, 2))
    assert none == many


def test_deduplicate_keeps_one_row_of_a_class(spark, write_tables):
    from sonorisk.llm.near_dups import deduplicate

    rows = near_rows()
    docs = read(spark, write_tables(documents=documents(rows)))
    got = deduplicate(docs)
    assert got.columns == docs.columns
    want = sorted(str((r[0], r[1])) for r in {(c, c) for c in brute_classes(rows) if c is not None})
    kept = [r for r in got.collect() if r.doc_id is not None and (r.text or "").encode().split()]
    alone = [r for r in rows if r[0] is None or not (r[1] or "").encode().split()]
    assert sorted(str((r.doc_id, r.doc_id)) for r in kept) == sorted(w for w in want if w not in {str((r[0], r[0])) for r in alone})
    assert got.count() == len(kept) + len(alone)
    assert deduplicate(docs.limit(0)).count() == 0


def test_registers_estimate_probability_jaccard():
    from sonorisk.llm.near_dups import probability_jaccard, signatures

    rng = np.random.default_rng(1)
    h = rng.integers(1, 1 << 63, 300, dtype=np.uint64)
    a, b = (np.sort(h[:220]), rng.integers(1, 5, 220).astype(float)), (np.sort(h[80:]), rng.integers(1, 5, 220).astype(float))
    s = signatures([a, b], registers=4000)
    exact = probability_jaccard(*a, *b)
    x, y = dict(zip(*a, strict=True)), dict(zip(*b, strict=True))
    assert abs(exact - sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in x.keys() | y.keys()) for i in x.keys() & y.keys())) < 1e-9
    assert abs((s[0] == s[1]).mean() - exact) < 0.04


def test_added_sketches_never_underestimate():
    import pyarrow as pa

    from sonorisk.llm import substrings as SB

    rng = np.random.default_rng(2)
    chunks = [rng.choice(rng.integers(0, 1 << 63, 6000, dtype=np.uint64), 900, replace=False) for _ in range(2)]
    chunks.append(np.concatenate([chunks[0][:300], rng.integers(0, 1 << 63, 400, dtype=np.uint64)]))
    bits = SB.sketch_bits(3000)
    table = []
    for k, h in enumerate(chunks):
        sketch = SB.CountMin(bits)
        sketch.add(h[:500], np.ones(500))
        sketch.add(h[500:], np.ones(len(h) - 500))
        table += [(k, r, p, cells.tobytes(), counts.tobytes()) for r, p, cells, counts in sketch.parts()]
    table.sort(key=lambda x: x[1:3])
    names = ["chunk", "line", "range", "cells", "counts"]
    batch = pa.RecordBatch.from_pydict({n: [row[j] for row in table] for j, n in enumerate(names)})
    told = [row for b in SB._merged(iter([batch])) for row in b.to_pylist()]
    n = {v: c for v, c in zip(*np.unique(np.concatenate(chunks), return_counts=True), strict=True)}
    for k, h in enumerate(chunks):
        h = np.unique(h)
        one = pa.RecordBatch.from_pydict({"anchors": [h.view(np.int64).tobytes()], "owners": [np.array([(9, len(h))]).tobytes()], "held": [np.arange(len(h), dtype=np.int32).tobytes()], "answers": [[x for x in told if x["chunk"] == k]]})
        flagged = {x["h"] for b in SB._flags(bits)(iter([one])) for x in b.to_pylist()}
        want = {int(np.uint64(v).view(np.int64)) for v in h if n[v] > 1}
        assert want <= flagged and len(flagged - want) < 30


# ---- token ids


def test_token_ids_match_the_library(spark, write_tables):
    import public_tokenizers as P
    import tiktoken

    from sonorisk.llm.bpe import encode_documents, read_ranks

    path = P.path("byte_bpe_multi_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(path), special_tokens={})
    rows = odd_rows() + [(300, "<|endoftext|> it's   we'll\n\n 12٣٤ 日本語 ​ x́", "a"), (301, "a" * 3000, "a")]
    docs = read(spark, write_tables(documents=documents(rows)))
    got = encode_documents(docs, path, P.PATTERN, keep=["doc_id", "text"], chunk_chars=5_000, with_ids=True).collect()
    assert len(got) == len(rows)
    for r in got:
        ids = enc.encode_ordinary(r.doc.text or "")
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((r.doc.text or "").encode()).hexdigest()
    assert encode_documents(docs.limit(0), path, P.PATTERN).count() == 0


def test_latin_pattern_splits_alike():
    import public_tokenizers as P
    import regex

    from sonorisk.llm.bpe import splitter

    rng, split, every = random.Random(4), splitter(P.PATTERN), regex.compile(P.PATTERN).findall
    for _ in range(3000):
        s = "".join(chr(rng.choice([rng.randrange(256), rng.randrange(32, 127), 39, 32, 10])) for _ in range(rng.randrange(30)))
        assert split(s) == every(s)


# ---- the pipeline


def test_pipeline_against_brute_force(spark, write_tables):
    """Each stage on what its predecessor kept, by plain Python over all rows."""
    import re

    import corpus_pipeline as cp
    import pyarrow as pa

    rows, marks = toxic_rows(400)
    rows, marks = [(r[0] + 20_000, *r[1:]) for r in rows], [(k + 20_000, y) for k, y in marks]
    rows = [*rows, *near_rows(), (5000, "x " + " ".join(f"bench{k}" for k in range(12)) + " y", "a")]
    bench = pa.table({"item_id": pa.array([1], pa.int64()), "text": pa.array([" ".join(f"BENCH{k}," for k in range(12))])})
    labels = pa.table({"doc_id": pa.array([m[0] for m in marks], pa.int64()), "quality": pa.array([1] * len(marks), pa.int32()), "toxic": pa.array([m[1] for m in marks], pa.int32())})
    sf = write_tables(documents=documents(rows), benchmark=bench, labels=labels)
    docs, kept = read(spark, sf), {}
    for k, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, sf)
        assert k == 4 or out.columns == docs.columns
        out.write.parquet(f"{sf}/{name}")
        docs = spark.read.parquet(f"{sf}/{name}")
        kept[name] = docs.collect()
    bad = {k for k, y in marks if y}
    assert sorted(str(r.doc_id) for r in kept["toxicity"]) == sorted(str(r[0]) for r in rows if r[0] not in bad)
    left = [(r.doc_id, r.text, None) for r in kept["toxicity"]]
    classes = brute_classes(left)
    expected = {c for c in classes if c is not None} | {None}
    assert {r.doc_id for r in kept["near_duplicates"]} == expected
    assert {r.doc_id for r in kept["decontamination"]} == expected - {5000}
    plain = {r.doc_id: r.text for r in kept["decontamination"] if r.doc_id is not None}
    for r in kept["secrets"]:
        if r.doc_id == 14:
            assert "[SECRET]" in r.text and not re.search("AKIA[A-Z0-9]{12}|[0-9a-f]{32}|abcdefgh12345678", r.text) and r.n_chars == len(r.text)
        elif r.doc_id is not None and r.doc_id not in (15, 16, 19):  # 19 holds long hexadecimal runs
            assert r.text == plain[r.doc_id]
    texts = sorted(hashlib.sha256((r.text or "").encode()).hexdigest() for r in kept["secrets"])
    assert sorted(r.decoded_sha256 for r in kept["token_ids"]) == texts
    assert sorted(str(r) for r in cp.run(spark, sf).collect()) == sorted(str(r) for r in kept["token_ids"])


def test_pipeline_without_rows(spark, write_tables):
    import corpus_pipeline as cp
    import pyarrow as pa

    bench = pa.table({"item_id": pa.array([], pa.int64()), "text": pa.array([], pa.string())})
    labels = pa.table({"doc_id": pa.array([], pa.int64()), "quality": pa.array([], pa.int32()), "toxic": pa.array([], pa.int32())})
    assert cp.run(spark, write_tables(documents=documents([]), benchmark=bench, labels=labels)).count() == 0
