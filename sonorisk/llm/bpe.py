"""Byte-level BPE by a global distinct-word shuffle.

Documents are cut into chunks and into pre-tokens; each chunk sends its distinct pre-tokens, sorted and packed, to
the bucket of their hash, where every distinct word is encoded once.  The ids return to the chunk in the order in
which the words left, and the chunk's documents are reassembled by position.  Decoding joins the token-byte table.

Scale: a word crosses the network once a chunk, not once an occurrence.  A chunk is bounded in characters (one longer
document is a chunk alone) and travels compressed to meet its ids.  Nothing grows with the corpus but the number of
rows: the rank table is a broadcast of the vocabulary's fixed size, and a bucket holds a bounded cache, not the words.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import pickle
import re
import zlib
from array import array
from collections.abc import Callable, Iterator, Sequence
from itertools import accumulate, pairwise

import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from sonorisk.llm.common import nested

CHUNK_CHARS = 8_000_000
CACHE_WORDS = 200_000
PACKED = "chunk long, bucket int, body binary"


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 bytes and rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the adjacent pair of lowest rank (leftmost first) merges until none has a rank.

    Pairs wait in a heap and the pieces are a linked list, so a word of n bytes takes n log n steps.
    """
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    n = len(word)
    ends = list(range(1, n + 1))  # end of the piece that starts here; 0 when merged away
    before = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, end = heapq.heappop(heap)
        j = ends[i]
        if not j or j >= n or ends[j] != end:
            continue  # one of the two pieces has changed since
        ends[i], ends[j] = end, 0
        if end < n:
            before[end] = i
            if (r := ranks.get(word[i : ends[end]])) is not None:
                heapq.heappush(heap, (r, i, ends[end]))
        if (h := before[i]) >= 0 and (r := ranks.get(word[h:end])) is not None:
            heapq.heappush(heap, (r, h, end))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[word[i : ends[i]]])
        i = ends[i]
    return ids


def _latin_pattern(pattern: str) -> str:
    """The pattern with its classes spelled out for code points under 256, for the faster standard engine."""
    names = {c: "".join(f"\\x{k:02x}" for k in range(256) if regex.match(c, chr(k))) for c in (r"\p{L}", r"\p{N}", r"\s", r"\S")}
    out, inside, at = [], False, 0
    while at < len(pattern):
        name = next((c for c in names if pattern.startswith(c, at)), None)
        if name:
            out.append(names[name] if inside else f"[{names[name]}]")
            at += len(name)
        else:
            step = 2 if pattern[at] == "\\" else 1
            inside = pattern[at] == "[" or (inside and pattern[at] != "]")
            out.append(pattern[at : at + step])
            at += step
    return "".join(out)


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """All matches in a text.  A pattern with classes unknown to ``_latin_pattern`` always takes the general engine."""
    every, latin = regex.compile(pattern).findall, None
    if not re.search(r"\\[^\\pPsSrnt'\"]|\\[pP](?!\{[LN]\})|\(\?[^!:=]", pattern):
        latin = re.compile(_latin_pattern(pattern)).findall

    def split(text: str) -> list[str]:
        if latin:
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return every(text)
            return latin(text)
        return every(text)

    return split


def pack(obj) -> bytes:
    return zlib.compress(pickle.dumps(obj, protocol=5), 1)


def unpack(data: bytes):
    return pickle.loads(zlib.decompress(data))


def _chunks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[int, list, list[str]]]:
    """Chunk id, kept columns and texts; the same for every scan of the same partition."""
    number, docs, texts, size = TaskContext.get().partitionId() << 32, [], [], 0
    for b in batches:
        for doc, text in zip(b.column("doc").to_pylist(), b.column("t").to_pylist(), strict=True):
            docs.append(doc)
            texts.append(text or "")
            size += len(texts[-1]) + 64
            if size >= limit:
                yield number, docs, texts
                number, docs, texts, size = number + 1, [], [], 0
    if docs:
        yield number, docs, texts


def _pack_words(words: Sequence[bytes]) -> bytes:
    """Number of words, their lengths and their bytes."""
    return array("I", [len(words), *map(len, words)]).tobytes() + b"".join(words)


def _unpack_words(data: bytes) -> list[bytes]:
    n = array("I", data[:4])[0]
    ends = list(accumulate(array("I", data[4 : 4 * n + 4]), initial=4 * n + 4))
    return [data[a:b] for a, b in pairwise(ends)]


def _buckets(seen: set[str], ranks: dict[bytes, int], n: int) -> dict[int, list[bytes]]:
    """Distinct pre-tokens that are no token themselves, by bucket, sorted."""
    out: dict[int, list[bytes]] = {}
    for w in sorted(x.encode() for x in seen):
        if w not in ranks:
            out.setdefault(zlib.crc32(w) % n, []).append(w)
    return out


def _table(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=["chunk", "bucket", "body"])


def encode_documents(docs: DataFrame, rank_path: str, pattern: str, keep: Sequence[str] | None = ("doc_id",), text: str = "text", chunk_chars: int = CHUNK_CHARS, with_ids: bool = False) -> DataFrame:
    """``doc`` (kept columns), ``n_tokens, ids_sha256, decoded_sha256`` (and ``ids`` on demand) for every row.

    ``rank_path`` is read by the driver.  A NULL text is empty and has no tokens.  Repeated rows give repeated results;
    no rows give none.  Special tokens are ordinary text.
    """
    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast(read_ranks(rank_path))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = nested(docs, keep, t=text)
    doc_type = rows.schema["doc"].dataType

    def words_out(batches):
        find, table = splitter(pattern), ranks.value
        for chunk, _, texts in _chunks(batches, chunk_chars):
            seen: set[str] = set()
            for t in texts:
                seen.update(find(t))
            yield _table([(chunk, b, zlib.compress(_pack_words(ws), 1)) for b, ws in _buckets(seen, table, n).items()])

    def encode_words(batches):
        table, cache = ranks.value, {}
        for b in batches:
            done = []
            for chunk, bucket, body in zip(*(c.to_pylist() for c in b.columns), strict=True):
                data, ids = zlib.decompress(body), []
                for word in _unpack_words(data):
                    got = cache.get(word)
                    if got is None:
                        if len(cache) >= CACHE_WORDS:
                            cache.clear()
                        got = cache[word] = ",".join(map(str, merge(word, table)))
                    ids.append(got)
                done.append((chunk, bucket, zlib.compress(zlib.crc32(data).to_bytes(4, "big") + "\n".join(ids).encode(), 1)))
            yield _table(done)

    def bodies(batches):
        for chunk, docs_, texts in _chunks(batches, chunk_chars):
            yield _table([(chunk, -1, pack((docs_, texts)))])

    out_type = T.StructType(
        [T.StructField("doc", doc_type), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
        + ([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else [])
    )

    from pyspark.sql.pandas.types import to_arrow_type

    doc_arrow = to_arrow_type(doc_type)

    def reassemble(batches):
        find, table = splitter(pattern), ranks.value
        token_bytes = {str(i): w for w, i in table.items()}
        chunk, body, parts = None, None, []

        def finish():
            kept, texts = unpack(body)
            found = [find(t) for t in texts]
            seen = set().union(*found)
            listed: dict[str, str] = {}
            asked = _buckets(seen, table, n)
            for bucket, packed in parts:
                data, words = zlib.decompress(packed), asked.get(bucket, [])
                if data[:4] == zlib.crc32(_pack_words(words)).to_bytes(4, "big"):
                    listed.update(zip((w.decode() for w in words), data[4:].decode().split("\n"), strict=True))
            # a word without its bucket's answer is a token itself; or a repeated scan has cut the chunk differently
            for w in seen - listed.keys():
                listed[w] = ",".join(map(str, merge(w.encode(), table)))
            decoded = {w: b"".join(map(token_bytes.__getitem__, ids.split(","))) for w, ids in listed.items()}
            out = []
            for words in found:
                ids = ",".join(map(listed.__getitem__, words))
                back = b"".join(map(decoded.__getitem__, words))
                out.append((ids.count(",") + 1 if words else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(back).hexdigest(), [int(x) for x in ids.split(",") if x] if with_ids else None))
            cols = [pa.array(kept, doc_arrow), pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out]), pa.array([o[2] for o in out])]
            if with_ids:
                cols.append(pa.array([o[3] for o in out], pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(cols, names=out_type.names)

        for b in batches:
            for c, bucket, data in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if c != chunk:
                    if body is not None:
                        yield finish()
                    chunk, body, parts = c, None, []
                if bucket < 0:
                    body = data
                else:
                    parts.append((bucket, data))
        if body is not None:
            yield finish()

    answers = rows.mapInArrow(words_out, PACKED).repartition(n, "bucket").mapInArrow(encode_words, PACKED)
    return rows.mapInArrow(bodies, PACKED).unionByName(answers).repartition(n, "chunk").sortWithinPartitions("chunk", "bucket").mapInArrow(reassemble, out_type)
