"""Secret scans by corpus-wide ownership frequency, in DataFrame functions only.

Every candidate value is hashed, and its hash is counted over distinct repositories and distinct owners of the
whole corpus.  A value that ``example_owners`` or more owners hold is a copied example; a rarer one looks live.
Spans of the base patterns are always reported; unlabelled high-entropy strings are added only when they look live.

Scale: texts are scanned where they lie and never shuffled; a row without candidates passes straight through.  Rows
with candidates are checkpointed, so later steps read them from the shared folder.  Counting goes from (hash, owner,
repository) to (hash, owner) to hash, each with map-side combine, so a value held by a third of all rows is spread
by repository first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from sonorisk.llm.common import nested, reliable


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


KEYWORDS = ("password", "passwd", "secret", "token", "api_?key")
ASSIGN = "(" + "|".join(map(_any_case, KEYWORDS)) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{12,}"  # a maximal run, so 16 characters or more of AKIA[A-Z0-9]+
HEX = "[0-9a-f]{32,}"
OPAQUE = "[A-Za-z0-9+/_=-]{20,}"
MIN_ASSIGNED = 8
#: kind, pattern, group of the value, least characters of the value; the order breaks ties of equal start.
BASE = (("assign", ASSIGN, 2, MIN_ASSIGNED), ("access", ACCESS, 0, 16), ("hex", HEX, 0, 32))
SPAN = "struct<s:bigint,k:int,e:bigint,kind:string,h:string>"  # sorts by start, then kind


def _opaque(v: Column) -> Column:
    return v.rlike("[A-Z]") & v.rlike("[a-z]") & v.rlike("[0-9]")


def _spans(text: Column, k: int, kind: str, pattern: str, group: int, least: int) -> Column:
    """Leftmost non-overlapping matches with code-point offsets.

    The pieces between matches and the matches themselves alternate, so offsets are running sums of their lengths.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.arrays_zip(
        F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)).alias("gap"), found.alias("hit"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("val")
    )
    none = F.array().cast(f"array<{SPAN}>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["pos"] + F.char_length(x["gap"])
        end = start + F.char_length(x["hit"])
        span = F.struct(start.alias("s"), F.lit(k).alias("k"), end.alias("e"), F.lit(kind).alias("kind"), F.md5(x["val"]).alias("h"))
        good = F.char_length(x["val"]) >= least
        if kind == "opaque":
            good = good & _opaque(x["val"])
        return F.struct(end.alias("pos"), F.when(good, F.concat(acc["out"], F.array(span).cast(f"array<{SPAN}>"))).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).cast("bigint").alias("pos"), none.alias("out"))
    return F.when(text.rlike(pattern), F.aggregate(parts, start, step, lambda acc: acc["out"])).otherwise(none)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def _of_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def ownership(candidates: DataFrame) -> DataFrame:
    """``h, owner, repo`` to ``h, n_repos, n_owners``: exact distinct counts."""
    by_repo = candidates.groupBy("h", "owner", "repo").agg(F.lit(1).alias("one"))
    by_owner = by_repo.groupBy("h", "owner").agg(F.count(F.lit(1)).alias("n"))
    return by_owner.groupBy("h").agg(F.sum("n").alias("n_repos"), F.count(F.lit(1)).alias("n_owners"))


def find_secrets(
    docs: DataFrame, example_owners: int = 3, keep: Sequence[str] | None = ("doc_id",), text: str = "text", repo: str = "doc_id", owner: str = "source",
) -> DataFrame:
    """One row per document: ``doc`` (kept columns), ``base`` and ``spans`` (arrays of spans by start, then kind), ``n_live``, ``n_example``.

    A span is ``s`` and ``e`` (code points, end exclusive), its ``kind``, with number ``k``, and ``h``, the hash of its value.  ``base``: assign,
    access and hex.  ``spans``: these and the added ``opaque`` ones, which overlap no base span and look live.
    ``n_live`` and ``n_example`` count the base spans by ownership.  A NULL text is empty; a NULL owner or repository
    is one of its own.  Repeated rows are reported once a row, and count as one repository.  No rows: none returned.
    """
    cols = {"t": text, "repo": repo, "owner": owner}
    rows = nested(docs, keep, **cols).withColumn("t", F.coalesce("t", F.lit("")))
    # a text that passes has a span or an opaque string; the two branches part all rows between them
    has = F.col("t").rlike("|".join([ASSIGN, ACCESS, HEX])) | F.col("t").rlike(OPAQUE)
    empty = F.array().cast(f"array<{SPAN}>")
    plain = rows.filter(~has).select("doc", empty.alias("base"), empty.alias("spans"), F.lit(0).cast("long").alias("n_live"), F.lit(0).cast("long").alias("n_example"))

    base = F.concat(*[_spans(F.col("t"), k, *p) for k, p in enumerate(BASE)])
    extra = F.filter(F.col("more"), lambda x: ~F.exists(F.col("base"), lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))
    hits = reliable(
        rows.filter(has)
        .select("doc", "repo", "owner", base.alias("base"), _spans(F.col("t"), len(BASE), "opaque", OPAQUE, 0, 20).alias("more"))
        .select("doc", "repo", "owner", "base", extra.alias("more"), F.monotonically_increasing_id().alias("rid"))
    )
    single = hits.select("rid", "repo", "owner", F.explode(F.concat("base", "more")).alias("x")).select("rid", "repo", "owner", "x", F.col("x.h").alias("h"))
    counts = reliable(ownership(single))
    live = F.col("n_owners") < example_owners
    in_base = F.col("x.k") < len(BASE)
    judged = single.join(counts, "h").groupBy("rid").agg(
        F.collect_list(F.when(live & ~in_base, F.col("x"))).alias("added"), F.sum((live & in_base).cast("long")).alias("n_live"), F.sum((~live & in_base).cast("long")).alias("n_example")
    )
    zero = F.lit(0).cast("long")
    found = hits.join(judged, "rid", "left").select(
        "doc", F.array_sort("base").alias("base"), F.array_sort(F.concat("base", F.coalesce("added", empty))).alias("spans"),
        F.coalesce("n_live", zero).alias("n_live"), F.coalesce("n_example", zero).alias("n_example"),
    )
    return plain.unionByName(found)


def digests(found: DataFrame) -> DataFrame:
    """The counts and digest columns of ``find_secrets`` rows."""
    return found.select(
        "doc", *[_of_kind(F.col("base"), k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), "n_live", "n_example",
    )


def masked(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """The text with every span, or union of overlapping spans, replaced by the mask."""
    start = F.struct(F.lit(0).cast("bigint").alias("pos"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        gap = F.substring(text, (acc["pos"] + 1).cast("int"), (x["s"] - acc["pos"]).cast("int"))
        apart = (x["s"] >= acc["pos"]) & ((x["s"] > acc["pos"]) | (F.size(acc["out"]) == 0))
        return F.struct(F.greatest(acc["pos"], x["e"]).alias("pos"), F.when(apart, F.concat(acc["out"], F.array(gap, F.lit(mask)))).otherwise(acc["out"]).alias("out"))

    def end(acc: Column) -> Column:
        return F.concat(F.array_join(acc["out"], ""), F.substring(text, (acc["pos"] + 1).cast("int"), F.char_length(text)))

    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, end)).otherwise(text)
