"""Sharding by proportional stratified interleaving, in DataFrame functions only.

Rows are shuffled by a seeded hash within their source, ranked, and sorted by fractional rank
``(rank - 1/2) / rows of the source``; cutting that order evenly gives every shard the corpus mixture.

Scale: no source is ranked in one task, nor is the order, but for rows of one fractional rank, which share a band: a corpus of
very many sources with a row each is one band.  The hash splits each source into cells of about
``cell_rows`` rows, so a rank is the rows of the cells before (a running sum over cell counts) plus the place in the
cell; the global order is cut into cells of fractional rank in the same way.  Only hashes, sizes and checksums are
shuffled, never texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from sonorisk.llm.common import reliable


def _cell(hex_hash: Column, cells: Column) -> Column:
    """Cell of a hash: its first 32 bits, scaled to the number of cells."""
    return F.floor(F.conv(F.substring(hex_hash, 1, 8), 16, 10).cast("long") * cells / F.lit(1 << 32)).cast("long")


def _rows_before(cells: DataFrame, group: list[str], cell: str, block: int = 4_096) -> DataFrame:
    """``offset``: the rows ``n`` of the earlier cells of the group, by running sums over blocks of cells and inside a block."""
    cells = reliable(cells.withColumn("block", F.floor(F.col(cell) / block).cast("long")))
    blocks = cells.groupBy(*group, "block").agg(F.sum("n").alias("n"))
    over_blocks = W.partitionBy(*group).orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    inside = W.partitionBy(*group, "block").orderBy(cell).rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0)
    blocks = blocks.select(*group, "block", F.coalesce(F.sum("n").over(over_blocks), zero).alias("outer_sum"))
    cells = cells.select(*group, "block", cell, F.coalesce(F.sum("n").over(inside), zero).alias("inner_sum"))
    return reliable(cells.join(blocks, [*group, "block"]).select(*group, cell, (F.col("outer_sum") + F.col("inner_sum")).alias("offset")))


def interleaved_shards(docs: DataFrame, n_shards: int = 8, seed: str = "shards", cell_rows: int = 2_000) -> DataFrame:
    """``doc_id, size, text_crc32, source, shard, slot`` for every row of ``docs`` (``doc_id, text, source``).

    Shard sizes in rows differ by one at most; slots run from 0 in each shard.  Size: UTF-8 bytes of the text plus one;
    a NULL text has none.  A NULL source is a stratum of its own.  Ties (repeated ids) are ordered by checksum and
    size; rows equal in all of these are interchangeable.  An empty table gives no rows.
    """
    raw = F.coalesce(F.encode(F.col("`text`"), "UTF-8"), F.lit(b""))
    narrow = docs.select(
        F.col("`doc_id`").alias("doc_id"), F.col("`source`").alias("source"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"),
        F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("`doc_id`").cast("string"), F.lit("null"))).cast("binary")).alias("h"),
    )
    narrow = reliable(narrow)
    stratum = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null"))
    rows = narrow.withColumn("stratum", stratum)
    strata = reliable(rows.groupBy("stratum").agg(F.count(F.lit(1)).alias("n_stratum")))
    total = strata.agg(F.coalesce(F.sum("n_stratum"), F.lit(0))).first()[0]

    # a source may hold any share of the rows: its count meets them under each first digit of their hashes
    salted = strata.withColumn("salt", F.explode(F.array(*[F.lit(d) for d in "0123456789abcdef"])))
    celled = rows.withColumn("salt", F.substring("h", 1, 1)).join(salted, ["stratum", "salt"]).drop("salt").withColumn("cell", _cell(F.col("h"), F.ceil(F.col("n_stratum") / cell_rows)))
    cells = _rows_before(celled.groupBy("stratum", "cell").agg(F.count(F.lit(1)).alias("n")), ["stratum"], "cell")
    order = [F.col(c).asc_nulls_first() for c in ("h", "doc_id", "text_crc32", "size")]
    in_cell = celled.withColumn("place", F.row_number().over(W.partitionBy("stratum", "cell").orderBy(*order)))
    ranked = in_cell.join(cells, ["stratum", "cell"]).withColumn("frac", (2 * (F.col("place") + F.col("offset")) - 1) / (2 * F.col("n_stratum")))
    ranked = reliable(
        ranked.select("doc_id", "source", "size", "text_crc32", "h", "stratum", "frac", F.floor(F.col("frac") * F.lit(-(-total // cell_rows))).cast("long").alias("band"))
    )
    bands = _rows_before(ranked.groupBy("band").agg(F.count(F.lit(1)).alias("n")), [], "band")
    place = F.row_number().over(W.partitionBy("band").orderBy("frac", "stratum", *order))
    position = F.col("offset") + F.col("place") - 1
    return (
        ranked.withColumn("place", place).join(bands, "band").withColumn("position", position)
        .withColumn("shard", F.floor(F.col("position") * n_shards / F.lit(max(1, total))).cast("int"))
        .select("doc_id", "size", "text_crc32", "source", "shard", (F.col("position") - F.ceil(F.col("shard").cast("long") * F.lit(total) / n_shards)).cast("long").alias("slot"))
    )
